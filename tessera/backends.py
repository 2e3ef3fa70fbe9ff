"""Pluggable models: embedders, and language models behind a small protocol. The deterministic ones are stand-ins for tests."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
import re
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384
HASH_MODEL = "hash-test"


def hash_embed(text: str, dim: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of lower-case tokens in hashed places, of unit length."""
    out = np.zeros(dim, dtype=np.float32)
    for token in text.lower().split():
        h = hashlib.blake2b(token.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % dim] += 1.0 if h[4] & 1 else -1.0
    return out / max(float(np.linalg.norm(out)), 1e-12)


def embed(text: Column, dim: int = DIMENSIONS) -> Column:
    """Hash embeddings of a text column, by Arrow batches; a null text is empty."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: hash_embed(t or "", dim))

    return run(text)


class Embedder(Protocol):
    """Vectors of batches of texts. ``available`` says whether the model can be loaded here; questions may be embedded in another
    way than documents."""

    name: str
    available: bool

    def documents(self, texts: list[str]) -> np.ndarray: ...

    def queries(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """Scores of batches of texts for one question, read together."""

    name: str
    available: bool

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """The deterministic stand-in."""

    name, available = HASH_MODEL, True

    def __init__(self, dim: int = DIMENSIONS):
        self.dim = dim

    def documents(self, texts: list[str]) -> np.ndarray:
        return np.array([hash_embed(t, self.dim) for t in texts], dtype=np.float32).reshape(len(texts), self.dim)

    queries = documents


class NeuralEmbedder:
    """A model of the ``fastembed`` package, where that is installed; loaded once in each worker process."""

    def __init__(self, name: str, batch: int = 64):
        self.name, self.batch = name, batch
        self._model = None

    def __getstate__(self) -> dict:
        return {"name": self.name, "batch": self.batch, "_model": None}  # a loaded model does not travel

    @property
    def available(self) -> bool:
        return importlib.util.find_spec("fastembed") is not None

    def _loaded(self):
        if self._model is None:
            from fastembed import TextEmbedding

            self._model = TextEmbedding(model_name=self.name)
        return self._model

    def documents(self, texts: list[str]) -> np.ndarray:
        return np.array(list(self._loaded().embed(texts, batch_size=self.batch)), dtype=np.float32)

    def queries(self, texts: list[str]) -> np.ndarray:
        return np.array(list(self._loaded().query_embed(texts)), dtype=np.float32)


class CrossEncoder:
    """A reranker of the ``fastembed`` package, where that is installed; loaded once in each worker process."""

    def __init__(self, name: str):
        self.name = name
        self._model = None

    def __getstate__(self) -> dict:
        return {"name": self.name, "_model": None}

    @property
    def available(self) -> bool:
        return importlib.util.find_spec("fastembed") is not None

    def score(self, query: str, texts: list[str]) -> list[float]:
        if self._model is None:
            from fastembed.rerank.cross_encoder import TextCrossEncoder

            self._model = TextCrossEncoder(model_name=self.name)
        return [float(s) for s in self._model.rerank(query, texts)]


def chosen(*models):
    """The first model that is available here, or None: what is asked for, then what to fall back to."""
    return next((m for m in models if m is not None and m.available), None)


def vectors(text: Column, embedder: Embedder, *, queries: bool = False) -> Column:
    """Unit vectors of a text column by Arrow batches; a null text is empty."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            found = (embedder.queries if queries else embedder.documents)([t or "" for t in part])
            size = np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12) if len(found) else 1.0
            yield pd.Series(list((found / size).astype(np.float32)), index=part.index)

    return run(text)


class LanguageModel(Protocol):
    def chat(self, messages: list[dict], *, temperature: float | None = None, max_tokens: int | None = None) -> Iterator[str]: ...


def complete(model: LanguageModel, messages: list[dict], **options) -> str:
    return "".join(model.chat(messages, **options))


class ModelError(RuntimeError):
    """The language model gave no answer."""


class Echo:
    """Says the end of the last thing the user said."""

    def chat(self, messages: list[dict], *, temperature: float | None = None, max_tokens: int | None = None) -> Iterator[str]:
        said = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
        yield f"[echo] {said[-400:]}"


class Scripted:
    """Gives prepared answers in turn, the last one for ever; an exception is raised."""

    def __init__(self, *answers: str | Exception):
        self.answers, self.asked = list(answers), []

    def chat(self, messages: list[dict], *, temperature: float | None = None, max_tokens: int | None = None) -> Iterator[str]:
        self.asked.append(messages)
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(answer, Exception):
            raise answer
        yield answer


class Http:
    """A chat server that streams JSON lines."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "qwen3.5:9b", timeout: float = 600):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def chat(self, messages: list[dict], *, temperature: float | None = 0.2, max_tokens: int | None = 900) -> Iterator[str]:
        body = {"model": self.model, "messages": messages, "stream": True, "options": {"temperature": temperature, "num_predict": max_tokens}}
        request = urllib.request.Request(f"{self.url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                yield from parse_stream(answer)
        except OSError as e:
            raise ModelError(str(e)) from e

    def tags(self) -> list[str]:
        return [m["name"] for m in self._models("/api/tags")]

    def running(self) -> list[dict]:
        """Loaded models: name, bytes, and how much of them lies on the GPU."""
        return [placement(m) for m in self._models("/api/ps")]

    def _models(self, path: str) -> list[dict]:
        try:
            with urllib.request.urlopen(self.url + path, timeout=10) as answer:
                return json.load(answer).get("models", [])
        except OSError as e:
            raise ModelError(f"no answer from {self.url}: {e}") from e

    def has_model(self, name: str) -> bool:
        return has_model(self.tags(), name)


def placement(model: dict) -> dict:
    """name, bytes and percent on the GPU of a loaded model, as the server reports it; one without a size has none there."""
    size, there = model.get("size") or 0, model.get("size_vram") or 0
    return {"name": model.get("name"), "bytes": size, "gpu_percent": round(100 * there / size, 1) if size else 0.0}


def megabytes(size: int) -> float:
    """Millions of bytes to one place."""
    return round(size / 1e6, 1)


def has_model(names: list[str], name: str) -> bool:
    return any(n in (name, f"{name}:latest") or n.startswith(f"{name}:") for n in names)


def parse_stream(lines) -> Iterator[str]:
    """Texts of a stream of JSON lines; blank and malformed lines are passed over, an error is raised, ``done`` ends it."""
    for line in lines:
        try:
            part = json.loads(line)
        except ValueError:
            continue
        if part.get("error"):
            raise ModelError(part["error"])
        text = (part.get("message") or {}).get("content")
        if text:
            yield text
        if part.get("done"):
            return


def setting(name: str, default, given=None):
    """A setting: what is given, else the environment's value by the default's type (empty: the default), else the default."""
    if given is not None:
        return given
    raw = os.environ.get(name, "")
    if raw == "":
        return default
    if isinstance(default, bool):
        return raw.strip().lower() in ("1", "true", "yes", "on")
    return type(default)(raw)


def strip_thinking(text: str) -> str:
    text = re.sub(r"(?is)<think>.*?</think>", "", text)
    return re.sub(r"(?is)\A\s*<think>.*?(</think>|\Z)", "", text).strip()
