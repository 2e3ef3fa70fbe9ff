"""Packing token sequences by harmonic classes.

Capacity is 2048 tokens. Class k holds the pieces longer than 2048 / (k + 1) and up to 2048 / k, and a bin of it is exactly
k pieces. A length is snug if its bins waste at most ``LOOSE`` tokens, were all k pieces as long as it. A document gives
as many whole sequences as it fills; its rest is one piece if it is snug, and is else cut into two to four snug pieces, as
few as can be and the shortest as long as can be. Where a piece would be short, the rest and one whole sequence are cut together, so that few
pieces are.

Each worker fills the bins of each class on its own. Pieces of bins that are open when its rows end, fewer than k of each
class, are brought together by class and fill bins of k in the same way. What is still open then is fewer than k pieces
of each class in the whole corpus, some thousands, and is laid into sequences by first fit, the longest first.

Scale: the texts are read once and not exchanged; the pieces, some twenty bytes each, are written to the scratch folder.
Only pieces of open bins travel, again without their ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, only, table

CAPACITY = 2048
#: Tokens that a bin may waste; a rest with a piece below ``SHORT`` is cut together with a whole sequence if that helps.
LOOSE, SHORT = 16, 128
#: Open pieces of one class that one task brings together.
TOGETHER = 1_000_000
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and encodes each run of letters, single digit, and run of other signs on its own. Texts
    of plain Latin letters and ASCII signs are split here in the same way and each run is encoded by the library once; in
    other texts, so are the plain words, and all other words go to the library whole.
    """

    _LATIN = "a-zß-öø-ÿ"
    _PLAIN = re.compile(rf"[\t-\r -~{_LATIN}À-ÖØ-Þ]*")
    _RUNS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9\t-\r ]+")
    _WORDS = re.compile(r"[^\t-\r ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        return "<|" not in text and self._PLAIN.fullmatch(text) is not None

    def _runs(self, text: str) -> list[str]:
        if self._plain(text):
            return self._RUNS.findall(text.lower())
        return [r for w in self._WORDS.findall(text) for r in (self._RUNS.findall(w.lower()) if self._plain(w) else (w,))]

    def _learn(self, new: list[str]) -> None:
        known = self.known
        if len(known) > 600_000:
            for old in list(islice(known, 300_000)):
                del known[old]
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            whole = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            cuts = np.flatnonzero(np.diff(np.array(whole.word_ids, dtype=np.float64))) + 1
            if len(cuts) == len(part) - 1:
                raw = np.array(whole.ids, dtype="<u4").tobytes()
                ends = [0, *(4 * cuts).tolist(), len(raw)]
                known.update((r, raw[a:b]) for r, a, b in zip(part, ends, ends[1:], strict=False))
            else:  # some are not one run for the library
                found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
                known.update((r, np.array(e.ids, dtype="<u4").tobytes()) for r, e in zip(part, found, strict=True))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        runs = [self._runs(t) for t in texts]
        found = [list(map(self.known.get, r)) for r in runs]
        new = {k for r, f in zip(runs, found, strict=True) if None in f for k, x in zip(r, f, strict=True) if x is None}
        if new:
            odd = {k for k in new if not self._plain(k)}
            self._learn(sorted(new - odd))
            fresh = {k: np.array(e.ids, dtype="<u4").tobytes() for k, e in zip(odd, self.tokenizer.encode_batch_fast(list(odd), add_special_tokens=False), strict=True)}
            fresh |= {k: self.known[k] for k in new - odd}
            for r, f in zip(runs, found, strict=True):
                if None in f:
                    f[:] = [fresh[k] if x is None else x for k, x in zip(r, f, strict=True)]
            self.known.update(fresh)
        yield from map(b"".join, found)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process; it outlives a task."""
    return Encoder(path)


def snug(length: int) -> bool:
    """Whether a bin of pieces of this length is full but for ``LOOSE`` tokens."""
    return 0 < length <= CAPACITY and CAPACITY - CAPACITY // length * length <= LOOSE


@lru_cache(1)
def _splits() -> list[tuple[int, ...]]:
    """The pieces of each length below two sequences: as few as can be, all snug, the shortest as long as can be; longest first."""
    good = [n for n in range(1, CAPACITY + 1) if snug(n)]
    out: list[tuple[int, ...]] = [()] * (2 * CAPACITY)
    for n in good:
        out[n] = (n,)
    for pieces in (2, 3, 4):
        found: dict[int, tuple[int, ...]] = {}
        for n in range(len(out)):
            if len(out[n]) == pieces - 1:
                for a in good:
                    if a <= out[n][-1] and n + a < len(out) and not out[n + a]:
                        found[n + a] = max(found.get(n + a, ()), (*out[n], a), key=lambda p: (p[-1] if p else 0, p))
        for n, p in found.items():
            out[n] = p
    return out


def cuts(length: int) -> list[int]:
    """Lengths of the pieces of a document of so many ids."""
    whole, rest = divmod(length, CAPACITY)
    parts = _splits()[rest]
    if whole and rest and parts[-1] < SHORT:
        longer = _splits()[rest + CAPACITY]
        if longer and longer[-1] > parts[-1]:
            whole, parts = whole - 1, longer
    return [CAPACITY] * whole + list(parts)


Piece = tuple  # (id, start, length, crc32 of the ids, tokens of the document)


class Packer:
    """Fills bins for one task; ``base`` makes its sequence ids distinct from those of other tasks."""

    def __init__(self, base: int = 0):
        self.next = base
        self.open: dict[int, list[Piece]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: Sequence[Piece]) -> None:
        """One sequence of the pieces."""
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def put(self, piece: Piece) -> None:
        """Put a piece into its class's open bin."""
        k = CAPACITY // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self.close(bin_)
            bin_.clear()

    def add(self, key, ids: bytes) -> None:
        """Cut and put a document."""
        start, tokens = 0, len(ids) // 4
        for n in cuts(tokens):
            self.put((key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens))
            start += n

    def leave(self) -> None:
        """Rows without a sequence for the pieces of open bins."""
        self.rows += [(*piece, None, None) for bin_ in self.open.values() for piece in bin_]
        self.open.clear()

    def finish(self) -> None:
        """Lay the open pieces into sequences, the longest first, each into the first that has room."""
        bins: list[list[Piece]] = []
        room: list[int] = []
        for piece in sorted((p for bin_ in self.open.values() for p in bin_), key=lambda p: (-p[2], *p[3:], p[1], str(p[0]))):
            for at, left in enumerate(room):
                if left >= piece[2]:
                    break
            else:
                at = len(bins)
                bins.append([])
                room.append(CAPACITY)
            bins[at].append(piece)
            room[at] -= piece[2]
        self.open.clear()
        for bin_ in bins:
            self.close(bin_)

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * (1 + len(COLUMNS))
        self.rows.clear()
        return pa.record_batch([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["id", *COLUMNS])


def _pack(path: str | None):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path is None:
            import public_tokenizers

            own = encoder(public_tokenizers.path(TOKENIZER))
        else:
            own = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 33)
        kind = None
        end = END_ID.to_bytes(4, "little")
        for batch in chunks:
            kind = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 500):
                keys, texts = (batch.column(k).slice(i, 500).to_pylist() for k in (0, 1))
                for key, ids in zip(keys, own.texts([t or "" for t in texts]), strict=True):
                    packer.add(key, ids + end)
                if len(packer.rows) > 5000:
                    yield packer.batch(kind)
        packer.leave()
        if packer.rows:
            yield packer.batch(kind)

    return run


def _gather(round_: int, last: bool):
    """Fill bins from the open pieces of other tasks; ``last``: and lay what is still open into sequences."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer((round_ << 58) + (TaskContext.get().partitionId() << 33))
        kind = None
        for batch in chunks:
            kind = batch.schema.field(0).type
            for piece in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                packer.put(piece)
            if len(packer.rows) > 5000:
                yield packer.batch(kind)
        if last:
            packer.finish()
        else:
            packer.leave()
        if packer.rows:
            yield packer.batch(kind)

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents, packed: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a tokenizer file on the workers (None: the installed ``word_bpe_49k.json``). A null or
    empty text is the end id alone. Repeated rows and null ids are packed as rows of their own; a text of any length is
    cut. A sequence holds 2048 tokens at most and is padded to 2048 unless its length is a power of two. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = only(docs, id=id_col, text=text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COLUMNS)
    pieces = materialise(rows.mapInArrow(_pack(tokenizer), schema), "pieces")
    out, left = pieces.where("sequence_id IS NOT NULL"), pieces.where("sequence_id IS NULL")
    n = left.count()
    class_ = F.floor(F.lit(CAPACITY) / F.col("length"))
    for round_, parts in ((1, -(-n // TOGETHER)), (2, 1)):
        if round_ == 2 or parts > 1:
            spread = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(max(parts, 1)))
            dealt = left.repartition(class_, spread).sortWithinPartitions(class_, spread, "id", "start", "ids_crc32")
            pieces = materialise(dealt.mapInArrow(_gather(round_, False), schema), "pieces")
            out, left = out.union(pieces.where("sequence_id IS NOT NULL")), pieces.where("sequence_id IS NULL")
    # fewer than k pieces of each class k remain
    out = out.union(left.repartition(1).mapInArrow(_gather(3, True), schema))
    return out.withColumnRenamed("id", id_col)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
