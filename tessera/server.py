"""Thin HTTP adapters over an index and over a campaign: JSON, server-sent events, and a page. Standard library only."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from tessera.backends import Echo, Http, ModelError
from tessera.operators import index, search_index, turns
from tessera.operators.campaign import Campaign

#: One page for both: a form that posts its text and shows the events.
PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>
<form id="f"><input id="q" size="80" autofocus><button>Send</button></form><pre id="o" style="white-space:pre-wrap"></pre><script>
f.onsubmit = async e => {{ e.preventDefault(); o.textContent = "";
  const r = (await fetch("{path}", {{method: "POST", body: JSON.stringify({{{field}: q.value}})}})).body.pipeThrough(new TextDecoderStream()).getReader();
  let rest = "";
  for (;;) {{ const {{value, done}} = await r.read(); if (done) break; const parts = (rest + value).split("\\n\\n"); rest = parts.pop();
    for (const p of parts) {{ const d = JSON.parse(p.slice(6)); o.textContent += d.type == "token" ? d.text : d.error ? "\\n" + d.error : ""; }} }} }};
</script></body></html>"""


class Adapter(BaseHTTPRequestHandler):
    """Routes: functions of the request's JSON (POST) or query (GET) that give a JSON value, or a generator of events."""

    routes: dict[tuple[str, str], Callable[[dict], object]] = {}
    page = ""

    def log_message(self, *_) -> None:
        """Quiet."""

    def _send(self, body: bytes, kind: str = "application/json", code: int = 200) -> None:
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def _stream(self, events: Iterable[dict]) -> None:
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.send_header("Cache-Control", "no-cache")
        self.end_headers()
        for event in events:
            self.wfile.write(f"data: {json.dumps(event)}\n\n".encode())
            self.wfile.flush()

    def _answer(self, method: str, asked: dict) -> None:
        path = urlsplit(self.path).path
        if (method, path) == ("GET", "/"):
            self._send(self.page.encode(), "text/html; charset=utf-8")
            return
        route = self.routes.get((method, path))
        if route is None:
            self._send(b'{"error": "not found"}', code=404)
            return
        try:
            found = route(asked)
        except (KeyError, RuntimeError) as e:
            self._send(json.dumps({"error": f"missing: {e}" if isinstance(e, KeyError) else str(e)}).encode(), code=400)
            return
        if isinstance(found, dict):
            self._send(json.dumps(found, default=str).encode())
        else:
            self._stream(found)

    def do_GET(self) -> None:
        self._answer("GET", {k: v[-1] for k, v in parse_qs(urlsplit(self.path).query).items()})

    def do_POST(self) -> None:
        self._answer("POST", json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"))


def _adapter(title: str, path: str, field: str, routes: dict) -> type[Adapter]:
    return type("Routes", (Adapter,), {"routes": routes, "page": PAGE.format(title=title, path=path, field=field)})


def handler(ix: index.Index, model=None) -> type[Adapter]:
    model = model or Echo()

    def stats(_: dict) -> dict:
        out = index.composite(ix.documents(), ix.chunks(), ix.meta()).first().asDict()
        out["by_ext"] = {r["ext"]: r["n"] for r in index.by_extension(ix.documents()).collect()}
        if isinstance(model, Http):
            try:
                out["model"] = {"reachable": True, "loaded": model.running(), "has_model": model.has_model(model.model)}
            except ModelError as e:
                out["model"] = {"reachable": False, "error": str(e)}
        return out

    def search(asked: dict) -> dict:
        found = search_index.ask(ix, asked["question"], asked.get("top_k") or 0, counted=True)
        return {"hits": [h.asDict() for h in found.hits], "timings": found.timings, "counts": found.counts}

    def ask(asked: dict):
        return search_index.answer(ix, asked["question"], model, asked.get("top_k") or 0, asked.get("history") or [])

    def ingest(asked: dict) -> dict:
        done = {"force": bool(asked.get("force"))}
        return ix.ingest(asked["paths"], **done) if asked.get("paths") else ix.rescan(**done)

    return _adapter("Index", "/api/ask", "question", {("GET", "/api/stats"): stats, ("POST", "/api/search"): search, ("POST", "/api/ask"): ask, ("POST", "/api/ingest"): ingest})


def game(campaign: Campaign) -> type[Adapter]:
    def state(_: dict) -> dict:
        ties = turns.standing(campaign.tables.read("relationships"), campaign.tables.read("characters")).collect()
        last = campaign.history(1)
        return campaign.status() | {
            "choices": campaign.pending(), "unarchived": turns.unarchived(campaign.tables.read("turns")).count(), "last_entry": last[0]["entry"] if last else "",
            "relationships": [{"name": r["name"] or r["other"], "label": r["label"], "closeness": r["closeness"], "note": r["note"]} for r in ties],
        }

    def turn(asked: dict):
        for event in campaign.play(asked["action"]):
            yield {**event, "type": "done"} if event["type"] == "turn" else event

    routes = {
        ("GET", "/api/state"): state, ("GET", "/api/history"): lambda q: {"turns": [r.asDict() for r in campaign.history(int(q.get("limit", 12)))]},
        ("POST", "/api/turn"): turn, ("POST", "/api/recall"): lambda q: {"memories": [m.asDict() for m in campaign.recall(q["query"], int(q.get("top_k") or 0))]},
    }
    return _adapter(campaign.status()["title"] or "Campaign", "/api/turn", "action", routes)


def serve(ix: index.Index, port: int = 8080, model=None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to run (``serve_forever``)."""
    return ThreadingHTTPServer((host, port), handler(ix, model))


def serve_game(campaign: Campaign, port: int = 8090, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), game(campaign))
