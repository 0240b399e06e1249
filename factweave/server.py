"""The engine's questions over HTTP, with the standard library only.

GET /health, /entities, /entities/TYPE, /entities/TYPE/ID, /entities/TYPE/ID/page.md, /conflicts, /conflicts/ID, /resolutions;
POST /retrieve {query, k, hops}, /conflicts/ID/resolve {side}, /resolutions/approve, /resolutions/reject, /ask {question}.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from .models import ChatClient
from .operators import conflicts, dml
from .plans.ask import ToolClient, ask
from .plans.engine import Engine


class NotFound(Exception):
    pass


def _rows(df, limit: int = 500) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def answer(engine: Engine, method: str, url: str, body: dict, client: ToolClient | None = None, index: str | None = None, chat: ChatClient | None = None, pages_at: str | None = None):
    """The JSON value for a request. ``index`` is a written search index, without
    which each question indexes the store anew; ``chat`` writes pages, which are
    kept in ``pages_at``."""
    parts = urlsplit(url)
    q = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    path = [unquote(x) for x in parts.path.strip("/").split("/") if x]
    store = engine.store
    match (method, path):
        case ("GET", ["health"]):
            return {"status": "ok"}
        case ("GET", ["entities"]):
            return _rows(engine.entity_counts())
        case ("GET", ["entities", kind]):
            e = store.table("entities")
            page = dml.entity_page(e, kind, q.get("q"), int(q.get("offset", 0)), int(q.get("limit", 100)))
            return {"total": dml.entities_like(e, kind, q.get("q")).count(), "ids": [r["id"] for r in page.collect()]}
        case ("GET", ["entities", kind, entity_id]):
            got = engine.show(entity_id)
            if got["type"] != kind:
                raise NotFound(entity_id)
            return got
        case ("GET", ["entities", kind, entity_id, "page.md"]):
            if chat is None:
                raise ValueError("no model is set")
            return {"markdown": engine.page(chat, kind, entity_id, pages_at)}
        case ("GET", ["conflicts"]):
            return _rows(conflicts.unresolved(store.table("conflicts")))
        case ("GET", ["conflicts", number]):
            got = engine.conflict(int(number))
            if got is None:
                raise NotFound(number)
            return got
        case ("POST", ["conflicts", number, "resolve"]):
            engine.resolve_one(int(number), str(body.get("side")), int(body.get("at", 0)))
            return {"ok": True}
        case ("GET", ["resolutions"]):
            return _rows(conflicts.recent_resolutions(store.table("facts"), int(q["since"]) if "since" in q else None, int(q.get("limit", 100)), float(q.get("max_confidence", 0.9))))
        case ("POST", ["resolutions", "approve"]):
            engine.approve(body["entity_id"], body["surface"])
            return {"ok": True}
        case ("POST", ["resolutions", "reject"]):
            engine.reject(body["subject"], body["predicate"], body["entity_id"], body["surface"], int(body.get("at", 0)))
            return {"ok": True}
        case ("POST", ["retrieve"]):
            return _rows(engine.search(str(body["query"]), min(int(body.get("k", 10)), 50), int(body.get("hops", 0)), index))
        case ("POST", ["ask"]):
            if client is None:
                raise ValueError("no model is set")
            return {"answer": ask(engine, client, str(body["question"]), index)}
    raise NotFound(parts.path)


def serve(engine: Engine, port: int = 8080, client: ToolClient | None = None, index: str | None = None, chat: ChatClient | None = None, pages_at: str | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                status, got = 200, answer(engine, self.command, self.path, json.loads(self.rfile.read(size) or b"{}"), client, index, chat, pages_at)
            except NotFound as e:
                status, got = 404, {"error": f"not found: {e}"}
            except (KeyError, ValueError, TypeError) as e:
                status, got = 400, {"error": f"{type(e).__name__}: {e}"}
            except Exception as e:
                status, got = 500, {"error": str(e)[:500]}
            data = json.dumps(got, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
