"""Command line: python -m factweave.cli --store DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .models import FakeChat, HashEmbeddings, HttpClient, ModelConfig
from .operators.views import load_templates
from .plans.ask import ChatTools, ask
from .plans.engine import Engine
from .server import serve


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="factweave")
    p.add_argument("--store", required=True)
    p.add_argument("--config")
    p.add_argument("--offline", action="store_true", help="stand-ins for models")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name, args in {
        "ingest": ["folder", "--dry-run", "--extract", "--max", "--lots", "--concurrency", "--at"], "alias-index": [], "embed": ["--model", "--force", "--limit"], "reconcile-refs": [], "cleanup-conflicts": [], "inspect": [], "resolve": [],
        "build": ["folder", "--templates"], "serve": ["--port", "--index", "--pages"], "ask": ["question", "--index"], "index": ["folder"], "entity-counts": [], "predicate-counts": ["--type"], "top-values": ["predicate", "--limit"],
        "search": ["query", "--k", "--hops", "--index"], "show": ["id", "--format"], "llm-test": [], "list": ["type", "--contains", "--limit"],
        "clear-aliases": [], "clear-llm": [], "clear-reconciled": [], "gen-md": ["folder", "--type", "--limit", "--retries", "--force"], "page": ["type", "id", "folder"],
    }.items():
        q = sub.add_parser(name)
        for a in args:
            q.add_argument(a, **({"action": "store_true"} if a in ("--dry-run", "--force", "--extract") else {}))
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), a.store)
    config = ModelConfig.load(a.config)
    chat = FakeChat(lambda s, u: "{}") if a.offline else HttpClient(config)
    vectors = HashEmbeddings() if a.offline else HttpClient(config)

    def ingest():
        """Files, and with --extract what a model says of their texts."""
        found = engine.ingest(a.folder, int(a.at or 0), a.dry_run)
        if a.extract and not a.dry_run:
            return {"facts": engine.extract(engine.sections(a.folder), chat, int(a.at or 0), a.max and int(a.max), int(a.lots or 1), int(a.concurrency or 1)), "usage": engine.usage}
        return found

    out = {
        "ingest": ingest, "serve": lambda: serve(engine, int(a.port or 8080), ChatTools(chat), a.index, chat, a.pages).serve_forever(), "ask": lambda: ask(engine, ChatTools(chat), a.question, a.index),
        "alias-index": engine.alias_index, "embed": lambda: engine.embed(vectors, a.model or config.embed_model, force=a.force, limit=a.limit and int(a.limit)),
        "reconcile-refs": engine.reconcile_refs, "cleanup-conflicts": lambda: engine.cleanup_conflicts(chat), "inspect": engine.inspect, "resolve": engine.resolve,
        "build": lambda: engine.build(a.folder, load_templates(a.templates) if a.templates else None), "index": lambda: engine.index(a.folder), "entity-counts": engine.entity_counts, "predicate-counts": lambda: engine.predicate_counts(a.type),
        "top-values": lambda: engine.top_values(a.predicate, int(a.limit or 20)), "search": lambda: engine.search(a.query, int(a.k or 10), int(a.hops or 0), a.index),
        "show": lambda: engine.shown(a.id, a.format or "text"), "llm-test": lambda: chat.chat("Answer briefly.", "Say ok."), "list": lambda: engine.list_entities(a.type, a.contains, a.limit and int(a.limit)),
        "clear-aliases": engine.clear_aliases, "clear-llm": engine.clear_llm, "clear-reconciled": engine.clear_reconciled,
        "gen-md": lambda: engine.generate_pages(chat, a.folder, a.type, a.limit and int(a.limit), int(a.retries or 3), a.force), "page": lambda: engine.page(chat, a.type, a.id, a.folder),
    }[a.cmd]()
    if hasattr(out, "show"):
        out.show(200, truncate=False)
    elif isinstance(out, str):
        print(out)
    elif out is not None:
        print(json.dumps(out, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
