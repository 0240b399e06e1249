"""What models are asked about sections and predicates, and their answers as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 8000
SYSTEM = (
    "You extract facts from a text. Answer with JSON only: {\"facts\": [{\"subject\", \"predicate\", \"object\"}], "
    "\"refs\": [{\"entity_id\", \"evidence_span\", \"confidence\"}]}. Use ids from the candidate list only and quote the text."
)
CARDINALITY = "Does this predicate hold one value for an entity (scalar) or several (list)? Answer with JSON only: {\"cardinality\", \"confidence\"}."
ANSWER = "section string, kind string, subject string, predicate string, object_json string, entity_id string, evidence_span string, confidence double"


def prompt(text: str, candidates: list[dict], parent: str | None, parent_type: str | None = None, field: str | None = None) -> str:
    """The question about a text: whose it is and in which field it stands, whom it
    may name, and itself up to MAX_BYTES."""
    whose = " ".join(x for x in (parent or "none", parent_type and f"({parent_type})", field and f"field {field}") if x)
    named = "\n".join(f"- {c['entity_id']} ({c['entity_type']}): {c['surface']}" for c in candidates)
    body = text.encode()[:MAX_BYTES].decode("utf-8", "ignore")
    return f"Parent: {whose}\nCandidates:\n{named or '- none'}\nText:\n{body}"


def strip_fences(answer: str) -> str:
    a = answer.strip()
    if a.startswith("```"):
        a = a.split("\n", 1)[1] if "\n" in a else ""
        a = a.rsplit("```", 1)[0]
    return a.strip()


def parse_answer(answer: str) -> tuple[list[dict], list[dict]]:
    """Facts and references of an answer; none if it isn't what was asked for."""
    try:
        got = json.loads(strip_fences(answer))
    except ValueError:
        return [], []
    if not isinstance(got, dict):
        return [], []
    rows = lambda k, need: [x for x in got.get(k) or [] if isinstance(x, dict) and all(x.get(n) not in (None, "") for n in need)]
    return rows("facts", ("subject", "predicate", "object")), rows("refs", ("entity_id",))


def extract_sections(work: DataFrame, client, concurrency: int = 1) -> DataFrame:
    """Answers for ``work(section, text, parent_subject, candidates)``, up to
    ``concurrency`` calls at once in each task; the parent's type and the text's
    field are told where ``work`` has them (parent_type, field).

    Rows by kind: ``fact`` and ``ref`` from the answer, ``done`` for each section
    that was answered or has no candidates (then it isn't asked about), ``usage``
    with a task's counters. A failed call gives no rows."""

    def one(row: tuple) -> list[tuple]:
        section, text, parent, cands, parent_type, field = row
        done = [(section, "done", None, None, None, None, None, None)]
        if cands is None or not len(cands):
            return done
        try:
            facts, refs = parse_answer(client.chat(SYSTEM, prompt(text, list(cands), parent, parent_type, field)))
            said = [(section, "fact", str(f["subject"]), str(f["predicate"]), json.dumps(f["object"], ensure_ascii=False, sort_keys=True), None, None, 0.7) for f in facts]
            said += [(section, "ref", None, None, None, str(r["entity_id"]), r.get("evidence_span"), float(r.get("confidence") or 0.0)) for r in refs]
        except Exception:  # a section's failure is no reason to lose the others
            return []
        return said + done

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ANSWER.split(", ")]
        before = dict(getattr(client, "usage", {}))
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for p in parts:
                got = pool.map(one, zip(*(p[c] for c in asked), strict=True))
                yield pd.DataFrame([r for rows in got for r in rows], columns=names)
        used = {k: v - before.get(k, 0) for k, v in getattr(client, "usage", {}).items()}
        yield pd.DataFrame([(None, "usage", None, k, None, None, None, float(v)) for k, v in used.items() if v], columns=names)

    asked = ["section", "text", "parent_subject", "candidates", "parent_type", "field"]
    given = work.select(*[F.col(c) if c in work.columns else F.lit(None).cast("string").alias(c) for c in asked])
    return given.mapInPandas(run, ANSWER)


def usage_of(answers: DataFrame) -> DataFrame:
    """(name, n): calls and tokens of all tasks."""
    return answers.where("kind = 'usage'").groupBy(F.col("predicate").alias("name")).agg(F.sum("confidence").cast("long").alias("n"))


def classify(evidence: DataFrame, client) -> DataFrame:
    """Cardinality of each predicate in ``evidence``; list where the answer fails."""

    def one(row) -> tuple[str, float]:
        try:
            got = json.loads(strip_fences(client.chat(CARDINALITY, f"{row['entity_type']}.{row['predicate']}: {row['samples']}")))
            return ("scalar" if got.get("cardinality") == "scalar" else "list"), float(got.get("confidence", 0.5))
        except Exception:
            return "list", 0.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [one(r) for r in p.to_dict("records")]
            yield pd.DataFrame({"predicate": p["predicate"], "entity_type": p["entity_type"], "cardinality": [c for c, _ in got], "confidence": [x for _, x in got]})

    return evidence.mapInPandas(run, "predicate string, entity_type string, cardinality string, confidence double")
