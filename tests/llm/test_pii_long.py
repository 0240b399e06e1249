"""Scores and overlaps of many spans in one text, against its own characters."""

import random
import re

from factweave.llm import pii


def test_context_of_every_span(spark):
    rng = random.Random(6)
    bits = ["call 555-123-4567", "a@b.co", "ssn 123-45-6789", "server 10.0.0.1", "10.0.0.2", "pay by card 4111 1111 1111 1111", "+49 30 1234567", "555-123-4567", "ünïcode", "long words between that push the call words far away from the number", "4111-1111-1111-1111", "x" * 60, "3782 822463 10005"]
    text = " ".join(rng.choice(bits) for _ in range(3_000))
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["pii"]
    base = [s for s in got if s["kind"] in pii.PATTERNS]
    assert len(got) > 1_500 and len(got) > len(base)
    for s in got:
        near = text[max(0, s["start"] - pii.NEAR) : s["start"]].lower()
        want = min(1.0, pii.PRIOR[s["kind"]] + pii.RAISE * bool(re.search(rf"\b(?:{pii.CONTEXT[s['kind']]})", near)))
        assert s["score"] == round(want, 2), (s, near)
        if s["kind"] not in pii.PATTERNS:
            assert s["score"] >= pii.LEAST and not any(b["start"] < s["end"] and s["start"] < b["end"] for b in base)
    # every number after "call" is there, unless a base span holds it
    for m in re.finditer(r"call (555-123-4567)(?![0-9-])", text):
        assert any(s["kind"] == "local_phone" and s["start"] == m.start(1) for s in got)
