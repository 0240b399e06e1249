"""Decontamination, line deduplication and personal data against brute force."""

import hashlib
import re

from factweave.llm import decontaminate, lines, pii

from .helpers import corpus, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def overlap(rows, items, n=13):
    wins = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, ids = WORD.findall(low(t)), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if found := wins.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rows = corpus(seed=3)
    p = rows[10][1].split("\n")
    items = [(1, rows[0][1]), (2, "Tiny"), (3, None), (4, "..."), (5, " ".join(p)[:300].upper()), (10, rows[0][1]), (6, "é ü ascii")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = overlap([(d, t) for d, t, _ in rows], items)
    for block in (decontaminate.BLOCK, 12_000):  # one block of the hash set, and several
        got = decontaminate.decontaminate(frame(spark, rows), bench, block=block).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=str) == want
    bad = {x[0] for x in want if x[4]}
    kept = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, _ in rows} - bad and bad
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.decontaminate(frame(spark, rows), none).where("contaminated OR n_hit > 0").count()
    assert decontaminate.decontaminate(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


def one_edit(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    a, b = k + (len(x) >= len(y)), k + (len(y) >= len(x))
    return x[a:] == y[b:]


def kept_lines(rows):
    """By brute force over all pairs of lines."""
    seq = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            w = [x for x in re.split(r"[\x20\t\r\x0b\f]+", line) if x]
            if len(w) >= 5:
                seq.append((d, i, w))
    gone = {(d, i) for k, (d, i, w) in enumerate(seq) if any(one_edit(w, v) for _, _, v in seq[:k])}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_line_dedup(spark):
    rows = [(d, t) for d, t, _ in corpus(seed=5)[:-2]]
    base = "one two three four five six seven"
    edits = [base, base + " eight", "zero " + base, base.replace("four", "4"), base.replace("four ", ""), "one two three four 5 six 7", "one one two three four five six seven"]
    rows += [(200 + i, f"unlike words {i} stand in here too\n{e}\n\nshort line") for i, e in enumerate(edits)]
    rows += [(300, "a a a a a a a a\na a a a a a a\nb a a a a a a a")]
    got = lines.dedup_lines(frame(spark, [(*r, "t") for r in rows]))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == kept_lines(rows)
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string, n_chars long")).count() == 0
    odd = spark.createDataFrame([(None, base), (1, base), (1, base), (2, None)], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in lines.dedup_lines(odd).collect()) == ["", "", "None", base]


def test_lines_that_share_most_words(spark):
    rows = [(i, f"value {i} of the long family of lines like this one") for i in range(300)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in got.where("text <> ''").collect()] == [0]


def test_equal_short_lines(spark):
    rows = [(1, "All rights reserved.\none two three four\n\nx"), (2, "All  rights reserved.\none two three 4\n\nx\ny"), (3, "y\n \nAll rights reserved.\nAll rights reserved")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), short_copies=True)
    assert {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in got.collect()} == {1: (rows[0][1], 0), 2: ("one two three 4\n\ny", 2), 3: (" \nAll rights reserved", 2)}
    rows = [(d, t) for d, t, _ in corpus(seed=5)[:-2]]
    rows += [(200 + i, f"unlike words {i} stand in here too\nshort line\n\nshort line {i % 2}") for i in range(6)]
    first, want = {}, kept_lines(rows)
    for d, t in sorted(rows):
        for i, line in enumerate((t or "").split("\n")):
            if 0 < len(line.split()) < 5:
                first.setdefault(tuple(line.split()), (d, i))
    for d, t in rows:
        # kept_lines leaves every short line: walk both to tell which of them are copies
        left, at = (want[d] or "").split("\n"), 0
        for i, line in enumerate((t or "").split("\n")):
            if at < len(left) and left[at] == line:
                if 0 < len(line.split()) < 5 and first[tuple(line.split())] != (d, i):
                    del left[at]
                else:
                    at += 1
        want[d] = None if t is None else "\n".join(left)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), short_copies=True)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(t):
    out, t = [], t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return [(k, *m.span()) for k, m in out]


TEXTS = [
    None, "", "write to a.b@c.de_x@e.fg or é@x.y, ü a@b@c.d", "1.2.3.4.5.6.7.8 0255.1.1.001 256.1.1.1 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111, 4 1 1 1", "call +1 (555) 123-4567 or +12 or +1 2345678901234567, +1(2).3",
    "日本 4111111111111111 日本 +49 30 1234567", "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "phone 555-123-4567, and then, after a good many other words that say nothing, 555-123-4567",
    "9" * 3000 + " " + "a" * 3000 + "@", "5 " * 2000, "x@y.z" * 50,
]


def test_pii(spark):
    rows = [(i, t, "t") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "t"), (2, TEXTS[2], "t")]
    got = pii.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in pii.PATTERNS]
        assert base == spans(r["text"])
    more = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]], s["score"]) for s in r["pii"] if s["kind"] not in pii.PATTERNS] for r in got}
    assert more[7] == [("iban", "GB82 WEST 1234 5698 7654 32", 1.0)]
    assert [x[:2] for x in more[8]] == [("local_phone", "555-123-4567")]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hash_of_spans(spark):
    df = spark.createDataFrame([(1, TEXTS[4])], "doc_id long, text string")
    s = ",".join(f"{k}:{a}:{b}" for k, a, b in spans(TEXTS[4]))
    from pyspark.sql import functions as F

    got = pii.find_pii(df).select(F.sha2(pii._joined(F.col("pii")), 256)).first()[0]
    assert got == hashlib.sha256(s.encode()).hexdigest()
