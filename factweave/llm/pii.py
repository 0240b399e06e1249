"""Personal data: patterns propose spans, checksums confirm them, nearby words
adjust the score. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table

# Possessive forms of the agreed patterns: they match the same spans, since what
# follows each repetition is outside its class. The guards skip starts inside a
# run that has already failed as a whole (\G: where the match before ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The method's additions: confirmed by a checksum or their form, or proposed weakly and decided by context.
MORE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+()A-Za-z-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "short_card": r"(?<![0-9.+-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+|xox[abprs]-[A-Za-z0-9-]{10,250}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])",
    "pem": r"-----BEGIN\x20(?:[A-Z]{2,12}\x20){0,3}PRIVATE\x20KEY-----",
    "secret": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret)\x20{0,3}[:=]\x20{0,3}[\"']?[A-Za-z0-9+/_.~-]{8,256}+={0,2}+[\"']?",
}
#: What a span starts with, by kind, before context is looked at.
PRIOR = {
    "email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "local_phone": 0.3, "short_card": 0.3, "ssn": 0.6, "ipv6": 0.7, "key": 0.9, "pem": 0.9, "secret": 0.7,
}
#: Words that raise a span's score when they stand shortly before it.
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|transfer", "local_phone": "phone|call|tel|mobile|fax",
    "short_card": "card|amex|credit|pay", "ssn": "ssn|social|security|tax", "ipv6": "ip|address|host|server", "key": "key|aws|access|credential",
    "pem": "key|private|certificate", "secret": "login|user|credential|auth|config",
}
#: A text without this can hold none of the kind; all others need a digit.
NEEDS = {"email": "@", "phone": "+", "ipv6": ":", "pem": "-----BEGIN"}
NEAR, RAISE, LEAST = 40, 0.3, 0.5


_PLACED = "array<struct<start:int,end:int,m:string,before:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m, before>> in code points of all leftmost matches,
    ``before`` being the NEAR characters ahead of a match: the pieces that split()
    leaves between the matches give their offsets and what stands there.

    Offsets are running sums. They are taken over blocks of about the root of the
    number of matches, since an array that grows by one is copied each time: n
    matches cost n times the root of n, not n squared."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(NEAR)).alias("near")))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("m"), F.length(m).alias("len"), p["gap"].alias("gap"), p["near"].alias("near")))
    # zip_with pads: the piece after the last match has no match of its own
    sized = F.filter(sized, lambda x: x["m"].isNotNull())
    last = lambda *parts: F.right(F.concat(*parts), F.lit(NEAR))

    def step(acc, x):
        s, e, before = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["len"], last(acc["tail"], x["near"])
        out = F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["m"].alias("m"), before.alias("before"))))
        return F.struct(e.alias("at"), last(before, x["m"]).alias("tail"), out.alias("out"))

    def place(xs: Column, at: Column) -> Column:
        return F.aggregate(xs, F.struct(at["at"].alias("at"), at["tail"].alias("tail"), F.expr(f"cast(array() AS {_PLACED})").alias("out")), step, lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        cut = _cut(xs)
        onward = lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), last(a["tail"], x["near"], x["m"]).alias("tail"))
        none = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")))
        starts = F.aggregate(cut, none, lambda a, b: F.concat(a, F.array(F.aggregate(b, F.element_at(a, -1), onward))))
        return F.flatten(F.filter(F.zip_with(cut, starts, lambda b, at: F.when(b.isNotNull(), place(b, at))), lambda x: x.isNotNull()))

    # One element for the whole list: what it is made of is computed once.
    return F.element_at(F.transform(F.array(sized), blocks), 1)


def _cut(xs: Column) -> Column:
    """An array in blocks of about the root of its size."""
    n = F.size(xs)
    k = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / k).cast("int"), F.lit(0))), lambda c: F.slice(xs, c * k + 1, k))


def _bounded(spans: Column) -> Column:
    """Spans by start in blocks, each with the range that it covers."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    part = lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("spans"))
    return F.element_at(F.transform(F.array(ordered), lambda xs: F.transform(_cut(xs), part)), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    part = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(part, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code, without spaces, leaves 1 modulo 97."""
    chars = F.split(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))), "")

    def step(a, c):
        v = F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
        return F.when(c == "", a).otherwise((a * F.when(v < 10, 10).otherwise(100) + v) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int"), F.lit(999)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "short_card":
        return n.between(13, 15) & luhn(_digits(m))
    if kind == "ssn":  # numbers that are never given out
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$")
    if kind == "secret":  # a value with a digit, not a word of prose
        return F.regexp_extract(m, "[:=](.*)$", 1).rlike("[0-9]")
    if kind == "iban":
        code = F.replace(m, F.lit(" "))
        return F.length(code).between(15, 34) & mod97(code)
    return F.lit(True)


_NONE = "cast(array() AS array<struct<kind:string,start:int,end:int,score:double>>)"


def _scored(t: Column, kind: str, pattern: str) -> Column:
    """The valid spans of one kind with their scores."""

    def one(s):
        raised = F.when(F.lower(s["before"]).rlike(rf"\b(?:{CONTEXT[kind]})"), RAISE).otherwise(0.0)
        score = F.round(F.least(F.lit(1.0), F.lit(PRIOR[kind]) + raised), 2)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    return F.transform(F.filter(_spans(t, pattern), lambda s: _valid(kind, s["m"])), one)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array<struct<kind, start, end, score>>, ordered by
    kind (as in PATTERNS, then MORE) and start; offsets are code points, end
    exclusive.

    A span's score is its kind's prior, raised by RAISE when one of the kind's
    context words stands within NEAR code points before it. Base kinds are kept
    whatever their score once valid; added kinds need LEAST and must not overlap
    a base span. A null or empty text has no spans; repeated rows are looked at
    one by one; an empty table gives no rows; all rows and columns of the input
    are kept, but for a column named pii, which is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = [*PATTERNS, *MORE]
    name = dict(zip(["", "parts", *kinds], spare(docs, "pii_base", "pii_parts", *[f"pii_{k}" for k in kinds]), strict=True))
    out = docs
    # One column each: higher-order functions over them aren't computed twice.
    for kind, pattern in [*PATTERNS.items(), *MORE.items()]:
        need = F.instr(t, NEEDS[kind]) > 0 if kind in NEEDS else t.rlike("[0-9]")
        out = out.withColumn(name[kind], F.when(need, _scored(t, kind, pattern)).otherwise(F.expr(_NONE)))
    out = out.withColumn(name[""], F.concat(*[F.col(name[k]) for k in PATTERNS]))
    base, parts = F.col(name[""]), F.col(name["parts"])
    out = out.withColumn(name["parts"], _bounded(base))
    # an added span looks into the blocks of base spans that its own range touches
    meets = lambda s: F.exists(parts, lambda p: (p["low"] < s["end"]) & (s["start"] < p["high"]) & F.exists(p["spans"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    more = F.filter(F.concat(*[F.col(name[k]) for k in MORE]), lambda s: (s["score"] >= LEAST) & ~meets(s))
    return out.withColumn("pii", F.concat(base, more)).drop(*name.values())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest, all spans as text, and n_pii, how many
    there are of all kinds; one row for each row of documents, null texts too."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*PATTERNS))
    n = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in PATTERNS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_pii"))
