"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accented letters that are folded, and what they become.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"


def normalize_alias(s: Column) -> Column:
    """Lower case, accents folded, white space collapsed and trimmed."""
    folded = F.trim(F.regexp_replace(F.translate(F.lower(s), ACCENTED, FOLDED), r"(?U)\s+", " "))
    return F.when(s.rlike(r"[^!-~]"), folded).otherwise(F.lower(s))  # visible ASCII has nothing to fold or collapse


def object_kind(obj: Column) -> Column:
    """string, number, bool, null, array or object, from canonical JSON text."""
    c = F.substring(obj, 1, 1)
    return (
        F.when(c == '"', "string").when(c == "{", "object").when(c == "[", "array").when(c.isin("t", "f"), "bool").when(c == "n", "null").otherwise("number")
    )


def json_string(s: Column) -> Column:
    """A string as JSON text; null as the JSON null."""
    quoted = F.to_json(F.array(s))
    return F.when(s.isNull(), "null").otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def unquote(obj: Column) -> Column:
    """The value at the root of a JSON text. A string without escapes, whose second
    quote is its last character, is cut out and not parsed."""
    cut = F.substring_index(F.substring(obj, 2, 2**31 - 1), '"', 1)
    plain = obj.startswith('"') & ~obj.contains("\\") & (F.octet_length(cut) == F.octet_length(obj) - 2)
    return F.when(plain, cut).otherwise(F.get_json_object(obj, "$"))


def value_to_string(obj: Column) -> Column:
    """Strings raw, null empty, everything else as its JSON text."""
    return F.when(obj.startswith('"'), unquote(obj)).when(obj.startswith("n"), "").otherwise(obj)


def string_or_number(obj: Column) -> Column:
    return F.when(obj.startswith('"'), unquote(obj)).when(~F.substring(obj, 1, 1).isin("{", "[", "t", "f", "n"), obj)


def string_only(obj: Column) -> Column:
    return F.when(obj.startswith('"'), unquote(obj))


def display(obj: Column) -> Column:
    return F.when(~obj.startswith("n"), value_to_string(obj))


def looks_like_alias(norm: Column) -> Column:
    """Has an ASCII letter, no slash, is not mostly digits and not date-shaped."""
    digits, seps = F.regexp_count(norm, F.lit("[0-9]")), F.regexp_count(norm, F.lit("[-:]"))
    mostly = digits.cast("float") / F.length(norm).cast("float") > F.lit(0.7).cast("float")
    return norm.rlike("[A-Za-z]") & ~norm.contains("/") & ~mostly & ~((digits >= 6) & (seps >= 2))


def email_local(s: Column) -> Column:
    """What stands before the first @, if it is shaped like a name."""
    local = F.substring_index(s, "@", 1)
    return F.when((F.instr(s, "@") > 1) & (local.rlike("[._-]") | (F.octet_length(local) >= 4)), local)


def humanize_email_local(local: Column) -> Column:
    """ravi.kumar -> Ravi Kumar; null with fewer than two lettered parts."""
    parts = F.filter(F.split(local, "[._-]"), lambda p: p.rlike(r"\p{IsAlphabetic}"))
    name = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), " ")
    return F.when(local.rlike("[._-]") & (F.size(parts) >= 2), name)


def mention_tokens(s: Column) -> Column:
    """Runs of letters, digits, ' and -, in lower case."""
    return F.array_remove(F.split(F.lower(s), r"[^\p{IsAlphabetic}\p{N}'-]+"), "")


def word_tokens(s: Column) -> Column:
    """Alphanumeric runs in lower case, as search uses them."""
    return F.array_remove(F.split(F.lower(s), r"[^\p{IsAlphabetic}\p{N}]+"), "")


def ngrams(tokens: str, most: int = 5) -> Column:
    """array<struct<n, pos, gram>> of all n-grams, n from ``most`` down to 1."""
    one = "transform(sequence(1, size({t}) - {n} + 1), i -> struct({n} AS n, i AS pos, array_join(slice({t}, i, {n}), ' ') AS gram))"
    parts = [f"if(size({tokens}) >= {n}, {one.format(t=tokens, n=n)}, array())" for n in range(most, 0, -1)]
    return F.expr(f"concat({', '.join(parts)})")


def f32(value: Column) -> Column:
    """Single precision, widened again."""
    return value.cast("float").cast("double")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where they are empty, of unequal length or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(F.lit(0.0))


def strip_fences(s: Column) -> Column:
    """Without a wrapping Markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def sanitize(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_-]", "_")


def sanitize_id(s: Column) -> Column:
    """A safe file name: no separators, no leading dot, never empty."""
    kept = F.regexp_replace(s, "[^A-Za-z0-9_.@+=~-]", "_")
    return F.when(kept == "", "_").when(kept.startswith("."), F.concat(F.lit("_"), kept)).otherwise(kept)


def shorten(s: Column, most: int = 500, side: int = 250) -> Column:
    n = F.length(s)
    cut = F.concat(F.left(s, F.lit(side)), F.lit("…["), (n - 2 * side).cast("string"), F.lit(" chars elided]…"), F.right(s, F.lit(side)))
    return F.when(n > most, cut).otherwise(s)


def truncate(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit("…"))).otherwise(s)


def truncate_bytes(s: Column, most: int) -> Column:
    """At most so many bytes, cut between characters."""
    # A character has four bytes at most; what is cut short becomes one
    # replacement character at the end and is taken off.
    head = F.make_valid_utf8(F.substring(s.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(s) <= most, s).otherwise(F.regexp_replace(head, "\uFFFD+$", ""))


def ref_target(predicate: Column) -> Column:
    return F.when(predicate.startswith("ref:"), F.substr(predicate, F.lit(5)))


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)
