"""Folders of mixed files to records and text sections.

Files are listed and read by Spark; a file that can't be read becomes a row of
errors and doesn't stop the rest.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import splits

SNIFF = 256
#: Files of a folder's root that name what is to be passed over.
IGNORE_FILES = (".gitignore", ".ignore")
#: One row per record (kind r), section (s) or error (e).
ITEM = "path string, adapter string, content_hash string, kind string, pos long, fields string, heading string, text string, locator string, error string"
RECORDS = ["path", "adapter", "content_hash", "pos", "fields"]
SECTIONS = ["path", "adapter", "content_hash", "heading", "text", "locator"]


class Raw(str):
    """A number as it was written."""


def canonical(value) -> str:
    """JSON text with sorted keys and numbers as they were written."""
    if isinstance(value, Raw):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def parsed_json(text: str):
    """A JSON value, numbers as they were written."""
    return json.loads(text, parse_int=Raw, parse_float=Raw, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))


def _as_record(value) -> dict:
    return value if isinstance(value, dict) else {"value": value}


def read_json(content: bytes, path: str) -> Iterator[tuple]:
    """A top array gives a record per element, anything else one record; lines of
    .jsonl and .ndjson one each, blank ones skipped."""
    text = content.decode("utf-8-sig")
    if path.lower().endswith((".jsonl", ".ndjson")):
        # LF or CRLF: other line separators may stand inside a JSON string
        values = [parsed_json(line) for line in text.split("\n") if line.strip()]
    else:
        value = parsed_json(text)
        values = value if isinstance(value, list) else [value]
    for v in values:
        yield "r", _as_record(v)


def read_csv(content: bytes, path: str) -> Iterator[tuple]:
    """All values are strings; a row of another width is an error."""
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter="\t" if path.lower().endswith(".tsv") else ",", strict=True)
    header = next(rows, None)
    for row in rows:
        if row and len(row) != len(header):
            raise ValueError(f"line {rows.line_num}: {len(row)} fields, {len(header)} expected")
        if row:
            yield "r", dict(zip(header, row, strict=True))


def read_text(content: bytes, path: str) -> Iterator[tuple]:
    yield "s", (None, content.decode("utf-8", "replace"), None)


def pdf_reader(extract: Callable[[bytes], str] | None) -> Callable:
    """Pages between form feeds, blank ones left out but counted; a text of blank
    pages alone is one section. ``extract`` turns a PDF's bytes into text."""

    def read(content: bytes, path: str) -> Iterator[tuple]:
        if extract is None:
            raise ValueError("no PDF text extractor is set")
        text = extract(content)
        filled = [(f"page:{i}", p) for i, p in enumerate(text.split("\f"), 1) if p.strip()]
        for locator, p in filled or [(None, text)]:
            yield "s", (None, p, locator)

    return read


@dataclass
class Adapter:
    """``match`` tells, from the path and first bytes, strong (2), weak (1) or 0;
    ``ranges`` how a large file can be read in ranges (a form of ``splits``), if so."""

    name: str
    match: Callable[[str, bytes], int]
    read: Callable[[bytes, str], Iterator[tuple]]
    ranges: Callable[[str, bytes], str | None] = lambda path, head: None


def _by_ext(*exts: str) -> Callable[[str, bytes], int]:
    return lambda path, head: 2 * path.lower().endswith(exts)


@dataclass
class Registry:
    adapters: list[Adapter] = field(default_factory=list)

    def register(self, adapter: Adapter) -> Registry:
        self.adapters.append(adapter)
        return self

    def pick(self, path: str, head: bytes) -> Adapter | None:
        """Strong beats weak; of equals the first registered."""
        best = max(self.adapters, key=lambda a: a.match(path, head), default=None)
        return best if best and best.match(path, head) else None


def default_registry(extract_pdf: Callable[[bytes], str] | None = None) -> Registry:
    def json_match(path: str, head: bytes) -> int:
        if path.lower().endswith((".json", ".jsonl", ".ndjson")):
            return 2
        return int("." not in path.rsplit("/", 1)[-1] and head.lstrip()[:1] in (b"{", b"[")) or int(head.lstrip()[:1] in (b"{", b"["))

    return Registry([
        Adapter("json", json_match, read_json, splits.form_of), Adapter("csv", _by_ext(".csv", ".tsv"), read_csv, splits.form_of), Adapter("txt", _by_ext(".txt", ".md", ".log"), read_text),
        Adapter("pdf", lambda path, head: 2 * (path.lower().endswith(".pdf") or head.startswith(b"%PDF-")), pdf_reader(extract_pdf)),
    ])


def sniff(content: Column, n: int = SNIFF) -> Column:
    return F.substring(content, 1, n)


def schema_of(path: Column) -> Column:
    """The file's stem."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parse(files: DataFrame, registry: Registry, size: int = SNIFF) -> DataFrame:
    """Items of binaryFile rows. Each file is read by one task, in one go."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        names = [x.split()[0] for x in ITEM.split(", ")]
        for p in parts:
            for path, content in zip(p["path"], p["content"], strict=True):
                adapter = registry.pick(path, bytes(content[:size]))
                if adapter is None:
                    continue
                base, rows = (path, adapter.name, hashlib.sha256(content).hexdigest()), []
                try:
                    for i, (kind, x) in enumerate(adapter.read(content, path)):
                        if kind == "r":
                            fields = json.dumps({k: canonical(v) for k, v in x.items()}, ensure_ascii=False)
                            rows.append((*base, "r", i, fields, None, None, None, None))
                        else:
                            rows.append((*base, "s", i, None, *x, None))
                except Exception as e:  # one bad file is one row of errors
                    rows = [(*base, "e", 0, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, ITEM)


@dataclass(frozen=True)
class WalkOptions:
    """``glob`` limits file names; ``ignore`` adds patterns to those of the root's
    ignore files, which ``ignore_files`` turns off; ``sniff`` is how many bytes
    adapters see; hidden files and folders need ``hidden``; CSV, TSV, JSON lines and
    JSON arrays of more than ``split_over`` bytes are read in ranges."""

    glob: str | None = None
    ignore: tuple[str, ...] = ()
    ignore_files: bool = True
    hidden: bool = False
    sniff: int = SNIFF
    split_over: int = 128 << 20


def ignore_regex(pattern: str) -> str | None:
    """A line of an ignore file as a regular expression for paths below the root;
    None for comments, blank lines and exceptions (which aren't supported)."""
    p = pattern.rstrip()
    if not p or p.startswith(("#", "!")):
        return None
    fixed, p = "/" in p.rstrip("/"), p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(p[i], re.escape(p[i])), i + 1
    return ("^" if fixed else "^(?:.*/)?") + out + "(?:/.*)?$"


def listed(spark: SparkSession, root: str, options: WalkOptions = WalkOptions()) -> DataFrame:
    """binaryFile rows of the files under ``root`` that aren't hidden or ignored.

    Ignore patterns are those of the root's own ignore files; ones in deeper
    folders are not read, and a pattern that starts with ! has no effect."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    base = fs.makeQualified(base)
    patterns = list(options.ignore)
    for name in IGNORE_FILES if options.ignore_files else ():
        at = jvm.org.apache.hadoop.fs.Path(base, name)
        if fs.exists(at):
            stream = fs.open(at)
            patterns += bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()
            stream.close()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if options.glob:
        reader = reader.option("pathGlobFilter", options.glob)
    files = reader.load(root)
    top = base.toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.col("path"), "^.*?" + re.escape(top) + "/", "") if top else F.col("path")
    if not options.hidden:
        files = files.where(~below.rlike(r"(?:^|/)\.[^/]"))
    for regex in filter(None, map(ignore_regex, patterns)):
        files = files.where(~below.rlike(regex))
    return files


def _heads(spark: SparkSession, paths: list[str], size: int) -> list[bytes]:
    """The first bytes of each file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def head(path: str) -> bytes:
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(conf).open(at)
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(head, paths))


#: Bytes that one row can hold.
ROW = (1 << 31) - 64


def walk(spark: SparkSession, root: str, registry: Registry | None = None, options: WalkOptions = WalkOptions()) -> DataFrame:
    """All items of the files under ``root``.

    Large files that can be cut are read in ranges, by as many tasks as they have
    (their names and first bytes come to the driver); the others each by one task,
    and of those one of over 2 GB is an error row."""
    registry, files = registry or default_registry(), listed(spark, root, options)
    large = files.where(F.col("length") > options.split_over).select("path", F.col("_metadata.file_path").alias("named"), "length").collect()
    cut, over = [], []
    for r, head in zip(large, _heads(spark, [r["path"] for r in large], options.sniff), strict=True):
        adapter = registry.pick(r["path"], head)
        form = adapter.ranges(r["path"], head) if adapter else None
        if form:
            cut.append((r["path"], r["named"], form, r["length"], adapter.name))
        elif adapter and r["length"] > ROW:
            over.append((r["path"], adapter.name))
    whole = files.where((F.col("length") <= ROW) & ~F.col("path").isin([c[0] for c in cut])) if large else files
    items = parse(whole, registry, options.sniff)
    nothing = lambda *names: {n: F.lit(None).cast("string") for n in names}
    if cut:
        names = spark.createDataFrame([(c[0], c[4]) for c in cut], "path string, adapter string")
        ranged = splits.read(spark, [c[:4] for c in cut]).join(F.broadcast(names), "path")
        items = items.unionByName(ranged.withColumns(nothing("heading", "text", "locator")).select(*items.columns))
    if over:
        bad = spark.createDataFrame(over, "path string, adapter string").withColumns(nothing("content_hash", "fields", "heading", "text", "locator"))
        items = items.unionByName(bad.withColumns({"kind": F.lit("e"), "pos": F.lit(0).cast("long"), "error": F.lit("ValueError: over 2 GB and not to be read in ranges")}).select(*items.columns))
    return items


def records(items: DataFrame) -> DataFrame:
    """(…, schema, fields map<string, JSON text>) in file order."""
    return items.where("kind = 'r'").select(*RECORDS[:-1], schema_of(F.col("path")).alias("schema"), F.from_json("fields", "map<string,string>").alias("fields"))


def sections(items: DataFrame) -> DataFrame:
    return items.where("kind = 's'").select(*SECTIONS)


def errors(items: DataFrame) -> DataFrame:
    return items.where("kind = 'e'").select("path", "adapter", "error")


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A large delimited table by Spark's own splittable reader: strings only, a
    ragged row fails, an empty cell is an empty string."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, mode="FAILFAST", emptyValue="")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
