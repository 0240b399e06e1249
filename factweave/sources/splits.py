"""Large files by byte ranges: CSV, TSV, JSON lines and JSON arrays in many tasks.

Spark's text source cuts a file at separators (line ends, or the closing braces of
an array's objects), whatever file system it is in. What a range means depends on
what stands before it: quotes and brackets may be open. So a first pass sums each
range up for each way in which it may begin, the sums of a file's ranges are put
together in order, and a second pass reads each range knowing where it is. A record
that lies in several ranges is put together from its parts.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed

#: A prime of 255 bits: a range's bytes modulo it, with their number, give a file's.
PRIME = 2**255 - 19
SEPARATORS = {"csv": b"\n", "tsv": b"\n", "lines": b"\n", "array": b"}", "values": b","}
SUMMED = "path string, start long, form string, sums string"
PLACED = "path string, start long, open boolean, depth int, pos long, header string, content_hash string, problem string"
PART = "path string, content_hash string, kind string, pos long, start long, fields string, text string, error string"
_STRING = re.compile(r'(?:[^"\\]++|\\.)*+("|\\?\Z)', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+("|\\?\Z)|[\[\]{},]', re.S)


def form_of(path: str, head: bytes) -> str | None:
    """How a JSON or CSV file can be cut: by its name and first bytes; None if it is
    one value."""
    name, head = path.lower(), head.removeprefix(b"\xef\xbb\xbf").lstrip()
    if name.endswith((".csv", ".tsv")):
        return name[-3:]
    if name.endswith((".jsonl", ".ndjson")):
        return "lines"
    if head[:1] != b"[":
        return None
    return "array" if head[1:].lstrip()[:1] == b"{" else "values"


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open behind a line of CSV, if it was (not) before."""
    if '"' not in line:
        return inside
    body, i = line.rstrip("\r\n"), 0
    while True:
        if inside:
            j = body.find('"', i)
            while j >= 0 and body[j + 1 : j + 2] == '"':
                j = body.find('"', j + 2)
            if j < 0:
                return True
            inside, i = False, j + 1
        elif body[i : i + 1] == '"':
            inside, i = True, i + 1
            continue
        j = body.find(sep, i)
        if j < 0:
            return False
        i = j + 1


def csv_lines(text: str) -> Iterator[str]:
    """Lines with their ends, as a file opened for CSV gives them."""
    return iter(io.StringIO(text, newline=""))


def structure(text: str, inside: bool) -> Iterator[tuple[int, str]]:
    """(place, character) of brackets and commas outside strings; last (-1, '"') if a
    string is open at the end."""
    at = 0
    if inside:
        m = _STRING.match(text)
        if m[1] != '"':
            yield -1, '"'
            return
        at = m.end()
    for m in _TOKEN.finditer(text, at):
        if m[1] is None:
            yield m.start(), m[0]
        elif m[1] != '"':
            yield -1, '"'


class _Sum:
    """One way in which a range may begin: ``inside`` a quoted field or string."""

    def __init__(self, form: str, inside: bool):
        self.form, self.sep, self.inside = form, "\t" if form == "tsv" else ",", inside
        self.depth, self.counts, self.header = 0, Counter(), [] if form in ("csv", "tsv") and not inside else None

    def add(self, text: str) -> None:
        if self.form == "lines":
            self.counts[0] += sum(1 for x in text.split("\n") if x.strip())
        elif self.form in ("csv", "tsv"):
            for line in csv_lines(text):
                fresh = not self.inside and line.strip("\r\n") != ""
                if fresh:
                    self.counts[0] += 1
                if self.header is not None and self.counts[0] == 1:
                    self.header.append(line)
                self.inside = inside_after(line, self.inside, self.sep)
        else:
            inside = False
            for at, c in structure(text, self.inside):
                if at < 0:
                    inside = True
                elif c == ",":
                    self.counts[self.depth] += 1
                else:
                    self.depth += 1 if c in "[{" else -1
            self.inside = inside

    def state(self) -> dict:
        return {"inside": self.inside, "depth": self.depth, "counts": dict(self.counts), "header": "".join(self.header) if self.header else None}


def _runs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(path, start, form, row, bytes) of a batch's runs of rows of one range."""
    starts, paths = batch.column("start").to_numpy(), batch.column("path").dictionary_encode()
    codes = paths.indices.to_numpy()
    edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
    for a, z in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if z > a:
            form = batch.column("form")[int(a)].as_py()
            sep = SEPARATORS[form]
            yield paths.dictionary[int(codes[a])].as_py(), int(starts[a]), form, int(a), sep.join(batch.column("value").slice(a, z - a).to_pylist()) + sep


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """A row for each range: what it does in either state, its bytes modulo PRIME."""
    at, ways, size, value, problem = None, [], 0, 0, None

    def done() -> pa.RecordBatch:
        sums = {"size": size, "value": str(value), "ways": [w.state() for w in ways], "problem": problem}
        return pa.RecordBatch.from_pydict({"path": [at[0]], "start": pa.array([at[1]], pa.int64()), "form": [at[2]], "sums": [json.dumps(sums)]})

    for batch in batches:
        for path, start, form, _, data in _runs(batch):
            if (path, start, form) != at:
                if at is not None:
                    yield done()
                at, ways, size, value, problem = (path, start, form), [_Sum(form, False), _Sum(form, True)], 0, 0, None
            size += len(data)
            value = (value * pow(256, len(data), PRIME) + int.from_bytes(data, "big")) % PRIME
            try:
                text = data.decode("utf-8")
                for w in ways[: 1 if start == 0 else 2]:
                    w.add(text)
            except UnicodeDecodeError as e:
                problem = f"UnicodeDecodeError: {e.reason}"
    if at is not None:
        yield done()


def _place(ranges: pd.DataFrame) -> pd.DataFrame:
    """A file's ranges in order: in which state, at which record each begins; the
    file's hash; what is wrong with the whole, if anything is."""
    inside, depth, pos, outer, header, value, size, problem, rows = False, 0, 0, 0, None, 0, 0, None, []
    form, length = ranges["form"].iloc[0], int(ranges["length"].iloc[0])
    for r in ranges.sort_values("start").itertuples():
        sums = json.loads(r.sums)
        way = sums["ways"][int(inside)]
        problem = problem or sums["problem"]
        if not rows:
            header = sums["ways"][0]["header"]
        rows.append([r.path, r.start, inside, depth, pos])
        counts = {int(k): n for k, n in way["counts"].items()}
        pos += counts.get(1 - depth if form in ("array", "values") else 0, 0)
        outer += counts.get(-depth, 0)
        inside, depth = way["inside"], depth + way["depth"]
        size, value = size + sums["size"], (value * pow(256, sums["size"], PRIME) + int(sums["value"])) % PRIME
        if problem is None and form in ("csv", "tsv") and len(rows) == 1 and (inside and pos == 1 or pos == 0):
            problem = "ValueError: the header is longer than a range of the file"
    # the last row has got a separator that the file may lack (a byte order mark is not in the rows)
    added = size in (length + 1, length - 2)
    if form in ("array", "values"):
        depth += added and form == "array"
        if problem is None and outer != (added and form == "values"):
            problem = "ValueError: text behind the array"
    if problem is None and (inside or depth):
        problem = "ValueError: the file ends within a record"
    digest = hashlib.sha256(f"{length}:{value}".encode()).hexdigest()
    return pd.DataFrame([[*r, header, digest, problem] for r in rows], columns=["path", "start", "open", "depth", "pos", "header", "content_hash", "problem"])


class _Reader:
    """The records of one range, of which it is known how it begins. ``put`` takes
    (kind, pos, fields, text, error): records (r), parts of records (f), errors (e)."""

    def __init__(self, form: str, start: int, inside: bool, depth: int, pos: int, header: str | None, put):
        from .files import canonical, parsed_json

        self.canonical, self.parse, self.put = canonical, parsed_json, put
        self.form, self.sep, self.inside, self.depth, self.pos, self.held = form, "\t" if form == "tsv" else ",", inside, depth, pos, []
        self.begun = start > 0  # whether the array has
        self.first = inside if form in ("csv", "tsv") else start > 0 and depth > 0  # whether what comes first may have begun before
        self.names = next(csv.reader(csv_lines(header), delimiter=self.sep, strict=True)) if header and form in ("csv", "tsv") else None

    def record(self, pos: int, fields: dict) -> None:
        self.put("r", pos, json.dumps({k: self.canonical(v) for k, v in fields.items()}, ensure_ascii=False), None, None)

    def value(self, pos: int, text: str) -> None:
        try:
            v = self.parse(text)
            self.record(pos, v if isinstance(v, dict) else {"value": v})
        except Exception as e:
            self.put("e", pos, None, None, f"{type(e).__name__}: {e}")

    def rows(self, pos: int, lines: list[str]) -> None:
        """Whole records of CSV, the first of which has the number ``pos``."""
        try:
            for row in csv.reader(lines, delimiter=self.sep, strict=True):
                if not row:
                    continue
                if len(row) != len(self.names):
                    raise ValueError(f"record {pos}: {len(row)} fields, {len(self.names)} expected")
                if pos:
                    self.record(pos - 1, dict(zip(self.names, row, strict=True)))
                pos += 1
        except Exception as e:
            self.put("e", pos, None, None, f"{type(e).__name__}: {e}")

    def add(self, text: str) -> None:
        if self.form == "lines":
            for line in text.split("\n"):
                if line.strip():
                    self.value(self.pos, line)
                    self.pos += 1
        elif self.form in ("csv", "tsv"):
            self._csv(text)
        else:
            self._json(text)

    def _csv(self, text: str) -> None:
        """Records begin where no field is open; the last one's lines are held."""
        lines, n = [], 0
        for line in csv_lines(text):
            if not self.inside:
                if self.held and self.first:
                    self.put("f", self.pos - 1, None, "".join(self.held), None)
                elif self.held:
                    lines.extend(self.held)
                    n += 1
                self.held, self.first = [], False
                if not line.strip("\r\n"):
                    continue
                self.pos += 1
            self.held.append(line)
            self.inside = inside_after(line, self.inside, self.sep)
        if lines:
            self.rows(self.pos - n - bool(self.held), lines)

    def _json(self, text: str) -> None:
        """Elements end at the array's own commas and at its end."""
        at, inside = 0, False
        for i, c in structure(text, self.inside):
            if self.begun and not self.depth:
                break  # behind the array
            if i < 0:
                inside = True
            elif c != ",":
                self.depth += 1 if c in "[{" else -1
                if self.depth == 1 and not self.begun:
                    self.begun, self.held, at = True, [], i + 1
                elif self.depth == 0:
                    self._element(text[at:i], True)
                    at = i + 1
            elif self.depth == 1:
                self._element(text[at:i], False)
                at = i + 1
        self.inside = inside
        self.held.append(text[at:])

    def _element(self, last: str, end: bool) -> None:
        text = "".join(self.held) + last
        if self.first:
            self.put("f", self.pos, None, text, None)
        elif text.strip() or not end or self.pos:
            self.value(self.pos, text)
        self.pos, self.held, self.first = self.pos + 1, [], False

    def close(self) -> None:
        """The end of the range: what is held may go on in the next."""
        text = "".join(self.held)
        if self.form in ("csv", "tsv"):
            if text and (self.first or self.inside):
                self.put("f", self.pos - 1, None, text, None)
            elif text:
                self.rows(self.pos - 1, self.held)
        elif self.depth and text.strip():
            self.put("f", self.pos, None, text, None)
        elif text.strip() not in ("", SEPARATORS[self.form].decode()):
            self.put("e", self.pos, None, None, "ValueError: text behind the array")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    names = [x.split()[0] for x in PART.split(", ")]
    kinds = pa.schema([(n, pa.int64() if n in ("pos", "start") else pa.string()) for n in names])
    at, reader = None, None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    for batch in batches:
        for path, start, form, i, data in _runs(batch):
            if (path, start) != at:
                if reader is not None:
                    reader.close()
                one = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                at, digest = (path, start), one("content_hash")
                reader = _Reader(form, start, one("open"), one("depth"), one("pos"), one("header"), lambda kind, pos, fields, text, error: out.append((*[at[0], digest, kind, pos, at[1]], fields, text, error)))  # noqa: B023
            reader.add(data.decode("utf-8"))
            if len(out) > 5_000:
                yield flush()
    if reader is not None:
        reader.close()
    if out:
        yield flush()


def _join(form: str, header: str | None, pos: int, text: str) -> list[tuple]:
    """The record that the parts of its ranges give, or its error."""
    out: list[tuple] = []
    reader = _Reader(form, 0, False, 1, pos, header, lambda *x: out.append(x))
    if form in ("csv", "tsv"):
        reader.rows(pos, list(csv_lines(text)))
    elif text.strip() or pos:
        reader.value(pos, text)
    return out


def _joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = [(r.path, r.content_hash, x[0], x[1], r.start, x[2], None, x[4]) for r in p.itertuples() for x in _join(r.form, r.header, r.pos, r.text)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PART.split(", ")])


def read(spark: SparkSession, files: list[tuple[str, str, str, int]]) -> DataFrame:
    """Items (path, adapter, content_hash, kind, pos, fields, error) of large files,
    given as (path, name by which the text source knows it, form, bytes).

    Records, their numbers and values are those that the file read whole gives. A
    file with any error is one error row, that of its first bad record. The hash is
    of all bytes, wherever the ranges lie, but not that of the file read whole. No
    range passes the driver; the second pass's rows are written once in the shared
    folder, since files with errors give no records. Broadcast is one short row for
    each range (of ``spark.sql.files.maxPartitionBytes``). The bound is that of a
    row: no separator may be over 2 GB from the next, nor a record longer."""
    known = spark.createDataFrame([(p, n, f, size) for p, n, f, size in files], "path string, named string, form string, length long")
    ranged = None
    for sep in sorted({SEPARATORS[f] for _, _, f, _ in files}):
        paths = [p for p, _, f, _ in files if SEPARATORS[f] == sep]
        lines = spark.read.option("lineSep", sep.decode()).text([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
        lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("named"), F.col("_metadata.file_block_start").alias("start"))
        mine = known.where(F.col("form").isin([f for f, s in SEPARATORS.items() if s == sep]))
        lines = lines.join(F.broadcast(mine), "named").select("path", "start", "form", "length", "value")  # one row a file
        ranged = lines if ranged is None else ranged.unionByName(lines)
    sums = ranged.select("path", "start", "form", "value").mapInArrow(_sum_up, SUMMED)
    placed = sums.join(F.broadcast(known.select("path", "length")), "path").groupBy("path").applyInPandas(_place, PLACED)
    placed = checkpointed(placed)
    good = placed.where("problem IS NULL")
    parts = ranged.join(F.broadcast(good), ["path", "start"]).select("path", "start", "form", "value", "open", "depth", "pos", "header", "content_hash").mapInArrow(_read, PART)
    parts = checkpointed(parts)
    whole = parts.where("kind = 'f'").groupBy("path", "content_hash", "pos").agg(F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    whole = whole.join(F.broadcast(known.select("path", "form")), "path").join(F.broadcast(good.where("start = 0").select("path", "header")), "path")
    records = parts.where("kind <> 'f'").unionByName(whole.select("path", "content_hash", "pos", "start", "form", "header", "text").mapInPandas(_joined, PART))
    bad = placed.where("problem IS NOT NULL").groupBy("path", "content_hash").agg(F.lit(-1).cast("long").alias("pos"), F.min("problem").alias("error"))
    bad = bad.unionByName(records.where("kind = 'e'").select("path", "content_hash", "pos", "error"))
    first = bad.groupBy("path", "content_hash").agg(F.min_by("error", "pos").alias("error"))  # a row a file at most
    fine = records.where("kind = 'r'").join(F.broadcast(first.select("path")), "path", "left_anti").select("path", "content_hash", F.lit("r").alias("kind"), "pos", "fields", F.lit(None).cast("string").alias("error"))
    return fine.unionByName(first.select("path", "content_hash", F.lit("e").alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("fields"), "error"))
