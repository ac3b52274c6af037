"""Splitting oversized items at natural boundaries, by byte ranges.

An item is cut into byte ranges with halos. Workers count characters and line breaks of each range; prefix sums of these narrow
counts place every range in its item; then each worker emits the pieces that end in its range, by offset, from the range and its
halo alone. No worker needs a whole item, and how an item is cut into ranges changes nothing in the result.

That is so because where to cut depends on the neighbourhood only: characters are counted off in steps, and the piece ends at the
best boundary in the last stretch of its step. Of the boundaries there the kind decides first, then the last one: the end of a
blank line before text that is not indented, of any blank line, of a line before text that is not indented, of any line, of a
sentence or statement, white space, and if there is none the step's end (but not within a carriage return and line feed).
The next piece begins exactly ``overlap`` characters before that cut.

Items of at most max_chars characters are not split and do not come out. Null contents are no items; missing line numbers
count from 1. Characters are code points; "\\r\\n", "\\n" and "\\r" end lines. Of repeated deliveries the latest counts.
Empty tables give empty results."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import norm_enum, norm_id
from .common import latest, small_batches

MAX_CHARS, OVERLAP = 2048, 256
#: Bytes of a range of a table's text and of a file.
TEXT_RANGE, FILE_RANGE = 16 << 10, 8 << 20
#: Characters looked at right of a cut.
_AHEAD = 64
_KINDS = [re.compile(p) for p in (r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)(?=\S)", r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)", r"(?:\r\n|\n|\r)(?=[^\s})\]])", r"(?:\r\n|\n|\r)", r"[.!?;。！？][\"')\]]*\s+|[。！？；]", r"\s+")]
_BREAK = re.compile(r"\r\n|\n|\r")
_BREAK_BYTES = re.compile(rb"\r\n|\n|\r")

PIECES = "item string, piece int, start_char long, end_char long, start_line long, end_line long, content string"
_PIECES = pa.schema([("item", pa.string()), ("piece", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("content", pa.string())])
_RANGES = pa.schema([("item", pa.string()), ("base_line", pa.int64()), ("range", pa.int32()), ("ranges", pa.int32()), ("head", pa.int32()), ("core", pa.int32()), ("n_chars", pa.int64()), ("n_breaks", pa.int64()), ("body", pa.binary())])
RANGES = "item string, base_line long, range int, ranges int, head int, core int, n_chars long, n_breaks long, body binary"


class Steps:
    """The geometry: pieces of at most max_chars that overlap by overlap."""

    def __init__(self, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> None:
        if not 0 <= overlap < max_chars // 2:
            raise ValueError("the overlap must be less than half of a piece")
        self.max_chars, self.overlap = max_chars, overlap
        self.slack = (max_chars - overlap) // 4
        self.step = max_chars - overlap - self.slack
        self.halo = (self.step + self.slack + overlap + 2, _AHEAD + 2)

    def cut(self, text: str, at: int, target: int) -> int:
        """Where the piece whose step ends at ``target`` ends; text begins at character ``at`` of the item."""
        lo, hi = target - self.slack - at, target - at
        part = text[lo : hi + _AHEAD]
        width = hi - lo
        for kind in _KINDS:
            best = 0
            for m in kind.finditer(part):
                if m.end() > width:
                    break
                best = m.end()
            if best:
                return target - self.slack + best
        inside = 0 < width < len(part) and part[width - 1] == "\r" and part[width] == "\n"
        return target - 1 if inside else target


def chars_of(data: bytes) -> int:
    return len(data) - sum(map(data.count, (bytes([b]) for b in range(0x80, 0xC0)))) if not data.isascii() else len(data)


def breaks_of(core: bytes, after: bytes) -> int:
    """Line breaks that end in core; a carriage return before a line feed ends in the line feed."""
    n = core.count(b"\n") + core.count(b"\r") - core.count(b"\r\n")
    return n - (core.endswith(b"\r") and after.startswith(b"\n"))


def _aligned(data: bytes) -> int:
    i = 0
    while i < len(data) and data[i] & 0xC0 == 0x80:
        i += 1
    return i


def emit(steps: Steps, item: str, base_line: int, body: bytes, head: int, core: int, char_start: int, break_start: int, total: int, last: bool) -> Iterator[tuple]:
    """The pieces that end in the range body[head : head + core], whose first character is number char_start."""
    lead = _aligned(body) if head else 0
    end = len(body)
    while end > head + core and end and body[end - 1] & 0xC0 == 0x80:
        end -= 1
    if end > head + core and end and body[end - 1] >= 0xC0:
        end -= 1
    if last:
        end = len(body)
    left = body[lead:head]
    text = body[lead:end].decode("utf-8", "replace")
    at = char_start - chars_of(left)
    breaks = [m.end() for m in _BREAK.finditer(text)]
    before = break_start - bisect_right(breaks, char_start - at)
    step, stop = steps.step, char_start + chars_of(body[head : head + core])
    line = lambda c: base_line + before + bisect_right(breaks, c - at)
    i = max(0, -(-char_start // step) - 1)
    while True:
        target = (i + 1) * step
        if target >= total:
            final = True
            if not last:
                return
        elif target >= stop and not (last and target == stop):
            return
        else:
            final = False
            if target < char_start:
                i += 1
                continue
        a = 0 if i == 0 else steps.cut(text, at, i * step) - steps.overlap
        b = total if final else steps.cut(text, at, target)
        yield item, i, a, b, line(a), line(b - 1) if b > a else line(a), text[a - at : b - at]
        if final:
            return
        i += 1


def _to_ranges(steps: Steps, size: int, single: bool):
    left, right = 4 * steps.halo[0], 4 * steps.halo[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, bases, contents = (batch.column(i) for i in range(3))
            out: list[tuple] = []
            held = 0
            for n in range(batch.num_rows):
                data = contents[n].as_py().encode("utf-8", "replace")
                count = max(1, -(-len(data) // size))
                if single != (count == 1):
                    continue
                base = bases[n].as_py() or 1
                if single:
                    out += emit(steps, items[n].as_py(), base, data, 0, len(data), 0, 0, chars_of(data), True)
                    held += len(data)
                for r in range(0 if single else count):
                    core = data[r * size : (r + 1) * size]
                    body = data[max(0, r * size - left) : (r + 1) * size + right]
                    out.append((items[n].as_py(), base, r, count, min(left, r * size), len(core), chars_of(core), breaks_of(core, data[(r + 1) * size : (r + 1) * size + 1]), body))
                    held += len(body)
                if held > 8 << 20:
                    yield from _batches(out, _PIECES if single else _RANGES)
                    out, held = [], 0
            yield from _batches(out, _PIECES if single else _RANGES)

    return run


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _emit_ranges(steps: Steps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for r in batch.to_pylist():
                out += emit(steps, r["item"], r["base_line"], r["body"], r["head"], r["core"], r["char_start"], r["break_start"], r["total"], r["range"] == r["ranges"] - 1)
                held += len(r["body"])
                if held > 8 << 20:
                    yield from _batches(out, _PIECES)
                    out, held = [], 0
            yield from _batches(out, _PIECES)

    return run


def _placed(ranges: DataFrame) -> DataFrame:
    """Prefix sums of the narrow counts."""
    before = W.partitionBy("item").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return ranges.select("item", "range", zero("n_chars").alias("char_start"), zero("n_breaks").alias("break_start"), F.sum("n_chars").over(W.partitionBy("item")).alias("total"))


def split_items(items: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, range_bytes: int = TEXT_RANGE) -> DataFrame:
    """(item, piece, start_char, end_char, start_line, end_line, content) of items (item, base_line, content)."""
    small_batches(items.sparkSession, 500)
    steps = Steps(max_chars, overlap)
    long = items.select("item", F.col("base_line").cast("long").alias("base_line"), "content").where(F.char_length("content") > max_chars)
    ranges = long.mapInArrow(_to_ranges(steps, range_bytes, False), RANGES)
    sums = _placed(ranges.select("item", "range", "n_chars", "n_breaks"))
    return long.mapInArrow(_to_ranges(steps, range_bytes, True), PIECES).unionByName(ranges.join(sums, ["item", "range"]).mapInArrow(_emit_ranges(steps), PIECES))


def split_entities(entities: DataFrame, **options) -> DataFrame:
    """split_items of code_entities.content. Lines count in the file: from start_line, in FILE rows from 1."""
    max_chars = options.get("max_chars", MAX_CHARS)
    rows = entities.where(F.char_length("content") > max_chars).select(norm_id("id").alias("item"), F.when(norm_enum("entity_type") != "FILE", F.greatest("start_line", F.lit(1))).otherwise(1).alias("base_line"), "content", F.col("updated_at").alias("at")).where("item is not null")
    return split_items(latest(rows, ["item"], ["at"], ["base_line", "content"]), **options)


def _read(path: str, start: int, stop: int) -> bytes:
    import pyarrow.fs as fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_input_file(place) as f:
        return f.read_at(stop - start, start)


def _read_ranges(steps: Steps, size: int, whole: bool):
    left, right = 4 * steps.halo[0], 4 * steps.halo[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, length, r = row["item"], row["size"], row["range"]
                start, stop = r * size, min((r + 1) * size, length)
                lo = max(0, start - left) if whole else start
                body = _read(path, lo, min(length, stop + (right if whole else 1)))
                core = body[start - lo : stop - lo]
                yield from _batches([(path, 1, r, row["ranges"], start - lo, len(core), chars_of(core), breaks_of(core, body[stop - lo : stop - lo + 1]), body if whole else b"")], _RANGES)

    return run


def split_files(spark: SparkSession, files: list[tuple[str, int]], max_chars: int = MAX_CHARS, overlap: int = OVERLAP, range_bytes: int = FILE_RANGE) -> DataFrame:
    """The same for giant UTF-8 files (path, size in bytes), which are only ever read range by range: once to count, once to
    emit. Paths must be readable by all workers."""
    steps = Steps(max_chars, overlap)
    table = spark.createDataFrame([(p, n, max(1, -(-n // range_bytes))) for p, n in files], "item string, size long, ranges int")
    parts = table.select("item", "size", "ranges", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"))
    spread = parts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "item", "range")
    sums = _placed(spread.mapInArrow(_read_ranges(steps, range_bytes, False), RANGES))
    bodies = spread.mapInArrow(_read_ranges(steps, range_bytes, True), RANGES)
    return bodies.join(sums.where(F.col("total") > max_chars), ["item", "range"]).mapInArrow(_emit_ranges(steps), PIECES)
