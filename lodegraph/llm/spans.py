"""Long exact spans shared between documents, by a log-structured index of fingerprints.

Documents come in batches. Each batch's winnowed fingerprints (see winnow.py) are written as a sorted, immutable run, bucketed by
hash, in the shared folder; the run is merge-joined with the runs before it (same buckets: no shuffle), which gives the hashes
that two different texts share; where runs are many they are compacted into one that keeps, for each hash, what tells one text
from more. Any span of min_span characters holds a fingerprint, so no shared span is missed. Only around shared
fingerprints are the windows of exactly min_span characters compared, by a 128-bit digest: each window belongs to the
fingerprint chosen from it, so each is compared once. What those windows cover is the result, exactly. An index given a
folder of its own is kept there and goes on with the next batch (see FingerprintIndex).

Nothing is done by pairs: a fingerprint or window in a million documents is a million rows of a partial aggregation. A text is
known by a 128-bit digest. Of copies of a whole text one stands for all, chosen from narrow rows before texts move; the others
are joined to the result at the end, hot ones by broadcast.

Null texts and texts shorter than min_span share nothing. Characters are code points, compared exactly. A repeat within one
document is no sharing; repeated rows of one doc_id with the same text count as one document, with different texts as different
ones whose results come as rows of their own. Empty tables give empty results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import cut, shared_dir, spread
from .common import small_batches
from .winnow import chosen, code_points, fingerprints, window_hashes

MIN_SPAN = 200
#: Runs at which they are compacted.
COMPACT_AT = 3
_OWNER = ["o1", "o2"]


def _split(min_span: int) -> tuple[int, int]:
    """Gram and window whose guarantee is min_span."""
    gram = (min_span + 2) // 2
    return gram, min_span - gram + 1


def _post(min_span: int):
    """The different fingerprints of each text, in place of the text."""
    gram, window = _split(min_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            hs = [np.unique(fingerprints(code_points(t.as_py()), gram, window)[1]) for t in texts]
            ends = np.cumsum([0, *map(len, hs)]).astype(np.int32)
            values = np.concatenate(hs).view(np.int64) if hs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[*batch.schema.names[:-1], "hs"])

    return run


def _windows(min_span: int):
    """For each window of min_span characters whose chosen fingerprint is among the given hashes: its digest and place."""
    gram, window = _split(min_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts, marked = batch.columns
            for i in range(len(texts)):
                points = code_points(texts[i].as_py())
                starts = chosen(points, gram, window, np.sort(marked[i].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                for lo in range(0, len(starts), 1 << 16):
                    some = starts[lo : lo + (1 << 16)]
                    a, b = np.empty(len(some), np.uint64), np.empty(len(some), np.uint64)
                    base = 0
                    while base < len(some):
                        end = np.searchsorted(some, some[base] + (1 << 16))
                        part = points[some[base] : some[end - 1] + min_span]
                        a[base:end] = window_hashes(part, min_span, 1)[some[base:end] - some[base]]
                        b[base:end] = window_hashes(part, min_span, 2)[some[base:end] - some[base]]
                        base = end
                    number = pa.array(np.full(len(some), numbers[i].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), number, pa.array(some.astype(np.int32))], names=["a", "b", "t", "start"])

    return run


def _ends() -> list:
    """What is kept of a group of texts to tell, now or later, whether they are different."""
    return [f(c).alias(f"{name}_{c}") for c in _OWNER for f, name in ((F.min, "low"), (F.max, "high"))]


_DIFFERENT = "low_o1 <> high_o1 or low_o2 <> high_o2"
_RUN = "h bigint, low_o1 bigint, high_o1 bigint, low_o2 bigint, high_o2 bigint, n bigint"


class FingerprintIndex:
    """Sorted runs of (h, low and high of both halves of the texts' digests, n): two different texts differ in a half, so low
    <> high of one says that different texts share the hash. Runs are only ever added, merge-joined and compacted.

    Without a folder the index lives in the shared folder until close(). With one it is kept: each run is a folder named after
    its number of buckets, and opening the same folder again finds the runs. One writer at a time."""

    def __init__(self, spark: SparkSession, buckets: int, compact_at: int = COMPACT_AT, root: str | None = None) -> None:
        self.spark, self.buckets, self.compact_at, self.kept = spark, buckets, compact_at, root is not None
        self.root = root or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.shared: DataFrame | None = None
        path, fs = self._place(self.root)
        for status in fs.listStatus(path) if self.kept and fs.exists(path) else []:
            name = status.getPath().getName()
            if fs.exists(self._place(f"{self.root}/{name}/_SUCCESS")[0]):
                spark.sql(f"create table if not exists {name} ({_RUN}) using parquet clustered by (h) sorted by (h) into {name.split('_')[1]} buckets location '{self.root}/{name}'")
                self.runs.append(name)

    def _place(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{self.buckets}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, runs: list[str], files: bool) -> None:
        for r in runs:
            self.spark.sql(f"drop table if exists {r}")
            if files:
                path, fs = self._place(f"{self.root}/{r}")
                fs.delete(path, True)

    def add(self, postings: DataFrame) -> DataFrame:
        """Adds a batch of (h, o1, o2); returns (h, n): the hashes that are now known to be shared and of which a text is in
        this batch, and in how many postings they are at least."""
        # aggregated before the shuffle, so a hash in very many texts is one row a task
        run = self._write(postings.groupBy("h").agg(*_ends(), F.count(F.lit(1)).alias("n")))
        fresh = self.spark.table(run)
        found = fresh.where(_DIFFERENT).select("h", "n")
        for old in self.runs:
            past = self.spark.table(old).select("h", *[F.col(c).alias(f"past_{c}") for c in ("low_o1", "high_o1", "low_o2", "high_o2", "n")])
            differ = " or ".join(f"least(low_{c}, past_low_{c}) <> greatest(high_{c}, past_high_{c})" for c in _OWNER)
            found = found.unionByName(fresh.join(past, "h").where(differ).select("h", (F.col("n") + F.col("past_n")).alias("n")))
        found = cut(found.groupBy("h").agg(F.max("n").alias("n")))
        self.shared = found if self.shared is None else self.shared.unionByName(found)
        self.runs.append(run)
        if len(self.runs) >= self.compact_at:
            self.compact()
        return found

    def compact(self) -> None:
        """One run in place of all; the old ones go only once the new one is whole."""
        # read as plain files: a union of bucketed scans claims a partitioning by bucket that it does not have (Spark 4.1)
        every = self.spark.read.schema(_RUN).parquet(*[f"{self.root}/{r}" for r in self.runs])
        both = [f(f"{name}_{c}").alias(f"{name}_{c}") for c in _OWNER for f, name in ((F.min, "low"), (F.max, "high"))]
        merged = self._write(every.groupBy("h").agg(*both, F.sum("n").alias("n")))
        old, self.runs = self.runs, [merged]
        self._drop(old, True)

    def close(self) -> None:
        """Takes the runs out of the catalogue, and their files away unless the index is kept."""
        self._drop(self.runs, not self.kept)
        if not self.kept:
            path, fs = self._place(self.root)
            fs.delete(path, True)


def hot_rows(counted: DataFrame, key: str, total: int) -> list:
    """The keys of (key, n) with more than 1/(4 x partitions) of all rows; at most 4 x partitions by that definition."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [r[0] for r in counted.where(F.col("n") > max(20_000, total / (4 * parts))).select(key).distinct().collect()]


def shared_windows(docs: DataFrame, min_span: int = MIN_SPAN, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", index_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(owners, windows): the documents (doc_id, n_chars, o1, o2) and the windows (o1, o2, starts) of min_span characters that
    stand in different texts. o1 and o2 are the halves of a text's digest. With index_root the fingerprints of these
    documents stay in the index there, next to those of earlier calls."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.char_length("text") >= min_span))
    texts = texts.select("doc_id", F.char_length("text").alias("n_chars"), F.xxhash64("text").alias("o1"), F.xxhash64(F.lit("\x1f"), "text").alias("o2"), "text")
    posted = cut(texts.mapInArrow(_post(min_span), f"doc_id {dict(texts.dtypes)['doc_id']}, n_chars int, o1 long, o2 long, hs array<long>"))
    every = posted.select(*_OWNER, F.explode("hs").alias("h"))
    index = FingerprintIndex(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), root=index_root)
    try:
        for b in range(batches):
            index.add(every.where(F.pmod("o1", F.lit(batches)) == b))
        shared = index.shared.groupBy("h").agg(F.max("n").alias("n"))
        total = posted.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()[0]
        # a fingerprint that a third of the texts have is met by broadcast, not gathered in one task
        marked = lookup_join(every, shared.select("h"), "h", "left_semi", hot_rows(shared, "h", total)).groupBy(*_OWNER).agg(F.collect_set("h").alias("marked"))
        first = posted.groupBy(*_OWNER).agg(F.min("doc_id").alias("first"))
        marked = cut(marked.join(first, _OWNER).withColumn("t", F.monotonically_increasing_id()))  # a short name for each text
    finally:
        index.close()
    # of copies only the first is sent: the key holds its id, so even a text that is everywhere goes to one task once
    likely = _maybe_in(texts.withColumnRenamed("doc_id", "first"), marked)
    marks = marked.select(F.col("o1").alias("m1"), F.col("o2").alias("m2"), F.col("first").alias("m"), "t", "marked")
    one = cut(likely.join(marks, (F.col("o1") == F.col("m1")) & (F.col("o2") == F.col("m2")) & F.col("first").eqNullSafe(F.col("m"))).select("t", "text", "marked"))
    windows = one.mapInArrow(_windows(min_span), "a long, b long, t long, start int")
    keys = cut(windows.groupBy("a", "b").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("a", "b"))
    return posted.drop("hs"), windows.join(keys, ["a", "b"]).groupBy("t").agg(F.collect_set("start").alias("starts")).join(marked.select("t", *_OWNER), "t").select(*_OWNER, "starts")


def _maybe_in(texts: DataFrame, marked: DataFrame, most_bits: int = 1 << 29) -> DataFrame:
    """The texts that may be among the marked ones (o1, o2, first), by a bit map of about eight bits for each of these and 64 MB
    at most, so that the others' texts are not shuffled. A set bit may belong to another text: a join has to follow."""
    bits = min(most_bits, 1 << max(16, (8 * marked.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*_OWNER, "first"), F.lit(bits))
    maps = marked.select(F.bitmap_bucket_number(slot).alias("_part"), F.bitmap_bit_position(slot).alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return texts.withColumn("_part", F.bitmap_bucket_number(slot)).withColumn("_at", at).join(F.broadcast(maps), "_part").where(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0).drop("_part", "_at", "_map")


def _stretches(min_span: int):
    """Starts of windows to the maximal stretches they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts in batch.column(2):
                at = np.unique(starts.values.to_numpy(zero_copy_only=False))
                gap = np.flatnonzero(np.diff(at) > min_span)
                out.append([{"start": int(at[i]), "end": int(at[j]) + min_span} for i, j in zip(np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(at) - 1]]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS)], names=["o1", "o2", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def shared_spans(docs: DataFrame, min_span: int = MIN_SPAN, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", index_root: str | None = None) -> DataFrame:
    """(doc_id, n_chars, copies, spans, shared_chars): for each document that shares a span its length, the number of
    documents with the same whole text, the maximal shared stretches as structs (start, end), and how many characters these
    cover. Stretches that overlap are one; offsets count code points from 0, end excluded."""
    owners, windows = shared_windows(docs, min_span, batches, id_col, text_col, index_root)
    spans = windows.mapInArrow(_stretches(min_span), "o1 long, o2 long, spans array<struct<start:int,end:int>>")
    owners = owners.distinct()
    key = F.concat(F.hex("o1"), F.lit("-"), F.hex("o2")).alias("owner")
    copies = owners.groupBy(*_OWNER).agg(F.countDistinct("doc_id").alias("copies"), F.count(F.lit(1)).alias("n"))
    known = copies.join(spans, _OWNER, "left").where("copies > 1 or spans is not null")
    # a text with copies is shared as a whole, so what is broadcast of a hot one is a few numbers
    known = cut(known.select(key, "copies", "n", F.when(F.col("copies") == 1, F.col("spans")).alias("spans")))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = lookup_join(owners.select(key, "doc_id", "n_chars"), known.drop("n"), "owner", "inner", hot_rows(known, "owner", total))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_chars").alias("end")))
    out = out.withColumn("spans", F.coalesce("spans", whole))
    return out.select("doc_id", "n_chars", "copies", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("shared_chars"))
