"""The most similar vectors for every vector, by vantage-point trees.

Vectors are scaled to length one, so that the Euclidean distance, for which the triangle inequality holds, orders them as the
cosine does. A routing tree, built on a bounded sample, sends each row to one shard: a node has a vantage point and a distance at
which the sample's distances leave a gap. How far the rows on either side really are from the point is then taken over all
rows, so nothing depends on the sample but speed. A search enters a side only if the triangle inequality allows a neighbour
there: d(query, point) - farthest inside <= factor * reach, and nearest outside - d(query, point) <= factor * reach, reach being
the distance of the k-th best so far (or the given radius). Within a shard the same search runs on a tree of the shard's own
rows. factor 1 is exact; less prunes more and may lose neighbours.

Shards of many rows are cut into blocks, and so are the queries that enter them, so that a task holds two blocks at most,
however many rows a shard has; no rows are dropped for it.

Vectors that are null, of another length, all zero, or have null or infinite or undefined elements take no part. Of repeated
deliveries of an id the latest counts. Exactly equal vectors are searched as one and of their ids the smallest count, however many
they are; between different vectors the order is that of the cosine as computed. A vector is not its own neighbour, but equal
vectors of other ids are. Empty input gives an empty result."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from ..tables import norm_id
from .common import small_batches

DIM = 384
#: Rows of the routing sample, at least and at most (48 MB); it is collected to the driver. In between it grows with the rows,
#: so that groups of about a block can be told apart. There is at most one leaf for LEAST_ROWS of its rows.
SAMPLE, SAMPLE_MOST, LEAST_ROWS = 4096, 32_768, 8
#: Rows of a block, at most.
BLOCK = 8192
#: Rows of a bucket of a shard's own tree.
BUCKET = 256


def _unit(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(sizes == dim)
            some = batch.take(pa.array(rows))
            flat = np.asarray(some.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dim)
            ok = np.isfinite(flat).all(1) & (flat != 0).any(1)
            flat = flat[ok]
            flat /= np.abs(flat).max(1, keepdims=True)
            flat = (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype("<f4")
            some = some.take(pa.array(np.flatnonzero(ok)))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "at", "vec"])

    return run


def usable_vectors(entities: DataFrame, id_col: str = "id", vector: str = "embedding_vector", at: str = "updated_at", dim: int = DIM) -> DataFrame:
    """(id, vec): the unit vectors as bytes, one row per id."""
    small_batches(entities.sparkSession)
    rows = entities.where(F.size(vector) == dim).select(norm_id(id_col).alias("id"), F.col(at).cast("timestamp").alias("at"), F.col(vector).cast("array<float>").alias("vec")).where("id is not null")
    return rows.mapInArrow(_unit(dim), "id string, at timestamp, vec binary").groupBy("id").agg(F.max(F.struct("at", "vec")).alias("x")).select("id", "x.vec")


@dataclass
class Node:
    point: np.ndarray
    radius: float
    inside: "Node | int"
    outside: "Node | int"
    number: int = 0
    farthest: float = 2.0
    nearest: float = 0.0


@dataclass
class Routing:
    root: "Node | int"
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 1


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ points.T)))


def _gap(d: np.ndarray, least: int) -> tuple[float, float]:
    """(width, middle) of the widest gap between sorted distances that leaves ``least`` rows on either side."""
    s = np.sort(d)
    steps = np.diff(s)[least - 1 : len(s) - least]
    if not len(steps):
        return 0.0, 0.0
    i = int(np.argmax(steps)) + least - 1
    return float(s[i + 1] - s[i]), float((s[i] + s[i + 1]) / 2)


def build_routing(sample: np.ndarray, least_gap: float = 0.12, least_rows: int = LEAST_ROWS, tries: int = 24, seed: int = 7, deepest: int = 400) -> Routing:
    """A tree whose splits lie in gaps of the sample's distances; a vantage point is moved to the middle of its near side."""
    rnd, out = np.random.default_rng(seed), Routing(0)
    out.leaves = 0

    def grow(rows: np.ndarray, splits: int) -> Node | int:
        x = sample[rows]
        if len(rows) >= 2 * least_rows and splits < deepest:
            for pick in rnd.permutation(len(rows))[:tries]:
                point, best = x[pick], (0.0, 0.0)
                for _ in range(3):
                    d = distances(x, point[None])[:, 0]
                    best = _gap(d, least_rows)
                    near = x[d <= best[1]]
                    if not len(near):
                        break
                    mean = near.mean(0)
                    point = (mean / max(np.linalg.norm(mean), 1e-9)).astype(np.float32)
                d = distances(x, point[None])[:, 0]
                best = _gap(d, least_rows)
                if best[0] >= least_gap:
                    node = Node(point, best[1], 0, 0, len(out.nodes))
                    out.nodes.append(node)
                    node.inside = grow(rows[d <= best[1]], splits + 1)
                    node.outside = grow(rows[d > best[1]], splits + 1)
                    return node
        out.leaves += 1
        return out.leaves - 1

    out.root = grow(np.arange(len(sample)), 0) if len(sample) else 0
    out.leaves = max(1, out.leaves)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)


def _assign(packed: bytes, dim: int):
    """Rows to leaves, with each node's distances: (id, vec, leaf) and, as rows without id, (node, far, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routing: Routing = pickle.loads(packed)
        points = np.array([n.point for n in routing.nodes], np.float32).reshape(-1, dim)
        far, near = np.zeros(len(routing.nodes)), np.full(len(routing.nodes), 2.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            d, leaf = distances(x, points), np.zeros(len(x), np.int32)
            stack = [(routing.root, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                if isinstance(at, int):
                    leaf[rows] = at
                elif len(rows):
                    own = d[rows, at.number]
                    isin = own <= at.radius
                    if isin.any():
                        far[at.number] = max(far[at.number], own[isin].max())
                    if not isin.all():
                        near[at.number] = min(near[at.number], own[~isin].min())
                    stack += [(at.inside, rows[isin]), (at.outside, rows[~isin])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf), pa.nulls(len(x), pa.float64()), pa.nulls(len(x), pa.float64())], names=["id", "vec", "leaf", "far", "near"])
        n = len(routing.nodes)
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(far), pa.array(near)], names=["id", "vec", "leaf", "far", "near"])

    return run


def _enter(packed: bytes, dim: int, factor: float):
    """Queries (id, vec, home, reach) to the leaves they must be searched in: (id, vec, leaf, reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routing: Routing = pickle.loads(packed)
        points = np.array([n.point for n in routing.nodes], np.float32).reshape(-1, dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            reach = batch.column(3).to_numpy(zero_copy_only=False) * factor + 1e-5
            d = distances(_matrix(batch.column(1), dim), points)
            rows_out, leaves_out, stack = [], [], [(routing.root, np.arange(batch.num_rows))]
            while stack:
                at, rows = stack.pop()
                if isinstance(at, int):
                    rows_out.append(rows)
                    leaves_out.append(np.full(len(rows), at, np.int32))
                elif len(rows):
                    own = d[rows, at.number]
                    stack += [(at.inside, rows[own - at.farthest <= reach[rows]]), (at.outside, rows[at.nearest - own <= reach[rows]])]
            rows, leaves = np.concatenate(rows_out), np.concatenate(leaves_out)
            for lo in range(0, len(rows), 4096):
                take = pa.array(rows[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves[lo : lo + 4096]), batch.column(2).take(take), batch.column(3).take(take)], names=["id", "vec", "leaf", "home", "reach"])

    return run


class Tree:
    """A vantage-point tree of the rows of one block: halves at the median distance, down to buckets."""

    def __init__(self, x: np.ndarray, bucket: int = BUCKET, seed: int = 1) -> None:
        self.x, self.bucket, self.rnd = x, bucket, np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.bucket:
            return rows, np.ascontiguousarray(self.x[rows])
        point = self.x[rows[self.rnd.integers(len(rows))]]
        d = distances(self.x[rows], point[None])[:, 0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        return point, float(d[order[half - 1]]), float(d[order[half]]), self._grow(rows[order[:half]]), self._grow(rows[order[half:]])

    def search(self, q: np.ndarray, k: int, reach: np.ndarray, factor: float = 1.0, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest within reach of each query, best first; -1 where there are fewer. same: for
        each query its own row here, or -1."""
        self.q, self.k, self.factor = q, k, factor
        self.reach = reach.astype(np.float64).copy()
        self.best = np.full((len(q), k), -3.0, np.float32)
        self.rows = np.full((len(q), k), -1, np.int64)
        self.same = np.full(len(q), -1) if same is None else same
        if len(self.x) and len(q):
            self._visit(self.root, np.arange(len(q)))
        order = np.argsort(-self.best, axis=1, kind="stable")
        return np.take_along_axis(self.rows, order, 1), np.take_along_axis(self.best, order, 1)

    def _visit(self, at, who: np.ndarray) -> None:
        if not len(who):
            return
        if len(at) == 2:
            rows, x = at
            s = self.q[who] @ x.T
            own = np.flatnonzero((self.same[who] >= 0) & np.isin(self.same[who], rows))
            if len(own):
                place = {r: i for i, r in enumerate(rows)}
                for i in own:
                    s[i, place[self.same[who[i]]]] = -3
            hit = np.flatnonzero(s.max(1) >= 1 - (self.reach[who] + 1e-6) ** 2 / 2)
            if len(hit):
                some, s = who[hit], s[hit]
                s[s < (1 - (self.reach[some] + 1e-6) ** 2 / 2)[:, None]] = -3
                both = np.concatenate([self.best[some], s], 1)
                names = np.concatenate([self.rows[some], np.broadcast_to(rows, s.shape)], 1)
                top = np.argpartition(-both, self.k - 1, axis=1)[:, : self.k]
                self.best[some] = np.take_along_axis(both, top, 1)
                self.rows[some] = np.where(self.best[some] > -3, np.take_along_axis(names, top, 1), -1)
                worst = self.best[some].min(1).astype(np.float64)
                full = worst > -3
                self.reach[some[full]] = np.minimum(self.reach[some[full]], np.sqrt(np.maximum(0, 2 - 2 * worst[full])))
            return
        point, farthest, nearest, inside, outside = at
        d = distances(self.q[who], point[None])[:, 0]
        closer = d <= (farthest + nearest) / 2
        goes_in = lambda w, e: w[e - farthest <= self.factor * self.reach[w] + 1e-5]
        goes_out = lambda w, e: w[nearest - e <= self.factor * self.reach[w] + 1e-5]
        self._visit(inside, goes_in(who[closer], d[closer]))
        self._visit(outside, goes_out(who[~closer], d[~closer]))
        self._visit(outside, goes_out(who[closer], d[closer]))
        self._visit(inside, goes_in(who[~closer], d[~closer]))


_OUT = pa.schema([("q", pa.string()), ("x", pa.string()), ("cosine", pa.float64())])


def _search(dim: int, k: int, factor: float):
    def run(group: pa.Table) -> pa.Table:
        data = group["reach"].is_null().to_numpy()
        ids = np.array(group["id"].to_pylist(), dtype=object)
        vecs, d, q = _matrix(group["vec"], dim), np.flatnonzero(data), np.flatnonzero(~data)
        d = d[np.argsort(ids[d])]
        # exactly equal vectors are one row of the tree; of their ids the first k + 1 can count, one of them being the query
        made: dict[bytes, int] = {}
        kind = np.fromiter((made.setdefault(vecs[i].tobytes(), len(made)) for i in d), np.int64, len(d))
        members: list[list[str]] = [[] for _ in made]
        for i, u in zip(d, kind):
            if len(members[u]) <= k:
                members[u].append(ids[i])
        one = d[np.unique(kind, return_index=True)[1]]
        at = dict(zip(ids[d], kind.tolist()))
        same = np.array([at.get(i, -1) for i in ids[q]], np.int64)
        reach = np.array(group["reach"].to_pylist(), dtype=object)[q].astype(np.float64)
        rows, _ = Tree(vecs[one]).search(vecs[q], k, reach, factor, same)
        rows = np.concatenate([same[:, None], rows], 1)  # the query's own copies are found without a search
        i, j = np.nonzero(rows >= 0)
        kinds = rows[i, j]
        exact = np.einsum("ij,ij->i", vecs[q[i]].astype(np.float64), vecs[one[kinds]].astype(np.float64)) if len(i) else np.empty(0)
        found: list[list[tuple[float, str]]] = [[] for _ in q]
        for n, u, c in zip(i.tolist(), kinds.tolist(), exact.tolist()):
            found[n] += [(-c, x) for x in members[u] if x != ids[q[n]]]
        out = [(ids[q[n]], x, -c) for n, near in enumerate(found) for c, x in sorted(near)[:k]]
        return pa.table([pa.array([r[c] for r in out], t.type) for c, t in enumerate(_OUT)], schema=_OUT)

    return run


def nearest(vectors: DataFrame, k: int, queries: DataFrame | None = None, radius: float | None = None, factor: float = 1.0, dim: int = DIM, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(q, x, cosine, rank): for each query the k most similar vectors; with a radius only those within it.

    vectors, queries: as usable_vectors gives them; queries are ids to be searched, all rows by default. Without a radius a
    first search in each query's own shard finds how far the search has to reach in the others."""
    rows = max(1, vectors.count())
    sample = min(max(sample, 2 * LEAST_ROWS * rows // block), max(sample, SAMPLE_MOST))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 1.25 * sample / rows + 0.01 * (rows < 100 * sample)) * (1 << 30))
    some = [r.vec for r in vectors.where(share).select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).select("vec").collect()]
    routing = build_routing(np.frombuffer(b"".join(map(bytes, some)), "<f4").reshape(-1, dim) if some else np.empty((0, dim), np.float32))
    placed = cut(vectors.select("id", "vec").mapInArrow(_assign(pickle.dumps(routing), dim), "id string, vec binary, leaf int, far double, near double"))
    for r in placed.where("id is null").groupBy("leaf").agg(F.max("far").alias("far"), F.min("near").alias("near")).collect():
        routing.nodes[r.leaf].farthest, routing.nodes[r.leaf].nearest = r.far, r.near
    packed = pickle.dumps(routing)
    data = placed.where("id is not null").select("id", "vec", "leaf")
    asked = data if queries is None else data.join(queries.select("id").distinct(), "id", "left_semi")

    def search(entering: DataFrame, held: bool) -> DataFrame:
        if held:
            entering = cut(entering)
        blocks = F.broadcast(data.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("ni")))  # one row a leaf: at most 4096
        turns = F.broadcast(entering.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nj")))
        hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = data.join(blocks, "leaf").join(turns, "leaf").select("id", "vec", F.lit(None).cast("double").alias("reach"), "leaf", hashed("ni").alias("i"), each("nj").alias("j"))
        q = entering.join(blocks, "leaf").join(turns, "leaf").select("id", "vec", "reach", "leaf", each("ni").alias("i"), hashed("nj").alias("j"))
        found = x.unionByName(q).groupBy("leaf", "i", "j").applyInArrow(_search(dim, k, factor), "q string, x string, cosine double")
        return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "x"))).where(F.col("rank") <= k)

    entered = "id string, vec binary, leaf int, home int, reach double"
    if radius is not None:
        ways = asked.select("id", "vec", F.col("leaf").alias("home"), F.lit(float(radius)).alias("reach")).mapInArrow(_enter(packed, dim, factor), entered)
        return search(ways.select("id", "vec", "leaf", "reach"), True)
    first = cut(search(asked.select("id", "vec", "leaf", F.lit(2.0).alias("reach")), False))
    worst = first.groupBy(F.col("q").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).otherwise(F.lit(-1.0)).alias("worst"))
    bound = asked.join(worst, "id", "left").select("id", "vec", F.col("leaf").alias("home"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.coalesce("worst", F.lit(-1.0)))).alias("reach"))
    ways = bound.mapInArrow(_enter(packed, dim, factor), entered).where("leaf <> home")
    rest = search(ways.select("id", "vec", "leaf", "reach"), True)
    both = first.drop("rank").unionByName(rest.drop("rank")).distinct()
    return both.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "x"))).where(F.col("rank") <= k)


def mutual_pairs(found: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine), a < b: pairs of which each is among the other's nearest, with a cosine of at least ``least``."""
    pair = found.where(F.col("cosine") >= least).select(F.least("q", "x").alias("a"), F.greatest("q", "x").alias("b"), "cosine")
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine")).where("n = 2").select("a", "b", "cosine")


def divisible_by(col: Column | str, n: int) -> Column:
    """Whether a UUID text, read as the number that its hexadecimal digits make, is divisible by n."""
    digits = F.lpad(F.regexp_replace(F.col(col) if isinstance(col, str) else col, "-", ""), 32, "0")
    part = lambda k: F.conv(F.substring(digits, 25 - 8 * k, 8), 16, 10).cast("long") * pow(2, 32 * k, n)
    return F.pmod(part(0) + part(1) + part(2) + part(3), F.lit(n)) == 0
