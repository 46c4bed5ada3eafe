"""Exact top-k inner product search by norm-bucketed retrieval.

Candidates are dealt into buckets by length, longest first. Every query block
first meets the longest bucket, which gives each query a k-th score to beat.
Buckets are grouped by falling length, so a query block goes only to the
leading groups, down to the last whose longest vector can reach one of its
scores. A task holds one tile: a group's buckets and a bounded number of query
blocks, one of them open at a time. Within a bucket the local cosine
threshold, score / (query length * longest), decides how a query prunes: over
COORD_FROM by the feasible range of its FOCUS largest coordinates, else by
length, a prefix of the bucket. What is left is verified by exact products.

Defined results. Vectors that are null, or hold a null or non-finite component
(as given, or times 64), and rows with a null vec_id take no part. All other
rows do, and rows that share a vec_id are separate queries and candidates; a
query meets every row but itself. Shorter vectors count as padded with zeros.
Products are exact at any size; one that no long holds raises an error. Ties
go to the smaller vec_id. Fewer than k candidates give all of them; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import common

K, SCALE, NARROW = 20, 64, 1 << 30
BUCKET, QUERIES_A_BLOCK = 4096, 512
#: Buckets of a group and query blocks of a tile at most; groups at most, so that their lengths fit in one small row.
TILE, GROUPS = (16, 64), 65_536
COORD_FROM, FOCUS = 0.9, 3
_ROW = "row long, vec_id long, v binary, wide boolean"
_BLOB = "rows binary, ids binary, vectors binary, wide boolean, dim int, n int, longest double"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scaled vectors as bytes, four a component where all fit, else eight (a whole number as double)."""
    for batch in batches:
        ids, vectors = batch.column(1), batch.column(2)
        batch = batch.filter(pc.and_(ids.is_valid(), vectors.is_valid()))
        vectors = batch.column(2)
        flat = vectors.flatten()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))]).astype(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
        ok, small = (np.diff(_sums(~f, ends)) == 0 for f in (np.isfinite(x), np.abs(x) < NARROW))
        for wide in (False, True):
            rows = np.flatnonzero(ok & (small != wide))
            if not len(rows):
                continue
            size = np.diff(ends)[rows]
            took = np.repeat(ends[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            kind = "<f8" if wide else "<i4"
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * np.dtype(kind).itemsize
            raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(x[took].astype(kind).tobytes())])
            picked = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked).cast(pa.int64()), raw, pa.array(np.full(len(rows), wide))], ["row", "vec_id", "v", "wide"])


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])[ends]


def matrix(raw: pa.Array, wide: bool) -> np.ndarray:
    """Vectors of one kind as rows, shorter ones padded."""
    kind = np.dtype("<f8" if wide else "<i4")
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    dim = int(size.max(initial=0)) // kind.itemsize
    if (size == dim * kind.itemsize).all():
        return np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), dim)
    return np.frombuffer(b"".join(x.ljust(kind.itemsize * dim, b"\0") for x in raw.to_pylist()), kind).reshape(len(raw), dim)


def _length(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        size = np.zeros(batch.num_rows)
        for kind in (False, True):
            rows = np.flatnonzero(wide == kind)
            if len(rows):
                size[rows] = _length(matrix(batch.column(2).take(pa.array(rows)), kind))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size)], [*batch.schema.names, "size"])


def _blobs(size: int):
    """Rows of a partition to blobs of `size` vectors of one kind, longest first within each run of the partition."""

    def made(rows: pa.Table, wide: bool):
        rows = rows.combine_chunks()
        m = matrix(rows.column("v").combine_chunks(), wide)
        number, ids = (rows.column(c).to_numpy().astype("<i8") for c in ("row", "vec_id"))
        norm = _length(m)
        order = np.lexsort((ids, -norm))
        return pa.RecordBatch.from_arrays(
            [*(pa.array([x[order].tobytes()], pa.binary()) for x in (number, ids, m)), pa.array([wide]), pa.array([m.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([float(norm.max())])],
            ["rows", "ids", "vectors", "wide", "dim", "n", "longest"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            wide = batch.column(batch.schema.get_field_index("wide"))
            for kind, part in ((False, batch.filter(pc.invert(wide))), (True, batch.filter(wide))):
                if part.num_rows:
                    held[kind].append(part)
                while sum(b.num_rows for b in held[kind]) >= size:
                    table = pa.Table.from_batches(held[kind])
                    yield made(table.slice(0, size), kind)
                    held[kind] = table.slice(size).to_batches()
        for kind, left in held.items():
            if any(b.num_rows for b in left):
                yield made(pa.Table.from_batches(left), kind)

    return run


class Best:
    """The k best (score, id) of each query of a block, kept as rows sorted best first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.own, self.ids, self.q, self.k = rows, ids, vectors, k
        self.norm = _length(vectors)
        self.most = _most(vectors)
        self.score = np.zeros((len(ids), 0), np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.live = np.zeros((len(ids), 0), bool)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor

    def threshold(self) -> np.ndarray:
        """The score that a candidate must reach."""
        own = np.where(self.live[:, self.k - 1], self.score[:, self.k - 1], -np.inf) if self.live.shape[1] >= self.k else np.full(len(self.ids), -np.inf)
        return np.maximum(own, self.floor)

    def _products(self, rows: np.ndarray, p: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Exact products; those of pairs that are not live may be anything."""
        dim = min(self.q.shape[1], p.shape[1])
        bound = self.most * _most(p) * max(dim, 1)
        if bound >= 1 << 63:
            exact = np.array([[int(x) for x in r] for r in self.q[rows, :dim]], object).reshape(len(rows), dim) @ np.array([[int(x) for x in r] for r in p[:, :dim]], object).reshape(len(p), dim).T
            exact = np.where(live, exact, 0)
            if any(not -(1 << 63) <= int(x) < 1 << 63 for x in exact.ravel()):
                raise OverflowError("a score is larger than a long holds")
            return exact.astype(np.int64)
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        return (self.q[rows, :dim].astype(kind) @ p[:, :dim].T.astype(kind)).astype(np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray, found: np.ndarray, live: np.ndarray) -> None:
        """Merge candidates of these rows."""
        if not score.shape[1]:
            return
        have = self.score.shape[1]
        s = np.hstack([self.score[rows], score])
        f = np.hstack([self.found[rows], np.broadcast_to(found, score.shape)])
        a = np.hstack([self.live[rows], live])
        if s.shape[1] > 4 * self.k + have:  # keep whatever reaches the k-th score
            masked = np.where(a, s, np.iinfo(np.int64).min)
            kth = np.partition(masked, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            reach = a & (masked >= kth[:, None])
            width = int(reach.sum(axis=1).max(initial=0))
            order = np.argsort(~reach, axis=1, kind="stable")[:, :width]
            s, f, a = (np.take_along_axis(x, order, 1) for x in (s, f, reach))
        order = np.lexsort((f, -s, ~a), axis=1)[:, : self.k]
        s, f, a = (np.take_along_axis(x, order, 1) for x in (s, f, a))
        if s.shape[1] != have:
            full = [np.zeros((len(self.ids), s.shape[1]), x.dtype) for x in (self.score, self.found, self.live)]
            for new, old in zip(full, (self.score, self.found, self.live), strict=True):
                new[:, : old.shape[1]] = old[:, : new.shape[1]]
            self.score, self.found, self.live = full
        self.score[rows], self.found[rows], self.live[rows] = s, f, a

    def meet(self, numbers: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
        """Search a bucket, sorted longest first."""
        if not len(ids):
            return
        norm = _length(p)
        need = self.threshold()
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(need == -np.inf, -np.inf, need / (self.norm * norm[0]))
        local = np.where((self.norm * norm[0] == 0) & (need > 0), np.inf, np.where(np.isnan(local), -np.inf, local))
        alive = local <= 1 + 1e-12
        by_coordinate = alive & (local >= COORD_FROM)
        for r in np.flatnonzero(by_coordinate):
            c = self._feasible(r, local[r], p, norm)
            if len(c):
                rows, live = np.array([r]), (numbers[c] != self.own[r])[None, :]
                self.add(rows, self._products(rows, p[c], live), ids[c], live)
        rows = np.flatnonzero(alive & ~by_coordinate)
        if len(rows):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(need[rows] > 0, need[rows] / self.norm[rows], -1)
            upto = int(np.searchsorted(-norm, -np.min(least) * (1 - 1e-12), "right"))
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                live = numbers[:upto] != self.own[part][:, None]
                self.add(part, self._products(part, p[:upto], live), ids[:upto], live)

    def _feasible(self, r: int, t: float, p: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Rows whose largest query coordinates lie where a cosine of at least t allows."""
        q = self.q[r] / self.norm[r]
        ok = norm > 0
        unit = np.where(ok, norm, 1)
        spread = np.sqrt(max(0.0, 1 - min(t, 1.0) ** 2))
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            if f < p.shape[1]:
                x, room = p[:, f] / unit, spread * np.sqrt(max(0.0, 1 - q[f] ** 2)) + 1e-9
                # for cosines from t up to 1 the range's ends are reached at t, or at 1 where the coordinate itself is further out
                ends = [q[f] * min(t, 1.0) - room, q[f] * min(t, 1.0) + room, q[f]]
                hi = 1.0 if abs(q[f]) >= t and q[f] > 0 else max(ends)
                lo = -1.0 if abs(q[f]) >= t and q[f] < 0 else min(ends)
                ok &= (x >= lo - 1e-9) & (x <= hi + 1e-9)
        return np.flatnonzero(ok)

    def rows(self) -> pa.RecordBatch:
        at = np.nonzero(self.live & (self.score >= self.floor[:, None]))  # less cannot be among the k best
        return pa.RecordBatch.from_arrays([pa.array(self.own[at[0]]), pa.array(self.ids[at[0]]), pa.array(self.found[at]), pa.array(self.score[at])], ["q_row", "query_id", "vec_id", "score"])


def _most(m: np.ndarray) -> int:
    return int(max(m.max(initial=0), -m.min(initial=0)))


def _read(x: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda name: x.column(x.schema.get_field_index(name))[k].as_py()
    vectors = np.frombuffer(get("vectors"), "<f8" if get("wide") else "<i4").reshape(get("n"), get("dim"))
    return np.frombuffer(get("rows"), "<i8"), np.frombuffer(get("ids"), "<i8"), vectors


def _seeded(k: int):
    """Query blocks, each beside the longest bucket (c_...), to the blocks with their scores to beat and the length that reaches the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            own = pa.RecordBatch.from_arrays([c for c, n in zip(batch.columns, names, strict=True) if not n.startswith("c_")], [n for n in names if not n.startswith("c_")])
            longest = pa.RecordBatch.from_arrays([c for c, n in zip(batch.columns, names, strict=True) if n.startswith("c_")], [n[2:] for n in names if n.startswith("c_")])
            floors, reach = [], []
            for i in range(batch.num_rows):
                best = Best(*_read(own, i), k)
                best.meet(*_read(longest, i))
                need = best.threshold()
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach.append(float(np.min(np.where(need > 0, need / best.norm, 0.0))))
                floors.append(need.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(floors, pa.binary()), pa.array(reach, pa.float64())], [*own.schema.names, "floor", "reach"])

    return run


def _tile(k: int):
    """The best of each query in one tile: a block at a time meets the group's buckets."""

    def run(blocks: pa.Table, buckets: pa.Table) -> pa.Table:
        out = []
        for i in range(blocks.num_rows):
            best = Best(*_read(blocks, i), k, np.frombuffer(blocks.column("floor")[i].as_py(), "<f8"))
            for j in range(buckets.num_rows):
                best.meet(*_read(buckets, j))
            out.append(best.rows())
        return pa.Table.from_batches(out, pa.schema([(c, pa.int64()) for c in ("q_row", "query_id", "vec_id", "score")]))

    return run


def top_k(vectors: DataFrame, queries, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. queries: a Column condition on vec_id that selects the queries."""
    rows = common.staged(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_integers, _ROW), "topk-vectors")
    n, nq = rows.count(), rows.filter(queries).count()
    buckets, blocks = -(-n // BUCKET) or 1, -(-nq // QUERIES_A_BLOCK) or 1
    # a tile grows with the tables up to its bounds, so that small ones still have several
    group = max(1, min(TILE[0], buckets // 32), -(-buckets // GROUPS))
    side = max(1, min(TILE[1], blocks // 8))
    longest_first = rows.mapInArrow(_lengths, _ROW + ", size double").repartitionByRange(buckets, F.col("size").desc(), F.col("vec_id"), F.col("row"))
    found = longest_first.drop("size").mapInArrow(_blobs(BUCKET), _BLOB).withColumn("part", F.spark_partition_id())
    found = common.staged(found, "topk-buckets")
    # groups of consecutive parts, as many as the buckets ask for however many parts the session made
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    found = found.withColumn("group", F.floor(F.col("part") * F.lit(-(-buckets // group)) / F.lit(parts)).cast("int"))
    asked = rows.filter(queries).repartition(blocks, F.xxhash64("row")).mapInArrow(_blobs(QUERIES_A_BLOCK), _BLOB)
    tiles = -(-blocks // side)
    asked = common.staged(asked.withColumn("tile", F.pmod(F.xxhash64("rows"), F.lit(tiles)).cast("int")), "topk-queries")
    # the scores to beat: every block against the bucket with the longest vector, one row
    columns = ["rows", "ids", "vectors", "wide", "dim", "n"]
    first = found.orderBy(F.col("longest").desc(), "part").limit(1).select(*(F.col(c).alias(f"c_{c}") for c in columns))
    q = asked.select("tile", *columns).repartition(min(blocks, 4096), F.xxhash64("rows")).join(F.broadcast(first))
    q = common.staged(q.mapInArrow(_seeded(k), f"tile int, {_BLOB.removesuffix(', longest double')}, floor binary, reach double"), "topk-seeded")
    # a block goes to the leading groups: one row of at most GROUPS lengths tells how many
    reaches = found.groupBy("group").agg(F.max("longest").alias("longest")).agg(F.sort_array(F.collect_list(F.struct("group", "longest"))).alias("lengths"))
    leading = F.filter("lengths", lambda x: x["longest"] * F.lit(1 + 1e-12) >= F.col("reach"))
    q = q.join(F.broadcast(reaches)).withColumn("group", F.explode(F.transform(leading, lambda x: x["group"]))).drop("lengths", "reach")
    c = found.select("group", *columns).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    best = q.groupBy("group", "tile").cogroup(c.groupBy("group", "tile")).applyInArrow(_tile(k), "q_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
QUERIES, ORACLES = {"op7_topk": op7_topk}, {"op7_topk": ORACLE}
