"""Near-duplicate detection with HyperMinHash.

A document's set is its distinct shingles of five words (A-Z lower-cased,
words are runs of anything but space and tab to carriage return). One 64-bit
hash of each shingle picks one of REGISTERS buckets and a fraction; a register
keeps the least fraction's leading-zero count and MANTISSA further bits.
Empty registers take over that of the first filled bucket in a fixed order of
their own, so short texts have full sketches with the same collision
probability.

Registers are banded (BANDS x ROWS). Documents with equal sets are one class,
represented by the least doc_id. In a band bucket every class is paired with
the bucket's least; pairs whose collision-corrected Jaccard estimate allows it
are confirmed on the full sets. That is done in three rounds, with connected
components after each: first the pair that most buckets name, one for each
class; then the other pairs whose ends are still apart; then buckets that hold
different components and more than two classes are compared in full, in
blocks, between components only. No round emits all pairs of a group: n
near copies of one text cost n pairs.

At a similarity of exactly 0.75 a pair shares no band with probability
(1 - 0.75^5)^48 < 3e-6, and less above.

Defined results. A null or wordless text has an empty set, is linked with
nothing and is its own component. Rows that share a doc_id are one vertex:
each row gets its own set size, and links of any of them hold for the id. A
null doc_id takes no part in links, has a null component and is kept. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.components import components

SHINGLE, REGISTERS, MANTISSA, BANDS, ROWS = 5, 240, 10, 48, 5
#: Links: 100 * intersection >= PERCENT * union. Estimates under FLOOR, five standard deviations lower, are not confirmed.
PERCENT, FLOOR = 75, 0.60
#: Clusters up to this size are compared in one group, larger ones in blocks.
SMALL, BLOCK = 64, 256
#: Keys of at least HOT rows, and at most so many of them, are hot.
HOT, HOT_KEYS = 1000, 10_000
_U = np.uint64
_MULTIPLIERS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    data = common.LOWER[data]
    start, end, per = common.word_spans(data, offsets)
    w = common.range_hash(common.prefix_hash(data), start, end)
    n = len(w) - SHINGLE + 1
    rolled = np.zeros(max(n, 0), _U)
    for k, m in enumerate(_MULTIPLIERS):
        if n > 0:
            rolled += w[k : k + n] * m
    rolled = common.mix(rolled)
    out = []
    for a, b in zip(per[:-1].tolist(), per[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            h = np.sort(rolled[a : b - SHINGLE + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(common.mix(np.array([sum((w[a + k] * _MULTIPLIERS[k] for k in range(b - a)), _U(b - a))], _U)))
        else:
            out.append(w[:0])
    return out


def _orders() -> np.ndarray:
    """For each register, the rank of every bucket in the order in which it looks for a filled one."""
    rng = np.random.default_rng(11)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)], np.int32)


_ORDERS = _orders()
_EDGES = np.array([-(-(k << 64) // REGISTERS) for k in range(REGISTERS)], _U)


def sketch(sets: np.ndarray) -> np.ndarray:
    """The registers of a non-empty sorted hash set."""
    at = np.searchsorted(sets, _EDGES)
    stop = np.append(at[1:], len(sets))
    filled = np.flatnonzero(at < stop)
    low = sets[at[filled]] * _U(REGISTERS)  # the fraction within the bucket
    # leading zeros from the exponent of the exact upper half
    high = (low >> _U(11)).astype(np.float64)
    zeros = np.where(high > 0, 53 - np.frexp(high)[1], 53).astype(np.int64)
    mantissa = ((low << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)).astype(np.int64)
    made = (zeros << MANTISSA | mantissa).astype(np.uint16)
    if len(filled) == REGISTERS:
        return made
    out = np.empty(REGISTERS, np.uint16)
    out[filled] = made
    empty = np.flatnonzero(at >= stop)
    out[empty] = made[_ORDERS[np.ix_(empty, filled)].argmin(axis=1)]
    return out


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How often registers of disjoint sets of these sizes collide: least fractions of rates a and b in one cell of relative width about 0.72 / 2^MANTISSA."""
    return 0.72 / (1 << MANTISSA) * na * nb / (na + nb) ** 2


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (rows), corrected for collisions."""
    c = chance(na.astype(float), nb.astype(float))
    return ((a == b).mean(axis=-1) - c) / (1 - c)


@common.released
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in common.chunks(batch.column(1)):
            n, f1, f2, sk = [], [], [], []
            for s in shingles(data, offsets):
                n.append(len(s))
                f1.append(int(s.sum(dtype=_U).view(np.int64)) if len(s) else 0)
                f2.append(int(common.mix(s ^ _U(0x5BD1E9955BD1E995)).sum(dtype=_U).view(np.int64)) if len(s) else 0)
                sk.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sk, pa.binary())], ["doc_id", "n", "f1", "f2", "sketch"])


@common.released
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in common.chunks(batch.column(1)):
            found = shingles(data, offsets)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "shingles"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


@common.released
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and estimate allow a link."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            x = batch.slice(at, 4096)
            na, nb = x.column(2).to_numpy(), x.column(3).to_numpy()
            ok = (estimate(_matrix(x.column(4)), _matrix(x.column(5)), na, nb) >= FLOOR) & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(ok)), x.column(1).filter(pa.array(ok))], ["a", "b"])


def _allowed(k: int, right: np.ndarray, comp: np.ndarray, n: np.ndarray, sk: np.ndarray) -> np.ndarray:
    """Those of right that are in another component than k and that sizes and sketches allow, likeliest first."""
    r = right[(comp[right] != comp[k]) & (100 * np.minimum(n[right], n[k]) >= PERCENT * np.maximum(n[right], n[k]))]
    if not len(r):
        return r
    e = estimate(sk[k][None, :], sk[r], np.full(len(r), n[k]), n[r])
    return r[e >= FLOOR][np.argsort(-e[e >= FLOOR], kind="stable")]


def _meetings(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a group with the rows that it is compared with: all of its small cluster, or the other block of a large one."""
    block, cluster = (group.column(c).to_numpy() for c in ("block", "cluster"))
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    if lo < 0:
        order = np.argsort(cluster, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            for k in range(len(rows) - 1):
                yield rows[k], rows[k + 1 :]
    elif lo == hi:
        for k in range(group.num_rows - 1):
            yield k, np.arange(k + 1, group.num_rows)
    else:
        right = np.flatnonzero(block == hi)
        for k in np.flatnonzero(block == lo):
            yield k, right


def _arrays(group: pa.Table) -> tuple[np.ndarray, ...]:
    sk = np.vstack([np.frombuffer(x, np.uint16) for x in group.column("sketch").to_pylist()])
    return (*(group.column(c).to_numpy().copy() for c in ("rep", "component", "n")), sk)


@common.released
def _named(group: pa.Table) -> pa.Table:
    """The rows of a group that their sketches let link with another of it."""
    group = group.combine_chunks()
    _, comp, n, sk = _arrays(group)
    some = np.zeros(group.num_rows, bool)
    for k, right in _meetings(group):
        found = _allowed(k, right, comp, n, sk)
        some[found] = True
        some[k] |= len(found) > 0
    return group.filter(pa.array(some))


@common.released
def _met(group: pa.Table) -> pa.Table:
    """Links of one group between different components, confirmed on the full sets; linked components merge at once."""
    group = group.combine_chunks()
    ids, comp, n, sk = _arrays(group)
    sets = [np.asarray(x.values.to_numpy(), np.int64) for x in group.column("shingles")]
    out: list[tuple] = []
    for k, right in _meetings(group):
        for j in _allowed(k, right, comp, n, sk):
            if comp[j] != comp[k]:
                c = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                if 100 * c >= PERCENT * (n[k] + n[j] - c):
                    out.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
                    comp[comp == comp[j]] = comp[k]
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that their sketches allow. A leader of very many is split by the join at run time."""
    left = reps.select(F.col("rep").alias("l"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("rep").alias("r"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(right, F.col("b") == F.col("r")).join(left, F.col("a") == F.col("l"))
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_likely, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that their full sets link. Only documents in a pair are read again."""
    wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("w"), "left_semi")
    sets = common.staged(texts.mapInArrow(_sets, "doc_id long, shingles array<long>"), "near-sets")
    left = sets.select(F.col("doc_id").alias("l"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("r"), F.col("shingles").alias("y"))
    both = pairs.join(right, F.col("b") == F.col("r")).join(left, F.col("a") == F.col("l"))
    common_n = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common_n.alias("c"), (F.size("x") + F.size("y") - common_n).alias("u")).filter(100 * F.col("c") >= PERCENT * F.col("u")).filter("u > 0").select("a", "b").distinct()


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    since = common.mark()
    likely = common.staged(_estimated(pairs.select("a", "b"), reps), "near-pairs")
    out = common.staged(_confirmed(likely, docs), "near-links")
    common.drop_since(since)
    return out


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    left = found.select(F.col("node").alias("l"), F.col("component").alias("ca"))
    right = found.select(F.col("node").alias("r"), F.col("component").alias("cb"))
    named = pairs.join(left, F.col("a") == F.col("l"), "left").join(right, F.col("b") == F.col("r"), "left")
    return named.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = common.staged(rows.mapInArrow(_sketched, "doc_id long, n long, f1 long, f2 long, sketch binary"), "near-sketches")
    live = made.filter("n > 0 and doc_id is not null")
    classes = live.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    of = common.staged(classes.select(F.col("n").alias("k0"), F.col("f1").alias("k1"), F.col("f2").alias("k2"), "rep", "copies"), "near-keys")
    same = (F.col("n") == F.col("k0")) & (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2"))
    reps = common.staged(live.join(of, same & (F.col("doc_id") == F.col("rep"))).select("rep", "n", "sketch"), "near-classes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.col("sketch").substr(k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = reps.select("rep", F.explode(keys).alias("key"))
    leaders = common.staged(banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1").select(F.col("key").alias("b_key"), "leader", "size"), "near-leaders")
    # a hot key has this many rows, so there are HOT_KEYS of them at most
    least = max(HOT, max(BANDS * reps.count(), made.count()) // HOT_KEYS)
    by_key = lambda x, y: x["key"] == y["b_key"]
    buckets = common.staged(common.split_join(banded, leaders, by_key, F.col("size") >= least).select("key", "leader", "size", "rep"), "near-buckets")
    counted = buckets.filter("rep <> leader").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("named"))
    na, nb = (reps.select(F.col("rep").alias(f"{x}_id"), F.col("n").alias(f"{x}_n")) for x in "ab")
    near = F.expr(f"100 * least(a_n, b_n) >= {PERCENT} * greatest(a_n, b_n)")
    stars = common.staged(counted.join(na, F.col("a") == F.col("a_id")).join(nb, F.col("b") == F.col("b_id")).filter(near).select("a", "b", "named"), "near-stars")
    # ids with several sets are one vertex, and so are the classes that hold them
    shared = common.staged(live.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("d")), "near-repeats")
    several = live.join(shared, F.col("doc_id") == F.col("d"), "left_semi").join(of, same).filter("doc_id <> rep")
    edges = several.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    first = stars.groupBy("b").agg(F.max(F.struct("named", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    found = components(edges.unionByName(_links(first, reps, docs)))
    # from here on the stars stand for the edges that made them
    stars_of = lambda c: c.select(F.col("component").alias("a"), F.col("node").alias("b"))
    found = components(stars_of(found).unionByName(_links(_apart(stars, found), reps, docs)))
    since = common.mark()
    more = common.staged(_open_links(buckets, found, reps, docs), "near-more")
    common.drop_since(since)
    if not more.isEmpty():
        found = components(stars_of(found).unionByName(more))
    comp = found.select(F.col("node"), "component")
    per_class = of.join(comp, F.col("rep") == F.col("node"), "left").select("k0", "k1", "k2", "copies", F.coalesce("component", "rep").alias("class_component"))
    of_class = lambda x, y: (x["n"] == y["k0"]) & (x["f1"] == y["k1"]) & (x["f2"] == y["k2"]) & x["doc_id"].isNotNull()
    out = common.split_join(made.drop("sketch"), common.staged(per_class, "near-components"), of_class, F.col("copies") >= least, "left")
    component = F.coalesce("class_component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without the near-duplicates of smaller doc_ids. Rows that share a doc_id stay or go together."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("g_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["g_id"], "left_anti")


def _open_links(buckets: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that share a bucket of more than two classes.

    Classes that meet in open buckets form clusters. A cluster's members are
    compared with each other where their sizes allow a link, large clusters in
    blocks by size class: a block meets those of its own and the next class
    only. Sketches travel to the blocks first; the full sets only of those
    members that a sketch lets link there. Pairs are tested and confirmed inside
    the task, which returns links.
    """
    named = buckets.filter("size > 2").join(found, F.col("rep") == F.col("node"), "left").select("key", "leader", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select(F.col("key").alias("m_key"))
    left = named.join(mixed, F.col("key") == F.col("m_key"), "left_semi").select(F.col("leader").alias("a"), F.col("rep").alias("b"), "component").distinct()
    left = common.staged(left, "near-open")
    grouped = components(left.filter("a <> b").select("a", "b"))
    cluster = grouped.select("node", F.col("component").alias("cluster"))
    members = left.select("b", "component").distinct().join(cluster, F.col("b") == F.col("node"), "left").select(F.col("b").alias("rep"), "component", F.coalesce("cluster", "b").alias("cluster"))
    sizes = members.join(reps.select(F.col("rep").alias("s_rep"), "n"), F.col("rep") == F.col("s_rep")).drop("s_rep")
    sizes = common.staged(sizes.withColumn("grade", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / PERCENT))).cast("int")), "near-clusters")
    total = sizes.groupBy("cluster").agg(F.count("*").alias("members")).withColumnRenamed("cluster", "t")
    sizes = sizes.join(total, F.col("cluster") == F.col("t")).drop("t")
    columns = ["lo", "hi", "cluster", "block", "rep", "component", "n"]
    deals = max(1, sizes.filter(F.col("members") <= SMALL).count() // 4000)
    small = sizes.filter(F.col("members") <= SMALL).withColumns({"lo": F.lit(-1), "hi": F.lit(0), "block": F.lit(0)})
    small = small.withColumn("deal", F.pmod(F.xxhash64("cluster"), F.lit(deals)))
    large = sizes.filter(F.col("members") > SMALL)
    per = large.groupBy("cluster", "grade").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    at = lambda step, name: per.select(F.col("cluster").alias(f"{name}_c"), (F.col("grade") - step).alias(f"{name}_g"), F.col("blocks").alias(name))
    for step, name in ((0, "same"), (1, "above"), (-1, "below")):
        large = large.join(at(step, name), (F.col("cluster") == F.col(f"{name}_c")) & (F.col("grade") == F.col(f"{name}_g")), "left").drop(f"{name}_c", f"{name}_g")
    own = F.pmod(F.xxhash64("rep"), F.col("same")).cast("int")
    # a block's number holds its grade, so numbers of the next grade are larger
    number = lambda grade, k: (grade * F.lit(1 << 16) + k).cast("int")
    large = large.withColumn("block", number(F.col("grade"), own))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here = F.transform(upto(F.col("same")), lambda k: number(F.col("grade"), k))
    up = F.transform(upto(F.col("above")), lambda k: number(F.col("grade") + 1, k))
    down = F.transform(upto(F.col("below")), lambda k: number(F.col("grade") - 1, k))
    meets = F.transform(F.concat(here, up, down), lambda k: F.struct(F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi")))
    large = large.withColumn("m", F.explode(meets)).withColumns({"lo": F.col("m.lo"), "hi": F.col("m.hi"), "deal": F.col("cluster")})
    dealt = small.select("deal", *columns).unionByName(large.select("deal", *columns))
    # sketches alone tell whose full sets are needed where
    sketches = reps.select(F.col("rep").alias("s_rep"), "sketch")
    dealt = dealt.join(sketches, F.col("rep") == F.col("s_rep")).select("deal", *columns, "sketch")
    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in dealt.columns)
    named = common.staged(dealt.groupBy("deal", "lo", "hi").applyInArrow(lambda g: _named(g), schema), "near-named")
    wanted = common.staged(named.select(F.col("rep").alias("w")).distinct(), "near-wanted")  # its size decides whether texts are shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("w"), "left_semi")
    sets = common.staged(texts.mapInArrow(_sets, "doc_id long, shingles array<long>"), "near-sets")
    named = named.join(sets, F.col("rep") == F.col("doc_id")).select("deal", *columns, "sketch", "shingles")
    return named.groupBy("deal", "lo", "hi").applyInArrow(lambda g: _met(g), "a long, b long").distinct()


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op2_minhash": op2_minhash}, {}
