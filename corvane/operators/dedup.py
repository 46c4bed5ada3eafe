"""Exact and near deduplication with survivors in a fixed visiting order.

Similarity is the exact Jaccard of word-shingle sets. Equal sets are one class
from the start, so copies never meet each other; classes meet by a prefix
filter (sets sorted rarest shingle first: two sets of similarity t share a
shingle in their first n - ceil(t * n) + 1), which keeps frequent shingles out
of the join and loses no pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.corpus import keep_order
from corvane.operators.stage import cut, drop_since, mark

SHINGLE, THRESHOLD, PERMUTATIONS = 5, 0.8, 128
#: Bands and rows for that threshold and number of permutations.
BANDS, ROWS = 9, 13
#: Classes of a bucket that one block holds, about.
BUCKET_BLOCK = 256
#: Open nodes that are settled in one task.
SETTLED_AT_ONCE = 50_000


def shingle_sets(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """id and its sorted distinct shingle hashes."""
    rows = docs.select("id", tx.words(F.col("text")).alias("w"))
    return rows.select("id", tx.shingle_hashes(F.col("w"), n).alias("set"))


def set_classes(sets: DataFrame) -> DataFrame:
    """id, rep: the least id with an equal set; empty sets are left out."""
    keyed = sets.filter(F.size("set") > 0).select("id", F.size("set").alias("n"), F.xxhash64("set").alias("k1"), F.xxhash64(F.lit(7), F.col("set")).alias("k2"))
    rep = keyed.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"))
    return keyed.join(rep, ["n", "k1", "k2"]).select("id", "rep")


def class_pairs(sets: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a < b, jaccard: representatives whose sets are at least this similar."""
    reps = cut(sets.join(classes.filter("id = rep").select("id"), "id", "left_semi"))
    grams = reps.select("id", F.size("set").alias("n"), F.explode("set").alias("g"))
    rare = grams.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    # a shingle of one set joins nothing: only its place in the order counts, and it comes first
    shared = grams.join(rare, "g").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("common"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    skip = F.col("n") - F.size("common")
    head = F.when(prefix > skip, F.slice("common", F.lit(1), (prefix - skip).cast("int"))).otherwise(F.slice("common", 1, 0))
    heads = shared.select("id", "n", F.explode(F.transform(head, lambda x: x["g"])).alias("g"))
    other = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g")
    met = heads.withColumnsRenamed({"id": "a", "n": "na"}).join(other, "g").filter("a < b").filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    pairs = met.select("a", "b").distinct()
    x = reps.select(F.col("id").alias("a"), F.col("set").alias("x"))
    y = reps.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    j = both / (F.size("x") + F.size("y") - both)
    return pairs.join(x, "a").join(y, "b").select("a", "b", j.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, jaccard: similar class representatives, and each further member of a class with its representative."""
    sets = cut(shingle_sets(docs))
    classes = set_classes(sets)
    copies = classes.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return class_pairs(sets, classes, threshold).unionByName(copies)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """id, duplicate_of, dropped by equal texts: of one source the first in visiting order stays; the first of another source is linked to the first of all."""
    rows = docs.select("id", "source", tx.sha256(F.col("text")).alias("sha"), F.struct(*keep_order(docs)).alias("o"))
    first = rows.groupBy("sha", "source").agg(F.min("o").alias("first_o"), F.min_by("id", "o").alias("first_id"))
    of_all = rows.groupBy("sha").agg(F.min_by("id", "o").alias("all_id"))
    j = rows.join(first, ["sha", "source"]).join(of_all, "sha")
    dup = F.when(F.col("id") != F.col("first_id"), F.col("first_id")).when(F.col("id") != F.col("all_id"), F.col("all_id"))
    return j.select("id", dup.alias("duplicate_of"), (F.col("id") != F.col("first_id")).alias("dropped")).filter("duplicate_of is not null")


def survivors(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, duplicate_of, kind, jaccard, dropped for each document that is dropped or linked; all others are kept without a row.

    In visiting order a document is dropped if a kept one of its source has its
    text or a similar set; else it is kept, and linked to the first kept copy
    of its text in another source, or to the best similar kept document. Within
    a class and source only the first can be kept, so the order is settled on
    those, in rounds: a node falls once an earlier neighbour of its source is
    kept and stays once all of them have fallen. The rounds are joins over the
    edges; once few nodes are open they are visited in order in one task, so a
    long chain does not take a round a link.
    """
    order = F.struct(*keep_order(docs)).alias("o")
    rows = docs.select("id", "source", tx.sha256(F.col("text")).alias("sha"), order)
    sets = cut(shingle_sets(docs))
    classes = set_classes(sets)
    pairs = cut(class_pairs(sets, classes, threshold))
    # texts without words have no set; equal ones still are copies
    rows = rows.join(classes, "id", "left").withColumn("rep", F.coalesce("rep", F.concat(F.lit("text:"), "sha")))
    rows = cut(rows.withColumn("first_o", F.min("o").over(W.partitionBy("rep", "source"))))
    nodes = rows.filter(F.col("o") == F.col("first_o")).select("rep", "source", "id", "o")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    mine = nodes.select(F.col("rep").alias("a"), "source", F.col("id").alias("x"), F.col("o").alias("xo"))
    theirs = nodes.select(F.col("rep").alias("b"), F.col("source").alias("y_source"), F.col("id").alias("y"), F.col("o").alias("yo"))
    edges = cut(both.join(mine, "a").join(theirs, "b").filter("yo < xo").select("x", "y", "source", "y_source", "jaccard"))
    inside = edges.filter("source = y_source").select("x", "y")
    state = cut(nodes.join(inside.select(F.col("x").alias("id")).distinct().withColumn("open", F.lit(True)), "id", "left").select("id", F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("kept")))
    since = mark()
    # a round settles at least the first open node of every chain; what is left of long chains is settled in one task once it is small
    while (left := state.filter("kept is null").count()) > SETTLED_AT_ONCE:
        seen = inside.join(state.select(F.col("id").alias("y"), F.col("kept").alias("y_kept")), "y")
        view = seen.groupBy("x").agg(F.bool_or(F.coalesce("y_kept", F.lit(False))).alias("beaten"), F.bool_and(F.coalesce(~F.col("y_kept"), F.lit(False))).alias("clear"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("beaten"), False).when(F.col("clear"), True)
        state = cut(state.join(view, state["id"] == view["x"], "left").select("id", new.alias("kept")))
        drop_since(since)
    if left:
        state = cut(_settled(state, inside, nodes))
        drop_since(since)
    kept = state.filter("kept").select(F.col("id").alias("k"))
    near = edges.join(kept, F.col("y") == F.col("k"), "left_semi")
    best = F.max(F.struct(F.col("jaccard").alias("j"), F.col("y").alias("of")))
    best_same = near.filter("source = y_source").groupBy("x").agg(best.alias("same")).withColumnRenamed("x", "node")
    best_any = near.groupBy("x").agg(best.alias("near")).withColumnRenamed("x", "node2")
    first = nodes.select(F.col("rep").alias("n_rep"), F.col("source").alias("n_source"), F.col("id").alias("node"))
    at = rows.join(first, (F.col("rep") == F.col("n_rep")) & (F.col("source") == F.col("n_source"))).join(state.select(F.col("id").alias("s_id"), "kept"), F.col("node") == F.col("s_id"))
    at = at.join(best_same, "node", "left").join(best_any, F.col("node") == F.col("node2"), "left")
    live = rows.join(kept, F.col("id") == F.col("k"), "left_semi")
    # earlier kept documents of the same text, and of the same set, in other sources
    text_first = live.groupBy("sha").agg(F.min(F.struct("o", "id", "source")).alias("t")).withColumnRenamed("sha", "t_sha")
    at = at.join(text_first, F.col("sha") == F.col("t_sha"), "left")
    at = at.join(live.select(F.col("id").alias("f_id"), F.col("sha").alias("f_sha")), F.col("node") == F.col("f_id"), "left")
    kin = live.select("id", "rep", "o", F.max("id").over(W.partitionBy("rep").orderBy("o").rowsBetween(W.unboundedPreceding, -1)).alias("kin"), )
    at = at.join(kin.select(F.col("id").alias("q_id"), "kin"), F.col("id") == F.col("q_id"), "left")
    is_node = F.col("id") == F.col("node")
    is_kept = is_node & F.col("kept")
    same_best = F.greatest(F.col("same"), F.when(~is_node & F.col("kept"), F.struct(F.lit(1.0).alias("j"), F.col("node").alias("of"))))
    any_best = F.greatest(F.col("near"), F.when(F.col("kin").isNotNull(), F.struct(F.lit(1.0).alias("j"), F.col("kin").alias("of"))))
    exact_same = ~is_node & F.col("kept") & (F.col("f_sha") == F.col("sha"))
    exact_other = is_kept & (F.col("t.id") != F.col("id")) & (F.col("t.source") != F.col("source"))
    log = (
        F.when(exact_same, F.struct(F.col("node").alias("of"), F.lit("exact").alias("kind"), F.lit(1.0).alias("j")))
        .when(~is_kept, F.struct(same_best["of"].alias("of"), F.lit("near").alias("kind"), F.round(same_best["j"], 4).alias("j")))
        .when(exact_other, F.struct(F.col("t.id").alias("of"), F.lit("exact").alias("kind"), F.lit(1.0).alias("j")))
        .when(any_best.isNotNull(), F.struct(any_best["of"].alias("of"), F.lit("near").alias("kind"), F.round(any_best["j"], 4).alias("j")))
    )
    return at.select("id", log.alias("l"), (~is_kept).alias("dropped")).filter("l is not null").select("id", F.col("l.of").alias("duplicate_of"), F.col("l.kind").alias("kind"), F.col("l.j").alias("jaccard"), "dropped")


def _settled(state: DataFrame, inside: DataFrame, nodes: DataFrame) -> DataFrame:
    """The state with its open nodes, at most SETTLED_AT_ONCE, visited one after the other in one task."""
    open_ = state.filter("kept is null").select("id")
    links = inside.join(open_.withColumnRenamed("id", "x"), "x").join(state.select(F.col("id").alias("y"), F.col("kept").alias("y_kept")), "y")
    # what a node needs to know: whether a settled neighbour is kept, and which neighbours are open, themselves few
    per = links.groupBy("x").agg(F.bool_or(F.coalesce("y_kept", F.lit(False))).alias("beaten"), F.collect_list(F.when(F.col("y_kept").isNull(), F.col("y"))).alias("open"))
    rows = per.join(nodes.select(F.col("id").alias("x"), "o"), "x").select(F.lit(0).alias("one"), "x", "beaten", "open", "o")
    kind = dict(state.dtypes)["id"]

    def visited(group: pa.Table) -> pa.Table:
        held: dict = {}
        ids, beaten, near = (group.column(c).to_pylist() for c in ("x", "beaten", "open"))
        for k in _in_order(group):
            held[ids[k]] = not beaten[k] and not any(held.get(y, False) for y in near[k])
        return pa.table([pa.array(list(held)), pa.array(list(held.values()), pa.bool_())], names=["x", "now"])

    now = rows.groupBy("one").applyInArrow(visited, f"x {kind}, now boolean")
    return state.join(now, F.col("id") == F.col("x"), "left").select("id", F.coalesce("kept", "now").alias("kept"))


def _in_order(group: pa.Table) -> list[int]:
    """Places of a group's rows by their visiting order, compared field by field."""
    keys = [tuple(o.values()) for o in group.column("o").to_pylist()]
    return sorted(range(len(keys)), key=keys.__getitem__)


def _signed(permutations: int, seed: int, digest: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
        for batch in batches:
            out, own = [], []
            for s in batch.column(1):
                h = np.asarray(s.values.to_numpy(), np.int64).view(np.uint64)
                out.append([int(x) for x in ((h[:, None] * a + b) >> np.uint64(32)).min(axis=0)] if len(h) else None)
                own.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if digest else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), pa.array(own, pa.binary())][: 2 + digest], ["id", "signature", "digest"][: 2 + digest])

    return run


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """id, signature: the least 32-bit value of each permutation over the shingles; null without shingles."""
    return shingle_sets(docs).mapInArrow(_signed(permutations, seed), "id string, signature array<long>")


def _members(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = lambda c: rows.field(c).flatten().to_numpy().reshape(len(rows), -1)
    return np.array(rows.field("id").to_pylist(), object), column("signature"), column("keys")


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of a bucket with their signatures' agreement, in the first band that both share."""
    kinds = {"a": pa.string(), "b": pa.string(), "estimate": pa.float64()}
    for batch in batches:
        held, n = [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held]), kind) for k, kind in enumerate(kinds.values())], list(kinds))  # noqa: B023

        band, same, left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("band", "same", "l", "r"))
        for at, own, x, y in zip(band.to_pylist(), same.to_pylist(), left, right):
            (ids, s, k), (others, t, j) = _members(x.values), _members(y.values)
            for i in range(len(ids)):
                to = np.flatnonzero(others > ids[i]) if own else np.arange(len(others))
                to = to[~(j[to, :at] == k[i, :at]).any(axis=1)]
                if len(to):
                    low = others[to] > ids[i]
                    held.append((np.where(low, ids[i], others[to]), np.where(low, others[to], ids[i]), (t[to] == s[i]).mean(axis=1)))
                    n += len(to)
            if n >= 50_000:
                yield made()
                held, n = [], 0
        if n:
            yield made()


def lsh_candidates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """a < b, estimate: the classes of equal sets that share a band bucket, by their least ids, and their signatures' agreement; copies with their class's least id.

    A bucket is dealt into blocks and every two of its blocks meet in a row of
    their own. Only the first band that two classes share gives the pair.
    """
    kind = dict(docs.dtypes)["id"]
    signed = cut(shingle_sets(docs).mapInArrow(_signed(PERMUTATIONS, 1, True), f"id {kind}, signature array<long>, digest binary").filter("signature is not null"))
    classes = signed.groupBy("digest").agg(F.min("id").alias("rep"))
    named = signed.join(classes, "digest").select("id", "rep", "signature")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.slice("signature", k * rows + 1, rows)))
    reps = cut(named.filter("id = rep").select("id", "signature", keys.alias("keys")))
    banded = reps.select("id", F.posexplode("keys").alias("band", "key"))
    blocks = banded.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks"))
    dealt = banded.join(blocks, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = cut(dealt.join(reps, "id").groupBy("band", "key", "blocks", "block").agg(F.collect_list(F.struct("id", "signature", "keys")).alias("m")))
    left = members.select("band", "key", F.col("block").alias("x"), F.col("m").alias("l"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    right = members.select("band", "key", F.col("block").alias("y"), F.col("m").alias("r"))
    met = left.join(right, ["band", "key", "y"]).select("band", (F.col("x") == F.col("y")).alias("same"), "l", "r")
    pairs = met.mapInArrow(_bucket_pairs, "a string, b string, estimate double")
    return pairs.unionByName(named.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("estimate")))
