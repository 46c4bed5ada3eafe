"""Splits, sequence packing in closed form, row cutting and masks.

A document of t tokens (its end token included) that starts at prefix sum s
covers rows s // L to (s + t - 1) // L, so packing needs no sequential state:
prefix sums over slices of the order give every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.stage import running

VAL_FRACTION, MIN_VAL_DOCS, ROWS_PER_SHARD, IGNORED = 0.001, 2000, 1000, -100


def split_by_document(docs: DataFrame, fraction: float = VAL_FRACTION, minimum: int = MIN_VAL_DOCS, seed: int = 0, check: bool = True) -> DataFrame:
    """Adds split: of each source the max(ceil(fraction * n), minimum) ids with the smallest seeded hashes are val.

    The hash's value range is cut into slices with counts, so the rank of a row
    needs only its slice. A source that would be taken whole raises.
    """
    rows = docs.withColumn("u_", tx.unit(seed, F.col("id"))).withColumn("slice_", F.floor(F.col("u_") * 1024).cast("int"))
    counts = rows.groupBy("source", "slice_").agg(F.count("*").alias("n_"))
    before = W.partitionBy("source").orderBy("slice_").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s_"), F.col("slice_").alias("k_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"), F.sum("n_").over(W.partitionBy("source")).alias("total_"))
    rows = rows.join(counts, (F.col("source") == F.col("s_")) & (F.col("slice_") == F.col("k_")))
    rank = F.row_number().over(W.partitionBy("source", "slice_").orderBy("u_", "id")) + F.col("before_")
    n_val = F.greatest(F.ceil(F.lit(fraction) * F.col("total_")), F.lit(minimum))
    if check:
        n_val = F.when(n_val >= F.col("total_"), F.raise_error(F.concat(F.lit("no train documents would be left in "), F.col("source"))).cast("bigint")).otherwise(n_val)
    return rows.withColumn("split", F.when(rank <= n_val, "val").otherwise("train")).select(*docs.columns, "split")


def starts(docs: DataFrame, tokens: Column, by: tuple[str, ...] = ("source", "split"), order: str = "ord") -> DataFrame:
    """Adds t, the tokens with the end, and start, the tokens of the group before, in the order of a unique number."""
    return running(docs.withColumn("t", tokens.cast("long")), F.col("t"), "start", order, by=by)


def pieces(placed: DataFrame, row_len: int | Column) -> DataFrame:
    """A line for each (document, row): row, lo and hi in the document's tokens, at in the row."""
    n = row_len if isinstance(row_len, Column) else F.lit(row_len)
    rows = F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("t") - 1) / n))
    out = placed.withColumn("row", F.explode(rows))
    lo = F.greatest(F.col("row") * n - F.col("start"), F.lit(0))
    hi = F.least((F.col("row") + 1) * n - F.col("start"), F.col("t"))
    return out.withColumns({"lo": lo, "hi": hi, "at": F.col("start") + lo - F.col("row") * n})


def packed_rows(placed: DataFrame, row_len: int | Column, by: tuple[str, ...] = ("source", "split")) -> DataFrame:
    """One line a row: its documents in order, real tokens, licences joined by +, all/any flags."""
    p = pieces(placed, row_len)
    docs = F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])
    return p.groupBy(*by, "row").agg(
        docs.alias("documents"), F.sum(F.col("hi") - F.col("lo")).alias("length"), F.array_join(F.sort_array(F.collect_set("licence")), "+").alias("licence"),
        F.bool_and("commercial_safe").alias("commercial_safe"), F.bool_or("research_only").alias("research_only"),
    )


def packed_tokens(placed: DataFrame, tokens: str, row_len: int, end: int = 0, by: tuple[str, ...] = ("source", "split")) -> DataFrame:
    """The rows themselves: input_ids and doc_ids of row_len entries, the last row padded with end tokens of its last document. tokens: an array column that ends in the end token."""
    p = pieces(placed, row_len)
    cut = F.slice(tokens, (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    rows = p.groupBy(*by, "row").agg(F.sort_array(F.collect_list(F.struct("at", cut.alias("ids")))).alias("parts"))
    rows = rows.withColumn("ids", F.flatten(F.transform("parts", lambda x: x["ids"])))
    local = F.flatten(F.transform("parts", lambda x, k: F.array_repeat(k, F.size(x["ids"]))))
    pad = F.lit(row_len) - F.size("ids")
    return rows.select(*by, "row", F.concat("ids", F.array_repeat(F.lit(end), pad)).alias("input_ids"), F.concat(local, F.array_repeat((F.size("parts") - 1), pad)).alias("doc_ids"), F.size("ids").alias("length"))


def document_offsets(rows: DataFrame) -> DataFrame:
    """Adds offsets: for each token its distance from where its document starts in the row."""
    return rows.withColumn("offsets", F.transform("doc_ids", lambda d, k: (k - F.array_position("doc_ids", d) + 1).cast("int")))


def boundary_labels(rows: DataFrame) -> DataFrame:
    """Adds labels: the next token, IGNORED where it belongs to another document, lies past the length, or does not exist."""
    n = F.size("input_ids")
    nxt = F.concat(F.slice("input_ids", F.lit(2), n - 1), F.array(F.lit(None).cast("int")))
    doc = F.concat(F.slice("doc_ids", F.lit(2), n - 1), F.array(F.lit(None).cast("int")))
    same = F.zip_with("doc_ids", doc, lambda a, b: a == b)
    labels = F.zip_with(nxt, same, lambda x, ok: F.when(ok, x).otherwise(F.lit(IGNORED)))
    real = F.transform(labels, lambda x, k: F.when(k + 1 < F.col("length"), x).otherwise(F.lit(IGNORED)))
    return rows.withColumn("labels", real)


def cut_rows(rows: DataFrame, factor: int) -> DataFrame:
    """Each stored row as `factor` consecutive shorter ones; the length is clipped to each."""
    width = (F.size("input_ids") / F.lit(factor)).cast("int")
    out = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("width", width)
    lo = F.col("part") * F.col("width")
    cut = lambda c: F.slice(c, lo + 1, F.col("width")).alias(c)
    return out.select(*[c for c in rows.columns if c not in ("input_ids", "doc_ids", "length")], "part", cut("input_ids"), cut("doc_ids"), F.greatest(F.lit(0), F.least(F.col("length") - lo, F.col("width"))).alias("length"))


def right_padded(rows: DataFrame, ids: str, batch: str) -> DataFrame:
    """Adds padded and labels: ids filled with 0, labels with IGNORED, to the longest of the batch."""
    longest = F.max(F.size(ids)).over(W.partitionBy(batch))
    out = rows.withColumn("longest_", longest)
    return out.withColumns({"padded": F.concat(ids, F.array_repeat(F.lit(0), F.col("longest_") - F.size(ids))), "labels": F.concat(ids, F.array_repeat(F.lit(IGNORED), F.col("longest_") - F.size(ids)))}).drop("longest_")


def write_shards(rows: DataFrame, path: str, rows_per_shard: int = ROWS_PER_SHARD) -> None:
    """Parquet by source and split, at most rows_per_shard rows a file; complete or absent, by the job's commit."""
    rows.write.option("maxRecordsPerFile", rows_per_shard).partitionBy("source", "split").parquet(path)


def shard_directory(lengths: list[int], row_len: int) -> tuple[int, int]:
    """The packed length that serves rows of row_len, and how many each stored row gives: itself, else the smallest multiple."""
    if row_len in lengths:
        return row_len, 1
    fits = sorted(n for n in lengths if n > row_len and n % row_len == 0)
    if not fits:
        raise FileNotFoundError(f"no shards of {row_len} tokens or a multiple of it")
    return fits[0], fits[0] // row_len
