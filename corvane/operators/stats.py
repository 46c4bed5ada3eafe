"""Agreement, thresholds, bootstrap, curves and selection rules over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.stage import running


def _over(a: Column, b: Column, zero: Column | None = None) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0) if zero is None else zero)


def agreement(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """n, accuracy, Cohen's kappa (null when chance agreement is 1), precision and recall of label 1."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    t = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    n, tp, fp, fn, tn = (F.col(c).cast("double") for c in ("n", "tp", "fp", "fn", "tn"))
    seen = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return t.select(*by, "n", seen.alias("accuracy"), F.when(chance < 1, F.round((seen - chance) / F.nullif(1 - chance, F.lit(0.0)), 12)).alias("kappa"), _over(tp, tp + fp).alias("precision"), _over(tp, tp + fn).alias("recall"))


def threshold_scan(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 at every observed probability: running totals from the highest down.

    Totals run over the distinct probabilities, summed before, range by range.
    """
    per = df.groupBy(F.col(p).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("all"))
    down = running(running(per, F.col("pos"), "pos_above", F.col("threshold").desc()), F.col("all"), "all_above", F.col("threshold").desc())
    total = per.agg(F.sum("pos").alias("positives"))  # one row
    tp = F.col("pos_above") + F.col("pos")
    rows = down.crossJoin(F.broadcast(total)).select("threshold", tp.alias("tp"), (F.col("all_above") + F.col("all") - tp).alias("fp"), (F.col("positives") - tp).alias("fn"))
    precision, recall = _over(F.col("tp"), F.col("tp") + F.col("fp")), _over(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumns({"precision": precision, "recall": recall}).withColumn("f1", _over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """The row of the best f1, ties to the higher threshold."""
    return threshold_scan(df, p, label).orderBy(F.round("f1", 12).desc(), F.col("threshold").desc()).limit(1)


def paired_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, metric, value) twice to id, metric, a, b: for each metric the items that both have."""
    return a.select("id", "metric", F.col("value").alias("a")).join(b.select("id", "metric", F.col("value").alias("b")), ["id", "metric"])


def paired_bootstrap(pairs: DataFrame, samples: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """metric, n, a, b, diff, ci_low, ci_high, significant, frac_sign_flipped.

    Draw d of a resample takes the item whose number is the hash of (seed,
    resample, d) over the number of items; one draw serves every metric and
    both systems. Draws meet items by number, and a resample misses the items
    that a metric lacks. Bounds are order statistics.
    """
    spark = pairs.sparkSession
    items = pairs.select("id").distinct()
    numbered = running(items, F.lit(1).cast("long"), "k", "id")
    n = items.count()
    draws = spark.range(samples * n).select(F.floor(F.col("id") / n).alias("s"), F.floor(tx.unit(seed, F.col("id").cast("string")) * n).cast("long").alias("k"))
    drawn = draws.groupBy("s", "k").agg(F.count("*").alias("times"))
    rows = pairs.join(numbered, "id").select("metric", "k", "a", "b")
    per = drawn.join(rows, "k").groupBy("metric", "s").agg((F.sum(F.col("times") * (F.col("a") - F.col("b"))) / F.sum("times")).alias("d"))
    per = per.withColumn("d", F.round("d", 9))
    point = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("a"), 9).alias("a"), F.round(F.avg("b"), 9).alias("b"), F.round(F.avg(F.col("a") - F.col("b")), 9).alias("diff"))
    ranked = per.withColumns({"r": F.row_number().over(W.partitionBy("metric").orderBy("d")) - 1, "m": F.count("*").over(W.partitionBy("metric"))})
    lo = F.greatest(F.lit(0), F.floor(F.lit(alpha / 2) * F.col("m")).cast("long") - 1)
    hi = F.least(F.col("m") - 1, F.floor(F.lit(1 - alpha / 2) * F.col("m")).cast("long"))
    j = ranked.join(F.broadcast(point.select("metric", "diff")), "metric")  # a row a metric
    flipped = F.when(F.col("diff") > 0, F.col("d") <= 0).when(F.col("diff") < 0, F.col("d") >= 0).otherwise(F.lit(True))
    ci = j.groupBy("metric").agg(F.max(F.when(F.col("r") == lo, F.col("d"))).alias("ci_low"), F.max(F.when(F.col("r") == hi, F.col("d"))).alias("ci_high"), (F.count_if(flipped).cast("double") / F.count("*")).alias("frac_sign_flipped"))
    return point.join(ci, "metric").withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def step_curves(scalars: DataFrame, window: int, mean: tuple[str, ...], most: tuple[str, ...], last: tuple[str, ...]) -> DataFrame:
    """(run, tag, step, value) to run, w, tag, kind, value: tumbling windows of steps with the mean, the maximum or the last value of a tag."""
    w = F.floor(F.col("step") / window)
    g = scalars.groupBy("run", w.alias("w"), "tag").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.max_by("value", "step").alias("last"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.array(*map(F.lit, tags)).alias("tags"), F.col(k).alias("value")) for k, tags in (("mean", mean), ("most", most), ("last", last)) if tags))
    return g.select("run", "w", "tag", F.inline(F.filter(kinds, lambda x: F.array_contains(x["tags"], F.col("tag"))))).select("run", "w", "tag", "kind", F.round("value", 9).alias("value"))


def latest_only(scalars: DataFrame) -> DataFrame:
    """Rows of each run's highest version."""
    top = scalars.groupBy(F.col("run").alias("r")).agg(F.max("version").alias("v"))
    return scalars.join(top, (F.col("run") == F.col("r")) & (F.col("version") == F.col("v"))).drop("r", "v")


def merged_legs(legs: DataFrame) -> DataFrame:
    """(run, s, n, gb) to run, s_per_step weighted by n, peak, legs."""
    return legs.groupBy("run").agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 9).alias("s_per_step"), F.max("gb").alias("peak_gb"), F.count("*").alias("legs"))


def arm_means(rows: DataFrame, seeds: int = 2) -> DataFrame:
    """(arm, seed, metric, value) to arm, metric, mean, sd: only where every seed has a value, and there are `seeds` of them."""
    total = rows.groupBy("arm").agg(F.countDistinct("seed").alias("all"))
    per = rows.filter("value is not null").groupBy("arm", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_samp("value"), 9).alias("sd"))
    return per.join(total, "arm").filter((F.col("n") == seeds) & (F.col("all") == seeds)).select("arm", "metric", "mean", "sd")


def selection_rule(means: DataFrame, bar: float, base: str, primary: str, guards: tuple[str, ...]) -> DataFrame:
    """arm, gain, verdict against the base arm: adopt if the primary metric is lower by more than the bar and no guard falls by more than it."""
    need = [primary, *guards]
    wide = means.groupBy("arm").pivot("metric", need).agg(F.first("mean"))
    b = F.broadcast(wide.filter(F.col("arm") == base).select(*[F.col(c).alias(f"base_{c}") for c in need]))  # one row
    rows = wide.filter(F.col("arm") != base).crossJoin(b)
    gain = F.round(F.col(f"base_{primary}") - F.col(primary), 9)
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in need]) == 1
    loses = F.greatest(*[(F.col(f"base_{g}") - F.col(g) > bar).cast("int") for g in guards]) == 1
    verdict = F.when(missing, "incomplete").when((gain > bar) & ~loses, "adopt").when(gain > bar, "wins but loses recall").otherwise("does not beat the base")
    return rows.select("arm", gain.alias("gain"), verdict.alias("verdict"))


def log_slope(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope over (log x, log y)."""
    return df.groupBy(*by).agg(F.round(F.regr_slope(F.log(y), F.log(x)), 9).alias("slope"))


def perplexities(rows: DataFrame, by: list[str]) -> DataFrame:
    """(ce, tokens, late) to overall and late perplexity: exp of summed cross entropy over summed tokens."""
    late = F.col("late")
    return rows.groupBy(*by).agg(F.round(F.exp(F.sum("ce") / F.sum("tokens")), 9).alias("ppl"), F.round(F.exp(F.sum(F.when(late, F.col("ce"))) / F.sum(F.when(late, F.col("tokens")))), 9).alias("late_ppl"))


def quota_capped(rows: DataFrame, quota: DataFrame, order: str = "ord") -> DataFrame:
    """The first rows of each kind up to its quota; a kind without one has none."""
    place = F.row_number().over(W.partitionBy("kind").orderBy(order))
    return rows.withColumn("place", place).join(quota, "kind").filter(F.col("place") <= F.col("quota")).drop("place", "quota")


def whole_group_sample(rows: DataFrame, cap: int) -> DataFrame:
    """(type, grp, ...): whole groups in hash order while they fit the cap of their type; one that does not fit is skipped, later ones may.

    Of the groups of one size no more than the first cap // size can be kept,
    as room only shrinks, so the fold runs over those: about cap * log(cap).
    """
    sizes = rows.groupBy("type", "grp").agg(F.count("*").alias("n")).filter(F.col("n") <= cap).withColumn("h", tx.sha256(F.concat(F.lit("sample:"), F.col("grp"))))
    nth = F.row_number().over(W.partitionBy("type", "n").orderBy("h", "grp"))
    able = sizes.withColumn("nth", nth).filter((F.col("nth") <= cap) & (F.col("nth") <= F.floor(F.lit(cap) / F.col("n"))))
    lists = able.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("h", "grp", "n"))).alias("g"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["n"] <= cap
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["grp"]))).otherwise(acc["kept"]).alias("kept"))

    kept = lists.select("type", F.explode(F.aggregate("g", start, step)["kept"]).alias("grp"))
    return rows.join(kept, ["type", "grp"], "left_semi")
