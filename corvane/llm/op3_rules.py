"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule; policies are versions of a bit mask over it, so
another policy or an ablation reads only the ledger, never a text. A word is
alphabetic if it holds a letter (Unicode category L).

Defined results. A null text has no words and counts 0 everywhere, and so
fails the base rules. Rows that repeat a doc_id are judged separately. An
empty table gives an empty ledger. Other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

#: The symbols that count.
SYMBOLS = common._table_of(b"#*$%&|<>")
_CONTINUES = common._table_of(range(0x80, 0xC0))
_U = np.uint64
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "longest_word")

#: Rules in bit order: a bit set means that the rule failed. Never renumber; append.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "5 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "few_alphabetic_words": "100 * n_alpha_words < 50 * n_words",
    "unbroken_run": "longest_word > 1000",
}
BASE = ("too_few_words", "repeated_windows")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "duplicate_lines", "short_words", "long_words", "few_alphabetic_words"),
    "v2": (*BASE, "many_symbols", "duplicate_lines", "short_words", "long_words", "few_alphabetic_words", "unbroken_run"),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    """The policy's bits."""
    order = list(RULES)
    return sum(1 << order.index(r) for r in POLICIES[policy])


def _repeat_counts(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs more than once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(k), bool)
    out[order] = same
    return out


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """For each key whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    out = np.empty(len(k), bool)
    out[order] = again
    return out


def _sums(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[borders[1:]] - c[borders[:-1]]


_LETTER = common._table_of([*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)])


@functools.cache
def _letters() -> np.ndarray:
    """For every code point whether its category is L."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def letters(data: np.ndarray) -> np.ndarray:
    """For every byte of UTF-8 text whether a letter begins there."""
    out = _LETTER[data]
    at = np.flatnonzero(data >= 0xC2)
    if len(at):
        seen = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        lead, low = seen[at], [seen[at + k] & 0x3F for k in (1, 2, 3)]
        point = np.where(lead < 0xE0, (lead & 0x1F) << 6 | low[0], np.where(lead < 0xF0, (lead & 0x0F) << 12 | low[0] << 6 | low[1], (lead & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]))
        out[at] = _letters()[np.minimum(point, 0x10FFFF)]
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of the documents that lie one after the other in data."""
    n = len(offsets) - 1
    start, end, per = common.word_spans(data, offsets)
    h = common.prefix_hash(data)
    n_words = np.diff(per)
    doc = np.repeat(np.arange(n), n_words)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_CONTINUES[data], out=lead[1:])
    chars = lead[end] - lead[start]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letters(data), out=before[1:])
    alpha = (before[end] - before[start]) > 0
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, chars)
    # windows of three words within one document
    w = common.range_hash(h, start, end)
    covered = np.zeros(len(w), bool)
    if len(w) >= 3:
        whole = doc[2:] == doc[:-2]
        key = common.mix(w[:-2] * _U(0x9E3779B97F4A7C15) + w[1:-1] * _U(0xC2B2AE3D27D4EB4F) + w[2:] * _U(0x165667B19E3779F9) + common.mix(doc[:-2].astype(_U)))
        at = np.flatnonzero(whole)
        at = at[_repeat_counts(key[at])]
        covered[at] = covered[at + 1] = covered[at + 2] = True
    # lines: split at \n, those with a word
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    stop = np.append(line_start[1:], len(data))
    cut = (stop > line_start) & (data[stop - 1] == 10)
    line_end = stop - cut
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    lines = common.mix(common.range_hash(h, line_start, line_end) + common.mix(line_doc.astype(_U)))
    again = _first_seen(lines)
    line_borders = np.searchsorted(line_doc, np.arange(n + 1))
    return {
        "n_words": n_words,
        "word_chars": _sums(chars, per),
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_lines": np.diff(line_borders),
        "n_dup_lines": _sums(again, line_borders),
        "n_repeat_words": _sums(covered, per),
        "n_alpha_words": _sums(alpha, per),
        "longest_word": longest,
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in common.chunks(batch.column(1)):
            found = measure(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(found[k].astype(np.int64)) for k in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failures: bit k set where rule k fails."""
    rows = docs.select("doc_id", "text")
    measured = rows.mapInArrow(_measured, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{k} long" for k in MEASURES))
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("failures", bits.cast("long"))


def judge(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    hit = lambda p: F.col("failures").bitwiseAND(F.lit(mask(p))) != 0
    return rows.withColumns({"base_failed": hit("base"), "kept": ~(hit("base") | hit(policy)), "policy": F.lit(policy)})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, failed, only_rule: documents that fail a rule, and those that the policy would keep without it.

    One pass over the ledger: each rule is tested by bit operations inside one
    aggregation, so no more than a row a rule leaves a task.
    """
    m, order = mask(policy), list(RULES)
    used = [k for k, name in enumerate(order) if m >> k & 1]
    aggs = []
    for k in used:
        aggs.append(F.count_if(F.col("failures").bitwiseAND(F.lit(1 << k)) != 0).alias(f"failed_{k}"))
        aggs.append(F.count_if(F.col("failures").bitwiseAND(F.lit(m)) == F.lit(1 << k)).alias(f"only_{k}"))
    cells = F.array(*(F.struct(F.lit(order[k]).alias("rule"), F.col(f"failed_{k}").alias("failed"), F.col(f"only_{k}").alias("only_rule")) for k in used))
    return rows.agg(*aggs).select(F.inline(cells))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(ledger(common.table(spark, sf_dir, "documents")))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """policy, kept, rule, failed, only_rule for every policy, from one ledger."""
    book = common.staged(ledger(common.table(spark, sf_dir, "documents")).select("doc_id", "failures"), "rules-ledger")
    out = []
    for policy in POLICIES:
        kept = judge(book, policy).agg(F.count_if("kept").alias("kept"))  # one row
        out.append(ablations(book, policy).crossJoin(F.broadcast(kept)).select(F.lit(policy).alias("policy"), "kept", "rule", "failed", "only_rule"))
    return functools.reduce(DataFrame.unionByName, out)


def _oracle(ablated: bool = False) -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT r, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2),
tri AS (SELECT x.r, x.i, count(*) OVER (PARTITION BY x.r, w[x.i], w[x.i + 1], w[x.i + 2]) AS c FROM wins x JOIN words USING (r)),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY r),
lines AS (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line),
dup AS (SELECT r, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup FROM lines GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, COALESCE(n_lines, 0)::BIGINT AS n_lines, COALESCE(n_dup, 0)::BIGINT AS n_dup_lines,
         COALESCE(cov.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')))::BIGINT AS n_alpha_words,
         COALESCE(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS longest_word
  FROM words LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
bits AS (SELECT *, ({bits})::BIGINT AS failures FROM m)
{_ablated() if ablated else _judged()}
"""


def _judged() -> str:
    return f"""SELECT *, (failures & {mask("base")}) <> 0 AS base_failed, (failures & {mask("base") | mask(CURRENT)}) = 0 AS kept, '{CURRENT}' AS policy FROM bits
"""


def _ablated() -> str:
    """Each policy's rules written out, over documents judged without bits."""
    parts = []
    for policy, used in POLICIES.items():
        for name in used:
            others = " OR ".join(f"({RULES[r]})" for r in used if r != name)
            parts.append(f"SELECT '{policy}' AS policy, count(*) FILTER (NOT ({others} OR ({RULES[name]}))) AS kept, '{name}' AS rule, count(*) FILTER ({RULES[name]}) AS failed, count(*) FILTER (({RULES[name]}) AND NOT ({others})) AS only_rule FROM m")
    return "\nUNION ALL ".join(parts)


QUERIES, ORACLES = {"op3_rules": op3_rules, "rule_ablations": rule_ablations}, {"op3_rules": _oracle(), "rule_ablations": _oracle(True)}
