"""Best-fit packing of token sequences by minimum bin slack.

Documents become token ids with an end id; only those over the capacity are
cut. The packing is planned on the histogram of piece lengths, which has one
entry per length up to the capacity whatever the corpus size: each bin takes
the longest piece left and, by a bitset subset-sum program over the available
lengths, the combination that leaves least slack. A combination stays the
fullest as long as its lengths last, so it is taken as often as they do, and
the number of programs run depends on the capacity, not on the corpus.

Defined results. A null text is empty: it has the end id alone. Rows that
repeat a doc_id are packed separately; a null doc_id is kept. An empty table
gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import common

CAPACITY, END = 2048, 0
#: Rows that a task ranks within one length at most, about, and groups that a length is dealt to at least.
RANKED, GROUPS = 200_000, 64
_encoders: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """Text to ids, the same as tokenizers gives for this byte-level BPE file, which adds no token of its own but reads the file's added ones in a text.

    The file's vocabulary is read as merge ranks. That is valid where merges
    are numbered as their tokens, which is checked, and several times faster
    on long texts.
    """
    if path not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], {t["content"]: t for t in file.get("added_tokens", [])}
        if any(t[flag] for t in added.values() for flag in ("single_word", "lstrip", "rstrip")) or any(a != b and a in b for a in added for b in added):
            raise ValueError("added tokens that need more than a plain split")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("merges are not numbered in rank order")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
        _encoders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={content: t["id"] for content, t in added.items()})
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first one may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            row, piece, start, length, crc, raw = [], [], [], [], [], []

            def flush():
                out = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]  # noqa: B023
                made = pa.RecordBatch.from_arrays(out + ([pa.array(raw, pa.binary())] if with_ids else []), ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])  # noqa: B023
                for x in (row, piece, start, length, crc, raw):  # noqa: B023
                    x.clear()
                return made

            for i, text in enumerate(texts):
                t = text.as_py() or ""
                tokens = np.append(np.asarray(enc.encode_to_numpy(t, allowed_special="all") if len(t) else (), "<u4"), np.uint32(END)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    own = tokens[s : s + n].tobytes()
                    row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own))
                    if with_ids:
                        raw.append(own)
                if len(row) >= 2000:
                    yield flush()
            yield flush()

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian, 4 bytes each)."""
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_pieces(path or vocabulary_path(), capacity, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum that is at most room: bitset subset sums, longest first."""
    want, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted((n for n in available if n <= room), reverse=True):
        left, k = min(available[n], room // n), 1
        while left:
            k = min(k, left)
            grown = (reach | reach << (n * k)) & want
            if grown != reach:
                steps.append((n, k, reach))
                reach = grown
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            total -= n * k
            found[n] = found.get(n, 0) + k
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins take each."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        combo = fullest({n: c for n, c in rest.items() if c > 0}, capacity - first)
        combo[first] = combo.get(first, 0) + 1
        times = min(left[n] // m for n, m in combo.items())
        out.append((combo, times))
        for n, m in combo.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def slots(made: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows length, first rank, first sequence, copies in a bin, offset of the first copy; by length and rank."""
    rows, used, sequence = [], {}, 0
    for combo, times in made:
        at = 0
        for n in sorted(combo, reverse=True):
            rows.append((n, used.get(n, 0), sequence, combo[n], at))
            used[n] = used.get(n, 0) + combo[n] * times
            at += n * combo[n]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(where: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = where[:, 0] << 44 | where[:, 1]
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            w = where[np.searchsorted(keys, n << 44 | rank, "right") - 1]
            k = rank - w[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(w[:, 2] + k // w[:, 3]), pa.array(w[:, 4] + k % w[:, 3] * n)], [*columns, "sequence_id", "offset"])

    return run


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row, a piece with its length, a sequence_id and its offset there. cut_up is read more than once: pass a staged table."""
    counts = {int(r["length"]): int(r["n"]) for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = slots(plan(counts, capacity))
    groups = max(GROUPS, sum(counts.values()) // RANKED)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    rows = cut_up.withColumn("deal", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = W.partitionBy("length").orderBy("deal").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("length", "deal").agg(F.count("*").alias("n")).select(F.col("length").alias("b_length"), F.col("deal").alias("b_deal"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    rows = rows.join(sums, (F.col("length") == F.col("b_length")) & (F.col("deal") == F.col("b_deal")))
    rank = F.row_number().over(W.partitionBy("length", "deal").orderBy(*order)) - 1 + F.col("earlier")
    columns = cut_up.columns
    kinds = dict(cut_up.dtypes)
    return rows.select(*columns, rank.cast("long").alias("rank")).mapInArrow(_placed(where, columns), ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack."""
    return pack(common.staged(pieces(docs, path, capacity, with_ids), "pack-pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(common.table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op4_packing": op4_packing}, {}
