"""Quality classifier: a byte-level convolutional network in numpy.

Every byte position gets FILTERS learned filters of three bytes. Their
rectified responses are averaged over overlapping chunks of four blocks that
cover the whole text (a step of one block), a hidden layer rates each chunk,
the ratings are max-pooled over the chunks, and a logistic unit combines them.
Texts are read in parts of PART bytes that overlap by what a chunk and a
filter see, so neither memory nor the score depends on how a text is cut.

The network is fitted on a bounded sample of labelled rows: per class at most
PER_CLASS documents (by hash of their id), whole texts of any length, empty
ones included. Only the blocks of the chunks that won the pooling take part in
the way back, a bounded number a document. Scoring covers all documents.

Defined results. A null text counts as empty and gets the empty text's score.
Labels other than 0 and 1, labels of a document that contradict each other,
and repeats are left out of the fit; without labels of both classes every
score is 0.5. Rows that repeat a doc_id are scored separately. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

PER_CLASS = 1500
FILTERS, HIDDEN, BLOCK, SPAN, TAPS = 16, 32, 64, 4, 3
#: Bytes of a part, a multiple of BLOCK.
PART = 1 << 18
EPOCHS, BATCH, RATE = 8, 64, 0.01
_F32 = np.float32


@dataclass
class Net:
    """Weights: byte tables of the three filter positions, chunk layer, output."""

    taps: np.ndarray  # 3 x 256 x FILTERS
    bias: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray  # (FILTERS + 1) x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start of each block, blocks before each document, and first and end block of each chunk's document order."""
    n = np.diff(offsets)
    blocks = -(-n // BLOCK)
    before = np.zeros(len(n) + 1, np.int64)
    np.cumsum(blocks, out=before[1:])
    doc = np.repeat(np.arange(len(n)), blocks)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - before[:-1][doc]) * BLOCK
    chunks = np.where(blocks > 0, np.maximum(blocks - SPAN + 1, 1), 0)
    c_doc = np.repeat(np.arange(len(n)), chunks)
    c_before = np.cumsum(chunks) - chunks
    first = before[:-1][c_doc] + np.arange(len(c_doc)) - c_before[c_doc]
    return start, c_doc, first, np.minimum(first + SPAN, before[1:][c_doc])


def responses(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rectified filter responses at every byte; a filter sees zero beyond the text's end."""
    x = np.take(net.taps[0], data, axis=0)
    ends = offsets[1:][np.diff(offsets) > 0]
    for k in range(1, TAPS):
        if len(data) > k:
            y = np.take(net.taps[k], data[k:], axis=0)
            for back in range(1, k + 1):
                at = ends - back
                y[at[(at >= 0) & (at < len(y))]] = 0
            x[:-k] += y
    x += net.bias
    return np.maximum(x, 0, out=x)


def chunk_means(act: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean responses of each chunk, its document, its bytes, and its first byte. A chunk's mean does not depend on what lies around it."""
    start, doc, first, end = layout(offsets)
    sums = np.add.reduceat(act, start, axis=0) if len(start) else np.zeros((0, act.shape[1]), _F32)
    sums = np.vstack([sums, np.zeros((1, act.shape[1]), _F32)])
    total = sums[first]
    for k in range(1, SPAN):
        total = total + sums[np.where(first + k < end, first + k, len(sums) - 1)]
    # a chunk ends where its document's blocks end, so the next block's start may be another document's
    size = np.minimum(np.append(start, offsets[-1])[end], offsets[1:][doc]) - start[first]
    return (total / size[:, None]).astype(_F32), doc, size, start[first]


def parts(offsets: np.ndarray, part: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """Cuts of documents that lie one after the other: first document, its texts' offsets, and bytes read past their end.

    Small documents go together; a large one is cut where chunks begin, each
    cut reading on to the end of the last chunk that begins in it, and two
    bytes further for the filters.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + part, "right")) - 1)
        at, more = int(offsets[i]), (SPAN - 1) * BLOCK
        if j == i + 1:
            while int(offsets[j]) - at > part + more + TAPS - 1:
                yield i, np.array([at, at + part + more], np.int64), TAPS - 1
                at += part
        yield i, np.concatenate([[at], offsets[i + 1 : j + 1]]).astype(np.int64), 0
        i = j


def read_chunks(net: Net, data: np.ndarray, offsets: np.ndarray, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Means, document, bytes and first byte of all chunks, a part at a time."""
    for i, at, ahead in parts(offsets, part):
        base, end = int(at[0]), int(at[-1])
        piece = data[base : end + ahead]
        own = at - base
        seen = own.copy()
        seen[-1] += ahead
        means, doc, size, first = chunk_means(responses(net, piece, seen)[: end - base], own)
        yield means, doc + i, size, first + base


def features(net: Net, means: np.ndarray, size: np.ndarray) -> np.ndarray:
    z = (means - net.shift) / net.scale
    cover = (size / (BLOCK * SPAN)).astype(_F32)[:, None]
    return np.hstack([z * np.sqrt(cover), cover])


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document and unit the largest rating over all chunks, the first byte of the first chunk that has it, and that chunk's bytes."""
    n = len(offsets) - 1
    top = np.zeros((n, net.out.shape[0]), _F32)
    where, width = np.zeros(top.shape, np.int64), np.zeros(top.shape, np.int64)
    for means, doc, size, first in read_chunks(net, data, offsets, part):
        if not len(doc):
            continue
        rated = np.maximum(features(net, means, size) @ net.hidden + net.hidden_bias, 0)
        has, at = np.unique(doc, return_index=True)
        best = np.maximum.reduceat(rated, at, axis=0)
        better = best > top[has]
        place = np.where(rated == best[np.searchsorted(has, doc)], np.arange(len(doc))[:, None], len(doc))
        place = np.minimum.reduceat(place, at, axis=0)
        place = np.minimum(place, len(doc) - 1)
        top[has] = np.where(better, best, top[has])
        where[has] = np.where(better, first[place], where[has])
        width[has] = np.where(better, size[place], width[has])
    return top, where, width


def _probability(net: Net, top: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((top @ net.out + net.out_bias).astype(float), -30, 30)))


def score(net: Net, data: np.ndarray, offsets: np.ndarray, part: int = PART) -> np.ndarray:
    """Probability of label 1 for each document."""
    return _probability(net, pooled(net, data, offsets, part)[0])


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Net | None:
    """Adam on the weighted log loss; the same result for the same rows in the same order."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.5, (3, 256, FILTERS)).astype(_F32), rng.normal(0, 0.1, FILTERS).astype(_F32), np.zeros(FILTERS, _F32), np.ones(FILTERS, _F32),
        rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS + 1, HIDDEN)).astype(_F32), np.full(HIDDEN, -0.5, _F32), np.full(HIDDEN, -0.3, _F32), np.full(1, 1.0, _F32),
    )
    net.hidden[-1] = 0
    texts = [np.frombuffer(t, np.uint8) for t in texts]

    def joined(rows):
        parts = [texts[i] for i in rows]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    # the scale of the responses, over whole chunks of some documents
    for full in (BLOCK * SPAN, 1):
        n, sums, squares = 0, np.zeros(FILTERS), np.zeros(FILTERS)
        for k in rng.permutation(len(texts))[:300]:
            for means, _, size, _ in read_chunks(net, *joined([k])):
                x = means[size >= full].astype(float)
                n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n > 50:
            break
    if n:
        net.shift = (sums / n).astype(_F32)
        net.scale = (np.sqrt(np.maximum(squares / n - (sums / n) ** 2, 0)) + 1e-3).astype(_F32)
    names = ("taps", "bias", "hidden", "hidden_bias", "out", "out_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            data, offsets = joined(rows)
            top, where, width = pooled(net, data, offsets)
            d = ((_probability(net, top) - labels[rows]) * weight[rows] / len(rows)).astype(_F32)
            g = {"out": top.T @ d, "out_bias": d.sum(keepdims=True)} | _back(net, data, offsets, top, where, width, d[:, None] * net.out)
            step += 1
            for k in names:
                grad = g[k].astype(_F32)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                new = getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, new.astype(_F32))
    return net


def _back(net: Net, data: np.ndarray, offsets: np.ndarray, top: np.ndarray, where: np.ndarray, width: np.ndarray, d_top: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the chunk layer and the filters: through the chunk that gave each document and unit its largest rating."""
    g = {k: np.zeros_like(getattr(net, k)) for k in ("hidden", "hidden_bias", "taps", "bias")}
    row, unit = np.nonzero(top > 0)
    if not len(row):
        return g
    place, chunk = np.unique(where[row, unit], return_inverse=True)
    size, end = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    size[chunk], end[chunk] = width[row, unit], offsets[1:][row]
    # the blocks of these chunks, each read once
    begin = place[:, None] + np.arange(SPAN) * BLOCK
    real = begin < (place + size)[:, None]
    blocks, of = np.unique(begin[real], return_inverse=True)
    stop = np.zeros(len(blocks), np.int64)
    stop[of] = np.broadcast_to(end[:, None], begin.shape)[real]
    see = blocks[:, None] + np.arange(BLOCK + TAPS - 1)
    inside = see < stop[:, None]
    byte = data[np.where(inside, see, 0)] if len(data) else np.zeros(see.shape, np.uint8)
    act = np.zeros((len(blocks), BLOCK, FILTERS), _F32)
    for k in range(TAPS):
        act += net.taps[k][byte[:, k : k + BLOCK]] * inside[:, k : k + BLOCK, None]
    act = np.maximum(act + net.bias, 0) * inside[:, :BLOCK, None]
    number = np.full(begin.shape, len(blocks))
    number[real] = of
    sums = np.vstack([act.sum(axis=1), np.zeros((1, FILTERS), _F32)])
    x = features(net, sums[number].sum(axis=1) / size[:, None].astype(_F32), size)
    d_rated = np.zeros((len(place), HIDDEN), _F32)
    np.add.at(d_rated, (chunk, unit), d_top[row, unit])
    g["hidden"], g["hidden_bias"] = x.T @ d_rated, d_rated.sum(axis=0)
    d_mean = (d_rated @ net.hidden[:-1].T) / net.scale * np.sqrt(size / (BLOCK * SPAN)).astype(_F32)[:, None] / size[:, None].astype(_F32)
    d_block = np.zeros((len(blocks) + 1, FILTERS), _F32)
    np.add.at(d_block, number.ravel(), np.repeat(d_mean, SPAN, axis=0))
    d_act = (d_block[:-1, None, :] * (act > 0)).reshape(-1, FILTERS)
    g["bias"] = d_act.sum(axis=0)
    for k in range(TAPS):
        keep = np.flatnonzero(inside[:, k : k + BLOCK].ravel())
        b = byte[:, k : k + BLOCK].ravel()[keep]
        by = np.argsort(b, kind="stable")
        heads = np.flatnonzero(np.append(True, b[by][1:] != b[by][:-1]))
        g["taps"][k][b[by][heads]] = np.add.reduceat(d_act[keep[by]], heads, axis=0)
    return g


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The bounded sample of labelled texts, ordered by hash."""
    one = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).filter("a = b")
    one = one.select(F.col("doc_id").alias("l_id"), F.col("a").cast("int").alias("quality"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")).alias("h"))
    picked = one.filter("quality = 0").orderBy("h").limit(PER_CLASS).unionByName(one.filter("quality = 1").orderBy("h").limit(PER_CLASS))
    # at most 2 * PER_CLASS ids
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
    got = sorted((r["h"], r["doc_id"], r["text"], r["quality"]) for r in rows.select("h", "doc_id", "text", "quality").collect())
    got = list({r[1]: r for r in got}.values())
    return [r[2].encode() for r in got], np.array([r[3] for r in got], int)


def _scored(net: Net | None):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in common.chunks(batch.column(1), 1 << 16):
                p = score(net, data, offsets) if net else np.full(j - i, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p)], ["doc_id", "score"])

    return run


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, score."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_scored(net), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def _passing(net: Net | None, at: int):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in common.chunks(batch.column(at), 1 << 16):
                ok = score(net, data, offsets) >= 0.5 if net else np.ones(j - i, bool)
                yield batch.slice(i, j - i).filter(pa.array(ok))

    return run


def passing(docs: DataFrame, net: Net | None) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    common.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_passing(net, docs.columns.index("text")), docs.schema)


def trained(docs: DataFrame, labels: DataFrame) -> Net | None:
    """The network fitted on labelled rows that are not held out."""
    return fit(*sample(docs, labels.filter(~common.held_out(F.col("doc_id"), 3, 1))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = predict(docs, trained(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES, ORACLES = {"op10_quality": op10_quality}, {}
