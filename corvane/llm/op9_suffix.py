"""Removal of repeated passages by a sparse suffix array.

Every SPAN-byte string has one anchor, the GRAM bytes in it with the least
hash (the leftmost on ties), so equal strings have equal anchors at equal
places. Only strings whose anchor occurs twice can repeat. The suffixes at
those anchors, and the reversed prefixes before them, are ordered by
deep-shallow sorting; common prefixes of neighbours then tell, for each string
around an anchor, which other occurrences agree with it, and all but the
first are removed.

Work is dealt twice: texts by shards of documents, anchors by buckets of
hashes. Shards and buckets exchange packed messages: a shard sends a bucket
each anchor once (twice if it repeats within the shard), and each distinct
surrounding of a repeated anchor once, so a passage in a third of all
documents costs a bucket an entry a shard and surrounding. Whole copies of an
earlier text are settled before by their SHA-256. The texts are shuffled once;
the three passes over them read the same exchange.

Defined results. A null text is empty. Documents are ordered by doc_id, a null
one first, and rows that share a doc_id by their text's SHA-256; repeated
equal rows count as copies of the first. Texts under SPAN bytes lose nothing.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common, deepshallow

SPAN, GRAM = 100, 32
#: Bytes of text in a shard, and of text whose anchors share a bucket.
SHARD, BUCKET = 4 << 20, 16 << 20
_SLICE = 1 << 18
_U = np.uint64
_POS = _U((1 << 21) - 1)
_MESSAGE = "shard long, bucket long, kind int, payload binary"
_NULL_ID = -(1 << 63)


def _slide_min(c: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    n = len(c)
    full = -(-n // w) * w
    x = np.full(full, np.iinfo(np.uint64).max, _U)
    x[:n] = c
    x = x.reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, first and last string start of every run of strings that share an anchor."""
    width = span - gram + 1
    n = len(data) - span + 1
    out: list[tuple] = []
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (_U, np.int64, np.int64, np.int64))
    for a in range(0, n, _SLICE):
        b = min(n, a + _SLICE)
        part = data[a : b + span - 1]
        h = common.prefix_hash(part)
        m = len(part) - gram + 1
        inverse = common.powers(len(h), inverse=True)
        g = common.mix((h[gram:] - h[:m]) * inverse[:m])
        least = _slide_min((g & ~_POS) | np.arange(m, dtype=_U), width)
        # strings may not cross the end of a document
        lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        change = np.zeros(b - a + 1, np.int32)
        first, last = np.maximum(offsets[lo:hi], a), np.minimum(offsets[lo + 1 : hi + 1] - span + 1, b)
        some = first < last
        np.add.at(change, first[some] - a, 1)
        np.add.at(change, last[some] - a, -1)
        valid = np.cumsum(change[:-1]) > 0
        starts = np.flatnonzero(valid)
        place = (least[starts] & _POS).astype(np.int64)
        if not len(starts):
            continue
        new = np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))
        k = np.flatnonzero(new)
        out.append((g[place[k]], place[k] + a, starts[k] + a, starts[np.append(k[1:] - 1, len(starts) - 1)] + a))
    if not out:
        return tuple(np.zeros(0, t) for t in (_U, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Shard:
    """The first copies of a shard's texts, in document order."""

    def __init__(self, texts: pa.Table, messages: pa.Table):
        wanted = set()
        self.payloads: dict[int, list[bytes]] = {}
        for kind, payload in zip(messages.column("kind").to_pylist(), messages.column("payload").to_pylist(), strict=True):
            if kind == 0:
                wanted.update(payload[i : i + 40] for i in range(0, len(payload), 40))
            else:
                self.payloads.setdefault(kind, []).append(payload)
        found: dict[tuple[int, bytes], bytes] = {}
        ids = texts.column("doc_id").to_pylist()
        for chunk_at, chunk in _chunks(texts.column("text")):
            raw, at = common.text_bytes(chunk)
            for i in range(len(chunk)):
                text = raw[at[i] : at[i + 1]]
                sha = hashlib.sha256(text).digest()
                k = ids[chunk_at + i]
                order = _NULL_ID if k is None else k
                if order.to_bytes(8, "big", signed=True) + sha in wanted:
                    found[order, sha] = text
        keys = sorted(found)
        self.ids = np.array([k for k, _ in keys], np.int64)
        self.sha = [s for _, s in keys]
        self.tie = np.array([int.from_bytes(s[:8], "big") >> 1 for s in self.sha], np.int64)
        self.data = np.concatenate([found[k] for k in keys]) if keys else np.zeros(0, np.uint8)
        self.offsets = np.cumsum([0, *(len(found[k]) for k in keys)]).astype(np.int64)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, "right") - 1

    def numbers(self, kind: int, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(self.payloads.get(kind, [])), dtype)

    def repeated(self, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The anchors that the buckets found repeated; the cut of one run at a slice's end does not matter."""
        h, place, lo, hi = anchors(self.data, self.offsets, span, gram)
        again = np.sort(self.numbers(1, "<u8"))
        if not len(again):
            return h[:0], place[:0], lo[:0], hi[:0]
        at = np.minimum(np.searchsorted(again, h), len(again) - 1)
        k = again[at] == h
        return h[k], place[k], lo[k], hi[k]


def _chunks(column):
    at = 0
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield at, c
        at += len(c)


def _dealt(shard: int, kind: int, h: np.ndarray, records: np.ndarray, buckets: int) -> list[tuple]:
    """Messages of records by the bucket of their hash."""
    bucket = (h >> _U(20)) % _U(buckets)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    ends = np.append(cuts[1:], len(b)) if len(b) else []
    return [(shard, int(b[x]), kind, records[order[x:y]].tobytes()) for x, y in zip(cuts, ends, strict=True)]


def _messages(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["shard", "bucket", "kind", "payload"])


def _entry(span: int, gram: int) -> np.dtype:
    left = span - gram
    return np.dtype([("h", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("pos", "<i8"), ("near", "u1"), ("far", "u1"), ("left", "u1", (left,)), ("right", "u1", (span,))])


def _first(span: int, gram: int) -> np.dtype:
    return np.dtype([("doc", "<i8"), ("tie", "<i8"), ("pos", "<i8"), ("far", "u1"), ("mask", "u1", (-(-(span - gram + 1) // 8),))])


@common.released
def announce(key, texts: pa.Table, messages: pa.Table, span: int, gram: int, buckets: int) -> pa.Table:
    """A shard's anchors, each once, twice if it repeats here."""
    s = Shard(texts, messages)
    h, place, _, _ = anchors(s.data, s.offsets, span, gram)
    # one occurrence may come in several runs
    order = np.lexsort((place, h))
    h, place = h[order], place[order]
    if len(h):
        keep = np.append(True, (h[1:] != h[:-1]) | (place[1:] != place[:-1]))
        h = h[keep]
        third = np.zeros(len(h), bool)
        third[2:] = h[2:] == h[:-2]
        h = h[~third]
    return _messages(_dealt(key[0].as_py(), 1, h, h.astype("<u8"), buckets))


@common.released
def pick(key, messages: pa.Table) -> pa.Table:
    """A bucket's repeated anchors, back to each shard that has them."""
    shards = np.array(messages.column("shard").to_pylist(), np.int64)
    parts = [np.frombuffer(p, "<u8") for p in messages.column("payload").to_pylist()]
    h = np.sort(np.concatenate(parts))
    again = np.unique(h[1:][h[1:] == h[:-1]])
    rows = []
    for shard, part in zip(shards.tolist(), parts, strict=True):
        own = np.intersect1d(part, again)
        if len(own):
            rows.append((shard, key[0].as_py(), 1, own.astype("<u8").tobytes()))
    return _messages(rows)


@common.released
def surroundings(key, texts: pa.Table, messages: pa.Table, span: int, gram: int, buckets: int) -> pa.Table:
    """For each repeated anchor, the distinct surroundings here with the first place of each."""
    s = Shard(texts, messages)
    h, place, lo, hi = s.repeated(span, gram)
    if not len(h):
        return _messages([])
    take = _distinct(s, h, place, lo, hi, span)
    h, place, lo, hi = h[take], place[take], lo[take], hi[take]
    left = span - gram
    out = np.zeros(len(h), _entry(span, gram))
    doc = s.doc_of(place)
    out["h"], out["doc"], out["tie"], out["pos"] = h, s.ids[doc], s.tie[doc], place - s.offsets[doc]
    out["near"], out["far"] = place - hi, place - lo
    padded = np.concatenate([np.zeros(left, np.uint8), s.data, np.zeros(span, np.uint8)])
    for at in range(0, len(h), 4096):
        x = slice(at, at + 4096)
        p = place[x] + left
        back = np.arange(1, left + 1)
        # reversed, the byte next to the anchor first; beyond the strings at hand it is all zero
        l_bytes = padded[p[:, None] - back]
        l_bytes[back[None, :] > (place[x] - lo[x])[:, None]] = 0
        ahead = np.arange(span)
        r_bytes = padded[p[:, None] + ahead]
        r_bytes[ahead[None, :] >= (span - (place[x] - hi[x]))[:, None]] = 0
        out["left"][x], out["right"][x] = l_bytes, r_bytes
    return _messages(_dealt(key[0].as_py(), 2, h, out, buckets))


def _distinct(s: Shard, h: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> np.ndarray:
    """Indices of the first of each distinct surrounding."""
    key = np.empty(len(h), _U)
    for a in range(0, len(h), 1 << 12):
        x = slice(a, a + (1 << 12))
        base = int(lo[x].min())
        part = s.data[base : int(hi[x].max()) + span]
        ph = common.prefix_hash(part)
        key[x] = common.range_hash(ph, lo[x] - base, hi[x] + span - base)
    key = common.mix(key + (place - lo).astype(_U) * _U(0x9E3779B97F4A7C15) + (hi - lo).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    order = np.lexsort((place, key, h))
    first = np.append(True, (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1]))
    return np.sort(order[first])


@common.released
def settle(key, messages: pa.Table, span: int, gram: int) -> pa.Table:
    """The places that come first with their surrounding, and which of their strings occur earlier all the same; to their shards."""
    kind = _entry(span, gram)
    parts = [np.frombuffer(p, kind) for p in messages.column("payload").to_pylist()]
    shard = np.repeat(np.array(messages.column("shard").to_pylist(), np.int64), [len(p) for p in parts])
    e = np.concatenate(parts)
    # one entry for each surrounding: the first in document order
    whole = np.ascontiguousarray(np.hstack([e["near"][:, None], e["far"][:, None], e["left"], e["right"]]))
    body = whole.view([("b", f"V{whole.shape[1]}")]).ravel()
    same = _ids(body, e["h"])
    order = np.lexsort((e["pos"], e["tie"], e["doc"], same))
    first = np.append(True, same[order][1:] != same[order][:-1])
    take = order[first]
    e, shard = e[take], shard[take]
    n = len(e)
    group = np.unique(e["h"], return_inverse=True)[1]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((e["pos"], e["tie"], e["doc"]))] = np.arange(n)
    r_order, r_lcp = deepshallow.sort(group, e["right"])
    l_order, l_lcp = deepshallow.sort(group, e["left"])
    width = span - gram + 1
    mask = np.zeros((n, -(-width // 8) * 8), np.uint8)
    alone = np.bincount(group)[group] == 1
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(width):
        served = np.flatnonzero((e["near"] <= a) & (a <= e["far"]) & ~alone)
        if not len(served):
            continue
        r_class[r_order] = np.cumsum(r_lcp < span - a)
        l_class[l_order] = np.cumsum(l_lcp < a)
        code = l_class[served] * np.int64(n + 1) + r_class[served]
        o = np.lexsort((rank[served], code))
        again = np.append(False, code[o][1:] == code[o][:-1])
        mask[served[o[again]], a] = 1
    out = np.zeros(n, _first(span, gram))
    for f in ("doc", "tie", "pos", "far"):
        out[f] = e[f]
    out["mask"] = np.packbits(mask, axis=1)[:, : out["mask"].shape[1]]
    o = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.append(True, shard[o][1:] != shard[o][:-1]))
    ends = np.append(cuts[1:], n)
    return _messages([(int(shard[o[x]]), key[0].as_py(), 2, out[o[x:y]].tobytes()) for x, y in zip(cuts, ends, strict=True)])


def _ids(body: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each distinct (h, body)."""
    seen: dict = {}
    return np.fromiter((seen.setdefault((a, b.tobytes()), len(seen)) for a, b in zip(h.tolist(), body, strict=True)), np.int64, len(h))


def removed(s: Shard, span: int, gram: int) -> np.ndarray:
    """For each byte of the shard whether it goes."""
    _, place, lo, hi = s.repeated(span, gram)
    change = np.zeros(len(s.data) + 1, np.int32)
    first = s.numbers(2, _first(span, gram))
    width = span - gram + 1
    # a run of strings is named by its anchor's place and its reach to the left
    run = place * (width + 1) + (place - lo)
    at = np.zeros(0, np.int64)
    if len(first):
        where = {k: i for i, k in enumerate(zip(s.ids.tolist(), s.tie.tolist(), strict=True))}
        doc = np.array([where[k] for k in zip(first["doc"].tolist(), first["tie"].tolist(), strict=True)], np.int64)
        at = (s.offsets[doc] + first["pos"]) * (width + 1) + first["far"]
        order = np.argsort(at, kind="stable")
        at, first = at[order], first[order]
    named = np.isin(run, at)
    np.add.at(change, lo[~named], 1)
    np.add.at(change, hi[~named] + span, -1)
    if named.any():
        mine = np.unpackbits(first["mask"], axis=1)[np.searchsorted(at, run[named]), :width]
        row, col = np.nonzero(mine)
        starts = place[named][row] - col
        np.add.at(change, starts, 1)
        np.add.at(change, starts + span, -1)
    return np.cumsum(change[:-1]) > 0


@common.released
def cleaned(key, texts: pa.Table, messages: pa.Table, span: int, gram: int) -> pa.Table:
    """The shard's results."""
    s = Shard(texts, messages)
    gone = removed(s, span, gram)
    rows: list[list] = [[], [], [], [], []]
    for i in range(len(s.ids)):
        a, b = s.offsets[i], s.offsets[i + 1]
        g = gone[a:b]
        kept = s.data[a:b][~g] if g.any() else s.data[a:b]
        values = (None if s.ids[i] == _NULL_ID else int(s.ids[i]), int(b - a), int(g.sum()), int(g[0]) + int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept.tobytes()).hexdigest())
        for c, v in zip(rows, values, strict=True):
            c.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


@common.released
def cleaned_rows(key, texts: pa.Table, messages: pa.Table, span: int, gram: int, columns: list[str]) -> pa.Table:
    """The shard's rows with all their columns: a first copy with what is left of its text, other copies with none."""
    s = Shard(texts, messages)
    gone = removed(s, span, gram)
    where = {k: i for i, k in enumerate(zip(s.ids.tolist(), s.sha, strict=True))}
    out: list[str] = []
    ids = texts.column("doc_id").to_pylist()
    for at, chunk in _chunks(texts.column("text")):
        raw, ends = common.text_bytes(chunk)
        for i in range(len(chunk)):
            k = where.pop((_NULL_ID if ids[at + i] is None else ids[at + i], hashlib.sha256(raw[ends[i] : ends[i + 1]]).digest()), None)
            out.append("" if k is None else s.data[s.offsets[k] : s.offsets[k + 1]][~gone[s.offsets[k] : s.offsets[k + 1]]].tobytes().decode("utf-8", "ignore"))
    made = {"text": pa.array(out, pa.string())}
    if "n_chars" in columns:
        made["n_chars"] = pa.array([len(t) for t in out]).cast(texts.column("x_n_chars").type)
    return pa.table([made.get(c, texts.column(f"x_{c}") if c != "text" else None) for c in columns], names=columns)


class _Plan:
    """Texts by shard and the messages that settle them; whatever reads the texts reads one exchange."""

    def __init__(self, docs: DataFrame, span: int, gram: int, carry: list[str]):
        spark = docs.sparkSession
        common.bounded_batches(spark)
        key, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
        base = docs.select(key.alias("doc_id"), text.alias("text"))
        meta = base.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
        meta = common.staged(meta.groupBy("doc_id", "sha", "n").agg(F.count("*").alias("c")), "suffix-copies")
        total = meta.agg(F.sum("n")).first()[0] or 0
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts, buckets = (max(least, -(-total // size)) for size in (SHARD, BUCKET))
        order = F.coalesce("doc_id", F.lit(_NULL_ID).cast("long"))
        # rows that share an id, or have none, are dealt by their text's hash too
        shard = lambda c, sha: F.pmod(F.xxhash64(c, sha), F.lit(parts)).cast("long")
        long = meta.filter(F.col("n") >= span)
        firsts = long.groupBy("sha").agg(F.min(order).alias("best")).select(F.col("sha").alias("b_sha"), "best")
        firsts = common.staged(firsts, "suffix-firsts")
        # a copy meets its own key (id and hash), never its group's
        ranked = long.join(firsts, (F.col("sha") == F.col("b_sha")) & (order == F.col("best")), "left").withColumn("first", F.col("best").isNotNull()).drop("b_sha", "best")
        self.ranked = ranked.unionByName(meta.filter(F.col("n") < span).withColumn("first", F.lit(False)))
        name = F.concat(F.unhex(F.lpad(F.hex("best"), 16, "0")), F.unhex("b_sha"))
        # a shard holds a bounded share of the documents, and so does its list
        firsts = firsts.groupBy(shard("best", "b_sha").alias("shard")).agg(F.collect_list(name).alias("keys")).mapInArrow(_joined, _MESSAGE)
        own = F.sha2(text.cast("binary"), 256)
        self.texts = docs.filter(F.octet_length(text) >= span).select(shard(F.coalesce(key, F.lit(_NULL_ID)), own).alias("shard"), key.alias("doc_id"), text.alias("text"), *(F.col(c).alias(f"x_{c}") for c in carry))
        told = self.cogroup(firsts, lambda k, t, m: announce(k, t, m, span, gram, buckets), _MESSAGE)
        again = told.groupBy("bucket").applyInArrow(lambda k, m: pick(k, m), _MESSAGE)
        known = firsts.unionByName(again)
        near = self.cogroup(known, lambda k, t, m: surroundings(k, t, m, span, gram, buckets), _MESSAGE)
        settled = near.groupBy("bucket").applyInArrow(lambda k, m: settle(k, m, span, gram), _MESSAGE)
        self.messages = known.unionByName(settled)

    def cogroup(self, messages: DataFrame, f, schema) -> DataFrame:
        return self.texts.groupBy("shard").cogroup(messages.groupBy("shard")).applyInArrow(f, schema)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    plan = _Plan(docs, span, gram, [])
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = plan.cogroup(plan.messages, lambda k, t, m: cleaned(k, t, m, span, gram), columns)
    # all other rows: short texts as they are, later copies without anything
    plain = plan.ranked.withColumn("times", F.col("c") - F.col("first").cast("long")).filter("times > 0")
    short = F.col("n") < span
    plain = plain.select(
        "doc_id", F.col("n").alias("n_bytes"), F.when(short, 0).otherwise(F.col("n")).cast("long").alias("n_removed"), F.when(short, 0).otherwise(1).cast("long").alias("n_spans"),
        F.when(short, F.col("sha")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"),
    ).drop("copy")
    return out.unionByName(plain)


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of docs, all columns, with repeated passages cut out of text, and n_chars, if there, counted anew.

    Bytes of characters that a removal cuts apart go with it. A null text stays
    null; a document may be left with an empty text. The texts travel once,
    with their rows.
    """
    columns = docs.columns
    plan = _Plan(docs, span, gram, [c for c in columns if c != "text"])
    long = plan.cogroup(plan.messages, lambda k, t, m: cleaned_rows(k, t, m, span, gram, columns), docs.schema)
    return long.unionByName(docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) < span))


def _joined(batches):
    for batch in batches:
        rows = [(s, 0, 0, b"".join(k)) for s, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield from _messages(rows).to_batches() if rows else ()


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES, ORACLES = {"op9_suffix": op9_suffix}, {}
