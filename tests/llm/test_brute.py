"""Operators against plain versions, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import deepshallow, op2_minhash, op3_rules, op4_packing, op5_language, op7_topk, op8_mix, op9_suffix, op10_quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def planted(spark):
    """Near copies in a chain, a crowd of near copies, shared passages, and plain texts."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, base, passage = [], text(120), text(60)
    for k in range(90):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((k, " ".join(t)))
    chain = text(150)
    for k in range(90, 110):
        rows.append((k, " ".join(chain)))
        for _ in range(2):
            chain[rng.randrange(len(chain))] = rng.choice(vocab)
    for k in range(110, 170):
        t = text(rng.choice([3, 8, 60, 200]))
        rows.append((k, " ".join([*t[: len(t) // 2], *passage, *t[len(t) // 2 :]]) if k % 2 else " ".join(t)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize(("name", "hot"), [("docs", 1000), ("planted", 1000), ("planted", 2)])
def test_near_duplicates(name, hot, request, monkeypatch):
    monkeypatch.setattr(op2_minhash, "HOT", hot)
    frame = request.getfixturevalue(name)
    want = brute_components(frame.select("doc_id", "text").collect())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_minhash.near_duplicates(frame).collect()}
    assert got == want


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.75, 0.9):
        for n in (12, 300, 5000):
            both = max(1, round(2 * n * j / (1 + j)))
            found = []
            for _ in range(40):
                x = np.sort(rng.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64))
                pick = rng.permutation(len(x))
                a, b = np.sort(x[pick[:n]]), np.sort(x[np.concatenate([pick[: both], pick[n:]])])
                found.append(op2_minhash.estimate(op2_minhash.sketch(a), op2_minhash.sketch(b), np.array(len(a)), np.array(len(b))))
            true = both / len(x)
            assert abs(np.mean(found) - true) < 0.05


def plain_removal(texts, span):
    seen, out = set(), {}
    for k, t in sorted(texts.items()):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - span + 1):
            w = t[s : s + span]
            if w in seen:
                gone[s : s + span] = True
            seen.add(w)
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[k] = (len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum())), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("name", ["docs", "planted"])
def test_repeated_passages(name, request):
    frame = request.getfixturevalue(name)
    want = plain_removal({r["doc_id"]: (r["text"] or "").encode() for r in frame.collect()}, 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op9_suffix.remove_repeats(frame).collect()}
    assert got == want


def test_repeats_in_small_alphabets(spark):
    rng = random.Random(9)
    texts = {k: "".join(rng.choice("ab") for _ in range(rng.choice([0, 5, 30, 200]))) + "xyxyxyxyxyxyxyxyxyxyxy" * (k % 3) for k in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_removal({k: v.encode() for k, v in texts.items()}, 14)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op9_suffix.remove_repeats(frame, 14, 5).collect()}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=30, max_size=30).map(lambda b: bytes(x % 2 for x in b[:12]) + bytes(18))), max_size=40), st.integers(0, 3))
def test_deep_shallow_order(rows, shallow):
    group = np.array([g for g, _ in rows], np.int64)
    strings = np.frombuffer(b"".join(s for _, s in rows), np.uint8).reshape(len(rows), 30)
    order, lcp = deepshallow.sort(group, strings, shallow)
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    for k in range(1, len(got)):
        (g, a), (h, b) = got[k - 1], got[k]
        n = next((i for i in range(30) if a[i] != b[i]), 30)
        assert lcp[k] == (-1 if g != h else n)


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = op4_packing.vocabulary_path()
    theirs, ours = Tokenizer.from_file(path), op4_packing.encoder(path)
    theirs.encode_special_tokens = True

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.'aäß1  <|>")), max_size=60))
    def same(text):
        assert theirs.encode(text, add_special_tokens=False).ids == list(ours.encode_ordinary(text))

    same()
    assert theirs.encode("x<|endoftext|>y", add_special_tokens=False).ids == list(ours.encode_ordinary("x<|endoftext|>y"))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_uses_every_piece_once(counts):
    made = op4_packing.plan(counts, 40)
    used = Counter()
    for combo, times in made:
        assert times > 0 and sum(n * m for n, m in combo.items()) <= 40
        for n, m in combo.items():
            used[n] += m * times
    assert used == Counter(counts)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=6), st.integers(0, 40))
def test_fullest_is_fullest(available, room):
    found = op4_packing.fullest(available, room)
    assert all(found[n] <= available[n] for n in found)
    sums = {0}
    for n, c in available.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert sum(n * m for n, m in found.items()) == max(s for s in sums if s <= room)


def test_packing_round_trip(docs):
    got = op4_packing.best_fit(docs, with_ids=True).toPandas()
    enc = op4_packing.encoder(op4_packing.vocabulary_path())
    for r in docs.limit(40).collect():
        own = got[got["doc_id"] == r["doc_id"]].sort_values("piece")
        ids = np.frombuffer(b"".join(own["ids"]), "<u4").tolist()
        assert ids == [*enc.encode_ordinary(r["text"]), 0]
        assert [zlib.crc32(x) for x in own["ids"]] == own["ids_crc32"].tolist() and (own["length"][1:] == 2048).all()
    bins = got.groupby("sequence_id")["length"].sum()
    assert bins.max() <= 2048 and len(bins) <= -(-got["length"].sum() // 2048) + 2


def test_topk_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12)) * rng.lognormal(0, 1, (900, 1))
    x[100:300] = x[100]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(64 * x).astype(np.int64)
    want = []
    for k in range(0, 900, 20):
        s = q @ q[k]
        best = sorted((j for j in range(900) if j != k), key=lambda j: (-s[j], j))[:20]
        want += [(k, i + 1, j, int(s[j])) for i, j in enumerate(best)]
    assert sorted(map(tuple, op7_topk.top_k(frame, F.col("vec_id") % 20 == 0).collect())) == sorted(want)


def test_buckets_prune_without_loss():
    rng = np.random.default_rng(4)
    p = (rng.normal(size=(3000, 8)) * 60).astype(np.int32)
    norm = np.sqrt((p.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norm)
    p, ids = p[order], np.arange(3000)[order]
    best = op7_topk.Best(np.arange(40) + 10_000, np.arange(40) + 10_000, (rng.normal(size=(40, 8)) * 60).astype(np.int32), 5)
    for at in range(0, 3000, 500):
        best.meet(ids[at : at + 500], ids[at : at + 500], p[at : at + 500])
    s = best.q.astype(np.int64) @ p.T.astype(np.int64)
    for r in range(40):
        want = sorted(range(3000), key=lambda j: (-s[r, j], ids[j]))[:5]
        assert best.found[r].tolist() == [ids[j] for j in want]


def test_languages_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from corvane.llm import common

    out = common.held_out(F.col("doc_id"), 4, 2)
    texts = op5_language.labelled_text(d.filter(~out))
    got = op5_language.predict(d.filter(out), texts).join(d.select("doc_id", "lang"), "doc_id").filter("lang is not null")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op10_quality.op10_quality(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.95
    assert (got[got["quality"] == 1]["predicted"] == 1).mean() >= 0.97


def test_mix_is_near_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op8_mix.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["size"] for r in got)


def test_rules_against_plain(docs):
    got = {r["doc_id"]: r for r in op3_rules.ledger(docs).collect()}
    for r in docs.collect():
        w = WORD.findall(r["text"])
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cov = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in r["text"].split("\n") if WORD.search(x)]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_repeat_words"], g["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cov), len(lines) - len(set(lines)))


def test_pipeline_on_whole_tables(spark):
    """Each stage against its plain version on its own input."""
    import corpus_pipeline
    from corvane.llm import common

    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = d
    for name, stage in corpus_pipeline.STAGES:
        before = got.collect()
        got = common.staged(stage(spark, got, SF), "test-stage")
        if name == "near-duplicates":
            want = brute_components(before)
            assert {r["doc_id"] for r in got.collect()} == {k for k, (_, c) in want.items() if c == k}
        if name == "repeated passages":
            want = plain_removal({r["doc_id"]: r["text"].encode() for r in before}, 100)
            for r in got.collect():
                n, gone, _, sha = want[r["doc_id"]]
                assert len(r["text"].encode()) <= n - gone and (len(r["text"].encode()) < n - gone or hashlib.sha256(r["text"].encode()).hexdigest() == sha) and r["n_chars"] == len(r["text"])
        if name != "packing":
            assert got.columns == d.columns
    assert got.filter("piece = 0").count() == len(before)


def test_multikey_rounds_take_ties_and_order():
    rng = np.random.default_rng(6)
    strings = rng.integers(0, 2, (500, 20)).astype(np.uint8)
    strings[::3] = strings[0]
    strings[1::5, :16] = 1
    group = rng.integers(0, 4, 500)
    for shallow in (0, 1, 2, 3):
        order, _ = deepshallow.sort(group, strings, shallow)
        got = [(group[k], strings[k].tobytes()) for k in order]
        assert got == sorted(got) and sorted(order.tolist()) == list(range(500))


def test_repeats_without_ids_and_under_one_id(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    texts = ["x" * k + passage + f" tail {k}" for k in range(6)]
    rows = [(None, t) for t in texts] + [(7, t[::-1]) for t in texts] + [(None, texts[0]), (7, None), (8, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(1), "bucket": F.lit(2), "payload": F.lit("p"), "kind": F.lit("k"), "sha": F.lit("s"), "n": F.lit(0)})
    got = op9_suffix.remove_repeats(frame).toPandas()
    by_sha = lambda own: sorted((t.encode() for t in own), key=lambda t: hashlib.sha256(t).hexdigest())
    ordered = [*by_sha(texts), *by_sha(t[::-1] for t in texts)]
    want = plain_removal(dict(enumerate(ordered)), 100)
    n = len(texts[0])
    rest = [(n, n, 1, hashlib.sha256(b"").hexdigest()), (0, 0, 0, hashlib.sha256(b"").hexdigest()), (5, 0, 0, hashlib.sha256(b"short").hexdigest())]
    assert sorted(map(tuple, got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].values.tolist())) == sorted([*want.values(), *rest])
    out = op9_suffix.without_repeats(frame)
    assert out.columns == frame.columns and out.count() == len(rows)

def test_token_ids_with_added_tokens(spark):
    from tokenizers import Tokenizer

    theirs, rng = Tokenizer.from_file(op4_packing.vocabulary_path()), random.Random(2)
    texts = ["x<|endoftext|>y", "<|endoftext|>", *("".join(rng.choice(["<|endoftext|>", "<|endoftext|", " ", "aß", "\n", "don't"]) for _ in range(12)) for _ in range(60))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(np.frombuffer(r["ids"], "<u4")) for r in op4_packing.pieces(d, with_ids=True).collect()}
    assert got == {k: [*theirs.encode(t, add_special_tokens=False).ids, op4_packing.END] for k, t in enumerate(texts)}
