"""Queries do the whole job: compared with plain versions over all rows, not with the catalogue's SQL."""

import random
import unicodedata

import numpy as np
import pytest

from corvane.operators import dedup, records
from corvane.plans import corpus, evaluation, packing, retrieval
from corvane.plans import dedup as dedup_plans
from corvane.plans import records as record_plans

SF = "/root/testdata/sf0.001"


def test_vector_topk_asks_every_twentieth_vector(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], np.float64)
    want = {}
    for k in np.flatnonzero(ids % 20 == 0):
        score = np.round(m @ m[k], 6)
        want[int(ids[k])] = [int(x) for x in ids[np.lexsort((ids, -score))[:10]]]
    got = {}
    for r in retrieval.vector_topk_exact(spark, SF).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want and 20 in got


def test_lsh_candidates_are_all_pairs_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET_BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    texts = {}
    for k in range(40):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(400)] = f"x{rng.randrange(1000)}"
        texts[f"d{k:02d}"] = " ".join(words)
    texts |= {"alone": "one two three four five six seven", "blank": ""}
    d = spark.createDataFrame(list(texts.items()), "id string, text string")
    sig = {r["id"]: r["signature"] for r in dedup.signatures(d).filter("signature is not null").collect()}
    sets = {r["id"]: tuple(r["set"]) for r in dedup.shingle_sets(d).collect() if r["set"]}
    rep = {k: min(x for x in sets if sets[x] == s) for k, s in sets.items()}
    agree = lambda x, y: sum(p == q for p, q in zip(sig[x], sig[y])) / 128
    meet = lambda x, y: any(sig[x][k * 13 : k * 13 + 13] == sig[y][k * 13 : k * 13 + 13] for k in range(9))
    classes = sorted(set(rep.values()))
    want = sorted([(x, y, agree(x, y)) for x in classes for y in classes if x < y and meet(x, y)] + [(r, k, 1.0) for k, r in rep.items() if k != r])
    assert len(want) > 300 and len(classes) < 40
    assert sorted((r["a"], r["b"], r["estimate"]) for r in dedup.lsh_candidates(d).collect()) == want


def test_legs_ranks_and_truncated_ids_are_of_all_rows(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    legs = {}
    for r in orders.collect():
        legs.setdefault(f"r{r['o_custkey'] % 9}", []).append((float(r["o_totalprice"]), r["o_orderkey"] % 50 + 1))
    got = {r["run"]: r for r in evaluation.leg_merge(spark, SF).collect()}
    assert {k: (r["legs"], r["peak_gb"]) for k, r in got.items()} == {k: (len(v), max(x for x, _ in v)) for k, v in legs.items()}
    assert all(float(got[k]["s_per_step"]) == pytest.approx(sum(x * n for x, n in v) / sum(n for _, n in v)) for k, v in legs.items())
    spark.range(20_003).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    ranked = sorted((r["o_orderkey"], r["rank"], r["turn"]) for r in packing.rank_shards(spark, str(tmp_path)).collect())
    assert ranked == [(k, k % 8, k // 8) for k in range(800, 20_000)]
    more = SF.replace("sf0.001", "sf0.01")
    turns = spark.read.parquet(f"{more}/conversations.parquet").collect()
    for r in corpus.truncation_rates(spark, more).collect():
        want = sorted(t["conv_id"] for t in turns if t["role"] == r["role"] and t["turn"] % 3 == 0)
        assert (r["ids"] or []) == want and r["truncated"] == len(want)
    assert max(t["conv_id"] for t in turns) >= 20


def test_contamination_by_unicode_form_and_case(spark, tmp_path):
    question = "Wann haftet die Straße am Café?"
    lines = ["clean line", unicodedata.normalize("NFD", question), "WANN HAFTET DIE STRASSE AM CAFÉ", f"  {question[:-1]}. ", question, None]
    spark.createDataFrame([(k, "src1", t if t is None else f"before\n{t}\nafter") for k, t in enumerate(lines)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = spark.createDataFrame([(1, question)], "item_id long, text string")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in dedup_plans.contamination_guard(spark, str(tmp_path)).collect()) == [0, 5]
    assert dedup_plans.question_keys(spark, str(tmp_path)).collect()[0]["question_key"] == records.question_key("wann haftet die strasse am café")
    asked.filter("false").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    with pytest.raises(ValueError, match="empty"):
        dedup_plans.contamination_guard(spark, str(tmp_path))


def test_prompts_and_chunks_hold_whole_texts(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], {})[r["turn"]] = r["text"]
    want = {c: f"Frage: {t[0]}\n" + "\n".join(f"[{k + 1}] {t[k]}" for k in sorted(t)) for c, t in turns.items() if 0 in t}
    got = {r["conv_id"]: r["prompt"] for r in record_plans.judge_prompts(spark, SF).collect()}
    assert {c: p for c, p in got.items() if p is not None} == want and max(len(x) for t in turns.values() for x in t.values()) > 30
    chunks = record_plans._chunks(spark, SF)
    whole = {f"{r['source']}:{r['doc_id']}#1": r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["chunk_id"]: r["text"] for r in chunks.collect()} == whole
    late = chunks.filter("length(text) > 100").limit(1).selectExpr("ord AS id", "chunk_id", "concat(substring(text, 1, 100), '?') AS text")
    assert [r["state"] for r in records.inconsistent(late, chunks).collect()] == ["differs"]


def greedy(docs, sets, threshold=0.8):
    """Kept ids in visiting order, one document at a time, against all kept ones of its source."""
    kept = []
    for d in docs:
        s = sets[d["id"]]
        if not any(k["source"] == d["source"] and (k["text"] == d["text"] or (s and len(s & sets[k["id"]]) >= threshold * len(s | sets[k["id"]]))) for k in kept):
            kept.append(d)
    return {k["id"] for k in kept}


@pytest.mark.parametrize("at_once", [0, 50_000])
def test_survivors_of_long_chains(spark, monkeypatch, at_once):
    """Each text is near its neighbours only, so what is kept alternates along the chain, whether settled in rounds or at once."""
    monkeypatch.setattr(dedup, "SETTLED_AT_ONCE", at_once)
    rng = random.Random(3)
    words, rows = [f"w{k}" for k in range(200)], []
    for k in range(14):
        rows.append((f"s:{k:02d}", "s", " ".join(words)))
        words[rng.randrange(5 + k * 13, 10 + k * 13)] = f"x{k}"
    rows += [(f"t:{k:02d}", "t", rows[k][2]) for k in range(0, 14, 3)] + [("s:90", "s", rows[0][2]), ("s:91", "s", "")]
    d = spark.createDataFrame([(*r, True, False) for r in rows], "id string, source string, text string, commercial_safe boolean, research_only boolean")
    sets = {r["id"]: set(r["set"]) for r in dedup.shingle_sets(d).collect()}
    visited = sorted((dict(id=i, source=s, text=t) for i, s, t in rows), key=lambda x: (x["source"], x["id"]))
    gone = {r["id"] for r in dedup.survivors(d).filter("dropped").collect()}
    assert {x["id"] for x in visited} - gone == greedy(visited, sets)
    assert 2 < len(gone) < len(rows) - 4


def test_running_totals_over_ranges(spark, monkeypatch):
    from corvane.operators import stage

    monkeypatch.setattr(stage, "RANGE", 40)
    rng = random.Random(4)
    rows = [(k * k, rng.choice(["a", "b", None]), rng.randrange(9)) for k in range(300)]
    got = stage.running(spark.createDataFrame(rows, "k long, g string, n long"), stage.F.col("n"), "before", "k", by=("g",)).collect()
    want, seen = {}, {}
    for k, g, n in sorted(rows):
        want[k] = seen.get(g, 0)
        seen[g] = want[k] + n
    assert {r["k"]: r["before"] for r in got} == want
