"""The network against a plain forward pass, numeric gradients, and cuts of long texts."""

import random

import numpy as np
import pytest

from corvane.llm import op10_quality as q


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(5)
    return q.Net(
        rng.normal(0, 0.5, (3, 256, q.FILTERS)).astype(np.float32), rng.normal(0, 0.1, q.FILTERS).astype(np.float32), rng.normal(0.4, 0.1, q.FILTERS).astype(np.float32), np.full(q.FILTERS, 0.3, np.float32),
        rng.normal(0, 0.4, (q.FILTERS + 1, q.HIDDEN)).astype(np.float32), np.zeros(q.HIDDEN, np.float32), rng.normal(0, 0.3, q.HIDDEN).astype(np.float32), np.full(1, 0.2, np.float32),
    )


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    sizes = [0, 1, 2, 3, 63, 64, 65, 200, 255, 256, 257, 258, 320, 321, 700, 1000, 4097]
    return [bytes(rng.choice(b"abc \n\xc3\xa4#") for _ in range(n)) for n in sizes]


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def plain(net, text):
    """One text, one loop a layer."""
    n = len(text)
    act = [[max(0.0, float(net.bias[f]) + sum(float(net.taps[k][text[i + k]][f]) for k in range(3) if i + k < n)) for f in range(q.FILTERS)] for i in range(n)]
    blocks = -(-n // q.BLOCK)
    top = [0.0] * q.HIDDEN
    for c in range(max(blocks - q.SPAN + 1, 1) if n else 0):
        own = act[c * q.BLOCK : c * q.BLOCK + q.SPAN * q.BLOCK]
        cover = len(own) / (q.SPAN * q.BLOCK)
        x = [(sum(a[f] for a in own) / len(own) - float(net.shift[f])) / float(net.scale[f]) * cover**0.5 for f in range(q.FILTERS)] + [cover]
        for u in range(q.HIDDEN):
            top[u] = max(top[u], sum(x[f] * float(net.hidden[f][u]) for f in range(q.FILTERS + 1)) + float(net.hidden_bias[u]))
    return 1 / (1 + np.exp(-(sum(t * float(w) for t, w in zip(top, net.out, strict=True)) + float(net.out_bias[0]))))


def test_scores_are_those_of_the_plain_pass(net, texts):
    got = q.score(net, *joined(texts))
    assert np.allclose(got, [plain(net, t) for t in texts], atol=1e-4)


@pytest.mark.parametrize("part", [64, 128, 320, 1024])
def test_parts_do_not_change_scores(net, texts, part):
    whole = q.score(net, *joined(texts))
    assert np.allclose(q.score(net, *joined(texts), part), whole, atol=1e-6)
    alone = [q.score(net, *joined([t]), part)[0] for t in texts]
    assert np.allclose(alone, whole, atol=1e-6)


def test_gradients_are_numeric_ones(net, texts):
    data, offsets = joined(texts)
    top, where, width = q.pooled(net, data, offsets)
    g = q._back(net, data, offsets, top, where, width, np.ones_like(top) * net.out)
    loss = lambda: float((q.pooled(net, data, offsets)[0].astype(float) @ net.out.astype(float)).sum())
    rng = np.random.default_rng(1)
    for name in ("hidden", "hidden_bias", "bias", "taps"):
        array, flat = getattr(net, name), g[name].ravel()
        for k in rng.choice(np.argsort(-np.abs(flat))[: max(4, len(flat) // 8)], 4, replace=False):
            old = array.ravel()[k]
            step = np.float32(2e-3)
            array.ravel()[k] = old + step
            up = loss()
            array.ravel()[k] = old - step
            down = loss()
            array.ravel()[k] = old
            assert abs((up - down) / (2 * float(step)) - flat[k]) <= 0.1 * abs(flat[k]) + 0.05


def test_sample_keeps_whole_texts_of_any_length(spark):
    docs = spark.createDataFrame([(1, "x" * 50_000, 0), (2, "", 0), (3, None, 0), (4, "y", 0), (4, None, 0)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    got = q.sample(docs, labels)
    assert sorted(map(len, got[0])) == [0, 0, 1, 50_000] and sorted(got[1].tolist()) == [0, 0, 1, 1]
    assert q.fit(*got) is not None
