"""The window network against a plain forward pass, numeric gradients and counts alone; scores don't depend on partitions."""

import math
from collections import Counter

import numpy as np

from pathloom.llm import lm_scoring


def small():
    shape = lm_scoring.Shape([(1, 20_000), (3, 200), (50, 9), (400, 2)])
    shape.levels = 2
    rng = np.random.default_rng(4)
    used = rng.choice(lm_scoring.CLASSES * 256, 3000, replace=False)
    shape.weigh(used, rng.integers(1, 50, 3000))
    values = rng.normal(0, 0.2, len(lm_scoring.Network(shape).values))
    net = lm_scoring.Network(shape, values)
    leaf = rng.choice(used, 7)
    around = rng.integers(0, 1 + lm_scoring.CLASSES * shape.rows, (7, 4))
    return shape, net, around, leaf // 256, leaf % 256


def plain_log(net, shape, around, gold, code):
    """One token, by sums over plain numbers: tilted masses, level by level."""
    hidden = [math.tanh(net.shift[u] + sum(net.rows[j][r][u] for j, r in enumerate(around))) for u in range(lm_scoring.HIDDEN)]
    tilt = [math.exp(net.bias[k] + sum(h * net.out[u][k] for u, h in enumerate(hidden))) for k in range(net.out.shape[1])]
    classes = np.exp(shape.base[0][0].astype(float))
    groups, leaves = (np.exp(shape.base[k].astype(float)) for k in (1, 2))
    top = lm_scoring.CLASSES
    a, b = divmod(int(code), 16)
    p = [m * t for m, t in zip(classes, tilt, strict=False)]
    q = [m * t for m, t in zip(groups[gold], tilt[top : top + 16], strict=True)]
    r = [m * t for m, t in zip(leaves[gold * 16 + a], tilt[top + 16 :], strict=True)]
    return math.log(p[gold] / sum(p)) + math.log(q[a] / sum(q)) + math.log(r[b] / sum(r))


def test_forward_pass():
    shape, net, around, gold, code = small()
    want = [plain_log(net, shape, a, g, b) for a, g, b in zip(around, gold, code, strict=True)]
    assert np.allclose(net.logs(around, gold, code), want, atol=1e-3)


def test_probabilities_sum_to_one():
    shape, net, around, _, _ = small()
    leaf = np.flatnonzero(np.isfinite(shape.base[2].ravel()))
    total = np.exp(net.logs(np.repeat(around[:1], len(leaf), 0), leaf // 256, leaf % 256)).sum()
    assert abs(total - 1) < 1e-3


def test_gradient_is_the_slope_of_the_loss():
    shape, net, around, gold, code = small()
    loss = lambda v: -lm_scoring.Network(shape, v).logs(around, gold, code).astype(np.float64).mean()
    g = net.gradient(around, gold, code)
    rng = np.random.default_rng(5)
    for i in np.concatenate([rng.choice(np.flatnonzero(g), 40), np.arange(len(g) - 20, len(g))]):
        up, down = net.values.astype(np.float64), net.values.astype(np.float64)
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[i]) < 2e-3


def corpus(spark):
    rng = np.random.default_rng(6)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    texts = [" ".join(w for _ in range(40) for w in ("the", rng.choice(nouns), rng.choice(verbs), "a", rng.choice(nouns), ".")) for _ in range(60)]
    rows = [*enumerate(texts), (900, None), (901, ""), (None, "the noun1"), (5, texts[5])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_scores_depend_on_the_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 4_000)
    docs = corpus(spark)
    got = [sorted(map(tuple, lm_scoring.pseudo_likelihood(d).collect()), key=str) for d in (docs.coalesce(1), docs.repartition(5), docs.repartition(13, "text"))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 64


def test_context_beats_counts(spark):
    docs = corpus(spark).where("doc_id < 900")
    tokens = Counter(w for r in docs.collect() for w in r.text.split())
    n = sum(tokens.values())
    counts = sum(c * math.log(c / n) for c in tokens.values()) / n
    scored = lm_scoring.pseudo_likelihood(docs, rounds=30).agg({"log_likelihood": "sum", "n_tokens": "sum"}).first()
    assert scored["sum(log_likelihood)"] / scored["sum(n_tokens)"] > counts + 0.3


def test_an_order_never_seen_scores_lower(spark):
    """Words of the same counts in an order that the corpus doesn't have."""
    docs = corpus(spark)
    good, bad = "the noun1 verb2 a noun3 . the noun4 verb5 a noun6 .", "verb2 the a noun1 noun3 . . noun4 a the noun6 verb5"
    both = docs.unionByName(spark.createDataFrame([(1000, good), (1001, bad)], "doc_id long, text string"))
    got = {r.doc_id: r.per_token for r in lm_scoring.pseudo_likelihood(both, rounds=30).collect()}
    assert got[1000] > got[1001] + 0.5
