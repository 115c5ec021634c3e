"""Operator 3's hashing of whole runs of texts against plain sets, and its two ways to pick out texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathloom.llm import minmax_dedup

TEXTS = [b"", None, b" \n\t", b"One", b"one TWO", b"a b a b a", "Été été naïve\x0bx\x1cy".encode(), b"w" * 40 + b" " + b"w" * 41 + b" " + b"W" * 40, b"x" * 32 + b" " + b"x" * 33, b"u v " * 40_000 + b"t" * 300_000 + b" end", b"last one"]


def plain(text, k):
    w = (text or b"").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_shingles_of_runs():
    for k in (1, 2, 5):
        found = minmax_dedup.shingles(TEXTS * 2, k)
        assert [len(x) for x in found] == [len(plain(t, k)) for t in TEXTS * 2]
        for a, x in zip(TEXTS, found, strict=False):
            for b, y in zip(TEXTS, found, strict=False):
                assert len(np.intersect1d(x, y)) == len(plain(a, k) & plain(b, k))


def test_signature_and_sketch():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    a, b = minmax_dedup.FACTORS.astype(np.uint32), (minmax_dedup.ADDENDS >> np.uint64(31)).astype(np.uint32)
    every = (x >> np.uint64(32)).astype(np.uint32)[:, None] * a + b
    assert (minmax_dedup.signature(x) == minmax_dedup.mixed(np.concatenate([every.min(0), every.max(0)]).astype(np.uint64))).all()
    # of sets with a similarity of 0.8 about a tenth of the bits differ
    y = np.concatenate([x[: 3000 * 8 // 9], rng.integers(0, 2**64, 3000 // 9, dtype=np.uint64)])
    deep = [minmax_dedup.sketch(minmax_dedup.signature(s, minmax_dedup.DEEP_FACTORS, minmax_dedup.DEEP_ADDENDS)).view(np.uint64) for s in (x, y)]
    assert 330 < np.bitwise_count(deep[0] ^ deep[1]).sum() <= minmax_dedup.may_differ(2 * minmax_dedup.DEEP, 80, 5.2)


def test_texts_are_picked_out_where_they_are(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    plans, write = [], minmax_dedup.written

    def kept(df, what, *by):
        if what == "sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, what, *by)

    monkeypatch.setattr(minmax_dedup, "written", kept)
    both = []
    for few in (minmax_dedup.FEW, 0):
        monkeypatch.setattr(minmax_dedup, "FEW", few)
        both.append(sorted(map(tuple, minmax_dedup.near_duplicates(docs, k=2).select("doc_id", F.col("component_id")).collect())))
    assert both[0] == both[1] and any(a != b for a, b in both[0])
    half = len(plans) // 2
    assert all("BroadcastHashJoin" in p for p in plans[:half]) and all("ShuffledHashJoin" in p for p in plans[half:])


def near_copies(n):
    """Two families of n texts around the bound: texts of one family lack words of a common text and have words of their own."""
    rng = np.random.default_rng(7)
    out = []
    for family in "uv":
        base = [f"{family}{i}" for i in range(120)]
        for k in range(n):
            words = list(base)
            for at in rng.choice(120, rng.integers(3, 9), replace=False):
                words[at] = f"{family}{k}x{at}"
            out.append(" ".join(words))
    return out


def components_of(texts, k=2):
    """The smallest index that each text reaches over links of all pairs."""
    sets, label = [plain(t.encode(), k) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def test_tiles_find_what_all_pairs_find(monkeypatch):
    texts = near_copies(100)
    sets = minmax_dedup.shingles([t.encode() for t in texts], 2)
    values = np.stack([minmax_dedup.signature(x) for x in sets])
    bits, own = minmax_dedup.sketch(values), np.arange(len(texts)) % 2
    # all in one bucket, which is each one's first
    bands = np.tile(np.arange(minmax_dedup.BANDS), (len(texts), 1))
    for long in (1024, 118):
        monkeypatch.setattr(minmax_dedup, "LONG", long)
        deep = [minmax_dedup.sketch(minmax_dedup.signature(x, minmax_dedup.DEEP_FACTORS, minmax_dedup.DEEP_ADDENDS)).tolist() if len(x) > long else None for x in sets]
        label = list(range(len(texts)))
        for i, j in ((0, 0), (0, 1), (1, 1)):
            at = np.flatnonzero((own == i) | (own == j))
            tile = {"node": at, "label": at, "n": np.array([len(sets[x]) for x in at]), "own": own[at], "bits0": bits[at, 0], "bits1": bits[at, 1], "band": np.zeros(len(at), np.int64)}
            tile = {c: pa.array(x) for c, x in tile.items()} | {"i": pa.array([i] * len(at)), "j": pa.array([j] * len(at)), "bands": pa.array(bands[at].tolist())}
            tile |= {"members": pa.array([sets[x].tobytes() for x in at]), "deep": pa.array([deep[x] for x in at], pa.list_(pa.int64()))}
            links = minmax_dedup.linked(tile, 80)
            # no more of them than connect what they connect
            assert len(links) < len(at) and set(links.ravel().tolist()) <= set(minmax_dedup.asked(tile, 80)[:, 1].tolist())
            for a, b in links.tolist():
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
        assert label == components_of(texts)
        assert 2 < len(set(label)) < len(texts)


def test_a_crowded_bucket_makes_no_rows_of_pairs(spark, monkeypatch):
    texts, rows, write = near_copies(200), {}, minmax_dedup.written

    def counted(df, what, *by):
        rows.setdefault(what, []).append(out := write(df, what, *by))
        return out

    for name, value in {"written": counted, "TILE": 40, "SET_TILE": 25, "LONG": 100}.items():
        monkeypatch.setattr(minmax_dedup, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r.component_id for r in minmax_dedup.near_duplicates(docs, k=2).orderBy("doc_id").collect()] == components_of(texts)
    # pairs are written in the two rounds of hubs alone, and in the last step links that connect, not all that there are
    assert len(rows["pairs"]) == 2
    assert 0 < rows["links"][-1].count() < len(texts) * minmax_dedup.BANDS
