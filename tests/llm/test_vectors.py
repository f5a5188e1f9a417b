"""Top-k search and embedding near-dedup against brute force."""

from __future__ import annotations

import math

import brute
import numpy as np
import pytest

from grainwise.llm import embedding_dedup, topk

INF = float("inf")
ODD = [None, [], [None, 1.0], [math.nan, 1.0], [INF, 1.0], [0.0, 0.0], [1.0], [2.0, 1.0, 0.0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def clustered(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[: n // 4] = base[0] + 0.18 * rng.normal(size=(n // 4, dim))  # a large group near the threshold
    base[n // 2 : n // 2 + 60] = base[n // 2]  # equal vectors
    base[n - 40 :] = base[n - 80 : n - 40] + 0.15 * rng.normal(size=(40, dim))
    return base.astype(np.float32)


def expected_top(rows, k, every):
    """By the largest score, then the smaller id."""
    usable = {}
    for vec_id, v, *_ in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        scaled = [math.floor(1024 * float(np.float32(x))) for x in v]
        usable[vec_id] = min(scaled, usable.get(vec_id, scaled))
    out = set()
    for q, v in usable.items():
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in usable.items() if c != q and len(w) == len(v))
        out |= {(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("bins", [4, 1 << 14])
def test_topk_equals_brute_force(spark, monkeypatch, bins):
    for name, value in (("BINS", bins), ("CANDIDATE_BLOCK", 64), ("QUERY_BLOCK", 8), ("SCORED_AT_ONCE", 3)):
        monkeypatch.setattr(topk, name, value)
    vectors = clustered(1, n=300, dim=8)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(1000 + i, [1.0] * 8, 1) for i in range(90)]  # ties beyond k
    rows += [(2000 + 10 * i, v, 1) for i, v in enumerate(ODD)] + [(None, [1.0] * 8, 1), (10, [9.0] * 8, 1), (10, [9.0] * 8, 1)]
    df = frame(spark, rows).selectExpr("vec_id", "embedding", "1 as score", "'x' as query_id", "2 as block")
    found = topk.search(df, k=5, every=10)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in found.collect()} == expected_top(rows, 5, 10)


def test_topk_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(60, 4))
    vectors[10:20] *= 5000
    vectors[20:40] *= 1e5  # scores beyond 2**53
    vectors[40:50] = np.float32(6e5) * np.sign(vectors[40:50])  # ranges of scores beyond 2**62
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors.astype(np.float32))]
    rows += [(70, [1.0, 4e6, 0.0, 0.0], 1), (71, [3.0, 0.0, 0.0, 4e6], 1), (80, [2048.5, 0.0], 1), (81, [1e6, 1.0], 1)]
    rows += [(90, [8.0, 9e6, 0.0], 1), (91, [0.0, 0.0, 9e6], 1)]  # no product with itself fits
    want = expected_top(rows, 5, 10)
    assert max(s for *_, s in want) > 1 << 61
    assert {tuple(r) for r in topk.search(frame(spark, rows), k=5, every=10).collect()} == want
    near = 1.9 * 2**20  # scores near the largest bigint and near the smallest
    rows = [(0, [2.0**22, 0.0], 1), (1, [near, 1.0], 1), (2, [-near, 0.0], 1), (3, [near - 1, 0.0], 1)]
    assert {tuple(r) for r in topk.search(frame(spark, rows), k=2).collect()} == expected_top(rows, 2, 100)


def test_topk_of_long_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist(), 1) for i, v in enumerate((2047 - rng.random(size=(6, 9000))).astype(np.float32))]
    assert {tuple(r) for r in topk.search(frame(spark, rows), k=4).collect()} == expected_top(rows, 4, 100)


@pytest.mark.parametrize("vectors", ([[1e30, 0.0], [1.0, 1.0]], [[4e6, 4e6], [4e6, 4e6]]))
def test_topk_refuses_what_is_no_bigint(spark, vectors):
    with pytest.raises(Exception, match="is no bigint"):
        topk.search(frame(spark, [(i, v, 1) for i, v in enumerate(vectors)])).collect()


def test_topk_with_few_candidates(spark):
    rows = [(100, [1.0, 2.0], 1), (3, [1.0, 0.0], 1), (200, [1.0, 2.0, 3.0], 1)]
    assert {tuple(r) for r in topk.search(frame(spark, rows)).collect()} == {(100, 1, 3, 1024 * 1024)}
    assert topk.search(frame(spark, rows[:1])).collect() == []
    assert topk.search(frame(spark, [])).collect() == []


def test_topk_scores_are_floored(spark):
    rows = [(0, [-0.0004, 0.5], 1), (1, [0.0009, -0.0001], 1)]
    assert {tuple(r) for r in topk.search(frame(spark, rows)).collect()} == {(0, 1, 1, -1 * 0 + 512 * -1)}


def expected_links(rows, cosine=0.93):
    usable = [
        (k, vec_id, np.array(v, dtype=np.float32).astype(float), label)
        for k, (vec_id, v, label) in enumerate(rows)
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links, degree = [], [0] * len(rows)
    for n, (k, a, x, p) in enumerate(usable):
        for m, b, y, q in usable[:n]:
            if p == q and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((a, b))
                degree[k] += 1
                degree[m] += 1
    component = brute.smallest_reachable({r[0] for r in rows if r[0] is not None}, links)
    return sorted((r[0] or -1, degree[k], component.get(r[0], -1), r[0] is None or component[r[0]] == r[0]) for k, r in enumerate(rows))


def found_links(spark, rows):
    df = frame(spark, rows).selectExpr("vec_id", "embedding", "label", "'x' as way", "1 as rows", "2 as kept")
    found = embedding_dedup.near_vectors(df)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    none = lambda x: -1 if x is None else x
    return sorted((none(r[0]) or r[0] or -1, r[1], none(r[2]), r[3]) if r[0] != 0 else (-1, r[1], none(r[2]), r[3]) for r in found.collect())


def all_rows():
    rows = [(i + 1, v.tolist(), i % 3 if 100 <= i < 200 else 7) for i, v in enumerate(clustered(5))]
    rows += [(5000 + i, v, 7) for i, v in enumerate(ODD)] + [(6000, rows[0][1], None), (None, rows[0][1], 7), (2, rows[1][1], 7), (3, rows[300][1], 7)]
    return rows


@pytest.mark.parametrize("plan", ["whole", "blocks", "cells"])
def test_links_equal_brute_force(spark, monkeypatch, plan):
    if plan != "whole":
        monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    if plan == "cells":
        monkeypatch.setattr(embedding_dedup, "cell_plan", lambda n, spread, cosine: 3)
    rows = all_rows()
    assert found_links(spark, rows) == expected_links(rows)


def test_no_vectors(spark):
    assert found_links(spark, []) == []
    assert found_links(spark, [(4, None, 1)]) == [(4, 0, 4, True)]


def test_collisions_are_counted_around_each_query():
    random_ = np.random.default_rng(3)
    a, b = random_.normal(size=(30, 5)), random_.normal(size=(40, 5))
    direct = (np.abs(a[:, None, :] - b[None, :, :]) <= embedding_dedup.HALF_WINDOW).sum(axis=2)
    assert (embedding_dedup.collisions(a, b) == direct).all()


def test_the_count_is_calibrated_for_recall():
    least = embedding_dedup.least_collisions()
    p = embedding_dedup.collision_probability(embedding_dedup.COSINE)
    reached = [sum(math.comb(32, k) * p**k * (1 - p) ** (32 - k) for k in range(n, 33)) for n in (least, least + 1)]
    assert reached[0] >= embedding_dedup.RECALL > reached[1]
    random_ = np.random.default_rng(4)
    x = random_.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = random_.normal(size=x.shape)
    y -= (y * x).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    project = embedding_dedup.directions(64, embedding_dedup.PROJECTIONS, 1)
    hits = (np.abs(x @ project - y @ project) <= embedding_dedup.HALF_WINDOW).sum(axis=1)
    assert (hits >= least).mean() >= 0.995


def near_pairs(n, dimensions, random_, mean=0.0):
    """Unit vectors around a common direction, each with one at cosine 0.93 exactly."""
    x = random_.normal(size=(n, dimensions)) + mean * np.eye(dimensions)[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = random_.normal(size=x.shape)
    y -= (y * x).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    return x, 0.93 * x + math.sqrt(1 - 0.93**2) * y


@pytest.mark.parametrize("mean", [0.0, 3.0, 12.0])
def test_cells_make_near_pairs_meet(mean):
    """Wherever the vectors lie: with a common direction as without."""
    x, y = near_pairs(20_000, 64, np.random.default_rng(6), mean)
    for bins in (1, 3, 6):
        ways = embedding_dedup.ways_for(bins)
        a, b = (embedding_dedup.cells_of(v, bins, ways) for v in (x, y))
        met = a == b
        assert (met.any(axis=1)).mean() >= 0.9999
        assert abs(met.mean() - embedding_dedup.same_bin_probability() ** bins) < 0.02


def test_the_plan_is_the_least_work_at_every_size():
    plans = [embedding_dedup.cell_plan(n, 1.0) for n in (10, 30_000, 1 << 20, 1 << 24, 1 << 30)]
    assert plans[:2] == [0, 0] and plans == sorted(plans) and plans[-1] > plans[2] > 3
    # Vectors that hardly differ cannot be told apart by bins: their label stays one cell, in blocks.
    assert embedding_dedup.cell_plan(1 << 20, 0.05) == 0


def test_a_common_direction_leaves_no_hot_cell():
    x, _ = near_pairs(20_000, 64, np.random.default_rng(7), 3.0)
    cells = embedding_dedup.cells_of(x, 6, embedding_dedup.ways_for(6))
    shares = [np.unique(cells[:, way], return_counts=True)[1].max() / len(x) for way in range(cells.shape[1])]
    assert np.mean(shares) < 0.05


def test_spreads_of_labels(spark):
    random_ = np.random.default_rng(8)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(near_pairs(400, 16, random_, 2.0)[0])]
    frame_ = spark.createDataFrame(rows, "vec_id long, vector array<double>, label int").selectExpr("label", "vector", "size(vector) as dim").repartition(5)
    for r in embedding_dedup._spreads(frame_).collect():
        own = np.array([v for _, v, label in rows if label == r["label"]])
        assert r["n"] == 200 and r["spread"] == pytest.approx(math.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1).mean()))
