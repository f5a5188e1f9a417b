"""Vector codes against plain k-means."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from grainwise.llm import ball_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, entries=256, rounds=4):
    """{position: (code, error)} and the codebooks of rows (vec_id, vector), by Python's whole numbers."""
    kept = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for p in range(4)] for _, v in kept]
    books = [[parts[k][p] for k in range(min(entries, len(kept)))] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for turn in range(rounds + 1):
        best = [[nearest(x[p], books[p]) for p in range(4)] for x in parts]
        if turn < rounds:
            for p in range(4):
                for k in range(len(books[p])):
                    own = [x[p] for x, b in zip(parts, best) if b[p][1] == k]
                    if own:
                        books[p][k] = [sum(column) // len(own) for column in zip(*own)]
    codes = [(i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b)) for (i, _), b in zip(kept, best)]
    listed = ",".join(str(x) for book in books for e in book for x in e)
    return codes, hashlib.sha256(listed.encode()).hexdigest()


def some_vectors(n, dimension, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dimension)] for _ in range(12)]
    return [[c + rng.gauss(0, 0.05) for c in rng.choice(centres)] for _ in range(n)]


def check(spark, rows):
    """rows: (vec_id, vector, label)"""
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "'x' as error", "2 as v", "3 as codes")
    got = ball_codes.codes_of(df).collect()
    codes, digest = plain([(i, v) for i, v, _ in rows])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted(codes)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    return got


def test_codes_equal_plain_k_means(spark):
    rows = [(3 * i % 1009, v, i % 3) for i, v in enumerate(some_vectors(600, 16, 1))]
    got = check(spark, rows)
    label_of = {i: label for i, _, label in rows}
    for r in got:
        assert r["label_error"] == sum(x["error"] for x in got if label_of[x["vec_id"]] == label_of[r["vec_id"]])


def test_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    grid = [[rng.choice([0.0, 0.5, -0.25]) for _ in range(8)] for _ in range(300)]
    rows = [(i, v, None if i % 4 else 7) for i, v in enumerate(grid)]
    rows += [(5, grid[5], None), (5, grid[5], None)]
    rows += [(400 + i, [rng.choice([0.1, 0.37, -0.2, 0.55]) for _ in range(8)], None if i % 4 else 7) for i in range(100)]
    rows += [(1000, None, 1), (1001, [0.1, None] * 4, 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 1)]
    got = check(spark, rows)
    assert len({r["label_error"] for r in got}) == 2


def test_few_vectors_and_none(spark):
    rows = [(i, v, 1) for i, v in enumerate(some_vectors(5, 4, 2))]
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert ball_codes.codes_of(df.limit(0)).collect() == []
    left = ball_codes.codes_of(df.unionByName(spark.createDataFrame([(9, [1.0] * 6, 1), (10, [], 1), (11, [1.0] * 8, 1), (None, [1.0] * 4, 1)], SCHEMA)))
    assert sorted(r["vec_id"] for r in left.collect()) == [0, 1, 2, 3, 4]


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 1e3 for x in v], 1) for i, v in enumerate(some_vectors(40, 8, 3))]
    rows += [(100 + i, [x * 2e5 for x in v], 1) for i, v in enumerate(some_vectors(20, 8, 5))]
    check(spark, rows)


@pytest.mark.parametrize("scale", [10, 1 << 24, 1 << 33])
def test_balls_find_the_nearest_entry(scale):
    rng = np.random.default_rng(7)
    entries = rng.integers(-scale, scale, (256, 4))
    entries[40] = entries[3]  # equal entries
    x = np.concatenate([rng.integers(-scale, scale, (500, 4)), entries[:60], (entries[:50] + entries[50:100]) // 2])
    book = ball_codes.Codebook(entries)

    def all_of(x, entries):
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in entries] for r in x]
        return [r.index(min(r)) for r in d], [min(r) for r in d]

    for codes in (ball_codes.first_guess(x, book), rng.integers(0, 256, len(x)), np.zeros(len(x), np.int64)):
        found, d = ball_codes.nearest(x, codes, None, book)
        assert (found.tolist(), d.tolist()) == all_of(x, entries)
    # Two entries move a little: what is known of the others is used again.
    moved = entries.copy()
    moved[7] += 2
    moved[200] -= 1
    again, d = ball_codes.nearest(x, found, d, ball_codes.Codebook(moved, book))
    assert (again.tolist(), d.tolist()) == all_of(x, moved)


def test_stable_cores_and_far_entries_are_not_compared(monkeypatch):
    entries = np.array([[0, 0], [100, 0], [1000, 0], [1010, 0]])
    book = ball_codes.Codebook(entries)
    compared = []
    whole = ball_codes.squared
    monkeypatch.setattr(ball_codes, "squared", lambda x, y: compared.append((len(x), y.tolist())) or whole(x, y))
    monkeypatch.setattr(ball_codes, "RING", 1)
    codes, _ = ball_codes.nearest(np.array([[1, 1], [2, 0], [60, 0], [1004, 0]]), np.array([0, 0, 0, 2]), None, book)
    assert codes.tolist() == [0, 0, 1, 2]
    assert compared == [(1, [[0, 0], [100, 0]])]
    compared.clear()
    unmoved = ball_codes.Codebook(entries, book)
    ball_codes.nearest(np.array([[60, 0]]), np.array([1]), np.array([1600]), unmoved)
    assert [c for c in compared if c[0] != 4] == []


def test_components_beyond_bigint_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e18] * 4, 1), (2, [0.0] * 4, 1)], SCHEMA)
    with pytest.raises(Exception, match="no bigint"):
        ball_codes.codes_of(df).collect()
