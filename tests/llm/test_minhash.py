"""Shingles, signatures and near-duplicate components against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from grainwise.llm import minhash, words
from grainwise.llm.components import components

SCHEMA = "doc_id long, text string"


def result(spark, rows):
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    return found


TEXTS = ["", None, "   \n", "a b", "A  B", "one two three four five", "One two THREE four five six", "é à ü x y\x0bz", "a b c d e a b c d e"]


def test_shingle_counts():
    values, sizes = words.shingle_hashes(*words.word_hashes(pa.array(TEXTS)))
    assert sizes.tolist() == [len(brute.shingles(t)) for t in TEXTS]
    assert len(values) == sizes.sum()


def test_equal_sets_have_equal_hashes_whatever_the_surroundings():
    alone = words.shingle_hashes(*words.word_hashes(pa.array(["The Quick brown fox jumps over"])))[0]
    among = words.shingle_hashes(*words.word_hashes(pa.array(["x", "the quick  brown\nfox jumps over", "y z"])))[0]
    assert set(alone.tolist()) <= set(among.tolist())


def test_long_texts_are_taken_in_pieces(monkeypatch):
    texts = pa.array([" ".join(f"w{i % 977}" for i in range(5000)), None, "b" * 5000 + " c", "a"])
    whole = words.word_hashes(texts)
    monkeypatch.setattr(words, "PIECE_BYTES", 1000)
    pieces = words.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, pieces))


def test_estimates_follow_similarity():
    values, sizes = words.shingle_hashes(*words.word_hashes(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (400, 500)])))
    bits = minhash.packed_bits(minhash.minima(values, sizes))
    x = (bits[0] ^ bits[1]).view(np.uint64)
    groups = (x[:, None] >> np.arange(0, 64, 4, dtype=np.uint64)) & np.uint64(15)
    equal = (groups == 0).mean()
    assert abs((equal - 1 / 16) / (15 / 16) - 396 / 496) < 0.1


def mutated(rng, text, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(800)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 60, 150]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    hub = " ".join(rng.choices(vocabulary, k=120))
    # A large group around one text whose members are near the threshold of each other.
    rows += [(1000 + i, mutated(rng, hub, rng.choice([0.0, 0.01, 0.02, 0.03, 0.06]))) for i in range(150)]
    rows += [(2000 + i, mutated(rng, rng.choice(base), 0.02)) for i in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [(3000 + i, passage + " " + " ".join(rng.choices(vocabulary, k=40))) for i in range(40)]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, corpus):
    found = {r["doc_id"]: r for r in result(spark, corpus)}
    expected = brute.near_duplicates(corpus)
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert all(r["kept"] == (i == expected[i]) for i, r in found.items())
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(brute.shingles(t)) for i, t in corpus}
    assert max(list(expected.values()).count(c) for c in set(expected.values())) > 50


def test_buckets_and_pairs_in_many_blocks(spark, corpus, monkeypatch):
    """Hot buckets cut into blocks, pairs dealt to many tasks: the same components."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(minhash, "SET_BLOCK", 20)
    monkeypatch.setattr(minhash, "SET_SHINGLES", 500)
    found = {r["doc_id"]: r["component_id"] for r in result(spark, corpus)}
    assert found == brute.near_duplicates(corpus)


def test_rows_without_words_and_ids(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text), (None, text), (None, None), (7, None), (8, ""), (9, " \n"), (3, text)]
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in result(spark, rows)}
    assert found == {(5, 3, 3, False), (3, 3, 3, True), (None, 3, None, True), (None, 0, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True)}


def test_rows_that_share_an_id_join_their_groups(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    found = {r["doc_id"]: r["component_id"] for r in result(spark, [(1, a), (2, a), (2, b), (3, b), (4, "lone text")])}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def test_empty_table(spark):
    assert result(spark, []) == []


def test_clashing_columns_and_one_of_each_group(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, 9, "k"), (2, text.upper(), 8, "l"), (3, "other words here", 7, None), (3, "and more", 6, "m"), (None, text, 5, "n"), (4, None, 4, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, component_id string")
    assert minhash.near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    kept = minhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, text), (1, text), (3, "and more"), (4, "")]


def test_components_of_a_chain_a_star_and_repeated_edges(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 160)] + [(7, 3), (3, 7), (5, 5), (None, 1)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 160)}, 7: 3, 3: 3}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
