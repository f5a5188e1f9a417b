"""The prefix trie of conversations against a plain trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from grainwise.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns of each conversation as (role, text); exact ties are left to the caller to avoid."""
    found = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {path: [] for path in members}
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        leaves = saved = 0
        stack = [path]
        while stack:
            p = stack.pop()
            leaves += not children[p]
            saved += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
            stack += children[p]
        return leaves, saved

    rows = set()
    for path, of in members.items():
        leaves, saved = below(path)
        ends = sorted(c for c in of if len(convs[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        rows.add((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(children[path]), leaves, saved, digest))
    return rows


def some_conversations(seed, convs, longest, words=("a", "bb", "é🙂", "")):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, None if t == 0 else t, rng.choice(["user", None, ""]), rng.choice([*words, None])))
    return rows


def found(df):
    return {tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as a", "2 as n_convs", "3 as block")


@pytest.mark.parametrize("width", [2, 8])
def test_rebuilt_trie_equals_a_plain_one(spark, monkeypatch, width):
    monkeypatch.setattr(trie, "WIDTH", width)
    monkeypatch.setattr(trie, "SPAN", 3)
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = some_conversations(1, [*range(0, 40), *range(-130, -90), *range(205, 260), 901], 14)
    # A conversation far longer than the others, two that equal it for long, and exact copies.
    long = [(t, "user", f"{t % 7}") for t in range(60)]
    for c in (300, 302, 377):
        rows += [(c, *turn) for turn in long[: 60 - c % 5]]
    rows += [(c, *turn) for c in range(1000, 1030) for turn in long[:9]]
    rows += [(None, 1, "user", "no conversation")]
    df = trie.rebuilt_trie(table(spark, rows))
    assert found(df) == plain_trie(rebuilt(ordered(rows)))
    assert df.count() == len(plain_trie(rebuilt(ordered(rows))))


def test_plain_trie_with_texts(spark):
    rows = some_conversations(2, range(50), 5)
    nodes = trie.conversation_trie(table(spark, rows))
    convs = ordered(rows)
    assert found(nodes) == plain_trie(convs)
    for r in nodes.collect():
        said = convs[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None)
        assert (r["role"], r["text"]) == said


def test_repeated_rows_are_turns_of_their_own_and_ties_have_an_order(spark):
    rows = [(1, 1, "user", "x"), (1, 1, "user", "x"), (2, 1, "user", "x"), (2, 1, "user", "x"), (3, 5, "b", "y"), (3, 5, "a", "z")]
    nodes = trie.conversation_trie(table(spark, rows))
    assert found(nodes) == plain_trie(ordered(rows))
    assert sorted((r["depth"], r["role"]) for r in nodes.filter("conv_id = 3").collect()) == [(1, "a"), (2, "b")]


def test_turnless_and_no_conversations(spark):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(101, 160)}
    rows = [(c, 1, "user", "gone") for c in h]
    nodes = found(trie.rebuilt_trie(table(spark, rows)))
    assert nodes == plain_trie(rebuilt(ordered(rows)))
    assert any(depth == 0 and n == len(h) for _, depth, _, n, *_ in nodes)
    assert trie.rebuilt_trie(table(spark, rows).limit(0)).collect() == []
    only = [(c, 1, "user", "gone") for c in h if h[c]]
    assert found(trie.rebuilt_trie(table(spark, only))) == plain_trie(rebuilt(ordered(only)))


def test_turns_are_numbered_across_parts(spark):
    """One conversation that fills several sorted parts, with a number of turns in none of them."""
    rows = spark.range(5000).selectExpr("if(id < 4000, 7L, id) as conv_id", "5000 - id as turn", "'user' as role", "cast(id as string) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = trie.numbered_turns(rows).filter("conv_id = 7")
        assert sorted(r["depth"] for r in turns.collect()) == list(range(1, 4001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_in_levels(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(trie, "SPAN", 4)
    rows = spark.range(300).selectExpr("id % 2 as k", "id div 2 as i", "id * 7919 as v", "id as w")
    for total, plain in ((F.sum, sum), (F.bit_xor, lambda values: __import__("functools").reduce(lambda x, y: x ^ y, values, 0))):
        got = trie.running(rows, "k", "i", ["v", "w"], total, 149).collect()
        assert len(got) == 300
        for r in got:
            before = [(2 * i + r["k"]) for i in range(r["i"])]
            assert r["before_v"] == plain([n * 7919 for n in before]) and r["before_w"] == plain(before)


def test_long_lists_of_ends_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED_IDS", 10)
    rows = [(c, 1, "user", "same") for c in range(3, 700, 3)]
    assert found(trie.conversation_trie(table(spark, rows))) == plain_trie(ordered(rows))
