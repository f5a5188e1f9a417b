"""Byte-level BPE, unigram counts and packing against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex

from grainwise.llm import bpe, packing, pretokens, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
ALPHABETS = ("abcdefghij", " \n\t", "the in er on ", "aA1 .,!'", "éèüßñ漢字🙂", "0123456789", "a", "=-_ ", "".join(map(chr, range(32, 127))))
TEXTS = [None, "", " ", "a", "It's  the\n\n end.", "<|endoftext|> x", "naïve — 漢字🙂🙂", "x" * 5000, " " * 3000 + "y", "\x00\x01"]


def some_texts(n, seed=1, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(1, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {token: i for i, token in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(library):
    coder, split = bpe.coder(RANKS), pretokens.Splitter(PATTERN)
    for text in [t for t in TEXTS if t] + some_texts(4000):
        ids = [i for block in bpe.text_ids(coder, split, text) for i in block]
        assert ids == library.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_single_pieces_equal_the_library(library):
    coder, rng = bpe.coder(RANKS), random.Random(4)
    for k in range(3000):
        piece = bytes(rng.choice(b"aeinrst") for _ in range(rng.randint(1, 60))) if k % 2 else b"".join(rng.choices(coder.tokens, k=4))
        assert list(coder.encode_bytes(piece)) == library._encode_single_piece(piece)


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY_ENTRIES", 5)
    coder = bpe.BytePairCoder(bpe.read_ranks(RANKS))
    for text in some_texts(100, seed=9):
        assert [i for block in bpe.text_ids(coder, pretokens.Splitter(PATTERN), text) for i in block] == library.encode_ordinary(text)


def test_a_vocabulary_with_gaps_is_refused(tmp_path):
    (tmp_path / "ranks").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="gaps"):
        bpe.read_ranks(str(tmp_path / "ranks"))


def test_long_texts_come_in_blocks(monkeypatch, library):
    text = " ".join(some_texts(300, seed=5))
    monkeypatch.setattr(pretokens, "WHOLE_CHARS", 100)
    monkeypatch.setattr(pretokens, "BLOCK", 7)
    blocks = list(bpe.text_ids(bpe.coder(RANKS), pretokens.Splitter(PATTERN), text))
    assert len(blocks) > 10 and [i for b in blocks for i in b] == library.encode_ordinary(text)


def documents(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (None, "no id"), (3, "again"), (3, "again")], "doc_id long, text string")


def test_round_trip_digests(spark, library):
    docs = documents(spark, TEXTS + some_texts(50, seed=7)).selectExpr("doc_id", "text", "1 as n_tokens", "'x' as ids_sha256")
    found = bpe.round_trip(docs, RANKS, PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def expected(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    rows = [expected(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rows))
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).collect() == []


def test_ids_and_bytes_as_tables(spark, library):
    docs = documents(spark, TEXTS)
    encoded = bpe.encode_documents(docs, RANKS, PATTERN)
    of_three = sorted(r["ids"] for r in encoded.filter("doc_id = 3").collect())
    assert of_three == sorted(library.encode_ordinary(t) for t in (TEXTS[3], "again", "again"))
    decoded = {bytes(r["decoded"]).decode() for r in bpe.decode_documents(encoded, RANKS).collect()}
    assert decoded == {r["text"] or "" for r in docs.collect()}


# unigram counts


def test_unigram_counts_equal_the_library():
    from tokenizers import models

    scores = token_counts.zipf_scores(bpe.read_ranks(RANKS))
    # The library works on characters: bytes stand as Latin-1, the last piece is its unknown one.
    pieces = [(piece.decode("latin-1"), score) for piece, score in scores.items()] + [("<unk>", -100.0)]
    model = models.Unigram(pieces, len(scores), False)
    counter = token_counts.UnigramCounter(scores)
    for text in some_texts(800, seed=2):
        for pretoken in regex.findall(PATTERN, text):
            assert counter.pieces(pretoken) == len(model.tokenize(pretoken.encode().decode("latin-1"))), pretoken


def test_unigram_counts_by_all_segmentations(monkeypatch):
    scores = {b"a": -1.0, b"b": -2.0, b"ab": -2.5, b"ba": -1.5, b"aba": -4.0, b"bb": -3.9}
    monkeypatch.setattr(token_counts, "MEMORY_ENTRIES", 20)
    counter = token_counts.UnigramCounter(scores)

    def best(text):  # (negative score, pieces)
        if not text:
            return 0.0, 0
        found = []
        for piece, score in scores.items():
            if text.startswith(piece):
                rest = best(text[len(piece) :])
                found.append((rest[0] - score, rest[1] + 1))
        return min(found)

    rng = random.Random(8)
    for _ in range(300):
        word = "".join(rng.choices("ab", k=rng.randint(1, 9)))
        assert counter.pieces(word) == best(word.encode())[1]


def test_shared_prefixes_are_scored_once():
    counter = token_counts.UnigramCounter({b"a": -1.0, b"b": -1.0})
    counter.count({"abab"})
    assert counter.nodes_scored == 4
    # One node for each distinct prefix, whatever their order and number.
    counter.count({"abaa", "abba", "ab", "abbab", "b", "abab"})
    assert counter.nodes_scored == 4 + len({"a", "ab", "aba", "abaa", "abb", "abba", "abbab", "b"})
    counter.count({"abaa", "abba"})
    assert counter.nodes_scored == 12


def test_unigram_counts_of_many_pretokens_at_once():
    """All words of a set together, against each one by itself, long and short, with several bytes a character."""
    scores = token_counts.zipf_scores(bpe.read_ranks(RANKS))
    rng = random.Random(31)
    words = {w for text in some_texts(300, seed=30) for w in regex.findall(PATTERN, text)} | {"x" * 700, "漢字" * 80, "the", "there", "therein"}
    words |= {"".join(rng.choices("aeinrst", k=rng.randint(1, 30))) for _ in range(500)}
    together = token_counts.UnigramCounter(scores)
    together.count(words)
    alone = token_counts.UnigramCounter(scores)
    assert together.known == {w: alone.pieces(w) for w in words}


def test_a_byte_the_vocabulary_lacks_is_an_error():
    with pytest.raises(ValueError, match="lacks a byte"):
        token_counts.UnigramCounter({b"a": -1.0}).pieces("ab")


def test_token_counts_of_documents(spark):
    docs = documents(spark, TEXTS).selectExpr("doc_id", "text", "'y' as n_tokens")
    found = token_counts.count_tokens(docs, RANKS, PATTERN).collect()
    assert len(found) == docs.count()
    assert {(r["n_tokens"], r["n_pretokens"]) for r in found if r["doc_id"] in (0, 1)} == {(0, 0)}
    assert next(r for r in found if r["doc_id"] == 4)["n_pretokens"] == len(regex.findall(PATTERN, TEXTS[4]))
    assert token_counts.count_tokens(docs.limit(0), RANKS, PATTERN).collect() == []


# packing


def all_costs(places, kinds, width):
    """Cheapest cost by trying every predecessor."""
    penalty = (0, packing.SENTENCE_CUT, packing.INNER_CUT)
    cost = {0: 0}
    for place, kind in zip(places, kinds):
        options = []
        for start in cost:
            length = place - start
            if length <= width:
                padding = 0 if length & (length - 1) == 0 else width - length
                options.append(cost[start] + padding + penalty[kind] + packing.SEQUENCE_COST)
        cost[place] = min(options)
    return cost


def test_cuts_are_the_cheapest():
    rng = random.Random(6)
    for width in (8, 32, 64):
        for _ in range(60):
            places = sorted(rng.sample(range(1, 400), 90))
            places = [p for p in places if p <= width or any(0 < p - q <= width for q in places)]
            if places[0] > width or any(b - a > width for a, b in zip(places, places[1:])):
                continue
            kinds = [rng.randrange(3) for _ in places]
            cuts = packing.best_cuts(places, kinds, width, 1)
            penalty = (0, packing.SENTENCE_CUT, packing.INNER_CUT)
            total = 0
            for a, b in zip([0, *cuts], cuts):
                assert 0 < b - a <= width
                total += (0 if (b - a) & (b - a - 1) == 0 else width - (b - a)) + packing.SEQUENCE_COST + penalty[kinds[places.index(b)]]
            assert cuts[-1] == places[-1] and total == all_costs(places, kinds, width)[places[-1]]


def test_short_unpadded_sequences_are_found_by_default():
    for power in (1, 2, 4, 8, 16):
        # A cut inside a document, and no padding, against one at a document's end with two padded sequences.
        places = [100, 2048, 2048 + power]
        assert packing.best_cuts(places, [packing.DOCUMENT_END, packing.INSIDE, packing.DOCUMENT_END]) == places[1:]
    rng = random.Random(61)
    for _ in range(5):
        places = np.unique(np.cumsum([rng.choice([1, 2, 3, 8, 16, 40, 700, 2048]) for _ in range(120)])).tolist()
        kinds = [rng.randrange(3) for _ in places]
        total, penalty = 0, (0, packing.SENTENCE_CUT, packing.INNER_CUT)
        cuts = packing.best_cuts(places, kinds)
        for a, b in zip([0, *cuts], cuts):
            total += (0 if (b - a) & (b - a - 1) == 0 else 2048 - (b - a)) + packing.SEQUENCE_COST + penalty[kinds[places.index(b)]]
        assert total == all_costs(places, kinds, 2048)[places[-1]]


def test_all_sentence_marks_allow_a_cut(tokenizer):
    ids_of = packing.ids_of_pretokens(JSON, PATTERN)
    for text in ("你好。世界。再见", "Wait… and… go", "a …b", "「好。」他说。", "x」。!…y", "é.é!é?é\né…é。", "🙂。🙂…🙂.)"):
        ids, ends = ids_of(text)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        # The bytes before every offset, by the vocabulary's spelling of bytes.
        byte_of = {c: byte for byte, c in packing._byte_alphabet().items()}
        spelled = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in ids.tolist()]
        before = [b"".join(spelled[: k + 1]) for k in range(len(ids))]
        marks = tuple(mark.encode() for mark in ".!?\n…。")
        assert ends.tolist() == [k + 1 for k, done in enumerate(before) if done.endswith(marks)]
        stops = {len(m.group().encode()) + len(text[: m.start()].encode()) for m in regex.finditer(PATTERN, text) if m.group()[-1] in ".!?\n…。"}
        assert stops <= {len(before[k - 1]) for k in ends.tolist()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(JSON)
    found.encode_special_tokens = True
    return found


def test_pieces_cover_every_token_once(spark, tokenizer, monkeypatch):
    rng = random.Random(12)
    sentence = lambda: " ".join(rng.choices(["the", "of", "onen", "ation", "é", "12"], k=rng.randint(3, 30))) + rng.choice([".", "!", "?\n", "\n"])
    texts = TEXTS + [" ".join(sentence() for _ in range(rng.choice([1, 5, 40, 700]))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 as start", "'z' as length").coalesce(2)
    pieces = packing.pack_documents(docs, JSON, PATTERN, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[doc_id], key=lambda p: p["start"])
        assert [i for p in own for i in p["ids"]] == ids
        assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        for p in own:
            cut = np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4")
            assert p["ids_crc32"] == zlib.crc32(cut.tobytes()) and p["doc_tokens"] == len(ids) and p["length"] > 0
    padded = total = 0
    for members in by_sequence.values():
        members.sort(key=lambda p: p["offset"])
        used = 0
        for p in members:
            assert p["offset"] == used
            used += p["length"]
        assert used <= packing.SEQUENCE_TOKENS
        padded += 0 if used & (used - 1) == 0 else packing.SEQUENCE_TOKENS - used
        total += used
    assert padded < 0.02 * total


def test_added_tokens_in_a_text_have_their_own_id(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from grainwise.llm import queries

    unmodified = Tokenizer.from_file(JSON)
    end = "<|endoftext|>"
    texts = [t for t in TEXTS if t] + [end, end * 3, f"a  {end}  b.{end}\n\n", f"<|{end}|>", f"x{end}'s 漢{end}字。", "<|endoftext", f" {end} " * 40 + "no"]
    texts += [end.join(some_texts(3, seed=k)) for k in range(40)]
    ids_of = packing.ids_of_pretokens(JSON, PATTERN, True)
    for text in texts:
        assert ids_of(text)[0].tolist() == unmodified.encode(text, add_special_tokens=False).ids, text
    assert ids_of(f"One.{end}Two.")[1].tolist() == [2, 5]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for packed in (queries.op5_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        pieces = packed.collect()
        for doc_id, text in rows:
            ids = np.array([*unmodified.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
            own = [p for p in pieces if p["doc_id"] == doc_id]
            assert sum(p["length"] for p in own) == len(ids)
            for p in own:
                assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())


def test_packing_of_repeated_rows_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string").coalesce(1)
    assert [(p["doc_id"], p["start"], p["offset"], p["sequence_id"]) for p in packing.pack_documents(docs, JSON, PATTERN).collect()] == [(1, 0, 0, 0), (1, 0, 3, 0)]
    assert packing.pack_documents(docs.limit(0), JSON, PATTERN).collect() == []


def test_blocks_are_bounded(spark, monkeypatch):
    found = packing.ids_of_pretokens(JSON, PATTERN)
    ids, ends = found("One. Two.\nThree")
    assert ends.tolist() == [2, 4, 5] and len(ids) == 6
    places, kinds = packing.cut_places(np.array([6, 0, 700]), [ends, np.array([], int), np.array([], int)])
    assert places.tolist() == [2, 4, 5, 6, 262, 518, 706] and kinds.tolist() == [1, 1, 1, 0, 2, 2, 0]


def test_the_fast_matcher_means_the_same():
    import regex as properties

    usual = [chr(c) for c in range(0x300) if not pretokens.UNUSUAL.search(chr(c))]
    assert "\x1c" not in usual and "²" not in usual and "é" in usual
    for c in usual:
        for text in (c, f" {c}", f"a{c}1", f"'{c}", f"{c}  {c}", f"'s{c}"):
            assert pretokens.USUAL.findall(text) == properties.findall(PATTERN, text), repr(text)
    assert PATTERN == pretokens.BYTE_LEVEL
    for text in some_texts(2000, seed=21):
        assert pretokens.Splitter(PATTERN).blocks(text).__next__() == properties.findall(PATTERN, text)
