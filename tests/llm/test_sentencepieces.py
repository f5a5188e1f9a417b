"""SentencePiece encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from grainwise.llm import sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ("abcdefghij", " \n\t", "the in er on ", "aA1 .,!'", "éèüßñ漢字🙂", "0123456789", "a", " ", "=-_ ", "▁", "".join(map(chr, range(32, 127))))
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "It's  the\n\n end.", "<s> x </s> <unk>", "<0x0A>\n", "naïve — 漢字🙂🙂", "x" * 5000, " " * 3000 + "y",
    "\x00\x01", "�", "▁▁ a▁b", "=" * 700, "aaa" * 900, "​​ç̧", " ".join(["word"] * 3000),
]


def some_texts(n, seed=1, longest=80):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(1, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.PieceCoder(sentencepieces.PieceModel(MODEL))


def test_ids_and_texts_equal_the_library(library, pieces):
    texts = [t for t in TEXTS if t is not None] + some_texts(4000)
    for text, ids in zip(texts, pieces.encode_texts(texts)):
        assert ids.tolist() == library.encode(text), repr(text)
        assert pieces.decode(ids.tolist()) == library.decode(ids.tolist())


def test_runs_of_one_character(library, pieces):
    for c in " a=-#é0":
        texts = [c * n + tail for n in range(1, 140) for tail in ("", "b")]
        for text, ids in zip(texts, pieces.encode_texts(texts)):
            assert ids.tolist() == library.encode(text), repr(text)


def test_words_of_pieces(library, pieces):
    rng = random.Random(3)
    normal = [p for p, kind in zip(pieces.model.pieces, pieces.model.kinds) if kind == sentencepieces.NORMAL]
    texts = ["".join(rng.choices(normal, k=rng.randint(2, 12))).replace(sentencepieces.SPACE, rng.choice([" ", ""])) for _ in range(4000)]
    for text, ids in zip(texts, pieces.encode_texts(texts)):
        assert ids.tolist() == library.encode(text), repr(text)


def test_the_heap_merges_in_the_same_order(monkeypatch, library):
    monkeypatch.setattr(sentencepieces, "LONG", 3)
    pieces = sentencepieces.PieceCoder(sentencepieces.PieceModel(MODEL))
    for text in some_texts(500, seed=6) + ["x" * 3000, " " * 50]:
        assert pieces.encode(text) == library.encode(text)


def test_long_texts_and_forgetting_change_nothing(monkeypatch, library):
    monkeypatch.setattr(sentencepieces, "WHOLE_CHARS", 100)
    monkeypatch.setattr(sentencepieces, "MEMORY_ENTRIES", 20)
    pieces = sentencepieces.PieceCoder(sentencepieces.PieceModel(MODEL))
    for text in some_texts(150, seed=8, longest=400):
        assert pieces.encode(text) == library.encode(text)
        pieces.forget_if_full()
    assert len(pieces.known) <= 20


def test_any_ids_decode_as_in_the_library(library, pieces):
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(32000), 1, 2]) for _ in range(rng.randint(0, 9))]
        assert pieces.decode(ids) == library.decode(ids), ids


def made_up(pieces: list[tuple[str, float]], tmp_path):
    """A model file with these normal pieces and no bytes."""

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3, value])
        return bytes([number << 3 | 2, len(value)]) + value

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + field(3, kind))

    content = piece("<unk>", 0, 2) + b"".join(piece(p, s, 1) for p, s in pieces)
    content += field(2, field(3, 2)) + field(3, field(3, 0) + field(4, 0))
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}.model"
    path.write_bytes(content)
    return str(path)


def test_vocabularies_whose_merges_overtake_each_other(tmp_path):
    """Random scores, so that merges make better pairs than the round's, equal scores, and spaces inside pieces."""
    import sentencepiece

    rng = random.Random(11)
    for trial in range(60):
        letters = "ab" if trial % 2 else "ab▁"
        words = {"".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(25)}
        scores = [(c, -9.0) for c in letters] + [(w, -float(rng.randint(1, 4 if trial % 3 else 40))) for w in sorted(words)]
        path = made_up(scores, tmp_path)
        library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.PieceCoder(sentencepieces.PieceModel(path))
        texts = ["".join(rng.choices("ab c", k=rng.randint(1, 40))) for _ in range(60)]
        for text, ids in zip(texts, own.encode_texts(texts)):
            assert ids.tolist() == library.encode(text), (scores, text)


def test_other_kinds_of_models_are_refused(tmp_path):
    path = made_up([("a", -1.0)], tmp_path)
    content = open(path, "rb").read()
    (tmp_path / "unigram").write_bytes(content.replace(bytes([2 << 3 | 2, 2, 3 << 3, 2]), bytes([2 << 3 | 2, 2, 3 << 3, 1])))
    with pytest.raises(ValueError, match="BPE"):
        sentencepieces.PieceModel(str(tmp_path / "unigram"))


def documents(spark):
    rows = [*enumerate(TEXTS + some_texts(60, seed=7)), (None, "no id"), (3, "again"), (3, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_tokens", "'x' as ids", "2 as __text")


def test_round_trip_digests(spark, library):
    docs = documents(spark).drop("__text")
    found = sentencepieces.round_trip(docs, MODEL)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def expected(doc_id, text):
        ids = library.encode(text or "")
        digests = (hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids)))
        return doc_id, len(ids), *digests

    rows = [expected(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rows))
    assert sentencepieces.round_trip(docs.limit(0), MODEL).collect() == []


def test_ids_and_texts_as_tables(spark, library):
    docs = documents(spark)
    encoded = sentencepieces.encode_documents(docs, MODEL)
    assert sorted(r["ids"] for r in encoded.filter("doc_id = 3").collect()) == sorted(library.encode(t) for t in (TEXTS[3], "again", "again"))
    assert encoded.filter("doc_id = 0").first()["ids"] == []
    decoded = sentencepieces.decode_documents(encoded, MODEL)
    assert sorted(r["decoded"] for r in decoded.collect()) == sorted(library.decode(library.encode(r["text"] or "")) for r in docs.collect())


def test_the_query(spark, library, tmp_path):
    from grainwise.llm import queries

    documents(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op13_sentencepiece(spark, str(tmp_path)).collect()
    counted = sorted((r["doc_id"], r["n_tokens"]) for r in rows if r["doc_id"] is not None)
    assert counted == sorted((r["doc_id"], len(library.encode(r["text"] or ""))) for r in documents(spark).collect() if r["doc_id"] is not None)
