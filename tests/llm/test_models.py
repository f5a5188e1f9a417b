"""Quality classifier and language ID: the identity, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from grainwise.llm import language, quality

SF_DIR = "/root/testdata/sf0.001"
ODD = ["", None, "  \n", "1234 5678", "%%% ### $$$", "a", "é", "word " * 30_000]


def test_linear_time_scores_equal_the_sum_over_pairs():
    random_ = np.random.default_rng(1)
    machine = quality.Machine(0.3, random_.normal(size=quality.FEATURES), random_.normal(size=(quality.FEATURES, quality.FACTORS)))
    index, value, per_row = quality.features(pa.array(["a b c a", "d %%% e", ""]), pa.array([7, None, 0]))
    scores, _ = machine.raw(index, value, per_row)
    start = 0
    for row, n in enumerate(per_row):
        i, x = index[start : start + n], value[start : start + n]
        start += n
        slow = 0.3 + (machine.weight[i] * x).sum()
        slow += sum(machine.factor[i[p]] @ machine.factor[i[q]] * x[p] * x[q] for p in range(n) for q in range(p))
        assert scores[row] == pytest.approx(slow, rel=1e-4, abs=1e-4)


def test_features_of_a_text_do_not_depend_on_its_neighbours(monkeypatch):
    texts, lengths = ["one two two", None, "THREE, 4!", " ".join(f"w{i}" for i in range(3000))], [11, None, 9, 5]
    together = quality.features(pa.array(texts), pa.array(lengths, type=pa.int64()))
    monkeypatch.setattr("grainwise.llm.words.PIECE_BYTES", 500)
    monkeypatch.setattr(quality, "PIECE_BYTES", 500)
    alone = [quality.features(pa.array([t], type=pa.string()), pa.array([n], type=pa.int64())) for t, n in zip(texts, lengths)]
    for part in range(3):
        assert np.allclose(together[part], np.concatenate([a[part] for a in alone]))


def test_one_label_or_none():
    assert quality.fit([], [], np.array([])).probability(*quality.features(pa.array(["x"]), pa.array([1]))) == pytest.approx([0.5])
    one = quality.features(pa.array(["x y"]), pa.array([3]))
    sure = quality.fit([one[0]], [one[1]], np.array([1.0]))
    assert sure.probability(*one) > 0.99


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_quality_of_held_out_documents(spark, tables):
    from grainwise.llm.queries import op3_quality_classifier

    docs, labels = tables
    found = op3_quality_classifier(spark, SF_DIR)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    known = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert len(known) > 10 and sum(a == b for a, b in known) >= 0.95 * len(known)


def test_quality_learns_nothing_from_held_out_labels(spark):
    ids = [i for i in range(300) if crc32(str(i).encode()) % 3 == 1]
    docs = spark.createDataFrame([(i, f"word{i}", 5) for i in ids], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    machine = quality.learn(docs, labels)
    assert machine.probability(*quality.features(pa.array(["any"]), pa.array([3]))) == pytest.approx([0.5])


def test_quality_of_odd_rows(spark):
    rows = [(i, t, None, i % 2) for i, t in enumerate(ODD)] + [(None, "x y z", -5, 1), (1, None, 3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score int")
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, 0), (None, 1), (5, None), (77, 1)], "doc_id long, quality int")
    machine = quality.learn(docs, labels)
    found = quality.score_quality(docs, machine)
    assert found.columns == ["doc_id", "text", "n_chars", "score", "predicted"]
    scored = found.collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if not r["text"] and r["n_chars"] is None}) == 1
    assert quality.score_quality(docs.limit(0), machine).collect() == []
    assert quality.learn(docs.limit(0), labels.limit(0)).bias == pytest.approx(0.0)


def test_vectors_skip_what_is_no_letter():
    vectors = language.trigram_vectors(pa.array(["Abc abc", "abc-ABC", "", None, "99 !!"]))
    assert np.allclose(vectors[0], vectors[1]) and not vectors[2:].any()
    assert np.allclose((vectors[:2] ** 2).sum(axis=1), 1)


def test_vectors_of_long_texts_in_pieces(monkeypatch):
    texts = pa.array(["lorem ipsum dolor " * 300, "x", "éàü ñandú " * 200])
    whole = language.trigram_vectors(texts)
    monkeypatch.setattr(language, "PIECE_BYTES", 333)
    assert np.allclose(whole, language.trigram_vectors(texts))


def test_svm_separates():
    random_ = np.random.default_rng(2)
    x = random_.normal(size=(200, 20)).astype(np.float32)
    positive = x[:, 0] + x[:, 1] > 0
    w = language.linear_svm(x, positive)
    assert ((x @ w[:-1] + w[-1] > 0) == positive).mean() > 0.95


def test_families_and_pairs():
    rng = random.Random(4)
    syllables = {"de": "sch ung ein", "en": "the ing tion", "fr": "eau oi ment", "es": "ción os ar", "xx": "qq zz kk"}
    make = lambda lang: " ".join("".join(rng.choices(syllables[lang].split(), k=2)) for _ in range(30))
    named = [lang for lang in syllables for _ in range(40)]
    model = language.fit(language.trigram_vectors(pa.array([make(n) for n in named])), named)
    assert model.families == [["de", "en"], ["es", "fr"], ["xx"]] and set(model.by_pair) == {("de", "en"), ("es", "fr")}
    fresh = [lang for lang in syllables for _ in range(10)]
    predicted, score = model.predict(language.trigram_vectors(pa.array([make(n) for n in fresh])))
    assert predicted == fresh and (score > 0.5).all() and (score <= 1).all()


def plain_prediction(model, row):
    """Family by the greatest margin, language by most votes and then the weakest win; the first among equals."""

    def margin(w):
        return float(np.dot(row, w[:-1]) + w[-1])

    def sure(m):
        return 1 / (1 + math.exp(-4 * min(max(m, -8), 8)))

    score, members = 1.0, model.families[0]
    if len(model.families) > 1:
        margins = [margin(model.by_family[:, k]) for k in range(len(model.families))]
        best = margins.index(max(margins))
        score, members = sure(margins[best]), model.families[best]
    ranked = []
    for name in members:
        votes, weakest = 0, 1.0
        for other in members:
            if other == name:
                continue
            first = (name, other) in model.by_pair
            m = margin(model.by_pair[(name, other) if first else (other, name)])
            votes += m >= 0 if first else m < 0
            weakest = min(weakest, sure(m if first else -m))
        ranked.append((votes + weakest / 2, weakest))
    place = [v for v, _ in ranked].index(max(v for v, _ in ranked))
    return members[place], score * ranked[place][1]


def test_votes_and_margins_equal_a_plain_version():
    random_ = np.random.default_rng(12)
    for names in (["en", "de", "nl", "fr", "es", "it", "pt", "zz"], ["fr", "es", "it"], ["en", "fr"], ["zz"]):
        named = [n for n in names for _ in range(15)]
        x = random_.random((len(named), 40)).astype(np.float32) * 0.3
        x[np.arange(len(named)), [names.index(n) for n in named]] += 1
        model = language.fit(x, named)
        fresh = random_.random((200, 40)).astype(np.float32)
        predicted, score = model.predict(fresh)
        for row, name, s in zip(fresh, predicted, score):
            expected, sure = plain_prediction(model, row)
            assert name == expected and s == pytest.approx(sure, rel=1e-4)
    # Equal margins and votes everywhere: the first family, the first language.
    model = language.LanguageModel([["aa", "bb", "cc"], ["dd"]], np.zeros((5, 2), np.float32), {p: np.zeros(5, np.float32) for p in (("aa", "bb"), ("aa", "cc"), ("bb", "cc"))})
    assert model.predict(np.ones((3, 4), np.float32))[0] == ["aa"] * 3 and plain_prediction(model, np.ones(4))[0] == "aa"


def test_machines_fitted_together_are_those_fitted_alone():
    random_ = np.random.default_rng(13)
    x = random_.normal(size=(120, 20)).astype(np.float32)
    positive = np.stack([x[:, k] > 0.2 for k in range(5)], axis=1)
    together = language.linear_svms(x, positive)
    for k in range(5):
        assert np.allclose(together[:, k], language.linear_svm(x, positive[:, k]), atol=1e-3)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i % 9}") for i in range(100)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.learn(docs)


def test_language_of_held_out_documents(spark, tables):
    from grainwise.llm.queries import op7_language_id

    rows = {r["doc_id"]: r for r in op7_language_id(spark, SF_DIR).collect()}
    docs = tables[0].collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    known = [(rows[d["doc_id"]]["lang_pred"], d["lang"]) for d in docs if rows[d["doc_id"]]["held_out"] and d["lang"]]
    assert len(known) > 20 and sum(a == b for a, b in known) >= 0.95 * len(known)


def test_every_labelled_language_is_learnt(spark):
    rng = random.Random(40)
    names = [f"x{k:02d}" for k in range(45)] + ["en", "de"]
    words = {name: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for name in names}
    rows = [(1000 * k + i, " ".join(rng.choices(words[name], k=25)), name) for k, name in enumerate(names) for i in range(14 + k % 5)]
    rows += [(10**6 + i, "12 34", "rare") for i in range(400)] + [(10**7 + i, "kwyjibo zzyzx qoph", "rare") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs, language.learn(docs)).collect()
    held = [r for r in found if crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["text"] != "12 34"]
    assert len({r["lang"] for r in held}) > 40 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    few = language.learn(docs, rows=60)
    assert sorted(n for members in few.families for n in members) == sorted([*names, "rare"])


def test_language_of_odd_rows(spark, tables):
    model = language.learn(tables[0])
    rows = [(i, t, 1.5) for i, t in enumerate(ODD)] + [(None, "the of and", None), (1, None, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = language.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    for r in found.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
    assert language.identify(docs.limit(0), model).collect() == []
    unlearnt = language.learn(tables[0].withColumn("lang", tables[0]["lang"].substr(1, 0)).limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, unlearnt).collect()} == {"und"}
