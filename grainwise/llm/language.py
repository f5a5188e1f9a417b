"""Language of documents in two steps: the family first, then the language within it.

Texts become square roots of the shares of their hashed letter trigrams, which are
vectors of length 1. One linear support vector machine for each family against
the rest chooses the family; within it, machines for each pair of its
languages vote. They are fitted on the driver to a sample of about SAMPLE
documents of each labelled language, chosen by the hash of the id; of many
languages, fewer documents each, so that all are about SAMPLE_ROWS. The model
grows with the languages and not with the documents, and every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, map_slices
from .words import PIECE_BYTES, string_buffers

SAMPLE = 800
SAMPLE_ROWS = 25_600
MOST_LANGUAGES = 1_000
BUCKETS = 1 << 12
STEPS = 150
PENALTY = 1e-4
UNKNOWN = "und"

# Families of languages by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILY = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indo-aryan": ("hi", "bn", "mr", "ne", "ur", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY_OF = {code: family for family, codes in FAMILY.items() for code in codes}

# Letters as they are, A to Z lower-cased; all other ASCII is a space.
_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[:128] = 0x20
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.split("-")[0].lower(), language)


def trigram_vectors(texts: pa.Array) -> np.ndarray:
    """One row of BUCKETS numbers for each text; all zero without letters. Long texts are taken in pieces."""
    raw, offsets = string_buffers(texts)
    rows = len(offsets) - 1
    counts = np.zeros(rows * BUCKETS, dtype=np.float64)
    for start in range(0, len(raw), PIECE_BYTES):
        part = _LETTER[raw[start : start + PIECE_BYTES + 2]]
        if len(part) < 3:
            break
        a, b, c = part[:-2], part[1:-1], part[2:]
        code = (a << np.uint32(16)) | (b << np.uint32(8)) | c
        code = code * np.uint32(0x9E3779B1)
        bucket = (code >> np.uint32(32 - 12)).astype(np.int64)
        place = np.arange(start, start + len(a))
        row = np.searchsorted(offsets, place, side="right") - 1
        inside = (place + 3 <= offsets[row + 1]) & ~((b == 0x20) & ((a == 0x20) | (c == 0x20)))
        counts += np.bincount(row[inside] * BUCKETS + bucket[inside], minlength=len(counts))
    counts = counts.reshape(rows, BUCKETS)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def linear_svms(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """A column of weights and bias (last) for each column of ``positive``: the squared hinge loss, both sides weighing the same, by accelerated descent."""
    y = np.where(positive, 1, -1).astype(np.float32)
    per_positive = 0.5 / np.maximum(positive.sum(axis=0), 1)
    per_negative = 0.5 / np.maximum((~positive).sum(axis=0), 1)
    share = np.where(positive, per_positive, per_negative).astype(np.float32)
    w = np.zeros((x.shape[1] + 1, positive.shape[1]), dtype=np.float32)
    ahead, momentum, rate = w.copy(), 1.0, 0.25
    for _ in range(STEPS):
        slack = np.maximum(1 - y * (x @ ahead[:-1] + ahead[-1]), 0) * share * y
        slope = np.vstack([-2 * (x.T @ slack) + PENALTY * ahead[:-1], -2 * slack.sum(axis=0)])
        new = (ahead - rate * slope).astype(np.float32)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = (new + (momentum - 1) / after * (new - w)).astype(np.float32)
        w, momentum = new, after
    return w


def linear_svm(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    return linear_svms(x, positive[:, None])[:, 0]


@dataclass
class LanguageModel:
    families: list[list[str]] = field(default_factory=list)
    by_family: np.ndarray | None = None  # a column for each family
    by_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of every row; ties go to the family and language that come first."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))

        def sure(margin):
            return 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8)))

        names = np.full(len(x), "", dtype=object)
        score = np.ones(len(x))
        chosen = np.zeros(len(x), dtype=int)
        if len(self.families) > 1:
            margins = (x @ self.by_family[:-1] + self.by_family[-1]).astype(np.float64)
            chosen = margins.argmax(axis=1)
            score = sure(margins.max(axis=1))
        for k, members in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            votes = np.zeros((len(rows), len(members)))
            against = np.ones((len(rows), len(members)))
            for i, j in combinations(range(len(members)), 2):
                w = self.by_pair[members[i], members[j]]
                margin = (x[rows] @ w[:-1] + w[-1]).astype(np.float64)
                votes[:, i] += margin >= 0
                votes[:, j] += margin < 0
                against[:, i] = np.minimum(against[:, i], sure(margin))
                against[:, j] = np.minimum(against[:, j], sure(-margin))
            best = (votes + against / 2).argmax(axis=1)
            names[rows] = np.array(members, dtype=object)[best]
            score[rows] *= against[np.arange(len(rows)), best]
        return names.tolist(), score


def fit(x: np.ndarray, languages: list[str]) -> LanguageModel:
    known = sorted(set(languages))
    grouped: dict[str, list[str]] = {}
    for language in known:
        grouped.setdefault(family_of(language), []).append(language)
    named = np.array(languages)
    model = LanguageModel([grouped[f] for f in sorted(grouped)])
    if len(model.families) > 1:
        model.by_family = linear_svms(x, np.stack([np.isin(named, members) for members in model.families], axis=1))
    for members in model.families:
        for one, other in combinations(members, 2):
            rows = np.isin(named, (one, other))
            model.by_pair[one, other] = linear_svm(x[rows], named[rows] == one)
    return model


def learn(docs: DataFrame, sample: int = SAMPLE, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit to about ``sample`` documents of each language that are not held out and have a letter.

    Of more than ``rows`` / ``sample`` languages, equal parts of about ``rows``
    documents are taken. Every language with a usable document is learnt, from one at least.
    Rows of one doc_id and language count once, with the smallest text. Without
    labelled documents there is no language to learn; more than MOST_LANGUAGES languages are an error.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(2, 4))
    usable = usable.select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return LanguageModel()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    sample = min(sample, rows / len(counts))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    shares = docs.sparkSession.createDataFrame([(row["lang"], sample / row["count"]) for row in counts], "lang string, share double")
    # MOST_LANGUAGES rows at most.
    drawn = usable.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).filter(F.col("text").rlike(r"\p{L}"))
    drawn = drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", "text")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        vectors = trigram_vectors(part.column("text"))
        index = [np.flatnonzero(v).astype(np.int32) for v in vectors]
        value = [v[i] for v, i in zip(vectors, index)]
        arrays = [pa.array(index, type=pa.list_(pa.int32())), pa.array(value, type=pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *arrays], names=["doc_id", "lang", "index", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, index array<int>, value array<float>"
    found = map_slices(drawn, run, schema).toArrow()
    missed = {row["lang"] for row in counts}.difference(found["lang"].to_pylist())
    if missed:
        # By chance, or for texts without a letter: the first usable document by the same draw.
        missing = docs.sparkSession.createDataFrame([(name,) for name in sorted(missed)], "lang string")
        usable = usable.join(F.broadcast(missing), "lang").filter(F.col("text").rlike(r"\p{L}"))
        first = usable.groupBy("lang").agg(F.min(F.struct(draw.alias("draw"), "doc_id", "text")).alias("first"))
        more = map_slices(first.select("first.doc_id", "lang", "first.text"), run, schema).toArrow()
        found = pa.concat_tables([found, more.cast(found.schema)])
    found = found.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    x = np.zeros((found.num_rows, BUCKETS), dtype=np.float32)
    for row in range(found.num_rows):
        x[row, found["index"][row].values.to_numpy()] = found["value"][row].values.to_numpy()
    return fit(x, found["lang"].to_pylist())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and lang_pred and score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text
    if no language was learnt. Repeated rows are judged alike; columns of ``docs``
    that are called lang_pred or score are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    names = {c: f"c{k}" for k, c in enumerate(kept)}

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        languages, score = model.predict(trigram_vectors(part.column(names["text"])))
        has_letter = part.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
        languages = [name if ok else UNKNOWN for name, ok in zip(languages, has_letter)]
        columns = [part.column(n) for n in names.values()]
        judged = [pa.array(languages, type=pa.string()), pa.array(np.where(has_letter, score, 0.0))]
        return pa.RecordBatch.from_arrays([*columns, *judged], names=[*names.values(), "lang_pred", "score"])

    letter = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*(docs[c].alias(n) for c, n in names.items()), letter.alias("__letter"))
    schema = ", ".join(f"{names[c]} {docs.schema[c].dataType.simpleString()}" for c in kept)
    found = map_slices(rows, run, f"{schema}, lang_pred string, score double", names["text"])
    return found.select(*(F.col(n).alias(c) for c, n in names.items()), "lang_pred", "score")
