"""Document quality by a factorisation machine.

A document's features are its hashed words (counts, scaled to length 1), bins of
statistics of its structure, and a bin of its metadata (the recorded number of
characters). Every feature has a weight and a short factor; the score adds the
products of all pairs of features, weighted by the inner products of their
factors, in time linear in the features by

    sum over pairs = 1/2 * sum over factors of ((sum v x)^2 - sum (v x)^2).

The machine is fitted on the driver to a sample of at most SAMPLE labelled
documents, those with the smallest hash of their ids; the model has a fixed size and
every whole text is scored. A document comes to the driver as its features, FEATURES pairs of 8 bytes
at most, so the sample takes 0.8 GB if every document has all words; measured, 16 MB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, map_slices
from .words import PIECE_BYTES, string_buffers, word_hashes

SAMPLE = 6000
WORD_BUCKETS = 1 << 14
BINS = 16
FACTORS = 8
EPOCHS = 6
BATCH = 64
RATE = 0.1
DECAY = 1e-5

# Byte classes: 0 letter (and all of a multi-byte character), 1 capital, 2 digit, 3 space, 4 line break, 5 prose mark, 6 other.
_CLASSES = 7
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
STATISTICS = 9
FEATURES = WORD_BUCKETS + (STATISTICS + 1) * BINS


def _class_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each class every row has, taken in pieces."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * _CLASSES, dtype=np.int64)
    for start in range(0, len(raw), PIECE_BYTES):
        part = raw[start : start + PIECE_BYTES]
        row = np.searchsorted(offsets, np.arange(start, start + len(part)), side="right") - 1 if rows > 1 else 0
        counts += np.bincount(row * _CLASSES + _CLASS[part], minlength=len(counts))
    return counts.reshape(rows, _CLASSES)


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all rows, one row after the other, and how many each row has.

    A null text counts as empty; a null n_chars as the text's own length.
    """
    raw, offsets = string_buffers(texts)
    rows = len(offsets) - 1
    words, n_words = word_hashes(texts)
    owner = np.repeat(np.arange(rows), n_words)
    keys, counts = np.unique(owner * WORD_BUCKETS + (words % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    row_of, bucket = keys // WORD_BUCKETS, keys % WORD_BUCKETS
    norm = np.sqrt(np.bincount(row_of, weights=counts.astype(float) ** 2, minlength=rows))
    word_values = counts / norm[row_of]
    distinct = np.bincount(row_of, minlength=rows)

    classes = _class_counts(raw, offsets)
    size = np.diff(offsets)
    share = classes / np.maximum(size, 1)[:, None]
    visible = classes[:, [0, 1, 2, 5, 6]].sum(axis=1)
    recorded = np.asarray(n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)
    recorded = np.where(np.isnan(recorded), size, np.maximum(recorded, 0))

    def root(x):  # spreads small shares over the bins
        return np.sqrt(np.clip(x, 0, 1)) * (BINS - 1)

    scaled = [
        *(root(share[:, c]) for c in (1, 2, 4, 5, 6)),
        root(classes[:, 6] / np.maximum(n_words, 1)),
        np.minimum(visible / np.maximum(n_words, 1), BINS - 1),
        root(distinct / np.maximum(n_words, 1)),
        np.minimum(np.log2(n_words + 1), BINS - 1),
        np.minimum(np.log2(recorded + 1), BINS - 1),
    ]
    bins = np.stack(scaled, axis=1).astype(np.int64)
    columns = bins + WORD_BUCKETS + np.arange(bins.shape[1]) * BINS
    per_row = distinct + bins.shape[1]
    ends = np.cumsum(per_row)
    index = np.empty(int(ends[-1]) if rows else 0, dtype=np.int32)
    value = np.empty(len(index), dtype=np.float32)
    if rows:
        word_start = ends - per_row
        at = np.arange(len(keys)) - np.repeat(np.cumsum(distinct) - distinct, distinct) + np.repeat(word_start, distinct)
        index[at], value[at] = bucket, word_values
        tail = (word_start + distinct)[:, None] + np.arange(bins.shape[1])
        index[tail], value[tail] = columns, 1 / np.sqrt(bins.shape[1])
    return index, value, per_row


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before squashing, and each row's sums of v x."""
        starts = np.cumsum(per_row) - per_row
        vx = self.factor[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.weight[index] * value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def probability(self, index: np.ndarray, value: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        if len(per_row) == 0:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, per_row)[0].astype(float), -30, 30)))


def fit(index: list[np.ndarray], value: list[np.ndarray], label: np.ndarray) -> Machine:
    """Adaptive gradient descent on the logistic loss. Without rows of both labels every score is the labels' mean, 0.5 if there is none."""
    random = np.random.default_rng(11)
    machine = Machine(0.0, np.zeros(FEATURES, np.float32), random.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32))
    mean = float(label.mean()) if len(label) else 0.5
    if len(label) == 0 or mean in (0.0, 1.0):
        machine.factor[:] = 0
        machine.bias = float(np.clip(np.log((mean + 1e-9) / (1 - mean + 1e-9)), -20, 20))
        return machine
    machine.bias = float(np.log(mean / (1 - mean)))
    seen_w = np.full(FEATURES, 1e-6, np.float32)
    seen_v = np.full((FEATURES, FACTORS), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = random.permutation(len(label))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            per_row = np.array([len(index[r]) for r in rows])
            i, x = np.concatenate([index[r] for r in rows]), np.concatenate([value[r] for r in rows])
            raw, sums = machine.raw(i, x, per_row)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]).astype(np.float32) / len(rows)
            machine.bias -= RATE * float(error.sum())
            e = np.repeat(error, per_row)
            used, at = np.unique(i, return_inverse=True)
            by_weight = np.bincount(at, weights=e * x, minlength=len(used)) + DECAY * machine.weight[used]
            slope = (e * x)[:, None] * (np.repeat(sums, per_row, axis=0) - machine.factor[i] * x[:, None])
            by_factor = np.stack([np.bincount(at, weights=slope[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1)
            by_factor += DECAY * machine.factor[used]
            seen_w[used] += by_weight**2
            seen_v[used] += by_factor**2
            machine.weight[used] -= RATE * by_weight / np.sqrt(seen_w[used])
            machine.factor[used] -= RATE * by_factor / np.sqrt(seen_v[used])
    return machine


def _feature_rows(docs: DataFrame) -> DataFrame:
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        index, value, per_row = features(part.column("text"), part.column("n_chars"))
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (index, value)]
        known = [part.column("doc_id"), part.column("label")]
        return pa.RecordBatch.from_arrays([*known, *lists], names=["doc_id", "label", "index", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs, run, f"doc_id {kind}, label double, index array<int>, value array<float>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit to at most ``sample`` documents that have a label and are not held out.

    A document labelled several times has the mean of its labels; of rows that
    share a doc_id the smallest text is taken.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(1, 3))
    chosen = usable.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", "n_chars").join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("row"))
    found = _feature_rows(rows.select("doc_id", "label", "row.text", "row.n_chars")).toArrow().sort_by("doc_id")
    index = [found["index"][k].values.to_numpy() for k in range(found.num_rows)]
    value = [found["value"][k].values.to_numpy() for k in range(found.num_rows)]
    return fit(index, value, found["label"].to_numpy())


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1, higher is better) and predicted (1 if score >= 0.5).

    Null texts score as empty ones; repeated rows are scored alike; columns of ``docs``
    that are called score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    names = {c: f"c{k}" for k, c in enumerate(kept)}

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        score = machine.probability(*features(part.column(names["text"]), part.column(names["n_chars"])))
        columns = [part.column(names[c]) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names.values(), "score", "predicted"])

    rows = docs.select(*(docs[c].alias(n) for c, n in names.items()))
    schema = ", ".join(f"{names[c]} {docs.schema[c].dataType.simpleString()}" for c in kept)
    scored = map_slices(rows, run, f"{schema}, score double, predicted int", names["text"])
    return scored.select(*(F.col(n).alias(c) for c, n in names.items()), "score", "predicted")
