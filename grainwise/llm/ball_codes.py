"""Compress vectors to codes: one k-means per part of the vectors, by ball k-means.

Components become integers, so distances and sums are exact wherever they are added
up. Every row carries its codes and exact distances of the round before. An entry with
the parts assigned to it is a ball; in a round, a slice of rows finds the nearest entries like this:

* Each part's distance to its entry, as it is now, is worked out again (not at all where neither
  the entry nor any neighbour moved). The greatest in a ball is its radius.
* An entry is a neighbour of a ball if half its distance from the ball's entry does not exceed the
  radius; only neighbours can take a part from the ball.
* A part nearer to its entry than half the way to the nearest other entry lies in the stable core and
  keeps its code.
* The others lie in rings around the entry, bounded by half the distances of its neighbours in
  order. A part in the k-th ring has the first k neighbours as candidates and no other.

All bounds are compared as integers, four times a squared distance with the squared distance of two
entries, so ties reach the comparison and fall to the lower index. Balls are those of the
slice, which are part of the whole ball: their radii are smaller and the bounds hold all the same.

Tasks send the sum and count of every entry's parts; the codebooks, of a fixed size, are all the
driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
SLICE_ROWS = 16384
RING = 32  # neighbours by which rings are taken together
GUESSES = 16  # entries that a part without a code is held against to find its first ball
EXACT = 1 << 53  # whole numbers up to here are exact in double precision


class Codebook:
    """The entries of one part, and for each the others by distance."""

    def __init__(self, entries: np.ndarray, before: Codebook | None = None):
        """``before`` is the codebook of the round before, to tell which entries moved."""
        self.entries = entries
        kind = exact_type(entries)
        d = squared(entries.astype(kind), entries.astype(kind))
        self.order = np.argsort(d, axis=1, kind="stable")
        self.sorted = np.take_along_axis(d, self.order, axis=1)
        # Each entry comes first itself, whatever equal entries there are.
        for i in range(len(entries)):
            at = int(np.flatnonzero(self.order[i] == i)[0])
            self.order[i, 1 : at + 1] = self.order[i, :at].copy()
            self.order[i, 0] = i
        self.moved = np.ones(len(entries), dtype=bool) if before is None else (entries != before.entries).any(axis=1)


def exact_type(*arrays: np.ndarray):
    """The number type in which squared distances of the arrays' rows are exact: double, 64-bit whole or Python's own whole numbers."""
    largest = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    bound = 16 * arrays[0].shape[1] * largest * largest  # four times a squared distance
    return np.float64 if bound < EXACT else np.int64 if bound < 1 << 62 else object


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, of one exact type."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def own_squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y in pairs."""
    gap = x - y
    return (gap * gap).sum(axis=1)


def nearest(x: np.ndarray, codes: np.ndarray, known: np.ndarray | None, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of the entries nearest to the rows of x, ties to the lower index.

    ``codes`` are any codes to start from; ``known`` are the distances they had in the codebook before, or None.
    """
    codes = codes.copy()
    kind = exact_type(x, book.entries)
    x, entries = x.astype(kind), book.entries.astype(kind)
    if known is None:
        own = own_squared(x, entries[codes])
    else:
        own = known.astype(kind)
        again = book.moved[codes]
        own[again] = own_squared(x[again], entries[codes[again]])
    started = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[started], np.arange(len(entries) + 1))
    for i in np.flatnonzero(np.diff(edges)):
        ball = started[edges[i] : edges[i + 1]]
        four = 4 * own[ball]
        reach = book.sorted[i, 1:]
        neighbours = int(np.searchsorted(reach, four.max(), side="right"))
        if neighbours == 0:
            continue
        if known is not None and not book.moved[book.order[i, : neighbours + 1]].any():
            continue
        rings = np.searchsorted(reach, four, side="right")
        for ring in np.unique(-(-rings[rings > 0] // RING)):
            of_ring = ball[(rings > (ring - 1) * RING) & (rings <= ring * RING)]
            candidates = np.sort(book.order[i, : 1 + min(ring * RING, neighbours)])
            d = squared(x[of_ring], entries[candidates])
            best = d.argmin(axis=1)
            codes[of_ring] = candidates[best]
            own[of_ring] = d[np.arange(len(best)), best]
    return codes, own


def first_guess(x: np.ndarray, book: Codebook) -> np.ndarray:
    """The nearest of GUESSES entries."""
    kind = exact_type(x, book.entries)
    return squared(x.astype(kind), book.entries[:GUESSES].astype(kind)).argmin(axis=1)


def sums_of(x: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of the parts of every entry; sums as Python's whole numbers where 64 bits might not hold them."""
    order = np.argsort(codes, kind="stable")
    used, first = np.unique(codes[order], return_index=True)
    counts = np.bincount(codes, minlength=entries)
    wide = x.size and max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= 1 << 62
    sums = np.zeros((entries, x.shape[1]), dtype=object if wide else np.int64)
    if len(x):
        sums[used] = np.add.reduceat(x[order].astype(sums.dtype), first, axis=0)
    return counts, sums


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (components scaled to whole numbers) of the rows that take part.

    Rows whose vector is null or holds null or non-finite components are left out, and so are rows without a
    vec_id and vectors whose dimension is not a multiple of PARTS, at least PARTS. A scaled component that is no bigint is an error.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & fits)
    too_large = F.raise_error(F.lit("a scaled component is no bigint"))
    whole = F.transform(x, lambda v: F.when(F.abs(v * SCALE) < 2.0**63, F.floor(v * SCALE).cast("bigint")).otherwise(too_large))
    return rows.select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _assigned(rows: DataFrame, books: list[Codebook], folder: str, dimension: int, first: bool) -> DataFrame:
    """Write rows with their nearest entries, and every task's sums beside them; returns the rows."""
    width = dimension // PARTS
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<bigint>, codes array<int>, d array<bigint>, kind string, part int, entry int, n bigint, sums array<decimal(38,0)>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, len(books[0].entries)), dtype=np.int64)
        totals = np.zeros((PARTS, len(books[0].entries), width), dtype=object)
        types = None
        for batch in batches:
            types = batch.schema.field("vec_id").type, batch.schema.field("label").type
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                n = part.num_rows
                v = _matrix(part.column("v"), dimension)
                codes, d = np.zeros((n, PARTS), np.int32), np.zeros((n, PARTS), np.int64)
                before = None if first else (_matrix(part.column("codes"), PARTS), _matrix(part.column("d"), PARTS))
                for p, book in enumerate(books):
                    x = v[:, p * width : (p + 1) * width]
                    start_codes = first_guess(x, book) if first else before[0][:, p]
                    codes[:, p], d[:, p] = nearest(x, start_codes, None if first else before[1][:, p], book)
                    c, s = sums_of(x, codes[:, p], len(book.entries))
                    counts[p] += c
                    totals[p] += s
                yield _rows(part, codes, d)
        if types:
            yield from _sums(counts, totals, *types)

    def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        offsets = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1), type=kind))

    def _rows(part: pa.RecordBatch, codes: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        n = part.num_rows
        empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38)))]
        columns = [part.column(c) for c in ("vec_id", "label", "v")] + [listed(codes, pa.int32()), listed(d, pa.int64()), pa.array(["row"] * n), *empty]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    def _sums(counts, totals, id_type, label_type) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for p in range(PARTS):
            used = np.flatnonzero(counts[p])
            n = len(used)
            empty = [pa.nulls(n, t) for t in (id_type, label_type, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            sums = pa.array([[Decimal(int(s)) for s in totals[p][i]] for i in used], type=pa.list_(pa.decimal128(38)))
            columns = [*empty, pa.array(["sum"] * n), pa.array([p] * n, pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used]), sums]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    NAMES = ["vec_id", "label", "v", "codes", "d", "kind", "part", "entry", "n", "sums"]
    rows.mapInArrow(run, schema).write.parquet(folder)
    return rows.sparkSession.read.schema(schema).parquet(folder)


def _moved(state: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks whose entries are the floors of their parts' means; entries without parts stay."""
    sums = state.filter("kind = 'sum'").select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # PARTS * ENTRIES rows of one part's width: the size of the codebooks.
    found = sums.groupBy("part", "entry").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "s"))).alias("s")).collect()
    entries = [book.entries.copy() for book in books]
    for r in found:
        entries[r["part"]][r["entry"]] = [int(s["s"]) // r["n"] for s in r["s"]]
    return [Codebook(e, before) for e, before in zip(entries, books)]


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the codebooks (one array of entries for each part).

    ``vectors`` holds vec_id, embedding and label; other columns are ignored. The table has one row for each
    vector that takes part (see ``usable_vectors``), repeated rows included: vec_id, label, codes
    (array, one index for each part) and error (squared distances summed over the parts). Codebooks start from the vectors
    with the smallest vec_ids, ties by their components; vectors whose dimension differs from the first one's are left out.
    An error or sum that is no bigint is an error. Without vectors there are no rows and no codebooks.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors)
    # The first codebooks: a fixed number of vectors.
    least = rows.orderBy("vec_id", "v").limit(1).collect()
    if not least:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error")), []
    dimension = len(least[0]["v"])
    rows = rows.filter(F.size("v") == dimension)
    start = np.array([r["v"] for r in rows.orderBy("vec_id", "v").select("v").limit(entries).collect()], dtype=np.int64)
    width = dimension // PARTS
    books = [Codebook(start[:, p * width : (p + 1) * width]) for p in range(PARTS)]
    for number in range(rounds + 1):
        state = _assigned(rows, books, new_folder(spark, "codes"), dimension, number == 0)
        rows = state.filter("kind = 'row'").select("vec_id", "label", "v", "codes", "d")
        if number < rounds:
            books = _moved(state, books)
    error = F.aggregate("d", F.lit(0).cast("bigint"), lambda total, x: total + x)
    return rows.select("vec_id", "label", "codes", error.alias("error")), [book.entries for book in books]


def codes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (errors summed over equal labels, nulls together), codebooks_sha256.

    Rows of a hot label meet its sum in a join that Spark splits or broadcasts.
    """
    coded, books = compress(vectors)
    digits = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    listed = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))
