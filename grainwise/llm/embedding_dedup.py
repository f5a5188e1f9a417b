"""Near-duplicate embeddings by counting collisions on many one-dimensional projections.

Equal vectors of one label form one class with its number of rows. Classes of a
label are projected on PROJECTIONS random directions, each projection is
sorted, and a window is laid around each vector's own value; a vector inside
the window collides with it. A pair whose cosine is COSINE collides on a
projection with a known probability, so the number of collisions that such a pair
reaches with probability RECALL is known too; pairs that reach it are verified in
double precision.

Work is laid out in cells and blocks. A cell is where all of a few random projections, cut into
bins of a width that is a multiple of the distance of a pair at the threshold, fall into
the same bins; how likely such a pair shares a bin does not depend on where it lies, so a
label whose vectors have a common direction is split like any other. A label is split in as
many ways as make the pair meet in one of them with probability MEET; a pair
counts in the first way in which it meets. How many projections make a cell is chosen for each label and
dimension by one rule, the least estimated work: none for all but large labels, whose one cell loses
nothing. Every cell is cut into blocks of about BLOCK classes, and each pair of blocks
is one task's work, so one hot label or cell spreads over many tasks. A task
returns, for each class, how many rows it linked with and the smallest class
it reached: one row, however many links.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import checkpointed

COSINE = 0.93
RECALL = 0.9999
PROJECTIONS = 32
HALF_WINDOW = 0.374  # of a projection whose values have variance 1 over unit vectors
BLOCK = 2048
MEET = 0.999999  # of a pair at the threshold, in some cell
BIN = 4.0  # bin width over the distance of such a pair
COPY = 2048  # a copy of a vector costs as much as so many comparisons
MOST_BINS = 24  # more projections never make less work
VERIFY = 1 << 17


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def collision_probability(cosine: float, half_window: float = HALF_WINDOW) -> float:
    """Chance that two unit vectors with this cosine differ by at most the half window on one projection."""
    distance = math.sqrt(max(2 - 2 * cosine, 1e-300))
    return 2 * _normal(half_window / distance) - 1


def least_collisions(cosine: float = COSINE, recall: float = RECALL, projections: int = PROJECTIONS) -> int:
    """The greatest count that a pair with this cosine reaches with probability ``recall``."""
    p = collision_probability(cosine)
    missed = 0.0
    for k in range(projections + 1):
        missed += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if missed > 1 - recall:
            return k
    return projections


def same_bin_probability(ratio: float = BIN) -> float:
    """Chance that two vectors share a bin ``ratio`` times as wide as they are apart, on a random projection with a random offset."""
    return 2 * _normal(ratio) - 1 - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def ways_for(bins: int, meet: float = MEET) -> int:
    """So many ways of ``bins`` projections make a pair at the threshold meet in one of them with probability ``meet``."""
    together = same_bin_probability() ** bins
    return 1 if bins == 0 else math.ceil(math.log(1 - meet) / math.log(1 - together))


def cell_plan(n: int, spread: float, cosine: float = COSINE) -> int:
    """Projections per cell for a label of ``n`` classes whose projections have standard deviation ``spread``: the least work.

    A cell is taken to hold the share of classes that so many bins of a normal distribution leave together.
    """
    width = BIN * math.sqrt(max(2 - 2 * cosine, 1e-300))
    kept = min(1.0, width / (max(spread, 1e-9) * math.sqrt(2 * math.pi * math.e)))

    def work(bins: int) -> float:
        return ways_for(bins) * (n * kept**bins + COPY)

    return min(range(MOST_BINS + 1), key=work)


def directions(dimensions: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimensions, number))


def cells_of(unit: np.ndarray, bins: int, ways: int, cosine: float = COSINE) -> np.ndarray:
    """The cell of every vector in every way, as a number."""
    if bins == 0:
        return np.zeros((len(unit), ways), dtype=np.int64)
    width = BIN * math.sqrt(max(2 - 2 * cosine, 1e-300))
    offset = np.random.default_rng(3).random(bins * ways)
    binned = np.floor(unit @ directions(unit.shape[1], bins * ways, seed=2) / width + offset).astype(np.int64)
    # Unit vectors reach few bins; 64 bits wrap around without harm, since equal bins stay equal.
    factors = np.random.default_rng(4).integers(1, 1 << 62, size=bins * ways, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (binned * factors).reshape(len(unit), ways, bins).sum(axis=2)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often each row of ``b`` lies in the window around each row of ``a``; both hold projections by column."""
    counts = np.zeros(len(a) * len(b), dtype=np.uint8)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        values = b[order, k]
        first = np.searchsorted(values, a[:, k] - HALF_WINDOW, side="left")
        number = np.searchsorted(values, a[:, k] + HALF_WINDOW, side="right") - first
        within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        found = order[within + np.repeat(first, number)]
        counts[found + np.repeat(np.arange(len(a)) * len(b), number)] += 1
    return counts.reshape(len(a), len(b))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def linked_pairs(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, cells: np.ndarray, way: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) between two blocks whose cosine is at least ``cosine``, met here first."""
    unit = _unit(vectors)
    projected = unit @ directions(vectors.shape[1], PROJECTIONS, seed=1)
    counts = collisions(projected[left], projected[right])
    i, j = np.nonzero(counts >= least_collisions(cosine))
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    if way:
        fresh = ~(cells[i, :way] == cells[j, :way]).any(axis=1)
        i, j = i[fresh], j[fresh]
    keep = np.empty(len(i), dtype=bool)
    for start in range(0, len(i), VERIFY):
        x, y = unit[i[start : start + VERIFY]], unit[j[start : start + VERIFY]]
        keep[start : start + VERIFY] = np.einsum("nd,nd->n", x, y) >= cosine
    return i[keep], j[keep]


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places, in order of size, the smallest place that links lead to."""
    low = np.arange(n)
    for _ in count():
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def _block_task(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("cid")
        vectors = np.stack(table["vector"].to_numpy(zero_copy_only=False)).astype(np.float64) if table.num_rows else np.zeros((0, 1))
        side, rows = table["side"].to_numpy(), table["rows"].to_numpy()
        way, bins = int(table["way"][0].as_py()), int(table["bins"][0].as_py())
        left = np.flatnonzero(side == 0)
        right = left if table["low"][0].as_py() == table["high"][0].as_py() else np.flatnonzero(side == 1)
        cells = cells_of(_unit(vectors), bins, ways_for(bins), cosine) if way else np.zeros((len(vectors), 1), np.int64)
        i, j = linked_pairs(vectors, left, right, cells, way, cosine)
        links = np.bincount(i, weights=rows[j], minlength=len(side)) + np.bincount(j, weights=rows[i], minlength=len(side))
        root = smallest_reached(len(side), i, j)
        out = table.select(["label", "key_a", "key_b", "cid"])
        out = out.append_column("links", pa.array(links.astype(np.int64)))
        out = out.append_column("root", table["cid"].take(pa.array(root)))
        return out.filter(pa.array(links > 0))

    return run


def _spreads(classes: DataFrame) -> DataFrame:
    """label, dim, n, spread: how far the unit vectors of a label and dimension lie from their mean, on a projection.

    Tasks send one sum of unit vectors for each label and batch.
    """

    def sums(batches):
        for batch in batches:
            for dim in set(batch.column("dim").to_pylist()):
                part = pa.Table.from_batches([batch]).filter(pc.equal(batch.column("dim"), dim))
                unit = _unit(np.stack(part["vector"].to_numpy(zero_copy_only=False)).astype(np.float64))
                coded = part["label"].combine_chunks().dictionary_encode()
                of = coded.indices.to_numpy()
                total = np.zeros((len(coded.dictionary), dim))
                np.add.at(total, of, unit)
                number = np.bincount(of, minlength=len(total))
                columns = [coded.dictionary, pa.array([dim] * len(total), pa.int32()), pa.array(number), pa.array(list(total), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "n", "total"])

    label = classes.schema["label"].dataType.simpleString()
    found = classes.select("label", "dim", "vector").mapInArrow(sums, f"label {label}, dim int, n bigint, total array<double>")
    by_place = found.select("label", "dim", "n", F.posexplode("total").alias("place", "x"))
    by_place = by_place.groupBy("label", "dim", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = by_place.groupBy("label", "dim").agg(F.max("n").alias("n"), F.sum((F.col("x") / F.col("n")) ** 2).alias("squared"))
    return mean.select("label", "dim", "n", F.sqrt(F.greatest(1 - F.col("squared"), F.lit(0.0))).alias("spread"))


def _with_cells(classes: DataFrame, cosine: float) -> DataFrame:
    """Classes with the projections per cell of their label (bins), and a row for each way with its cell."""

    def planned(batches):
        for batch in batches:
            bins = [cell_plan(n, s, cosine) for n, s in zip(batch.column("n").to_pylist(), batch.column("spread").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("dim"), pa.array(bins, pa.int32())], names=["label", "dim", "bins"])

    label = classes.schema["label"].dataType.simpleString()
    plans = checkpointed(_spreads(classes).mapInArrow(planned, f"label {label}, dim int, bins int"))

    def with_cells(batches):
        for batch in batches:
            kinds = {(d, b) for d, b in zip(batch.column("dim").to_pylist(), batch.column("bins").to_pylist())}
            for dim, bins in kinds:
                part = pa.Table.from_batches([batch]).filter(pc.and_(pc.equal(batch.column("dim"), dim), pc.equal(batch.column("bins"), bins)))
                unit = _unit(np.stack(part["vector"].to_numpy(zero_copy_only=False)).astype(np.float64))
                cells = pa.array(list(cells_of(unit, bins, ways_for(bins), cosine)), type=pa.list_(pa.int64()))
                yield from part.append_column("cells", cells).to_batches()

    # A plan is one row for a label and dimension.
    joined = classes.join(plans, ["label", "dim"]).select(*classes.columns, "bins")
    celled = joined.mapInArrow(with_cells, _schema(joined) + ", cells array<bigint>")
    return celled.select("*", F.posexplode("cells").alias("way", "cell")).drop("cells")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows are compared when their labels are equal and not null and their vectors
    have the same dimension. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do rows without a vec_id (their
    component is null and they are kept). n_links counts the other rows linked
    with; rows that share a vec_id are rows of their own that share a component.
    An empty table gives no rows; other columns are ignored.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    usable = usable & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", "label", usable.alias("usable"))
    keys = (F.xxhash64("embedding").alias("key_a"), F.xxhash64(F.lit(1), "embedding").alias("key_b"))
    own = rows.filter("usable").select("vec_id", "label", *keys, "embedding")

    classes = own.groupBy("label", "key_a", "key_b").agg(
        F.min("vec_id").alias("cid"), F.count("*").alias("rows"), F.first("embedding").alias("vector")
    )
    classes = checkpointed(classes.withColumn("dim", F.size("vector")))
    celled = _with_cells(classes, cosine)

    place = ["label", "dim", "way", "cell"]
    blocks = celled.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    blocks = checkpointed(blocks.filter("n > 1").drop("n"))
    dealt = celled.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("key_a", "key_b"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.withColumn("side", (F.col("block") != F.col("low")).cast("int")).drop("block", "other", "blocks")
    label = vectors.schema["label"].dataType.simpleString()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"label {label}, key_a bigint, key_b bigint, cid {kind}, links bigint, root {kind}"
    found = dealt.groupBy(*place, "low", "high").applyInArrow(_block_task(cosine), schema)
    found = checkpointed(found)

    of_class = found.groupBy("label", "key_a", "key_b").agg(F.sum("links").alias("links"))
    of_class = classes.select("label", "key_a", "key_b", "cid", "rows").join(of_class, ["label", "key_a", "key_b"], "left")
    members = own.drop("embedding").join(checkpointed(of_class), ["label", "key_a", "key_b"])
    links = (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")
    members = checkpointed(members.select("vec_id", "cid", links))
    edges = members.select(F.col("vec_id").alias("a"), F.col("cid").alias("b")).unionByName(
        found.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    )
    joined = components(edges).withColumnRenamed("id", "vec_id")

    alone = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"))
    out = members.drop("cid").unionByName(alone).join(joined, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
