"""Exact top-k search by refining histograms of scores.

Queries and candidates are packed into blocks, and every block of queries meets
every block of candidates: one matrix product scores all of their pairs. No
score is stored. Each round counts, for every query, how many scores fall into
each of BINS equal bins of its current range, adds the counts up over all
blocks and narrows the range to the bin that holds the k-th greatest score. A
range of one value is the k-th score itself. A last pass keeps the scores
above it and, of those equal to it, as many as are still needed, by the
smaller id.

A block only reports bins from its own k-th greatest score up: below it no bin
can hold the overall one. So a round moves at most k counts for each query and
block of candidates.

Products are taken in double precision where that is exact, and of long vectors
or large components in whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

SCALE = 1024
BINS = 1 << 14
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 16384
EXACT = 1 << 52  # sums up to it are exact in double precision, with a bit to spare for the rounding of the bound
SCORED_AT_ONCE = 64


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): usable vectors as floor(SCALE * x) doubles, one for each vec_id.

    Left out are rows without a vec_id, null vectors and those that hold null
    or non-finite components. Of rows that share a vec_id the smallest vector
    counts. A finite component that is no bigint after scaling is an error, as
    it is in SQL.
    """

    def scale(v: Column) -> Column:
        product = v.cast("double") * SCALE
        said = F.concat(F.lit("A component of vector "), F.col("vec_id").cast("string"), F.lit(f" times {SCALE} is no bigint."))
        return F.when(F.abs(product) < float(1 << 63), F.floor(product).cast("double")).otherwise(F.raise_error(said).cast("double"))

    x = F.transform("embedding", scale)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", x.alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt to ``blocks`` blocks by a hash of their id, each block's vectors of one dimension packed into one row.

    Columns: dim, block, ids (in order) and matrix, as bytes of longs and of ints, or longs where a component needs them.
    """

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        ids = table["vec_id"].to_numpy().astype(np.int64)
        matrix = np.stack(table["vector"].to_numpy(zero_copy_only=False))
        matrix = matrix.astype(np.int32 if np.abs(matrix).max(initial=0) < 1 << 31 else np.int64)
        packed = {"dim": table["dim"][:1], "block": table["block"][:1]}
        return pa.table(packed | {"ids": pa.array([ids.tobytes()]), "matrix": pa.array([matrix.tobytes()])})

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    rows = rows.select(F.size("vector").alias("dim"), block.alias("block"), F.col("vec_id").cast("bigint"), "vector")
    schema = "dim int, block int, ids binary, matrix binary"
    return checkpointed(rows.groupBy("dim", "block").applyInArrow(pack, schema))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    kind = np.int32 if len(row["matrix"]) == 4 * len(ids) * row["dim"] else np.int64
    matrix = np.frombuffer(row["matrix"], dtype=kind).reshape(len(ids), row["dim"])
    return ids, matrix.astype(np.float64)


def _scores(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray):
    """(positions of queries, their scores, a mask of what is not the query itself), some queries at a time."""
    largest = np.maximum(candidates.max(axis=1, initial=0), -candidates.min(axis=1, initial=0))
    for start in range(0, len(q_ids), SCORED_AT_ONCE):
        at = np.arange(start, min(start + SCORED_AT_ONCE, len(q_ids)))
        asked, others = queries[at], q_ids[at][:, None] != c_ids[None, :]
        scores = asked @ candidates.T
        wide = np.flatnonzero(largest * (np.abs(asked).max(initial=0) * asked.shape[1]) > EXACT)
        if len(wide):
            scores[:, wide] = 0
        scores = scores.astype(np.int64)
        if len(wide):
            scores[:, wide] = _whole_scores(q_ids[at], asked, c_ids[wide], candidates[wide], others[:, wide])
        yield at, scores, others


def _whole_scores(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact products modulo 2**64, which are the products themselves: one between ``others`` that is no bigint is an error."""
    sizes = np.abs(queries) @ np.abs(candidates).T
    off = sizes * (queries.shape[1] + 4) / (1 << 52)  # more than the error of the product in double precision
    for i, j in np.argwhere(others & (np.abs(queries @ candidates.T) + off >= float(1 << 63))).tolist():
        score = sum(int(a) * int(b) for a, b in zip(queries[i].tolist(), candidates[j].tolist()))
        if not -(1 << 63) <= score < 1 << 63:
            raise OverflowError(f"The score of vectors {q_ids[i]} and {c_ids[j]} is no bigint.")
    return queries.astype(np.int64) @ candidates.astype(np.int64).T


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query with all other vectors.

    Queries are the rows whose vec_id is divisible by ``every``. Ties go to the
    smaller vec_id. With fewer than k candidates all are returned; a query without
    any has no row. Vectors of different dimensions have no product and are not compared;
    see ``scaled`` for rows that take no part. Other columns are ignored.
    """
    usable = checkpointed(scaled(vectors))
    asked = usable.filter(F.col("vec_id") % every == 0)
    candidate_blocks = math.ceil(usable.count() / CANDIDATE_BLOCK) or 1
    candidates = _packed(usable, candidate_blocks)
    queries = _packed(asked, math.ceil(asked.count() / QUERY_BLOCK) or 1)

    def pairs(asking: DataFrame) -> DataFrame:
        """Every block of queries beside every block of candidates of its dimension."""
        own = candidates.withColumnsRenamed({"block": "c_block", "ids": "c_ids", "matrix": "c_matrix"})
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1)))
        return asking.withColumn("c_block", everywhere).join(own, ["dim", "c_block"])

    def with_state(state: DataFrame) -> DataFrame:
        """Blocks of queries with the present range of each query."""
        owned = queries.mapInArrow(_ids, "dim int, block int, query_id bigint").join(state, "query_id")
        each = F.struct("query_id", "low", "high", "need")
        return queries.join(owned.groupBy("dim", "block").agg(F.collect_list(each).alias("state")), ["dim", "block"])

    def measured(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _unpacked(row)
                c_ids, c = _unpacked({"ids": row["c_ids"], "matrix": row["c_matrix"], "dim": row["dim"]})
                for at, scores, others in _scores(q_ids, q, c_ids, c):
                    least = np.where(others, scores, np.iinfo(np.int64).max).min(axis=1)
                    most = np.where(others, scores, np.iinfo(np.int64).min).max(axis=1)
                    n = others.sum(axis=1)
                    some = n > 0
                    arrays = [pa.array(x[some]) for x in (q_ids[at], least, most, n)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "low", "high", "n"])

    ranges = pairs(queries).mapInArrow(measured, "query_id bigint, low bigint, high bigint, n bigint")
    ranges = ranges.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    # need: the rank, from the top of the range, of the score that is looked for.
    state = ranges.select("query_id", "low", "high", F.least("n", F.lit(k).cast("bigint")).alias("need"))
    state = checkpointed(state)
    while not state.filter("low < high").isEmpty():
        counts = pairs(with_state(state)).mapInArrow(_histograms(k), "query_id bigint, bin int, n bigint")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # At most k bins of a query hold one of its k greatest scores and are read from the top.
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        read = counts.withColumn("above", above).join(state, "query_id")
        hit = read.filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
        # A range and its bins may go beyond a bigint, their ends that are kept do not.
        wider = {c: F.col(c).cast("decimal(20,0)") for c in ("low", "high")}
        hit = hit.withColumns(wider).withColumn("width", F.expr(f"cast((high - low) div {BINS} + 1 as decimal(20,0))"))
        low = F.col("low") + F.col("bin") * F.col("width")
        high = F.least(F.col("high"), low + F.col("width") - 1)
        state = checkpointed(
            hit.select("query_id", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), (F.col("need") - F.col("above")).alias("need"))
        )

    found = pairs(with_state(state)).mapInArrow(_kept(k), "query_id bigint, vec_id bigint, score bigint")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids(batches):
    for batch in batches:
        for row in batch.select(["dim", "block", "ids"]).to_pylist():
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            dim, block = (pa.array(np.full(len(ids), row[c], dtype=np.int32)) for c in ("dim", "block"))
            yield pa.RecordBatch.from_arrays([dim, block, pa.array(ids)], names=["dim", "block", "query_id"])


def _query_state(row: dict):
    """Scorable queries of a pair of blocks: ids, vectors and their state, in order of id."""
    q_ids, q = _unpacked(row)
    c_ids, c = _unpacked({"ids": row["c_ids"], "matrix": row["c_matrix"], "dim": row["dim"]})
    state = {s["query_id"]: (s["low"], s["high"], s["need"]) for s in row["state"]}
    known = np.array([i in state for i in q_ids.tolist()], dtype=bool)
    values = np.array([state[i] for i in q_ids[known].tolist()], dtype=np.int64).reshape(-1, 3)
    return q_ids[known], q[known], c_ids, c, values


def _histograms(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, c_ids, c, values = _query_state(row)
                for at, scores, others in _scores(q_ids, q, c_ids, c):
                    low, high = values[at, 0][:, None], values[at, 1][:, None]
                    # Differences of longs may only fit without a sign.
                    base = low.astype(np.uint64)
                    width = (high.astype(np.uint64) - base) // BINS + 1
                    bin_of = ((scores.astype(np.uint64) - base) // width).astype(np.int64)
                    bins = np.where(others & (scores >= low) & (scores <= high), bin_of, -1)
                    kth = np.partition(bins, max(bins.shape[1] - k, 0), axis=1)[:, max(bins.shape[1] - k, 0)]
                    i, j = np.nonzero((bins >= 0) & (bins >= kth[:, None]))
                    codes, n = np.unique(i * BINS + bins[i, j], return_counts=True)
                    arrays = [pa.array(q_ids[at][codes // BINS]), pa.array((codes % BINS).astype(np.int32)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "bin", "n"])

    return run


def _kept(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, c_ids, c, values = _query_state(row)
                for at, scores, others in _scores(q_ids, q, c_ids, c):
                    kth, need = values[at, 0][:, None], values[at, 2][:, None]
                    equal = others & (scores == kth)
                    # Candidates are in order of id: the first ones of equal score are the smallest.
                    taken = (others & (scores > kth)) | (equal & (np.cumsum(equal, axis=1) <= need))
                    i, j = np.nonzero(taken)
                    arrays = [pa.array(q_ids[at][i]), pa.array(c_ids[j]), pa.array(scores[i, j])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run
