"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Every text becomes the set of its distinct word shingles and, from it, the
   minima of HASHES hash functions. BANDS keys of ROWS minima each propose
   candidates; the low BITS of every minimum, packed into longs, estimate the
   similarity of a pair by counting equal groups of bits, corrected for groups
   that are equal by chance.
2. Documents with equal sets form one class; all that follows is between
   classes. The classes of a bucket (equal band key) are compared with the
   bucket's smallest class, which is linear however large the bucket is, and
   links confirmed so far are joined into components.
3. What is left are pairs in one bucket whose components still differ. Each
   bucket's largest component needs no comparison within itself: the other
   rows of the bucket meet all of its rows, with estimates from SHARP_HASHES
   one-bit minima. First each row is confirmed against
   the likeliest row of every other component, which settles most; then, with
   the components of that, all pairs that are left.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**32, 5 in
a million; the cut on estimates lies over four standard deviations below
the threshold. No bucket is capped, and a pair is given up only if its classes
are in one component already.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import checkpointed, map_slices
from .words import mixed, shingle_hashes, word_hashes

ROWS = 4
BANDS = 32
HASHES = 256  # the bands take the first ROWS * BANDS of them, estimates all
BITS = 4
LIKELY = 0.63  # estimates from here on are confirmed; 0.75 less 4.25 standard deviations of 0.028
SHARP_HASHES = 2048  # of one bit each, for the rows of buckets that hold several components
SHARP_LIKELY = 0.687  # 0.75 less 4.3 standard deviations of 0.0146
MATCH_PERCENT = 75
SET_SHINGLES = 1 << 22
BUCKET_BLOCK = 2048
SET_BLOCK = 512
CHUNK = 4096


def _functions(number: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    odd = random.integers(1, 2**31, size=number, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, random.integers(0, 2**32, size=number, dtype=np.uint32)


_FUNCTIONS = _functions(HASHES, 20240307)
_SHARP_FUNCTIONS = _functions(SHARP_HASHES, 20240308)


def minima(values: np.ndarray, sizes: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _FUNCTIONS) -> np.ndarray:
    """The minima of all hash functions over each row's set, one row of numbers for each; empty sets have the greatest number."""
    multiply, add = functions
    number = len(multiply)
    out = np.full((len(sizes), number), np.iinfo(np.uint32).max, dtype=np.uint32)
    ends = np.cumsum(sizes)
    high = (values >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(values), CHUNK):
        stop = min(start + CHUNK, len(values))
        rows = np.searchsorted(ends, np.arange(start, stop), side="right")
        first, at = np.unique(rows, return_index=True)
        a = high[start:stop]
        for k in range(number):
            x = a * multiply[k]
            x += add[k]
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            out[first, k] = np.minimum(out[first, k], np.minimum.reduceat(x, at))
    return out


def packed_bits(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` of every minimum, packed into signed longs."""
    low = (mins & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(mins), -1, 64 // bits)
    places = np.arange(0, 64, bits, dtype=np.uint64)
    return np.bitwise_or.reduce(low << places, axis=2).astype(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One long for each band, different bands never meaning the same key on purpose."""
    grouped = mins[:, : BANDS * ROWS].astype(np.uint64).reshape(len(mins), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(mins), BANDS)).copy()
    for row in range(ROWS):
        key = mixed(key ^ grouped[:, :, row]) + np.uint64(row)
    return key.astype(np.int64)


def _set_digest(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs that are equal for equal sets."""
    starts = np.cumsum(sizes) - sizes
    filled = sizes > 0
    out = np.zeros((2, len(sizes)), dtype=np.uint64)
    if len(values):
        for k, salt in enumerate((np.uint64(0x1234567), np.uint64(0x89ABCDEF01))):
            out[k, filled] = np.add.reduceat(mixed(values ^ salt), starts[filled])
    return out[0].astype(np.int64), out[1].astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (equal for equal sets), bits, bands; one row for each input row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values, sizes = shingle_hashes(*word_hashes(part.column("__text")))
        mins = minima(values, sizes)
        set_a, set_b = _set_digest(values, sizes)
        lists = [pa.array(list(x), type=pa.list_(pa.int64())) for x in (packed_bits(mins), band_keys(mins))]
        return pa.RecordBatch.from_arrays(
            [part.column("__id"), pa.array(sizes), pa.array(set_a), pa.array(set_b), *lists],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bits", "bands"],
        )

    rows = docs.select(docs["doc_id"].cast("bigint").alias("__id"), docs["text"].alias("__text"))
    schema = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bits array<bigint>, bands array<bigint>"
    return map_slices(rows, run, schema, "__text")


def _texts_of(docs: DataFrame, wanted: DataFrame, of_sets, name: str) -> DataFrame:
    """(class, name) for the classes in ``wanted`` (class, set_a, set_b), by ``of_sets`` of their shingles, taken from the texts anew."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values, sizes = shingle_hashes(*word_hashes(part.column("__text")))
        set_a, set_b = _set_digest(values, sizes)
        own = pa.array((set_a == part.column("set_a").to_numpy()) & (set_b == part.column("set_b").to_numpy()))
        return pa.RecordBatch.from_arrays([part.column("class"), of_sets(values, sizes)], names=["class", name]).filter(own)

    rows = docs.select(docs["doc_id"].cast("bigint").alias("class"), docs["text"].alias("__text")).join(wanted, "class")
    # Repeated rows give a class its value more than once.
    found = map_slices(rows, run, f"class bigint, {name} array<bigint>", "__text")
    return checkpointed(found.groupBy("class").agg(F.first(name).alias(name)))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles)"""

    def whole(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))

    return _texts_of(docs, wanted, whole, "shingles")


def sharp_bits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, sharp): one bit of each of SHARP_HASHES minima."""

    def sharp(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.array(list(packed_bits(minima(values, sizes, _SHARP_FUNCTIONS), 1)), type=pa.list_(pa.int64()))

    return _texts_of(docs, wanted, sharp, "sharp")


def estimated(left: Column, right: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from packed bits: the share of equal groups, less those equal by chance."""
    low_bits = sum(1 << place for place in range(0, 63, bits))
    low_bits |= -(1 << 63) if bits == 1 else 0
    different = F.lit(0)
    for i in range(hashes * bits // 64):
        x = left[i].bitwiseXOR(right[i])
        for shift in (1 << k for k in range(bits.bit_length() - 1)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        different = different + F.bit_count(x.bitwiseAND(F.lit(low_bits)))
    by_chance = 1.0 / (1 << bits)
    return ((1 - different / hashes) - by_chance) / (1 - by_chance)


def confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets have 100 * intersection >= 75 * union.

    Pairs are dealt by locality: those whose first ends lie in one of the blocks of about SET_BLOCK
    classes go together, in as many tasks as keep the sets of their second ends under
    about SET_SHINGLES numbers. A set moves once to a task, and a class that is the first end of very many pairs
    is spread.
    """
    pairs = checkpointed(pairs)
    ends = checkpointed(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
    sets = full_sets(docs, classes.join(ends, "class", "left_semi").select("class", "set_a", "set_b"))
    blocks = F.lit(math.ceil(ends.count() / SET_BLOCK) or 1)
    placed = pairs.select("a", "b", F.pmod(F.xxhash64("a"), blocks).alias("p"))
    seconds = placed.select("p", F.col("b").alias("class")).distinct().join(sets.select("class", F.size("shingles").alias("n")), "class")
    tasks = seconds.groupBy("p").agg(F.ceil(F.sum("n") / SET_SHINGLES).alias("tasks"))
    placed = placed.join(checkpointed(tasks), "p").withColumn("q", F.pmod(F.xxhash64(F.lit(1), "b"), F.greatest("tasks", F.lit(1)))).drop("tasks")
    placed = checkpointed(placed)
    needed = placed.select("p", "q", F.col("a").alias("class")).union(placed.select("p", "q", "b"))
    needed = needed.distinct().toDF("of_p", "of_q", "class")

    def compare(pairs_here: pa.Table, sets_here: pa.Table) -> pa.Table:
        numbers = sets_here["class"].to_pylist()
        of = dict(zip(numbers, sets_here["shingles"].combine_chunks().to_numpy(zero_copy_only=False))) if numbers else {}
        keep = []
        for a, b in zip(pairs_here["a"].to_pylist(), pairs_here["b"].to_pylist()):
            shared = len(np.intersect1d(of[a], of[b], assume_unique=True))
            keep.append(100 * shared >= MATCH_PERCENT * (len(of[a]) + len(of[b]) - shared))
        return pairs_here.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    both = placed.groupBy("p", "q").cogroup(needed.join(sets, "class").groupBy("of_p", "of_q"))
    return both.applyInArrow(compare, "a bigint, b bigint")


def _open_rows(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, class, component, largest, blocks) of the buckets that hold several components; largest is that with most rows there, blocks how many parts of about BUCKET_BLOCK rows it has."""
    placed = buckets.join(joined.withColumnRenamed("id", "class"), "class", "left")
    placed = checkpointed(placed.select("key", "class", F.coalesce("component", "class").alias("component")))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    parts = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("rows"))
    blocks = F.ceil(F.col("rows") / BUCKET_BLOCK).cast("int").alias("blocks")
    open_keys = checkpointed(parts.filter("parts > 1").select("key", F.col("largest.component").alias("largest"), blocks))
    return checkpointed(placed.join(open_keys, "key"))


def _across(rows: DataFrame, signed: DataFrame, likeliest_only: bool) -> DataFrame:
    """Likely pairs (a, b) of one bucket whose components differ; or of each class only the likeliest of every other component.

    The rows of a bucket are cut into blocks, and each pair of blocks is joined by itself, so that
    a bucket of any size is spread over tasks.
    """
    rows = rows.join(signed, "class").withColumn("block", F.pmod(F.xxhash64("class", "key"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = rows.filter("component != largest").select(
        "key", F.col("block").alias("block_a"), every.alias("block_b"), *(F.col(c).alias(n) for c, n in (("class", "a"), ("component", "part_a"), ("sharp", "sharp_a"), ("bands", "bands_a")))
    )
    any_ = rows.select(
        "key", F.col("block").alias("block_b"), every.alias("block_a"), "largest", *(F.col(c).alias(n) for c, n in (("class", "b"), ("component", "part_b"), ("sharp", "sharp_b"), ("bands", "bands_b")))
    )
    # Two rows outside the largest component would meet twice in a bucket, and a pair in each bucket that it shares.
    once = (F.col("part_b") == F.col("largest")) | (F.col("a") < F.col("b"))
    shared = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True)
    first = shared == F.array_position("bands_a", F.col("key"))
    similarity = estimated(F.col("sharp_a"), F.col("sharp_b"), SHARP_HASHES, 1)
    pairs = one.join(any_, ["key", "block_a", "block_b"]).filter((F.col("part_a") != F.col("part_b")) & once & (similarity >= SHARP_LIKELY) & first)
    if likeliest_only:
        best = F.max(F.struct(similarity.alias("similarity"), "b")).alias("best")
        pairs = pairs.groupBy("a", "part_b").agg(best).select("a", F.col("best.b").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links lead to. Texts without words
    (null and empty ones among them) have no shingle and link with nothing. Rows
    that share a doc_id count as one document with all of their texts. Rows
    without a doc_id link with nothing: their component is null and they are
    kept. An empty table gives no rows; other columns are ignored.
    """
    found = checkpointed(signatures(docs))
    linkable = found.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))

    equal_sets = linkable.groupBy("set_a", "set_b").agg(
        F.min(F.struct("doc_id", "bits", "bands")).alias("smallest")
    )
    classes = checkpointed(
        equal_sets.select("set_a", "set_b", F.col("smallest.doc_id").alias("class"), "smallest.bits", "smallest.bands")
    )
    members = linkable.join(classes.select("set_a", "set_b", "class"), ["set_a", "set_b"])
    same_set = members.filter(F.col("doc_id") != F.col("class")).select(F.col("class").alias("a"), F.col("doc_id").alias("b"))
    same_set = checkpointed(same_set)

    banded = classes.select("class", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("class").alias("head"), F.count("*").alias("n")).filter("n > 1")
    buckets = checkpointed(banded.join(checkpointed(shared.select("key", "head")), "key"))

    bits = classes.select("class", "bits")
    bits_of = lambda end: bits.select(F.col("class").alias(end), F.col("bits").alias(f"bits_{end}"))
    likely = estimated(F.col("bits_a"), F.col("bits_b")) >= LIKELY

    starred = buckets.filter("class != head").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    starred = starred.join(bits_of("a"), "a").join(bits_of("b"), "b").filter(likely).select("a", "b")
    links = checkpointed(confirmed(docs, starred, classes).unionByName(same_set))
    joined = components(links)

    signed = None
    for likeliest_only in (True, False):
        rows = _open_rows(buckets, joined)
        if rows.isEmpty():
            break
        if signed is None:
            open_classes = classes.join(rows.select("class").distinct(), "class", "left_semi")
            sharp = sharp_bits(docs, open_classes.select("class", "set_a", "set_b"))
            signed = checkpointed(classes.select("class", "bands").join(sharp, "class"))
        more = checkpointed(confirmed(docs, _across(rows, signed, likeliest_only), classes))
        if not more.isEmpty():
            roots = joined.select(F.col("component").alias("a"), F.col("id").alias("b"))
            joined = components(roots.unionByName(more))

    out = found.select("doc_id", "n_shingles").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with their columns.

    Rows that repeat a kept document's id count as copies of it: one of them
    stays, that with the smallest text, then the smallest other columns.
    """
    groups = near_duplicates(docs).filter("kept")
    ids = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows"))
    # The ids that are kept grow with the corpus, so they are never broadcast.
    rows = docs.join(checkpointed(ids).hint("merge"), "doc_id", "left")
    single = rows.filter((F.col("__rows") == 1) | F.col("doc_id").isNull())
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    repeated = rows.filter("__rows > 1").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("__row"))
    repeated = repeated.select("doc_id", "__row.*")
    return single.select(*docs.columns).unionByName(repeated.select(*docs.columns))
