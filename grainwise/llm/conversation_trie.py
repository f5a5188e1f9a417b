"""The prefix trie of conversations, by ROLLUP over positional turn ids.

A turn's id is two numbers: a hash of role and text, and half of another one packed with
the number of code points of the text. A conversation is laid out in blocks of WIDTH
turns, one row a block, with the ids of its turns in positional columns; one

    GROUP BY prior node, ROLLUP((turn 1), ..., (turn WIDTH))

aggregates all prefixes of all blocks together, and grouping_id tells the depth. A long
conversation goes on in further rows, each keyed by the node at which the block before it
ends. A node's key is the exclusive or of a hash of (depth, turn) over its path, so
the keys of all blocks are running totals and no block waits for another one's result.

The smallest member of a node names it. Along a conversation's path, the nodes that
it names are those from some depth to its end. What has to be added up over a
subtree is therefore booked on the conversations that name its nodes, and a second ROLLUP adds
it up over members:

* leaves: a conversation counts 1 if it names a childless node;
* saved tokens: a conversation counts all that its nodes save. Its nodes above the
  one in question are its ancestors, and only the node's own name can name those: what it
  saves above is taken off again, as a running total along its path.

No step gathers a conversation, a node's members or its children in one task: turns are
numbered along a global sort, running totals are taken over spans of SPAN rows in
levels, joins on a conversation or a parent are split by chunk or salt, and the ids that end at a
node are joined to strings where they are sorted and digested from those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

WIDTH = 8
SPAN = 1024
CHUNK = 4096
SALTS = 256
JOINED_IDS = 8192
LENGTH_BITS = (1 << 31) - 1


def _turn_ids() -> tuple[Column, Column]:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    other = F.xxhash64(F.lit(1), role, text).bitwiseAND(F.lit(~LENGTH_BITS))
    return F.xxhash64(role, text).alias("a"), other.bitwiseOR(F.length(text).cast("bigint")).alias("b")


def _link(seed: int, depth, a, b) -> Column:
    """What a turn at a depth adds to the key of its node."""
    return F.xxhash64(F.lit(seed), F.col(depth) if isinstance(depth, str) else depth, a, b)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), a, b of every turn, by turn (null first), ties by role and then by hash."""
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), *_turn_ids())
    ordered = ids.filter("conv_id is not null").orderBy("conv_id", F.asc_nulls_first("turn"), "role", "a", "b").select("conv_id", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, counted = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            place = np.arange(len(conv))
            fresh = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            local = place - np.maximum.accumulate(np.where(fresh, place, 0)) + 1
            if not fresh[0]:
                goes_on = len(conv) if not fresh.any() else int(np.argmax(fresh))
                local[:goes_on] += counted
            last, counted = conv[-1], int(local[-1])
            columns = [*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "a", "b", "part", "local"])

    rows = checkpointed(ordered.mapInArrow(run, "conv_id bigint, a bigint, b bigint, part int, local bigint"))
    # A part goes on with at most one conversation of the parts before it, its first one.
    per_part = rows.groupBy("conv_id", "part").agg(F.max("local").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = per_part.select("conv_id", "part", before.alias("before")).filter("before is not null")
    depth = F.col("local") + F.coalesce("before", F.lit(0))
    return rows.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", depth.alias("depth"), "a", "b")


def rebuilt(turns: DataFrame, shared: Column, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``shared`` turns of the first one of their group, followed by their own after as many.

    ``turns`` are numbered turns; ``shared`` is a small number worked out from conv_id. Returns
    the turns so numbered and one row (conv_id, turns) for each conversation, turnless ones included.
    """
    turns = checkpointed(turns)
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    lengths = checkpointed(turns.groupBy("conv_id").agg(F.max("depth").alias("own")))
    convs = lengths.select("conv_id", "own", shared.cast("bigint").alias("h"), base)
    most = convs.agg(F.max("h")).first()[0] or 0
    first = lengths.select(F.col("conv_id").alias("base"), F.least("own", F.lit(most)).alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(first, "base", "left").select("conv_id", "base", "own", "h", taken.alias("taken"))
    convs = checkpointed(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))

    heads = turns.filter((F.col("depth") <= most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    copied = convs.filter("taken > 0").select("conv_id", "base", "taken").join(heads, "base").filter("depth <= taken")
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"own div {CHUNK}"))).alias("chunk")
    own = turns.withColumn("chunk", F.expr(f"depth div {CHUNK}")).join(convs.select("conv_id", "h", "taken", chunks), ["conv_id", "chunk"])
    own = own.filter("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "depth", "a", "b"]
    return copied.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id", "turns")


def running(df: DataFrame, key: str, index: str, columns: list[str], total, most: int) -> DataFrame:
    """Add before_<column>, the total of the rows of a key with a smaller index (0 without any).

    Indices are unique in a key and ``most`` at most. Windows hold SPAN rows: the totals of spans are
    run in the same way, level by level.
    """
    span = f"{index}_span"
    window = Window.partitionBy(key, span).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(span, F.expr(f"{index} div {SPAN}"))
    here = out.select("*", *(F.coalesce(total(c).over(window), F.lit(0)).alias(f"before_{c}") for c in columns))
    if most < SPAN:
        return here.drop(span)
    spans = out.groupBy(key, span).agg(*(total(c).alias(c) for c in columns))
    above = running(spans, key, span, columns, total, most // SPAN)
    above = above.select(key, span, *(F.col(f"before_{c}").alias(f"above_{c}") for c in columns))
    both = {f"before_{c}": _plus(total, F.col(f"before_{c}"), F.col(f"above_{c}")) for c in columns}
    return here.join(above, [key, span]).withColumns(both).drop(span, *(f"above_{c}" for c in columns))


def _plus(total, x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y) if total is F.bit_xor else x + y


def _blocks(turns: DataFrame, convs: DataFrame, most: int) -> DataFrame:
    """One row for each block of a conversation: positional turn ids, the key of the node before it, what its turns add to that."""
    placed = turns.withColumn("block", F.expr(f"(depth - 1) div {WIDTH}")).withColumn("slot", F.expr(f"(depth - 1) % {WIDTH}"))
    placed = placed.withColumn("link_a", _link(0, "depth", "a", "b")).withColumn("link_b", _link(1, "depth", "a", "b"))
    slots = [F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}{k + 1}") for k in range(WIDTH) for c in "ab"]
    links = [F.bit_xor(c).alias(c) for c in ("link_a", "link_b")]
    blocks = placed.groupBy("conv_id", "block").agg(*slots, *links)
    turnless = convs.filter("turns = 0").select("conv_id", F.lit(0).cast("bigint").alias("block"))
    blocks = blocks.unionByName(turnless.withColumn("link_a", F.lit(0)).withColumn("link_b", F.lit(0)), allowMissingColumns=True)
    return running(blocks, "conv_id", "block", ["link_a", "link_b"], F.bit_xor, most // WIDTH)


def _rolled_up(blocks: DataFrame, measures: str) -> DataFrame:
    """All nodes: key, key of the parent, depth, last turn, and ``measures`` over the members."""
    columns = ", ".join(f"(a{k}, b{k})" for k in range(1, WIDTH + 1))
    # grouping_id has two bits for each turn, set for turns below the node.
    level = " ".join(f"when {(1 << 2 * (WIDTH - k)) - 1} then {k}" for k in range(WIDTH + 1))
    last = {c: " ".join(f"when {k} then {c}{k}" for k in range(1, WIDTH + 1)) for c in "ab"}
    grouped = blocks.sparkSession.sql(
        f"""
        select *, case level {last["a"]} end as a, case level {last["b"]} end as b, block * {WIDTH} + level as depth
        from (
            select block, before_link_a, before_link_b, {", ".join(f"a{k}, b{k}" for k in range(1, WIDTH + 1))},
                case grouping_id() {level} end as level, {measures}
            from {{blocks}}
            group by block, before_link_a, before_link_b, rollup({columns})
        )
        """,
        blocks=blocks,
    )
    nodes = grouped.filter("a is not null or depth = 0")

    def key(seed: int, prior: str) -> tuple[Column, Column]:
        """Of the parent and of the node; deeper turns are null here and add nothing."""
        parent = F.col(prior)
        for k in range(1, WIDTH):
            link = F.when(F.col("level") > k, _link(seed, F.col("block") * WIDTH + k, f"a{k}", f"b{k}"))
            parent = parent.bitwiseXOR(F.coalesce(link, F.lit(0)))
        own = F.when(F.col("depth") > 0, _link(seed, F.col("depth"), "a", "b"))
        return parent, parent.bitwiseXOR(F.coalesce(own, F.lit(0)))

    (parent_a, key_a), (parent_b, key_b) = key(0, "before_link_a"), key(1, "before_link_b")
    drop = ["level", "block", "before_link_a", "before_link_b", *(f"{c}{k}" for k in range(1, WIDTH + 1) for c in "ab")]
    return nodes.select(
        "*", parent_a.alias("parent_a"), parent_b.alias("parent_b"), key_a.alias("key_a"), key_b.alias("key_b")
    ).drop(*drop)


def _ends(blocks: DataFrame) -> DataFrame:
    """key_a, key_b, ends_sha256 of the nodes at which a conversation ends."""
    at_end = blocks.groupBy("conv_id").agg(F.bit_xor("link_a").alias("key_a"), F.bit_xor("link_b").alias("key_b"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (batch.column(c).to_numpy() for c in ("key_a", "key_b", "conv_id"))
            if not len(ids):
                continue
            fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            fresh[::JOINED_IDS] = True
            first = np.flatnonzero(fresh)
            listed = [",".join(map(str, part.tolist())) for part in np.split(ids, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (a, b, ids)] + [pa.array(listed)], names=["key_a", "key_b", "first", "listed"])

    parts = at_end.orderBy("key_a", "key_b", "conv_id").select("key_a", "key_b", "conv_id")
    parts = parts.mapInArrow(join, "key_a bigint, key_b bigint, first bigint, listed string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("ends_sha256", pa.string())])
        node, running_digest = None, None
        for batch in batches:
            out = []
            for a, b, listed in zip(*(batch.column(c).to_pylist() for c in ("key_a", "key_b", "listed"))):
                if (a, b) == node:
                    running_digest.update(b"," + listed.encode())
                    continue
                if node:
                    out.append((*node, running_digest.hexdigest()))
                node, running_digest = (a, b), hashlib.sha256(listed.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, running_digest.hexdigest())))], schema)

    by_node = parts.repartition("key_a", "key_b").sortWithinPartitions("key_a", "key_b", "first").select("key_a", "key_b", "listed")
    return by_node.mapInArrow(digest, "key_a bigint, key_b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns.

    ``turns`` are numbered turns (conv_id, depth, a, b), ``convs`` all conversations (conv_id,
    turns), turnless ones included. Returns conv_id (the smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    last turn's ids a and b (null for the root). Without conversations there is no node.
    """
    most = convs.agg(F.max("turns")).first()[0] or 0
    blocks = checkpointed(_blocks(turns, convs, most))
    key, parent = ["key_a", "key_b"], ["parent_a", "parent_b"]
    nodes = _rolled_up(blocks, "count(*) as n_convs, min(conv_id) as conv_id")
    saves = (F.col("n_convs") - 1) * F.coalesce(F.col("b").bitwiseAND(F.lit(LENGTH_BITS)), F.lit(0))
    nodes = checkpointed(nodes.withColumn("saves", saves).withColumn("salt", F.pmod(F.xxhash64("conv_id", "a", "b"), F.lit(SALTS)).cast("int")))

    # Children of a hot node are counted, and told its name, by salt.
    kids = nodes.filter("depth > 0").groupBy(*parent, "salt").agg(F.count("*").alias("kids"))
    named = nodes.select(F.col("key_a").alias("parent_a"), F.col("key_b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    kids = checkpointed(kids.join(named, parent))
    n_children = kids.groupBy(F.col("parent_a").alias("key_a"), F.col("parent_b").alias("key_b")).agg(F.sum("kids").alias("n_children"))
    above_root = F.col("depth") == 0
    of_parent = kids.select(*parent, "salt", "parent_conv_id", F.lit(False).alias("above_root"))
    nodes = nodes.withColumn("above_root", above_root).join(of_parent, [*parent, "salt", "above_root"], "left").join(n_children, key, "left")
    nodes = checkpointed(nodes.drop("salt", "above_root", *parent).withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    booked = nodes.groupBy("conv_id").agg(F.sum("saves").alias("all_saved"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"greatest(turns - 1, 0) div {WIDTH * CHUNK}"))).alias("chunk")
    booked = booked.join(convs, "conv_id").select("conv_id", "all_saved", "leaf", chunks)
    weighed = blocks.withColumn("chunk", F.expr(f"block div {CHUNK}")).join(booked, ["conv_id", "chunk"], "left")
    sums = _rolled_up(weighed, "sum(coalesce(all_saved, 0)) as all_saved, sum(coalesce(leaf, 0)) as n_leaves")

    out = running(nodes, "conv_id", "depth", ["saves"], F.sum, most)
    out = out.join(sums.select(*key, "all_saved", "n_leaves"), key).join(_ends(blocks), key, "left")
    return out.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("all_saved") - F.col("before_saves")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "a", "b",
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of ``conversations`` (conv_id, turn, role, text), with role and text of each node's last turn.

    Turns come by turn, null first; ties by role, then by a hash. A null role or text is empty. Rows
    without a conv_id are left out, repeated rows are turns of their own, an empty table has no
    node, other columns are ignored. See ``prefix_trie`` for the columns; role and text are null for the root.
    """
    turns = checkpointed(numbered_turns(conversations))
    nodes = prefix_trie(turns, turns.groupBy("conv_id").agg(F.max("depth").alias("turns")))
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    said = conversations.filter("conv_id is not null").select(*_turn_ids(), role, text).dropDuplicates(["a", "b"])
    # A turn that ends a great many nodes is left to the splitting of skewed partitions.
    return nodes.join(said, ["a", "b"], "left").drop("a", "b")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share the first crc32(conv_id) mod 6 turns with the first one of their hundred."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    turns, convs = rebuilt(numbered_turns(conversations), shared)
    return prefix_trie(turns, convs).drop("a", "b")
