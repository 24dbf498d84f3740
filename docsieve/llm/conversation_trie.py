"""A prefix trie of conversations, made by merging partial tries.

A node is a sequence of first turns. Its key is the exclusive or of 128-bit digests of (place, role, text), which any part of a conversation adds to alone, so
a conversation of any length is keyed in blocks of turns that Spark deals out. A partial trie is a table of nodes by key, with members, smallest member and
the list of conversations that end there; two are merged by adding up rows of one key. Each partition combines its own rows, a first merge goes by key and a
share of the conversations, the next by key alone, so that a node that all conversations share costs a task a few rows of each partition. End lists are kept in
blocks of BLOCK ids and are hashed as a stream of blocks.

The roll-up goes from below: the nodes that have one conversation as smallest member are a chain down to its end. A chain's leaf and its saved tokens are added up
from its end, and the whole of it is added to each node above its top, which are nodes of its conversation's own path; so every path node gets one row a chain,
added up by key. Nothing depends on how deep chains hang on each other, and there is no loop over depths.

Defined cases: turns are in order of turn (null first), then role, then text, by bytes; null role or text is empty. Equal rows are turns each. Rows without a
conv_id take no part. Remainders have the sign of the dividend. An empty table has no nodes; else there is a root. Columns beside these four aren't read. Texts
of any length are digested whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm import shared

#: Ids of a block of an end list, and turns of a block of a conversation, as bits.
BLOCK = 12
#: Parts of a node's rows in the first merge.
FAN = 16
_KEY = ["depth", "k1", "k2"]
_HEAD = "array<struct<place:bigint,g1:bigint,g2:bigint,size:bigint>>"


def _block(column: str) -> Column:
    return F.shiftright(F.col(column).cast("long"), BLOCK)


def _digest(place: str) -> list[Column]:
    """Digest of a turn at a place, as two columns."""
    return [F.xxhash64(F.col(place).cast("long"), "t1", "t2").alias("g1"), F.xxhash64("t2", F.col(place).cast("long"), "t1").alias("g2")]


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 1, t1, t2, size): each conversation's turns in order. Ranges of the sorted table are counted each; a conversation may lie in many."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "__place"]
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")), F.monotonically_increasing_id().alias("__place")
    )
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = shared.written(
        dealt.select("conv_id", F.monotonically_increasing_id().alias("seq"), F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.length("text").cast("long").alias("size")).withColumn(
            "part", F.shiftright("seq", 33)
        ),
        "turns",
    )
    parts = turns.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", (F.col("first") - before).alias("zero"))
    return turns.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("seq") - F.col("zero") + 1).alias("rank"), "t1", "t2", "size")


def _totals_before(rows: DataFrame, block: str, sums: dict[str, Column], backwards: bool) -> DataFrame:
    """For each (conv_id, block) the sums over the conversation's blocks before it (or behind it); blocks without any are left out."""
    totals = rows.groupBy("conv_id", block).agg(*(c.alias(name) for name, c in sums.items()))
    order = Window.partitionBy("conv_id").orderBy(F.desc(block) if backwards else F.asc(block)).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.bit_xor if not backwards else F.sum
    found = totals.select("conv_id", block, *(whole(name).over(order).alias(f"before_{name}") for name in sums))
    return found.where(F.col(f"before_{next(iter(sums))}").isNotNull())


def paths(turns: DataFrame, heads: str, base: str, most_heads: int) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, size, last): the nodes on each conversation's path. p1 and p2 are the parent's key, last tells the path's end.

    A conversation is rebuilt from the first `heads` turns of conversation `base` and its own turns after as many; both are SQL over conv_id, heads at most most_heads.
    """
    convs = turns.groupBy("conv_id").agg(F.max("rank").alias("n_own")).select("conv_id", "n_own", F.expr(heads).cast("long").alias("h"), F.expr(base).cast("long").alias("base"))
    based = convs.select("base").distinct()
    first = turns.where(F.col("rank") <= most_heads).withColumnRenamed("conv_id", "base").join(based, "base", "left_semi")
    first = first.groupBy("base").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("place"), *_digest("rank"), "size"))).alias("first"))
    head = F.slice(F.coalesce("first", F.expr(f"cast(array() AS {_HEAD})")), F.lit(1), F.col("h").cast("int"))
    convs = convs.join(first, "base", "left").withColumn("head", head)
    convs = convs.withColumn("total", F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).select("conv_id", "n_own", "h", "head", "total")
    convs = shared.written(convs, "conversations")

    xor = lambda k, upto: f"aggregate(slice(head, 1, {upto}), 0L, (s, x) -> s ^ x.g{k})"
    node = f"""named_struct('depth', cast(i AS bigint), 'k1', {xor(1, 'i')}, 'k2', {xor(2, 'i')}, 'p1', {xor(1, 'greatest(i - 1, 0)')}, 'p2', {xor(2, 'greatest(i - 1, 0)')},
        'size', if(i = 0, 0L, head[i - 1].size), 'last', i = total)"""
    shared_part = convs.select("conv_id", F.expr(f"inline(transform(sequence(0, size(head)), i -> {node}))"))

    salted = convs.select("conv_id", "h", "total", F.size("head").alias("m"), F.expr(xor(1, "size(head)")).alias("x1"), F.expr(xor(2, "size(head)")).alias("x2"), F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("n_own", BLOCK))).alias("block"))
    own = turns.withColumn("block", _block("rank")).join(salted, ["conv_id", "block"]).where("rank > h").withColumn("depth", F.col("rank") - F.col("h") + F.col("m"))
    own = own.select("conv_id", "block", "depth", *_digest("depth"), "size", "x1", "x2", "total")
    before = _totals_before(own, "block", {"g1": F.bit_xor("g1"), "g2": F.bit_xor("g2")}, False)
    order = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = own.select("*", *(F.bit_xor(f"g{k}").over(order).bitwiseXOR(F.col(f"x{k}")).alias(f"r{k}") for k in (1, 2)))
    keyed = keyed.join(before, ["conv_id", "block"], "left")
    keys = [F.col(f"r{k}").bitwiseXOR(F.coalesce(f"before_g{k}", F.lit(0).cast("long"))) for k in (1, 2)]
    own_part = keyed.select("conv_id", "depth", *(x.alias(f"k{k}") for k, x in enumerate(keys, 1)), *(x.bitwiseXOR(F.col(f"g{k}")).alias(f"p{k}") for k, x in enumerate(keys, 1)), "size", (F.col("depth") == F.col("total")).alias("last"))
    return shared_part.unionByName(own_part)


def merged(tables: DataFrame, *salt: str) -> DataFrame:
    """Partial tries added up by key (and salt): members, smallest member. Rows of one partition are combined before they are shuffled."""
    whole = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *(F.max(c).alias(c) for c in ("p1", "p2", "size"))]
    return tables.groupBy(*_KEY, *salt).agg(*whole)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's end list, from blocks in order of nodes and ids; one block is held at a time."""
    key, digest = None, None
    names = [*_KEY, "ends_sha256"]
    for batch in batches:
        done = []
        for *own, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=names)


def ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which paths end."""
    blocks = rows.where("last").groupBy(*_KEY, _block("conv_id").alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    dealt = blocks.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")).repartition(*_KEY).sortWithinPartitions(*_KEY, "block")
    return dealt.select(*_KEY, "ids").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


@shared.tidy
def trie(conversations: DataFrame, heads: str = "0", base: str = "conv_id", most_heads: int = 0) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A node is named by conv_id and depth."""
    turns = shared.written(ordered(conversations), "ordered")
    rows = shared.written(paths(turns, heads, base, most_heads), "paths")
    tables = rows.select("*", F.lit(1).cast("long").alias("n_convs"), F.pmod("conv_id", F.lit(FAN)).alias("salt"))
    nodes = shared.written(merged(merged(tables, "salt")), "nodes")
    above = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(above, _KEY, "left").join(ends(rows), _KEY, "left")
    own = (F.col("n_convs") - 1) * F.col("size")
    nodes = shared.written(nodes.fillna({"n_children": 0, "ends_sha256": hashlib.sha256(b"").hexdigest()}).withColumn("own_saved", own).withColumn("own_leaf", (F.col("n_children") == 0).cast("long")), "counted")

    chains = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.sum("own_saved").alias("up_saved"), F.sum("own_leaf").alias("up_leaves"))
    chains = shared.written(chains.select("conv_id", "top.*", "up_saved", "up_leaves").where("depth > 0"), "chains")
    salted = chains.select("conv_id", F.col("depth").alias("top"), "up_saved", "up_leaves", F.explode(F.sequence(F.lit(0).cast("long"), _block("depth"))).alias("block"))
    up = rows.select("conv_id", *_KEY, _block("depth").alias("block")).join(salted, ["conv_id", "block"]).where("depth < top")
    up = up.groupBy(*_KEY).agg(F.sum("up_saved").alias("up_saved"), F.sum("up_leaves").alias("up_leaves"))

    parent_key = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    tops = chains.select("conv_id", F.col("depth").alias("top"), *parent_key)
    parents = shared.lookup(tops, nodes.select(*_KEY, F.col("conv_id").alias("parent_conv_id"), "n_children"), _KEY, "n_children").select("conv_id", F.col("top").alias("depth"), "parent_conv_id")

    placed = nodes.withColumn("block", _block("depth"))
    behind = _totals_before(placed, "block", {"saved": F.sum("own_saved"), "leaf": F.sum("own_leaf")}, True)
    order = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", F.sum("own_saved").over(order).alias("down_saved"), F.sum("own_leaf").over(order).alias("down_leaves")).join(behind, ["conv_id", "block"], "left")
    found = summed.join(up, _KEY, "left").join(parents, ["conv_id", "depth"], "left")
    add = lambda *names: sum((F.coalesce(x, F.lit(0)) for x in names[1:]), F.col(names[0]))
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        add("down_leaves", "before_leaf", "up_leaves").alias("n_leaves"), add("down_saved", "before_saved", "up_saved").alias("saved_tokens"), "ends_sha256",
    )


def op11(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt: heads of up to five turns come from the first conversation of each hundred."""
    return trie(conversations, "crc32(cast(cast(conv_id AS string) AS binary)) % 6", "conv_id - conv_id % 100", 5)
