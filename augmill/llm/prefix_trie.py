"""Conversation prefix trie by ROLLUP over positional turn-id columns.

A turn's id is the first 128 bits of the SHA-256 of its role and text, with its number of
words. Conversations become rows of blocks of ``WIDTH`` turns: the block's number, the key of
the node that the block starts from, and its turn ids in columns t1..tWIDTH. One

    GROUP BY block, start, ROLLUP(t1, ..., tWIDTH)

aggregates all prefixes of all blocks together; grouping_id tells a prefix's length, so that a
column that is empty because a conversation has ended isn't taken for one rolled up. Long
conversations go on in further blocks, keyed by the node that the block before ended in. A
node's key is its depth and the 128-bit XOR of hashes of its turns and their positions, which a
running window gives for every turn; so a block's start is known from the conversation alone,
and no loop over blocks, and no join of one block to the next, is needed.

Sums over subtrees come from a second ROLLUP over the same rows: each node belongs to its
smallest member, which passes through all its ancestors, so a subtree's sum is the sum of
what the members own in this depth or below. Leaves count at the conversation that owns them.

The ids of conversations that end in a node are joined in ranges of 4,096 ids before they
move, and hashed as a stream in order: no list of them is ever held.

Edge cases: rows with a null conv_id belong to no conversation and are left out; null roles and
texts are ''; null turns come first; turns of equal number are ordered by their id, and repeated
rows are turns of their own; a conversation without rebuilt turns ends in the root; an empty
table has no node. Other columns aren't read and may clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augmill.sources.tables import load

from .common import stored
from .registry import register

#: Turns of a block, and positional columns of the ROLLUP.
WIDTH = 8
#: Conversation ids whose decimals are joined before they move: 2 to this power.
RANGE_BITS = 12

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "ka", "kb"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, turn_id struct<h, words>): the turns of every conversation in order, from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    read = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.struct(F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, 16).alias("h"),
                 F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")).alias("turn_id"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_id.h")
    return read.select("conv_id", F.row_number().over(order).cast("bigint").alias("nth"), "turn_id")


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, part, nth, turn_id): each conversation as the first h turns of conversation c - c % 20 (part 0),
    then its own after the first h (part 1), after a row without a turn (part -1); h = crc32(c) % 4."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    heads = own.where("conv_id % 20 = 0 AND nth <= 3").groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("nth", "turn_id"))).alias("head"))
    convs = own.select("conv_id").distinct()
    first = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).where(h > 0).join(heads, "base").select(
        "conv_id", F.explode(F.slice("head", F.lit(1), h.cast("int"))).alias("x"))
    part = F.lit
    return (convs.select("conv_id", part(-1).alias("part"), F.lit(0).cast("bigint").alias("nth"),
                         F.lit(None).cast(own.schema["turn_id"].dataType).alias("turn_id"))
            .unionByName(first.select("conv_id", part(0).alias("part"), "x.nth", "x.turn_id"))
            .unionByName(own.where(F.col("nth") > h).select("conv_id", part(1).alias("part"), "nth", "turn_id")))


def _hash(seed: int, depth: Column, turn_id: Column) -> Column:
    return F.when(turn_id.isNotNull(), F.xxhash64(F.lit(seed), depth, turn_id["h"])).otherwise(F.lit(0).cast("bigint"))


def paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, ka, kb, turn_id, hash_a, hash_b, last): every turn of every sequence (conv_id, part, nth,
    turn_id) with the key of the node it leads to, and whether the sequence ends there."""
    order = Window.partitionBy("conv_id").orderBy("part", "nth")
    at = sequences.select("conv_id", "turn_id", "part", "nth", (F.row_number().over(order) - 1).cast("bigint").alias("depth"),
                          F.lead("part").over(order).isNull().alias("last"))
    at = at.withColumn("hash_a", _hash(1, F.col("depth"), F.col("turn_id"))).withColumn("hash_b", _hash(2, F.col("depth"), F.col("turn_id")))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at.select("conv_id", "depth", F.bit_xor("hash_a").over(so_far).alias("ka"), F.bit_xor("hash_b").over(so_far).alias("kb"),
                     "turn_id", "hash_a", "hash_b", "last")


def blocks(path: DataFrame, width: int) -> DataFrame:
    """(conv_id, block, start_a, start_b, t1..t<width>): a row per conversation and block of its path."""
    begun = (F.col("depth") - 1) % width == 0
    cells = [F.max(F.when((F.col("depth") - 1) % width == i, F.col("turn_id"))).alias(f"t{i + 1}") for i in range(width)]
    return path.groupBy("conv_id", F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / width)).cast("bigint").alias("block")).agg(
        F.coalesce(F.max(F.when(begun, F.col("ka").bitwiseXOR(F.col("hash_a")))), F.lit(0)).alias("start_a"),
        F.coalesce(F.max(F.when(begun, F.col("kb").bitwiseXOR(F.col("hash_b")))), F.lit(0)).alias("start_b"), *cells)


def prefixes(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """(level, turn_id, KEY, up_a, up_b, aggregates): every node of every block, with the key of its parent."""
    t = ", ".join(f"t{i + 1}" for i in range(width))
    rolled = rows.sparkSession.sql(
        f"SELECT block, start_a, start_b, {t}, CAST({width} - bit_count(grouping_id()) AS INT) AS level, {aggregates} "
        f"FROM {{rows}} GROUP BY block, start_a, start_b, ROLLUP({t})", rows=rows)
    cells = [F.col(f"t{i + 1}") for i in range(width)]
    end = F.when(F.col("level") > 0, F.element_at(F.array(*cells), F.col("level")))
    nodes = rolled.withColumn("turn_id", end).where("turn_id IS NOT NULL OR (level = 0 AND block = 0)")
    nodes = nodes.withColumn("depth", F.col("block") * width + F.col("level"))
    for key, start, seed in (("ka", "start_a", 1), ("kb", "start_b", 2)):
        all_of = F.col(start)
        for i, cell in enumerate(cells):
            all_of = all_of.bitwiseXOR(_hash(seed, F.col("block") * width + F.lit(i + 1), cell))
        nodes = nodes.withColumn(key, all_of)
    nodes = nodes.withColumn("up_a", F.col("ka").bitwiseXOR(_hash(1, F.col("depth"), F.col("turn_id"))))
    nodes = nodes.withColumn("up_b", F.col("kb").bitwiseXOR(_hash(2, F.col("depth"), F.col("turn_id"))))
    return nodes.drop("start_a", "start_b", *[f"t{i + 1}" for i in range(width)])


def _hashed(batches):
    """Rows (KEY, ids) in order of key and ids -> (KEY, ends_sha256), one stream of ids per key."""
    key, digest = None, None
    for batch in batches:
        out = []
        for *at, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = at, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield _ended(out)
    if key is not None:
        yield _ended([(*key, digest.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*KEY, "ends_sha256"])


def ends(path: DataFrame) -> DataFrame:
    """(KEY, ends_sha256): per node in which conversations end, the SHA-256 of their decimal ids in ascending order."""
    ranges = path.where("last").groupBy(*KEY, F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = ranges.repartition(*KEY).sortWithinPartitions(*KEY, "range")
    return ordered.select(*KEY, "ids").mapInArrow(_hashed, "depth bigint, ka bigint, kb bigint, ends_sha256 string")


def trie(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """All nodes of the trie of the sequences (conv_id, part, nth, turn_id), in which every conversation has
    a row of part -1 without a turn: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256). The call itself writes the paths, the blocks and the nodes to the shared folder."""
    path = stored(paths(sequences), "trie-paths")
    rows = stored(blocks(path, width), "trie-blocks")

    counted = stored(prefixes(rows, width, "count(*) AS n_convs, min(conv_id) AS conv_id").select(
        *KEY, "up_a", "up_b", "conv_id", "n_convs", F.coalesce("turn_id.words", F.lit(0)).alias("words")), "trie-nodes")
    below = counted.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("ka"), F.col("up_b").alias("kb")).agg(
        F.count("*").alias("n_children"))
    above = counted.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("up_a"), F.col("kb").alias("up_b"),
                           F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(counted.join(below, KEY, "left").join(above, ["depth", "up_a", "up_b"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    # what a conversation owns in each block, behind it, and whether it owns a leaf
    cell = (F.col("depth") - 1) % width
    gain = (F.col("n_convs") - 1) * F.col("words")
    owned = nodes.groupBy("conv_id", F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / width)).cast("bigint").alias("block")).agg(
        *[F.sum(F.when(cell == i, gain)).alias(f"x{i + 1}") for i in range(width)], F.sum(gain).alias("gain"),
        F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    every = [f"x{i + 1}" for i in range(width)]
    shares = rows.join(owned, ["conv_id", "block"], "left").select(
        *rows.columns, *[F.coalesce(x, F.lit(0)).alias(x) for x in every],
        F.coalesce(F.sum("gain").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rest"),
        F.coalesce(F.sum("leaf").over(Window.partitionBy("conv_id")), F.lit(0)).alias("leaf"))
    sums = ", ".join(f"sum({x}) AS {x}" for x in [*every, "rest", "leaf"])
    saved = F.col("rest")
    for i, x in enumerate(every):
        saved = saved + F.when(F.col("level") <= i + 1, F.col(x)).otherwise(0)
    below = prefixes(shares, width, sums).select(*KEY, F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"))

    whole = nodes.join(below, KEY).join(ends(path), KEY, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


SQL = r"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT conv_id, list({'role': role, 'text': text}
      ORDER BY turn ASC NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS own FROM t GROUP BY conv_id),
  h AS (SELECT conv_id, own, conv_id - conv_id % 20 AS base, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(
      [xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 4)::BIGINT AS h FROM own),
  r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS r
      FROM h LEFT JOIN own b ON b.conv_id = h.base),
  pre AS (SELECT conv_id, len(r) AS n, d, r[1:d] AS p FROM (SELECT conv_id, r, unnest(range(0, len(r) + 1)) AS d FROM r)),
  node AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
      coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM pre GROUP BY p, d),
  kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
  whole AS (SELECT node.*, coalesce(kids.n_children, 0) AS n_children, CASE WHEN node.depth > 0 THEN (node.n_convs - 1)
      * len(regexp_extract_all(node.p[node.depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS gain
      FROM node LEFT JOIN kids ON kids.p = node.p AND kids.depth = node.depth),
  sub AS (SELECT p[1:a] AS p, a AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(gain) AS saved_tokens
      FROM (SELECT p, n_children, gain, unnest(range(0, depth + 1)) AS a FROM whole) GROUP BY ALL)
SELECT whole.conv_id, whole.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, whole.n_convs::BIGINT AS n_convs,
  whole.n_children::BIGINT AS n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens::BIGINT AS saved_tokens,
  sha256(whole.ends) AS ends_sha256
FROM whole JOIN sub ON sub.p = whole.p AND sub.depth = whole.depth
LEFT JOIN node up ON whole.depth > 0 AND up.depth = whole.depth - 1 AND up.p = whole.p[1:whole.depth - 1]
"""


@register("op11_prefix_trie", SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(stored(turns(load(spark, sf_dir, "conversations")), "turns")))
