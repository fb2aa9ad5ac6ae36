"""Conversation prefixes as a trie, by prefix-doubling naming.

A conversation is a row of turns. Equal turns get one number, and level by level a block of 2^k turns that begins at a
multiple of 2^k gets a number for the pair of its halves' numbers, equal pairs the same one. A prefix of d turns falls
into one such block for each binary digit of d, so its name is the number of the pair (name of the prefix without its last
block, number of that block), and all prefixes are named in as many rounds as a length has digits. Rows with one name are
one node of the trie. No conversation is held as a whole: every step works on rows of one turn, block or prefix.

Numbers are dense: places in the table of different pairs, as prefix sums over its parts have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.llm.shared import Scratch, parts

#: Ids joined into one piece of a long list of members that is digested, and turns summed in one go along a conversation.
PIECE = 4096
SPAN = 1024
#: The place of a row in its partition, from monotonically_increasing_id (a fixed value of Spark's).
PLACE = (1 << 33) - 1
WORDS = r"[^\x20\x09-\x0D]+"
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def dense_names(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The different rows of a table, with a number each from 0 on, in the column name."""
    columns = pairs.columns
    listed = scratch.table(pairs.distinct().withColumn("at", F.monotonically_increasing_id()), "different")
    sizes = listed.groupBy(F.expr("at >> 33").alias("part")).agg(F.count("*").alias("n"))
    # One row for each partition that was written.
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = listed.withColumn("part", F.expr("at >> 33")).join(F.broadcast(before), "part")
    return named.select(*columns, (F.col("before") + F.col("at").bitwiseAND(PLACE)).alias("name"))


def numbered_turns(spark: SparkSession, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, key, words): each conversation's turns from 0 on. turns: (conv, turn, role, text).

    Turns are ordered by a range shuffle and numbered by their place in a partition; where a conversation spans several
    partitions, the partitions' counts are summed. key is a digest of role and text.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ordered = turns.repartitionByRange(2 * parts(spark), *order).sortWithinPartitions(*order)
    placed = scratch.table(ordered.select("conv", key.alias("key"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("at")), "turns")
    stretches = placed.groupBy("conv", F.expr("at >> 33").alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    stretches = stretches.select("conv", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.withColumn("part", F.expr("at >> 33")).join(stretches, ["conv", "part"]).select("conv", F.expr("at - first + before").alias("pos"), "key", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after exchanging beginnings: conversation c begins with the first h turns of conversation
    c - c % group, h being crc32 of c's digits modulo most, and goes on with its own turns after its first h."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    convs = turns.select("conv").distinct().select("conv", h, F.expr(f"conv - conv % {group}").alias("base"))
    heads = turns.where(F.col("pos") < most - 1).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
    begun = convs.join(heads, "base", "left").select("conv", "h", F.expr("slice(coalesce(head, array()), 1, cast(h AS int))").alias("head"))
    own = turns.join(begun.select("conv", "h", F.size("head").alias("lead")), "conv").where("pos >= h").select("conv", F.expr("pos - h + lead").alias("pos"), "key", "words")
    first = begun.select("conv", F.explode("head").alias("t")).select("conv", "t.pos", "t.key", "t.words")
    return convs.select("conv"), own.unionByName(first)


def named_prefixes(spark: SparkSession, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, d, name) for the prefixes of d = 1, 2, ... turns: of the same d, those of one name are equal, and no others.
    turns: (conv, pos, key), pos from 0 on without gaps."""
    names = dense_names(turns.select("key"), scratch)
    levels = [scratch.table(turns.join(names, "key").select("conv", F.col("pos").alias("j"), "name"), "level0")]
    while True:  # halves: a block of 2^k turns is whole if both of its halves are there
        halves = levels[-1].groupBy("conv", F.expr("j >> 1").alias("j")).agg(F.min(F.struct("j", "name")).alias("a"), F.max(F.struct("j", "name")).alias("b"))
        pairs = scratch.table(halves.where("a.j < b.j").selectExpr("conv", "j", "a.name AS a", "b.name AS b"), "halves")
        if pairs.isEmpty():
            break
        levels.append(scratch.table(pairs.join(dense_names(pairs.select("a", "b"), scratch), ["a", "b"]).select("conv", "j", "name"), f"level{len(levels)}"))
        scratch.drop(pairs)
    # The longest blocks first: prefix m = (2 t + 1) 2^k is prefix 2 t 2^k and the block with number 2 t of level k.
    found: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        blocks = levels[k].where("j % 2 = 0").select("conv", F.expr(f"shiftleft(j, {k})").alias("d"), F.col("name").alias("b"))
        whole = blocks.where("d = 0").select("conv", F.lit(1 << k).cast("long").alias("d"), F.col("b").alias("name"))
        found.append(scratch.table(whole, "prefix"))
        if len(found) > 1:
            pairs = scratch.table(reduce(DataFrame.unionByName, found[:-1]).withColumnRenamed("name", "a").join(blocks, ["conv", "d"]), "ends")
            if not pairs.isEmpty():
                named = pairs.join(dense_names(pairs.select("a", "b"), scratch), ["a", "b"])
                # Names of pairs and of whole blocks never meet: one has lengths that are powers of two.
                found.append(scratch.table(named.select("conv", F.expr(f"d + {1 << k}").alias("d"), "name"), "prefix"))
            scratch.drop(pairs)
    return reduce(DataFrame.unionByName, found)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of each node's pieces; rows are sorted by node and piece, and one piece is held at a time."""
    node, sha = None, None
    for rb in batches:
        out = []
        for d, name, piece in zip(rb.column("d").to_pylist(), rb.column("name").to_pylist(), rb.column("piece")):
            if (d, name) != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (d, name), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.as_buffer())
        if out:
            yield _ends(out)
    if node is not None:
        yield _ends([(*node, sha.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["d", "name", "ends_sha256"])


def digests_of_members(spark: SparkSession, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, name, ends_sha256) for members (d, name, conv): the digest of a node's conversation ids, ascending, in decimal
    digits joined by commas. Ids are ordered by a range shuffle and joined in pieces of PIECE; a node of several pieces is
    digested as they come."""
    order = ["d", "name", "conv"]
    ordered = members.repartitionByRange(2 * parts(spark), *order).sortWithinPartitions(*order)
    placed = scratch.table(ordered.select(*order, F.monotonically_increasing_id().alias("at")), "members")
    pieces = placed.groupBy("d", "name", F.expr(f"at DIV {PIECE}").alias("at")).agg(F.concat_ws(",", F.array_sort(F.collect_list("conv")).cast("array<string>")).alias("piece"))
    pieces = scratch.table(pieces, "pieces")
    several = pieces.groupBy("d", "name").agg(F.count("*").alias("n"))
    rows = pieces.join(several, ["d", "name"])
    one = rows.where("n = 1").select("d", "name", F.sha2("piece", 256).alias("ends_sha256"))
    many = rows.where("n > 1").select("d", "name", "at", F.col("piece").cast("binary").alias("piece")).repartition("d", "name").sortWithinPartitions("d", "name", "at")
    return one.unionByName(many.mapInArrow(_digested, "d long, name long, ends_sha256 string"))


def summed_below(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of each conversation's rows (conv, d, ...), the columns' sums over that row and those of greater d, in spans of
    SPAN rows, so that no task sums a long conversation alone."""
    spanned = rows.withColumn("span", F.expr(f"d DIV {SPAN}"))
    inner = Window.partitionBy("conv", "span").orderBy(F.col("d").desc())
    outer = Window.partitionBy("conv").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = spanned.where(f"n >= {SPAN}").groupBy("conv", "span").agg(*(F.sum(c).alias(c) for c in columns))
    later = totals.select("conv", "span", *(F.sum(c).over(outer).alias(f"later_{c}") for c in columns))
    within = spanned.select("*", *(F.sum(c).over(inner).alias(f"sum_{c}") for c in columns)).join(later, ["conv", "span"], "left")
    return within.select(*rows.columns, *((F.col(f"sum_{c}") + F.coalesce(f"later_{c}", F.lit(0))).alias(f"below_{c}") for c in columns))


def trie_nodes(spark: SparkSession, convs: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of conversations (conv) with turns (conv, pos, key, words): NODES."""
    turns = scratch.table(turns, "rebuilt")
    prefixes = turns.select("conv", F.expr("pos + 1").alias("d"), "words").join(named_prefixes(spark, turns.select("conv", "pos", "key"), scratch), ["conv", "d"])
    lengths = convs.join(turns.groupBy("conv").agg(F.count("*").alias("n")), "conv", "left").select("conv", F.coalesce("n", F.lit(0)).alias("n"))
    root = lengths.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("name"), "n")
    rows = scratch.table(prefixes.join(lengths, "conv").select(root.columns).unionByName(root), "prefixes")
    # A node stands at its smallest member's row of that depth.
    nodes = rows.groupBy("d", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("n").alias("longest"))
    placed = rows.join(nodes.select("conv", "d", "n_convs", "longest"), ["conv", "d"], "left")
    marked = placed.selectExpr("conv", "d", "name", "n", "n_convs IS NOT NULL AS own", "coalesce((n_convs - 1) * words, 0) AS saved", "if(longest = d, 1L, 0L) AS leaf")
    below = scratch.table(summed_below(marked, ["saved", "leaf"]), "below")
    # The row of the next depth: is there a node of its own, a child? That before: the name of the parent.
    shifted = below.select("conv", F.expr("d + 1").alias("d"), F.col("name").alias("parent_name"))
    own = below.where("own AND d > 0").select("conv", "d").join(shifted, ["conv", "d"])
    children = scratch.table(own.selectExpr("conv", "d", "d - 1 AS parent_d", "parent_name"), "children")
    counted = children.groupBy(F.col("parent_d").alias("d"), F.col("parent_name").alias("name")).agg(F.count("*").alias("n_children"))
    full = below.groupBy("d", "name").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("below_leaf").alias("n_leaves"), F.sum("below_saved").alias("saved_tokens"))
    ends = digests_of_members(spark, rows.where("d = n").select("d", "name", "conv"), scratch)
    full = scratch.table(full.join(counted, ["d", "name"], "left").join(ends, ["d", "name"], "left"), "nodes")
    parents = full.select(F.col("d").alias("parent_d"), F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    # Many children may have one parent: a join that Spark can split.
    linked = children.join(parents, ["parent_d", "parent_name"]).select(F.col("conv").alias("conv_id"), "d", "parent_conv_id")
    none = hashlib.sha256(b"").hexdigest()
    filled = full.join(linked, ["conv_id", "d"], "left").withColumnRenamed("d", "depth")
    return filled.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(none))}).select(NODES)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of any table of conversations; null role or text becomes empty."""
    empty = F.lit("")
    columns = [F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")]
    return conversations.select(*columns).where("conv IS NOT NULL")


def prefix_trie(spark: SparkSession, conversations: DataFrame, exchange: bool = False) -> DataFrame:
    """The trie of conversations' prefixes: a row for each different sequence of first turns (role, text), NODES.

    Turns are ordered by turn, null first, ties by role and then text; repeated rows are turns of their own. Null role or
    text counts as empty. Rows without conv_id belong to no conversation and are left out. Texts of any length count by
    their digest and their words. An empty table has no node, not even a root; other columns are left out. exchange: the
    beginnings of conversations are exchanged first (rebuilt).
    """
    scratch = Scratch(spark, "trie")
    turns = scratch.table(numbered_turns(spark, turn_rows(conversations), scratch), "numbered")
    convs, turns = rebuilt(turns) if exchange else (turns.select("conv").distinct(), turns)
    return trie_nodes(spark, convs, turns, scratch)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), exchange=True)


#: The trie by the turns themselves: lists of (role, text) as keys; crc32 bit by bit.
ORACLE = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS l FROM t GROUP BY c),
h AS (SELECT c, l, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT) % 4 AS h FROM own),
re AS (SELECT h.c, list_concat(list_slice(coalesce(b.l, []), 1, h.h::BIGINT), list_slice(h.l, h.h::BIGINT + 1, len(h.l))) AS l FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
p AS (SELECT c, d, list_slice(l, 1, d) AS p, len(l) AS n FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM re)),
node AS (SELECT d, p, min(c) AS c, count(*) AS k, max(n) = d AS leaf,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(p[d].x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS v,
  sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS e FROM p GROUP BY d, p),
up AS (SELECT list_slice(p, 1, a) AS p, v, leaf FROM (SELECT p, v, leaf, unnest(range(0, d + 1)) AS a FROM node)),
sums AS (SELECT p, sum(v) AS v, count(*) FILTER (leaf) AS leaves FROM up GROUP BY p),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL)
SELECT node.c AS conv_id, node.d AS depth, parent.c AS parent_conv_id, node.k AS n_convs, coalesce(kids.kids, 0) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves,
  CAST(sums.v AS BIGINT) AS saved_tokens, node.e AS ends_sha256
FROM node JOIN sums ON sums.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node parent ON node.d > 0 AND parent.p = list_slice(node.p, 1, node.d - 1)
"""
