"""The prefix trie of rebuilt conversations, by collapsing whole sequences.

A prefix is known by its depth and 128 bits: the exclusive or, over its turns, of hashes of each turn's place, role and
text. So keys of all prefixes are running values, which ranges of turns find on their own and then shift by what stands
before them; no conversation has to fit into a task. Equal conversations become one sequence with a weight and its list
of ends, sequences that are proper prefixes of others are not leaves, and nodes are weighted sums over sequences.

What a subtree saves is a sum over nodes. Every node is owned by the sequence of its smallest member, and a sequence owns
the end of its path, so the sum follows from plain sums over the sequences below a node: their weighted lengths and the
lengths of what they own. Nothing walks the trie level by level, however deep it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written
from .turns import conversations, in_order

#: Conversations come in families of so many ids, whose first one lends its turns.
FAMILY = 100
#: A conversation takes fewer turns than this from the first of its family.
LENT = 6
#: Bits of the ids that a block of an end list holds.
BLOCK_BITS = 12
NODE = ["depth", "k1", "k2"]
SPAN = 33


def _bits(digest: Column, half: int) -> Column:
    return F.conv(F.substring(digest, 1 + 16 * half, 16), 16, -10).cast("long")


def _totals(rows: DataFrame) -> DataFrame:
    """Of each piece (conv_id, piece): what its rows add up to, and what the conversation's pieces before it do."""
    sums = rows.groupBy("conv_id", "piece").agg(F.count("*").alias("n"), F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.sum("length").alias("sum"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    prior = [F.coalesce(f.over(before), F.lit(0)).alias(name) for f, name in ((F.bit_xor("s1"), "o1"), (F.bit_xor("s2"), "o2"), (F.sum("sum"), "o"))]
    return sums.select("*", *prior)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all rebuilt conversations, and their ids.

    Rows have conv_id, depth (from 1), piece (a part of the conversation that one task may hold), x1 and x2 (hashes of
    place, role and text), and length (code points of the text). Ids have conv_id; rebuilt conversations may be turnless.
    """
    said = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    brief = in_order(said).select("conv_id", "at", F.shiftright("at", SPAN).alias("piece"), digest.alias("d"), F.length("text").cast("long").alias("length"))
    brief = written(brief.select("conv_id", "at", "piece", _bits(F.col("d"), 0).alias("t1"), _bits(F.col("d"), 1).alias("t2"), "length"))
    own = Window.partitionBy("conv_id")
    pieces = brief.groupBy("conv_id", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    pieces = written(pieces.select("*", F.coalesce(F.sum("n").over(own.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total")))
    placed = brief.join(pieces.select("conv_id", "piece", "first", "before"), ["conv_id", "piece"]).select("conv_id", "piece", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "t1", "t2", "length")
    ids = pieces.groupBy("conv_id").agg(F.max("total").alias("total"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = ids.where(F.col("conv_id") == family).select(F.col("conv_id").alias("family"), F.col("total").alias("there"))
    ids = ids.withColumn("family", family).withColumn("asked", F.crc32(F.col("conv_id").cast("string")) % LENT).join(heads, "family", "left")
    ids = written(ids.select("conv_id", "family", "asked", F.least("asked", F.coalesce("there", F.lit(0))).alias("lent")))
    kept = placed.join(ids.select("conv_id", "asked", "lent"), "conv_id").where(F.col("place") > F.col("asked")).withColumn("depth", F.col("place") - F.col("asked") + F.col("lent"))
    lenders = placed.where((F.col("conv_id") == family) & (F.col("place") < LENT)).select(F.col("conv_id").alias("family"), F.col("place").alias("depth"), "t1", "t2", "length")
    taken = ids.where("lent > 0").join(lenders, "family").where("depth <= lent").withColumn("piece", F.lit(-1).cast("long"))
    columns = ["conv_id", "piece", "depth", F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("x1"), F.xxhash64(F.lit(2), "depth", "t2", "t1").alias("x2"), "length"]
    rows = written(kept.select(*columns).unionByName(taken.select(*columns)))
    dropped(brief, pieces)
    return rows, ids.select("conv_id")


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of end lists from their blocks, which come sorted; only the hash of one list is held."""
    last, state, out = None, None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True))
        for key, ids in zip(keys, batch.column("ids").to_pylist(), strict=True):
            if key == last:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((*last, state.hexdigest()))
            last, state = key, hashlib.sha256(ids.encode())
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])
            out = []
    if state is not None:
        out.append((*last, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])


def end_lists(ends: DataFrame) -> DataFrame:
    """Of each node where conversations end (depth, k1, k2, conv_id): ends_sha256, the hash of their ids in order.

    Lists are cut into blocks of 4096 ids by ranges. Most lists are one block; the others are hashed block by block, so a
    list of any length costs its task a row for each 4096 ids and no memory.
    """
    ranged = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = written(written(ranged).groupBy(*NODE, "block").agg(listed.alias("ids")))
    lists = blocks.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    short = lists.where("n = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    long = blocks.join(lists.where("n > 1").select(*NODE), NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return short.unionByName(long.mapInArrow(_streamed, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), ties by role and text; a repeated row is a turn of its own. Null roles and
    texts count as empty. Rows without a conv_id take no part. A table without conversations has no node, not even a
    root. Other columns of `turns`, whatever their names, are not looked at.
    """
    rows, ids = rebuilt(turns)
    totals = written(_totals(rows))
    along = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("*", F.bit_xor("x1").over(along).alias("w1"), F.bit_xor("x2").over(along).alias("w2"), F.sum("length").over(along).alias("w"))
    paths = running.join(totals.select("conv_id", "piece", "o1", "o2", "o"), ["conv_id", "piece"]).select(
        F.col("conv_id").alias("rep"), "depth", F.col("w1").bitwiseXOR(F.col("o1")).alias("k1"), F.col("w2").bitwiseXOR(F.col("o2")).alias("k2"),
        "x1", "x2", "length", (F.col("w") + F.col("o") - F.col("length")).alias("prior"),
    )
    whole = totals.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("s1").alias("k1"), F.bit_xor("s2").alias("k2"), F.sum("sum").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ends = written(ids.join(whole, "conv_id", "left").select("conv_id", *map(zero, [*NODE, "total"])))
    sequences = written(ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep"), F.max("total").alias("total")))

    none = F.lit(0).cast("long")
    roots = sequences.select("rep", "weight", F.col("depth").alias("stop"), "total", *[none.alias(c) for c in [*NODE, "x1", "x2", "length", "prior"]])
    weighted = paths.join(sequences.select("rep", "weight", F.col("depth").alias("stop"), "total"), "rep").select(*roots.columns)
    weighted = written(weighted.unionByName(roots))
    owners = weighted.groupBy(*NODE).agg(F.min("rep").alias("rep"), F.max("length").alias("length"), F.max(F.col("stop") > F.col("depth")).alias("longer"))
    owners = written(owners)
    leaves = sequences.join(owners.where("longer"), NODE, "left_anti").select("rep", F.lit(1).alias("leaf"))
    owned = owners.groupBy("rep").agg(F.sum("length").alias("owned"))
    shares = sequences.select("rep").join(owned, "rep", "left").join(leaves, "rep", "left").select("rep", *map(zero, ["owned", "leaf"]))

    nodes = weighted.join(shares, "rep").groupBy(*NODE).agg(
        F.min(F.struct("rep", "total", "owned")).alias("first"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * F.col("total")).alias("lengths"),
        F.sum("owned").alias("owned"), F.sum("leaf").cast("long").alias("n_leaves"), F.max("prior").alias("prior"), F.max("x1").alias("x1"), F.max("x2").alias("x2"),
    )
    # All turns of members from here on, less each distinct one once.
    once = F.col("owned") - F.col("first.owned") + F.col("first.total") - F.col("prior")
    saved = F.col("lengths") - F.col("n_convs") * F.col("prior") - once
    above = [(F.col("depth") - 1).alias("depth"), F.col("k1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("k2")]
    nodes = written(nodes.select(*NODE, F.col("first.rep").alias("conv_id"), "n_convs", "n_leaves", saved.alias("saved_tokens"), F.when(F.col("depth") > 0, F.struct(*above)).alias("above")))
    dropped(rows, totals, sequences, weighted, owners)
    below = nodes.where("depth > 0").groupBy(*[F.col("above")[c].alias(c) for c in NODE]).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.struct(*NODE).alias("above"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, "above", "left").join(below, NODE, "left").join(end_lists(ends.select(*NODE, "conv_id")), NODE, "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every node; ties, nulls and empty tables as prefix_trie() says."""
    return prefix_trie(conversations(spark, sf_dir))


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string in DuckDB, bit by bit."""
    bit = "xor(y >> 1, (y & 1) * 3988292384)"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT), lambda c, x: list_reduce([xor(c, x)] || range(8), lambda y, i: {bit})), 4294967295)"


OP11_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
s AS (SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.own, r.pos) FILTER (r.own IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM s),
q AS (SELECT conv_id, n, depth, turns[1:depth] AS node, CASE WHEN depth > 0 THEN turns[1:depth - 1] END AS parent, coalesce(length(turns[depth].text), 0) AS size FROM p),
v AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY depth, node),
k AS (SELECT parent, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY parent),
w AS (SELECT v.*, coalesce(k.n_children, 0) AS n_children FROM v LEFT JOIN k ON k.parent = v.node),
b AS (SELECT a.node, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.size) AS saved FROM w a JOIN w d ON d.depth >= a.depth AND d.node[1:a.depth] = a.node GROUP BY a.node)
SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, w.ends_sha256 FROM w JOIN b ON b.node = w.node LEFT JOIN w u ON u.node = w.parent AND w.depth > 0
"""
