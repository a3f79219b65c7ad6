"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source before anything is shuffled, targets come from a table with one row a source, and each
document is then emitted floor(rate) times plus once more when a hash-seeded coin falls below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, free_name, packed_row, written

#: Sources take these weights in turn, by code point, the null source last.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MOST = 3


def sized(docs: DataFrame, text: str = "text", size: str = "__size") -> DataFrame:
    return docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, source: str = "source", size: str = "__size", weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: __source_size, __target and __rate, by weighted shares of the whole with a ceiling.

    A source's ceiling is `most` times its size. Excess over a ceiling is shared again by weight until no target is above
    one, which is the level at which min(ceiling, level * weight) sums to the whole: sources are taken by ceiling over
    weight, and the first k of them are full when the level left for the others stays below the next one's ratio. Levels
    only fall from that k on, so it is the largest of those that stay below.
    Works on one row a source (a partial sum has been made before the shuffle); an empty table gives no rows.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("__source_size"))
    turn = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("__turn", turn).withColumn("__weight", weight).withColumn("__cap", F.col("__source_size").cast("double") * most)
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__weight"), "__turn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("__source_size").over(whole).cast("double") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (
        F.sum("__weight").over(whole) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("__level", level).withColumn("__level", F.when(F.col("__level") <= F.col("__cap") / F.col("__weight"), F.col("__level")))
    per = per.withColumn("__level", F.max("__level").over(whole))
    target = F.coalesce(F.least(F.col("__cap"), F.col("__level") * F.col("__weight")), F.lit(0.0))
    per = per.withColumn("__target", target)
    return per.select(source, "__source_size", "__target", F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0).alias("__rate"))


def coin(*seeds: Column) -> Column:
    """A number in [0, 1) that depends on the seeds only: 48 bits of an MD5 sum."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(s.cast("string"), F.lit("~")) for s in seeds])), 1, 12), 16, 10)
    return bits.cast("double") / float(1 << 48)


def with_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """`docs` with __size, __source_size, __target and __copies, the number of times the mix emits the row.

    Null texts have size 0; null sources are one source; empty texts, and rows of sources without words, are never
    emitted (they add no words). Equal rows share one coin; rows without a key take theirs from the text as well.
    Columns of `docs` with the names of the new ones are replaced. Ties and repeated rows need no order. Any other columns pass
    through. The one join is with a written table of one row a source: its file size is known when the join is planned, so Spark
    broadcasts it only below its size threshold; beyond that adaptive execution splits a hot source.
    """
    rows = sized(docs, text)
    targets = written(source_targets(sized(docs.select(source, text), text), source))
    joined = rows.alias("d").join(targets.withColumnRenamed(source, "__source"), F.col(f"d.{source}").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.col("__rate")
    name = F.col(f"d.{key}")
    toss = F.when(name.isNull(), coin(F.lit(seed), name, F.col(f"d.{text}"))).otherwise(coin(F.lit(seed), name))
    copies = F.floor(rate) + (toss < rate - F.floor(rate)).cast("long")
    return joined.withColumn("__copies", F.when(F.col("__size") > 0, F.coalesce(copies, F.lit(0))).otherwise(0).cast("long"))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The mix itself: each row of `docs` as often as with_copies() says, with the columns of `docs`, whatever their names."""
    row, copy = free_name(docs, "row"), free_name(docs, "copy")
    own = docs.select(*dict.fromkeys([key, text, source]), packed_row(docs).alias(row))
    rows = with_copies(own, key, text, source, seed).where("__copies > 0")
    return rows.select(row, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias(copy)).select(f"{row}.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every document; nulls, ties and empty tables as with_copies() says."""
    rows = with_copies(documents(spark, sf_dir, "doc_id", "text", "source"))
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS turn FROM s),
c AS (SELECT *, (turn % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lev FROM c),
m AS (SELECT *, max(CASE WHEN lev <= cap / weight THEN lev END) OVER () AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, level * weight), 0.0) AS target FROM m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
k AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
  ('0x' || substr(md5('17|' || d.doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS coin
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM k
"""
