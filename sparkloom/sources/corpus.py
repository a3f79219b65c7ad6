"""Corpus files as essays (essay_path, body, content_hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths, text


def files(spark: SparkSession, root: str, folder: str = "content/posts") -> DataFrame:
    """essay_path (from `folder` on) and body, with plain line ends, of all files below `root`."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    return rows.select(F.regexp_extract("file", rf"({folder}/.*)$", 1).alias("essay_path"), text.normalized(F.col("body")).alias("body")).where("essay_path <> ''")


def essays(found: DataFrame, with_archives: bool = False) -> DataFrame:
    """Those in scope, with their hashes; a file that only stands for a body elsewhere gets that body if there is one.

    Of several bodies of one name the .mdx comes first, then .md, then .txt, then the smallest path.
    """
    scope = found.where(paths.in_scope(F.col("essay_path"), with_archives))
    name = F.regexp_extract("essay_path", r"unfolding/((?:activity|chatgpt|gemini)-20\d{2})\.mdx$", 1)
    bodies = found.select(F.regexp_extract("essay_path", r"data/unfolding-[a-z]+/([a-z]+-20\d{2})\.(?:mdx|md|txt)$", 1).alias("__name"), F.col("body").alias("__body"), F.struct(F.array_position(F.array(*[F.lit(e) for e in ("mdx", "md", "txt")]), F.regexp_extract("essay_path", r"\.(\w+)$", 1)).alias("kind"), F.col("essay_path").alias("path")).alias("__order")).where("__name <> ''")
    bodies = bodies.groupBy("__name").agg(F.min_by("__body", "__order").alias("__body"))
    rows = scope.withColumn("__name", name).join(bodies, "__name", "left").withColumn("body", F.coalesce("__body", "body"))
    return rows.select("essay_path", "body", text.content_hash(F.col("body")).alias("content_hash"))


def archives(found: DataFrame) -> DataFrame:
    rows = found.where(paths.is_year_archive(F.col("essay_path")))
    return rows.select("essay_path", paths.slug(F.col("essay_path")).alias("essay_slug"), text.content_hash(F.col("body")).alias("content_hash"))
