"""Heading-aware overlapping chunks. Everything happens inside a row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import paths, text

#: Words of a chunk, and words between the starts of two chunks.
WORDS, STRIDE = 500, 420
#: Characters of a payload's data and of its metadata's text.
DATA_CHARS, TEXT_CHARS = 4000, 2000
HEADING = r"^#{1,6}\s+(.+)"
MARK = "\u0001"


def sections(body: Column) -> Column:
    """array<struct<heading, text>>: lines without front matter, imports, fence marks and markup, cut at headings.

    Each heading line becomes a mark with the heading, so that joining the lines and cutting at the marks gives the
    sections. Sections without text, and those under a comment's heading, are left out.
    """
    lines = F.transform(F.split(F.translate(text.without_front_matter(text.normalized(body)), MARK, " "), "\n"), text.trimmed)
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("import ") & ~x.startswith("```"))
    head = lambda x: text.trimmed(F.regexp_extract(x, HEADING, 1))
    lines = F.transform(lines, lambda x: F.when(x.rlike(HEADING), F.concat(F.lit(MARK), head(x))).otherwise(text.plain_line(x)))
    # a one-element array names the parts, which would otherwise be computed again wherever they occur
    return F.element_at(F.transform(F.array(F.split(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), MARK)), _of_parts), 1)


def _of_parts(parts: Column) -> Column:
    first = F.struct(F.lit(None).cast("string").alias("heading"), F.element_at(parts, 1).alias("text"))
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.substring_index(p, "\n", 1).alias("heading"), F.when(F.contains(p, F.lit("\n")), F.substring(p, F.locate("\n", p) + 1, F.length(p))).otherwise("").alias("text")))
    flat = F.transform(F.concat(F.array(first), rest), lambda s: F.struct(s["heading"].alias("heading"), text.trimmed(F.regexp_replace(s["text"], r"\s+", " ")).alias("text")))
    return F.filter(flat, lambda s: (s["text"] != "") & ~text.is_comment_heading(s["heading"]))


def windows(section: Column) -> Column:
    """A section's chunks: its words are split once and cut many times."""
    return F.element_at(F.transform(F.array(F.split(section["text"], " ")), lambda words: _cut(section["heading"], words)), 1)


def _cut(heading: Column, words: Column) -> Column:
    last = F.ceil(F.greatest(F.lit(0), F.size(words) - WORDS) / STRIDE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(heading.alias("heading"), F.array_join(F.slice(words, i * STRIDE + 1, WORDS), " ").alias("text")))


def chunks(essays: DataFrame, path: str = "essay_path", body: str = "body") -> DataFrame:
    """One row a chunk: essay_path, essay_slug, heading, chunk_index, text, content_hash, token_estimate.

    A body without any text gives no chunk. Null bodies give none either.
    """
    found = essays.select(F.col(path).alias("essay_path"), F.posexplode(F.flatten(F.transform(sections(F.col(body)), windows))).alias("chunk_index", "chunk"))
    return found.select("essay_path", paths.slug(F.col("essay_path")).alias("essay_slug"), "chunk.heading", "chunk_index", "chunk.text", text.content_hash(F.col("chunk.text")).alias("content_hash"), text.token_estimate(F.col("chunk.text")).alias("token_estimate"))


def vector_payloads(found: DataFrame) -> DataFrame:
    """id, data and metadata of each chunk, as they are stored beside its vector."""
    meta = F.struct("essay_path", "essay_slug", "heading", "chunk_index", "content_hash", "token_estimate", F.substring("text", 1, TEXT_CHARS).alias("text"))
    return found.select(paths.vector_id(F.col("essay_slug"), F.col("chunk_index")).alias("id"), F.substring("text", 1, DATA_CHARS).alias("data"), meta.alias("metadata"))


def chunk_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("essay_path").agg(F.count("*").alias("chunk_count"))
