"""Essay paths: scopes, slugs and vector ids, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders, archive names and extensions of the corpus layout.
EXAMINED, UNFOLDING, PRE_EXAMINED = "content/posts/examined/", "content/posts/unfolding/", "content/posts/pre-examined/"
ARCHIVE = r"(?i)^content/posts/unfolding/(chatgpt|gemini)(-20\d{2})?(-p\d+)?\.mdx$"
YEAR_ARCHIVE = r"(?i)^content/posts/unfolding/(chatgpt|gemini)-20\d{2}\.mdx$"
EXTENSION = r"\.(mdx|md|txt)$"


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_archive(path: Column) -> Column:
    return slashed(path).rlike(ARCHIVE)


def is_year_archive(path: Column) -> Column:
    return slashed(path).rlike(YEAR_ARCHIVE)


def in_scope(path: Column, with_archives: bool = False) -> Column:
    """Whether the incremental sync owns a path; conversation archives only where they are asked for."""
    p = slashed(path)
    kept = p.rlike(EXTENSION) & ~p.contains("/_meta.") & ~p.endswith("_meta.ts") & ~p.startswith(PRE_EXAMINED.rstrip("/"))
    return kept & (p.startswith(EXAMINED) | p.startswith(UNFOLDING)) & (F.lit(with_archives) | ~is_archive(p))


def slug(path: Column) -> Column:
    """The path without its content folder, its extension and a closing index page, from the site's root."""
    bare = F.regexp_replace(F.regexp_replace(slashed(path), "^content/", ""), EXTENSION, "")
    whole = F.regexp_replace(F.concat(F.lit("/"), bare), "/index$", "")
    return F.when(whole == "", "/").otherwise(whole)


def is_index(path: Column, slug_: Column) -> Column:
    """Whether a chunk is of a folder's page; null paths and slugs are of none."""
    return F.coalesce(slashed(path), F.lit("")).rlike(r"(?i)/index\.(mdx|md|txt)$") | F.coalesce(slug_.endswith("/index"), F.lit(False))


def vector_id(slug_: Column, index: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(slug_, "^/", ""), "/", "--"), F.lit("#"), index.cast("string"))


def id_range(slug_: Column, start: Column, stop: Column) -> Column:
    """The ids of chunks start to stop, without stop; none where the range is empty."""
    ids = F.transform(F.sequence(start, stop - 1), lambda i: vector_id(slug_, i))
    return F.when(stop > start, ids).otherwise(F.array().cast("array<string>"))


def disjoint_scopes(paths: DataFrame, path: str = "essay_path", with_archives: bool = False) -> DataFrame:
    """Paths that both writers would own."""
    return paths.where(in_scope(F.col(path), with_archives)).select(path).intersect(paths.where(is_year_archive(F.col(path))).select(path))


def assert_disjoint(paths: DataFrame, path: str = "essay_path", with_archives: bool = False) -> None:
    """Raise ValueError, before anything is written, if some path has two writers; names up to five of them."""
    both = [r[path] for r in disjoint_scopes(paths, path, with_archives).orderBy(path).limit(5).collect()]
    if both:
        raise ValueError(f"owned by the sync and by the backfill: {', '.join(both)}")


def allowed(rows: DataFrame, only: DataFrame | None, path: str = "essay_path") -> DataFrame:
    """`rows` of the paths that a run is restricted to (a column `path` of `only`); all of them without a restriction."""
    return rows if only is None else rows.join(only.select(path).distinct(), path, "left_semi")
