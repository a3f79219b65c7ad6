"""The driver tables as the engine's own: essays, manifests, messages and queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import chunking

PATH = """CASE WHEN lang = 'en' AND source = 'src1' THEN concat('content/posts/examined/doc-', doc_id, '/index.mdx')
 WHEN lang = 'en' THEN concat('content/posts/examined/doc-', doc_id, '.mdx') WHEN lang = 'de' THEN concat('content/posts/unfolding/doc-', doc_id, '.md')
 WHEN lang = 'fr' THEN concat('content/posts/pre-examined/doc-', doc_id, '.mdx') ELSE concat('content/posts/unfolding/gemini-2024-p', doc_id, '.mdx') END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Texts that lie in fewer splits than there are cores, as in a file of one row group, are
    dealt out first, since what is done with each of them takes longer than moving it; larger tables are read in place."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents" and rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        return rows.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return rows


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, essay_path, body, content_hash: the documents, in the folder of their language."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("essay_path"), F.col("text").alias("body"), text.content_hash(F.col("text")).alias("content_hash"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_counts(chunking.chunks(essays(spark, sf_dir)))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier manifest: labelled essays, stale where the quality is 0 and half done where they are toxic, and the
    benchmark's items, which the corpus doesn't have any more."""
    labelled = essays(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    known = labelled.join(chunking.chunk_counts(chunking.chunks(labelled)), "essay_path")
    hash_ = F.when(F.col("quality") == 1, F.col("content_hash")).otherwise("sha256:stale")
    done = F.when(F.col("toxic") == 1, F.floor(F.col("chunk_count") / 2)).otherwise(F.col("chunk_count")).cast("long")
    rows = known.select("essay_path", hash_.alias("content_hash"), F.col("chunk_count").alias("total_chunks"), done.alias("next_chunk_index"), done.alias("committed_chunks"))
    three = F.lit(3).cast("long")
    gone = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("content/posts/examined/item-"), F.col("item_id").cast("string"), F.lit(".mdx")).alias("essay_path"), text.content_hash(F.col("text")).alias("content_hash"), three.alias("total_chunks"), three.alias("next_chunk_index"), three.alias("committed_chunks"))
    return rows.unionByName(gone)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def sql_chain(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        column = f"regexp_replace({column}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


ESSAYS_SQL = f"essays AS (SELECT doc_id, {PATH} AS essay_path, text AS body, 'sha256:' || sha256(text) AS content_hash FROM documents)"
_PLAIN = sql_chain("x", text.LINE_RULES)
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
SECTIONS_SQL = f"""s0 AS (SELECT essay_path, replace(replace(body, chr(13) || chr(10), chr(10)), chr(1), ' ') AS body FROM essays),
s1 AS (SELECT essay_path, list_filter(list_transform(string_split(CASE WHEN starts_with(body, '---') AND strpos(substr(body, 4), chr(10) || '---') > 0
  THEN substr(body, strpos(substr(body, 4), chr(10) || '---') + 7) ELSE body END, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '' AND NOT starts_with(x, 'import ') AND NOT starts_with(x, '```')) AS lines FROM s0),
s2 AS (SELECT essay_path, string_split(array_to_string(list_filter(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '^#{{1,6}}\\s+(.+)')
  THEN chr(1) || {_TRIM.format("regexp_extract(x, '^#{1,6}" + chr(92) + "s+(.+)', 1)")} ELSE {_PLAIN} END), lambda x: x <> ''), chr(10)), chr(1)) AS parts FROM s1),
s3 AS (SELECT essay_path, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM s2),
s4 AS (SELECT essay_path, n, CASE WHEN n > 1 THEN string_split(part, chr(10))[1] END AS heading,
  {_TRIM.format("regexp_replace(CASE WHEN n = 1 THEN part WHEN strpos(part, chr(10)) > 0 THEN substr(part, strpos(part, chr(10)) + 1) ELSE '' END, '" + chr(92) + "s+', ' ', 'g')")} AS text FROM s3),
sections AS (SELECT * FROM s4 WHERE text <> '' AND NOT coalesce(regexp_matches(heading, '(?i)(^|[^a-z0-9_])comment($|[^a-z0-9_])|^\\d+\\.\\s+\\d{{4}}-\\d{{2}}-\\d{{2}}'), false))"""
SLUG_SQL = r"coalesce(nullif(regexp_replace('/' || regexp_replace(regexp_replace(essay_path, '^content/', ''), '\.(mdx|md|txt)$', ''), '/index$', ''), ''), '/')"
_CHUNKS = f"""{SECTIONS_SQL},
c0 AS (SELECT essay_path, n, heading, string_split(text, ' ') AS words FROM sections),
c1 AS (SELECT essay_path, n, heading, words, unnest(range(0, 1 + ceil(greatest(0, len(words) - 500) / 420)::BIGINT)) AS w FROM c0),
c2 AS (SELECT essay_path, heading, (row_number() OVER (PARTITION BY essay_path ORDER BY n, w) - 1)::INTEGER AS chunk_index, array_to_string(words[w * 420 + 1 : w * 420 + 500], ' ') AS text FROM c1),
chunks AS (SELECT essay_path, {SLUG_SQL} AS essay_slug, heading, chunk_index, text,
  'sha256:' || sha256(text) AS content_hash, greatest(1, ceil(length(text) / 4))::INTEGER AS token_estimate FROM c2),
counts AS (SELECT essay_path, count(*) AS chunk_count FROM chunks GROUP BY essay_path)"""


def chunks_sql(essays_sql: str) -> str:
    """sections, chunks and counts of the essays that a common table expression defines."""
    return f"{essays_sql}, {_CHUNKS}"


CHUNKS_SQL = chunks_sql(ESSAYS_SQL)
ENTRIES_SQL = f"""{CHUNKS_SQL},
k AS (SELECT e.essay_path, CASE WHEN quality = 1 THEN content_hash ELSE 'sha256:stale' END AS content_hash, chunk_count AS total_chunks,
  CASE WHEN toxic = 1 THEN chunk_count // 2 ELSE chunk_count END AS next_chunk_index FROM essays e JOIN labels USING (doc_id) JOIN counts USING (essay_path)),
entries AS (SELECT *, next_chunk_index AS committed_chunks FROM k UNION ALL
  SELECT 'content/posts/examined/item-' || item_id || '.mdx', 'sha256:' || sha256(text), 3, 3, 3 FROM benchmark)"""
MESSAGES_SQL = "messages AS (SELECT conv_id AS conversation_id, turn AS ord, role, text AS content FROM conversations)"
ARCHIVE_SQL = """essays AS (SELECT essay_path, body, 'sha256:' || sha256(body) AS content_hash FROM (
  SELECT 'content/posts/unfolding/' || CASE WHEN lang IN ('en', 'de') THEN 'chatgpt' ELSE 'gemini' END || '-20' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '.mdx' AS essay_path, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY 1))"""


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_path, body: the documents as two hundred year archives at most, joined in order."""
    family = F.when(F.col("lang").isin("en", "de"), "chatgpt").otherwise("gemini")
    path = F.concat(F.lit("content/posts/unfolding/"), family, F.lit("-20"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(".mdx"))
    rows = table(spark, sf_dir, "documents").select(path.alias("essay_path"), "doc_id", "text")
    return rows.groupBy("essay_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("body"))
