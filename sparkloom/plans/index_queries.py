"""Queries over essays, chunks, manifests and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths, text
from sparkloom.operators import backfill, chunking, conversations, manifest, retrieve, sync
from sparkloom.operators.models import hashed_embedder, tracing_embedder
from sparkloom.operators.vector_index import VectorIndex
from sparkloom.sources import scratch
from sparkloom.sources.tables import VersionedTable
from sparkloom.streaming import ledger

from .views import ARCHIVE_SQL, CHUNKS_SQL, ENTRIES_SQL, ESSAYS_SQL, SECTIONS_SQL, SLUG_SQL, archives, chunks_sql, counts, entries, essays, sql_chain, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search queries: every vector whose id is divisible by 20, against all vectors."""
    return vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")


PAIRS = "pairs AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"
TOP = f"{PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"


@query(f"WITH {TOP} SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.similar(asked(spark, sf_dir), vectors(spark, sf_dir), 10)


@query(f"WITH {PAIRS} SELECT query_id, vec_id, score FROM pairs WHERE score >= 0.3")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.similar(asked(spark, sf_dir), vectors(spark, sf_dir), floor=0.3)


@query("WITH q AS (SELECT count(*) AS queries FROM embeddings WHERE vec_id % 20 = 0) SELECT queries, queries * least(10, (SELECT count(*) FROM embeddings)) AS nearest, true AS reached FROM q")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted-file index finds nine of ten of the ten nearest vectors of each search query, or more."""
    rows, sought = vectors(spark, sf_dir), asked(spark, sf_dir)
    index = VectorIndex.built(rows, f"{scratch.base_dir(spark)}/index-{uuid.uuid4().hex}", 10)
    exact = retrieve.similar(sought, rows, 10).select("query_id", "vec_id")
    found = index.search(sought, rows, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("nearest"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.similar(asked(spark, sf_dir), vectors(spark, sf_dir), 60).drop("rank").join(vectors(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("essay_slug")), "vec_id")


BEST = "one AS (SELECT *, row_number() OVER (PARTITION BY query_id, essay_slug ORDER BY score DESC, vec_id) AS n FROM {}), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM one WHERE n = 1)"
POOL = f"{TOP}, pool AS (SELECT query_id, vec_id, label::VARCHAR AS essay_slug, score FROM ranked WHERE rank <= 60)"


@query(f"WITH {POOL}, {BEST.format('pool')} SELECT query_id, vec_id, essay_slug, score, rank::INTEGER AS rank FROM best WHERE rank <= 5")
def dedupe_by_essay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.best_per_essay(pooled(spark, sf_dir), 5)


#: A second score that depends on the row alone, in a cross-encoder's place.
STAND_IN = "round(((vec_id * 7919 + query_id * 104729) % 2001) / 1000.0 - 1.0, 6)"


@query(f"WITH {POOL} SELECT query_id, vec_id, score AS ann, CASE WHEN score > 0.3 AND {STAND_IN} < 0 THEN score ELSE {STAND_IN} END::DOUBLE AS score FROM pool")
def coerce_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir).select("query_id", "vec_id", F.col("score").alias("ann"), retrieve.coerced(F.col("score"), F.expr(STAND_IN).cast("double"), 0.3).alias("score"))


RERANKED = f"{POOL}, r AS (SELECT query_id, vec_id, essay_slug, CASE WHEN score > 0.3 AND {STAND_IN} < 0 THEN score ELSE {STAND_IN} END::DOUBLE AS score FROM pool)"


@query(f"WITH {RERANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r WHERE score >= 0) SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM o WHERE rank <= 10")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pooled(spark, sf_dir).withColumn("score", retrieve.coerced(F.col("score"), F.expr(STAND_IN).cast("double"), 0.3)).where("score >= 0")
    return retrieve.best_per_essay(rows.withColumn("essay_slug", F.col("vec_id")), 10).select("query_id", "vec_id", "score", "rank")


TERMS = r"terms AS (SELECT item_id, list_filter(regexp_extract_all(replace(lower(text), '''', ''), '\b([a-z][a-z0-9-]{3,})\b', 1), lambda w: w NOT IN ('what', 'whats', 'that', 'this', 'with', 'from', 'about', 'your', 'have', 'does', 'the', 'and', 'for', 'are', 'how', 'not', 'any', 'can', 'may', 'via', 'per')) AS terms FROM benchmark)"
MATCH = "len(list_filter(list_distinct(terms), lambda t: CASE WHEN length(t) <= 4 THEN regexp_matches({0}, '(^|[^a-z0-9_])' || t || '($|[^a-z0-9_])') ELSE contains({0}, t) OR (ends_with(t, 'ism') AND contains({0}, substr(t, 1, length(t) - 3))) END))"


@query(f"""WITH {POOL}, {TERMS}, h AS (SELECT p.query_id, p.vec_id, p.essay_slug, round(CASE WHEN p.score > 0.5 AND s < 0 THEN p.score ELSE s END + {MATCH.format("lower(coalesce(d.source, '') || ' ' || d.text)")} * 0.2, 6) AS score
  FROM (SELECT *, {STAND_IN}::DOUBLE AS s FROM pool) p JOIN documents d ON d.doc_id = p.vec_id JOIN terms t ON t.item_id = p.query_id // 20 WHERE p.score >= 0.0 AND CASE WHEN p.score > 0.5 AND s < 0 THEN p.score ELSE s END >= 0),
  {BEST.format("h")} SELECT query_id, vec_id, essay_slug, score, rank::INTEGER AS rank FROM best WHERE rank <= 5""")
def retrieve_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, floor, second score, boost by the terms of a benchmark text, best of each essay, top 5."""
    from sparkloom.operators.terms import literal_terms

    words = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 20).alias("query_id"), literal_terms(F.col("text")).alias("terms"))
    bodies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("body"), F.col("source").alias("heading"))
    near = pooled(spark, sf_dir).where("score >= 0.0").withColumn("stand_in", F.expr(STAND_IN).cast("double"))
    hits = near.join(bodies, "vec_id").join(words, "query_id")
    found = retrieve.retrieve(hits, 5, min_score=0.0, rerank=F.col("stand_in"))
    return found.select("query_id", "vec_id", "essay_slug", "score", "rank")


@query(f"WITH {CHUNKS_SQL} SELECT * FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(essays(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL} SELECT * FROM counts")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir)


VEC_ID = "replace(regexp_replace(essay_slug, '^/', ''), '/', '--') || '#' || chunk_index"


@query(f"WITH {CHUNKS_SQL} SELECT {VEC_ID} AS id, substr(text, 1, 4000) AS data, substr(text, 1, 2000) AS meta_text, heading AS meta_heading, token_estimate AS meta_tokens FROM chunks")
def vector_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.vector_payloads(chunking.chunks(essays(spark, sf_dir)))
    return rows.select("id", "data", F.col("metadata.text").alias("meta_text"), F.col("metadata.heading").alias("meta_heading"), F.col("metadata.token_estimate").alias("meta_tokens"))


@query(f"WITH {CHUNKS_SQL} SELECT essay_path, essay_slug, {VEC_ID} AS id FROM chunks")
def slugs_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunks(essays(spark, sf_dir))
    return rows.select("essay_path", "essay_slug", paths.vector_id(F.col("essay_slug"), F.col("chunk_index")).alias("id"))


@query(f"WITH {ENTRIES_SQL}, r AS (SELECT essay_path, {SLUG_SQL} AS essay_slug, unnest(range(next_chunk_index, total_chunks)) AS chunk_index FROM entries) SELECT essay_path, {VEC_ID} AS id FROM r")
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return rows.select("essay_path", F.explode(paths.id_range(paths.slug(F.col("essay_path")), F.col("next_chunk_index"), F.col("total_chunks"))).alias("id"))


@query(f"WITH {CHUNKS_SQL} SELECT essay_path, chunk_index, (row_number() OVER (ORDER BY essay_path, chunk_index) - 1) // 16 AS batch FROM chunks")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunks(essays(spark, sf_dir)).select("essay_path", "chunk_index")
    return backfill.micro_batches(rows, ["essay_path", "chunk_index"])


@query(f"WITH {ESSAYS_SQL}, {SECTIONS_SQL} SELECT essay_path, heading, text FROM sections")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = essays(spark, sf_dir)
    return rows.select("essay_path", F.explode(chunking.sections(F.col("body"))).alias("s")).select("essay_path", "s.heading", "s.text")


DIGEST = "SELECT 'sha256:' || sha256(array_to_string([count(*)::VARCHAR, {}], ':')) AS digest FROM (SELECT sha256(essay_path || ':' || content_hash) AS h FROM {{}})".format(", ".join(f"sum(('0x' || substr(h, {16 * i + 1}, 15))::BIGINT)::VARCHAR" for i in range(4)))


@query(f"WITH {ESSAYS_SQL} {DIGEST.format('essays')}")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.corpus_digest(essays(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT count(l.content_hash) > 0 AND bool_or(m.content_hash IS DISTINCT FROM l.content_hash) AS stale FROM entries m FULL JOIN essays l USING (essay_path)")
def corpus_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.is_stale(entries(spark, sf_dir), essays(spark, sf_dir))


TO_PROCESS = "SELECT l.essay_path, l.content_hash FROM essays l LEFT JOIN entries m USING (essay_path) WHERE m.content_hash IS DISTINCT FROM l.content_hash"
REMOVED = "SELECT m.essay_path FROM entries m ANTI JOIN essays l USING (essay_path)"


@query(f"WITH {ENTRIES_SQL} {TO_PROCESS}")
def sync_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.to_process(entries(spark, sf_dir), essays(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} {REMOVED}")
def sync_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.removed(entries(spark, sf_dir), essays(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT essay_path, 'process' AS action FROM ({TO_PROCESS}) UNION ALL SELECT essay_path, 'remove' FROM ({REMOVED})")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.sync_plan(entries(spark, sf_dir), essays(spark, sf_dir))


SCOPE = r"""p AS (SELECT doc_id, essay_path FROM essays UNION ALL SELECT doc_id, 'content/posts/unfolding/chatgpt-20' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '.mdx' FROM documents UNION ALL SELECT doc_id, replace(essay_path, 'doc-', '_meta.doc-') FROM essays
  UNION ALL SELECT doc_id, replace(essay_path, '.mdx', '_meta.mdx') FROM essays UNION ALL SELECT doc_id, 'content/posts/unfolding/chatgpt.mdx' FROM documents),
f AS (SELECT *, regexp_matches(essay_path, '(?i)^content/posts/unfolding/(chatgpt|gemini)(-20\d{2})?(-p\d+)?\.mdx$') AS archive, regexp_matches(essay_path, '(?i)^content/posts/unfolding/(chatgpt|gemini)-20\d{2}\.mdx$') AS year_archive,
  regexp_matches(essay_path, '\.(mdx|md|txt)$') AND NOT contains(essay_path, '/_meta.') AND NOT ends_with(essay_path, '_meta.ts') AND NOT starts_with(essay_path, 'content/posts/pre-examined')
  AND (starts_with(essay_path, 'content/posts/examined/') OR starts_with(essay_path, 'content/posts/unfolding/')) AS kept FROM p)"""


def scoped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = essays(spark, sf_dir).select("doc_id", "essay_path")
    years = found.select("doc_id", F.concat(F.lit("content/posts/unfolding/chatgpt-20"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(".mdx")).alias("essay_path"))
    renamed = [found.select("doc_id", F.replace("essay_path", F.lit(a), F.lit(b)).alias("essay_path")) for a, b in (("doc-", "_meta.doc-"), (".mdx", "_meta.mdx"))]
    plain = found.select("doc_id", F.lit("content/posts/unfolding/chatgpt.mdx").alias("essay_path"))
    return found.unionByName(years).unionByName(renamed[0]).unionByName(renamed[1]).unionByName(plain)


@query(f"WITH {ESSAYS_SQL}, {SCOPE} SELECT doc_id, essay_path, kept AND NOT archive AS deploy, kept AS with_archives, archive, year_archive FROM f")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("essay_path")
    return scoped_paths(spark, sf_dir).select("doc_id", p, paths.in_scope(p).alias("deploy"), paths.in_scope(p, True).alias("with_archives"), paths.is_archive(p).alias("archive"), paths.is_year_archive(p).alias("year_archive"))


@query(f"WITH {ESSAYS_SQL}, {SCOPE} SELECT DISTINCT essay_path FROM f WHERE kept AND year_archive")
def scope_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both writers would own if the sync took year archives too."""
    return paths.disjoint_scopes(scoped_paths(spark, sf_dir), with_archives=True)


BACKLOG = """b AS (SELECT essay_path, CASE WHEN m.content_hash IS NULL THEN 'embed_new' WHEN l.content_hash IS NULL THEN 'delete_removed' WHEN m.content_hash <> l.content_hash THEN 'reembed_changed'
  WHEN next_chunk_index < total_chunks THEN 'embed_resume' END AS kind, total_chunks, next_chunk_index FROM entries m FULL JOIN essays l USING (essay_path)),
backlog AS (SELECT essay_path, kind, CASE WHEN kind IN ('delete_removed', 'reembed_changed') THEN total_chunks END AS old_total_chunks, next_chunk_index FROM b WHERE kind IS NOT NULL)"""


@query(f"WITH {ENTRIES_SQL}, {BACKLOG} SELECT essay_path, kind, coalesce(old_total_chunks, 0) AS old_total_chunks FROM backlog")
def backlog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.backlog(entries(spark, sf_dir), essays(spark, sf_dir))
    return found.withColumn("old_total_chunks", F.coalesce("old_total_chunks", F.lit(0)))


@query(f"""WITH {ENTRIES_SQL}, local AS (SELECT essay_path, content_hash, total_chunks AS local_next FROM entries WHERE content_hash <> 'sha256:stale')
SELECT e.essay_path, e.content_hash, e.total_chunks, CASE WHEN local_next > committed_chunks THEN local_next ELSE next_chunk_index END AS next_chunk_index,
  CASE WHEN local_next > committed_chunks THEN local_next ELSE committed_chunks END AS committed_chunks FROM entries e LEFT JOIN local l ON e.essay_path = l.essay_path AND e.content_hash = l.content_hash""")
def merge_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = entries(spark, sf_dir)
    local = remote.where("content_hash <> 'sha256:stale'").select("essay_path", "content_hash", F.col("total_chunks").alias("next_chunk_index"), F.col("total_chunks").alias("committed_chunks"))
    return manifest.merge_cursors(remote, local)


@query(f"""WITH {ENTRIES_SQL}, p AS (SELECT DISTINCT essay_path, unnest([0, (committed_chunks - 1) // 2, committed_chunks - 1])::BIGINT AS chunk_index FROM entries WHERE committed_chunks > 0)
SELECT p.essay_path, p.chunk_index FROM p ANTI JOIN chunks c ON p.essay_path = c.essay_path AND p.chunk_index = c.chunk_index""")
def verify_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(entries(spark, sf_dir), chunking.chunks(essays(spark, sf_dir)))


BUDGET = 700
PLAN = f"""{BACKLOG}, t AS (SELECT b.*, coalesce(c.chunk_count, 0) AS new_total FROM backlog b LEFT JOIN counts c USING (essay_path)),
d AS (SELECT essay_path, kind, CASE kind WHEN 'delete_removed' THEN old_total_chunks WHEN 'reembed_changed' THEN greatest(0, old_total_chunks - new_total) ELSE 0 END AS deletes,
  CASE kind WHEN 'delete_removed' THEN 0 WHEN 'embed_resume' THEN greatest(0, new_total - next_chunk_index) ELSE new_total END AS upserts FROM t),
g AS (SELECT essay_path, stage, pending, least(pending, greatest(0, {BUDGET - 5} - coalesce(sum(pending) OVER (ORDER BY stage, essay_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS granted
  FROM (SELECT essay_path, 0 AS stage, deletes AS pending FROM d UNION ALL SELECT essay_path, 1, upserts FROM d))"""


@query(f"WITH {ENTRIES_SQL}, {PLAN} SELECT d.essay_path, kind, deletes, upserts, sum(granted) FILTER (stage = 0)::BIGINT AS deletes_granted, sum(granted) FILTER (stage = 1)::BIGINT AS upserts_granted FROM d JOIN g USING (essay_path) GROUP BY ALL")
def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, live = entries(spark, sf_dir), essays(spark, sf_dir)
    return backfill.plan_batch(manifest.backlog(found, live), found, counts(spark, sf_dir), backfill.WriteBudget(write_budget=BUDGET))


ASKS = "SELECT '2026-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS day, coalesce(lang, '') || '-' || coalesce(source, '') AS request, sum(1 + n_chars // 2000)::BIGINT AS chunks FROM documents GROUP BY 1, 2"


@query(f"WITH a AS ({ASKS}) SELECT day, request, least(chunks, greatest(0, 60 - coalesce(sum(chunks) OVER (PARTITION BY day ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS granted FROM a")
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream's ledger of 60 chunks a day grants to each language and source, which ask for their documents' chunks."""
    day = F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    request = F.concat(F.coalesce("lang", F.lit("")), F.lit("-"), F.coalesce("source", F.lit("")))
    asks = table(spark, sf_dir, "documents").groupBy(day.alias("day"), request.alias("request")).agg(F.sum(1 + F.floor(F.col("n_chars") / 2000)).cast("long").alias("chunks"))
    folder = f"{scratch.base_dir(spark)}/ledger-{uuid.uuid4().hex}"
    asks.select(F.to_timestamp("day").alias("at"), "request", "chunks").write.parquet(f"{folder}/asks")
    stream = spark.readStream.schema(ledger.ASK).parquet(f"{folder}/asks")
    with ledger.state_in_rocks(spark):
        query_ = ledger.grants(stream, 60).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(ledger.GRANT).parquet(f"{folder}/out").where("NOT closed").select("day", "request", "granted")


@query(f"WITH {ENTRIES_SQL} SELECT count(*) AS files, sum(total_chunks)::BIGINT AS vector_count, sum(committed_chunks)::BIGINT AS committed_archive_vectors FROM entries")
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.rollup(entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT essay_path, content_hash, total_chunks, next_chunk_index, committed_chunks FROM entries")
def manifest_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.from_json(manifest.as_json(entries(spark, sf_dir)))


@query(f"WITH {ENTRIES_SQL}, s AS (SELECT count(l.content_hash) > 0 AND bool_or(m.content_hash IS DISTINCT FROM l.content_hash) AS stale, count(m.content_hash) AS n FROM entries m FULL JOIN essays l USING (essay_path)) SELECT CASE WHEN stale THEN 'stale' ELSE 'index_current' END AS index_status, n AS files, 'hashed' AS model FROM s")
def index_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entries(spark, sf_dir)
    stale = manifest.is_stale(found, essays(spark, sf_dir)).crossJoin(F.broadcast(found.agg(F.count("*").alias("files"))))
    meta = retrieve.index_meta(F.lit("index_current"), F.col("stale"), F.lit(None).cast("string"), F.lit("hashed"))
    return stale.select(meta.alias("m"), "files").select("m.index_status", "files", "m.model")


@query("""SELECT id, doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '/posts/' || source END AS essay_slug, essay_path, CASE WHEN doc_id % 3 > 0 THEN lang END AS heading, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE doc_id END::INTEGER AS chunk_index,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS body, CASE WHEN doc_id % 6 = 0 THEN 0.0 ELSE n_chars / 4.0 END::DOUBLE AS score
FROM (SELECT *, CASE WHEN doc_id % 50 = 7 THEN '__manifest__' WHEN doc_id % 50 = 8 THEN '__backfill_manifest__' ELSE 'doc#' || doc_id END AS id,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN lang = 'fr' THEN 'content/posts/pre-examined/x.mdx' ELSE 'content/posts/examined/x.mdx' END AS essay_path FROM documents)
WHERE id NOT IN ('__manifest__', '__backfill_manifest__') AND NOT starts_with(essay_path, 'content/posts/pre-examined')""")
def hit_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits with gaps in their metadata, mapped to chunks."""
    id_ = "CASE WHEN doc_id % 50 = 7 THEN '__manifest__' WHEN doc_id % 50 = 8 THEN '__backfill_manifest__' ELSE concat('doc#', doc_id) END AS id"
    parts = ["IF(doc_id % 4 = 0, NULL, concat('/posts/', source)) AS essay_slug", "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN lang = 'fr' THEN 'content/posts/pre-examined/x.mdx' ELSE 'content/posts/examined/x.mdx' END AS essay_path", "IF(doc_id % 3 > 0, lang, NULL) AS heading", "IF(doc_id % 4 = 1, NULL, int(doc_id)) AS chunk_index", "IF(doc_id % 5 = 0, NULL, text) AS text"]
    hits = table(spark, sf_dir, "documents").select(F.expr(id_), "doc_id", F.struct(*[F.expr(p) for p in parts]).alias("metadata"), F.expr("IF(doc_id % 6 = 0, NULL, n_chars / 4.0D) AS score"))
    return retrieve.chunks_of_hits(hits)


BEST_DOCS = f"""WITH {POOL}, {BEST.format("pool")}, c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, '/' || essay_slug AS essay_slug, CASE WHEN vec_id % 3 > 0 THEN source END AS heading, {sql_chain("text", text.PASSAGE_RULES)} AS body FROM best JOIN documents ON doc_id = vec_id WHERE rank <= 3),
ctx AS (SELECT query_id, string_agg('[' || rank || '] ' || essay_slug || coalesce(' \u2014 ' || heading, '') || chr(10) || substr(body, 1, 1200) || CASE WHEN length(body) > 1200 THEN '\u2026' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS context FROM c GROUP BY 1)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three documents of each search query, as passages."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("heading"), "text", F.lit(None).cast("string").alias("essay_path"))
    return retrieve.best_per_essay(pooled(spark, sf_dir), 3).withColumn("essay_slug", F.concat(F.lit("/"), "essay_slug")).join(docs, "vec_id")


@query(f"{BEST_DOCS} SELECT * FROM ctx")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.context_block(passages(spark, sf_dir))


@query(f"""{BEST_DOCS} SELECT query_id, 'You answer questions using only the retrieved essay passages below. Cite passage numbers like [1] when you rely on a source. If the passages do not contain enough information, say so briefly.'
  || chr(10) || chr(10) || 'Retrieved passages:' || chr(10) || coalesce(context, 'No relevant passages were retrieved from the indexed corpus.') AS system, regexp_replace(b.text, '^\\s+|\\s+$', '', 'g') AS user_turn
  FROM benchmark b LEFT JOIN ctx ON ctx.query_id = b.item_id * 20 WHERE query_id IS NOT NULL""")
def model_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is sent for each benchmark text whose search query found something."""
    asked_ = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 20).alias("query_id"), F.col("text").alias("query"))
    return context_block(spark, sf_dir).join(asked_, "query_id").select("query_id", conversations.system_prompt(F.col("context")).alias("system"), conversations.user_turn(F.col("query")).alias("user_turn"))


def run_tables(spark: SparkSession) -> list[VersionedTable]:
    """A fresh table of vectors and one of manifest entries."""
    base = f"{scratch.base_dir(spark)}/tables-{uuid.uuid4().hex}"
    return [VersionedTable(spark, f"{base}/vectors", "id", 16), VersionedTable(spark, f"{base}/manifest", "essay_path", 16)]


def earlier_vectors(ids: DataFrame) -> DataFrame:
    """Vectors of an earlier run, of which nothing but the id is known."""
    meta = "struct<essay_path: string, essay_slug: string, heading: string, chunk_index: int, content_hash: string, token_estimate: int, text: string>"
    return ids.select("id", F.lit(None).cast("string").alias("data"), F.lit(None).cast(meta).alias("metadata"), F.lit(None).cast("array<float>").alias("vector"))


#: What tracing_embedder() makes of a chunk's whole text, as one number.
TRACE = "31 * length(text) + 7 * length(string_split(text, ' ')[-1]) + unicode(text[-1:])"


def clock() -> str:
    return "2026-01-02T03:04:05.000Z"


@query(f"""WITH {ENTRIES_SQL}, owned AS (SELECT * FROM essays WHERE NOT starts_with(essay_path, 'content/posts/pre-examined') AND NOT regexp_matches(essay_path, '(?i)^content/posts/unfolding/(chatgpt|gemini)(-20\\d{{2}})?(-p\\d+)?\\.mdx$'))
SELECT o.essay_path, o.content_hash, coalesce(n.chunk_count, 0)::BIGINT AS total_chunks, coalesce(n.chunk_count, 0)::BIGINT AS vectors, CASE WHEN m.content_hash = o.content_hash THEN 0 ELSE coalesce(n.chunk_count, 0) END::BIGINT AS written,
  CASE WHEN m.content_hash = o.content_hash THEN 0 ELSE coalesce(t.trace, 0) END::BIGINT AS trace
FROM owned o LEFT JOIN counts n USING (essay_path) LEFT JOIN entries m USING (essay_path) LEFT JOIN (SELECT essay_path, sum({TRACE}) AS trace FROM chunks GROUP BY 1) t USING (essay_path)""")
def sync_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries after a sync over an earlier manifest and its vectors, with what the table of vectors holds of each."""
    vectors_, manifest_ = run_tables(spark)
    before = scratch.stored(entries(spark, sf_dir).select("essay_path", "content_hash", "total_chunks"))
    vectors_.upsert(earlier_vectors(sync.chunk_ids(before, F.lit(0).cast("long"), F.col("total_chunks"))))
    manifest_.replace(before, {"status": "index_current", "manifest_digest": "sha256:earlier"})
    sync.run_sync(essays(spark, sf_dir), vectors_, manifest_, tracing_embedder, clock=clock)
    return held(manifest_.read(), vectors_.read())


def held(entries_: DataFrame, vectors_: DataFrame) -> DataFrame:
    safe = F.regexp_replace("id", "#\\d+$", "")
    trace = F.sum(31 * F.col("vector")[0].cast("long") + 7 * F.col("vector")[1].cast("long") + F.col("vector")[2].cast("long"))
    of = vectors_.groupBy(safe.alias("safe")).agg(F.count("*").alias("vectors"), F.count("vector").alias("written"), trace.alias("trace"))
    mine = F.regexp_replace(paths.vector_id(paths.slug(F.col("essay_path")), F.lit(0)), "#0$", "")
    rows = entries_.withColumn("safe", mine).join(of, "safe", "full_outer")
    return rows.select(*entries_.columns, F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("written", F.lit(0)).alias("written"), F.coalesce("trace", F.lit(0)).alias("trace"))


ARCHIVE_ENTRIES = """k AS (SELECT essay_path, substr(essay_path, length(essay_path) - 5, 2)::INTEGER AS yy, content_hash, chunk_count FROM essays JOIN counts USING (essay_path)),
entries AS (SELECT essay_path, CASE WHEN yy % 5 = 1 THEN 'sha256:stale' ELSE content_hash END AS content_hash, CASE WHEN yy % 5 = 1 THEN chunk_count + 7 ELSE chunk_count END AS total_chunks, CASE WHEN yy % 5 = 2 THEN chunk_count // 2 ELSE CASE WHEN yy % 5 = 1 THEN chunk_count + 7 ELSE chunk_count END END AS next_chunk_index, next_chunk_index AS committed_chunks FROM k WHERE yy % 5 > 0
  UNION ALL SELECT 'content/posts/unfolding/gemini-1999.mdx', 'sha256:gone', 9, 9, 9)"""


@query(f"""WITH {chunks_sql(ARCHIVE_SQL)}, {ARCHIVE_ENTRIES}, {PLAN.replace(str(BUDGET - 5), "195")},
p AS (SELECT d.essay_path, kind, deletes, sum(granted) FILTER (stage = 0)::BIGINT AS dg, sum(granted) FILTER (stage = 1)::BIGINT AS ug FROM d JOIN g USING (essay_path) GROUP BY ALL),
a AS (SELECT essay_path, kind, dg, ug, dg = deletes AS whole, m.content_hash AS old_hash, e.content_hash AS new_hash, m.total_chunks AS old_total, coalesce(c.chunk_count, 0) AS new_total, m.next_chunk_index AS old_next
  FROM (SELECT essay_path FROM entries UNION SELECT essay_path FROM p) LEFT JOIN p USING (essay_path) LEFT JOIN entries m USING (essay_path) LEFT JOIN essays e USING (essay_path) LEFT JOIN counts c USING (essay_path)),
r AS (SELECT *, kind IN ('embed_new', 'reembed_changed') AND whole AS fresh FROM a WHERE NOT coalesce(kind = 'delete_removed' AND whole, false)),
z AS (SELECT essay_path, CASE WHEN fresh THEN new_hash ELSE old_hash END AS content_hash, CASE WHEN fresh THEN new_total WHEN kind = 'delete_removed' THEN old_total - dg ELSE old_total END AS total_chunks,
  CASE WHEN fresh THEN ug WHEN kind = 'embed_resume' THEN old_next + ug ELSE old_next END AS next_chunk_index, coalesce(ug, 0) AS written, kind, old_total, dg, CASE WHEN kind = 'embed_resume' THEN old_next ELSE 0 END AS began FROM r),
tr AS (SELECT z.essay_path, sum({TRACE}) AS trace FROM z JOIN chunks c ON c.essay_path = z.essay_path AND c.chunk_index >= began AND c.chunk_index < began + written GROUP BY 1)
SELECT essay_path, content_hash, total_chunks::BIGINT AS total_chunks, next_chunk_index::BIGINT AS next_chunk_index, least(next_chunk_index, total_chunks)::BIGINT AS committed_chunks,
  CASE WHEN kind = 'embed_new' THEN written WHEN kind = 'embed_resume' THEN next_chunk_index WHEN kind IS NULL THEN total_chunks ELSE greatest(old_total - dg, written) END::BIGINT AS vectors, written::BIGINT AS written, coalesce(trace, 0)::BIGINT AS trace FROM z LEFT JOIN tr USING (essay_path)""")
def backfill_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries after a day's backfill of 195 chunk writes, with what the table of vectors holds of each."""
    vectors_, manifest_ = run_tables(spark)
    found = scratch.stored(archives(spark, sf_dir))
    sizes = chunking.chunk_counts(chunking.chunks(found))
    live = found.select("essay_path", text.content_hash(F.col("body")).alias("content_hash")).join(sizes, "essay_path").withColumn("m", F.expr("int(substr(essay_path, length(essay_path) - 5, 2)) % 5"))
    stale, half = F.col("m") == 1, F.col("m") == 2
    total = F.when(stale, F.col("chunk_count") + 7).otherwise(F.col("chunk_count")).cast("long")
    done = F.when(half, F.floor(F.col("chunk_count") / 2)).otherwise(total).cast("long")
    known = live.where("m > 0").select("essay_path", F.when(stale, "sha256:stale").otherwise(F.col("content_hash")).alias("content_hash"), total.alias("total_chunks"), done.alias("next_chunk_index"), done.alias("committed_chunks"))
    gone = spark.createDataFrame([("content/posts/unfolding/gemini-1999.mdx", "sha256:gone", 9, 9, 9)], sync.BACKFILL_ENTRY)
    before = scratch.stored(known.unionByName(gone))
    vectors_.upsert(earlier_vectors(sync.chunk_ids(before, F.lit(0).cast("long"), F.col("next_chunk_index"))))
    manifest_.replace(before, {"status": "batch_running"})
    sync.run_backfill(found, vectors_, manifest_, tracing_embedder, backfill.WriteBudget(write_budget=200), clock=clock)
    return held(manifest_.read(), vectors_.read())
