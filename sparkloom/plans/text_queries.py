"""Queries over messages, query terms, passages and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import sentences, text
from sparkloom.operators import answer, chunking, conversations, embeddings, models, paging, postings, retrieve, sagas, terms
from sparkloom.sources.scratch import stored

from .index_queries import BEST, MATCH, TERMS, VEC_ID
from .views import CHUNKS_SQL, MESSAGES_SQL, essays, messages, queries, sql_chain, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RANKED = "row_number() OVER (PARTITION BY conversation_id ORDER BY {})"


@query(f"WITH {MESSAGES_SQL}, r AS (SELECT *, {RANKED.format('ord')} AS rank FROM messages) SELECT conversation_id, ord, role, content, rank::INTEGER AS rank FROM r WHERE rank <= 4")
def messages_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.messages_page(messages(spark, sf_dir), 4)


@query(f"WITH {MESSAGES_SQL}, r AS (SELECT *, {RANKED.format('ord')} - 1 AS n FROM messages) SELECT conversation_id, ord, role, content, (n // 3)::INTEGER AS page FROM r")
def message_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its page of three, by a table of page boundaries."""
    rows = messages(spark, sf_dir)
    return paging.pages(rows, stored(paging.marks(rows, 3)))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("conversation_id").agg(F.max("ord").alias("before"))


BEFORE = f"WITH {MESSAGES_SQL}, c AS (SELECT conversation_id, max(ord) AS before FROM messages GROUP BY 1), r AS (SELECT m.*, {RANKED} AS rank FROM messages m JOIN c USING (conversation_id) WHERE ord < before) SELECT conversation_id, ord, role, content, rank::INTEGER AS rank FROM r WHERE rank <= 3"


@query(BEFORE.format("ord"))
def messages_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.messages_before(messages(spark, sf_dir), cursors(spark, sf_dir), 3)


@query(BEFORE.format("ord DESC"))
def messages_nearest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.messages_before(messages(spark, sf_dir), cursors(spark, sf_dir), 3, nearest=True)


HISTORY = f"{MESSAGES_SQL}, r AS (SELECT *, {RANKED.format('ord DESC')} AS rank FROM messages WHERE role <> 'system'), h AS (SELECT conversation_id, ord, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, content FROM r WHERE rank <= 4)"


@query(f"WITH {HISTORY} SELECT * FROM h")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.history(messages(spark, sf_dir), 4)


TURN = "b AS (SELECT item_id, text FROM benchmark), t AS (SELECT conversation_id, text AS query, 'Answer ' || item_id AS answer FROM (SELECT DISTINCT conversation_id FROM messages) JOIN b ON item_id = conversation_id % (SELECT count(*) FROM benchmark)), x AS (SELECT conversation_id, max(ord) + 1 AS next FROM messages GROUP BY 1)"


@query(f"""WITH {MESSAGES_SQL}, {TURN}, m AS (SELECT conversation_id, ord, role, content, NULL AS llm_meta FROM messages UNION ALL SELECT conversation_id, next, 'user', query, NULL FROM t JOIN x USING (conversation_id) UNION ALL SELECT conversation_id, next + 1, 'assistant', answer, 'none' FROM t JOIN x USING (conversation_id)),
r AS (SELECT *, {RANKED.format("ord DESC")} AS rank FROM m) SELECT conversation_id, ord, role, content, llm_meta FROM r WHERE rank <= 3""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages of each conversation after one more turn: a benchmark text and its answer."""
    rows = messages(spark, sf_dir)
    n = table(spark, sf_dir, "benchmark").count()
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"), F.concat(F.lit("Answer "), F.col("item_id").cast("string")).alias("answer"))
    turns = rows.select("conversation_id").distinct().withColumn("item_id", F.col("conversation_id") % n).join(items, "item_id").withColumn("llm_meta", F.lit("none"))
    new = conversations.with_turns(rows, turns)
    both = rows.withColumn("llm_meta", F.lit(None).cast("string")).unionByName(new.select("conversation_id", "ord", "role", "content", "llm_meta"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("ord")))).where("rank <= 3").drop("rank")


@query(f"WITH {MESSAGES_SQL} SELECT conversation_id, count(*) AS messages, max(ord) AS last_turn FROM messages GROUP BY 1")
def conversations_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return conversations.touched(rows, at="ord").join(rows.groupBy("conversation_id").agg(F.count("*").alias("messages")), "conversation_id").select("conversation_id", "messages", F.col("updated_at").alias("last_turn"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary from the benchmark: its words of eight letters and more, each expanded to itself and its reverse."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9_])([a-z]{8,})(?![a-z0-9_])"), F.lit(1))).alias("term")).distinct()
    return words.select("term", F.concat("term", F.lit(" "), F.reverse("term")).alias("expansion"))


VOCABULARY = r"vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\b([a-z]{8,})\b', 1)) AS term FROM benchmark)"
_STOPS = "('" + "', '".join(terms.STOP_WORDS) + "')"
_SUFFIXES = "['" + "', '".join(terms.SUFFIXES) + "']"
ALIASES = f"""{VOCABULARY}, sfx AS (SELECT unnest({_SUFFIXES}) AS suffix),
stems AS (SELECT term, substr(term, 1, length(term) - length(suffix)) AS stem FROM vocabulary, sfx WHERE ends_with(term, suffix) AND length(term) - length(suffix) >= 3),
claims AS (SELECT term, substr(stem, 1, n) AS alias FROM (SELECT term, stem, unnest(range(3, length(stem) + 1)) AS n FROM stems) UNION SELECT term, substr(term, 1, 3) FROM vocabulary UNION SELECT term, substr(term, 1, 4) FROM vocabulary),
aliases AS (SELECT alias, min(term) AS term FROM claims WHERE length(alias) >= 3 AND length(alias) < length(term) AND alias NOT IN {_STOPS} GROUP BY alias HAVING count(DISTINCT term) = 1)"""


@query(f"WITH {ALIASES} SELECT alias, term FROM aliases")
def short_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.short_aliases(vocabulary(spark, sf_dir))


WORDS = r"words AS (SELECT item_id, unnest(regexp_extract_all(replace(lower(text), '''', ''), '\b([a-z][a-z0-9-]{3,})\b', 1)) AS word, generate_subscripts(regexp_extract_all(replace(lower(text), '''', ''), '\b([a-z][a-z0-9-]{3,})\b', 1), 1) AS pos FROM benchmark)"
FUZZY = f"fuzzy AS (SELECT DISTINCT word, term FROM words, vocabulary WHERE word NOT IN {_STOPS} AND abs(length(word) - length(term)) <= 2 AND levenshtein(word, term) <= 2)"


@query(f"WITH {VOCABULARY}, {WORDS}, {FUZZY} SELECT * FROM fuzzy")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = queries(spark, sf_dir).select(F.explode(terms.literal_terms(F.col("query"))).alias("word"))
    return terms.fuzzy_terms(words, vocabulary(spark, sf_dir))


TOKENS = r"tokens AS (SELECT item_id, unnest(regexp_extract_all(replace(lower(text), '''', ''), '\b([a-z]{3,})\b', 1)) AS token, generate_subscripts(regexp_extract_all(replace(lower(text), '''', ''), '\b([a-z]{3,})\b', 1), 1) AS pos FROM benchmark)"
RESOLVED = f"""t AS (SELECT DISTINCT token FROM tokens WHERE token NOT IN {_STOPS}),
ra AS (SELECT token, term FROM t JOIN aliases ON alias = token), rb AS (SELECT token, term FROM t JOIN vocabulary ON term = token WHERE token NOT IN (SELECT token FROM ra)),
rc AS (SELECT token, min(term) AS term FROM t JOIN vocabulary ON starts_with(term, token) AND length(term) > length(token) WHERE token NOT IN (SELECT token FROM ra) AND token NOT IN (SELECT token FROM rb) GROUP BY token HAVING count(*) = 1),
resolved AS (SELECT * FROM ra UNION ALL SELECT * FROM rb UNION ALL SELECT * FROM rc)"""


@query(f"WITH {ALIASES}, {TOKENS}, {RESOLVED} SELECT token, term FROM resolved")
def resolve_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = queries(spark, sf_dir).select(F.explode(F.regexp_extract_all(terms.low(F.col("query")), F.lit(terms.WORD), F.lit(1))).alias("token"))
    known = vocabulary(spark, sf_dir)
    return terms.resolve_tokens(tokens, known, terms.short_aliases(known))


ALL_TERMS = f"""{ALIASES}, {WORDS}, {FUZZY}, {TOKENS}, {RESOLVED},
lit AS (SELECT item_id, word AS term, min(pos) AS pos FROM words WHERE word NOT IN {_STOPS} GROUP BY 1, 2),
pieces AS (SELECT item_id, 0 AS part, pos * 2 AS p, term AS tie, term FROM lit UNION ALL SELECT item_id, 1, pos * 2, '', token FROM tokens JOIN resolved USING (token)
  UNION ALL SELECT item_id, 1, pos * 2 + 1, '', term FROM tokens JOIN resolved USING (token)
  UNION ALL SELECT item_id, 2, l.pos * 2, f.term, f.term FROM lit l JOIN fuzzy f ON l.term = f.word),
firsts AS (SELECT item_id, term, min((part, p, tie)) AS place FROM pieces GROUP BY 1, 2),
q AS (SELECT item_id AS query_id, list(term ORDER BY place) AS terms FROM firsts GROUP BY 1)"""


@query(f"WITH {ALL_TERMS} SELECT b.item_id AS query_id, coalesce(array_to_string(terms, ' '), '') AS terms FROM benchmark b LEFT JOIN q ON b.item_id = q.query_id")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vocabulary(spark, sf_dir)
    return terms.query_terms(queries(spark, sf_dir), known, terms.short_aliases(known)).select("query_id", F.array_join("terms", " ").alias("terms"))


EXPANDED = """w AS (SELECT item_id, term, min((CASE part WHEN 2 THEN -1 ELSE part END, p, tie)) AS place FROM pieces WHERE part <> 2 OR term IN (SELECT term FROM vocabulary) GROUP BY 1, 2),
x AS (SELECT item_id, string_agg(term || ' ' || reverse(term), ' ' ORDER BY place) AS more FROM w WHERE term IN (SELECT term FROM vocabulary) GROUP BY 1),
expanded AS (SELECT b.item_id AS query_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') || coalesce(' ' || more, '') AS expanded FROM benchmark b LEFT JOIN x USING (item_id))"""


@query(f"WITH {ALL_TERMS}, {EXPANDED} SELECT * FROM expanded")
def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vocabulary(spark, sf_dir)
    return terms.expand_queries(queries(spark, sf_dir), known, terms.short_aliases(known))


LETTERS = "list_transform(range(97, 123), lambda c: (length({0}) - length(replace({0}, chr(c::INTEGER), '')))::DOUBLE)"
UNIT = "CASE WHEN list_sum(list_transform(n, lambda x: x * x)) = 0 THEN n ELSE list_transform(n, lambda x: (x / sqrt(list_sum(list_transform(n, lambda y: y * y))))::FLOAT::DOUBLE) END"


@query(f"""WITH {ALL_TERMS}, {EXPANDED}, {CHUNKS_SQL},
qv AS (SELECT query_id, expanded, {UNIT} AS v FROM (SELECT *, {LETTERS.format("expanded")} AS n FROM expanded)),
cv AS (SELECT {VEC_ID} AS vec_id, essay_path, essay_slug, heading, chunk_index, substr(text, 1, 2000) AS body, {UNIT} AS v FROM (SELECT *, {LETTERS.format("text")} AS n FROM chunks)),
pr AS (SELECT query_id, vec_id, round(list_dot_product(q.v, c.v), 6) + 0.0 AS ann FROM qv q, cv c),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ann DESC, vec_id) AS n FROM pr) WHERE n <= 30),
hit AS (SELECT near.query_id, vec_id, essay_slug, heading, chunk_index, body, ann, expanded FROM near JOIN cv USING (vec_id) JOIN qv ON qv.query_id = near.query_id WHERE NOT starts_with(essay_path, 'content/posts/pre-examined') AND ann >= 0.5),
lt AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(replace(lower(expanded), '''', ''), '\\b([a-z][a-z0-9-]{{3,}})\\b', 1), lambda w: w NOT IN {_STOPS})) AS terms FROM expanded),
ce AS (SELECT hit.*, CASE WHEN len(terms) = 0 THEN 0.0 ELSE (2 * {MATCH.format("lower(body)")} - len(terms))::DOUBLE / len(terms) END AS ce FROM hit JOIN lt USING (query_id)),
co AS (SELECT *, CASE WHEN ann > 0.5 AND ce < 0 THEN ann ELSE ce END AS second FROM ce),
h AS (SELECT co.query_id, vec_id, essay_slug, chunk_index, round(second + coalesce({MATCH.format("lower(coalesce(heading, '') || ' ' || body)")}, 0) * 0.2, 6) AS score FROM co LEFT JOIN q ON q.query_id = co.query_id WHERE second >= 0),
{BEST.format("h")}
SELECT query_id, vec_id, essay_slug, chunk_index, score::DOUBLE AS score, rank::INTEGER AS rank, 'stale' AS index_status, 'lexical' AS model FROM best WHERE rank <= 5""")
def search_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text asked of the chunks of all documents: expanded, embedded, searched, scored again, boosted and
    cut to each essay's best, with the status of an index that the corpus has left behind."""
    header = {"status": "index_current", "manifest_digest": "sha256:earlier"}
    rows = stored(embeddings.payloads(chunking.chunks(essays(spark, sf_dir)), models.letter_embedder))
    found = retrieve.retrieval(header, True, queries(spark, sf_dir), rows, vocabulary(spark, sf_dir), models.letter_embedder, "letters", "lexical", models.lexical_scorer)
    meta = found.meta
    return found.chunks.select("query_id", "vec_id", "essay_slug", "chunk_index", "score", "rank", F.lit(meta["index_status"]).alias("index_status"), F.lit(meta["model"]).alias("model"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the words of one benchmark text, dealt out in turn."""
    n = table(spark, sf_dir, "benchmark").count()
    words = table(spark, sf_dir, "benchmark").select("item_id", terms.literal_terms(F.col("text")).alias("terms"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", (F.col("doc_id") % n).alias("item_id"))
    return docs.join(words, "item_id")


ASKED = f"{TERMS}, a AS (SELECT doc_id, text, source, item_id, len(list_distinct(terms)) AS n_terms, {MATCH.format('lower(text)')} AS hits FROM documents d JOIN terms t ON t.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"


@query(f"WITH {ASKED} SELECT doc_id, item_id, n_terms::INTEGER AS n_terms, hits::INTEGER AS hits FROM a")
def term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("doc_id", "item_id", F.size("terms").alias("n_terms"), text.matching_terms(F.col("terms"), F.col("text")).alias("hits"))


@query(f"WITH {ASKED} SELECT doc_id, item_id, round(hits * 0.2, 6)::DOUBLE AS boost FROM a")
def term_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("doc_id", "item_id", F.round(terms.overlap_boost(F.col("terms"), F.col("text")), 6).alias("boost"))


@query(f"WITH {ASKED}, r AS (SELECT item_id, doc_id, round(hits * 10 + length(text) / 1000000.0 - CASE WHEN source = 'src1' THEN 8 ELSE 0 END, 6)::DOUBLE AS relevance FROM a) SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc_id)::INTEGER AS rank FROM r")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = terms.relevance(F.col("terms"), F.col("text"), F.length("text") / 1000000.0, F.col("source") == "src1")
    rows = asked(spark, sf_dir).select("item_id", "doc_id", F.round(score, 6).alias("relevance"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("relevance"), "doc_id")))


@query(f"""WITH {TERMS}, r AS (SELECT item_id AS query_id, doc_id, round({MATCH.format("lower(coalesce(text, ''))")} * 10 + length(coalesce(text, '')) / 1000000.0 - CASE WHEN source = 'src1' THEN 8 ELSE 0 END, 6)::DOUBLE AS relevance FROM documents, terms),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id)::INTEGER AS rank FROM r) SELECT * FROM o WHERE rank <= 10""")
def corpus_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the whole corpus that are most relevant to each benchmark text."""
    asked_ = stored(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms.literal_terms(F.col("text")).alias("terms")))
    body = F.coalesce("text", F.lit(""))
    base = F.round(postings.base_score(F.length(body) / 1000000.0, F.coalesce(F.col("source") == "src1", F.lit(False))), 6)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), body.alias("body"), base.alias("base"))
    found = postings.Postings(docs, asked_.select(F.explode("terms").alias("term"))).top(asked_, 10)
    return found.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("relevance"), "rank")


@query(f"SELECT page_id, {sql_chain('html', text.LINE_RULES)} AS plain FROM pages")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.plain_line(F.col("html")).alias("plain"))


@query(f"SELECT doc_id, {sql_chain('text', text.PASSAGE_RULES)} AS passage FROM documents")
def clean_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_passage(F.col("text")).alias("passage"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^\[\d+\]\s*', '') AS t FROM documents),
g AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, substr(lower(t), i, 18) AS gram FROM (SELECT doc_id, t, unnest(range(1, length(t) - 16)) AS i FROM t)) GROUP BY doc_id, gram HAVING count(*) >= 3),
w AS (SELECT doc_id, regexp_split_to_array(lower(t), '\s+') AS words FROM t)
SELECT w.doc_id, g.doc_id IS NOT NULL AS repeated_gram, len(words) >= 10 AND len(list_distinct(words)) / len(words) < 0.4 AS few_words FROM w LEFT JOIN g USING (doc_id)""")
def repetition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.clean_generated(F.col("text"))
    few = (F.size(F.split(F.lower(t), r"\s+")) >= 10) & (text.unique_word_share(t) < 0.4)
    return table(spark, sf_dir, "documents").select("doc_id", text.repeated_gram(t).alias("repeated_gram"), few.alias("few_words"))


@query()
def generation_flaws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that would speak against each document if a generator had written it.

    Its SQL would compare all pairs of neighbouring blocks of every text, for minutes; tests hold it against the pattern.
    """
    return text.with_flaws(table(spark, sf_dir, "documents").select("doc_id", "text"))


MACHINES = {
    "embed": ("no_index index_current stale sync_failed sync_running sync_pending", "deploy_build_ok posts_digest_changed schedule_sync sync_retry posts_digest_unchanged sync_complete sync_start sync_error"),
    "backfill": ("backlog_pending batch_running batch_committed backlog_complete batch_failed", "daily_schedule batch_upsert_ok backlog_remaining backlog_drained batch_error batch_retry archive_content_changed"),
    "retrieve": ("anonymous session_active", "retrieval_request index_stale"),
}
_MET = "VALUES " + ", ".join(f"('{m}', '{s}', '{e}')" for m, (states, events) in MACHINES.items() for s in states.split() for e in events.split())


@query(f"""WITH e(edge, machine, state, event, next_state) AS (VALUES
 ('EM01', 'embed', 'no_index', 'deploy_build_ok', 'sync_running'), ('EM02', 'embed', 'index_current', 'posts_digest_changed', 'stale'), ('EM03', 'embed', 'stale', 'sync_start', 'sync_running'),
 ('EM04', 'embed', 'stale', 'schedule_sync', 'sync_pending'), ('EM05', 'embed', 'sync_pending', 'sync_start', 'sync_running'), ('EM06', 'embed', 'sync_running', 'sync_complete', 'index_current'),
 ('EM07', 'embed', 'sync_running', 'sync_error', 'sync_failed'), ('EM08', 'embed', 'sync_failed', 'sync_retry', 'sync_running'), ('EM09', 'embed', 'index_current', 'posts_digest_unchanged', 'index_current'),
 ('BF01', 'backfill', 'backlog_pending', 'daily_schedule', 'batch_running'), ('BF02', 'backfill', 'batch_running', 'batch_upsert_ok', 'batch_committed'), ('BF03', 'backfill', 'batch_committed', 'backlog_remaining', 'backlog_pending'),
 ('BF04', 'backfill', 'batch_committed', 'backlog_drained', 'backlog_complete'), ('BF05', 'backfill', 'batch_running', 'batch_error', 'batch_failed'), ('BF06', 'backfill', 'batch_failed', 'batch_retry', 'batch_running'),
 ('BF07', 'backfill', 'backlog_pending', 'archive_content_changed', 'backlog_pending'), ('BF08', 'backfill', 'backlog_complete', 'archive_content_changed', 'backlog_pending'),
 ('VR01', 'retrieve', 'anonymous', 'retrieval_request', 'anonymous'), ('VR02', 'retrieve', 'session_active', 'retrieval_request', 'session_active'), ('VR03', 'retrieve', 'session_active', 'index_stale', 'session_active')),
met(machine, state, event) AS ({_MET}), n AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY state, event) - 1 AS i, count(*) OVER (PARTITION BY machine) AS of FROM met)
SELECT d.doc_id, n.machine, n.state, n.event, e.edge, e.next_state FROM documents d JOIN n ON n.i = d.doc_id % n.of LEFT JOIN e USING (machine, state, event)""")
def saga_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document meets one state and event of every machine, by turns all that there are."""
    rows = None
    for machine, (states, events) in MACHINES.items():
        pairs = sorted((s, e) for s in states.split() for e in events.split())
        pick = F.element_at(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(e).alias("event")) for s, e in pairs]), (F.col("doc_id") % len(pairs) + 1).cast("int"))
        part = table(spark, sf_dir, "documents").select("doc_id", F.lit(machine).alias("machine"), pick.alias("p")).select("doc_id", "machine", "p.*")
        rows = part if rows is None else rows.unionByName(part)
    return sagas.step(rows)


STATUS = "CASE doc_id % 6 WHEN 0 THEN 'no_index' WHEN 1 THEN 'index_current' WHEN 2 THEN 'stale' WHEN 3 THEN 'sync_failed' WHEN 4 THEN 'sync_pending' ELSE 'sync_running' END"


@query(f"""SELECT doc_id, status, CASE WHEN n_chars % 7 = 0 THEN 'sync_error' WHEN n_chars % 7 = 1 THEN 'sync_complete' WHEN status = 'index_current' AND n_chars % 3 = 0 THEN 'posts_digest_unchanged'
 WHEN status = 'index_current' AND n_chars % 3 = 1 THEN 'posts_digest_changed' WHEN status = 'no_index' THEN 'deploy_build_ok' WHEN status IN ('stale', 'sync_pending') THEN 'sync_start' WHEN status = 'sync_failed' THEN 'sync_retry' ELSE 'sync_start' END AS event
 FROM (SELECT doc_id, n_chars, {STATUS} AS status FROM documents)""")
def resolve_sync_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, status = F.col("n_chars"), F.expr(STATUS)
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), sagas.sync_event(n % 7 == 0, n % 7 == 1, status, n % 3 == 1, n % 3 == 0).alias("event"))


BACKFILL = "CASE doc_id % 5 WHEN 0 THEN 'backlog_pending' WHEN 1 THEN 'batch_running' WHEN 2 THEN 'batch_committed' WHEN 3 THEN 'batch_failed' ELSE 'backlog_complete' END"


@query(f"""SELECT doc_id, CASE WHEN status IN ('batch_running', 'batch_committed') THEN 'batch_failed' ELSE status END AS status,
 CASE WHEN status = 'backlog_complete' THEN 'archive_content_changed' WHEN status IN ('batch_running', 'batch_committed', 'batch_failed') THEN 'batch_retry' WHEN changed THEN 'archive_content_changed' ELSE 'daily_schedule' END AS event
 FROM (SELECT doc_id, n_chars % 2 = 1 AS changed, {BACKFILL} AS status FROM documents)""")
def resolve_backfill_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr(BACKFILL)
    return table(spark, sf_dir, "documents").select("doc_id", sagas.settled(status).alias("status"), sagas.backfill_event(status, F.col("n_chars") % 2 == 1).alias("event"))


@query("SELECT doc_id, k, least(60, greatest(6 * k, k + 5)) AS usual, least(60, greatest(k, n_chars // 50)) AS clamped FROM (SELECT doc_id, n_chars, doc_id % 20 + 1 AS k FROM documents)")
def pool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 20 + 1
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k"), retrieve.pool_size(k).cast("long").alias("usual"), retrieve.pool_size(k, F.col("n_chars") / 50).cast("long").alias("clamped"))


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN n <= 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '>20' END AS bucket FROM (SELECT n_chars // 500 AS n FROM documents)) GROUP BY 1")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(text.size_bucket(F.floor(F.col("n_chars") / 500)).alias("bucket")).agg(F.count("*").alias("n"))


def _again(column: str, pattern: str, by: str, times: int = 2) -> str:
    """A replacement whose matches may touch: what the first pass has eaten the next one sees."""
    for _ in range(times):
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return column


_W, _P, _C, _J = "\ufdd0", "\ufdd5", "\ufdd4", "\ufdd3"  # in addresses, inside of words, a cut, a cut taken back
_SHELTER = f"array_to_string(list_transform(between, lambda b, i: b || coalesce(translate(found[i], '.!?\u2026', '{_W}\ufdd1\ufdd2\ufdd6'), '')), '')"
_ADDRESS = r"(?i)\b(?:https?://|ftp://|www\.)[^\s<>)\"\x27]+|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_STOPS_IN = _again(_again(_again(_again(_SHELTER, r"([0-9])\.([0-9])", rf"\1{_P}\2"), r"([A-Za-z0-9])\.([A-Za-z])", rf"\1{_P}\2"), rf"([.{_P}{_W}])\.", rf"\1{_P}"), rf"\.([.{_P}{_W}])", rf"{_P}\1")
_STOPS_IN = _again(_STOPS_IN, r"(^|[\s(\"\x27])(\p{L})\.(\s{1,2}\p{Lu})", rf"\1\2{_P}\3", 3)
_STOPS_IN = _again(_STOPS_IN, rf"(?i)(^|[^a-z])({'|'.join(sentences.ABBREVIATIONS).replace('.', f'[{_P}{_W}]')})\.", rf"\1\2{_P}")
_CUTS = _again(_again("t", r"([!?\u2026][\"\x27)\]]*)\s+(\S)".replace("\\u2026", "\u2026"), rf"\1{_C}\2"), r"(\.[\"\x27)\]]*)\s+([\p{Lu}\"\u00ab])".replace("\\u00ab", "\u00ab"), rf"\1{_C}\2")
_JOINS = _again("t", rf"{_C}([^{_C}{_J}]{{1,7}}|[)\]\"\x27\u00bb\u2014\u2013-]+)({_C}|{_J}|$)".replace("\\u00bb", "\u00bb").replace("\\u2014", "\u2014").replace("\\u2013", "\u2013"), rf"{_J}\1\2", 2)


@query(f"""WITH p AS (SELECT doc_id, {sql_chain("translate(coalesce(text, ''), '" + sentences.SPACES + "', '" + " " * len(sentences.SPACES) + "')", text.PASSAGE_RULES)} AS t FROM documents),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\.{{3,}}', '\u2026', 'g'), '([!?])[!?]+', '\\1', 'g') AS t FROM p),
a AS (SELECT doc_id, string_split_regex(t, '{_ADDRESS}') AS between, regexp_extract_all(t, '{_ADDRESS}') AS found FROM e),
m AS (SELECT doc_id, {_STOPS_IN} AS t FROM a), c AS (SELECT doc_id, {_CUTS} AS t FROM m), j AS (SELECT doc_id, {_JOINS} AS t FROM c),
s AS (SELECT doc_id, t, regexp_extract_all(t, '(?s)(.{{12,}}?)(?:{_C}|$)', 1) AS parts FROM j),
r AS (SELECT doc_id, parts, substr(t, 1 + coalesce(list_sum(list_transform(parts, lambda x: length(x) + 1)), 0)::BIGINT) AS rest FROM s),
w AS (SELECT doc_id, CASE WHEN rest = '' THEN parts WHEN len(parts) = 0 THEN [rest] ELSE parts[1:len(parts) - 1] || [parts[-1] || ' ' || rest] END AS parts FROM r),
x AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: translate(x, '{_W}{_P}\ufdd1\ufdd2\ufdd6{_C}{_J}', '..!?\u2026  ')), lambda x: length(x) >= 8) AS found FROM w)
SELECT doc_id, len(found)::INTEGER AS n_sentences, sha256(array_to_string(found, chr(10))) AS sha256 FROM x""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", sentences.split_sentences("text").alias("s"))
    return found.select("doc_id", F.size("s").alias("n_sentences"), F.sha2(F.array_join("s", "\n"), 256).alias("sha256"))


@query()
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to each benchmark text from the five documents of its share that are most relevant to it."""
    ranked = relevance_rank(spark, sf_dir).where("rank <= 5")
    rows = ranked.join(asked(spark, sf_dir), ["item_id", "doc_id"])
    rows = rows.select(F.col("item_id").alias("query_id"), "terms", "rank", F.lit(None).cast("string").alias("heading"), "text", (F.col("source") == "src1").alias("is_index"))
    return answer.extractive(rows)

