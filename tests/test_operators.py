import os

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import backfill, conversations, manifest, models, retrieve, sagas, terms
from sparkloom.sources import corpus, tables
from sparkloom.streaming import backfill as stream

ENTRY = "essay_path string, content_hash string, total_chunks long, next_chunk_index long, committed_chunks long"
LIVE = "essay_path string, content_hash string"


def entries(spark, rows):
    return spark.createDataFrame([(p, h, t, n, n) for p, h, t, n in rows], ENTRY)


@pytest.mark.parametrize(
    "known, live, want, changed, drained",
    [
        ([], [("p", "a")], [("p", "embed_new", None)], False, False),
        ([("p", "a", 100, 40)], [("p", "a")], [("p", "embed_resume", None)], False, False),
        ([("p", "a", 100, 100)], [("p", "a")], [], False, True),
        ([("p", "old", 120, 120)], [("p", "new")], [("p", "reembed_changed", 120)], True, False),
        ([("p", "a", 80, 80)], [], [("p", "delete_removed", 80)], True, False),
        ([("p", "a", 100, 100), ("q", "b", 200, 50)], [("p", "a"), ("q", "b")], [("q", "embed_resume", None)], False, False),
    ],
)
def test_backlog(spark, known, live, want, changed, drained):
    actions = manifest.backlog(entries(spark, known), spark.createDataFrame(live, LIVE))
    assert [tuple(r) for r in actions.collect()] == want
    assert tuple(manifest.backlog_flags(actions).first()) == (changed, drained)


def test_merge_and_verify(spark):
    remote = entries(spark, [("p", "a", 500, 100), ("q", "new", 500, 100)])
    local = entries(spark, [("p", "a", 500, 180), ("q", "stale", 500, 300), ("r", "x", 9, 9)])
    got = {r["essay_path"]: (r["content_hash"], r["committed_chunks"]) for r in manifest.merge_cursors(remote, local).collect()}
    assert got == {"p": ("a", 180), "q": ("new", 100)}
    assert spark.range(1).select(manifest.merged_status(F.lit("batch_running"), F.lit("batch_failed"))).first()[0] == "batch_failed"
    have = spark.createDataFrame([("p", 0), ("p", 89)], "essay_path string, chunk_index long")
    missing = manifest.verify(entries(spark, [("p", "a", 500, 180)]), have).collect()
    assert [tuple(r) for r in missing] == [("p", 179)]
    assert manifest.rollup(entries(spark, [("p", "a", 40, 40), ("q", "b", 10, 10)])).first()["committed_archive_vectors"] == 50


def test_plans_staleness_and_digest(spark):
    a, b = spark.createDataFrame([("a", "1")], LIVE), spark.createDataFrame([("b", "2")], LIVE)
    known = a.withColumn("total_chunks", F.lit(1))
    assert sorted(map(tuple, manifest.sync_plan(known, b).collect())) == [("a", "remove"), ("b", "process")]
    assert not manifest.is_stale(known, a.limit(0)).first()[0] and manifest.is_stale(known, a.unionByName(b)).first()[0]
    assert manifest.is_stale(known, a, has_digest=False).first()[0] and not manifest.is_stale(known, a).first()[0]
    digest = lambda df: manifest.corpus_digest(df).first()[0]
    assert digest(a.unionByName(b)) == digest(b.unionByName(a)) != digest(a) and digest(a.limit(0)) != digest(a)
    back = manifest.from_json(manifest.as_json(entries(spark, [("p", "a", 3, 2)])))
    assert tuple(back.first()) == ("p", "a", 3, 2, 2)
    assert tuple(manifest.from_json(spark.createDataFrame([("p", "{oops")], "essay_path string, payload string")).first()) == ("p", "", 0, 0, 0)


def test_budget(spark):
    assert backfill.WriteBudget.resolved({}).chunk_write_budget == 9495
    assert backfill.WriteBudget.resolved({"PROVIDER_DAILY_CAP": "2000", "WRITE_BUDGET": "100"}).chunk_write_budget == 95
    for env in ({"WRITE_BUDGET": "10000"}, {"WRITE_BUDGET": "5"}, {"WRITE_BUDGET": "lots"}, {"WRITE_BUDGET": "-5"}):
        with pytest.raises(ValueError):
            backfill.WriteBudget.resolved(env)
    meter = backfill.BudgetMeter(backfill.WriteBudget(write_budget=105))
    meter.spend(chunks=60)
    meter.spend(chunks=40)
    meter.spend(bookkeeping=2)
    assert (meter.spent, meter.remaining) == (102, 0)
    with pytest.raises(ValueError):
        meter.spend(chunks=1)


def test_backfill_runs_until_drained(spark):
    essays = spark.createDataFrame([(f"content/posts/unfolding/chatgpt-202{i}.mdx", " ".join(["w"] * (2000 + i))) for i in range(3)], "essay_path string, body string")
    known, states = entries(spark, [("gone", "x", 4, 4)]), []
    for _ in range(6):
        plan, after, state = backfill.run_batch(essays, known, backfill.WriteBudget(write_budget=11))
        assert plan.agg(F.sum("deletes_granted") + F.sum("upserts_granted")).first()[0] <= 6
        known = spark.createDataFrame(after.collect(), ENTRY)
        states.append(state)
        if state == "backlog_complete":
            break
    assert states[-1] == "backlog_complete" and len(states) == 4
    assert all(r["next_chunk_index"] == r["total_chunks"] == 5 for r in known.collect())


def test_sagas(spark):
    rows = spark.createDataFrame([(e[0], e[2], e[3]) for e in sagas.EDGES] + [("backfill", "backlog_complete", "daily_schedule")], "machine string, state string, event string")
    got = sagas.step(rows).collect()
    assert sorted(r["edge"] for r in got if r["edge"]) == sorted(e[1] for e in sagas.EDGES) and sum(r["edge"] is None for r in got) == 1
    cases = [("backlog_pending", False, "daily_schedule"), ("batch_failed", False, "batch_retry"), ("batch_running", False, "batch_retry"), ("batch_committed", True, "batch_retry"), ("backlog_pending", True, "archive_content_changed"), ("backlog_complete", True, "archive_content_changed")]
    df = spark.createDataFrame(cases, "s string, c boolean, w string")
    assert sagas.next_state("embed", "stale", "sync_start") == "sync_running"
    with pytest.raises(ValueError):
        sagas.next_state("retrieve", "active", "retrieval_request")
    assert [r[0] for r in spark.createDataFrame([(True,), (False,)], "h boolean").select(sagas.session_state(F.col("h"))).collect()] == ["session_active", "anonymous"]
    assert all(r[0] == r[1] for r in df.select(sagas.backfill_event(F.col("s"), F.col("c")), "w").collect())


def test_terms(spark):
    words = terms.glossary(spark)
    aliases = terms.short_aliases(words)
    some = lambda names: {r["alias"] for r in terms.short_aliases(spark.createDataFrame([(n,) for n in names], "term string")).collect()}
    assert {"top", "topo", "she"} <= some(["topos", "sheaf"]) and "con" not in some(["concrescence", "conjunction"])
    asked = spark.createDataFrame([(0, "define a coalgebra please"), (1, "define a coalgebre please"), (2, "cookie settings"), (3, "is sem near?"), (4, "prehen next to μf or nuf")], "query_id int, query string")
    expanded = {r["query_id"]: r["expanded"] for r in terms.expand_queries(asked, words, aliases).collect()}
    assert terms.EXPANSIONS["coalgebra"] in expanded[0] and terms.EXPANSIONS["coalgebra"] in expanded[1]
    assert expanded[2] == "cookie settings" and terms.EXPANSIONS["semiosis"] in expanded[3] and terms.INITIAL in expanded[4] and terms.FINAL in expanded[4]
    found = {r["query_id"]: r for r in terms.query_terms(asked, words, aliases).collect()}
    assert found[1]["fuzzy"] == ["coalgebra"] and {"prehen", "prehension"} <= set(found[4]["terms"])
    row = spark.createDataFrame([(["moon", "tide"], "on tides", "Moon")], "t array<string>, b string, h string")
    assert tuple(row.select(terms.overlap_boost(F.col("t"), F.col("b")), terms.overlap_boost(F.col("t"), F.col("b"), F.col("h"))).first()) == pytest.approx((0.0, 0.2))


def test_conversations(spark):
    rows = spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], f"m{i}") for i in range(20)] + [(1, 20, "system", "s")], "conversation_id int, ord int, role string, content string")
    got = conversations.history(rows, 4).orderBy("ord").collect()
    assert [r["content"] for r in got] == ["m16", "m17", "m18", "m19"] and got[1]["role"] == "model"
    assert conversations.messages_page(rows, 3).count() == 3
    before = spark.createDataFrame([(1, 10)], "conversation_id int, before int")
    pick = lambda near: [r["ord"] for r in conversations.messages_before(rows, before, 2, near).orderBy("ord").collect()]
    assert (pick(False), pick(True)) == ([0, 1], [8, 9])
    for n in (0, 201):
        with pytest.raises(ValueError):
            conversations.page_limit(n)
    found = spark.createDataFrame([(7, 1, "/s", None, "H", "**b** " + "x" * 1300), (7, 2, "", "p.mdx", None, "t"), (7, 3, None, None, None, "u"), (8, 1, None, None, None, None)], "query_id int, rank int, essay_slug string, essay_path string, heading string, text string")
    block = {r["query_id"]: r["context"] for r in conversations.context_block(found).collect()}
    assert block[7] == "[1] /s \u2014 H\nb " + "x" * 1198 + "\u2026\n\n[2] p.mdx\nt\n\n[3] passage-3\nu" and block[8] == conversations.NO_PASSAGES
    as_dicts = [r.asDict() for r in found.where("query_id = 7").orderBy("rank").collect()]
    prompt = spark.range(1).select(conversations.system_prompt(F.lit(block[7])), conversations.user_turn(F.lit(" q \n"))).first()
    assert conversations.prompt_of(as_dicts) == prompt[0] and prompt[1] == "q" and conversations.prompt_of([]).endswith(conversations.NO_PASSAGES)


def test_search_and_embedder(spark):
    embed = models.hashed_embedder(16)
    vectors = spark.createDataFrame([(i, embed([f"word{i} other{i % 3}"])[0].tolist()) for i in range(30)] + [(99, None)], "vec_id long, vector array<float>")
    asked = vectors.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "vector")
    top = retrieve.similar(asked, vectors, 1).collect()
    assert all(r["score"] == pytest.approx(1, abs=1e-4) for r in top) and len(top) == 3
    assert retrieve.similar(asked.limit(0), vectors, 1).count() == 0
    texts = spark.createDataFrame([("a b",), (None,)], "t string").select(models.embedding(embed)("t").alias("v")).collect()
    assert texts[0]["v"] == pytest.approx(embed(["a b"])[0].tolist())


def test_corpus_tables_and_stream(spark, tmp_path):
    root = tmp_path / "site"
    for name, body in {"content/posts/examined/a.mdx": "one\r\ntwo", "content/posts/unfolding/chatgpt-2024.mdx": "stub", "content/posts/data/unfolding-chatgpt/chatgpt-2024.md": "full body", "content/posts/examined/x.png": "no"}.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_text(body, newline="")
    found = corpus.files(spark, str(root))
    got = {r["essay_path"]: r["body"] for r in corpus.essays(found, with_archives=True).collect()}
    assert got == {"content/posts/examined/a.mdx": "one\ntwo", "content/posts/unfolding/chatgpt-2024.mdx": "full body"}
    assert corpus.archives(found).first()["essay_slug"] == "/posts/unfolding/chatgpt-2024"

    table = tables.VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    table.upsert(rows(("a", 1), ("b", 2)))
    table.upsert(rows(("b", 3), ("c", 4)))
    table.delete(rows(("a", 0)))
    assert sorted(map(tuple, table.read().collect())) == [("b", 3), ("c", 4)] and table.version() == 3
    assert {r["id"]: r["v"] for r in table.fetch(rows(("b", 0), ("z", 0))).collect()} == {"b": 3, "z": None}
    with pytest.raises(ValueError):
        tables.appended(table, rows(("b", 9)))
    assert tables.read_manifest(None, "{bad", {"status": "no_index"}) == {"status": "no_index"}
    assert tables.read_manifest(None, '{"extra": 1}', {"status": "no_index"}) == {"status": "no_index", "extra": 1}

    source = str(tmp_path / "in")
    essays = spark.createDataFrame([("content/posts/examined/a.mdx", "some words here")], "essay_path string, body string")
    essays.write.parquet(source)
    vectors = tables.VersionedTable(spark, str(tmp_path / "vectors"))
    for _ in range(2):
        stream.start(spark, source, vectors, str(tmp_path / "cp"), models.hashed_embedder(8)).awaitTermination()
    assert [r["id"] for r in vectors.read().collect()] == ["posts--examined--a#0"] and vectors.version() == 1


def repo_of(spark, folder):
    names, stamps = iter(range(99)), iter(range(99))
    pair = [tables.VersionedTable(spark, f"{folder}/{n}", buckets=4) for n in ("conversations", "messages")]
    return conversations.ConversationRepo(*pair, clock=lambda: f"t{next(stamps):02d}", new_id=lambda: f"id{next(names)}")


def test_persisted_conversation(spark, tmp_path):
    repo, asked = repo_of(spark, tmp_path), []
    respond = lambda q, synthesize: {"answer": f"about {q}", "chunks": [{"essay_slug": "/a", "heading": None, "text": "body"}], "meta": {"index_status": "index_current"}}
    alone = conversations.conversational_answer("q", respond)
    assert alone["conversation_id"] is None and alone["answer"] == "about q"
    with pytest.raises(RuntimeError):
        conversations.conversational_answer("q", respond, title="t")
    with pytest.raises(ValueError):
        conversations.conversational_answer("q", respond, repo, conversation_id="nope")
    first = conversations.conversational_answer("one", respond, repo, title=" T ")

    def client(messages, system):
        asked.append((messages, system))
        return {"text": "from the model", "model": "m"}

    complete = conversations.completion({"OPENAI_API_KEY": "k"}, {"openai": client})
    second = conversations.conversational_answer(" two ", respond, repo, first["conversation_id"], complete=complete)
    assert second["llm_meta"] == {"llm_provider": "openai", "llm_model": "m", "llm_fallback": False} and second["meta"]["answer_mode"] == "generative"
    assert [m["content"] for m in asked[0][0]] == ["one", "about one", "two"] and "[1] /a\nbody" in asked[0][1]
    missing = conversations.completion({"LLM_PROVIDER": "Anthropic"}, {})
    third = conversations.conversational_answer("three", respond, repo, first["conversation_id"], complete=missing)
    assert third["llm_meta"]["llm_fallback"] and third["llm_meta"]["llm_provider"] == "anthropic" and conversations.completion({}, {}) is None
    kept = repo.list(first["conversation_id"])
    assert [(m["role"], m["content"]) for m in kept] == [("user", "one"), ("assistant", "about one"), ("user", " two "), ("assistant", "from the model"), ("user", "three"), ("assistant", "about three")]
    assert [m["ord"] for m in repo.list(first["conversation_id"], 2, before=kept[4]["id"])] == [0, 1]
    assert repo.get(first["conversation_id"])["updated_at"] > kept[-1]["created_at"] and repo.get("nope") is None
    for status in ("no_index", "sync_failed"):
        off = lambda q, synthesize, s=status: {"answer": "x", "chunks": [], "meta": {"index_status": s}}
        assert conversations.conversational_answer("q", off, repo, first["conversation_id"], complete=complete)["message_id"] is None
    rows = spark.createDataFrame([("a", "user", "hi", "t", "{}")], "id string, role string, content string, created_at string, llm_meta string")
    assert conversations.listed(rows).columns == ["id", "role", "content", "created_at"]


def vector_ids(table):
    return sorted(r["id"] for r in table.read().select("id").collect())


def test_sync_writes(spark, tmp_path):
    from sparkloom.operators import sync

    vectors, manifest_ = (tables.VersionedTable(spark, str(tmp_path / n), k, 4) for n, k in (("v", "id"), ("m", "essay_path")))
    essays = lambda *x: spark.createDataFrame([(f"content/posts/examined/{n}.mdx", " ".join(["w"] * size)) for n, size in x], "essay_path string, body string")
    embed = models.hashed_embedder(4)
    first = sync.run_sync(essays(("a", 600), ("b", 10)), vectors, manifest_, embed)
    assert (first["status"], first["vector_count"], first["last_job"]["chunks_written"], first["last_job"]["files_scanned"]) == ("index_current", 3, 3, 2)
    version = manifest_.version()
    assert sync.run_sync(essays(("a", 600), ("b", 10)), vectors, manifest_, embed)["last_sync_at"] == first["last_sync_at"] and manifest_.version() == version
    second = sync.run_sync(essays(("a", 20), ("c", 10)), vectors, manifest_, embed)
    assert (second["last_job"]["chunks_written"], second["last_job"]["chunks_deleted"]) == (2, 2)
    assert vector_ids(vectors) == ["posts--examined--a#0", "posts--examined--c#0"] and second["manifest_digest"] != first["manifest_digest"]

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        sync.run_sync(essays(("d", 5)), vectors, manifest_, broken)
    header, entries_ = sync.read(manifest_, sync.SYNC_DEFAULTS, sync.SYNC_ENTRY)
    assert header["status"] == "sync_failed" and "no model" in header["last_error"] and header["last_job"]["error_stage"] == "embed" and entries_.count() == 2
    assert sync.run_sync(essays(("d", 5)), vectors, manifest_, embed)["status"] == "index_current" and vector_ids(vectors) == ["posts--examined--d#0"]
    with pytest.raises(ValueError):
        sync.run_sync(essays(("d", 5)), vectors, manifest_, embed, trigger="cron")


def test_backfill_writes_until_drained(spark, tmp_path):
    from sparkloom.operators import sync

    vectors, manifest_ = (tables.VersionedTable(spark, str(tmp_path / n), k, 4) for n, k in (("v", "id"), ("m", "essay_path")))
    essays = lambda *x: spark.createDataFrame([(f"content/posts/unfolding/gemini-20{y}.mdx", " ".join(["w"] * size)) for y, size in x] + [("content/posts/examined/a.mdx", "not an archive")], "essay_path string, body string")
    budget, embed = backfill.WriteBudget(write_budget=8), models.hashed_embedder(4)
    seen = []
    for _ in range(4):
        header = sync.run_backfill(essays((30, 1300), (31, 900)), vectors, manifest_, embed, budget)
        seen.append((header["status"], header["last_run"]["chunks_upserted"], header["committed_archive_vectors"]))
    assert seen == [("backlog_pending", 3, 3), ("backlog_complete", 2, 5), ("backlog_complete", 2, 5), ("backlog_complete", 2, 5)]
    header = sync.run_backfill(essays((31, 400),), vectors, manifest_, embed, budget)
    assert (header["status"], header["last_run"]["chunks_deleted"], header["last_run"]["chunks_upserted"]) == ("backlog_pending", 3, 0)
    header = sync.run_backfill(essays((31, 400),), vectors, manifest_, embed, budget)
    assert header["status"] == "backlog_complete" and vector_ids(vectors) == ["posts--unfolding--gemini-2031#0"]
    only = spark.createDataFrame([("content/posts/unfolding/gemini-2032.mdx",)], "essay_path string")
    header = sync.run_backfill(essays((31, 900), (32, 10)), vectors, manifest_, embed, budget, only=only)
    assert header["last_run"]["chunks_upserted"] == 1 and {r["essay_path"][-8:-4]: r["total_chunks"] for r in manifest_.read().collect()} == {"2031": 1, "2032": 1}


def test_tables_in_buckets(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), buckets=8)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    table.upsert(rows(*[(f"k{i}", i) for i in range(40)]), meta={"n": 1})
    table.upsert(rows(("k1", 100), ("k1", 300), ("k1", 200)), order=F.col("v"))
    assert {r["id"]: r["v"] for r in table.read().collect()}["k1"] == 300 and table.read().count() == 40 and table.meta() == {"n": 1}
    moved = set(table.pointer(2)["buckets"].items()) - set(table.pointer(1)["buckets"].items())
    assert len(moved) == 1  # one bucket was written anew
    table.delete(table.read().select("id"))
    assert table.read().count() == 0 and table.read(2).count() == 40
    assert table.vacuum(1) > 0 and table.versions() == [3]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    waits = []
    assert tables.retried(flaky, sleep=waits.append) == "done" and waits == [0.5, 1.0]
    applied = tables.VersionedTable(spark, str(tmp_path / "applied"), "name", 2)
    steps = {"002": ["CREATE OR REPLACE TEMP VIEW two AS SELECT * FROM one"], "001": ["CREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS x"]}
    assert tables.migrated(spark, steps, applied, "t") == ["001", "002"] and tables.migrated(spark, steps, applied, "t") == []


def test_whole_search(spark):
    embed = models.hashed_embedder(32)
    meta = "struct<essay_slug: string, essay_path: string, heading: string, chunk_index: int, text: string>"
    texts = [("a#0", "/a", "content/posts/examined/a.mdx", "the coalgebra unfolds a stream"), ("a#1", "/a", "content/posts/examined/a.mdx", "a coalgebra again"), ("b#0", "/b", "content/posts/examined/b.mdx", "cooking rice for two"), ("p#0", "/p", "content/posts/pre-examined/p.mdx", "coalgebra draft")]
    rows = [(i, embed([t])[0].tolist(), (s, p, None, 0, t)) for i, s, p, t in texts] + [("__manifest__", embed(["coalgebra"])[0].tolist(), None)]
    vectors = spark.createDataFrame(rows, f"id string, vector array<float>, metadata {meta}")
    asked = spark.createDataFrame([(1, "what is a coalgebra")], "query_id int, query string")
    results, candidates = retrieve.search(asked, vectors, terms.glossary(spark), embed, 3, 0.0, models.lexical_scorer, -1.0)
    assert {r["essay_slug"] for r in candidates.collect()} <= {"/a", "/b"} and results.orderBy("rank").first()["essay_slug"] == "/a"
    score = models.cross_encoder(lambda q, p: [float(len(x.split())) for x in p], 4)
    results, _ = retrieve.search(asked, vectors, terms.glossary(spark), embed, 3, 0.0, score)
    assert results.where("essay_slug = '/b'").first()["score"] == 4.0


def test_deleted_training_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
