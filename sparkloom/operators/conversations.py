"""Conversations: pages of messages, histories and the prompts made of them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.sentences import passage
from sparkloom.sources.tables import VersionedTable, appended

HISTORY, PAGE, LONGEST_PAGE = 12, 50, 200
CONTEXT_CHARS = 1200
# What a model is told, and what it is given where nothing was found.
INSTRUCTION = (
    "You answer questions using only the retrieved essay passages below. "
    "Cite passage numbers like [1] when you rely on a source. "
    "If the passages do not contain enough information, say so briefly."
)
NO_PASSAGES = "No relevant passages were retrieved from the indexed corpus."


def page_limit(limit: int | None) -> int:
    """The page size asked for, checked: 1 to 200, 50 if none is given."""
    n = PAGE if limit is None else limit
    if not 1 <= n <= LONGEST_PAGE:
        raise ValueError(f"limit must be 1 to {LONGEST_PAGE}")
    return n


def messages_page(messages: DataFrame, limit: int | None = None, conversation: str = "conversation_id", order: str = "ord") -> DataFrame:
    """Each conversation's first messages."""
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(order))
    return messages.withColumn("rank", rank).where(F.col("rank") <= page_limit(limit))


def messages_before(messages: DataFrame, cursors: DataFrame, limit: int | None = None, nearest: bool = False, conversation: str = "conversation_id", order: str = "ord") -> DataFrame:
    """Messages before each conversation's cursor (conversation, before): the oldest ones, or those nearest to it."""
    rows = messages.join(cursors, conversation).where(F.col(order) < F.col("before"))
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order) if nearest else F.asc(order)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= page_limit(limit)).drop("before")


def history(messages: DataFrame, last: int = HISTORY, conversation: str = "conversation_id", order: str = "ord") -> DataFrame:
    """The last messages of each conversation as a model sees them: without system ones, the assistant as model."""
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order)))
    rows = messages.where("role <> 'system'").withColumn("rank", rank).where(F.col("rank") <= last)
    return rows.withColumn("role", F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))).drop("rank")


def title_of(slug: Column, heading: Column, path: Column, number: Column) -> Column:
    """What a passage is called: its essay and heading, else its path, else its number. Empty counts as missing."""
    some = lambda c: F.when(c != "", c)
    named = F.concat(F.coalesce(slug, F.lit("")), F.lit(" \u2014 "), some(heading))
    return F.coalesce(named, some(slug), some(path), F.concat(F.lit("passage-"), number.cast("string")))


def cut(body: Column, most: int) -> Column:
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\u2026"))).otherwise(body)


def context_block(rows: DataFrame, key: str = "query_id", order: str = "rank", most: int = CONTEXT_CHARS) -> DataFrame:
    """key and context: the passages of each key as one numbered block, each with its title, cleaned, cut at `most`.

    rows: key, order, essay_slug, essay_path, heading, text; a bounded top k a key. A key of which only a row with a
    null text is there gets the sentence for no passages.
    """
    passage = F.struct(F.col(order).alias("order"), "essay_slug", "essay_path", "heading", cut(text.clean_passage(F.col("text")), most).alias("body"))
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), passage)))
    numbered = F.transform(parts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), title_of(x["essay_slug"], x["heading"], x["essay_path"], i + 1), F.lit("\n"), x["body"]))
    block = F.array_join(numbered, "\n\n")
    return rows.groupBy(key).agg(F.when(F.size(parts) > 0, block).otherwise(NO_PASSAGES).alias("context"))


def touched(messages: DataFrame, conversation: str = "conversation_id", at: str = "created_at") -> DataFrame:
    return messages.groupBy(conversation).agg(F.max(at).alias("updated_at"))


def orphans(messages: DataFrame, conversations: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    return messages.join(conversations, conversation, "left_anti")


def forgotten(conversations: VersionedTable, messages: VersionedTable, ids: DataFrame) -> None:
    """Delete conversations (a column id) and all their messages, those first, so that none is left without its conversation."""
    old = messages.read()
    if old is not None:
        mine = old.join(ids.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi")
        messages.delete(mine.select(messages.key))
    conversations.delete(ids)


def system_prompt(context: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION + "\n\nRetrieved passages:\n"), F.coalesce(context, F.lit(NO_PASSAGES)))


def user_turn(query: Column) -> Column:
    return text.trimmed(query)


def listed(messages: DataFrame) -> DataFrame:
    """Messages as a listing shows them: without what a model and a retrieval had to say about them."""
    return messages.select("id", "role", "content", "created_at")


def with_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """The messages that a turn of each conversation adds: the question as the user's, then the answer.

    messages: conversation_id, ord and others; turns: conversation_id, query, answer and optionally retrieval_meta and
    llm_meta, one row a conversation. A conversation without messages starts at 0. Metadata goes with the answer.
    """
    last = messages.groupBy("conversation_id").agg((F.max("ord") + 1).alias("next"))
    meta = [F.col(c) if c in turns.columns else F.lit(None).cast("string").alias(c) for c in ("retrieval_meta", "llm_meta")]
    rows = turns.select("conversation_id", "query", "answer", *meta).join(last, "conversation_id", "left").withColumn("next", F.coalesce("next", F.lit(0)))
    none = F.lit(None).cast("string")
    said = lambda n, role, body, kept: F.struct((F.col("next") + n).alias("ord"), F.lit(role).alias("role"), F.col(body).alias("content"), *[(F.col(c) if kept else none).alias(c) for c in ("retrieval_meta", "llm_meta")])
    both = F.array(said(0, "user", "query", False), said(1, "assistant", "answer", True))
    return rows.select("conversation_id", F.explode(both).alias("m")).select("conversation_id", "m.*")


def persists(conversation_id: str | None, title: str | None) -> bool:
    return bool((conversation_id or "").strip() or (title or "").strip())


def merged_meta(meta: Column, provider: Column, model: Column, fallback: Column) -> Column:
    """An answer's metadata with those of the model that wrote it."""
    return meta.withField("llm_provider", provider).withField("llm_model", model).withField("llm_fallback", F.coalesce(fallback, F.lit(False)))


class ConversationRepo:
    """Conversations and messages in two keyed tables; ids and stamps come from functions that can be set."""

    CONVERSATION = "id string, title string, created_at string, updated_at string"
    MESSAGE = "id string, conversation_id string, ord long, role string, content string, retrieval_meta string, llm_meta string, created_at string"

    def __init__(self, conversations: VersionedTable, messages: VersionedTable, clock: Callable[[], str], new_id: Callable[[], str] = lambda: str(uuid.uuid4())):
        self.conversations, self.messages, self.clock, self.new_id, self.spark = conversations, messages, clock, new_id, conversations.spark

    def create(self, title: str | None = None) -> dict:
        now = self.clock()
        row = {"id": self.new_id(), "title": title, "created_at": now, "updated_at": now}
        appended(self.conversations, self.spark.createDataFrame([tuple(row.values())], self.CONVERSATION))
        return row

    def get(self, conversation_id: str) -> dict | None:
        found = self.conversations.fetch(self.spark.createDataFrame([(conversation_id,)], "id string"))
        rows = found.where("created_at IS NOT NULL").collect() if "created_at" in found.columns else []
        return rows[0].asDict() if rows else None

    def touch(self, conversation_id: str) -> None:
        row = self.get(conversation_id)
        if row:
            self.conversations.upsert(self.spark.createDataFrame([(row["id"], row["title"], row["created_at"], self.clock())], self.CONVERSATION))

    def add(self, conversation_id: str, role: str, content: str, retrieval_meta: dict | None = None, llm_meta: dict | None = None) -> dict:
        """A new message of a conversation that must exist; the conversation is touched."""
        if self.get(conversation_id) is None:
            raise ValueError("Conversation not found")
        last = self._of(conversation_id).agg(F.max("ord")).first()[0]
        as_json = lambda x: None if x is None else json.dumps(x)
        row = {"id": self.new_id(), "conversation_id": conversation_id, "ord": 0 if last is None else last + 1, "role": role, "content": content, "retrieval_meta": as_json(retrieval_meta), "llm_meta": as_json(llm_meta), "created_at": self.clock()}
        appended(self.messages, self.spark.createDataFrame([tuple(row.values())], self.MESSAGE))
        self.touch(conversation_id)
        return row

    def _of(self, conversation_id: str) -> DataFrame:
        rows = self.messages.read()
        return (self.spark.createDataFrame([], self.MESSAGE) if rows is None else rows).where(F.col("conversation_id") == conversation_id)

    def list(self, conversation_id: str, limit: int | None = None, before: str | None = None) -> list[dict]:
        """A conversation's messages in order, those before another message if one is named."""
        rows = self._of(conversation_id)
        if before is not None:
            cursor = rows.where(F.col("id") == before).select("conversation_id", F.col("ord").alias("before"))
            rows = messages_before(rows, cursor, limit).drop("rank")
        else:
            rows = messages_page(rows, limit).drop("rank")
        return [r.asDict() for r in rows.orderBy("ord").collect()]


def conversational_answer(query: str, respond: Callable[..., dict], repo: ConversationRepo | None = None, conversation_id: str | None = None, title: str | None = None, complete: Callable[[list[dict], str], dict] | None = None) -> dict:
    """One turn of a conversation: its answer, and the ids under which it was kept.

    respond(query, synthesize) answers without a history: answer, chunks, meta. complete(messages, system) is an outside
    model, given the passages and the last messages: text, provider, model; where it fails, respond answers. Without an
    id or a title nothing is kept. With neither an index nor a sync that went well the model isn't asked.
    """
    none = {"llm_provider": None, "llm_model": None, "llm_fallback": False}
    if not persists(conversation_id, title):
        return {**respond(query, True), "conversation_id": None, "message_id": None, "llm_meta": none}
    if repo is None:
        raise RuntimeError("Persistence unavailable")
    name = (conversation_id or "").strip()
    if name:
        if repo.get(name) is None:
            raise ValueError("Conversation not found")
    else:
        name = repo.create((title or "").strip() or None)["id"]
    said, llm = [{"role": m["role"], "content": m["content"]} for m in repo.list(name)][-HISTORY:], none
    if complete is None:
        result = respond(query, True)
    else:
        result = respond(query, False)
        if result["meta"].get("index_status") in ("no_index", "sync_failed"):
            return {**result, "conversation_id": name, "message_id": None, "llm_meta": llm}
        try:
            got = complete([*said, {"role": "user", "content": query.strip()}], prompt_of(result["chunks"]))
            result = {**result, "answer": got["text"], "meta": {**result["meta"], "generator_model": got["model"], "synthesized": True, "answer_mode": "generative"}}
            llm = {"llm_provider": got["provider"], "llm_model": got["model"], "llm_fallback": False}
        except Exception as error:  # noqa: BLE001  an outside model that fails is a reason to fall back, whatever its error
            result, llm = respond(query, True), {"llm_provider": getattr(error, "provider", None), "llm_model": None, "llm_fallback": True}
    repo.add(name, "user", query)
    meta = {k: result["meta"].get(k) for k in ("index_status", "manifest_digest", "rerank")}
    kept = repo.add(name, "assistant", result["answer"], meta, {"provider": llm["llm_provider"], "model": llm["llm_model"], "fallback": llm["llm_fallback"]})
    return {**result, "meta": {**result["meta"], **llm}, "conversation_id": name, "message_id": kept["id"], "llm_meta": llm}


def prompt_of(chunks: list[dict]) -> str:
    """The system prompt over one question's passages."""
    parts = []
    for i, c in enumerate(chunks, 1):
        slug, body = c.get("essay_slug") or "", passage(c["text"])
        title = f"{slug} \u2014 {c['heading']}" if c.get("heading") else slug or c.get("essay_path") or f"passage-{i}"
        parts.append(f"[{i}] {title}\n{body[:CONTEXT_CHARS]}{chr(0x2026) if len(body) > CONTEXT_CHARS else ''}")
    return f"{INSTRUCTION}\n\nRetrieved passages:\n" + ("\n\n".join(parts) or NO_PASSAGES)


PROVIDERS = ("gemini", "openai", "anthropic")


def provider_of(env: Mapping[str, str]) -> str | None:
    """The provider that is named, else the first one with a key; None without either."""
    named = env.get("LLM_PROVIDER", "").strip().lower()
    return named if named in PROVIDERS else next((p for p in PROVIDERS if env.get(f"{p.upper()}_API_KEY", "").strip()), None)


def completion(env: Mapping[str, str], clients: Mapping[str, Callable[[list[dict], str], dict]]) -> Callable[[list[dict], str], dict] | None:
    """The client of the provider that the environment asks for, None where it asks for none; unknown ones raise when called."""
    provider = provider_of(env)
    if provider is None:
        return None

    def complete(messages: list[dict], system: str) -> dict:
        if provider not in clients:
            error = NotImplementedError(f"provider {provider} has no client")
            error.provider = provider
            raise error
        return {"provider": provider, **clients[provider](messages, system)}

    return complete
