"""Answers from retrieved chunks: sentences picked from them, or a generator's text if it passes the checks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.sentences import passage, split_sentences

from .terms import INDEX_PENALTY, OVERLAP

# What is said where nothing was found.
EMPTY = "I could not find relevant passages in the essay corpus to answer that question."
NOTHING = "No relevant passages matched your question in the indexed essay corpus."
CANDIDATES = "ANN bi-encoder candidates (stage 1 \u2014 nearest neighbors from similarity search; not used as the final extractive answer):"
INSTRUCTION = "You are a helpful assistant. Using only the context below, write a clear 2-4 sentence answer to the question. Use plain English. Do not copy section headings alone."
WINDOW, PAD, EXCERPT = 420, 100, 280


def hits_term(term: str, text: str) -> bool:
    low = text.lower()
    if len(term) <= 4:
        return re.search(rf"(?<![a-z0-9_]){re.escape(term)}(?![a-z0-9_])", low) is not None
    return term in low or term.endswith("ism") and term[:-3] in low


def window_around(text: str, terms: list[str], most: int = WINDOW) -> str | None:
    """About `most` characters around the earliest term, cut at spaces; None without a term or much text."""
    clean = passage(text)
    places = []
    for t in terms:
        m = re.search(rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])" if len(t) <= 4 else re.escape(t), clean.lower())
        if m:
            places.append((m.start(), m.end() - m.start()))
    if len(clean) <= 20 or not places:
        return None
    at, size = min(places, key=lambda p: p[0])
    begin = max(0, at - PAD)
    end = min(len(clean), at + size + most - (at - begin))
    if begin:
        space = clean.rfind(" ", 0, begin + 21)
        begin = space + 1 if space > begin else begin
    if end < len(clean):
        space = clean.find(" ", max(begin, end - 20))
        end = space if space > 0 else end
    cut = clean[begin:end].strip()
    return cut if len(cut) > 20 else clean[:most]


def extract(terms: list[str], ranked: list[tuple[str, str, list[str]]]) -> str:
    """Two or three sentences from chunks (heading, text, sentences) in order of relevance."""
    out: list[str] = []
    for heading, text, found in ranked:
        if terms and not any(hits_term(t, f"{heading or ''} {text}") for t in terms):
            continue
        if terms:
            found = [s for s in found if any(hits_term(t, s) for t in terms)] or [w for w in [window_around(text, terms)] if w]
        for s in found[:2]:
            if s not in out and len(out) < 3:
                out.append(s)
        if len(out) >= 2:
            break
    return "\n\n".join(out) or EMPTY


@F.pandas_udf(T.StringType())
def extractive_answers(terms: pd.Series, chunks: pd.Series) -> pd.Series:
    return pd.Series([extract(list(t), [(c["heading"], c["text"], list(c["sentences"])) for c in cs]) for t, cs in zip(terms, chunks, strict=True)])


def extractive(rows: DataFrame) -> DataFrame:
    """query_id and answer from rows (query_id, terms, rank, heading, text, is_index) of a bounded top k a query.

    Index pages count only where a query has nothing else.
    """
    chunk = F.struct("rank", "heading", "text", "is_index", split_sentences("text").alias("sentences"))
    kept = rows.groupBy("query_id").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_list(chunk)).alias("c"))
    proper = F.filter("c", lambda x: ~x["is_index"])
    return kept.select("query_id", extractive_answers("terms", F.when(F.size(proper) > 0, proper).otherwise(F.col("c"))).alias("answer"))


def sentences_of(texts: list[str]) -> list[list[str]]:
    """Sentences of one request's few texts."""
    from pyspark.sql import SparkSession

    rows = SparkSession.active().createDataFrame(list(enumerate(texts)), "i int, text string").select("i", split_sentences("text").alias("s")).collect()
    return [list(r["s"]) for r in sorted(rows)]


def mentions(terms: list[str], answer: str) -> bool:
    return any(hits_term(t, answer) for t in terms) if terms else len(answer) >= 40


def acceptable(terms: list[str], answer: str) -> bool:
    text = answer.strip()
    echo = re.fullmatch(r"The [^.]{5,90}\.", text) is not None and not mentions(terms, text)
    return len(text) >= 40 and not echo and not re.match(r"F\s+[-/:]", text) and mentions(terms, text)


def malformed(text: str) -> bool:
    """Text that a generator should not have written; see functions.text.malformed for the rules as a Column."""
    t = clean_generated(text)
    if len(t) < 8 or re.match(r"\[\d+\]", text.strip()) or re.search(r"([\s\S]{12,}?)\1{2,}", t):
        return True
    low = t.lower()
    grams = Counter(low[i : i + 18] for i in range(len(low) - 17))
    words = t.lower().split()
    return max(grams.values(), default=0) >= 3 or len(words) >= 10 and len(set(words)) / len(words) < 0.4


def clean_generated(text: str) -> str:
    return re.sub(r"^\[\d+\]\s*", "", text.strip())


def relevance(terms: list[str], chunk: dict) -> float:
    overlap = sum(hits_term(t, f"{chunk.get('heading') or ''} {chunk['text']}") for t in terms)
    return overlap * OVERLAP + chunk.get("score", 0.0) - (INDEX_PENALTY if chunk.get("is_index") else 0)


def rag_prompt(question: str, terms: list[str], chunks: list[dict], most: int = 1800) -> str:
    """The prompt of a question: the three chunks that are most relevant to its terms, each under its heading."""
    ranked = sorted(chunks, key=lambda c: -relevance(terms, c))[:3]
    passages = [f"{c['heading']}: {passage(c['text'])}" if c.get("heading") else passage(c["text"]) for c in ranked]
    context = "\n\n".join(passages)
    if len(context) > most:
        context = re.sub(r"\s+\S*$", "", context[:most]) + "\u2026"
    return f"{INSTRUCTION}\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"


def candidates_section(candidates: list[dict]) -> str:
    """The nearest chunks, numbered, with their scores and beginnings; nothing where there are none."""
    lines = []
    for i, c in enumerate(candidates, 1):
        slug, body = c.get("essay_slug") or "", passage(c["text"])
        title = f"{slug} \u2014 {c['heading']}" if c.get("heading") else slug or c.get("essay_path") or "(unknown)"
        lines.append(f"{i}. {title} (ANN score {c['score']:.3f})\n   {body[:EXCERPT]}{chr(0x2026) if len(body) > EXCERPT else ''}")
    return "\n".join(["", "", CANDIDATES, "", *lines]) if lines else ""


def citations_only(n: int) -> str:
    return f"Found {n} relevant passage{'' if n == 1 else 's'} (synthesis unavailable \u2014 see citations below)." if n else NOTHING


def assembled(text: str, candidates: list[dict]) -> str:
    """An answer, with the candidates after it if it says nothing."""
    return text + candidates_section(candidates) if text in (NOTHING, EMPTY) or not text.strip() else text


def answer(question: str, terms: list[str], chunks: list[dict], candidates: list[dict] = (), synthesize: bool = True, generate: Callable[[str], str] | None = None, confident: bool = True) -> dict:
    """One question's answer and how it came about: citations only, empty, extractive, generated or fallback.

    chunks and candidates: results of a retrieval, best first (heading, text, score, essay_slug, essay_path, is_index).
    A generated text stands if it is neither malformed nor beside the question.
    """
    said = lambda text, mode, fallback=False: {"answer": assembled(text, list(candidates)), "mode": mode, "fallback": fallback}
    if not synthesize:
        return said(citations_only(len(chunks)), "citations")
    if not chunks:
        return said(NOTHING, "empty")
    ranked = sorted(chunks, key=lambda c: -relevance(terms, c))
    proper = [c for c in ranked if not c.get("is_index")] or ranked
    extracted = extract(terms, [(c.get("heading"), c["text"], split) for c, split in zip(proper, sentences_of([c["text"] for c in proper]), strict=True)])
    if generate is None or not confident:
        return said(extracted, "extractive")
    try:
        raw = generate(rag_prompt(question, terms, chunks))
        text = clean_generated(raw)
        if not malformed(raw) and acceptable(terms, text):
            return {"answer": text, "mode": "generative", "fallback": False}
    except Exception:  # noqa: BLE001  a generator that fails is a reason to fall back, whatever its error
        pass
    return said(extracted, "extractive", True)
