import random
import re
import time

import regex
from pyspark.sql import functions as F

from sparkloom.functions import sentences
from sparkloom.functions.text import PASSAGE_RULES

_RULES = [(re.compile(p), b.replace("$1", r"\1")) for p, b in PASSAGE_RULES]
#: Stretches in which a stop is part of a word: addresses, then numbers and names joined by stops.
_WHOLE = regex.compile(r"""(?i)\b(?:https?://|ftp://|www\.)[^\s<>)"']+|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b""")
_INNER = regex.compile(r"(?<=\d)\.(?=\d)|(?<=[A-Za-z0-9])\.(?=[A-Za-z])|(?<=\.)\.|\.(?=\.)|(?:(?<=[\s(\"']\p{L})|(?<=^\p{L}))\.(?=\s{1,2}\p{Lu})")
_ABBREVIATED = regex.compile(r"([A-Za-z][A-Za-z.]{0,8})\.")
_END = regex.compile(r"""[.!?…]["')\]]*(?=(\s*)(\S?))""")
_CLOSERS = regex.compile(r"""[)\]"'»—–-]+""")


def passage(text):
    for pattern, by in _RULES:
        text = pattern.sub(by, text)
    return text.strip()


def _fixed_stops(text):
    """Places of stops that don't end a sentence."""
    fixed = {m.start() for m in _INNER.finditer(text)}
    for m in _WHOLE.finditer(text):
        fixed.update(range(*m.span()))
    for m in _ABBREVIATED.finditer(text, overlapped=True):
        if m[1].lower() in sentences.ABBREVIATIONS and (m.start() == 0 or not text[m.start() - 1].isascii() or not text[m.start() - 1].isalpha()):
            fixed.add(m.end() - 1)
    return fixed


def _ends(text):
    fixed = _fixed_stops(text)
    for m in _END.finditer(text):
        if m.start() in fixed:
            continue
        gap, ahead = m[1], m[2]
        if not ahead or gap and (text[m.start()] != "." or regex.match(r'[\p{Lu}"«]', ahead)):
            yield m.end()


def brute(text):
    """Sentences of a passage. Pieces under 8 characters join the one before, pieces under 12 the one after."""
    clean = regex.sub(r"([!?])[!?]+", r"\1", regex.sub(r"\.{3,}", "…", passage(text or "")))
    edges = [0, *_ends(clean), len(clean)]
    out: list[str] = []
    ahead = ""
    for piece in (clean[a:b].strip() for a, b in zip(edges[:-1], edges[1:], strict=True)):
        if not piece:
            continue
        piece, ahead = f"{ahead} {piece}".strip(), ""
        if out and (len(piece) < 8 or _CLOSERS.fullmatch(piece)):
            out[-1] += f" {piece}"
        elif len(piece) < 12:
            ahead = piece
        else:
            out.append(piece)
    if ahead:
        out[-1:] = [f"{out[-1]} {ahead}"] if out else [ahead]
    return [s for s in out if len(s) >= 8]


def test_every_document_as_by_a_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", sentences.split_sentences("text").alias("s")).collect()
    assert len(docs) == 1000 and sum(len(r["s"]) for r in docs) > 10_000
    for r in docs:
        assert r["s"] == brute(r["text"]), r["text"][:300]


def test_random_texts_as_by_a_scan(spark):
    draw = random.Random(8)
    bits = ["Dr", "e.g", "U.S", "a", "b", "Word", "word", "é", "Éa", "A", "x1", "3", "14", ".", ".", ".", "!", "?", "...", "\u2026", '"', ")", "]", "'", "\u00bb", "\u2014", " ", " ", " ", "  ", "\u00a0", "https://a.b/c.d?e!", "me@x.org", "www.q.de", "(", "\u00ab", "-", "vs", "long enough words here"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(0, 40))) for _ in range(4000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", sentences.split_sentences("t").alias("s")).collect()
    for r in got:
        assert r["s"] == brute(texts[r["i"]]), repr(texts[r["i"]])


def test_very_long_texts(spark):
    texts = [("No. " * 500_000,), ("A sentence of some length. " * 200_000,), ("." * 1_000_000,), ("x" * 2_000_000,), ("! " * 500_000,)]
    began = time.perf_counter()
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(F.size(sentences.split_sentences("t"))).collect()]
    assert got[:2] == [1, 200_000] and time.perf_counter() - began < 60
