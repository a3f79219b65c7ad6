"""Sentences of passages by a few linear rewrites, all in the JVM.

Stops that don't end a sentence, and all that stands in addresses, are exchanged for marks; white space behind the stops
that do becomes a cut. Cuts before pieces under 8 characters are taken back, and what is left falls into stretches of 12
characters or more that end at a cut. Every step is one regular expression without nested repetition, so a text of any
length takes time in proportion and no stack.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PASSAGE_RULES, clean_passage

# Abbreviations whose stop never ends a sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st vs eg e.g ie i.e cf approx dept est fig nos vol pp eds gov inc ltd corp univ assn bros"
    " ph.d m.d b.a m.a b.s m.s ll.b ll.d a.m p.m u.s u.k u.n e.u n.b p.s q.e.d viz ibid eqn eqns resp avg".split()
)
#: White space beyond ASCII, which counts as a space here.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Marks: a stop, !, ? and an ellipsis that end nothing, a cut, and a cut taken back. They are no characters of any text;
#: where one stands in a text, it is left out.
MARKS = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4\ufdd5"
STOP, CUT, JOIN = MARKS[0], MARKS[4], MARKS[5]
ENDS = ".!?\u2026"
CLOSERS = """["')\\]]*"""
WHOLE = r"""(?i)\b(?:https?://|ftp://|www\.)[^\s<>)"']+|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"""
INNER = rf"(?<=[0-9])\.(?=[0-9])|(?<=[A-Za-z0-9])\.(?=[A-Za-z])|(?<=[.{STOP}])\.|\.(?=[.{STOP}])|(?:(?<=[\s(\"']\p{{L}})|(?<=\A\p{{L}}))\.(?=\s{{1,2}}\p{{Lu}})"
ABBREVIATED = rf"((?<![A-Za-z])(?i:{'|'.join(a.replace('.', STOP) for a in ABBREVIATIONS)}))\."
_RULES = [(re.compile(p), b.replace("$1", r"\1")) for p, b in PASSAGE_RULES]
#: Characters that a sentence has at least, and that a piece has at least which stands behind a cut.
WHOLE_LENGTH, PIECE_LENGTH = 12, 8


def passage(text: str) -> str:
    for pattern, by in _RULES:
        text = pattern.sub(by, text)
    return text.strip()


def _named(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _sheltered(text: Column) -> Column:
    """Addresses with marks in the place of their stops."""
    parts = F.struct(F.split(text, WHOLE, -1).alias("between"), F.regexp_extract_all(text, F.lit(WHOLE), F.lit(0)).alias("found"))
    joined = lambda p: F.array_join(F.transform(p["between"], lambda b, i: F.concat(b, F.coalesce(F.translate(F.get(p["found"], i), ENDS, MARKS[:4]), F.lit("")))), "")
    return F.when(text.rlike(r"(?i)://|www\.|@"), _named(parts, joined)).otherwise(text)


def _marked(text: Column) -> Column:
    """The passage with all marks set, nothing but marks between its pieces."""
    clean = clean_passage(F.translate(text, SPACES + MARKS, " " * len(SPACES)))
    clean = F.regexp_replace(F.regexp_replace(clean, r"\.{3,}", ENDS[3]), "([!?])[!?]+", "$1")
    work = F.regexp_replace(F.regexp_replace(_named(clean, _sheltered), INNER, STOP), ABBREVIATED, f"$1{STOP}")
    work = F.regexp_replace(work, rf"([!?{ENDS[3]}]{CLOSERS})\s+(?=\S)", f"$1{CUT}")
    work = F.regexp_replace(work, rf"(\.{CLOSERS})\s+(?=[\p{{Lu}}\"\u00ab])", f"$1{CUT}")
    return F.regexp_replace(work, rf"{CUT}(?=(?:[^{CUT}]{{1,{PIECE_LENGTH - 1}}}|[)\]\"'\u00bb\u2014\u2013-]+)(?:{CUT}|\z))", JOIN)


def split_sentences(text: Column | str) -> Column:
    """Sentences of a passage. Pieces under 8 characters join the one before, pieces under 12 the one after.

    A null text has none; what comes out under 8 characters is left out.
    """
    least = WHOLE_LENGTH
    stretch = rf"(?:\A|{CUT})([\s\S]{{{least},}}?(?={CUT}|\z)(?:{CUT}[\s\S]{{1,{least - 1}}}\z)?)"
    cut = lambda work: F.when(F.length(work) < least, F.array(work)).otherwise(F.regexp_extract_all(work, F.lit(stretch), F.lit(1)))
    plain = lambda s: F.translate(s, MARKS, ENDS + "  ")
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(_named(_marked(F.coalesce(column, F.lit(""))), cut), plain), lambda s: F.length(s) >= PIECE_LENGTH)
