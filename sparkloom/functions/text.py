"""Text expressions: hashes, estimates, markup, passages, term matches and repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import has_passage, has_tandem

# Rewrites of one line of marked-up text, in order.
LINE_RULES = [(r"<[^>]+>", " "), (r"\{[^}]+\}", " "), (r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", r"$1"), (r"^import\s+.+$", " "), (r"\s+", " ")]
# Rewrites of a passage, in order; those with (?m) work line by line.
PASSAGE_RULES = [
    (r"\r\n", "\n"), (r"\|[-\s|:]+\|", " "), (r"\|[^|\n]{1,120}\|", " "), (r"```[\s\S]*?```", " "), (r"`([^`]+)`", r"$1"),
    (r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", r"$1"), (r"\[([^\]]+)\]\[[^\]]*\]", r"$1"),
    (r"<#?[a-zA-Z0-9_-]+>", " "), (r"</?[a-zA-Z][^>]*>", " "), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", r"$1"),
    (r"__([^_]+)__", r"$1"), (r"\*([^*]+)\*", r"$1"), (r"_([^_]+)_", r"$1"), (r"~~([^~]+)~~", r"$1"), (r"(?m)^>\s+", ""),
    (r"(?m)^[-*+]\s+", ""), (r"(?m)^\d+\.\s+", ""), (r"\[\^[^\]]+\]", " "), (r"(?m)^\[[^\]]+\]:\s+\S+.*$", " "),
    (r"\s*---+?\s*", " — "), (r"\n+", " "), (r"\s+", " "),
]


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return trimmed(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def plain_line(line: Column) -> Column:
    return rewritten(line, LINE_RULES)


def clean_passage(text: Column) -> Column:
    return rewritten(text, PASSAGE_RULES)


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n", "\n")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def without_front_matter(text: Column) -> Column:
    end = F.locate("\n---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.substring(text, end + 4, F.length(text))).otherwise(text)


def is_comment_heading(heading: Column) -> Column:
    return F.coalesce(heading.rlike(r"(?i)(^|[^a-z0-9_])comment($|[^a-z0-9_])|^\d+\.\s+\d{4}-\d{2}-\d{2}"), F.lit(False))


def term_matches(term: Column, text: Column) -> Column:
    """Terms of up to four letters as whole words, longer ones anywhere; of those in -ism the stem will do."""
    return _matches(term, F.lower(text))


def _matches(term: Column, low: Column) -> Column:
    # the quotes take everything between them literally, but for a closing quote of the term's own
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    word = F.contains(low, term) & F.rlike(low, F.concat(F.lit("(^|[^a-z0-9_])"), quoted, F.lit("($|[^a-z0-9_])")))
    stem = F.substring(term, F.lit(1), F.length(term) - 3)
    return F.when(F.length(term) <= 4, word).otherwise(F.contains(low, term) | term.endswith("ism") & F.contains(low, stem))


def matching_terms(terms: Column, text: Column) -> Column:
    """How many of the terms a text has; it is lower-cased once, however many there are."""
    counts = F.transform(F.array(F.lower(text)), lambda low: F.size(F.filter(terms, lambda t: _matches(t, low))))
    return F.element_at(counts, 1)


def clean_generated(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), r"^\[\d+\]\s*", "")


def unique_word_share(text: Column) -> Column:
    words = F.split(F.lower(text), r"\s+")
    return F.size(F.array_distinct(words)) / F.size(words)


def repeated_gram(text: Column, n: int = 18, times: int = 3) -> Column:
    """Whether some run of n characters occurs `times` times: a longer run that does contains one of n that does."""
    return _repeated_gram(text, F.lower(text), n, times)


def _repeated_gram(text: Column, low: Column, n: int = 18, times: int = 3) -> Column:
    return (F.length(text) >= n + times - 1) & has_passage(n, times)(low)


def few_words(text: Column) -> Column:
    """Ten words or more, of which less than four in ten are distinct."""
    return _few_words(F.lower(text))


def _few_words(low: Column) -> Column:
    words = F.split(low, r"\s+")
    return (F.size(words) >= 10) & (F.size(F.array_distinct(words)) / F.size(words) < 0.4)


def flaws(text: Column) -> Column:
    """What speaks against a generated text: short, cited (a citation mark first), tandem (a unit of twelve characters or
    more three times in a row), repeated_gram, few_words."""
    t = clean_generated(text)
    flags = {"short": F.length(t) < 8, "cited": trimmed(text).rlike(r"^\[\d+\]"), "tandem": has_tandem(t), "repeated_gram": repeated_gram(t), "few_words": few_words(t)}
    return F.struct(*[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in flags.items()])


def with_flaws(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` with the fields of flaws() in place of a text; what several of them need is made once, in a column of its own."""
    rest, t, low = [c for c in rows.columns if c != text], F.col("__text"), F.col("__low")
    rows = rows.select(*rest, trimmed(F.col(text)).alias("__text"))
    rows = rows.select(*rest, t.rlike(r"^\[\d+\]").alias("__cited"), F.regexp_replace(t, r"^\[\d+\]\s*", "").alias("__text"))
    rows = rows.select(*rest, "__cited", "__text", F.lower(t).alias("__low"))
    flags = {"short": F.length(t) < 8, "cited": F.col("__cited"), "tandem": has_tandem(t), "repeated_gram": _repeated_gram(t, low), "few_words": _few_words(low)}
    return rows.select(*rest, *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in flags.items()])


def malformed(text: Column) -> Column:
    """Text that a generator should not have written: any of its flaws()."""
    found = flaws(text)
    return found["short"] | found["cited"] | found["tandem"] | found["repeated_gram"] | found["few_words"]


def size_bucket(n: Column) -> Column:
    ladder = F.when(n <= 0, "0").when(n == 1, "1")
    for upto, name in ((5, "2-5"), (10, "6-10"), (20, "11-20")):
        ladder = ladder.when(n <= upto, name)
    return ladder.otherwise(">20")
