"""Query terms: stop words, glossary aliases, typing errors, expansions and the boosts that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text

# Words that carry no meaning in a query.
STOP_WORDS = "what whats that this with from about your have does the and for are how not any can may via per".split()
# The site's vocabulary and what a term is expanded to for retrieval.
EXPANSIONS = {
    "catamorphism": "catamorphism fold F-algebra initial algebra μF",
    "anamorphism": "anamorphism unfold coalgebra νF",
    "hylomorphism": "hylomorphism catamorphism anamorphism fold unfold",
    "coalgebra": "coalgebra anamorphism unfold νF",
    "bisimulation": "bisimulation final coalgebra νF observational equivalence",
    "endofunctor": "endofunctor F-algebra F-coalgebra functor",
    "essayism": "essayism dialectic dialogue method",
    "semiosis": "semiosis sign process Peirce",
    "concrescence": "concrescence Whitehead prehension process",
    "operad": "operad operations composition",
    "prehension": "prehension Whitehead concrescence",
    "topos": "topos local truth sheaf",
    "sheaf": "sheaf topos local sections gluing",
    "logicism": "logicism Frege analytic membership",
    "physicalism": "physicalism quotient matter",
    "idealism": "idealism quotient mind",
}
INITIAL, FINAL = "initial algebra catamorphism fold F-algebra μF", "final coalgebra anamorphism unfold νF"
# Endings that are cut off to get a term's stem.
SUFFIXES = "morphism algebra omorphism ification escence ulation unction osis ism ogy ion".split()
WORD, LONG_WORD = r"(?<![a-z0-9_])([a-z]{3,})(?![a-z0-9_])", r"(?<![a-z0-9_])([a-z][a-z0-9-]{3,})(?<=[a-z0-9])(?![a-z0-9_])"
BOOST, OVERLAP, INDEX_PENALTY, EDITS = 0.2, 10, 8, 2
#: Letters of a word that the keys of its neighbourhood are made of; more than EDITS.
REACH = 8


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXPANSIONS.items()), "term string, expansion string")


def low(query: Column) -> Column:
    return F.regexp_replace(F.lower(query), "'", "")


def no_stops(words: Column) -> Column:
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def literal_terms(query: Column) -> Column:
    """Distinct words of four letters and more, in order, without stop words."""
    return no_stops(F.regexp_extract_all(low(query), F.lit(LONG_WORD), F.lit(1)))


def short_aliases(terms: DataFrame) -> DataFrame:
    """alias, term: beginnings and stems that exactly one term of the glossary (a column term) claims."""
    t = F.col("term")
    starts = lambda s: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length(s))), lambda n: F.substring(s, F.lit(1), n))
    stems = [F.when(t.endswith(s) & (F.length(t) - len(s) >= 3), starts(F.substring(t, F.lit(1), F.length(t) - len(s)))) for s in SUFFIXES]
    claimed = F.array_distinct(F.flatten(F.array_compact(F.array(*stems, F.array(F.substring(t, 1, 3), F.substring(t, 1, 4))))))
    claims = terms.select(F.lower("term").alias("term")).distinct().select(F.explode(claimed).alias("alias"), "term")
    good = (F.length("alias") >= 3) & (F.length("alias") < F.length("term")) & ~F.col("alias").isin(STOP_WORDS) & F.col("alias").rlike("^[a-z][a-z0-9-]*$")
    return claims.where(good).groupBy("alias").agg(F.count_distinct("term").alias("n"), F.min("term").alias("term")).where("n = 1").select("alias", "term")


def _shortened(word: Column) -> Column:
    """All that a word becomes by losing one letter."""
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def remainders(word: Column, edits: int = EDITS, reach: int = REACH) -> Column:
    """What the first `reach` letters of a word become by losing up to `edits` of them.

    Two words within so many edits share one: in their best alignment each edit takes at most one letter of either side,
    and a letter whose partner lies beyond the reach is paid for by a letter that came in before it.
    """
    forms = F.array(F.substring(word, 1, reach))
    every = forms
    for _ in range(edits):
        forms = F.array_distinct(F.flatten(F.transform(forms, _shortened)))
        every = F.concat(every, forms)
    return F.array_distinct(every)


def fuzzy_candidates(words: DataFrame, terms: DataFrame, edits: int = EDITS) -> DataFrame:
    """word, term: pairs that share a remainder and whose lengths differ by `edits` at most."""
    keyed = lambda df, c: df.select(c).distinct().select(c, F.explode(remainders(F.col(c), edits)).alias("rest"))
    near = F.abs(F.length("word") - F.length("term")) <= edits
    return keyed(words, "word").join(keyed(terms, "term"), "rest").where(near).select("word", "term").distinct()


def fuzzy_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, term: words (a column word) within two edits of a glossary term; only pairs that share a remainder are compared."""
    pairs = fuzzy_candidates(words.where(~F.col("word").isin(STOP_WORDS)), terms)
    return pairs.where(F.levenshtein("word", "term", EDITS).between(0, EDITS))


def resolve_tokens(tokens: DataFrame, terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """token, term: what a token (a column token) stands for: its alias, itself, or the one longer term that it begins."""
    t = tokens.select("token").distinct().where((F.length("token") >= 3) & ~F.col("token").isin(STOP_WORDS))
    by_alias = t.join(aliases.select(F.col("alias").alias("token"), "term"), "token")
    rest = t.join(by_alias.select("token"), "token", "left_anti")
    exact = rest.join(terms.select(F.col("term").alias("token"), "term"), "token")
    rest = rest.join(exact.select("token"), "token", "left_anti")
    starts = terms.select("term", F.explode(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("term") - 1))).alias("n")).where("n < length(term)").select(F.expr("substring(term, 1, n)").alias("token"), "term")
    one = starts.groupBy("token").agg(F.count_distinct("term").alias("n"), F.min("term").alias("term")).where("n = 1").select("token", "term")
    return by_alias.unionByName(exact).unionByName(rest.join(one, "token"))


def query_terms(queries: DataFrame, terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id and terms: literal words, then resolved tokens, then what the words were meant to be; each once."""
    q = low(F.col("query"))
    base = queries.select("query_id", literal_terms(F.col("query")).alias("literal"), F.regexp_extract_all(q, F.lit(WORD), F.lit(1)).alias("tokens"))
    tokens = base.select("query_id", F.posexplode("tokens").alias("pos", "token"))
    resolved = tokens.join(resolve_tokens(tokens, terms, aliases), "token").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "term"))).alias("r"))
    words = base.select("query_id", F.posexplode("literal").alias("pos", "word"))
    fuzzy = words.join(fuzzy_terms(words, terms), "word").groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("f"))
    all_ = base.join(resolved, "query_id", "left").join(fuzzy, "query_id", "left")
    none = F.array().cast("array<string>")
    r = F.coalesce(F.flatten(F.transform("r", lambda x: F.array(x["token"], x["term"]))), none)
    f = F.coalesce(F.transform("f", lambda x: x["term"]), none)
    return all_.select("query_id", F.array_distinct(F.concat("literal", r, f)).alias("terms"), F.array_distinct(f).alias("fuzzy"))


def expand_queries(queries: DataFrame, terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id and expanded: the query with the expansions of the glossary terms that it means."""
    found = queries.join(query_terms(queries, terms, aliases), "query_id")
    wanted = found.select("query_id", F.posexplode(F.array_distinct(F.concat("fuzzy", "terms"))).alias("pos", "term"))
    parts = wanted.join(terms, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "expansion"))).alias("parts"))
    out = found.join(parts, "query_id", "left")
    q, whole = low(F.col("query")), text.trimmed(F.col("query"))
    fixed = lambda p, s: F.when(q.rlike(p), F.array(F.lit(s))).otherwise(F.array().cast("array<string>"))
    expansions = F.coalesce(F.transform("parts", lambda x: x["expansion"]), F.array().cast("array<string>"))
    edge = r"(^|[^a-z0-9_])({})($|[^a-z0-9_])"
    every = F.concat(F.array(whole), expansions, fixed(edge.format("muf|μf|initial algebra"), INITIAL), fixed(edge.format("nuf|νf|final coalgebra"), FINAL))
    return out.select("query_id", F.array_join(F.array_distinct(every), " ").alias("expanded"))


def haystack(heading: Column, body: Column) -> Column:
    return F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), body)


def overlap_boost(terms: Column, body: Column, heading: Column | None = None) -> Column:
    """A fixed boost for each term that a chunk's heading or text has."""
    return text.matching_terms(terms, body if heading is None else haystack(heading, body)) * F.lit(BOOST)


def relevance(terms: Column, body: Column, score: Column, is_index: Column, heading: Column | None = None) -> Column:
    return text.matching_terms(terms, body if heading is None else haystack(heading, body)) * OVERLAP + score - F.when(is_index, INDEX_PENALTY).otherwise(0)
