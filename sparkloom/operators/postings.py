"""An inverted index of query terms over documents, with block maxima, and exact top-k searches that skip blocks.

A term of up to four letters must stand as a word, a longer one may stand anywhere, and one in -ism may lack its ending.
Terms hold letters, digits and hyphens only, so a match lies within a run of such characters and underscores. Runs are
matched once for the whole corpus: pieces of two to four letters are the join's key, and only what shares one is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as texts
from sparkloom.functions.prefix import with_running_total
from sparkloom.sources.scratch import stored

from .terms import INDEX_PENALTY, OVERLAP

RUN = r"[a-z0-9_-]+"
#: Documents of a block, in the order of what they score without any term.
BLOCK = 128
#: Blocks that each query looks at first, to learn what its k-th result must beat.
FIRST = 4
#: Letters of a join's key at most.
PIECE = 4


def _runs(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(RUN), F.lit(0)))


def matched_runs(runs: DataFrame, terms: DataFrame) -> DataFrame:
    """run, term: which of the terms (a column term) each of the runs (a column run) has."""
    t = F.col("term")
    stem = F.when((F.length(t) > PIECE) & t.endswith("ism"), F.expr("substring(term, 1, length(term) - 3)"))
    needles = terms.select("term").distinct().select("term", F.explode(F.array_distinct(F.array_compact(F.array(t, stem)))).alias("needle")).select("term", F.substring("needle", 1, PIECE).alias("piece"))
    sizes = F.sequence(F.lit(2), F.lit(PIECE))
    cut = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("run") - n + 1)), lambda i: F.substring(F.col("run"), i, n))))
    pieces = runs.select("run", F.explode(F.array_distinct(cut)).alias("piece"))
    return pieces.join(needles, "piece").where(texts.term_matches(t, F.col("run"))).select("run", "term").distinct()


class Postings:
    """Postings of `terms` (a column term) over documents (doc, body, base): base is a document's score without terms.

    Null bodies are empty. The blocks, the postings and the documents' bases are tables in the shared folder.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame) -> None:
        rows = docs.select("doc", F.col("base").cast("double").alias("base"), (-F.col("base").cast("double")).alias("down"), F.coalesce("body", F.lit("")).alias("body"))
        found = stored(rows.select("doc", "base", "down", _runs(F.col("body")).alias("runs")))
        placed = with_running_total(found.select("doc", "base", "down", F.lit(1).alias("one")), ["down", "doc"], "one", "place")
        self.docs = stored(placed.select("doc", "base", F.floor(F.col("place") / BLOCK).cast("long").alias("block")))
        pairs = found.select("doc", F.explode("runs").alias("run"))
        known = stored(matched_runs(pairs.select("run").distinct(), terms))
        hits = pairs.join(known, "run").select("doc", "term").distinct()
        self.lists = stored(hits.join(self.docs, "doc").groupBy("term", "block").agg(F.collect_list(F.struct("doc", "base")).alias("docs"), F.max("base").alias("most")))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, block, bound: what no document of a block can exceed for a query (query_id, terms)."""
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
        met = asked.join(self.lists.select("term", "block", "most"), "term")
        return met.groupBy("query_id", "block").agg((F.count("*") * OVERLAP + F.max("most")).alias("bound"))

    def _scored(self, queries: DataFrame, blocks: DataFrame) -> DataFrame:
        """query_id, doc, score of the documents with a term in the given blocks (query_id, block)."""
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
        lists = asked.join(self.lists, "term").join(blocks.select("query_id", "block"), ["query_id", "block"], "left_semi")
        hits = lists.select("query_id", F.explode("docs").alias("d")).groupBy("query_id", F.col("d.doc").alias("doc"))
        return hits.agg((F.count("*") * OVERLAP + F.max("d.base")).alias("score"))

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc, score, rank: the k best documents of each query, ties to the smaller doc; exact.

        Each query scores its most promising blocks first; further blocks are opened only where their bound reaches the
        k-th score so far. Documents without any of a query's terms can only be among the k best by their base alone.
        """
        bounds = stored(self.bounds(queries))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = bounds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
        plain = self.docs.orderBy(F.desc("base"), "doc").limit(k).select("doc", F.col("base").alias("score"))  # k rows
        start = stored(self._scored(queries, first))
        floor = start.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").alias("floor"))
        rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
        self.opened = stored(rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("query_id", "block"))
        found = start.unionByName(self._scored(queries, self.opened))
        listed = plain.agg(F.collect_list(F.struct("doc", "score")).alias("plain")).withColumn("__one", F.lit(1))  # one row of k
        others = queries.select("query_id", F.lit(1).alias("__one")).join(F.broadcast(listed), "__one").select("query_id", F.inline("plain"))
        missed = others.join(found.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
        return found.unionByName(missed).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def base_score(score: Column, is_index: Column) -> Column:
    """What a document scores without any term: its own score, less a penalty for an index page."""
    return score - F.when(is_index, INDEX_PENALTY).otherwise(0)
