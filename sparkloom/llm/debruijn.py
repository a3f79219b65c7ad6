"""Repeated passages by compaction of a de Bruijn graph, without a row for each k-mer of the corpus.

Nodes are the strings of K - 1 consecutive units, edges the K-mers (windows) from their prefix node to their suffix node.
Consecutive edges of a document that share a sample (their smallest unit gram) are one row, an edge run, with its first
and its last node. Equal edges have equal samples, so runs are told apart among those of one sample only, and samples
that occur once leave the graph at once, with all their edges.

1. Runs that occur more than once are edges of the graph. A node is passed through if one run enters it, one run leaves
   it, and each source of the one goes on into the other; else it is a junction: branches, ends of documents and ends of
   what repeats are junctions. Degrees are sums by node.
2. Runs are joined with the nodes that they leave from; in each document, those from one junction to the next are a path.
   As ends of documents are junctions, every source of a path holds the whole of it, and its first run names it.
3. Each source's coordinates fetch its words, whose BLAKE2b digest (128 bits) has to agree: sources of one path with one
   digest are the same passage, and all but those in the smallest document are repeats. Two k-mers with one hash of 64
   bits can so leave a repeat in place, but never remove what doesn't repeat.
4. What is no repeat and has a sample with several kinds of runs is cut into shorter runs, at last into single edges, and
   goes through the same steps again.

A path of any length takes the same number of joins: nothing is doubled or iterated along it. Hot runs and nodes are
summed before they are shuffled, and their joins can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, slices, written
from .repeats import BLOCK, NODE_SPANS, Ranges, Units, checked, first_window, guarded, next_level, sampled_spans, span_rows, window_count

#: Of a slice: its units' bytes in a row, and where each unit and each text's units begin (one more at the end).
Raw = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]
DIGESTS = "path long, doc long, tag long, start long, stop int, digest binary"


def _runs(docs: DataFrame, units: Units, window: int, gram: int, most: int, names_only: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2, most)):
            values, upto = units(batch.column(2))
            doc, lo, n, at, key, ids = sampled_spans(values, upto, window, gram)
            if names_only:
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (key, ids)], names=["key", "id"])
            elif len(lo):
                ranges = Ranges(values)
                yield span_rows(batch, doc, key, ids, lo - upto[doc], n, at, left=ranges(lo, window - 1), right=ranges(lo + n, window - 1))

    return docs.mapInArrow(rows, "key long, id long" if names_only else NODE_SPANS)


def _samples(runs: DataFrame) -> DataFrame:
    """The samples that occur more than once, and whether their runs are of several kinds."""
    kinds = runs.groupBy("key").agg(F.count("*").alias("runs"), (F.min("id") != F.max("id")).alias("several"))
    return written(kinds.where("runs > 1").select("key", "several"))


def _through(edges: DataFrame) -> DataFrame:
    """The nodes with one run in and one out, where every source that comes in goes out.

    The places of sources are compared as the exclusive or of their hashes, which is 0 where both sides are the same.
    """
    place, none = F.xxhash64("doc", "tag", "at"), F.lit(None).cast("long")
    out = edges.select(F.col("left").alias("node"), none.alias("enters"), F.col("id").alias("leaves"), "doc", "tag", first_window().alias("at"))
    into = edges.select(F.col("right").alias("node"), F.col("id").alias("enters"), none.alias("leaves"), "doc", "tag", (first_window() + window_count()).alias("at"))
    degrees = out.unionByName(into).groupBy("node").agg(
        (F.min("enters") == F.max("enters")).alias("one_in"),
        (F.min("leaves") == F.max("leaves")).alias("one_out"),
        (F.count("enters") == F.count("leaves")).alias("as_many"),
        (F.bit_xor(place) == 0).alias("same"),
    )
    return degrees.where("one_in AND one_out AND as_many AND same").select("node")


def _labelled(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Runs with a live sample, with the place of their path's first run (null: occurs once)."""
    live = written(runs.join(guarded(samples), "key"))
    repeated = written(live.groupBy("id").agg(F.count("*").alias("sources")).where("sources > 1").select("id", F.lit(True).alias("repeated")))
    known = written(live.join(guarded(repeated), "id", "left").where("several OR repeated"))
    nodes = written(_through(known.where("repeated")))
    inside = guarded(nodes.select(F.col("node").alias("left"), F.lit(True).alias("inside")))
    order = Window.partitionBy("doc", "tag").orderBy("place")
    edges = known.where("repeated").join(inside, "left", "left").withColumn("start", F.last(F.when(F.col("inside").isNull(), F.col("place")), ignorenulls=True).over(order))
    columns = ["id", "key", "doc", "tag", "place", "several", "start"]
    alone = known.where("repeated IS NULL").withColumn("start", F.lit(None).cast("long"))
    found = written(edges.select(*columns).unionByName(alone.select(*columns)))
    dropped(live, repeated, known, nodes)
    return found


def _digests(docs: DataFrame, asked: DataFrame, raw: Raw, window: int, most: int) -> DataFrame:
    """Of each source of a path, the digest of what is at its coordinates."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2, most)):
            data, begins, upto = raw(batch.column(2))
            asked = batch.column(3)
            flat, counts = asked.flatten(), np.diff(asked.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), counts)
            start, stop, path = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            first = begins[(start >> 24) + upto[doc]]
            last = begins[stop + (window - 1) + upto[doc]]
            view = memoryview(data)
            digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            docs, tags = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
            columns = [pa.array(path, pa.int64()), pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "doc", "tag", "start", "stop", "digest"])

    wanted = docs.join(guarded(asked, "asked"), ["doc", "tag"]).select("doc", "tag", "text", "asked")
    return wanted.mapInArrow(rows, DIGESTS)


def compacted(docs: DataFrame, runs: DataFrame, samples: DataFrame, raw: Raw, window: int, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Sources of paths that an earlier document has (path, doc, tag, start, stop), the runs that are still open, and the
    tables to drop once both have been read."""
    labelled = _labelled(runs, samples)
    dropped(runs, samples)
    first = F.max(F.when(F.col("place") == F.col("start"), F.col("id"))).alias("path")
    paths = labelled.where("start IS NOT NULL").repartition("doc", "tag").groupBy("doc", "tag", "start").agg(F.max(first_window() + window_count()).alias("stop"), first)
    asked = written(paths.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop", "path")).alias("asked")))
    sources = written(_digests(docs, asked, raw, window, most))
    dropped(asked)
    earliest = written(sources.groupBy("path", "digest").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest")).where("earliest < latest").drop("latest"))
    again = written(sources.join(guarded(earliest), ["path", "digest"]).where("doc > earliest").select("path", "doc", "tag", "start", "stop"))
    dropped(sources, earliest)
    still = labelled.where("several").join(guarded(again.select("doc", "tag", "start").distinct()), ["doc", "tag", "start"], "left_anti")
    return again, still, [labelled]


def repeated_passages(docs: DataFrame, units: Units, raw: Raw, window: int, gram: int, most: int = 2 << 20) -> DataFrame:
    """doc, tag, ranges: the units that windows cover which also start in a document with a smaller `doc`, as
    (start, end) in no particular order. docs has doc, tag and text, see repeats.tagged()."""
    checked(window, gram)
    samples = _samples(_runs(docs, units, window, gram, most, names_only=True))
    runs, covered = _runs(docs, units, window, gram, most, names_only=False), []
    for block in (BLOCK, 1, 0):
        again, still, read = compacted(docs, runs, samples, raw, window, most)
        covered.append(again.select("doc", "tag", F.struct(F.shiftright("start", 24).cast("int").alias("start"), (F.col("stop") + (window - 1)).alias("end")).alias("range")))
        if block:
            runs = next_level(docs, still, units, window, block, most, nodes=True)
            samples = _samples(runs)
        dropped(*read)
    return covered[0].unionByName(covered[1]).unionByName(covered[2]).groupBy("doc", "tag").agg(F.collect_list("range").alias("ranges"))
