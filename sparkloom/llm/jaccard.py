"""Exact Jaccard join of n-gram sets by vertical partitioning.

All n-grams are ordered by their hash, and this order is cut into fragments, the same for all sets of about a size. Sets
that are similar enough differ in fewer n-grams than they have fragments, so they agree on a whole fragment: equal
fragments make the buckets of candidates. A pair's overlap is counted in each of a fixed number of fragments separately,
and the partial overlaps are summed per pair.

No bucket is expanded into its pairs. One member, the pivot, is compared with all others; two members whose differences
from the pivot don't meet are decided by the sizes of these differences alone, and then both link to the pivot if they
link at all. Members with differences in common meet again in buckets of one such gram, of which each member enters only
the rarest that it can't do without.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, guarded, mix64, packed_row, slices, string_buffers, word_bounds, word_hashes, written
from .components import connected_components

#: Bits of an n-gram's hash; a slice's text number goes above them while it is sorted.
HASH_BITS = 52
#: Fragments in which overlaps are counted.
PARTIAL = 8
#: Smaller sets take further levels until they have fragments to spare. Of larger ones few need that; those are looked
#: for one by one, see _lacking().
SMALL = 160
#: One fragment in so many is looked at first.
SAMPLE = 16
#: Set digests that a task keeps so as not to send the fragments of copies again.
SEEN = 250_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a slice (ASCII letters lower-cased), and where each text's begin.

    A text of fewer than n words has one gram, the whole of it; one without words has none.
    """
    data, offs = string_buffers(column)
    starts, ends, upto = word_bounds(data, offs)
    words = word_hashes(LOWER[data], starts, ends)
    counts = np.diff(upto)
    n_docs = len(counts)
    doc = np.repeat(np.arange(n_docs), counts)
    sums = np.zeros(len(words), np.uint64)
    valid = np.ones(len(words), bool)
    for i in range(n):
        factor = mix64(np.array([i + 11], np.uint64))[0] | np.uint64(1)
        sums[: len(words) - i] += words[i:] * factor
    for i in range(1, n):
        at = upto[1:] - i
        valid[at[at >= upto[:-1]]] = False
    grams, owner = mix64(sums[valid]) >> np.uint64(64 - HASH_BITS), doc[valid]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = []
        for d in short:
            total = np.array([counts[d]], np.uint64)
            for i in range(counts[d]):
                total = mix64(total + words[upto[d] + i : upto[d] + i + 1] * np.uint64(2 * i + 3))
            extra.append(total[0] >> np.uint64(64 - HASH_BITS))
        grams, owner = np.append(grams, np.array(extra, np.uint64)), np.append(owner, short)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | grams)
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    owner = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
    return keys & np.uint64((1 << HASH_BITS) - 1), np.searchsorted(owner, np.arange(n_docs + 1))


def small_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    most = 1 << (64 - HASH_BITS)
    for batch in (x for b in batches for x in slices(b, column, 2 << 20)):
        for begin in range(0, batch.num_rows, most):
            yield batch.slice(begin, most)


def digests(grams: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; 0 for an empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(grams), dtype=np.uint64)])
    n = np.diff(upto)
    out = mix64(sums[upto[1:]] - sums[upto[:-1]] + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    out[n == 0] = 0
    return out.view(np.int64)


def ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of two whole numbers, as it is written: 0.85 is 17/20, not the binary number next to it."""
    if not 0 < threshold <= 1:
        raise ValueError(f"a similarity threshold is above 0 and at most 1, not {threshold}")
    exact = Fraction(str(threshold)).limit_denominator(10_000)
    return exact.numerator, exact.denominator


def level_of(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """log2 of the number of fragments for sets of size n: at least 1.25 * (1 - t) / t * n, with t = num / den."""
    least = np.maximum(1, -(-5 * (den - num) * n // (4 * num)))
    return np.ceil(np.log2(least)).astype(np.int64)


def fragment_keys(grams: np.ndarray, upto: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set number, key, level and spare of each non-empty fragment, on every level that a set may share with a similar one.

    With t the threshold, sets of sizes a <= b that are similar differ in at most d = a * (1 - t) / t grams, and b <= a / t.
    Both take the level of a. Of a's non-empty fragments at most d differ, so one is left where there are more than d.
    A small set goes up from level to level until even a partner's fragments must exceed that, so that the level on which
    the smaller has enough of them is among those of both. A set that has `spare` fragments more than needed for one
    common one can leave out its `spare` most frequent ones: similar sets still meet in the rarest common fragment.
    All bounds are reckoned in whole numbers: in binary fractions they miss sets that just reach them.
    """
    sizes = np.diff(upto).astype(np.int64)
    num, den = ratio(threshold)
    differ = sizes * (den - num) // num
    high, low = level_of(sizes, num, den), level_of(sizes * num // den, num, den)
    needs = differ >= 1  # smaller sets are similar to equal ones only
    enough = sizes * (den - num) * (den + num)  # of a partner's fragments: more than num * den times theirs
    more = needs & (sizes < SMALL)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for level in range(int(low[needs].min()) if needs.any() else 1, HASH_BITS + 1):
        on = needs & (level >= low) & ((level <= high) | more)
        if not on.any():
            if level > int(high.max()) and not more.any():
                break
            continue
        who, keys, held = keys_on(level, on, grams, upto)
        spare = np.maximum(held - differ - 1, 0)
        for o, v in zip(out, (who, keys, np.full(len(who), level), spare[who]), strict=True):
            o.append(v)
        more &= ~(on & (held * num * den > enough) & (level >= high))
    return tuple(np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out)


def keys_on(level: int, on: np.ndarray, grams: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set number and key of each non-empty fragment on a level, for the sets that are `on`, and how many each set has."""
    owner = np.repeat(np.arange(len(on)), np.diff(upto))
    some = np.flatnonzero(on[owner])
    frag, who = grams[some] >> np.uint64(HASH_BITS - level), owner[some]
    new = np.ones(len(some), bool)
    new[1:] = (who[1:] != who[:-1]) | (frag[1:] != frag[:-1])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(mix64(grams[some]), first) if len(first) else np.zeros(0, np.uint64)
    who = who[first]
    keys = mix64(sums + frag[first] * np.uint64(0x94D049BB133111EB) + np.uint64(level + 1))
    return who, keys.view(np.int64), np.bincount(who, minlength=len(on))


def lacking_levels(grams: np.ndarray, upto: np.ndarray, threshold: float) -> np.ndarray:
    """Of each set that is not small: 0, or where it has too few fragments on its own level the first with enough."""
    sizes = np.diff(upto).astype(np.int64)
    num, den = ratio(threshold)
    differ, high = sizes * (den - num) // num, level_of(sizes, num, den)
    out = np.zeros(len(sizes), np.int64)
    wait = (sizes >= SMALL) & (differ >= 1)
    for level in range(int(high[wait].min()) if wait.any() else HASH_BITS + 1, HASH_BITS + 1):
        on = wait & (level >= high)
        if on.any():
            held = keys_on(level, on, grams, upto)[2]
            good = on & (held > differ)
            out[good & (level > high)] = level
            wait &= ~good
        if not wait.any():
            break
    return out


class Fresh:
    """Picks the sets of a slice that a task hasn't met yet, as far as it keeps track."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, k: np.ndarray) -> np.ndarray:
        order = np.argsort(k, kind="stable")
        first = order[np.append(True, k[order][1:] != k[order][:-1])] if len(k) else order
        fresh = np.sort(np.array([i for i in first.tolist() if int(k[i]) not in self.seen], np.int64))
        if len(self.seen) > SEEN:
            self.seen.clear()
        self.seen.update(k[fresh].tolist())
        return fresh


def fresh_keys(fresh: np.ndarray, grams: np.ndarray, upto: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    sizes = np.diff(upto)
    keep = np.zeros(len(sizes), bool)
    keep[fresh] = True
    return fragment_keys(grams[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[fresh])]), threshold)


def _sets(docs: DataFrame, key: str, text: str, n: int, threshold: float) -> DataFrame:
    """doc_id, text_hash, n, k (the set's digest), a sample of the set's fragments by their hash, and lacking_levels()."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = Fresh()
        for batch in small_slices(batches, 2):
            grams, upto = gram_sets(batch.column(2), n)
            k = digests(grams, upto)
            fresh = unseen(k)
            who, keys, _, _ = fresh_keys(fresh, grams, upto, threshold)
            some = np.flatnonzero(keys % SAMPLE == 0)
            some = some[np.argsort(who[some], kind="stable")]
            offs = np.searchsorted(fresh[who[some]], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(upto).astype(np.int64)), pa.array(k), pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[some])), pa.array(lacking_levels(grams, upto, threshold))], names=["doc_id", "text_hash", "n", "k", "sample", "lack"])

    return rows.mapInArrow(sized, "doc_id long, text_hash long, n long, k long, sample array<bigint>, lack long")


def _fragments(docs: DataFrame, text: str, n: int, threshold: float) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = Fresh()
        for batch in small_slices(batches, 0):
            grams, upto = gram_sets(batch.column(0), n)
            k = digests(grams, upto)
            fresh = unseen(k)
            who, keys, level, spare = fresh_keys(fresh, grams, upto, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(k[fresh][who]), pa.array(level.astype(np.int32)), pa.array(spare.astype(np.int32))], names=["key", "k", "level", "spare"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(keyed, "key long, k long, level int, spare int")


def _lacking(docs: DataFrame, sets: DataFrame, text: str, n: int) -> DataFrame | None:
    """key, k of the fragments that sets with too few of them on their own level share with any set on a higher one.

    Such sets are rare accidents of the hash among the larger ones; None where there are none.
    """
    short = written(sets.where("lack > 0").select("k", "lack", "text_hash").dropDuplicates(["k"]))
    levels = sorted(r["lack"] for r in short.select("lack").distinct().collect())  # at most one for each bit of a hash
    if not levels:
        return None

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 0):
            grams, upto = gram_sets(batch.column(0), n)
            k = digests(grams, upto)
            for level in levels:
                who, keys, _ = keys_on(level, k != 0, grams, upto)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(k[who]), pa.array(np.full(len(who), level))], names=["key", "k", "lack"])

    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = texts.join(guarded(short), F.xxhash64("text") == F.col("text_hash"), "left_semi").mapInArrow(keyed, "key long, k long, lack long")
    own = written(own.join(guarded(short.select("k", "lack")), ["k", "lack"]).select("key").distinct())
    return texts.mapInArrow(keyed, "key long, k long, lack long").join(guarded(own), "key", "left_semi").select("key", "k").distinct()


def _pieces(docs: DataFrame, wanted: DataFrame, text: str, n: int) -> DataFrame:
    """k, n, fragment and its grams, for the sets of the texts in `wanted` (text_hash)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = Fresh()
        for batch in small_slices(batches, 0):
            grams, upto = gram_sets(batch.column(0), n)
            k = digests(grams, upto)
            first = unseen(k).tolist()
            names, sizes, places, begins, ends = [], [], [], [], []
            for i in first:
                inner = np.searchsorted(grams[upto[i] : upto[i + 1]], np.arange(PARTIAL + 1, dtype=np.uint64) * np.uint64((1 << HASH_BITS) // PARTIAL)) + upto[i]
                inner[-1] = upto[i + 1]
                names += [k[i]] * PARTIAL
                sizes += [upto[i + 1] - upto[i]] * PARTIAL
                places += range(PARTIAL)
                begins += inner[:-1].tolist()
                ends += inner[1:].tolist()
            lists = [grams[a:b].view(np.int64) for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(places, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["k", "n", "fragment", "grams"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(guarded(wanted), F.xxhash64("text") == F.col("text_hash"), "left_semi")
    return rows.mapInArrow(cut, "k long, n long, fragment int, grams array<bigint>").groupBy("k", "n", "fragment").agg(F.first("grams").alias("grams"))


def _side(pieces: DataFrame, name: str) -> DataFrame:
    return pieces.select(F.col("k").alias(name), F.col("n").alias(f"n_{name}"), "fragment", F.col("grams").alias(f"g_{name}"))


def _by_fragment(pairs: DataFrame, pieces: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each pair of sets and fragment, with the grams of both there and the sizes of the sets."""
    each = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(PARTIAL - 1))))
    return each.join(_side(pieces, a), [a, "fragment"]).join(_side(pieces, b), [b, "fragment"])


def _similar(pairs: DataFrame, pieces: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: partial overlaps by fragment, summed per pair."""
    num, den = ratio(threshold)
    sizes = pieces.where("fragment = 0").select("k", "n")
    fit = pairs.join(sizes.select(F.col("k").alias("a"), F.col("n").alias("m_a")), "a").join(sizes.select(F.col("k").alias("b"), F.col("n").alias("m_b")), "b")
    fit = fit.where(F.least("m_a", "m_b") * den >= F.greatest("m_a", "m_b") * num).select("a", "b")
    partial = _by_fragment(fit, pieces, "a", "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("shared"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return total.where(F.col("shared") * den >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * num).select("a", "b")


def _mixed(rows: DataFrame, *bucket: str) -> DataFrame:
    """The buckets with rows of several components, and how many rows they have."""
    return rows.groupBy(*bucket).agg(F.min("component").alias("low"), F.max("component").alias("top"), F.count("*").alias("members")).where("low < top").drop("low", "top")


def _with_pivots(rows: DataFrame) -> DataFrame:
    """From key, k, component: p, pc, k, component for each member k of a bucket of several components, p its pivot.

    The pivot is that with the most companions in all its buckets, most likely what the others are copies of.
    """
    live = written(rows.join(_mixed(rows, "key"), "key"))
    weight = live.groupBy("k").agg(F.sum("members").alias("weight"))
    pivots = live.join(weight, "k").groupBy("key").agg(F.max(F.struct("weight", "k", "component")).alias("pivot")).select("key", F.col("pivot.k").alias("p"), F.col("pivot.component").alias("pc"))
    return live.join(pivots, "key").where("k <> p").select("p", "pc", "k", "component").distinct()


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of a pivot with its bucket's members of other components."""
    return _with_pivots(rows).where("component <> pc").select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("k"))
    return rows.join(guarded(labels.withColumnRenamed("node", "k")), "k", "left").withColumn("component", F.coalesce("component", "k"))


def _differing(family: DataFrame, pieces: DataFrame, threshold: float) -> DataFrame:
    """From p, k, component: what of k's difference from its pivot p another component's member has as well.

    p, k, component, cost, budget and grams, rarest first. A member that lacks r grams of p's and has a others costs
    r + t * a; the budget is (1 - t) * |p| (all times the threshold's denominator). Two members i and j with s
    differences in common are similar just if cost(i) + cost(j) - (1 + t) * s is within the budget, the pivot itself
    being a member of cost 0.
    """
    num, den = ratio(threshold)
    apart = F.concat(F.array_except("g_p", "g_k"), F.array_except("g_k", "g_p"))
    parts = written(_by_fragment(family, pieces, "p", "k").select("p", "k", "component", "n_p", "n_k", apart.alias("apart")))
    removed, added = (F.expr(f"(differ + n_{x} - n_{y}) div 2") for x, y in ("pk", "kp"))
    costs = parts.groupBy("p", "k", "component", "n_p", "n_k").agg(F.sum(F.size("apart")).alias("differ"))
    costs = costs.select("p", "k", "component", (removed * den + added * num).alias("cost"), (F.col("n_p") * (den - num)).alias("budget"))
    rows = parts.select("p", "k", "component", F.explode("apart").alias("gram"))
    often = _mixed(rows, "p", "gram")
    order = F.array_sort(F.collect_list(F.struct("members", "gram")))
    lists = rows.join(often, ["p", "gram"]).groupBy("p", "k").agg(order.getField("gram").alias("grams"))
    return costs.join(lists, ["p", "k"], "left").withColumn("grams", F.coalesce("grams", F.array().cast("array<bigint>")))


def _emitted(members: DataFrame, threshold: float) -> DataFrame:
    """p, gram, k, component, cost, budget, far, place, rest: the grams by which a member can be found.

    Of two members that don't both link to the pivot, the far one (that costs more) is beyond the budget, and the other
    one is near. What a role must have in common with any partner is known from its own cost, so that it can do without
    as many grams less one, the most frequent ones.
    """
    num, den = ratio(threshold)
    held = F.size("grams")
    least_far = F.greatest(F.lit(1), F.expr(f"(cost - budget + {den - 1}) div {den}"))
    least_near = F.greatest(F.lit(1), F.expr(f"(cost + greatest(cost, budget + 1) - budget + {den + num - 1}) div {den + num}"))
    roles = members.withColumn("far", F.explode(F.array(F.lit(True), F.lit(False)))).where("NOT far OR cost > budget")
    roles = roles.withColumn("held", held).withColumn("take", F.col("held") - F.when(F.col("far"), least_far).otherwise(least_near) + 1).where("take > 0")
    rows = roles.select("p", "k", "component", "cost", "budget", "far", "held", F.posexplode(F.slice("grams", F.lit(1), F.col("take").cast("int"))).alias("place", "gram"))
    return rows.withColumn("rest", F.col("held") - F.col("place")).drop("held", "place")


def _agreeing(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) out of p, i, j that are similar, by their differences from p."""
    num, den = ratio(threshold)
    i, j = (members.select("p", F.col("k").alias(x), F.col("cost").alias(f"c_{x}"), F.col("grams").alias(f"g_{x}"), *(["budget"] if x == "i" else [])) for x in "ij")
    both = pairs.join(i, ["p", "i"]).join(j, ["p", "j"])
    return both.where(F.col("c_i") + F.col("c_j") - F.size(F.array_intersect("g_i", "g_j")) * (num + den) <= F.col("budget")).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def _linked_sets(docs: DataFrame, sets: DataFrame, text: str, n: int, threshold: float) -> DataFrame | None:
    """Components of the distinct sets (node, component), None where nothing links.

    Sets in one component need no further links, so obvious copies are linked first: in the buckets of a sample of the
    fragments, the pivots are compared with the others. Then all fragments are looked at, and only buckets of several
    components count; there again the pivots are compared with the others. In what is left, members are compared by
    their differences from the pivots: first with the nearest one in each bucket of a gram, then near with far ones.
    """
    num, den = ratio(threshold)
    links = labels = done = None

    def linked(found: DataFrame) -> None:
        nonlocal links, labels
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            labels = connected_components(links)

    def pieces_of(names: DataFrame) -> DataFrame:
        wanted = written(sets.join(names, "k").groupBy("k").agg(F.min("text_hash").alias("text_hash")).select("text_hash"))
        return written(_pieces(docs, wanted, text, n))

    def compared(pairs: DataFrame) -> None:
        nonlocal done
        pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        if pairs.limit(1).count():
            names = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
            linked(written(_similar(pairs, pieces_of(names), threshold)))
            done = pairs if done is None else done.unionByName(pairs)

    compared(_pivot_pairs(_labelled(sets.select("k", F.explode("sample").alias("key")).distinct(), None)))
    keys = _labelled(_fragments(docs, text, n, threshold), labels)
    live = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("top"), F.count("*").alias("often")).where("low < top").select("key", "often")
    rows = written(keys.join(guarded(written(live)), "key").select("key", "k", "level", "spare", "often").distinct())
    rarest = F.row_number().over(Window.partitionBy("k", "level").orderBy(F.desc("often"), "key"))
    rows = rows.withColumn("place", rarest).where("place > spare").select("key", "k")
    rare = _lacking(docs, sets, text, n)
    rows = written(rows if rare is None else rows.unionByName(rare))
    compared(_pivot_pairs(_labelled(rows, labels)))
    family = written(_with_pivots(_labelled(rows, labels)).select("p", "k", "component"))
    names = family.select("k").union(family.select("p")).distinct()
    if not family.limit(1).count():
        return labels
    members = written(_differing(family, pieces_of(names), threshold))
    linked(written(members.where("cost <= budget").select(F.least("p", "k").alias("a"), F.greatest("p", "k").alias("b"))))
    emitted = written(_emitted(members, threshold))

    def once_more() -> DataFrame:
        now = _labelled(emitted.drop("component"), labels)
        return written(now.join(_mixed(now, "p", "gram").drop("members"), ["p", "gram"]))

    rows = once_more()
    nearest = rows.groupBy("p", "gram").agg(F.min(F.struct("cost", "k", "component")).alias("first")).select("p", "gram", F.col("first.k").alias("i"), F.col("first.component").alias("c"))
    first = rows.join(nearest, ["p", "gram"]).where("component <> c").select("p", "i", F.col("k").alias("j")).distinct()
    linked(written(_agreeing(first, members, threshold)))
    rows = once_more()
    near = rows.where("NOT far").select("p", "gram", F.col("k").alias("i"), F.col("component").alias("ci"), F.col("cost").alias("cost_i"), F.col("rest").alias("rest_i"))
    far = rows.where("far").select("p", "gram", F.col("k").alias("j"), F.col("component").alias("cj"), F.col("cost").alias("cost_j"), F.col("rest").alias("rest_j"), "budget")
    # where two lists of grams meet first, what is left of both bounds what they can have in common
    may = (F.col("cost_i") + F.col("cost_j") - F.least("rest_i", "rest_j") * (num + den)) <= F.col("budget")
    order = (F.col("cost_i") < F.col("cost_j")) | ((F.col("cost_i") == F.col("cost_j")) & (F.col("i") != F.col("j")))
    pairs = near.join(far, ["p", "gram"]).where((F.col("ci") != F.col("cj")) & order & may).select("p", F.col("i"), F.col("j")).distinct()
    linked(written(_agreeing(written(pairs), members, threshold)))
    return labels


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the smallest key reachable by links, its own included) of each row.

    Null and empty texts have empty sets and link with nothing, so each is its own component. Equal sets link with each
    other; they are one set throughout, and copies are never expanded into pairs. Rows with equal keys keep a row each;
    a null key takes the smallest key of its component, null if it has none. Other columns are ignored.
    """
    sets = written(_sets(docs, key, text, n, threshold))
    labels = _linked_sets(docs, sets, text, n, threshold)
    full = sets.where("n > 0")
    if labels is not None:
        full = full.join(labels.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    else:
        full = full.withColumn("component", F.col("k"))
    full = written(full.select("doc_id", "text_hash", "n", "component"))
    least = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = full.join(least, "component").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(sets.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """`docs` with one row of each component: the smallest key's, and of several such rows one.

    Texts without words are components of their own and stay; so do null-key rows of components without any key. Null texts
    count as empty, an empty table stays empty, and columns of any names pass through.
    """
    found = jaccard_components(docs, key, text, n, threshold).where("doc_id <=> component_id")
    sure = "n_shingles > 0 AND doc_id IS NOT NULL"
    pick = found.where(sure).groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    pick = pick.unionByName(found.where(f"NOT ({sure})").select("doc_id", "text_hash").distinct())
    pick = pick.select(F.col("doc_id").alias("key"), F.col("text_hash").alias("kept"))
    rows = docs.select(F.col(key).alias("own"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), packed_row(docs).alias("row"))
    stay = rows.join(pick, F.col("own").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("kept")), "left_semi")
    return stay.dropDuplicates(["own", "hash"]).select("row.*")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every document; nulls, ties and empty tables as jaccard_components() says."""
    found = jaccard_components(documents(spark, sf_dir, "doc_id", "text"), n=4, threshold=0.85)
    return found.select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 3], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (h) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
