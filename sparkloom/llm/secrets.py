"""Secret scans in DataFrame operations only.

Three kinds are certain by their form: assignments, access identifiers and long hexadecimal runs. Two more are weak on
their own, secret-looking runs and endpoints: they are reported only when a complementary part lies within reach in the
same text, which is found by an interval join over bins of `reach` code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written

# What the kinds look like, in the order in which spans that start together are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "endpoint", "weak")
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "endpoint": r"https?://[A-Za-z0-9.-]+[A-Za-z0-9/_.:-]*",
    "weak": r"[A-Za-z0-9+/]{32,}",
}
#: How far apart complementary parts may lie, in code points.
REACH = 240
SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Runs of so many code points, cut by a regular expression in one pass, stand for a text where places in it are looked up.
RUN = 256
#: Arrays are summed in blocks of so many elements.
SUMMED = 1024


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each element of an array of int joined with all before it.

    Appending to an array copies it, so elements are joined in blocks, then the blocks' last ones, and both are put
    together: for n elements some 500 n copies of a pointer and (n / 1024) ** 2 more.
    """
    grown = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, join(x, F.element_at(acc, -1))).otherwise(x))))
    last = lambda blocks: grown(F.transform(blocks, lambda b: F.element_at(b, -1)))

    def shifted(x: Column) -> Column:
        return F.flatten(F.transform(x["blocks"], lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda y: join(y, F.get(x["lasts"], i - 1))))))

    def summed(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / SUMMED).cast("int")), lambda b: grown(F.slice(a, b * SUMMED + 1, SUMMED)))
        return named(named(blocks, lambda b: F.struct(b.alias("blocks"), last(b).alias("lasts"))), shifted)

    return named(values, lambda a: F.when(F.size(a) > 1, summed(a)).otherwise(a))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places, from the lengths of matches and of the pieces between them."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces"))

    def placed(x: Column) -> Column:
        ends = running(F.transform(x["hits"], lambda h, i: F.length(F.get(x["pieces"], i)) + F.length(h)), lambda y, z: y + z)
        return named(ends, lambda e: F.transform(x["hits"], lambda h, i: F.struct((F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("end"), h.alias("hit"))))

    return named(found, placed)


def spans(kind: str, text: Column) -> Column:
    """The kind's spans in `text`; a cheap search for what every match holds goes first."""
    found = matches(text, PATTERNS[kind])
    guard = F.lit(True)
    if kind == "assign":
        low = F.lower(text)
        guard = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["hit"], "^" + ASSIGN, 2)) >= 6)
    elif kind == "access":
        guard = F.contains(text, F.lit("AKIA"))
    elif kind == "hex":
        guard = text.rlike(PATTERNS["hex"])
    elif kind == "endpoint":
        guard = F.contains(text, F.lit("://"))
    else:
        guard = text.rlike(PATTERNS["weak"])
        found = F.filter(found, lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[a-z]") & x["hit"].rlike("[A-Z]"))
    found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    return F.when(guard, found).otherwise(F.array().cast(SPAN))


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak spans of `parts` (key, base, weak) with a complementary base span within reach: key, links.

    A secret-looking run needs an access identifier, an endpoint needs an access identifier or an assignment. Both sides
    are cut into bins of `reach` code points. Spans of a kind don't overlap, so a bin holds a bounded number of them.
    """
    weak = parts.select("key", F.explode("weak").alias("w")).select("key", "w", F.explode(F.sequence(F.floor((F.col("w.start") - reach) / reach), F.floor((F.col("w.end") + reach) / reach))).alias("bin"))
    base = parts.select("key", F.explode("base").alias("b")).where(f"b.kind < {KINDS.index('hex')}")
    base = base.select("key", "b", F.explode(F.sequence(F.floor(F.col("b.start") / reach), F.floor(F.col("b.end") / reach))).alias("bin"))
    near = (F.col("b.start") - F.col("w.end") <= reach) & (F.col("w.start") - F.col("b.end") <= reach)
    fits = (F.col("w.kind") == KINDS.index("endpoint")) | (F.col("b.kind") == KINDS.index("access"))
    apart = (F.col("b.start") >= F.col("w.end")) | (F.col("w.start") >= F.col("b.end"))
    found = weak.alias("x").join(base.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.bin") == F.col("y.bin")) & near & fits & apart, "left_semi")
    return found.groupBy("key").agg(F.collect_set("w").alias("links"))


def secret_spans(docs: DataFrame, keep: list[str], text: str = "text", reach: int = REACH) -> DataFrame:
    """The columns `keep` of `docs`, with base_spans and secret_spans (base ones and linked weak ones, in order).

    Null texts count as empty and empty texts have no spans; rows are independent, so ties, repeated rows and null keys
    need nothing. Kept columns may have any names but base_spans and secret_spans, which are replaced. Weak parts are linked once for each distinct text, by its digest, so a group of copies costs one.
    """
    body = text_or_empty(text)
    base = F.array_sort(F.concat(*[spans(k, body) for k in KINDS[:3]]))
    keep = [c for c in keep if c not in ("base_spans", "secret_spans")]
    own = F.struct(F.lit(0).alias("__row"), *[F.col(f"`{c}`") for c in keep]).alias("__kept")  # away from the names used below
    found = docs.select(own, base.alias("base_spans"), body.alias("__text"))
    sure = F.size(F.filter("base_spans", lambda s: s["kind"] < KINDS.index("hex"))) > 0
    weak = F.when(sure, F.concat(*[spans(k, F.col("__text")) for k in KINDS[3:]])).otherwise(F.array().cast(SPAN))
    found = found.withColumn("__weak", weak).withColumn("__key", F.when(F.size("__weak") > 0, F.sha2("__text", 256))).drop("__text")
    found = written(found)
    some = found.where("__key is not null")
    parts = some.groupBy(F.col("__key").alias("key")).agg(F.first("base_spans").alias("base"), F.first("__weak").alias("weak"))
    some = some.join(linked(parts, reach).withColumnRenamed("key", "__key"), "__key", "left")
    some = some.withColumn("secret_spans", F.array_sort(F.concat("base_spans", F.coalesce("links", F.array().cast(SPAN)))))
    none = found.where("__key is null").withColumn("secret_spans", F.col("base_spans"))
    out = some.select("__kept", "base_spans", "secret_spans").unionByName(none.select("__kept", "base_spans", "secret_spans"))
    return out.select(*[F.col("__kept")[c].alias(c) for c in keep], "base_spans", "secret_spans")


def listed(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column) -> Column:
    """`text` with each stretch that spans cover replaced by the name of its first kind."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def between(runs: Column, start: Column, stop: Column) -> Column:
        first = F.floor(start / RUN).cast("int")
        near = F.array_join(F.slice(runs, first + 1, F.floor(stop / RUN).cast("int") - first + 1), "")
        return F.substring(near, start - first * RUN + 1, stop - start)

    def joined(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(F.lit(0))
        kept = F.transform(found, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(x["runs"], before(i), s["start"]), F.get(names, s["kind"]))).otherwise(""))
        last = F.element_at(x["ends"], -1)
        return F.concat(F.array_join(kept, ""), between(x["runs"], last, F.greatest(last, x["size"])))

    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0))
    parts = F.struct(runs.alias("runs"), running(F.transform(found, lambda s: s["end"]), F.greatest).alias("ends"), F.length(text).alias("size"))
    return F.when(F.size(found) > 0, named(parts, joined)).otherwise(text)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every document; nulls, ties and empty tables as secret_spans() says."""
    found = secret_spans(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("secret_spans").alias("spans"))


def _sql_spans(kind: str, keep: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    return f"""SELECT * FROM (SELECT rid, doc_id, {KINDS.index(kind)} AS kind, unnest(hits) AS hit,
  unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0)))::BIGINT AS start
  FROM (SELECT rid, doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS pieces FROM d) WHERE len(hits) > 0) WHERE {keep}"""


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_sql_spans("assign", "length(regexp_extract(hit, '^" + ASSIGN.replace("'", "''") + "', 2)) >= 6")} UNION ALL {_sql_spans("access", "true")} UNION ALL {_sql_spans("hex", "true")}),
w AS ({_sql_spans("endpoint", "true")} UNION ALL {_sql_spans("weak", "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')")}),
e AS (SELECT *, start + length(hit) AS stop FROM s), f AS (SELECT *, start + length(hit) AS stop FROM w),
g AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM e WHERE e.rid = f.rid AND e.kind < 2 AND e.start - f.stop <= {REACH} AND f.start - e.stop <= {REACH}
  AND (f.kind = 3 OR e.kind = 1) AND (e.start >= f.stop OR f.start >= e.stop))),
h AS (SELECT rid, kind, start, stop, true AS base FROM e UNION ALL SELECT rid, kind, start, stop, false FROM g),
n AS (SELECT *, (['assign', 'access', 'hex', 'endpoint', 'weak'])[kind + 1] || ':' || start || ':' || stop AS name FROM h),
r AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name, ',' ORDER BY start, kind) FILTER (base) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans FROM n GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (rid)
"""
