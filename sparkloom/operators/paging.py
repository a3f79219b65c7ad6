"""Pages of conversations by a small table of page boundaries, so that a page reads its own messages only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 50
MARK = "conversation_id, page, first, last"


def marks(messages: DataFrame, size: int = SIZE) -> DataFrame:
    """conversation_id, page (from 0), first and last: the ords that each page of `size` messages begins and ends with.

    Messages (conversation_id, ord) have one ord each within their conversation; rows with null ones are left out.
    """
    known = messages.where("conversation_id IS NOT NULL AND ord IS NOT NULL").select("conversation_id", "ord")
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("ord")) - 1
    return known.withColumn("page", F.floor(place / size).cast("int")).groupBy("conversation_id", "page").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))


def extended(old: DataFrame, messages: DataFrame, added: DataFrame, size: int = SIZE) -> DataFrame:
    """The marks after messages have been added behind the last ones of their conversations.

    messages: all of them; added: the new ones. Pages but the last of each touched conversation stay as they are, so only
    messages from its last page's first one on are numbered anew.
    """
    touched = added.select("conversation_id").distinct()
    last = old.join(touched, "conversation_id").groupBy("conversation_id").agg(F.max_by(F.struct("page", "first"), "page").alias("m"))
    open_ = touched.join(last.select("conversation_id", F.col("m.page").alias("base"), F.col("m.first").alias("since")), "conversation_id", "left")
    tail = messages.join(open_, "conversation_id").where("since IS NULL OR ord >= since").select("conversation_id", "ord")
    new = marks(tail, size).join(open_, "conversation_id").select("conversation_id", (F.col("page") + F.coalesce("base", F.lit(0))).cast("int").alias("page"), "first", "last")
    kept = old.join(open_.select("conversation_id", F.col("base")), "conversation_id", "left").where("base IS NULL OR page < base")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def pages(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The messages of wanted pages (conversation_id, page, first, last: rows of marks()), with their page."""
    at = wanted.select("conversation_id", "page", "first", "last")
    return messages.join(at, "conversation_id").where("ord BETWEEN first AND last").drop("first", "last")


def page(messages: DataFrame, index: DataFrame, conversation: object, number: int) -> DataFrame:
    """One page of one conversation, by conditions that reach the files; empty where there is no such page."""
    mark = index.where((F.col("conversation_id") == conversation) & (F.col("page") == number)).first()  # a row at most
    if mark is None:
        return messages.limit(0)
    return messages.where((F.col("conversation_id") == conversation) & F.col("ord").between(mark["first"], mark["last"]))
