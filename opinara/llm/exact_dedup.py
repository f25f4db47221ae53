"""Exact dedup by two-pass Bloom filtering.

A narrow table (id, SHA-256 of the normalised text) is written once, in ranges of the
hash so small that each range's filter can be sent to all executors.  Pass 1 counts, per
Bloom slot, how many rows hit it; slots hit twice or more are kept as 64-bit words.  Pass 2
probes each row: a row of which some slot was hit once only is unique and passes straight
through; the others may be repeated, and only they shuffle, to be grouped by their SHA-256.
False positives cost a shuffled row, never a wrong result.  Ranges take their turn one
after the other, so that the filter is complete at any number of rows and its broadcast
stays within FILTER_BYTES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.session import cut, drop_stored, stored

#: Runs of ASCII white space that are not one space already; replacing the others would cost most.
WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Bytes that the words of one range's filter may take when they are sent to all executors.
FILTER_BYTES = 64 << 20
#: Bytes that the list of rows that go may take when it is sent to all executors.
BROADCAST_BYTES = 24 << 20
#: A filter word as a row: its number and its mask, and what a hash table adds.
WORD_BYTES = 32


def normalised(text: Column) -> Column:
    """``text`` (null: empty) with each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _sha(text_col: str) -> Column:
    return F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256)


def _slots(hashed: DataFrame, words: int) -> DataFrame:
    """The word of a row and its two different bits in it."""
    first = F.shiftrightunsigned("h", 52).bitwiseAND(F.lit(63)).cast("int")
    step = F.pmod(F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(4095)), F.lit(63)).cast("int") + 1
    return hashed.withColumn("word", F.pmod("h", F.lit(words))).withColumn("b1", first).withColumn("b2", (first + step) % 64)


def repeated_slots(slots: DataFrame) -> DataFrame:
    """Pass 1: (word, mask) with a 1 for each slot that two rows or more hit."""
    hits = slots.select("word", F.explode(F.array("b1", "b2")).alias("bit")).groupBy("word", "bit").count().where("count >= 2")
    return hits.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))


def _probed(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, rows: int | None, filter_bytes: int) -> list[DataFrame]:
    """Of each range: rows (id, sha, maybe), ``maybe`` where the text may occur again."""
    n = docs.count() if rows is None else rows
    ranges = max(1, -(-n * bits_per_row // 64 * WORD_BYTES // max(1, filter_bytes)))
    words = max(1, n * bits_per_row // 64 // ranges)
    hashed = docs.select(F.col(f"`{id_col}`").alias("id"), _sha(text_col).alias("sha")).withColumn("h", F.xxhash64("sha"))
    narrow = stored(hashed.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(ranges)).cast("int")))
    own, out = F.expr("shiftleft(1L, b1) | shiftleft(1L, b2)"), []
    for part in range(ranges):
        slots = _slots(narrow.where(F.col("part") == part), words)
        mask = cut(repeated_slots(slots))
        maybe = F.coalesce(F.col("mask").bitwiseAND(own) == own, F.lit(False)).alias("maybe")
        probed = slots.join(F.broadcast(mask), "word", "left").select("id", "sha", maybe)
        out.append(stored(probed) if ranges > 1 else probed)
    if ranges > 1:
        drop_stored(narrow)
    return out


def _answers(probed: DataFrame) -> DataFrame:
    """(id, keep_id, group_size, kept, sha) of the rows of one range."""
    alone = probed.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = probed.where("maybe").select("id", "sha")
    groups = maybe.groupBy("sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return alone.unionByName(maybe.join(groups, "sha").select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = 16, rows: int | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  A null id loses to any other; of a group with null
    ids only, keep_id is null and the rows are kept.  Rows that repeat an id with an
    equal text are one document and get equal answers (``kept_rows`` keeps one of
    them).  Other columns are ignored, whatever their names.  An empty table gives
    an empty result.
    """
    out = _union([_answers(p) for p in _probed(docs, id_col, text_col, bits_per_row, rows, filter_bytes)])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = 16, rows: int | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged, whatever their names: of
    equal texts the one with the smallest id (nulls as in ``annotate``; of a group with null ids
    only, and of rows that repeat both id and text, one).  Only rows that go, or are repeated,
    are joined with the texts, which move only where that list exceeds BROADCAST_BYTES; the
    join's key holds the id, so a text that a third of all rows share is spread over all tasks."""
    marks = []
    for probed in _probed(docs, id_col, text_col, bits_per_row, rows, filter_bytes):
        maybe = probed.where("maybe").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n"))
        first = maybe.groupBy("sha").agg(F.min("id").alias("keep_id"), F.sum("n").alias("size")).where("size > 1")
        stays = F.col("id").eqNullSafe(F.col("keep_id"))
        marks.append(cut(maybe.join(first, "sha").where(~stays | (F.col("n") > 1)).select("id", "sha", stays.alias("stays"))))
    gone = _union(marks)
    if gone.count() * 128 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("_id"), _sha(text_col).alias("_sha"))
    judged = packed.join(gone, (F.col("_sha") == F.col("sha")) & F.col("_id").eqNullSafe(F.col("id")), "left")
    alone, repeated = judged.where("stays IS NULL"), judged.where("stays").dropDuplicates(["_sha", "_id"])
    return alone.select("row.*").unionByName(repeated.select("row.*"))
