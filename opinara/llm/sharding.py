"""Sharding by proportional stratified interleaving.

Rows of a source are ranked in a seeded shuffle; the rank over the source's size
places each row in (0, 1), and the global order of these fractions interleaves the
sources in proportion.  Cutting that order into equal runs gives shards of which each
has the corpus' mixture and of which the row counts differ by one at most.  Ranks are
made from bucket offsets plus a rank inside a bucket of bounded size, so no task sees
a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.session import cut

#: Rows of a bucket, about.
BUCKET = 20_000


def shards(docs: DataFrame, n_shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes plus 1), text_crc32, law ``rows``, shard, slot, grown_shard (null).

    A null source is a stratum of its own, a null text has size 1 and the checksum of
    nothing.  Rows that repeat an id lie side by side in an order that does not matter.
    With fewer rows than shards, some shards stay empty; an empty table gives no rows.
    """
    rows = docs.count()
    parts = rows // bucket + 1
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).cast("binary"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    ).withColumn("b", F.expr(f"cast(conv(substr(key, 1, 8), 16, 10) AS bigint) * {parts} div 4294967296"))
    counts = read.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("n"))
    by_source = Window.partitionBy("stratum")
    counts = counts.select("stratum", "b", (F.sum("n").over(by_source.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(by_source).alias("total"))
    inside = Window.partitionBy("stratum", "b").orderBy("key", "id")
    ranked = read.join(counts, ["stratum", "b"]).withColumn("rank", F.col("before") + F.row_number().over(inside))
    placed = ranked.withColumn("place", (2 * F.col("rank") - 1) / (2 * F.col("total"))).withColumn("g", F.floor(F.col("place") * parts))
    placed = cut(placed.select("id", "size", "text_crc32", "stratum", "key", "place", "g"))
    groups = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"))
    order = Window.partitionBy("g").orderBy("place", "stratum", "key", "id")
    at = placed.join(groups, "g").withColumn("pos", F.col("before") + F.row_number().over(order) - 1)
    shard = F.expr(f"cast(pos * {n_shards} div {max(rows, 1)} AS int)")
    first = F.expr(f"(shard * {rows}L + {n_shards - 1}) div {n_shards}")
    return at.withColumn("shard", shard).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
