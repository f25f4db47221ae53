"""Tables that are changed in place: keyed merges that rewrite the touched buckets only.

A stored table is Parquet, partitioned by a hash bucket of its key; the number of buckets is
part of the partition column's name, so the table says itself how it is cut.  A merge reads
the buckets that its rows fall into, joins there, writes the result to the shared checkpoint
folder and then replaces these buckets in one commit.  Run twice, it leaves the same table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.session import drop_stored, stored

BUCKETS = 64
_NAME = re.compile(r"^_bucket_of_(\d+)$")


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _cut_of(table: DataFrame) -> tuple[str, int]:
    name = next((c for c in table.columns if _NAME.match(c)), None)
    if name is None:
        raise ValueError("not a table of buckets")
    return name, int(_NAME.match(name)[1])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table."""
    table = spark.read.parquet(path)
    return table.drop(_cut_of(table)[0])


def create_table(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new stored table; of rows that agree on ``keys`` there must be one."""
    name = f"_bucket_of_{buckets}"
    df.withColumn(name, _bucket(keys, buckets)).repartition(buckets, name).write.partitionBy(name).parquet(path)


def merge(new: DataFrame, path: str, keys: list[str], matched: dict[str, Column] | None = None, missing: dict[str, Column] | None = None, insert: bool = True, buckets: int = BUCKETS, changed: Column | None = None) -> dict[str, int]:
    """Merges ``new`` into the table at ``path``, which it creates where there is none; returns
    how many rows were inserted, updated and kept as they were.

    A stored row whose key ``new`` has becomes what ``matched`` says, column by column, from
    ``old.*`` and ``new.*`` (else the columns of ``new``), where ``changed`` holds (else always).
    A key that the table lacks is inserted with the columns of ``new``, or what ``missing`` says,
    where ``insert``.  A key twice in ``new`` raises.  Rows with a null in their key are merged
    like others."""
    spark = new.sparkSession
    held = stored(new)
    if held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count():
        raise ValueError(f"a key of {keys} occurs twice in the rows to merge")
    if _exists(spark, path):
        table = spark.read.parquet(path)
        name, n = _cut_of(table)
        touched = [r[0] for r in held.select(_bucket(keys, n)).distinct().collect()]  # one number a bucket at most
        # a literal list prunes the scan to these buckets
        old = table.where(F.col(name).isin(touched))
    else:
        name, n = f"_bucket_of_{buckets}", buckets
        old = held.withColumn(name, F.lit(0)).where("false")
    columns = [c for c in old.columns if c != name]
    a = old.select(F.struct(*columns).alias("old"), *[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)])
    b = held.select(F.struct(*held.columns).alias("new"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)])
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    both = a.join(b, on, "full_outer")
    hit = F.col("old").isNotNull() & F.col("new").isNotNull()
    touch = hit & (F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(True))
    given = set(held.columns)

    def value(c: str) -> Column:
        kind = old.schema[c].dataType
        fresh = (missing or {}).get(c, F.col(f"new.{c}") if c in given else F.lit(None))
        later = (matched or {}).get(c, F.col(f"new.{c}") if c in given and matched is None else F.col(f"old.{c}"))
        return F.when(F.col("old").isNull(), fresh.cast(kind)).when(touch, later.cast(kind)).otherwise(F.col(f"old.{c}")).alias(c)

    state = F.when(F.col("old").isNull(), "inserted").when(touch, "updated").otherwise("kept").alias("_state")
    rows = both if insert else both.where("old IS NOT NULL")
    out = stored(rows.select(*[value(c) for c in columns], state))
    counts = {r["_state"]: r["n"] for r in out.groupBy("_state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get("inserted") or counts.get("updated"):
        ready = out.drop("_state").withColumn(name, _bucket(keys, n))
        ready.repartition(n, name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    drop_stored(out)
    drop_stored(held)
    return {k: counts.get(k, 0) for k in ("inserted", "updated", "kept")}


# -- what the engine stores --------------------------------------------------

LABELS = ("positive", "negative", "neutral")
SCORES = ["positive_score", "negative_score", "neutral_score"]


def store_sentiment(scored: DataFrame, path: str, model: str, at: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Results (review_id, label, scores, confidence, compound) by review; a new result takes the
    place of an old one and of a manual correction."""
    now = F.lit(at).cast("timestamp")
    rows = scored.select("review_id", "label", *[F.col(c).cast("double").alias(c) for c in (*SCORES, "confidence", "compound")])
    rows = rows.withColumns({"model": F.lit(model), "analysed_at": now, "corrected_by": F.lit(None).cast("string"), "corrected_at": F.lit(None).cast("timestamp")})
    return merge(rows, path, ["review_id"], buckets=buckets)


def not_analysed(reviews: DataFrame, path: str) -> DataFrame:
    """The reviews without a stored result."""
    spark = reviews.sparkSession
    return reviews.join(read_table(spark, path).select("review_id"), "review_id", "left_anti") if _exists(spark, path) else reviews


def correct_sentiment(corrections: DataFrame, path: str, at: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Manual corrections (review_id, label, corrected_by): the label changes, and the compound score,
    which explained another label, goes; the other scores stay.  A review without a result gets
    a judgement of its own: one for the label, nought for the others, full confidence."""
    if corrections.where(~F.col("label").isin(*LABELS) | F.col("label").isNull()).limit(1).count():
        raise ValueError(f"a label must be one of {', '.join(LABELS)}")
    now = F.lit(at).cast("timestamp")
    rows = corrections.select("review_id", "label", *[(F.col("label") == x).cast("double").alias(f"{x}_score") for x in LABELS], F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("compound"))
    rows = rows.join(corrections.select("review_id", F.col("corrected_by").cast("string").alias("corrected_by")), "review_id")
    rows = rows.withColumns({"model": F.lit("manual"), "analysed_at": now, "corrected_at": now})
    change = {"label": F.col("new.label"), "compound": F.lit(None), "corrected_by": F.col("new.corrected_by"), "corrected_at": F.col("new.corrected_at")}
    return merge(rows, path, ["review_id"], matched=change, buckets=buckets)


def store_aspects(links: DataFrame, path: str, names_path: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Aspect results (review_id, project_id, aspect, label, confidence) by review and aspect; aspects
    that a project has not had are added to its names first."""
    merge(links.select("project_id", "aspect").distinct(), names_path, ["project_id", "aspect"], changed=F.lit(False), buckets=buckets)
    rows = links.select("review_id", "project_id", "aspect", "label", F.col("confidence").cast("double").alias("confidence"))
    return merge(rows, path, ["review_id", "aspect"], matched={"label": F.col("new.label"), "confidence": F.col("new.confidence")}, buckets=buckets)


def store_findings(current: DataFrame, path: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Reconciles findings (review_id, finding_type, severity, evidence, text_sha256) with the stored
    ones: new ones wait for review; one whose evidence changed, or that was stale, waits again
    and loses its review; one that is no longer found turns stale and keeps its evidence."""
    spark, keys = current.sparkSession, ["review_id", "finding_type"]
    rows = current.select(*keys, "severity", "evidence", "text_sha256", F.lit("needs_review").alias("status"), F.lit(None).cast("string").alias("reviewed_by"))
    stale = 0
    if _exists(spark, path):
        gone = read_table(spark, path).where("status <> 'stale'").join(current.select(*keys), keys, "left_anti").select(*keys)
        stale = merge(gone, path, keys, matched={"status": F.lit("stale")}, insert=False)["updated"]
    differs = F.lit(False)
    for c in ("severity", "evidence", "text_sha256"):
        differs = differs | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    got = merge(rows, path, keys, changed=differs | (F.col("old.status") == "stale"), buckets=buckets)
    return {"created": got["inserted"], "updated": got["updated"], "stale": stale}
