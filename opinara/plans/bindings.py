"""The canonical relations, derived from the test tables by integer arithmetic.

The corpus is invented prose without product talk, so every fifth review says one of the
sentences below after its own text; the rule tables are the library's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.rules import ASPECTS, CATEGORIES, LEXICON, SECURITY  # noqa: F401
from opinara.functions.text import dedup_key
from opinara.session import drop_stored, stored

SENTENCES = [
    "I love the screen, excellent quality and great sound.",
    "Terrible battery, it does not work and I hate the charging.",
    "The app freezes and shows an error message since version 2.4.1.",
    "Please add a dark display, would like to see it soon.",
    "Why is the delivery so slow?",
    "Customer support was rude; the helpline is useless.",
    "Too expensive, the price is awful. I will cancel my plan.",
    "I switched from Acme to Globex because the camera is better there.",
    "We are leaving Acme for Initech as the interface is confusing.",
    "Someone logged in without permission, my account was taken over from 203.0.113.9.",
    "A fake support account sent a phishing link https://Login.Example.net/reset?id=5#top, beware.",
    "They leaked my personal data, see CVE-2024-12345 and http://acme.test:8080/report/.",
    "Release 2.4.1 crashed again, version 2.4.1 is buggy and slow.",
    "Fast shipping and sturdy packaging, highly recommend it.",
    "I choose Globex. It is easy to use, since the design is beautiful.",
    "Possible scam: unauthorised charge after I replaced Acme with Globex.",
    "Expired TLS certificate on files.globex.test, certificate warning every day.",
    "It downloaded malware 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08 to my box.",
    "Call me at +1 (212) 555-0100 or write to ann.lee@corp.example.com.",
    "Globex is fine, Initech is okay, nothing special.",
]
#: Sentences that try the rules of emphasis; a review whose id is a multiple of three gets one of them.
EMPHATIC = [
    "The screen is VERY good, but the battery is not great!!!",
    "At least it isn't a horrible phone.",
    "Never so good, and without doubt excellent??",
    "It was kind of slow, hardly fast and no good at all.",
    "AWFUL support; I LOVE the sound though!",
    "Yeah right, a great phone to die for.",
    "The least helpful, least friendly shop, yet not the worst???",
    "No love, no perfect camera, nor a good one.",
]
COMPETITORS = ["Acme", "Globex", "Initech"]
_INGESTED: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; texts in fewer files than there are cores are dealt out to all of them.  (A
    corpus of many files is read as it lies.)"""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and len(df.inputFiles()) < cores else df


def _text() -> Column:
    i = F.col("doc_id")
    said = F.element_at(F.array(*[F.lit(x) for x in SENTENCES]), (F.floor(i / 5) % len(SENTENCES) + 1).cast("int"))
    return F.when(i % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said)).otherwise(F.col("text"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews as ingestion writes them: their columns and text, the digest and length of the
    normalised text, and the flags of spam and of texts that the project had before.

    One row per document; the first row of a text wins.  Only digests are shuffled to find
    repeats; the flags meet the texts once, here, and every query reads them side by side."""
    i = F.col("doc_id")
    base = table(spark, sf_dir, "documents").select(
        i.alias("review_id"), (i % 4).alias("project_id"), _text().alias("text"), "source", "lang",
        F.when(i % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 120).cast("int"))).alias("review_date"),
        F.when(i % 7 != 0, (i % 11) / 2.0).alias("rating"),
        (i % 23 == 0).alias("is_deleted"), (i % 3).alias("dataset_id"),
    ).withColumn("_k", dedup_key(F.col("text")))
    keyed = base.withColumn("content_key", F.sha2("_k", 256)).withColumn("content_chars", F.length("_k")).drop("_k")
    narrow = stored(keyed.select("review_id", "project_id", "content_key"))
    first = narrow.groupBy("project_id", "content_key").agg(F.min("review_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = narrow.join(first, ["project_id", "content_key"]).where("review_id > first_id").select("review_id", F.lit(True).alias("is_duplicate"))
    bad = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("review_id"), F.lit(True).alias("is_spam")).distinct()
    marked = stored(again.join(bad, "review_id", "full_outer").groupBy("review_id").agg(F.max("is_duplicate").alias("is_duplicate"), F.max("is_spam").alias("is_spam")))
    # the list of flagged reviews is sent to all executors where its size allows it; beyond that the texts move, once
    flags = F.broadcast(marked) if marked.count() * 64 <= 24 << 20 else marked
    rows = keyed.join(flags, "review_id", "left").fillna(False, ["is_duplicate", "is_spam"])
    out = stored(rows)
    drop_stored(narrow)
    drop_stored(marked)
    return out


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a folder or file was changed, and its bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested reviews, written once for a session and the state of its input."""
    at = (spark.sparkContext.applicationId, sf_dir, *(_state(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
    if at not in _INGESTED:
        _INGESTED[at] = ingested(spark, sf_dir)
    return _INGESTED[at]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested reviews with their texts and flags."""
    return _kept(spark, sf_dir).drop("content_key", "content_chars")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each review what finds repeats and is narrow: no text is read for it."""
    return _kept(spark, sf_dir).select("review_id", "project_id", "source", "is_deleted", "is_spam", "is_duplicate", "content_key", "content_chars")
