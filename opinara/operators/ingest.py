"""Ingestion: classified rows, profile, preview statistics, page context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.functions import text as T


def classify(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Raw rows (row_no, text, rating, date as strings) with clean text, parsed values, the
    reason a row is invalid, and whether an earlier valid row has the same normalised text, or
    ``existing`` (content_key) has it.  Texts do not move: their digests meet, and come back
    to the rows of which the text was seen."""
    read = raw.select("row_no", T.clean_text(F.col("text")).alias("clean"), "rating", T.parse_rating(F.col("rating")).alias("stars"), T.parse_date(F.col("date")).alias("review_date"))
    judged = read.withColumn("reason", F.when(F.col("clean") == "", "empty_text").when(~T.rating_ok(F.col("rating")), "bad_rating"))
    keyed = judged.where("reason IS NULL").select("row_no", F.sha2(F.lower("clean"), 256).alias("content_key"))
    first = keyed.groupBy("content_key").agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = keyed.join(first, "content_key").where("row_no > first").select("row_no")
    if existing is not None:
        again = again.unionByName(keyed.join(existing.select("content_key"), "content_key", "left_semi").select("row_no")).distinct()
    return judged.join(again.withColumn("_again", F.lit(True)), "row_no", "left").withColumn("is_duplicate", F.coalesce("_again", F.lit(False))).drop("_again")


def outcomes(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("reason", F.when(F.col("is_duplicate"), "duplicate").otherwise("valid")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def profile(classified: DataFrame) -> DataFrame:
    ok = F.col("reason").isNull()
    size, stars = F.when(ok, F.length("clean")), F.when(ok, F.col("stars"))
    return classified.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(ok).alias("valid"), F.count_if(F.col("reason") == "empty_text").alias("empty_text"), F.count_if("is_duplicate").alias("duplicates"),
        F.bround(F.avg(size), 2).alias("mean_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.bround(F.avg(stars), 4).alias("mean_rating"), F.median(stars).alias("median_rating"),
    )


def preview_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: non-empty values, smallest and largest number, whether all are numbers."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p")
    v = F.col("v")
    number = v.try_cast("double")
    return df.select(pairs).select("p.*").groupBy("column").agg(F.count_if(F.trim(v) != "").alias("non_empty"), F.min(number).alias("min_value"), F.max(number).alias("max_value"), F.bool_and(v.isNull() | (F.trim(v) == "") | number.isNotNull()).alias("is_numeric"))


def rating_mismatch(scored: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows of which the rating and a strong text score say the opposite."""
    said = T.rating_label(F.col("rating"))
    return scored.where((F.abs("compound") >= least) & (((said == "negative") & (F.col("label") == "positive")) | ((said == "positive") & (F.col("label") == "negative"))))


def flag_counts(classified: DataFrame) -> DataFrame:
    """(kind, value, n): valid rows by quality flag, language guess and rating."""
    ok = classified.where("reason IS NULL")
    rating = F.when(F.col("stars") == F.floor("stars"), F.col("stars").cast("int").cast("string")).otherwise(F.bround("stars", 2).cast("string"))
    parts = F.concat(F.transform(T.quality_flags(F.col("clean")), lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("value"))), F.array(F.struct(F.lit("language").alias("kind"), T.language_hint(F.col("clean")).alias("value")), F.struct(F.lit("rating").alias("kind"), F.coalesce(rating, F.lit("missing")).alias("value"))))
    return ok.select(F.explode(parts).alias("p")).select("p.*").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def flag_samples(classified: DataFrame, n: int = 3) -> DataFrame:
    """(flag, rank, row_no, chars): the first ``n`` valid rows of each quality flag."""
    each = classified.where("reason IS NULL").select("row_no", F.length("clean").alias("chars"), F.explode(T.quality_flags(F.col("clean"))).alias("flag"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("flag").orderBy("row_no"))).where(F.col("rank") <= n).select("flag", "rank", "row_no", "chars")


def error_samples(classified: DataFrame, n: int = 20) -> DataFrame:
    """(row_no, reason) of the first ``n`` invalid rows."""
    return classified.where("reason IS NOT NULL").select("row_no", "reason").orderBy("row_no").limit(n)


def mismatch_samples(scored: DataFrame, n: int = 3, least: float = 0.4) -> DataFrame:
    """The first ``n`` rows of each kind of strong disagreement of rating and text, and how many there are."""
    kind = F.when(F.col("compound") > 0, "strong_positive_text_low_rating").otherwise("strong_negative_text_high_rating")
    by = Window.partitionBy("type")
    each = rating_mismatch(scored, least).withColumn("type", kind).withColumn("total", F.count(F.lit(1)).over(by)).withColumn("rank", F.row_number().over(by.orderBy("review_id")))
    return each.where(F.col("rank") <= n).select("type", "rank", "review_id", "rating", "compound", "total")


def warnings_of(facts: DataFrame) -> DataFrame:
    """(severity, warnings) of a profile row with row_count, valid, duplicates, mismatches, unknown_language, short and caps."""
    c = F.col
    tests = [
        (c("row_count") == 0, "zero_rows"), (c("valid") == 0, "no_valid_rows"), ((c("valid") > 0) & (c("duplicates") / F.greatest(F.lit(1), c("row_count")) >= 0.25), "duplicates"), (c("mismatches") >= 3, "rating_mismatch"),
        ((c("unknown_language") > 0) & (c("unknown_language") >= F.greatest(F.lit(1), F.floor(c("row_count") / 4))), "language"), ((c("short") > 0) & (c("short") >= F.greatest(F.lit(1), F.floor(c("valid") / 5))), "short_texts"), (c("caps") > 0, "caps"),
    ]
    found = facts.withColumn("warnings", F.array_compact(F.array(*[F.when(t, name) for t, name in tests])))
    return found.select(F.when((c("row_count") == 0) | (c("valid") == 0), "error").when(F.size("warnings") > 0, "warning").otherwise("info").alias("severity"), F.array_join("warnings", ",").alias("warnings"))


def _inside(html, tag: str):
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: T.clean_text(x))


def website_context(pages: DataFrame) -> DataFrame:
    """(page_id, title, description, headings, excerpt, content_hash): title of 400 characters at most, meta
    description of 600, the first eight different h1 and then h2, 1800 characters of the body
    without script and style, and the page's SHA-256."""
    html = F.coalesce("html", F.lit(""))
    meta = F.regexp_extract(html, r"(?is)<meta\s[^>]*name=[\"']description[\"'][^>]*>", 0)
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)^.*?<body\b[^>]*>|</body>.*$", ""), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    headings = F.slice(F.array_distinct(F.filter(F.concat(_inside(html, "h1"), _inside(html, "h2")), lambda x: x != "")), 1, 8)
    return pages.select(
        "page_id", F.substring(T.clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, 400).alias("title"), F.substring(T.clean_text(F.regexp_extract(meta, r"(?is)content=[\"']([^\"']*)", 1)), 1, 600).alias("description"),
        F.array_join(headings, " | ").alias("headings"), F.substring(T.clean_text(body), 1, 1800).alias("excerpt"), F.sha2("html", 256).alias("content_hash"),
    )
