"""Composites: provenance, comparisons, report sections and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.functions import text as T
from opinara.operators.reviews import label_counts, mean_confidence, trend, with_percentages
from opinara.session import cut


def provenance(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest origins (dataset, source) of each project, and whether there are more."""
    by = df.groupBy("project_id", "dataset_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count("review_date").alias("dated"), F.min("review_date").alias("first_date"), F.max("review_date").alias("last_date"))
    w = Window.partitionBy("project_id")
    ranked = by.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "source", "dataset_id"))).withColumn("truncated", F.count(F.lit(1)).over(w) > n)
    return ranked.where(F.col("rank") <= n)


def metadata_rollup(records: DataFrame, keys: list[str]) -> DataFrame:
    """(field, value, n) of a metadata map's ``keys``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.try_element_at("metadata", F.lit(k)).alias("value")) for k in keys])
    return records.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def undated(df: DataFrame) -> DataFrame:
    """Rows that a trend skips, per project."""
    return df.groupBy("project_id").agg(F.count_if(F.col("review_date").isNull()).alias("skipped_no_date"), F.count(F.lit(1)).alias("reviews"))


def comparison(scored: DataFrame, links: DataFrame, terms: DataFrame, projects: list[int], known: DataFrame) -> DataFrame:
    """Two projects or more side by side: reviews and analysed ones, labels with percentages and mean
    confidence (null without an analysed review), mean rating, the aspects with most positive and
    most negative mentions (ties by name), keywords in order, and the share of each label by month.

    scored: all reviews that are not deleted, spam and duplicates among them; links: their
    aspects; terms: (project_id, keyword, rank).  An unknown project is an error."""
    if len(set(projects)) < 2:
        raise ValueError("a comparison needs two projects")
    there = {r[0] for r in known.where(F.col("project_id").isin(projects)).select("project_id").distinct().collect()}
    if missing := sorted(set(projects) - there):
        raise ValueError(f"unknown projects: {missing}")
    some = lambda df: df.where(F.col("project_id").isin(projects))
    counted = some(scored).groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count("label").alias("analysed"), *label_counts(), mean_confidence("label"), F.bround(F.avg("rating"), 2).alias("average_rating"))
    by = some(links).groupBy("project_id", "aspect").agg(*label_counts())
    # the first of two aspects with equal counts is the one whose name comes first: the least of (-count, name)
    most = lambda x: F.min(F.when(F.col(x) > 0, F.struct((-F.col(x)).alias("n"), "aspect")))["aspect"].alias(f"top_{x}_aspect")
    tops = by.groupBy("project_id").agg(most("positive"), most("negative"))
    words = some(terms).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]), ",").alias("top_keywords"))
    months = trend(some(scored), "monthly")
    line = F.concat_ws("/", *[F.col(x).cast("string") for x in ("positive", "negative", "neutral")])
    trends = months.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period", line.alias("l")))), lambda x: F.concat_ws("=", x["period"], x["l"])), ",").alias("trend"))
    out = with_percentages(counted, "analysed", None)
    for more in (tops, words, trends):
        out = out.join(more, "project_id", "left")
    return out


def comparison_narrative(entities: DataFrame) -> DataFrame:
    """(text): which project has the highest share of positive reviews (ties by id), and what each
    project's most frequent negative aspect is; a sentence on missing data where nothing is analysed."""
    name = F.concat(F.lit("Project "), F.col("project_id").cast("string"))
    best = F.min(F.when(F.col("positive_pct").isNotNull(), F.struct((-F.col("positive_pct")).alias("p"), F.col("project_id").alias("i"), F.format_string("%s has the highest positive sentiment percentage (%s%%).", name, F.col("positive_pct").cast("string")).alias("t"))))["t"]
    about = F.when(F.col("top_negative_aspect").isNotNull(), F.struct("project_id", F.format_string("%s's most common negative feedback relates to \"%s\".", name, F.col("top_negative_aspect")).alias("t")))
    told = entities.agg(best.alias("best"), F.array_sort(F.collect_list(about)).alias("about"))
    return told.select(F.when(F.col("best").isNull(), "Not enough analysed data across the selected projects to compare sentiment.").otherwise(F.concat_ws(" ", "best", F.transform("about", lambda x: x["t"]))).alias("text"))


def evidence_rollup(outputs: dict[str, DataFrame]) -> DataFrame:
    """(tool, rows, evidence, sources): what each tool's rows (review_id, source) rest on."""
    each = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("tool"), "review_id", "source") for name, df in outputs.items()])
    ids = each.groupBy("tool", "review_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return ids.groupBy("tool").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("evidence"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


SECTIONS = (
    "projectOverview", "executiveSummary", "sentimentDistribution", "sentimentTrends", "topicAnalysis", "keywordAnalysis", "aspectSentiment", "recommendations",
    "comparison", "alerts", "representativeReviews", "securityFindings", "investigationFindings", "conclusion", "aiInterpretation",
)
LABELS = ("positive", "negative", "neutral")


def tags(scored: DataFrame, links: DataFrame, findings: DataFrame, stop_words: list[str]) -> DataFrame:
    """(project_id, section, item, label, review_date, review_id): what each review adds to a report.

    scored: reviews that are not deleted, with text; one pass over it makes the tags of all
    sections that a review's own columns decide.  links, findings: (review_id, project_id, ...)."""
    tag = lambda section, item: F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"))
    clean = ~F.col("is_spam") & ~F.col("is_duplicate")
    single = [
        tag("projectOverview", F.lit("reviews")), F.when(F.col("label").isNotNull(), tag("sentimentDistribution", F.col("label"))), F.when(F.col("review_date").isNotNull(), tag("sentimentTrends", F.date_format("review_date", "yyyy-MM"))),
        F.when(clean, tag("representativeReviews", F.col("review_id"))), F.when(clean, tag("sourceProvenance", F.coalesce("source", F.lit("unknown")))),
    ]
    words = F.transform(F.array_distinct(F.filter(T.keyword_tokens(F.col("text")), lambda w: ~w.isin(*stop_words))), lambda w: tag("keywordAnalysis", w))
    all_tags = F.concat(F.array_compact(F.array(*single)), F.when(~F.col("is_spam"), F.coalesce(words, F.array().cast("array<struct<section:string,item:string>>"))).otherwise(F.array().cast("array<struct<section:string,item:string>>")))
    columns = ["project_id", "section", "item", "label", "review_date", "review_id"]
    own = scored.select("project_id", "label", "review_date", "review_id", F.explode(all_tags).alias("t")).select("project_id", "t.*", "label", "review_date", "review_id").select(*columns)
    said = links.select("project_id", F.lit("aspectSentiment").alias("section"), F.col("aspect").alias("item"), "label", "review_date", "review_id")
    found = findings.select("project_id", F.lit("securityFindings").alias("section"), F.col("finding_type").alias("item"), F.lit(None).cast("string").alias("label"), "review_date", "review_id")
    return own.unionByName(said.select(*columns)).unionByName(found.select(*columns))


def report(tagged: DataFrame, given: dict[str, DataFrame] | None = None, wanted: tuple[str, ...] = SECTIONS, keywords: int = 20, reviews: int = 500) -> DataFrame:
    """(project_id, section, rank, item, n, positive, negative, neutral, line) of a report's sections.

    One aggregate with grouping sets counts items and whole sections together; a section that no
    review adds to has no row of its grouping, and stands under ``skipped`` instead.  Rank 0 is
    the section as a whole, items follow: keywords and aspects by frequency, months in order,
    reviews newest first.  ``given``: ready sections (project_id, item, line), such as topics,
    alerts, a summary or an investigation's findings.  ``sourceProvenance`` is always there."""
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == x).alias(x) for x in LABELS], F.max("review_date").alias("last"), F.min("review_date").alias("first")]
    cube = cut(tagged.groupingSets([["project_id", "section", "item"], ["project_id", "section"]], "project_id", "section", "item").agg(F.grouping("item").alias("whole"), *counts))
    section, item, parts = F.col("section"), F.col("item"), cube.where("whole = 0")
    newest = [F.desc_nulls_last("last"), item.try_cast("bigint"), item]
    frequent = [F.desc("n"), item]

    def first(rows: DataFrame, order: list, most: int | None = None) -> DataFrame:
        # with a plain limit, each task keeps its own first rows before they meet
        numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("project_id", "section").orderBy(*order)))
        return numbered.where(F.col("rank") <= most) if most else numbered

    by_name, long = section.isin("sentimentTrends", "securityFindings"), section.isin("keywordAnalysis", "representativeReviews")
    ranked = cube.where("whole = 1").withColumn("rank", F.lit(0))
    for some in (first(parts.where(section == "keywordAnalysis"), frequent, keywords), first(parts.where(section == "representativeReviews"), newest, reviews), first(parts.where(by_name), [item]), first(parts.where(~by_name & ~long), frequent)):
        ranked = ranked.unionByName(some)
    span = F.concat(F.coalesce(F.col("first").cast("string"), F.lit("?")), F.lit(" to "), F.coalesce(F.col("last").cast("string"), F.lit("?")))
    columns = ["project_id", "section", "rank", "item", "n", *LABELS, "line"]
    counted = ranked.withColumn("line", F.when((section == "projectOverview") & (F.col("whole") == 1), span)).select(*columns)
    # an aspect of three mentions or more, half of them negative, asks for something
    share = T.percentage(F.col("negative"), F.col("n"), 0.0)
    urgent = counted.where((section == "aspectSentiment") & (F.col("rank") > 0) & (F.col("n") >= 3) & (share >= 50))
    asked = urgent.withColumn("line", F.when(share >= 75, "high").when(share >= 60, "medium").otherwise("low")).withColumn("section", F.lit("recommendations"))
    asked = asked.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc(share), F.desc("n"), "item"))).select(*columns)
    # the conclusion rests on the labels and the aspect that is named most
    win = F.max(F.when((section == "sentimentDistribution") & (F.col("rank") == 0), F.struct("n", *LABELS)))
    top = F.max(F.when((section == "aspectSentiment") & (F.col("rank") == 1), item))
    ends = counted.where(section.isin("sentimentDistribution", "aspectSentiment") & (F.col("rank") <= 1)).groupBy("project_id").agg(win.alias("w"), top.alias("top")).where("w IS NOT NULL AND top IS NOT NULL")
    main = F.greatest(*[F.col(f"w.{x}") for x in LABELS])
    label = F.when(F.col("w.positive") == main, "positive").when(F.col("w.negative") == main, "negative").otherwise("neutral")
    said = F.format_string('Based on %d reviews, the dominant sentiment is %s (%s%%). The most-discussed aspect is "%s".', F.col("w.n"), label, T.percentage(main, F.col("w.n"), 0.0).cast("string"), F.col("top"))
    null = F.lit(None).cast("bigint")
    bare = lambda df, name: df.select("project_id", F.lit(name).alias("section"), "rank", F.col("item").cast("string").alias("item"), null.alias("n"), *[null.alias(x) for x in LABELS], "line")
    out = counted.unionByName(asked).unionByName(bare(ends.select("project_id", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("item"), said.alias("line")), "conclusion"))
    for name, df in (given or {}).items():
        out = out.unionByName(bare(df.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("item", "line"))), name))
    kept = out.where(section.isin(*wanted, "sourceProvenance"))
    asked_for = cube.select("project_id").distinct().select("project_id", F.explode(F.array(*[F.lit(x) for x in wanted])).alias("item"))
    absent = asked_for.join(kept.select("project_id", F.col("section").alias("item")).distinct(), ["project_id", "item"], "left_anti")
    return kept.unionByName(bare(absent.select("project_id", F.lit(0).alias("rank"), "item", F.lit(None).cast("string").alias("line")), "skipped"))


def lookup(df: DataFrame, ids: list[int]) -> DataFrame:
    """Evidence of the given reviews that are eligible: project, source, date, the text as shown, whether
    that is the whole, its length, and where it comes from as JSON."""
    shown = T.truncated(F.col("text"))
    provenance = F.to_json(F.struct(*[F.col(c) for c in ("source", "lang", "dataset_id") if c in df.columns]))
    some = df.where(F.col("review_id").isin(ids))
    return some.select("review_id", "project_id", "source", "review_date", shown.alias("content"), (shown == F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars"), provenance.alias("provenance"))


def narrative(summary: DataFrame) -> DataFrame:
    """(project_id, text): a sentence on the labels, most frequent first, by template."""
    parts = F.array_sort(F.array(*[F.struct((-F.col(f"{x}_pct")).alias("k"), F.lit(x).alias("x"), F.col(f"{x}_pct").alias("p")) for x in ("positive", "negative", "neutral")]))
    return summary.select("project_id", F.concat(F.lit("Feedback is "), F.array_join(F.transform(parts, lambda y: F.format_string("%s%% %s", y["p"].cast("string"), y["x"])), ", "), F.lit(".")).alias("text"))
