"""Summaries of a project in words: six kinds and the overall one, from its figures by template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("overall", "executive", "positive", "negative", "comparative", "periodic")

# Sentences, with what is put into them.
FACT = "Of %s analysed reviews, %s%% were positive, %s%% negative and %s%% neutral (average confidence %s%%)."
NO_FACT = "No analysed reviews are available for this date range yet."
WORST = '"%s" is the most frequently identified negative aspect in the analysed feedback (%s%% negative across %s mentions).'
BEST = '"%s" is the most frequently identified positive aspect (%s%% positive across %s mentions).'
NO_ASPECT = "No aspect-level data is available for this date range yet."
TOPICS = "The most prominent topics identified in the feedback are %s."
NO_TOPIC = "No topic analysis data is available for this date range yet."
TERMS = "Frequently mentioned terms include %s."
OPEN = "%s system-generated recommendation(s) are currently open and awaiting review."
NO_OPEN = "No open recommendations have been generated for this project."
SHARE = "The negative-sentiment share has been %s over the most recent periods."
COMPARED = "Negative-sentiment share is %s compared to the previous period in this date range. "
NOT_COMPARED = "Not enough historical data across periods to generate a period-over-period comparison yet."
STRONG = "Aspects with the strongest %s sentiment: %s."
NOT_STRONG = "No aspect-level %s-sentiment data is available for this date range yet."
LINE = '"%s" — %s%% %s across %s mentions'


def strongest(stats: DataFrame, label: str, n: int = 3) -> DataFrame:
    """(project_id, <label>_aspects): the ``n`` aspects with the largest share of a label, as structs in order;
    ties by frequency, then name."""
    order = Window.partitionBy("project_id").orderBy(F.desc(f"{label}_pct"), F.desc("frequency"), "aspect")
    first = stats.where(F.col(label) > 0).withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return first.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("k", "aspect", F.col(f"{label}_pct").alias("pct"), "frequency"))).alias(f"{label}_aspects"))


def directions(periods: DataFrame) -> DataFrame:
    """(project_id, direction) of the negative share in the last period against the one before; null with one period only."""
    w = Window.partitionBy("project_id").orderBy("period")
    moved = periods.withColumn("d", F.col("negative_pct") - F.lag("negative_pct").over(w))
    last = moved.groupBy("project_id").agg(F.max_by(F.struct("d"), "period")["d"].alias("d"))
    return last.select("project_id", F.when(F.col("d") > 0, "increasing").when(F.col("d") < 0, "decreasing").when(F.col("d") == 0, "stable").alias("direction"))


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def texts(summary: DataFrame, stats: DataFrame, terms: DataFrame, periods: DataFrame, topics: DataFrame | None = None, open_recommendations: DataFrame | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """(project_id, kind, text) of all six kinds.

    summary: (project_id, analysed, <label>_pct, avg_confidence); stats: aspects with counts and
    percentages; terms, topics: (project_id, rank, keyword or name), of which five and three are
    named; periods: a trend by month; open_recommendations: (project_id, ...).  What a project
    has no figures of is said by a sentence of its own."""
    listed = lambda df, c, n: df.where(F.col("rank") <= n).groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]).alias(c))
    rows = summary.join(strongest(stats, "positive"), "project_id", "left").join(strongest(stats, "negative"), "project_id", "left").join(listed(terms, "keyword", 5), "project_id", "left").join(directions(periods), "project_id", "left")
    rows = rows.join(listed(topics, "name", 3), "project_id", "left") if topics is not None else rows.withColumn("name", F.lit(None).cast("array<string>"))
    if open_recommendations is not None:
        rows = rows.join(open_recommendations.groupBy("project_id").agg(F.count(F.lit(1)).alias("open")), "project_id", "left")
    else:
        rows = rows.withColumn("open", F.lit(0))
    fact = F.when(F.col("analysed") > 0, F.format_string(FACT, _s("analysed"), _s("positive_pct"), _s("negative_pct"), _s("neutral_pct"), _s(F.bround(F.col("avg_confidence") * 100, 1)))).otherwise(NO_FACT)
    top = lambda label, form: F.when(F.size(f"{label}_aspects") > 0, F.format_string(form, F.col(f"{label}_aspects")[0]["aspect"], _s(F.col(f"{label}_aspects")[0]["pct"]), _s(F.col(f"{label}_aspects")[0]["frequency"])))
    both = F.concat_ws(" ", top("negative", WORST), top("positive", BEST))
    aspect = F.when(both == "", NO_ASPECT).otherwise(both)
    topic = F.when(F.size("name") > 0, F.format_string(TOPICS, F.array_join(F.transform("name", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "))).otherwise(NO_TOPIC)
    keyword = F.when(F.size("keyword") > 0, F.format_string(TERMS, F.array_join("keyword", ", ")))
    waiting = F.when(F.coalesce("open", F.lit(0)) > 0, F.format_string(OPEN, _s("open"))).otherwise(NO_OPEN)
    moved = F.when(F.col("direction").isNotNull(), F.format_string(SHARE, F.col("direction")))

    def strong(label: str) -> Column:
        lines = F.transform(f"{label}_aspects", lambda a: F.format_string(LINE, a["aspect"], _s(a["pct"]), F.lit(label), _s(a["frequency"])))
        return F.when(F.size(f"{label}_aspects") > 0, F.format_string(STRONG, F.lit(label), F.array_join(lines, "; ")))

    span = "Across all available review dates" if not (date_from or date_to) else f"Through {date_to}" if not date_from else f"From {date_from} onward" if not date_to else f"For the period {date_from} to {date_to}"
    said = {
        "overall": F.concat_ws(" ", fact, topic, aspect, keyword),
        "executive": F.concat_ws(" ", fact, aspect, moved, waiting),
        "positive": F.coalesce(strong("positive"), F.lit(NOT_STRONG % "positive")),
        "negative": F.coalesce(F.concat(strong("negative"), F.lit(" "), waiting), F.lit(NOT_STRONG % "negative")),
        "comparative": F.coalesce(F.concat(F.format_string(COMPARED, F.col("direction")), fact), F.lit(NOT_COMPARED)),
        "periodic": F.concat(F.lit(f"{span}: "), fact, F.lit(" "), topic),
    }
    # a template filled with a missing direction is no sentence
    said["comparative"] = F.when(F.col("direction").isNotNull(), said["comparative"]).otherwise(NOT_COMPARED)
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), said[k].alias("text")) for k in KINDS])).alias("s")
    return rows.select("project_id", parts).select("project_id", "s.*")
