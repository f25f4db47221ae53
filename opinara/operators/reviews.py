"""Filters, sentiment, summaries, trends, keywords and aspects over reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.functions import text as T


def eligible(df: DataFrame, spam: bool = False, duplicates: bool = False) -> DataFrame:
    """Not deleted; spam and duplicates only where asked for."""
    keep = ~F.col("is_deleted")
    if not spam:
        keep = keep & ~F.col("is_spam")
    if not duplicates:
        keep = keep & ~F.col("is_duplicate")
    return df.where(keep)


def filtered(df: DataFrame, date_from: str | None = None, date_to: str | None = None, source: str | None = None, rating: float | None = None, label: str | None = None, min_confidence: float | None = None, undated: bool = False, dataset: int | None = None) -> DataFrame:
    """Result filters; undated rows drop out of a date range unless ``undated``."""
    day, none = F.col("review_date"), F.col("review_date").isNull() & F.lit(undated)
    for given, test in ((date_from, lambda: (day >= F.lit(date_from).cast("date")) | none), (date_to, lambda: (day <= F.lit(date_to).cast("date")) | none), (source, lambda: F.col("source") == source), (dataset, lambda: F.col("dataset_id") == dataset), (rating, lambda: F.col("rating") == rating), (label, lambda: F.col("label") == label), (min_confidence, lambda: F.col("confidence") >= min_confidence)):
        if given is not None:
            df = df.where(test())
    return df


def once(value: Column) -> Column:
    """A costly value that filters above it shall read, not compute again: an expression
    that is not deterministic stays where it is written."""
    return F.when(F.spark_partition_id() >= 0, value)


def usable(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of which the text is more than white space of any kind."""
    return df.where(F.col(text_col).rlike(r"(?U)\S"))


def keyword_policy(text: Column, include: list[str], exclude: list[str], groups: dict[str, list[str]] | None = None) -> Column:
    """struct(kept, included, excluded, <group>...): terms that a text holds.  An excluded term
    wins; without include terms every other text is kept; further groups annotate only."""
    held = lambda terms: F.array_compact(F.array(*[F.when(T.has_term(text, x), F.lit(x)) for x in terms])) if terms else F.array().cast("array<string>")
    inside, outside = held(include), held(exclude)
    kept = (F.size(outside) == 0) & ((F.size(inside) > 0) if include else F.lit(True))
    return F.struct(kept.alias("kept"), inside.alias("included"), outside.alias("excluded"), *[held(v).alias(k) for k, v in (groups or {}).items()])


def _tokens(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z']+")


def lexicon_sum(text: Column, lexicon: dict[str, float]) -> Column:
    """Sum of the valences of a text's tokens ``[A-Za-z']+``."""
    valence = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    # only tokens of the lexicon are taken out of the text
    words = "|".join(sorted(lexicon, key=len, reverse=True))
    hits = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<![a-z'])(?:{words})(?![a-z'])"), F.lit(0))
    return F.aggregate(hits, F.lit(0.0), lambda a, w: a + F.element_at(valence, w))


def sentiment(df: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """``df`` with compound (sum / 3 within [-1, 1]), its parts positive_score, negative_score and
    neutral_score, confidence (its size) and label."""
    raw = F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), lexicon_sum(F.col(text_col), lexicon) / 3)), 4)
    scored = df.withColumn("compound", once(raw) if not df.isStreaming else raw)
    size = F.abs("compound").cast("decimal(5,4)")
    parts = {"positive_score": F.greatest("compound", F.lit(0.0)), "negative_score": F.greatest(-F.col("compound"), F.lit(0.0)), "neutral_score": F.bround(1 - F.abs("compound"), 4)}
    return scored.withColumns({"confidence": size, "label": T.compound_label(F.col("compound")), **parts})


def token_valences(df: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep``, place, token, lowered, valence, matched: tokens ``\\S+`` whose lower-cased form without
    punctuation at its ends is not empty."""
    raw = df.select(*keep, F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+")).alias("place", "token"))
    low = raw.withColumn("lowered", F.regexp_replace(F.lower("token"), r"^\p{Punct}+|\p{Punct}+$", "")).where("lowered <> ''")
    names = F.broadcast(df.sparkSession.createDataFrame(list(lexicon.items()), "lowered string, valence double").where("valence <> 0"))
    return low.join(names, "lowered", "left").select(*keep, "place", "token", "lowered", F.coalesce("valence", F.lit(0.0)).alias("valence"), F.col("valence").isNotNull().alias("matched"))


def contributing(tokens: DataFrame, labels: DataFrame, key: str = "review_id", n: int = 8) -> DataFrame:
    """The first ``n`` matched tokens of each text in the direction of its label, strongest first."""
    sign = F.when(F.col("label") == "negative", -1).when(F.col("label") == "positive", 1)
    some = tokens.where("matched").join(labels.select(key, "label"), key).where(F.col("valence") * sign > 0)
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("valence")), "place")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(key, "rank", "token", "valence")


def label_counts() -> list[Column]:
    return [F.count_if(F.col("label") == x).alias(x) for x in ("positive", "negative", "neutral")]


def with_percentages(df: DataFrame, total: str = "total", empty: float | None = 0.0) -> DataFrame:
    for x in ("positive", "negative", "neutral"):
        df = df.withColumn(f"{x}_pct", T.percentage(F.col(x), F.col(total), empty))
    return df


def mean_confidence(of: str | None = None) -> Column:
    n = F.count(of) if of else F.count(F.lit(1))
    return F.bround(F.try_divide(F.sum("confidence").cast("double"), n), 4).alias("avg_confidence")


def summary(scored: DataFrame) -> DataFrame:
    """Counts, percentages and mean confidence per project; ``total`` counts all rows, the
    percentages are of those with a label (``analysed``)."""
    counted = scored.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count("label").alias("analysed"), *label_counts(), mean_confidence("label"))
    return with_percentages(counted, "analysed")


def period(granularity: str) -> Column:
    day = F.col("review_date")
    return {"daily": F.date_format(day, "yyyy-MM-dd"), "weekly": F.date_format(F.date_trunc("week", day), "yyyy-MM-dd"), "monthly": F.date_format(day, "yyyy-MM")}[granularity]


def trend(scored: DataFrame, granularity: str) -> DataFrame:
    """Dated rows by project and period."""
    by = scored.where("review_date IS NOT NULL").groupBy("project_id", period(granularity).alias("period"))
    return with_percentages(by.agg(F.count(F.lit(1)).alias("total"), *label_counts(), mean_confidence()))


def trend_direction(periods: DataFrame, delta: float = 3.0) -> DataFrame:
    """Per project, the last period against the one before: negative share (any change) and positive share (beyond ``delta`` points)."""
    w = Window.partitionBy("project_id").orderBy("period")
    moved = periods.withColumn("dn", F.col("negative_pct") - F.lag("negative_pct").over(w)).withColumn("dp", F.col("positive_pct") - F.lag("positive_pct").over(w))
    last = moved.groupBy("project_id").agg(F.max_by(F.struct("dn", "dp"), "period").alias("x"))
    return last.select(
        "project_id",
        F.when(F.col("x.dn") > 0, "increasing").when(F.col("x.dn") < 0, "decreasing").otherwise("stable").alias("negative_direction"),
        F.when(F.col("x.dp") >= delta, "improving").when(F.col("x.dp") <= -delta, "declining").otherwise("stable").alias("positive_direction"),
    )


def keywords(scored: DataFrame, stop_words: list[str], n: int = 50, with_bigrams: bool = True, search: str | None = None) -> DataFrame:
    """Top ``n`` terms per project by document frequency, with label counts, the mean of
    positive minus negative score, and the majority label (``unanalysed`` without any).

    Bigrams join neighbours after stop words went; ties go by term.  As no bigram is more
    frequent than its rarer word, bigrams are built of those words only that are as frequent as
    the ``n``-th of the project; ``search`` keeps terms that hold it."""
    tokens = F.filter(T.keyword_tokens(F.col("text")), lambda w: ~w.isin(*stop_words))
    base = scored.select("project_id", "label", (F.col("positive_score") - F.col("negative_score")).alias("_d"), tokens.alias("_t"))
    by = Window.partitionBy("project_id").orderBy(F.desc("frequency"), "keyword")
    counts = [F.count(F.lit(1)).alias("frequency"), *label_counts(), F.count("label").alias("_n"), F.sum(F.col("_d").cast("decimal(6,4)")).alias("_s")]
    held = lambda c: c.contains(search.lower()) if search else F.lit(True)
    each = base.select("project_id", "label", "_d", F.explode(F.array_distinct("_t")).alias("keyword"))
    single = each.groupBy("project_id", "keyword").agg(*counts)
    if not with_bigrams:
        counted = single.where(held(F.col("keyword")))
    else:
        # with a search, rarer words may be in the answer, so every word counts
        wanted = single if search else single.withColumn("_r", F.rank().over(Window.partitionBy("project_id").orderBy(F.desc("frequency")))).where(F.col("_r") <= n)
        top = wanted.groupBy("project_id").agg(F.collect_set("keyword").alias("_top"))
        inside = lambda x: F.array_contains(F.col("_top"), x)
        if search:
            pairs = base.select("project_id", "label", "_d", F.explode(F.array_distinct(T.bigrams(F.col("_t")))).alias("keyword"))
        else:
            marked = base.join(F.broadcast(top), "project_id").select("project_id", "label", "_d", F.transform("_t", lambda w: F.when(inside(w), w)).alias("_t"))
            near = F.zip_with(F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))), F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
            pairs = marked.select("project_id", "label", "_d", F.explode(F.array_distinct(F.array_compact(near))).alias("keyword"))
        double = pairs.groupBy("project_id", "keyword").agg(*counts)
        counted = single.unionByName(double).where(held(F.col("keyword")))
    major = F.when(F.col("positive") > F.greatest("negative", "neutral"), "positive").when(F.col("negative") > F.greatest("positive", "neutral"), "negative").when(F.col("_n") == 0, "unanalysed").otherwise("neutral")
    ranked = counted.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    return ranked.select("project_id", "keyword", "frequency", "positive", "negative", "neutral", F.bround(F.try_divide(F.col("_s").cast("double"), F.col("_n")), 4).alias("avg_score"), "rank", major.alias("majority"))


def overlaid(vocabulary: dict[str, list[str]], rows: list[tuple[str, list[str]]]) -> dict[str, list[str]]:
    """A vocabulary with a project's rows (name, surface forms) over it: names in lower case,
    forms trimmed, in lower case and each once, the name among them; a later row wins."""
    out = {k: list(v) for k, v in vocabulary.items()}
    for name, forms in rows:
        name = " ".join(name.split()).lower()
        if not name or len(name) > 150:
            raise ValueError("an aspect needs a name of 150 characters at most")
        out[name] = list(dict.fromkeys(x for x in (" ".join(f.split()).lower() for f in [name, *forms]) if x))[:50]
    return out


def aspects(df: DataFrame, vocabulary: dict[str, list[str]], lexicon: dict[str, float]) -> DataFrame:
    """(review_id, project_id, review_date, source, aspect, label, confidence): each aspect of which
    a surface form stands in the text, scored on the sentences that hold it.

    An aspect's regular expression runs where the text holds one of its forms."""
    rx = {a: _surface(forms) for a, forms in sorted(vocabulary.items())}
    text, low = F.col("text"), F.col("_low")
    held = lambda forms: reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in forms])
    hits = F.array_compact(F.array(*[F.when(held(vocabulary[a]) & text.rlike(x), F.struct(F.lit(a).alias("aspect"), F.lit(x).alias("rx"))) for a, x in rx.items()]))
    df = df.withColumn("_low", F.lower(text))
    keep = ["review_id", "project_id", "review_date", "source"]
    found = df.select(*keep, "text", F.explode(hits).alias("a")).select(*keep, "text", "a.*")
    local = F.array_join(F.filter(T.sentences(F.col("text")), lambda s: F.rlike(s, F.col("rx"))), " ")
    scored = sentiment(found.select(*keep, "aspect", "text", local.alias("local")).select(*keep, "aspect", F.when(F.col("local") != "", F.col("local")).otherwise(F.col("text")).alias("context")), lexicon, "context")
    return scored.select(*keep, "aspect", "label", "confidence")


def _surface(forms: list[str]) -> str:
    return r"(?i)(^|[^A-Za-z0-9_])(" + "|".join(sorted(dict.fromkeys(forms), key=lambda x: (-len(x), x))) + r")([^A-Za-z0-9_]|$)"


def aspect_stats(links: DataFrame, names: DataFrame) -> DataFrame:
    """Per project and aspect, also those that never occur; sorted, most frequent first, by ``ranked``."""
    counted = links.groupBy("project_id", "aspect").agg(F.count(F.lit(1)).alias("frequency"), *label_counts(), mean_confidence())
    full = names.join(counted, ["project_id", "aspect"], "left").fillna(0, ["frequency", "positive", "negative", "neutral"])
    return with_percentages(full, "frequency")


def argmax_aspect(stats: DataFrame, label: str) -> DataFrame:
    """Per project, the aspect with most rows of ``label`` (ties by name); none where all are 0."""
    w = Window.partitionBy("project_id").orderBy(F.desc(label), "aspect")
    return stats.where(F.col(label) > 0).withColumn("k", F.row_number().over(w)).where("k = 1").select("project_id", F.col("aspect").alias(f"top_{label}"), F.col(label).alias(f"n_{label}"))


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new``, and rows of ``old`` without a successor."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Three-way state of findings: inserted, updated, unchanged or stale."""
    both = old.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new")), keys, "full_outer")
    state = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "stale").when(F.col("_old") != F.col("_new"), "updated").otherwise("unchanged")
    return both.select(*keys, F.coalesce("_new", "_old").alias(value), state.alias("state"))


def ordered(df: DataFrame, order: list, n: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``rank`` in a total order, the first ``n`` (all without) of each key in ``by``.

    Without a key, the first ``n`` of every partition are taken before they meet."""
    if by:
        out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return out.where(F.col("rank") <= n) if n else out
    if not n:
        raise ValueError("an order over all rows needs a limit")
    first = df.orderBy(*order).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def insert_missing(old: DataFrame, new: DataFrame, a: str, b: str) -> DataFrame:
    """Links of ``new`` that ``old`` has in neither direction: an insert that may be repeated."""
    pair = lambda df: df.select(F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")).distinct()
    return new.join(pair(old), (F.least(a, b) == F.col("_x")) & (F.greatest(a, b) == F.col("_y")), "left_anti")


def dimension(old: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Get or create: rows of ``old``, and of ``found`` those whose key is new."""
    return old.select(*keys).unionByName(found.select(*keys).distinct().join(old, keys, "left_anti"))


def flag(df: DataFrame, ids: DataFrame, column: str, value=True, key: str = "review_id") -> DataFrame:
    """Flag update: ``column`` becomes ``value`` in the rows named by ``ids`` and stays in the others."""
    marked = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).drop("_hit").select(*df.columns)


def date_span(df: DataFrame, date_from: str | None = None, date_to: str | None = None, fallback_days: int = 365, today: str | None = None) -> DataFrame:
    """(project_id, date_from, date_to): given dates, else the first and last review date, else
    the ``fallback_days`` before ``today``; an inverted span is turned round."""
    end = F.lit(today).cast("date") if today else F.current_date()
    by = df.groupBy("project_id").agg(F.min("review_date").alias("lo"), F.max("review_date").alias("hi"))
    hi = F.coalesce(F.lit(date_to).cast("date"), "hi", end)
    lo = F.coalesce(F.lit(date_from).cast("date"), "lo", F.date_sub(hi, fallback_days))
    return by.select("project_id", F.least(lo, hi).alias("date_from"), F.greatest(lo, hi).alias("date_to"))
