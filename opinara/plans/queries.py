"""Queries over the canonical relations, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import rules as X
from opinara.functions import text as T
from opinara.operators import ingest as I
from opinara.operators import reviews as R
from opinara.operators import signals as S
from opinara.operators import topics as M
from opinara.plans import bindings as B
from opinara.plans.bindings import reviews, table

STOP = list(X.stop_words("english", "german", "french", "spanish"))
TODAY = "2024-04-15"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LEX = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in B.LEXICON.items()) + " ELSE 0 END"
_CLEAN = r"trim(regexp_replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_KEY = "lower(" + _CLEAN.format("text") + ")"


def _score(col: str) -> str:
    return f"greatest(-1.0, least(1.0, coalesce(list_sum(list_transform(regexp_extract_all(coalesce({col}, ''), '[A-Za-z'']+'), lambda w: CAST({_LEX} AS DOUBLE))), 0) / 3))"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SAID = "[" + ", ".join(map(lit, B.SENTENCES)) + f"][1 + (doc_id // 5) % {len(B.SENTENCES)}]"
WITH = f"""WITH r0 AS (
  SELECT doc_id AS review_id, doc_id % 4 AS project_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' ' || {_SAID} ELSE text END AS text, source, lang, doc_id % 3 AS dataset_id,
         CASE WHEN doc_id % 17 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 120 AS INT) END AS review_date,
         CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 11) / 2.0 END AS rating,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) AS is_spam, doc_id % 23 = 0 AS is_deleted
  FROM documents d),
reviews AS (SELECT *, row_number() OVER (PARTITION BY project_id, {_KEY} ORDER BY review_id) > 1 AS is_duplicate FROM r0),
alive AS (SELECT * FROM reviews WHERE NOT is_deleted),
eligible AS (SELECT * FROM alive WHERE NOT is_spam AND NOT is_duplicate),
s0 AS (SELECT *, round_even({_score('text')}, 4) AS compound FROM alive),
scored AS (SELECT *, CAST(abs(compound) AS DECIMAL(5,4)) AS confidence, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM s0)"""
_COUNTS = "count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral"


def _pcts(total: str = "total") -> str:
    return ", ".join(f"CASE WHEN {total} > 0 THEN round_even({x} / {total} * 100, 2) ELSE 0.0 END AS {x}_pct" for x in ("positive", "negative", "neutral"))


_CONF = "round_even(CAST(sum(confidence) AS DOUBLE) / count(*), 4) AS avg_confidence"


def alive(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).where("NOT is_deleted")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return R.sentiment(alive(spark, d), B.LEXICON)


@query(WITH + " SELECT review_id, compound, CAST(confidence AS DOUBLE) AS confidence, label FROM scored")
def sentiment_lexicon_score(spark, d):
    return scored(spark, d).select("review_id", "compound", F.col("confidence").cast("double").alias("confidence"), "label")


@query(WITH + f", g AS (SELECT project_id, count(*) AS total, count(label) AS analysed, {_COUNTS}, {_CONF} FROM scored GROUP BY 1) SELECT *, {_pcts()} FROM g")
def sentiment_summary(spark, d):
    return R.summary(scored(spark, d))


@query(WITH + " SELECT review_id, label, CAST(confidence AS DOUBLE) AS confidence, review_date FROM scored WHERE review_date BETWEEN DATE '2024-02-01' AND DATE '2024-03-31' AND label = 'negative' AND confidence >= 0.5")
def sentiment_list_filtered(spark, d):
    got = R.filtered(scored(spark, d), "2024-02-01", "2024-03-31", label="negative", min_confidence=0.5)
    return got.select("review_id", "label", F.col("confidence").cast("double").alias("confidence"), "review_date")


@query(WITH + " SELECT review_id, review_date FROM alive WHERE review_date IS NULL OR review_date >= DATE '2024-03-01'")
def report_reviews_undated(spark, d):
    return R.filtered(alive(spark, d), "2024-03-01", undated=True).select("review_id", "review_date")


def _trend_sql(p: str) -> str:
    return WITH + f", g AS (SELECT project_id, {p} AS period, count(*) AS total, {_COUNTS}, {_CONF} FROM scored WHERE review_date IS NOT NULL GROUP BY 1, 2)"


@query(_trend_sql("strftime(review_date, '%Y-%m-%d')") + f" SELECT *, {_pcts()} FROM g")
def trend_daily(spark, d):
    return R.trend(scored(spark, d), "daily")


@query(_trend_sql("strftime(date_trunc('week', review_date), '%Y-%m-%d')") + f" SELECT *, {_pcts()} FROM g")
def trend_weekly(spark, d):
    return R.trend(scored(spark, d), "weekly")


@query(_trend_sql("strftime(review_date, '%Y-%m')") + f" SELECT *, {_pcts()} FROM g")
def trend_monthly(spark, d):
    return R.trend(scored(spark, d), "monthly")


@query(
    _trend_sql("strftime(date_trunc('week', review_date), '%Y-%m-%d')")
    + f""", p AS (SELECT *, {_pcts()} FROM g), l AS (SELECT *, negative_pct - lag(negative_pct) OVER w AS dn, positive_pct - lag(positive_pct) OVER w AS dp,
  row_number() OVER (PARTITION BY project_id ORDER BY period DESC) AS k FROM p WINDOW w AS (PARTITION BY project_id ORDER BY period))
SELECT project_id, CASE WHEN dn > 0 THEN 'increasing' WHEN dn < 0 THEN 'decreasing' ELSE 'stable' END AS negative_direction,
  CASE WHEN dp >= 3 THEN 'improving' WHEN dp <= -3 THEN 'declining' ELSE 'stable' END AS positive_direction FROM l WHERE k = 1"""
)
def trend_direction_lag(spark, d):
    return R.trend_direction(R.trend(scored(spark, d), "weekly"))


def _kw_sql(n: int, bigrams: bool) -> str:
    terms = "list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))" if bigrams else "list_distinct(t)"
    stops = ", ".join(f"'{w}'" for w in STOP)
    return WITH + f""", t AS (SELECT project_id, label, compound, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]{{3,}}'), lambda w: lower(w)), lambda w: w NOT IN ({stops})) AS t FROM scored WHERE NOT is_spam),
k AS (SELECT project_id, label, compound, unnest({terms}) AS keyword FROM t), g AS (SELECT project_id, keyword, count(*) AS frequency, {_COUNTS}, round_even(CAST(sum(CAST(compound AS DECIMAL(6,4))) AS DOUBLE) / count(*), 4) AS avg_score FROM k GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY frequency DESC, keyword) AS rank FROM g)
SELECT *, CASE WHEN positive > greatest(negative, neutral) THEN 'positive' WHEN negative > greatest(positive, neutral) THEN 'negative' ELSE 'neutral' END AS majority FROM x WHERE rank <= {n}"""


@query(_kw_sql(50, True))
def keyword_bigrams(spark, d):
    return R.keywords(scored(spark, d).where("NOT is_spam"), STOP)


@query(_kw_sql(50, False))
def keyword_df(spark, d):
    return R.keywords(scored(spark, d).where("NOT is_spam"), STOP, with_bigrams=False)


@query("SELECT project_id, keyword AS text, frequency AS weight FROM (" + _kw_sql(100, True) + ")")
def word_cloud(spark, d):
    return R.keywords(scored(spark, d).where("NOT is_spam"), STOP, 100).select("project_id", F.col("keyword").alias("text"), F.col("frequency").alias("weight"))


def _rx(forms: list[str]) -> str:
    return "(?i)(^|[^A-Za-z0-9_])(" + "|".join(sorted(forms, key=lambda x: (-len(x), x))) + ")([^A-Za-z0-9_]|$)"


_ASPECTS = " UNION ALL ".join(
    f"""SELECT review_id, project_id, review_date, source, '{a}' AS aspect,
 coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '' AND regexp_matches(s, '{_rx(f)}')), ' '), ''), text) AS context
 FROM eligible WHERE regexp_matches(text, '{_rx(f)}')"""
    for a, f in sorted(B.ASPECTS.items())
)
_LINKS = WITH + f""", ctx AS ({_ASPECTS}), c1 AS (SELECT *, round_even({_score('context')}, 4) AS compound FROM ctx),
links AS (SELECT review_id, project_id, review_date, source, aspect, CAST(abs(compound) AS DECIMAL(5,4)) AS confidence, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM c1)"""
_STATS = _LINKS + f""", g AS (SELECT project_id, aspect, count(*) AS frequency, {_COUNTS}, {_CONF} FROM links GROUP BY 1, 2),
names AS (SELECT DISTINCT project_id, aspect FROM (SELECT DISTINCT project_id FROM reviews), (SELECT unnest([{', '.join(lit(a) for a in sorted([*B.ASPECTS, 'warranty']))}]) AS aspect)),
f AS (SELECT names.project_id, names.aspect, coalesce(frequency, 0) AS frequency, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, avg_confidence FROM names LEFT JOIN g USING (project_id, aspect)),
stats AS (SELECT *, {_pcts('frequency')} FROM f)"""


def links(spark, d):
    return R.aspects(R.eligible(reviews(spark, d)), B.ASPECTS, B.LEXICON)


def stats(spark, d):
    names = reviews(spark, d).select("project_id").distinct().withColumn("aspect", F.explode(F.array(*[F.lit(a) for a in sorted([*B.ASPECTS, "warranty"])])))
    return R.aspect_stats(links(spark, d), names)


@query(_LINKS + " SELECT review_id, aspect, label, CAST(confidence AS DOUBLE) AS confidence FROM links")
def aspect_extract(spark, d):
    return links(spark, d).select("review_id", "aspect", "label", F.col("confidence").cast("double").alias("confidence"))


@query(_STATS + " SELECT * FROM stats")
def aspect_stats(spark, d):
    return stats(spark, d)


@query(_STATS + ", x AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY negative DESC, aspect) AS k FROM stats WHERE negative > 0) SELECT project_id, aspect AS top_negative, negative AS n_negative FROM x WHERE k = 1")
def top_aspect_argmax(spark, d):
    return R.argmax_aspect(stats(spark, d), "negative")


@query(_LINKS + f", h AS (SELECT * FROM scored WHERE review_id IN (SELECT review_id FROM links WHERE aspect = 'price') AND review_date IS NOT NULL), g AS (SELECT project_id, strftime(review_date, '%Y-%m') AS period, count(*) AS total, {_COUNTS}, {_CONF} FROM h GROUP BY 1, 2) SELECT *, {_pcts()} FROM g")
def trend_aspect_semi(spark, d):
    return R.trend(scored(spark, d).join(links(spark, d).where("aspect = 'price'"), "review_id", "left_semi"), "monthly")


@query(_STATS + """ SELECT project_id, aspect, frequency, negative_pct, CASE WHEN negative_pct >= 75 THEN 'high' WHEN negative_pct >= 60 THEN 'medium' ELSE 'low' END AS priority
FROM stats WHERE frequency >= 3 AND negative_pct >= 50 AND NOT (project_id = 1 AND aspect = 'battery')""")
def recommendations(spark, d):
    return S.recommendations(stats(spark, d), spark.createDataFrame([(1, "battery")], "project_id bigint, aspect string"))


@query(WITH + " SELECT review_id FROM alive WHERE text ILIKE '%apache license%' OR lower(text) LIKE '%idiot of%'")
def review_search_ilike(spark, d):
    return alive(spark, d).where(F.col("text").ilike("%apache license%") | F.lower("text").contains("idiot of")).select("review_id")


@query(WITH + " SELECT project_id, count(*) AS total, count(*) FILTER (is_spam) AS spam, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (is_deleted) AS deleted, count(*) FILTER (NOT is_deleted AND NOT is_spam AND NOT is_duplicate) AS eligible FROM reviews GROUP BY 1")
def data_quality(spark, d):
    ok = ~F.col("is_deleted") & ~F.col("is_spam") & ~F.col("is_duplicate")
    return reviews(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_spam").alias("spam"), F.count_if("is_duplicate").alias("duplicates"), F.count_if("is_deleted").alias("deleted"), F.count_if(ok).alias("eligible"))


@query(WITH + " SELECT review_id, is_duplicate FROM reviews")
def dedup_first_seen(spark, d):
    return reviews(spark, d).select("review_id", "is_duplicate")


@query(WITH + r" SELECT e.review_id FROM eligible e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.review_id) AND regexp_matches(e.text, '\S')")
def pending_reviews_anti(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").alias("review_id"))
    return R.usable(R.eligible(reviews(spark, d))).join(done, "review_id", "left_anti").select("review_id")


_RAW = """WITH raw AS (SELECT doc_id + 2 AS row_no, CASE WHEN doc_id % 31 = 0 THEN '  ' ELSE text END AS text,
 CASE doc_id % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '7.5' WHEN 2 THEN '' ELSE CAST(doc_id % 6 AS VARCHAR) END AS rating,
 CASE doc_id % 5 WHEN 0 THEN '2024-3-' || CAST(1 + doc_id % 28 AS VARCHAR) WHEN 1 THEN '3/' || CAST(1 + doc_id % 28 AS VARCHAR) || '/2024' WHEN 2 THEN CAST(13 + doc_id % 15 AS VARCHAR) || '/4/2024' WHEN 3 THEN '2024/5/' || CAST(1 + doc_id % 28 AS VARCHAR) ELSE 'someday' END AS date FROM documents),
""" + r"""c AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS clean,
 CASE WHEN try_cast(trim(rating) AS DOUBLE) BETWEEN 0 AND 5 THEN try_cast(trim(rating) AS DOUBLE) END AS stars,
 CAST(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%m/%d/%Y'), try_strptime(date, '%d/%m/%Y'), try_strptime(date, '%Y/%m/%d')) AS DATE) AS review_date FROM raw),
e AS (SELECT *, CASE WHEN clean = '' THEN 'empty_text' WHEN trim(coalesce(rating, '')) <> '' AND stars IS NULL THEN 'bad_rating' END AS reason FROM c),
classified AS (SELECT row_no, clean, stars, review_date, reason, reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, lower(clean) ORDER BY row_no) > 1 AS is_duplicate FROM e)"""


def raw(spark, d):
    i = F.col("doc_id")
    s = lambda e: e.cast("string")
    return table(spark, d, "documents").select(
        (i + 2).alias("row_no"), F.when(i % 31 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(i % 9 == 0, "abc").when(i % 9 == 1, "7.5").when(i % 9 == 2, "").otherwise(s(i % 6)).alias("rating"),
        F.when(i % 5 == 0, F.concat(F.lit("2024-3-"), s(1 + i % 28))).when(i % 5 == 1, F.concat(F.lit("3/"), s(1 + i % 28), F.lit("/2024"))).when(i % 5 == 2, F.concat(s(13 + i % 15), F.lit("/4/2024"))).when(i % 5 == 3, F.concat(F.lit("2024/5/"), s(1 + i % 28))).otherwise("someday").alias("date"),
    )


@query(_RAW + " SELECT row_no, stars, review_date, reason, is_duplicate FROM classified")
def ingest_classify(spark, d):
    return I.classify(raw(spark, d)).select("row_no", "stars", "review_date", "reason", "is_duplicate")


@query(_RAW + " SELECT CASE WHEN reason IS NOT NULL THEN reason WHEN is_duplicate THEN 'duplicate' ELSE 'valid' END AS status, count(*) AS n FROM classified GROUP BY 1")
def ingest_outcomes(spark, d):
    return I.outcomes(I.classify(raw(spark, d)))


@query(_RAW + """ SELECT count(*) AS row_count, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason = 'empty_text') AS empty_text, count(*) FILTER (is_duplicate) AS duplicates,
 round_even(avg(length(clean)) FILTER (reason IS NULL), 2) AS mean_length, min(length(clean)) FILTER (reason IS NULL) AS min_length, max(length(clean)) FILTER (reason IS NULL) AS max_length,
 round_even(avg(stars) FILTER (reason IS NULL), 4) AS mean_rating, median(stars) FILTER (reason IS NULL) AS median_rating FROM classified""")
def dataset_profile(spark, d):
    return I.profile(I.classify(raw(spark, d)))


@query("""SELECT c AS "column", count(*) FILTER (v IS NOT NULL AND trim(v) <> '') AS non_empty, min(try_cast(v AS DOUBLE)) AS min_value, max(try_cast(v AS DOUBLE)) AS max_value,
 bool_and(v IS NULL OR trim(v) = '' OR try_cast(v AS DOUBLE) IS NOT NULL) AS is_numeric FROM (SELECT 'event_type' AS c, event_type AS v FROM events UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events) GROUP BY 1""")
def dataset_preview_stats(spark, d):
    return I.preview_stats(table(spark, d, "events"), ["event_type", "value", "user_id"])


@query(WITH + """, m AS (SELECT review_id, rating, compound, CASE WHEN rating <= 2 THEN 'negative' WHEN rating >= 4 THEN 'positive' WHEN rating BETWEEN 2.5 AND 3.5 THEN 'neutral' END AS rl, label FROM scored)
SELECT review_id, rating, compound FROM m WHERE abs(compound) >= 0.4 AND ((rl = 'negative' AND label = 'positive') OR (rl = 'positive' AND label = 'negative'))""")
def rating_label_mismatch(spark, d):
    return I.rating_mismatch(scored(spark, d)).select("review_id", "rating", "compound")


def hit(words: str, tail: str = "", text: str = "text") -> str:
    """SQL test of a phrase between word boundaries of any script."""
    edge = X.EDGE
    end = rf"(?:\?|[^\p{{L}}\p{{N}}_.!?\n][^.!?\n]{{0,179}}\?)" if tail else f"(?:$|{edge})"
    return f"regexp_matches({text}, {lit(f'(?i)(?:^|{edge})(?:{words}){end}')})"


def _cats(configured: bool) -> str:
    tests = [(c, hit(rx, X.TAILS.get(c, ""))) for c, rx in X.CATEGORIES.items()]
    tests += [("COMPETITIVE", " OR ".join(hit(n) for n in B.COMPETITORS))] if configured else []
    tests += [(X.FINDING_CATEGORY.get(k, "SECURITY"), hit(rx)) for k, (_, rx) in X.SECURITY.items()]
    found = ", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, t in tests)
    return f"""h AS (SELECT review_id, source, review_date, list_distinct(list_filter([{found}], lambda x: x IS NOT NULL)) AS h FROM eligible),
cats AS (SELECT review_id, source, review_date, unnest(CASE WHEN len(h) > 0 THEN h ELSE ['OTHER'] END) AS category FROM h)"""


_CATS, _BASE_CATS = WITH + ", " + _cats(True), WITH + ", " + _cats(False)


def cats(spark, d, configured: bool = True):
    terms = {"COMPETITIVE": B.COMPETITORS} if configured else {}
    rows = R.eligible(reviews(spark, d)).select("review_id", "source", "review_date", "text")
    return S.categories(rows, X.CATEGORIES, tails=X.TAILS, configured=terms, findings=X.SECURITY, finding_category=X.FINDING_CATEGORY)


@query(_CATS + " SELECT review_id, category FROM cats")
def feedback_categories(spark, d):
    return cats(spark, d).select("review_id", "category")


@query(_CATS + " SELECT category, count(*) AS n, count(DISTINCT review_id) AS reviews, count(DISTINCT source) AS sources FROM cats GROUP BY 1")
def feedback_totals(spark, d):
    # a review has a category once, so its reviews are its rows
    by = cats(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("source")).cast("long").alias("sources"))
    return by.select("category", "n", F.col("n").alias("reviews"), "sources")


_MOVED = "|".join(f"(?:{x})" for x in X.SWITCHES)
_SENT = "regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]|\\z)')"
_COMP = WITH + ", comp0 AS (" + " UNION ALL ".join(
    f"SELECT review_id, project_id, '{n}' AS competitor, len(regexp_extract_all(text, '(?i)\\b{n}\\b')) AS mentions, list_filter({_SENT}, lambda s: regexp_matches(s, '(?i)(?:{_MOVED})\\s*{n}(?:$|{X.EDGE})')) AS moved FROM eligible WHERE {hit(n)}" for n in B.COMPETITORS
) + f"), comp AS (SELECT review_id, project_id, competitor, mentions, len(moved) > 0 AS switching, list_filter(list_transform(moved, lambda s: trim(regexp_extract(s, '(?i){X.REASON}', 1))), lambda x: x <> '')[1] AS reason FROM comp0)"


@query(_COMP + " SELECT * FROM comp")
def competitor_mentions(spark, d):
    return S.competitors(R.eligible(reviews(spark, d)), B.COMPETITORS)


@query(_COMP + " SELECT project_id, count(*) AS mentions, count(*) FILTER (switching) AS switching_intent, count(DISTINCT competitor) AS competitors FROM comp GROUP BY 1")
def competitor_summary(spark, d):
    got = S.competitors(R.eligible(reviews(spark, d)), B.COMPETITORS)
    return got.groupBy("project_id").agg(F.count(F.lit(1)).alias("mentions"), F.count_if("switching").alias("switching_intent"), F.size(F.collect_set("competitor")).cast("long").alias("competitors"))


_SEC = WITH + ", sec AS (" + " UNION ALL ".join(f"SELECT review_id, source, '{k}' AS finding_type, '{sev}' AS severity, regexp_extract(text, '(?i)\\b(?:{rx})\\b', 0) AS evidence FROM eligible WHERE {hit(rx)}" for k, (sev, rx) in X.SECURITY.items()) + ")"


def findings(spark, d):
    return S.security_signals(R.eligible(reviews(spark, d)), B.SECURITY)

@query(_SEC + " SELECT * FROM sec")
def security_signals(spark, d):
    return findings(spark, d)


@query(_SEC + """, old AS (SELECT review_id, finding_type, CASE WHEN review_id % 3 = 0 THEN 'changed' ELSE evidence END AS evidence FROM sec WHERE review_id % 2 = 0 UNION ALL SELECT 900001, 'MALWARE_REPORT', 'gone')
SELECT coalesce(n.review_id, o.review_id) AS review_id, coalesce(n.finding_type, o.finding_type) AS finding_type, coalesce(n.evidence, o.evidence) AS evidence,
 CASE WHEN o.review_id IS NULL THEN 'inserted' WHEN n.review_id IS NULL THEN 'stale' WHEN o.evidence <> n.evidence THEN 'updated' ELSE 'unchanged' END AS state
FROM old o FULL JOIN sec n ON o.review_id = n.review_id AND o.finding_type = n.finding_type""")
def finding_reconcile(spark, d):
    new = findings(spark, d)
    old = new.where("review_id % 2 = 0").select("review_id", "finding_type", F.when(F.col("review_id") % 3 == 0, "changed").otherwise(F.col("evidence")).alias("evidence"))
    old = old.unionByName(spark.createDataFrame([(900001, "MALWARE_REPORT", "gone")], "review_id bigint, finding_type string, evidence string"))
    return R.reconcile(old, new, ["review_id", "finding_type"], "evidence")


_PARTS = T.URL_PARTS
# separators are doubled, so that one of them can end a match and another begin the next
_IND = WITH + rf""", u AS (SELECT review_id, source, regexp_replace(unnest(regexp_extract_all(text, '(?i)https?://[^\s<>"'']+')), '[.,;:!?)\]}}>]+$', '') AS b FROM eligible),
urls AS (SELECT review_id, source, lower(regexp_extract(b, '{_PARTS}', 1)) || '://' || lower(regexp_extract(b, '{_PARTS}', 2)) || CASE WHEN regexp_extract(b, '{_PARTS}', 3) <> '' THEN ':' || regexp_extract(b, '{_PARTS}', 3) ELSE '' END || left(regexp_extract(b, '{_PARTS}', 4), 512) AS value FROM u WHERE regexp_matches(b, '{_PARTS}')),
ips AS (SELECT review_id, source, unnest(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_.])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_.])((?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}})(?:$|[^\p{{L}}\p{{N}}_.])', 1)) AS value FROM eligible),
sha AS (SELECT review_id, source, lower(unnest(regexp_extract_all(regexp_replace(text, '([^0-9a-fA-F])', '\1\1', 'g'), '(?:^|[^0-9a-fA-F])([0-9a-fA-F]{{64}})(?:$|[^0-9a-fA-F])', 1))) AS value FROM eligible),
dom AS (SELECT review_id, source, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '(?i)https?://[^\s<>"'']+', ' ', 'g'), '([^\p{{L}}\p{{N}}_.-])', '\1\1', 'g'), '(?i)(?:^|[^\p{{L}}\p{{N}}_.-])((?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,63}})(?:$|[^\p{{L}}\p{{N}}_.-])', 1))) AS value FROM eligible),
ind AS (SELECT review_id, source, 'URL' AS kind, value FROM urls UNION SELECT review_id, source, 'DOMAIN', regexp_extract(value, '^https?://([^/:]+)', 1) FROM urls WHERE contains(regexp_extract(value, '^https?://([^/:]+)', 1), '.')
 UNION SELECT review_id, source, 'CVE', upper(unnest(regexp_extract_all(text, '(?i)\bCVE-[0-9]{{4}}-[0-9]{{4,}}\b'))) FROM eligible UNION SELECT review_id, source, 'IP', value FROM ips WHERE list_max(list_transform(string_split(value, '.'), lambda x: CAST(x AS INT))) <= 255
 UNION SELECT review_id, source, 'HASH_SHA256', value FROM sha UNION SELECT review_id, source, 'DOMAIN', value FROM dom)"""


@query(_IND + " SELECT * FROM ind")
def indicator_extract(spark, d):
    return S.indicators(R.eligible(reviews(spark, d)))


@query(_IND + ", g AS (SELECT kind, value, count(DISTINCT review_id) AS reviews, count(DISTINCT source) AS sources FROM ind GROUP BY 1, 2) SELECT *, CASE WHEN sources >= 2 THEN 'POSSIBLE_INCIDENT' ELSE 'OBSERVED_PATTERN' END AS status FROM g WHERE reviews >= 2")
def indicator_correlate(spark, d):
    return S.correlate(S.indicators(R.eligible(reviews(spark, d))))


@query(rf"SELECT doc_id AS review_id, sha256(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[EMAIL]', 'g'), '(^|{X.EDGE})(\+?[0-9][0-9 .()-]{{7,}}[0-9])($|{X.EDGE})', '\1[PHONE]\3', 'g')) AS redacted_sha256 FROM documents")
def pii_redact(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.sha2(T.redact_apart(F.col("text")), 256).alias("redacted_sha256"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS url FROM pages")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(h, '{a}') OR h = '{a.rstrip('.') if a.endswith('.') else a}' THEN '{b}'" for a, b in X.SOURCE_LABELS) + r" ELSE h END AS label FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS h FROM pages)")
def source_label(spark, d):
    return table(spark, d, "pages").select("page_id", T.source_label(F.col("url")).alias("label"))


_DUP = WITH + f""", k AS (SELECT project_id, review_id, source, {_KEY} AS k FROM eligible2 WHERE length({_KEY}) >= 24),
f AS (SELECT *, min(review_id) OVER (PARTITION BY project_id, k) AS anchor_id FROM k), dup AS (SELECT project_id, anchor_id, review_id, 'NORMALIZED_CONTENT_SHA256' AS method FROM f WHERE review_id > anchor_id)"""
# a duplicate's flag keeps it out of links and source statistics; someone has taken the flag from even ids
_RESTORED = ", eligible2 AS (SELECT * FROM alive WHERE NOT is_spam AND NOT (is_duplicate AND review_id % 2 = 1)), k AS"
_DUP = _DUP.replace(", k AS", _RESTORED, 1)


def restored(df: DataFrame) -> DataFrame:
    """Eligible rows where flags of duplicates with even ids have been taken off by hand."""
    return R.eligible(df.withColumn("is_duplicate", F.col("is_duplicate") & (F.col("review_id") % 2 == 1)))


def dups(spark, d):
    return S.duplicate_links(restored(B.keys(spark, d)))


@query(_DUP + " SELECT * FROM dup")
def dup_links(spark, d):
    return dups(spark, d)


@query(_DUP + " SELECT l.anchor_id, l.review_id, a.source AS left_source, b.source AS right_source FROM dup l JOIN eligible2 a ON a.review_id = l.anchor_id JOIN eligible2 b ON b.review_id = l.review_id WHERE a.source <> b.source")
def dup_links_eligible_selfjoin(spark, d):
    r = restored(B.keys(spark, d)).select("review_id", "source")
    a, b = r.select(F.col("review_id").alias("anchor_id"), F.col("source").alias("left_source")), r.withColumnRenamed("source", "right_source")
    return dups(spark, d).join(a, "anchor_id").join(b, "review_id").where("left_source <> right_source").select("anchor_id", "review_id", "left_source", "right_source")


@query(_DUP.replace("WITH r0", "WITH RECURSIVE r0", 1) + """, e AS (SELECT anchor_id AS u, review_id AS v FROM dup UNION SELECT review_id, anchor_id FROM dup),
reach AS (SELECT u AS node, u AS r FROM e UNION SELECT e.u, reach.r FROM e JOIN reach ON reach.node = e.v) SELECT node, min(r) AS component FROM reach GROUP BY 1""")
def dup_components(spark, d):
    return S.components(dups(spark, d), "anchor_id", "review_id")


_HIST = "string_agg(category || '=' || n, ',' ORDER BY category)"


@query(
    _DUP + ", " + _cats(False) + ", " + _SEC.split(WITH + ", ", 1)[1]
    + f""", st AS (SELECT s.source, count(*) AS records, count(*) FILTER (x.review_id IS NULL) AS canonical, count(*) FILTER (x.review_id IS NOT NULL) AS duplicates, min(review_date) AS first_date, max(review_date) AS last_date, count(review_date) AS dated, {_COUNTS}
 FROM (SELECT * FROM scored WHERE review_id IN (SELECT review_id FROM eligible2)) s LEFT JOIN (SELECT DISTINCT review_id FROM dup) x USING (review_id) GROUP BY 1), hs AS (SELECT source, {_HIST} AS categories FROM (SELECT source, category, count(*) AS n FROM cats WHERE category <> 'OTHER' GROUP BY 1, 2) GROUP BY 1),
fs AS (SELECT source, count(*) AS findings FROM sec GROUP BY 1), names AS (SELECT DISTINCT source FROM reviews UNION SELECT 'a source without reviews')
SELECT names.source, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('records', 'canonical', 'duplicates', 'dated', 'positive', 'negative', 'neutral', 'findings'))}, first_date, last_date, coalesce(categories, '') AS categories
 FROM names LEFT JOIN st USING (source) LEFT JOIN hs USING (source) LEFT JOIN fs USING (source)"""
)
def source_statistics(spark, d):
    names = B.keys(spark, d).select("source").unionByName(spark.createDataFrame([("a source without reviews",)], "source string")).distinct()
    links = dups(spark, d)
    return S.source_statistics(restored(scored(spark, d)).drop("text"), links, S.components(links, "anchor_id", "review_id"), names, cats(spark, d, False), findings(spark, d))


@query(WITH + " SELECT project_id, source, lang, count(*) AS n, count(review_date) AS dated, min(review_date) AS first_date, max(review_date) AS last_date FROM eligible GROUP BY 1, 2, 3")
def source_provenance(spark, d):
    return R.eligible(reviews(spark, d)).groupBy("project_id", "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("review_date").alias("dated"), F.min("review_date").alias("first_date"), F.max("review_date").alias("last_date"))


_THEMES = _LINKS + ", " + _cats(False) + """, es AS (SELECT s.* FROM scored s WHERE NOT is_spam AND NOT is_duplicate),
themes0 AS (SELECT category AS theme, review_id, source, review_date FROM cats WHERE category <> 'OTHER' UNION ALL SELECT 'NEGATIVE_SENTIMENT', review_id, source, review_date FROM es WHERE label = 'negative' UNION ALL SELECT 'ASPECT:' || aspect, review_id, source, review_date FROM links)"""


def _emerge(volume: bool, least: float = 1.5) -> str:
    more = " UNION ALL SELECT 'REVIEW_VOLUME', review_id, source, review_date FROM es" if volume else ""
    return _THEMES + f""", themes AS (SELECT * FROM themes0{more}),
win AS (SELECT *, CASE WHEN review_date BETWEEN DATE '{TODAY}' - 6 AND DATE '{TODAY}' THEN 'current' WHEN review_date BETWEEN DATE '{TODAY}' - 13 AND DATE '{TODAY}' - 7 THEN 'baseline' END AS win FROM themes),
em AS (SELECT theme, count(*) FILTER (win = 'current') AS current_count, count(*) FILTER (win = 'baseline') AS baseline_count, count(DISTINCT CASE WHEN win = 'current' THEN source END) AS sources FROM win WHERE win IS NOT NULL GROUP BY 1),
er AS (SELECT *, CASE WHEN baseline_count > 0 THEN round_even((current_count / 7) / (baseline_count / 7), 3) END AS rate_ratio FROM em
 WHERE current_count >= 3 AND (baseline_count = 0 OR (current_count / 7) / (baseline_count / 7) >= {least}))"""


def tagged(spark, d, volume: bool = False):
    rows = R.eligible(scored(spark, d)).drop("text")
    return S.windows(S.themes(rows, cats(spark, d, False), links(spark, d), volume), TODAY)


@query(_emerge(False) + " SELECT * FROM er")
def emerging_themes(spark, d):
    return S.emerging(tagged(spark, d), "theme", 7, 7)


@query(_emerge(True) + " SELECT * FROM er")
def anomalies(spark, d):
    return S.emerging(tagged(spark, d, True), "theme", 7, 7)


@query(_emerge(False) + " SELECT theme, rank, review_id FROM (SELECT theme, review_id, row_number() OVER (PARTITION BY theme ORDER BY review_date DESC, review_id) AS rank FROM win WHERE win = 'current') WHERE rank <= 100")
def theme_evidence(spark, d):
    return S.evidence(tagged(spark, d), "theme")


@query(
    _emerge(False)
    + rf""", b AS (SELECT theme, current_count AS new, baseline_count AS old FROM em WHERE theme NOT LIKE 'ASPECT:%' AND current_count >= 3), rose AS (SELECT * FROM b WHERE old > 0 AND (new / 7) / (old / 7) >= 1.5),
ev AS (SELECT theme, rank, review_id FROM (SELECT theme, review_id, row_number() OVER (PARTITION BY theme ORDER BY review_date DESC, review_id) AS rank FROM win WHERE win = 'current' AND theme IN (SELECT theme FROM rose)) WHERE rank <= 100),
vs AS (SELECT review_id, unnest(regexp_extract_all(text, '(?i)\b{X.VERSION}\b', 1)) AS version, unnest(range(len(regexp_extract_all(text, '(?i)\b{X.VERSION}\b', 1)))) AS k FROM eligible),
told AS (SELECT theme, version, count(*) AS reports, min(rank * 1000 + k) AS place, count(DISTINCT review_id) AS n FROM ev JOIN vs USING (review_id) GROUP BY 1, 2 HAVING count(*) >= 2),
f AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY theme ORDER BY place) = 1)
SELECT theme AS category, 'FACT' AS type, new || ' eligible dated reviews matched the ' || theme || ' phrase rules in the comparison period.' AS claim, least(new, 100) AS evidence_count FROM b
UNION ALL SELECT theme, 'OBSERVATION', theme || ' mentions increased from ' || old || ' in the baseline window to ' || new || ' in the comparison window.', least(new, 100) FROM rose
UNION ALL SELECT theme, 'CORRELATION', 'The ' || theme || ' increase overlaps with ' || reports || ' reports mentioning version ' || version || '.', n FROM f
UNION ALL SELECT theme, 'HYPOTHESIS', 'Version ' || version || ' may be associated with the increase in ' || theme || ' reports.', n FROM f
UNION ALL SELECT theme, 'RECOMMENDATION', 'Compare telemetry and release history of version ' || version || ' with the ' || theme || ' evidence.', n FROM f"""
)
def root_cause_claims(spark, d):
    texts = R.eligible(reviews(spark, d)).select("review_id", "text")
    return S.root_causes(tagged(spark, d), texts, 7, 7)


@query(WITH + f", g AS (SELECT project_id, count(*) AS total, {_COUNTS}, round_even(avg(rating), 2) AS avg_rating, count(review_date) AS dated FROM scored GROUP BY 1) SELECT *, {_pcts()} FROM g")
def project_comparison(spark, d):
    got = scored(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), *R.label_counts(), F.bround(F.avg("rating"), 2).alias("avg_rating"), F.count("review_date").alias("dated"))
    return R.with_percentages(got)


_PAIRS = f"WITH pairs AS (SELECT l.toxic AS truth, CASE WHEN round_even({_score('d.text')}, 4) < 0 THEN 1 ELSE 0 END AS predicted FROM documents d JOIN labels l USING (doc_id)), grid AS (SELECT a.x AS truth, b.x AS predicted FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(x)), cm AS (SELECT g.truth, g.predicted, count(p.truth) AS n FROM grid g LEFT JOIN pairs p USING (truth, predicted) GROUP BY 1, 2)"


def pairs(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return R.sentiment(docs.select("text", F.col("toxic").alias("truth")), B.LEXICON).select("truth", F.when(F.col("compound") < 0, 1).otherwise(0).alias("predicted"))


@query(_PAIRS + " SELECT * FROM cm")
def confusion_matrix(spark, d):
    return S.confusion(pairs(spark, d), [0, 1])


@query(_PAIRS + """, a AS (SELECT truth AS class, sum(n) AS support, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1), b AS (SELECT predicted AS class, sum(n) AS said FROM cm GROUP BY 1),
m AS (SELECT class, CAST(support AS BIGINT) AS support, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM a JOIN b USING (class))
SELECT class, support, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM m""")
def prf_metrics(spark, d):
    return S.class_metrics(pairs(spark, d), [0, 1])


_METRICS = _STATS + f""", sw AS (SELECT * FROM scored WHERE review_date >= DATE '{TODAY}' - 30), sg AS (SELECT project_id, count(*) AS total, {_COUNTS} FROM sw GROUP BY 1),
m AS (SELECT project_id, 'review_volume' AS metric, CAST(total AS DOUBLE) AS value FROM sg UNION ALL SELECT project_id, 'negative_review_count', CAST(negative AS DOUBLE) FROM sg
 UNION ALL SELECT project_id, 'negative_sentiment_percentage', round_even(negative / total * 100, 2) FROM sg UNION ALL SELECT project_id, 'average_rating', round_even(avg(rating), 2) FROM sw GROUP BY 1
 UNION ALL SELECT project_id, 'keyword_frequency', CAST(count(*) FILTER (NOT is_spam AND list_contains(list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: lower(w)), 'screen')) AS DOUBLE) FROM sw GROUP BY 1
 UNION ALL SELECT project_id, 'aspect_negativity_percentage', negative_pct FROM stats WHERE aspect = 'price'
 UNION ALL SELECT project_id, 'recommendation_priority', CAST(count(*) AS DOUBLE) FROM stats WHERE frequency >= 3 AND negative_pct >= 75 GROUP BY 1)"""
_RULES = [("many", "review_volume", ">=", 60.0), ("angry", "negative_review_count", ">", 8.0), ("share", "negative_sentiment_percentage", ">=", 10.0), ("poor", "average_rating", "<", 2.5), ("screen", "keyword_frequency", ">=", 3.0), ("price", "aspect_negativity_percentage", ">", 60.0), ("act", "recommendation_priority", ">=", 1.0)]


def metrics(spark, d):
    """The seven metrics of each project, reviews of the last 30 days (31 dates); aspects over all time."""
    rows = S.alert_window(scored(spark, d), TODAY, 30)
    named = F.array_contains(T.keyword_tokens(F.col("text")), "screen") & ~F.col("is_spam")
    by = rows.groupBy("project_id").agg(
        F.count(F.lit(1)).cast("double").alias("review_volume"), F.count_if(F.col("label") == "negative").cast("double").alias("negative_review_count"), T.percentage(F.count_if(F.col("label") == "negative"), F.count(F.lit(1))).alias("negative_sentiment_percentage"),
        F.bround(F.avg("rating"), 2).alias("average_rating"), F.count_if(named).cast("double").alias("keyword_frequency"),
    )
    found = stats(spark, d)
    price = found.where("aspect = 'price'").select("project_id", F.lit("aspect_negativity_percentage").alias("metric"), F.col("negative_pct").alias("value"))
    urgent = found.where("frequency >= 3 AND negative_pct >= 75").groupBy("project_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("project_id", F.lit("recommendation_priority").alias("metric"), "value")
    return by.unpivot("project_id", [c for c in by.columns if c != "project_id"], "metric", "value").unionByName(price).unionByName(urgent)


def rules(spark):
    return spark.createDataFrame(_RULES, "rule string, metric string, operator string, threshold double")


_EVALUATED = _METRICS + ", rules(rule, metric, op, threshold) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', CAST({t} AS DOUBLE))" for a, b, c, t in _RULES) + """),
ev AS (SELECT rule, project_id, m.metric AS metric, value, threshold, coalesce(CASE op WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold ELSE value < threshold END, false) AS triggered FROM rules JOIN m ON rules.metric = m.metric)"""


@query(_METRICS + " SELECT * FROM m")
def alert_metrics(spark, d):
    return metrics(spark, d)


@query(_EVALUATED + " SELECT * FROM ev")
def alert_evaluate(spark, d):
    return S.evaluate_alerts(metrics(spark, d), rules(spark))


@query(_EVALUATED + ", old AS (SELECT rule, project_id, project_id % 2 = 0 AS was FROM ev WHERE project_id < 3), x AS (SELECT ev.*, coalesce(was, false) AS was FROM ev LEFT JOIN old USING (rule, project_id)) SELECT rule, project_id, CASE WHEN triggered AND NOT was THEN 'raised' WHEN triggered THEN 'open' ELSE 'cleared' END AS event FROM x WHERE triggered OR was")
def alert_edges(spark, d):
    now = S.evaluate_alerts(metrics(spark, d), rules(spark))
    old = now.where("project_id < 3").withColumn("triggered", F.col("project_id") % 2 == 0)
    return S.alert_edges(old, now)


@query(WITH + f", g AS (SELECT project_id, count(*) AS total, {_COUNTS}, {_CONF} FROM scored GROUP BY 1), p AS (SELECT *, {_pcts()} FROM g) SELECT project_id, 'Of ' || total || ' analysed reviews, ' || positive_pct || '% are positive, ' || negative_pct || '% negative and ' || neutral_pct || '% neutral.' AS sentence FROM p")
def summary_text(spark, d):
    s = R.summary(scored(spark, d))
    return s.select("project_id", F.concat(F.lit("Of "), F.col("total").cast("string"), F.lit(" analysed reviews, "), F.col("positive_pct").cast("string"), F.lit("% are positive, "), F.col("negative_pct").cast("string"), F.lit("% negative and "), F.col("neutral_pct").cast("string"), F.lit("% neutral.")).alias("sentence"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_event_per_entity(spark, d):
    return S.latest(table(spark, d, "events").withColumn("at", F.struct("ts", "event_id")), "user_id", "at", ["event_type", "event_id"])


@query(WITH + """, new AS (SELECT review_id, label FROM scored WHERE review_id % 5 = 0), corr AS (SELECT review_id, 'neutral' AS label FROM scored WHERE review_id % 3 = 0 AND review_id % 5 <> 0), old AS (SELECT review_id, 'positive' AS label FROM scored WHERE review_id % 2 = 0)
, x AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE review_id NOT IN (SELECT review_id FROM new)) SELECT x.review_id, coalesce(c.label, x.label) AS label FROM x LEFT JOIN corr c USING (review_id)""")
def sentiment_upsert(spark, d):
    s = scored(spark, d).select("review_id", "label")
    merged = R.overlay(s.where("review_id % 2 = 0").withColumn("label", F.lit("positive")), s.where("review_id % 5 = 0"), ["review_id"])
    corrected = s.where("review_id % 3 = 0 AND review_id % 5 <> 0").select("review_id", F.lit("neutral").alias("corrected"))
    return merged.join(corrected, "review_id", "left").select("review_id", F.coalesce("corrected", "label").alias("label"))


_CLEANED = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_HEADS = ", ".join(f"list_transform(regexp_extract_all(html, '(?is)<{h}\\b[^>]*>(.*?)</{h}>', 1), lambda x: {_CLEANED.format('x')})" for h in ("h1", "h2"))
_BODY = r"regexp_replace(regexp_replace(html, '(?is)^.*?<body\b[^>]*>|</body>.*$', '', 'g'), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>', ' ', 'g')"


@query(rf"""WITH p AS (SELECT page_id, html, list_filter(list_concat({_HEADS}), lambda x: x <> '') AS heads, regexp_extract(html, '(?is)<meta\s[^>]*name=["'']description["''][^>]*>', 0) AS meta,
 regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, {_BODY} AS body FROM pages)
SELECT page_id, left({_CLEANED.format('t')}, 400) AS title, left({_CLEANED.format(r"""regexp_extract(meta, '(?is)content=["'']([^"'']*)', 1)""")}, 600) AS description,
 array_to_string(list_filter(heads, lambda x, i: list_position(heads, x) = i)[1:8], ' | ') AS headings, left({_CLEANED.format('body')}, 1800) AS excerpt, sha256(html) AS content_hash FROM p""")
def website_context(spark, d):
    return I.website_context(table(spark, d, "pages"))


@query(WITH + ", t AS (SELECT review_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z]{3,}'), lambda w: lower(w)))) AS term FROM eligible), n AS (SELECT count(*) AS n FROM eligible) SELECT term, count(*) AS df, CAST(round(1000 * (ln((1 + n.n) / (1 + count(*))) + 1)) AS BIGINT) AS idf_milli FROM t, n GROUP BY term, n.n")
def topic_tfidf_terms(spark, d):
    return M.document_frequencies(R.eligible(reviews(spark, d)))


@query()
def topic_kmeans(spark, d):
    return M.topics(R.eligible(reviews(spark, d)), 6)


@query("SELECT c_mktsegment AS segment, count(*) AS orders, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, CAST(round_even(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS BIGINT) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment)")
def segment_rollup(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"), F.bround(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 0).cast("long").alias("revenue"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def event_volume_daily(spark, d):
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
