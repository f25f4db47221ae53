"""Further queries over the canonical relations: evidence spans, orders, filters, ingestion
reports, collected records and composites; each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import rules as X
from opinara.functions import text as T
from opinara.operators import collect as C
from opinara.operators import ingest as I
from opinara.operators import reports as P
from opinara.operators import reviews as R
from opinara.operators import signals as S
from opinara.operators import topics as M
from opinara.plans import bindings as B
from opinara.plans import queries as Q
from opinara.plans.bindings import reviews, table
from opinara.plans.queries import ORACLES, QUERIES, TODAY, WITH, lit, query  # noqa: F401

# -- evidence ---------------------------------------------------------------


def _sql_spans(rows: str, rx: str) -> str:
    """SQL of all matches of ``rx``: what lies between the matches gives their places."""
    return f"""SELECT review_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'evidence': m[i]}})) AS x
 FROM (SELECT review_id, regexp_extract_all(text, {rx}) AS m, string_split_regex(text, {rx}) AS g FROM {rows} WHERE regexp_matches(text, {rx}))"""


_EVIDENCE = {k: v for k, v in X.CATEGORIES.items() if k != "QUESTION"}


@query(
    WITH
    + " SELECT review_id, category, CAST(x.start AS INT) AS start, CAST(x.start + length(x.evidence) AS INT) AS \"end\", x.evidence AS evidence FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS category, * FROM ({_sql_spans('eligible', lit(rf'(?i)\b(?:{rx})\b'))})" for c, rx in _EVIDENCE.items())
    + ")"
)
def category_evidence(spark, d):
    return S.category_evidence(R.eligible(reviews(spark, d)).select("review_id", "text"), _EVIDENCE)


@query(
    WITH
    + rf""", s AS ({_sql_spans("eligible", lit(T.SENTENCE))}), t AS (SELECT review_id, x.start + length(x.evidence) - length(ltrim(x.evidence, E' \t\n\r\f\x0b')) AS a, trim(x.evidence, E' \t\n\r\f\x0b') AS text FROM s)
SELECT review_id, CAST(a AS INT) AS start, CAST(a + length(text) AS INT) AS "end", text FROM t WHERE length(text) > 0"""
)
def sentence_evidence(spark, d):
    rows = R.eligible(reviews(spark, d))
    return rows.select("review_id", F.explode(T.sentence_spans(F.col("text"))).alias("x")).select("review_id", "x.*")


@query(WITH + r", t AS (SELECT review_id, label, unnest(regexp_extract_all(text, '\S+')) AS token FROM scored), l AS (SELECT *, regexp_replace(regexp_replace(lower(token), '^[!-/:-@\[-`{-~]+', ''), '[!-/:-@\[-`{-~]+$', '') AS lowered FROM t) SELECT review_id, lowered, CAST(" + Q._LEX.replace("lower(w)", "lowered") + " AS DOUBLE) AS valence, count(*) AS n FROM l WHERE lowered <> '' GROUP BY 1, 2, 3 HAVING valence <> 0")
def token_valences(spark, d):
    rows = Q.alive(spark, d).select("review_id", "text")
    got = R.token_valences(rows, B.LEXICON, ["review_id"]).where("matched")
    return got.groupBy("review_id", "lowered", "valence").agg(F.count(F.lit(1)).alias("n"))


_TOKENS = WITH + r""", t AS (SELECT review_id, label, unnest(regexp_extract_all(text, '\S+')) AS token, unnest(range(len(regexp_extract_all(text, '\S+')))) AS place FROM scored),
l AS (SELECT *, regexp_replace(regexp_replace(lower(token), '^[!-/:-@\[-`{-~]+', ''), '[!-/:-@\[-`{-~]+$', '') AS lowered FROM t), v AS (SELECT *, CAST(""" + Q._LEX.replace("lower(w)", "lowered") + """ AS DOUBLE) AS valence FROM l)"""


@query(_TOKENS + " SELECT review_id, rank, token, valence FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY abs(valence) DESC, place) AS rank FROM v WHERE (label = 'negative' AND valence < 0) OR (label = 'positive' AND valence > 0)) WHERE rank <= 8")
def contributing_terms(spark, d):
    rows = Q.scored(spark, d)
    tokens = R.token_valences(rows.select("review_id", "text"), B.LEXICON, ["review_id"])
    return R.contributing(tokens, rows.drop("text"))


# -- orders -----------------------------------------------------------------


@query(Q._STATS + " SELECT project_id, aspect, frequency, row_number() OVER (PARTITION BY project_id ORDER BY frequency DESC, aspect) AS rank FROM stats")
def aspects_by_frequency(spark, d):
    return R.ordered(Q.stats(spark, d), [F.desc("frequency"), "aspect"], by=["project_id"]).select("project_id", "aspect", "frequency", "rank")


@query(Q._STATS + ", r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY negative_pct DESC, frequency DESC, aspect) AS rank FROM stats WHERE frequency > 0) SELECT project_id, aspect, negative_pct, rank FROM r WHERE rank <= 3")
def top_negative_aspects(spark, d):
    some = Q.stats(spark, d).where("frequency > 0")
    return R.ordered(some, [F.desc("negative_pct"), F.desc("frequency"), "aspect"], 3, ["project_id"]).select("project_id", "aspect", "negative_pct", "rank")


@query(WITH + " SELECT review_id, label, row_number() OVER (ORDER BY review_date DESC NULLS LAST, review_id) AS rank FROM scored ORDER BY review_date DESC NULLS LAST, review_id LIMIT 500")
def results_newest(spark, d):
    order = [F.col("review_date").desc_nulls_last(), "review_id"]
    return R.ordered(Q.scored(spark, d).select("review_id", "label", "review_date"), order, 500).select("review_id", "label", "rank")


@query(Q._COMP + " SELECT review_id, competitor, switching, row_number() OVER (ORDER BY switching DESC, lower(competitor), review_id) AS rank FROM comp ORDER BY switching DESC, lower(competitor), review_id LIMIT 500")
def competitors_ordered(spark, d):
    got = S.competitors(R.eligible(reviews(spark, d)), B.COMPETITORS)
    return R.ordered(got, [F.desc("switching"), F.lower("competitor"), "review_id"], 500).select("review_id", "competitor", "switching", "rank")


@query(Q._IND + ", g AS (SELECT kind, value, count(DISTINCT review_id) AS reviews FROM ind GROUP BY 1, 2 HAVING count(DISTINCT review_id) >= 2) SELECT *, row_number() OVER (ORDER BY reviews DESC, kind, value) AS rank FROM g ORDER BY rank LIMIT 200")
def correlations_ordered(spark, d):
    got = S.correlate(S.indicators(R.eligible(reviews(spark, d)))).select("kind", "value", "reviews")
    return R.ordered(got, [F.desc("reviews"), "kind", "value"], 200)


@query(Q._DUP + " SELECT anchor_id, review_id FROM dup ORDER BY review_id DESC, anchor_id LIMIT 1000")
def dup_links_newest(spark, d):
    return Q.dups(spark, d).orderBy(F.desc("review_id"), "anchor_id").limit(1000).select("anchor_id", "review_id")


# -- filters and joins ------------------------------------------------------


@query(Q._LINKS + " SELECT review_id, aspect, label FROM links JOIN (SELECT review_id, dataset_id FROM reviews) r USING (review_id) WHERE review_date BETWEEN DATE '2024-02-01' AND DATE '2024-04-30' AND dataset_id = 1")
def aspect_filters(spark, d):
    owned = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), (F.col("doc_id") % 3).alias("dataset_id"))
    got = R.filtered(Q.links(spark, d), "2024-02-01", "2024-04-30").join(owned, "review_id")
    return R.filtered(got, dataset=1).select("review_id", "aspect", "label")


@query(WITH + " SELECT review_id FROM alive WHERE contains(text, 'Globex') AND rating = 4.5")
def review_search_literal(spark, d):
    return R.filtered(Q.alive(spark, d).where(F.col("text").contains("Globex")), rating=4.5).select("review_id")


@query(WITH + f", k AS (SELECT review_id, list_filter(['screen', 'battery', 'price'], lambda t: regexp_matches(text, '(?i)(?:^|{X.EDGE})' || t || '(?:$|{X.EDGE})')) AS i, list_filter(['scam', 'malware'], lambda t: regexp_matches(text, '(?i)(?:^|{X.EDGE})' || t || '(?:$|{X.EDGE})')) AS e, list_filter(['Acme', 'Globex', 'Initech'], lambda t: regexp_matches(text, '(?i)(?:^|{X.EDGE})' || t || '(?:$|{X.EDGE})')) AS c FROM alive) SELECT review_id, len(e) = 0 AND len(i) > 0 AS kept, array_to_string(i, ',') AS included, array_to_string(e, ',') AS excluded, array_to_string(c, ',') AS competitor FROM k WHERE len(i) + len(e) + len(c) > 0")
def keyword_policy(spark, d):
    policy = R.keyword_policy(F.col("text"), ["screen", "battery", "price"], ["scam", "malware"], {"competitor": B.COMPETITORS})
    got = Q.alive(spark, d).select("review_id", R.once(policy).alias("p")).select("review_id", "p.*")
    joined = got.select("review_id", "kept", *[F.array_join(c, ",").alias(c) for c in ("included", "excluded", "competitor")])
    return joined.where("included <> '' OR excluded <> '' OR competitor <> ''")


@query(Q._SEC + ", f AS (SELECT *, CASE review_id % 4 WHEN 0 THEN 'stale' WHEN 1 THEN 'dismissed' ELSE 'open' END AS status FROM sec) SELECT f.review_id, finding_type, severity, review_date FROM f JOIN alive USING (review_id) WHERE status NOT IN ('stale', 'dismissed')")
def open_findings(spark, d):
    status = F.when(F.col("review_id") % 4 == 0, "stale").when(F.col("review_id") % 4 == 1, "dismissed").otherwise("open")
    found = Q.findings(spark, d).withColumn("status", status).where(~F.col("status").isin("stale", "dismissed"))
    return found.join(Q.alive(spark, d).select("review_id", "review_date"), "review_id").select("review_id", "finding_type", "severity", "review_date")


@query(Q._SEC + ", n AS (SELECT review_id, count(*) AS n FROM sec GROUP BY 1) SELECT review_id, coalesce(n, 0) AS findings FROM alive LEFT JOIN n USING (review_id)")
def findings_per_review(spark, d):
    n = Q.findings(spark, d).groupBy("review_id").agg(F.count(F.lit(1)).alias("findings"))
    return Q.alive(spark, d).select("review_id").join(n, "review_id", "left").fillna(0, ["findings"])


@query(Q._DUP + " SELECT DISTINCT review_id FROM (SELECT anchor_id AS review_id FROM dup UNION ALL SELECT review_id FROM dup)")
def dup_endpoints(spark, d):
    links = Q.dups(spark, d)
    ends = links.select(F.explode(F.array("anchor_id", "review_id")).alias("review_id")).distinct()
    return Q.alive(spark, d).select("review_id").join(ends, "review_id", "left_semi")


@query(Q._DUP + ", old AS (SELECT review_id AS a, anchor_id AS b FROM dup WHERE review_id % 2 = 0) SELECT anchor_id, review_id FROM dup WHERE NOT EXISTS (SELECT 1 FROM old WHERE (a = anchor_id AND b = review_id) OR (a = review_id AND b = anchor_id))")
def dup_links_insert(spark, d):
    links = Q.dups(spark, d).select("anchor_id", "review_id")
    old = links.where("review_id % 2 = 0").select(F.col("review_id").alias("anchor_id"), F.col("anchor_id").alias("review_id"))
    return R.insert_missing(old, links, "anchor_id", "review_id")


@query(Q._DUP + """, url AS (SELECT project_id, review_id, review_id // 40 AS u FROM eligible2 WHERE review_id % 10 < 5), byurl AS (SELECT project_id, min(review_id) OVER (PARTITION BY project_id, u) AS anchor_id, review_id, 0 AS r, 'CANONICAL_URL' AS method FROM url),
x AS (SELECT * FROM byurl WHERE review_id > anchor_id UNION ALL SELECT project_id, anchor_id, review_id, 1, method FROM dup) SELECT project_id, anchor_id, review_id, method FROM x QUALIFY row_number() OVER (PARTITION BY project_id, anchor_id, review_id ORDER BY r) = 1""")
def dup_links_by_url(spark, d):
    url = F.when(F.col("review_id") % 10 < 5, F.concat(F.lit("https://Shop.Example/p/"), F.floor(F.col("review_id") / 40), F.lit("?x=1")))
    rows = Q.restored(B.keys(spark, d)).withColumn("url_key", T.canonical_url(url))
    return S.duplicate_links(rows)


@query(Q._RAW + ", seen AS (SELECT DISTINCT lower(clean) AS k FROM classified WHERE row_no % 2 = 0 AND reason IS NULL) SELECT row_no FROM classified WHERE reason IS NULL AND row_no % 2 = 1 AND (lower(clean) IN (SELECT k FROM seen) OR row_no > (SELECT min(c.row_no) FROM classified c WHERE c.reason IS NULL AND c.row_no % 2 = 1 AND lower(c.clean) = lower(classified.clean)))")
def ingest_against_existing(spark, d):
    rows = Q.raw(spark, d)
    old = I.classify(rows.where("row_no % 2 = 0")).where("reason IS NULL").select(F.sha2(F.lower("clean"), 256).alias("content_key"))
    return I.classify(rows.where("row_no % 2 = 1"), old).where("is_duplicate").select("row_no")


# -- aggregates -------------------------------------------------------------


@query(WITH + ", g AS (SELECT project_id, dataset_id, source, count(*) AS n, count(review_date) AS dated, min(review_date) AS first_date, max(review_date) AS last_date FROM eligible GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, source, dataset_id) AS rank, count(*) OVER (PARTITION BY project_id) > 5 AS truncated FROM g) SELECT * FROM r WHERE rank <= 5")
def provenance_top(spark, d):
    return P.provenance(R.eligible(reviews(spark, d)), 5)


@query(WITH + " SELECT project_id, min(review_date) AS date_from, max(review_date) AS date_to FROM alive GROUP BY 1")
def date_span(spark, d):
    return R.date_span(Q.alive(spark, d), today=TODAY)


@query(Q._PAIRS + """, a AS (SELECT truth AS class, sum(n) AS support, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1), b AS (SELECT predicted AS class, sum(n) AS said FROM cm GROUP BY 1),
m AS (SELECT class, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM a JOIN b USING (class)), f AS (SELECT round_even(p, 4) AS p, round_even(r, 4) AS r, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM m)
SELECT CAST((SELECT sum(n) FROM cm) AS BIGINT) AS total, round_even((SELECT sum(n) FILTER (truth = predicted) / sum(n) FROM cm), 4) AS accuracy, round_even(avg(p), 4) AS macro_precision, round_even(avg(r), 4) AS macro_recall, round_even(avg(f1), 4) AS macro_f1 FROM f""")
def accuracy(spark, d):
    return S.accuracy(Q.pairs(spark, d), [0, 1])


@query(Q._trend_sql("strftime(review_date, '%Y-%m')").replace("WHERE review_date IS NOT NULL GROUP BY 1, 2", "GROUP BY 1, 2") + " SELECT project_id, count(*) FILTER (review_date IS NULL) AS skipped_no_date, count(*) AS reviews FROM scored GROUP BY 1")
def trend_skipped(spark, d):
    return P.undated(Q.alive(spark, d))


@query("SELECT user_id AS workflow, CASE WHEN bool_or(event_type = 'error') AND bool_or(event_type = 'purchase') THEN 'partial' WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'click') THEN 'running' WHEN bool_and(event_type IN ('purchase', 'view')) THEN 'completed' ELSE 'pending' END AS status, count(*) AS steps FROM events GROUP BY 1")
def workflow_status(spark, d):
    kind = F.col("event_type")
    state = F.when(kind == "error", "failed").when(kind == "purchase", "completed").when(kind == "click", "running").when(kind == "view", "skipped").otherwise("pending")
    return S.overall_status(table(spark, d, "events").select(F.col("user_id").alias("workflow"), state.alias("status")), "workflow")


@query(Q._CATS + f", t AS (SELECT 'categories' AS tool, review_id, source FROM cats WHERE category <> 'OTHER' UNION ALL SELECT 'search', review_id, source FROM alive WHERE contains(text, 'Globex')) SELECT tool, count(*) AS rows, count(DISTINCT review_id) AS evidence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM t GROUP BY 1")
def evidence_rollup(spark, d):
    found = Q.cats(spark, d).where("category <> 'OTHER'").select("review_id", "source")
    search = Q.alive(spark, d).where(F.col("text").contains("Globex")).select("review_id", "source")
    return P.evidence_rollup({"categories": found, "search": search})


# -- ingestion reports ------------------------------------------------------

_T = "coalesce(clean, '')"
_SHARE = "length(regexp_replace({0}, '[^{1}]', '', 'g')) / greatest(1, length(regexp_replace({0}, '[^{2}]', '', 'g')))"
# SQL has no back references: a run of each character of the Latin blocks
_RUNS = "|".join(f"\\x{{{{{c:x}}}}}{{5,}}".replace("{{", "{").replace("}}", "}") for c in range(0x20, 0x250))
_FLAGS = f"""list_filter([CASE WHEN trim({_T}) = '' THEN 'empty_text' END, CASE WHEN trim({_T}) <> '' AND length(trim({_T})) < 10 THEN 'extremely_short_text' END, CASE WHEN {_SHARE.format('clean', r'\p{Lu}', r'\p{L}')} >= 0.5 THEN 'excessive_caps' END,
 CASE WHEN len(regexp_extract_all(clean, '(?i)https?://\\S+|www\\.\\S+')) >= 3 THEN 'url_heavy' END, CASE WHEN regexp_matches(clean, '{_RUNS}') THEN 'repeated_characters' END], lambda x: x IS NOT NULL)"""
_LANG = f"CASE WHEN trim(clean) = '' THEN 'empty' WHEN {_SHARE.format('clean', 'A-Za-z', r'\p{L}')} < 0.4 THEN 'non_english_or_unknown' ELSE 'english_likely' END"
_PROFILE = Q._RAW + f", ok AS (SELECT row_no, clean, stars, {_FLAGS} AS flags, {_LANG} AS language FROM classified WHERE reason IS NULL)"


@query(_PROFILE + ", k AS (SELECT 'flag' AS kind, unnest(flags) AS value FROM ok UNION ALL SELECT 'language', language FROM ok UNION ALL SELECT 'rating', coalesce(CASE WHEN stars = floor(stars) THEN CAST(CAST(stars AS INT) AS VARCHAR) ELSE CAST(round_even(stars, 2) AS VARCHAR) END, 'missing') FROM ok) SELECT kind, value, count(*) AS n FROM k GROUP BY 1, 2")
def profile_counts(spark, d):
    return I.flag_counts(I.classify(Q.raw(spark, d)))


@query(_PROFILE + ", fl AS (SELECT row_no, length(clean) AS chars, unnest(flags) AS flag FROM ok) SELECT flag, rank, row_no, chars FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY row_no) AS rank FROM fl) WHERE rank <= 3")
def profile_samples(spark, d):
    return I.flag_samples(I.classify(Q.raw(spark, d)))


@query(Q._RAW + " SELECT row_no, reason FROM classified WHERE reason IS NOT NULL ORDER BY row_no LIMIT 20")
def ingest_errors(spark, d):
    return I.error_samples(I.classify(Q.raw(spark, d)))


@query(WITH + ", m AS (SELECT review_id, rating, compound, CASE WHEN rating <= 2 AND compound >= 0.4 THEN 'strong_positive_text_low_rating' WHEN rating >= 4 AND compound <= -0.4 THEN 'strong_negative_text_high_rating' END AS type FROM scored), r AS (SELECT *, count(*) OVER (PARTITION BY type) AS total, row_number() OVER (PARTITION BY type ORDER BY review_id) AS rank FROM m WHERE type IS NOT NULL) SELECT type, rank, review_id, rating, compound, total FROM r WHERE rank <= 3")
def mismatch_samples(spark, d):
    return I.mismatch_samples(Q.scored(spark, d))


# -- composites -------------------------------------------------------------


@query()
def topic_sizes(spark, d):
    return M.topic_distribution(M.topics(R.eligible(reviews(spark, d)), 6), Q.scored(spark, d))


# -- collected records ------------------------------------------------------


@query("SELECT page_id, CASE WHEN contains(h, 'amazon.') THEN 'amazon' WHEN contains(h, 'flipkart.') THEN 'flipkart' WHEN contains(h, 'reddit.com') THEN 'reddit' WHEN contains(h, 'github.com') THEN 'github_issues' ELSE 'website' END AS source_type FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h FROM pages)")
def source_types(spark, d):
    return table(spark, d, "pages").select("page_id", C.source_type(F.col("url")).alias("source_type"))


