"""Queries on emphasis, nested payloads, pages, identity and stored state, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import rules as X
from opinara.functions import text as T
from opinara.operators import collect as C
from opinara.operators import ingest as I
from opinara.operators import ledger as L
from opinara.operators import nested as N
from opinara.operators import pages as H
from opinara.operators import reports as P
from opinara.operators import reviews as R
from opinara.operators import summaries as S
from opinara.operators import valence as V
from opinara.plans import bindings as B
from opinara.plans import more  # noqa: F401  (its queries are registered first)
from opinara.plans import queries as Q
from opinara.plans.bindings import reviews, table
from opinara.plans.queries import ORACLES, QUERIES, WITH, lit, query  # noqa: F401
from opinara.session import cut

# -- emphasis ---------------------------------------------------------------


def _in(words) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


def _case(value: str, table: dict) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in table.items()) + " END"


def _emphasis_sql() -> str:
    """The positional rules as windows over unnested tokens, one step after another."""
    punct = lit(V.PUNCTUATION)
    bare = f"trim(x, {punct})"
    said = "[" + ", ".join(map(lit, B.EMPHATIC)) + f"][1 + (review_id // 3) % {len(B.EMPHATIC)}]"
    sql = WITH + f""", e0 AS (SELECT review_id, CASE WHEN review_id % 3 = 0 THEN coalesce(text, '') || ' ' || {said} ELSE coalesce(text, '') END AS text FROM alive),
e1 AS (SELECT review_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: CASE WHEN length({bare}) > 2 THEN {bare} ELSE x END) AS ws FROM e0),
e2 AS (SELECT review_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM e1),
e3 AS (SELECT *, lower(w) AS low, upper(w) = w AND lower(w) <> w AS cap, {_case('lower(w)', B.LEXICON)} AS v FROM e2),
e4 AS (SELECT *, {', '.join(f'lag(low, {k}) OVER q AS l{k}, lag(v, {k}) OVER q AS v{k}, lag(cap, {k}) OVER q AS c{k}' for k in (1, 2, 3))}, lead(low, 1) OVER q AS f1, lead(low, 2) OVER q AS f2, lead(v, 1) OVER q AS vf,
  count(*) FILTER (cap) OVER (PARTITION BY review_id) AS loud, min(i) FILTER (low = 'but') OVER (PARTITION BY review_id) AS bi FROM e3 WINDOW q AS (PARTITION BY review_id ORDER BY i)),
x0 AS (SELECT *, loud > 0 AND loud < n AS mixed, CASE WHEN l1 = 'no' OR l2 = 'no' OR (l3 = 'no' AND l1 IN ('or', 'nor')) THEN v * {X.TURN} WHEN low = 'no' AND vf IS NOT NULL THEN 0 ELSE v END AS x
  FROM e4 WHERE v IS NOT NULL AND low NOT IN {_in(X.DEGREES)} AND NOT (low = 'kind' AND coalesce(f1, '') = 'of')),
y0 AS (SELECT * REPLACE (CASE WHEN cap AND mixed THEN CASE WHEN x > 0 THEN x + {X.CAPITALS} ELSE x - {X.CAPITALS} END ELSE x END AS x) FROM x0)"""
    for k in (1, 2, 3):
        free = f"i >= {k} AND v{k} IS NULL"
        degree = f"CASE WHEN l{k} IN {_in(X.DEGREES)} THEN ({_case(f'l{k}', X.DEGREES)} * CASE WHEN x < 0 THEN -1 ELSE 1 END + CASE WHEN c{k} AND mixed THEN CASE WHEN x > 0 THEN {X.CAPITALS} ELSE -{X.CAPITALS} END ELSE 0 END) * {X.FADING[k - 1]} ELSE 0 END"
        between = [f"l{b}" for b in range(1, k)]
        special = ""
        if between:
            any_of = lambda words: " OR ".join(f"coalesce({b}, '') IN {_in(words)}" for b in between)
            special = f"WHEN l{k} = 'never' AND ({any_of(['so', 'this'])}) THEN x * 1.25 WHEN l{k} = 'without' AND ({any_of(['doubt'])}) THEN x "
        sql += f", d{k} AS (SELECT * REPLACE (CASE WHEN {free} THEN x + {degree} ELSE x END AS x) FROM y{k - 1})"
        sql += f", y{k} AS (SELECT * REPLACE (CASE WHEN {free} THEN CASE {special}WHEN l{k} IN {_in(X.NEGATIONS)} OR contains(l{k}, 'n''t') THEN x * {X.TURN} ELSE x END ELSE x END AS x) FROM d{k})"
    one = lambda *parts: "concat_ws(' ', " + ", ".join(parts) + ")"
    idiom = lambda p: _case(p, X.IDIOMS)
    ahead = f"coalesce(CASE WHEN n - 1 > i + 1 THEN {idiom(one('low', 'f1', 'f2'))} END, CASE WHEN n - 1 > i THEN {idiom(one('low', 'f1'))} END)"
    behind = ", ".join(idiom(one(*p)) for p in (("l1", "low"), ("l2", "l1", "low"), ("l2", "l1"), ("l3", "l2", "l1"), ("l3", "l2")))
    pairs = {w: v for w, v in X.DEGREES.items() if " " in w}
    extra = " + ".join(f"coalesce({_case(one(*p), pairs)}, 0)" for p in (("l3", "l2"), ("l2", "l1")))
    sql += f""", z AS (SELECT * REPLACE (CASE WHEN i >= 3 AND v3 IS NULL THEN coalesce({ahead}, {behind}, x) + {extra} ELSE x END AS x) FROM y3),
l AS (SELECT review_id, n, i, (CASE WHEN i > 0 AND v1 IS NULL AND l1 = 'least' AND coalesce(l2, '') NOT IN ('at', 'very') THEN x * {X.TURN} ELSE x END) * CASE WHEN bi IS NULL THEN 1 WHEN i < bi THEN 0.5 WHEN i > bi THEN 1.5 ELSE 1 END AS x FROM z),
a AS (SELECT review_id, sum(x ORDER BY i) AS s, sum(CASE WHEN x > 0 THEN x + 1 ELSE 0 END ORDER BY i) AS p, sum(CASE WHEN x < 0 THEN 1 - x ELSE 0 END ORDER BY i) AS m, count(*) FILTER (x <> 0) AS k FROM l GROUP BY 1),
b AS (SELECT review_id, len(ws) AS n, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(m, 0) AS m, len(ws) - coalesce(k, 0) AS neu,
  least(length(text) - length(replace(text, '!', '')), 4) * {X.CALL} + CASE WHEN length(text) - length(replace(text, '?', '')) > 3 THEN {X.ASKS} WHEN length(text) - length(replace(text, '?', '')) > 1 THEN (length(text) - length(replace(text, '?', ''))) * {X.ASK} ELSE 0 END AS e
  FROM e1 JOIN e0 USING (review_id) LEFT JOIN a USING (review_id)),
c AS (SELECT review_id, s + sign(s) * e AS t, p + CASE WHEN p > m THEN e ELSE 0 END AS p, m + CASE WHEN m > p THEN e ELSE 0 END AS m, neu FROM b),
o AS (SELECT review_id, round_even(t / sqrt(t * t + {X.ALPHA}), 4) AS compound, coalesce(round_even(p / nullif(p + m + neu, 0), 3), 0.0) AS positive_score, coalesce(round_even(m / nullif(p + m + neu, 0), 3), 0.0) AS negative_score, coalesce(round_even(neu / nullif(p + m + neu, 0), 3), 0.0) AS neutral_score FROM c),
q AS (SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM o)
SELECT *, CASE label WHEN 'positive' THEN positive_score WHEN 'negative' THEN negative_score ELSE neutral_score END AS confidence FROM q"""
    return sql


@query(_emphasis_sql())
def heuristic_sentiment(spark, d):
    i = F.col("review_id")
    said = F.element_at(F.array(*[F.lit(x) for x in B.EMPHATIC]), (F.floor(i / 3) % len(B.EMPHATIC) + 1).cast("int"))
    rows = Q.alive(spark, d).select("review_id", F.when(i % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said)).otherwise(F.col("text")).alias("text"))
    lexicon = spark.createDataFrame(list(B.LEXICON.items()), "term string, valence double")
    return V.scored(rows, lexicon).drop("text")


# -- nested payloads --------------------------------------------------------


@query("SELECT conv_id, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, lower(left(t, 160)) FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) WHERE length(t) >= 3) GROUP BY 1")
def provider_records(spark, d):
    """Each turn of a conversation as a provider's nested payload."""
    item = F.struct(F.col("turn").cast("string").alias("review_id"), F.col("role").alias("author"), F.col("text").alias("review_text"))
    body = F.struct(F.col("conv_id").cast("string").alias("product_title"), F.struct(F.array(item).alias("items")).alias("data"))
    payloads = table(spark, d, "conversations").select("conv_id", F.to_json(body).alias("payload"))
    got = C.normalize(N.records(payloads, keep=["conv_id"]), by=["conv_id"])
    return got.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def _uuid(of: str) -> str:
    return f"regexp_replace(md5({of}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def tool_outputs(spark, d):
    """What a tool might return for each review: nested objects with ids in several spellings."""
    i = F.col("review_id")
    ident = lambda c: N.uuid_of(F.md5(c.cast("string").cast("binary")))
    items = F.array(F.struct(ident(i).alias("reviewId"), F.struct(F.col("source"), F.array(F.upper(ident(i + 1)), F.lit("none")).alias("evidenceIds")).alias("more")))
    entries = F.transform(F.sequence(F.lit(0), (i % 30).cast("int")), lambda k: F.struct(k.alias("k"), F.concat(F.lit("n"), k.cast("string")).alias("name")))
    body = F.struct(F.struct(items.alias("items"), F.when(i % 2 == 0, F.concat(F.lit("{"), ident(i + 2), F.lit("}"))).alias("evidenceId")).alias("result"), entries.alias("entries"), F.repeat(F.coalesce("source", F.lit("?")), 60).alias("label"), F.lit("https://e.example").alias("url"), F.lit("spoken").alias("Content"))
    return Q.alive(spark, d).select("review_id", F.to_json(body).alias("payload"))


@query(WITH + f" SELECT review_id, {_uuid('review_id::VARCHAR')} AS evidence_id FROM alive UNION SELECT review_id, {_uuid('(review_id + 1)::VARCHAR')} FROM alive UNION SELECT review_id, {_uuid('(review_id + 2)::VARCHAR')} FROM alive WHERE review_id % 2 = 0")
def evidence_ids(spark, d):
    return N.evidence_ids(tool_outputs(spark, d), keep=["review_id"])


_ENTRIES = "array_to_string(list_transform(range(0, least(12, review_id % 30 + 1)), lambda k: '{\"k\":' || k || ',\"name\":\"n' || k || '\"}'), ',')"


@query(
    WITH
    + f""" SELECT review_id, '{{"Content":"{N.SPOKEN}","entries":[' || {_ENTRIES} || '],"label":"' || left(repeat(coalesce(source, '?'), 60), 200) || '","result":{{' ||
 CASE WHEN review_id % 2 = 0 THEN '"evidenceId":"{{' || {_uuid('(review_id + 2)::VARCHAR')} || '}}",' ELSE '' END || '"items":[{{"more":{{"evidenceIds":["' || upper({_uuid('(review_id + 1)::VARCHAR')}) || '","none"]' ||
 CASE WHEN source IS NOT NULL THEN ',"source":"' || source || '"' ELSE '' END || '}},"reviewId":"' || {_uuid('review_id::VARCHAR')} || '"}}]}},"url":"{N.LEFT_OUT}"}}' AS compact FROM alive"""
)
def compact_outputs(spark, d):
    return N.compacted(tool_outputs(spark, d), "review_id")


# -- pages and identity -----------------------------------------------------


def _markup(spark_side: bool):
    """Review markup of a page, as a Spark column or SQL text: of item properties, of classes, or both."""
    item = ['<div itemprop="review"><i itemprop="author">A', "p", "-", "k", " </i><b itemprop=\"ratingValue\">", "r", ".5 of 5</b><u itemprop='datePublished'>2024-01-0", "j", '</u><p itemprop="reviewBody"> Body <b>', "p", "</b> no &amp; ", "k", "</p></div>"]
    named = ['<li class="x review"><span class="author">B', "p", '</span><div class="stars">Rated: ', "r", '</div><em class="date">day ', "k", "</em><script>no text</script><p>Class <i>text</i> ", "k", "</p><p>more</p></li>"]
    if not spark_side:
        values = {"p": "page_id", "k": "k", "r": "(page_id + k) % 7", "j": "(k + 1)"}
        join = lambda parts: "concat(" + ", ".join(values.get(x) or lit(x) for x in parts) + ")"
        each = lambda parts: f"array_to_string(list_transform(range(0, page_id % 4), lambda k: {join(parts)}), '')"
        return f"CASE page_id % 3 WHEN 0 THEN {each(item)} WHEN 1 THEN {each(named)} ELSE {each(named)} || {each(item)} END"
    p = F.col("page_id")

    def each(parts):
        def one(k):
            values = {"p": p.cast("string"), "k": k.cast("string"), "r": ((p + k) % 7).cast("string"), "j": (k + 1).cast("string")}
            return F.concat(*[values[x] if x in values else F.lit(x) for x in parts])

        n = (p % 4).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one), "")).otherwise("")

    return F.when(p % 3 == 0, each(item)).when(p % 3 == 1, each(named)).otherwise(F.concat(each(named), each(item)))


@query(
    """WITH p AS (SELECT page_id, unnest(range(0, page_id % 4)) AS k FROM pages WHERE contains(html, '</body>')), r AS (SELECT *, (page_id + k) % 7 + CASE WHEN page_id % 3 = 1 THEN 0 ELSE 0.5 END AS stars FROM p)
SELECT page_id, CAST(CASE WHEN page_id % 3 = 1 THEN 1 ELSE 0 END AS INT) AS selector_set, CAST(k AS INT) AS k, CASE WHEN page_id % 3 = 1 THEN 'Classtext' || k ELSE 'Body' || page_id || 'no & ' || k END AS text,
 CASE WHEN page_id % 3 = 1 THEN 'B' || page_id ELSE 'A' || page_id || '-' || k END AS reviewer, CASE WHEN stars <= 5 THEN stars::DOUBLE END AS rating, CASE WHEN page_id % 3 = 1 THEN 'day ' || k ELSE '2024-01-0' || (k + 1) END AS date FROM r"""
)
def page_records(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.replace("html", F.lit("</body>"), F.concat(_markup(True), F.lit("</body>"))).alias("html"))
    return H.records(pages)


_STANDS = r"regexp_matches(c, '(^|[^a-z0-9]){0}($|[^a-z0-9])')"


@query(
    WITH
    + rf""", c0 AS (SELECT review_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS c FROM alive),
c1 AS (SELECT *, list_slice(list_filter(string_split(left(c, instr(c, 'globex') - 1) || ' ' || substr(c, instr(c, 'globex') + 6), ' '), lambda x: x <> ''), 1, 2) AS rest FROM c0),
m AS (SELECT review_id, CASE WHEN {_STANDS.format('globex')} THEN CASE WHEN list_has_any(rest, ['the', 'is']) THEN 'rejected' ELSE 'name' END
 WHEN {_STANDS.format('acme')} AND {_STANDS.format('camera')} THEN 'brand_model' WHEN {_STANDS.format('initech')} THEN 'alias' WHEN {_STANDS.format('fast shipping')} THEN 'alias' END AS method FROM c1)
SELECT review_id, method, CASE method WHEN 'name' THEN 0.95::DOUBLE WHEN 'brand_model' THEN 0.92::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM m WHERE method <> 'rejected'"""
)
def identity_matches(spark, d):
    entity = C.Entity(name="Globex", brand="Acme", model="camera", aliases=("Initech", "Fast  shipping"), variants=("the", "is"))
    return C.identified(Q.alive(spark, d).select("review_id", F.col("text").alias("title")), entity).select("review_id", "method", "confidence")


# -- evidence, profile, comparison, report ----------------------------------


@query(
    WITH
    + """ SELECT review_id, project_id, source, review_date, CASE WHEN length(text) > 300 THEN rtrim(left(text, 270)) || '...' ELSE text END AS content, length(text) <= 300 AS whole, length(text) AS chars,
 '{"source":"' || source || '","lang":"' || lang || '","dataset_id":' || dataset_id || '}' AS provenance FROM eligible WHERE review_id IN (5, 10, 15, 20, 25, 30, 35, 40, 999999)"""
)
def evidence_lookup(spark, d):
    return P.lookup(R.eligible(reviews(spark, d)), [5, 10, 15, 20, 25, 30, 35, 40, 999999])


@query(
    more._PROFILE
    + f", mm AS (SELECT stars, round_even({Q._score('clean')}, 4) AS compound FROM ok), "
    + """f AS (SELECT (SELECT count(*) FROM classified) AS row_count, count(*) AS valid, (SELECT count(*) FROM classified WHERE is_duplicate) AS duplicates,
 (SELECT least(3, count(*) FILTER (stars <= 2 AND compound >= 0.4)) + least(3, count(*) FILTER (stars >= 4 AND compound <= -0.4)) FROM mm) AS mismatches,
 count(*) FILTER (language = 'non_english_or_unknown') AS unknown_language, count(*) FILTER (list_contains(flags, 'extremely_short_text')) AS short, count(*) FILTER (list_contains(flags, 'excessive_caps')) AS caps FROM ok),
w AS (SELECT *, list_filter([CASE WHEN row_count = 0 THEN 'zero_rows' END, CASE WHEN valid = 0 THEN 'no_valid_rows' END, CASE WHEN valid > 0 AND duplicates / greatest(1, row_count) >= 0.25 THEN 'duplicates' END, CASE WHEN mismatches >= 3 THEN 'rating_mismatch' END,
 CASE WHEN unknown_language > 0 AND unknown_language >= greatest(1, row_count // 4) THEN 'language' END, CASE WHEN short > 0 AND short >= greatest(1, valid // 5) THEN 'short_texts' END, CASE WHEN caps > 0 THEN 'caps' END], lambda x: x IS NOT NULL) AS w FROM f)
SELECT CASE WHEN row_count = 0 OR valid = 0 THEN 'error' WHEN len(w) > 0 THEN 'warning' ELSE 'info' END AS severity, array_to_string(w, ',') AS warnings FROM w"""
)
def profile_warnings(spark, d):
    rows = R.sentiment(I.classify(Q.raw(spark, d)), B.LEXICON, "clean")
    ok, flags = F.col("reason").isNull(), T.quality_flags(F.col("clean"))
    low, high = (ok & (F.col("stars") <= 2) & (F.col("compound") >= 0.4)), (ok & (F.col("stars") >= 4) & (F.col("compound") <= -0.4))
    # of each kind three samples are kept, and samples are what is counted
    facts = rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(ok).alias("valid"), F.count_if("is_duplicate").alias("duplicates"), (F.least(F.lit(3), F.count_if(low)) + F.least(F.lit(3), F.count_if(high))).alias("mismatches"),
        F.count_if(ok & (T.language_hint(F.col("clean")) == "non_english_or_unknown")).alias("unknown_language"), F.count_if(ok & F.array_contains(flags, "extremely_short_text")).alias("short"), F.count_if(ok & F.array_contains(flags, "excessive_caps")).alias("caps"),
    )
    return I.warnings_of(facts)


_ALL_LINKS = Q._LINKS.replace("FROM eligible WHERE regexp_matches", "FROM alive WHERE regexp_matches")
_COMPARED = (
    _ALL_LINKS
    + f""", ts AS (SELECT project_id, count(*) AS total, count(label) AS analysed, {Q._COUNTS}, {Q._CONF}, round_even(avg(rating), 2) AS average_rating FROM scored GROUP BY 1),
ac AS (SELECT project_id, aspect, {Q._COUNTS} FROM links GROUP BY 1, 2), tp AS (SELECT project_id, arg_min(aspect, (-positive, aspect)) FILTER (positive > 0) AS top_positive_aspect, arg_min(aspect, (-negative, aspect)) FILTER (negative > 0) AS top_negative_aspect FROM ac GROUP BY 1),
kw AS (SELECT project_id, string_agg(keyword, ',' ORDER BY rank) AS top_keywords FROM ({Q._kw_sql(5, True)}) GROUP BY 1),
tm AS (SELECT project_id, strftime(review_date, '%Y-%m') AS period, {Q._COUNTS} FROM scored WHERE review_date IS NOT NULL GROUP BY 1, 2), tr AS (SELECT project_id, string_agg(period || '=' || positive || '/' || negative || '/' || neutral, ',' ORDER BY period) AS trend FROM tm GROUP BY 1),
ce AS (SELECT ts.*, {Q._pcts('analysed')}, top_positive_aspect, top_negative_aspect, top_keywords, trend FROM ts LEFT JOIN tp USING (project_id) LEFT JOIN kw USING (project_id) LEFT JOIN tr USING (project_id) WHERE project_id IN (0, 2))"""
)


def _compared(spark, d):
    rows = Q.scored(spark, d)
    return P.comparison(rows, R.aspects(Q.alive(spark, d), B.ASPECTS, B.LEXICON), R.keywords(rows.where("NOT is_spam"), Q.STOP, 5), [0, 2], B.keys(spark, d).select("project_id"))


@query(_COMPARED + " SELECT * FROM ce")
def comparison_of_projects(spark, d):
    return _compared(spark, d)


@query(
    _COMPARED
    + """ SELECT arg_min('Project ' || project_id || ' has the highest positive sentiment percentage (' || positive_pct || '%).', (-positive_pct, project_id)) || ' ' ||
 string_agg('Project ' || project_id || '''s most common negative feedback relates to "' || top_negative_aspect || '".', ' ' ORDER BY project_id) AS text FROM ce"""
)
def comparison_narrative(spark, d):
    return P.comparison_narrative(_compared(spark, d))


_BETWEEN = "(review_date IS NULL OR review_date BETWEEN DATE '2024-02-01' AND DATE '2024-04-30')"


def _report_sql() -> str:
    counts = "count(*) AS n, " + Q._COUNTS
    stops = ", ".join(map(lit, Q.STOP))
    none = "NULL::BIGINT AS n, NULL::BIGINT AS positive, NULL::BIGINT AS negative, NULL::BIGINT AS neutral"
    return _ALL_LINKS + ", " + Q._SEC.split(WITH + ", ", 1)[1] + f""", sr AS (SELECT * FROM scored WHERE {_BETWEEN}), ok AS (SELECT * FROM sr WHERE NOT is_spam AND NOT is_duplicate),
tg AS (SELECT project_id, 'projectOverview' AS section, 'reviews' AS item, label, review_date, review_id FROM sr
 UNION ALL SELECT project_id, 'sentimentDistribution', label, label, review_date, review_id FROM sr UNION ALL SELECT project_id, 'sentimentTrends', strftime(review_date, '%Y-%m'), label, review_date, review_id FROM sr WHERE review_date IS NOT NULL
 UNION ALL SELECT project_id, 'representativeReviews', review_id::VARCHAR, label, review_date, review_id FROM ok UNION ALL SELECT project_id, 'sourceProvenance', coalesce(source, 'unknown'), label, review_date, review_id FROM ok
 UNION ALL SELECT project_id, 'keywordAnalysis', unnest(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]{{3,}}'), lambda w: lower(w))), lambda w: w NOT IN ({stops}))), label, review_date, review_id FROM sr WHERE NOT is_spam
 UNION ALL SELECT project_id, 'aspectSentiment', aspect, label, review_date, review_id FROM links WHERE {_BETWEEN}
 UNION ALL SELECT e.project_id, 'securityFindings', finding_type, NULL, review_date, review_id FROM sec JOIN (SELECT review_id, project_id, review_date FROM eligible) e USING (review_id) WHERE {_BETWEEN}),
it AS (SELECT project_id, section, item, {counts}, max(review_date) AS last FROM tg GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY project_id, section ORDER BY CASE WHEN section IN ('sentimentTrends', 'securityFindings') THEN 0 WHEN section = 'representativeReviews' THEN -coalesce(last - DATE '1970-01-01', -99999999) ELSE -n END,
  CASE WHEN section = 'representativeReviews' THEN item::BIGINT END, item) AS rank FROM it),
wh AS (SELECT project_id, section, {counts}, coalesce(min(review_date)::VARCHAR, '?') || ' to ' || coalesce(max(review_date)::VARCHAR, '?') AS span FROM tg GROUP BY 1, 2),
ur AS (SELECT *, round_even(negative / n * 100, 2) AS share FROM rk WHERE section = 'aspectSentiment' AND n >= 3 AND round_even(negative / n * 100, 2) >= 50),
cc AS (SELECT w.project_id, w.n, greatest(w.positive, w.negative, w.neutral) AS main, CASE WHEN positive >= greatest(negative, neutral) THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS label, a.item AS top
  FROM wh w JOIN (SELECT project_id, item FROM rk WHERE section = 'aspectSentiment' AND rank = 1) a USING (project_id) WHERE section = 'sentimentDistribution'),
al AS (SELECT project_id, 'alert ' || project_id AS item, 'open' AS line FROM (SELECT DISTINCT project_id FROM reviews) WHERE project_id % 2 = 0),
rp AS (SELECT project_id, section, 0 AS rank, NULL AS item, n, positive, negative, neutral, CASE WHEN section = 'projectOverview' THEN span END AS line FROM wh
 UNION ALL SELECT project_id, section, rank, item, n, positive, negative, neutral, NULL FROM rk WHERE rank <= CASE section WHEN 'keywordAnalysis' THEN 20 WHEN 'representativeReviews' THEN 30 ELSE 1000000000 END
 UNION ALL SELECT project_id, 'recommendations', row_number() OVER (PARTITION BY project_id ORDER BY share DESC, n DESC, item), item, n, positive, negative, neutral, CASE WHEN share >= 75 THEN 'high' WHEN share >= 60 THEN 'medium' ELSE 'low' END FROM ur
 UNION ALL SELECT project_id, 'conclusion', 1, NULL, {none}, 'Based on ' || n || ' reviews, the dominant sentiment is ' || label || ' (' || round_even(main / n * 100, 2) || '%). The most-discussed aspect is "' || top || '".' FROM cc
 UNION ALL SELECT project_id, 'alerts', 1, item, {none}, line FROM al)
SELECT project_id, section, CAST(rank AS INT) AS rank, item, n, positive, negative, neutral, line FROM rp
UNION ALL SELECT p.project_id, 'skipped', 0, s.item, {none}, NULL FROM (SELECT DISTINCT project_id FROM tg) p, (SELECT unnest([{', '.join(map(lit, P.SECTIONS))}]) AS item) s WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.project_id = p.project_id AND rp.section = s.item)"""


@query(_report_sql())
def report_sections(spark, d):
    within = lambda df: R.filtered(df, "2024-02-01", "2024-04-30", undated=True)
    found = Q.findings(spark, d).join(Q.alive(spark, d).select("review_id", "project_id", "review_date"), "review_id")
    alerts = B.keys(spark, d).select("project_id").distinct().where("project_id % 2 = 0").select("project_id", F.concat(F.lit("alert "), F.col("project_id").cast("string")).alias("item"), F.lit("open").alias("line"))
    tagged = P.tags(within(Q.scored(spark, d)), within(R.aspects(Q.alive(spark, d), B.ASPECTS, B.LEXICON)), within(found), Q.STOP)
    return P.report(tagged, {"alerts": alerts}, reviews=30)


# -- evidence ledger --------------------------------------------------------

_SEARCHED = "contains(text, 'Globex')"
_ENTRIES_SQL = (
    Q._CATS + ", " + Q._SEC.split(WITH + ", ", 1)[1]
    + f""", led AS (SELECT DISTINCT project_id AS run_id, tool, {_uuid('review_id::VARCHAR')} AS evidence_id, source FROM (
 SELECT 'search' AS tool, review_id FROM eligible WHERE {_SEARCHED} UNION ALL SELECT 'categories', review_id FROM cats WHERE category <> 'OTHER' UNION ALL SELECT 'security', review_id FROM sec) JOIN (SELECT review_id, project_id, coalesce(source, 'unknown') AS source FROM eligible) USING (review_id))"""
)


def _ledger(spark, d):
    ident = N.uuid_of(F.md5(F.col("review_id").cast("string").cast("binary")))
    rows = R.eligible(reviews(spark, d))
    owner = rows.select("review_id", "project_id")
    hits = rows.where(F.col("text").contains("Globex")).select(F.lit("search").alias("tool"), "review_id")
    hits = hits.unionByName(Q.cats(spark, d).where("category <> 'OTHER'").select(F.lit("categories").alias("tool"), "review_id")).unionByName(Q.findings(spark, d).select(F.lit("security").alias("tool"), "review_id"))
    step = F.when(F.col("tool") == "search", 0).when(F.col("tool") == "categories", 1).otherwise(2)
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(ident.alias("evidenceId"))).alias("items")).alias("result")))
    # one payload for each hit, as a tool returns them page by page; ids that are not eligible drop out
    outputs = hits.join(owner, "review_id").select(F.col("project_id").alias("run_id"), "tool", step.alias("step"), payload.alias("payload"))
    return L.entries(outputs, rows.select(ident.alias("evidence_id"), "source"))


@query(_ENTRIES_SQL + " SELECT * FROM led")
def investigation_ledger(spark, d):
    return _ledger(spark, d)


@query(_ENTRIES_SQL + ", ids AS (SELECT DISTINCT run_id, source, evidence_id FROM led), c AS (SELECT run_id, source, count(*) AS evidence FROM ids GROUP BY 1, 2) SELECT *, round_even(evidence / sum(evidence) OVER (PARTITION BY run_id) * 100, 2) AS share FROM c")
def investigation_sources(spark, d):
    return L.composition(_ledger(spark, d))


@query(
    _ENTRIES_SQL
    + """, f AS (SELECT run_id, tool AS finding_id, min(evidence_id) AS a, max(evidence_id) AS b FROM led GROUP BY 1, 2), other AS (SELECT run_id, min(evidence_id) AS o FROM led GROUP BY 1),
fx AS (SELECT f.*, CASE WHEN f.run_id % 2 = 1 AND finding_id = 'search' THEN (SELECT o FROM other WHERE other.run_id = f.run_id - 1) END AS foreign_id FROM f),
ci AS (SELECT run_id, finding_id, a AS evidence_id FROM fx UNION SELECT run_id, finding_id, b FROM fx UNION SELECT run_id, finding_id, foreign_id FROM fx WHERE foreign_id IS NOT NULL),
ck AS (SELECT run_id, finding_id, count(*) AS cited, count(*) FILTER (NOT EXISTS (SELECT 1 FROM led WHERE led.run_id = ci.run_id AND led.evidence_id = ci.evidence_id)) AS unavailable FROM ci GROUP BY 1, 2)
SELECT *, CASE WHEN unavailable > 0 THEN 'rejected' ELSE 'valid' END AS state FROM ck"""
)
def citation_check(spark, d):
    """Findings that cite the first and last id of a tool; some cite another run's evidence as well."""
    led = cut(_ledger(spark, d))
    each = led.groupBy("run_id", F.col("tool").alias("finding_id")).agg(F.min("evidence_id").alias("a"), F.max("evidence_id").alias("b"))
    other = led.groupBy((F.col("run_id") + 1).alias("run_id")).agg(F.min("evidence_id").alias("o"))
    foreign = F.when((F.col("run_id") % 2 == 1) & (F.col("finding_id") == "search"), F.col("o"))
    findings = each.join(other, "run_id", "left").select("run_id", "finding_id", F.array_compact(F.array("a", F.upper("b"), foreign)).alias("evidence_ids"))
    return L.checked(findings, led).select("run_id", "finding_id", "cited", "unavailable", "state")


# -- ingestion --------------------------------------------------------------


@query(WITH + f" SELECT project_id, count(*) AS reviews, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (is_spam) AS spam, CAST(sum(length({Q._KEY})) AS BIGINT) AS chars FROM reviews GROUP BY 1")
def ingest_reviews(spark, d):
    """Ingestion itself, anew each time: what the other queries read as written."""
    rows = B.ingested(spark, d)
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("is_duplicate").alias("duplicates"), F.count_if("is_spam").alias("spam"), F.sum("content_chars").cast("long").alias("chars"))


# -- summaries --------------------------------------------------------------


@query(
    Q._STATS
    + f""", su AS (SELECT project_id, count(label) AS analysed, {Q._COUNTS}, {Q._CONF} FROM scored GROUP BY 1), sp AS (SELECT *, {Q._pcts('analysed')} FROM su),
ra AS (SELECT *, row_number() OVER (PARTITION BY project_id, positive > 0 ORDER BY positive_pct DESC, frequency DESC, aspect) AS kp, row_number() OVER (PARTITION BY project_id, negative > 0 ORDER BY negative_pct DESC, frequency DESC, aspect) AS kn FROM stats),
po AS (SELECT project_id, string_agg('"' || aspect || '" — ' || positive_pct || '% positive across ' || frequency || ' mentions', '; ' ORDER BY kp) AS lines, max(CASE WHEN kp = 1 THEN '"' || aspect || '" is the most frequently identified positive aspect (' || positive_pct || '% positive across ' || frequency || ' mentions).' END) AS best FROM ra WHERE positive > 0 AND kp <= 3 GROUP BY 1),
ne AS (SELECT project_id, string_agg('"' || aspect || '" — ' || negative_pct || '% negative across ' || frequency || ' mentions', '; ' ORDER BY kn) AS lines, max(CASE WHEN kn = 1 THEN '"' || aspect || '" is the most frequently identified negative aspect in the analysed feedback (' || negative_pct || '% negative across ' || frequency || ' mentions).' END) AS worst FROM ra WHERE negative > 0 AND kn <= 3 GROUP BY 1),
kw AS (SELECT project_id, string_agg(keyword, ', ' ORDER BY rank) AS terms FROM ({Q._kw_sql(5, True)}) GROUP BY 1),
mo AS (SELECT project_id, strftime(review_date, '%Y-%m') AS period, {Q._COUNTS}, count(*) AS total FROM scored WHERE review_date IS NOT NULL GROUP BY 1, 2), mp AS (SELECT *, {Q._pcts()} FROM mo),
ml AS (SELECT project_id, negative_pct - lag(negative_pct) OVER (PARTITION BY project_id ORDER BY period) AS d, row_number() OVER (PARTITION BY project_id ORDER BY period DESC) AS k FROM mp),
di AS (SELECT project_id, CASE WHEN d > 0 THEN 'increasing' WHEN d < 0 THEN 'decreasing' WHEN d = 0 THEN 'stable' END AS direction FROM ml WHERE k = 1),
op AS (SELECT project_id, count(*) AS n FROM stats WHERE frequency >= 3 AND negative_pct >= 50 GROUP BY 1),
al AS (SELECT sp.project_id, 'Of ' || analysed || ' analysed reviews, ' || positive_pct || '% were positive, ' || negative_pct || '% negative and ' || neutral_pct || '% neutral (average confidence ' || round_even(avg_confidence * 100, 1) || '%).' AS fact,
 coalesce(nullif(concat_ws(' ', worst, best), ''), 'No aspect-level data is available for this date range yet.') AS aspect, po.lines AS pl, ne.lines AS nl, terms, direction,
 CASE WHEN op.n > 0 THEN op.n || ' system-generated recommendation(s) are currently open and awaiting review.' ELSE 'No open recommendations have been generated for this project.' END AS waiting
 FROM sp LEFT JOIN po USING (project_id) LEFT JOIN ne USING (project_id) LEFT JOIN kw USING (project_id) LEFT JOIN di USING (project_id) LEFT JOIN op USING (project_id))
SELECT project_id, 'overall' AS kind, concat_ws(' ', fact, 'The most prominent topics identified in the feedback are "first", "second".', aspect, 'Frequently mentioned terms include ' || terms || '.') AS text FROM al
UNION ALL SELECT project_id, 'executive', concat_ws(' ', fact, aspect, 'The negative-sentiment share has been ' || direction || ' over the most recent periods.', waiting) FROM al
UNION ALL SELECT project_id, 'positive', coalesce('Aspects with the strongest positive sentiment: ' || pl || '.', 'No aspect-level positive-sentiment data is available for this date range yet.') FROM al
UNION ALL SELECT project_id, 'negative', coalesce('Aspects with the strongest negative sentiment: ' || nl || '. ' || waiting, 'No aspect-level negative-sentiment data is available for this date range yet.') FROM al
UNION ALL SELECT project_id, 'comparative', coalesce('Negative-sentiment share is ' || direction || ' compared to the previous period in this date range. ' || fact, 'Not enough historical data across periods to generate a period-over-period comparison yet.') FROM al
UNION ALL SELECT project_id, 'periodic', 'From 2024-01-01 onward: ' || fact || ' The most prominent topics identified in the feedback are "first", "second".' FROM al"""
)
def summaries(spark, d):
    rows, found = Q.scored(spark, d), Q.stats(spark, d)
    topics = B.keys(spark, d).select("project_id").distinct().withColumn("t", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("first").alias("name")), F.struct(F.lit(2).alias("rank"), F.lit("second").alias("name"))))).select("project_id", "t.*")
    return S.texts(R.summary(rows), found, R.keywords(rows.where("NOT is_spam"), Q.STOP, 5), R.trend(rows, "monthly"), topics, found.where("frequency >= 3 AND negative_pct >= 50"), date_from="2024-01-01")


@query(Q._CATS + " SELECT (SELECT count(*) FROM eligible) AS reviews_scanned, (SELECT count(DISTINCT review_id) FROM cats WHERE category <> 'OTHER') AS classified_reviews, (SELECT count(*) FROM cats WHERE category = 'OTHER') AS other")
def feedback_scan(spark, d):
    # a review without a category has one row, OTHER; the rows of the others are counted by review
    per = Q.cats(spark, d).groupBy("review_id").agg(F.bool_or(F.col("category") != "OTHER").alias("classified"))
    return per.agg(F.count(F.lit(1)).alias("reviews_scanned"), F.count_if("classified").alias("classified_reviews"), F.count_if(~F.col("classified")).alias("other"))
