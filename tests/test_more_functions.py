"""Functions that no registered query uses: each with its defined results, nulls and empty tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import collect as C
from opinara.operators import reports as P
from opinara.operators import topics as M
from opinara.sources import files
from opinara.streaming import reviews as ST


def values(spark, rows, kind, f):
    return [r.y for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_text_functions(spark):
    both = spark.createDataFrame([(["b", "a", "b"], ["c", "a"]), ([], ["z"]), (None, ["q"])], "a array<string>, b array<string>")
    assert [r.y for r in both.select(T.ordered_union(F.col("a"), F.col("b")).alias("y")).collect()] == [["b", "a", "c"], ["z"], None]
    maps = spark.createDataFrame([({"k": "v"},), ({"k": "é" * 20},), (None,)], "x map<string,string>")
    assert [r.y for r in maps.select(T.metadata_or_null(F.col("x"), 30).alias("y")).collect()] == ['{"k":"v"}', None, None]
    assert values(spark, ["The dog is at the door", "xyz", "", None, "it's me"], "string", T.english_hint_ratio) == [4 / 6, 0.0, None, None, 0.0]


def test_product_urls_keep_their_ids(spark):
    raw = ["https://Shop.Example/p/one/?pid=A1&x=2&lid=L9#top", "https://shop.example/p?lid=L1", "https://shop.example/p", "no url", None]
    got = values(spark, raw, "string", C.product_url)
    assert got[0] == "https://shop.example/p/one?pid=A1&lid=L9" and got[1].endswith("/p?lid=L1") and got[2] == "https://shop.example/p" and got[4] is None


def test_collected_records(spark):
    comments = spark.createDataFrame([("1", " good one ", "1700000000", 3), ("2", "[removed]", None, 1), ("3", "[deleted]", None, 1), ("4", "", None, 1), ("5", "dated", "2024-03-04T10:00:00Z", 1), ("6", None, None, 1)], "id string, body string, created string, score int")
    assert [(r.record_id, r.text, r.day) for r in C.discussions(comments).collect()] == [("1", "good one", dt.date(2023, 11, 14)), ("5", "dated", dt.date(2024, 3, 4))]
    found = spark.createDataFrame([("A", "shop", "https://a.b/x?y=1", 2), ("a", "shop", "https://A.b/x", 1), ("B", "forum", "https://c.d/", 0), ("C", "shop", None, 3)], "name string, category string, url string, priority int")
    assert [(r.name, r.priority) for r in C.candidates(found).collect()] == [("B", 0), ("a", 1), ("C", 3)]
    assert [r.name for r in C.candidates(found, "shop", 1).collect()] == ["a"]
    entity = C.Entity(name="Acme One")
    rows = spark.createDataFrame([("Acme One", "fine"), ("Acme One", "  "), ("other", "fine"), ("Acme One pro", "x")], "title string, text string")
    got = C.verified(rows, entity, 2, "api", "p1").collect()
    assert [(r.title, r.method, r.metadata["level"], r.metadata["provider"]) for r in got] == [("Acme One", "name", "2", "p1")]
    payload = [{"text": "the Acme one", "rating": 4.0, "date": "2024-01-02"}, {"text": "acme again", "rating": 9.0, "date": "soon"}, {"text": "another", "rating": 1.0}, {"text": "acme" + "x" * 10_000}]
    own = C.prototype_records(spark.createDataFrame([(json.dumps(payload),), ("broken",)], "payload string"), "ACME", 3).collect()
    assert [tuple(r) for r in own] == [("the Acme one", 4.0, dt.date(2024, 1, 2)), ("acme again", None, None)]


def test_labelled_rows(spark):
    rows = spark.createDataFrame([("a", " Positive "), ("", "negative"), ("b", "NEUTRAL")], "Text string, LABEL string")
    assert [tuple(r) for r in C.labelled_rows(rows).collect()] == [("a", "positive"), ("b", "neutral")]
    with pytest.raises(ValueError, match="good"):
        C.labelled_rows(spark.createDataFrame([("a", "good")], "text string, label string"))


def test_issue_payloads_levels_and_relevance(spark):
    payload = [{"id": 1, "title": "Crash", "body": "it fails", "created_at": "2024-02-03T00:00:00Z", "labels": [{"name": f"l{k}"} for k in range(25)]}, {"id": 2, "title": "PR", "pull_request": {"url": "u"}}, {"id": 3, "title": "Only", "body": None}]
    got = files.issues(spark.createDataFrame([(json.dumps(payload),), ("no json",), (None,)], "payload string")).collect()
    assert [(r.external_review_id, r.text, r.date) for r in got] == [("1", "Crash\n\nit fails", dt.date(2024, 2, 3)), ("3", "Only", None)] and len(got[0].labels) == 20
    rows = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("s", 1, "c"), ("t", 3, "d")], "source string, level int, text string")
    assert sorted(r.text for r in files.first_level(rows).collect()) == ["a", "c", "d"]
    texts = spark.createDataFrame([("I like the Acme phone",), ("acme",), ("a long text about nothing",), (None,)], "text string")
    assert [r.text for r in files.relevant(texts, ["ACME"]).collect()] == ["I like the Acme phone"]


def test_sinks(spark, tmp_path):
    path, log = str(tmp_path / "r"), str(tmp_path / "log")
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "project_id int, review_id int")
    files.append_reviews(df, path)
    files.append_reviews(df.where("project_id = 1"), path)
    assert spark.read.parquet(path).count() == 4
    for _ in range(2):  # a rerun replaces, and leaves other projects alone
        files.replace_projects(df.where("project_id = 1"), path)
        assert sorted((r.project_id, r.review_id) for r in spark.read.parquet(path).collect()) == [(0, 1), (0, 2), (1, 3)]
    events = files.audit_events(df, "flagged", "review", "review_id", ["project_id"], "ann", "2024-01-01 00:00:00")
    files.append_audit(events, log)
    files.append_audit(events.limit(0), log)
    got = spark.read.parquet(log).orderBy("entity_id").collect()
    assert [(r.actor, r.action, r.entity_id, json.loads(r.metadata)) for r in got][0] == ("ann", "flagged", "1", {"project_id": 0}) and len(got) == 3


def test_rollups_and_narrative(spark):
    records = spark.createDataFrame([({"level": "1", "method": "api"},), ({"level": "1"},), (None,), ({"level": "2", "x": "y"},)], "metadata map<string,string>")
    assert sorted(tuple(r) for r in P.metadata_rollup(records, ["level", "method"]).collect()) == [("level", "1", 2), ("level", "2", 1), ("method", "api", 1)]
    summary = spark.createDataFrame([(1, 20.0, 50.0, 30.0)], "project_id int, positive_pct double, negative_pct double, neutral_pct double")
    assert P.narrative(summary).first().text == "Feedback is 50.0% negative, 30.0% neutral, 20.0% positive."
    with pytest.raises(ValueError, match="unknown projects"):
        P.comparison(summary, summary, summary, [1, 9], summary)
    with pytest.raises(ValueError, match="two projects"):
        P.comparison(summary, summary, summary, [1, 1], summary)


def test_rows_without_a_time_are_counted_aside(spark):
    rows = spark.createDataFrame([(0, dt.datetime(2024, 1, 1)), (0, None), (1, None), (1, None)], "project_id int, ts timestamp")
    dated, none = ST.dated(rows)
    assert dated.count() == 1 and sorted(tuple(r) for r in none.collect()) == [(0, 1), (1, 2)]


def test_topic_distribution_counts_labels(spark):
    assigned = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 1, "b"), (4, 1, "b")], "review_id int, topic int, name string")
    scored = spark.createDataFrame([(1, "positive"), (2, "negative"), (3, "neutral"), (9, "positive")], "review_id int, label string")
    got = sorted(tuple(r) for r in M.topic_distribution(assigned, scored).collect())
    assert got == [(0, "a", 2, 1, 1, 0, 0), (1, "b", 2, 0, 0, 1, 1)]
