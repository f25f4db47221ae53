"""Stored tables: keyed merges by bucket, idempotent, with the engine's rules of state."""

import os

import pytest
from pyspark.sql import functions as F

from opinara.sources import stored as K

AT, LATER = "2024-05-01 00:00:00", "2024-05-02 00:00:00"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def state(spark, path, *columns):
    return sorted(map(tuple, K.read_table(spark, path).select(*columns).collect()), key=str)


def results(spark, rows):
    return spark.createDataFrame([(i, label, p, n, 1 - p - n, max(p, n), c) for i, label, p, n, c in rows], "review_id bigint, label string, positive_score double, negative_score double, neutral_score double, confidence double, compound double")


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert K.merge(rows, path, ["k"], buckets=16) == {"inserted": 1000, "updated": 0, "kept": 0}
    before = files(path)
    got = K.merge(spark.createDataFrame([(5, "b"), (2000, "c")], "k bigint, v string"), path, ["k"])
    assert (got["inserted"], got["updated"]) == (1, 1)
    after = files(path)
    folders = lambda x: {os.path.dirname(p) for p in x}
    assert len(folders(set(before) - set(after))) <= 2 and len(set(before) & set(after)) >= len(before) - 2
    assert K.read_table(spark, path).count() == 1001 and dict(state(spark, path, "k", "v"))[5] == "b"
    # again: the same state
    whole = state(spark, path, "k", "v")
    assert K.merge(spark.createDataFrame([(5, "b"), (2000, "c")], "k bigint, v string"), path, ["k"])["inserted"] == 0
    assert state(spark, path, "k", "v") == whole
    with pytest.raises(ValueError, match="twice"):
        K.merge(spark.createDataFrame([(1, "x"), (1, "y")], "k bigint, v string"), path, ["k"])
    K.merge(spark.createDataFrame([(None, "n")], "k bigint, v string"), path, ["k"])
    K.merge(spark.createDataFrame([(None, "m")], "k bigint, v string"), path, ["k"])
    assert [v for k, v in state(spark, path, "k", "v") if k is None] == ["m"]
    assert K.merge(rows.where("false"), path, ["k"]) == {"inserted": 0, "updated": 0, "kept": 0}


def test_sentiment_corrections_and_new_runs(spark, tmp_path):
    path = str(tmp_path / "s")
    columns = ["review_id", "label", "positive_score", "confidence", "compound", "model", "corrected_by"]
    K.store_sentiment(results(spark, [(1, "positive", 0.7, 0.1, 0.6), (2, "negative", 0.0, 0.5, -0.4)]), path, "lexicon", AT)
    fix = spark.createDataFrame([(2, "positive", "ann"), (3, "neutral", "bob")], "review_id bigint, label string, corrected_by string")
    for _ in range(2):  # a correction that is sent twice
        K.correct_sentiment(fix, path, LATER)
        assert state(spark, path, *columns) == [(1, "positive", 0.7, 0.7, 0.6, "lexicon", None), (2, "positive", 0.0, 0.5, None, "lexicon", "ann"), (3, "neutral", 0.0, 1.0, None, "manual", "bob")]
    with pytest.raises(ValueError, match="label"):
        K.correct_sentiment(fix.withColumn("label", F.lit("great")), path, LATER)
    reviews = spark.createDataFrame([(k,) for k in (1, 3, 4)], "review_id bigint")
    assert [r.review_id for r in K.not_analysed(reviews, path).collect()] == [4] and K.not_analysed(reviews, str(tmp_path / "none")).count() == 3
    # a new run takes the marks of the correction away
    K.store_sentiment(results(spark, [(2, "negative", 0.0, 0.5, -0.4)]), path, "lexicon", LATER)
    assert state(spark, path, *columns)[1] == (2, "negative", 0.0, 0.5, -0.4, "lexicon", None)


def test_aspects_are_created_once(spark, tmp_path):
    path, names = str(tmp_path / "a"), str(tmp_path / "n")
    kind = "review_id bigint, project_id int, aspect string, label string, confidence double"
    first = spark.createDataFrame([(1, 0, "price", "negative", 0.5), (2, 0, "price", "positive", 0.25)], kind)
    assert K.store_aspects(first, path, names)["inserted"] == 2 and K.store_aspects(first, path, names)["inserted"] == 0
    got = K.store_aspects(spark.createDataFrame([(1, 0, "price", "neutral", 0.0), (1, 0, "sound", "positive", 1.0)], kind), path, names)
    assert (got["inserted"], got["updated"]) == (1, 1)
    assert state(spark, path, "review_id", "aspect", "label") == [(1, "price", "neutral"), (1, "sound", "positive"), (2, "price", "positive")]
    assert state(spark, names, "project_id", "aspect") == [(0, "price"), (0, "sound")]


def test_findings_are_reconciled(spark, tmp_path):
    path = str(tmp_path / "f")
    kind = "review_id bigint, finding_type string, severity string, evidence string, text_sha256 string"
    make = lambda *rows: spark.createDataFrame(list(rows), kind)
    a, b, c = (1, "PHISHING", "HIGH", "link", "x"), (2, "MALWARE", "HIGH", "bad", "y"), (3, "TLS", "LOW", "old", "z")
    assert K.store_findings(make(a, b), path) == {"created": 2, "updated": 0, "stale": 0}
    assert K.store_findings(make(a, b), path) == {"created": 0, "updated": 0, "stale": 0}
    seen = spark.createDataFrame([(1, "PHISHING", "dismissed", "ann"), (2, "MALWARE", "confirmed", "ann")], "review_id bigint, finding_type string, status string, reviewed_by string")
    K.merge(seen, path, ["review_id", "finding_type"], matched={"status": F.col("new.status"), "reviewed_by": F.col("new.reviewed_by")})
    # one changes, one goes, one is new
    assert K.store_findings(make((1, "PHISHING", "HIGH", "other link", "x2"), c), path) == {"created": 1, "updated": 1, "stale": 1}
    columns = ["review_id", "status", "evidence", "reviewed_by"]
    assert state(spark, path, *columns) == [(1, "needs_review", "other link", None), (2, "stale", "bad", "ann"), (3, "needs_review", "old", None)]
    # what was stale and is found again waits for review again
    assert K.store_findings(make(b, c), path) == {"created": 0, "updated": 1, "stale": 1}
    assert [r[1] for r in state(spark, path, *columns)] == ["stale", "needs_review", "needs_review"]
