"""Operator 13: features by their definition, held-out accuracy, awkward tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from opinara.llm import quality_classifier as qc
from opinara.llm import queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FULL = (1 << 64) - 1


def slow_bag(text):
    factor, mix = int(qc.FACTOR), int(qc.MIX)
    found, before = [], None
    for w in [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]:
        found.append((0, sum((c + 1) * pow(factor, i + 1, 1 << 64) for i, c in enumerate(w)) & FULL))
        if before is not None:
            found.append((1, int(before == w)))
        before, padded = w, b" " + w + b" "
        for k in qc.GRAMS:
            for i in range(len(padded) - k + 1):
                h = 0
                for c in padded[i : i + k]:
                    h = (h * factor + c + 1) & FULL
                found.append((k, h))

    def bucket(kind, h):
        h = ((h ^ (h >> 32)) * mix + kind) & FULL
        h = ((h ^ (h >> 29)) * mix) & FULL
        return h >> (64 - qc.BITS)

    return Counter(bucket(*x) for x in found)


def test_bags_by_definition_in_any_window():
    rng = random.Random(1)
    for window in (1 << 17, 7, 5, 1):
        for _ in range(60):
            texts = [rng.choice([None, "", "".join(rng.choice("ab é\n\t日") for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(0, 5))]
            for text, (at, n) in zip(texts, qc.bags(texts, window=window), strict=True):
                assert dict(zip(at.tolist(), n.tolist())) == dict(slow_bag(text))


def test_scores_are_those_of_the_mean_vector():
    texts = ["good words here", "bad### words$$$", "", "the the the the", "x" * 1000]
    known = qc.bags(texts[:2] * 10)
    model = qc.Model(known, np.array([1, 0] * 10), steps=400)
    for text, score in zip(texts, model.scores(texts)):
        (at, n), z = qc.bags([text])[0], model.start
        if len(at):
            z += float(model.weight[at] @ n) / n.sum()
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9
    assert model.scores(texts)[0] > 0.5 > model.scores(texts)[1]
    assert np.allclose(model.scores(texts, window=3), model.scores(texts))


def test_held_out_accuracy_and_no_leak(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = queries.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in queries.op13_quality_classifier(spark, sf).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    known = {r.doc_id: r.quality for r in labels.collect() if got[r.doc_id].held_out}
    right = sum(got[i].predicted == q for i, q in known.items()) / len(known)
    caught = sum(got[i].predicted == 0 for i, q in known.items() if q == 0) / sum(q == 0 for q in known.values())
    assert right >= 0.97 and caught >= 0.9
    # turning the held-out labels and renaming sources changes nothing
    turned = labels.withColumn("quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in qc.classify(docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit(None).cast("string")), turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in got.items())


def test_awkward_and_empty_tables(spark):
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(0, "", "en", "s", 0), (1, None, None, None, None), (8, "fine words", "en", None, 1), (9, "junk### $$$", "en", "s", 1), (9, "junk### $$$", "en", "s", 1), (None, "fine words", None, None, None), (10, long, "en", "s", 1), (11, " \t\n", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for clash in ("id", "label", "i", "h", "score", "predicted", "held_out", "at", "n", "order"):
        docs = docs.withColumn(clash, F.lit("z"))
    labels = spark.createDataFrame([(8, 1), (9, 0), (9, 1), (10, 1), (11, 0), (7, None), (None, 1)], "doc_id bigint, quality int")
    got = qc.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({r.score for r in got if r.doc_id in (0, 1, 11)}) == 1 and len({r.score for r in got if r.doc_id == 9}) == 1
    assert {r.score for r in got if r.doc_id is None} == {r.score for r in got if r.doc_id == 8} and not [r for r in got if r.doc_id is None and r.held_out]
    # nothing to learn from, one label only, nothing to score
    assert {(r.score, r.predicted) for r in qc.classify(docs, labels.where("false")).collect()} == {(0.5, 1)}
    assert {r.predicted for r in qc.classify(docs, labels.where("quality = 0")).collect()} == {0}
    assert qc.classify(docs.where("false"), labels).collect() == []
    assert qc.fit(docs, labels, sample=1) is not None
