"""Mini-batch k-means against a NumPy version on the same batches, and topics of texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import topics as M


def blobs(n, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(5, 6)) * 4
    return [(k, (at[k % 5] + rng.normal(size=6)).tolist()) for k in range(n)]


@pytest.mark.parametrize("batch", [40, 1000])
def test_mini_batches_equal_numpy(spark, monkeypatch, batch):
    monkeypatch.setattr(M, "BATCH", batch)
    rows = blobs(400)
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = M.mini_batches(df, 5, seed=7, starts=3, steps=20)
    # the same buckets, order of batches and starts in NumPy
    hashed = {r.id: r.h for r in df.select("id", F.xxhash64(F.lit(7), "id").alias("h")).collect()}
    points = {i: np.array(v) for i, v in rows}
    buckets = max(1, min(M.BATCHES, 400 // batch))
    order = sorted(points, key=lambda i: (hashed[i], i))[: M.TRIED]
    centres, weight = M.best_start(np.stack([points[i] for i in order]), 5, 7, 3), np.zeros(5)
    for step in range(min(20, 3 * buckets if buckets > 1 else 12)):
        x = np.stack([points[i] for i in points if hashed[i] % buckets == step % buckets])
        c = M.nearest(x, centres)
        before, weight = centres, weight.copy()
        for j in range(5):
            mine = x[c == j]
            weight[j] += len(mine)
            if len(mine):
                centres = np.where(np.arange(5)[:, None] == j, centres[j] + (mine.sum(axis=0) - len(mine) * before[j]) / weight[j], centres)
        if np.abs(centres - before).max() < 1e-6:
            break
    assert np.allclose(got, centres, atol=1e-9)
    everything = np.stack([points[i] for i in range(400)])
    assert (M.nearest(everything, got) == M.nearest(everything, centres)).all()
    # blobs that lie far apart are told apart
    assert len({(k % 5, int(c)) for k, c in enumerate(M.nearest(everything, got))}) <= 8


def test_starts_are_spread_and_seeded():
    points = np.array([v for _, v in blobs(200)])
    a, b = (M.best_start(points, 5, 3, 3) for _ in range(2))
    assert (a == b).all() and len(np.unique(a, axis=0)) == 5
    assert M.plus_plus(np.zeros((4, 2)), 3, np.random.default_rng(0)).shape == (3, 2)


def test_topics_of_texts(spark):
    rows = [(k, ["battery charge power low battery", "screen display bright glass screen", "delivery courier parcel late"][k % 3] + (" extra" if k % 7 == 0 else "")) for k in range(60)] + [(90, "the and of"), (91, None)]
    df = spark.createDataFrame(rows, "review_id bigint, text string")
    got = {r.review_id: r for r in M.topics(df, 3).collect()}
    assert len(got) == 62 and all(0 <= r.relevance <= 1 for r in got.values())
    assert all(len({got[k].topic for k in range(j, 60, 3)}) == 1 for j in range(3)) and len({got[k].topic for k in range(3)}) == 3
    assert "battery" in got[0].name and "screen" in got[1].name and got[0].relevance > 0.7
    with pytest.raises(ValueError):
        M.topics(df.limit(1), 3)
    assert {r.name for r in M.topics(df.where("review_id >= 90"), 3).collect()} == {"General Feedback"}
