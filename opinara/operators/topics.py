"""Topics: TF-IDF with Spark ML and mini-batch k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import keyword_tokens
from opinara.session import drop_stored, stored


def document_frequencies(df: DataFrame, least: int = 1) -> DataFrame:
    """Terms with their document frequency and smoothed idf (in thousandths)."""
    n = df.select(F.count(F.lit(1)).alias("n"))
    terms = df.select(F.explode(F.array_distinct(keyword_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    return terms.join(F.broadcast(n)).select("term", "df", F.round(1000 * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).cast("long").alias("idf_milli"))


#: Rows of a mini-batch at least, buckets of which one is a batch, steps, and rows that starts are tried on.
BATCH = 1024
BATCHES = 64
STEPS = 48
TRIED = 3 * BATCH


def plus_plus(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ starts: each next centre is drawn in proportion to its squared distance from those before."""
    centres = [points[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = near.sum()
        pick = rng.choice(len(points), p=near / total) if total > 0 else rng.integers(len(points))
        centres.append(points[pick])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)


def best_start(points: np.ndarray, k: int, seed: int, starts: int) -> np.ndarray:
    """Of ``starts`` seeded starts the one of least cost on ``points``."""
    tried = [plus_plus(points, k, np.random.default_rng(seed + x)) for x in range(starts)]
    return min(tried, key=lambda c: ((points - c[nearest(points, c)]) ** 2).sum())


def moved(centres: np.ndarray, weight: np.ndarray, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres after a batch: each goes towards its rows' mean by their share of all rows it has had."""
    weight = weight + n
    return centres + (sums - n[:, None] * centres) / np.maximum(weight, 1)[:, None], weight


def mini_batches(points: DataFrame, k: int, seed: int = 42, starts: int = 3, steps: int = STEPS) -> np.ndarray:
    """Centres of the rows of ``points`` (id, v array<double>).

    Rows are dealt into buckets by a seeded hash of their id and written by bucket; a step
    reads one bucket, sums its rows by nearest centre in the tasks, and the driver gets one
    row for each centre.  Starts are tried on a bounded sample, the rows whose hash is least."""
    size = points.count()
    buckets = max(1, min(BATCHES, size // BATCH))
    draw = F.xxhash64(F.lit(seed), "id")
    table = stored(points.withColumn("b", F.pmod(draw, F.lit(buckets)).cast("int")).repartition("b"))
    sample = points.select("v", draw.alias("h"), "id").orderBy("h", "id").limit(TRIED).toPandas()
    centres = best_start(np.stack(sample["v"].to_numpy()), k, seed, starts)
    weight = np.zeros(k)
    dims = centres.shape[1]

    def summed(at: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((k, dims)), np.zeros(k)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                c = nearest(x, at)
                np.add.at(total, c, x)
                n += np.bincount(c, minlength=k)
            flat = np.concatenate([n[:, None], total], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["cell", "s"])

        return run

    for step in range(min(steps, 3 * buckets if buckets > 1 else 12)):
        got = np.zeros(k * (dims + 1))
        rows = table.where(F.col("b") == step % buckets).select("v").mapInArrow(summed(centres), "cell int, s double")
        for r in rows.groupBy("cell").agg(F.sum("s").alias("s")).collect():  # as many numbers as the centres have
            got[r.cell] = r.s
        both = got.reshape(k, dims + 1)
        before = centres
        centres, weight = moved(centres, weight, both[:, 1:], both[:, 0])
        if np.abs(centres - before).max() < 1e-6:
            break
    drop_stored(table)
    return centres


def topics(df: DataFrame, k: int = 8, features: int = 500, seed: int = 42, starts: int = 3) -> DataFrame:
    """(review_id, topic, name, relevance): mini-batch k-means clusters of L2-normalised TF-IDF vectors
    of the ``features`` most frequent terms, with smoothed idf plus one.

    A topic is named by its centroid's three heaviest terms (``General Feedback`` without any;
    a name that is taken gets a number); relevance is the product of a review's vector with its
    centroid, from 0 to 1.  Fewer than two usable texts are an error."""
    words = stored(StopWordsRemover(inputCol="words", outputCol="kept").transform(df.select("review_id", keyword_tokens(F.col("text")).alias("words"))).select("review_id", "kept"))
    n = words.count()
    if n < 2:
        raise ValueError("topics need two reviews with a text at least")
    if not words.where(F.size("kept") > 0).limit(1).count():
        return words.select("review_id", F.lit(0).alias("topic"), F.lit("General Feedback").alias("name"), F.lit(1.0).alias("relevance"))
    counter = CountVectorizer(inputCol="kept", outputCol="tf", vocabSize=features).fit(words)
    counted = counter.transform(words)
    idf = F.array(*[F.lit(float(x) + 1.0) for x in IDF(inputCol="tf", outputCol="tfidf").fit(counted).idf])
    raw = counted.select(F.col("review_id").alias("id"), F.zip_with(vector_to_array("tf"), idf, lambda a, b: a * b).alias("w"))
    length = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
    normal = stored(raw.withColumn("l", length).select("id", F.transform("w", lambda x: F.when(F.col("l") > 0, x / F.col("l")).otherwise(0.0)).alias("v")))
    fitted = mini_batches(normal, max(1, min(k, 20, n)), seed, starts)
    names: list[str] = []
    for number, center in enumerate(fitted):
        heavy = [counter.vocabulary[i] for i in (-center).argsort(kind="stable")[:3] if center[i] > 0]
        name, again = " / ".join(heavy) or f"Topic {number + 1}", 2
        while name in names:
            name, again = " / ".join(heavy) + f" ({again})", again + 1
        names.append(name)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, fitted.shape[1])
            c = nearest(x, fitted)
            near = np.round(np.clip((x * fitted[c]).sum(axis=1), 0, 1), 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.astype(np.int32)), pa.array([names[i] for i in c], pa.string()), pa.array(near)], ["review_id", "topic", "name", "relevance"])

    kind = df.schema["review_id"].dataType.simpleString()
    return normal.mapInArrow(place, f"review_id {kind}, topic int, name string, relevance double")


def topic_distribution(assigned: DataFrame, scored: DataFrame) -> DataFrame:
    """Per topic: reviews, and how many are positive, negative, neutral and not analysed."""
    labels = ("positive", "negative", "neutral")
    both = assigned.join(scored.select("review_id", "label"), "review_id", "left")
    return both.groupBy("topic", "name").agg(F.count(F.lit(1)).alias("reviews"), *[F.count_if(F.col("label") == x).alias(x) for x in labels], F.count_if(F.col("label").isNull()).alias("unanalysed"))
