"""Quality classifier: supervised subword embeddings.

A text is a bag of its words, of the character n-grams of its words and of marks that say
whether a word repeats the one before, hashed into buckets.  Each bucket has a learned vector; a document's vector is the mean over its bag, and a softmax
over a linear layer gives the labels' probabilities.  Bags are made in Spark's tasks, from
whole texts; numpy trains by stochastic gradient descent on the bags of a bounded sample of
labelled rows.  As the output is linear in the mean, scoring needs one number a bucket and
label: the tables are multiplied once, and the product is what tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the fit: labelled rows, distinct by text and label, and steps of the descent, each on one
#: of them (in whole rounds over all).
SAMPLE_TEXTS = 4000
STEPS = 32_000
#: n-grams of bytes, counting the blank before and after a word, and bits of a bucket's number.
GRAMS = (2, 3, 4)
BITS = 16
DIMS = 8
RATE = 1.0
SEED = 13
#: Texts turned into Python objects at a time, and bytes of a text hashed at once.
SLICE = 64
WINDOW = 1 << 17
#: Odd multipliers of the rolling hash (with the inverse of the first) and of the final mixing.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWERS, UNDONE = _powers(FACTOR, WINDOW + 1), _powers(INVERSE, WINDOW + 1)


def _bucket(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX + np.uint64(kind)
    h = (h ^ (h >> np.uint64(29))) * MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[str | None], bits: int = BITS, grams: tuple[int, ...] = GRAMS, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of every feature of the texts, in pieces.

    A word is a run without space, tab or line break; its n-grams may hold the blank before
    or after it.  Each word after a text's first also says whether it repeats the one before.
    Texts are hashed together, ``window`` bytes at once; a word that is cut goes on in the
    next window."""
    if not texts:
        return
    said = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" " + b"".join(t + b" " for t in said), np.uint8)
    owner = np.repeat(np.arange(len(said), dtype=np.int32), [len(t) + 1 for t in said])
    owner = np.concatenate([owner[:1], owner])
    blank = BLANK[raw]
    keep = ~(blank & np.concatenate([[False], blank[:-1]]))  # one blank for each run of them
    data, owner, blank = np.where(blank, np.uint8(32), raw)[keep], owner[keep], blank[keep]
    done, at_zero = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    place, unplace = at_zero, at_zero  # FACTOR**at and its inverse
    opened, undo = done, at_zero  # of the word that is open: the sum before it, and what undoes its place
    last, last_owner = done, np.full(1, -1, np.int32)
    for at in range(0, len(data), window):
        part = data[at : at + window]
        n = len(part)
        # the sum of byte * FACTOR**place up to each byte; differences of it are words' hashes
        sums = done + np.cumsum((part.astype(np.uint64) + np.uint64(1)) * (POWERS[:n] * place), dtype=np.uint64)
        ends = np.nonzero(blank[at : at + n])[0]
        if at == 0:
            opened, undo, ends = sums[:1], UNDONE[:1] * unplace, ends[1:]  # the blank before the first text
        opens, undoes = np.concatenate([opened, sums[ends]]), np.concatenate([undo, UNDONE[ends] * unplace])
        word = (np.where(ends > 0, sums[ends - 1], done) - opens[:-1]) * undoes[:-1]
        whose = owner[at + ends - 1]
        yield whose, _bucket(word, 0, bits)
        before, before_owner = np.concatenate([last, word]), np.concatenate([last_owner, whose])
        beside = before_owner[:-1] == before_owner[1:]
        yield whose[beside], _bucket((before[:-1] == before[1:])[beside].astype(np.uint64), 1, bits)
        last, last_owner = before[-1:], before_owner[-1:]
        opened, undo = opens[-1:], undoes[-1:]
        done, place, unplace = sums[-1:], place * POWERS[n : n + 1], unplace * UNDONE[n : n + 1]
        for k in grams:
            wide, empty = data[at : at + n + k - 1], blank[at : at + n + k - 1]
            m = len(wide) - k + 1
            if m <= 0:
                continue
            h, inner = np.zeros(m, np.uint64), np.zeros(m, bool)
            for i in range(k):
                h = h * FACTOR + (wide[i : i + m] + np.uint64(1))
                if 0 < i < k - 1:
                    inner |= empty[i : i + m]
            mine = owner[at + 1 : at + 1 + m] if k > 2 else np.where(empty[:m], owner[at + 1 : at + 1 + m], owner[at : at + m])
            yield mine[~inner], _bucket(h[~inner], k, bits)


def bags(texts: list[str | None], bits: int = BITS, grams: tuple[int, ...] = GRAMS, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its buckets and how often each occurs."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for owner, bucket in features(texts, bits, grams, window):
        key, n = np.unique((owner.astype(np.int64) << bits) + bucket, return_counts=True)
        keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    edges = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << bits)
    return [(keys[a:b] & ((1 << bits) - 1), counts[a:b]) for a, b in zip(edges, edges[1:])]


class Model:
    """Vectors of the buckets, the output layer and its bias, trained by stochastic gradient descent."""

    def __init__(self, known: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, grams: tuple[int, ...] = GRAMS, dims: int = DIMS, steps: int = STEPS, rate: float = RATE, seed: int = SEED):
        self.bits, self.grams = bits, grams
        rng = np.random.default_rng(seed)
        table = rng.uniform(-1 / dims, 1 / dims, (1 << bits, dims)).astype(np.float32)
        out, bias = np.zeros((2, dims), np.float32), np.zeros(2, np.float32)
        share = [(at, (n / max(1, n.sum())).astype(np.float32)) for at, n in known]
        epochs, done = -(-steps // max(1, len(known))) if known else 0, 0
        steps = max(1, epochs * len(known))
        for _ in range(epochs):
            for k in rng.permutation(len(known)):
                at, w = share[k]
                step = np.float32(rate * (1 - done / steps))
                rows = table[at]
                mean = w @ rows
                z = out @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                pull = p @ out
                out -= step * np.outer(p, mean)
                bias -= step * np.float32(0.1) * p
                table[at] = rows - (step * w)[:, None] * pull
                done += 1
        #: What a bucket adds to label 1 against label 0, and what an empty text has.
        self.weight = (table @ (out[1] - out[0])).astype(np.float64)
        self.start = float(bias[1] - bias[0])

    def scores(self, texts: list[str | None], window: int = WINDOW) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for owner, bucket in features(texts, self.bits, self.grams, window):
            total += np.bincount(owner, weights=self.weight[bucket], minlength=len(texts))
            n += np.bincount(owner, minlength=len(texts))
        z = self.start + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_TEXTS) -> Model | None:
    """A model from the whole texts of at most ``sample`` labelled rows, those whose text and
    label hash lowest (of rows equal in both, one); None where no row has a label of 0 or 1.
    Texts become bags in the tasks; the driver gets at most ``sample`` of them."""
    said = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("label")).where("i IS NOT NULL AND label IN (0, 1)").distinct()
    known = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # ids and hashes meet first; texts travel only for the rows that are drawn
    drawn = known.select("i", "h").distinct().join(said, "i").groupBy("h", "label").agg(F.min("i").alias("i")).withColumn("order", F.xxhash64("h", "label")).orderBy("order", "h", "label").limit(sample)
    picked = known.join(F.broadcast(drawn.select("i", "h", "label")), ["i", "h"]).dropDuplicates(["i", "h", "label"]).select("h", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = bags(part.column(2).to_pylist())
                columns = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["h", "label", "at", "n"])

    got = picked.mapInArrow(run, "h bigint, label int, at array<int>, n array<int>").toArrow()
    if not got.num_rows:
        return None
    order = np.lexsort((got.column("label").to_numpy(), got.column("h").to_numpy()))
    at, n = got.column("at"), got.column("n")
    # a text without words has an empty bag, from which the bias learns
    return Model([(at[int(k)].values.to_numpy(), n[int(k)].values.to_numpy()) for k in order], got.column("label").to_numpy()[order])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_TEXTS) -> DataFrame:
    """id, held_out, score (probability of label 1), predicted (1 if score >= 0.5) for each row.

    Learns from labelled rows that are not held out; nothing but the text enters a score.
    Null and empty texts get the score of an empty bag, and where nothing is labelled all
    get 0.5.  A null id is not held out and has no label; repeated rows get equal scores; an
    empty table gives no rows; other columns are ignored."""
    model = fit(docs.where(~held_out(id_col)), labels, id_col, text_col, label_col, sample)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if model is None:
        scored = texts.select("id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1).to_pylist()))], ["id", "score"])

        scored = texts.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
