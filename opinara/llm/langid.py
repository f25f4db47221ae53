"""Language ID by prediction by partial matching.

Each language has a context tree of variable order over bytes with PPM-C escape
probabilities, fitted on a bounded sample of rows and then frozen; a text's score under a
language is its exact code length in bits.  What follows each context is counted by Spark
over the whole texts of the sample; the driver gets the counts of the contexts that the
trees keep, the most frequent ones of each language.  The trees share one topology (the
contexts that some language keeps), so that one walk per byte, newest byte first, finds
the context and one lookup gives the cost in all languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.session import cut

#: Bounds of the fit: rows per language, order, contexts per language and order.
SAMPLE_TEXTS = 400
ORDER = 4
CONTEXTS = 1024
#: A context's code has one digit for each byte: 0 before the text, else the byte + 1.
BASE = 257
SLICE = 64
LETTER = re.compile(r"[^\W\d_]")


#: Of one order: (context, next class, language, count); codes are numbers in BASE, the newest class lowest.
Counts = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (byte + 1) of the texts, each after ``order`` zeros; which are real; and their places."""
    pad = bytes(order)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64) + 1
    real = np.ones(len(data), bool)
    at = 0
    for t in texts:
        real[at : at + order] = False
        at += order + len(t)
    data[~real] = 0
    return data, real, np.nonzero(real)[0]


def counts_of(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order up to ``order``: (context, next class, count)."""
    data, _, at = _codes(texts, order)
    code, out = np.zeros(len(data), np.int64), []
    for m in range(order + 1):
        if m:
            code[m:] += data[:-m] * BASE ** (m - 1)
        gram, n = np.unique(code[at] * BASE + data[at], return_counts=True)
        out.append((gram // BASE, gram % BASE, n))
    return out


class Model:
    """Frozen code lengths: child[state, byte class] and cost[node, byte class, language]."""

    def __init__(self, langs: list[str], counts: Counts):
        """counts: of each order; a context of order m + 1 has its newest m classes among those of order m."""
        self.langs, self.order = langs, len(counts) - 1
        seen = np.unique(np.concatenate([x[1] for x in counts]))
        self.classes = np.zeros(BASE, np.int64)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        # 0 is a byte that was never seen, the last class stands before a text
        self.classes[0] = len(seen) + 1
        k = self.k = len(seen) + 2
        contexts = [np.unique(x[0]) if len(x[0]) else np.zeros(int(m == 0), np.int64) for m, x in enumerate(counts)]
        for m in range(2, len(contexts)):
            contexts[m] = contexts[m][np.isin(contexts[m] % BASE ** (m - 1), contexts[m - 1])]
        base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        nodes = self.nodes = int(base[-1])
        # a state beyond the nodes is a node whose walk has ended
        self.child = np.concatenate([np.arange(nodes, 2 * nodes), np.arange(nodes, 2 * nodes)]).astype(np.int32)[:, None].repeat(k, axis=1)
        self.cost = np.zeros((nodes, k, len(langs)), np.float32)
        for m, ctx in enumerate(contexts):
            if m:
                up = base[m - 1] + np.searchsorted(contexts[m - 1], ctx % BASE ** (m - 1))
                self.child[up, self.classes[ctx // BASE ** (m - 1)]] = base[m] + np.arange(len(ctx))
                below = self.cost[up].astype(float)
            else:
                below = np.full((1, k, len(langs)), np.log2(len(seen) + 1))
            if not len(ctx):
                continue
            c, symbol, lang, count = counts[m]
            row = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            ok = ctx[row] == c
            row, symbol, lang, count = row[ok], self.classes[symbol[ok]], lang[ok], count[ok]
            n, kinds = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
            np.add.at(n, (row, lang), count)
            np.add.at(kinds, (row, lang), 1)
            # what a context has not seen costs its escape and the shorter context's length
            escape = np.where(n > 0, np.log2((n + kinds) / np.maximum(kinds, 1), where=n > 0, out=np.zeros_like(n)), 0)
            own = below + escape[:, None, :]
            own[row, symbol, lang] = np.log2((n + kinds)[row, lang] / count)
            self.cost[base[m] : base[m + 1]] = own

    def _joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte classes of the texts, each after ``order`` zeros, and which are real."""
        data, real, _ = _codes(texts, self.order)
        return self.classes[data], real

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        data, real = self._joined(texts)
        at = np.nonzero(real)[0]
        ends = np.cumsum([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for lo in range(0, len(at), 1 << 18):
            here = at[lo : lo + (1 << 18)]
            state = np.zeros(len(here), np.int32)
            for m in range(1, self.order + 1):
                state = self.child[state, data[here - m]]
            state[state >= self.nodes] -= self.nodes
            cost = self.cost[state, data[here]]
            mine = owner[lo : lo + (1 << 18)]
            first = np.concatenate([[0], np.nonzero(np.diff(mine))[0] + 1])
            out[mine[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
        assert not len(ends) or ends[-1] == len(at)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits = self.bits([(t or "").encode() for t in texts])
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        lettered = [bool(t and LETTER.search(t)) for t in texts]
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], [float(s) if ok else 0.0 for s, ok in zip(share, lettered)]


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_TEXTS, order: int = ORDER, contexts: int = CONTEXTS) -> Model:
    """A model from the whole texts of at most ``sample`` rows of each language (those whose id
    and text hash lowest; of repeated rows one).  The driver gets the counts of at most
    ``contexts`` contexts of each language and order, the most frequent ones."""
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("id", "h"), "id", "h")
    text = F.col(f"`{text_col}`")
    known = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    chosen = known.select("id", "lang", "h").distinct().withColumn("k", F.row_number().over(lowest)).where(F.col("k") <= sample).select(F.col("id").alias("i"), "lang", "h")
    picked = known.join(F.broadcast(chosen), ["lang", "h"]).where(F.col("id").eqNullSafe(F.col("i"))).dropDuplicates(["lang", "id", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                by: dict[str, list[bytes]] = {}
                for lang, t in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    by.setdefault(lang, []).append(t.encode())
                for lang, many in by.items():
                    for m, (c, symbol, n) in enumerate(counts_of(many, order)):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(np.full(len(c), m, np.int32)), pa.array(c), pa.array(symbol.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "m", "c", "s", "n"])

    grams = cut(picked.mapInArrow(count, "lang string, m int, c bigint, s int, n bigint").groupBy("lang", "m", "c", "s").agg(F.sum("n").alias("n")))
    often = Window.partitionBy("lang", "m").orderBy(F.desc("total"), "c")
    kept = grams.groupBy("lang", "m", "c").agg(F.sum("n").alias("total")).withColumn("k", F.row_number().over(often)).where(F.col("k") <= contexts).select("m", "c").distinct()
    got = grams.join(F.broadcast(kept), ["m", "c"]).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    number = got["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)
    m, c, symbol, n = (got[x].to_numpy(np.int64) for x in ("m", "c", "s", "n"))
    return Model(langs, [tuple(x[m == level] for x in (c, symbol, number, n)) for level in range(order + 1)])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred (``und`` for a null text or one without a letter), score: the share
    of the best language when code lengths are read as probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                langs, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Learns from rows that are not held out and have a language and a text.  Null texts
    are ``und`` with score 0, as is everything when there is nothing to learn from; a
    null id counts as not held out; ties go to the first language by name.  Repeated
    rows get equal answers; other columns are ignored.
    """
    out = F.coalesce(held_out(id_col), F.lit(False))
    model = fit(docs.where(~out), id_col, text_col, lang_col)
    got = predict(docs, model, id_col, text_col)
    return got.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")
