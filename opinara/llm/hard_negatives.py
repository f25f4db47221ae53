"""Hard-negative mining by product quantisation with stored residual norms.

Vectors are cut into subspaces of two dimensions, each with a codebook fitted on a bounded
sample.  Every row keeps its codes and the norm of what they leave over.  An anchor's tables
of inner products with all centres give a score for each row by look-ups; the true score lies
within residual norm times anchor norm of it (and a slack for rounding), so a row whose
interval cannot reach a window is left out for certain.  Exact integer products of the rows
that remain complete each window.

Rows are dealt into blocks of equal size, anchors too, and each pair of blocks meets in one
task; a task returns at most its best few rows for each anchor, and Spark ranks those.  The
first round finds the positives; their exact scores are the windows of the second.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.llm.vectors import common_length, dots, matrix, scaled, whole
from opinara.session import cut, stored

#: floor(SCALE * component) is the integer that stands for a component.
SCALE = 256
#: Bounds of the codebook's fit: rows of the sample, centres of a subspace, rounds.
SAMPLE = 2048
CENTRES = 256
ROUNDS = 5
WIDTH = 2
#: Rows and anchors of a block, and anchors whose look-ups are added at once.
ROWS_PER_BLOCK = 1 << 15
ANCHORS_PER_BLOCK = 1 << 15
TOGETHER = 64
#: Rows whose products fit into a processor's cache.
CHUNK = 1 << 10


class Codebook:
    """Centres of each subspace, fitted by Lloyd's rounds on a sample."""

    def __init__(self, sample: np.ndarray, width: int = WIDTH, centres: int = CENTRES, rounds: int = ROUNDS):
        self.dims = sample.shape[1]
        self.cuts = [slice(at, min(at + width, self.dims)) for at in range(0, self.dims, width)]
        self.centres = []
        for part in self.cuts:
            x = sample[:, part].astype(float)
            c = np.unique(x, axis=0)
            c = c[np.random.default_rng(len(c)).permutation(len(c))[:centres]]
            for _ in range(rounds):
                near = self._nearest(x, c)
                n = np.bincount(near, minlength=len(c))
                total = np.stack([np.bincount(near, weights=x[:, k], minlength=len(c)) for k in range(x.shape[1])], axis=1)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            self.centres.append(c)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        half, turned = (c**2).sum(axis=1) / 2, np.ascontiguousarray(c.T)
        return np.concatenate([(half - x[at : at + CHUNK] @ turned).argmin(axis=1) for at in range(0, len(x), CHUNK)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row, one byte a subspace, and the norm of the row minus its centres."""
        codes, left = np.zeros((len(x), len(self.cuts)), np.uint8), np.zeros(len(x))
        for m, (part, c) in enumerate(zip(self.cuts, self.centres)):
            own = x[:, part].astype(float)
            codes[:, m] = self._nearest(own, c)
            left += ((own - c[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left)

    def tables(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Of each subspace: inner products of its centres (rows) with the anchors (columns)."""
        return [(c @ anchors[:, part].astype(float).T) for part, c in zip(self.cuts, self.centres)]


def intervals(book: Codebook, codes: np.ndarray, left: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score that each anchor (row) may have with each coded vector (column)."""
    tables = book.tables(anchors)
    single = [t.astype(np.float32) for t in tables]
    score = np.empty((len(anchors), len(codes)), np.float32)
    for at in range(0, len(codes), CHUNK):
        some = codes[at : at + CHUNK]
        total = np.zeros((len(some), len(anchors)), np.float32)
        for m, t in enumerate(single):
            total += t[some[:, m]]
        score[:, at : at + CHUNK] = total.T
    # what single precision can lose in the tables, their sum and the bounds
    most = sum(np.abs(t).max(axis=0) for t in tables)
    norm = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
    reach = norm[:, None] * left[None, :] * (1 + 2.0**-20) + ((len(tables) + 8) * 2.0**-23 * most)[:, None]
    reach = reach.astype(np.float32)
    return score - reach, score + reach


def _block(table: pa.Table, dims: int) -> tuple[np.ndarray, ...]:
    """Row number, id, label and vector of a block's rows."""
    return (*(table.column(c).to_numpy() for c in ("rid", "id", "label")), matrix(table.column("x"), dims))


def _best(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rids, ids, -scores))[:k]


def _codes(rows: pa.Table, subspaces: int) -> np.ndarray:
    flat = b"".join(rows.column("codes").to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(rows.num_rows, subspaces).astype(np.intp)


def _positives(book: Codebook, k: int):
    """Of each anchor of a block, its ``k`` best other rows of the same label in a block of rows."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if rows.num_rows and anchors.num_rows:
            rid, ids, label, x = _block(rows, book.dims)
            codes, left = _codes(rows, len(book.cuts)), rows.column("left").to_numpy()
            arid, _, alabel, ax = _block(anchors, book.dims)
            for one in np.unique(alabel):
                here, asked = np.nonzero(label == one)[0], np.nonzero(alabel == one)[0]
                if not len(here):
                    continue
                for at in range(0, len(asked), TOGETHER):
                    some = asked[at : at + TOGETHER]
                    low, high = intervals(book, codes[here], left[here], ax[some])
                    # one more than k, as the anchor itself may be among them
                    least = np.partition(low, -k - 1, axis=1)[:, -k - 1] if len(here) > k else np.full(len(some), -np.inf, np.float32)
                    for b, a in enumerate(some):
                        found = here[high[b] >= least[b]]
                        found = found[rid[found] != arid[a]]
                        score = dots(x[found], ax[a])
                        top = _best(score, ids[found], rid[found], k)
                        out.append([np.full(len(top), arid[a]), ids[found[top]], rid[found[top]], score[top]])
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("arid", "positive_id", "positive_rid", "positive_score"), columns)})

    return run


def _negatives(book: Codebook, k: int, low_pct: int, high_pct: int):
    """Of each anchor and positive, the ``k`` best rows of other labels within its window in a block of rows."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if rows.num_rows and anchors.num_rows:
            rid, ids, label, x = _block(rows, book.dims)
            codes, left = _codes(rows, len(book.cuts)), rows.column("left").to_numpy()
            arid, _, alabel, ax = _block(anchors, book.dims)
            asked = anchors.column("found").to_pylist()
            for at in range(0, len(arid), TOGETHER):
                lows, highs = intervals(book, codes, left, ax[at : at + TOGETHER])
                for b, (low, high) in enumerate(zip(lows, highs), at):
                    same = label == alabel[b]
                    low[same], high[same] = -np.inf, -np.inf
                    # 100 * score within low_pct and high_pct times the positive's
                    windows = [(p["n"], -(-low_pct * p["score"] // 100), high_pct * p["score"] // 100) for p in asked[b]]
                    windows = [w for w in windows if w[1] <= w[2]]
                    may = np.zeros(len(rid), bool)
                    for _, least, most in windows:
                        sure = low[(low >= least) & (high <= most)]
                        floor = max(least, np.partition(sure, -k)[-k]) if len(sure) >= k else least
                        may |= (high >= floor) & (low <= most)
                    found = np.nonzero(may)[0]
                    if not len(found):
                        continue
                    score = dots(x[found], ax[b])
                    for n, least, most in windows:
                        inside = np.nonzero((score >= least) & (score <= most))[0]
                        top = inside[_best(score[inside], ids[found[inside]], rid[found[inside]], k)]
                        out.append([np.full(len(top), arid[b]), np.full(len(top), n), ids[found[top]], rid[found[top]], score[top]])
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("arid", "n", "negative_id", "negative_rid", "negative_score"), columns)})

    return run


def _ranked(rows: DataFrame, by: list[str], what: str, k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(f"{what}_score"), f"{what}_id", f"{what}_rid")
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95,
    scale: int = SCALE, rows_per_block: int = ROWS_PER_BLOCK, anchors_per_block: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (rows where ``anchor`` holds) and each of its first ``positives`` other rows
    of the same label, the first ``negatives`` rows of other labels whose score is between
    ``low_pct`` and ``high_pct`` per cent of the positive's.  Scores are inner products of
    floor(scale * x); higher ones come first, ties by smaller id.  ids and labels are integers.

    Rows without an id or label, or whose vector is null, holds a null or non-finite entry or
    has another length than most, take no part.  A repeated row is a row of its own: it is
    another row for its copies, and an anchor as often as it occurs.  An anchor without
    positives or negatives gives no rows, nor does an empty table.  Other columns are ignored.
    """
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark = rows.sparkSession
    known = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), F.col(f"`{vec_col}`").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole("v")).select("id", "label", "anchor", scaled("v", scale).alias("x"))
    dims = common_length(known)
    if not dims:
        return spark.createDataFrame([], schema)
    known = known.where(F.size("x") == dims)
    sample = known.select("x", F.xxhash64("id", "x").alias("h")).orderBy("h", "x").limit(SAMPLE).toPandas()
    book = spark.sparkContext.broadcast(Codebook(np.stack(sample["x"].to_numpy()).astype(np.int64)))

    def encode(batches):
        for batch in batches:
            codes, left = book.value.encode(matrix(batch.column(3), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], ["id", "label", "anchor", "x", "codes", "left"])

    # row numbers are written with the rows, so all later reads agree on them
    numbered = stored(known.mapInArrow(encode, "id bigint, label bigint, anchor boolean, x array<bigint>, codes binary, left double").withColumn("rid", F.monotonically_increasing_id()))
    count = numbered.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).first()
    # blocks are of equal size whatever ids and labels are; their number grows with the rows
    row_blocks = max(math.ceil(count["n"] / rows_per_block), min(4 * spark.sparkContext.defaultParallelism, math.ceil(count["n"] / 256)), 1)
    anchor_blocks = max(math.ceil(count["a"] / anchors_per_block), 1)
    every = numbered.withColumn("p", F.col("rid") % row_blocks).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    asked = cut(numbered.where("anchor").select("rid", "id", "label", "x"))

    def met(anchors: DataFrame, work, result: str) -> DataFrame:
        dealt = anchors.withColumn("q", F.pmod(F.xxhash64("rid"), F.lit(anchor_blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint"))))
        return every.drop("anchor").groupBy("p", "q").cogroup(dealt.groupBy("p", "q")).applyInArrow(work, result)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        return _positives(book.value, positives)(left, right)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        return _negatives(book.value, negatives, low_pct, high_pct)(left, right)

    near = _ranked(met(asked, first, "arid bigint, positive_id bigint, positive_rid bigint, positive_score bigint"), ["arid"], "positive", positives, "n")
    near = cut(near.select("arid", F.col("n").cast("bigint").alias("n"), "positive_id", "positive_score"))
    windows = near.groupBy("arid").agg(F.collect_list(F.struct("n", F.col("positive_score").alias("score"))).alias("found"))
    far = _ranked(met(asked.join(windows, asked["rid"] == windows["arid"]).drop("arid"), second, "arid bigint, n bigint, negative_id bigint, negative_rid bigint, negative_score bigint"), ["arid", "n"], "negative", negatives, "rank")
    named = asked.select(F.col("rid").alias("arid"), F.col("id").alias("anchor_id"))
    return far.join(near, ["arid", "n"]).join(named, "arid").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
