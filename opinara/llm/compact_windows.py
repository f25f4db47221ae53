"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles, in which a word that is repeated counts five
times at most.  Under a hash function a Cartesian tree over
the shingles' hashes gives, for each node that is the minimum of some window of a given
width, its compact window (l, c, r): every subsequence inside [l, r] that holds c has the
hash at c as its min-hash.

Two stretches of WIDTH shingles with a Jaccard similarity of SIMILAR share so many
shingles that, as one changed word breaks SHINGLE - 1 neighbours at least, a run of
``run_of`` consecutive ones is common to both.  Equal runs have equal min-hashes, so with
windows as wide as that run no pair is lost, whatever the hash functions are:

1. the compact windows of the first function meet by min-hash over all texts; those that
   no other text has drop out.  Windows whose surroundings (WIDTH - 1 shingles to either
   side) are equal are one class, linked through their smallest id;
2. where classes of one min-hash differ, an interval join with the compact windows of the
   other functions cuts each representative's windows into segments of one signature;
   representatives meet by signature, in groups too large by the exact runs in it;
3. pairs that meet are verified on their surroundings, shingle by shingle.

Links join documents into classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.llm.graph import connected_components
from opinara.session import cut, drop_stored, stored

SHINGLE = 5
#: 46 shingles of five words span 50 words.
WIDTH = 46
FUNCTIONS = 4
SIMILAR = 0.8
SLICE = 64
#: Members of a signature that meet as they are; larger groups are split by the exact runs.
SPLIT = 256
#: Members of a run that are compared in one group; larger groups are dealt out in pairs of chunks.
CHUNK = 8192
#: Rows whose groups are compared together, and pairs of surroundings at once.
TOGETHER = 4096
COMPARED = 256
BROADCAST_BYTES = 24 << 20
_BASE = 0x9E3779B97F4A7C15


def shingles(text: str | None) -> np.ndarray:
    """64-bit hash of each run of five words, A-Z in lower case.  A shingle that equals the
    one before adds nothing to a set and is left out: a word repeated more than five times
    in a row counts five times."""
    words = (text or "").encode().lower().split()
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    one = np.fromiter(map(digest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(_BASE) + one[k : k + n]
    out = out[np.append(True, out[1:] != out[:-1])]
    return out ^ (out >> np.uint64(31))


def share_of(width: int, similar: float) -> int:
    """Shingles that two stretches of ``width`` have in common at least, at a Jaccard similarity of ``similar``."""
    return math.ceil(2 * similar / (1 + similar) * width - 1e-9)


def run_of(width: int, similar: float) -> int:
    """Consecutive shingles that they have in common at least: a break inside costs SHINGLE - 1 or more."""
    share = share_of(width, similar)
    return math.ceil(share / ((width - share) // (SHINGLE - 1) + 1))


def _mixed(values: np.ndarray, function: int) -> np.ndarray:
    out = values ^ np.uint64((0xA24BAED4963EE407 * (function + 1)) % (1 << 64))
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(27))


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree nodes whose window [l, r] has ``width`` elements or more.

    Those nodes are the minima of windows of ``width``; as they are the top of the
    tree, their extents need no other node.  Of equal values the left one is smaller.
    """
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    key = (values >> np.uint64(24) << np.uint64(24)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFF))
    low, span = key, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n - width + 1], low[width - span :][: n - width + 1])
    # each window's minimum knows its place in the low bits, and places never go back
    start = np.arange(len(low))
    place = start + ((low.view(np.int64) - start) & 0xFFFFFF)
    nodes = place[np.append(True, place[1:] != place[:-1])]
    height = key[nodes].tolist()
    left, right, stack = [0] * len(nodes), [n - 1] * len(nodes), []
    where = nodes.tolist()
    for k, h in enumerate(height):
        while stack and height[stack[-1]] > h:
            right[stack.pop()] = where[k] - 1
        left[k] = where[stack[-1]] + 1 if stack else 0
        stack.append(k)
    return np.array(left), nodes, np.array(right)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class Digests:
    """Digests of stretches [lo, hi) of a sequence, from sums of its prefixes."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(max(1 << 16, 1 << (len(values) + 1).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[hi] - self.sums[lo]) * self.down[lo], 7)


def _batch(columns: list[list[np.ndarray]], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), t) for x, t in zip(columns, kinds)], names)


def _windows(docs: DataFrame, width: int, run: int) -> DataFrame:
    """(v, id, c, after, d) of the compact windows of the first function: min-hash (48 bits, as it
    only brings windows together), place, shingles of the surroundings after it, and a digest of
    the surroundings (64 bits, as windows equal in v and d are linked without a further look)."""
    names, kinds = ["v", "id", "c", "after", "d"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out: list[list[np.ndarray]] = [[] for _ in names]
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    each = shingles(text)
                    if len(each) < width:
                        continue
                    value = _mixed(each, 0)
                    _, c, _ = compact_windows(value, run)
                    hi = np.minimum(c + width, len(each))
                    d = Digests(each).of(np.maximum(c - width + 1, 0), hi)
                    for column, x in zip(out, ((value[c] >> np.uint64(16)).astype(np.int64), np.full(len(c), i), c, hi - 1 - c, d.view(np.int64))):
                        column.append(x)
                if out[0]:
                    yield _batch(out, names, kinds)

    return docs.mapInArrow(work, "v bigint, id bigint, c int, after int, d bigint")


def segments(each: np.ndarray, at: np.ndarray, run: int, functions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of the functions' compact windows: (c, first, last, signature) of the
    segments of starts in which every window of ``run`` has the same minima, for the
    windows of the first function whose place is in ``at``."""
    firsts, minima = [], []
    for f in range(functions):
        value = _mixed(each, f)
        l, c, _ = compact_windows(value, run)
        firsts.append(np.maximum(l, c - run + 1))
        minima.append(value[c])
        if not f:
            places = c
    cuts = np.unique(np.concatenate(firsts))
    owners = [np.searchsorted(x, cuts, side="right") - 1 for x in firsts]
    pick = np.nonzero(np.isin(places[owners[0]], at))[0]
    signature = np.zeros(len(pick), np.uint64)
    for f in range(functions):
        signature = _mixed(signature * np.uint64(_BASE) + minima[f][owners[f][pick]], 3)
    last = np.append(cuts[1:], len(each) - run + 1) - 1
    return places[owners[0][pick]], cuts[pick], last[pick], signature


def _surroundings(docs: DataFrame, width: int, run: int, functions: int) -> DataFrame:
    """Of rows (id, text, at): (id, c, low, s, sig, first, last) for each place c in ``at``: the
    surroundings' first shingle and their shingles (32 bits each), and of each segment the
    signature and its first and last start."""
    names = ["id", "c", "low", "s", "sig", "first", "last"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                flat: list[list[np.ndarray]] = [[] for _ in range(7)]
                sizes: list[list[np.ndarray]] = [[], []]
                for i, text, at in zip(*(x.to_pylist() for x in part.columns)):
                    each = shingles(text)
                    place, first, last, signature = segments(each, np.array(at), run, functions)
                    c, begin = np.unique(place, return_index=True)
                    low, high = np.maximum(c - width + 1, 0), np.minimum(c + width, len(each))
                    short = (each >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    around = [short[a:b] for a, b in zip(low.tolist(), high.tolist())]
                    for column, x in zip(flat, (np.full(len(c), i), c, low, np.concatenate([short[:0], *around]), signature.view(np.int64), first, last)):
                        column.append(x)
                    sizes[0].append(high - low)
                    sizes[1].append(np.diff(np.append(begin, len(place))))
                if flat[0]:
                    one = [np.concatenate(x) for x in flat]
                    ends = [pa.array(np.concatenate([[0], np.cumsum(np.concatenate(x))]).astype(np.int32)) for x in sizes]
                    lists = [pa.ListArray.from_arrays(ends[0 if k == 3 else 1], pa.array(one[k])) for k in range(3, 7)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in one[:3]), *lists], names)

    return docs.mapInArrow(work, "id bigint, c bigint, low bigint, s array<int>, sig array<bigint>, first array<bigint>, last array<bigint>")


def extents(x: np.ndarray, y: np.ndarray, width: int, share: int) -> tuple[np.ndarray, ...]:
    """Of pairs of rows of x and y: first and last element of x in windows of ``width`` of
    which at least ``share`` occur in y, then those of y in x; -1 where there is none.
    Rows are filled up with negative numbers that occur on one side only."""
    same = x[:, :, None] == y[:, None, :]
    out = []
    for hit in (same.any(axis=2), same.any(axis=1)):
        total = np.zeros((len(x), hit.shape[1] + 1), np.int32)
        np.cumsum(hit, axis=1, out=total[:, 1:])
        good = total[:, width:] - total[:, :-width] >= share
        some = good.any(axis=1)
        out.append(np.where(some, good.argmax(axis=1), -1))
        out.append(np.where(some, good.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + width - 1, -1))
    return tuple(out)


def linked(ids: np.ndarray, rows: np.ndarray, sizes: np.ndarray, group: np.ndarray, width: int, share: int) -> list[tuple[int, ...]]:
    """(i, j, i_lo, i_hi, j_lo, j_hi): verified pairs of rows of one group with different ids,
    without those that earlier ones join already.

    rows: the surroundings' shingles, of which row k has ``sizes[k]``; group: ascending."""
    n, out = len(ids), []
    inside = np.arange(rows.shape[1]) < sizes[:, None]
    # shingles lose their sign, so that what fills rows up is like nothing else
    left, right = (np.where(inside, rows & 0x7FFFFFFF, fill) for fill in (np.int32(-1), np.int32(-2)))
    ends = np.searchsorted(group, group, side="right")
    begins = np.searchsorted(group, group)
    tree, missing = np.arange(n), ends - begins - 1
    leader = np.unique(begins)
    while len(leader := leader[(leader + 1 < ends[leader]) & (missing[begins[leader]] > 0)]):
        # each round compares one row of every group with the rows behind it
        i = np.repeat(leader, ends[leader] - leader - 1)
        j = np.concatenate([np.arange(a + 1, b) for a, b in zip(leader.tolist(), ends[leader].tolist())])
        apart = (ids[i] != ids[j]) & (tree[i] != tree[j])
        i, j = i[apart], j[apart]
        for lo in range(0, len(i), COMPARED):
            a, b = i[lo : lo + COMPARED], j[lo : lo + COMPARED]
            p = extents(left[a], right[b], width, share)
            for k in np.nonzero((p[0] >= 0) & (p[2] >= 0))[0].tolist():
                u, v = int(a[k]), int(b[k])
                if tree[u] == tree[v]:
                    continue
                out.append((u, v, *(int(x[k]) for x in p)))
                mine = tree[begins[u] : ends[u]]
                mine[mine == tree[v]] = tree[u]
                missing[begins[u]] -= 1
        leader = leader + 1
    return out


def _verified(met: DataFrame, width: int, share: int) -> DataFrame:
    """Spanning links of the groups (sig, run, lo, hi) of rows (id, low, s)."""
    order = ["sig", "run", "lo", "hi"]
    names = ["a", "b", "a_lo", "a_hi", "b_lo", "b_hi"]
    wide = 2 * width - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(cols: list[np.ndarray], new: np.ndarray) -> pa.RecordBatch:
            ids, low, sizes, rows = cols[4:]
            got = linked(ids, rows, sizes, np.cumsum(new), width, share)
            i, j, *at = (np.array(x, np.int64) for x in zip(*got)) if got else [np.zeros(0, np.int64)] * 6
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ids[j], low[i] + at[0], low[i] + at[1], low[j] + at[2], low[j] + at[3])], names)

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
            sizes = pa.compute.list_value_length(batch.column(6)).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.zeros((len(sizes), wide), np.int32)
            rows[np.arange(wide) < sizes[:, None]] = batch.column(6).flatten().to_numpy(zero_copy_only=False)
            cols += [sizes, rows]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = False
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            # groups stay whole; many small ones are compared together
            at = np.nonzero(new)[0]
            done = 0
            for stop in at[1:].tolist():
                if stop - done >= TOGETHER or stop == at[-1]:
                    yield compare([c[done:stop] for c in cols], new[done:stop])
                    done = stop
            held = [c[done:].copy() for c in cols]
        if held is not None and len(held[0]):
            new = np.zeros(len(held[0]), bool)
            yield compare(held, new)

    rows = met.select(*order, "id", "low", "s").repartition(*order).sortWithinPartitions(*order, "id", "low")
    return rows.mapInArrow(work, ", ".join(f"{x} bigint" for x in names))


def _sized(table: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def _first_of_sets(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (id, c, k, key) whose key two documents or more have, with n, its number of
    rows.  Of a place's keys that the same places share, the first by k is enough."""
    mark = F.sum(F.xxhash64("id", "c") % (1 << 40)).alias("set")
    whole = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y"), mark).where("x < y").select(key, "n", "set")
    before = F.lag("set").over(Window.partitionBy("id", "c").orderBy("k"))
    return rows.join(whole, key).withColumn("before", before).where("before IS NULL OR before <> set").drop("before", "set")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, functions: int = FUNCTIONS, similar: float = SIMILAR, split: int = SPLIT, chunk: int = CHUNK) -> DataFrame:
    """(a, b, a_lo, a_hi, b_lo, b_hi): shingle intervals of two documents that are nearly
    equal; at least a spanning forest of all such pairs."""
    run, share = run_of(width, similar), share_of(width, similar)
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    windows = stored(_windows(read, width, run))
    again = stored(windows.groupBy("v").count().where("count > 1").select("v"))
    shared = stored(windows.join(_sized(again, 48), "v"))
    drop_stored(windows)
    drop_stored(again)
    classes = stored(shared.groupBy("v", "d").agg(F.min(F.struct("id", "c", "after")).alias("first"), F.max("id").alias("last")).select("v", "d", "first.*", "last"))
    copies = classes.where("id < last").select("v", "d", F.col("id").alias("b"), F.col("c").alias("b_c"))
    lo = lambda c: F.greatest(F.col(c) - (width - 1), F.lit(0))
    equal = cut(
        shared.join(copies, ["v", "d"]).where("id <> b")
        .select(F.col("id").alias("a"), "b", lo("c").alias("a_lo"), (F.col("c") + F.col("after")).alias("a_hi"), lo("b_c").alias("b_lo"), (F.col("b_c") + F.col("after")).alias("b_hi"))
        .select(*[F.col(x).cast("long").alias(x) for x in ("a", "b", "a_lo", "a_hi", "b_lo", "b_hi")])
        .distinct()
    )
    drop_stored(shared)
    unlike = classes.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("n > 1 AND x < y").select("v")
    wanted = classes.join(unlike, "v").select("id", "c").distinct().groupBy("id").agg(F.collect_list("c").alias("at"))
    around = stored(_surroundings(read.join(wanted, "id").select("id", "text", "at"), width, run, functions))
    drop_stored(classes)
    # a repeated id is one document: of its rows one stays
    each = around.select("id", "c", F.posexplode(F.arrays_zip("sig", "first", "last")).alias("k", "x")).select("id", "c", "k", "x.*").dropDuplicates(["id", "c", "k"])
    keyed = stored(_first_of_sets(each, "sig"))
    # not so here: a row more of the same document is never compared with it
    texts = around.select("id", "c", "low", "s")
    zero = F.lit(0).cast("long")
    few = keyed.where(F.col("n") <= split).select("sig", zero.alias("run"), zero.alias("lo"), zero.alias("hi"), "id", "c")
    exact = F.transform(F.sequence("first", "last"), lambda k: F.xxhash64(F.slice("s", (k - F.col("low") + 1).cast("int"), F.lit(run))))
    hot = keyed.where(F.col("n") > split).join(texts, ["id", "c"]).select("id", "c", "first", F.posexplode(exact).alias("k", "run"))
    runs = stored(_first_of_sets(hot.withColumn("k", F.col("first") + F.col("k")), "run"))
    whole = runs.where(F.col("n") <= chunk).select(zero.alias("sig"), "run", zero.alias("lo"), zero.alias("hi"), "id", "c")
    met = runs.where(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("p", F.pmod(F.xxhash64("id", "c"), F.col("chunks")))
    many = met.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(zero.alias("sig"), "run", F.least("p", "q").cast("long").alias("lo"), F.greatest("p", "q").cast("long").alias("hi"), "id", "c")
    near = cut(_verified(few.unionByName(whole).unionByName(many).join(texts, ["id", "c"]), width, share))
    drop_stored(keyed)
    drop_stored(runs)
    drop_stored(around)
    return equal.unionByName(near)


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, functions: int = FUNCTIONS, similar: float = SIMILAR) -> DataFrame:
    """One row per input row: id, class_id (smallest id reachable by links, its own without
    one), n_passages (maximal runs of words that are nearly repeated in another document, as
    far as the links found show) and n_words (words in them).

    Texts are linked where ``width`` consecutive shingles of each have a Jaccard similarity
    of ``similar``, or as many common shingles within the surroundings of a common run.  Null
    ids have a null class; null texts, and texts that are too short, have no passages; rows
    that repeat an id are one document; other columns are ignored; an empty table gives no rows.
    """
    got = passages(docs, id_col, text_col, width, functions, similar)
    kinds = connected_components(got.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    words = lambda x: got.select(F.col(x).alias("id"), F.col(f"{x}_lo").alias("lo"), (F.col(f"{x}_hi") + SHINGLE).alias("hi"))
    ends = words("a").unionByName(words("b"))
    runs = F.expr(
        "aggregate(array_sort(collect_list(struct(lo, hi))), named_struct('end', -1L, 'n', 0L, 'words', 0L), (s, x) -> CASE WHEN x.lo > s.end "
        "THEN named_struct('end', x.hi, 'n', s.n + 1, 'words', s.words + x.hi - x.lo) "
        "WHEN x.hi > s.end THEN named_struct('end', x.hi, 'n', s.n, 'words', s.words + x.hi - s.end) ELSE s END)"
    )
    per = ends.distinct().groupBy("id").agg(runs.alias("r"))
    found = per.join(kinds.withColumnRenamed("node", "id"), "id").select(F.col("id").alias("_id"), "component", "r")
    rows = docs.select(F.col(f"`{id_col}`").alias("id")).join(found, F.col("id").cast("long") == F.col("_id"), "left")
    none = F.lit(0).cast("long")
    return rows.select(F.col("id").alias(id_col), F.coalesce("component", F.col("id").cast("long")).alias("class_id"), F.coalesce("r.n", none).alias("n_passages"), F.coalesce("r.words", none).alias("n_words"))
