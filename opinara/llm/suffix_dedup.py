"""Substring dedup by longest-previous-factor arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller
id, or earlier in the same text) is removed.  Each string of that length has a
minimizer, the k-gram of smallest hash in it; equal strings have equal minimizers, so
strings meet by minimizer.  Surroundings of a minimizer that are equal from end to end
are settled by their digests; the texts of the others meet in tasks, each of which builds a
suffix array of its strings by prefix doubling (cut at ``length`` bytes) and from it the
longest previous factors: the nearest smaller positions before and after a string in suffix
order are the earlier strings with the longest common prefixes, and a string whose longest
previous factor reaches ``length`` is a later copy.

Surroundings of one minimizer that outnumber HOT do not meet in a task: their strings meet
by digest, in groups that aggregate before they shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.session import cut, drop_stored, ensure_checkpoint_dir, stored

GRAM = 32
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
BATCH = 2 << 20
#: Different surroundings of one minimizer that one task compares; it holds no more of them.
HOT = 4096
BROADCAST_BYTES = 24 << 20
#: Low bits of a packed run that hold its bytes beyond the length.
EXTENT_BITS = 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes that begin at each position."""
    h, step, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = (factor * factor * 3 + 2) % (1 << 64) | 1
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def minimizers(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first start, last start): the strings of ``length`` bytes that
    begin from the first to the last start have this minimizer, the leftmost of equal ones."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if not len(sizes) or ends[-1] < length:
        return none
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    wide, span = length - GRAM + 1, 1
    while span * 2 <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < wide:
        key = np.minimum(key[: len(key) - (wide - span)], key[wide - span :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(at))
    owner = np.searchsorted(ends, start, side="right")
    good = start + length <= ends[np.minimum(owner, len(ends) - 1)]
    start, at, owner = start[good], at[good], owner[good]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(start)) - 1
    base = (ends - sizes)[owner[first]]
    return h[at[first]], owner[first], start[first] - base, start[last] - base


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches with their texts as bytes, of about SLICE bytes."""
    for batch in batches:
        sizes = np.array(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.concatenate([[0], np.nonzero(np.diff(np.cumsum(sizes) // SLICE))[0] + 1, [batch.num_rows]]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(lo, hi - lo)
            yield part, [(t or b"") for t in part.column(column).to_pylist()]


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.uint64)
    sorted_keys = keys[order]
    ranks[order] = np.cumsum(np.concatenate([[0], sorted_keys[1:] != sorted_keys[:-1]])).astype(np.uint64)
    return ranks


def smaller_before(position: np.ndarray) -> np.ndarray:
    """Of each place in ``position`` (different values), the nearest place before it with a smaller one, or -1."""
    at = np.arange(-1, len(position) - 1)
    open_ = np.arange(len(position))
    while True:
        # a larger value is skipped together with what its own pointer has skipped
        open_ = open_[at[open_] >= 0]
        open_ = open_[position[at[open_]] > position[open_]]
        if not len(open_):
            return at
        at[open_] = at[at[open_]]


def longest_previous(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factors among ``starts`` (ascending positions), ``length`` at most: of each,
    the longest prefix that an earlier one of them has, too."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    n = len(data)
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys = keys << np.uint64(8) | padded[k : n + k]
    levels, depth = [_ranks(keys)], 8
    while depth * 2 <= length:
        ahead = np.concatenate([levels[-1][depth:], np.zeros(min(depth, n), np.uint64)])[:n]
        levels.append(_ranks(levels[-1] << np.uint64(32) | ahead))
        depth *= 2
    key = levels[-1][starts] << np.uint64(32) | levels[-1][np.minimum(starts + length - depth, n - 1)]
    order = starts[np.argsort(key, kind="stable")]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the strings at a and b, ``length`` at most."""
        out, width = np.zeros(len(a), np.int64), depth
        for ranks in reversed(levels):
            for _ in range(2 if width == depth else 1):
                x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
                out += width * ((ranks[x] == ranks[y]) & (np.maximum(a, b) + out < n))
            width //= 2
        differ = keys[np.minimum(a + out, n - 1)] ^ keys[np.minimum(b + out, n - 1)]
        for shift in range(56, -1, -8):
            same = differ >> np.uint64(shift) == 0
            if not same.any():
                break
            out += same
        return np.minimum(out, length)

    longest = np.zeros(len(order), np.int64)
    for side in (order, order[::-1]):
        before = smaller_before(side)
        some = np.nonzero(before >= 0)[0]
        got = common(side[some], side[before[some]])
        where = some if side is order else len(order) - 1 - some
        longest[where] = np.maximum(longest[where], got)
    out = np.zeros(len(order), np.int64)
    out[np.searchsorted(starts, order)] = longest
    return out


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts`` have a longest previous factor of ``length`` among them."""
    return longest_previous(data, starts, length) >= length


def _unioned(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals [start, end)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.nonzero(new)[0]
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def _find(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Covered intervals from strings' surroundings sorted by (h, id, s).

    What is held over from one piece to the next is, of the last minimizer, those
    surroundings that had a string not seen before, HOT at most; all others repeat them."""
    held: list[tuple[int, int, int, bytes]] = []

    def work(rows: list[tuple[int, int, int, bytes]], old: int):
        texts = [r[3] for r in rows]
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes
        each = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), each)
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        same = repeated_starts(np.frombuffer(b"".join(texts), np.uint8), base[owner] + inner, length)
        fresh = np.zeros(len(rows), bool)
        fresh[owner[~same]] = True
        fresh[:old] = True
        pick = same & (owner >= old)
        who, at = owner[pick], inner[pick]
        out = [], [], []
        if len(who):
            # runs of neighbouring starts in one surrounding
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.nonzero(new)[0]
            last = np.append(first[1:], len(who)) - 1
            s = np.array([r[2] for r in rows])
            out = [rows[w][1] for w in who[first]], s[who[first]] + at[first], s[who[last]] + at[last] + length
        keep = [r for r, f in zip(rows, fresh) if f and r[0] == rows[-1][0]]
        return keep, pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["id", "lo", "hi"])

    rows, size, last = [], 0, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            new = []
            for r in zip(*(c.to_pylist() for c in part.columns)):
                if r[:3] != last:
                    new.append(r)
                last = r[:3]
            rows += new
            size += sum(len(r[3]) for r in new)
            if size >= BATCH:
                held, out = work(held + rows, len(held))
                yield out
                rows, size = [], 0
    if rows:
        yield work(held + rows, len(held))[1]


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text as bytes) of rows with an id, as a table in the checkpoint folder that is
    bucketed by id: joins on the id move only their other side."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")).where("id IS NOT NULL")
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    read.repartition(buckets, "id").write.bucketBy(buckets, "id").option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    table = spark.table(name)
    # the files stay, and the relation knows its buckets
    spark.sql(f"DROP TABLE {name}")
    return table


def spans(base: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text as bytes): removed runs (id, p) of the first document of each text, and
    (id) of the documents whose whole text is an earlier document's.  A run is packed: its
    first byte, shifted by EXTENT_BITS, and how many bytes it has beyond ``length``."""
    long = base.where(F.octet_length("text") >= length)
    named = long.select("id", F.sha2("text", 256).alias("sha"))
    firsts = named.groupBy("sha").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = cut(named.join(firsts, "sha").where("id > keep").select("id").distinct())
    first = long.join(copies, "id", "left_anti")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, 1):
            h, owner, s, e = minimizers(texts, length)
            ids = np.array(part.column(0).to_pylist(), np.int64)
            digest = [xxhash.xxh3_64_intdigest(texts[k][lo:hi]) for k, lo, hi in zip(owner.tolist(), s.tolist(), (e + length).tolist())]
            rows, later = _settled(h.view(np.int64), np.array(digest, np.uint64).view(np.int64), ids[owner], s << EXTENT_BITS | (e - s))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, later)], ["h", "d", "id", "p", "later"])

    placed = first.mapInArrow(place, "h bigint, d bigint, id bigint, p bigint, later boolean")
    # what a slice has settled needs no meeting and is dealt out to all tasks
    by = F.when(F.col("later"), F.xxhash64("id", "p")).otherwise(F.col("h"))
    judged = cut(placed.repartition(by).sortWithinPartitions("later", "h", "d", "id", "p").mapInArrow(_equal, "h bigint, id bigint, p bigint, ask boolean"))
    hot = cut(judged.where("ask").groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot")))
    at = judged.where("ask").groupBy("id").agg(F.collect_list(F.shiftright("p", EXTENT_BITS)).alias("at"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, 1):
            h, owner, s, e = minimizers(texts, length)
            lists = part.column(2)
            asked = lists.flatten().to_numpy(zero_copy_only=False)
            whose = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            pick = np.nonzero(np.isin(owner << 40 | s, whose << 40 | asked))[0]
            ids = np.array(part.column(0).to_pylist(), np.int64)
            ctx = [texts[k][lo:hi] for k, lo, hi in zip(owner[pick].tolist(), s[pick].tolist(), (e[pick] + length).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h[pick].view(np.int64)), pa.array(ids[owner[pick]]), pa.array(s[pick]), pa.array(ctx, pa.binary())], ["h", "id", "s", "ctx"])

    around = stored(long.join(at, "id").select("id", "text", "at").mapInArrow(surround, "h bigint, id bigint, s bigint, ctx binary"))
    marked = around.join(F.broadcast(hot) if hot.count() * 32 <= BROADCAST_BYTES else hot, "h", "left")
    found = marked.where("hot IS NULL").select("h", "id", "s", "ctx").repartition("h").sortWithinPartitions("h", "id", "s").mapInArrow(lambda b: _find(b, length), "id bigint, lo bigint, hi bigint")
    packed = F.shiftleft("lo", EXTENT_BITS) + F.col("hi") - F.col("lo") - length
    found = cut(found.select("id", packed.alias("p")))
    # strings of a hot minimizer: the first of each digest stays, by id and place
    strings = marked.where("hot").select("id", "s", F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - length)).alias("k"), "ctx")
    named = stored(strings.select("id", (F.col("s") + F.col("k")).alias("s"), F.sha2(F.substring("ctx", F.col("k") + 1, F.lit(length)), 256).alias("d")).distinct())
    first = named.groupBy("d").agg(F.min(F.struct("id", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first")
    later = named.join(first, "d").where(F.struct("id", "s") > F.col("first")).select("id", F.shiftleft("s", EXTENT_BITS).alias("p"))
    later = cut(later)
    drop_stored(named)
    drop_stored(around)
    return judged.where("NOT ask").select("id", "p").unionByName(found).unionByName(later), copies


def _settled(h: np.ndarray, d: np.ndarray, i: np.ndarray, p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Surroundings (minimizer, digest, id, place) without repeated rows, and which of them have an
    equal one before them, by id and place: these are repeats whatever else there is, so that of
    a frequent one each slice sends only its first to the others."""
    order = np.lexsort((p, i, d, h))
    rows = [x[order] for x in (h, d, i, p)]
    alike = np.array([x[1:] == x[:-1] for x in rows])
    same = np.append(np.zeros(min(1, len(h)), bool), alike[:2].all(axis=0))
    again = np.append(np.zeros(min(1, len(h)), bool), alike.all(axis=0))
    return [x[~again] for x in rows], same[~again]


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of surroundings sorted by (later, minimizer, digest, id, place): those equal to an earlier
    one, also by ``later``, are repeats from end to end (ask false); the first of each digest is
    asked for where its minimizer has another digest, too, so that texts travel for partial
    repeats only.  A row that repeats the one before is the same place of the same document."""
    last: tuple[int, int, int, int] | None = None
    held: tuple[int, int, int, bool] | None = None
    for batch in batches:
        *columns, later = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if later.any():
            h, d, i, p = (x[later] for x in columns)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, i, p, np.zeros(len(h), bool))], ["h", "id", "p", "ask"])
        h, d, i, p = (x[~later] for x in columns)
        if not len(h):
            continue
        new, again = np.ones(len(h), bool), np.zeros(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        again[1:] = ~new[1:] & (i[1:] == i[:-1]) & (p[1:] == p[:-1])
        if last is not None:
            new[0] = (int(h[0]), int(d[0])) != last[:2]
            again[0] = (int(h[0]), int(d[0]), int(i[0]), int(p[0])) == last
        last = int(h[-1]), int(d[-1]), int(i[-1]), int(p[-1])
        rep = ~new & ~again
        f = np.nonzero(new)[0]
        fh, fi, fp, done = h[f], i[f], p[f], np.zeros(len(f), bool)
        if held is not None:
            fh, fi, fp, done = (np.concatenate([[x], y]) for x, y in zip(held, (fh, fi, fp, done)))
        ask = np.zeros(len(fh), bool)
        same = fh[1:] == fh[:-1]
        ask[1:] |= same
        ask[:-1] |= same
        if len(fh):
            held = int(fh[-1]), int(fi[-1]), int(fp[-1]), bool(ask[-1] or done[-1])
        ask &= ~done.astype(bool)
        flags = np.concatenate([np.zeros(int(rep.sum()), bool), np.ones(int(ask.sum()), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[rep], y[ask]])) for x, y in ((h, fh), (i, fi), (p, fp))] + [pa.array(flags)], ["h", "id", "p", "ask"])


def removed(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, runs (array of [lo, hi) of removed bytes), kept (remaining bytes).

    Null texts are empty; ids are whole numbers and name documents (of rows that repeat
    an id, with equal texts, none counts as earlier than the other); rows with a null
    id are left whole and count as copies of nothing.  Texts shorter than ``length``
    lose nothing.  An empty table gives no rows.
    """
    base = located(docs, id_col, text_col)
    found, copies = spans(base, length)
    per = found.groupBy("id").agg(F.collect_list("p").alias("found"))
    marked = base.join(copies.withColumn("copy", F.lit(True)), "id", "left").join(per, "id", "left").select("id", "text", "copy", "found")
    nameless = docs.where(F.col(f"`{id_col}`").cast("long").isNull()).select(F.lit(None).cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), F.lit(None).cast("boolean").alias("copy"), F.lit(None).cast("array<bigint>").alias("found"))
    runs = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, 1):
            many, kept = [], []
            for text, copy, got in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                if copy:
                    lo, hi = [0], [len(text)]
                elif got:
                    packed = np.array(got, np.int64)
                    start = packed >> EXTENT_BITS
                    lo, hi = (x.tolist() for x in _unioned(start, start + (packed & (1 << EXTENT_BITS) - 1) + length))
                else:
                    lo, hi = [], []
                many.append([{"lo": a, "hi": b} for a, b in zip(lo, hi)])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *hi], [*lo, len(text)])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(many, runs), pa.array(kept, pa.binary())], ["id", "n_bytes", "runs", "kept"])

    got = marked.unionByName(nameless).mapInArrow(strip, "id bigint, n_bytes bigint, runs array<struct<lo:bigint,hi:bigint>>, kept binary")
    return got.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    got = removed(docs, length, id_col, text_col)
    return got.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
