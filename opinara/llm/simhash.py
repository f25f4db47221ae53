"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are made in Arrow batches.  Distinct fingerprints are cut into parts;
two that differ in at most ``radius`` bits agree on ``parts - radius`` parts, so each
choice of that many parts is a table in which they share a key (no pair is lost).
Fingerprints that share a key meet in one sorted run and are compared bit-sliced:
blocks of 64 fingerprints are stored as 64 bit planes, a query's bits select each
plane or its complement, carry-save counters add up all 64 distances at once, and a
block is abandoned when every member exceeds the radius.  Links form components.

``kept_rows`` (the pipeline's stage) links at a Jaccard similarity of 0.8, where about one
bit of six differs, too many for parts of 64 bits.  It makes wider fingerprints of the sets of
shingles by the same rule, has them meet by bands of their bits, compares those that meet
in bit planes, too, and verifies components of what is near by the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.compact_windows import SHINGLE, shingles
from opinara.llm.graph import connected_components
from opinara.session import cut

SEED = 42
#: Members of one key that are compared in one group; larger keys are dealt out in pairs of chunks.
CHUNK = 4096
#: Bits of a wide fingerprint that are compared where two texts meet.
BITS = 192
#: Chance that a bit differs at a Jaccard similarity of 0.8: for sets of five shingles or more at most
#: this, arccos(8/9)/pi = 0.152 for large ones (of four shingles beside five: 0.1875).
DIFFER = 0.1612
#: Chances that a pair at 0.8 meets under no band, and that more of its BITS differ than are looked for.
MISS, FAR = 3e-6, 1e-6
#: Bits of a band where the number of rows is not known, and members of a band's key that are compared in one
#: group (larger ones are dealt out in pairs of chunks).
BAND, MEMBERS = 10, 1 << 12
#: Rows that are sorted into groups at a time, pairs of a row and a block that are compared at a time, and
#: members of a component of near rows whose sets are compared in one task.
ROWS, AT_ONCE, VERIFIED = 1 << 14, 1 << 13, 1 << 9
#: Texts that are turned into Python objects at a time.
SLICE = 64
#: Bytes that a table may take when it is sent to all executors.
BROADCAST_BYTES = 24 << 20


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text: A-Z lower-cased, words, ``width``-word shingles with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[k:] for k in range(width)])))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, SLICE):
                out += [fingerprint(t, width) for t in batch.column(1).slice(at, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def tables(parts: int, radius: int) -> list[int]:
    """Masks of the bits that each table's key keeps."""
    edges = [64 * k // parts for k in range(parts + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(parts)]
    return [sum(part[k] for k in chosen) for chosen in combinations(range(parts), parts - radius)]


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits whose counter is above the radius."""
    more, equal = np.zeros_like(over), ~np.zeros_like(over)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more |= equal & counters[k]
            equal = equal & ~counters[k]
    return over | more


def near(planes: np.ndarray, left: np.ndarray, right: np.ndarray, query: int, radius: int) -> np.ndarray:
    """For each pair of blocks: bits of the right block's members within ``radius`` of member ``query`` of the left block.

    planes: uint64[blocks, 64], plane p's bit m is bit p of member m.
    """
    out = np.zeros(len(left), np.uint64)
    live = np.arange(len(left))
    wide = radius.bit_length()
    counters = [np.zeros(len(left), np.uint64) for _ in range(wide)]
    over = np.zeros(len(left), np.uint64)
    q = np.uint64(query)
    for p in range(64):
        mask = np.uint64(0) - ((planes[left[live], p] >> q) & np.uint64(1))
        carry = planes[right[live], p] ^ mask
        for k in range(wide):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7:
            gone = _exceeds(counters, over, radius)
            stay = gone != ~np.uint64(0)
            if p == 63:
                out[live] = ~gone
            elif not stay.all():
                live, over, counters = live[stay], over[stay], [c[stay] for c in counters]
                if not len(live):
                    break
    return out


def block_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of fps within ``radius`` of each other, inside each run [start, end)."""
    firsts, sizes, lefts, rights = [], [], [], []
    blocks = -(-(ends - starts) // 64)
    base = np.concatenate([[0], np.cumsum(blocks)])
    for s, e, b, n in zip(starts, ends, base, blocks):
        for k in range(n):
            firsts.append(s + 64 * k)
            sizes.append(min(64, e - s - 64 * k))
            for m in range(k, n):
                lefts.append(b + k)
                rights.append(b + m)
    firsts, sizes = np.array(firsts), np.array(sizes)
    at = firsts[:, None] + np.minimum(np.arange(64)[None, :], sizes[:, None] - 1)
    bits = np.unpackbits(fps[at].view(np.uint8).reshape(len(firsts), 64, 8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64).reshape(len(firsts), 64)
    full = ~np.uint64(0)
    valid = np.where(sizes == 64, full, (np.uint64(1) << np.minimum(sizes, 63).astype(np.uint64)) - np.uint64(1))
    lefts, rights = np.array(lefts), np.array(rights)
    found_i, found_j = [], []
    step = max(1, (1 << 20) // 64)
    for at in range(0, len(lefts), step):
        left, right = lefts[at : at + step], rights[at : at + step]
        for query in range(int(sizes[left].max())):
            has = sizes[left] > query
            a, b = left[has], right[has]
            hit = near(planes, a, b, query, radius) & valid[b]
            above = (full << np.uint64(query)) << np.uint64(1) if query < 63 else np.uint64(0)
            hit = np.where(a == b, hit & above, hit)
            some = np.nonzero(hit)[0]
            if len(some):
                row, bit = np.nonzero(np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                found_i.append(firsts[a[some[row]]] + query)
                found_j.append(firsts[b[some[row]]] + bit)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def spanning(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links join two trees, so that the rest adds nothing to components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    keep = np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep[k] = True
    return keep


def links(fps: DataFrame, radius: int = 2, parts: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) of distinct fingerprints ``fps`` (fp) within ``radius``: at least a spanning forest of all such links."""
    parts = parts or radius + 2
    masks = np.array(tables(parts, radius), np.uint64).view(np.int64).tolist()
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    counts = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(counts, ["t", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = met.select("fp", "t", "key", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d")).select("fp", "t", "key", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"))
    order = ["t", "key", "lo", "hi"]
    tested = np.array(masks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(cols: list[np.ndarray], cut_at: np.ndarray) -> pa.RecordBatch:
            starts, ends = cut_at[:-1], cut_at[1:]
            many = ends - starts > 1
            src = dst = np.zeros(0, np.int64)
            if many.any():
                fp = cols[0]
                i, j = block_pairs(fp.view(np.uint64), starts[many], ends[many], radius)
                # a pair that meets in several tables is reported by the first of them
                same = ((fp[i] ^ fp[j])[:, None] & tested[None, :]) == 0
                mine = same.argmax(axis=1) == cols[1][i]
                i, j = i[mine], j[mine]
                tree = spanning(i, j)
                src, dst = fp[i[tree]], fp[j[tree]]
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            n = len(cols[0])
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in cols[1:]:
                new[1:] |= c[1:] != c[:-1]
            cut_at = np.concatenate([[0], np.nonzero(new)[0]])
            held = [c[cut_at[-1] :].copy() for c in cols]
            if len(cut_at) > 1:
                yield compare(cols, cut_at)
        if held is not None:
            yield compare(held, np.array([0, len(held[0])]))

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "src bigint, dst bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other.  A null id is
    never the smallest unless it is alone.  Repeated rows give repeated results; other
    columns are ignored; an empty table gives no rows.  Links are sought between
    distinct fingerprints, so copies never multiply.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    joined = connected_components(links(classes.select("fp"), radius))
    merged = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = merged.groupBy("component").agg(F.min("least").alias("component_id"))
    named = merged.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@lru_cache
def bands_of(bits: int) -> int:
    """Bands of ``bits`` bits, so many that a pair at 0.8 agrees on none with a chance of MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFER) ** bits)))


@lru_cache
def radius_of(bits: int) -> int:
    """Most places in which ``bits`` bits are looked for: at 0.8 more differ with a chance of FAR at most."""
    tail = 1.0
    for r in range(bits):
        tail -= math.comb(bits, r) * DIFFER**r * (1 - DIFFER) ** (bits - r)
        if tail <= FAR:
            return r
    return bits


def band_bits(rows: int) -> int:
    """Bits of a band, so that some 16000 of ``rows`` unlike texts at most meet under one (up to 2^38 rows)."""
    return min(24, max(BAND, rows.bit_length() - 14))


@lru_cache
def _salts(words: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, words).astype(np.uint64)


def set_fingerprint(each: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of a set of 64-bit hashes, as words of 64 bits: a bit is 1 if set in over half of them.
    Each hash is mixed anew for each word."""
    words = -(-bits // 64)
    salts = _salts(words)
    counts = np.zeros(64 * words, np.int64)
    # 255 at a time, so that counts fit a byte
    for at in range(0, len(each), 255):
        x = each[at : at + 255, None] ^ salts
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(each), bitorder="little").view(np.uint64)


def _sets(docs: DataFrame, id_col: str, text_col: str, full: bool, bits: int = BAND) -> DataFrame:
    """(id, h, k, s): h is a hash of the text, k names its set of five-word shingles (a shorter text is
    one shingle); s is the set if ``full``, else its fingerprint, wide enough for bands of ``bits`` bits."""
    width = max(BITS, bits * bands_of(bits))

    def one(text: str | None) -> tuple[int, np.ndarray]:
        words = (text or "").encode().lower().split()
        each = np.unique(shingles(text)) if len(words) >= SHINGLE else np.full(min(1, len(words)), xxhash.xxh64_intdigest(b" ".join(words), SEED), np.uint64)
        k = xxhash.xxh3_64_intdigest(each.tobytes())
        return k, each if full or not len(each) else set_fingerprint(each, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = [one(t) for t in part.column(1).to_pylist()]
                keys = np.array([k for k, _ in got], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys), pa.array([x.view(np.int64) for _, x in got], pa.list_(pa.int64()))], ["id", "h", "k", "s"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), _text_hash(text_col).alias("h")).mapInArrow(run, f"id {kind}, h bigint, k bigint, s array<bigint>")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that agree on their first two columns, from batches sorted by these."""
    held: list[tuple] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            lists = [c.flatten().to_numpy(zero_copy_only=False) for c in part.columns[4:]]
            ends = [np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in part.columns[4:]]
            for n, r in enumerate(zip(*(c.to_pylist() for c in part.columns[:4]))):
                if held and held[0][:2] != r[:2]:
                    yield held
                    held = []
                held.append((*r, *(x[e[n] : e[n + 1]].copy() for x, e in zip(lists, ends))))
    if held:
        yield held


def _changes(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.nonzero(new)[0]


class _Adders:
    """Carry-save adders: sums of bit planes, 64 to a word, in counters of ``wide`` bits; what exceeds these is in ``over``."""

    def __init__(self, wide: int, over: np.ndarray):
        self.over, self.sums, self.waits = over, [None] * wide, [None] * wide

    def add(self, x: np.ndarray, level: int = 0) -> None:
        """Two planes of a weight wait for each other and go into its sum at once; ``x`` is used up."""
        while level < len(self.sums):
            other, total = self.waits[level], self.sums[level]
            if other is None:
                self.waits[level] = x
                return
            self.waits[level] = None
            if total is None:
                total = other ^ x
                x &= other
            else:
                carry = total & other
                total ^= other
                np.bitwise_and(total, x, out=other)
                total ^= x
                carry |= other
                x = carry
            self.sums[level] = total
            level += 1
        self.over |= x

    def exceed(self, radius: int) -> np.ndarray:
        """Bits whose sum is above the radius; no plane waits any more."""
        for level in range(len(self.waits)):
            if (other := self.waits[level]) is not None:
                self.waits[level] = None
                total = np.zeros_like(other) if self.sums[level] is None else self.sums[level]
                carry = total & other
                self.sums[level] = total ^ other
                self.add(carry, level + 1)
        return _exceeds([np.zeros_like(self.over) if c is None else c for c in self.sums], self.over, radius)

    def keep(self, stay: np.ndarray) -> None:
        self.over, self.sums = self.over[stay], [c if c is None else c[stay] for c in self.sums]


def near_rows(planes: np.ndarray, fps: np.ndarray, row: np.ndarray, block: np.ndarray, valid: np.ndarray, radius: int, band: int, table: np.ndarray) -> np.ndarray:
    """For each pair of a row (ascending) and a block: bits of the block's ``valid`` members within ``radius`` of
    the row's fingerprint that agree with it on none of the bands of ``band`` bits before the pair's own, ``table``.

    planes: uint64[bits, blocks], plane p's bit m is bit p of member m."""
    out = np.zeros(len(row), np.uint64)
    live = np.arange(len(row))
    first = row[0]
    own = np.ascontiguousarray(np.unpackbits(fps[first : row[-1] + 1].view(np.uint8), axis=1, bitorder="little").T)
    mine = row - first
    masks = np.array([0, ~np.uint64(0)], np.uint64)
    adders = _Adders(radius.bit_length(), ~valid)
    last = int(table.max())
    differ = np.zeros(len(row), np.uint64)
    for p in range(len(planes)):
        x = planes[p].take(block)
        x ^= masks.take(own[p]).take(mine)
        if p // band < last:
            differ |= x
            if p % band == band - 1:
                adders.over |= np.where(p // band < table, ~differ, np.uint64(0))
                differ[:] = 0
        adders.add(x)
        # from here on hardly a block of unlike members is left
        if (p + 1) % 32 == 0 and (p + 1) / 2 - radius > 1.75 * (p + 1) ** 0.5 or p + 1 == len(planes):
            gone = adders.exceed(radius)
            stay = gone != ~np.uint64(0)
            if p + 1 == len(planes):
                out[live] = ~gone
            elif not stay.all():
                live, mine, block, table, differ = live[stay], mine[stay], block[stay], table[stay], differ[stay]
                adders.keep(stay)
                if not len(live):
                    break
    return out


def _close(g: np.ndarray, part: np.ndarray, c: np.ndarray, fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, block, hits) of rows sorted by group (g, part) and chunk c: members of a later block of 64 rows
    that are near a row of the same group, in a group of two chunks those of the other one only.  A pair that
    agrees on several bands belongs to the first of them, as far as BITS show."""
    n = len(g)
    to = lambda starts: np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    ends, own = to(_changes(g, part)), to(_changes(g, part, c))
    starts = np.where(part >> 21 == part & (1 << 21) - 1, np.arange(n) + 1, own)
    padded = np.zeros((-(-n // 64) * 64, fps.shape[1]), np.uint64)
    padded[:n] = fps
    bit = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8 * fps.shape[1]), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bit.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0].copy()
    count = np.where(starts < ends, (ends - 1) // 64 - starts // 64 + 1, 0)
    upto = np.cumsum(count)
    full = ~np.uint64(0)
    radius = radius_of(64 * fps.shape[1])
    for at in range(0, int(upto[-1]), AT_ONCE):
        each = np.arange(at, min(at + AT_ONCE, int(upto[-1])))
        row = np.searchsorted(upto, each, side="right")
        block = starts[row] // 64 + each - (upto[row] - count[row])
        low = np.maximum(starts[row] - 64 * block, 0).astype(np.uint64)
        high = np.minimum(ends[row] - 64 * block, 64).astype(np.uint64)
        valid = (full << low) & (full >> (np.uint64(64) - high))
        hits = near_rows(planes, padded, row, block, valid, radius, bits, g[row] >> 32)
        some = np.nonzero(hits)[0]
        yield row[some], block[some], hits[some]


def _members(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


#: Bits of a group's name for each chunk of a pair; below them one tells which chunk a row is of, above them
#: stand the band and 24 bits of its key.
_CHUNK_BITS = 14


def _named(name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, part, c) for ``_close``."""
    most = (1 << _CHUNK_BITS) - 1
    pair = name >> 1
    key = pair >> 2 * _CHUNK_BITS
    return key >> 24 << 32 | key & (1 << 24) - 1, (pair >> _CHUNK_BITS & most) << 21 | pair & most, name & 1


def jaccard_links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8, chunk: int = MEMBERS, bits: int = BAND) -> DataFrame:
    """(src, dst) of ``classes`` (k, least: id and h of a row, s as fingerprint) whose shingle sets have at least the
    Jaccard similarity ``similar`` (0.8 or more): at least a spanning forest of all such links.

    Classes meet under bands of ``bits`` bits of their fingerprints and are compared bit-sliced; a pair at
    0.8 is not found with a chance of MISS + FAR.  Components of near classes are then compared by their sets,
    which travel once, in components of more than VERIFIED once for each VERIFIED members."""
    if similar < 0.8:
        raise ValueError("bands and radius are made for a similarity of 0.8 or more")
    pairs = cut(_near_pairs(classes.select("k", "s"), chunk, bits))
    return _verified(docs, classes, connected_components(pairs), id_col, text_col, similar, min(chunk, VERIFIED))


def _near_pairs(classes: DataFrame, chunk: int, bits: int) -> DataFrame:
    """(src, dst) of classes (k, s) that are near and meet under a band: a spanning forest of each group that meets."""
    words = BITS // 64
    narrow = [f"f{w}" for w in range(words)]
    banded = classes.where(F.size("s") > 0).select("k", "s", F.explode(F.sequence(F.lit(0), F.lit(bands_of(bits) - 1))).alias("t")).select("*", F.expr(f"t * {bits} DIV 64").cast("int").alias("w"), F.expr(f"t * {bits} % 64").alias("o"))
    # a band may lie across two words
    key = F.expr(f"shiftrightunsigned(s[w], o) | CASE WHEN o + {bits} > 64 THEN shiftleft(s[w + 1], 64 - o) ELSE 0L END").bitwiseAND(F.lit((1 << bits) - 1))
    keyed = banded.select(F.shiftleft(F.col("t").cast("long"), 24).bitwiseOR(key).alias("g"), "k", *(F.col("s")[w].alias(f) for w, f in enumerate(narrow)))
    chunks = F.least(F.ceil(F.col("count") / chunk), F.lit(1 << _CHUNK_BITS)).alias("chunks")
    hot = cut(keyed.groupBy("g").count().where(F.col("count") > chunk).select("g", chunks))
    met = keyed.join(_sized(hot), "g", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("k"), "chunks"))
    # chunks c and d of a band's members meet in one group, whose name ends with 1 for the rows of the greater one
    pair = F.shiftleft(F.shiftleft("g", _CHUNK_BITS) + F.least("c", "d"), _CHUNK_BITS) + F.greatest("c", "d")
    name = (F.shiftleft(pair, 1) + (F.col("c") > F.col("d")).cast("long")).alias("name")
    dealt = met.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(name, "k", *narrow)
    group = F.shiftright("name", 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(cols: list[np.ndarray]) -> pa.RecordBatch:
            # the smallest come first, so that many bands give the same pairs
            order = np.lexsort((cols[1], cols[0]))
            (name, k), fps = (c[order] for c in cols[:2]), np.column_stack([c[order] for c in cols[2:]]).view(np.uint64)
            trees = np.arange(len(name))
            src, dst = [], []
            for row, block, hits in _close(*_named(name), fps, bits):
                pair, member = _members(hits)
                i, j = row[pair], 64 * block[pair] + member
                # trees that the pairs before have made are left out
                apart = trees[i] != trees[j]
                i, j = i[apart], j[apart]
                tree = spanning(trees[i], trees[j])
                src.append(k[i[tree]])
                dst.append(k[j[tree]])
                trees = _merged(trees, trees[i[tree]], trees[j[tree]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (src, dst)], ["src", "dst"])

        held: list[list[np.ndarray]] = []
        n, most = 0, ROWS
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                cols = [np.concatenate(x) for x in zip(*held)]
                last = _changes(cols[0] >> 1)[-1]
                held, n = [[c[last:].copy() for c in cols]], n - last
                most = max(ROWS, 2 * n)
                if last:
                    yield asked([c[:last] for c in cols])
        if n:
            yield asked([np.concatenate(x) for x in zip(*held)])

    return dealt.repartition(group).sortWithinPartitions("name").mapInArrow(ask, "src bigint, dst bigint")


def _merged(trees: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Trees (the name of each row's) after a and b have been joined."""
    up = np.arange(len(trees))
    for x, y in zip(a.tolist(), b.tolist()):
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        up[max(x, y)] = min(x, y)
    while (up[up] != up).any():
        up = up[up]
    return up[trees]


def _verified(docs: DataFrame, classes: DataFrame, near: DataFrame, id_col: str, text_col: str, similar: float, chunk: int) -> DataFrame:
    """(src, dst) of classes of one component of ``near`` (node, component) whose sets have the similarity ``similar``."""
    radius = radius_of(BITS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            fps = np.array([r[4][: BITS // 64] for r in rows]).view(np.uint64)
            c = np.array([r[2] for r in rows])
            trees = np.arange(len(rows))
            out = []
            for i in range(len(rows) - 1):
                j = i + 1 + np.nonzero((trees[i + 1 :] != trees[i]) & ((c[i + 1 :] != c[i]) | (c[0] == c[-1])))[0]
                far = np.bitwise_count(fps[j] ^ fps[i]).sum(axis=1)
                # the most similar first: a link saves the comparisons that it implies
                for m in j[np.argsort(far, kind="stable")[: int((far <= radius).sum())]].tolist():
                    x, y = rows[i][5], rows[m][5]
                    if trees[i] != trees[m] and min(len(x), len(y)) >= similar * max(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both >= similar * (len(x) + len(y) - both):
                            trees[trees == trees[m]] = trees[i]
                            out.append((rows[i][3], rows[m][3]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["src", "dst"])

    members = cut(near.select(F.col("node").alias("k"), F.col("component").alias("g")).join(classes.select("k", "least", "s"), "k"))
    wanted = members.select("least.id", "least.h").distinct()
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), _text_hash(text_col).alias("h"))
    again = named.join(_sized(wanted), named["id"].eqNullSafe(wanted["id"]) & (named["h"] == wanted["h"]), "left_semi")
    sets = _sets(again, "id", "text", True).select("k", F.col("s").alias("full")).dropDuplicates(["k"])
    many = cut(members.groupBy("g").count().where(F.col("count") > chunk).select("g", F.ceil(F.col("count") / chunk).alias("chunks")))
    dealt = members.join(sets, "k").join(_sized(many), "g", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("k"), "chunks"))
    # chunks lo and hi of a component meet in the group lo << 32 | hi
    part = (F.shiftleft(F.least("c", "d"), 32) + F.greatest("c", "d")).alias("part")
    met = dealt.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("g", part, "c", "k", "s", "full")
    # a number is given, as these rows are few for the work they make
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(tasks, "g", "part").sortWithinPartitions("g", "part", "c", "k").mapInArrow(compare, "src bigint, dst bigint")


def _sized(table: DataFrame, row_bytes: int = 64) -> DataFrame:
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8) -> DataFrame:
    """Of each group of linked texts, the row with the smallest id, all columns unchanged, whatever
    their names.

    Texts are linked whose sets of five-word shingles have at least the Jaccard similarity
    ``similar``; texts without a word, null or not, are alike.  A null id loses to any other; of a
    group with null ids only, the text of the smallest hash stays.  Of rows that repeat an id and
    text one stays; rows that repeat an id with another text are documents of their own.  An empty
    table gives no rows.  Only what goes, or is repeated, is joined with the texts: these move only
    where that list exceeds BROADCAST_BYTES."""
    count = docs.count()
    bits = band_bits(count)
    rows = cut(_sets(docs, id_col, text_col, False, bits))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least")
    classes = cut(rows.groupBy("k").agg(least, F.first("s").alias("s")))
    joined = connected_components(jaccard_links(docs, classes, id_col, text_col, similar, max(MEMBERS, 2 * count >> bits), bits)).withColumnRenamed("node", "k")
    merged = classes.join(joined, "k", "left").select("least", F.coalesce("component", "k").alias("component"))
    stay = merged.groupBy("component").agg(F.min("least").alias("x")).select(F.col("x.id").alias("i"), F.col("x.h").alias("g"), F.lit(True).alias("stays"))
    each = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))
    marks = each.join(stay, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").where("stays IS NULL OR n > 1")
    marks = cut(marks.select("id", "h", F.coalesce("stays", F.lit(False)).alias("stays")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("_id"), _text_hash(text_col).alias("_h"))
    judged = packed.join(_sized(marks), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left")
    alone, repeated = judged.where("stays IS NULL"), judged.where("stays").dropDuplicates(["_id", "_h"])
    return alone.select("row.*").unionByName(repeated.select("row.*"))
