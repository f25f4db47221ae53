"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a segment tree over the ranks of its adjacent pairs:
the root holds the lowest rank, a descent to the left finds its leftmost pair, and a
merge updates its neighbours' pairs in logarithmic time, until no pair can be merged.
The trees of a slice's new pre-tokens are rows of one array and take their steps
together; merged pre-tokens are remembered in a bounded table per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that one task remembers, twice over: a full table becomes the older one.
REMEMBERED = 100_000
#: Longer pre-tokens (in bytes) have a tree of their own and are merged anew in each slice.
LONG = 63
SLICE = 128
NONE = 1 << 30

# Fixed value: the split pattern of byte-level tokenizers, with white space as in Unicode.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_names() -> list[str]:
    """The character that stands for each byte in a vocabulary file: printable Latin-1 stands for itself, the rest moves above U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Codec:
    """A tokenizer file's vocabulary, merges and added tokens."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab, names = data["model"]["vocab"], byte_names()
        value = {c: b for b, c in enumerate(names)}
        self.single = [vocab[c] for c in names]
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, at in vocab.items():
            self.bytes[at] = bytes(value[c] for c in token)
        for token, at in self.added.items():
            self.bytes[at] = token.encode()
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        keys = np.fromiter(self.merges.keys(), np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.merges.values(), np.int32, len(keys))[order], NONE).astype(np.int32)
        self.made_ids, self.single_ids = np.array(self.made, np.int32), np.array(self.single, np.int32)
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        single, rank_of, made = self.single, self.merges.get, self.made
        ids = [single[b] for b in word]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        # tree[size + k]: rank of the pair that begins at k
        tree = [NONE] * size + [rank_of(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        tree += [NONE] * (2 * size - len(tree))
        for at in range(size - 1, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree[1]) < NONE:
            at = 1
            while at < size:
                at += at
                if tree[at] != low:
                    at += 1
            k = at - size
            gone = after[k]
            ids[k], ids[gone] = made[low], -1
            after[k] = nxt = after[gone]
            prev = before[k]
            if nxt < n:
                before[nxt] = k
            new = rank_of(ids[k] << 32 | ids[nxt], NONE) if nxt < n else NONE
            puts = [(k, new)]
            if gone < n - 1:
                puts.append((gone, NONE))
            if prev >= 0:
                puts.append((prev, rank_of(ids[prev] << 32 | ids[k], NONE)))
            for at, rank in puts:
                at += size
                if tree[at] == rank:
                    continue
                tree[at] = rank
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    if b < a:
                        a = b
                    if tree[at] == a:
                        break
                    tree[at] = a
                    at >>= 1
        return tuple([x for x in ids if x >= 0])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they do not merge; an id of -1 never does."""
        key = (a.astype(np.int64) << 32) + b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(NONE))

    def merge_together(self, words: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Token ids of words of fewer than ``size`` bytes, a power of two: a row of
        ``trees`` is one word's tree, and every step merges one pair of every word that
        still has one.  Places past a word's end, and place -1, have id -1."""
        n, depth = len(words), size.bit_length() - 1
        raw = np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8).reshape(n, size)
        inside = np.arange(size) < np.fromiter(map(len, words), np.int64, n)[:, None]
        ids = np.where(inside, self.single_ids[raw], np.int32(-1))
        trees = np.full((n, 2 * size), NONE, np.int32)
        trees[:, size:-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        for d in range(depth - 1, -1, -1):
            below = trees[:, 2 << d : 4 << d]
            trees[:, 1 << d : 2 << d] = np.minimum(below[:, ::2], below[:, 1::2])
        after = np.tile(np.minimum(np.arange(1, size + 1), size - 1), (n, 1))
        before = np.tile(np.arange(-1, size - 1) % size, (n, 1))
        ids, trees, after, before = ids.ravel(), trees.ravel(), after.ravel(), before.ravel()
        rows = np.arange(n)
        while len(rows := rows[trees[rows * 2 * size + 1] < NONE]):
            root, base = rows * 2 * size, rows * size
            low, at = trees[root + 1], np.ones(len(rows), np.int64)
            for _ in range(depth):
                at += at
                at += trees[root + at] != low
            k = at - size
            gone = after[base + k]
            nxt, prev = after[base + gone], before[base + k]
            ids[base + k], ids[base + gone] = self.made_ids[low], -1
            after[base + k], before[base + nxt] = nxt, k
            trees[root + size + gone] = NONE
            trees[root + size + prev] = self.ranks(ids[base + prev], ids[base + k])
            trees[root + size + k] = self.ranks(ids[base + k], ids[base + nxt])
            paths = [size + gone, size + prev, at]
            for _ in range(depth):
                for i, path in enumerate(paths):
                    paths[i] = path = path >> 1
                    left = root + 2 * path
                    trees[root + path] = np.minimum(trees[left], trees[left + 1])
        ids = ids.reshape(n, size)
        ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
        flat = ids[ids >= 0].tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def merged(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of each pre-token, from the tables or merged now."""
        known, older = self.known, self.older
        here = dict(zip(words, map(known.get, words)))
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for word in [w for w, ids in here.items() if ids is None]:
            if (ids := older.get(word)) is None:
                raw = word.encode()
                if len(raw) <= LONG:
                    classes.setdefault(max(4, 1 << len(raw).bit_length()), []).append((word, raw))
                    continue
                ids = self.merge(raw)
            here[word] = ids
        for size, found in classes.items():
            new = dict(zip([w for w, _ in found], self.merge_together([r for _, r in found], size)))
            here |= new
            if len(known) >= REMEMBERED:
                self.older, self.known = known, (known := {})
            known |= new
        return here

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts in one row, and where each text's ids begin and end."""
        split = self.split.findall
        pieces = [self.special.split(t or "") if self.special else [t or ""] for t in texts]
        # an added token is a number in place of a word, so that no pre-token can be taken for it
        words = [[w for p in ps for w in ([self.added[p]] if p in self.added else split(p))] if len(ps) > 1 else split(ps[0]) for ps in pieces]
        alone = {k: (k,) for k in self.added.values()}
        here = self.merged(set().union(*words).difference(alone)) | alone
        ids = [np.fromiter(chain.from_iterable(map(here.__getitem__, ws)), np.int32) for ws in words]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum([0, *map(len, ids)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes
        return b"".join([table[k] for k in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def _columns(docs: DataFrame, add: str, kind: str, source: str, spec: str, work) -> DataFrame:
    """``docs`` with column ``add``, made from column ``source`` slice by slice."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    names = [c for c in docs.columns if c != add]
    place = names.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, work(tool, part.column(place))], [*names, add])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in names]).schema)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{fields}, `{add}` {kind}")


def _encoded(tool: Codec, texts: pa.Array) -> pa.Array:
    ids, ends = tool.encode_all(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _decoded(tool: Codec, ids: pa.Array) -> pa.Array:
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array([tool.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())


def encode(docs: DataFrame, spec: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text (null: none) in ``out_col``.

    spec: the contents of a tokenizers JSON file (byte-level BPE), a few MB of fixed
    size.  An ``out_col`` that ``docs`` already has is replaced.
    """
    return _columns(docs, out_col, "array<int>", text_col, spec, _encoded)


def decode(docs: DataFrame, spec: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``ids_col`` (null: empty)."""
    return _columns(docs, out_col, "string", ids_col, spec, _decoded)


def digests(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, then decoded from the ids."""
    ids = encode(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), spec).drop("text")
    back = decode(ids, spec)
    return back.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
