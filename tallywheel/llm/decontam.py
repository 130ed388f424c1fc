"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A passage matches an item of n words if some run of words of the document is within floor(n / 5) word edits of it.

1. Blocks. An item is cut into even blocks of BLOCK words at most. If the item has k edits, some block of b words has at
   most its share, floor(b * k / n), by pigeonhole; so blocks are sought with that many, and windows stay short.
2. Windows. A match keeps at least b - 1 - 2e of a block's word pairs (an edit spoils two at most) within b + e words.
   Only window starts with that many pairs of one block ahead go on; nothing that could match is lost.
3. The CGK walk embeds edit distance in Hamming distance: at each step the current word is emitted, and a random bit of
   (step, word) says whether to move on. Windows a few edits apart fall into step again soon.
4. Bit sampling: each repetition walks with its own random bits and hashes SAMPLES emitted positions, spread over the
   block's length class, to one key. Windows and blocks that share a key of a class are candidates. REPEATS repetitions
   leave a block unseen with probability (1 - p ** SAMPLES) ** REPEATS, where p is the share of equal positions: for 0.3,
   the least mean seen of blocks of 30 words with 6 edits, 0.41 a window, and a match has several windows and blocks.
   Measured recall of items with exactly n / 5 edits is in the README; the tests hold it at 0.9.
5. Every candidate is verified by exact word edit distance (bit-parallel) of the whole item, over the document around it.

Words are compared in lower case (A-Z) without ASCII punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDIT_SHARE = 0.2
REPEATS, SAMPLES, BLOCK = 32, 3, 30
#: Benchmarks go to the executors in blocks of this many bytes at most, one pass over the documents for each block.
BLOCK_BYTES = 16 << 20
PAIR_BITS = 22
#: Items of up to SHORT words have masks of 16 KB at most, which are kept for KEPT items at a time.
SHORT, KEPT = 512, 2048
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(None, MARKS).split()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for hashes that agree on all machines."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def edit_distance_within(pattern: dict, n: int, words: list) -> tuple[int, int]:
    """(least edits between the pattern and any run of words, index of the run's last word), by bit-parallel columns.

    pattern: a word's positions in the item as a bit mask; n: the item's words.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, at = n, -1
    get = pattern.get
    for i, w in enumerate(words):
        eq = get(w, 0)
        x = eq | down
        zero = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (full & ~(zero | up)), up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
        if score < best:
            best, at = score, i
    return best, at


class Places:
    """The words of a long item, with a mask for each word that is asked for."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words, kind="stable")
        self.words = words[self.order]

    def get(self, word: int, default: int = 0) -> int:
        low, high = np.searchsorted(self.words, [word, word + 1])
        if low == high:
            return default
        at = self.order[low:high]
        bits = np.zeros(int(at.max()) + 1, np.uint8)
        bits[at] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


class Matcher:
    """The items of one benchmark block, made ready to be sought in texts."""

    def __init__(self, items: list[tuple[int, bytes]], edit_share: float = EDIT_SHARE, repeats: int = REPEATS, samples: int = SAMPLES, seed: int = 11):
        self.repeats, self.samples, self.seed, self.share = repeats, samples, seed, edit_share
        self.ids: dict[bytes, int] = {}
        self.items = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.items.append((item_id, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int64)))
        # The blocks of each item, which are what is indexed: (item, words before the block, its words).
        self.blocks = [(i, a, w[a:b]) for i, (_, w) in enumerate(self.items) for a, b in self._cuts(len(w))]
        self.block_item = np.array([i for i, _, _ in self.blocks], np.int64)
        self.block_at = np.array([a for _, a, _ in self.blocks], np.int64)
        self.longest = max((len(w) for _, _, w in self.blocks), default=0)
        # Which blocks have a pair of words: blocks of pair code c are pair_blocks[first[c] : first[c + 1]].
        codes = [np.unique(self._pairs(w)) for _, _, w in self.blocks]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        self.pair_blocks = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[np.argsort(flat, kind="stable")]
        self.first_block = np.zeros((1 << PAIR_BITS) + 1, np.int32)
        np.cumsum(np.bincount(flat, minlength=1 << PAIR_BITS), out=self.first_block[1:])
        self.sizes = np.array([len(w) for _, _, w in self.blocks], np.int64)
        self.allowed = np.array([len(w) * self.edits(len(self.items[i][1])) // len(self.items[i][1]) for i, _, w in self.blocks], np.int64)
        self.needed = self.sizes - 1 - 2 * self.allowed
        self.near: dict[int, dict[int, int]] = {}
        lengths = sorted(set(self.sizes.tolist()))
        rng = np.random.default_rng(seed)
        # Sampled steps of each class and repetition: a block of n words is walked in 2n steps on average.
        self.odd = rng.integers(0, 1 << 62, (2 * self.longest + 1, repeats), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = {n: rng.integers(0, max(1, 2 * n - 2), (repeats, samples)) for n in lengths}
        keys, owners = [], []
        for i, (_, _, w) in enumerate(self.blocks):
            keys.append(self._keys(self._walk(w[None, :], 2 * len(w)), len(w))[0])
            owners.append(np.full(repeats, i))
        flat, owner = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((keys, np.uint64), (owners, np.int64)))
        order = np.argsort(flat, kind="stable")
        self.keys, self.owners = flat[order], owner[order]

    def mask(self, item: int) -> dict[int, int] | Places:
        """The positions of each word of an item as a bit mask: made where an item is verified, so that what is broadcast grows
        with the benchmark's words. Masks of a short item are kept, for so many items; a long item's are made one by one."""
        words = self.items[item][1]
        if len(words) > SHORT:
            return Places(words)
        if item not in self.near:
            if len(self.near) >= KEPT:
                self.near.clear()
            mask: dict[int, int] = {}
            for j, x in enumerate(words.tolist()):
                mask[x] = mask.get(x, 0) | 1 << j
            self.near[item] = mask
        return self.near[item]

    def edits(self, n: int) -> int:
        return int(n * self.share + 1e-9)

    @staticmethod
    def _cuts(n: int) -> list[tuple[int, int]]:
        many = -(-n // BLOCK)
        return [(n * j // many, n * (j + 1) // many) for j in range(many)]

    @staticmethod
    def _pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = a.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + b.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
        return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def _pairs(self, w: np.ndarray) -> np.ndarray:
        return self._pair_codes(w[:-1], w[1:])

    def _walk(self, windows: np.ndarray, steps: int) -> np.ndarray:
        """(repeats, windows, steps): the CGK walks of windows of words; beyond the end a window emits 0."""
        count, width = windows.shape
        padded = np.hstack([windows, np.zeros((count, 1), np.int64)]).ravel()
        base = np.arange(count, dtype=np.int64) * (width + 1)
        at = np.zeros((self.repeats, count), np.int64)
        out = np.empty((steps, self.repeats, count), np.int64)
        for t in range(steps):
            out[t] = word = padded[base + at]
            # A multiply-shift hash of the word, drawn anew for each step and repetition, decides whether to move on.
            move = ((word.astype(np.uint64) + np.uint64(0x9E3779B9)) * self.odd[t][:, None]) >> np.uint64(63)
            at = np.minimum(at + move.astype(np.int64), width)
        return out.transpose(1, 2, 0)

    def _keys(self, walks: np.ndarray, n: int) -> np.ndarray:
        """(windows, repeats): the LSH keys of walks for the length class n."""
        picked = np.take_along_axis(walks, self.steps[n][:, None, :], axis=2)
        key = np.full(picked.shape[:2], n, np.uint64)
        key = _mix(key * np.uint64(1_000_003) + np.arange(self.repeats, dtype=np.uint64)[:, None])
        for j in range(self.samples):
            with np.errstate(over="ignore"):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + picked[:, :, j].astype(np.uint64))
        return key.T

    def _starts(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each length class the window starts from which a match with a block of that length is possible."""
        at = np.nonzero((words[:-1] > 0) & (words[1:] > 0))[0]
        codes = self._pair_codes(words[at], words[at + 1])
        begin, end = self.first_block[codes], self.first_block[codes + 1]
        counts = end - begin
        total = int(counts.sum())
        place = np.repeat(at, counts)
        block = self.pair_blocks[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(total)]
        order = np.argsort(block, kind="stable")
        place, block = place[order], block[order]
        need = self.needed[block]
        last = np.arange(total) + need - 1
        fits = (need > 0) & (last < total)
        last = np.where(fits, last, 0)
        n, k = self.sizes[block], self.allowed[block]
        fits &= (block[last] == block) & (place[last] - place <= n + k - 2) if total else fits
        out: dict[int, list[np.ndarray]] = {}
        low, high = np.maximum(place[last] - (n + k) + 2, 0)[fits], place[fits]
        for size in np.unique(n[fits]).tolist():
            here = n[fits] == size
            edge = np.zeros(len(words) + 2, np.int32)
            np.add.at(edge, low[here], 1)
            np.add.at(edge, high[here] + 1, -1)
            out[size] = [np.nonzero(np.cumsum(edge)[: len(words)] > 0)[0]]
        for i in np.nonzero(self.needed < 1)[0].tolist():  # one or two words: no pair is sure to be left
            out.setdefault(int(self.sizes[i]), []).append(np.nonzero(np.isin(words, self.blocks[i][2]))[0])
        return {size: np.unique(np.concatenate(x)) for size, x in out.items() if sum(map(len, x))}

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item index, where its first word would stand) pairs: a block of the item and a window share a key. Sorted."""
        if len(words) < 1 or not len(self.keys):
            return []
        found = []
        padded = np.concatenate([words, np.zeros(self.longest, np.int64)])
        for n, starts in self._starts(words).items():
            for a in range(0, len(starts), 512):
                part = starts[a : a + 512]
                keys = self._keys(self._walk(padded[part[:, None] + np.arange(self.longest)], 2 * n), n)
                left = np.searchsorted(self.keys, keys.ravel(), "left")
                hit = left < len(self.keys)
                hit[hit] = self.keys[left[hit]] == keys.ravel()[hit]
                if not hit.any():
                    continue
                left = left[hit]
                counts = np.searchsorted(self.keys, keys.ravel()[hit], "right") - left
                start = np.repeat(np.repeat(part, self.repeats)[hit], counts)
                block = self.owners[np.repeat(left - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
                found.append(np.unique(np.stack([self.block_item[block], start - self.block_at[block]], axis=1), axis=0))
        return [tuple(x) for x in np.unique(np.concatenate(found), axis=0).tolist()] if found else []

    def matches(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(item_id, edits, first word) of the best match found of each item that the text holds."""
        raw = words_of(text)
        get = self.ids.get
        words = np.fromiter(map(get, raw, repeat(0)), np.int64, len(raw))
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        for item, start in self.candidates(words):
            n = len(self.items[item][1])
            k = self.edits(n)
            if item in done and start < done[item]:
                continue  # inside what was verified for the item already
            low = max(0, start - 2 * k - 1)
            done[item] = start + 1 + k
            edits, end = edit_distance_within(self.mask(item), n, words[low : max(0, start + n + 3 * k + 2)].tolist())
            if edits <= k and (item not in best or edits < best[item][0]):
                best[item] = (edits, max(0, low + end - n + 1))
        return [(self.items[i][0], e, s) for i, (e, s) in sorted(best.items())]


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items (null texts left out) in blocks of bounded size, one of which is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("t")).filter("t IS NOT NULL")
    block, size, some = [], 0, False
    for r in rows.orderBy("item_id", "t").toLocalIterator():
        block.append((r["item_id"], bytes(r["t"])))
        size += len(r["t"]) + 64
        if size > block_bytes:
            yield block
            block, size, some = [], 0, True
    if block or not some:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """(doc_id, item_id, edits, first_word): for each row of docs the items that its whole text holds, with the edits of the
    best match found (another place of the text may hold it with fewer).

    Null, empty and short texts hold nothing; repeated rows give repeated results; null ids are carried. Items without
    words match nothing; repeated items match alike. An empty table on either side gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    out = None
    for block in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(block, edit_share))

        def run(batches, shared=shared):
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in shared.value.matches(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "item_id", "edits", "first_word"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def _clean_column(spark, matcher: Matcher):
    """A function of a binary text column: whether the text holds none of the matcher's items."""
    shared = spark.sparkContext.broadcast(matcher)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.matches(t) for t in texts], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with the columns of docs. Null, empty and short texts hold
    nothing and stay; so do all rows if the benchmark is empty or has no words. An empty table gives an empty result."""
    for block in blocks_of(benchmark):
        docs = docs.filter(_clean_column(docs.sparkSession, Matcher(block, edit_share))(F.col("text").cast("binary")))
    return docs
