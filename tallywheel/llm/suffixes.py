"""Removal of long repeated passages by run-length indexes (run-compressed Burrows-Wheeler transforms).

A string of LENGTH bytes that starts at two places or more is repeated. Where to look: the *key* of such a window is the
least hash among its k-byte grams, which depends on nothing but the window, so equal windows have equal keys wherever they
stand. A text is cut into segments, the maximal runs of windows of one key (about one for every (LENGTH - k) / 2 bytes),
and a segment's snippet is the bytes that its windows cover. Snippets are known by a hash first: those that are equal
become one with a count, and keys that no second snippet has leave, before any text is moved.

How it is decided: the distinct snippets of a key are in one block, each block of about BLOCK bytes is a run-length index,
and the matching statistics of its own snippets are streamed from it: the longest match of every byte's suffix with a
suffix that starts elsewhere. Windows whose match is of LENGTH bytes or more are repeated, as are all windows of a snippet
that occurs twice. Snippets of a block that don't share a key have no window in common, so blocks may mix keys.

A key with too many distinct snippets for a block (they share a gram and differ around it) is cut again with longer grams:
GRAMS in turn, and with the last one, the window itself, all snippets of a key are equal. Nothing is dropped on the way.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm._common import forget, written

LENGTH = 400
#: Shares of a window that a gram covers, in turn: 128, 384 and 400 of 400 bytes.
GRAMS = (0.32, 0.96, 1.0)
#: Bytes of snippets in an index; a key with more than a quarter of it is cut with longer grams.
BLOCK = 1 << 20
#: Windows in a segment at most, and bytes of text whose grams are in memory at once.
MOST_WINDOWS, PIECE = 1 << 15, 1 << 20
_R, _MIX, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


# -- the index


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes of text (bytes), whose strings end at the sorted positions `ends` (each a separator that is
    less than any byte and unlike all others, ascending). Prefix doubling, over the suffixes not yet told apart."""
    n = len(text)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # bytes before the separator
    h = 7
    char, key = np.r_[text.astype(np.int64) + 1, np.zeros(h, np.int64)], np.zeros(n, np.int64)
    for j in range(h):
        key = 257 * key + np.where(left > j, char[j : n + j], 0)
    order = np.argsort(key, kind="stable")  # stable: strings that end within h bytes are in the order of their separators
    ranks = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (left[order[1:]] < h)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks[order] = head
    alone = new & np.r_[new[1:], True]
    at = np.nonzero(~alone)[0]
    while len(at):
        mine = order[at]
        pair = ranks[mine] * n + ranks[np.minimum(mine + h, n - 1)]
        by = np.argsort(pair)
        mine, pair = mine[by], pair[by]
        order[at] = mine
        new = np.r_[True, pair[1:] != pair[:-1]]
        ranks[mine] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of strings of bytes: a character and a length for each run, with the text
    position of the suffix at each run's first and last row."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes + 1)[:-1]].astype(np.int64)
        self.ends = self.starts + sizes
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        order = suffix_order(self.text, self.ends)
        # The character before a suffix; a string's first suffix follows a separator, which is unlike any other character.
        before = np.where(np.isin(order, self.starts), -1, self.text[order - 1].astype(np.int16))
        new = np.r_[True, (before[1:] != before[:-1]) | (before[1:] < 0)]
        rows = np.nonzero(new)[0]
        self.chars, self.lengths = before[rows], np.diff(np.r_[rows, len(order)])
        self.first, self.last = order[rows], order[np.r_[rows[1:], len(order)] - 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lengths of the longest common prefixes of the suffixes at a and b, each up to the end of its string."""
        n = len(self.text)
        most = np.minimum(self.ends[np.searchsorted(self.ends, a)] - a, self.ends[np.searchsorted(self.ends, b)] - b)
        padded, words = np.r_[self.text, np.zeros(8, np.uint8)], np.zeros(n, np.uint64)
        for j in range(8):
            words |= padded[j : n + j].astype(np.uint64) << np.uint64(8 * j)
        out, open_ = np.zeros(len(a), np.int64), np.nonzero(most > 0)[0]
        while len(open_):
            far = out[open_]
            unlike = words[a[open_] + far] ^ words[b[open_] + far]
            same = unlike == 0
            low = unlike & (~unlike + np.uint64(1))
            out[open_] += np.where(same, 8, np.log2(np.where(same, 1, low).astype(np.float64)).astype(np.int64) // 8)
            open_ = open_[same & (out[open_] < most[open_])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For every text position the longest match of its suffix with a suffix that starts elsewhere.

        The match with the next suffix in order is compared at the borders of runs only; within a run, a position's match
        is one less than that of the position before it, so the rest is streamed along the text.
        """
        n = len(self.text)
        border = self.common(self.last[:-1], self.first[1:])
        out = np.zeros(n, np.int64)
        for sampled, match in ((self.first, np.r_[0, border]), (self.last, np.r_[border, 0])):
            held, known = np.zeros(n, np.int64), np.zeros(n, bool)
            held[sampled], known[sampled] = match + sampled, True
            near = np.maximum.accumulate(np.where(known, np.arange(n), 0))
            np.maximum(out, held[near] - np.arange(n), out=out)
        return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each maximal run of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def repeated_windows(strings: list[bytes], counts: list[int], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each distinct string the runs (first, end) of starts of `length` bytes that occur elsewhere, in it, in another string
    or in a second copy of it."""
    index = RunIndex(strings)
    match = index.matching_statistics()
    out = []
    for start, end, n in zip(index.starts, index.ends, counts, strict=True):
        windows = max(0, end - start - length + 1)
        out.append(runs_of(np.ones(windows, bool) if n > 1 else match[start : start + windows] >= length))
    return out


# -- segments


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _R and of its inverse modulo 2^64."""
    out = []
    for base in (_R, pow(_R, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    if w == 1:
        return x
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring bytes."""
    size = 1 << max(PIECE.bit_length(), int(len(text)).bit_length())
    up, down = _powers(size)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(text * up[: len(text)], dtype=np.uint64)]
    out = (total[k:] - total[:-k]) * down[: len(text) - k + 1]
    for shift, by in ((32, _MIX), (29, _MIX2)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(by)
    return out ^ (out >> np.uint64(32))


def segments(pieces: list[np.ndarray], length: int, k: int, most: int):
    """(piece, start, windows, key, hash, inner) arrays over pieces of at least `length` bytes: the segments of each. inner:
    whether the least gram occurs in the segment twice, so that it may repeat itself."""
    w = length - k + 1
    text = np.concatenate(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    grams = gram_hashes(text, k)
    least = sliding_min(grams, w)
    edge = np.zeros(len(least) + 1, np.int64)
    np.add.at(edge, offsets, 1)
    np.add.at(edge, offsets + sizes - length + 1, -1)
    whole = np.cumsum(edge[:-1]) > 0
    same = np.r_[False, whole[1:] & whole[:-1] & (least[1:] == least[:-1])] if most > 1 else np.zeros(len(least), bool)
    start = np.nonzero(whole & ~same)[0]
    end = np.nonzero(whole & ~np.r_[same[1:], False])[0] + 1
    cuts = -(-(end - start) // most)
    if len(cuts) and cuts.max() > 1:
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start, end = np.repeat(start, cuts) + nth * most, np.repeat(end, cuts)
        end = np.minimum(end, start + most)
    key = least[start]
    inner = np.zeros(len(start), bool)
    if w > 1 and len(start):
        around = np.r_[np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]
        minima = np.nonzero(~sliding_min(~around, w) == grams)[0]
        low, high = np.searchsorted(minima, start), np.searchsorted(minima, end + w - 1)
        which = np.repeat(np.arange(len(start)), high - low)
        flat = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        inner = np.bincount(which, grams[minima[flat]] == key[which], minlength=len(start)) > 1
    piece = np.searchsorted(offsets, start, side="right") - 1
    view = memoryview(np.ascontiguousarray(text))
    digest = np.array([xxhash.xxh3_64_intdigest(view[a : b + length - 1]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
    return piece, start - offsets[piece], end - start, key.view(np.int64), digest.view(np.int64), inner


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a binary column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


_SEGMENTS = "a long, b long, n long, starts array<long>, windows int, key long, s long, inner boolean"


def _cut(texts: DataFrame, length: int, k: int, most: int) -> DataFrame:
    """texts(a, b, n, text binary) -> the segments of each text, those with equal snippets in one row with all their starts."""

    def run(batches):
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            data, offsets = _bytes(batch.column(3))
            rows, starts, pieces, held = [], [], [], 0

            def out(rows, starts, pieces):
                piece, start, *rest = segments(pieces, length, k, most)
                row, begin = np.array(rows)[piece], np.array(starts, np.int64)[piece] + start
                order = np.lexsort((begin, rest[2], rest[1], row))
                row, begin, windows, key, digest, inner = (x[order] for x in (row, begin, *rest))
                first = np.nonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])][: len(row)])[0]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(begin))
                arrays = [*(pa.array(x[row[first]], pa.int64()) for x in ids), lists, pa.array(windows[first].astype(np.int32)), pa.array(key[first]), pa.array(digest[first]), pa.array(np.logical_or.reduceat(inner, first) if len(first) else inner)]
                return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n", "starts", "windows", "key", "s", "inner"])

            for i in range(len(offsets) - 1):
                size = offsets[i + 1] - offsets[i]
                for at in range(0, max(0, size - length + 1), PIECE):  # a long text in pieces that overlap by a window
                    piece = data[offsets[i] + at : offsets[i] + min(size, at + PIECE + length - 1)]
                    rows.append(i)
                    starts.append(at)
                    pieces.append(piece)
                    held += len(piece)
                    if held >= PIECE:
                        yield out(rows, starts, pieces)
                        rows, starts, pieces, held = [], [], [], 0
            if pieces:
                yield out(rows, starts, pieces)

    return texts.select("a", "b", "n", "text").mapInArrow(run, _SEGMENTS)


def repeats(texts: DataFrame, length: int = LENGTH, grams: tuple[float, ...] = GRAMS, block: int = BLOCK) -> DataFrame:
    """texts(a, b, n, text binary), equal texts under equal (a, b) -> (a, b, runs): each text's starts of repeated strings, as
    sorted runs (low, high) that don't touch.

    n counts how often a row stands for its text.
    """
    k = max(1, min(length, round(length * grams[0])))
    last = len(grams) == 1 or k == length
    cut = written(_cut(texts.filter(F.octet_length("text") >= length), length, k, 1 if last else MOST_WINDOWS), "repeats-segments")
    times = F.sum(F.col("n") * F.size("starts"))
    shared = cut.groupBy("key").agg(times.alias("all"), F.max("inner").alias("inner")).filter("`all` > 1 OR inner").select("key")
    # Copies of a text are one from here on.
    places = written(cut.join(shared, "key", "left_semi"), "repeats-shared")
    places = written(places.groupBy("a", "b", "starts", "windows", "key", "s").agg(F.sum("n").alias("n")), "repeats-places")
    forget(cut)
    snippets = places.groupBy("key", "s").agg(times.alias("n"), F.min(F.struct("a", "b", F.col("starts")[0].alias("start"), "windows")).alias("at"))
    snippets = written(snippets.select("key", "s", "n", "at.*"), "repeats-snippets")
    sizes = snippets.groupBy("key").agg(F.sum(F.col("windows") + length - 1).alias("bytes"))
    crowded = sizes.filter(F.lit(not last) & (F.col("bytes") > block // 4)).select("key", F.lit(True).alias("crowded"))
    wanted = snippets.join(crowded, "key", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    wanted = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("start", "windows", "key", "s", "n", "crowded")).alias("wanted"))  # a text's own segments

    def take(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column(0))
            for i, wanted in enumerate(batch.column(1)):
                rows = wanted.as_py()
                text = data[offsets[i] : offsets[i + 1]]
                got = [text[r["start"] : r["start"] + r["windows"] + length - 1].tobytes() for r in rows]
                columns = [pa.array([r[c] for r in rows], t) for c, t in (("key", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("crowded", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.binary())], names=["key", "s", "n", "crowded", "text"])

    one_each = texts.select("a", "b", "text").dropDuplicates(["a", "b"])
    held = one_each.join(wanted, ["a", "b"]).select("text", "wanted").mapInArrow(take, "key long, s long, n long, crowded boolean, text binary")
    held = written(held, "repeats-texts")
    total = {r["crowded"]: r["bytes"] for r in held.groupBy("crowded").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    blocks = -(-total.get(False, 0) // block)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(pdf["text"].tolist(), pdf["n"].tolist(), length)
        counts = [len(low) for low, _ in found]
        return pd.DataFrame({"key": pdf["key"].repeat(counts).to_numpy(), "s": pdf["s"].repeat(counts).to_numpy(), "low": np.concatenate([low for low, _ in found]), "high": np.concatenate([high for _, high in found])})

    simple = held.filter("NOT crowded").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, blocks))))
    simple = simple.repartition(max(1, min(20_000, blocks)), "block").groupBy("block").applyInPandas(index, "key long, s long, low long, high long")
    found = found_here = written(simple, "repeats-runs")
    if total.get(True):
        more = held.filter("crowded").select(F.col("key").alias("a"), F.col("s").alias("b"), "n", "text")
        more = repeats(more, length, grams[1:], block).select(F.col("a").alias("key"), F.col("b").alias("s"), F.explode("runs").alias("run"))
        found = found.unionByName(more.select("key", "s", "run.low", "run.high"))
    # What a text gathers is its own segments.
    out = places.join(found, ["key", "s"]).groupBy("a", "b").agg(F.collect_list(F.struct("starts", "low", "high")).alias("runs"))

    def merge(batches):
        for batch in batches:
            lists = []
            for mine in batch.column(2).to_pylist():
                low = np.concatenate([np.array(r["starts"]) + r["low"] for r in mine])
                high = np.concatenate([np.array(r["starts"]) + r["high"] for r in mine])
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                first = np.nonzero(np.r_[True, low[1:] > high[:-1]])[0]
                lists.append([{"low": a, "high": b} for a, b in zip(low[first].tolist(), high[np.r_[first[1:], len(low)] - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], names=["a", "b", "runs"])

    out = written(out.mapInArrow(merge, "a long, b long, runs array<struct<low:long,high:long>>"), "repeats-found")
    forget(places, snippets, held, found_here)
    return out


def covered(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal byte ranges that windows starting in sorted runs [low, high) cover."""
    out: list[list[int]] = []
    for low, high in runs:
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + length - 1)
        else:
            out.append([low, high + length - 1])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """(doc_id, text_bytes, spans, kept): for every document its length, the ranges removed and the bytes left.

    Every byte that a repeated string of `length` bytes covers goes, at all of its places; a null text is empty, a text shorter
    than `length` keeps all; ids may be null or repeat, other columns are not looked at, a row that repeats another is a
    second place of all its strings. Long texts are cut in pieces that overlap by a window. An empty table has no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text")).withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    runs = repeats(rows.select("a", "b", F.lit(1).cast("long").alias("n"), "text"), length, **how)

    def run(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column(1))
            spans, kept, sizes = [], [], []
            for i, mine in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                gone = covered([(r["low"], r["high"]) for r in mine or ()], length)
                keep = np.ones(len(text), bool)
                for a, b in gone:
                    keep[a:b] = False
                spans.append([{"begin": a, "end": b} for a, b in gone])
                kept.append(text[keep].tobytes())
                sizes.append(len(text))
            shape = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, shape), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(runs, ["a", "b"], "left").select("doc_id", "text", "runs").mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = remove_repeats(docs, **how)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
