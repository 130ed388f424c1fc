"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits, zero-padded to 23). The binary Golay code
(23, 12) is perfect: every 23-bit word lies within 3 bits of exactly one codeword. A word *owns* the index of its
nearest codeword and *reaches* the indices of the codewords nearest to itself and to each word one bit away (at most
six, usually six). If two segments differ in one bit at most, what one owns the other reaches.

Pigeonhole: of three errors over three segments, the segment with most has at least one (or there is no error at
all), so the other two have at most two errors together, and never two in one of them unless the third has fewer
than that - whichever way, some pair of segments has at most one error in each. So a key is a pair of segments with
a codeword index each (24 bits): 3 owned keys a fingerprint, about 85 reached ones. Equal keys are joined and every
pair is verified on all 64 bits.

Unrelated fingerprints share a key once there are more of them than keys, so from ``WIDE_FROM`` fingerprints on four
segments of 16 bits are keyed by three (36 bits): 4 owned keys, about 360 reached ones. Without the segment that has
most of three errors, the other three have one each at most and one of them has none. Both ways find the same links.

Copies: equal fingerprints are one node. Keys that many fingerprints own (a large group of near copies) leave the
join: their members are cut into tiles and each tile emits a spanning forest of its links instead of all its pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.llm._common import as_row, components, written

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_GENERATOR = 0b110001110101

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
#: Crowded keys that are sent to every executor; more of them are joined by a shuffle.
MOST_SENT = 1 << 17
WIDE_SEGMENTS, WIDE_FROM = ((48, 16), (32, 16), (16, 16), (0, 16)), 1 << 22


def fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; 0 for none or no words.

    Only A-Z are lower-cased and only ASCII white space separates words. A bit is set if it is set in more than half
    of the XXH64 hashes (seed 42) of the shingles, repeats included; a text of fewer words is one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= words_per_shingle:
        return int.from_bytes(digest(joined, 42), "big")
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: -words_per_shingle])]
    raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[words_per_shingle - 1 :], strict=True)])
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs. Null text counts as empty; null ids stay null."""

    def run(batches):
        for batch in batches:
            out = np.fromiter((fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator polynomial."""
    left = words.astype(np.int64, copy=True)
    for bit in range(22, 10, -1):
        left ^= np.where((left >> bit) & 1, GOLAY_GENERATOR << (bit - 11), 0)
    return left


_LEADERS: np.ndarray | None = None


def _leaders() -> np.ndarray:
    """The one error pattern of weight 3 at most for each of the 2048 syndromes."""
    global _LEADERS
    if _LEADERS is None:
        errors = np.array([sum(1 << b for b in bits) for weight in range(4) for bits in combinations(range(23), weight)], np.int64)
        found = np.zeros(2048, np.int64)
        found[_syndromes(errors)] = errors
        _LEADERS = found
    return _LEADERS


def golay_index(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each 23-bit word."""
    return (words ^ _leaders()[_syndromes(words)]) >> 11


def golay_reach(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, k) indices of the codewords nearest to each word or to a word one of its low bits away; -1 fills repeats."""
    near = np.stack([golay_index(words), *(golay_index(words ^ (1 << b)) for b in range(bits))], axis=1)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, axis=1)
    return near[:, : max(1, int((near >= 0).sum(axis=1).max(initial=1)))]


def fuzzy_keys(fps: np.ndarray, owned: bool, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) arrays: the keys that each fingerprint owns, or all that it reaches."""
    bits, segments = fps.view(np.uint64), WIDE_SEGMENTS if wide else SEGMENTS
    parts = [((bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in segments]
    own = [golay_index(p) for p in parts]
    sets = [o[:, None] if owned else golay_reach(p, width) for o, p, (_, width) in zip(own, parts, segments, strict=True)]
    most = len(segments) - 1
    rows, keys = [], []
    for number, chosen in enumerate(combinations(range(len(segments)), most)):
        full, key, exact = np.True_, np.int64(number), np.bool_(not wide)
        for place, i in enumerate(chosen):
            a = sets[i].reshape(len(fps), *(sets[i].shape[1] if x == place else 1 for x in range(most)))
            full = full & (a >= 0)
            exact = exact | (a == own[i].reshape(-1, *[1] * most))  # of a wide key one segment has no error
            key = (key << 12) | a
        found = full & exact
        rows.append(np.nonzero(found)[0])
        keys.append(key[found])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(nodes: DataFrame, owned: bool, wide: bool = False) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                rows, keys = fuzzy_keys(part := np.ascontiguousarray(fps[at : at + 4096]), owned, wide)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def spanning_links(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """A spanning forest of the graph that links fingerprints at max_bits bits or fewer, by breadth-first search.

    What a search has reached leaves the array, so that a dense group of near copies costs little more than its size.
    """
    left, out = np.unique(fps.view(np.uint64)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                out.append((np.full(len(found), at), found))
                queue.extend(found)
    if not out:
        return np.empty((0, 2), np.int64)
    return np.stack([np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])], axis=1).view(np.int64)


def links(nodes: DataFrame, max_bits: int = 3, hot: int = 96, tile: int = 8192, wide_from: int = WIDE_FROM) -> DataFrame:
    """(a, b) links of distinct fingerprints nodes(fp), enough of them that each linked group stays connected.

    Keys with up to ``hot`` owners give all their links; a key with more gives a spanning forest of each pair of its
    tiles of about ``tile`` members. Nothing is dropped on either way.
    """
    if max_bits > 3:
        raise ValueError("the pigeonhole over Golay segments holds for 3 bits at most")
    wide = nodes.count() >= wide_from
    owners = written(_keys(nodes, True, wide), "golay-owned")
    crowded = written(owners.groupBy("key").count().filter(F.col("count") > hot).select("key"), "golay-hot")
    reach = _keys(nodes, False, wide)
    some = crowded.count()
    plain = owners.join(crowded, "key", "left_anti") if some else owners
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    # Reached keys are many more than Spark expects of their fingerprints: unhinted, it would broadcast them all.
    found = reach.hint("merge").join(plain.withColumnRenamed("fp", "other"), "key").filter((F.col("fp") != F.col("other")) & near)
    found = found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    if some:
        members = written(reach.join(F.broadcast(crowded) if some <= MOST_SENT else crowded.hint("merge"), "key"), "golay-members")
        tiles = members.groupBy("key").count().select("key", F.ceil(F.col("count") / tile).cast("int").alias("n"))
        mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        dealt = members.join(tiles, "key").withColumn("m", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = dealt.select("key", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), "fp")

        def forest(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(spanning_links(pdf["fp"].to_numpy(), max_bits), columns=["a", "b"])

        found = found.unionByName(dealt.groupBy("key", "x", "y").applyInPandas(forest, "a long, b long"))
    return found


def near_duplicates(docs: DataFrame, max_bits: int = 3, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable over links.

    Null ids stay in their group but never name it, unless all are null. An empty table gives an empty result.
    Repeated rows give repeated rows. Texts without words share the fingerprint zero.
    """
    fps = written(fingerprints(docs, words_per_shingle), "simhash-fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    group = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    linked = nodes.join(group, "fp")
    first = linked.groupBy("component").agg(F.min("first").alias("least"))
    least = linked.join(first, "component").select("fp", "least")
    # A table of its own, so that the join below has a plain exchange on either side: Spark can split a hot fingerprint.
    of_fp = written(nodes.join(least, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-groups")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Near-duplicate documents: the sets of five-word shingles of two texts have at least LIKE / OF (0.8) of their union in
#: common. Texts of fewer than SHINGLE words have none, so that only equal ones are near.
SHINGLE, LIKE, OF = 5, 4, 5
#: Keys a text has: KEYED Golay-coded SimHash fingerprints of its distinct words, and BANDS of BAND_ROWS minima of its
#: shingles. Texts of similarity s share one of the latter with probability 1 - (1 - s ** BAND_ROWS) ** BANDS: 0.99997 at 0.8.
KEYED, BANDS, BAND_ROWS = 4, 20, 4
#: A sketch has four bits for each of SKETCH minima, in 8 longs. Two sketches differ in SKETCH * (1 - s) * 15 / 16 places on
#: average: of pairs of similarity 0.8 or more one in 10 ** 9 differs in over APART, and such pairs are never candidates, in
#: groups of any size. Of pairs of similarity 0.43 (texts that share a template of 60%) one in 200 is a candidate.
SKETCH, APART = 128, 53
#: Odd multipliers that draw fingerprints and minima from one hash; made by a rule.
TURNS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 | 1) & (2**64 - 1) for i in range(KEYED + SKETCH + SHINGLE)], np.uint64)
NIBBLES = np.uint64(0x1111111111111111)
#: A group of related texts is compared in tiles of this many texts and shingles at most, about.
TILE_ROWS, TILE_SHINGLES = 8192, 1 << 21


def _mixed(hashes: np.ndarray, turn) -> np.ndarray:
    mixed = hashes * turn
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _majority(hashes: np.ndarray, turns: np.ndarray) -> list[int]:
    """One signed 64-bit fingerprint a turn: the bits set in more than half of the hashes, each remixed by the turn."""
    out = []
    for turn in turns:
        mixed = _mixed(hashes, turn)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 16):
            ones += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(mixed)).view(np.int64)[0]))
    return out


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of SKETCH multipliers."""
    turns = TURNS[KEYED : KEYED + SKETCH, None]
    least = np.full(SKETCH, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[None, at : at + 512] * turns).min(axis=1), out=least)
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    """A signed key a band, of BAND_ROWS minima each."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys ^ row, TURNS[0])
    return keys.view(np.int64)


def golay_names(fps: np.ndarray) -> np.ndarray:
    """(n, KEYED) keys of (n, KEYED) signed fingerprints: the slot and the Golay indices of all three segments."""
    bits, out = fps.view(np.uint64), np.broadcast_to(np.arange(KEYED, dtype=np.int64), fps.shape)
    for shift, width in SEGMENTS:
        out = (out << 12) | golay_index(((bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
    return out


class _WordHashes(dict):
    """The hash of each word, kept for up to 400,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORD_HASHES = _WordHashes()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))


def words_name(words: list[bytes]) -> int:
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), 42), "big", signed=True)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The sorted hashes of the distinct shingles of words, given as hashes; none below SHINGLE words."""
    if len(hashes) < SHINGLE:
        return np.empty(0, np.uint64)
    many = len(hashes) - SHINGLE + 1
    total = np.zeros(many, np.uint64)
    for j, turn in enumerate(TURNS[KEYED + SKETCH :]):
        total = _mixed(total + hashes[j : j + many], turn)
    return np.unique(total)


def shingled(text: bytes | None) -> tuple[int, int, list[int], np.ndarray, list[int]]:
    """(hash of the words, number of distinct shingles, KEYED word fingerprints, BANDS keys, the sketch as longs) of a
    whole text; the last three are empty or zero below SHINGLE words."""
    words = (text or b"").lower().split()
    hashes = _word_hashes(words)
    shingles = shingle_set(hashes)
    if not len(shingles):
        return words_name(words), 0, [], np.empty(0, np.int64), [0] * (SKETCH // 16)
    least = _minima(shingles)
    four = (_mixed(least, TURNS[1]) >> np.uint64(17)).astype(np.uint8) & 15
    sketch = (four[::2] << 4 | four[1::2]).view(np.int64).tolist()
    return words_name(words), len(shingles), _majority(np.unique(hashes), TURNS[:KEYED]), _band_keys(least), sketch


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, name, t, n, sketch, keys) for every row of docs; t is the hash of the text as it stands."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # texts and keys of so many rows at once
                batch = whole.slice(at, 512)
                got = [shingled(t) for t in batch.column(2).to_pylist()]
                golay = iter(golay_names(np.array([x[2] for x in got if x[2]], np.int64).reshape(-1, KEYED)))
                keys = [np.concatenate([next(golay), x[3]]) if x[2] else x[3] for x in got]
                long = lambda values: pa.array(values, pa.int64())
                columns = [long([x[0] for x in got]), batch.column(1), long([x[1] for x in got])]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in ([x[4] for x in got], keys)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *lists], names=["doc_id", "name", "t", "n", "sketch", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, name long, t long, n long, sketch array<bigint>, keys array<bigint>")


def shingle_sets(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, s): the shingles of the texts of docs whose hash is in texts(t, name), once each."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingle_set(_word_hashes((t or b"").lower().split())).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["name", "s"])

    found = docs.select(F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text")).join(texts, "t")
    return found.groupBy("name").agg(F.first("text").alias("text")).mapInArrow(run, "name long, s array<bigint>")


def cross_links(names: np.ndarray, classes: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """(a, b) names of links at LIKE / OF and more between texts of different classes, enough to join every two classes
    that have one (a link joins its classes for what follows)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    begin = np.cumsum(sizes) - sizes
    marked = np.zeros(int(flat.max()) + 1, np.int8)
    of, out = np.unique(classes, return_inverse=True)[1], []
    for i in range(len(names) - 1):
        rest = np.nonzero(of[i + 1 :] != of[i])[0] + i + 1
        if not len(rest):
            continue
        fit = OF * np.minimum(sizes[rest], sizes[i]) >= LIKE * np.maximum(sizes[rest], sizes[i])
        rest = rest[fit]
        unlike = sketches[rest] ^ sketches[i]
        unlike |= unlike >> np.uint64(2)
        unlike |= unlike >> np.uint64(1)
        rest = rest[np.bitwise_count(unlike & NIBBLES).sum(axis=1) <= APART]
        if not len(rest):
            continue
        own = flat[begin[i] : begin[i] + sizes[i]]
        marked[own] = 1
        ends = np.cumsum(sizes[rest])
        at = np.repeat(begin[rest] - (ends - sizes[rest]), sizes[rest]) + np.arange(ends[-1])
        both = np.add.reduceat(marked[flat[at]].astype(np.int32), ends - sizes[rest])
        marked[own] = 0
        for j in rest[OF * both >= LIKE * (sizes[rest] + sizes[i] - both)].tolist():
            if of[j] != of[i]:
                out.append((names[i], names[j]))
                of[of == of[j]] = of[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _near(n, m) -> Column:
    """Whether sets of n and m shingles can have LIKE / OF of their union in common."""
    return OF * F.least(n, m) >= LIKE * F.greatest(n, m)


def _apart(a: Column, b: Column) -> Column:
    """In how many places of four bits two sketches differ."""
    out = F.lit(0)
    for i in range(SKETCH // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        out = out + F.bit_count(x.bitwiseAND(F.lit(int(NIBBLES))))
    return out


def similar_links(texts: DataFrame, docs: DataFrame, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(a, b) names of near-duplicate texts of docs, given as texts(name, t, n, sketch, keys), enough that each linked
    group stays connected. Rows grow with the texts, not with the pairs of a group:

    1. Stars. Of the texts that share a key, each is paired with the least name only. A star pair that may be similar
       (by size and sketch) relates its texts; related texts make families.
    2. Strays. Texts that share a key but no family are paired wherever they may be similar.
    3. Each text's closest star pair and all strays are verified by the exact similarity of the sets of shingles, which
       makes classes.
    4. A family of several classes is compared in one place, class against class, in tiles if it is large: a text comes
       once for each tile that it must meet, however many keys it shares. Tiles of one class don't meet.
    """
    least = F.min("name").alias("lead")
    keyed = texts.select("name", F.explode("keys").alias("key"))
    leads = keyed.groupBy("key").agg(least, F.max("name").alias("last")).filter("lead < last").select("key", "lead")
    shared = written(keyed.join(leads, "key"), "simhash-shared")
    facts = written(texts.select("name", "t", "n", "sketch"), "simhash-facts")
    theirs = facts.select(*(F.col(c).alias(f"l_{c}") for c in ("name", "n", "sketch")))
    col = F.col
    stars = shared.filter("name <> lead").select("name", col("lead").alias("l_name")).distinct().join(facts, "name").join(theirs, "l_name")
    stars = stars.withColumn("apart", _apart(col("sketch"), col("l_sketch"))).filter(_near(col("n"), col("l_n")) & (col("apart") <= APART))
    stars = written(stars.select(col("name").alias("a"), col("l_name").alias("b"), "apart"), "simhash-stars")
    family = components(stars).withColumnRenamed("component", "family")

    kin = shared.select("key", "name").join(family.withColumnRenamed("node", "name"), "name", "left").withColumn("family", F.coalesce("family", "name"))
    mixed = kin.groupBy("key").agg(F.min("family").alias("low"), F.max("family").alias("high")).filter("low < high").select("key")
    kin = written(kin.join(mixed, "key").join(facts.drop("t"), "name"), "simhash-kin")
    other = kin.select("key", *(col(c).alias(f"l_{c}") for c in ("name", "family", "n", "sketch")))
    may = (col("name") < col("l_name")) & (col("family") != col("l_family")) & _near(col("n"), col("l_n")) & (_apart(col("sketch"), col("l_sketch")) <= APART)
    strays = kin.join(other, "key").filter(may).select(col("name").alias("a"), col("l_name").alias("b")).distinct()
    closest = stars.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    pairs = written(strays.unionByName(closest), "simhash-pairs")

    named = pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(family.select(col("node").alias("name"))).distinct()
    # Tables of their own, so that texts of which no part is wanted stay where they are while the names are few.
    sets = written(shingle_sets(docs, written(facts.join(named, "name").select("t", "name"), "simhash-named")), "simhash-sets")
    sets_a, sets_b = (sets.select(col("name").alias(x), col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(sets_a, "a").join(sets_b, "b").filter(OF * both >= LIKE * (F.size("sa") + F.size("sb") - both))
    found = written(found.select("a", "b"), "simhash-verified")

    classes = components(found).withColumnRenamed("component", "class")
    members = family.join(classes, "node", "left").select(col("node").alias("name"), "family", F.coalesce("class", "node").alias("class"))
    members = written(members.join(facts.select("name", "n", "sketch"), "name"), "simhash-members")
    # The largest class of a family has tiles of its own, from 0; the rest of the family has the tiles after them.
    sized = members.groupBy("family", "class").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    whole = sized.groupBy("family").agg(F.sum("c").alias("all_c"), F.sum("w").alias("all_w"), F.max(F.struct("c", "class", "w")).alias("top"))
    whole = whole.filter((col("all_c") > 2) & (col("all_c") > col("top.c")))  # a family of two is one pair, already verified
    tiles = lambda c, w: F.greatest(F.ceil(c / tile_rows), F.ceil(w / tile_shingles), F.lit(1)).cast("int")
    whole = whole.select("family", col("top.class").alias("top"), tiles(col("top.c"), col("top.w")).alias("x"), tiles(col("all_c") - col("top.c"), col("all_w") - col("top.w")).alias("y"))
    dealt = members.join(written(whole, "simhash-families"), "family").withColumn("in", col("class") == col("top"))
    mine = F.when(col("in"), F.pmod(F.xxhash64("name"), col("x"))).otherwise(col("x") + F.pmod(F.xxhash64("name"), col("y"))).cast("int")
    meets = F.sequence(F.when(col("in"), col("x")).otherwise(F.lit(0)), col("x") + col("y") - 1)
    dealt = dealt.withColumn("m", mine).select("family", "class", "name", "sketch", "m", F.explode(meets).alias("o"))
    dealt = dealt.select("family", F.least("m", "o").alias("p"), F.greatest("m", "o").alias("q"), "class", "name", "sketch").join(sets, "name")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sketches = np.stack(pdf["sketch"].to_list()).astype(np.int64).view(np.uint64)
        return pd.DataFrame(cross_links(pdf["name"].to_numpy(), pdf["class"].to_numpy(), sketches, [np.asarray(s) for s in pdf["s"]]), columns=["a", "b"])

    return found.unionByName(written(dealt.groupBy("family", "p", "q").applyInPandas(compare, "a long, b long"), "simhash-crossed"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, name, t) of the rows of docs and (name, group, component_id) of their texts."""
    rows = written(shingle_rows(docs), "simhash-wide")
    same = [F.first(c).alias(c) for c in ("n", "sketch", "keys")]
    nodes = written(rows.groupBy("name").agg(F.min("doc_id").alias("first"), F.min("t").alias("t"), *same), "simhash-nodes")
    group = components(similar_links(nodes.filter("n > 0"), docs))
    linked = nodes.select("name", "first").join(group.withColumnRenamed("node", "name"), "name")
    least = linked.join(linked.groupBy("component").agg(F.min("first").alias("least")), "component").select("name", "component", "least")
    of = nodes.select("name", "first").join(least, "name", "left").select("name", F.coalesce("component", "name").alias("group"), F.coalesce("least", "first").alias("component_id"))
    return rows.select("doc_id", "name", "t"), written(of, "simhash-groups")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, name, component_id) for every row of docs: groups of texts that are equal word for word or linked by
    similarity of five-word shingles; component_id is the smallest doc_id of the group.

    Null and empty texts have no words and are equal to each other; texts of fewer than five words are near only if
    equal. Null ids stay in their group but never name it. An empty table gives an empty result.
    """
    rows, of = _grouped(docs)
    return rows.join(of, "name").select("doc_id", "name", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The columns of docs; of each group of near-duplicate texts (similar_groups) a row with the smallest doc_id stays.

    Of rows of a group that repeat that doc_id, one with the least hash of its words stays, and of those the one with the
    smallest text hash. An id that has texts of several groups stays once for each group that it names. Rows without an
    id are kept, as nothing tells which of them to keep. Null and empty texts are one group. Columns of any name are
    carried as they are; long texts are read whole. An empty table gives an empty result.
    """
    rows, of = _grouped(docs)
    kept = rows.join(of, "name").filter("doc_id = component_id").groupBy("group").agg(F.min(F.struct("doc_id", "name", "t")).alias("x"))
    kept = kept.select(F.col("x.doc_id").alias("id"), F.col("x.t").alias("text_hash"))
    named = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"))
    # A row that is repeated often is one row a task before it is shuffled.
    once = named.join(kept, ["id", "text_hash"], "left_semi").groupBy("id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.select("row").unionByName(named.filter("id IS NULL").select("row")).select("row.*")
