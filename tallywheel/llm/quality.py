"""Quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text: rates of marks, digits, repeats and the like, and hashed
shares of its words and of the three-byte sequences in it. The weights are learned from preference pairs (a document
labelled good beats one labelled bad) by logistic loss on the feature differences; a quantile of the scores of the
labelled documents is the threshold. Training reads a bounded sample of the labelled documents; scoring is one pass over
all texts that stores no features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm._common import fold, written

FEATURES = ("upper", "symbols", "pipes", "bangs", "stutter", "variety", "digits", "word_length", "log_words", "bad_lines")
#: Rates also enter as logarithms, so that a bad part of a long good text still counts.
LOGGED = ("upper", "symbols", "pipes", "bangs", "stutter", "digits")
NAMES = FEATURES + tuple(f"log_{x}" for x in LOGGED)
EPS = 1e-3
BUCKETS = 512  # of the words, and again of the three-byte sequences
BLOCK = 1 << 20  # bytes hashed at a time
MOST_ROWS = 6000  # labelled documents of each class that training reads


def _uppers(text: str) -> int:
    low = text.lower()
    if len(low) != len(text):
        return sum(a != a.lower() for a in text)
    return int(np.count_nonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)))


def features(text: str | None) -> list[float]:
    """The features of a whole text; all rates are 0 for an empty or null one."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    count = text.count
    symbols = sum(map(count, "*%&$#"))
    bad = 0
    for line in text.split("\n"):
        k = line.count(" ") + 1
        if (line.count("|") + line.count("!") + line.count("*") + line.count("&") + line.count("$") + line.count("%") + line.count("#")) * 2 > k:
            bad += k
    rates = [
        _uppers(text) / chars,
        symbols / n,
        count("|") / n,
        count("!") / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n ** 0.75,
        sum(map(count, "0123456789")) / chars,
        (len(text) - len(words)) / n,
        float(np.log(n)),
        min(1.0, bad / n),
    ]
    return rates + [float(np.log(rates[FEATURES.index(x)] + EPS)) for x in LOGGED]


def shares(text: str | None) -> np.ndarray:
    """Square roots of the shares of each bucket of words, then of each bucket of three-byte sequences, in lower case; zeros
    where there are none."""
    low = (text or "").lower()
    out = np.zeros(2 * BUCKETS)
    for word, n in Counter(low.split()).items():
        out[zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS] += n
    data = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, max(0, len(data) - 2), BLOCK):
        x = data[at : at + BLOCK + 2].astype(np.uint32)
        h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
        out[BUCKETS:] += np.bincount(h >> 23, minlength=BUCKETS)
    for part in (out[:BUCKETS], out[BUCKETS:]):
        if total := part.sum():
            part[:] = np.sqrt(part / total)
    return out


def vector(text: str | None) -> np.ndarray:
    return np.concatenate([features(text), shares(text)])


WIDTH = len(NAMES) + 2 * BUCKETS


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f) for every row of docs: vector() as 32-bit floats."""

    def run(batches):
        for batch in batches:
            rows = [vector(t).astype("<f4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, f binary")


def _solve(times, right: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Conjugate gradients for a positive definite matrix that is given by its product with a vector."""
    x, r = np.zeros_like(right), right.copy()
    d, size = r.copy(), right @ right
    least = 1e-12 * size
    for _ in range(rounds):
        if size <= least:
            break
        m = times(d)
        x += (step := size / (d @ m)) * d
        r -= step * m
        size, was = r @ r, size
        d = r + size / was * d
    return x


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs: int = 20_000, penalty: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on feature differences of random (better, worse) pairs, by Newton's method.

    A pair's difference is never formed: what the pairs say of a document is summed before it meets the document's features.
    """
    rng = np.random.default_rng(seed)
    x = np.concatenate([better, worse])
    a, b = rng.integers(0, len(better), pairs), len(better) + rng.integers(0, len(worse), pairs)
    back = lambda v: x.T @ (np.bincount(a, v, len(x)) - np.bincount(b, v, len(x))).astype(x.dtype) / pairs
    w = np.zeros(x.shape[1])
    for _ in range(30):
        s = x @ w.astype(x.dtype)
        p = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30).astype(float)))
        curve = p * (1 - p)

        def times(v, curve=curve):
            t = x @ v.astype(x.dtype)
            return back(curve * (t[a] - t[b])) + penalty * v

        step = _solve(times, penalty * w - back(p))
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def threshold(bad: np.ndarray, good: np.ndarray, n0: int, n1: int) -> float:
    """The quantile of all scores at the share of label 0, between the two neighbours that it parts; bad and good are the
    scores of samples of n0 and n1 documents."""
    scores = np.concatenate([bad, good])
    weight = np.concatenate([np.full(len(bad), n0 / len(bad)), np.full(len(good), n1 / len(good))])
    order = np.argsort(scores, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), n0 * (1 + 1e-9)))
    at = min(max(at, 1), len(scores) - 1)
    return float(scores[order][at - 1] + scores[order][at]) / 2


def sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> tuple[list[np.ndarray], list[int]]:
    """(features of at most most_rows documents, number of all documents) of class 0 and of class 1, outside fold 1.

    The ids come first, by hash, so that only the texts of chosen documents are looked at.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 1))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    counts = {r["y"]: r["count"] for r in rows.join(mine, "doc_id").groupBy("y").count().collect()}  # two rows
    order = F.xxhash64("doc_id")
    got = []
    for y in (0, 1):
        chosen = rows.filter(F.col("y") == y).join(mine.distinct(), "doc_id", "left_semi").select("doc_id").distinct().orderBy(order).limit(most_rows)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
        # An id may have many rows; the limit holds for rows.
        f = [np.frombuffer(r["f"], "<f4") for r in feature_table(texts).orderBy(order, "f").limit(most_rows).collect()]
        got.append(np.array(f, np.float32).reshape(-1, WIDTH))
    return got, [counts.get(0, 0), counts.get(1, 0)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> dict:
    """The model from labelled rows outside fold 1; at most most_rows of each class, the first by hash of the id.

    Without both classes, or without labels, the model is constant: the smoothed share of label 1.
    """
    got, (n0, n1) = sample(docs, labels, label, most_rows)
    if not n0 or not n1:
        return {"constant": (n1 + 1) / (n0 + n1 + 2)}
    both = np.concatenate(got)
    mean, sd = both.mean(0, dtype=float), both.std(0, dtype=float) + 1e-6
    # Rates are scaled one by one; the buckets as a whole, to the variance of all rates, so that rare buckets stay small.
    sd[len(NAMES) :] = np.sqrt((sd[len(NAMES) :] ** 2).sum() / len(NAMES))
    got = [((x - mean) / sd).astype(np.float32) for x in got]
    w = fit_pairs(got[1], got[0])
    bad, good = (np.sort(x @ w) for x in got)
    spread = max(1e-6, float(np.median(good) - np.median(bad)) / 8)
    return {"w": w / sd / spread, "b": float(-(mean / sd) @ w - threshold(bad, good, n0, n1)) / spread}


def score(text: str | None, model: dict) -> float:
    """0 to 1; 0.5 at the threshold."""
    if "constant" in model:
        return float(model["constant"])
    z = float(vector(text) @ model["w"]) + model["b"]
    return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Empty and null texts have a score like any other; repeated rows give equal scores; a null id is never held out. Long
    texts are hashed in blocks. An empty table gives an empty result.
    """
    model = train(docs, labels, label)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t, model) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_best(docs: DataFrame, labels: DataFrame, share: float = 0.8, label: str = "quality") -> DataFrame:
    """doc_id, score of the documents above the score quantile that leaves about `share` of all of them; with equal scores at
    the quantile, all of these stay."""
    out = written(scores(docs, labels, label), "quality-scores")
    cut = out.agg(F.percentile_approx("score", 1 - share, 10_000)).first()[0]
    return out.filter(F.col("score") >= (cut if cut is not None else 0.0)).select("doc_id", "score")
