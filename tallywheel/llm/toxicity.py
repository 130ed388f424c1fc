"""Toxicity: a support vector machine with a gap-weighted subsequence string kernel and Nyström landmarks.

The kernel of two words sums, over all common subsequences of three characters, decay ** (spans of both), with spans up
to `SPAN`: a word with inserted or missing characters keeps most of its similarity. A sentence's margin is that of its
most toxic word, its witness.

Labels are of documents, and a document's sentences inherit its label, though most sentences of a toxic document are
harmless (multiple instances). So the machine is trained twice. The first one learns from words that sentences of toxic
documents have far more often than chance allows (a false discovery rate over all words), each also with a character put
in between. It then finds each labelled sentence's witness; the second one learns from the witnesses of toxic sentences
that it holds for toxic, against the witnesses of clean sentences and the common words of clean documents.

Landmarks span the kernel's feature space: K_nm K_mm^(-1/2) are the features of a linear SVM (squared hinge). As the
kernel has an explicit feature for each triple of characters, the trained machine folds into one weight a triple, and
scoring a word costs its length, whatever the number of landmarks. A document's score is a logistic function of the
margins of its two most toxic distinct words, fitted on the labelled documents.

Training reads a bounded sample of labelled documents (``MOST_DOCS`` of each class, the first by hash of the id); of
their words the machines see up to ``MOST_POSITIVE`` toxic, ``MOST_NEGATIVE`` and ``HARD`` clean ones. Scoring reads every
character of every text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm._common import fold, forget, written

MOST_DOCS = 3000
MOST_POSITIVE, MOST_NEGATIVE, HARD = 600, 8000, 3000
LANDMARKS = 320
SPAN, DECAY, LONG = 6, 0.7, 16
SYMBOLS = 64
NONE = -20.0  # the margin of a text without words
CACHE = 200_000
#: Of the words taken for toxic at first this share may be there by chance; margins count within +-EDGE.
FALSE_SHARE, EDGE = 0.1, 3.0
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|[\r\n]+")

#: Digits that stand for letters; all other ASCII that isn't a letter is dropped inside a word.
LOOKALIKE = str.maketrans("0134578", "oieastb", "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "269")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text: lower case, look-alike digits read as letters, marks inside words dropped,
    runs of three or more single characters joined."""
    words = (text or "").lower().translate(LOOKALIKE).split()
    return set(words) | {"".join(words[i:j]) for i, j in _spelled(words)}


def contexts_of(text: str | None) -> set[tuple[str, str]]:
    """The distinct (word, word before it) of a whole text; see words_of."""
    words = (text or "").lower().translate(LOOKALIKE).split()
    pairs = set(zip(words, ["", *words], strict=False))
    return pairs | {("".join(words[i:j]), words[i - 1] if i else "") for i, j in _spelled(words)}


def _spelled(words: list[str]) -> list[tuple[int, int]]:
    """Where runs of three or more words of one character begin and end."""
    single = [i for i, w in enumerate(words) if len(w) == 1]
    if len(single) < 3:
        return []
    out, run = [], [single[0]]
    for i in [*single[1:], -9]:
        if i == run[-1] + 1:
            run.append(i)
            continue
        if len(run) > 2:
            out.append((run[0], run[-1] + 1))
        run = [i]
    return out


class Kernel:
    """The explicit features of the subsequence kernel over an alphabet of 61 characters, two ends and a rest."""

    def __init__(self, alphabet: str):
        self.alphabet = alphabet[: SYMBOLS - 3]
        self.code = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(self.alphabet):
            self.code[ord(c)] = i + 1
        self.norm = np.array([1.0, *(self._norm(n) for n in range(1, LONG + 1))])

    @staticmethod
    def _norm(n: int) -> float:
        return max(1e-6, sum(DECAY ** (2 * (d + 1)) * max(0, n + 2 - d) * (d - 1) for d in range(2, SPAN))) ** 0.5

    def triples(self, words: list[str]):
        """Yields (word, triple, weight) arrays: every subsequence of three characters within SPAN."""
        text = "".join(f"\0{w}\0" for w in words)
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        codes[begin], codes[begin + sizes - 1] = SYMBOLS - 2, SYMBOLS - 1
        owner = np.repeat(np.arange(len(words)), sizes)
        scale = 1 / self.norm[np.minimum(sizes - 2, LONG)]
        for far in range(2, SPAN):
            same = owner[:-far] == owner[far:]
            who, a, c = owner[:-far][same], codes[:-far][same], codes[far:][same]
            weight = DECAY ** (far + 1) * scale[who]
            for near in range(1, far):
                yield who, (a * SYMBOLS + codes[near : len(codes) - far + near][same]) * SYMBOLS + c, weight

    def margins(self, words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(len(words), bias)
        for who, triple, weight in self.triples(words):
            out += np.bincount(who, weights[triple] * weight, len(words))
        return out


def _nystroem(kernel: Kernel, words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of words, the triples of the landmarks, the features' directions over those triples)."""
    parts = list(kernel.triples(landmarks))
    used = np.unique(np.concatenate([t for _, t, _ in parts]))
    marks = np.zeros((len(landmarks), len(used)))
    for who, triple, weight in parts:
        np.add.at(marks, (who, np.searchsorted(used, triple)), weight)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    basis = root.T @ marks  # rows: orthonormal directions over the used triples
    lookup = np.full(SYMBOLS**3, len(used), np.int64)
    lookup[used] = np.arange(len(used))
    out = np.empty((len(words), int(good.sum())))
    for at in range(0, len(words), 256):
        dense = np.zeros((len(words[at : at + 256]), len(used) + 1))
        for who, triple, weight in kernel.triples(words[at : at + 256]):
            np.add.at(dense, (who, lookup[triple]), weight)
        out[at : at + 256] = dense[:, :-1] @ basis.T
    return out, used, basis


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Weights and bias of a linear squared-hinge SVM by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        slack = 1 - y * (x @ w)
        on = slack > 0
        a = x[on] * cost[on, None]
        new = np.linalg.solve(a.T @ x[on] + ridge, a.T @ y[on])
        if np.abs(new - w).max() < 1e-5:
            return new
        w = 0.3 * w + 0.7 * new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(len(w)), x.T @ (p - y) / len(x) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """A trained machine; margins of words seen before are kept, up to CACHE of them."""

    def __init__(self, alphabet: str, weights: np.ndarray, bias: float, logit: list[float] | None = None, constant: float | None = None):
        self.alphabet, self.weights, self.bias, self.logit, self.constant = alphabet, weights, bias, logit, constant
        self.kernel, self.seen = None, {}

    def __getstate__(self):
        return self.__dict__ | {"kernel": None, "seen": {}}

    def _learn(self, words) -> None:
        """Makes the margins of the words known."""
        self.kernel = self.kernel or Kernel(self.alphabet)
        fresh = [w for w in words if w not in self.seen]
        for k in range(0, len(fresh), 8192):
            part = fresh[k : k + 8192]
            self.seen.update(zip(part, self.kernel.margins(part, self.weights, self.bias).tolist(), strict=True))

    def margins_of(self, words: list[str]) -> np.ndarray:
        self._learn(words)
        return np.array([self.seen[w] for w in words])

    def witnesses(self, text: str | None) -> list[str]:
        """The most toxic word of each sentence of a text, the first by code point on ties."""
        sentences = [x for x in map(words_of, SENTENCE_END.split(text or "")) if x]
        self._learn(set().union(*sentences))
        out = [min(words, key=lambda w: (-self.seen[w], w)) for words in sentences]
        if len(self.seen) > CACHE:
            self.seen.clear()
        return out

    def tops(self, texts) -> np.ndarray:
        """(n, 2): the margins of the two most toxic distinct words of each text."""
        out = np.full((len(texts), 2), NONE)
        at = 0
        while at < len(texts):
            sets, fresh = [], set()
            while at + len(sets) < len(texts) and len(fresh) < 40_000:
                words = words_of(texts[at + len(sets)])
                sets.append(words)
                fresh.update(w for w in words if w not in self.seen)
            self._learn(fresh)
            for i, words in enumerate(sets):
                if words:
                    best = sorted(map(self.seen.__getitem__, words))[-2:]
                    out[at + i, 0] = best[-1]
                    out[at + i, 1] = best[0] if len(best) > 1 else NONE
            at += len(sets)
            if len(self.seen) > CACHE:
                self.seen.clear()
        return np.clip(out, NONE, -NONE)

    def scores(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _squash(self.tops(texts), np.array(self.logit))


def _squash(tops: np.ndarray, logit: np.ndarray) -> np.ndarray:
    z = _inputs(tops) @ logit[:-1] + logit[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _inputs(tops: np.ndarray) -> np.ndarray:
    """The first margin within +-EDGE; the second counts only where it, too, is toxic."""
    return np.stack([np.clip(tops[:, 0], -EDGE, EDGE), np.clip(tops[:, 1], 0, EDGE)], axis=1)


def _stuffed(word: str, alphabet: str, rng) -> str:
    """The word with one character put in between."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + alphabet[int(rng.integers(0, len(alphabet)))] + word[at:]


def _sample(labels: DataFrame, label: str, most: int) -> pd.DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    return pd.concat([rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id")).limit(most).toPandas() for y in (1, 0)])


def _told_apart(told: DataFrame) -> list[str]:
    """The words that toxic documents have too often for chance, most telling first, MOST_POSITIVE at most; told has word,
    toxic and clean (contexts) and their log-ratio. By Chernoff's bound on the binomial tail and Benjamini and Hochberg's rule."""
    least = 3
    frequent = told.filter(F.col("toxic") + F.col("clean") >= least)
    tests, sum_toxic, sum_all = frequent.agg(F.count(F.lit(1)), F.sum("toxic"), F.sum(F.col("toxic") + F.col("clean"))).first()
    if not sum_toxic or sum_toxic == sum_all:
        return []
    share, total = sum_toxic / sum_all, F.col("toxic") + F.col("clean")
    a = F.col("toxic") / total
    evidence = total * (a * F.log(a / share) + F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - share))).otherwise(0.0))
    above = frequent.filter((F.col("ratio") > 2.0) & (F.col("toxic") >= least) & (F.length("word") > 2)).withColumn("evidence", evidence)
    rows = above.orderBy(F.desc("evidence"), "word").limit(MOST_POSITIVE).collect()
    fit = [i for i, r in enumerate(rows) if tests * np.exp(-r["evidence"]) <= FALSE_SHARE * (i + 1)]
    return [r["word"] for r in rows[: fit[-1] + 1]] if fit else []


def _machine(positive: list[str], negative: list[str], seed: int) -> Scorer:
    """A machine that tells the words positive, and these with a character put in between, from the words negative."""
    known = set(positive)
    bad = [w for w in dict.fromkeys(negative) if w not in known]
    letters = pd.Series(list("".join(positive * 4 + bad))).value_counts()
    order = sorted(letters.index, key=lambda c: (-letters[c], c))
    alphabet = "".join(order[: SYMBOLS - 3])
    rng = np.random.default_rng(seed)
    good = positive + [_stuffed(w, alphabet, rng) for w in positive for _ in range(2) if len(w) > 3]
    marks = good[: min(len(positive), LANDMARKS // 2)] + bad[: LANDMARKS // 4] + [bad[i] for i in rng.permutation(len(bad))[: LANDMARKS // 4]]
    x, used, basis = _nystroem(Kernel(alphabet), good + bad, list(dict.fromkeys(marks)))
    y = np.r_[np.ones(len(good)), -np.ones(len(bad))]
    cost = np.r_[np.full(len(good), 2.0 * len(bad) ** 0.5 / len(good) ** 0.5), np.ones(len(bad))]
    w = _svm(x, y, cost)
    folded = np.zeros(SYMBOLS**3, np.float32)
    folded[used] = w[:-1] @ basis
    return Scorer(alphabet, folded, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_DOCS, seed: int = 3) -> Scorer:
    """The machine from labelled rows outside fold 1. Without both classes it is constant: the smoothed share of label 1."""
    spark = docs.sparkSession
    chosen = _sample(labels, label, most)
    ids = spark.createDataFrame([(int(a), int(b)) for a, b in zip(chosen["doc_id"], chosen["y"], strict=True)], "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(ids), "doc_id")  # 2 * most short rows

    def split(batches):
        for batch in batches:
            ys, texts_ = (batch.column(i).to_pylist() for i in range(2))
            found, fresh, sizes = [], [], []
            for text in texts_:
                pairs, met = contexts_of(text), set()
                for word, before in pairs:
                    found.append((word, before))
                    fresh.append(word not in met)
                    met.add(word)
                sizes.append(len(pairs))
            ys = np.repeat(np.array(ys, np.int32), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ys), *(pa.array([x[k] for x in found], pa.string()) for k in range(2)), pa.array(fresh, pa.bool_())], names=["y", "word", "before", "fresh"])

    # A word counts once a document and once for each word that it follows, whichever is less: neither copies of a document
    # nor the repeats within one are evidence of their own.
    counts = sample.select("y", "text").mapInArrow(split, "y int, word string, before string, fresh boolean").groupBy("word", "before", "y").agg(F.count(F.when(F.col("fresh"), 1)).alias("docs"))
    said = lambda y: F.least(F.count(F.when(F.col("y") == y, 1)), F.coalesce(F.sum(F.when(F.col("y") == y, F.col("docs"))), F.lit(0))).cast("long")
    counts = written(counts.groupBy("word").agg(said(1).alias("toxic"), said(0).alias("clean")), "toxic-words")
    n1, n0 = int((chosen["y"] == 1).sum()), int((chosen["y"] == 0).sum())
    if not n1 or not n0:
        return Scorer("", np.zeros(SYMBOLS**3, np.float32), 0.0, constant=(n1 + 1) / (n0 + n1 + 2))
    ratio = F.log((F.col("toxic") + 0.2) / n1) - F.log((F.col("clean") + 0.2) / n0)
    told = counts.withColumn("ratio", ratio)
    clean = told.filter((F.col("clean") > 0) & (F.col("ratio") < 1.0)).select("word", "clean")
    clear = _told_apart(told)
    if not clear:
        return Scorer("", np.zeros(SYMBOLS**3, np.float32), 0.0, constant=(n1 + 1) / (n0 + n1 + 2))
    negative = [r["word"] for r in clean.orderBy(F.desc("clean"), "word").limit(MOST_NEGATIVE // 4).collect()]
    negative += [r["word"] for r in clean.orderBy(F.xxhash64("word")).limit(MOST_NEGATIVE).collect()]
    machine = _machine(clear, negative, seed)
    shared = spark.sparkContext.broadcast(machine)

    def testify(batches):
        for batch in batches:
            found = [(y, w) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in shared.value.witnesses(t)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string())], names=["y", "word"])

    seen = sample.select("y", "text").mapInArrow(testify, "y int, word string").groupBy("word")
    seen = written(seen.agg(F.sum("y").cast("long").alias("toxic"), F.count(F.when(F.col("y") == 0, 1)).alias("clean")), "toxic-witnesses")
    # As many as the machine sees, by the number of sentences that they speak for.
    speak = seen.filter((F.col("toxic") * n0 > F.col("clean") * n1 * 8) & (F.length("word") > 2)).orderBy(F.desc("toxic"), "word").limit(8 * MOST_POSITIVE).collect()
    hold = machine.margins_of([r["word"] for r in speak])
    toxic = [*clear, *(r["word"] for r, m in zip(speak, hold, strict=True) if m > 0.5 and r["word"] not in set(clear))][:MOST_POSITIVE]
    rivals = [r["word"] for r in seen.filter(F.col("clean") * n1 >= F.col("toxic") * n0).orderBy(F.desc("clean"), F.xxhash64("word")).limit(8 * HARD).collect()]
    rivals = [rivals[i] for i in np.argsort(-machine.margins_of(rivals), kind="stable")[:HARD]]
    machine = _machine(toxic, [*rivals, *negative], seed)
    forget(seen)
    shared = spark.sparkContext.broadcast(machine)

    def peaks(batches):
        for batch in batches:
            tops = shared.value.tops(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tops[:, 0]), pa.array(tops[:, 1])], names=["y", "a", "b"])

    got = sample.select("y", "text").mapInArrow(peaks, "y int, a double, b double").toPandas()  # 2 * most short rows
    forget(counts)
    if got["y"].nunique() < 2:
        machine.constant = (n1 + 1) / (n0 + n1 + 2)
        return machine
    # A document labelled toxic without one toxic word is mislabelled, as far as words can tell, and teaches nothing.
    tops, y = got[["a", "b"]].to_numpy(), got["y"].to_numpy(np.float64)
    seen = (y == 0) | (tops[:, 0] > 0)
    if not y[seen].any():
        seen[:] = True
    machine.logit = _logistic(_inputs(tops[seen]), y[seen]).tolist()
    return machine


def score_column(spark, machine: Scorer):
    """A function of a text column: its score, 0 to 1."""
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def toxic_score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return toxic_score


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null, empty and wordless texts get the score of a text without toxic words; repeated rows give equal scores; a null
    id is never held out. An empty table gives an empty result.
    """
    machine = train(docs, labels, label)
    toxic = score_column(docs.sparkSession, machine)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 1).alias("held_out"), toxic(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs."""
    toxic = score_column(docs.sparkSession, train(docs, labels, label))
    return docs.filter(toxic(F.col("text").cast("string")) < threshold)
