"""Secret scans: a wide finder, and a random forest that removes its false positives (DataFrame functions only).

The finder takes every run of 12 characters or more of letters, digits, _ + / - that holds a digit, every key in a
provider's format and every value assigned to a credential's name, with what stands before and after it. The forest sees length, character classes and transitions, how much of the candidate dictionary
words cover, path-like surroundings and the neighbouring words. It is trained on labelled findings; weak_labels() gives
some by provider formats and assignments, where a table of reviewed findings is missing.

One pass finds the candidates and stores them (a few per hundred documents); training reads a bounded sample of
labelled ones (``MOST_LABELLED`` of each class, the first by hash), scoring reads them all.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywheel.llm._common import fold, written

RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{12,}"
NEAR = 64  # characters kept on either side
MOST_LABELLED = 10_000
DICTIONARY_WORDS = 300

#: Words that name a credential, words that name something else, and words that mark a placeholder.
CREDENTIAL = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credential|private[_-]?key)"
ORDINARY = r"(?:phone|tel|card|isbn|order|invoice|version|commit|sha\d*|md5|digest|checksum|uuid|guid|revision|build)"
PLACEHOLDER = r"(?:example|sample|dummy|test|placeholder|changeme|redacted|xxxx|your)"
#: Published formats of provider keys.
FORMATS = r"(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_\-]{35})"
PROVIDER = f"^{FORMATS}$"
#: What stands between a credential's name and its value, and the value: up to its closing quote, or to white space without
#: the marks that close a sentence or bracket. Names are bounded, so that the finder can look behind.
ASSIGNED = rf"(?i:{CREDENTIAL})[\"']?\s{{0,3}}(?:=>|:=|[=:])\s{{0,3}}(?:(?i:bearer|basic)\s{{1,3}})?"
VALUE = (
    rf"(?<=[=:>\s])(?<={ASSIGNED})(?!(?i:bearer|basic)\s)[^\s\"'=>](?:\S*[^\s,;.)\]}}>\"'])?"
    rf"|(?<=\")(?<={ASSIGNED}\")[^\"\r\n]+|(?<=')(?<={ASSIGNED}')[^'\r\n]+"
)
ANY_FORMAT = rf"(?<![A-Za-z0-9]){FORMATS}(?![A-Za-z0-9])"
PLAIN, FULL = f"{RUN}|{ANY_FORMAT}", f"{VALUE}|{RUN}|{ANY_FORMAT}"

FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "transitions", "case_changes", "distinct", "hex", "number", "vowels", "dictionary",
    "path", "address", "credential", "assigned", "quoted", "ordinary", "placeholder", "words_before", "words_after",
)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, position, candidate, before, after): every candidate of every whole text, numbered in each row."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), text.rlike(ASSIGNED).alias("a"))
    # Looking behind costs much and is left to texts in which something is assigned.
    cut = lambda pattern: F.struct(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("c"), F.split("t", pattern, -1).alias("p"))
    rows = rows.filter(F.col("a") | F.col("t").rlike(PLAIN)).select("doc_id", F.when(F.col("a"), cut(FULL)).otherwise(cut(PLAIN)).alias("f"))
    rows = rows.select("doc_id", F.col("f.c").alias("c"), F.transform("f.p", lambda p: F.struct(F.right(p, F.lit(NEAR)).alias("tail"), F.left(p, F.lit(NEAR)).alias("head"))).alias("p"))
    found = F.transform("c", lambda c, i: F.struct(c.alias("candidate"), F.get("p", i).getField("tail").alias("before"), F.get("p", i + 1).getField("head").alias("after")))
    rows = rows.select("doc_id", F.posexplode(found).alias("position", "f"))
    return rows.select("doc_id", "position", "f.candidate", F.coalesce("f.before", F.lit("")).alias("before"), F.coalesce("f.after", F.lit("")).alias("after"))


def dictionary(docs: DataFrame, most_words: int = DICTIONARY_WORDS) -> list[str]:
    """The commonest words of four letters or more in all documents."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{4,12}\b"), F.lit(0))).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most_words).collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c).cast("double")
    count = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)).cast("double")
    flag = lambda pattern, of: of.rlike(pattern).cast("double")
    before, after = F.col("before"), F.col("after")
    known = "|".join(sorted(words, key=lambda w: (-len(w), w))) or r"(?!)"
    covered = (n - F.length(F.regexp_replace(low, known, ""))) / n
    values = {
        "length": n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "lowers": count("[a-z]") / n,
        "marks": count(r"[_+/\-]") / n,
        "transitions": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n,
        "case_changes": count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": flag("^[0-9a-f]+$", c),
        "number": flag("^[0-9]+$", c),
        "vowels": count("[aeiou]", low) / n,
        "dictionary": covered,
        "path": (flag(r"[/\\]", c) + flag(r"(?:[/\\.~]|://\S*)$", before)),
        "address": flag("^@", after) + flag(r"@\S*$", before),
        "credential": flag(rf"(?i){CREDENTIAL}\W{{0,6}}$", before),
        "assigned": flag(r"[=:]\s*[\"']?$", before),
        "quoted": flag(r"[\"']$", before) + flag(r"^[\"']", after),
        "ordinary": flag(rf"(?i)\b{ORDINARY}\W{{0,6}}$", before),
        "placeholder": flag(rf"(?i){PLACEHOLDER}", low) + flag(rf"(?i){PLACEHOLDER}", before),
        "words_before": count(r"\S+", before),
        "words_after": count(r"\S+", after),
    }
    return found.withColumns({name: F.coalesce(values[name], F.lit(0.0)) for name in FEATURES})


def weak_labels(found: DataFrame) -> DataFrame:
    """found with y: 1 for provider formats and credentials assigned by name, 0 for numbers, addresses, named ordinary values and
    words; null where neither is sure."""
    c, before = F.col("candidate"), F.col("before")
    placeholder = F.lower(c).rlike(PLACEHOLDER) | F.lower(before).rlike(rf"{PLACEHOLDER}\W*$")
    assigned = before.rlike(rf"(?i){CREDENTIAL}\W{{0,6}}$") & before.rlike(r"[=:]\s*[\"']?$")
    mixed = c.rlike(r"^(?=\S*[A-Za-z])(?=\S*[0-9!@#$%^&*])\S{6,}$")  # a value of letters with digits or marks
    secret = (c.rlike(PROVIDER) | (assigned & ((F.length(c) >= 16) | mixed))) & ~placeholder
    ordinary = c.rlike("^[0-9+/_-]+$") | F.col("after").rlike("^@") | before.rlike(rf"(?i)\b{ORDINARY}\W{{0,6}}$") | placeholder | (F.regexp_count(c, F.lit("[0-9]")) <= 2)
    return found.withColumn("y", F.when(secret, 1).when(ordinary, 0))


def train(labelled: DataFrame, trees: int = 40, depth: int = 6, most: int = MOST_LABELLED, seed: int = 17):
    """A forest from rows with features and y (0 or 1), or the smoothed share of label 1 where a class is missing."""
    order = F.xxhash64("candidate", "before", "after")
    counts = {r["y"]: r["count"] for r in labelled.filter(F.col("y").isin(0, 1)).groupBy("y").count().collect()}  # two rows
    if len(counts) < 2:
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    parts = [labelled.filter(F.col("y") == y).orderBy(order, "candidate").limit(most) for y in (0, 1)]
    rows = written(parts[0].unionByName(parts[1]).select(*FEATURES, "y", order.alias("h")), "secret-labelled")
    share = min(counts[1], most) / (min(counts[0], most) + min(counts[1], most))
    rows = rows.withColumn("weight", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share))).coalesce(1).sortWithinPartitions("h", *FEATURES)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.withColumn("y", F.col("y").cast("double"))))


def score(found: DataFrame, model) -> DataFrame:
    """found (with features) with score: the forest's share of votes for a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    voted = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(found))
    return voted.withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def redacted(candidate: Column) -> Column:
    return F.substring(F.sha2(candidate.cast("binary"), 256), 1, 16)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, position, n_chars, digest, score, is_secret for every candidate of every row of docs.

    The text of a candidate never leaves the scan; digest (of its SHA-256) tells equal ones. labelled: findings with
    candidate, before, after and y; without it, weak labels of the documents outside fold 1. Null and empty texts have
    no candidates; null ids are carried; repeated rows give repeated findings. An empty table gives an empty result.
    """
    found = written(with_features(find(docs), dictionary(docs)), "secret-findings")
    if labelled is None:
        labelled = weak_labels(found.filter(fold("doc_id") != 1))
    elif not set(FEATURES) <= set(labelled.columns):
        labelled = with_features(labelled, dictionary(docs))
    out = score(found, train(labelled))
    return out.select("doc_id", "position", F.length("candidate").alias("n_chars"), redacted(F.col("candidate")).alias("digest"), "score", (F.col("score") >= threshold).cast("int").alias("is_secret"))
