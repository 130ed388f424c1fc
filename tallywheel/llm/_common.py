"""What the operators of this package share: durable intermediate tables, label folds and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, notebooks).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: A word, for every operator that counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, a local one on a local
    master only, as the executors of a cluster would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/tallywheel/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, computed once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallywheel_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tallywheel_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def quoted(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(docs: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """All columns of docs (but some) as one struct named row: a stage carries it untouched, whatever its columns are called."""
    return F.struct(*(quoted(c) for c in docs.columns if c not in leave)).alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """0, 1 or 2: crc32 of the id as text, mod 3. Fold 1 is held out; a null id is in fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3, F.lit(0)).cast("int")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node reachable from each node.

    Minimum labels flow along edges and labels are chased through labels (pointer jumping), so that a chain of n nodes
    takes about log n rounds. Every round is a written table; the driver sees one count a round. A node with many
    neighbours is pre-aggregated by min() before its shuffle.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("next"))
        new = written(step.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("next", "now")).alias("component")), "cc-labels")
        changed = new.filter("was <> component").limit(1).count()
        forget(labels)
        labels = new.select("node", "component")
        labels._tallywheel_path = new._tallywheel_path
        if not changed:
            forget(both)
            return labels
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
