"""Sequential operators as windows: what a reader of one file does record by record, said declaratively for all files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _past(keys: Sequence[str], order: str, current: bool = True):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if current else -1)


def largest_wins(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """One row a key: the largest value, the first by order on ties. Aggregates before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, *(F.col("__best")[c].alias(c) for c in rest))


def carried(rows: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str]) -> DataFrame:
    """rows with the last non-null value so far of each column, under a new name."""
    w = _past(keys, order)
    return rows.withColumns({new: F.last(old, ignorenulls=True).over(w) for new, old in columns.items()})


def line_offsets(rows: DataFrame, keys: Sequence[str], order: str, line: str = "line") -> DataFrame:
    """rows with record_offset: the byte at which each line begins in its file, a line end after each."""
    return rows.withColumn("record_offset", F.coalesce(F.sum(F.octet_length(line) + 1).over(_past(keys, order, current=False)), F.lit(0)).cast("long"))


def positions(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """rows with pos, from 1 in each key."""
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long"))


def increments(rows: DataFrame, keys: Sequence[str], order: str, counters: Sequence[str], seed: str | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Running totals to increments.

    rows have the structs `total` (running counters) and `last` (the increment as reported); either may be null. Added:
    delta (struct), emits (whether the row stands for usage), reset (the total fell), previous and after (the running totals
    around the row).

    An equal total says nothing, whatever `last` is; a non-zero `last` is the increment; else it is the total less the
    one before, or the total itself at the start and where any counter fell. A row without a total adds its `last` to
    the running total. seed: a struct column with the total before the first row. also: further fields of the structs that
    are carried along but not compared; their increment is 0 where either side has none.
    """
    every = [*counters, *also]
    zero = lambda s: _all(F.coalesce(F.col(s)[c], F.lit(0)) == 0 for c in counters)
    has_total, has_last = F.col("total").isNotNull(), F.col("last").isNotNull() & ~zero("last")
    before = _past(keys, order, current=False)
    first = F.col(seed) if seed else F.lit(None).cast(rows.schema["total"].dataType)
    # Rows since the last total, and that total; the increments since then are added to it.
    # A total of zeros without an increment is no report at all.
    rows = rows.withColumn("__told", F.when(has_total & (~zero("total") | has_last), F.col("total")))
    rows = rows.withColumn("__group", F.count("__told").over(before))
    rows = rows.withColumn("__base", F.coalesce(F.last("__told", ignorenulls=True).over(before), first))
    since = W.partitionBy(*keys, "__group").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    loose = ~has_total & has_last
    rows = rows.withColumn("__any", F.coalesce(F.max(loose).over(since), F.lit(False)))
    limit = F.lit(2**63 - 1).cast("decimal(38,0)")
    added = {c: F.coalesce(F.sum(F.when(loose, F.col("last")[c].cast("decimal(20,0)"))).over(since), F.lit(0)) for c in every}
    rows = rows.withColumn("__added", F.struct(*(added[c].alias(c) for c in every)))
    prev = {c: F.least(F.coalesce(F.col("__base")[c], F.lit(0)).cast("decimal(38,0)") + F.col("__added")[c], limit).cast("long") for c in every}
    rows = rows.withColumn("__prev", F.when(F.col("__base").isNotNull() | F.col("__any"), F.struct(*(prev[c].alias(c) for c in every))))
    known, p, t = F.col("__prev").isNotNull(), F.col("__prev"), F.col("total")
    equal = has_total & known & _all(t[c] == p[c] for c in counters)
    fell = has_total & known & ~_all(t[c] >= p[c] for c in counters)
    some = has_total & ~zero("total")
    delta = {c: F.when(has_last, F.col("last")[c]).when(some & known & ~fell, t[c] - p[c]).when(some, t[c]) for c in counters}
    step = lambda c: F.when((t[c] > 0) & (p[c] > 0) & (t[c] >= p[c]), t[c] - p[c]).otherwise(F.lit(0).cast("long"))
    delta |= {c: F.when(has_last, F.col("last")[c]).when(some & known & ~fell, step(c)).when(some, t[c]) for c in also}
    emits = F.coalesce(~F.coalesce(equal, F.lit(False)) & (has_last | some), F.lit(False))
    return rows.withColumns({
        "delta": F.when(emits, F.struct(*(delta[c].alias(c) for c in every))),
        "emits": emits,
        "reset": F.coalesce(emits & fell, F.lit(False)),
        "repeats": F.coalesce(equal, F.lit(False)),
        "previous": F.col("__prev"),
        "after": F.when(F.col("__told").isNotNull(), F.col("__told")).when(loose, F.struct(*(F.least(F.coalesce(p[c], F.lit(0)).cast("decimal(38,0)") + F.coalesce(F.col("last")[c], F.lit(0)), limit).cast("long").alias(c) for c in every))).otherwise(p),
    }).drop("__told", "__group", "__base", "__any", "__added", "__prev")


def _all(parts) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def without_inherited(child: DataFrame, parent: DataFrame, keys: Sequence[str], signature: str = "signature") -> DataFrame:
    """child's rows that parent has not, or has with another signature (changed)."""
    theirs = parent.select(*keys, F.col(signature).alias("__theirs"), F.lit(True).alias("__has"))
    out = child.join(theirs, list(keys), "left").filter(F.col("__has").isNull() | ~F.col(signature).eqNullSafe(F.col("__theirs")))
    return out.withColumn("changed", F.col("__has").isNotNull()).drop("__theirs", "__has")


def after_common_prefix(child: DataFrame, parent: DataFrame, keys: Sequence[str], signature: str, expected: str, on: Sequence[str] = ("pos",)) -> DataFrame:
    """child's rows (with pos) from the first on that differs from parent's row of the same position."""
    both = child.join(parent, list(on), "left")
    same = F.min(F.col(signature).eqNullSafe(F.col(expected)).cast("int")).over(_past(keys, "pos"))
    return both.withColumn("__same", same).filter("__same = 0").drop("__same", expected)


def latest_parent(child: DataFrame, parent: DataFrame, key: str, at: str, begun: str, child_id: str, parent_id: str) -> DataFrame:
    """(child, parent): the largest parent of the same key that began no later than the child; null without one."""
    # Parents and children of a key stand in one line by time; a running maximum says what has begun. It never pairs them.
    begins = parent.filter(F.col(key).isNotNull() & F.col(begun).isNotNull()).select(F.col(key).alias("k"), F.col(begun).alias("t"), F.lit(0).alias("asks"), F.col(parent_id).alias("id"))
    rows = begins.unionByName(child.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("asks"), F.col(child_id).alias("id")))
    line = W.partitionBy("k").orderBy("t", "asks")
    so_far, before = line.rowsBetween(W.unboundedPreceding, 0), line.rowsBetween(W.unboundedPreceding, -1)
    theirs = F.when(F.col("asks") == 0, F.col("id"))
    rows = rows.withColumns({"top": F.max(theirs).over(so_far), "was": F.max(theirs).over(before)})
    # The largest but one, for a child that is the largest itself.
    lower = F.when(theirs < F.col("was"), theirs).when(theirs > F.col("was"), F.col("was"))
    rows = rows.withColumn("next", F.max(lower).over(so_far)).filter("asks = 1")
    return rows.groupBy(F.col("id").alias(child_id)).agg(F.max(F.when(F.col("top") == F.col("id"), F.col("next")).otherwise(F.col("top"))).alias(parent_id))
