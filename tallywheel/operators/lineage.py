"""Chains of parents by pointer doubling: a round joins every node to the node that its pointer has reached, so that a chain of
n links takes about log n rounds, whatever the number of chains. Nothing is followed on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.tables import forget, settled


def _doubled(going: DataFrame, pointers: DataFrame, carried: list[str]) -> DataFrame:
    """Each pointer that goes on as far again; what a node carries is its own, or else the first that its pointer's node carries."""
    beyond = pointers.select(F.col("node").alias("to"), F.col("to").alias("__to"), *(F.col(c).alias(f"__{c}") for c in carried))
    return going.join(beyond, "to", "left").select("node", F.col("__to").alias("to"), *(F.coalesce(c, f"__{c}").alias(c) for c in carried))


def _run(pointers: DataFrame, carried: list[str], name: str, visit=None) -> DataFrame:
    """pointers (node, to, ...) doubled until those that still go on go round for ever, or until visit(those) says no.

    A pointer that has ended leaves the joins. Where the others stand can only become fewer nodes: once a round leaves as many,
    going on maps these nodes onto themselves, so that all of them are on cycles. Rounds grow with the log of the longest way
    to an end or to a cycle, not with the number of links.
    """
    pointers, stood = settled(pointers, name), 0
    while True:
        going = pointers.filter("to IS NOT NULL")
        if visit is None:
            stand = going.agg(F.countDistinct("to")).first()[0]
            more, stood = stand not in (0, stood), stand
        else:
            more = visit(going)
        if not more:
            return pointers
        further = settled(_doubled(going, pointers, carried).unionByName(pointers.filter("to IS NULL")), name)
        forget(pointers)
        pointers = further


def ancestors(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): the nodes themselves and all that their chains reach. links (child, parent): one row a child."""
    held = [settled(nodes.select("node").distinct(), "ancestors")]

    def visit(going: DataFrame) -> bool:
        # After jumps of 1, 2, 4, ... links, each taken or not, every distance has been gone. Jumps that find nothing new find
        # nothing ever after: the nodes at all greater distances are among those held.
        more = held[0].join(going, "node").select(F.col("to").alias("node"))
        new = settled(held[0].unionByName(more).distinct(), "ancestors")
        grown = new.count() > held[0].count()
        forget(held[0])
        held[0] = new
        return grown

    forget(_run(links.select(F.col("child").alias("node"), F.col("parent").alias("to")), [], "lineage", visit))
    return held[0]


def resolve(links: DataFrame) -> DataFrame:
    """(child, problem, value, cycle) for links (child, parent, problem, late, value), one row a child, null parents leading nowhere.

    A walk goes from child to parent, up to a node that is no child. At each node it looks for the link's problem, then whether
    it has been at the parent before (cycle: that node), then for the late problem; what it finds first ends it. value: that of
    the first link that has one, if the walk ends well.
    """
    links = settled(links.select("child", "parent", "problem", "late", "value"), "links")
    known = links.select(F.col("child").alias("parent"), F.lit(True).alias("goes"))
    # Null keys stay out of the joins: all of them would meet in one task.
    known = links.filter("parent IS NOT NULL").join(known, "parent", "left").unionByName(links.filter("parent IS NULL").withColumn("goes", F.lit(None).cast("boolean")))
    links = settled(known, "links-known")
    parents = links.select(F.col("child").alias("node"), "parent")
    # Where only problems stop: a pointer that still goes on goes round; where it stands is on a cycle, and every node of the
    # cycle is where some pointer stands.
    first = links.select(F.col("child").alias("node"), F.when(F.col("problem").isNull() & F.col("goes"), F.col("parent")).alias("to"))
    lost = _run(first, [], "lineage-rings").filter("to IS NOT NULL")
    ring = lost.select(F.col("to").alias("node")).distinct().withColumn("ring", F.lit(True))
    into = lost.select("node").join(parents, "node").join(ring, "node", "left")
    into = into.select("node", F.when(F.col("ring").isNull(), F.col("parent")).alias("to"), F.when(F.col("ring"), F.col("node")).alias("entry"))
    entered = _run(into, ["entry"], "lineage-cycles").select("node", "entry")
    # The link that closes a cycle for those who entered it there: its late problem is never looked at.
    closing = ring.select("node").join(parents, "node").select(F.col("parent").alias("entry"), F.col("node").alias("closes"))
    both = F.coalesce("problem", "late")
    stop = F.when(both.isNotNull(), F.struct(both.alias("text"), F.col("child").alias("at"), F.col("problem").isNull().alias("late")))
    walk = links.select(F.col("child").alias("node"), F.when(both.isNull() & F.col("goes"), F.col("parent")).alias("to"), stop.alias("stop"), F.when(both.isNull(), F.col("value")).alias("value"))
    out = _run(walk, ["stop", "value"], "lineage").join(entered.join(closing, "entry", "left"), "node", "left")
    round_ = F.col("entry").isNotNull() & (F.col("stop").isNull() | (F.col("stop.late") & (F.col("stop.at") == F.col("closes"))))
    fine = F.col("stop").isNull() & F.col("entry").isNull()
    return out.select(F.col("node").alias("child"), F.when(~round_, F.col("stop.text")).alias("problem"), F.when(fine, F.col("value")).alias("value"), F.when(round_, F.col("entry")).alias("cycle"))
