"""Connected components of a link table, by label propagation with pointer jumping; nothing of it comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: a, b (bigint). Gives (node, component) of every node, component being the smallest node it is linked with.

    In each round a node takes the smallest label among its own, its neighbours' and those of the node that its label
    names, so that labels travel twice as far each round; links inside one component are dropped as they go. Rounds are
    written to the shared folder, and a round's tables go when the next are written; the labels returned are such a
    table. Null ends and links of a node with itself say nothing.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(rounds):
        # every link as one between labels: its larger label should become its smaller
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        before, links = links, written(links.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
        free(before)
        if links.isEmpty():
            break
        # labels are nodes too: hook each to the smallest that it meets, then flatten the hooks
        hooks = written(links.groupBy(F.col("b").alias("old")).agg(F.min("a").alias("new")), "hooks")
        for _ in range(rounds):
            up = hooks.select(F.col("old").alias("new"), F.col("new").alias("next"))
            moved = written(hooks.select("old", "new").join(up, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved")), "hooks")
            free(hooks)
            hooks = moved
            if moved.where("moved").isEmpty():
                break
        before, labels = labels, written(labels.join(hooks, labels["component"] == hooks["old"], "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
        free(before, hooks)
    else:
        raise RuntimeError("components did not settle")
    free(links)
    return labels
