"""Connected components of link tables, by contraction in stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.store import few, stored


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for each id of the links ``a, b``; root is the smallest id reachable.

    Each round every root moves to its smallest neighbour, roots are followed twice, and links
    are rewritten to roots; loops and repeats go. Rounds are stored, no id's links are gathered; they take
    as many tasks and files as their links need, not one for each shuffle partition.
    Links holding a null are left out. No links give an empty frame.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    n = links.count()
    links = stored(few(links.distinct(), n), "links")
    ids, labels = 2 * n, None  # at most
    while labels is None or n:
        both = links.select(F.col("b").alias("id"), F.col("a").alias("near")).unionByName(links.select(F.col("a").alias("id"), F.col("b").alias("near")))
        step = stored(few(both.groupBy("id").agg(F.min("near").alias("_m")).select("id", F.least("id", "_m").alias("root")), 2 * n), "step")
        for _ in range(2):
            step = stored(few(_follow(step, step), 2 * n), "step")
        labels = step if labels is None else stored(few(_follow(labels, step), ids), "labels")
        ends = [step.select(F.col("id").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b")]
        moved = links.join(ends[0], "a").join(ends[1], "b").where("_a <> _b")
        moved = few(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")), n)
        links = stored(few(moved.distinct(), n), "links")
        n = links.count()
    return labels


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    to = step.select(F.col("id").alias("root"), F.col("root").alias("_to"))
    return labels.join(to, "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
