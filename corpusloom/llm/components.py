"""Connected components by repeated contraction, with DataFrame joins and small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Tables


def _edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, tables: Tables | None = None, *, max_rounds: int = 60) -> DataFrame:
    """(id, root): every node of the edges (a, b) with the least node of its component.

    Each round, nodes point to their least neighbour if it is less, pointers are followed twice, and edges are
    taken between the nodes pointed to. Pointers lead from greater to lesser nodes, so the last node of each
    component is its least. No node's neighbours are gathered: minima are partial aggregates. Loops and repeated
    edges do no harm, null ends are dropped. Nodes are of any type that has an order. The result is written; with
    ``tables`` it is one of them.
    """
    outer, tables = tables, Tables(edges.sparkSession)
    real = edges.where("a IS NOT NULL AND b IS NOT NULL")
    rest = tables.write(_edges(real), "edges")
    labels = tables.write(real.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    for _ in range(max_rounds):
        if rest.isEmpty():
            tables.drop(labels)
            if outer is not None:
                outer.held += tables.held
            return labels
        point = rest.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        twice = (
            point.alias("p")
            .join(point.alias("q"), F.col("p.to") == F.col("q.id"), "left")
            .select("p.id", F.coalesce("q.to", "p.to").alias("to"))
        )
        point = tables.write(twice, "pointers")
        labels = tables.write(
            labels.alias("l").join(point.alias("p"), F.col("l.root") == F.col("p.id"), "left").select("l.id", F.coalesce("p.to", "l.root").alias("root")),
            "labels",
        )
        one = rest.join(point.withColumnRenamed("id", "a"), "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        two = one.join(point.withColumnRenamed("id", "b"), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
        rest = tables.write(_edges(two), "edges")
        tables.drop(labels, rest)
    raise RuntimeError("components did not settle")
