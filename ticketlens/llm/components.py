"""Connected components of an edge table, by Spark joins alone.

Each round hooks every node to its smallest neighbour, follows the pointers to
their roots by doubling, and joins the edges to the roots; at least half of
the nodes that still have an edge leave per round.  A hub that touches a third
of all edges is met by map-side ``min`` aggregates and by joins that Spark can
split; no node's neighbours are gathered.  Tables between steps are written to
the shared folder, so a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keep=written) -> DataFrame:
    """``(node, root)`` for every node with an edge to another; ``root`` is the
    smallest node of its component.  Edges with a null end are left out, loops
    and repeated edges change nothing, no edge gives no row.  ``keep`` writes
    the tables between steps."""
    e = keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
             .where("a is not null and b is not null and a != b").distinct(), "edges")
    found = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = keep(both.groupBy("a").agg(F.min("b").alias("b"))
                  .select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "pointers")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            nxt = keep(up.join(over, "root")
                       .select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")),
                       "pointers")
            up = nxt.select("node", "root")
            if nxt.where("moved").isEmpty():
                break
        roots_a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        roots_b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = keep(e.join(roots_a, "a").join(roots_b, "b").where("ra != rb")
                 .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if found is None:
            found = up
        else:
            again = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = keep(found.join(again, "root", "left")
                         .select("node", F.coalesce("top", "root").alias("root")), "roots")
    if found is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
