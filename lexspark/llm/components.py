"""Connected components of a table of links, as DataFrame rounds with written state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, remove_dirs, shared_dir


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``links`` (two id columns) -> ``(id, comp)``; ``comp`` is the smallest id reachable.

    Each round hooks every node to its smallest neighbour, shortens those chains by pointer
    doubling until they are stars, and contracts the links to links between roots. Roots are
    local minima, so a round at least halves them. The state of a round is written to the
    shared folder; the driver sees counts only. Hubs are met with partial aggregation and
    with joins against one row per node, which AQE can split.

    Links with a null end and self links are ignored; repeated links do no harm; an empty
    table gives an empty result.
    """
    spark = links.sparkSession
    root = shared_dir(spark)
    edges = links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst")
    edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = materialise(edges, f"{root}/edges0")
    labels, step, written = None, 0, ["edges0"]
    while edges.limit(1).count():
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("up"))
        hook = materialise(hook, f"{root}/hook{step}")
        written.append(f"hook{step}")
        jump = 0
        while True:
            over = hook.select(F.col("id").alias("up"), F.col("up").alias("higher"))
            nxt = hook.join(over, "up").select("id", F.col("higher").alias("up"), (F.col("higher") != F.col("up")).alias("moved"))
            nxt = materialise(nxt, f"{root}/hook{step}_{jump}")
            moved = nxt.where("moved").limit(1).count()
            hook = nxt.select("id", "up")
            written.append(f"hook{step}_{jump}")
            jump += 1
            if not moved:
                break
        if labels is None:
            labels = hook.select("id", F.col("up").alias("comp"))
        else:
            held = hook.select(F.col("id").alias("comp"), "up")
            labels = labels.join(held, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        a = hook.select(F.col("id").alias("src"), F.col("up").alias("a"))
        b = hook.select(F.col("id").alias("dst"), F.col("up").alias("b"))
        edges = edges.join(a, "src").join(b, "dst").where("a <> b")
        edges = edges.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        step += 1
        edges = materialise(edges, f"{root}/edges{step}")
        written.append(f"edges{step}")
    if labels is None:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("comp"))
    labels = materialise(labels, f"{root}/labels")
    remove_dirs(spark, root, *written)
    return labels
