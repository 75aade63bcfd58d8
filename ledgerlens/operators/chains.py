"""D11 + E16: reversal-chain traversal by pointer doubling.

A reversal has one parent (the link table's key), so the links are pointers.
Every node jumps to its pointer's pointer and adds up the distances, which
doubles the distance in each round: a chain of 10,000 links takes 14 rounds.
Nodes that still move when a round finishes none of them hang on a cycle,
which no root reaches.

Links that break the key (a child with several parents) are allowed: such a
child ends the pointers below it, and only these few ends are searched from the
roots step by step.  Each round is written to the shared folder, so lineage
stays one join deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize, new_run_dir


def _pointers(edges: DataFrame, run_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node, top, steps): what each node below a top reaches, a top being a node
    without a parent or with several; and the children with several (node)."""
    above = materialize(edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("top")), "above", run_dir)
    inner = above.filter("n = 1").select("node")
    state = (above.filter("n = 1").select("node", "top", F.lit(1).cast("long").alias("steps"))
             .join(inner.select(F.col("node").alias("top"), F.lit(True).alias("moves")), "top", "left"))
    state = materialize(state.select("node", "top", "steps", F.coalesce("moves", F.lit(False)).alias("moves")), "jump_00", run_dir)
    moving, rnd = state.filter("moves").count(), 0
    while moving:
        rnd += 1
        ahead = state.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("moves").alias("still"))
        jumped = state.filter("moves").drop("moves").join(ahead, "top").select("node", F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"),
                                                                              F.col("still").alias("moves"))
        state = materialize(state.filter("NOT moves").unionByName(jumped), f"jump_{rnd:02d}", run_dir)
        left = state.filter("moves").count()
        if left == moving:
            break
        moving = left
    return state.filter("NOT moves").drop("moves"), above.filter("n > 1").select("node")


def chain_depths(led: DataFrame, links: DataFrame, run_dir: str | None = None) -> DataFrame:
    """-> (root_txn_id, depth, txn_id): what each ledger id that is never a child
    reaches, at its smallest depth; the root itself has depth 0.  Roots without
    children are left out."""
    run_dir = run_dir or new_run_dir(led.sparkSession, "chains")
    edges = links.select(F.col("child_txn_id").alias("child"), F.col("parent_txn_id").alias("parent")).dropna().distinct()
    edges = materialize(edges, "edges", run_dir)
    below, several = _pointers(edges, run_dir)
    roots = (led.select(F.col("ledger_txn_id").alias("root")).distinct().join(edges.select(F.col("child").alias("root")), "root", "left_anti")
             .join(edges.select(F.col("parent").alias("root")), "root", "left_semi"))
    tops = materialize(roots.select("root", F.col("root").alias("top"), F.lit(0).cast("long").alias("depth")), "tops_00", run_dir)
    if not several.isEmpty():
        place = below.unionByName(below.select(F.col("top").alias("node"), "top", F.lit(0).cast("long").alias("steps")).distinct()) \
            .unionByName(several.select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("steps"))).unionByName(
                roots.select(F.col("root").alias("node"), F.col("root").alias("top"), F.lit(0).cast("long").alias("steps"))).distinct()
        into = edges.join(several.select(F.col("node").alias("child")), "child").join(place.select(F.col("node").alias("parent"), "top", "steps"), "parent")
        into = materialize(into.groupBy("top", F.col("child").alias("next")).agg((F.min("steps") + 1).alias("steps")), "ends", run_dir)
        frontier, rnd = tops, 0
        while not frontier.isEmpty():  # a shorter way to an end is followed again
            rnd += 1
            found = frontier.join(into, "top").groupBy("root", F.col("next").alias("top")).agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
            known = tops.select("root", "top", F.col("depth").alias("had"))
            frontier = materialize(found.join(known, ["root", "top"], "left").filter("had IS NULL OR depth < had").drop("had"), f"ends_{rnd:02d}", run_dir)
            tops = materialize(tops.unionByName(frontier).groupBy("root", "top").agg(F.min("depth").alias("depth")), f"tops_{rnd:02d}", run_dir)
    reached = tops.join(below, "top").select("root", (F.col("depth") + F.col("steps")).alias("depth"), F.col("node").alias("txn_id"))
    return reached.unionByName(tops.select("root", "depth", F.col("top").alias("txn_id"))).withColumnRenamed("root", "root_txn_id")


def reversal_chains(led: DataFrame, links: DataFrame, max_depth: int | None = None,
                    run_dir: str | None = None) -> DataFrame:
    """-> (root_txn_id, chain_length, chain, is_truncated): ``chain_depths`` as
    one array a root, ids by (depth, id).  With ``max_depth`` deeper nodes are
    left out, and ``is_truncated`` tells the chains that have some."""
    deep = materialize(chain_depths(led, links, run_dir), "chain-depths")
    kept = F.lit(True) if max_depth is None else F.col("depth") <= max_depth
    return (deep.groupBy("root_txn_id")
            .agg(F.max(F.when(kept, F.col("depth"))).alias("chain_length"),
                 F.sort_array(F.collect_list(F.when(kept, F.struct("depth", "txn_id")))).alias("c"), F.max(~kept).alias("is_truncated"))
            .filter(F.col("chain_length") > 0)
            .select("root_txn_id", "chain_length", F.transform("c", lambda x: x["txn_id"]).alias("chain"), "is_truncated"))
