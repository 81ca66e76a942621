"""Orders and reachability over the object graphs of documents, by joins in rounds.

A round is a join that doubles how far is seen, or follows one more link; what decides whether another one
comes is whether the last found anything.  Circles end, as nothing in them is new twice.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """The rows, written by checkpoint() to the folder in spark.checkpoint.dir, so that no round carries the plans of those before."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliomill-"))
    return df.checkpoint()


def chain_ranks(heads: DataFrame, following: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, parent, node, rank) of all nodes that follow from each parent's first one.

    heads (group, parent, node) and following (group, node, next), one next a node.  Each round reaches twice as far by
    joining the jumps with themselves.  A node that is reached twice keeps its smallest rank, of equal ones the
    smallest parent.
    """
    reached = _kept(heads.select(group, "parent", "node", F.lit(0).alias("rank")))
    jumps = _kept(following.where(F.col("next").isNotNull()).select(group, "node", "next"))
    step = 1
    while True:
        onward = reached.join(jumps, [group, "node"]).select(group, "parent", F.col("next").alias("node"), (F.col("rank") + step).alias("rank"))
        best = F.min(F.struct("rank", "parent")).alias("_best")
        found = _kept(reached.unionByName(onward).groupBy(group, "node").agg(best).select(group, "_best.parent", "node", "_best.rank"))
        if found.count() == reached.count():
            return found
        twice = jumps.select(group, F.col("node").alias("_from"), F.col("next").alias("node"))
        jumps = _kept(twice.join(jumps, [group, "node"]).select(group, F.col("_from").alias("node"), "next"))
        reached, step = found, step * 2


def outline_order(items: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, node_ord, parent_ord, level, node, title, path) of outline items (group, node, title, first, next) in the order of reading.

    A root has the node 0, which is in no outline itself.  Items that no chain from the root reaches take no part.
    The rank among its siblings is found by pointer jumping over `next`, the ranks of all its ancestors by pointer
    jumping over parents; an item's place is the order of these ranks.
    """
    heads = items.where(F.col("first").isNotNull()).select(group, F.col("node").alias("parent"), F.col("first").alias("node"))
    ranked = chain_ranks(heads, items.where("node <> 0").select(group, "node", "next"), group)
    named = ranked.where("node <> 0").join(items.select(group, "node", "title"), [group, "node"])
    # `up` is an ancestor, and `ranks` and `titles` belong to the items below it down to this one.
    known = _kept(named.select(group, "node", "parent", F.col("parent").alias("up"), F.array("rank").alias("ranks"), F.array("title").alias("titles")))
    open_ = known.where("up <> 0").count()
    while open_:
        above = known.select(F.col(group).alias("_g"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("ranks").alias("_ranks"), F.col("titles").alias("_titles"))
        joined = known.join(above, (F.col(group) == F.col("_g")) & (F.col("up") == F.col("_n")), "left")
        done = F.col("up") == 0
        further = _kept(joined.where(done | F.col("_n").isNotNull()).select(
            group, "node", "parent", F.when(done, F.lit(0)).otherwise(F.col("_up")).cast(known.schema["up"].dataType).alias("up"),
            F.when(done, F.col("ranks")).otherwise(F.concat("_ranks", "ranks")).alias("ranks"), F.when(done, F.col("titles")).otherwise(F.concat("_titles", "titles")).alias("titles")))
        left = further.where("up <> 0").count()
        if left == open_ and further.where((F.col("up") == 0)).count() == known.where("up = 0").count():
            known = further.where("up = 0")  # what is left goes round in circles
            break
        known, open_ = further, left
    order = Window.partitionBy(group).orderBy("ranks")
    placed = known.withColumn("node_ord", F.row_number().over(order) - 1)
    parents = placed.select(F.col(group).alias("_g"), F.col("node").alias("_n"), F.col("node_ord").alias("parent_ord"))
    out = placed.join(parents, (F.col(group) == F.col("_g")) & (F.col("parent") == F.col("_n")), "left")
    return out.select(group, "node_ord", "parent_ord", F.size("ranks").alias("level"), "node", F.element_at("titles", -1).alias("title"), F.array_join("titles", " / ").alias("path"))


def target_pages(outline: DataFrame, destinations: DataFrame, pages: DataFrame, group: str = "doc_id") -> DataFrame:
    """The outline with `target_page`: the number of the page object (group, node, page_node) that an item names, or null."""
    to = destinations.join(pages.select(group, F.col("node").alias("page_node"), F.col("page").alias("target_page")), [group, "page_node"]).select(group, "node", "target_page")
    return outline.join(to, [group, "node"], "left")


def page_images(pages: DataFrame, links: DataFrame, images: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, page, image_index) and the columns of `images` (group, node, ...): one row for each image.

    pages (group, page, node), links (group, node, target).  An image belongs to the first page that reaches it over any
    number of links (parents of the page, forms in forms); one that no page reaches has a null page and comes last.
    """
    edges = _kept(links.select(group, "node", "target").distinct())
    seen = frontier = _kept(pages.groupBy(group, "node").agg(F.min("page").alias("page")))
    while frontier.limit(1).count():
        onward = frontier.join(edges, [group, "node"]).groupBy(group, F.col("target").alias("node")).agg(F.min("page").alias("page"))
        both = seen.select(group, "node", F.col("page").alias("_had"))
        # A node counts as new where a smaller page reaches it than before.
        frontier = _kept(onward.join(both, [group, "node"], "left").where(F.col("_had").isNull() | (F.col("page") < F.col("_had"))).select(group, "node", "page"))
        seen = _kept(seen.unionByName(frontier).groupBy(group, "node").agg(F.min("page").alias("page")))
    order = Window.partitionBy(group).orderBy(F.col("page").asc_nulls_last(), "node")
    placed = images.join(seen, [group, "node"], "left").withColumn("image_index", F.row_number().over(order) - 1)
    return placed.select(group, "page", "image_index", "node", *[c for c in images.columns if c not in (group, "node")])
