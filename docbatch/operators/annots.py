"""Annotations of documents: classify by subtype, keep by contents, edit, remove and prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.functions.rows import not_listed

# The annotation subtypes that a clean-up removes.
REMOVABLE = ["Text", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Caret", "Ink", "Popup"]


def removable(annots: DataFrame, keep: DataFrame) -> DataFrame:
    """Annotations to remove: removable subtypes, without free texts that hold a word of ``keep`` in any case.

    ``keep`` is counted and sent along with the anti join, in parts if it is long.
    """
    found = annots.filter(F.col("subtype").isin(REMOVABLE))
    words = keep.select(F.lower(T.norm(F.col("word"))).alias("_word"))
    return not_listed(found, words, (F.col("subtype") == "FreeText") & F.contains(F.lower(T.norm(F.col("contents"))), F.col("_word")))


def edit_first(annots: DataFrame, find: str, replace: str) -> DataFrame:
    """Replaces the first literal occurrence in the contents; ``matched`` ignores spacing, ``changed`` does not."""
    at = F.instr("contents", find)
    done = F.concat(F.substring("contents", F.lit(1), at - 1), F.lit(replace), F.substring("contents", at + len(find), F.length("contents")))
    return annots.withColumns({"matched": F.contains(T.norm(F.col("contents")), F.lit(" ".join(find.split()))), "changed": at > 0, "contents": F.when(at > 0, done).otherwise(F.col("contents"))})


def removed_with_proof(before: DataFrame, after: DataFrame, target: Column) -> DataFrame:
    """Per document: annotations before, removed and after, and how many of the target remain."""
    b = before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("after"), F.count_if(target).alias("remaining"))
    after_n = F.coalesce("after", F.lit(0))
    return b.join(a, "doc_id", "left").select("doc_id", "before", (F.col("before") - after_n).alias("removed"), after_n.alias("after"), F.coalesce("remaining", F.lit(0)).alias("remaining"))


def inherited_type(nodes: DataFrame, hops: int) -> DataFrame:
    """(tree, node, field_type, hops): climbs parents by doubling, so ``hops`` steps take log2(hops) joins.

    ``nodes`` has (tree, node, parent, field_type); a parent below 0 or absent ends the walk.
    """
    types = nodes.select("tree", F.col("node").alias("at"), F.col("field_type").alias("its"))
    walk = nodes.select("tree", "node", F.col("node").alias("at"), F.lit(0).alias("h"))
    known = nodes.select("tree", F.col("node").alias("at"))
    step = nodes.filter("parent >= 0").select("tree", F.col("node").alias("at"), F.col("parent").alias("up")).join(known.select("tree", F.col("at").alias("up")), ["tree", "up"], "left_semi").select("tree", "at", "up")
    span = 1
    while span <= hops:
        # rows with h < span are known; one jump of ``span`` steps adds those below 2 * span
        jumped = walk.join(step, ["tree", "at"]).select("tree", "node", F.col("up").alias("at"), (F.col("h") + span).alias("h")).filter(F.col("h") <= hops)
        walk = walk.unionByName(jumped)
        if 2 * span <= hops:
            step = step.join(step.select("tree", F.col("at").alias("up"), F.col("up").alias("upper")), ["tree", "up"]).select("tree", "at", F.col("upper").alias("up"))
        span *= 2
    walk = walk.join(types, ["tree", "at"])
    return walk.groupBy("tree", "node").agg(F.min_by("its", F.when(F.col("its").isNotNull(), F.col("h"))).alias("field_type"), F.max("h").alias("hops"))
