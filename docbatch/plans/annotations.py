"""Queries of annotations: counting, filtering with exceptions, editing, removing with proof, and ancestor walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.functions.rows import joined_list
from docbatch.operators import annots as A
from docbatch.plans.catalog import query
from docbatch.sources import tables as S

# Words whose presence in the contents keeps an annotation.
KEEP = ["the", "de", "und"]
KEEP_SQL = "keep(word) AS (VALUES " + ", ".join(f"('{w}')" for w in KEEP) + ")"


def annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.annotations(S.table(spark, sf_dir, "pages"))


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in KEEP], "word string")


@query(
    "annot_rule_hits",
    f"""WITH {S.ANNOTS_SQL}, {KEEP_SQL} SELECT doc_id, word, count(*) AS hits FROM annots JOIN keep ON contains({T.norm_sql("contents")}, {T.norm_sql("word")}) WHERE subtype = 'FreeText' GROUP BY 1, 2""",
)
def annot_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation counts once for a rule, however often its contents hold the text."""
    free = annots(spark, sf_dir).filter("subtype = 'FreeText'").withColumn("s", T.norm(F.col("contents")))
    return joined_list(free, words(spark), F.contains("s", T.norm(F.col("word")))).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "annot_keep",
    f"""WITH {S.ANNOTS_SQL}, {KEEP_SQL} SELECT doc_id, ann_no, subtype FROM annots a WHERE subtype IN ({", ".join(f"'{x}'" for x in A.REMOVABLE)})
    AND NOT (subtype = 'FreeText' AND EXISTS (SELECT 1 FROM keep WHERE contains(lower({T.norm_sql("a.contents")}), lower({T.norm_sql("word")}))))""",
)
def annot_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.removable(annots(spark, sf_dir), words(spark)).select("doc_id", "ann_no", "subtype")


@query("annot_types", f"WITH {S.ANNOTS_SQL} SELECT subtype, count(*) AS n, count(DISTINCT doc_id) AS docs FROM annots WHERE subtype IN ({', '.join(repr(x) for x in A.REMOVABLE)}) GROUP BY 1")
def annot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annots(spark, sf_dir).filter(F.col("subtype").isin(A.REMOVABLE)).groupBy("subtype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("annot_counts", f"WITH {S.ANNOTS_SQL} SELECT doc_id, count_if(subtype = 'Widget') AS signatures, count_if(subtype = 'FreeText') AS free_texts, count_if(subtype = 'Text') AS others, count(*) AS total FROM annots GROUP BY 1")
def annot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("subtype") == s)
    return annots(spark, sf_dir).groupBy("doc_id").agg(n("Widget").alias("signatures"), n("FreeText").alias("free_texts"), n("Text").alias("others"), F.count(F.lit(1)).alias("total"))


@query(
    "annot_edit",
    f"""WITH {S.ANNOTS_SQL} SELECT doc_id, ann_no, contains({T.norm_sql("contents")}, 'th') AS matched,
    CASE WHEN contains(contents, 'th') THEN concat(substring(contents, 1, instr(contents, 'th') - 1), 'TH', substring(contents, instr(contents, 'th') + 2)) ELSE contents END AS contents,
    contains(contents, 'th') AS changed FROM annots WHERE subtype = 'FreeText'""",
)
def annot_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence alone is edited; a match in spelling only is told apart from a change."""
    return A.edit_first(annots(spark, sf_dir).filter("subtype = 'FreeText'"), "th", "TH").select("doc_id", "ann_no", "matched", "contents", "changed")


@query(
    "annot_remove",
    f"""WITH {S.ANNOTS_SQL} SELECT doc_id, count(*) AS before, count_if(subtype = 'Text') AS removed, count_if(subtype <> 'Text') AS after, 0::BIGINT AS remaining FROM annots GROUP BY 1""",
)
def annot_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of a subtype, recounted: ``remaining`` must be 0."""
    before = annots(spark, sf_dir)
    return A.removed_with_proof(before, before.filter("subtype <> 'Text'"), F.col("subtype") == "Text")


TREE_SQL = "nodes AS (SELECT conv_id, turn, turn - 1 AS parent, CASE WHEN turn = 0 THEN role END AS field_type FROM conversations)"


def field_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("turn") == 0, F.col("role"))
    return S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree"), F.col("turn").alias("node"), (F.col("turn") - 1).alias("parent"), own.alias("field_type"))


@query(
    "ancestor_type",
    f"""WITH RECURSIVE {TREE_SQL}, walk AS (
        SELECT conv_id, turn, turn AS at, 0 AS hops FROM nodes
        UNION ALL SELECT w.conv_id, w.turn, n.parent, hops + 1 FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.turn = w.at WHERE n.parent >= 0 AND hops < 8
    ) SELECT w.conv_id AS tree, w.turn AS node, arg_min(n.field_type, hops) FILTER (n.field_type IS NOT NULL) AS field_type, max(hops)::INTEGER AS hops
    FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.turn = w.at GROUP BY 1, 2""",
)
def ancestor_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of the nearest ancestor that has one, at most eight steps up."""
    return A.inherited_type(field_tree(spark, sf_dir), hops=8)
