"""Queries of the rule engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.operators import rules as R
from docbatch.plans.catalog import query
from docbatch.sources import tables as S

DISTINCT_SQL = f"""{S.RULES_SQL}, kept_rules AS (
    SELECT * EXCLUDE (r) FROM (
        SELECT *, {T.rule_key_sql("find")} AS rule_key, row_number() OVER (PARTITION BY {T.rule_key_sql("find")} ORDER BY rule_id) AS r
        FROM rules WHERE {T.norm_sql("find")} <> ''
    ) WHERE r = 1
)"""

HITS_SQL = f"""{S.LINES_SQL}, {DISTINCT_SQL}, norm_lines AS (SELECT *, {T.norm_sql("line")} AS s FROM lines),
line_hits AS (
    SELECT doc_id, rule_id, page_no, sum({T.count_of_sql("s", "needle")})::BIGINT AS n
    FROM norm_lines JOIN (SELECT rule_id, {T.norm_sql("find")} AS needle FROM kept_rules) ON contains(s, needle) GROUP BY 1, 2, 3
), exact_hits AS (
    SELECT doc_id, rule_id, sum(n)::BIGINT AS hits, array_to_string(list_sort(list(DISTINCT page_no)), ',') AS pages FROM line_hits GROUP BY 1, 2
)"""

FLEX_SQL = f"""{S.PAGES_SQL}, {DISTINCT_SQL}, page_hits AS (
    SELECT doc_id, rule_id, page_no, sum({T.count_of_sql("s", "needle")})::BIGINT AS n
    FROM (SELECT *, {T.flexible_key_sql("text")} AS s FROM doc_pages) JOIN (SELECT rule_id, {T.flexible_key_sql("find")} AS needle FROM kept_rules) ON needle <> '' AND contains(s, needle)
    GROUP BY 1, 2, 3
), flex_hits AS (
    SELECT doc_id, rule_id, sum(n)::BIGINT AS hits, array_to_string(list_sort(list(DISTINCT page_no)), ',') AS pages FROM page_hits GROUP BY 1, 2
)"""


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_document(R.line_hits(S.lines(S.table(spark, sf_dir, "documents")), S.rules(spark)))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.doc_pages(S.table(spark, sf_dir, "conversations"))


@query("rule_hits", f"WITH {HITS_SQL} SELECT * FROM exact_hits")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact(spark, sf_dir)


#: Openings of lines that make a long list of rules, and their words.
OPENINGS, OPENING_WORDS = 20_000, 3
MANY_SQL = HITS_SQL.replace(
    S.RULES_SQL,
    f"""openings AS (SELECT array_to_string(string_split(s, ' ')[1:{OPENING_WORDS}], ' ') AS find, count(*) AS n FROM (SELECT {T.norm_sql("line")} AS s FROM lines) WHERE len(string_split(s, ' ')) >= {OPENING_WORDS} GROUP BY 1),
    rules AS (SELECT row_number() OVER (ORDER BY n DESC, find)::INTEGER AS rule_id, find, '' AS replace FROM openings ORDER BY rule_id LIMIT {OPENINGS})""",
)


@query("rule_hits_many", f"WITH {MANY_SQL} SELECT * FROM exact_hits")
def rule_hits_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of rules taken from the documents, in one pass over them."""
    lines = S.lines(S.table(spark, sf_dir, "documents"))
    return R.by_document(R.line_hits(lines, R.frequent_openings(lines, OPENING_WORDS, OPENINGS)))


@query("rule_hits_flex", f"WITH {FLEX_SQL} SELECT * FROM flex_hits")
def rule_hits_flex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_document(R.page_hits(conversation_pages(spark, sf_dir), S.rules(spark)))


@query(
    "rule_reinforce",
    f"""WITH {FLEX_SQL}, page_lines AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line FROM doc_pages),
    exact_pages AS (
        SELECT doc_id, rule_id, page_no, sum({T.count_of_sql("s", "needle")})::BIGINT AS n FROM (SELECT *, {T.norm_sql("line")} AS s FROM page_lines)
        JOIN (SELECT rule_id, {T.norm_sql("find")} AS needle FROM kept_rules) ON contains(s, needle) GROUP BY 1, 2, 3
    ), e AS (SELECT doc_id, rule_id, sum(n)::BIGINT AS hits, array_to_string(list_sort(list(DISTINCT page_no)), ',') AS pages FROM exact_pages GROUP BY 1, 2)
    SELECT doc_id, rule_id, greatest(coalesce(e.hits, 0), coalesce(f.hits, 0)) AS hits,
           CASE WHEN coalesce(f.hits, 0) > coalesce(e.hits, 0) THEN f.pages ELSE e.pages END AS pages,
           greatest(coalesce(f.hits, 0) - coalesce(e.hits, 0), 0) AS added
    FROM e FULL JOIN flex_hits f USING (doc_id, rule_id)""",
)
def rule_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    exact_hits = R.by_document(R.line_hits(pages.select("doc_id", "page_no", F.explode(F.split("text", "\n")).alias("line")), S.rules(spark)))
    return R.reinforced(exact_hits, R.by_document(R.page_hits(pages, S.rules(spark))))


@query(
    "active_rules",
    f"""WITH {HITS_SQL} SELECT rule_id, find, replace, coalesce(sum(hits), 0)::BIGINT AS hits
    FROM rules LEFT JOIN exact_hits USING (rule_id) WHERE {T.norm_sql("find")} <> '' AND replace <> '' GROUP BY 1, 2, 3""",
)
def active_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = exact(spark, sf_dir).groupBy("rule_id").agg(F.sum("hits").alias("hits"))
    return R.active_rules(S.rules(spark)).join(hits, "rule_id", "left").select("rule_id", "find", "replace", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("rule_dedupe", f"WITH {HITS_SQL} SELECT rule_id, rule_key, count(DISTINCT doc_id) AS docs FROM kept_rules LEFT JOIN exact_hits USING (rule_id) GROUP BY 1, 2")
def rule_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_rules(S.rules(spark)).join(exact(spark, sf_dir), "rule_id", "left").groupBy("rule_id", "rule_key").agg(F.countDistinct("doc_id").alias("docs"))


@query(
    "pending_rules",
    f"""WITH {HITS_SQL} SELECT d.doc_id, r.rule_id FROM documents d CROSS JOIN kept_rules r
    WHERE NOT EXISTS (SELECT 1 FROM exact_hits e WHERE e.doc_id = d.doc_id AND e.rule_id = r.rule_id)""",
)
def pending_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the cheap stage left without a hit, per document."""
    rules = R.distinct_rules(S.rules(spark)).select("rule_id")
    return R.without_hit(S.table(spark, sf_dir, "documents").select("doc_id"), rules, exact(spark, sf_dir))


@query(
    "missing_rules",
    f"""WITH {FLEX_SQL}, turns AS (SELECT doc_id, page_no, {T.variant_key_sql("text")} AS k FROM doc_pages)
    SELECT d.doc_id, rule_id, variant_key FROM (SELECT DISTINCT doc_id FROM doc_pages) d
    CROSS JOIN (SELECT rule_id, {T.variant_key_sql("find")} AS variant_key FROM kept_rules) r
    WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.doc_id = d.doc_id AND contains(t.k, r.variant_key))""",
)
def missing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir).withColumn("k", T.variant_key(F.col("text")))
    rules = R.distinct_rules(S.rules(spark)).select("rule_id", T.variant_key(F.col("find")).alias("variant_key")).filter("variant_key <> ''")
    hits = R.needle_counts(pages, ["doc_id"], "k", rules.withColumnRenamed("variant_key", "needle"))
    return R.without_hit(pages.select("doc_id").distinct(), rules, hits)


@query(
    "batch_totals",
    f"""WITH {HITS_SQL} SELECT rule_id, sum(hits)::BIGINT AS hits, count(*) AS docs, count_if(hits >= 10) AS heavy_docs, max(hits) AS most FROM exact_hits GROUP BY 1""",
)
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact(spark, sf_dir).groupBy("rule_id").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("docs"), F.count_if(F.col("hits") >= 10).alias("heavy_docs"), F.max("hits").alias("most"))


@query(
    "hit_lines",
    f"""WITH {HITS_SQL} SELECT doc_id, string_agg(rule_id || ':' || hits, '; ' ORDER BY rule_id) AS line FROM exact_hits WHERE hits > 0 GROUP BY 1""",
)
def hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("rule_id", "hits")))
    shown = F.transform(rows, lambda r: F.concat_ws(":", r["rule_id"], r["hits"]))
    return exact(spark, sf_dir).filter("hits > 0").groupBy("doc_id").agg(F.array_join(shown, "; ").alias("line"))


@query(
    "coalesced_count",
    f"""WITH {HITS_SQL}, w AS (SELECT doc_id, max(CASE WHEN rule_id = 1 THEN hits END) a, max(CASE WHEN rule_id = 5 THEN hits END) b, max(CASE WHEN rule_id = 7 THEN hits END) c FROM exact_hits GROUP BY 1)
    SELECT doc_id, coalesce(nullif(a, 0), nullif(b, 0), nullif(c, 0), 1) AS first_count, greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)) AS most_count FROM w""",
)
def coalesced_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = exact(spark, sf_dir).groupBy("doc_id").agg(*(F.max(F.when(F.col("rule_id") == r, F.col("hits"))).alias(n) for n, r in (("a", 1), ("b", 5), ("c", 7))))
    zero = [F.coalesce(c, F.lit(0)) for c in ("a", "b", "c")]
    return wide.select("doc_id", F.coalesce(*(F.nullif(F.col(c), F.lit(0)) for c in ("a", "b", "c")), F.lit(1)).alias("first_count"), F.greatest(*zero).alias("most_count"))


@query(
    "first_hit_page",
    f"""WITH {S.ANNOTS_SQL}, {HITS_SQL}, {S.PAGES_SQL}, every AS (
        SELECT doc_id, rule_id, 0 AS kind, page_no FROM line_hits
        UNION ALL SELECT doc_id, rule_id, 1, 1 + (ann_no - 1) // 5 FROM annots JOIN kept_rules ON subtype = 'FreeText' AND contains({T.norm_sql("contents")}, {T.norm_sql("find")})
        UNION ALL SELECT doc_id, rule_id, 2, page_no + 1 FROM (SELECT *, {T.flexible_key_sql("text")} AS s FROM doc_pages) JOIN (SELECT rule_id, {T.flexible_key_sql("find")} AS needle FROM kept_rules) ON needle <> '' AND contains(s, needle))
    SELECT d.doc_id, coalesce(arg_min(p.page_no, p.rule_id * 1000000 + p.kind * 100000 + p.page_no), 1)::INTEGER AS page_no
    FROM documents d LEFT JOIN every p ON p.doc_id = d.doc_id GROUP BY 1""",
)
def first_hit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first rule with hits its first page with text, else with an annotation, else with recognised text (here the turns of a conversation)."""
    docs, rules = S.table(spark, sf_dir, "documents"), S.rules(spark)
    notes = S.annotations(S.table(spark, sf_dir, "pages")).filter("subtype = 'FreeText'").select("doc_id", F.expr("cast(1 + (ann_no - 1) div 5 as int)").alias("page_no"), F.col("contents").alias("line"))
    seen = R.page_hits(conversation_pages(spark, sf_dir), rules).withColumn("page_no", F.col("page_no") + 1)
    return R.first_pages(docs, R.line_hits(S.lines(docs), rules), R.line_hits(notes, rules), seen)


@query(
    "reason_list",
    f"""WITH {HITS_SQL}, reasons AS (SELECT doc_id, CASE WHEN hits >= 100 THEN 'many' WHEN hits >= 10 THEN 'some' END AS reason FROM exact_hits)
    SELECT doc_id, coalesce(nullif(coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ', '), ''), ''), 'none') AS reasons FROM reasons GROUP BY 1""",
)
def reason_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reasons(exact(spark, sf_dir), ("many", F.col("hits") >= 100), ("some", F.col("hits") >= 10))


@query(
    "pattern_conflicts",
    f"""WITH {S.LINES_SQL}, pat AS (SELECT doc_id, line_no, left({T.norm_sql("line")}, 16) AS prefix, {T.norm_sql("line")} AS find, lang AS replace FROM lines JOIN documents USING (doc_id))
    SELECT prefix, count(*) AS n, count(DISTINCT find) AS finds, count(DISTINCT replace) AS replaces, count(DISTINCT replace) > 1 AS ambiguous
    FROM pat WHERE length(find) >= 16 GROUP BY 1 HAVING count(*) > 1""",
)
def pattern_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts that share a prefix meet in one bucket; one text with several replacements is refused."""
    docs = S.table(spark, sf_dir, "documents")
    rows = S.lines(docs).join(docs.select("doc_id", "lang"), "doc_id").select(T.norm(F.col("line")).alias("find"), F.col("lang").alias("replace"))
    return R.ambiguous_patterns(rows)


@query(
    "space_variants",
    "WITH m AS (SELECT doc_id, len(regexp_extract_all(text, 'of {1,4}the'))::BIGINT AS n, len(regexp_extract_all(text, 'of the'))::BIGINT AS exact FROM documents) SELECT * FROM m WHERE n > 0",
)
def space_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space of the search text stands for one to four spaces."""
    rows = S.table(spark, sf_dir, "documents").select("doc_id", R.spaced_counts(F.col("text"), "of the").alias("c"))
    return rows.select("doc_id", "c.*").filter("n > 0")


@query(
    "encodable_gate",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '^[\\x00-\\x7f\\x{a0}-\\x{ff}\\x{20ac}\\x{201a}\\x{192}\\x{201e}\\x{2026}\\x{2020}\\x{2021}\\x{2c6}\\x{2030}\\x{160}\\x{2039}\\x{152}\\x{17d}\\x{2018}\\x{2019}\\x{201c}\\x{201d}\\x{2022}\\x{2013}\\x{2014}\\x{2dc}\\x{2122}\\x{161}\\x{203a}\\x{153}\\x{17e}\\x{178}]*$')
    THEN NULL ELSE 'not encodable' END AS reason FROM documents""",
)
def encodable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.when(~F.col("text").rlike(T.ENCODABLE), "not encodable").alias("reason"))


@query(
    "self_containing_rules",
    f"""WITH {HITS_SQL} SELECT rule_id, contains({T.rule_key_sql("replace")}, {T.rule_key_sql("find")}) AS self_containing, count(DISTINCT doc_id) AS docs
    FROM kept_rules LEFT JOIN exact_hits USING (rule_id) GROUP BY 1, 2""",
)
def self_containing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replacement that contains what it replaces cannot be verified by the absence of the old text."""
    rules = R.distinct_rules(S.rules(spark)).withColumn("self_containing", F.contains(T.rule_key(F.col("replace")), T.rule_key(F.col("find"))))
    return rules.join(exact(spark, sf_dir), "rule_id", "left").groupBy("rule_id", "self_containing").agg(F.countDistinct("doc_id").alias("docs"))


@query(
    "top_hit_docs",
    f"""WITH {HITS_SQL} SELECT * FROM (SELECT rule_id, doc_id, hits, row_number() OVER (PARTITION BY rule_id ORDER BY hits DESC, doc_id)::INTEGER AS place FROM exact_hits) WHERE place <= 5""",
)
def top_hit_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("rule_id").orderBy(F.desc("hits"), "doc_id")
    return exact(spark, sf_dir).withColumn("place", F.row_number().over(order)).filter("place <= 5").select("rule_id", "doc_id", "hits", "place")
