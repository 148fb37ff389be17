"""Queries of located and verified edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.operators import edits as E
from docbatch.plans.catalog import query
from docbatch.sources import tables as S

FIND, REPLACE = "of the", "from-that"
#: The flexible pattern of FIND, for RE2.
PATTERN_SQL = (T.FLEX_SQL + "*").join("ofthe")



def occ_sql(name: str = "occ", source: str = "documents") -> str:
    """(doc_id, ordinal, start, end_, match, text, occurrence_id) of FIND in a table."""
    return f"""{name} AS (
    SELECT doc_id, text, ordinal::INTEGER AS ordinal, (g0 + m0)::INTEGER AS start, (g0 + m0 + length(match))::INTEGER AS end_, match, substring(md5(concat_ws('|', 'ofthe', doc_id, ordinal)), 1, 16) AS occurrence_id FROM (
        SELECT doc_id, text, ordinal, match, sum(length(gap)) OVER w AS g0, coalesce(sum(length(match)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m0
        FROM (SELECT doc_id, text, unnest(ms) AS match, unnest(gs[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS ordinal
              FROM (SELECT doc_id, text, regexp_extract_all(text, '{PATTERN_SQL}') AS ms, string_split_regex(text, '{PATTERN_SQL}') AS gs FROM {source}))
        WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)
    )
)"""


OCC_SQL = occ_sql()


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.occurrences(docs(spark, sf_dir).select("doc_id", "text"), FIND).withColumn("occurrence_id", E.occurrence_id(FIND, "doc_id", "ordinal"))


@query(
    "occurrences",
    f"""WITH {OCC_SQL} SELECT doc_id, occurrence_id, ordinal, start, end_, match, substring(text, greatest(start - 18, 0) + 1, least(start, 18)) AS before, substring(text, end_ + 1, 18) AS after FROM occ""",
)
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occ(spark, sf_dir).select("doc_id", "occurrence_id", "ordinal", "start", F.col("end").alias("end_"), "match", "before", "after")


@query("flex_replace", f"SELECT doc_id, md5(regexp_replace(text, '{PATTERN_SQL}', '{REPLACE}', 'g')) AS digest, len(regexp_extract_all(text, '{PATTERN_SQL}')) AS edits FROM documents")
def flex_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(E.replaced(F.col("text"), FIND, REPLACE)).alias("digest"), F.regexp_count("text", F.lit(T.flexible_pattern(FIND))).alias("edits"))


APPLIED = [(f, r) for _, f, r in S.RULES if f.strip() and r and f not in ("the  ", "THE")]


def _nested(column: str, rules: list[tuple[str, str]]) -> str:
    for find, replace in rules:
        column = f"replace({column}, '{find}', '{replace}')"
    return column


@query("rules_in_order", f"SELECT doc_id, md5({_nested('text', APPLIED)}) AS digest, length({_nested('text', APPLIED)}) AS n_chars FROM documents")
def rules_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = E.replaced_in_order(F.col("text"), APPLIED)
    return docs(spark, sf_dir).select("doc_id", F.md5(done).alias("digest"), F.length(done).alias("n_chars"))


#: A replacement that the flexible pattern finds again.
AGAIN = "of-the"


@query(
    "cascade_edit",
    f"""WITH c AS (SELECT doc_id, text, {T.count_of_sql("text", f"'{FIND}'")} AS direct, len(regexp_extract_all(text, '{PATTERN_SQL}')) AS expected, replace(text, '{FIND}', '{AGAIN}') AS new FROM documents),
    g AS (SELECT *, string_split_regex(new, '{PATTERN_SQL}') AS gs, regexp_extract_all(new, '{PATTERN_SQL}') AS ms FROM c WHERE expected > 0)
    SELECT doc_id, expected::BIGINT AS expected, direct::BIGINT AS direct, least(expected - direct, len(ms))::BIGINT AS by_fallback,
           md5(array_to_string(list_transform(gs, lambda x, i: x || CASE WHEN i > len(ms) THEN '' WHEN i <= expected - direct THEN '{AGAIN}' ELSE ms[i] END), '')) AS digest FROM g""",
)
def cascade_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact replacement first; the flexible one does what it left, and no more than that."""
    out = E.cascade(docs(spark, sf_dir).select("doc_id", "text"), FIND, AGAIN).filter("expected > 0")
    return out.select("doc_id", "expected", "direct", "by_fallback", F.md5("done").alias("digest"))


@query(
    "verified_count",
    f"""WITH e AS (SELECT doc_id, text, replace(text, '{FIND}', '{REPLACE}') AS new FROM documents)
    SELECT doc_id, least(greatest({T.count_of_sql("text", f"'{FIND}'")} - {T.count_of_sql("new", f"'{FIND}'")}, 0), greatest({T.count_of_sql("new", f"'{REPLACE}'")} - {T.count_of_sql("text", f"'{REPLACE}'")}, 0))::BIGINT AS verified FROM e""",
)
def verified_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that a recount proves: old text gone and new text come, whichever is fewer."""
    new = F.replace(F.col("text"), F.lit(FIND), F.lit(REPLACE))
    return docs(spark, sf_dir).select("doc_id", E.proved_edits(F.col("text"), new, F.lit(FIND), F.lit(REPLACE)).alias("verified"))


@query(
    "retry_pick",
    f"""WITH e AS (SELECT doc_id, n_chars, {T.count_of_sql("text", f"'{FIND}'")} AS first, len(regexp_extract_all(text, '{PATTERN_SQL}'))::BIGINT AS retry FROM documents)
    SELECT doc_id, n_chars >= 16384 AS heavy, CASE WHEN n_chars < 16384 AND retry > first THEN 'retry' ELSE 'first' END AS kept, CASE WHEN n_chars < 16384 AND retry > first THEN retry ELSE first END::BIGINT AS edits FROM e""",
)
def retry_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second strategy is kept only if it is strictly better, and never for heavy documents."""
    heavy = F.col("n_chars") >= 16384
    first, retry = T.count_of(F.col("text"), F.lit(FIND)), F.regexp_count("text", F.lit(T.flexible_pattern(FIND))).cast("long")
    return docs(spark, sf_dir).select("doc_id", heavy.alias("heavy"), E.better_retry(first, retry, heavy).alias("r")).select("doc_id", "heavy", "r.*")


@query(
    "post_verify",
    f"""WITH {S.RULES_SQL}, r AS (SELECT * FROM rules WHERE {T.norm_sql("find")} <> '' AND replace <> ''),
    e AS (SELECT doc_id, rule_id, contains({T.rule_key_sql("replace")}, {T.rule_key_sql("find")}) AS loops, contains(text, find) AS had, contains(replace(text, find, replace), find) AS left_over FROM documents CROSS JOIN r)
    SELECT rule_id, count_if(had) AS docs, count_if(had AND NOT loops AND NOT left_over) AS proved, count_if(had AND (loops OR left_over)) AS unresolved FROM e GROUP BY 1""",
)
def post_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit counts as done only if its rule cannot bring the old text back and a recount finds none of it."""
    from docbatch.operators.rules import active_rules

    return E.post_verified(docs(spark, sf_dir), active_rules(S.rules(spark)))


@query(
    "failsafe_output",
    f"""WITH e AS (SELECT doc_id, text, replace(text, 'que', 'que-que') AS new FROM documents WHERE lang <> 'de')
    SELECT doc_id, contains(new, 'que') AS failed, md5(CASE WHEN contains(new, 'que') THEN text ELSE new END) AS digest FROM e""",
)
def failsafe_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document whose edit cannot be proved keeps its original; documents without analysis give no output."""
    new = F.replace(F.col("text"), F.lit("que"), F.lit("que-que"))
    rows = docs(spark, sf_dir).filter("lang <> 'de'").select("doc_id", E.failsafe(F.col("text"), new, F.contains(new, F.lit("que"))).alias("o"))
    return rows.select("doc_id", "o.failed", F.md5("o.text").alias("digest"))


_APPLIED_SQL = f"""e AS (SELECT lang, doc_id, text AS before, replace(text, '{FIND}', '{REPLACE}') AS after, len(regexp_extract_all(text, '{PATTERN_SQL}'))::BIGINT AS expected, {T.count_of_sql("text", f"'{FIND}'")}::BIGINT AS edits, contains(text, '{REPLACE}') OR n_chars > 15000 AS failed FROM documents)"""


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact replacement of every document; it fails where the new text is there before, and for very long ones."""
    text = F.col("text")
    return docs(spark, sf_dir).select(
        "lang", "doc_id", text.alias("before"), F.replace(text, F.lit(FIND), F.lit(REPLACE)).alias("after"),
        F.regexp_count(text, F.lit(T.flexible_pattern(FIND))).cast("long").alias("expected"), T.count_of(text, F.lit(FIND)).alias("edits"), (F.contains(text, F.lit(REPLACE)) | (F.col("n_chars") > 15000)).alias("failed"),
    )


@query(
    "apply_totals",
    f"""WITH {_APPLIED_SQL} SELECT lang, count_if(NOT failed) AS outputs, count_if(failed) AS failures, sum(CASE WHEN failed THEN 0 ELSE edits END)::BIGINT AS edits, count_if(NOT failed AND expected > edits) AS unresolved,
        sum(strlen(before))::BIGINT AS bytes_before, sum(CASE WHEN failed THEN strlen(before) ELSE strlen(after) END)::BIGINT AS bytes_after FROM e GROUP BY 1""",
)
def apply_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs, failures, edits, unresolved documents and bytes before and after, for each language."""
    return E.apply_totals(applied(spark, sf_dir), ["lang"])


@query("unresolved_docs", f"WITH {_APPLIED_SQL} SELECT lang, doc_id, CASE WHEN failed THEN 'failed' ELSE 'unresolved' END AS state, CASE WHEN failed THEN expected ELSE expected - edits END AS open FROM e WHERE failed OR expected > edits")
def unresolved_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the documents that failed or have edits left."""
    return E.unresolved(applied(spark, sf_dir), ["lang", "doc_id"])


@query(
    "selected_edit",
    f"""WITH {OCC_SQL}, s AS (SELECT doc_id, occurrence_id FROM occ WHERE ordinal % 2 = 1 UNION ALL SELECT doc_id, 'gone' FROM documents WHERE doc_id % 10 = 0),
    o AS (SELECT *, ordinal % 2 = 1 AS chosen, coalesce(lag(end_) OVER (PARTITION BY doc_id ORDER BY ordinal), 0) AS pe FROM occ),
    e AS (SELECT doc_id, count(*) AS found, count_if(chosen) AS applied, string_agg(substring(text, pe + 1, start - pe) || CASE WHEN chosen THEN '{REPLACE}' ELSE match END, '' ORDER BY ordinal) AS head, max(end_) AS tail FROM o GROUP BY 1),
    n AS (SELECT doc_id, count(*) AS selected, count_if(occurrence_id = 'gone') AS missing FROM s GROUP BY 1)
    SELECT doc_id, coalesce(found, 0) AS found, coalesce(selected, 0) AS selected, coalesce(applied, 0) AS applied, coalesce(missing, 0) AS missing, CASE WHEN missing > 0 THEN 'missing ids' WHEN selected IS NULL THEN 'nothing selected' END AS reason,
        md5(CASE WHEN missing > 0 OR selected IS NULL THEN text ELSE head || substring(text, tail + 1) END) AS digest FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN n USING (doc_id)""",
)
def selected_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only chosen occurrences change, here every other one of a document; some documents ask for one that is not there."""
    found = occ(spark, sf_dir)
    gone = docs(spark, sf_dir).filter("doc_id % 10 = 0").select("doc_id", F.lit("gone").alias("occurrence_id"))
    selected = found.filter("ordinal % 2 = 1").select("doc_id", "occurrence_id").unionByName(gone)
    out = E.apply_selected(docs(spark, sf_dir).select("doc_id", "text"), found.drop("text"), selected, REPLACE)
    return out.select("doc_id", "found", "selected", "applied", "missing", "reason", F.md5("text").alias("digest"))


@query(
    "whole_job",
    f"""WITH {OCC_SQL}, s AS (SELECT doc_id, count(*) FILTER (ordinal % 2 = 1) AS chosen FROM occ GROUP BY 1),
    j AS (SELECT lang, doc_id, coalesce(chosen, 0) + (doc_id % 10 = 0 AND lang = 'de')::INTEGER AS selected, doc_id % 10 = 0 AND lang = 'de' AS gone FROM documents LEFT JOIN s USING (doc_id))
    SELECT lang, count(*) AS docs, sum(selected)::BIGINT AS selected, CASE WHEN bool_or(gone) THEN 'failed' ELSE 'done' END AS job FROM j GROUP BY 1""",
)
def whole_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each language: it fails as a whole where what was applied is not what was selected, here in one language that asks for occurrences that are not there."""
    rows, found = docs(spark, sf_dir).select("doc_id", "lang", "text"), occ(spark, sf_dir)
    gone = rows.filter("doc_id % 10 = 0 and lang = 'de'").select("doc_id", F.lit("gone").alias("occurrence_id"))
    selected = found.filter("ordinal % 2 = 1").select("doc_id", "occurrence_id").unionByName(gone)
    out = E.apply_selected(rows.select("doc_id", "text"), found.drop("text"), selected, REPLACE).withColumnRenamed("text", "done").join(rows, "doc_id")
    jobs = E.whole_job(out.select("lang", "doc_id", "selected", "reason", F.col("text").alias("original"), F.col("done").alias("text")), ["lang"])
    return jobs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("selected").alias("selected"), F.max("job").alias("job"))


@query(
    "capped_edit",
    f"""WITH {OCC_SQL} SELECT doc_id, ordinal, start FROM (SELECT o.*, {T.count_of_sql("o.text", "'of'")} AS remaining FROM occ o) WHERE ordinal <= remaining // 4""",
)
def capped_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No more replacements than remain to be expected, in order of place."""
    found = occ(spark, sf_dir).withColumn("remaining", T.count_of(F.col("text"), F.lit("of")))
    return E.capped(found, F.expr("remaining div 4"), ["doc_id"]).select("doc_id", "ordinal", "start")


_FIELDS = ("ordinal", "match", "before", "after")
_CONTEXT_SQL = "substring(text, greatest(start - 18, 0) + 1, least(start, 18)) AS before, substring(text, end_ + 1, 18) AS after"


@query(
    "reconcile",
    f"""WITH later AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x of the y ' || text WHEN doc_id % 5 = 1 THEN replace(text, 'of the', 'of that') ELSE text END AS text FROM documents), {occ_sql()}, {occ_sql("now", "later")},
    b AS (SELECT doc_id, occurrence_id, ordinal, match, {_CONTEXT_SQL} FROM occ), c AS (SELECT doc_id, occurrence_id, ordinal, match, {_CONTEXT_SQL} FROM now)
    SELECT doc_id, occurrence_id, CASE WHEN b.ordinal IS NULL THEN 'added' WHEN c.ordinal IS NULL THEN 'missing' ELSE 'changed' END AS problem
    FROM b FULL JOIN c USING (doc_id, occurrence_id) WHERE (b.ordinal, b.match, b.before, b.after) IS DISTINCT FROM (c.ordinal, c.match, c.before, c.after)""",
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences against those of a later state, by id, with all that is known of them."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x of the y "), F.col("text"))).when(F.col("doc_id") % 5 == 1, F.replace("text", F.lit("of the"), F.lit("of that"))).otherwise(F.col("text"))
    later = E.occurrences(docs(spark, sf_dir).select("doc_id", text.alias("text")), FIND).withColumn("occurrence_id", E.occurrence_id(FIND, "doc_id", "ordinal"))
    return E.reconciled(occ(spark, sf_dir), later, ["doc_id", "occurrence_id"], list(_FIELDS))


@query(
    "strategy_pick",
    f"""WITH c AS (SELECT doc_id, {T.count_of_sql("text", f"'{FIND}'")} AS exact, len(regexp_extract_all(text, 'of {{1,4}}the')) AS spaced, len(regexp_extract_all(text, '{PATTERN_SQL}')) AS flexible FROM documents)
    SELECT doc_id, CASE WHEN exact = flexible THEN 'exact' WHEN spaced = flexible THEN 'spaced' ELSE 'unsupported' END AS strategy FROM c WHERE flexible > 0""",
)
def strategy_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first strategy whose count is the expected one."""
    exact, spaced = T.count_of(F.col("text"), F.lit(FIND)), F.regexp_count("text", F.lit("of {1,4}the"))
    flexible = F.regexp_count("text", F.lit(T.flexible_pattern(FIND)))
    rows = docs(spark, sf_dir).select("doc_id", exact.alias("exact"), spaced.alias("spaced"), flexible.alias("flexible")).filter("flexible > 0")
    return rows.select("doc_id", E.first_strategy(F.col("flexible"), ("exact", F.col("exact")), ("spaced", F.col("spaced"))).alias("strategy"))


@query(
    "all_or_nothing",
    f"""WITH c AS (SELECT doc_id, text, {T.count_of_sql("text", f"'{FIND}'")} AS proved, len(regexp_extract_all(text, '{PATTERN_SQL}')) AS raw FROM documents)
    SELECT doc_id, CASE WHEN raw = 0 THEN 'no hit' WHEN proved <> raw THEN 'not all proved' END AS reason, md5(CASE WHEN proved = raw THEN replace(text, '{FIND}', '{REPLACE}') ELSE text END) AS digest FROM c""",
)
def all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved, raw = T.count_of(F.col("text"), F.lit(FIND)), F.regexp_count("text", F.lit(T.flexible_pattern(FIND)))
    edited = F.replace(F.col("text"), F.lit(FIND), F.lit(REPLACE))
    return docs(spark, sf_dir).select("doc_id", E.all_or_nothing(F.col("text"), edited, proved, raw).alias("o")).select("doc_id", "o.reason", F.md5("o.text").alias("digest"))


@query(
    "skip_log",
    f"""WITH {S.RULES_SQL} SELECT d.doc_id, r.rule_id, CASE WHEN {T.norm_sql("find")} = '' THEN 'blank' WHEN replace = '' THEN 'nothing to put' WHEN contains({T.rule_key_sql("replace")}, {T.rule_key_sql("find")}) THEN 'not verifiable' ELSE 'no hit' END AS reason
    FROM documents d CROSS JOIN rules r WHERE {T.norm_sql("find")} = '' OR replace = '' OR contains({T.rule_key_sql("replace")}, {T.rule_key_sql("find")}) OR NOT contains(d.text, r.find)""",
)
def skip_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every refusal leaves a row with its reason."""
    return E.skip_reasons(docs(spark, sf_dir), S.rules(spark))


SEGMENTS_SQL = "segments AS (SELECT conv_id AS doc_id, turn::INTEGER AS seg_no, text FROM conversations)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seg_no"), "text")


@query("segment_offsets", f"WITH {SEGMENTS_SQL} SELECT doc_id, seg_no, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM segments")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.segment_bases(segments(spark, sf_dir)).select("doc_id", "seg_no", F.col("base").cast("long").alias("base"))


SEG_REPLACE = "<=>"
_CUT = f"floor(({{x}} - m0) * {len(SEG_REPLACE)} / (m1 - m0)::DOUBLE + 0.5)::INTEGER"


@query(
    "segment_replace",
    f"""WITH {SEGMENTS_SQL}, based AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS base FROM segments),
    whole AS (SELECT doc_id, string_agg(text, '' ORDER BY seg_no) AS text FROM segments GROUP BY 1),
    parts AS (SELECT doc_id, unnest(ms) AS match, unnest(gs[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS o FROM (SELECT doc_id, regexp_extract_all(text, '\\.{T.FLEX_SQL}*[A-Z]') AS ms, string_split_regex(text, '\\.{T.FLEX_SQL}*[A-Z]') AS gs FROM whole)),
    hits AS (SELECT doc_id, m1 - length(match) AS m0, m1 FROM (SELECT doc_id, match, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY o) AS m1 FROM parts)),
    touched AS (SELECT b.doc_id, seg_no, text, base, greatest(m0, base) AS a, least(m1, base + length(text)) AS b, m0, m1 FROM based b JOIN hits h ON b.doc_id = h.doc_id AND m0 < base + length(text) AND m1 > base),
    shares AS (SELECT doc_id, seg_no, (a - base)::BIGINT AS a, (b - base)::BIGINT AS b, substring('{SEG_REPLACE}', {_CUT.format(x="a")} + 1, {_CUT.format(x="b")} - {_CUT.format(x="a")}) AS s, text FROM touched),
    spliced AS (SELECT doc_id, seg_no, string_agg(substring(text, pa + 1, a - pa) || s, '' ORDER BY a) || substring(any_value(text), max(b) + 1) AS text
        FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id, seg_no ORDER BY a), 0) AS pa FROM shares) GROUP BY 1, 2)
    SELECT doc_id, seg_no, md5(coalesce(x.text, s.text)) AS digest FROM segments s LEFT JOIN spliced x USING (doc_id, seg_no)""",
)
def segment_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence borders (a full stop, separators, a capital) replaced, also where they span two turns."""
    return E.segment_replace_pattern(segments(spark, sf_dir), rf"\.{T.FLEX}*[A-Z]", SEG_REPLACE).select("doc_id", "seg_no", F.md5("text").alias("digest"))


@query(
    "invariants",
    f"""WITH e AS (SELECT doc_id, text, replace(text, '{FIND}', '{REPLACE}') AS new FROM documents)
    SELECT doc_id, NOT contains(new, '{FIND}') AS old_gone, contains(text, '{FIND}') = contains(new, '{REPLACE}') AS new_present, md5(replace(new, '{REPLACE}', '{FIND}')) = md5(text) AS rest_unchanged FROM e""",
)
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after an edit: old text gone, new text present where the old was, all else unchanged."""
    new = F.replace(F.col("text"), F.lit(FIND), F.lit(REPLACE))
    return docs(spark, sf_dir).select("doc_id", E.kept_invariants(F.col("text"), new, F.lit(FIND), F.lit(REPLACE)).alias("i")).select("doc_id", "i.*")
