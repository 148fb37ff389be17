"""Queries of the string and box functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbatch.functions import boxes as B
from docbatch.functions import text as T
from docbatch.plans.catalog import query
from docbatch.sources import tables as S

L = f"WITH {S.LINES_SQL}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines(S.table(spark, sf_dir, "documents")).select("doc_id", "line_no", "line")


def _line_query(name: str, column, sql: str) -> None:
    @query(name, f"{L} SELECT doc_id, line_no::INTEGER AS line_no, md5({sql}) AS value FROM lines")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines(spark, sf_dir).select("doc_id", "line_no", F.md5(column(F.col("line"))).alias("value"))


_line_query("fn_norm", T.norm, T.norm_sql("line"))
_line_query("fn_rule_key", T.rule_key, T.rule_key_sql("line"))
_line_query("fn_variant_key", T.variant_key, T.variant_key_sql("line"))
_line_query("fn_flexible_key", T.flexible_key, T.flexible_key_sql("line"))
_line_query("fn_flexible_key_composed", lambda c: T.flexible_key(c, True), T.flexible_key_sql("line", True))
_line_query("fn_composed", T.composed, T.composed_sql("line"))
_line_query("fn_strip_accents", T.strip_accents, "strip_accents(line)")
_line_query("fn_folded", T.folded, T.folded_sql("line"))
_line_query("fn_tightened", T.tightened, T.tightened_sql("line"))
_line_query("fn_confusable_key", lambda c: T.confusable_key(c, "oil"), T.confusable_key_sql("line", "oil"))
for _mode in ("o", "oi", "bar"):
    _line_query(f"fn_confusable_key_{_mode}", lambda c, m=_mode: T.confusable_key(c, m), T.confusable_key_sql("line", _mode))
_line_query("fn_code_key", T.code_key, T.code_key_sql("line"))


@query(
    "fn_similarity",
    f"""{L}, a AS (SELECT doc_id, line_no, regexp_replace(strip_accents(line), '[^ -~]', '', 'g') AS s FROM lines), p AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS t FROM a),
    r AS (SELECT *, {T.similarity_sql("s", "t")} AS similarity FROM p WHERE t IS NOT NULL AND {T.length_ratio_sql("s", "t")} >= 0.84)
    SELECT doc_id, line_no::INTEGER AS line_no, round(CASE WHEN similarity >= 0.84 THEN similarity ELSE 0.0 END, 6) AS similarity, round({T.length_ratio_sql("s", "t")}, 6) AS ratio FROM r""",
)
def fn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of similar length compared by edit distance, which stops where it falls below the threshold."""
    from pyspark.sql import Window

    a = lines(spark, sf_dir).withColumn("s", F.regexp_replace(T.strip_accents(F.col("line")), "[^ -~]", ""))
    p = a.withColumn("t", F.lead("s").over(Window.partitionBy("doc_id").orderBy("line_no"))).filter("t is not null")
    p = p.withColumn("ratio", T.length_ratio(F.col("s"), F.col("t"))).filter("ratio >= 0.84")
    return p.select("doc_id", "line_no", F.round(T.similarity(F.col("s"), F.col("t"), 0.84), 6).alias("similarity"), F.round("ratio", 6).alias("ratio"))


@query("fn_exact_code", f"{L} SELECT doc_id, line_no::INTEGER AS line_no, instr(line, 'the') AS first_any, length(regexp_extract(line, '^(.*?)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])', 1)) AS before FROM lines WHERE regexp_matches(line, '(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])')")
def fn_exact_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code with borders on both sides: its neighbours are no letters or digits."""
    border = r"(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])"
    return lines(spark, sf_dir).filter(F.col("line").rlike(border)).select("doc_id", "line_no", F.instr("line", "the").alias("first_any"), F.length(F.regexp_extract("line", "^(.*?)" + border, 1)).alias("before"))


@query("fn_abbreviation", f"{L} SELECT doc_id, line_no::INTEGER AS line_no, NOT regexp_matches(line, '^[A-Za-z]\\.') OR starts_with({T.confusable_key_sql('line')}, lower(line[1])) AS kept FROM lines")
def fn_abbreviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as targets against their own keys, in which an o is folded away."""
    return lines(spark, sf_dir).select("doc_id", "line_no", T.abbreviation_kept(F.col("line"), T.confusable_key(F.col("line"))).alias("kept"))


@query("fn_sub_box", "SELECT doc_id, round(100.0 * instr(text, ' ') / greatest(n_chars, 1), 6) AS x0, round(100.0 * (instr(text, ' ') + 5) / greatest(n_chars, 1), 6) AS x1 FROM documents")
def fn_sub_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a box that a run of characters takes."""
    at = F.instr("text", " ")
    x0, x1 = B.sub_box(F.lit(0.0), F.lit(100.0), at, at + 5, F.col("n_chars"))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.round(x0, 6).alias("x0"), F.round(x1, 6).alias("x1"))


@query(
    "fn_boxes",
    f"""WITH {S.STROKES_SQL}, p AS (SELECT *, x0 + 1 AS u0, y0 + 1 AS v0, x1 + 2 AS u1, y1 + 2 AS v1 FROM strokes), c AS (SELECT *, greatest(least(x1, u1) - greatest(x0, u0), 0) * greatest(least(y1, v1) - greatest(y0, v0), 0) AS cut, greatest((x1 - x0) * (y1 - y0), 1) AS a, greatest((u1 - u0) * (v1 - v0), 1) AS b FROM p)
    SELECT stroke, round(cut, 6) AS cut, round(cut / (a + b - cut), 6) AS iou, round(cut / a, 6) AS share, u0 <= x0 + 2 AND v0 <= y0 + 2 AND u1 >= x1 - 2 AND v1 >= y1 - 2 AS contained FROM c""",
)
def fn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, overlap and containment of each mark with a shifted copy."""
    s = S.strokes(S.table(spark, sf_dir, "lineitem"))
    a = B.Box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    b = B.Box(F.col("x0") + 1, F.col("y0") + 1, F.col("x1") + 2, F.col("y1") + 2)
    return s.select("stroke", F.round(a.cut(b), 6).alias("cut"), F.round(a.iou(b), 6).alias("iou"), F.round(a.cut(b) / a.area(1.0), 6).alias("share"), b.contains(a, pad=2.0).alias("contained"))


@query("fn_transform", f"WITH {S.STROKES_SQL} SELECT stroke, round(least(600 - y0, 600 - y1), 6) AS x0, round(least(x0, x1), 6) AS y0, round(greatest(600 - y0, 600 - y1), 6) AS x1, round(greatest(x0, x1), 6) AS y1 FROM strokes")
def fn_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes turned by a quarter on a page 600 high: an affine transform, then ordered corners."""
    box = B.Box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).transformed((0.0, 1.0, -1.0, 0.0, 600.0, 0.0))
    return S.strokes(S.table(spark, sf_dir, "lineitem")).select("stroke", *(F.round(c, 6).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), box, strict=True)))


@query("fn_unrotate", f"WITH {S.STROKES_SQL} SELECT stroke, round((600 - y1 + 5) / 2, 6) AS x0, round((x0 + 7) / 2, 6) AS y0, round((600 - y0 + 5) / 2, 6) AS x1, round((x1 + 7) / 2, 6) AS y1, round((y0 + 5) / 2, 6) AS u0, round((400 - x1 + 7) / 2, 6) AS v0, round((y1 + 5) / 2, 6) AS u1, round((400 - x0 + 7) / 2, 6) AS v1 FROM strokes")
def fn_unrotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes found in a band that was turned by a quarter, either way, and enlarged twice, in the coordinates of the page."""
    box = B.Box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    a, b = (box.unrotated(angle, (600.0, 400.0), (5.0, 7.0), 2.0) for angle in (90, 270))
    return S.strokes(S.table(spark, sf_dir, "lineitem")).select("stroke", *(F.round(c, 6).alias(n) for n, c in zip(("x0", "y0", "x1", "y1", "u0", "v0", "u1", "v1"), (*a, *b), strict=True)))


_TOOK_SQL = "CASE WHEN n_chars >= 10000 THEN floor(n_chars / 100.0 + 0.5)::BIGINT // 10 || '.' || floor(n_chars / 100.0 + 0.5)::BIGINT % 10 || ' s' WHEN n_chars >= 1000 THEN floor(n_chars / 10.0 + 0.5)::BIGINT // 100 || '.' || lpad((floor(n_chars / 10.0 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') || ' s' ELSE n_chars || ' ms' END"


@query("fn_format", f"SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN floor(n_chars / 102.4 + 0.5)::BIGINT // 10 || '.' || floor(n_chars / 102.4 + 0.5)::BIGINT % 10 || ' KB' ELSE floor(n_chars / 1048576 + 0.5)::BIGINT || ' MB' END AS size, {_TOOK_SQL} AS took FROM documents")
def fn_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and times for people, rounded half up."""
    n = F.col("n_chars")
    tenths = T.rounded_half_up(n / 102.4).cast("long")
    kb = F.concat(F.expr("cast(floor(n_chars / 102.4D + 0.5D) as bigint) div 10"), F.lit("."), tenths % 10, F.lit(" KB"))
    mb = F.concat(T.rounded_half_up(n / 1048576).cast("long"), F.lit(" MB"))
    size = F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)
    return S.table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), T.duration(n).alias("took"))


@query("fn_status", "WITH s AS (SELECT event_id, 'Working ' || event_id % 100 || '/' || 100 || ': file' || user_id AS status FROM events) SELECT event_id, regexp_extract(status, '([0-9]+)/([0-9]+): (.*)', 1)::INTEGER AS idx, regexp_extract(status, '([0-9]+)/([0-9]+): (.*)', 2)::INTEGER AS total, regexp_extract(status, '([0-9]+)/([0-9]+): (.*)', 3) AS file FROM s")
def fn_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status line parsed into index, total and file."""
    s = F.concat(F.lit("Working "), F.col("event_id") % 100, F.lit("/100: file"), F.col("user_id"))
    part = lambda i: F.regexp_extract(s, r"([0-9]+)/([0-9]+): (.*)", i)
    return S.table(spark, sf_dir, "events").select("event_id", part(1).cast("int").alias("idx"), part(2).cast("int").alias("total"), part(3).alias("file"))
