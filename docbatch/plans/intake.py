"""Queries of intake: file selection, de-duplication, exploding, parsing token rows, gates and routes, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.operators import intake as I
from docbatch.operators import rules as R
from docbatch.plans.catalog import query
from docbatch.sources import tables as S
from docbatch.plans.staging import shared_dir
from docbatch.sources.files import promote, read_committed, sanitised_name, write_bundle, write_committed, write_verified


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents")


@query("scan_filter", "SELECT page_id, url FROM pages WHERE lower(split_part(url, '?', 1)) LIKE '%.pdf' OR lower(url) LIKE 'https://%'")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted by scheme or by extension, in any case."""
    u = F.lower("url")
    return S.table(spark, sf_dir, "pages").filter(F.split_part(u, F.lit("?"), F.lit(1)).endswith(".pdf") | u.startswith("https://")).select("page_id", "url")


@query("dedupe_first", "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, n_chars ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_wins(docs(spark, sf_dir), ["source", "lang", "n_chars"], "doc_id").select("doc_id", "source", "n_chars")


@query("dedupe_last", "SELECT source, lang, max(doc_id) AS doc_id, min(doc_id) AS position, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of a name wins at the place of the first."""
    return I.last_wins(docs(spark, sf_dir), ["source", "lang"], "doc_id", ["n_chars"])


@query("explode_lines", f"WITH {S.LINES_SQL} SELECT doc_id, page_no::INTEGER AS page_no, line_no::INTEGER AS line_no, md5(line) AS digest FROM lines")
def explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines(docs(spark, sf_dir)).select("doc_id", "page_no", "line_no", F.md5("line").alias("digest"))


@query(
    "parse_token_rows",
    f"""WITH {S.TOKENS_SQL} SELECT doc_id, line_no, count(*) AS words, string_agg(word, ' ' ORDER BY word_no) AS line_text, min(x0) AS x0, max(x1) AS x1, min(conf)::INTEGER AS conf
    FROM tokens WHERE trim(word) <> '' GROUP BY 1, 2""",
)
def parse_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised tokens as tab-separated text, parsed back into lines: a header, short rows and blank words are dropped."""
    t = S.tokens(docs(spark, sf_dir))
    row = F.concat_ws("\t", F.lit("5"), "doc_id", F.lit("1"), F.lit("1"), "line_no", "word_no", "x0", "y0", F.col("x1") - F.col("x0"), F.lit(8.0), "conf", "word")
    header = F.concat_ws("\t", F.lit("level"), F.lit("page"), F.lit("block"))
    text = t.select(row.alias("row")).unionByName(t.select("doc_id").distinct().select(header.alias("row")))
    return I.parse_token_rows(text)


@query("sink_names", r"SELECT url, regexp_replace(url, '[/\\]', '_', 'g') AS name, count(*) AS n FROM pages GROUP BY 1, 2")
def sink_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").groupBy("url", sanitised_name(F.col("url")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("write_verify", f"SELECT doc_id, md5(replace(text, 'of the', 'from-that')) AS digest FROM documents WHERE contains(text, 'of the')")
def write_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed documents alone are written, read again, compared with what was meant, and then put in their place."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    changed = d.withColumns({"old": F.col("text"), "text": F.replace("text", F.lit("of the"), F.lit("from-that"))}).filter("text <> old").drop("old")
    path = f"{shared_dir(spark)}/docbatch-promoted-{uuid.uuid4().hex}"
    promote(write_verified(changed, ["doc_id"], "text"), path)
    return spark.read.schema(changed.schema).parquet(path).select("doc_id", F.md5("text").alias("digest"))


@query("bundle", r"SELECT regexp_replace(source || '/' || lang, '[/\\]', '_', 'g') AS name, count(*) AS outputs, sum(length(text))::BIGINT AS chars FROM documents WHERE n_chars > 0 AND lang IS NOT NULL GROUP BY 1")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs without errors as a bundle with a folder for each sanitised name, read again."""
    error = F.when(F.col("lang").isNull() | (F.col("n_chars") <= 0), "no analysis")
    rows = docs(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("name"), "text", error.alias("error"))
    path = f"{shared_dir(spark)}/docbatch-bundle-{uuid.uuid4().hex}"
    write_bundle(rows, path, "name", "text", "error")
    return spark.read.parquet(path).groupBy("name").agg(F.count(F.lit(1)).alias("outputs"), F.sum(F.length("value")).alias("chars"))


@query(
    "doc_kinds",
    f"""WITH {S.ANNOTS_SQL} SELECT p.page_id AS doc_id, regexp_matches(html, '<p[ >]') AS text, count(ann_no) FILTER (subtype = 'FreeText') > 0 AS annotation, contains(html, '<svg') AS vector, contains(html, '<img') AS image
    FROM pages p LEFT JOIN annots a ON a.doc_id = p.page_id GROUP BY p.page_id, html""",
)
def doc_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.kinds(S.table(spark, sf_dir, "pages"))


@query(
    "kind_label",
    """SELECT page_id AS doc_id, coalesce(nullif(concat_ws(' · ', CASE WHEN regexp_matches(html, '<p[ >]') THEN 'text' END, CASE WHEN contains(html, '<svg') THEN 'vector' END, CASE WHEN contains(html, '<img') THEN 'image' END), ''), 'none') AS label FROM pages""",
)
def kind_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.labelled(I.kinds(S.table(spark, sf_dir, "pages")), ["text", "vector", "image"])


WORDS_SQL = "w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(text, '\\s+', '_', 'g'), '.')) AS word FROM documents))"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with underscores for white space, as structured codes."""
    s = F.explode(F.split(F.regexp_replace("text", r"[\t-\r ]+", "_"), r"\."))
    return docs(spark, sf_dir).select(s.alias("word")).distinct()


_PARTS = "list_filter(string_split(word, '_'), lambda x: x <> '')"


@query(
    "code_classify",
    f"""WITH {WORDS_SQL} SELECT md5(word) AS code,
    contains(word, '_') AND length(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) BETWEEN 20 AND 90 AND len({_PARTS}) >= 5 AND len(list_filter({_PARTS}, lambda x: NOT regexp_full_match(x, '[A-Za-z0-9.-]+'))) = 0 AS long_code,
    contains(word, '_') AND len({_PARTS}) >= 2 AND length(word) BETWEEN 6 AND 22 AS short_code,
    length(word) BETWEEN 4 AND 64 AND regexp_full_match(word, '[\\p{{L}}\\p{{N}}_\\s./:-]+') AS target FROM w""",
)
def code_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.classified_codes(codes(spark, sf_dir)).select(F.md5("word").alias("code"), "long_code", "short_code", "target")


@query(
    "target_route",
    f"""WITH {WORDS_SQL}, k AS (SELECT word, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS key, len(list_filter(string_split(word, '_'), lambda x: length(x) >= 2)) AS parts FROM w)
    SELECT md5(word) AS code, CASE WHEN length(key) >= 16 OR parts >= 4 THEN 'hard' WHEN length(key) <= 14 AND parts <= 3 THEN 'simple' ELSE 'plain' END AS route FROM k""",
)
def target_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.routed_targets(codes(spark, sf_dir)).select(F.md5("word").alias("code"), "route")


@query("size_route", "SELECT doc_id, CASE WHEN strlen(text) >= 16384 THEN 'heavy' ELSE 'normal' END AS route, strlen(text) AS size FROM documents")
def size_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by bytes; the limit is lower than in use, as documents here are small."""
    d = docs(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return I.routed_by_size(d, F.col("size"), heavy=16384)


@query(
    "batch_gate",
    f"""WITH {S.RULES_SQL}, r AS (SELECT source, doc_id, CASE WHEN n_chars = 0 THEN 'empty' END AS error, CASE WHEN lang = 'de' AND doc_id % 40 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN doc_id % 60 = 7 THEN 1 ELSE 0 END AS o, contains(text, find) AS hit, rule_id <> 7 OR doc_id % 4 > 0 AS enabled FROM documents, rules WHERE trim(find) <> '')
    SELECT source, bool_and(error IS NULL AND a = 0 AND o = 0 AND (NOT hit OR enabled)) AS selective FROM r GROUP BY 1""",
)
def batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a source that only need selective work: a row for each document, and one for each rule that hits it."""
    rules = S.rules(spark).filter("trim(find) <> ''").select("rule_id", F.col("find").alias("needle"))
    hits = R.needle_counts(docs(spark, sf_dir), ["source", "doc_id", "lang", "n_chars"], "text", rules)
    every = docs(spark, sf_dir).select("source", "doc_id", "lang", "n_chars", F.lit(None).cast(hits.schema["rule_id"].dataType).alias("rule_id"), F.lit(0).cast("long").alias("n"))
    rows = every.unionByName(hits).select(
        "source",
        F.when(F.col("n_chars") == 0, "empty").alias("error"),
        F.when((F.col("lang") == "de") & (F.col("doc_id") % 40 == 0), 1).otherwise(0).alias("annotation_count"),
        F.when(F.col("doc_id") % 60 == 7, 1).otherwise(0).alias("ocr_count"),
        F.col("n").alias("count"),
        ((F.coalesce("rule_id", F.lit(0)) != 7) | (F.col("doc_id") % 4 > 0)).alias("enabled"),
    )
    return I.selective_batches(rows, ["source"])


@query(
    "confidence_gate",
    f"""WITH {S.TOKENS_SQL} SELECT doc_id, CASE WHEN word_no % 7 = 0 THEN 'found before' WHEN conf < CASE WHEN word_no % 2 = 0 AND line_no % 3 = 0 THEN 10 ELSE 20 END THEN 'low confidence' WHEN length(word) % 11 BETWEEN 1 AND 6 THEN 'low similarity' ELSE 'accepted' END AS reason, count(*) AS n FROM tokens GROUP BY 1, 2""",
)
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as matches; the length of a word stands for its similarity."""
    t = S.tokens(docs(spark, sf_dir))
    m = t.withColumns({"text_count": (F.col("word_no") % 7 == 0).cast("int"), "similarity": F.length("word") % 11 / F.lit(10.0), "partial": F.col("word_no") % 2 == 0, "exact": F.col("line_no") % 3 == 0})
    return I.gated_matches(m).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


PAGE_SQL = "b AS (SELECT doc_id, 0.0::DOUBLE AS px0, min(y0) AS py0, least(max(x1), 400.0::DOUBLE) AS px1, max(y1) AS py1 FROM tokens GROUP BY 1)"


def token_pages(t: DataFrame) -> DataFrame:
    """The bounds of each document's page, at most 400 wide."""
    return t.groupBy("doc_id").agg(F.lit(0.0).alias("px0"), F.min("y0").alias("py0"), F.least(F.max("x1"), F.lit(400.0)).alias("px1"), F.max("y1").alias("py1"))


@query(
    "bounds_gate",
    f"""WITH {S.TOKENS_SQL}, {PAGE_SQL} SELECT doc_id, count_if(x0 >= px0 - 2 AND y0 >= py0 - 2 AND x1 <= px1 + 2 AND y1 <= py1 + 2 AND x1 > x0 AND y1 > y0) AS inside, count(*) AS n FROM tokens JOIN b USING (doc_id) GROUP BY 1""",
)
def bounds_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes within the page, with a tolerance of 2 on each side."""
    t = S.tokens(docs(spark, sf_dir))
    return I.within_pages(t, token_pages(t), ["doc_id"]).groupBy("doc_id").agg(F.count_if("inside").alias("inside"), F.count(F.lit(1)).alias("n"))


@query(
    "region_filter",
    f"""WITH {S.TOKENS_SQL}, {PAGE_SQL}, r AS (SELECT doc_id, CASE WHEN x0 >= px1 - (px1 - px0) * 0.45 AND y0 >= py1 - (py1 - py0) * 0.35 THEN 'bottom-right' WHEN x0 >= px1 - (px1 - px0) * 0.45 THEN 'right-strip' END AS region, word FROM tokens JOIN b USING (doc_id))
    SELECT doc_id, region, count(*) AS n FROM r WHERE contains(word, 'the') AND region = (SELECT min(region) FROM r x WHERE x.doc_id = r.doc_id AND contains(x.word, 'the') AND x.region IS NOT NULL) GROUP BY 1, 2""",
)
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the lower right corner of their page, or, where it has none, in the right strip."""
    t = S.tokens(docs(spark, sf_dir))
    found = I.page_regions(t.filter(F.contains("word", F.lit("the"))), token_pages(t), ["doc_id"], 0.45, 0.35)
    return I.first_region(found, ["doc_id"]).groupBy("doc_id", "region").agg(F.count(F.lit(1)).alias("n"))


@query(
    "edge_bands",
    f"""WITH {S.TOKENS_SQL}, {PAGE_SQL} SELECT doc_id, band, count(*) AS n FROM (SELECT doc_id, unnest(list_filter([CASE WHEN y0 < py0 + (py1 - py0) * 0.16 THEN 'top' END, CASE WHEN y1 > py1 - (py1 - py0) * 0.16 THEN 'bottom' END, CASE WHEN x0 < px0 + (px1 - px0) * 0.16 THEN 'left' END, CASE WHEN x1 > px1 - (px1 - px0) * 0.16 THEN 'right' END], lambda v: v IS NOT NULL)) AS band FROM tokens JOIN b USING (doc_id)) GROUP BY 1, 2""",
)
def edge_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the four edge bands of 16 % of their page."""
    lines = S.line_words(docs(spark, sf_dir))
    boxes = lines.select("doc_id", F.array_min("w.y0").alias("y0"), F.array_max("w.x1").alias("x1"), F.array_max("w.y1").alias("y1"))
    return I.edge_band_counts(lines, token_pages(boxes), ["doc_id"])


@query(
    "union_detections",
    f"""SELECT page_no, source, count(*) AS n FROM (SELECT l_suppkey AS page_no, 'tax' AS source FROM lineitem WHERE l_tax > 0.07 UNION ALL SELECT l_suppkey, 'discount' FROM lineitem WHERE l_discount > 0.09) GROUP BY 1, 2""",
)
def union_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = S.table(spark, sf_dir, "lineitem")
    found = [(n, l.filter(c).select(F.col("l_suppkey").alias("page_no"))) for n, c in (("tax", "l_tax > 0.07"), ("discount", "l_discount > 0.09"))]
    return I.united_detections(found).groupBy("page_no", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "routed_union",
    f"""WITH {WORDS_SQL}, c AS (SELECT word, contains(word, '_') AND length(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) BETWEEN 20 AND 90 AND len({_PARTS}) >= 5 AND len(list_filter({_PARTS}, lambda x: NOT regexp_full_match(x, '[A-Za-z0-9.-]+'))) = 0 AS long_code,
        contains(word, '_') AND len({_PARTS}) >= 2 AND length(word) BETWEEN 6 AND 22 AS short_code FROM w)
    SELECT md5(word) AS code, CASE WHEN long_code THEN 'long' WHEN short_code THEN 'short' ELSE 'other' END AS route,
        CASE WHEN long_code THEN {T.confusable_key_sql("word", "oi")} WHEN short_code THEN {T.code_key_sql("word")} ELSE {T.folded_sql("word")} END AS key FROM c""",
)
def routed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long codes, short codes and other targets, by their classes, each with its own key, united again."""
    w = F.col("word")
    routes = [("long", F.col("long_code"), T.confusable_key(w, "oi")), ("short", F.col("short_code"), T.code_key(w)), ("other", F.lit(True), T.folded(w))]
    return I.routed_keys(I.classified_codes(codes(spark, sf_dir)), routes).select(F.md5("word").alias("code"), "route", "key")


@query(
    "color_filter",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS r, l_tax * 10 AS g, (l_quantity % 10) / 10 AS b FROM lineitem)
    SELECT count_if(r - g >= 0.2 AND r - b >= 0.2) AS red, count_if(abs(r - 0.5) <= 0.05 AND abs(g - 0.5) <= 0.05) AS near_half, count_if(greatest(r, g, b) - least(r, g, b) >= 0.08) AS chromatic, count_if(greatest(r, g, b) <= 0.05) AS black FROM c""",
)
def color_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 10).alias("g"), (F.col("l_quantity") % 10 / 10).alias("b"))
    return I.colour_counts(c)


@query("weighted_count", "SELECT l_suppkey AS page_no, sum(CASE WHEN l_returnflag = 'R' THEN greatest(1, l_linenumber - 1) ELSE 1 END)::BIGINT AS weight FROM lineitem GROUP BY 1")
def weighted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items as detections of several parts."""
    l = S.table(spark, sf_dir, "lineitem")
    rows = l.select(F.col("l_suppkey").alias("page_no"), F.when(F.col("l_returnflag") == "R", "multi").otherwise("one").alias("source"), (F.col("l_linenumber") - 1).alias("parts"))
    return I.weighted_counts(rows, ["page_no"])


@query(
    "result_state",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS applied, o_orderkey % 3 = 0 AS pending, o_orderkey % 4 AS preview, o_totalprice < 50000 AS validated, o_custkey % 3 AS total, o_orderpriority LIKE '1%' AS exact FROM orders)
    SELECT o_orderkey, CASE WHEN applied > 0 THEN 'applied' WHEN pending AND preview > 0 THEN 'confirmed' WHEN validated AND total > 0 AND NOT pending THEN 'discarded' WHEN exact THEN 'confirmed' ELSE 'candidate' END AS state FROM r""",
)
def result_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    rows = o.select(
        "o_orderkey",
        (F.col("o_orderstatus") == "P").cast("int").alias("applied"),
        (F.col("o_orderkey") % 3 == 0).alias("pending"),
        (F.col("o_orderkey") % 4).alias("preview_validated"),
        (F.col("o_totalprice") < 50000).alias("validated"),
        (F.col("o_custkey") % 3).alias("total"),
        F.col("o_orderpriority").startswith("1").alias("exact"),
    )
    return I.result_states(rows).select("o_orderkey", "state")


@query(
    "prevalidate",
    """WITH g AS (SELECT l_orderkey, bool_and(l_discount <= 0.08) AS whole FROM lineitem GROUP BY 1)
    SELECT l.l_orderkey, l.l_linenumber, CASE WHEN whole THEN 'page' ELSE 'candidate' END AS proof FROM lineitem l JOIN g USING (l_orderkey) WHERE whole OR l_discount <= 0.05""",
)
def prevalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group that passes as a whole is kept; of others the rows that pass alone."""
    l = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return I.prevalidated(l, ["l_orderkey"], F.col("l_discount") <= 0.08, F.col("l_discount") <= 0.05).select("l_orderkey", "l_linenumber", "proof")


@query("unique_gate", "SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_totalprice > 200000) WHERE n = 1")
def unique_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one candidate, else none."""
    big = S.table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    one = big.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.first("o_orderkey").alias("o_orderkey"))
    return one.filter("n = 1").select("o_custkey", "o_orderkey")


_BOX_SQL = "l_suppkey AS page_no, l_partkey % 100 AS x0, l_quantity AS y0, l_partkey % 100 + 10 AS x1, l_quantity + 5 AS y1"


def item_boxes(l: DataFrame) -> DataFrame:
    x = F.col("l_partkey") % 100
    return l.withColumns({"page_no": F.col("l_suppkey"), "x0": x, "y0": F.col("l_quantity"), "x1": x + 10, "y1": F.col("l_quantity") + 5})


@query(
    "promote_candidate",
    f"""WITH c AS (SELECT l_orderkey, {_BOX_SQL} FROM lineitem WHERE l_linenumber = 1), h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 1), e AS (SELECT l_orderkey, {_BOX_SQL} FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber > 1),
    s AS (SELECT c.l_orderkey, bool_or(e.page_no = c.page_no AND c.x0 <= e.x1 AND c.x1 >= e.x0 AND c.y0 <= e.y1 AND c.y1 >= e.y0) AS meets FROM c JOIN e USING (l_orderkey) GROUP BY 1)
    SELECT c.l_orderkey, CASE WHEN h.l_orderkey IS NOT NULL THEN 'established' WHEN NOT coalesce(meets, true) THEN 'no evidence' ELSE 'promoted' END AS verdict FROM c LEFT JOIN h USING (l_orderkey) LEFT JOIN s USING (l_orderkey)""",
)
def promote_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First items as candidates, returned ones as established, others as evidence of the same order."""
    l = item_boxes(S.table(spark, sf_dir, "lineitem"))
    columns = ["l_orderkey", "page_no", "x0", "y0", "x1", "y1"]
    later = l.filter("l_linenumber > 1")
    out = I.promoted(l.filter("l_linenumber = 1").select(*columns), later.filter("l_returnflag = 'R'"), later.filter("l_returnflag = 'A'").select(*columns), "l_orderkey")
    return out.select("l_orderkey", "verdict")


@query(
    "tolerance_match",
    f"""WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS box_id, l_linenumber % 3 AS paths, l_linestatus, {_BOX_SQL} FROM lineitem), e AS (SELECT * FROM b WHERE l_linestatus = 'O'), c AS (SELECT * FROM b WHERE l_linestatus = 'F')
    SELECT e.page_no, e.box_id, count(c.box_id) AS found, count(c.box_id) = 1 AS accepted FROM e LEFT JOIN c ON c.page_no = e.page_no AND c.paths = e.paths AND abs(c.x0 - e.x0) <= 2 AND abs(c.y0 - e.y0) <= 2 AND abs(c.x1 - e.x1) <= 2 AND abs(c.y1 - e.y1) <= 2 GROUP BY 1, 2""",
)
def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes detected again with as many paths and all sides within 2: exactly one match is accepted."""
    l = item_boxes(S.table(spark, sf_dir, "lineitem")).withColumns({"box_id": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "paths": F.col("l_linenumber") % 3})
    columns = ["page_no", "box_id", "paths", "x0", "y0", "x1", "y1"]
    return I.matched_boxes(l.filter("l_linestatus = 'O'").select(*columns), l.filter("l_linestatus = 'F'").select(*columns), ["page_no"])


@query("committed_write", "SELECT doc_id, md5(text) AS digest FROM documents")
def committed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, read again, proved, and put in place by one rename; a second run replaces the first."""
    path = f"{shared_dir(spark)}/docbatch-committed-{uuid.uuid4().hex}"
    rows = docs(spark, sf_dir).select("doc_id", "text")
    write_committed(rows.limit(10), ["doc_id"], "text", path)
    write_committed(rows, ["doc_id"], "text", path)
    return read_committed(spark, path).select("doc_id", F.md5("text").alias("digest"))
