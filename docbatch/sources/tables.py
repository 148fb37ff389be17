"""Tables of a dataset folder, and the row sets that the operators take, derived from them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbatch.functions.words import slices, split_words

LINES_PER_PAGE = 20

# The rule set of the fixtures, in order (id, find, replacement).
RULES = [
    (1, "License", "Licence"),
    (2, "the", "THE"),
    (3, "the  ", "x"),
    (4, "THE", "y"),
    (5, "que", "que-que"),
    (6, "  ", "z"),
    (7, "et", ""),
    (8, "Licensed under the", "$1 \\under"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    """The rule set; a handful of rows, so joins may broadcast it."""
    return spark.createDataFrame(RULES, "rule_id int, find string, replace string")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line): every line of every document, numbered from 1; pages have 20 lines."""
    out = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return out.select("doc_id", F.expr(f"cast(1 + i div {LINES_PER_PAGE} as int)").alias("page_no"), (F.col("i") + 1).cast("int").alias("line_no"), "line")


LINES_SQL = f"""lines AS (
    SELECT doc_id, 1 + (i - 1) // {LINES_PER_PAGE} AS page_no, i AS line_no, line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
)"""


def doc_pages(conversations: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): a conversation as a document with a page for each turn."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "text")


PAGES_SQL = "doc_pages AS (SELECT conv_id AS doc_id, turn::INTEGER AS page_no, text FROM conversations)"


def annotations(pages: DataFrame) -> DataFrame:
    """(doc_id, ann_no, subtype, contents): comments, links and script marks of a page as annotations."""
    found = F.expr(r"""regexp_extract_all(html, '(<!--[^>]*-->|<a [^>]*>[^<]*</a>|<script[^>]*>)', 1)""")
    out = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("i", "raw"))
    subtype = F.when(F.col("raw").startswith("<!--"), "Text").when(F.col("raw").startswith("<a "), "FreeText").otherwise("Widget")
    contents = F.regexp_replace("raw", r"<!--|-->|<[^>]*>", "")
    return out.select("doc_id", (F.col("i") + 1).cast("int").alias("ann_no"), subtype.alias("subtype"), contents.alias("contents"))


ANNOTS_SQL = r"""raw_annots AS (
    SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<!--[^>]*-->|<a [^>]*>[^<]*</a>|<script[^>]*>')) AS raw,
           generate_subscripts(regexp_extract_all(html, '<!--[^>]*-->|<a [^>]*>[^<]*</a>|<script[^>]*>'), 1)::INTEGER AS ann_no FROM pages
), annots AS (
    SELECT doc_id, ann_no, CASE WHEN starts_with(raw, '<!--') THEN 'Text' WHEN starts_with(raw, '<a ') THEN 'FreeText' ELSE 'Widget' END AS subtype,
           regexp_replace(raw, '<!--|-->|<[^>]*>', '', 'g') AS contents FROM raw_annots
)"""


_WORDS = "array<struct<word_no: int, word: string, x0: double, y0: double, x1: double, y1: double, conf: int>>"


def line_words(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, w): the words of each line that has any, with their boxes in a grid of characters, as one array."""
    return words_of(lines(docs))


def words_of(lines: DataFrame) -> DataFrame:
    """``line_words`` of (doc_id, line_no, line). Where words start are running sums over many lines at once, without a shuffle."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            line, no, x0, size, words = split_words(batch.column(2))
            doc, row = (batch.column(c).to_numpy().astype(np.int64) for c in (0, 1))
            y0 = 10.0 * row[line]
            x0 = x0.astype(float)
            data = [pa.array(no, pa.int32()), words, pa.array(x0), pa.array(y0), pa.array(x0 + size), pa.array(y0 + 8), pa.array((doc[line] * 31 + row[line] * 7 + no) % 101, pa.int32())]
            held = np.bincount(line, minlength=batch.num_rows)
            some = pa.array(np.flatnonzero(held))
            w = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held[held > 0])], pa.int32()), pa.StructArray.from_arrays(data, names=["word_no", "word", "x0", "y0", "x1", "y1", "conf"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), w], names=["doc_id", "line_no", "w"])

    return lines.filter("line <> ''").select("doc_id", "line_no", "line").mapInArrow(place, f"doc_id long, line_no int, w {_WORDS}")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, word_no, word, x0, y0, x1, y1, conf): words of lines with boxes in a grid of characters."""
    return line_words(docs).select("doc_id", "line_no", F.inline("w"))


TOKENS_SQL = (
    LINES_SQL
    + """, words AS (
    SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1)::INTEGER AS word_no FROM lines
), placed AS (
    SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x0 FROM words
), tokens AS (
    SELECT doc_id, line_no, word_no, word, x0, 10.0::DOUBLE * line_no AS y0, x0 + length(word) AS x1, 10.0::DOUBLE * line_no + 8 AS y1,
           ((doc_id * 31 + line_no * 7 + word_no) % 101)::INTEGER AS conf FROM placed WHERE word <> ''
)"""
)


def strokes(lineitem: DataFrame) -> DataFrame:
    """(page_no, color, width, line_width, stroke, x0, y0, x1, y1): line items as strokes; a supplier is a page.

    Several items may share the number of an order's line, so a stroke's id holds its day and part as well.
    """
    days = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    return lineitem.select(
        F.col("l_suppkey").alias("page_no"),
        F.col("l_returnflag").alias("color"),
        F.col("l_linestatus").alias("width"),
        F.when(F.col("l_linestatus") == "F", 0.1).otherwise(0.0).alias("line_width"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4096 + days % 4096) * 256 + F.col("l_partkey") % 256).alias("stroke"),
        (days / F.lit(20.0)).alias("x0"),
        F.col("l_quantity").alias("y0"),
        (days / F.lit(20.0) + 1 + 20 * F.col("l_tax")).alias("x1"),
        (F.col("l_quantity") + 1 + 20 * F.col("l_discount")).alias("y1"),
    )


STROKES_SQL = """strokes AS (
    SELECT l_suppkey AS page_no, l_returnflag AS color, l_linestatus AS width, CASE WHEN l_linestatus = 'F' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS line_width, ((l_orderkey * 8 + l_linenumber) * 4096 + date_diff('day', DATE '1992-01-01', l_shipdate::DATE) % 4096) * 256 + l_partkey % 256 AS stroke,
           date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 20.0::DOUBLE AS x0, l_quantity AS y0,
           date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 20.0::DOUBLE + 1 + 20 * l_tax AS x1, l_quantity + 1 + 20 * l_discount AS y1
    FROM lineitem
)"""


def cells(lineitem: DataFrame) -> DataFrame:
    """(doc_id, x, y, value): a sparse grid of all its items for each supplier."""
    return cell_places(lineitem).groupBy("doc_id", "x", "y").agg(F.count(F.lit(1)).alias("value"))


def cell_places(lineitem: DataFrame) -> DataFrame:
    """(doc_id, x, y): the places of ``cells``, one for each item."""
    return lineitem.select(F.col("l_suppkey").alias("doc_id"), F.expr("cast(l_partkey % 200 as int)").alias("x"), F.expr("cast(l_quantity as int)").alias("y"))


CELLS_SQL = """cells AS (
    SELECT l_suppkey AS doc_id, (l_partkey % 200)::INTEGER AS x, l_quantity::INTEGER AS y, count(*) AS value
    FROM lineitem GROUP BY 1, 2, 3
)"""


def run_events(events: DataFrame) -> DataFrame:
    """(run_id, event_id, ts, file, stage, ms): the events of a day as a run."""
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), "event_id", "ts", F.col("user_id").alias("file"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))


EVENTS_SQL = "run_events AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_id, ts, user_id AS file, event_type AS stage, value AS ms FROM events)"

RULES_SQL = "rules(rule_id, find, replace) AS (VALUES " + ", ".join(f"({i}, '{f}', '{r}')" for i, f, r in RULES) + ")"
