"""Intake of documents: which entries count, what kind they are, and which route they take."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbatch.functions.rows import held


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. Minima come first, so a frequent key is not gathered in one task."""
    best = rows.groupBy(*keys).agg(F.min(order).alias(order))
    return rows.join(best, [*keys, order], "left_semi")


def last_wins(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last row of each key, with the position of the first."""
    return rows.groupBy(*keys).agg(F.max(order).alias(order), F.min(order).alias("position"), *(F.max_by(v, order).alias(v) for v in values))


def parse_token_rows(text: DataFrame) -> DataFrame:
    """Lines of text from tab-separated token rows: level, page, block, paragraph, line, word, x, y, width, height, confidence, text."""
    f = held(text.filter(F.startswith("row", F.lit("5\t"))), "f", F.split("row", "\t", 12)).select("f").filter(F.size("f") == 12)
    word = F.get("f", F.lit(11))
    t = f.select(F.get("f", F.lit(1)).try_cast("long").alias("doc_id"), F.get("f", F.lit(4)).try_cast("int").alias("line_no"), F.get("f", F.lit(5)).try_cast("int").alias("word_no"), F.get("f", F.lit(6)).try_cast("double").alias("x0"), F.get("f", F.lit(8)).try_cast("double").alias("w"), F.get("f", F.lit(10)).try_cast("int").alias("conf"), word.alias("word"))
    t = t.filter(F.trim("word") != "")
    gathered = _gathered(t.withColumn("x1", F.col("x0") + F.col("w")))
    line = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("some"))), lambda x: x["word"]), " ")
    return gathered.groupBy("doc_id", "line_no").agg(F.sum("words").alias("words"), line.alias("line_text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("conf").alias("conf"))


def _gathered(t: DataFrame) -> DataFrame:
    """(doc_id, line_no, some, words, x0, x1, conf): the words of a line that follow one another in a batch as one row, so that hardly more rows than lines are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, line = (batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in ("doc_id", "line_no"))
            cuts = np.r_[0, np.flatnonzero((doc[1:] != doc[:-1]) | (line[1:] != line[:-1])) + 1]
            ends = np.r_[cuts, batch.num_rows]
            of = pa.table({"i": pa.array(np.repeat(np.arange(len(cuts)), np.diff(ends))), **{c: batch.column(c) for c in ("x0", "x1", "conf")}})
            box = of.group_by("i").aggregate([("x0", "min"), ("x1", "max"), ("conf", "min")]).sort_by("i").combine_chunks()
            words = pa.StructArray.from_arrays([batch.column("word_no"), batch.column("word")], names=["word_no", "word"])
            first = pa.array(cuts)
            some = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(first), batch.column("line_no").take(first), some, pa.array(np.diff(ends), pa.int64()), *(box.column(c).combine_chunks() for c in ("x0_min", "x1_max", "conf_min"))], names=["doc_id", "line_no", "some", "words", "x0", "x1", "conf"])

    return t.select("doc_id", "line_no", "word_no", "x0", "x1", "conf", "word").mapInArrow(run, "doc_id long, line_no int, some array<struct<word_no: int, word: string>>, words long, x0 double, x1 double, conf int")


def kinds(pages: DataFrame) -> DataFrame:
    """(doc_id, text, annotation, vector, image): what a page holds."""
    h = F.col("html")
    return pages.select(F.col("page_id").alias("doc_id"), h.rlike("<p[ >]").alias("text"), h.rlike("<a [^>]*>[^<]*</a>").alias("annotation"), F.contains(h, F.lit("<svg")).alias("vector"), F.contains(h, F.lit("<img")).alias("image"))


def labelled(rows: DataFrame, names: list[str]) -> DataFrame:
    label = F.concat_ws(" · ", *(F.when(F.col(n), n) for n in names))
    return rows.select("doc_id", F.coalesce(F.nullif(label, F.lit("")), F.lit("none")).alias("label"))


def _parts() -> Column:
    return F.filter(F.split("word", "_"), lambda x: x != "")


def classified_codes(words: DataFrame) -> DataFrame:
    """Adds long_code, short_code and target: the classes of structured codes."""
    key = F.length(F.regexp_replace("word", "[^A-Za-z0-9]", ""))
    under = F.contains("word", F.lit("_"))
    return words.withColumns(
        {
            "long_code": under & key.between(20, 90) & (F.size(_parts()) >= 5) & F.forall(_parts(), lambda x: x.rlike("^[A-Za-z0-9.-]+$")),
            "short_code": under & (F.size(_parts()) >= 2) & F.length("word").between(6, 22),
            "target": F.length("word").between(4, 64) & F.col("word").rlike(r"^[\p{L}\p{N}_\s./:-]+$"),
        }
    )


def routed_targets(words: DataFrame) -> DataFrame:
    key = F.length(F.regexp_replace(F.lower("word"), "[^a-z0-9]", ""))
    parts = F.size(F.filter(F.split("word", "_"), lambda x: F.length(x) >= 2))
    return words.withColumn("route", F.when((key >= 16) | (parts >= 4), "hard").when((key <= 14) & (parts <= 3), "simple").otherwise("plain"))


def colour_counts(c: DataFrame) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return c.agg(
        F.count_if((r - g >= 0.2) & (r - b >= 0.2)).alias("red"),
        F.count_if((F.abs(r - 0.5) <= 0.05) & (F.abs(g - 0.5) <= 0.05)).alias("near_half"),
        F.count_if(F.greatest(r, g, b) - F.least(r, g, b) >= 0.08).alias("chromatic"),
        F.count_if(F.greatest(r, g, b) <= 0.05).alias("black"),
    )


def prevalidated(rows: DataFrame, keys: list[str], whole: Column, alone: Column) -> DataFrame:
    groups = rows.groupBy(*keys).agg(F.bool_and(whole).alias("_whole"))
    joined = rows.join(groups, keys)
    return joined.filter(F.col("_whole") | alone).withColumn("proof", F.when(F.col("_whole"), "page").otherwise("candidate")).drop("_whole")


def ranked_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The best row of each key by several criteria."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def gated_matches(matches: DataFrame) -> DataFrame:
    """Adds ``reason``: accepted, or why a recognised match does not count.

    ``matches`` has text_count (hits of earlier stages), conf, similarity (0: unknown), partial and exact. An exact
    part of a longer word needs a confidence of 10, all else 20.
    """
    least = F.when(F.col("partial") & F.col("exact"), 10).otherwise(20)
    reason = F.when(F.col("text_count") > 0, "found before").when(F.col("conf") < least, "low confidence").when((F.col("similarity") > 0) & (F.col("similarity") < 0.70), "low similarity")
    return matches.withColumn("reason", F.coalesce(reason, F.lit("accepted")))


def within_pages(boxes: DataFrame, pages: DataFrame, keys: list[str], slack: float = 2.0) -> DataFrame:
    """Adds ``inside``: boxes of positive size within their page's bounds (px0, py0, px1, py1), but for ``slack`` on each side."""
    ok = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("x0") >= F.col("px0") - slack) & (F.col("y0") >= F.col("py0") - slack) & (F.col("x1") <= F.col("px1") + slack) & (F.col("y1") <= F.col("py1") + slack)
    return boxes.join(pages, keys).withColumn("inside", ok).drop("px0", "py0", "px1", "py1")


#: Bytes from which a document is heavy.
HEAVY = 16 << 20


def routed_by_size(rows: DataFrame, size: Column, heavy: int = HEAVY) -> DataFrame:
    """Adds ``route``: heavy documents are worked apart, each route with a strategy of its own."""
    return rows.withColumn("route", F.when(size >= heavy, "heavy").otherwise("normal"))


def selective_batches(results: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, selective): batches without errors or hits of other kinds, in which every rule with hits is enabled."""
    fine = F.col("error").isNull() & (F.col("annotation_count") == 0) & (F.col("ocr_count") == 0) & ((F.col("count") == 0) | F.col("enabled"))
    return results.groupBy(*keys).agg(F.bool_and(fine).alias("selective"))


def page_regions(boxes: DataFrame, pages: DataFrame, keys: list[str], right: float, bottom: float) -> DataFrame:
    """Adds ``region``: bottom-right, else right-strip, for boxes that begin in these fractions of their page; others are left out."""
    x = F.col("px1") - (F.col("px1") - F.col("px0")) * right
    y = F.col("py1") - (F.col("py1") - F.col("py0")) * bottom
    region = F.when((F.col("x0") >= x) & (F.col("y0") >= y), "bottom-right").when(F.col("x0") >= x, "right-strip")
    return boxes.join(pages, keys).withColumn("region", region).drop("px0", "py0", "px1", "py1").filter("region is not null")


def first_region(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the rows of its first region alone: the strip counts only where the corner gave nothing."""
    return found.join(found.groupBy(*keys).agg(F.min("region").alias("region")), [*keys, "region"], "left_semi")


def edge_bands(boxes: DataFrame, pages: DataFrame, keys: list[str], share: float = 0.16) -> DataFrame:
    """A row for each edge band of the page that a box touches."""
    w, h = F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0")
    bands = F.array_compact(
        F.array(
            F.when(F.col("y0") < F.col("py0") + h * share, "top"),
            F.when(F.col("y1") > F.col("py1") - h * share, "bottom"),
            F.when(F.col("x0") < F.col("px0") + w * share, "left"),
            F.when(F.col("x1") > F.col("px1") - w * share, "right"),
        )
    )
    return boxes.join(pages, keys).withColumn("band", F.explode(bands)).drop("px0", "py0", "px1", "py1")


def edge_band_counts(lines: DataFrame, pages: DataFrame, keys: list[str], share: float = 0.16) -> DataFrame:
    """(*keys, band, n): how many boxes touch each edge band of their page, those that none touches left out.

    ``lines`` has the boxes of a line as an array ``w``, which meets its page and is counted as one row.
    """
    w, h = F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0")
    tests = {
        "top": ("y0", lambda v: v < F.col("py0") + h * share),
        "bottom": ("y1", lambda v: v > F.col("py1") - h * share),
        "left": ("x0", lambda v: v < F.col("px0") + w * share),
        "right": ("x1", lambda v: v > F.col("px1") - w * share),
    }
    rows = lines.select(*keys, *(F.col(f"w.{c}").alias(c) for c, _ in tests.values())).join(pages, keys)
    counts = rows.groupBy(*keys).agg(*(F.sum(F.size(F.filter(c, test))).alias(band) for band, (c, test) in tests.items()))
    return counts.unpivot(keys, list(tests), "band", "n").filter("n > 0")


def result_states(rows: DataFrame) -> DataFrame:
    """Adds ``state`` from applied, pending, preview_validated, validated, total and exact: the first that holds of applied, confirmed, discarded, confirmed, candidate."""
    state = (
        F.when(F.col("applied") > 0, "applied")
        .when(F.col("pending") & (F.col("preview_validated") > 0), "confirmed")
        .when(F.col("validated") & (F.col("total") > 0) & ~F.col("pending"), "discarded")
        .when(F.col("exact"), "confirmed")
        .otherwise("candidate")
    )
    return rows.withColumn("state", state)


def weighted_counts(detections: DataFrame, keys: list[str], multi: str = "multi") -> DataFrame:
    """(*keys, weight): detections, one of several parts (source ``multi``) counting as many times as it has parts, others once."""
    return detections.groupBy(*keys).agg(F.sum(F.when(F.col("source") == multi, F.greatest(F.lit(1), F.coalesce("parts", F.lit(1)))).otherwise(1)).cast("long").alias("weight"))


def promoted(candidates: DataFrame, established: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Adds ``verdict``: a candidate is promoted where its key has nothing established and the evidence, if there is any, has a box on the same page that meets its own.

    ``candidates`` has (key, page_no, x0, y0, x1, y1), one to a key; ``evidence`` the same, any number; ``established`` has the key.
    """
    e = evidence.select(key, F.col("page_no").alias("ep"), *(F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")))
    meets = (F.col("ep") == F.col("page_no")) & (F.col("x0") <= F.col("ex1")) & (F.col("x1") >= F.col("ex0")) & (F.col("y0") <= F.col("ey1")) & (F.col("y1") >= F.col("ey0"))
    # evidence is aggregated before it joins again, so a key with much of it adds one row
    support = candidates.join(e, key).groupBy(key).agg(F.bool_or(meets).alias("_meets"))
    rows = candidates.join(established.select(key).distinct().withColumn("_held", F.lit(True)), key, "left").join(support, key, "left")
    verdict = F.when(F.col("_held"), "established").when(~F.coalesce("_meets", F.lit(True)), "no evidence").otherwise("promoted")
    return rows.withColumn("verdict", verdict).drop("_held", "_meets")


def matched_boxes(expected: DataFrame, candidates: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """(*keys, box_id, found, accepted): expected boxes and how many candidates have the same path count and all four sides within the tolerance; exactly one is accepted.

    Boxes meet on a grid of the tolerance by their first corner.
    """
    c = candidates.select(*keys, "paths", *(F.col(f).alias(f"c{f}") for f in ("x0", "y0", "x1", "y1")), F.floor(F.col("x0") / tolerance).alias("_x"), F.floor(F.col("y0") / tolerance).alias("_y"))
    around = lambda f: F.explode(F.array(*(F.floor(F.col(f) / tolerance) + i for i in (-1, 0, 1))))
    probe = expected.withColumn("_x", around("x0")).withColumn("_y", around("y0"))
    close = (F.abs(F.col("x0") - F.col("cx0")) <= tolerance) & (F.abs(F.col("y0") - F.col("cy0")) <= tolerance) & (F.abs(F.col("x1") - F.col("cx1")) <= tolerance) & (F.abs(F.col("y1") - F.col("cy1")) <= tolerance)
    hits = probe.join(c, [*keys, "paths", "_x", "_y"], "left").groupBy(*keys, "box_id").agg(F.count_if(F.coalesce(close, F.lit(False))).alias("found"))
    return hits.withColumn("accepted", F.col("found") == 1)


def routed_keys(rows: DataFrame, routes: list[tuple[str, Column, Column]]) -> DataFrame:
    """Adds ``route`` and ``key``: the name and the key of the first of (name, condition, key) whose condition a row meets; rows that meet none are left out.

    The rows are read once, and of the keys only that of a row's route is worked out.
    """
    (first, met, key), *others = routes
    route, keyed = F.when(met, F.lit(first)), F.when(met, key)
    for name, condition, key in others:
        route, keyed = route.when(condition, F.lit(name)), keyed.when(condition, key)
    return rows.withColumns({"route": route, "key": keyed}).filter("route is not null")


def united_routes(rows: DataFrame, routes: list[tuple[str, Column, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Rows dealt to the first route whose condition they meet, each route's operator applied to its own rows, and all united with ``route``.

    Operators give the same columns. Routes are disjoint, since a later one takes only what no earlier one took; rows that meet
    no condition, or an unknown one, go nowhere.
    """
    taken, out = F.lit(False), None
    for name, condition, operator in routes:
        met = F.coalesce(condition, F.lit(False))
        part = operator(rows.filter(met & ~taken)).withColumn("route", F.lit(name))
        out = part if out is None else out.unionByName(part)
        taken = taken | met
    return out


def united_detections(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """Detections of several sources in one, each with its ``source``; the same mark of two sources stays two."""
    parts = [rows.withColumn("source", F.lit(name)) for name, rows in found]
    return reduce(DataFrame.unionByName, parts)
