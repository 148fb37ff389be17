"""Queries of geometry, graphs and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbatch.operators import geometry as G
from docbatch.operators.numbering import exact_quantiles
from docbatch.plans.catalog import query
from docbatch.sources import tables as S

ST = f"WITH {S.STROKES_SQL}"
PAGE = (1000.0, 600.0)


def limit() -> Column:
    """The greatest gap within a family follows its line width."""
    return G.gap_limit(F.col("line_width"))


DX, DY = ("greatest(a.{0}0 - b.{0}1, b.{0}0 - a.{0}1, 0)".format(c) for c in "xy")
LIMIT_SQL = "greatest(8, least(22, a.line_width * 30 + 8))"


def pairs_sql(limit: str = LIMIT_SQL) -> str:
    return f"pairs AS (SELECT a.page_no, a.color, a.width, a.stroke AS a, b.stroke AS b FROM strokes a JOIN strokes b ON a.page_no = b.page_no AND a.color = b.color AND a.width = b.width AND a.stroke < b.stroke AND {DX} * {DX} + {DY} * {DY} <= pow({limit}, 2))"


def parts_sql(limit: str = LIMIT_SQL) -> str:
    """Pairs, the label of each stroke by rounds over the labels that changed, and the parts with their boxes."""
    return f"""{pairs_sql(limit)}, edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    labels(stroke, component) USING KEY (stroke) AS (SELECT stroke, stroke FROM strokes UNION SELECT e.b, min(w.component) FROM labels w JOIN edges e ON e.a = w.stroke JOIN recurring.labels r ON r.stroke = e.b WHERE w.component < r.component GROUP BY e.b),
    marked AS (SELECT s.*, component FROM strokes s JOIN labels USING (stroke)),
    parts AS (SELECT page_no, color, width, component, count(*) AS m, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM marked GROUP BY 1, 2, 3, 4)"""


RST = f"WITH RECURSIVE {S.STROKES_SQL}"


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strokes(S.table(spark, sf_dir, "lineitem"))


@query("families", f"{ST} SELECT page_no, color, width, count(*) AS n, round(max(x1) - min(x0), 6) AS w, round(max(y1) - min(y0), 6) AS h FROM strokes GROUP BY 1, 2, 3")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = G.union_boxes(strokes(spark, sf_dir), G.FAMILY)
    return u.select(*G.FAMILY, "n", F.round(F.col("x1") - F.col("x0"), 6).alias("w"), F.round(F.col("y1") - F.col("y0"), 6).alias("h"))


@query("union_box", f"{ST} SELECT page_no, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, count(*) AS n FROM strokes GROUP BY 1")
def union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.union_boxes(strokes(spark, sf_dir), ["page_no"]).select("page_no", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "n")


@query("gap_pairs", f"{ST}, {pairs_sql()} SELECT * FROM pairs")
def gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gap_pairs(strokes(spark, sf_dir), G.FAMILY, limit())


@query("components", f"{RST}, {parts_sql()} SELECT stroke, component FROM marked")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(strokes(spark, sf_dir), G.FAMILY, limit()).select("stroke", "component")


@query(
    "family_eval",
    f"""{RST}, {parts_sql()}, ranked AS (SELECT *, sum(m) OVER f AS n, row_number() OVER (f ORDER BY m DESC, component) AS r FROM parts WINDOW f AS (PARTITION BY page_no, color, width)),
    fam AS (SELECT page_no, color, width, component, n::BIGINT AS n, m AS main, x0, y0, x1, y1, greatest(x1 - x0, 1) AS w, greatest(y1 - y0, 1) AS h, (x1 - x0) * (y1 - y0) AS box FROM ranked WHERE r = 1),
    early AS (SELECT *, CASE WHEN n < 20 THEN 'few' WHEN n > 1200 THEN 'many' WHEN main < 20 THEN 'main' WHEN main::DOUBLE / n < 0.90 THEN 'dispersed' WHEN w < 40 OR h < 40 THEN 'small' WHEN box / 600000 < 0.00015 THEN 'tiny' WHEN box / 600000 > 0.08 THEN 'huge' END AS reason FROM fam),
    own AS (SELECT m.* FROM marked m JOIN early e USING (page_no, color, width, component) WHERE reason IS NULL), xs AS (SELECT DISTINCT page_no, color, width, unnest([x0, x1]) AS x FROM own),
    slabs AS (SELECT *, lead(x) OVER (PARTITION BY page_no, color, width ORDER BY x) AS nx FROM xs),
    inside AS (SELECT s.*, y0, y1, max(y1) OVER (PARTITION BY s.page_no, s.color, s.width, s.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM slabs s JOIN own t ON s.page_no = t.page_no AND s.color = t.color AND s.width = t.width AND t.x0 <= s.x AND t.x1 >= s.nx),
    inked AS (SELECT page_no, color, width, sum(greatest(y1 - greatest(y0, coalesce(reached, y0)), 0) * (nx - x)) AS ink FROM inside GROUP BY 1, 2, 3)
    SELECT page_no, color, width, n, main, coalesce(reason, CASE WHEN ink / greatest(box, 1) > 0.25 THEN 'dense' WHEN least(w, h) / greatest(w, h) < 0.10 THEN 'aspect' WHEN n - main > greatest(2, floor(n * 0.05)) THEN 'outside' ELSE 'accepted' END) AS reason
    FROM early LEFT JOIN inked USING (page_no, color, width)""",
)
def family_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evaluate_families(strokes(spark, sf_dir), G.FAMILY, *PAGE)


@query(
    "pending_eval",
    f"""{RST}, {parts_sql("18.5")} SELECT page_no, color, width, count(*) AS parts, sum(m)::BIGINT AS members,
        sum(m) BETWEEN 40 AND 400 AND count(*) BETWEEN 2 AND 8 AND bool_and(m >= 20 AND x1 - x0 >= 30 AND y1 - y0 >= 30 AND least(x1 - x0, y1 - y0) / greatest(x1 - x0, y1 - y0) >= 0.10) AND sum((x1 - x0) * (y1 - y0)) / 600000 <= 0.015 AS pending
    FROM parts GROUP BY 1, 2, 3""",
)
def pending_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evaluate_pending(strokes(spark, sf_dir), G.FAMILY, PAGE[0] * PAGE[1])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each page: that of its strokes with little height."""
    return G.union_boxes(strokes(spark, sf_dir).filter("y1 - y0 <= 1.5"), ["page_no"])


EVIDENCE_SQL = "evidence AS (SELECT page_no, min(x0) AS ex0, min(y0) AS ey0, max(x1) AS ex1, max(y1) AS ey1 FROM strokes WHERE y1 - y0 <= 1.5 GROUP BY 1)"


@query(
    "multi_refine",
    f"""{RST}, {parts_sql()}, {EVIDENCE_SQL}, big AS (SELECT page_no, color, width, ex0, ey0, ex1, ey1, count_if(m >= 20) AS parts, sum(m) AS n, sum(m) FILTER (m >= 20) AS held, bool_and(m < 20 OR (x0 <= ex1 AND x1 >= ex0 AND y0 <= ey1 AND y1 >= ey0)) AS near,
        min(x0) FILTER (m >= 20) AS x0, min(y0) FILTER (m >= 20) AS y0, max(x1) FILTER (m >= 20) AS x1, max(y1) FILTER (m >= 20) AS y1, any_value(greatest(ex1 - ex0, ey1 - ey0) * 0.12 + 8) AS pad
        FROM parts JOIN evidence USING (page_no) GROUP BY 1, 2, 3, 4, 5, 6, 7),
    ok AS (SELECT *, coalesce(held, 0)::DOUBLE / n AS covered, n BETWEEN 40 AND 5000 AND parts BETWEEN 2 AND 12 AND coalesce(held, 0)::DOUBLE / n >= 0.95 AND near AND coalesce((x0 >= ex0 - pad AND y0 >= ey0 - pad AND x1 <= ex1 + pad AND y1 <= ey1 + pad) OR (ex0 >= x0 - pad AND ey0 >= y0 - pad AND ex1 <= x1 + pad AND ey1 <= y1 + pad), FALSE) AS accepted FROM big)
    SELECT page_no, color, width, parts, round(covered, 6) AS covered, accepted, accepted AND count_if(accepted) OVER (PARTITION BY page_no) = 1 AS only FROM ok""",
)
def multi_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several parts accepted together, where the page's evidence supports all of them."""
    return G.refine_parts(strokes(spark, sf_dir), "page_no", G.FAMILY, evidence(spark, sf_dir)).withColumn("covered", F.round("covered", 6))


@query(
    "interval_union",
    f"""{ST}, r AS (SELECT *, max(y1) OVER (PARTITION BY page_no, color, width ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM strokes)
    SELECT page_no, color, width, round(sum(greatest(y1 - greatest(y0, coalesce(reached, y0)), 0)), 6) AS covered FROM r GROUP BY 1, 2, 3""",
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.interval_union(strokes(spark, sf_dir), G.FAMILY, "y0", "y1").withColumn("covered", F.round("covered", 6))


@query(
    "rect_union_area",
    f"""{ST}, xs AS (SELECT DISTINCT page_no, color, width, unnest([x0, x1]) AS x FROM strokes), slabs AS (SELECT *, lead(x) OVER (PARTITION BY page_no, color, width ORDER BY x) AS nx FROM xs),
    inside AS (SELECT s.*, y0, y1, max(y1) OVER (PARTITION BY s.page_no, s.color, s.width, s.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM slabs s JOIN strokes t ON s.page_no = t.page_no AND s.color = t.color AND s.width = t.width AND t.x0 <= s.x AND t.x1 >= s.nx)
    SELECT page_no, color, width, round(sum(greatest(y1 - greatest(y0, coalesce(reached, y0)), 0) * (nx - x)), 4) AS area FROM inside GROUP BY 1, 2, 3""",
)
def rect_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rect_union_area(strokes(spark, sf_dir), G.FAMILY).withColumn("area", F.round("area", 4))


@query("quantiles", f"{ST} SELECT page_no, round(median(y0), 6) AS middle, round(quantile_cont(x1 - x0, 0.25), 6) AS q1, round(quantile_cont(x1 - x0, 0.9), 6) AS q9 FROM strokes GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, interpolated quantiles."""
    rows, w = strokes(spark, sf_dir), F.col("x1") - F.col("x0")
    out = exact_quantiles(rows, ["page_no"], F.col("y0"), middle=0.5).join(exact_quantiles(rows, ["page_no"], w, q1=0.25, q9=0.9), "page_no")
    return out.withColumns({c: F.round(c, 6) for c in ("middle", "q1", "q9")})


@query("quantiles_of_all", f"{ST} SELECT round(quantile_cont(x1 - x0, 0.5), 6) AS middle, round(quantile_cont(x1 - x0, 0.05), 6) AS low, round(quantile_cont(x1 - x0, 0.99), 6) AS high FROM strokes")
def quantiles_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for all rows as one group, which no task holds."""
    out = exact_quantiles(strokes(spark, sf_dir), [], F.col("x1") - F.col("x0"), middle=0.5, low=0.05, high=0.99)
    return out.select(*(F.round(c, 6).alias(c) for c in ("middle", "low", "high")))


@query("share_gate", f"{ST} SELECT page_no, round(avg((x1 - x0 <= 2)::INTEGER), 6) AS share, avg((x1 - x0 <= 2)::INTEGER) >= 0.6 AS accepted, max(y0) - min(y0) <= 1e-9 AS one_row, count(DISTINCT color) = 1 AS one_colour FROM strokes GROUP BY 1")
def share_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of members that pass a test, and values that must be the only ones."""
    share = F.avg((F.col("x1") - F.col("x0") <= 2).cast("double"))
    return strokes(spark, sf_dir).groupBy("page_no").agg(F.round(share, 6).alias("share"), (share >= 0.6).alias("accepted"), (F.max("y0") - F.min("y0") <= 1e-9).alias("one_row"), (F.countDistinct("color") == 1).alias("one_colour"))


@query(
    "coverage_eval",
    f"""{ST}, {EVIDENCE_SQL}, j AS (SELECT *, x0 <= ex1 AND x1 >= ex0 AND y0 <= ey1 AND y1 >= ey0 AS i FROM strokes JOIN evidence USING (page_no)),
    g AS (SELECT page_no, ex0, ey0, ex1, ey1, count_if(i) AS inside, count_if(NOT i) AS outside, min(x0) FILTER (i) AS x0, min(y0) FILTER (i) AS y0, max(x1) FILTER (i) AS x1, max(y1) FILTER (i) AS y1, max(line_width) FILTER (i) AS thick, min(line_width) FILTER (i) AS thin FROM j GROUP BY 1, 2, 3, 4, 5),
    c AS (SELECT *, greatest(least(x1, ex1) - greatest(x0, ex0), 0) / greatest(ex1 - ex0, 1) AS cx, greatest(least(y1, ey1) - greatest(y0, ey0), 0) / greatest(ey1 - ey0, 1) AS cy, greatest(ex1 - ex0, ey1 - ey0, 1) * 0.08 + 3 AS pad FROM g)
    SELECT page_no, inside, outside, round(cx, 6) AS coverage_x, round(cy, 6) AS coverage_y,
        inside >= 20 AND outside = 0 AND x0 >= ex0 - pad AND y0 >= ey0 - pad AND x1 <= ex1 + pad AND y1 <= ey1 + pad AND cx >= 0.55 AND cy >= 0.55 AND thick - thin <= greatest(0.5, thick * 0.35) AS accepted FROM c""",
)
def coverage_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks inside and outside an evidence box, and how much of it they span."""
    out = G.evaluate_coverage(strokes(spark, sf_dir), "page_no", evidence(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("coverage_x", "coverage_y")})


#: Coordinates turned by a quarter and halved; the page and the evidence that they are held against.
FRAME = ((0.0, 0.5, 0.5, 0.0, 0.0, 0.0), 60.0, 45.0, (5.0, 5.0, 20.0, 20.0))


@query(
    "frame_choice",
    f"""{ST}, t AS (SELECT page_no, color, x0, y0, x1, y1, y0 * 0.5 AS tx0, x0 * 0.5 AS ty0, y1 * 0.5 AS tx1, x1 * 0.5 AS ty1 FROM strokes),
    g AS (SELECT page_no, color, sum(greatest(least(x1, 60) - greatest(x0, 0), 0) * greatest(least(y1, 45) - greatest(y0, 0), 0)) / sum((x1 - x0) * (y1 - y0)) AS raw, sum(greatest(least(tx1, 60) - greatest(tx0, 0), 0) * greatest(least(ty1, 45) - greatest(ty0, 0), 0)) / sum((tx1 - tx0) * (ty1 - ty0)) AS changed,
        bool_or(x0 <= 20 AND x1 >= 5 AND y0 <= 20 AND y1 >= 5) AS rh, bool_or(tx0 <= 20 AND tx1 >= 5 AND ty0 <= 20 AND ty1 >= 5) AS th FROM t GROUP BY 1, 2)
    SELECT page_no, color, round(raw, 6) AS raw, round(changed, 6) AS changed, CASE WHEN changed > raw + 0.25 OR (NOT rh AND th AND changed >= 0.98 AND raw < 0.98) THEN 'transformed' ELSE 'raw' END AS frame FROM g""",
)
def frame_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordinate frame in which more marks are visible; the raw one unless the other is clearly better."""
    return G.choose_frame(strokes(spark, sf_dir), ["page_no", "color"], *FRAME).withColumns({c: F.round(c, 6) for c in ("raw", "changed")})


@query(
    "scallop_eval",
    f"""{ST}, c AS (SELECT *, 0.665::DOUBLE + (stroke % 7) * 0.03::DOUBLE AS ratio FROM strokes), g AS (SELECT page_no, color, count(*) AS n, median(ratio) AS middle, avg((ratio BETWEEN 0.68 AND 0.84)::INTEGER) AS share, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h,
        max(x1 - x0) AS mw, max(y1 - y0) AS mh, median(x1 - x0) AS qw, median(y1 - y0) AS qh FROM c GROUP BY 1, 2)
    SELECT page_no, color, round(middle, 6) AS middle, round(share, 6) AS share, n >= 6 AND w >= 20 AND h >= 15 AND w / h BETWEEN 0.3 AND 3.5 AND middle BETWEEN 0.70 AND 0.82 AND share >= 0.85 AND greatest(mw / w, mh / h) <= 0.55 AND w / greatest(qw, 1e-9) >= 3 AND h / greatest(qh, 1e-9) >= 3 AS accepted FROM g""",
)
def scallop_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = strokes(spark, sf_dir).withColumn("ratio", F.lit(0.665) + (F.col("stroke") % 7) * 0.03)
    return G.evaluate_scallops(rows, ["page_no", "color"]).withColumns({c: F.round(c, 6) for c in ("middle", "share")})


@query("top_families", f"{ST}, f AS (SELECT page_no, color, width, count(*) AS n FROM strokes GROUP BY 1, 2, 3) SELECT page_no, color, width, place FROM (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY n DESC, color, width)::INTEGER AS place FROM f) WHERE place <= 3")
def top_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("page_no").orderBy(F.desc("n"), "color", "width")
    return G.union_boxes(strokes(spark, sf_dir), G.FAMILY).withColumn("place", F.row_number().over(order)).filter("place <= 3").select(*G.FAMILY, "place")


# --- paths: the items of a customer go round a square; every third square is cut open -------------
_AT = "(({i}) * 4.0::DOUBLE / n)"
_SIDE = "CASE floor({t}) WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {d} END"


def _corner(i: str, axis: str) -> str:
    t = _AT.format(i=i)
    there, back = f"200 * ({t} - floor({t}))", f"200 - 200 * ({t} - floor({t}))"
    return f"round({_SIDE.format(t=t, a=there, b='200.0::DOUBLE', c=back, d='0.0::DOUBLE') if axis == 'x' else _SIDE.format(t=t, a='0.0::DOUBLE', b=there, c='200.0::DOUBLE', d=back)}, 4)"


PATHS_SQL = f"""items AS (SELECT o_custkey AS ring, l_orderkey * 8 + l_linenumber AS path, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber)),
paths AS (SELECT ring, path, {_corner("i", "x")} AS sx, {_corner("i", "y")} AS sy, {_corner("(i + 1) % n", "x")} AS ex, {_corner("(i + 1) % n", "y")} AS ey, CASE WHEN ring % 2 = 1 THEN 2 ELSE 0 END AS curves, CASE WHEN ring % 2 = 0 THEN 4 ELSE 0 END AS lines, CASE WHEN ring % 5 = 0 THEN 0.5 + i % 2 ELSE 0.5 END::DOUBLE AS line_width FROM items WHERE NOT (ring % 3 = 0 AND i = 0)),
ends AS (SELECT ring, path, sx AS x, sy AS y FROM paths UNION ALL SELECT ring, path, ex, ey FROM paths),
pairs AS (SELECT DISTINCT a.ring, a.path AS a, b.path AS b FROM ends a JOIN ends b ON a.ring = b.ring AND a.path < b.path AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4)"""
CHAINS_SQL = """edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), walk AS (SELECT path AS node, path AS label FROM paths UNION SELECT e.b, w.label FROM walk w JOIN edges e ON e.a = w.node WHERE w.label < e.b),
labels AS (SELECT node AS path, min(label) AS component FROM walk GROUP BY 1), degrees AS (SELECT a AS path, count(*) AS degree FROM edges GROUP BY 1),
marked AS (SELECT p.*, component, coalesce(degree, 0) AS degree, least(sx, ex) AS x0, greatest(sx, ex) AS x1, least(sy, ey) AS y0, greatest(sy, ey) AS y1 FROM paths p JOIN labels USING (path) LEFT JOIN degrees USING (path)),
chains AS (SELECT ring, component, count(*) AS members, min(degree) = 2 AND max(degree) = 2 AS closed, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h, max(greatest(x1 - x0, y1 - y0)) AS member, sum(curves) AS curves, sum(lines) AS lines, max(line_width) - min(line_width) AS spread FROM marked GROUP BY 1, 2)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("ring"))
    own = Window.partitionBy("ring")  # a customer's items are few
    rows = l.join(o, "l_orderkey").select("ring", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("path"), (F.row_number().over(own.orderBy("l_orderkey", "l_linenumber")) - 1).alias("i"), F.count(F.lit(1)).over(own).alias("n"))

    def corner(i: F.Column) -> tuple[F.Column, F.Column]:
        t = i * 4.0 / F.col("n")
        side, there = F.floor(t), 200 * (t - F.floor(t))
        x = F.when(side == 0, there).when(side == 1, 200.0).when(side == 2, 200 - there).otherwise(0.0)
        y = F.when(side == 0, 0.0).when(side == 1, there).when(side == 2, 200.0).otherwise(200 - there)
        return F.round(x, 4), F.round(y, 4)

    (sx, sy), (ex, ey) = corner(F.col("i")), corner((F.col("i") + 1) % F.col("n"))
    odd, width = F.col("ring") % 2 == 1, F.when(F.col("ring") % 5 == 0, F.col("i") % 2 + 0.5).otherwise(0.5)
    rows = rows.select("ring", "path", "i", sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"), F.when(odd, 2).otherwise(0).alias("curves"), F.when(odd, 0).otherwise(4).alias("lines"), width.alias("line_width"))
    return rows.filter(~((F.col("ring") % 3 == 0) & (F.col("i") == 0))).drop("i")


@query("endpoint_pairs", f"WITH {PATHS_SQL} SELECT * FROM pairs")
def endpoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.endpoint_pairs(paths(spark, sf_dir), ["ring"], 2.0)


@query("endpoint_components", f"WITH RECURSIVE {PATHS_SQL}, {CHAINS_SQL} SELECT ring, path, component, degree FROM marked")
def endpoint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chains(paths(spark, sf_dir), ["ring"], 2.0).select("ring", "path", "component", "degree")


@query(
    "chain_eval",
    f"WITH RECURSIVE {PATHS_SQL}, {CHAINS_SQL} SELECT ring, component, members, closed, closed AND members BETWEEN 12 AND 80 AND least(w, h) >= 55 AND greatest(w, h) <= 280 AND member <= 55 AND curves >= members * 1.5 AND lines <= members * 0.35 AND spread <= 1e-4 AS accepted FROM chains",
)
def chain_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of touching paths: closed if every member touches exactly two others, and accepted by size, curves, lines and width."""
    return G.evaluate_chains(paths(spark, sf_dir), ["ring"], 2.0, *PAGE)


@query(
    "cycle_proof",
    f"""WITH RECURSIVE {PATHS_SQL}, {CHAINS_SQL}, nodes AS (SELECT ring, round(x / 2) AS nx, round(y / 2) AS ny, count(*) AS d FROM ends GROUP BY 1, 2, 3), nd AS (SELECT ring, count(*) AS nodes, min(d) AS low, max(d) AS high FROM nodes GROUP BY 1),
    box AS (SELECT ring, count(*) AS paths, count(DISTINCT component) AS parts, bool_or(round(sx / 2) = round(ex / 2) AND round(sy / 2) = round(ey / 2)) AS loop, min(x0) AS a0, max(x1) AS a1, min(y0) AS b0, max(y1) AS b1, avg((lines >= 4)::INTEGER) AS detailed, median(lines) AS middle, max(greatest(x1 - x0, y1 - y0)) AS span FROM marked GROUP BY 1),
    border AS (SELECT ring, avg((least(((x0 + x1) / 2 - a0) / (a1 - a0), (a1 - (x0 + x1) / 2) / (a1 - a0), ((y0 + y1) / 2 - b0) / (b1 - b0), (b1 - (y0 + y1) / 2) / (b1 - b0)) <= 0.10)::INTEGER) AS border FROM marked JOIN box USING (ring) WHERE a1 > a0 AND b1 > b0 GROUP BY 1)
    SELECT ring, paths, nodes, CASE WHEN paths NOT BETWEEN 20 AND 5000 THEN 'count' WHEN detailed < 0.85 OR middle < 4 THEN 'detail' WHEN least(a1 - a0, b1 - b0) <= 20 THEN 'small' WHEN loop THEN 'loop' WHEN nodes <> paths OR low <> 2 OR high <> 2 THEN 'degree'
        WHEN parts <> 1 THEN 'parts' WHEN coalesce(border, 0) < 0.90 THEN 'border' WHEN span > least(a1 - a0, b1 - b0) * 0.12 + 2 THEN 'span' ELSE 'cycle' END AS reason FROM box JOIN nd USING (ring) LEFT JOIN border USING (ring)""",
)
def cycle_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that are one cycle along their border, else the first test that they fail."""
    return G.prove_cycles(paths(spark, sf_dir), ["ring"], 2.0, G.POLYGON)


# --- grids ----------------------------------------------------------------------------------------
CE = f"WITH {S.CELLS_SQL}"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cells(S.table(spark, sf_dir, "lineitem"))


@query("dilate", f"{CE} SELECT DISTINCT doc_id, (x + i.i)::INTEGER AS x, (y + j.j)::INTEGER AS y FROM cells, (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j) WHERE x + i.i BETWEEN 0 AND 199 AND y + j.j BETWEEN 0 AND 59")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dilate(cells(spark, sf_dir), ["doc_id"], 200, 60)


@query("runs", f"{CE}, m AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, y ORDER BY x) AS i FROM cells) SELECT doc_id, y, min(x) AS x0, max(x) AS x1 FROM m GROUP BY doc_id, y, i")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.runs(S.cell_places(S.table(spark, sf_dir, "lineitem")), ["doc_id"])


@query("roughness", f"{CE}, r AS (SELECT doc_id, y, min(x) AS lo, max(x) AS hi FROM cells GROUP BY 1, 2), c AS (SELECT *, coalesce(abs(lo - lag(lo) OVER w) + abs(hi - lag(hi) OVER w), 0) AS change FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY y)) SELECT doc_id, count(*) AS rows, round(sum(change) / count(*), 6) AS roughness FROM c GROUP BY 1")
def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roughness(cells(spark, sf_dir), ["doc_id"]).withColumn("roughness", F.round("roughness", 6))


SPARSE = "cells AS (SELECT l_suppkey AS doc_id, (l_partkey % {m})::INTEGER AS x, (l_quantity % {m})::INTEGER AS y, count(*) AS value FROM lineitem GROUP BY 1, 2, 3)"
WIDTH = 60


def grid_sql(m: int, name: str = "") -> str:
    """Cells, their 4-connected parts and the roughness of these, with a suffix to the names."""
    return f"""{SPARSE.format(m=m).replace("cells AS", f"cells{name} AS")}, n{name} AS (SELECT a.doc_id, a.x, a.y, b.x AS bx, b.y AS by_ FROM cells{name} a JOIN cells{name} b ON a.doc_id = b.doc_id AND ((a.x = b.x AND abs(a.y - b.y) = 1) OR (a.y = b.y AND abs(a.x - b.x) = 1))),
walk{name} AS (SELECT doc_id, x, y, y * 60 + x AS label FROM cells{name} UNION SELECT n.doc_id, n.bx, n.by_, w.label FROM walk{name} w JOIN n{name} n ON n.doc_id = w.doc_id AND n.x = w.x AND n.y = w.y WHERE w.label < n.by_ * 60 + n.bx),
l{name} AS (SELECT doc_id, x, y, min(label) AS label FROM walk{name} GROUP BY 1, 2, 3),
r{name} AS (SELECT doc_id, label, count(*) AS rows, sum(change) / count(*) AS roughness FROM (SELECT doc_id, label, coalesce(abs(lo - lag(lo) OVER w) + abs(hi - lag(hi) OVER w), 0) AS change FROM (SELECT doc_id, label, y, min(x) AS lo, max(x) AS hi FROM l{name} GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY doc_id, label ORDER BY y)) GROUP BY 1, 2),
parts{name} AS (SELECT doc_id, label, count(*) AS area, (max(x) - min(x) + 1)::BIGINT AS w, (max(y) - min(y) + 1)::BIGINT AS h, min(y * 60 + x)::BIGINT AS first, any_value(roughness) AS roughness FROM l{name} JOIN r{name} USING (doc_id, label) GROUP BY 1, 2)"""


GRID_SQL = "WITH RECURSIVE " + grid_sql(WIDTH)
#: The grids here are small, so the limits are too.
GRID = G.GridLimits(area=4, side=2, density=0.70, fraction=0.70, roughness=0.03)


def parts(spark: SparkSession, sf_dir: str, m: int = WIDTH) -> DataFrame:
    """Components of a grid of all its items for each supplier, with area, box and roughness; ``m`` folds the grid."""
    c = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.expr(f"cast(l_partkey % {m} as int)").alias("x"), F.expr(f"cast(l_quantity % {m} as int)").alias("y")).agg(F.count(F.lit(1)).alias("value"))
    return G.grid_parts(c, ["doc_id"], WIDTH)


@query("grid_components", f"{GRID_SQL} SELECT doc_id, first, area, w, h FROM parts")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("doc_id", "first", "area", "w", "h")


_KEPT = f"area >= {GRID.area} AND w >= {GRID.side} AND h >= {GRID.side} AND area <= {GRID.density} * (w * h) AND w * h <= {GRID.fraction} * {{cells}} AND roughness >= {GRID.roughness}"


@query(
    "grid_filter",
    f"""{GRID_SQL}, {grid_sql(12, "2")}, c AS (SELECT doc_id, first, area FROM parts2 WHERE {_KEPT.format(cells=144)}), f AS (SELECT doc_id, first, area FROM parts WHERE {_KEPT.format(cells=WIDTH * WIDTH)})
    SELECT doc_id, first, area, 'coarse' AS scale FROM c UNION ALL SELECT doc_id, first, area, 'fine' FROM f WHERE doc_id NOT IN (SELECT doc_id FROM c)""",
)
def grid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that are large, thin and rough enough on a coarse grid, and on the fine one where the coarse has none."""
    coarse, fine = (G.filter_grid(parts(spark, sf_dir, m), m * m, GRID).select("doc_id", "first", "area") for m in (12, WIDTH))
    return G.coarse_then_fine(coarse, fine, ["doc_id"])


@query("top_components", f"{GRID_SQL} SELECT doc_id, first, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, first)::INTEGER AS place FROM parts) WHERE place <= 4")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("area"), "first")
    return parts(spark, sf_dir).withColumn("place", F.row_number().over(order)).filter("place <= 4").select("doc_id", "first", "place")


AFTER_SQL = f"{CE}, after AS (SELECT doc_id, x, y, value + CASE WHEN x < 20 THEN 30 ELSE 0 END AS value FROM cells WHERE x <> 150), d AS (SELECT doc_id, x, y, abs(coalesce(a.value, 0) - coalesce(b.value, 0)) AS delta FROM cells b FULL JOIN after a USING (doc_id, x, y))"


def changed(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    before = cells(spark, sf_dir)
    after = before.filter("x <> 150").withColumn("value", F.col("value") + F.when(F.col("x") < 20, 30).otherwise(0))
    return G.difference(before, after, ["doc_id"], least)


@query("diff_map", f"{AFTER_SQL} SELECT doc_id, x, y, delta FROM d WHERE delta >= 1")
def diff_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, 1)


@query("diff_confined", f"{AFTER_SQL} SELECT doc_id, count(*) AS changed, count_if(x >= 20) AS outside, count(*) >= 8 AND count_if(x >= 20) <= greatest(16, ceil(0.0025 * count(*))) AS confined FROM d WHERE delta >= 1 GROUP BY 1")
def diff_confined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes must lie in the allowed box, but for a few."""
    out = changed(spark, sf_dir, 1).groupBy("doc_id").agg(F.count(F.lit(1)).alias("changed"), F.count_if(F.col("x") >= 20).alias("outside"))
    return out.withColumn("confined", (F.col("changed") >= 8) & (F.col("outside") <= F.greatest(F.lit(16), F.ceil(F.col("changed") * 0.0025))))
