"""Operator 6: exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised to integers and grouped into buckets of similar length; a bucket is cut into
blocks of bounded size by a hash of the row. Each query first meets the ``SEEDS`` longest vectors, which
gives it a lower bound on its k-th best score. A bucket can hold a better vector only if its greatest
length reaches the bound divided by the query's length; their quotient is the local cosine threshold.
Where it is high, candidates are pruned by one coordinate (a vector at a small angle has a similar share
of its length in the query's largest coordinate); where it is low, by length alone. The remaining
products are computed in full and are exact integers.

Queries and candidates meet by an equi-join on pairs of blocks, so the work is spread evenly whatever
vectors repeat, and a query block is only sent to the buckets that its bounds leave open.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null
ids; vectors of another dimension than the query's are no candidates; zero vectors score 0; fewer
candidates than k give all; ties go to the smaller id; rows that share an id are queries and candidates
of their own, and a query has every row but itself as a candidate; components and scores beyond the range
of doubles and of 64 bits are held at the limits; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbatch.llm.common import staged

SCALE = 256.0
BUCKETS_PER_DOUBLING = 4
_MOST = np.finfo(np.float64).max
#: Vectors of a block of candidates or of queries, about; a row is copied once for each block on the other side.
BLOCK = 4096
SEEDS = 256
#: A local cosine threshold from here on prunes by coordinate, below it by length.
COORDINATE_FROM = 0.6
_SLACK = 1 + 1e-9


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, dim, norm, bucket) of the vectors that take part; x holds the doubles floor(256 * component)."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.binary()), ("dim", pa.int32()), ("norm", pa.float64()), ("bucket", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or not vector.is_valid or vector.values.null_count:
                    continue
                v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(v * SCALE), -_MOST, _MOST)
                        longest = float(np.abs(x).max(initial=0.0))
                        norm = min(_MOST, longest * float(np.sqrt(((x / longest) ** 2).sum()))) if longest else 0.0
                    rows.append((key, x.tobytes(), len(x), norm, int(np.floor(np.log2(norm) * BUCKETS_PER_DOUBLING)) if norm else -100_000))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "id long, x binary, dim int, norm double, bucket int")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the limits of 64 bits."""
    if q.size == 0 or c.size == 0:
        return np.zeros((len(q), len(c)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**52:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in c], dtype=object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()])


def open_pairs(q: np.ndarray, q_norm: np.ndarray, bound: np.ndarray, c: np.ndarray, c_norm: np.ndarray) -> np.ndarray:
    """Which candidates may reach each query's bound: by coordinate where the local cosine threshold is high, by length elsewhere."""
    most = float(c_norm.max())
    with np.errstate(divide="ignore", invalid="ignore"):
        least_norm = np.where((q_norm > 0) & np.isfinite(bound), bound / q_norm, -np.inf)
        threshold = np.where(most > 0, least_norm / most, -np.inf)
    ok = c_norm[None, :] * _SLACK >= least_norm[:, None]
    for i in np.flatnonzero((threshold >= COORDINATE_FROM) & (threshold <= _SLACK)):
        t = min(1.0, threshold[i])
        f = int(np.abs(q[i]).argmax())
        share = q[i, f] / q_norm[i]
        reach = np.sqrt(max(0.0, (1 - t * t) * (1 - share * share))) + 1e-9
        low = -1.0 if -share >= t else t * share - reach
        high = 1.0 if share >= t else t * share + reach
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(c_norm > 0, c[:, f] / c_norm, 0)
        ok[i] &= (own >= low - 1e-9) & (own <= high + 1e-9)
    ok[threshold > _SLACK] = False
    return ok


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows. ``is_query`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    data = staged(quantised(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    buckets = data.groupBy("bucket").agg(F.max("norm").alias("most"), F.count(F.lit(1)).alias("n")).collect()  # a few per doubling of the length
    queries = data.filter(is_query)
    n_queries = queries.count()
    if not buckets or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = {b["bucket"]: -(-b["n"] // BLOCK) for b in buckets}
    seeds = data.orderBy(F.desc("norm"), "id").limit(SEEDS).collect()  # at most SEEDS rows
    seed_row, seed_x, seed_dim = np.array([s["row"] for s in seeds]), [s["x"] for s in seeds], np.array([s["dim"] for s in seeds])

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            bound = np.full(len(keys), -np.inf)
            for dim in np.unique(dims):
                mine, theirs = np.flatnonzero(dims == dim), np.flatnonzero(seed_dim == dim)
                if len(theirs) <= k:
                    continue
                score = products(_matrix(batch.column(1).take(pa.array(mine))), np.stack([np.frombuffer(seed_x[s], np.float64) for s in theirs])).astype(np.float64)
                score[keys[mine][:, None] == seed_row[theirs][None, :]] = -np.inf
                bound[mine] = np.partition(score, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], names=[*batch.schema.names, "bound"])

    queries = staged(queries.select("id", "x", "dim", "norm", "row").mapInArrow(bounded, "id long, x binary, dim int, norm double, row long, bound double"), "queries")
    n_blocks = -(-n_queries // BLOCK)
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    # the buckets that some query of a block can still profit from
    all_buckets = F.array(*(F.struct(F.lit(b["bucket"]).alias("bucket"), F.lit(float(b["most"])).alias("most"), F.lit(blocks[b["bucket"]]).cast("int").alias("blocks")) for b in buckets))
    reach = F.min(F.when((F.col("norm") > 0) & (F.col("bound") > 0), F.col("bound") / F.col("norm")).otherwise(F.lit(float("-inf"))))
    wanted = queries.groupBy("qb").agg(reach.alias("reach")).withColumn("b", F.explode(F.filter(all_buckets, lambda b: b["most"] * _SLACK >= F.col("reach"))))
    wanted = wanted.select("qb", F.col("b.bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)).alias("block"))
    count_of = F.create_map(*(F.lit(int(x)) for pair in blocks.items() for x in pair))
    candidates = data.withColumn("block", F.pmod(F.xxhash64("row"), count_of[F.col("bucket")].cast("long")).cast("int"))
    left = queries.join(wanted, "qb").select("qb", "bucket", "block", "id", "x", "dim", "norm", "row", "bound")
    right = candidates.join(wanted, ["bucket", "block"]).select("qb", "bucket", "block", "id", "x", "dim", "norm", "row").toDF("c_qb", "c_bucket", "c_block", "id", "x", "dim", "norm", "row")

    def best(queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and block.num_rows:
            for dim in np.unique(queries.column("dim").to_numpy()):
                mine, theirs = (t.filter(pa.compute.equal(t.column("dim"), int(dim))) for t in (queries, block))
                if not theirs.num_rows:
                    continue
                c, c_norm, c_id, c_row = _matrix(theirs.column("x")), *(theirs.column(n).to_numpy() for n in ("norm", "id", "row"))
                for at in range(0, mine.num_rows, 256):
                    part = mine.slice(at, 256)
                    q, q_norm, bound, q_id, row = _matrix(part.column("x")), *(part.column(n).to_numpy() for n in ("norm", "bound", "id", "row"))
                    ok = open_pairs(q, q_norm, bound, c, c_norm) & (row[:, None] != c_row[None, :])
                    some_q, some_c = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
                    if not len(some_q):
                        continue
                    score = products(q[some_q], c[some_c])
                    ok = ok[np.ix_(some_q, some_c)] & (score >= bound[some_q][:, None])
                    for i, s, good in zip(some_q.tolist(), score, ok, strict=True):
                        at_i = np.flatnonzero(good)
                        if len(at_i):
                            # integers sort exactly: falling scores as rising complements
                            at_i = at_i[np.lexsort((c_id[some_c[at_i]], ~s[at_i]))][:k]
                            out += [(int(row[i]), int(q_id[i]), int(c_id[some_c[j]]), int(s[j])) for j in at_i]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("row", "query_id", "vec_id", "score"), columns, strict=True)})

    partial = left.groupBy("qb", "bucket", "block").cogroup(right.groupBy("c_qb", "c_bucket", "c_block")).applyInArrow(best, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
