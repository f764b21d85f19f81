"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, map_batches

#: Queries that are scored in one run over the candidates (and sent to each executor).
QUERY_BLOCK = 4096
#: Bins of a score histogram.
BINS = 1024
#: Scores that a task holds at once.
SCORES = 1 << 22


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows (id, v, top, row): floor(scale * x) of each component as packed 64-bit numbers, the largest of them, a number for each row.

    Rows whose id or vector is null, or whose vector is empty or holds a null or non-finite component, are
    left out; repeated rows are rows like any other.
    """
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = F.col(id_col).isNotNull() & (F.size(x) > 0) & ~bad
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.monotonically_increasing_id().alias("row"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column(1)
        ends = col.offsets.to_numpy()
        flat = np.floor(col.values.to_numpy() * scale).astype(np.int64)
        packed = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        top = [int(np.abs(flat[a:b]).max()) for a, b in zip(ends[:-1], ends[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(top, pa.int64()), batch.column(2)], names=["id", "v", "top", "row"])

    return map_batches(rows, run, "id bigint, v binary, top bigint, row bigint")


class QueryBlock:
    """Query vectors by dimension, and the range in which each one's k-th best score is sought."""

    def __init__(self, rows: list, k: int, top: int) -> None:
        rows = sorted(rows, key=lambda r: (len(r.v), r.id, r.row))
        self.k = k
        self.ids = np.array([r.id for r in rows], np.int64)
        self.rows = np.array([r.row for r in rows], np.int64)
        self.dims = np.array([len(r.v) // 8 for r in rows])
        self.groups = {
            int(d): (np.nonzero(self.dims == d)[0], np.array([np.frombuffer(r.v, np.int64) for r in rows if len(r.v) == 8 * d]))
            for d in np.unique(self.dims)
        }
        bound = np.zeros(len(rows), object)
        for at, q in self.groups.values():
            bound[at] = np.abs(q).astype(object).sum(axis=1) * top + 1
        #: sums of products below this are exact in doubles, which multiply far faster
        self.exact = max(bound, default=0) < 1 << 53
        bound = np.minimum(bound, 1 << 61)  # scores are 64-bit numbers
        self.low = np.array([-b for b in bound], np.int64)
        self.width = np.array([-(-(2 * b + 1) // BINS) for b in bound], np.int64)
        self.need = np.full(len(rows), k, np.int64)

    def scored(self, batch: pa.RecordBatch):
        """(query numbers, candidate ids, scores with a row per query, mask that leaves out the query's own row)."""
        ids, numbers = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        blobs = batch.column(1).to_pylist()
        size = np.array([len(b) // 8 for b in blobs])
        for d, (at, q) in self.groups.items():
            mine = np.nonzero(size == d)[0]
            step = max(1, SCORES // max(1, len(at)))
            for a in range(0, len(mine), step):
                some = mine[a : a + step]
                x = np.frombuffer(b"".join(blobs[i] for i in some), np.int64).reshape(-1, d)
                if self.exact:
                    s = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
                else:
                    s = q @ x.T
                yield at, ids[some], s, self.rows[at][:, None] != numbers[some][None, :]

    def histogram(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The upper bins of each query's scores in this batch, down to where k of them are reached.

        Lower bins of a batch can't hold the k-th best of all, so they aren't sent.
        """
        out = [], [], []
        for at, _, s, other in self.scored(batch):
            low, width = self.low[at][:, None], self.width[at][:, None]
            bins = np.minimum((s - low) // width, BINS)  # BINS: above the sought range
            bins[(s < low) | ~other] = -1
            flat = (bins + 1 + np.arange(len(at))[:, None] * (BINS + 2)).ravel()
            counts = np.bincount(flat, minlength=len(at) * (BINS + 2)).reshape(len(at), BINS + 2)[:, 1:]
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < self.k))
            for held, new in zip(out, (at[q], b, counts[q, b])):
                held.append(new)
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["q", "bin", "n"])

    def refine(self, found: list) -> None:
        """Narrow each range to the bin of its k-th best score; found: (q, bin, n of scores above the bin), if any."""
        hit = np.zeros(len(self.ids), bool)
        for q, b, _ in found:
            hit[q] = True
            self.low[q] += b * self.width[q]
        settled = self.width == 1
        self.width = np.maximum(1, -(-self.width // BINS))
        self.width[~hit] = 1
        self.done = bool(np.all(settled | ~hit))

    def best(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """All scores above the k-th best, and of those equal to it the k with the smallest ids."""
        out = [], [], [], []
        for at, ids, s, other in self.scored(batch):
            kth = self.low[at][:, None]
            q, c = np.nonzero((s > kth) & other)
            eq, ec = np.nonzero((s == kth) & other)
            order = np.lexsort((ids[ec], eq))
            eq, ec = eq[order], ec[order]
            first = np.arange(len(eq)) - np.searchsorted(eq, eq) < self.k
            q, c = np.concatenate([q, eq[first]]), np.concatenate([c, ec[first]])
            for held, new in zip(out, (self.rows[at][q], self.ids[at][q], ids[c], s[q, c])):
                held.append(new)
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["query", "query_id", "id", "score"])


def top_k(
    vectors: DataFrame, k: int, every: int, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each row whose id is divisible by ``every``: its k highest integer inner products with all other rows.

    Rows (query_id, rank from 1, id, score), ties by the smaller id. Every row but the query's own is a candidate, also one that repeats
    its id, and rows that repeat a query are queries too; vectors of another length don't compare; with fewer than k candidates all are given. Queries are
    taken in hashed blocks of about QUERY_BLOCK: each block scores all candidates, and rounds of global
    histograms narrow the range of every k-th best score down to one value. An empty table, or
    one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut(whole_numbers(vectors, id_col, vector))  # so the numbers of rows hold from here on
    queries = rows.where(F.col("id") % every == 0)
    n, top = queries.count(), rows.agg(F.max("top")).first()[0]
    found = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    blocks = -(-n // QUERY_BLOCK)
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK rows
        if not mine:
            continue
        block = QueryBlock(mine, k, top)
        while True:
            held = spark.sparkContext.broadcast(block)
            bins = map_batches(rows, lambda x, h=held: h.value.histogram(x), "q long, bin long, n long")
            total = bins.groupBy("q", "bin").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("q").orderBy(F.col("bin").desc())
            above = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
            at = total.withColumn("above", above).where(f"above < {k} and above + n >= {k}")
            block.refine([tuple(r) for r in at.select("q", "bin", "above").collect()])  # a row per query at most
            if block.done:
                break
        held = spark.sparkContext.broadcast(block)
        kept = map_batches(rows, lambda x, h=held: h.value.best(x), "query long, query_id long, id long, score long")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
        ranked = kept.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").drop("query")
        found = found.unionByName(cut(ranked) if blocks > 1 else ranked)
    return found


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, k=5, every=50).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: The same over the whole table; sums of products stay below 2^53, where doubles are exact.
ORACLE = """WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.n AS q, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
