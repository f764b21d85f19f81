"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import acos, ceil, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import connected_components, cut, least_roots, map_batches, shuffle_partitions

#: Passes, hashes that one pass concatenates to sort by, and further ones that only sift.
PASSES, HASHES, SIFT = 8, 60, 64
#: Sorted rows that one comparison block holds; the next one starts at its middle.
BLOCK = 1024
#: Rows of a partition of a sorted pass, about.
PART = 1 << 16
#: Members of a component, or of a long run, that meet in one tile.
TILE = 1024
#: Members of a run of equal signature prefixes, on average, and rows of a block that are compared at once.
RUN, ROWS_AT_ONCE = 256, 512
#: Small components are counted together, in groups of about so many members.
PACK = 4096


def _unit(blobs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, of packed numbers of type ``kind``."""
    x = np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(vectors: DataFrame, id_col: str, vector: str, label: str, kind: str) -> DataFrame:
    """Rows (id, label, digest, v): v packs the vector as it came; digest and v are null for a row that links with nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, blobs = [], []
        for i, k, x in zip(*(batch.column(c).to_pylist() for c in range(3))):
            v = None
            if i is not None and k is not None and x and None not in x:
                v = np.array(x, np.float64)
                norm = np.linalg.norm(v)
                v = v if np.isfinite(norm) and norm > 0 else None
            blobs.append(None if v is None else v.astype(kind).tobytes())
            digests.append(None if v is None else hashlib.sha256(f"{k}|{len(v)}|".encode() + blobs[-1]).digest()[:16])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())],
            names=["id", "label", "digest", "v"],
        )

    narrow = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x")
    )
    return map_batches(narrow, run, "id bigint, label string, digest binary, v binary")


def _signatures(classes: DataFrame, passes: int, seed: int, kind: str) -> DataFrame:
    """A row (grp, sig, sift, cid) for each class and pass: a number for pass and label, its sign hashes to sort by, and others to sift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = [1 << np.arange(k - 1, -1, -1, dtype=np.uint64) for k in (HASHES, SIFT)]
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            dims = np.array([len(b) // np.dtype(kind).itemsize for b in blobs], np.int64)
            for d in np.unique(dims):
                mine = np.nonzero(dims == d)[0]
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, int(d))).standard_normal((int(d), passes * (HASHES + SIFT)))
                signs = (_unit([blobs[i] for i in mine], kind) @ planes[d] > 0).reshape(len(mine), passes, HASHES + SIFT).astype(np.uint64)
                sig, sift = (signs[:, :, a:b] @ w for (a, b), w in zip(((0, HASHES), (HASHES, HASHES + SIFT)), weights))
                part = batch.take(pa.array(mine))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), p), pa.int32()), part.column(1), *(pa.array(x[:, p].view(np.int64)) for x in (sig, sift)), part.column(0)],
                        names=["pass", "label", "sig", "sift", "cid"],
                    )

    made = classes.select("cid", "label", "v").mapInArrow(run, "pass int, label string, sig bigint, sift bigint, cid bigint")
    return made.select(F.xxhash64("pass", "label").alias("grp"), "sig", "sift", "cid")


def most_flips(cosine: float) -> int:
    """Hashes in which two vectors of this cosine differ at most (but for 1 pair in 30000): 4 deviations over the mean."""
    p = acos(min(1.0, cosine)) / pi
    return ceil((HASHES + SIFT) * p + 4 * sqrt((HASHES + SIFT) * p * (1 - p)))


def _sifted(placed: DataFrame, flips: int) -> DataFrame:
    """Rows (kind, x, cid) of ``placed`` (grp, sig, sift, cid, sorted) with a row in their block (kind 0, number x) that may be near them.

    All pairs of a block are compared by their hashes. The rows at either end of a partition, which neighbours in the next one may
    be near to, are given as they are (kind 1, x being the later partition).
    """
    half = BLOCK // 2

    def near(rows: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rows), bool)
        grp, sig, sift = rows[:, 0], rows[:, 1], rows[:, 2]
        for a in range(0, len(rows), ROWS_AT_ONCE):
            i = slice(a, a + ROWS_AT_ONCE)
            apart = np.bitwise_count(sig[i, None] ^ sig[None, a:]) + np.bitwise_count(sift[i, None] ^ sift[None, a:])
            found = np.triu((apart <= flips) & (grp[i, None] == grp[None, a:]), 1)
            hit[i] |= found.any(axis=1)
            hit[a:] |= found.any(axis=0)
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, block, begun = np.empty((0, 4), np.uint64), 0, 0

        def out(kind: int, x: int, cid: np.ndarray) -> pa.RecordBatch:
            n = len(cid)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, x), pa.int64()), pa.array(cid.view(np.int64))], names=["kind", "x", "cid"]
            )

        for batch in batches:
            new = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns], axis=1)
            if part and begun < half and len(new):
                yield out(1, part, new[: half - begun, 3].copy())
            begun += len(new)
            held = np.concatenate([held, new])
            while len(held) > BLOCK:
                yield out(0, part << 32 | block, held[:BLOCK][near(held[:BLOCK]), 3])
                held, block = held[half:], block + 1
        if len(held):
            yield out(0, part << 32 | block, held[near(held), 3])
            yield out(1, part + 1, held[-half:, 3].copy())

    return placed.select("grp", "sig", "sift", "cid").mapInArrow(run, "kind int, x bigint, cid bigint")


def _block_edges(table: pa.Table, cosine: float, kind: str) -> pa.Table:
    """Edges that connect what links verified among all pairs of one block that have the same label."""
    label, cid, blobs = np.array(table["label"].to_pylist(), object), table["cid"].to_numpy(), table["v"].to_pylist()
    dims = np.array([len(b) for b in blobs])
    a, b = [], []
    for d in np.unique(dims):
        at = np.nonzero(dims == d)[0]
        x = _unit([blobs[i] for i in at], kind)
        for start in range(0, len(at), ROWS_AT_ONCE):
            i, j = np.nonzero(x[start : start + ROWS_AT_ONCE] @ x[start:].T >= cosine)
            upper = i < j
            i, j = at[start + i[upper]], at[start + j[upper]]
            same = label[i] == label[j]
            a.append(i[same])
            b.append(j[same])
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    root = least_roots(len(cid), i, j)
    moved = np.nonzero(root != np.arange(len(cid)))[0]
    return pa.table({"a": pa.array(cid[root[moved]], pa.int64()), "b": pa.array(cid[moved], pa.int64())})


def _passes(classes: DataFrame, cosine: float, passes: int, seed: int, kind: str) -> DataFrame:
    """Edges from all passes, each sorted over the whole table by its hashes and dealt in overlapping blocks.

    Only hashes are sorted. Vectors go to the blocks in which their hashes are near those of others, and there all pairs are verified.
    So are, in tiles, the pairs of a run of equal signature prefixes that may be longer than what two blocks share.
    """
    total = passes * classes.count()
    parts = max(1, min(shuffle_partitions(classes.sparkSession), total // PART))
    sigs = _signatures(classes, passes, seed, kind)
    placed = sigs.repartitionByRange(parts, "grp", "sig", "cid").sortWithinPartitions("grp", "sig", "cid")
    blocks = _sifted(placed, most_flips(cosine)).withColumns({"t1": F.lit(0), "t2": F.lit(0)})
    bits = min(HASHES, max(0, ceil(log2(max(1, total / passes / RUN)))))
    runs = sigs.select(F.xxhash64("grp", F.shiftright("sig", HASHES - bits)).alias("x"), "cid")
    long = runs.groupBy("x").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK // 2).select("x", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    rows = runs.join(long, "x").withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = rows.select(F.lit(2).alias("kind"), "x", "cid", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"))
    met = cut(blocks.unionByName(tiled)).join(classes.select("cid", "label", "v"), "cid")
    return met.groupBy("kind", "x", "t1", "t2").applyInArrow(lambda t: _block_edges(t, cosine, kind), "a bigint, b bigint").distinct()


def _counted(table: pa.Table, cosine: float, kind: str) -> pa.Table:
    """For each member of a group of components its links to members of its own, copies counted."""
    comp = table["component"].to_numpy()
    cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
    side, left, right = (table[c].to_numpy() for c in ("tile", "t1", "t2"))
    blobs = table["v"].to_pylist()
    order = np.argsort(comp, kind="stable")
    out_id, out_n = [], []
    for at in np.split(order, np.nonzero(np.diff(comp[order]))[0] + 1):
        if len({len(blobs[i]) for i in at}) > 1:  # of other dimensions: never linked, so never here
            raise ValueError("a component mixes dimensions")
        x = _unit([blobs[i] for i in at], kind)
        first = side[at] == left[at]
        if left[at[0]] == right[at[0]]:
            links = (x @ x.T >= cosine) * n[at][None, :]
            np.fill_diagonal(links, 0)
            total = links.sum(axis=1)
        else:
            near = x[first] @ x[~first].T >= cosine
            total = np.zeros(len(at), np.int64)
            total[first] = near @ n[at][~first]
            total[~first] = near.T @ n[at][first]
        out_id.append(cid[at])
        out_n.append(total)
    return pa.table({"cid": pa.array(np.concatenate(out_id), pa.int64()), "links": pa.array(np.concatenate(out_n), pa.int64())})


def _links(members: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(cid, links) within each component, all its pairs compared in tiles; only counts leave a tile.

    A component of more than TILE members is dealt in hashed tiles, each pair of tiles being one
    group; smaller ones share groups.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    packs = max(1, -(-total // PACK))
    rows = members.join(sizes, "component").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    rows = rows.withColumn("other", F.explode(others)).withColumns(
        {
            "t1": F.least("tile", "other"),
            "t2": F.greatest("tile", "other"),
            "pack": F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(-1 - F.col("component")),
        }
    )
    found = rows.select("pack", "t1", "t2", "component", "cid", "n", "v", "tile").groupBy("pack", "t1", "t2").applyInArrow(
        lambda t: _counted(t, cosine, kind), "cid bigint, links bigint"
    )
    return found.groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    passes: int = PASSES,
    seed: int = 42,
) -> DataFrame:
    """Rows (id, n_links, component, kept) for every vector; only vectors with equal labels compare.

    Equal vectors collapse to one class first, so copies never fill a block. Each pass orders
    the classes by label and concatenated random hashes and compares all pairs of a block of neighbours and of any
    longer run of equal hashes; verified links of all passes are united. Links are then counted over all pairs
    of a component, in tiles, so that a group larger than a block loses none.

    Rows whose id, label or vector is null, or whose vector is empty, zero or holds a null or non-finite component,
    link with nothing: n_links 0, their own id as component. Repeated rows are copies of each other. An
    empty table gives an empty one. Vectors of different lengths don't link.
    """
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    rows = _rows(vectors, id_col, vector, label, kind)
    grouped = rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()))
    nodes = connected_components(_passes(classes, cosine, passes, seed, kind))
    members = cut(classes.join(nodes.withColumnRenamed("node", "cid"), "cid"))
    roots = members.groupBy("component").agg(F.min("least").alias("root"))
    linked = members.select("cid", "component").join(roots, "component").join(_links(members, cosine, kind), "cid", "left")
    by_class = (
        classes.select("cid", "digest", "least", "n")
        .join(linked, "cid", "left")
        .select(
            "digest",
            F.coalesce("root", "least").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    return (
        rows.select("id", "digest")
        .join(by_class, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("root", "id"), F.lit(False)).alias("kept"),
        )
    )


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same by comparing all pairs, for tables whose ids don't repeat.
ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), m AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept
    FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id"""
