"""What the operators of this package share: durable cuts of the lineage, batch plumbing, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a few numbers that one checkpoint file holds at least, where their count is known.
ROWS_PER_FILE = 100_000
#: Bytes of rows that Python gets at a time.
ARROW_BYTES = 4 << 20
#: A node with more edges than this, and than one in HUB_SHARE of all, is a hub: there are 2 * HUB_SHARE hubs at most.
HUB_EDGES, HUB_SHARE = 256, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (a single-machine session, as in tests) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyforge-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder for one written table."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, narrow: bool = True, rows: int | None = None) -> DataFrame:
    """Cut the lineage: the rows are stored in the shared folder and survive lost executors.

    ``narrow`` writes two files per core at most, for tables of a few numbers per row, and no more than one for each
    ROWS_PER_FILE if ``rows`` says about how many there are; without it there is a file for each partition, as suits rows that cost
    much to make.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if narrow:
        files = 2 * spark.sparkContext.defaultParallelism
        df = df.coalesce(files if rows is None else max(1, min(files, -(-rows // ROWS_PER_FILE))))
    return df.checkpoint(eager=True)


def release_memory() -> None:
    """Give freed memory back to the system, so that a Python worker that waits holds little of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to hand Python no more than ARROW_BYTES at a time (one longer row goes alone).

    Each task holds a batch twice outside the heap and once in Python, which for whole texts is what fills an executor.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; batches that give None or no rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out
        release_memory()

    return small_batches(df).mapInArrow(run, schema)


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths add up to about ``most``; one long item is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def whole_runs(batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The columns that ``arrays`` makes of batches sorted by the first of them, cut where it changes: no run of a value is torn."""
    held: list[list[np.ndarray]] = []  # pieces of the last run, which the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        at = int(np.searchsorted(now[0], now[0][-1]))
        if at == 0 and held and held[0][0][0] == now[0][0]:
            held.append([c.copy() for c in now])
            continue
        if at:
            yield [np.concatenate(c) for c in zip(*held, [c[:at] for c in now])]
        elif held:
            yield [np.concatenate(c) for c in zip(*held)]
        held = [[c[at:].copy() for c in now]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def least_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest that the links (i, j) reach from it."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, as rows (node, component): component is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round is a
    min-aggregation and a join on the node, so nothing is gathered per node, and the number of
    rounds grows with the logarithm of the longest path. The edges of a hub don't meet in one task: the few hubs that there
    can be are broadcast with their least neighbours. Rounds are cut by checkpoints. Nodes without
    an edge are not returned; edges that hold a null are ignored; an empty table gives an empty one.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _fingerprint(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        e = cut(_small_star(_large_star(e, state[0]), state[0]), rows=state[0])
        new = _fingerprint(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``rows`` with column m of ``least`` (u, m, n). ``n`` rows have this u; those of hubs aren't shuffled by it."""
    hubs = F.broadcast(least.where(F.col("n") > max(HUB_EDGES, edges // HUB_SHARE)).select("u", F.col("m").alias("hub_m")))
    marked = rows.join(hubs, "u", "left")
    of_hubs = marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    return of_hubs.unionByName(marked.where("hub_m is null").select("u", "v").join(least.select("u", "m"), "u"))


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (here u > v always holds)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(e, least, edges).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()
