"""SimHash fingerprints of word shingles, near-duplicate groups by multi-index hashing, and groups of similar shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyforge.llm.common import (
    connected_components, cut, least_roots, map_batches, release_memory, shuffle_partitions, slices, small_batches, whole_runs,
)

BITS = 64
#: Shingles whose bits are counted at once: bounds the memory for one very long text.
CHUNK = 1 << 15
#: Rows that a table entry is compared with as it is; how often fuller ones are indexed again (64 bits halved); pairs compared at once.
ENTRY, LEVELS, PAIRS_AT_ONCE = 1024, 3, 1 << 20
#: Full entries whose 8-byte keys are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; a shorter text is one shingle.

    A-Z are lower-cased, words are what stands between the ASCII blanks 0x20 and 0x09-0x0D.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    runs = zip(*(words[i:] for i in range(width)))
    return np.fromiter(
        map(xxh64_intdigest, map(b" ".join, runs), repeat(seed)), np.uint64, len(words) - width + 1
    )


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number; 0 for no hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3, to: str = "fingerprint") -> DataFrame:
    """``docs`` without its text but with its fingerprint as a signed 64-bit number in column ``to``.

    Whole texts are read; a null text counts as an empty one, with fingerprint 0. Other columns,
    whatever their names, pass through unchanged.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, to)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(shingle_hashes(x.as_py(), width)) for x in batch.column(batch.num_columns - 1)]
        out = [batch.column(i) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays(
            [*out, pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())],
            names=[*(f.name for f in kept), to],
        )

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{to}` bigint"])
    return map_batches(docs.select(*(f"`{f.name}`" for f in kept), F.col(text).cast("string")), run, ddl)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """Rows (key, fp, free, own) of the tables at one level, from rows (key, fp, free, own) of the level above.

    The part of a fingerprint that is still free (from bit ``free`` on, the whole of it at level 0) is split in two segments,
    each of which is a table of its own. For either segment, a row goes to the entry of its own value (where it is ``own``, it is
    found) and, as a probe, to every other value of the Hamming ball of radius 1 around it. The other segment is free on the next level.
    """
    half = BITS >> (level + 1)
    width, mask = F.lit(half), F.lit((1 << half) - 1).cast("long")
    bits = F.sequence(F.lit(0), F.lit(half - 1))
    ball = F.concat(F.array(F.lit(0).cast("long")), F.transform(bits, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    parts = rows.select("key", "fp", "free", "own", sides).select("*", F.explode(ball).alias("flip"))
    segment = F.call_function("shiftrightunsigned", F.col("fp"), F.col("free") + F.col("side") * width).bitwiseAND(mask)
    return parts.select(
        F.xxhash64("key", F.lit(level), "side", segment.bitwiseXOR(F.col("flip"))).alias("key"),
        "fp",
        (F.col("free") + (1 - F.col("side")) * width).cast("int").alias("free"),
        (F.col("own") & (F.col("flip") == 0)).alias("own"),
    )


def _matched(rows: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) that connect what is within ``distance`` in the entries of ``rows`` (key, fp, own), sorted by key.

    Every probe of an entry is compared with every fingerprint found there, by all bits. Links are thinned to a forest.
    """

    def edges(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
        count = np.diff([*starts, len(key)])
        first, many = np.repeat(starts, count), np.repeat(count, count)
        held = np.nonzero(own & (many > 1))[0]
        first, many = first[held], many[held]
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in slices(many.tolist(), PAIRS_AT_ONCE):
            i = np.repeat(held[a:b], many[a:b])
            j = np.arange(len(i)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + np.repeat(first[a:b], many[a:b])
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (fp[i] != fp[j])
            left.append(i[near])
            right.append(j[near])
        nodes, at = np.unique(fp[np.concatenate(left + right)], return_inverse=True)
        i, j = np.split(at, 2)
        root = least_roots(len(nodes), i, j)
        moved = np.nonzero(root != np.arange(len(nodes)))[0]
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[moved]].view(np.int64)), pa.array(nodes[moved].view(np.int64))], names=["a", "b"])

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in whole_runs(batches, arrays):
            yield edges(*one)
        release_memory()

    return small_batches(rows.select("key", "fp", "own")).mapInArrow(run, "a bigint, b bigint")


def link_edges(fps: DataFrame, full: int = ENTRY) -> DataFrame:
    """Edges (a, b) between distinct ``fps`` (column fp) that connect all at 2 or fewer differing bits.

    Multi-index hashing: a fingerprint has two segments of 32 bits, and a table for each is keyed by the segment's exact value. Of
    two fingerprints at a distance of 2 or less one segment differs by 1 bit at most, so the Hamming ball of radius 1 around that
    segment of the one has the other's; all 33 values of the ball are probed in the table, and the whole distance of each match
    is verified. Copies with the same segment can fill an entry. One that meets more than ``full`` rows is indexed again by the
    other segment's two halves of 16 bits in the same way, then of 8: there, an entry can't hold more than 256 fingerprints.
    """
    n = shuffle_partitions(fps.sparkSession)
    rows = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("free"), F.lit(True).alias("own"))
    found = None
    for level in range(LEVELS):
        placed = dealt = _deal(rows.repartition(n), level)  # each row becomes 66, or fewer on the levels below
        crowded = 0
        if level < LEVELS - 1:
            met = dealt.groupBy("key").agg(F.count("*").alias("met"), F.count_if("own").alias("held"))
            large = cut(met.where((F.col("met") > full) & (F.col("held") > 0)).select("key"))
            crowded = large.count()
        if crowded:
            large = F.broadcast(large) if crowded <= BROADCAST_KEYS else large
            placed = dealt.join(large, "key", "left_anti")
        edges = _matched(placed.select("key", "fp", "own").repartition(n, "key").sortWithinPartitions("key"))
        found = edges if found is None else found.unionByName(edges)
        if not crowded:
            break
        rows = cut(dealt.join(large, "key", "left_semi"), narrow=False)
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, fingerprint long, component): component is the smallest id of all that links reach.

    One row per input row. Exact copies collapse to one fingerprint before anything is compared. A null
    id keeps its row and is never a smallest id (a component of null ids only has none). An empty table
    gives an empty one. Ties and repeated rows get the same answer. Texts of any length are read whole; other columns play no part.
    """
    rows = cut(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), width=width, to="fp"), narrow=False)
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = connected_components(link_edges(classes.select("fp")))
    labelled = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(roots, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


# --- groups of similar documents: fingerprints by the tables above, then parts of shingle sets, every pair that shares one, whole sets ---

#: Words of the shingles that make a fingerprint, as in ``op3_simhash``.
FINGERPRINT_WIDTH = 3

#: 64-bit words of the parity bits of a set.
WORDS = 4
#: Members of one entry that meet in one tile.
TILE = 1024
#: Small entries are compared together, in groups of about so many rows.
PACK = 16384
#: Shingles whose parts are summed at once.
PARTS_AT_ONCE = 1 << 20
#: Bits that a folded parity keeps at least, where a set's long one has more.
SKETCH_BITS = 2048
#: Bits of the map that says which sets are compared.
MARKS = 1 << 22


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """The finaliser of SplitMix64 over ``h`` and a seed."""
    h = h + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def parity(unique: np.ndarray) -> np.ndarray:
    """64 * WORDS bits, each the parity of the shingles that fall on it, as unsigned words.

    The bits of two sets differ in no more places than the sets differ in members.
    """
    at = mixed(unique, 1) % np.uint64(64 * WORDS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * WORDS) & 1, bitorder="little").view("<u8").copy()


def long_parity(unique: np.ndarray) -> bytes:
    """As ``parity``, in 2 bits or more for each member: a power of 2, so that a longer one folds to a shorter one's length."""
    width = max(64, 1 << int(2 * len(unique) - 1).bit_length()) if len(unique) else 64
    at = (mixed(unique, 6) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width) & 1, bitorder="little").tobytes()


def folded(long: bytes, n: int) -> bytes:
    """A set's long parity, in no more bits than tell it from unrelated sets of its size: SKETCH_BITS, or 1 for two members if that is more."""
    keep, words = max(SKETCH_BITS, 1 << (max(n, 2) // 2 - 1).bit_length()) // 8, np.frombuffer(long, np.uint8)
    while len(words) > keep:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words.tobytes()


def parities_differ(a: bytes, b: bytes) -> int:
    """The bits in which two long parities differ: no more than the members in which their sets do, and not many fewer."""
    x, y, shorter = int.from_bytes(a, "little"), int.from_bytes(b, "little"), min(len(a), len(b))
    for longer in range(max(len(a), len(b)).bit_length() - 1, shorter.bit_length() - 1, -1):
        half = 8 << (longer - 1)
        x, y = ((v >> half) ^ (v & ((1 << half) - 1)) for v in (x, y))
    return (x ^ y).bit_count()


def most_apart(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Members in which sets of ``a`` and ``b`` members may differ at most, at a Jaccard similarity of ``least`` or more."""
    return np.floor((a + b) * (1 - least) / (1 + least) + 1e-9).astype(np.int64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 32-bit hashes."""
    return np.unique((shingle_hashes(text, width) >> np.uint64(32)).astype("<u4"))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit number that stands for a set."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, width: int, by_fingerprint: bool) -> DataFrame:
    """Rows (row, id, fp, cid, n, bits, long, sketch) of docs (row, id, text): each text's fingerprint (else 0), the number of its set, its size and
    parity bits. The sketch is the folded parity, or null where that is the long one.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x.as_py(), width) for x in batch.column(2)]
        prints = [fingerprint(shingle_hashes(x.as_py(), FINGERPRINT_WIDTH)) if by_fingerprint else 0 for x in batch.column(2)]
        longs = [long_parity(s.astype(np.uint64)) for s in sets]
        sketches = [folded(x, len(s)) for x, s in zip(longs, sets)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(np.array(prints, np.uint64).view(np.int64)),
                pa.array([set_id(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([parity(s.astype(np.uint64)).tobytes() for s in sets], pa.binary()),
                pa.array(longs, pa.binary()),
                pa.array([None if len(x) == len(y) else x for x, y in zip(sketches, longs)], pa.binary()),
            ],
            names=["row", "id", "fp", "cid", "n", "bits", "long", "sketch"],
        )

    return map_batches(docs, run, "row bigint, id bigint, fp bigint, cid bigint, n bigint, bits binary, long binary, sketch binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets, given as sorted distinct hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def size_bounds(least: float, upto: int) -> list[int]:
    """The least sizes of the classes of set sizes, past ``upto``: similar sets are in one class or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] <= upto or len(bounds) < 3:
        bounds.append(max(bounds[-1] + 1, ceil(bounds[-1] / least - 1e-9)))
    return [*bounds, max(bounds[-1] + 1, ceil(bounds[-1] / least - 1e-9)), 1 << 62]


def part_shapes(least: float, upto: int) -> list[tuple[int, int, int, int]]:
    """(group, class, parts, spare) for every class of sizes up to ``upto``; a group is a class and the next one.

    Two similar sets of a group differ in at most parts - 1 - spare members, so that more than ``spare`` of their parts are equal.
    """
    bounds, out = size_bounds(least, upto), []
    for c in range(len(bounds) - 3):
        low, high = bounds[c + 1] - 1, bounds[c + 2] - 1
        apart = int(most_apart(np.array(low), np.array(min(high, int(low / least + 1e-9))), least))
        spare = 1 + ceil(0.05 * apart)
        if apart:  # else only equal sets are similar, and those are one class already
            out += [(c, member, apart + 1 + spare, spare) for member in (c, c + 1)]
    return out


def part_entries(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(entry, index of the set) for the parts of each set: similar sets that differ share an entry, always.

    The hashes deal members in parts; an entry is the sum over one part's mixed members. Sets that differ in fewer members than
    there are parts have an equal part. That may be an empty one, which is an entry only for sets with more than ``spare`` of them.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    longest = int(sizes.max(initial=0))
    owner_class = np.searchsorted(size_bounds(least, longest), sizes, side="right") - 1
    entries, owners = [], []
    for group, c, parts, spare in part_shapes(least, longest):
        mine = np.nonzero((owner_class == c) & (sizes > 0))[0]
        for a, b in slices(sizes[mine].tolist(), PARTS_AT_ONCE):
            at = mine[a:b]
            h = np.concatenate([sets[i] for i in at]).astype(np.uint64)
            own = np.repeat(np.arange(len(at)), sizes[at])
            cell = own * parts + (mixed(h, 2) % np.uint64(parts)).astype(np.int64)
            sums, held = np.zeros(len(at) * parts, np.uint64), np.bincount(cell, minlength=len(at) * parts)
            np.add.at(sums, cell, mixed(h, 3))
            part = np.tile(np.arange(parts, dtype=np.uint64), len(at))
            keep = (held > 0) | np.repeat((held.reshape(-1, parts) == 0).sum(axis=1) > spare, parts)
            entry = mixed(sums + mixed(part + np.uint64(group << 32), 4), 5)
            entries.append(entry[keep].view(np.int64))
            owners.append(np.repeat(at, parts)[keep])
    if not entries:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(entries), np.concatenate(owners)


def _entries(texts: DataFrame, width: int, least: float) -> DataFrame:
    """Rows (entry, cid) of the parts of the sets of ``texts`` (text), once for each copy of a set in another batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {set_id(s): s for s in (shingle_set(x.as_py(), width) for x in batch.column(0))}
            cid = np.fromiter(sets, np.int64, len(sets))
            entry, owner = part_entries(list(sets.values()), least)
            for a in range(0, len(entry), 1 << 17):
                e, o = entry[a : a + (1 << 17)], owner[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(cid[o])], names=["entry", "cid"])
        release_memory()

    return small_batches(texts).mapInArrow(run, "entry bigint, cid bigint")


def _shared(entries: DataFrame) -> DataFrame:
    """The rows of ``entries`` (sorted by entry and cid) whose entry another set has too, without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waits = None, None  # the row before, and whether it still waits for a row of its entry
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, cid = (c.to_numpy() for c in batch.columns)
            if last is not None:
                entry, cid = np.concatenate([[last[0]], entry]), np.concatenate([[last[1]], cid])
            new = np.concatenate([[True], (entry[1:] != entry[:-1]) | (cid[1:] != cid[:-1])])
            entry, cid = entry[new], cid[new]
            equal = entry[1:] == entry[:-1]
            given = last is not None and not waits
            twin = np.concatenate([[given], equal]) | np.concatenate([equal, [False]])
            out = np.nonzero(twin)[0][int(given) :]
            waits = not twin[-1]
            last = entry[-1], cid[-1]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(entry[out]), pa.array(cid[out])], names=["entry", "cid"])
        release_memory()

    return entries.mapInArrow(run, "entry bigint, cid bigint")


def _words(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), "<u8").reshape(-1, WORDS)


def may_be_similar(f: np.ndarray, g: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets with parity bits ``f``, ``g`` and sizes ``n``, ``m`` can be similar; never False for two that are."""
    return np.bitwise_count(f ^ g).sum(axis=-1, dtype=np.int64) <= most_apart(n, m, least)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _hub_pairs(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the member of an entry that is nearest to the middle of all and each other one, if they may be similar.

    ``members`` (entry, cid, n, bits) is sorted by entry. A group around one text is linked by these, a pair for each row at most.
    """

    def pairs(entry: np.ndarray, cid: np.ndarray, n: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.nonzero(np.diff(entry))[0] + 1])
        count = np.diff([*starts, len(entry)])
        ones = np.add.reduceat(np.unpackbits(f.view(np.uint8), axis=1), starts, axis=0, dtype=np.int32)
        middle = np.packbits(ones * 2 > count[:, None], axis=1).view("<u8")
        own = np.repeat(np.arange(len(starts)), count)
        off = np.bitwise_count(f ^ middle[own]).sum(axis=1, dtype=np.int64)
        hub = np.lexsort((cid, off, own))[starts][own]
        ok = (cid != cid[hub]) & may_be_similar(f, f[hub], n, n[hub], least)
        return pa.RecordBatch.from_arrays([pa.array(cid[hub[ok]]), pa.array(cid[ok])], names=["a", "b"])

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [*(batch.column(i).to_numpy() for i in range(3)), _words(batch.column(3))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in whole_runs(batches, arrays):
            yield pairs(*one)
        release_memory()

    return small_batches(members).mapInArrow(run, "a bigint, b bigint")


def nearest_labels(a: np.ndarray, b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places of the pairs of labels (a, b) that are the nearest, by ``off``, for either label: no more than there are labels."""
    ends, at = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((at, off[at], ends))
    return np.unique(at[order[np.diff(ends[order], prepend=-1) != 0]])


def _tile_pairs(table: pa.Table, least: float, nearest: bool) -> pa.Table:
    """The pairs within the entries of one group of small entries, or between two tiles of a large one, that have different labels and may be similar.

    The folded parities have the last word here. ``nearest`` leaves for each label only its pair of least distance for the sizes.
    """
    table = table.sort_by([("entry", "ascending"), ("cid", "ascending")])
    entry, cid, n, tile, left = (table[c].to_numpy() for c in ("entry", "cid", "n", "tile", "t1"))
    label = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
    f, sketch = _words(table["bits"]), table["sketch"].to_pylist()
    number, width = [int.from_bytes(x, "little") for x in sketch], np.array([len(x) for x in sketch])
    found, held, most = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0, PAIRS_AT_ONCE

    def thinned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, off = (np.concatenate(c) for c in zip(*found))
        keep = nearest_labels(label[i], label[j], off) if nearest else np.unique(np.stack([cid[i], cid[j]], axis=1), axis=0, return_index=True)[1]
        return i[keep], j[keep], off[keep]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal found, held, most
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        ok = may_be_similar(f[i], f[j], n[i], n[j], least)
        i, j = i[ok], j[ok]
        equal = (width[i] == width[j]).tolist()
        off = [(number[x] ^ number[y]).bit_count() if e else parities_differ(sketch[x], sketch[y]) for x, y, e in zip(i.tolist(), j.tolist(), equal)]
        off = np.array(off, np.int64)
        ok = off <= most_apart(n[i], n[j], least)
        i, j, off = i[ok], j[ok], off[ok]
        found.append((i, j, off / (n[i] + n[j])))
        held += len(i)
        if held > most:
            found = [thinned()]
            held = len(found[0][0])
            most = 2 * held + PAIRS_AT_ONCE

    if (table["t2"].to_numpy() != left).any():
        first, second = np.nonzero(tile == left)[0], np.nonzero(tile != left)[0]
        for i in first:
            add(np.full(len(second), i), second)
    else:
        i, step = np.arange(len(entry)), 1
        while len(i := i[i + step < len(entry)]) and len(i := i[entry[i] == entry[i + step]]):
            add(i, i + step)
            step += 1
    i, j, _ = thinned()
    return pa.Table.from_batches([_pair_batch(cid[i], cid[j])])


def _unsettled(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (entry, cid, label, m) of the entries of ``members`` (entry, cid) whose m sets aren't all of one component of ``nodes``."""
    labels = nodes.withColumnRenamed("node", "cid").withColumnRenamed("component", "label")
    labelled = cut(members.select("entry", "cid").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    sizes = labelled.groupBy("entry").agg(F.count("*").alias("m"), F.min("label").alias("l"), F.max("label").alias("h"))
    return cut(labelled.join(sizes.where("l <> h").select("entry", "m"), "entry").select("entry", "cid", "label", "m"))


def _other_pairs(members: DataFrame, classes: DataFrame, least: float, nearest: bool) -> DataFrame:
    """Pairs (a, b) of all members (entry, cid, label, m) that share an entry, have different labels and may be similar.

    Entries of more than TILE members are dealt in hashed tiles that meet by twos, so a task holds no more than two. ``nearest`` thins
    the pairs of a task to the nearest one of each label.
    """
    total = members.count()
    seen = classes.select("cid", "n", "bits", F.coalesce("sketch", "long").alias("sketch"))
    rows = members.join(seen, "cid").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns(
        {
            "t1": F.least("tile", "other"),
            "t2": F.greatest("tile", "other"),
            # the first number says which kind the second is of, so that an entry never meets a pack
            "kind": F.when(F.col("tiles") == 1, 0).otherwise(1),
            "pack": F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("entry"), F.lit(max(1, -(-total // PACK))))).otherwise(F.col("entry")),
        }
    )
    narrow = rows.select("kind", "pack", "t1", "t2", "tile", "entry", "cid", "label", "n", "bits", "sketch")
    return narrow.groupBy("kind", "pack", "t1", "t2").applyInArrow(lambda t: _tile_pairs(t, least, nearest), "a bigint, b bigint").distinct()


def _wanted(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Rows (cid, shingles) of the whole sets that occur in ``pairs``, and of few others.

    The texts are read again, and a bitmap of a fixed size says which sets pairs name, so that the others never move.
    """
    marks = pairs.select(F.explode(F.array("a", "b")).alias("cid")).select(F.pmod("cid", F.lit(MARKS)).alias("at")).distinct()
    named = np.zeros(MARKS, bool)
    named[marks.toArrow().column(0).to_numpy()] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(named))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = {set_id(s): s for s in (shingle_set(x.as_py(), width) for x in batch.column(0))}
        at = {c: c % MARKS for c in sets}
        held = [c for c, k in at.items() if shared.value[k >> 3] >> (7 - (k & 7)) & 1]
        return pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array([sets[c].tobytes() for c in held], pa.binary())], names=["cid", "shingles"]
        )

    found = map_batches(texts, run, "cid bigint, shingles binary")
    return cut(found.groupBy("cid").agg(F.first("shingles").alias("shingles")), narrow=False)


def _not_too_far(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Of ``pairs`` (a, b) those whose long parities don't rule out that their sets are similar."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("n"), F.col("long").alias("p"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("long").alias("q"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        apart = np.array([parities_differ(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())])
        ok = apart <= most_apart(batch.column(2).to_numpy(), batch.column(3).to_numpy(), least)
        return batch.select(["a", "b"]).filter(pa.array(ok))

    return cut(map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "p", "q"), run, "a bigint, b bigint"))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Of ``pairs`` (a, b) those whose whole shingle sets are similar enough."""
    sets = _wanted(pairs, texts, width)
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, t = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ok = [similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= least for x, y in zip(s, t)]
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return cut(map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t"), run, "a bigint, b bigint"))


def _fingerprint_edges(marked: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of ``marked`` (cid, fp) that connect those whose fingerprints are equal or linked by multi-index hashing.

    The least set of each fingerprint stands for it. A set that occurs with several fingerprints connects them.
    """
    hubs = cut(marked.groupBy("fp").agg(F.min("cid").alias("hub")))
    left, right = (hubs.select(F.col("fp").alias(end), F.col("hub").alias(f"hub_{end}")) for end in "ab")
    between = link_edges(hubs.select("fp")).join(left, "a").join(right, "b").select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b"))
    copies = marked.join(hubs, "fp").select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    return cut(copies.unionByName(between).where("a <> b"))


def _components(classes: DataFrame, texts: DataFrame, width: int, least: float, linked: DataFrame | None = None) -> DataFrame:
    """Components (node, component) of classes (cid, n, bits, long, sketch) that are ``linked`` (a, b) or have similar sets; those without a link are left out.

    A first round links each set to the hub that it meets most often. A second one compares what is not in one component then pair by pair, and
    links each component to its nearest ones, since groups are large and one link is enough. What that leaves apart is compared once more, and every
    pair that may be similar is verified.
    """
    n = shuffle_partitions(classes.sparkSession)
    shared = cut(_shared(_entries(texts, width, least).repartition(n, "entry").sortWithinPartitions("entry", "cid")))
    seen = classes.select("cid", "n", "bits")
    members = shared.join(seen, "cid").select("entry", "cid", "n", "bits")
    met = _hub_pairs(members.repartition(n, "entry").sortWithinPartitions("entry", "cid"), least).groupBy("a", "b").count()
    pairs = cut(met.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select("best.a", "b"))
    edges = _verified(_not_too_far(pairs, classes, least), texts, width, least)
    edges = edges if linked is None else linked.unionByName(edges)
    nodes = cut(connected_components(edges))
    members = shared
    for nearest in (True, False):
        members = _unsettled(members, nodes)
        others = cut(_other_pairs(members, classes, least, nearest))
        if others.isEmpty():
            break
        more = _verified(others, texts, width, least)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            nodes = cut(connected_components(edges))
    return nodes


def distinct_documents(
    docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text: str = "text", by_fingerprint: bool = False
) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id (null ids last).

    Documents are linked if the whole sets of their ``width``-word shingles have a Jaccard similarity of ``least`` or more; ``by_fingerprint``, those
    whose SimHash fingerprints differ in 2 bits or fewer are linked first, found by multi-index hashing as in ``near_duplicates``. Shingles
    are 32-bit hashes. Each set is dealt in more parts than two similar sets can differ in members, so similar ones have an equal part;
    of those that share one, all pairs that links don't connect yet are compared. Equal sets are one class, so texts without words
    (null, empty) are one group; of repeated rows one stays. All columns are kept, whatever their names. An empty
    table stays empty. ``docs`` is read several times and must give the same rows in the same partitions, as files do.
    """
    numbered = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = _sets(slim, width, by_fingerprint)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    alike = [F.first(c).alias(c) for c in ("n", "bits", "long", "sketch")]
    marked = rows.withColumn("first", order)
    if by_fingerprint:
        marked = cut(marked.groupBy("cid", "fp").agg(F.min("first").alias("first"), *alike))
    classes = cut(marked.groupBy("cid").agg(F.min("first").alias("first"), *alike))
    linked = _fingerprint_edges(marked.select("cid", "fp")) if by_fingerprint else None
    nodes = _components(classes, slim.select("text"), width, least, linked).withColumnRenamed("node", "cid")
    grouped = classes.select("cid", "first").join(nodes, "cid", "left").select(F.coalesce("component", "cid").alias("component"), "first")
    kept = grouped.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return numbered.join(kept, "row", "left_semi").select("doc.*")
