"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over the bytes of distinct words."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyforge.llm.common import release_memory, slices, small_batches
from tallyforge.llm.pieces import Strings, no_collection
from tallyforge.llm.pretokens import split

#: Maps that the rank literal is made of: a rank is found in the map that the crc32 of its bytes names (a power of 2).
MAPS = 4096
#: Words of more bytes merge all pairs of the lowest rank at each step, where the ranks allow it; the cuts of others fit 7 bits.
LONG = 96
#: Characters of consecutive documents whose distinct words are numbered together.
BLOCK_CHARS = 4 << 20
#: Text of the drawn documents whose words are folded beforehand.
COMMON_BYTES = 96 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_in_order(ranks: dict[bytes, int]) -> bool:
    """Whether a merge of these ranks never makes a pair of a lower rank than its own.

    If one did, in some word, the bytes of that pair would be a token. What happens within those bytes is the same when they stand alone, since nothing
    has merged across their ends. So it is enough to merge the bytes of each token, and to see that the ranks only rise.
    """
    for token in ranks:
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            found = [(ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
            if not found:
                break
            rank, i = min(found)
            if rank < last:
                return False
            parts[i : i + 2], last = [parts[i] + parts[i + 1]], rank
    return True


Rank = Callable[[Column], Column]


class RankMap:
    """The ranks as a literal: an array of small maps from hexadecimal bytes to ranks, folded to a constant by the optimizer."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
        for token, rank in ranks.items():
            maps[zlib.crc32(token) % MAPS][token.hex().upper()] = rank
        self.text = json.dumps(maps, separators=(",", ":"))
        self.in_order = merges_in_order(ranks)

    def bind(self, kind: str, body: Callable[[Rank], Column]) -> Column:
        """``body``, of type ``kind``, given a function that finds the rank of some bytes (null if they are no token).

        A fold over one element binds the literal to a name, so that a plan holds it once however often it is used.
        """

        def within(_: Column, table: Column) -> Column:
            return body(lambda token: F.element_at(F.get(table, F.crc32(token).bitwiseAND(F.lit(MAPS - 1)).cast("int")), F.hex(token)))

        literal = F.from_json(F.lit(self.text), "array<map<string,int>>")
        return F.aggregate(F.array(literal), F.array().cast(kind), within)


def _between(word: Column, start: Column, end: Column) -> Column:
    return F.substring(word, start + 1, end - start)


def _ids(word: Column, cuts: Column, rank: Rank) -> Column:
    """The ranks of the parts between consecutive ``cuts``."""
    starts = F.slice(cuts, F.lit(1), F.size(cuts) - 1)
    return F.transform(starts, lambda a, i: rank(_between(word, a, F.get(cuts, i + 1))))


def _fold_first(word: Column, rank: Rank) -> Column:
    """Merge the first pair of the lowest rank until no pair has one.

    The fold holds the cuts between parts, and each pair that has a rank as one number (rank, then its three
    cuts of 7 bits each), so that the least number is the pair to merge. Steps go by twos: one notes the cuts of the least
    pair, the next removes its middle cut and looks up the two pairs beside it. (Noting them in the state is
    far cheaper than nested folds, each of which copies the state.)
    """
    n = F.length(word)

    def pair(a: Column, m: Column, b: Column) -> Column:
        cuts = a * F.lit(1 << 14) + m * F.lit(1 << 7) + b
        return rank(_between(word, a, b)).cast("long") * F.lit(1 << 21) + cuts

    def cut(p: Column, shift: int) -> Column:
        return (F.shiftright(p, shift) if shift else p).bitwiseAND(F.lit(127).cast("long")).cast("int")

    def ranked(pairs: Column) -> Column:
        return F.filter(pairs, lambda p: p.isNotNull())

    nothing = F.lit(None).cast("int")
    start = F.struct(
        F.sequence(F.lit(0), n).alias("cuts"),
        ranked(F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(i, i + 1, i + 2))).alias("pairs"),
        nothing.alias("a"),
        nothing.alias("m"),
        nothing.alias("b"),
    )

    def note(state: Column) -> Column:
        least = F.array_min(state["pairs"])
        held = (state["cuts"].alias("cuts"), state["pairs"].alias("pairs"))
        return F.struct(*held, cut(least, 14).alias("a"), cut(least, 7).alias("m"), cut(least, 0).alias("b"))

    def merge(state: Column) -> Column:
        a, m, b = state["a"], state["m"], state["b"]
        wide_a, wide_b = a.cast("long"), b * F.lit(1 << 14).cast("long")
        low, middle = F.lit(127).cast("long"), F.lit(127 << 14).cast("long")
        apart = F.filter(state["pairs"], lambda p: (p.bitwiseAND(low) <= wide_a) | (p.bitwiseAND(middle) >= wide_b))
        before = F.array_max(F.filter(state["cuts"], lambda c: c < a))
        after = F.array_min(F.filter(state["cuts"], lambda c: c > b))
        both = F.array_append(F.array_append(apart, pair(before, a, b)), pair(a, b, after))
        return F.struct(
            F.array_remove(state["cuts"], m).alias("cuts"), ranked(both).alias("pairs"),
            a.alias("a"), m.alias("m"), b.alias("b"),
        )

    def step(state: Column, i: Column) -> Column:
        return F.when(F.size(state["pairs"]) == 0, state).when(i.bitwiseAND(F.lit(1)) == 1, note(state)).otherwise(merge(state))

    return F.aggregate(F.sequence(F.lit(1), 2 * n - 2), start, step, lambda state: _ids(word, state["cuts"], rank))


def _fold_all(word: Column, rank: Rank, in_order: bool) -> Column:
    """Merge at each step all pairs of the lowest rank, from the left and without overlap, if merges are ``in_order``; else the first pair.

    The former gives the same ids where a merge never makes a pair of a lower rank, which ``merges_in_order`` finds out. The
    number of steps then is that of the different ranks that occur, not of the bytes, so very long words stay feasible.
    """

    def step(cuts: Column, _: Column) -> Column:
        inner = F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 2, F.lit(0)))
        found = F.transform(inner, lambda a, i: rank(_between(word, a, F.get(cuts, i + 2))))

        def merge(cuts: Column, found: Column) -> Column:
            def marked(cuts: Column, least: Column) -> Column:
                if not in_order:
                    first = F.array_position(found, least)
                    return F.when(least.isNull(), cuts).otherwise(F.filter(cuts, lambda c, i: i != first))
                marks = F.array_join(F.transform(found, lambda r: F.when(r.eqNullSafe(least), "1").otherwise("0")), "")
                taken = F.split(F.regexp_replace(marks, "11", "10"), "")

                def drop(cuts: Column, taken: Column) -> Column:
                    kept = F.filter(cuts, lambda c, i: (i == 0) | ~F.coalesce(F.get(taken, i - 1) == "1", F.lit(False)))
                    return kept

                return F.when(least.isNull(), cuts).otherwise(F.aggregate(F.array(taken), cuts, drop))

            return F.aggregate(F.array(F.array_min(found)), cuts, marked)

        return F.aggregate(F.array(found), cuts, merge)

    n = F.length(word)
    # once a step has changed nothing, the later ones only compare two sizes
    start = F.struct(F.sequence(F.lit(0), n).alias("cuts"), F.lit(-1).alias("was"))

    def guarded(state: Column, i: Column) -> Column:
        moved = F.struct(step(state["cuts"], i).alias("cuts"), F.size(state["cuts"]).alias("was"))
        return F.when(F.size(state["cuts"]) == state["was"], state).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), n), start, guarded, lambda state: _ids(word, state["cuts"], rank))


def encode_word(word: Column, rank: Rank, in_order: bool = False) -> Column:
    """The ids of one word's bytes (a match of the pattern), as array<int>; of null or no bytes: empty."""
    whole = rank(word)
    n = F.length(word)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast("array<int>"))
        .when(whole.isNotNull(), F.array(whole))
        .when(n <= LONG, _fold_first(word, rank))
        .otherwise(_fold_all(word, rank, in_order))
    )


class Words:
    """Words that are encoded beforehand, found by a 64-bit hash; what a hash finds must also spell the word."""

    def __init__(self, hashes: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        start = (np.cumsum(size, dtype=np.int64) - size).astype(np.uint32)
        order = np.argsort(hashes)
        self.hashes, self.size, self.start, self.flat = hashes[order], size[order].astype(np.uint32), start[order], flat

    def find(self, words: list[bytes], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word how many ids it has (0: not found), and these ids, one word after another."""
        size = np.zeros(len(words), np.int64)
        if not len(self.hashes) or not words:
            return size, self.flat[:0]
        asked = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        hit = np.nonzero(self.hashes[at] == asked)[0]
        n, start = self.size[at[hit]].astype(np.int64), self.start[at[hit]].astype(np.int64)
        upto = np.cumsum(n)
        flat = self.flat[np.arange(n.sum()) + np.repeat(start - (upto - n), n)]
        ids, spelt, a = flat.tolist(), [], 0
        for b in upto.tolist():
            spelt.append(b"".join(map(pieces.__getitem__, ids[a:b])))
            a = b
        right = np.array([s == words[i] for s, i in zip(spelt, hit.tolist())], bool)
        size[hit] = n * right
        return size, flat[np.repeat(right, n)]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of consecutive documents, about ``most`` characters at a time."""
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in slices([len(t) for t in texts], most):
            yield batch.column(0).slice(a, b - a), texts[a:b]
        release_memory()


def _alone(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``batch``, once what it was made of is given back to the system: a task waits here while the JVM works on what it yields."""
    release_memory()
    return batch


def _lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and joined numbers of a column of number lists."""
    offsets = lists.offsets.to_numpy()
    return np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype("<u4")


def common_words(narrow: DataFrame, table: RankMap, most_bytes: int = COMMON_BYTES) -> Words:
    """The distinct words of a drawn part of the documents, of about ``most_bytes`` at most, each folded once.

    This only saves folding them again in every block. The part is bounded, and so are the words that go to the
    driver and to the executors.
    """
    n, size = narrow.agg(F.count("*"), F.sum(F.octet_length("__text"))).first()
    if not size:
        return Words(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32))
    part = narrow if size <= most_bytes else narrow.where(F.rand(11) < most_bytes / size)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks(batches, BLOCK_CHARS):
            yield _alone(pa.RecordBatch.from_arrays([pa.array(split(texts)[0], pa.binary())], names=["word"]))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            hashes = np.fromiter(map(xxh64_intdigest, names), np.uint64, len(names))
            size, flat = _lists(batch.column(1))
            columns = [pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True)], pa.binary()) for x in (hashes, size.astype("<i4"), flat)]
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64()), pa.array([len(flat)], pa.int64()), *columns], names=["n", "m", "h", "s", "f"])

    distinct = part.select("__id", "__text").mapInArrow(words, "word binary").distinct()
    folded = distinct.select("word", table.bind("array<int>", lambda rank: encode_word(F.col("word"), rank, table.in_order)).alias("made"))
    rows = folded.mapInArrow(packed, "n bigint, m bigint, h binary, s binary, f binary").collect()
    if not rows:  # the draw can miss all of a few long documents
        return Words(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32))
    unpack = lambda blob, k, kind: np.frombuffer(pa.decompress(blob, k * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
    return Words(
        np.concatenate([unpack(bytes(r.h), r.n, "<u8") for r in rows]),
        np.concatenate([unpack(bytes(r.s), r.n, "<i4") for r in rows]).astype(np.int64),
        np.concatenate([unpack(bytes(r.f), r.m, "<u4") for r in rows]),
    )


def encode(
    docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text: str = "text", digests: bool = False
) -> DataFrame:
    """Rows (id, ids, decoded) for each whole text: its token ids as little-endian unsigned 32-bit numbers, and the bytes they decode to.

    With ``digests``: (id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256). One row per
    input row; a null text counts as empty and has no ids. Null ids and repeated rows are kept; an empty table gives an empty
    one; texts and words of any length are read whole. Special
    tokens are not known, so their strings are ordinary text. Texts are split by ``pretokens.PATTERN``.

    Documents are taken in blocks, whose distinct words are numbered. Words that a drawn part of the corpus
    shares are folded once beforehand; the other words of a block are folded in its row, and its documents are
    then spelt by word numbers. Nothing is shuffled but the words of the drawn part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = small_batches(docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__text")))
    table = RankMap(ranks)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    context = docs.sparkSession.sparkContext
    shared, spelling = context.broadcast(common_words(narrow, table)), context.broadcast(pieces)

    def number(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        with no_collection():
            words, numbers, ends = split(texts)
            size, flat = shared.value.find(words, spelling.value)
            rest = [words[i] for i in np.nonzero(size == 0)[0].tolist()]
        raw = numbers.astype("<i4").tobytes()
        offsets = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, ids),
                pa.array([ends.astype("<i8").tobytes()], pa.binary()),
                pa.array([len(raw)], pa.int64()),
                pa.array([pa.compress(raw, codec="lz4", asbytes=True)], pa.binary()),
                pa.array([size.astype("<i4").tobytes()], pa.binary()),
                pa.array([flat.astype("<u4").tobytes()], pa.binary()),
                pa.array([rest], pa.list_(pa.binary())),
            ],
            names=["ids", "ends", "bytes", "numbers", "size", "flat", "rest"],
        )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches, BLOCK_CHARS):
            block = number(ids, texts)
            del ids, texts
            yield _alone(block)

    def spell_block(ids: pa.Array, made: pa.ListArray, ends: bytes, bytes_: int, numbers: bytes, size: bytes, flat: bytes, spell: Strings, decimal: Strings) -> pa.RecordBatch:
        size = np.frombuffer(size, "<i4").astype(np.int64)
        new = size == 0
        size[new], made = _lists(made)
        every = np.empty(int(size.sum()), "<u4")
        mine = np.repeat(new, size)
        every[~mine] = np.frombuffer(flat, "<u4")
        every[mine] = made
        sequence = np.frombuffer(pa.decompress(numbers, bytes_, codec="lz4", asbytes=True), "<i4")
        tokens = list(Strings(every, size).join(sequence, np.frombuffer(ends, "<i8")))
        flat_tokens = np.concatenate(tokens) if tokens else every
        until = np.cumsum([len(x) for x in tokens])
        if digests:
            out = [
                pa.array([len(x) for x in tokens], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()[:-1]).hexdigest() for x in decimal.join(flat_tokens, until)]),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in spell.join(flat_tokens, until)]),
            ]
        else:
            out = [pa.array([x.tobytes() for x in tokens], pa.binary()), pa.array([x.tobytes() for x in spell.join(flat_tokens, until)], pa.binary())]
        return pa.RecordBatch.from_arrays([ids, *out], names=[id_col, *(("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Strings.of_bytes(spelling.value)
        decimal = Strings.of_bytes([b"%d," % i for i in range(len(spelling.value))])
        for batch in batches:
            column = lambda name, held=batch: held.column(held.schema.get_field_index(name))
            for row in range(batch.num_rows):
                told = (column(c)[row].as_py() for c in ("ends", "bytes", "numbers", "size", "flat"))
                yield _alone(spell_block(column("ids")[row].values, column("made")[row].values, *told, spell, decimal))

    blocks = narrow.mapInArrow(numbered, f"ids array<{kind}>, ends binary, bytes bigint, numbers binary, size binary, flat binary, rest array<binary>")
    folded = blocks.withColumn("made", table.bind("array<array<int>>", lambda rank: F.transform("rest", lambda w: encode_word(w, rank, table.in_order)))).drop("rest")
    result = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    return folded.mapInArrow(spelt, f"`{id_col}` {kind}, {result}")


def decode(ids: bytes, pieces: list[bytes]) -> bytes:
    """The bytes of little-endian unsigned 32-bit ids: their pieces, one after another."""
    return b"".join(pieces[i] for i in np.frombuffer(ids, "<u4"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode(docs, ranks, digests=True)
