"""Token ids in fixed-width bit-packed files.

A file set is a Parquet folder of blocks, in ascending document order. A block holds whole documents: their ids, each in the
fewest bits that the vocabulary needs, one after another without gaps, and where each document ends. So
a block unpacks with a few numpy operations, and one document is read from its own bits only.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, release_memory, scratch_path, slices, small_batches
from tallyforge.llm.pieces import WordMemo
from tallyforge.llm.pretokens import split

#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Bytes of text for one shard (a sorted run of blocks, written by one task).
SHARD_BYTES = 48 << 20
#: Shards at most, and rows (doc_id, hash, number) that the driver draws for each of them to place their bounds: 10^6 rows at most.
MOST_SHARDS, DRAWN = 50_000, 20
#: Characters of texts encoded at a time.
STEP_CHARS = 8 << 20
#: Rows of texts, or of blocks of about BLOCK_IDS ids, that a Parquet reader decodes at a time on the heap.
READ_ROWS = 64


def id_width(vocabulary: int) -> int:
    """The bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` at ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):  # the same bits, without spreading them
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    step = 1 << 16  # a multiple of 8 ids, so that parts end on whole bytes
    for at in range(0, len(ids), step):
        part = ids[at : at + step].astype("<u4").view(np.uint8).reshape(-1, 4)
        bits = np.unpackbits(part, axis=1, count=width, bitorder="little")
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a payload, as unsigned 32-bit numbers; reads their own bytes only."""
    if not n:
        return np.empty(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", n, first * width // 8).astype(np.uint32)
    out, step = [], 1 << 16
    for at in range(first, first + n, step):
        k = min(step, first + n - at)
        lo, hi = at * width, (at + k) * width
        raw = np.frombuffer(payload, np.uint8, -(-hi // 8) - lo // 8, lo // 8)
        bits = np.unpackbits(raw, bitorder="little")[lo % 8 : lo % 8 + k * width].reshape(k, width)
        wide = np.zeros((k, 32), np.uint8)
        wide[:, :width] = bits
        out.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out)


class Encoder:
    """A tokenizers file with byte-level words, each distinct one encoded once. Strings of added tokens get those tokens' ids, as in the library."""

    held: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        #: texts with one of these are left to the library as a whole
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.vocabulary = self.tokenizer.get_vocab_size()
        #: the letter that byte-level vocabularies write for each byte: printable ones for themselves, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}
        #: ids as they are kept until they are packed
        self.small = np.dtype("<u2" if id_width(self.vocabulary) <= 16 else "<u4")
        self.memo = WordMemo(split, self._words, self.small.str)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Each word is one match of the pattern, so it goes to the tokenizer's model without its splitter, in byte-level letters."""
        tokenize, small, spell = self.tokenizer.model.tokenize, self.small, self.letters
        blank = spell[ord(" ")]
        made = []
        for w in words:
            letters = w.decode("latin-1")
            letters = letters.replace(" ", blank) if w.isascii() and letters.isprintable() else letters.translate(spell)
            made.append([t.id for t in tokenize(letters)])
        size = np.fromiter(map(len, made), np.int64, len(made)) * small.itemsize
        raw, ends = np.fromiter(chain.from_iterable(made), small).tobytes(), np.cumsum(size).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as numbers of type ``small``."""
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if not special:
            return self.memo.texts(texts)
        apart = set(special)
        plain = iter(self.memo.texts([t for i, t in enumerate(texts) if i not in apart]))
        whole = iter(self.tokenizer.encode_batch([texts[i] for i in special], add_special_tokens=False))
        return [np.array(next(whole).ids, self.small).tobytes() if i in apart else next(plain) for i in range(len(texts))]


def short_reads(df: DataFrame) -> DataFrame:
    """``df``, with its session set to decode READ_ROWS rows of Parquet at a time: the usual 4096 rows of texts or blocks are large arrays that fill the heap."""
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return df


def _bounds(docs: DataFrame) -> list[tuple]:
    """Shard bounds over (doc_id, text hash, row), from a drawn sample of about DRAWN rows for each shard."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(1, min(MOST_SHARDS, round((size or 0) / SHARD_BYTES)))
    if shards == 1:
        return []
    drawn = docs.where(F.rand(7) < min(1.0, DRAWN * shards / n)).select("doc_id", "h", "r").collect()
    keys = sorted((r.doc_id is not None, r.doc_id or 0, r.h, r.r) for r in drawn)
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every whole text of ``docs`` (doc_id, text), append ``end_id`` and write blocks by ascending doc_id.

    The tokenizer is a byte-level one that splits texts by ``pretokens.PATTERN``.

    Null texts count as empty, null ids come first, rows that share an id follow each other by the hash of
    their text; equal rows may lie in several shards. Texts of any length are encoded whole, a long one being a block of its own.
    Other columns, whatever their names, play no part. An empty table writes an empty file set.
    """
    docs = short_reads(small_batches(docs)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("r"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    bounds = _bounds(docs)

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts, hashes, numbers = (batch.column(i).to_pylist() for i in range(4))
        encoder = Encoder.at(tokenizer)
        end = np.array([end_id], encoder.small).tobytes()
        for a, b in slices([len(t) for t in texts], STEP_CHARS):
            made = [x + end for x in encoder.encode(texts[a:b])]
            shard = [bisect_right(bounds, (d is not None, d or 0, h, r)) for d, h, r in zip(ids[a:b], hashes[a:b], numbers[a:b])]
            blobs = [pa.compress(x, codec="zstd", asbytes=True) for x in made]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard, pa.int32()),
                    pa.array(ids[a:b], pa.int64()),
                    pa.array(hashes[a:b], pa.int64()),
                    pa.array(numbers[a:b], pa.int64()),
                    pa.array([len(x) // encoder.small.itemsize for x in made], pa.int64()),
                    pa.array(blobs, pa.binary()),
                ],
                names=["shard", "doc_id", "h", "r", "n", "ids"],
            )

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from encode(batch)
            release_memory()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        width = id_width(encoder.vocabulary)
        state = {"shard": None, "ids": [], "docs": [], "ends": [], "first": 0, "block": 0, "held": 0}

        def close() -> pa.RecordBatch:
            flat = np.concatenate(state["ids"])
            out = pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": state["shard"], "block": state["block"], "first": state["first"], "n_ids": len(flat),
                        "width": width, "low": min((d for d in state["docs"] if d is not None), default=None),
                        "high": state["docs"][-1], "doc_ids": state["docs"], "ends": state["ends"], "payload": pack(flat, width),
                    }
                ],
                schema=BLOCK_SCHEMA,
            )
            state.update(ids=[], docs=[], ends=[], first=state["first"] + len(flat), block=state["block"] + 1, held=0)
            return out

        for batch in batches:
            for shard, doc_id, n, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5))):
                if shard != state["shard"]:
                    if state["held"]:
                        yield close()
                    state.update(shard=shard, first=0, block=0)
                raw = pa.decompress(blob, n * encoder.small.itemsize, codec="zstd", asbytes=True)
                state["ids"].append(np.frombuffer(raw, encoder.small))
                state["docs"].append(doc_id)
                state["held"] += n
                state["ends"].append(state["held"])
                if state["held"] >= BLOCK_IDS:
                    yield close()
        if state["held"]:
            yield close()

    encoded = docs.select("doc_id", "text", "h", "r").mapInArrow(
        encode_all, "shard int, doc_id bigint, h bigint, r bigint, n bigint, ids binary"
    )
    placed = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "h", "r")
    placed.mapInArrow(
        blocks,
        "shard int, block int, first bigint, n_ids bigint, width int, low bigint, high bigint, doc_ids array<bigint>, ends array<bigint>, payload binary",
    ).write.option("compression", "zstd").parquet(path)


BLOCK_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
        ("low", pa.int64()), ("high", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of a file set, unpacked from its blocks.

    ``start`` counts the ids of all documents before. The totals of the shards (a few numbers
    each, as many as there are files) are summed in order and broadcast.
    """
    blocks = short_reads(spark.read.parquet(path))
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row per file
    base, at = {}, 0
    for r in sorted(totals):
        base[r.shard], at = at, at + r.n

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
        for b in batch.to_pylist():
            flat = unpack(b["payload"], b["width"], 0, b["n_ids"]).astype("<u4")
            start = 0
            for doc_id, end in zip(b["doc_ids"], b["ends"]):
                own = flat[start:end]
                out["doc_id"].append(doc_id)
                out["start"].append(base[b["shard"]] + b["first"] + start)
                out["n_tokens"].append(end - start)
                out["ids_crc32"].append(zlib.crc32(own.tobytes()))
                if ids:
                    out["ids"].append(own.tolist())
                start = end
        if not ids:
            del out["ids"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * ids
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return map_batches(
        blocks, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id (several if it repeats): only their own bits are unpacked, and of the other blocks no more is read than their least and greatest doc_id."""
    there = (F.col("low") <= doc_id) & (F.col("high") >= doc_id)
    hits = spark.read.parquet(path).where(there & F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("shard", "block")
    found = []
    for b in hits.toLocalIterator():
        for i, d in enumerate(b.doc_ids):
            if d == doc_id:
                start = b.ends[i - 1] if i else 0
                found.append(unpack(bytes(b.payload), b.width, start, b.ends[i] - start).tolist())
    return found


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
