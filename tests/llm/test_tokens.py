"""Byte-level BPE and token files against the libraries they follow."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import bpe, pieces, pretokens, tokenfiles

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "٣", "!", "　", "\x85", "\x1c", "日", "😀", "'s", "the", "<|endoftext|>"]
ODD = ["", " ", "a  b   c \n d\n\n  e", "don't I'll 'S we've", "x\n \ny", "a \n", "\r\n\r\n a", "日本語 テスト", "word " * 3, "　 b　"]


def fuzz(n, longest=16, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, longest))) for _ in range(n)]


def test_pattern_is_the_public_one():
    assert pretokens.PATTERN == public_tokenizers.PATTERN


def test_split_is_the_pattern():
    texts, find = ODD + fuzz(20000), regex.compile(pretokens.PATTERN).findall
    words, numbers, ends = pretokens.split(texts)
    start = 0
    for text, end in zip(texts, ends):
        assert [words[i].decode() for i in numbers[start:end]] == find(text)
        start = end
    assert pretokens.split([])[0] == [] and pretokens.split(["", ""])[0] == []


def test_number_words():
    texts = ["a b", "", "b  a\n", " b"]
    words, numbers, ends = pieces.number_words(texts, str.split)
    got = [[words[i] for i in numbers[a:b]] for a, b in zip([0, *ends[:-1]], ends)]
    assert got == [["a", "b"], [], ["b", "a"], ["b"]]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_fold_as_the_library_does(spark, tik):
    r = random.Random(3)
    words = [" there", "unbelievable", "Straße", "日本語", "=" * 400, "ab" * 200, "".join(r.choices("abcdefgh", k=700)), "a" * 97, "x", "é" * 60]
    table = bpe.RankMap(bpe.load_ranks(RANKS))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    made = df.select("w", table.bind("array<int>", lambda rank: bpe.encode_word(F.encode("w", "utf-8"), rank)).alias("ids")).collect()
    for row in made:
        assert row.ids == tik._core_bpe.encode_single_piece(row.w.encode()), row.w[:20]


def test_both_folds_agree(spark):
    table = bpe.RankMap(bpe.load_ranks(RANKS))
    words = [w for w in pretokens.split(fuzz(400, seed=5) + ["internationalisation queleque stbleing"])[0] if 1 < len(w) <= bpe.LONG]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary")
    first = table.bind("array<int>", lambda rank: bpe._fold_first(F.col("w"), rank))
    every = table.bind("array<int>", lambda rank: bpe._fold_all(F.col("w"), rank, True))
    assert df.where(first != every).count() == 0


def test_ranks_out_of_order_fold_one_by_one(spark):
    """A merge of rank 9 that makes a pair of rank 5: merging all pairs of rank 9 at once would not be the same."""
    ranks = {bytes([b]): 20 + b for b in range(256)} | {b"ab": 9, b"aba": 5}
    assert not bpe.merges_in_order(ranks) and bpe.merges_in_order({bytes([b]): b for b in range(256)} | {b"ab": 300, b"aba": 301})
    words = [b"ab" * 60, b"abab" * 40 + b"c", b"aab" * 50]
    lib = tiktoken.Encoding("t", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
    table = bpe.RankMap(ranks)
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary")
    made = df.select(table.bind("array<int>", lambda rank: bpe.encode_word(F.col("w"), rank, table.in_order)).alias("x")).collect()
    assert all(len(w) > bpe.LONG for w in words) and [r.x for r in made] == [lib.encode_ordinary(w.decode()) for w in words]


def test_documents_encode_and_decode(spark, docs, tik):
    rows = list(enumerate(ODD + fuzz(300, 40))) + [(7, None), (None, "null id"), (1, "again"), (1, "again")]
    ranks = bpe.load_ranks(RANKS)
    out = bpe.encode(docs(rows), ranks).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in out)
    want = sorted((i if i is not None else -1, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert got == want
    by_rank = {v: k for k, v in ranks.items()}
    pieces_ = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
    assert bpe.decode(bytes(out[0].ids), pieces_) == bytes(out[0].decoded)
    r = bpe.encode(docs([(1, "some text, twice")]), ranks, digests=True).first()
    ids = tik.encode_ordinary("some text, twice")
    assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(docs([]), ranks).count() == 0


def test_an_empty_draw_has_no_words(spark):
    narrow = spark.createDataFrame([(1, "some long words " * 50)], "__id long, __text string")
    words = bpe.common_words(narrow, bpe.RankMap(bpe.load_ranks(RANKS)), most_bytes=1e-9)
    assert words.find([b"some"], [])[0].tolist() == [0]


def test_what_a_hash_finds_must_spell_the_word():
    words = bpe.Words(np.array([bpe.xxh64_intdigest(b"ab"), bpe.xxh64_intdigest(b"zz")], np.uint64), np.array([1, 1]), np.array([0, 1], np.uint32))
    size, flat = words.find([b"ab", b"zz", b"q"], [b"ab", b"other"])
    assert size.tolist() == [1, 0, 0] and flat.tolist() == [0]


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 70001).astype(np.uint32)
    raw = tokenfiles.pack(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    for first, n in ((0, 70001), (5, 1), (65530, 4000), (70000, 1), (9, 0)):
        assert np.array_equal(tokenfiles.unpack(raw, width, first, n), ids[first : first + n])


def test_id_width():
    assert [tokenfiles.id_width(n) for n in (1, 2, 3, 256, 257, 50257, 65536)] == [1, 1, 2, 8, 9, 16, 16]


@pytest.mark.parametrize("shard_bytes", [tokenfiles.SHARD_BYTES, 2000])
def test_token_files(spark, docs, tmp_path, monkeypatch, shard_bytes):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", shard_bytes)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i * 3, t) for i, t in enumerate(ODD + fuzz(200, 60) + ["long words here " * 3000])] + [(2, None), (None, "first"), (2, "b"), (2, "b")]
    rows += [(5000 + i, t) for i, t in enumerate(["<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "x<|endoftext|>y" * 50])]
    rows += [(7000, "one document many times")] * 300
    random.Random(1).shuffle(rows)
    where = str(tmp_path / "tokens")
    tokenfiles.write_token_files(docs(rows).repartition(3), where, path)
    out = tokenfiles.read_token_files(spark, where, ids=True).orderBy("start").collect()
    tok = Tokenizer.from_file(path)
    encode = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert sorted(map(tuple, (r.ids for r in out))) == sorted(tuple(encode(t)) for _, t in rows)
    at = 0
    for r in out:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert tokenfiles.read_document(spark, where, 0) == [encode(ODD[0])] and len(tokenfiles.read_document(spark, where, 2)) == 3
    assert tokenfiles.read_document(spark, where, 5001) == [encode("a <|endoftext|><|endoftext|> b")] and 50256 in encode("<|endoftext|>")
    blocks = spark.read.parquet(where)
    assert (blocks.select("shard").distinct().count() == 1) == (shard_bytes != 2000)
    if shard_bytes == 2000:  # copies of one document are split
        assert blocks.where("low = 7000 and high = 7000").select("shard").distinct().count() > 1
    assert blocks.where("n_ids > 65536 * 2").count() == 0 and blocks.first().width == 16
    empty = str(tmp_path / "empty")
    tokenfiles.write_token_files(docs([]), empty, path)
    assert tokenfiles.read_token_files(spark, empty).count() == 0


def test_a_waiting_task_holds_no_split_texts():
    """What splitting a block leaves in Python's and Arrow's pools goes back to the system before the block is yielded."""
    held = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1]) >> 10
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(500)) for _ in range(1200)]
    pretokens.split(texts[:1])
    before = held()
    batch = bpe._alone(pa.RecordBatch.from_arrays([pa.array([len(pretokens.split(texts)[0])])], names=["n"]))
    assert batch.column(0)[0].as_py() > 100_000 and held() < before + 40


def test_token_files_are_read_a_few_blocks_at_a_time(spark, docs, tmp_path):
    """No array of the reader holds more than READ_ROWS blocks, whose payloads are 128 KiB each."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(name)
    where = str(tmp_path / "tokens")
    tokenfiles.write_token_files(docs([(i, f"text {i}") for i in range(300)]), where, public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenfiles.read_token_files(spark, where).count() == 300
    most = int(spark.conf.get(name)) * tokenfiles.BLOCK_IDS * 2
    spark.conf.unset(name)
    assert most <= 8 << 20
