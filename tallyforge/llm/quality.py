"""Quality: a factorisation machine over hashed words, structure statistics and metadata, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyforge.llm.common import release_memory, slices, small_batches
from tallyforge.llm.pieces import no_collection, number_words
from tallyforge.llm.toxicity import labelled_sample, not_held_out, words_of

#: Labelled documents of each class that are learned from, and the text they may hold in all.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 32 << 20
#: Hashed word features, factors of an interaction, and buckets of each statistic.
WORD_BITS, FACTORS, BUCKETS = 18, 6, 12
STEP_CHARS = 4 << 20
#: Training steps at least, where there are few labels.
LEAST_STEPS = 500

CLASSES = np.zeros(256, np.uint8)  # the kinds of bytes whose shares are statistics
for kind, members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#%&*$@^~=+_<>/\\"), 1):
    CLASSES[list(members)] = kind
N_KINDS = 9
STATISTICS = N_KINDS - 1 + 7


def statistics(texts: list[str], n_chars: list[int | None], numbers: np.ndarray, ends: np.ndarray, distinct: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A row of statistics for each text: shares of kinds of bytes, lengths, repetition, and its metadata."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(texts), STATISTICS))
    kinds = CLASSES[np.frombuffer(b"".join(raw), np.uint8)]
    owner_at = np.cumsum(size)[:-1]
    for i, part in enumerate(np.split(kinds, owner_at) if len(texts) else []):
        out[i, : N_KINDS - 1] = np.bincount(part, minlength=N_KINDS)[1:] / max(1, len(part))
    n = np.diff(ends, prepend=0)
    words = np.maximum(n, 1)
    at = N_KINDS - 1
    out[:, at] = np.log1p(size) / 12
    out[:, at + 1] = np.minimum(size / words, 30) / 30
    out[:, at + 2] = distinct / words
    out[:, at + 3] = top / words
    lines = [t.split("\n") for t in texts]
    out[:, at + 4] = [1 - len(set(x)) / len(x) for x in lines]
    out[:, at + 5] = [np.log1p(len(t) / len(x)) / 12 for t, x in zip(texts, lines)]
    out[:, at + 6] = [np.log1p(max(0, len(t) if c is None else c)) / 12 for t, c in zip(texts, n_chars)]
    return out


@dataclass
class Rows:
    """Sparse feature rows: ``index`` and ``value`` of row i end at ``ends[i]``."""

    index: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    def take(self, some: np.ndarray) -> Rows:
        begins = np.concatenate([[0], self.ends[:-1]])
        n = self.ends[some] - begins[some]
        at = np.arange(n.sum()) + np.repeat(begins[some] - (np.cumsum(n) - n), n)
        return Rows(self.index[at], self.value[at], np.cumsum(n))


@dataclass
class Buckets:
    """Bounds that cut each statistic into buckets, from quantiles of the sample."""

    bounds: np.ndarray

    def features(self, texts: list[str], n_chars: list[int | None]) -> Rows:
        """Each distinct word (its share of the words, square-rooted) and each statistic's bucket (1)."""
        words, numbers, ends = number_words(texts, words_of)
        code = np.fromiter((xxh64_intdigest(w, 11) >> (64 - WORD_BITS) for w in words), np.int64, len(words))
        n = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(texts)), n)
        pairs, count = np.unique(owner * (1 << WORD_BITS) + code[numbers], return_counts=True)
        doc, index = pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1)
        distinct = np.bincount(doc, minlength=len(texts))
        top = np.zeros(len(texts))
        np.maximum.at(top, doc, count)
        table = statistics(texts, n_chars, numbers, ends, distinct, top)
        if not self.bounds.size:
            self.bounds = np.quantile(table, np.linspace(0, 1, BUCKETS + 1)[1:-1], axis=0) if len(texts) else np.zeros((BUCKETS - 1, STATISTICS))
        bucket = np.stack([np.searchsorted(self.bounds[:, j], table[:, j], side="left") for j in range(STATISTICS)], axis=1)
        bucket = bucket + np.arange(STATISTICS) * BUCKETS + (1 << WORD_BITS)
        value = np.sqrt(count / np.maximum(n, 1)[doc])
        every_doc = np.concatenate([doc, np.repeat(np.arange(len(texts)), STATISTICS)])
        order = np.argsort(every_doc, kind="stable")
        per = distinct + STATISTICS
        return Rows(
            np.concatenate([index, bucket.ravel()])[order], np.concatenate([value, np.full(bucket.size, 0.5)])[order], np.cumsum(per)
        )


class Machine:
    """bias + sum of w x + half the sum over factors of (sum of v x) squared less the sum of v x squared: linear time."""

    def __init__(self, seed: int = 3) -> None:
        n = (1 << WORD_BITS) + STATISTICS * BUCKETS
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(n, np.float32)
        self.v = (rng.standard_normal((n, FACTORS)) * 0.02).astype(np.float32)

    def forward(self, rows: Rows):
        begins = np.concatenate([[0], rows.ends[:-1]])
        x = rows.value.astype(np.float32)[:, None]
        vx = self.v[rows.index] * x
        total = np.add.reduceat(vx, begins, axis=0)
        squares = np.add.reduceat(vx * vx, begins, axis=0)
        linear = np.add.reduceat(self.w[rows.index] * rows.value, begins)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1), vx, total

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, epochs: int, batch: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        sums_w, sums_v, sum_b = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                part = rows.take(some)
                logit, vx, total = self.forward(part)
                err = (0.5 * (1 + np.tanh(0.5 * logit)) - y[some]) * weight[some] / len(some)
                n = np.diff(part.ends, prepend=0)
                each = np.repeat(err, n) * part.value
                grad_v = each[:, None] * (np.repeat(total, n, axis=0) - vx)
                at, inverse = np.unique(part.index, return_inverse=True)
                gw = np.bincount(inverse, each) + 1e-5 * self.w[at]
                gv = np.stack([np.bincount(inverse, grad_v[:, f]) for f in range(FACTORS)], axis=1) + 1e-5 * self.v[at]
                sums_w[at] += gw**2
                sums_v[at] += gv**2
                sum_b += err.sum() ** 2
                self.w[at] -= (0.1 * gw / np.sqrt(sums_w[at])).astype(np.float32)
                self.v[at] -= (0.03 * gv / np.sqrt(sums_v[at])).astype(np.float32)
                self.bias -= 0.1 * err.sum() / np.sqrt(sum_b)


@dataclass
class Model:
    buckets: Buckets
    machine: Machine
    shift: float

    def score(self, texts: list[str], n_chars: list[int | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        logit = self.machine.forward(self.buckets.features(texts, n_chars))[0]
        return 0.5 * (1 + np.tanh(0.5 * (logit + self.shift)))


def train(texts: list[str], n_chars: list[int | None], labels: np.ndarray, share: float | None = None) -> Model:
    """Fit the machine. ``share`` is the part of label 1 among all labelled documents, towards which scores are shifted in part.

    With one class only, every score is near that class's side.
    """
    buckets, machine = Buckets(np.empty((0, 0))), Machine()
    y = np.asarray(labels, np.float64)
    if len(set(y.tolist())) < 2:
        rows = buckets.features(texts, n_chars)
        machine.v[:] = 0
        return Model(buckets, machine, 3.0 if len(y) and y.all() else -3.0)
    rows = buckets.features(texts, n_chars)
    own = y.mean()
    weight = np.where(y == 1, 0.5 / own, 0.5 / (1 - own))
    batch = int(np.clip(len(y) // 24, 16, 256))
    machine.fit(rows, y, weight, epochs=int(np.clip(-(-LEAST_STEPS * batch // len(y)), 12, 40)), batch=batch)
    share = min(max(own if share is None else share, 0.01), 0.99)
    return Model(buckets, machine, 0.4 * float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled documents whose crc32(id) mod 4 is not 2."""
    sample, share = labelled_sample(docs, labels, "quality", not_held_out(4, 2), rows=rows, limit_bytes=SAMPLE_BYTES, extra=("n_chars",))
    return train([r.text for r in sample], [r.n_chars for r in sample], np.array([r.y for r in sample]), share)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Rows (id, score) of every whole text, one per input row.

    A null text counts as empty and is scored as such, a null n_chars as the text's own length. Texts of any length are read
    whole. Null ids and repeated rows are kept; an empty table gives an empty one; other columns of any name are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars = [x or "" for x in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            for a, b in slices([len(t) for t in texts], STEP_CHARS):
                with no_collection():
                    made = held.value.score(texts[a:b], chars[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(made, pa.float64())], names=[id_col, "score"])
            release_memory()

    narrow = docs.select(F.col(id_col), F.col(text).cast("string").alias("__text"), F.col(n_chars).cast("long").alias("__n"))
    return small_batches(narrow).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = scores(docs, fit(docs, labels))
    return scored.select(
        "doc_id", (~not_held_out(4, 2)(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
