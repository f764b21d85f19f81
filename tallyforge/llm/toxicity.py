"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word is seen twice: as a word, and as its character n-grams. Either has an embedding, learned with the
network by back-propagation (the n-grams' embeddings are averaged), and a code, counted on labelled documents
(log-odds in hashed tables, cross-fitted while the network is trained). The network
reads overlapping windows of words in both directions, pools them by attention, and a document's score
comes from its highest window, over all windows of its whole text.
"""

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

#: Labelled documents of each class that are learned from, and the text they may hold in all.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 24 << 20
#: Words of a window, and from one window's start to the next one's.
WINDOW, STRIDE = 48, 32
#: Units of each direction; inputs of a word that are given (codes and a constant), numbers of an embedding, inputs in all.
HIDDEN, GIVEN, EMBED = 6, 4, 4
INPUTS = GIVEN + 2 * EMBED
#: Places of the hashed tables of codes, and of embeddings.
TABLE_BITS, EMBED_BITS = 20, 13
#: Training steps at least, where there are few labels.
LEAST_STEPS = 400
#: Share of words whose own code is hidden in an epoch of training.
HIDE_WORDS = 0.3
#: How fast embeddings are learned, beside the weights, and their pull to zero.
EMBED_RATE, EMBED_PULL = 0.05, 1e-4
GRAMS = (3, 4, 5, 6)
MIN_LOG_ODDS, MAX_LOG_ODDS = -3.0, 6.0
#: Characters of text, and windows, that are scored at a time.
STEP_CHARS, STEP_WINDOWS = 3 << 20, 2048
#: Words whose n-grams are held at a time.
WORDS_STEP = 1 << 14
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”‘’«»¡¿"


def words_of(piece: str) -> list[str]:
    """The words of a piece: lower case, without punctuation at their ends."""
    return [w for x in piece.lower().split() if (w := x.strip(EDGES))]


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all character n-grams (3 to 6 bytes, word ends marked), and the word that each is of."""
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # bytes to the end of the word
    codes, owners = [], []
    for k in GRAMS:
        ok = np.nonzero(left >= k)[0]
        value = np.full(len(ok), k, np.uint64)
        for i in range(k):
            value = value * np.uint64(256) + flat[ok + i]
        value = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)
        codes.append(value.astype(np.int64))
        owners.append(owner[ok])
    codes, owners = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return codes[order], owners[order]


def word_codes(words: list[str]) -> np.ndarray:
    shift = 64 - TABLE_BITS
    return np.fromiter((xxh64_intdigest(w, 7) >> shift for w in words), np.int64, len(words))


@dataclass
class Codes:
    """Log-odds of the toxic class, by table place, of words and of character n-grams."""

    word: np.ndarray
    gram: np.ndarray

    @classmethod
    def learn(cls, words: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Codes:
        """toxic and clean: the documents of each class that hold each word."""

        def log_odds(t: np.ndarray, c: np.ndarray) -> np.ndarray:
            value = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
            value[(t + c) == 0] = 0
            return np.clip(value, MIN_LOG_ODDS, MAX_LOG_ODDS).astype(np.float32)

        size = 1 << TABLE_BITS
        counts = np.zeros((4, size))
        for a in range(0, len(words), WORDS_STEP):
            part = words[a : a + WORDS_STEP]
            t, c, w = toxic[a : a + WORDS_STEP], clean[a : a + WORDS_STEP], word_codes(part)
            g, owner = gram_codes(part)
            for row, (at, weight) in enumerate(((w, t), (w, c), (g, t[owner]), (g, c[owner]))):
                counts[row] += np.bincount(at, weight, size)
        return cls(log_odds(counts[0], counts[1]), log_odds(counts[2], counts[3]))

    def inputs(self, words: list[str]) -> np.ndarray:
        """What is given of each word: the word's own code, the highest and mean code of its n-grams, and 1."""
        out = np.zeros((len(words), GIVEN), np.float32)
        out[:, 3] = 1
        for a in range(0, len(words), WORDS_STEP):
            part = words[a : a + WORDS_STEP]
            rows = out[a : a + len(part)]
            rows[:, 0] = self.word[word_codes(part)]
            codes, owner = gram_codes(part)
            values = self.gram[codes]
            at, first = np.unique(owner, return_index=True)
            rows[at, 1] = np.maximum.reduceat(values, first)
            rows[at, 2] = np.add.reduceat(values, first) / np.diff(np.append(first, len(values)))
        out[:, :3] *= np.float32(0.5)
        return out


class Places:
    """Where the words and their n-grams stand in the tables of embeddings; the n-grams of word i are ``gram[start[i] : start[i + 1]]``."""

    def __init__(self, words: list[str]) -> None:
        shift = TABLE_BITS - EMBED_BITS
        own, grams, size = [np.empty(0, np.int32)], [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        for a in range(0, len(words), WORDS_STEP):
            part = words[a : a + WORDS_STEP]
            codes, owner = gram_codes(part)
            own.append((word_codes(part) >> shift).astype(np.int32))
            grams.append((codes >> shift).astype(np.uint16))
            size.append(np.bincount(owner, minlength=len(part)))
        self.word, self.gram, self.size = np.concatenate(own), np.concatenate(grams), np.concatenate(size)
        self.start = np.cumsum(self.size) - self.size

    def grams_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the n-grams of some words, and the index in ``which`` of each one's word."""
        n = self.size[which]
        owner = np.repeat(np.arange(len(which)), n)
        return self.gram[np.arange(len(owner)) + np.repeat(self.start[which] - np.cumsum(n) + n, n)].astype(np.int64), owner


def embedded(p: dict[str, np.ndarray], places: Places, which: np.ndarray) -> np.ndarray:
    """The embeddings of some words: the word's own, and the mean of its n-grams'."""
    grams, owner = places.grams_of(which)
    sums = [np.bincount(owner, p["gram"][grams, k], len(which)) for k in range(EMBED)]
    mean = np.stack(sums, axis=1) / np.maximum(1, places.size[which])[:, None]
    return np.concatenate([p["word"][places.word[which]], mean], axis=1).astype(p["word"].dtype)


def embedding_gradients(p: dict[str, np.ndarray], places: Places, which: np.ndarray, d_own: np.ndarray, d_mean: np.ndarray) -> dict[str, np.ndarray]:
    """What the gradients of some words' embeddings say about the tables'."""
    size = len(p["word"])
    grams, owner = places.grams_of(which)
    d_gram = (d_mean / np.maximum(1, places.size[which])[:, None])[owner]
    return {
        "word": np.stack([np.bincount(places.word[which], d_own[:, k], size) for k in range(EMBED)], axis=1),
        "gram": np.stack([np.bincount(grams, d_gram[:, k], size) for k in range(EMBED)], axis=1),
    }


def windows(numbers: np.ndarray, ends: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of each text as rows of word numbers, filled up with ``blank``, and the text of each.

    A text without words has one blank window.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = ends - begins
    many = np.maximum(1, -(-np.maximum(n - (WINDOW - STRIDE), 0) // STRIDE))
    owner = np.repeat(np.arange(len(ends)), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    kind = np.int32 if len(numbers) < 1 << 30 else np.int64  # of some millions of windows, half the memory
    at = (begins[owner] + step * STRIDE).astype(kind)[:, None] + np.arange(WINDOW, dtype=kind)[None, :]
    at[at >= ends[owner].astype(kind)[:, None]] = len(numbers)
    return np.append(numbers, blank).astype(np.int32)[at], owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """The recurrent network. Parameters are float32 arrays in ``p``; direction 0 reads on, direction 1 reads back."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, f32 = HIDDEN, np.float32
        self.p: dict[str, np.ndarray] = {"bias": np.zeros(1, f32), "out": (rng.standard_normal(2 * h) * 0.3).astype(f32)}
        self.p["attend"] = (rng.standard_normal(2 * h) * 0.3).astype(f32)
        for d in "01":
            self.p["w" + d] = (rng.standard_normal((INPUTS, 3 * h)) * 0.4).astype(f32)
            self.p["u" + d] = (rng.standard_normal((h, 3 * h)) * 0.3).astype(f32)
        for d in ("word", "gram"):
            self.p[d] = (rng.standard_normal((1 << EMBED_BITS, EMBED)) * 0.1).astype(f32)
        #: score = sigmoid(scale * highest window + shift); a text without words scores as the share of toxic labels
        self.scale, self.shift, self.share = 1.0, 0.0, 0.0

    def forward(self, table: np.ndarray, rows: np.ndarray, keep: bool = False):
        """Logits of windows. table: inputs of each word number, the last one being blank; rows: windows of numbers."""
        b, h, blank = len(rows), HIDDEN, len(table) - 1
        held = np.ascontiguousarray(rows.T)
        there = held != blank
        states = np.zeros((WINDOW, b, 2 * h), np.float32)
        saved = []
        longest = int(there.any(axis=1).sum())
        for d in (0, 1):
            given, u = table @ self.p[f"w{d}"], self.p[f"u{d}"]
            s = np.zeros((b, h), np.float32)
            steps = range(longest) if d == 0 else range(longest - 1, -1, -1)
            for t in steps:
                x = given[held[t]]
                gates = x[:, : 2 * h] + s @ u[:, : 2 * h]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                z, r = gates[:, :h], gates[:, h:]
                rs = r * s
                c = np.tanh(x[:, 2 * h :] + rs @ u[:, 2 * h :])
                z = z * there[t][:, None]  # a blank leaves the state as it is
                new = s + z * (c - s)
                if keep:
                    saved.append((d, t, s, z, r, c, gates[:, :h]))
                s = new
                states[t, :, d * h : (d + 1) * h] = s
        weight = states @ self.p["attend"]
        weight = np.where(there, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0)) * there
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (held, there, states, weight, pooled, saved)) if keep else logits

    def gradients(self, table: np.ndarray, rows: np.ndarray, target: np.ndarray, importance: np.ndarray):
        """The gradients of the mean log loss, by back-propagation through time, but for the embeddings'; and those of ``table``."""
        h = HIDDEN
        logits, (held, there, states, weight, pooled, saved) = self.forward(table, rows, keep=True)
        err = ((_sigmoid(logits) - target) * importance / importance.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        met, at = {"0": [], "1": []}, {"0": [], "1": []}
        g["bias"][0] = err.sum()
        g["out"] = pooled.T @ err
        d_pooled = err[:, None] * self.p["out"][None, :]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0)[None, :])
        g["attend"] = np.einsum("tb,tbh->h", d_score, states)
        d_states = weight[:, :, None] * d_pooled[None] + d_score[:, :, None] * self.p["attend"]
        carried = {0: np.zeros((len(rows), h), np.float32), 1: np.zeros((len(rows), h), np.float32)}
        for d, t, s, z, r, c, z_raw in reversed(saved):
            u = self.p[f"u{d}"]
            ds = carried[d] + d_states[t, :, d * h : (d + 1) * h]
            dc = ds * z * (1 - c * c)
            dz = ds * (c - s) * there[t][:, None] * z_raw * (1 - z_raw)
            d_rs = dc @ u[:, 2 * h :].T
            dr = d_rs * s * r * (1 - r)
            d_gates = np.concatenate([dz, dr, dc], axis=1)
            g[f"u{d}"][:, : 2 * h] += s.T @ d_gates[:, : 2 * h]
            g[f"u{d}"][:, 2 * h :] += (r * s).T @ dc
            met[f"{d}"].append(d_gates)
            at[f"{d}"].append(held[t])
            carried[d] = ds * (1 - z) + d_rs * r + d_gates[:, : 2 * h] @ u[:, : 2 * h].T
        d_table = np.zeros_like(table)
        for d in "01":
            if met[d]:
                words, gates = np.concatenate(at[d]), np.concatenate(met[d])
                total = np.stack([np.bincount(words, gates[:, k], len(table)) for k in range(3 * h)], axis=1).astype(table.dtype)
                g[f"w{d}"] += table.T @ total
                d_table += total @ self.p[f"w{d}"].T
        return g, d_table

    def logits(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        parts = [self.forward(table, rows[a : a + STEP_WINDOWS]) for a in range(0, len(rows), STEP_WINDOWS)]
        return np.concatenate(parts) if parts else np.empty(0, np.float32)


@dataclass
class Model:
    codes: Codes
    network: Network

    def score(self, texts: list[str]) -> np.ndarray:
        """The score of each whole text: all its windows are read."""
        words, numbers, ends = number_words(texts, words_of)
        table = np.zeros((len(words) + 1, INPUTS), np.float32)
        for a in range(0, len(words), WORDS_STEP):
            part = words[a : a + WORDS_STEP]
            table[a : a + len(part), :GIVEN] = self.codes.inputs(part)
            table[a : a + len(part), GIVEN:] = embedded(self.network.p, Places(part), np.arange(len(part)))
        rows, owner = windows(numbers, ends, len(words))
        high = np.full(len(texts), -np.inf)
        np.maximum.at(high, owner, self.network.logits(table, rows))
        scores = _sigmoid(self.network.scale * high + self.network.shift)
        scores[np.diff(ends, prepend=0) == 0] = self.network.share
        return scores


def _numbered_in_steps(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``number_words``, some of the texts at a time."""
    known: dict[str, int] = {}
    parts, ends, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
    for a, b in slices([len(t) for t in texts], STEP_CHARS):
        words, numbers, upto = number_words(texts[a:b], words_of)
        here = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        parts.append(here[numbers])
        ends.append(upto + at)
        at += len(numbers)
        del words, numbers
        release_memory()
    return list(known), np.concatenate(parts), np.concatenate(ends)


def _holders(words: list[str], numbers: np.ndarray, ends: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """For each word the documents among ``mine`` that hold it."""
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    at = np.nonzero(mine[owner])[0]
    pairs = np.unique(owner[at].astype(np.int64) * len(words) + numbers[at]) if len(at) else np.empty(0, np.int64)
    return np.bincount(pairs % max(1, len(words)), minlength=len(words)).astype(np.float64)


def train(texts: list[str], labels: np.ndarray, share: float | None = None, epochs: int = 8, seed: int = 5) -> Model:
    """Fit codes and network. With one class only (or no text) every score is near that class's side.

    ``share`` is the part of toxic ones among all labelled documents, to which scores are calibrated (the
    sample's own if not given).

    Each half of the documents is coded by what the other half says. A toxic document teaches by its highest window (at first
    by codes, then by the network's own logits), a clean one by its highest and some others.
    """
    rng = np.random.default_rng(seed)
    network = Network(seed)
    labels = np.asarray(labels, np.float64)
    size = 1 << TABLE_BITS
    if len(set(labels.tolist())) < 2:
        network.scale, network.shift = 0.0, -3.0 if not labels.any() else 3.0
        network.share = float(_sigmoid(np.float64(network.shift)))
        return Model(Codes(np.zeros(size, np.float32), np.zeros(size, np.float32)), network)
    words, numbers, ends = _numbered_in_steps(texts)
    half = rng.random(len(texts)) < 0.5

    def learn(mine: np.ndarray) -> Codes:
        toxic, clean = mine & (labels == 1), mine & (labels == 0)
        return Codes.learn(
            words, _holders(words, numbers, ends, toxic), _holders(words, numbers, ends, clean), int(toxic.sum()), int(clean.sum())
        )

    inputs = [learn(~half).inputs(words), learn(half).inputs(words)]  # of documents in half, and of the others
    release_memory()
    # one table for both: the words of the second half's documents are numbered after the first's
    given, n = np.vstack([*inputs, np.zeros((1, GIVEN), np.float32)]), len(words)
    places = Places(words)
    rows, owner = windows(numbers, ends, n)
    blank = rows == n
    rows += np.where(half[owner], 0, n).astype(np.int32)[:, None]
    rows[blank] = 2 * n
    del blank
    order = np.lexsort((rng.random(len(rows)), owner))
    rows, owner = rows[order], owner[order]
    starts = np.nonzero(np.diff(owner, prepend=-1))[0]
    signal = given[:, 0] + given[:, 1]
    high = np.sort(signal[rows], axis=1)[:, -3:].sum(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    own = labels.mean()
    share = own if share is None else min(max(share, 0.001), 0.999)
    network.share = float(share)
    ticks, taught = 0, len(labels) + int((labels == 0).sum())
    batch = int(np.clip(taught // 24, 16, 256))
    epochs = int(np.clip(-(-LEAST_STEPS * batch // taught), epochs, 40))
    balance = (taught - labels.sum()) / labels.sum()  # both classes weigh the same

    def numbered(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some windows: the words that occur, the windows in numbers of these, and the inputs of each, the blank being the last one."""
        used, local = np.unique(np.append(some.ravel(), 2 * n), return_inverse=True)
        table = np.zeros((len(used), INPUTS), np.float32)
        table[:, :GIVEN] = given[used]
        table[:-1, GIVEN:] = embedded(network.p, places, used[:-1] % n)
        return used, local[:-1].reshape(some.shape), table

    def logits() -> np.ndarray:
        parts = []
        for a in range(0, len(rows), STEP_WINDOWS):
            _, local, table = numbered(rows[a : a + STEP_WINDOWS])
            parts.append(network.forward(table, local))
        return np.concatenate(parts)

    for epoch in range(epochs):
        if epoch:
            high = logits()
        # per document: its highest window, and for clean ones also a drawn one
        rank = np.lexsort((-high, owner))
        best = rank[starts]
        drawn = starts[labels == 0]  # rows are in drawn order within a document
        chosen = np.concatenate([best, drawn])
        rng.shuffle(chosen)
        seen = rng.random(2 * n + 1) >= HIDE_WORDS  # words unseen so far must be known by their n-grams alone
        for a in range(0, len(chosen), batch):
            some = chosen[a : a + batch]
            target = labels[owner[some]]
            importance = np.where(target == 1, balance, 1.0)
            used, local, table = numbered(rows[some])
            shown, real = seen[used][:, None], used[:-1] % n
            table[:, [0, *range(GIVEN, GIVEN + EMBED)]] *= shown
            g, d_table = network.gradients(table, local, target, importance)
            d_own, d_mean = (d_table[:-1] * shown[:-1])[:, GIVEN : GIVEN + EMBED], d_table[:-1, GIVEN + EMBED :]
            g |= embedding_gradients(network.p, places, real, d_own, d_mean)
            ticks += 1
            rate = 0.02 * (1 - 0.7 * epoch / epochs)
            for k, v in network.p.items():
                m, q = moments[k]
                if k in ("word", "gram"):
                    g[k] += EMBED_PULL * v
                m += 0.1 * (g[k] - m)
                q += 0.01 * (g[k] ** 2 - q)
                step = rate * (EMBED_RATE if k in ("word", "gram") else 1)
                v -= (step * (m / (1 - 0.9**ticks)) / (np.sqrt(q / (1 - 0.99**ticks)) + 1e-6)).astype(np.float32)
    top = np.maximum.reduceat(logits(), starts)
    del given, places, rows, inputs
    release_memory()
    network.scale, network.shift = _calibrate(top, labels, np.where(labels == 1, share / own, (1 - share) / (1 - own)))
    return Model(learn(np.ones(len(texts), bool)), network)


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of a logistic fit with a weak pull to (1, 0), by Newton's steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = _sigmoid(a * x + b)
        w, e = weight * p * (1 - p), weight * (p - y)
        g = np.array([(e * x).sum() + 5 * (a - 1), e.sum() + 0.5 * b])
        m = np.array([[(w * x * x).sum() + 5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.5]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.05)), float(b)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep, id_col: str = "doc_id", text: str = "text",
    rows: int = SAMPLE_ROWS, limit_bytes: int = SAMPLE_BYTES, extra: tuple[str, ...] = (),
) -> tuple[list, float]:
    """(sample, share of label 1 among all admitted labels). The sample has at most ``rows`` labelled documents of each class, as rows (text, y, extra...), and at most about ``limit_bytes`` of text.

    Drawn by a hash of the id among the labelled ids that ``keep`` admits, in a fixed order. An id with
    several labels takes the highest, documents that share an id take its label. Null ids, labels and texts are left out. Where the
    drawn texts hold more than ``limit_bytes``, a hash of the text says which of them stay. The ids (a bounded number) are broadcast to find the texts.
    """
    spark = docs.sparkSession
    asked = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & keep(F.col(id_col)))
    asked = asked.groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("__y"))
    picked = []
    for y in (0, 1):
        picked += asked.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows).collect()
    share = asked.agg(F.avg("__y")).first()[0] or 0.0
    if not picked:
        return [], share
    small = spark.createDataFrame([(r["__id"], int(r["__y"])) for r in picked], "__id long, __y int")
    met = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("text"), *(F.col(c) for c in extra)).join(F.broadcast(small), "__id")
    met = met.where("text is not null").withColumnRenamed("__y", "y")
    sized = met.select("__id", "y", F.octet_length("text").alias("b"))
    total = sized.agg(F.sum("b"), F.count("*")).first()
    if not total[1]:
        return [], share
    fits = min(1.0, limit_bytes / max(1, total[0]), 4 * rows / total[1])
    if fits < 1:
        met = met.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(fits * (1 << 20)))
    return met.orderBy("__id", F.xxhash64("text")).drop("__id").collect(), share


def not_held_out(modulus: int, remainder: int):
    return lambda doc_id: F.crc32(doc_id.cast("string").cast("binary")) % modulus != remainder


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled documents whose crc32(id) mod 5 is not 0."""
    sample, share = labelled_sample(docs, labels, "toxic", not_held_out(5, 0), rows=rows)
    model = train([r.text for r in sample], np.array([r.y for r in sample]), share)
    del sample
    release_memory()
    return model


def with_scores(docs: DataFrame, model, to: str = "score", id_only: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` (or only its column ``id_only``) with the score of every whole text in column ``to``.

    A null text counts as empty and is scored as such. All rows stay, repeated ones and those without an id too; an empty table gives
    an empty one. Texts of any length are read in all their windows. A column that is already named ``to`` is replaced (choose
    another name to keep it); the others may have any names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != to and (id_only is None or f.name == id_only)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in slices([len(t) for t in texts], STEP_CHARS):
                with no_collection():
                    scores = held.value.score(texts[a:b])
                part = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*part, pa.array(scores, pa.float64())], names=[*(f.name for f in kept), to])
            release_memory()

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{to}` double"])
    names = [F.col(f"`{f.name}`") for f in kept]
    return small_batches(docs).select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(run, ddl)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose whole text scores ``threshold`` or more. Columns stay as they are, whatever their names.

    A null text counts as empty; equal texts share their fate; an empty table stays empty; every window of a long text is read.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            clean = []
            for a, b in slices([len(t) for t in texts], STEP_CHARS):
                with no_collection():
                    clean.append(held.value.score(texts[a:b]) < threshold)
            del texts
            release_memory()
            yield batch.filter(pa.array(np.concatenate(clean))) if clean else batch

    return small_batches(docs).mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels), id_only="doc_id")
    return scored.select(
        "doc_id", (~not_held_out(5, 0)(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
