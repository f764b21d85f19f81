"""Every registered query over a small fixture of whole tables, against plain loops, the plain libraries, or its SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_search import brute_fingerprint, components
from test_text import brute_spans, labelled
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tallyforge.llm import bpe, licenses, quality, registry, toxicity

ODD = [None, "", " \n\t", "one", "one", "mail a.b@c.org, card 4111 1111 1111 1111, host 10.0.0.1", "x<|endoftext|>y  ünï 漢字\n\n", "ab " * 3000, licenses.MIT]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fixture")
    r, g = random.Random(6), np.random.default_rng(6)
    texts, y = labelled(90, lambda r: "grrzk" + r.choice(["a", "in", "ost"]), 4)
    rows = [(i, t, "en", r.choice(["a", "b", "c", None]), len(t), 0.5) for i, t in enumerate(texts)]
    rows += [(200 + i, t, "de", "b", None if t is None else len(t), 0.5) for i, t in enumerate(ODD)]
    rows += [(300, texts[0], None, "a", len(texts[0]), 0.5), (301, texts[1] + " q", "en", "a", 1, 0.5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(len(t) % 3 > 0), int(y[i])) for i, t in enumerate(texts)] + [(205, None, None), (9999, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    base = g.standard_normal((40, 16))
    near = base[:20] + 0.02 * g.standard_normal((20, 16))
    vectors = [(i, [float(np.float32(x)) for x in v], None if i == 7 else i % 20 % 3) for i, v in enumerate(np.concatenate([base, near]))]
    vectors += [(100, vectors[0][1], 0), (101, None, 0), (102, [1.0, None], 0), (103, [0.0] * 16, 1), (104, [float("inf")] * 16, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), rows, marks, vectors


@pytest.fixture(scope="module")
def results(spark, tables):
    held = {}

    def run(name):
        if name not in held:
            held[name] = registry.QUERIES[name](spark, tables[0])
        return held[name].columns, {r[0]: r for r in held[name].collect()}

    return run


def test_oracles_are_sql():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and all(isinstance(x, str) for x in registry.ORACLES.values())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles_agree(spark, tables, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    want = db.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, tables[0])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in df.select(*names).collect()) == key(want.select(*(f'"{n}"' for n in names)).fetchall())


def test_planted_links_are_found(results):
    _, out = results("op8_vectors")
    assert sum(r.n_links > 0 for r in out.values()) >= 30 and out[100].component_id == 0 and not out[100].kept


def test_mixing(tables, results):
    columns, out = results("op1_mixing")
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(columns)
    sizes, held = {}, defaultdict(int)
    for i, t, _, s, *_ in tables[1]:
        sizes[i] = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
        held[s] += sizes[i]
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = float(sum(held.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 3 * held[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3.0 * held[s] for s in full}
        left, open_ = left - sum(3.0 * held[s] for s in full), open_ - full
    taken = defaultdict(int)
    for i, _, _, s, *_ in tables[1]:
        r = out[i]
        assert (r["size"], r.source_size) == (sizes[i], held[s]) and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        taken[s] += r.taken
    # a source ends at its target but for the document that crosses it, and the last one of all that didn't fit
    assert all(abs(taken[s] - target[s]) <= 2 * max(sizes.values()) for s in order)


def test_simhash(tables, results):
    columns, out = results("op3_simhash")
    fps = {i: brute_fingerprint(t, 3) for i, t, *_ in tables[1]}
    roots = components(list(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {i: (r.fingerprint, r.component_id) for i, r in out.items()} == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}


def test_encoding(tables, results):
    tik = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    _, out = results("op7_bpe")
    for i, t, *_ in tables[1]:
        ids = tik.encode_ordinary(t or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == want, i


def test_token_file_rows(tables, results):
    tok, (_, out), at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), results("op10_token_files"), 0
    for i, t, *_ in sorted(tables[1]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)


def test_personal_data(tables, results):
    _, out = results("op9_pii")
    kinds = ("email", "ip", "card", "phone")
    for i, t, *_ in tables[1]:
        spans = brute_spans(t or "")
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        counts = Counter(k for _, k, _ in spans)
        assert [out[i][f"n_{k}"] for k in kinds] == [counts[o] for o in range(4)]
        assert out[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(out[i].spans.split(",")) | {""}


def check_scores(tables, columns, out, modulus, remainder, threshold, score):
    assert {"doc_id", "held_out", "score", "predicted"} <= set(columns) and len(out) == len(tables[1])
    for i, text, _, _, n_chars, _ in tables[1]:
        r = out[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder) and r.predicted == int(r.score >= threshold)
        assert abs(r.score - score(text or "", n_chars)) < 2e-3, i


def plain_words(text):
    return [w for x in text.lower().split() if (w := x.strip(toxicity.EDGES))]


def test_toxicity_by_plain_loops(spark, tables, results):
    """The network's sums written out, word by word and state by state, over every window of every text."""
    model = toxicity.fit(spark.read.parquet(f"{tables[0]}/documents.parquet"), spark.read.parquet(f"{tables[0]}/labels.parquet"))
    net, p, shift = model.network, model.network.p, toxicity.TABLE_BITS - toxicity.EMBED_BITS
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def seen(word):
        raw, grams = b"^" + word.encode() + b"$", []
        for k in toxicity.GRAMS:
            for a in range(len(raw) - k + 1):
                grams.append((int.from_bytes(bytes([k]) + raw[a : a + k], "big") * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - toxicity.TABLE_BITS))
        own, codes = xxh64_intdigest(word, 7) >> (64 - toxicity.TABLE_BITS), [float(model.codes.gram[x]) for x in grams]
        mean = np.mean([p["gram"][x >> shift] for x in grams], axis=0)
        return np.concatenate([[model.codes.word[own] / 2, max(codes) / 2, np.mean(codes) / 2, 1], p["word"][own >> shift], mean])

    def logit(words):
        h, states = toxicity.HIDDEN, {}
        for d, order in (("0", range(len(words))), ("1", range(len(words) - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                x = words[t] @ p["w" + d]
                z, r = sigmoid(x[:h] + s @ p["u" + d][:, :h]), sigmoid(x[h : 2 * h] + s @ p["u" + d][:, h : 2 * h])
                s = s + z * (np.tanh(x[2 * h :] + (r * s) @ p["u" + d][:, 2 * h :]) - s)
                states[d, t] = s
        every = np.array([np.concatenate([states["0", t], states["1", t]]) for t in range(len(words))])
        attention = np.exp(every @ p["attend"])
        return attention @ every / attention.sum() @ p["out"] + p["bias"][0]

    def score(text, _):
        words = [seen(w) for w in plain_words(text)]
        if not words:
            return net.share
        last = max(1, -(-max(0, len(words) - (toxicity.WINDOW - toxicity.STRIDE)) // toxicity.STRIDE))
        return sigmoid(net.scale * max(logit(words[a * toxicity.STRIDE :][: toxicity.WINDOW]) for a in range(last)) + net.shift)

    columns, out = results("op5_toxicity")
    check_scores(tables, columns, out, 5, 0, 0.5, score)


def test_quality_by_plain_loops(spark, tables, results):
    """Every pair of features multiplied out, instead of the sum-of-squares identity."""
    model = quality.fit(spark.read.parquet(f"{tables[0]}/documents.parquet"), spark.read.parquet(f"{tables[0]}/labels.parquet"))
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "|", "#%&*$@^~=+_<>/\\"]

    def score(text, n_chars):
        words, lines, raw = plain_words(text), text.split("\n"), text.encode()
        count = Counter(xxh64_intdigest(w, 11) >> (64 - quality.WORD_BITS) for w in words)
        n = max(1, len(words))
        stats = [sum(text.count(c) for c in k) / max(1, len(raw)) for k in kinds]
        stats += [np.log1p(len(raw)) / 12, min(len(raw) / n, 30) / 30, len(count) / n, max(count.values(), default=0) / n]
        stats += [1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)) / 12, np.log1p(len(text) if n_chars is None else n_chars) / 12]
        x = {k: (c / n) ** 0.5 for k, c in count.items()}
        for j, v in enumerate(stats):
            x[(1 << quality.WORD_BITS) + j * quality.BUCKETS + sum(b < v for b in model.buckets.bounds[:, j])] = 0.5
        at = sorted(x)
        total = model.machine.bias + sum(float(model.machine.w[i]) * x[i] for i in at)
        products = model.machine.v[at].astype(np.float64) @ model.machine.v[at].astype(np.float64).T
        total += sum(products[a, b] * x[at[a]] * x[at[b]] for a in range(len(at)) for b in range(a + 1, len(at)))
        return 1 / (1 + np.exp(-(total + model.shift)))

    columns, out = results("op2_quality")
    check_scores(tables, columns, out, 4, 2, 0.7, score)


def test_licences_of_whole_texts(tables, results):
    _, out = results("op6_licenses")
    assert {i for i, r in out.items() if r.license} == {208} and out[208].license == "MIT" and len(out) == len(tables[1])
