"""SimHash, vectors, top-k and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import simhash, topk, vectors
from tallyforge.llm.common import connected_components, shared_dir


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(nodes, pairs):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_shared_dir_is_the_sessions_own(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(i, 900) for i in range(700)] + [(0, 901), (902, 1)], [(1, 2), (2, 1), (5, 5), (9, 7), (8, 7)]])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == components({x for e in real for x in e}, real)


def brute_fingerprint(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(runs))


def corpus(n=120, seed=2):
    r = random.Random(seed)
    base = [" ".join(r.choices(["ab", "Cd", "éf", "gh", "ij", "kl", "mn"], k=r.randint(0, 60))) for _ in range(n)]
    near = [" ".join((t.split() or ["z"])[:-1] + ["q"]) for t in base[:40]]
    return base + near + base[:10] + ["", None, " \t\n", "one", "One", "a b c", "x " * 20000]


def test_fingerprints_and_groups(spark, docs):
    texts = corpus()
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    out = simhash.near_duplicates(docs(rows)).collect()
    assert len(out) == len(rows)
    fps = {i: brute_fingerprint(t, 3) for i, t in enumerate(texts)}
    ids = sorted(fps)
    roots = components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    for r in out:
        if r.doc_id is not None:
            assert r.fingerprint & (2**64 - 1) == fps[r.doc_id] and r.component_id == roots[r.doc_id]
        else:
            assert r.component_id == roots[0]
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("full", [1024, 40, 4])
def test_planted_distances_link(spark, full):
    """Entries of more than ``full`` rows go down to the second and third level."""
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(50)]
    every = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base] + [b ^ 0b111 for b in base[:10]]
    for shift in (0, 24, 32):  # groups that share a segment, some of them links and some chains of links
        every += [base[shift] ^ ((1 << r.randrange(32) | 1 << r.randrange(32) | 1 << r.randrange(32)) << shift) for _ in range(60)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in every})
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {x.node: x.component for x in connected_components(simhash.link_edges(df, full)).collect()}
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = components(signed, close)
    assert {n: got.get(n, n) for n in signed} == want


def test_tables_are_keyed_by_segments(spark):
    """33 entries for either segment, its own value among them; the halves of a free segment on the next level."""
    fp = 0x0123456789ABCDEF
    df = spark.createDataFrame([(0, fp, 0, True), (0, fp ^ 1, 0, True)], "key long, fp long, free int, own boolean")
    rows = simhash._deal(df, 0).collect()
    assert len(rows) == 2 * 66 and sum(x.own for x in rows) == 4
    entries = {x.key for x in rows if x.fp == fp}
    assert len(entries) == 66
    assert len({x.key for x in rows if x.fp == fp and x.own} & {x.key for x in rows if x.fp == fp ^ 1}) == 2
    assert {x.free for x in rows} == {0, 32}
    below = simhash._deal(spark.createDataFrame([(7, fp, 32, True), (7, fp, 32, False)], df.schema), 1).collect()
    assert len(below) == 2 * 34 and sum(x.own for x in below) == 2 and {x.free for x in below} == {32, 48}


def edited(words, share, r):
    out = list(words)
    for i in r.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_one_of_each_group_stays(spark, docs):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [r.choices(vocabulary, k=300) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(w)) for i, w in enumerate(base[:20])]  # exact copies
    rows += [(200 + i, edited(w, 0.01, r)) for i, w in enumerate(base[20:50])]  # similarity about 0.9
    rows += [(300 + i, edited(w, 0.12, r)) for i, w in enumerate(base[50:])]  # similarity about 0.35
    rows += [(400, ""), (401, None), (402, "tiny text"), (403, "tiny text"), (403, "tiny text")]
    out = simhash.distinct_documents(docs(rows))
    kept = sorted(x.doc_id for x in out.collect())
    clean = [*range(60), *(300 + i for i in range(10)), 400, 402]
    assert set(clean) <= set(kept) and len(kept) <= len(clean) + 2  # at most 2 of 30 near copies missed
    assert not set(kept) & set(range(100, 120)) and out.columns == docs([]).columns
    assert simhash.distinct_documents(docs([])).count() == 0


def kept_by_brute_force(texts, width=5, least=0.8):
    """Ids that stay, all pairs of whole shingle sets compared."""
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if (w := t.split()) else set() for t in texts]
    number = {x: k for k, x in enumerate({x for s in sets for x in s})}
    table = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        table[i, [number[x] for x in s]] = 1
    both, size = table @ table.T, table.sum(axis=1)
    near = np.argwhere(np.triu(both >= least * (size[:, None] + size[None, :] - both) - 1e-6, 1))
    roots = components(range(len(texts)), near.tolist())
    return sorted(i for i, root in roots.items() if root == i)


def test_star_of_near_copies_is_one_group(spark, docs):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = r.choices(vocabulary, k=124)
    copies = []
    for _ in range(1000):  # two words replaced: 10 of 120 shingles, similarity 0.846 to the base, about 0.72 to each other
        w = list(base)
        for at in r.sample(range(4, 120, 5), 2):
            w[at] = f"new{r.randrange(10**6)}"
        copies.append(" ".join(w))
    texts = [*copies[:500], " ".join(base), *copies[500:], *(" ".join(r.choices(vocabulary, k=60)) for _ in range(200))]
    want = kept_by_brute_force(texts)
    assert len(want) == 201
    assert sorted(x.doc_id for x in simhash.distinct_documents(docs(list(enumerate(texts)))).collect()) == want


def test_fingerprints_group_documents_too(spark, docs):
    """Texts whose fingerprints multi-index hashing links, some with sets that are far apart: one of each such group stays."""
    r = random.Random(21)
    tail = lambda: " ".join(f"t{r.randrange(10**6)}" for _ in range(12))
    texts = [f"{'one line again and again ' * 200}{tail()}" for _ in range(5)]  # 5 of 21 and more 5-word shingles in common
    texts += [f"{'some other words ' * 200}{tail()}", tail(), "a b c", "A b C d", *corpus(40)[:60]]
    table = docs(list(enumerate(texts)))
    groups = {x.doc_id: x.component_id for x in simhash.near_duplicates(table).collect()}
    assert len({groups[i] for i in range(5)}) == 1 and len(kept_by_brute_force(texts[:7])) == 7
    kept = [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()]
    assert len({groups[i] for i in kept}) == len(kept) and {0, 5, 6} <= set(kept)


def test_large_entries_meet_in_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    r = random.Random(11)
    passage, vocabulary = [f"p{i}" for i in range(120)], [f"w{i}" for i in range(4000)]
    shared = [[*passage, *r.choices(vocabulary, k=30)] for _ in range(150)]  # one passage, mutual similarity about 0.65
    texts = [" ".join(w) for w in shared] + [edited(w, 0.014, r) for w in shared[:60]]
    want = kept_by_brute_force(texts)
    assert 140 <= len(want) <= 200
    assert sorted(x.doc_id for x in simhash.distinct_documents(docs(list(enumerate(texts)))).collect()) == want


def test_pairs_to_verify_follow_the_documents(spark, docs, monkeypatch):
    """Few pairs of a group go on to the whole sets: long texts with a passage in common, and near copies that lie apart from their hub."""
    r = random.Random(31)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = r.choices(vocabulary, k=250)
    long = [" ".join([*passage, *r.choices(vocabulary, k=450)]) for _ in range(150)]
    base = r.choices(vocabulary, k=400)
    copies = [edited(base, share, r) for share in (0.005, 0.01, 0.02, 0.025, 0.03) for _ in range(30)]
    texts = [" ".join(base), *copies, *long]
    seen, verified = [], simhash._verified

    def counted(pairs, *more):
        seen.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "_verified", counted)
    want = kept_by_brute_force(texts)
    assert 151 <= len(want) < 290
    assert sorted(x.doc_id for x in simhash.distinct_documents(docs(list(enumerate(texts)))).collect()) == want
    assert sum(seen) < 4 * len(texts)


def test_nearest_pair_of_each_label():
    a, b, off = np.array([0, 0, 2, 3, 0]), np.array([1, 2, 1, 4, 1]), np.array([0.3, 0.2, 0.1, 0.4, 0.1])
    assert simhash.nearest_labels(a, b, off).tolist() == [2, 3, 4]
    assert not len(simhash.nearest_labels(a[:0], b[:0], off[:0]))


def test_folded_parities_rule_out_no_similar_sets():
    g = np.random.default_rng(5)
    for n in (0, 1, 400, 1025, 3000, 4097, 20000):
        a = np.unique(g.integers(0, 1 << 32, n)).astype(np.uint64)
        b, other = a[len(a) // 10 :], np.unique(g.integers(0, 1 << 32, n)).astype(np.uint64)
        x, y, z = (simhash.folded(simhash.long_parity(s), len(s)) for s in (a, b, other))
        assert simhash.parities_differ(x, y) <= len(a) // 10 and len(x) <= max(256, n)
        if n >= 400:
            assert simhash.parities_differ(x, z) > simhash.most_apart(np.array(len(a)), np.array(len(other)), 0.8)


def test_similar_sets_always_share_an_entry():
    g = np.random.default_rng(3)
    tried = 0
    for n in (4, 5, 6, 8, 9, 10, 12, 16, 20, 31, 45, 100, 300, 1000, 5000):
        for _ in range(100 if n < 400 else 10):
            a = np.unique(g.integers(0, 2**32, n, dtype=np.uint64).astype("<u4"))
            new = g.integers(0, 2**32, g.integers(0, n // 4 + 2), dtype=np.uint64).astype("<u4")
            b = np.unique(np.concatenate([a[g.integers(0, n // 4 + 1) :], new]))
            if np.array_equal(a, b) or simhash.similarity(a, b) < 0.8:
                continue
            entry, owner = simhash.part_entries([a, b], 0.8)
            assert np.intersect1d(entry[owner == 0], entry[owner == 1]).size, (len(a), len(b))
            bits = [simhash.parity(x.astype(np.uint64)) for x in (a, b)]
            assert simhash.may_be_similar(bits[0], bits[1], np.array(len(a)), np.array(len(b)), 0.8)
            tried += 1
    assert tried > 400


def test_whole_sets_decide():
    g = np.random.default_rng(4)
    for both, each, near in ((1600, 199, True), (1600, 201, False)):  # similarity 0.8008 and 0.7992
        made = np.unique(g.integers(0, 2**32, 4000, dtype=np.uint64).astype("<u4"))
        made = g.permutation(made)[: both + 2 * each]
        a, b = np.sort(made[: both + each]), np.sort(np.concatenate([made[:both], made[both + each :]]))
        assert simhash.similarity(a, b) == both / (both + 2 * each)
        assert (simhash.similarity(a, b) >= 0.8) == near


def test_long_parities_rule_out_no_similar_sets():
    g = np.random.default_rng(3)
    told = 0
    for n in (1, 3, 31, 32, 33, 250, 511, 513, 6000):
        for share in (0.0, 0.05, 0.1, 0.2, 0.5, 1.0):
            a = np.unique(g.integers(0, 1 << 32, n)).astype(np.uint64)
            out = int(share * len(a))
            b = np.unique(np.concatenate([a[out:], g.integers(0, 1 << 32, g.integers(0, 2 * out + 1)).astype(np.uint64)]))
            apart = len(np.setxor1d(a, b))
            differ = simhash.parities_differ(simhash.long_parity(a), simhash.long_parity(b))
            assert differ <= apart and simhash.parities_differ(simhash.long_parity(b), simhash.long_parity(a)) == differ
            limit = simhash.most_apart(np.array(len(a)), np.array(len(b)), 0.8)
            if n >= 250 and apart > 2 * limit:
                told += 1
                assert differ > limit
    assert told >= 6


def test_sketch_similarity():
    a, b = np.arange(100, dtype="<u4"), np.arange(20, 120, dtype="<u4")
    assert simhash.similarity(a, b) == 80 / 120 and simhash.similarity(a[:0], b) == 0 and simhash.similarity(a[:0], a[:0]) == 1


def vector_rows():
    g = np.random.default_rng(5)
    base = g.standard_normal((60, 16))
    close = [v + 0.03 * g.standard_normal(16) for v in base[:20] for _ in range(3)]
    hot = [base[30] + 0.02 * g.standard_normal(16) for _ in range(80)]
    every = [*base, *close, *hot, *base[:5], base[6] * 3]
    rows = [(i, [float(x) for x in v], i % 2 if i < 60 else 0) for i, v in enumerate(every)]
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0, None] * 8, 0), (903, [float("nan")] * 16, 0), (904, [1.0] * 16, None), (905, [], 0), (906, [1.0] * 8, 0)]
    return rows + bad


def test_near_vectors(spark):
    rows = vector_rows()
    out = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v), k) for i, v, k in rows if i < 900]
    unit = {i: v / np.linalg.norm(v) for i, v, _ in good}
    label = {i: k for i, _, k in good}
    pairs = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    links = {i: sum(i in p for p in pairs) for i in unit}
    roots = components(list(unit), pairs)
    assert len(out) == len(rows)
    for i in unit:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (links[i], roots[i], roots[i] == i), i
    for i in range(900, 907):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)


def test_big_component_counts_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rows = vector_rows()
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    hot = out.where("vec_id >= 120 and vec_id < 200").agg(F.min("n_links"), F.max("n_links")).first()
    assert hot[0] >= 75 and hot[1] <= 90


@pytest.mark.parametrize("dims, cosine, copies", [(64, 0.9815, 3000), (256, 0.985, 2000)])
def test_star_larger_than_all_windows(spark, dims, cosine, copies):
    g = np.random.default_rng(7)
    base = g.standard_normal(dims)
    base /= np.linalg.norm(base)
    noise = g.standard_normal((copies, dims))
    noise -= (noise @ base)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    every = np.concatenate([[base], cosine * base + (1 - cosine**2) ** 0.5 * noise, g.standard_normal((500, dims))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(every)]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert sum(r.component_id == 0 for r in out) >= copies * 0.999 and sum(r.kept for r in out) <= 501 + copies * 0.001
    assert sum(r.n_links != links[r.vec_id] for r in out) <= 1 + copies * 0.001


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    g = np.random.default_rng(1)
    rows = [(i, [float(x) for x in g.standard_normal(8)]) for i in range(200)] + [(200 + i, [0.5] * 8) for i in range(60)]
    rows += [(500, None), (550, [1.0, None]), (600, [float("inf")] * 8), (None, [1.0] * 8), (650, [1.0, 2.0]), (3, rows[3][1])]
    rows += [(50, rows[50][1]), (100, [1.0] * 8)]  # a repeated query, and another vector with a query's id
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect()
    whole = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for a, (q, x) in enumerate(whole):
        if q % 50 == 0:
            same = sorted((-int(x @ v), i) for b, (i, v) in enumerate(whole) if b != a and len(v) == len(x))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(same[:5], 1)]
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in out) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), 5, 50).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e5, 3.0]), (2, [1e5, 2.0]), (3, [1e4, 9.0])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 50).orderBy("rank").collect()
    assert [(r.id, r.score) for r in out] == [(1, 65536 * (10**12 + 3)), (2, 65536 * (10**12 + 2))]
