"""Mixing, personal data, licences, models, and the pipeline, on small tables with known answers."""

import pathlib
import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tallyforge.llm import licenses, mixing, pii, quality, toxicity


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in open_)
        got = capped | {s: left * weight[s] / w for s in open_}
        over = [s for s in open_ if got[s] > 3 * sizes[s]]
        if not over:
            return got
        capped |= {s: 3 * sizes[s] for s in over}


def mixed(seed=1, n=400):
    r = random.Random(seed)
    source = ["hot"] * 5 + ["é", "a", "B", None, "tiny"]
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(source)) for i in range(n)]
    return [x for x in rows if x[2] != "tiny"] + [(9001, "one two", "tiny"), (9002, None, "a"), (9003, "", None), (None, "x y z", "B"), (5, rows[5][1], rows[5][2])]


def test_mix_meets_its_targets(docs):
    rows = mixed()
    out = mixing.decide(docs(rows)).collect()
    sizes, of = Counter(), {i: s for i, _, s in rows}
    for _, t, s in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((i or -1, words(t)) for i, t, _ in rows)
    taken = Counter()
    for r in out:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, s
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(repr, mixing.decide(docs(rows).repartition(3)).collect())) == sorted(map(repr, out))


def test_mixed_documents_are_the_decided_ones(docs):
    rows = mixed(2, 150)
    decided, out = mixing.decide(docs(rows)), mixing.mix_documents(docs(rows))
    assert out.columns == docs([]).columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.times for r in decided.where("doc_id <> 5 and times > 0").collect()}) + Counter(
        {5: sum(r.times for r in decided.where("doc_id = 5").collect()), None: sum(r.times for r in decided.where("doc_id is null").collect())}
    )


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None), (2, "  ", "b")], [(1, "only one", "a")]])
def test_mix_of_little(docs, rows):
    out = mixing.decide(docs(rows)).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(t):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    r = random.Random(8)
    parts = ["a", "b@c", ".", "@", "-", "1", "23", "4111 1111 1111 1111", "255", "256", "+1 (555) 010-2020", "é", " ", "x.y@mail.example.com", "10.0.0.1", "+", "(", "\n", "0", "٣"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(20000)] + ["1" * 5000, "a" * 50000 + "@", "a@" * 2000, "1.1.1.1" * 300, "+1" * 999]
    texts += ["x " + "0" * 4200 + ".1.2.3", "1.2.3." + "0" * 4200 + "7 x"]
    for t in texts:
        got = [(s.start, s.order, s.end) for s in pii.find_spans(t) if s.order < 4]
        assert got == brute_spans(t), t[:80]


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32.") == ["iban"] and kinds("GB83 WEST 1234 5698 7654 32") == []
    assert kinds("his social security number 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("x " + "0" * 5000 + ".1.2.3") == kinds("1.2.3." + "0" * 9000) == ["ip"]  # past the digits that int() reads
    near, far = pii.find_spans("mail me: a@b.co")[0].score, pii.find_spans("x a@b.co")[0].score
    assert near > far


def test_scan_and_redact(docs):
    rows = [(1, "é mail a.b@c.org or +1 (555) 010-2020"), (2, None), (None, "10.0.0.1"), (3, ""), (3, "")]
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.scan(docs(rows)).collect()}
    assert spans == {1: [("email", 7, 16), ("phone", 20, 37)], 2: [], None: [("ip", 0, 8)], 3: []}
    out = pii.redact(docs(rows))
    assert out.columns == docs([]).columns and {r.doc_id: r.text for r in out.collect()} == {1: "é mail <email> or <phone>", 2: None, None: "<ip>", 3: ""}
    assert pii.redact(docs([])).count() == 0


def test_licences(spark, docs):
    texts = [
        "Copyright (c) 2020 Me & You\nAll rights reserved.\n\n" + licenses.MIT.upper(), "The MIT Licence (MIT)\r\n# Copyright 2020 X\r\n" + licenses.MIT.replace('"', "“"),
        licenses.BSD_TWO + licenses.BSD_WARRANTY, licenses.BSD_TWO + licenses.BSD_THREE + licenses.BSD_WARRANTY.replace("HOLDER", "OWNER"), "ISC Licence\nCopyright © X\n\n" + licenses.ISC_GRANT + licenses.ISC_CONDITION + licenses.ISC_WARRANTY,
        licenses.MIT + " And more.", "", None, "Ünïcode text © x", licenses.ZLIB.replace("acknowledgment", "acknowledgement"),
    ]
    rows = list(enumerate(texts)) + [(None, texts[0]), (4, texts[4])]
    out = licenses.scan(docs(rows)).collect()
    named = {r.doc_id: r.license for r in out}
    assert [named[i] for i in range(10)] == ["MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", None, None, None, None, "Zlib"] and len(out) == len(rows)
    duck = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    duck.register("documents", documents)
    assert sorted(duck.execute(licenses.oracle()).fetchall(), key=repr) == sorted(map(tuple, out), key=repr)
    assert licenses.scan(docs([])).count() == 0


def test_licences_in_any_wrap(docs):
    bodies = {"MIT": licenses.MIT, "BSD-2-Clause": licenses.BSD_TWO + licenses.BSD_WARRANTY, "BSD-3-Clause": licenses.BSD_TWO + licenses.BSD_THREE + licenses.BSD_WARRANTY}
    rows, want = [], {}
    for name, body in bodies.items():
        words = body.split()
        at = next(i for i, w in enumerate(words) if w == "COPYRIGHT")
        wraps = [textwrap.fill(" ".join(words), width) for width in (40, 60, 72, 78, 100, 120, 10**6)] + [" ".join(words[:at]) + "\n" + " ".join(words[at:])]
        for wrap in wraps:
            title = name.replace("BSD-", "BSD ") + " License"
            one_line = f"{title} Copyright (c) 2020 Me. All rights reserved. " + wrap if "\n" not in wrap else wrap
            for text in (wrap, "Copyright (c) 2019-2021 Me & You\nCopyright 2022 X\nAll rights reserved.\n\n" + wrap, "Copyright (c) 2020 Me " + wrap, one_line):
                want[len(rows)] = name
                rows.append((len(rows), text))
    for text in (licenses.MIT + " And more.", "Copyright (c) 2020 Me. A text of another kind.", "copyright holders", " ".join(licenses.MIT.split()).replace("COPYRIGHT HOLDERS BE LIABLE", "")):
        want[len(rows)] = None
        rows.append((len(rows), text))
    assert {r.doc_id: r.license for r in licenses.scan(docs(rows)).collect()} == want
    for _, text in rows[:8]:
        assert licenses.canonical_text(text) == licenses.canonical_text(licenses.MIT)


#: As the ISC and Apache texts are usually laid out: lines that begin with "copyright" or "(c)" and are no notices.
USUAL_ISC = """ISC License

Copyright (c) 2004, Someone Else

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


def test_real_lines_are_no_notices(docs):
    body = "You may copy it if:\n(a) it is whole\n(c) you keep the\ncopyright notice\u2028copyright lines\nCOPYRIGHT HOLDERS AGREE"
    assert licenses.canonical_text(body) == "you may copy it if a it is whole c you keep the copyright notice\u2028copyright lines copyright owners agree"
    rows = [(1, body), (2, USUAL_ISC), (3, USUAL_ISC.replace("copyright notice", "notice"))]
    out = {r.doc_id: (r.digest, r.license) for r in licenses.scan(docs(rows)).collect()}
    assert {i: x for i, (x, _) in out.items()} == {i: licenses.digest(t) for i, t in rows}
    assert [out[i][1] for i in (1, 2, 3)] == [None, "ISC", None]


def test_whole_long_licences(docs):
    folder = pathlib.Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no texts of long licences on this machine")
    files = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows, want = [], []
    for name, file in files.items():
        text = (folder / file).read_text(errors="replace")
        wrapped = "\n\n".join(x if "(C)" in x or "<year>" in x else textwrap.fill(x, 50) for x in text.split("\n\n"))
        for t, found in ((text, name), (text.upper().replace("\n", "\r\n"), name), (wrapped, name), (text[:-200], None), ("Foreword. " + text, None)):
            rows.append((len(rows), t))
            want.append(found)
    cut = rows[0][1].split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS"
    got = {r.doc_id: r.license for r in licenses.scan(docs([*rows, (999, cut)])).collect()}
    assert [got[i] for i in range(len(rows))] == want and got[999] == "Apache-2.0"


def labelled(n, mark, seed):
    r = random.Random(seed)
    syllables = ["ti", "on", "er", "an", "th", "re", "es", "nd", "ou", "ha"]
    texts, y = [], []
    for i in range(n):
        t = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(5, 160))]
        y.append(i % 3 == 0)
        if y[-1]:
            for _ in range(2):
                t.insert(r.randrange(len(t)), mark(r))
        texts.append(" ".join(t))
    return texts, np.array(y, int)


def test_toxicity_learns_word_stems():
    mark = lambda r: "grrzk" + r.choice(["a", "in", "ost", "ell", "ur", "imp"])
    texts, y = labelled(300, mark, 1)
    model = toxicity.train(texts, y)
    unseen, truth = labelled(200, lambda r: "grrzk" + r.choice(["oth", "ando", "ees"]), 2)
    assert ((model.score(unseen) >= 0.5) == truth).mean() >= 0.95
    empty = model.score(["", " . "])
    assert np.isfinite(empty).all() and (empty < 0.5).all()
    long = " ".join(unseen[i] for i in np.nonzero(truth == 0)[0])
    assert model.score([long + " grrzkost grrzkell " + long])[0] > model.score([long])[0]


def test_windows_cover_every_word():
    numbers = np.arange(200)
    ends = np.array([0, 5, 5 + toxicity.WINDOW, 200])
    rows, owner = toxicity.windows(numbers, ends, 999)
    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        assert {x for r in rows[owner == i] for x in r} - {999} == set(range(a, b)) and (owner == i).any()


def test_network_gradient():
    g = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table = np.vstack([g.standard_normal((20, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS))])
    rows = g.integers(0, 21, (6, toxicity.WINDOW))
    y, w = g.integers(0, 2, 6).astype(float), np.ones(6)
    grads, d_table = net.gradients(table, rows, y, w)

    def loss(table=table):
        p = toxicity._sigmoid(net.forward(table, rows))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("out", "attend", "w0", "u0", "w1", "u1"):
        flat = net.p[name].reshape(-1)
        i = len(flat) // 2
        was, eps = flat[i], 1e-3
        flat[i] = was + eps
        up = loss()
        flat[i] = was - eps
        down = loss()
        flat[i] = was
        assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[i]) < 2e-3, name
    words = ["alpha", "beta", "a"]  # and on to what the embeddings learn
    places, which, eps = toxicity.Places(words), np.arange(3), 1e-3
    at = toxicity.GIVEN, toxicity.GIVEN + toxicity.EMBED

    def filled():
        out = table.copy()
        out[:3, at[0] :] = toxicity.embedded(net.p, places, which)
        return out

    _, d_table = net.gradients(filled(), rows, y, w)
    made = toxicity.embedding_gradients(net.p, places, which, d_table[:3, at[0] : at[1]], d_table[:3, at[1] :])
    for name in ("word", "gram"):
        i = np.unravel_index(np.abs(made[name]).argmax(), made[name].shape)
        assert abs(made[name][i]) > 1e-4
        was = net.p[name][i]
        net.p[name][i] = was + eps
        up = loss(filled())
        net.p[name][i] = was - eps
        down = loss(filled())
        net.p[name][i] = was
        assert abs((up - down) / (2 * eps) - made[name][i]) < 2e-3, name


def test_models_of_one_class_or_nothing():
    for labels in ([], [0, 0], [1, 1]):
        texts = ["some words"] * len(labels)
        t = toxicity.train(texts, np.array(labels)).score(["a b", ""])
        q = quality.train(texts, [None] * len(labels), np.array(labels)).score(["a b", ""], [3, None])
        side = bool(labels) and labels[0] == 1
        assert ((t >= 0.5) == side).all() and ((q >= 0.5) == side).all()


def test_quality_learns_structure():
    r = random.Random(3)
    texts, y = [], []
    for i in range(300):
        t = ["".join(r.choices(["ti", "on", "er", "an"], k=3)) for _ in range(r.randint(10, 80))]
        y.append(i % 4 != 0)
        texts.append(" ".join(t) + "." if y[-1] else "!! ".join(t).upper() if i % 8 else " | ".join(t))
    y = np.array(y, int)
    chars = [len(t) for t in texts]
    model = quality.train(texts[:200], chars[:200], y[:200])
    assert ((model.score(texts[200:], chars[200:]) >= 0.7) == y[200:]).mean() >= 0.95
    assert np.isfinite(model.score(["", "\n\n"], [None, -5])).all()


def test_machine_uses_the_identity():
    m = quality.Machine()
    g = np.random.default_rng(2)
    m.w[:50], m.v[:50] = g.standard_normal(50), g.standard_normal((50, quality.FACTORS))
    index, value = np.array([1, 5, 9, 30]), np.array([0.5, 2.0, 1.0, -1.0])
    got = m.forward(quality.Rows(index, value, np.array([4])))[0][0]
    pairs = sum(m.v[i] @ m.v[j] * x * y for a, (i, x) in enumerate(zip(index, value)) for j, y in list(zip(index, value))[a + 1 :])
    assert abs(got - (m.bias + m.w[index] @ value + pairs)) < 1e-4


def test_fit_leaves_held_out_labels_alone(spark, docs):
    texts, y = labelled(120, lambda r: "grrzk" + r.choice("aei"), 4)
    table = docs([*enumerate(texts), (None, "x"), (500, None)])
    labels = spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y)] + [(None, 1, 1), (500, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    sample, share = toxicity.labelled_sample(table, labels, "toxic", toxicity.not_held_out(5, 0))
    import zlib

    kept = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    assert Counter(r.text for r in sample) == Counter(texts[i] for i in kept)
    small, _ = toxicity.labelled_sample(table, labels, "toxic", toxicity.not_held_out(5, 0), rows=10)
    assert Counter(r.y for r in small) == {0: 10, 1: 10}
    model = toxicity.fit(table, labels)
    out = toxicity.with_scores(table, model)
    assert out.count() == 122 and out.schema["score"].dataType.simpleString() == "double"
    kept_docs = toxicity.without_toxic(table, model)
    assert kept_docs.columns == table.columns and kept_docs.where("text like '%grrzk%'").count() <= 2
    scored = quality.scores(table, quality.fit(table, labels))
    assert scored.count() == 122 and scored.where("score is null or score < 0 or score > 1").count() == 0


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "byte_bpe"]
    texts, y = labelled(150, lambda r: "grrzk" + r.choice(["a", "in", "ost"]), 5)
    texts[1] += " mail a.b@c.org"
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)] + [(1000 + i, texts[i], "en", "a", 1) for i in range(1, 40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.columns == columns, name
        if name == "toxicity":
            assert docs.where("text like '%grrzk%'").count() <= 5 and docs.where("doc_id < 1000").count() >= 95
        if name == "simhash_near_dedup":
            assert docs.where("doc_id >= 1000").count() == 0
        if name == "pii":
            assert docs.where("text like '%<email>%'").count() == 1 and docs.where("text like '%@%'").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
