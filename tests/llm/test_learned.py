"""Quality, toxicity and language-model scores."""

import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from oplake.llm import lm_score, quality, toxicity
from oplake.llm.common import word_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(texts, lower=True):
    return [w for _, _, w in word_chunks(pa.array(texts, pa.string()), lower)]


def test_words_match_the_pattern():
    texts = ["Ab  cd\n", "", None, "é x Y\x1fz", "a\x0bb\x0cc", "end", "start ", "x" * 3_000_000, "ÀB"]
    got = []
    for w in words_of(texts):
        for a, b in zip(w.first[:-1], w.first[1:]):
            got.append([w.text(i) for i in range(a, b)])
    want = [[x.encode() for x in WORD.findall((t or "").translate(LOWER))] for t in texts]
    assert got == want
    flat = {}
    for w in words_of(texts + ["cd ab x"]):
        for i in range(len(w.start)):
            assert flat.setdefault(w.text(i), w.hash[i]) == w.hash[i]  # a word's hash does not depend on its place
    assert len(set(flat.values())) == len(flat)


def test_quality(spark, documents, label_table, corpus):
    model = quality.fit(documents, label_table)
    out = {r.doc_id: r for r in quality.score_documents(documents, model).collect()}
    assert len(out) == len(corpus[0])
    truth = {i: q for i, q, _ in corpus[1][:-9]}
    held = [i for i in truth if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(out[i].predicted == truth[i] for i in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    kept = {r.doc_id for r in quality.keep_documents(documents, model).collect()}
    assert kept == {i for i, r in out.items() if r.predicted}


def test_quality_edges(spark, documents, label_table):
    empty, no_labels = documents.limit(0), label_table.limit(0)
    assert quality.score_documents(empty, quality.fit(empty, no_labels)).count() == 0
    flat = quality.fit(documents, no_labels)
    assert {round(r.score, 6) for r in quality.score_documents(documents, flat).collect()} == {0.5}
    ones = quality.fit(documents, label_table.where("quality = 1"))
    assert all(r.score > 0.9 for r in quality.score_documents(documents, ones).collect())
    clash = documents.selectExpr("doc_id", "text", "1 AS score", "2 AS held_out").unionByName(spark.createDataFrame([(None, None, 1, 2), (3, "a", 1, 2), (3, "a", 1, 2)], "doc_id long, text string, score int, held_out int"))
    assert quality.score_documents(clash, quality.fit(clash, label_table.unionByName(spark.createDataFrame([(None, None, None), (5, 0, 0)], label_table.schema)))).count() == clash.count()


def test_dual_coordinate_descent_separates():
    rows = [np.array([1, 2]), np.array([1, 3]), np.array([4, 2]), np.array([4, 3])]
    values = [np.ones(2)] * 4
    y = np.array([1.0, 1.0, -1.0, -1.0])
    w, b = quality.dual_coordinate_descent(rows, values, y, np.full(4, 10.0), 100, 1)
    assert all(y[i] * (w[rows[i]].sum() + b) > 0.98 for i in range(4))


def test_quality_descent_finds_the_minimum():
    """The primal objective at the solution against small steps in every direction that matters, and
    against a plain subgradient method started elsewhere."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(60)]
    values = [rng.normal(size=len(r)).astype(np.float32) for r in rows]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = np.full(60, 0.7)

    def objective(w, b):  # the bias is a weight too, of an indicator that every row has
        margin = np.array([w[r] @ v + b for r, v in zip(rows, values)])
        return 0.5 * (w @ w + b * b) + float((cost * np.maximum(0, 1 - y * margin)).sum())

    w, b = quality.dual_coordinate_descent(rows, values, y, cost, 3000, 1, 1e-9)
    w = w[:30]
    best = objective(w, b)
    for _ in range(300):
        step = rng.normal(size=30) * 10.0 ** rng.uniform(-4, -1)
        assert objective(w + step, b + rng.normal() * 1e-3) > best - 1e-5
    u, c = np.zeros_like(w), 0.0
    for t in range(1, 6000):
        margin = np.array([u[r] @ v + c for r, v in zip(rows, values)])
        g, d = u.copy(), c
        for i in np.flatnonzero(y * margin < 1):
            g[rows[i]] -= cost[i] * y[i] * values[i]
            d -= cost[i] * y[i]
        u, c = u - g / (t + 50), c - d / (t + 50)
    assert objective(u, c) > best - 1e-5 and objective(u, c) < best * 1.02 + 0.05


def test_quality_score_by_brute_force(spark, documents, label_table, corpus):
    """Scores against a second implementation that counts n-grams text by text: very long, odd and empty ones too."""
    model = quality.fit(documents, label_table)
    texts = [d[1] for d in corpus[0]][::9] + ["", None, " ", "A", "one Two", "word " * 40_000 + "END!", "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_documents(df, model).collect()}
    for i, t in enumerate(texts):
        (words,) = words_of([t], lower=False)
        n, h, s = len(words.hash), [int(x) for x in words.hash], [int(x) for x in quality.shapes(words)]
        mask, one = (1 << 64) - 1, lambda v: int(quality.mix64(np.array([v], dtype=np.uint64))[0])
        slots = set()
        if n:
            grams = set(h) | {(3 * a + 7 * b) & mask for a, b in zip(h, h[1:])}
            kinds = (collections.Counter(s), collections.Counter((5 * a + 11 * b) & mask for a, b in zip(s, s[1:])), collections.Counter((13 * a + 17 * b + 19 * c) & mask for a, b, c in zip(s, s[1:], s[2:])))
            for k, counts in enumerate(kinds):
                for level, share in enumerate((0.0, 0.02, 0.1, 0.3)):
                    grams |= {one((g + 1000 * (k + 1) + level) & mask) for g, c in counts.items() if c > share * n}
            grams |= {one(10_000 + int(len(set(h)) / n * 10)), one(20_000 + int(math.log2(n) * 2))}
            slots = {1 + g % (quality.SLOTS - 1) for g in grams}
        slots = sorted(slots) or [0]
        norm = math.sqrt(sum(model.ratio[k] ** 2 for k in slots)) or 1.0
        z = model.slope * (sum(model.weight[k] for k in slots) / norm + model.bias) + model.shift
        assert abs(got[i] - 1 / (1 + math.exp(-max(-60, min(60, z))))) < 1e-6


def test_toxicity_by_brute_force(spark, documents, label_table, corpus):
    """Severity against a second implementation that splits and strips words text by text; repeated
    rows, null ids and columns of clashing names; very long texts."""
    model = toxicity.fit(documents, label_table)
    texts = [d[1] for d in corpus[0]][::7] + ["", None, "!!", "scumbag " * 30_000, "(Scumbag!)", "scum-bag", "x" * 100_000 + " moronic,"]
    rows = [(i if i % 5 else None, t, 1.0, "s") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, grade string")
    got = collections.Counter((r.doc_id, round(r.score, 7), round(r.severity, 7), r.grade, r.toxic) for r in toxicity.score_documents(df, model).collect())
    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    want = collections.Counter()
    for i, t, _, _ in rows:
        seen = {w.strip(marks) for w in WORD.findall((t or "").translate(LOWER))}
        slots = set()
        for w in seen:
            (one,) = words_of([w or "!"])
            slots |= set(next(toxicity.document_features(one)).tolist())
        z = sum(weight.get(k, 0.0) for k in slots)
        p = [1 / (1 + math.exp(-max(-60, min(60, z - c)))) for c in model.thresholds]
        want[i, round(p[0], 7), round(sum(p), 7), sum(x >= 0.5 for x in p), int(p[0] >= 0.5)] += 1
    assert got == want


def test_toxicity_fit_is_likely():
    """The fitted likelihood against a plain gradient method on all rows at once."""
    rng = np.random.default_rng(3)
    telling = rng.permutation(toxicity.SLOTS)[:12].astype(np.int32)
    features, grade = [], []
    for i in range(600):
        g = int(rng.integers(0, 3))
        own = telling[rng.random(12) < (0.02, 0.35, 0.7)[g]]
        features.append(np.unique(np.concatenate([own, rng.integers(0, toxicity.SLOTS, 15).astype(np.int32)])).astype(np.int32))
        grade.append(g)
    grade = np.array(grade)
    model = toxicity.fit_rows(features, grade, (int((grade == 0).sum()), int((grade > 0).sum())))
    x = np.array([[np.isin(s, f) for s in model.slots] for f in features], dtype=float)

    def loss(w, t):
        s = 1 / (1 + np.exp(-(x @ w)[:, None] + t))
        full = np.concatenate([np.ones((len(x), 1)), s, np.zeros((len(x), 1))], axis=1)
        return -float(np.log(np.maximum(full[np.arange(len(x)), grade] - full[np.arange(len(x)), grade + 1], 1e-12)).mean())

    w, t = np.zeros(len(model.slots)), np.array([0.0, 1.0])
    for _ in range(1500):
        base, g = loss(w, t), []
        s = 1 / (1 + np.exp(-(x @ w)[:, None] + t))
        full = np.concatenate([np.ones((len(x), 1)), s, np.zeros((len(x), 1))], axis=1)
        d, at = full * (1 - full), np.arange(len(x))
        p = full[at, grade] - full[at, grade + 1]
        w = w + 0.5 * x.T @ ((d[at, grade] - d[at, grade + 1]) / p) / len(x)
        dt = [(((grade + 1 == k) * d[:, k] - (grade == k) * d[:, k]) / p).mean() for k in (1, 2)]
        t = t + 0.5 * np.array(dt)
    assert loss(model.weights, model.thresholds) < loss(w, t) * 1.03 + 0.01


def test_toxicity(spark, documents, label_table, corpus):
    model = toxicity.fit(documents, label_table)
    assert all(np.diff(model.thresholds) >= 0)
    out = {r.doc_id: r for r in toxicity.score_documents(documents, model).collect()}
    truth = {i: t for i, _, t in corpus[1]}
    held = [i for i in truth if out[i].held_out]
    assert all(out[i].toxic == truth[i] for i in held) and sum(truth[i] for i in held) > 3
    assert all(out[i].severity > out[j].severity for i in held for j in held if truth[i] > truth[j])
    kept = {r.doc_id for r in toxicity.keep_documents(documents, model).collect()}
    assert kept == {i for i, r in out.items() if not r.toxic}
    assert toxicity.score_documents(documents.limit(0), model).count() == 0
    flat = toxicity.fit(documents, label_table.limit(0))
    assert len({r.score for r in toxicity.score_documents(documents, flat).collect()}) == 1


def test_ordinal_grades_are_ordered():
    """Given grades, more of the words that tell them means a higher expected grade."""
    rng = np.random.default_rng(0)
    features, y = [], []
    for i in range(900):
        g = int(i % 3)
        features.append(np.unique(np.concatenate([rng.integers(100, 4000, 20), rng.permutation(30)[: 5 * g]])).astype(np.int32))
        y.append(g)
    model = toxicity.fit_rows(features, np.array(y), (300, 600))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    z = np.array([sum(w for s, w in zip(model.slots, model.weights) if s in set(f.tolist())) for f in features])
    means = [z[np.array(y) == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]


def base_scores(rows):
    toks = {i: WORD.findall((t or "").translate(LOWER)) for i, t in rows}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in train for w in toks[i])
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    return n, {i: (len(t) + 1, sum(w in c for w in t) + 1, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) + math.log10((ends + 1) / (n + v + 1))) for i, t in toks.items()}


def test_toxicity_of_few_labels():
    """Ten toxic rows of 68 suffice to find texts by words that five or six of them hold and no clean one does."""
    bad = ["moron", "trash", "scum", "loser"]
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 30)) for _ in range(68)]
    for i in range(10):
        texts[i] += f" {bad[i % 4]} {bad[(i + 1) % 4]}"
    y = np.array([1] * 10 + [0] * 58)
    (words,) = words_of(texts)
    model = toxicity.fit_rows(list(toxicity.document_features(words)), y, (58, 10))
    p = model.predict(words)[:, 0]
    assert (p[:10] > 0.5).all() and (p[10:] < 0.5).all()


def test_toxicity_strips_whole_runs_of_punctuation():
    (words,) = words_of(["scum", "scum!!!!!!!!!!!!", "............(scum", '"' * 20 + "scum" + "?" * 30, "a-scum", "!" * 30])
    slots = [f.tolist() for f in toxicity.document_features(words)]
    assert slots[0] == slots[1] == slots[2] == slots[3] != slots[4] and slots[5] != slots[0]


def test_lm_scores(spark, documents, corpus):
    rows = [(d[0], d[1]) for d in corpus[0]]
    n, want = base_scores(rows)
    out = {r.doc_id: r for r in lm_score.score_documents(documents).collect()}
    for i, (tokens, known, base) in want.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    copies = {}
    for i, t in rows:
        copies.setdefault(t or "", set()).add(round(out[i].score, 9))
    assert all(len(s) == 1 for s in copies.values())  # a text's score is its own
    prose = [i for i, t in rows if t and 150 < len(t) < 1500 and out[i].held_out]
    assert sum(out[i].score for i in prose) > sum(out[i].base_score for i in prose)


def test_lm_without_training(spark):
    df = spark.createDataFrame([(i, "a bc") for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2] + [(None, None)][:0], "doc_id long, text string")
    out = lm_score.score_documents(df).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 and math.isfinite(r.score) for r in out) and len(out) == df.count()
    assert lm_score.score_documents(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (1, "x", 2), (1, "x", 2), (2, "", 3)], "doc_id long, text string, score int")
    assert lm_score.score_documents(odd).count() == 4


def mixer(rng):
    h = np.sort(rng.integers(1, 1 << 62, 500).astype(np.uint64))
    codes = lm_score.Codes(h, rng.integers(3, 900, 500), 700, 20, rng.integers(0, 99, 257 * 257))
    codes.set_classes([rng.integers(0, 500, 40) for _ in range(100)])
    counts = [rng.integers(0, 60, (1 << lm_score.TABLE_BITS, 2)).astype(np.uint32) for _ in range(lm_score.TABLES)]
    return lm_score.Mixer(codes, counts, lm_score._initial_weights())


def test_lm_is_a_distribution():
    """The two answers of a decision add up to 1, and all trees are complete prefix codes."""
    z = np.linspace(-17, 17, 999).astype(np.float32)
    one, none = lm_score.Mixer.costs(z, np.ones(999, np.int8)), lm_score.Mixer.costs(z, np.zeros(999, np.int8))
    assert np.allclose(np.exp(-one) + np.exp(-none), 1, atol=1e-5)
    codes = mixer(np.random.default_rng(1)).codes
    edges = [0, *range(codes.first_byte, len(codes.length) + 1, lm_score.FOLLOW)]
    assert len(edges) == lm_score.FOLLOW + 2
    for a, b in zip(edges, edges[1:]):
        assert abs(sum(2.0 ** -int(x) for x in codes.length[a:b]) - 1) < 1e-9


def test_lm_score_is_causal_and_apart():
    """A document's score does not depend on what it is scored beside."""
    m = mixer(np.random.default_rng(2))
    texts = ["alpha beta gamma alpha beta gamma", "", "zeta " * 4000, "alpha beta"]
    together = np.concatenate([m.score(w)[0] for w in words_of(texts)])
    alone = np.array([m.score(words_of([t])[0])[0][0] for t in texts])
    assert np.allclose(together, alone, rtol=1e-6)
    longer = m.score(words_of(["alpha beta gamma"])[0])[0][0]
    assert longer < alone[3] or longer < 0


def test_lm_tables_grow_with_the_training_words(spark):
    """Tables and words with a path of their own grow with the counted words, and all slots are used."""
    sizes = [10**k for k in range(6, 12)]
    for f in (lm_score.table_bits, lm_score.head_words):
        assert [f(n) for n in sizes] == sorted(f(n) for n in sizes) and f(10**11) > f(10**10) > f(10**9)
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(1, 1 << 62, 500).astype(np.uint64))
    codes = lm_score.Codes(h, rng.integers(3, 900, 500), 700, 20, rng.integers(0, 99, 257 * 257), 22)
    texts = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(300)) for _ in range(8)]
    d = [lm_score.Decisions(w, codes, False) for w in words_of(texts)]
    tables = lm_score.learn_model(spark.createDataFrame([(t,) for t in texts], "text string"), codes, 2).counts
    for k, table in enumerate(tables):
        slots = np.concatenate([x.slots[k] for x in d])
        assert table.shape == (1 << 22, 2) and slots.max() >= 3 << 20
        assert (table.sum(axis=1) == np.bincount(slots, minlength=1 << 22)).all()


def brute_logit(m, d, i):
    """(inputs, gate) of decision ``i`` from the tables, one at a time."""
    x, gate = [float(m.codes.logit[d.node[i]])], int(d.node[i] >= m.codes.word_nodes)
    for k in range(lm_score.TABLES):
        none, one = (int(v) for v in m.counts[k][d.slots[k][i]])
        x.append(math.log(one + 0.4) - math.log(none + 0.4))
        n = one + none
        gate = 4 * gate + (n > 0) + (n > 2) + (n > 15)
    match = int(d.match[i])
    return [*x, match, lm_score._BIAS], 3 * gate + (0 if not match else 2 if i in d.tok_start.tolist() else 1)


def brute_score(m, words):
    """log10 of the probability of one text, decision by decision, its own corrections included."""
    d = lm_score.Decisions(words, m.codes, True)
    own, curve, up, down = [0.0] * 6, [0.0] * 6, [0.0] * 6, [0.0] * 6
    total, size, at = 0.0, lm_score.FIRST_SEGMENT, 0
    for i in range(len(d.bit)):
        x, gate = brute_logit(m, d, i)
        base = max(-16.0, min(16.0, sum(w * v for w, v in zip(m.weights[gate], x))))
        z = max(-16.0, min(16.0, base + sum(w * v for w, v in zip(own, x)))) if any(own) else base
        p = 1 / (1 + math.exp(-z))
        total += math.log(p if d.bit[i] else 1 - p)
        for k in range(6):
            up[k] += (d.bit[i] - p) * x[k]
            down[k] += p * (1 - p) * x[k] ** 2
        at += 1
        if at == size:
            curve = [lm_score.FADE * c + h for c, h in zip(curve, down)]
            own = [max(-1.0, min(1.0, w + g / (3 * c + lm_score.PRIOR))) for w, g, c in zip(own, up, curve)]
            up, down, at, size = [0.0] * 6, [0.0] * 6, 0, min(4 * size, lm_score.SEGMENT)
    return total / math.log(10)


def test_lm_score_by_brute_force():
    """Whole scores against a second implementation: short, empty, repeating and unknown texts, from the
    first correction on; a correction gains where the weights are wrong, and never reaches back."""
    rng = np.random.default_rng(2)
    m = mixer(rng)
    m.weights = m.weights + rng.normal(size=m.weights.shape) * 0.1
    texts = ["alpha beta gamma delta " * 12, "", "zeta", "x y x y x y z " * 9, " ".join(f"w{i}" for i in range(60))]
    scoring = m.for_scoring()
    for t in texts:
        (words,) = words_of([t])
        want = brute_score(m, words)
        assert abs(scoring.score(words)[0][0] - want) < 0.004 * max(1.0, abs(want))


def test_lm_training_is_online(monkeypatch):
    """Weights and counts of a task against a second implementation that predicts, corrects, counts."""
    rng = np.random.default_rng(4)
    codes = mixer(rng).codes
    for name, value in (("LEARN", 64), ("CURVE", 1), ("RENEW", 0)):
        monkeypatch.setattr(lm_score, name, value)
    own = lm_score.Mixer.start(codes)
    weights = own.weights.copy()
    counts = [np.zeros_like(c) for c in own.counts]
    for text in ("alpha beta gamma " * 6, "beta gamma alpha x " * 5):
        (words,) = words_of([text])
        d = lm_score.Decisions(words, codes, True)
        other = lm_score.Mixer(codes, counts, weights)
        seen = [brute_logit(other, d, i) for i in range(len(d.bit))]
        for a in range(0, len(d.bit), 64):
            up, down = np.zeros_like(weights), np.zeros_like(weights)
            for i in range(a, min(a + 64, len(d.bit))):
                x, g = np.array(seen[i][0]), seen[i][1]
                p = 1 / (1 + math.exp(-max(-16.0, min(16.0, float(weights[g] @ x)))))
                up[g] += (d.bit[i] - p) * x
                down[g] += p * (1 - p) * x * x
            weights = weights + lm_score.RATE * up / (3 * down + 20)
        for k in range(lm_score.TABLES):
            for slot, bit in zip(d.slots[k], d.bit):
                counts[k][slot, bit] += 1
        assert own.learn(words) == len(d.bit)
        assert np.allclose(own.weights, weights, atol=2e-3) and all((a == b).all() for a, b in zip(own.counts, counts))


def test_lm_byte_pairs():
    """What follows what within words, against a count word by word; words of two documents may touch."""
    texts = ["ab  abc", "c", "", "d\ne", "é x"]
    got = sum(lm_score.byte_pairs(w) for w in words_of(texts))
    want = collections.Counter()
    for t in texts:
        for w in WORD.findall(t):
            b = [256, *w.encode(), 256]
            want.update(x * 257 + y for x, y in zip(b, b[1:]))
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want


def test_lm_blocks_keep_counts():
    for top in (0, 3, 255, 256, 65_535, 65_536, 1 << 33):
        c = np.array([0, 1, top], dtype=np.int64)
        assert lm_score._wide(lm_score._narrow(c)).tolist() == c.tolist()
    assert len(lm_score._narrow(np.zeros(8, np.int64))) == 9


def test_lm_short_cuts_give_the_same():
    """What saves time against the plain forms: counts looked up packed, known matches, words of classes by chunk."""
    rng = np.random.default_rng(8)
    m = mixer(rng)
    m.counts[0][:9] = [[0, 0], [63, 63], [63, 64], [64, 0], [0, 64], [127, 1], [1 << 20, 3], [7, 1 << 31], [0, 5]]
    m.renew()
    assert len(lm_score._PACKED) == lm_score._FEW**2
    for c, ready in zip(m.counts, m._ready):
        none, one = c[:5000].astype(np.int64).T
        step = np.rint((np.log(one + 0.4) - np.log(none + 0.4)) * 256)
        sure = (none + one > 0) * 1 + (none + one > 2) + (none + one > 15)
        assert np.abs((ready[:5000] >> 2) - step).max() <= 1 and ((ready[:5000] & 3) == sure).all()
    for texts in (["a b c a b c a b", "", "a b c"], ["x"], ["p q r s " * 40, "p q r s"]):
        (words,) = words_of(texts)
        d = lm_score.Decisions(words, m.codes, True)
        assert d.matched.tolist() == np.flatnonzero(d.match).tolist() and (len(d.matched) > 0) == (len(texts) > 1)
    text, place = np.array([0, 0, 2, 0, 2]), np.array([5, 2047, 1, 5, 1])
    size, places, count = lm_score.class_block(text, place, 4)
    assert (size.tolist(), places.tolist(), count.tolist()) == ([2, 0, 1, 0], [5, 2047, 1], [2, 1, 2])
    for data in (b"", b"x", rng.bytes(5000), bytes(70_000)):
        assert lm_score._unpress(lm_score._press(data)) == data


def test_lm_runs_in_the_jvm_as_in_numpy(spark, monkeypatch):
    """Scores, counts and weights of the JVM against the numpy form, and no row of texts goes to Python for them."""
    rng = np.random.default_rng(9)
    texts = [None, "", " \t\n", "Alpha BETA alpha beta alpha beta gamma", "h\u00e9llo \u4e2d\u6587 w1 w2 w1 w2", "w3 " * 900, "x" * 700, "\x0b\x0cw5\x1cw6 \x7f"]
    texts += [" ".join(f"w{k}" for k in rng.integers(0, 90, n)) for n in (1, 3, 40, 700)]
    h, c = np.unique(np.concatenate([w.hash for w in words_of([" ".join(f"w{k}" for k in range(60)) + " alpha beta"])]), return_counts=True)
    codes = lm_score.Codes(h, c * rng.integers(3, 900, len(h)), 700, 20, rng.integers(0, 99, 257 * 257))
    codes.set_classes([rng.integers(0, len(h), 40) for _ in range(100)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lm_score, "LEARN", 64)
    own = lm_score.Mixer.start(codes)
    for words in words_of([t or "" for t in texts]):
        own.learn(words)
    got = lm_score.learn_model(df.select("text"), codes, 1)
    assert all((x == y).all() for x, y in zip(own.counts, got.counts)) and np.allclose(own.weights, got.weights, atol=2e-3)
    counts = [rng.integers(0, 300, (1 << codes.table_bits, 2)).astype(np.uint32) for _ in range(lm_score.TABLES)]
    mix = lm_score.Mixer(codes, counts, lm_score._initial_weights() + rng.normal(size=own.weights.shape) * 0.1).for_scoring()
    engine = lm_score.scoring_engine(spark, mix, h[::2], c[::2])
    fields = "uid long, h long, doc_id long, n_tokens long, n_known long, part double, score double, octets long"
    scored = lm_score.jvm.map_rows(df.selectExpr("doc_id", "cast(text as binary)"), engine.scorer(), fields)
    assert not re.search("Arrow|Python", scored._jdf.queryExecution().executedPlan().toString())
    rows = scored.collect()
    for i, t in enumerate(texts):
        (words,) = words_of([t or ""])
        (r,) = [r for r in rows if r.doc_id == i and r.h is None]
        (want,), d = mix.score(words)
        assert abs(r.score - want) < 5e-4 * max(1, abs(want))
        assert (r.n_tokens, r.n_known, r.octets) == (len(words.hash) + 1, d.known.sum(), len((t or "").encode()))
        assert abs(r.part - np.log10(codes.count[d.known_at[d.known]] + 1.0).sum()) < 1e-6
        assert sorted(x.h for x in rows if x.uid == r.uid and x.h is not None) == sorted(words.hash[~d.known].view(np.int64).tolist())


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    """Classes and mixing weights come from every training text, also of tables above a few thousand."""
    seen, rng = {}, np.random.default_rng(6)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 40, 12))) for i in range(4200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)
    fit, model = lm_score.Codes.fit_classes, lm_score.learn_model

    def fit_classes(self, starts, total, texts, sums):
        def checked(*a):
            words, share, like = sums(*a)
            seen["texts"], seen["words"] = share.sum(axis=1), words.sum(axis=(1, 2))
            return words, share, like

        seen["total"] = total.sum()
        fit(self, starts, total, texts, checked)

    def learn_model(train, *a):
        seen["learned"] = train.count()
        return model(train, *a)

    monkeypatch.setattr(lm_score.Codes, "fit_classes", fit_classes, raising=False)
    monkeypatch.setattr(lm_score, "learn_model", learn_model)
    assert lm_score.score_documents(df).count() == len(rows)
    assert seen["learned"] == n and seen["total"] == 12 * n
    assert np.allclose(seen["texts"], n) and np.allclose(seen["words"], 12 * n, rtol=1e-4)


def test_hash_index():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    index = lm_score.HashIndex(keys)
    ask = np.concatenate([keys[::3], rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    at, known = index(ask)
    assert (known == np.isin(ask, keys)).all() and (keys[at[known]] == ask[known]).all()
    assert not lm_score.HashIndex(keys[:0])(ask)[1].any()


def test_fitting_holds_the_slots_once():
    """On the driver the sampled rows' slots arrive packed, and no second table of their size is made."""
    rng = np.random.default_rng(1)
    features = [np.unique(rng.integers(0, quality.SLOTS, 4000)).astype("<i4") for _ in range(2500)]
    for f in (*features[:20], features[0][:1], features[0][:0], np.array([0, quality.SLOTS - 1], dtype="<i4")):
        assert quality.unpack_slots(packed := quality.pack_slots(f)) == f.tobytes()
        assert len(packed) < 20 + len(f) * 2
    labels = (rng.random(len(features)) < 0.5).astype(int)
    tracemalloc.start()
    quality.fit_rows(features, labels, (1250, 1250), epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(f.nbytes for f in features)
