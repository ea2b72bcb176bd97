"""Operators 1, 2, 3 and 8: models against plain versions and on held-out rows."""

import dataclasses
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenflow.llm import attention, language_id, lm_scoring, quality, toxicity
from lumenflow.llm.bpe import codec
from lumenflow.llm.common import stored

DIR = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


# Language identification


def plain_bits(texts, text, alphabet):
    """Code length by context trees of dictionaries, with escapes and exclusion, byte by byte."""
    counts = [{} for _ in range(4)]
    for t in texts:
        b = b"\n\n\n" + t
        for i in range(3, len(b)):
            for k in range(4):
                c = counts[k].setdefault(b[i - k : i], Counter())
                c[b[i]] += 1

    def p(context, s):
        if context is None:
            return 1 / 256
        c = counts[len(context)].get(context)
        lower = context[1:] if context else None
        if not c:
            return p(lower, s)
        n, q = sum(c.values()), len(c)
        left = 1 - sum(p(lower, x) for x in c)
        if s in c:
            return c[s] / (n + q) if left > 1e-12 else c[s] / n
        return q / (n + q) * p(lower, s) / left

    b = b"\n\n\n" + text
    return sum(-math.log2(p(b[i - 3 : i], b[i])) for i in range(3, len(b)))


def test_code_lengths():
    texts = {"aa": [b"the cat sat", b"a hat"], "bb": [b"der hut", b"die katze"]}
    grams = Counter()
    for k, lang in enumerate(sorted(texts)):
        for t in texts[lang]:
            b = b"\n\n\n" + t
            for i in range(3, len(b)):
                grams[k, int.from_bytes(b[i - 3 : i + 1], "big")] += 1
    keys = list(grams)
    m = language_id.build(["aa", "bb"], np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([float(grams[k]) for k in keys]))
    tests = [b"the hut", b"", b"x", b"katze sat \xc3\xa4!", b"a"]
    got = m.code_lengths(np.frombuffer(b"".join(tests), np.uint8), np.cumsum([0, *map(len, tests)]))
    for row, t in zip(got, tests, strict=True):
        assert row == pytest.approx([plain_bits(texts[x], t, None) for x in ("aa", "bb")], rel=1e-4, abs=1e-4)
    p = 2.0 ** -m.bits.astype(float)
    others = 256 - (m.bits.shape[1] - 1)
    assert np.allclose(p[:, :-1].sum(1) + p[:, -1] * others, 1, atol=1e-4)


def test_language(spark):
    rows = language_id.query(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_edges(spark, small, edges, none):
    m = language_id.fit(small)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(edges, m).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] in m.languages
    kept = language_id.accepted(edges, m)
    assert kept.columns == edges.columns and not {0, 1, 2} & {r.doc_id for r in kept.collect()} and kept.filter("doc_id = 5").count() == 1
    assert language_id.identify(none, m).count() == language_id.accepted(none, m).count() == 0
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.identify(edges, empty).collect()} == {"und"}
    noise = spark.createDataFrame([(1, "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(300)))], "doc_id long, text string")
    assert not language_id.identify(noise, m).first().reliable


# Language-model scoring


def plain_log_probs(m, ids):
    """One text, token by token, in the windows that the model defines."""
    read = np.concatenate(([1], m.known[ids[:-1]]))
    out = []
    for i in range(len(ids)):
        first = i // attention.STRIDE * attention.STRIDE - (attention.WINDOW - attention.STRIDE)
        a = np.arange(max(0, first), i + 1)
        q = m.q[read[i]] + m.pq[i - first]
        s = np.exp(np.minimum((m.k[read[a]] + m.pk[a - first]) @ q, 40))
        h = (s / s.sum()) @ m.v[read[a]]
        last, before = read[i], read[i - 1] if i else 0
        g, j = divmod(m.cls[ids[i]], attention.MEMBERS)
        z = h @ m.out + m.skip[last] + m.skip2[before]
        w = h @ m.inner[g] + m.inner_skip[last, g] + m.inner_skip2[before, g]
        out.append(z[g] - np.log(np.exp(z).sum()) + w[j] - np.log(np.exp(w).sum()) + m.share[ids[i]])
    return np.array(out)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    return attention.train([np.concatenate([rng.integers(0, 60, n) % rng.integers(2, 60), [299]]) for n in (200, 5, 90, 1, 300)], 300, steps=30)


def test_windows(model):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 300, n) for n in (1, 2, 15, 16, 17, 33, 100)]
    ids, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    want = np.concatenate([plain_log_probs(model, t) for t in texts])
    for batch in (1, 3, 512):
        assert np.allclose(model.log_probs(ids, at, batch), want, atol=2e-3)


def test_probabilities_sum_to_one(model):
    text = np.array([5, 9, 5, 3])
    whole = np.concatenate([np.append(text, x) for x in range(300)])
    last = model.log_probs(whole, np.arange(301) * 5)[4::5]
    assert np.exp(last.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def plain_base(docs, training):
    find = re.compile("[^\x20\x09-\x0d]+").findall
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*find((t or "").translate(low)), None]
    c = Counter(x for t in training for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(x := tokens(t)), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for i, t in docs]


@pytest.mark.parametrize("frequent", [200_000, 40])
def test_base_score(spark, small, edges, none, model, monkeypatch, frequent):
    """Also with few broadcast counts, so that most words go through the join."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    wide = dataclasses.replace(model, known=np.zeros(50257, np.int32), cls=np.zeros(50257, np.int32), share=np.full(50257, -10.0, np.float32))
    counts = stored(lm_scoring.word_counts(small))
    for docs in (small, edges, none):
        got = sorted(map(tuple, lm_scoring.score(docs, counts, wide).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=str)
        want = sorted(plain_base([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in small.collect()]), key=str)
        assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9)


def test_scores_beat_counts(spark, monkeypatch):
    rows = lm_scoring.query(spark, BIG).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.score < 0 for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)


def test_counts_cover_all_texts(spark, small, monkeypatch):
    """Shares, classes and bigrams come from all texts, however few are sampled for the gradient steps."""
    monkeypatch.setattr(attention, "STEPS", 0)
    monkeypatch.setattr(lm_scoring, "KEYS", 5000)
    m = lm_scoring.fit(small, sample=3)
    c = codec()
    find = re.compile("[^\x20\x09-\x0d]+").findall
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [[*(i for w in find((r.text or "").translate(low)) for i in c.encode_piece(b" " + w.encode())), len(c.tokens)] for r in small.collect()]
    count = Counter(i for t in texts for i in t)
    smooth = np.array([count[i] + 0.01 for i in range(len(c.tokens) + 1)])
    assert np.allclose(m.share, np.log(smooth / np.bincount(m.cls, smooth)[m.cls]), atol=1e-5)
    assert set(np.flatnonzero(m.known)) <= {i for i, n in count.items() if n > 2} and (m.known > 0).sum() == min(attention.KNOWN, sum(n > 2 for n in count.values()))
    bigram = Counter((m.known[a] if a is not None else 1, m.cls[b] // attention.MEMBERS) for t in texts for a, b in zip([None, *t], t))
    groups = np.array([[bigram[r, g] for g in range(attention.GROUPS)] for r in range(len(m.skip))])
    prior = np.bincount(m.cls // attention.MEMBERS, smooth) / smooth.sum()
    assert np.allclose(m.skip, np.log((groups + 4 * prior) / (groups.sum(1, keepdims=True) + 4)), atol=1e-4)


def test_scoring_without_training(spark, edges, none):
    m = lm_scoring.fit(none)
    rows = lm_scoring.score(edges, stored(lm_scoring.word_counts(none)), m).collect()
    assert len(rows) == edges.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


# Quality and toxicity


def auc(rows, label):
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    return np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])


def test_quality(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = quality.query(spark, BIG).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    assert auc(held, "quality") > 0.95


def test_rules_as_columns(spark, small, edges):
    """Compiled columns say what the rules say in numpy."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    m = quality.fit(small, labels)
    assert 0 < len(m.rules) < 200
    for docs in (small, edges):
        x = quality.measured(docs, "text", [docs["doc_id"]]).toPandas()
        v = x[[f"s_{k}" for k in quality.STATISTICS]].to_numpy()
        z = m.bias + sum((w * r.holds(v) for r, w in m.rules), np.zeros(len(v)))
        got = sorted(r.score for r in quality.score(docs, m).collect())
        assert np.allclose(got, np.sort(1 / (1 + np.exp(-z))), atol=1e-9)


def test_one_kind_of_label(spark, small, edges, none):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        for m, name in ((quality, "quality"), (toxicity, "toxic")):
            model_ = m.fit(small, rows) if m is quality else m.fit_labels(small, rows, name)
            scores = {round(r.score, 6) for r in m.score(edges, model_).collect()}
            assert scores == {1.0 if rows is labels else 0.0}
    assert quality.score(none, quality.train(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))).count() == 0


def test_lasso_is_sparse():
    rng = np.random.default_rng(0)
    f = (rng.random((800, 30)) < 0.5).astype(float)
    y = (1 / (1 + np.exp(-(3 * f[:, 0] - 3 * f[:, 1]))) > rng.random(800)).astype(float)
    _, w = quality.lasso(f, y, penalty=0.02)
    assert w[0] > 1 and w[1] < -1 and (w != 0).sum() < 12


def test_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert auc(held, "toxic") > 0.95
    assert np.mean([r.predicted for r in held if r.toxic == 1]) > 0.8 and np.mean([r.predicted for r in held if r.toxic == 0]) < 0.01


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Model(np.arange(5), 0.2, rng.normal(size=5), rng.normal(size=(5, 3)))
    index, x = np.array([0, 2, 4]), np.array([1.0, 2.0, 0.5])
    z = 0.2 + x @ m.w[index] + sum(x[i] * x[j] * m.v[index[i]] @ m.v[index[j]] for i in range(3) for j in range(i))
    assert m.score(index, x, np.array([0, 3, 3])) == pytest.approx([1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-0.2))])


def test_interactions_are_learned():
    """Two terms that mean something only together."""
    rng = np.random.default_rng(4)
    d = (rng.random((600, 2)) < 0.5).astype(float)
    y = (d[:, 0] * d[:, 1]).astype(np.float32)
    index = np.concatenate([np.flatnonzero(r) for r in d])
    at = np.concatenate(([0], np.cumsum(d.sum(1)).astype(int)))
    m = toxicity.train(index, np.ones(len(index)), at, y, np.arange(2))
    s = m.score(np.array([0, 1, 0, 1]), np.ones(4), np.array([0, 1, 2, 4]))
    assert s[0] < 0.3 and s[1] < 0.3 and s[2] > 0.7


def test_toxic_edges(spark, small, edges, none):
    m = toxicity.fit_labels(small, spark.read.parquet(f"{DIR}/labels.parquet"), "toxic")
    assert toxicity.score(edges, m).count() == edges.count() and toxicity.score(none, m).count() == 0


def test_keys_are_made_by_pieces(spark, monkeypatch):
    """Counting neighbours holds the keys of a piece of a batch, never of all its texts, and counts the same."""
    texts = [np.arange(k % 7 + 1) % 5 for k in range(400)]
    table = spark.createDataFrame([(t.tolist(),) for t in texts], "ids array<int>").coalesce(1)
    place = np.arange(5)

    def keys(ids, at, place):
        if len(ids) > 60:
            raise ValueError(f"{len(ids)} ids at once")
        return attention.neighbour_keys(ids, at, place)

    monkeypatch.setattr(lm_scoring, "PIECE", 60)
    got = dict(zip(*(x.tolist() for x in lm_scoring.tally(table)(keys, place)), strict=True))
    want = dict(zip(*(x.tolist() for x in attention.tally(texts)(attention.neighbour_keys, place)), strict=True))
    assert got == want


def test_steps_cover_all_texts(spark, monkeypatch):
    """Texts that the first steps do not see change what the model learns, beyond their counts, and it comes to know them better."""
    rng = np.random.default_rng(5)
    order = [rng.permutation(40) for _ in range(2)]
    texts = [np.concatenate([order[k % 2][(np.arange(60) * 7 + k) % 40], [299]]) for k in range(120)]
    table = spark.createDataFrame([(t.tolist(),) for t in texts], "ids array<int>").repartition(3)
    counted = attention.tally(texts)
    first = attention.train(texts[:2], 300, steps=20, counted=counted)
    whole = attention.train(texts[:2], 300, steps=20, counted=counted, passed=lm_scoring.passed(table))
    ids, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    assert whole.log_probs(ids, at).mean() > first.log_probs(ids, at).mean() + 0.1
    assert not np.array_equal(first.inner, whole.inner) and not np.array_equal(first.q, whole.q)


def test_fit_steps_over_all_texts(spark, small, monkeypatch):
    """Every token of every training text is a target of a step, however few texts the first steps take."""
    seen = []
    real = lm_scoring.passed

    def watched(coded):
        def go_on(p, known, cls, tokens):
            total = sum(len(r.ids) for r in coded.select("ids").collect())
            seen.append((tokens, total, coded.count()))
            return real(coded)(p, known, cls, tokens)

        return go_on

    monkeypatch.setattr(lm_scoring, "passed", watched)
    monkeypatch.setattr(attention, "STEPS", 2)
    lm_scoring.fit(small, sample=3)
    assert [(n, k) for n, _, k in seen] == [(seen[0][1], small.count())]


def test_windows_of_a_step():
    """Side by side: each token is a target once, after what stands before it."""
    rng = np.random.default_rng(6)
    known, cls = rng.integers(0, 50, 90).astype(np.int32), rng.integers(0, 1024, 90).astype(np.int32)
    texts = [rng.integers(0, 90, n) for n in (0, 1, 31, 32, 33, 0, 70)]
    got = attention.whole_windows(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), known, cls)
    want = [(known[t[i - 1]] if i else 1, (known[t[i - 2]] if i > 1 else 1) if i else 0, cls[t[i]]) for t in texts for i in range(len(t))]
    real = got[2] >= 0
    assert list(zip(*(x[real].tolist() for x in got), strict=True)) == want


def test_sums_by_row():
    """Also with rows that many tokens share, and with none."""
    rng = np.random.default_rng(9)
    row, x = rng.integers(0, 50, 2000) ** 2, rng.normal(size=(2000, 16)).astype(np.float32)
    rows, sums = attention.by_row(row, x)
    assert rows.tolist() == sorted(set(row.tolist()))
    assert np.allclose(sums, [x[row == r].astype(float).sum(0) for r in rows], atol=1e-4)
    assert np.array_equal(attention.by_cell(attention.cells(row, 16), x, 2402)[rows], sums)
    assert [len(v) for v in attention.by_row(row[:0], x[:0])] == [0, 0]


def test_new_words_together(monkeypatch):
    """A worker's cache encodes the words that it does not know yet all at once."""
    c = codec()
    many, calls = c.encode_pieces, []
    monkeypatch.setattr(c, "encode_pieces", lambda p: calls.append(len(p)) or many(p))
    known = lm_scoring._Words(c, np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in (["quzzlewump", "the", None, "flonkerdaisy"], ["the", "brimblefoo", None]):
        slot = np.array([known[lm_scoring.END if w is None else w.encode()] for w in part])
        _, _, start, length, pool = known.arrays()
        want = [[len(c.tokens)] if w is None else c.encode_piece(b" " + w.encode()) for w in part]
        assert [pool[start[s] : start[s] + length[s]].tolist() for s in slot] == want
    assert calls == [4, 1]


def test_slopes():
    """Against differences of the loss."""
    rng = np.random.default_rng(7)
    g, m, w = attention.GROUPS, attention.MEMBERS, attention.WIDTH
    shapes = {"skip": (6, g), "skip2": (6, g), "inner_skip": (6, g, m), "inner_skip2": (6, g, m), "e": (6, w), "wq": (w, w), "wk": (w, w), "wv": (w, w), "pq": (attention.WINDOW, w), "pk": (attention.WINDOW, w), "out": (w, g), "inner": (g, w, m)}
    p = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    token, before = rng.integers(0, 6, (2, 3, attention.WINDOW))
    target = rng.integers(-1, g * m, (3, attention.WINDOW))

    def loss(p):
        e = p["e"][token]
        a = np.exp((e @ p["wq"] + p["pq"]) @ (e @ p["wk"] + p["pk"]).transpose(0, 2, 1)) * np.tril(np.ones((attention.WINDOW, attention.WINDOW)))
        h = a / a.sum(2, keepdims=True) @ (e @ p["wv"])
        ok = target >= 0
        tg, tm = np.divmod(target[ok], m)
        d = h[ok] @ p["out"] + p["skip"][token[ok]] + p["skip2"][before[ok]]
        di = np.einsum("nd,ndm->nm", h[ok], p["inner"][tg]) + p["inner_skip"][token[ok], tg] + p["inner_skip2"][before[ok], tg]
        each = np.arange(len(d))
        return -(d[each, tg] - np.log(np.exp(d).sum(1)) + di[each, tm] - np.log(np.exp(di).sum(1))).mean()

    dense, rows = attention.slopes({k: v.astype(np.float32) for k, v in p.items()}, token, before, target)
    for k, (row, d) in rows.items():
        dense[k] = np.zeros(shapes[k], np.float32)
        row, d = attention.by_row(row, d)
        dense[k].reshape(-1, d.shape[1])[row] = d
    for k, s in shapes.items():
        step = rng.normal(0, 1, s) * 1e-4
        up, down = (loss(p | {k: p[k] + x}) for x in (step, -step))
        assert (dense[k] * step).sum() == pytest.approx((up - down) / 2, rel=2e-2, abs=1e-8)
