"""Operators 10 and 5 against plain versions."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenflow.llm import exact_dedup, near_dedup
from lumenflow.llm.shingles import shingle_sets, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_groups(docs):
    by = defaultdict(list)
    for d in docs:
        by[(d.text or "").translate(LOWER)].append(d.doc_id)
    out = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_groups(spark, small, edges, none):
    for docs in (small, edges, none):
        got = exact_dedup.groups(docs)
        assert sorted(map(tuple, got.collect()), key=str) == plain_groups(docs.collect())


def test_colliding_identifiers(spark, table):
    """With two bits of identifier nearly all chunks collide; contents must still tell texts apart."""
    r = random.Random(2)
    texts = ["".join(r.choice("abc .\n") for _ in range(r.randint(0, 3000))) for _ in range(40)]
    texts += texts[:10] + [t.upper() for t in texts[10:15]] + [texts[0][:-1], texts[1] + "."]
    docs = table(texts)
    got = exact_dedup.groups(docs, identity=lambda c: F.xxhash64(c).bitwiseAND(3))
    assert sorted(map(tuple, got.collect()), key=str) == plain_groups(docs.collect())


def test_chunks_are_the_text(spark, table):
    texts = ["", "x", "a. " * 3000, "b" * 9000, "q" * 600 + "\n" + "z" * 600]
    rows = table(texts).select("text", exact_dedup.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text and all(0 < len(x) <= 4097 for x in r.c) for r in rows)


def test_unique(spark, edges, none):
    kept = exact_dedup.unique(edges)
    assert kept.columns == edges.columns
    got = sorted(((r.text or "").translate(LOWER) for r in kept.collect()))
    assert got == sorted({(r.text or "").translate(LOWER) for r in edges.collect()})
    assert exact_dedup.unique(none).count() == 0


def plain_components(docs):
    ids, sets, out = [d.doc_id for d in docs], [], {}
    for d in docs:
        w = words((d.text or "").encode())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if ids[i] == ids[j] or 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(find(i), find(j), key=lambda k: ids[k])] = min(find(i), find(j), key=lambda k: ids[k])
    for i, d in enumerate(docs):
        out.setdefault((d.doc_id, len(sets[i]), ids[find(i)] if d.doc_id is not None else None), 0)
        out[d.doc_id, len(sets[i]), ids[find(i)] if d.doc_id is not None else None] += 1
    return out


def check(df, docs):
    got = {}
    for r in near_dedup.near_components(df).collect():
        got[r.doc_id, r.n_shingles, r.component_id] = got.get((r.doc_id, r.n_shingles, r.component_id), 0) + 1
        assert r.kept == (r.doc_id == r.component_id)
    assert got == plain_components(docs)


def test_components(spark, small, edges, none):
    for docs in (small, edges, none):
        check(docs, docs.collect())


@pytest.fixture(scope="module")
def family():
    """A large group of near copies with few to many edits, another that shares half of its words, and unrelated texts."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    base = [r.choice(vocabulary) for _ in range(120)]
    texts = []
    for k in range(150):
        t = list(base)
        for _ in range(k % 16):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        texts.append(" ".join(t))
    for _ in range(60):
        texts.append(" ".join(base[:60] + [r.choice(vocabulary) for _ in range(60)]))
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40))) for _ in range(40)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("node, levels, block", [(32, 4, 1024), (4, 1, 16), (3, 2, 1024)])
def test_large_groups(spark, table, family, monkeypatch, node, levels, block):
    """All links of large nodes: with a few levels, most are left to be finished, in one or in many blocks."""
    monkeypatch.setattr(near_dedup, "NODE", node)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = table(family)
    check(docs, docs.collect())


def test_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (7, 7)], "a long, b long")
    got = {r.id: r.root for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}
    assert near_dedup.components(links.limit(0)).count() == 0
    known = near_dedup.components(links)
    more = spark.createDataFrame([(95, 40), (200, 201)], "a long, b long")
    got = {r.id: r.root for r in near_dedup.components(more, known).collect()}
    assert got == {i: 0 for i in (*range(1, 41), 90, 95, 100)} | {201: 200}


def test_unique_near(spark, table):
    kept = near_dedup.unique(table(["a b c d e f g h i j", "x y", "A b c d e f g h i j", ""]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3] and "slot" in kept.columns


def test_shingle_sets():
    sets = shingle_sets([b"", b"a b", b"a b c d e", b"A B C D E f", b"a b c d e a b c d e"])
    assert [len(s) for s in sets] == [0, 1, 1, 2, 5] and sets[2][0] in sets[3] and sets[1][0] not in sets[3]


def test_recall_near_the_bound(spark):
    """5,200 texts, half of them copies with a similarity from 0.745 to 0.8: nearly all links of full sets are found, and none beside."""
    r = random.Random(11)
    texts = []
    for _ in range(2600):
        t = [f"w{r.randrange(4000)}" for _ in range(r.randint(80, 400))]
        n = len(t) - 4
        like = r.uniform(0.745, 0.8)
        edits = max(1, round(n * (1 - like) / (1 + like) / 5))  # a replaced word changes five shingles
        gap = max(5, len(t) // (edits + 1))
        copy = list(t)
        for k in range(gap // 2, min(len(t), gap // 2 + gap * edits), gap):
            copy[k] = f"x{r.randrange(10**9)}"
        texts += [t, copy]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    where, both = defaultdict(list), defaultdict(int)
    for i, q in enumerate(sets):
        for g in q:
            where[g].append(i)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1
    links = {p for p, n in both.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(docs).collect()}
    assert len(links) > 1500 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert all(got[i] != got[i + 1] for i in range(0, len(texts), 2) if (i, i + 1) not in links)


@pytest.mark.parametrize("node, levels, documents", [(4, 3, 16), (32, 4, 64)])
def test_blocks_of_documents(spark, table, family, monkeypatch, node, levels, documents):
    """Links are found whatever blocks the documents are dealt to."""
    monkeypatch.setattr(near_dedup, "NODE", node)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    monkeypatch.setattr(near_dedup, "DOCUMENTS", documents)
    docs = table(family)
    check(docs, docs.collect())


def test_large_nodes_are_few_rows(spark, monkeypatch):
    """A large group of near copies is a few rows of each of its nodes, not one for each document and node."""
    r, seen, real = random.Random(4), [], near_dedup.stored

    def stored(df, even=False):
        out = real(df, even)
        if {"node", "n", "pivot"} <= set(out.columns) and "main" not in out.columns:
            seen.append(out.filter(f"n > {near_dedup.NODE}").count())
        return out

    monkeypatch.setattr(near_dedup, "stored", stored)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    texts = []
    for _ in range(600):
        t = list(base)
        t[r.randrange(len(t))] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(t))
    got = near_dedup.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0} and seen and 0 < sum(seen) < 600
