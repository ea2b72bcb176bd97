"""Operators 6 and 4 against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenflow.llm import bpe, token_counts


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.vocabulary())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "abcdefghijklmnopqrstuvwxyzäéñABC'0123 \n\t中文字日本語العربيةРусский!?.,#$%"


def test_random_texts(reference):
    r, c = random.Random(1), bpe.codec()
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(c.tokens[r.randrange(len(c.tokens))].decode("utf-8", "replace") for _ in range(r.randint(1, 8))) for _ in range(1000)]
    for t in [*texts, "a" * 20000, " " * 5000, "é" * 3000]:
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_full_caches(reference, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    c = bpe.Codec(bpe.vocabulary())
    t = "one two three four five six seven antidisestablishmentarianism " * 3
    assert np.frombuffer(c.encode(t), "<u4").tolist() == reference.encode_ordinary(t)


def test_pieces_together(small, monkeypatch):
    """Many pre-tokens at once have the ids that each has alone, and short words of more than one token never go one by one."""
    r, c = random.Random(3), bpe.codec()
    words = sorted({w for d in small.collect() for w in (d.text or "").encode().split()})
    pieces = [b" " + w for w in words] + [bytes(r.choice(b"aab \xc3\xa9\xff\x00") for _ in range(r.randrange(70))) for _ in range(3000)]
    pieces += [b"", b"a", b"a" * 64, b"a" * 65, b"ab" * 300, *c.tokens[:2000]]
    want = [c.encode_piece(p) for p in pieces]
    alone, real = [], c.encode_piece
    monkeypatch.setattr(c, "encode_piece", lambda p: alone.append(p) or real(p))
    ids, n = c.encode_pieces(pieces)
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert all(len(p) < 2 or p in c.ids or len(p) > bpe.SHORT for p in alone)
    held, merged = [], c._merged
    monkeypatch.setattr(c, "_merged", lambda a, b: held.append(len(a)) or merged(a, b))
    monkeypatch.setattr(bpe, "TOGETHER", 100)  # however many new words a long text has
    again = c.encode_pieces(pieces)
    assert all(np.array_equal(a, b) for a, b in zip(again, (ids, n), strict=True)) and max(held) <= 100
    assert [x.tolist() for x in c.encode_pieces([])] == [[], []] and [x.tolist() for x in c.encode_pieces([b" the"])] == [real(b" the"), [1]]
    few = bpe.Codec([b"a", b"b", b"ab", b"aab"])  # not all bytes are tokens
    assert few.encode_pieces([b"abaab", b"b"])[0].tolist() == [*few.encode_piece(b"abaab"), 1]


def test_digests(spark, small, edges, none, reference):
    for docs in (small, edges, none):
        got = sorted(map(tuple, bpe.digests(docs).collect()), key=str)
        want = []
        for d in docs.collect():
            ids = np.array(reference.encode_ordinary(d.text or ""), "<u4").tobytes()
            want.append((d.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert {bytes(r.decoded).decode() for r in bpe.encode(edges).collect()} == {r.text or "" for r in edges.collect()}


def test_edits_follow(small):
    c, r = bpe.codec(), random.Random(4)
    texts = [d.text for d in small.limit(40).collect()]
    for k in range(300):
        s = r.choice(texts)[: r.randint(0, 3000)] if k % 2 else "".join(r.choice(" \n\t'sab1.é中!") for _ in range(r.randint(0, 120)))
        tree = token_counts.Tree(c, s)
        for _ in range(5):
            a, n, w = r.randint(0, len(s) + 3), r.choice([0, 0, 1, 10, 700]), "".join(r.choice(" \n\t'sab1.é中!") for _ in range(r.choice([0, 1, 8, 60])))
            tree.edit(a, n, w)
            a = min(a, len(s))
            s = s[:a] + w + s[a + n :]
            assert tree.text == s and tree.n_chars == len(s)
            assert tree.leaves()[0] == [len(x) for x in c.find(s)] and tree.n_tokens == len(c.encode(s)) // 4


def test_edits_touch_little():
    c = bpe.codec()
    tree = token_counts.Tree(c, "the quick brown fox jumps " * 4000)
    assert tree.edit(50_000, 3, "xy") < 12


def test_recount(spark, small, edges, none, reference):
    plain = [d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) for d in (small, edges, none)]
    for docs in (*plain, *map(token_counts.trees, plain)):
        got = sorted(map(tuple, token_counts.recount(docs.withColumn("edits", token_counts.sample_edits())).select("doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens").collect()), key=str)
        want = []
        for d in docs.collect():
            s = d.text or ""
            n = len(s)
            t = s
            for part, cut, word in ((0.75, 10, ""), (0.5, 0, " edited"), (0.25, 5, "X1 ")):
                at = min(int(n * part), len(t))
                t = t[:at] + word + t[at + cut :]
            want.append((d.doc_id, n, len(reference.encode_ordinary(s)), len(t), len(reference.encode_ordinary(t))))
        assert got == sorted(want, key=str)


def test_attached_edits(spark, table):
    docs = table(["hello world", "no edits here"])
    edits = spark.createDataFrame([(0, 2, 0, 5, "HELLO"), (0, 1, 5, 0, " big"), (9, 1, 0, 1, "x")], "doc_id long, edit_no int, start int, length int, replacement string")
    rows = {r.doc_id: r for r in token_counts.recount(token_counts.attach(token_counts.trees(docs), edits)).collect()}
    assert rows[0].edited_tokens == len(bpe.codec().encode("HELLO big world")) // 4 and rows[0].edited_chars == 15
    assert rows[1].reencoded == 0 and rows[1].edited_tokens == rows[1].n_tokens and set(rows) == {0, 1}
