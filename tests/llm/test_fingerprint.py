"""Operator 7: chunks, containment, and the edited texts."""

import hashlib
import random

import pytest

from lumenflow.llm import fingerprint as f


def plain_cuts(data):
    """Byte by byte: a hash over the last 32 bytes."""
    out, at = [], 0
    for i in range(len(data)):
        h = sum(int(f.GEAR[data[i - k]]) << k for k in range(min(f.WINDOW, i + 1))) % (1 << 32)
        n = i + 1 - at
        zero = f.STRICT if n < f.NORMAL else f.LOOSE
        if n >= f.LEAST and (h < 1 << (32 - zero) or n == f.MOST) or i + 1 == len(data):
            out.append(i + 1)
            at = i + 1
    return out


def test_cuts():
    r = random.Random(7)
    for n in (0, 1, 7, 8, 9, 31, 33, 500, 3000):
        data = bytes(r.choice(b"abcdefgh ") for _ in range(n))
        assert f.cuts(data) == plain_cuts(data)
    same = b"a" * 1000
    assert f.cuts(same) == plain_cuts(same)


def test_shift_resistance():
    r = random.Random(8)
    text = bytes(r.choice(b"abcdefghijklmnop ") for _ in range(6000))
    moved = b"something in front " + text
    assert f.containment(f.fingerprint(text), f.fingerprint(moved)) > 0.97
    assert f.containment(f.fingerprint(text[:3000]), f.fingerprint(text)) > 0.97
    assert f.containment(f.fingerprint(text), f.fingerprint(text[:3000])) == pytest.approx(0.5, abs=0.03)
    assert f.containment(f.fingerprint(b""), f.fingerprint(b"")) == 1 and f.containment(f.fingerprint(b"x"), f.fingerprint(b"")) == 0


def test_text_form():
    p = f.fingerprint(b"ab" * 50_000 + b"some other text that is here")
    assert f.from_text(f.text_form(p)) == p and f.text_form(f.fingerprint(b"")) == ""


def plain_edits(docs):
    order = sorted(docs, key=lambda d: (d.doc_id is None, -(d.doc_id or 0), d.text or ""))
    out = []
    for i, d in enumerate(order):
        s, t = d.text or "", order[(i + 1) % len(order)].text or ""
        e = s[: len(s) - len(s) // 3] + t[: len(s) // 3]
        a, b, c = (f.fingerprint(x.encode()) for x in (s, e, t))
        out.append((d.doc_id, len(s), hashlib.sha256(e.encode()).hexdigest(), f.text_form(a), f.text_form(b), f.containment(a, b), f.containment(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 24, 3000])
def test_edited(spark, small, edges, none, size):
    for docs in (small, edges, small.limit(1), none):
        rows = docs.collect()
        assert sorted(map(tuple, f.edited(docs, size).collect()), key=str) == plain_edits(rows)


def test_fingerprints(spark, edges):
    rows = f.fingerprints(edges).collect()
    assert len(rows) == edges.count() and len({r.fingerprint for r in rows if r.doc_id == 6}) == 1
