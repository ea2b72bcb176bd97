"""Planes of several sizes against plain loops: windows, noise, quarter samples, search, deblocking and intra coding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.operators import deblock, search, wavefront
from lumenflow.operators import planes as P

SIZES = {7: (1, 1), 8: (2, 3), 9: (3, 1)}  # macroblocks: high, wide
SCHEMA = "plane long, y int, x int, high int, wide int, v array<int>, outer int, inner int, index int"


@pytest.fixture(scope="module")
def pictures():
    r = np.random.default_rng(5)
    out = {}
    for p, (high, wide) in SIZES.items():
        y, x = np.mgrid[: high * 16, : wide * 16]
        out[p] = np.clip(128 + 60 * np.sin(x / 9 + p) + 40 * np.cos(y / 7) + r.integers(-6, 7, y.shape), 0, 255).astype(int)
    return out


@pytest.fixture(scope="module")
def tiles(spark, pictures):
    rows = [(p, y, x, h, w, pictures[p][16 * y : 16 * y + 16, 16 * x : 16 * x + 16].ravel().tolist(), (y + x) % 5, (y * x + p) % 4, 20 + 7 * x + 3 * y) for p, (h, w) in SIZES.items() for y in range(h) for x in range(w)]
    return spark.createDataFrame([(*r[:5], [int(v) for v in r[5]], *r[6:]) for r in rows], SCHEMA)


def test_windows_and_noise(spark, tiles, pictures):
    rows = P.moved(P.windows(tiles), F.lit(3), F.lit(-5), F.lit(4660)).collect()
    assert len(rows) == sum(h * w for h, w in SIZES.values())
    for r in rows:
        pad = np.pad(pictures[r.plane], 16, mode="edge")
        at = slice(16 * r.y, 16 * r.y + 48), slice(16 * r.x, 16 * r.x + 48)
        assert (np.array(r.w).reshape(48, 48) == pad[at]).all()
        seed, noise = 0x1234, []
        for _ in range(pictures[r.plane].size):
            seed = (seed * 1103515245 + 12345) % 2**32
            noise.append((seed >> 16 & 0x7FFF) % 7 - 3)
        high, wide = pictures[r.plane].shape
        copy = np.clip(pad[16 + 5 : 16 + 5 + high, 16 - 3 : 16 - 3 + wide] + np.array(noise).reshape(high, wide), 0, 255)
        assert (np.array(r.cur).reshape(16, 16) == copy[16 * r.y : 16 * r.y + 16, 16 * r.x : 16 * r.x + 16]).all()


def test_far_noise(spark):
    """Skipping ahead meets the generator, step by step, beyond 4,096 numbers too."""
    seed, want = 99, []
    for _ in range(6000):
        seed = (seed * 1103515245 + 12345) % 2**32
        want.append((seed >> 16 & 0x7FFF) % 7 - 3)
    got = spark.range(6000).select("id", P.noise(F.lit(99), F.col("id").cast("int"), 13).alias("n")).orderBy("id").collect()
    assert [r.n for r in got] == want


def test_search(spark, tiles):
    """The places that sums rule out could not have won; the diamond is never better, and looks at fewer places."""
    both = P.moved(P.windows(tiles), F.lit(3), F.lit(-5), F.lit(4660))
    keep = ["plane", "y", "x"]
    full = {(r.plane, r.y, r.x): r for r in search.full(both, keep).collect()}
    quick = {(r.plane, r.y, r.x): r for r in search.diamond(both, keep).collect()}
    for r in both.collect():
        w, cur, k = np.array(r.w).reshape(48, 48), np.array(r.cur).reshape(16, 16), (r.plane, r.y, r.x)
        want = min((int(np.abs(w[16 + dy : 32 + dy, 16 + dx : 32 + dx] - cur).sum()), abs(dx) + abs(dy), dy, dx) for dy in range(-16, 17) for dx in range(-16, 17))
        assert (full[k].sad, full[k].dy, full[k].dx) == (want[0], *want[2:]) and full[k].looked <= 1089
        assert quick[k].sad >= full[k].sad and quick[k].points <= 200
    assert sum(r.looked for r in full.values()) < 0.5 * 1089 * len(full)


def plain_quarter(at, x, y, fx, fy):
    tap = lambda f: f(-2) - 5 * f(-1) + 20 * f(0) + 20 * f(1) - 5 * f(2) + f(3)
    clip = lambda v: max(0, min(255, v))
    across = lambda x, y: clip((tap(lambda k: at(x + k, y)) + 16) >> 5)
    down = lambda x, y: clip((tap(lambda k: at(x, y + k)) + 16) >> 5)
    centre = clip((tap(lambda r: tap(lambda k: at(x + k, y + r))) + 512) >> 10)
    half = {(0, 0): at(x, y), (2, 0): across(x, y), (0, 2): down(x, y), (2, 2): centre, (4, 0): at(x + 1, y), (0, 4): at(x, y + 1), (4, 2): down(x + 1, y), (2, 4): across(x, y + 1)}
    if fx % 2 == 0 and fy % 2 == 0:
        return half[fx, fy]
    if fx % 2 and fy % 2:  # between the nearest sample across and the nearest one down
        a, b = half[2, 0 if fy == 1 else 4], half[0 if fx == 1 else 4, 2]
    elif fx % 2:
        a, b = half[fx - 1, fy], half[fx + 1, fy]
    else:
        a, b = half[fx, fy - 1], half[fx, fy + 1]
    return (a + b + 1) >> 1


def test_quarter_samples(spark, tiles, pictures):
    w = P.windows(tiles.filter("plane = 8 and y = 0 and x = 1").unionByName(tiles.filter("plane = 8 and not (y = 0 and x = 1)"))).filter("plane = 8 and y = 0 and x = 1")
    vectors = [(mx, my) for mx in range(-4, 4) for my in range(-4, 4)]
    made = w.select(F.array(*[P.quarter(F.col("w"), 48, 16, 4, F.lit(mx), F.lit(my)) for mx, my in vectors[:16]]).alias("a"), F.array(*[P.quarter(F.col("w"), 48, 16, 4, F.lit(4 * mx + k % 4), F.lit(my)) for k, (mx, my) in enumerate(vectors[16:20])]).alias("b")).first()
    pad = np.pad(pictures[8], 40, mode="edge")
    at = lambda x, y: int(pad[40 + y, 40 + x])
    for (mx, my), got in zip(vectors[:16] + [(4 * mx + k % 4, my) for k, (mx, my) in enumerate(vectors[16:20])], [*made.a, *made.b], strict=True):
        assert got == [plain_quarter(at, 16 + x + (mx >> 2), y + (my >> 2), mx & 3, my & 3) for y in range(4) for x in range(4)]


@pytest.mark.parametrize("chroma", [False, True])
def test_deblocking(spark, tiles, pictures, chroma):
    """Edge by edge, sample by sample, in the order of a decoder."""
    marks = {(r.plane, r.y, r.x): r for r in tiles.collect()}
    want = {}
    for p, (high, wide) in SIZES.items():
        s = pictures[p].copy()
        for turned in (False, True):
            a = s.T if turned else s
            for n in range(a.shape[0]):
                for e in range(1, a.shape[1] // 4):
                    m = marks[(p, e // 4, n // 16) if turned else (p, n // 16, e // 4)]
                    line = deblock.filtered(a[n : n + 1, 4 * e - 4 : 4 * e + 4].astype(np.int32), np.array([[0, m.inner if e % 4 else m.outer]], np.int32), np.array([[0, m["index"]]], np.int32), chroma)
                    a[n, 4 * e - 4 : 4 * e + 4] = line[0]
        want[p] = s
    got = deblock.planes(tiles, chroma).collect()
    assert len(got) == tiles.count() and all((np.array(r.v).reshape(16, 16) == want[r.plane][16 * r.y : 16 * r.y + 16, 16 * r.x : 16 * r.x + 16]).all() for r in got)
    assert any((want[p] != pictures[p]).any() for p in want)


def test_intra_coding(spark, tiles, pictures):
    """Pictures of several sizes in one run: what a decoder gets is near the source, borders are read from neighbours that were coded."""
    rows = wavefront.code(tiles, 10).collect()
    assert sorted((r.plane, r.y, r.x) for r in rows) == sorted((r.plane, r.y, r.x) for r in tiles.select("plane", "y", "x").collect())
    whole = {p: np.zeros_like(a) for p, a in pictures.items()}
    for r in rows:
        whole[r.plane][16 * r.y : 16 * r.y + 16, 16 * r.x : 16 * r.x + 16] = np.array(r.v).reshape(16, 16)
        kept = [k for k in range(16) if not r.dropped[k]]
        blocks = np.array(r.levels).reshape(16, 16)
        assert [int((b != 0).sum()) for b in blocks] == list(r.totals) and not blocks[[k for k in range(16) if r.dropped[k]]].any() and (kept or r.plane)
        for k, (bx, by) in enumerate(wavefront.PLACES):
            assert r.x or bx or r.modes[k] not in (1, 4, 5, 6, 8)
            assert r.y or by or r.modes[k] not in (0, 3, 4, 5, 6, 7)
            if not r.dropped[k]:
                at = 16 * r.y + 4 * by, 16 * r.x + 4 * bx
                assert np.abs(whole[r.plane][at[0] : at[0] + 4, at[1] : at[1] + 4] - pictures[r.plane][at[0] : at[0] + 4, at[1] : at[1] + 4]).max() <= 4


def test_empty(spark, tiles):
    none = tiles.limit(0)
    assert P.windows(none).count() == deblock.planes(none).count() == wavefront.code(none).count() == 0
    assert search.full(none.select("plane", F.col("v").alias("cur"), F.col("v").alias("w")), ["plane"]).count() == 0
