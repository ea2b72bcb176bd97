"""Operator 13: rules against a plain version, models against dictionaries, verdicts against held-out rules."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lumenflow.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, verdict string, id long, score double"
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://Sub.COM/x?y", "http://a.example.com/en/1", "http://example.com/EN/1", "http://www.example.com/en/", "http://m.www.example.com/en/2#t", "http://xwww.example.com/en/2",
    "https://notcom/", "https://a.b.net/es/?q", "https://net/fr/1", "https://net/fr", "http://x.net?/es/", "http://x.net#/fr/", "a://b.com://c/d", "://com/", "http://x.org/en/ü中", "http://x.com:80/", "http://x.COM/\n/a", "http://x.com/" + "a" * 200000,
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return host.translate(LOWER), rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "h", "p", "r", "v", 3, 0.5) for i, u in enumerate(urls)], SCHEMA)


def made(n, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiounrst") for _ in range(r.randint(3, 9)))
    return [f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'm.'])}{word()}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randint(0, 999)}{r.choice(['', '.html', '?page=2', '#top'])}" for _ in range(n)]


def test_rules(spark):
    urls = URLS + made(300) + [u.replace("example.com", "www.example.com") for u in made(50)]
    rows = U.judged(pages(spark, urls)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = plain_parts(urls[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("allow" if r.score >= 0.5 else "block")) and 0 <= r.score <= 1


def plain_difference(training, url):
    """Interpolated by recursion over dictionaries of contexts."""
    logs = []
    for verdict in ("allow", "block"):
        follow = defaultdict(lambda: defaultdict(int))
        for u, v in training:
            line = [0] * U.ORDER + list(u.encode()) + [U.END]
            for i in range(U.ORDER, len(line) if v == verdict else 0):
                for k in range(U.ORDER + 1):
                    follow[tuple(line[i - k : i])][line[i]] += 1

        def chance(ctx, s, follow=follow):
            below = chance(ctx[1:], s) if ctx else 1 / 256  # noqa: B023
            if ctx not in follow:
                return below
            n, t = sum(follow[ctx].values()), len(follow[ctx])
            return (follow[ctx].get(s, 0) + t * below) / (n + t)

        line = [0] * U.ORDER + list(url.encode()) + [U.END]
        logs.append(sum(math.log(chance(tuple(line[i - U.ORDER : i]), line[i])) for i in range(U.ORDER, len(line))))
    return (logs[0] - logs[1]) / (len(url.encode()) + 1)


def test_models(spark):
    training = [(u, plain_rule(*plain_parts(u))[1]) for u in made(60)]
    training = [t for t in training if t[1]]
    model = U.counted(spark.createDataFrame(training, "url string, verdict string"))
    tests = ["", "x", "http://\x00\x01ü", *made(20, 9), *[t[0] for t in training[:5]]]
    raw = [t.encode() for t in tests]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = model.difference(np.frombuffer(b"".join(raw), np.uint8), at)
    assert got == pytest.approx([plain_difference(training, t) for t in tests], rel=1e-9, abs=1e-12)


def test_held_out(spark):
    """Rules that the models never saw the URLs of: most verdicts agree."""
    train, test = made(3000, 1), made(500, 2)
    known = [(u, plain_rule(*plain_parts(u))[1]) for u in train]
    model = U.fit(spark.createDataFrame([k for k in known if k[1]], "url string, verdict string"))
    raw = [u.encode() for u in test]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    score = model.score(np.frombuffer(b"".join(raw), np.uint8), at)
    right = [(s >= 0.5) == (v == "allow") for s, v in zip(score, (plain_rule(*plain_parts(u))[1] for u in test), strict=True) if v]
    assert sum(right) > 0.9 * len(right)


def test_edges(spark):
    assert U.judged(pages(spark, URLS).limit(0)).count() == 0
    rows = U.judged(pages(spark, ["http://x.org/a", None, "http://x.com/a", "http://x.com/a"])).collect()
    assert [r.verdict for r in rows] == ["allow"] * 4 and all(r.score is None for r in rows)
    assert U.judged(pages(spark, URLS)).columns == ["page_id", "host", "path", "rule", "verdict", "score"]


@pytest.mark.parametrize("frequent", [0, 300, 10**9])
def test_all_urls_are_counted(spark, monkeypatch, frequent):
    """Every different URL is learned from, the longest too, whatever part of the model is broadcast."""
    monkeypatch.setattr(U, "FREQUENT", frequent)
    long = "http://a.example.com/en/" + "longer" * 1000
    training = sorted({(u, plain_rule(*plain_parts(u))[1]) for u in made(40)} | {(long, "allow")})
    training = [t for t in training if t[1]]
    known = spark.createDataFrame(training, "url string, verdict string")
    model = U.counted(known)
    assert len(model.gram) <= frequent and (model.rest is None) == (frequent == 10**9)
    tests = ["", "x", "http://\x00ü", long[:90], *made(8, 9), training[0][0], training[0][0]]
    rows = spark.createDataFrame(list(enumerate(tests)), "i int, url string")
    got = {r.i: r.difference for r in U.differences(rows, model).collect()}
    assert len(got) == len(tests)
    assert [got[i] for i in range(len(tests))] == pytest.approx([plain_difference(training, t) for t in tests], rel=1e-9, abs=1e-12)


def test_all_urls_are_learned_from(spark):
    """More URLs of a verdict than a sample held: all that do not calibrate are counted, each once."""
    urls = spark.range(30000).selectExpr("concat('http://x.example.com/', id) AS url", "if(id % 2 = 0, 'allow', 'block') AS verdict")
    urls = urls.unionByName(spark.range(30000, 60000).selectExpr("concat('http://x.example.com/', id) AS url", "'allow' AS verdict"))
    model = U.fit(urls.unionByName(urls))
    held = urls.filter("pmod(xxhash64(url, 5), 5) = 0").count()
    assert model.count[np.searchsorted(model.gram, U.END)].sum() == 60000 - held
