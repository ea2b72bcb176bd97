"""Operator 3: quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Small boosted trees over them, grown on a bounded sample of labelled texts, give their paths
as rules (conjunctions of comparisons); a lasso logistic regression weights the rules and drops most; what is left is compiled into
one Spark column expression, so that scoring stays in generated JVM code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import bounded_sample, fold, table

#: Labelled texts that are learned from, about, chosen by a hash of their id.
SAMPLE = 12_000
TREES, DEPTH, BINS, LEAF = 40, 3, 32, 10
#: Weight of the lasso's penalty, and its steps.
PENALTY, STEPS = 4e-4, 600
THRESHOLD = 0.3

STATISTICS = ("chars", "words", "word_chars", "upper", "digits", "symbols", "ends", "lines", "distinct_words", "distinct_lines", "wide", "vowels", "bars")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; shares are of its characters or words, and 0 where there are none."""
    n = F.length("_t")
    words, lines = F.size("_w"), F.size("_l")
    share = lambda pattern: F.regexp_count("_t", F.lit(pattern)) / F.greatest(n, F.lit(1))
    return {
        "chars": F.log1p(n),
        "words": F.log1p(words),
        "word_chars": n / F.greatest(words, F.lit(1)),
        "upper": share("[A-Z]"),
        "digits": share("[0-9]"),
        "symbols": share(r"[#&$%*@^~_<>{}\[\]=+\\/]"),
        "ends": share("[.!?]"),
        "lines": lines / F.greatest(words, F.lit(1)),
        "distinct_words": F.size(F.array_distinct("_w")) / F.greatest(words, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct("_l")) / F.greatest(lines, F.lit(1)),
        "wide": (F.octet_length("_t") - n) / F.greatest(n, F.lit(1)),
        "vowels": share("[aeiou]"),
        "bars": share("[|!]"),
    }


def measured(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns in ``keep`` beside the statistics; null counts as an empty text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(*keep, t.alias("_t")).select("*", F.filter(F.split("_t", r"[ \t-\r]+"), lambda w: w != "").alias("_w"), F.split("_t", "\n").alias("_l"))
    names = [c for c in parts.columns if not c.startswith("_")]
    return parts.select(*names, *[c.cast("double").alias(f"s_{k}") for k, c in statistics(F.col("_t")).items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at most or above, bound)."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, below, bound in self.tests:
            out &= (x[:, k] <= bound) if below else (x[:, k] > bound)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, below, bound in self.tests:
            c = F.col(f"s_{STATISTICS[k]}")
            out = out & ((c <= bound) if below else (c > bound))
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(bins: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, path: tuple, out: list, step: np.ndarray) -> None:
    """Grows a tree below ``path`` and collects all its paths; ``step`` gets the leaves' values."""
    g, h = grad[rows].sum(), hess[rows].sum()
    if path:
        out.append(path)
    best = (1e-3, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAF:
        for k in range(bins.shape[1]):
            b = bins[rows, k]
            cg, ch, cn = (np.cumsum(np.bincount(b, w, len(edges[k]) + 1)) for w in (grad[rows], hess[rows], None))
            ok = (cn >= LEAF) & (len(rows) - cn >= LEAF)
            gain = np.where(ok, cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1), 0)[: len(edges[k])]
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (k, int(gain.argmax())))
    if best[1] is None:
        step[rows] = -g / (h + 1)
        return
    k, at = best[1]
    left = bins[rows, k] <= at
    for side, below in ((left, True), (~left, False)):
        _grow(bins, edges, rows[side], grad, hess, (*path, (k, below, float(edges[k][at]))), out, step)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> list[Rule]:
    """Distinct paths of boosted trees over quantile bins."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    z = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: list[tuple] = []
    rng = np.random.default_rng(3)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        step = np.zeros(len(y))
        paths: list[tuple] = []
        _grow(bins, edges, rows, p - y, p * (1 - p), (), paths, step)
        found += paths
        z += 0.2 * step
    return [Rule(t) for t in dict.fromkeys(found)]


def lasso(f: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps. Features are centred for the fit."""
    mean = f.mean(0)
    c = f - mean
    rate = 4 / max(np.linalg.norm(c.T @ c / len(y), 2), 1e-9) if c.size else 1.0
    bias, w = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros(f.shape[1])
    v, u, t = w.copy(), bias, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(u + c @ v, -60, 60))) - y
        new = v - rate * (c.T @ e) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb, nt = u - 4 * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = new, nb, nt
    return float(bias - mean @ w), w


def train(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y) or y.min() == y.max():
        return Ensemble(50.0 if len(y) and y[0] else -50.0, ())
    rules = grow_rules(x, y)
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    bias, w = lasso(np.stack([r.holds(x) for r in rules], 1).astype(np.float64), y)
    return Ensemble(bias, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if v))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """Learns from labelled documents. The sample is drawn from the labels, so that only its texts are joined; their statistics, a
    few numbers for each, come to the driver. Of repeated labels the largest counts; null labels are left out. With labels of one
    kind, or none, the score is constant."""
    one = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = bounded_sample(one, "doc_id", sample)  # a bounded number of rows, so that broadcasting it is safe
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = measured(rows, "text", [F.col("y").cast("double"), F.xxhash64("doc_id").alias("u")]).toPandas().sort_values("u", kind="stable")
    return train(got[[f"s_{k}" for k in STATISTICS]].to_numpy(), got["y"].to_numpy())


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(doc_id, score) of every whole text, empty ones too. Repeated rows give repeated results; other columns are ignored."""
    return measured(docs, "text", [F.col("doc_id")]).select("doc_id", model.column().alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality of every document, learned from labels outside fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(fold("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
