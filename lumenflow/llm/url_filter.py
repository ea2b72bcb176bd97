"""Operator 13: URL filters, by rules and by the ratio of two character models.

The longest rule that fits decides. URLs without a rule are judged by what the others look like: a model of accepted and one of rejected
URLs, each a Markov model of variable order over the bytes of the URL. A context of up to ORDER bytes mixes what followed it with what
the shorter context expects, in the proportion of its followers (Witten and Bell), down to equal chances for all bytes. The difference of
the two log-likelihoods, by symbol, is calibrated on labelled URLs that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import ascii_lower, pieces, row_sums, stored, table, utf8

#: (verdict, host, path): a rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Bytes of the longest context.
ORDER = 5
#: Grams of the most frequent contexts that are broadcast, at most; the others are joined.
FREQUENT = 500_000
END = 1


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no ``://``."""
    u = F.coalesce(url, F.lit(""))
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(u, shape, 1)), F.regexp_extract(u, shape, 2)


def decided(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null where none fits. Of equal rules the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules[::-1], key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, each behind ORDER zeros and before END, and the places of its symbols (bytes and END)."""
    n = len(at) - 1
    out = np.zeros(len(data) + n * (ORDER + 1), np.uint8)
    text = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(data)) + (text + 1) * ORDER + text] = data
    out[at[1:] + np.arange(1, n + 1) * (ORDER + 1) - 1] = END
    pads = (at[:-1] + np.arange(n) * (ORDER + 1))[:, None] + np.arange(ORDER)
    real = np.ones(len(out), bool)
    real[pads.ravel()] = False
    return out, np.flatnonzero(real)


def grams(line: np.ndarray, places: np.ndarray) -> Iterator[np.ndarray]:
    """For each order from 0 to ORDER a number for each place: the order, the context's bytes and the symbol."""
    key = np.zeros(len(places), np.int64)
    for k in range(ORDER + 1):
        key |= line[places - k].astype(np.int64) << 8 * k
        yield key | k << 8 * (ORDER + 1)


def context(gram):
    """The context of a gram, in an array or a column: its number without the symbol."""
    return F.shiftright(gram, 8) if isinstance(gram, Column) else gram >> 8


@dataclass
class Model:
    """Sorted grams with counts and sorted contexts with counts and followers, each for accepted (0) and rejected (1) URLs; and the
    calibration: log odds of acceptance = slope * difference + shift. ``rest`` has the contexts beyond FREQUENT grams, as ``counted``
    stores them; None where there are none."""

    gram: np.ndarray
    count: np.ndarray
    context: np.ndarray
    total: np.ndarray
    followers: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    rest: DataFrame | None = None

    def chances(self, line: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of each symbol as accepted and as rejected, and how many orders have gone into it: a context that is not held
        ends them, since longer ones are not held either."""
        p, orders = np.full((len(places), 2), 1 / 256), np.zeros(len(places), np.int32)
        for g in grams(line, places):
            c = context(g)
            i = np.searchsorted(self.context, c)
            known = np.flatnonzero(self.context[np.minimum(i, len(self.context) - 1)] == c) if len(self.context) else []
            if not len(known):
                break
            i, g = i[known], g[known]
            j = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
            seen = self.count[j] * (self.gram[j] == g)[:, None]
            n, t = self.total[i], self.followers[i]
            p[known] = np.where(n > 0, (seen + t * p[known]) / np.maximum(n + t, 1), p[known])
            orders[known] += 1
        return p, orders

    def difference(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-likelihood as accepted less that as rejected, by symbol, of each text; without ``rest``."""
        p, _ = self.chances(*symbols(data, at))
        ends = np.concatenate([[0], np.cumsum(np.diff(at) + 1)])
        return row_sums(np.log(p[:, 0]) - np.log(p[:, 1]), ends) / (np.diff(at) + 1)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(data, at) + self.shift, -500, 500)))


def counted(urls: DataFrame) -> Model | None:
    """The models of all labelled URLs (url, verdict); None unless there are both verdicts. Spark counts the grams and gathers those of a
    context, 256 at most. The most frequent contexts, with FREQUENT grams together, come to the driver; the others stay a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(0))
            blocked = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)) == "block"
            for i, j in pieces(at, 1 << 20):
                line, places = symbols(data[at[i] : at[j]], at[i : j + 1] - at[i])
                label = np.repeat(blocked[i:j], np.diff(at[i : j + 1]) + 1)
                for g in grams(line, places):
                    for verdict in (0, 1):
                        keys, n = np.unique(g[label == verdict], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), verdict, np.int32)), pa.array(n.astype(np.int64))], ["gram", "label", "n"])

    found = urls.select("url", "verdict").mapInArrow(run, "gram long, label int, n long").groupBy("gram").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    own = found.groupBy(context(F.col("gram")).alias("context")).agg(
        *[F.sum(f"n{k}").alias(f"t{k}") for k in (0, 1)], *[F.count_if(F.col(f"n{k}") > 0).alias(f"f{k}") for k in (0, 1)], F.collect_list(F.struct("gram", "n0", "n1")).alias("follow")
    )
    own = stored(own.withColumn("size", F.floor(16 * F.log2(F.col("t0") + F.col("t1")))))
    sums = own.filter("context = 0").select("t0", "t1").first()  # the context without bytes
    if sums is None or not all(sums):
        return None
    # A context is as frequent as those that it ends in, or less: above a size, the suffixes of all are there too.
    least, n = 1 << 20, 0
    for size, more in sorted(((r[0], r[1]) for r in own.groupBy("size").agg(F.sum(F.size("follow"))).collect()), reverse=True):
        n += more
        if n > FREQUENT:
            break
        least = size
    got = own.filter(F.col("size") >= least).sort("context").toArrow()
    follow = got["follow"].combine_chunks().flatten()
    gram, n0, n1 = (follow.field(f).to_numpy() for f in ("gram", "n0", "n1"))
    order = np.argsort(gram)
    pair = lambda name: np.stack([got[f"{name}{k}"].to_numpy().astype(float) for k in (0, 1)], 1)
    return Model(gram[order], np.stack([n0, n1], 1)[order].astype(float), got["context"].to_numpy(), pair("t"), pair("f"), rest=own.filter(F.col("size") < least).drop("size") if n > FREQUENT else None)


def differences(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``difference``, the log-likelihood of ``url`` as accepted less that as rejected, by symbol, in its place. What the
    broadcast part of the model leaves open meets ``rest`` in a join, a row for each place and longer context."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    kept = [c for c in rows.columns if c != "url"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", difference double"
    whole = model.rest is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, key = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            data, at = utf8(batch.column(len(kept)))
            for i, j in pieces(at, 1 << 20):
                cut = at[i : j + 1] - at[i]
                line, places = symbols(data[at[i] : at[j]], cut)
                p, orders = m.chances(line, places)
                ends = np.concatenate([[0], np.cumsum(np.diff(cut) + 1)])
                sums = row_sums(np.log(p[:, 0]) - np.log(p[:, 1]), ends)
                columns = [*(batch.column(k).slice(i, j - i) for k in range(len(kept))), pa.array(sums / np.diff(ends))]
                if not whole:
                    open_, of = [], []
                    for k, g in enumerate(grams(line, places)):
                        some = np.flatnonzero(orders <= k)
                        of.append(some)
                        open_.append(g[some])
                    n, g = np.concatenate(of), np.concatenate(open_)
                    order = np.argsort(n, kind="stable")
                    n, g = n[order], g[order]
                    steps = pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(p[n, 0]), pa.array(p[n, 1]), pa.array(g)], ["n", "p0", "p1", "gram"])
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(n, ends), pa.int32()), steps)
                    columns += [pa.array(key + np.arange(j - i)), pa.array(np.diff(ends)), lists]
                    key += j - i
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [*kept, "difference"] + ([] if whole else ["_key", "_n", "_open"])
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "url")
    if whole:
        return rows.mapInArrow(run, schema)
    part = stored(rows.mapInArrow(run, schema + ", _key long, _n long, _open array<struct<n: int, p0: double, p1: double, gram: long>>"))
    steps = part.select("_key", F.inline("_open")).withColumn("context", context(F.col("gram"))).join(model.rest, "context")
    hit = F.get(F.filter("follow", lambda e: e["gram"] == F.col("gram")), F.lit(0))
    seen = [F.coalesce(hit[f"n{k}"], F.lit(0)).alias(f"s{k}") for k in (0, 1)]
    each = steps.groupBy("_key", "n").agg(F.first("p0").alias("p0"), F.first("p1").alias("p1"), F.array_sort(F.collect_list(F.struct("gram", *seen, "t0", "t1", "f0", "f1"))).alias("e"))
    fold_ = lambda k: F.aggregate("e", F.col(f"p{k}"), lambda p, e: F.when(e[f"t{k}"] > 0, (e[f"s{k}"] + e[f"f{k}"] * p) / (e[f"t{k}"] + e[f"f{k}"])).otherwise(p))
    more = each.groupBy("_key").agg(F.sum(F.log(fold_(0)) - F.log(fold_(1)) - F.log("p0") + F.log("p1")).alias("_more"))
    out = part.drop("_open").join(more, "_key", "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], (F.col("difference") + F.coalesce("_more", F.lit(0.0)) / F.col("_n")).alias("difference"))


def calibrate(model: Model, urls: DataFrame) -> Model:
    """Slope and shift by logistic regression on all (url, verdict), with equal weight for both verdicts; unchanged unless there are both.
    Every Newton step is one aggregation."""
    rows = stored(differences(urls.select("verdict", "url"), model).select((F.col("verdict") == "allow").cast("double").alias("y"), F.col("difference").alias("x")))
    n, good = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or good in (0, n):
        return model
    x, y, w = F.col("x"), F.col("y"), F.when(F.col("y") == 1, 0.5 / good).otherwise(0.5 / (n - good))
    beta = np.array([1.0, 0.0])
    for _ in range(25):  # a weak pull towards slope 1 keeps separable URLs finite
        p = 1 / (1 + F.exp(-(x * float(beta[0]) + float(beta[1]))))
        v = w * p * (1 - p)
        a, b, xx, x1, one = rows.agg(F.sum(w * (y - p) * x), F.sum(w * (y - p)), F.sum(v * x * x), F.sum(v * x), F.sum(v)).first()
        step = np.linalg.solve(np.array([[xx, x1], [x1, one]]) + 1e-3 * np.eye(2), np.array([a, b]) - 1e-3 * (beta - [1.0, 0.0]))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return replace(model, slope=float(beta[0]), shift=float(beta[1]))


def fit(urls: DataFrame) -> Model | None:
    """Models and calibration of all labelled URLs (url, verdict). A URL counts once, however often it occurs; a fifth of them, by a hash
    of the URL, calibrates, the others are counted."""
    known = stored(urls.select("url", "verdict").distinct().withColumn("held", F.pmod(F.xxhash64("url", F.lit(5)), F.lit(5)) == 0))
    model = counted(known.filter("not held"))
    return None if model is None else calibrate(model, known.filter("held"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: (id_col, host, path, rule, verdict, score).

    ``score`` is the calibrated chance of acceptance by the models; it decides from 0.5 on where no rule fits. A null url counts as
    empty; it and a url without ``://`` have neither host nor path, no rule, and are judged by the models like others. Without rules of
    both verdicts that fit some url there is no model: score is null and what no rule decides is allowed. Repeated rows give repeated
    results; other columns are ignored, whatever their names."""
    host, path = parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    model = fit(rows.filter("verdict is not null").select("url", "verdict"))
    if model is None:
        found = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        odds = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), model.slope * F.col("difference") + model.shift))
        found = differences(rows, model).withColumn("score", 1 / (1 + F.exp(-odds)))
    own = F.when(F.col("score") < 0.5, "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: rule and verdict of every page's url."""
    return judged(table(spark, sf_dir, "pages"))
