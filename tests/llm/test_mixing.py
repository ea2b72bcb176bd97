"""Operator 9: windows, deviation and wholeness."""

from collections import Counter, defaultdict

import pytest

from lumenflow.llm import mixing


def plain_pattern(units):
    """Earliest deadline first, slot by slot."""
    cycle, done, out = sum(units.values()), Counter(), []
    for t in range(cycle):
        ready = [(-(-(done[s] + 1) * cycle // m), s) for s, m in sorted(units.items()) if done[s] < m and done[s] * cycle // m <= t]
        _, s = min(ready)
        out.append(s)
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [None, {"s0": 0.7, "s1": 0.2, "s2": 0.1}, {"s0": 1.0}, {}])
def test_windows_and_deviation(spark, table, weights):
    docs = table([f"text {i}" for i in range(700)])
    rows = mixing.schedule(docs, weights, block_rows=4, units=50).collect()
    assert sorted(r.row.doc_id for r in rows) == list(range(700)) and all(r.release <= r.slot and (r.deadline is None or r.slot < r.deadline) for r in rows)
    blocks = {(r.source, r.block_no): r.slot for r in rows}
    assert len(set(blocks.values())) == len(blocks)
    units = {s: v for s, v in ((r.source, r.m) for r in mixing.shares(docs.groupBy("source").count().withColumnRenamed("count", "n"), weights, 50).collect())}
    assert {s for s, m in units.items() if not m} == ({"s1", "s2"} if weights == {"s0": 1.0} else set())
    cycle, by = sum(units.values()), defaultdict(list)
    last = [slot for (s, _), slot in sorted(blocks.items()) if not units[s]]  # sources of weight 0 follow the others, one by one
    assert last == sorted(last) and not any(slot > last[0] for (s, _), slot in blocks.items() if units[s] and last)
    assert {r.source for r in rows if r.deadline is None} == {s for s, m in units.items() if not m}
    for (s, k), slot in blocks.items():
        if units[s]:
            by[s].append(slot)
    end = min((max(v) for v in by.values()))
    for s, slots in by.items():
        for t in range(end + 1):
            assert abs(sum(x < t for x in slots) - t * units[s] / cycle) < 1
    want = plain_pattern({s: m for s, m in units.items() if m})
    assert all(want[slot % cycle] == s for (s, _), slot in blocks.items() if units[s])


def test_small_weights(spark):
    """Weights that are multiples of 1 / UNITS of their sum are met exactly."""
    counts = spark.createDataFrame([(s, 10**9) for s in "abc"], "source string, n long")
    got = {r.source: (r.m, r.cycle) for r in mixing.shares(counts, {"a": 4091 / 4096, "b": 4 / 4096, "c": 1 / 4096}).collect()}
    assert got == {"a": (4091, 4096), "b": (4, 4096), "c": (1, 4096)}


@pytest.mark.parametrize("weights, want", [({"a": 0.7, "b": 0.2, "c": 0.1}, (7, 2, 1)), ({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, (1, 1, 1)), ({"a": 0.9998, "b": 0.0001, "c": 0.0001}, (9998, 1, 1)), ({"a": 5, "b": 0, "c": 10}, (1, 0, 2))])
def test_exact_weights(spark, weights, want):
    """The cycle is the sum of the smallest whole numbers in the ratio; a source that is not there takes no part."""
    counts = spark.createDataFrame([(s, 10**9) for s in "abc"], "source string, n long")
    got = {r.source: (r.m, r.cycle) for r in mixing.shares(counts, weights | {"gone": 0.1234567}).collect()}
    assert got == {s: (m, sum(want)) for s, m in zip("abc", want, strict=True)}


def test_no_drift(spark):
    """Weights of 1 to 9,999, and ones without a common measure that is small enough: the pattern is within one block of its targets at each
    slot, over three cycles. Beyond EXACT the targets themselves are multiples of a slot."""
    counts = spark.createDataFrame([(s, 10**9) for s in "ab"], "source string, n long")
    for weights in ({"a": 0.9999, "b": 0.0001}, {"a": 2**0.5, "b": 3**0.5}):
        share = mixing.shares(counts, weights)
        m = {r.source: (r.m, r.cycle) for r in share.collect()}
        at = {s: [] for s in "ab"}
        for r in mixing.pattern(share).collect():
            at[r.source].append(r.at)
        for s, slots in at.items():
            n, cycle = m[s]
            slots = sorted(x + k * cycle for k in range(3) for x in slots)
            assert len(slots) == 3 * n and all(k * cycle // n <= x < -(-(k + 1) * cycle // n) for k, x in enumerate(slots))
        target = {s: w / sum(weights.values()) for s, w in weights.items()}
        assert all(abs(n / cycle - target[s]) < (1e-12 if weights["a"] < 1 else 1 / 4096) for s, (n, cycle) in m.items())


def test_ties(spark):
    """Rows that repeat an id have an order of their own, whatever the partitioning."""
    rows = [(i % 3, "s", f"t{i}") for i in range(60)]
    orders = []
    for n in (1, 7):
        docs = spark.createDataFrame(rows[:: 1 if n == 1 else -1], "doc_id long, source string, text string").repartition(n)
        orders.append(sorted((r.slot, r.block_pos, r.row.text) for r in mixing.schedule(docs).collect()))
    assert orders[0] == orders[1]


def test_mixed_and_edges(spark, edges, none):
    out = mixing.mixed(edges)
    assert out.columns == edges.columns and sorted(map(str, out.collect())) == sorted(map(str, edges.collect()))
    assert mixing.mixed(none).count() == 0 and mixing.schedule(none).count() == 0


def test_order_in_files(spark, table, tmp_path):
    docs = table([f"t{i}" for i in range(500)])
    plan = {r.row.doc_id: (r.slot, r.source, r.block_pos) for r in mixing.schedule(docs).collect()}
    mixing.mixed(docs, slots_per_run=4).write.parquet(str(tmp_path / "m"))
    for f in (tmp_path / "m").glob("*.parquet"):
        ids = [r.doc_id for r in spark.read.parquet(str(f)).collect()]
        assert [plan[i] for i in ids] == sorted(plan[i] for i in ids)
