from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionlab.llm import packing as p
from regionlab.llm import tokens


def best_fit(sizes, capacity):
    """Best-fit decreasing over single items."""
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= s]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= s
        else:
            room.append(capacity - s)
    return len(room)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan(case):
    capacity, sizes = case
    histogram = Counter(sizes)
    slots, n = p.plan(histogram, capacity)
    load = Counter()
    ranks = {s: [] for s in histogram}
    for s in slots:
        for r in range(s.first, s.first + s.count):
            load[s.container + (r - s.first) // s.each] += s.size
            ranks[s.size].append(r)
    assert all(sorted(ranks[s]) == list(range(histogram[s])) for s in histogram)
    assert sorted(load) == list(range(n))
    assert max(load.values(), default=0) <= capacity
    assert n <= best_fit(sizes, capacity) + 1


def test_slots_by_rank():
    """Every rank finds its one slot in its range, ranges hold about two, and there are at most twice as many rows as slots."""
    histogram = {k: 1 + (k * 7919) % 5000 for k in range(1, 300)} | {7: 200_000}
    slots, _ = p.plan(histogram, 300)
    widths, rows = p.by_rank(slots, histogram)
    assert len(rows) <= 2 * len(slots)
    width, held = dict(widths), {}
    for size, b, s in rows:
        held.setdefault((size, b), []).append(s)
    met = items = 0
    for size, n in histogram.items():
        for r in range(0, n, 13):
            found = held[size, r // width[size]]
            assert sum(s.first <= r < s.first + s.count for s in found) == 1
            met, items = met + len(found), items + 1
    assert met / items < 3
    assert p.numbered_parts(0) == p.LEAST_PARTS and p.numbered_parts(10**10) * p.PART_ROWS >= 10**10


def test_plan_refuses():
    with pytest.raises(ValueError):
        p.plan({11: 1}, 10)


def test_pack(spark):
    """Every item once and whole unless it is too long; a third of all of one size; nulls, zeros, repeats and an empty table."""
    rows = [(i, 7) for i in range(300)] + [(1000 + i, 1 + i % 10) for i in range(600)] + [(5000, 10), (5001, 25), (5002, 30), (5003, 0), (5004, None), (5001, 25)]
    df = spark.createDataFrame(rows, "rest bigint, size bigint")
    got = p.pack(df, {"a": 10, "b": 64}, id_col="rest", size="size").cache()
    c = p.containers(got).collect()
    assert all(0 < r["used"] <= r["capacity"] and r["unused"] == r["capacity"] - r["used"] for r in c)
    total = sum(n or 0 for _, n in rows)
    for name, capacity in (("a", 10), ("b", 64)):
        assert sum(r["used"] for r in c if r["limit_name"] == name) == total
        numbers = sorted(r["container"] for r in c if r["limit_name"] == name)
        assert numbers == list(range(len(numbers)))
        loose = [n % capacity if n > capacity else n for _, n in rows if n]
        full = sum(n // capacity for _, n in rows if n and n > capacity)
        assert len(numbers) <= full + best_fit([n for n in loose if n], capacity) + 1
    pieces = got.where("limit_name = 'a' and rest in (5001, 5002)").groupBy("rest", "piece", "n_tokens").count().collect()
    assert {(r["rest"], r["piece"], r["n_tokens"], r["count"]) for r in pieces} == {(5001, 0, 10, 2), (5001, 1, 10, 2), (5001, 2, 5, 2), (5002, 0, 10, 1), (5002, 1, 10, 1), (5002, 2, 10, 1)}
    assert got.where("rest in (5003, 5004)").count() == 0
    assert p.pack(df.limit(0), {"a": 10}, id_col="rest", size="size").count() == 0
    with pytest.raises(ValueError):
        p.pack(df, {"a": 0}, id_col="rest", size="size")


def test_token_counts(spark):
    df = spark.createDataFrame([("Привіт, world!",), ("",), (None,), ("<|endoftext|>",)], "text string")
    got = [r[0] for r in df.select(tokens.token_count(F.col("text"))).collect()]
    assert got[0] == len(tokens.encoding().encode_ordinary("Привіт, world!")) > 2
    assert got[1:3] == [0, 0]
    assert got[3] > 1
