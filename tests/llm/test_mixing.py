import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regionlab.llm import mixing as m

source = st.tuples(st.floats(0.01, 1), st.integers(0, 5), st.integers(0, 1000))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), source, min_size=1), st.floats(0, 5000))
def test_water_fill(cases, total):
    """No cap is exceeded, nothing is lost while there is room, and sources below their cap keep the proportions of their targets."""
    got = m.water_fill({k: (w, c) for k, (w, c, _) in cases.items()}, {k: n for k, (_, _, n) in cases.items()}, total)
    caps = {k: c * n for k, (_, c, n) in cases.items()}
    assert all(-1e-6 <= s.allotted <= caps[s.source] + 1e-6 for s in got)
    assert sum(s.allotted for s in got) == pytest.approx(min(total, sum(caps.values())), abs=1e-6)
    free = [s for s in got if s.allotted < caps[s.source] - 1e-6]
    ratios = [s.allotted / s.target for s in free]
    assert not ratios or max(ratios) == pytest.approx(min(ratios), rel=1e-6, abs=1e-9)
    assert all(s.allotted / s.target <= min(ratios, default=float("inf")) + 1e-6 for s in got if s not in free)


TARGETS = [("a", 0.5, 1), ("B ", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 4), (None, 0.2, 1)]


def test_mix(spark):
    rows = [(i, "A" if i % 2 else " a", 10) for i in range(2000)] + [(5000 + i, "b", 7) for i in range(100)] + [(6000 + i, "C", 3) for i in range(50)]
    rows += [(7000, None, 5), (7001, "other", 5), (7002, "a", 0), (7003, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen, shares = m.mix(docs, targets, total=10_000)
    got = {r["source"]: r for r in m.reached(chosen, shares).collect()}
    # b and c are clamped at their caps, a takes what is left
    assert (got["b"]["tokens"], got["c"]["tokens"], got["none"]["tokens"]) == (2100, 300, 0)
    assert abs(got["a"]["tokens"] - 7600) <= 10
    assert sum(r["share"] for r in got.values()) == pytest.approx(1)
    assert {r["repeats"] for r in chosen.where("source = 'b'").collect()} == {3}
    assert {r["repeats"] for r in chosen.where("source = 'a'").collect()} == {1}
    assert chosen.where("doc_id >= 7000").count() == 0
    again, _ = m.mix(docs.repartition(3), targets, total=10_000)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in chosen.collect()}
    other, _ = m.mix(docs, targets, total=10_000, seed=3)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in chosen.collect()}
    chosen, shares = m.mix(docs.limit(0), targets)
    assert chosen.count() == 0
    assert m.reached(chosen, shares).where("share > 0").count() == 0


def test_repeats_by_fraction(spark):
    docs = spark.createDataFrame([(i, "a", 1 + i % 5) for i in range(1000)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 4)], "source string, target_share double, max_repeats int")
    chosen, shares = m.mix(docs, targets, total=3000 * 2.5)
    assert {r["repeats"] for r in chosen.collect()} == {2, 3}
    assert abs(m.reached(chosen, shares).first()["tokens"] - 7500) <= 5
