import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionlab.llm import repetition as r


def brute(w, run):
    """Words within a run of ``run`` or more that began earlier, by comparing all pairs of places."""
    hit = set()
    for i in range(len(w) - run + 1):
        if any(w[j : j + run] == w[i : i + run] for j in range(i)):
            hit |= set(range(i, i + run))
    return len(hit)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.integers(2, 4))
def test_covered_and_bounds(w, run):
    n = brute(w, run)
    assert r.covered(w, run) == n
    for rule in r.RULES:
        assert rule.bound(w, run) >= n, rule.name


TEXTS = ["a b c d", "one two three one two three", "One, two! three... (one) TWO three", "a a a a a a", "", None, "…", "x " * 50_000, "a b c " + "d e f g h i j k l m n o p q " + "a b c"]


def test_found_whatever_the_order(spark):
    """The cascade's order, even an empty sample's, does not change what is found."""
    want = {t for t in TEXTS if t and (w := r.words(t)) and brute(w[:300], 3) >= 0.4 * len(w[:300])}
    df = spark.createDataFrame([(t, i, "q") for i, t in enumerate(TEXTS + TEXTS)], "text string, id int, decide string")
    for sample in (0, 5, 100):
        found, _ = r.repetitive(df, sample_rows=sample)
        got = found.collect()
        assert {x["text"] for x in got} == want
        assert len(got) == 2 * len(want)
        assert found.columns == ["text", "id", "decide"]
    assert r.repetitive(df.limit(0))[0].count() == 0


def test_cascade_prefers_cheap_rejections():
    texts = ["a b c d e f g"] * 20 + ["x y z x y z"] * 5
    slow = r.Rule("slow", lambda w, run: sum(i for i in range(3000)) * 0 + r._spare_words(w, run))
    plan = r.plan_cascade(texts, 0.4, rules=[slow, r.Rule("fast", r._spare_words)])
    assert [m.name for m in plan] == ["fast"]
    assert plan[0].rejects == pytest.approx(0.8)


def test_shares(spark):
    df = spark.createDataFrame([("Рядок тут.\nРядок, тут\nінше",), (None,), ("a b c a b c",)], "text string")
    got = [tuple(x[0]) for x in df.select(r.shares(F.col("text"))).collect()]
    assert got[0] == (5, 0.0, 0.4, 0.4, 0.0)
    assert got[1] == (0, 0, 0, 0, 0)
    assert got[2] == (6, 0.5, 0, 0, 1.0)
