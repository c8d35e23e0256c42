import random

import numpy as np
from pyspark.sql import functions as F

from regionlab.llm import fmindex
from regionlab.llm import overlap as o


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_words():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randrange(90))] for _ in range(2))
        assert o.common_words(a, b) == plain_lcs(a, b)


def test_wavelet_matrix():
    rnd = np.random.default_rng(1)
    for numbers, n in ((2, 1), (3, 64), (5, 200), (300, 1000)):
        x = rnd.integers(0, numbers, n)
        m = fmindex.WaveletMatrix.of(x, numbers)
        at = rnd.integers(0, n + 1, 300)
        of = rnd.integers(0, numbers, 300)
        held = np.array([(x[:i] == c).sum() if c in x else -1 for c, i in zip(of, at)])
        assert (m.count(of, at)[held >= 0] == held[held >= 0]).all()
        number, before = m.at(np.arange(n))
        assert (number == x).all() and (before == [(x[:i] == x[i]).sum() for i in range(n)]).all()


def test_backward_search():
    """Every run is counted at all its places and nowhere else, and the index gives its texts back."""
    rnd = random.Random(2)
    texts = [[rnd.choice("abcd") for _ in range(rnd.randrange(1, 30))] for _ in range(20)] + [list("aaaa")] * 2
    index = fmindex.Index.load(fmindex.Index.build([str(i) for i in range(22)], [" ".join(t) for t in texts], 2).dump())
    names = {i: w for w, i in index.vocabulary.items()}
    assert [[names[x] for x in t] for t in index.texts(np.arange(22))] == texts
    for length in (1, 2, 3, 5, 9):
        runs = [[rnd.choice("abcd") for _ in range(length)] for _ in range(40)]
        low, high = index.search(np.array([index.numbered(r) for r in runs]))
        for r, a, b in zip(runs, low, high):
            assert sorted(index.owner[a:b]) == [i for i, t in enumerate(texts) for k in range(len(t) - length + 1) if t[k : k + length] == r]


def test_index_is_smaller_than_its_texts():
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("абвгдежзийклмн") for _ in range(rnd.randrange(3, 12))) for _ in range(8000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(80)) for _ in range(1500)]
    x = fmindex.Index.build([str(i) for i in range(1500)], texts, 2)
    held = x.transform.bits.nbytes + x.transform.ones.nbytes + x.owner.nbytes + x.ends.nbytes + x.signs.nbytes
    assert held < 0.6 * sum(len(t.encode()) for t in texts)


def test_common_spans():
    assert o.common_spans([1, 2, 3, 9, 4, 5, 8, 1, 2], [4, 5, 1, 2, 3], 2) == [(0, 3), (4, 6), (7, 9)]
    assert o.common_spans([1], [1], 2) == [] == o.common_spans([], [1], 1)


def near(words, rnd, part):
    w = list(words)
    for k in rnd.sample(range(len(w)), int(part * len(w))):
        w[k] = f"x{rnd.randrange(10**6)}"
    return w


def test_recall_on_hard_cases(spark):
    """Texts of which up to a quarter of the words were changed anywhere, against brute force over all pairs."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    train = [[rnd.choice(vocabulary) for _ in range(rnd.choice((5, 9, 14, 25, 45, 90, 200)))] for _ in range(120)]
    held = [near(rnd.choice(train), rnd, rnd.choice((0.05, 0.1, 0.2, 0.24))) for _ in range(160)]
    rows = [(i, "train" if i < len(train) else "eval", None, f"k{i}", " ".join(w), len(w)) for i, w in enumerate(train + held)]
    p = spark.createDataFrame(rows, o.PAGES)
    want = set()
    for i, a in enumerate(train):
        for j, b in enumerate(held):
            if plain_lcs(a, b) >= 0.75 * max(len(a), len(b)):
                want.add((f"k{i}", f"k{len(train) + j}"))
    got = [(r[0], r[1]) for r in o.close_texts(p, shard_words=1500).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(want) > 100
    assert set(got) == want


def test_rows(spark):
    """Image and text ties, every row of a repeated page, nulls, empty and wordless texts; silver plays no part."""
    text = " ".join(f"слово{i}" for i in range(40))
    rows = [
        (1, "train", "a/X1.jpg", text), (2, "train", "b/x1.png", None), (3, "eval", "X1.JPG", "інше зовсім"), (4, "eval", None, text.upper().replace(" ", ",  ")), (5, "eval", "q.jpg", text.replace("слово7 ", "")),
        (6, "train", "", ""), (7, "eval", "", ""), (8, "train", None, "…!"), (9, "eval", None, "… !"), (10, "train", "z.jpg", text), (11, "eval", None, None), (12, "eval", "w.jpg", "слово1 слово2 слово3"),
        (13, "eval", "z.png", text), (14, "train", "q.tif", text + " ще"), (15, None, "q.jpg", text),
    ]
    df = spark.createDataFrame(rows, "id int, s string, f string, t string").withColumnRenamed("id", "words")
    p = o.pages(df, "words", "s", "f", "t", "words", "t")
    assert p.columns[-2:] == ["kept_words", "kept_t"]
    near = o.written(o.close_texts(p))
    pairs = [(r["train_row"], r["eval_row"], r["tie"]) for r in o.overlaps(p, near).collect()]
    assert sorted(pairs) == sorted((r["train_row"], r["eval_row"], r["tie"]) for r in o.overlaps(p, near, hot=2).collect())
    assert sorted(pairs) == [
        (1, 3, "image"), (1, 4, "text"), (1, 5, "close"), (1, 13, "text"), (2, 3, "image"), (8, 9, "text"), (10, 4, "text"), (10, 5, "close"), (10, 13, "image"), (14, 4, "close"), (14, 5, "image"), (14, 13, "close"),
    ]
    r = o.report(p, [F.lit("x")], near).first()
    # of 3 eval rows each: image 1-3, 2-3, 10-13, 14-5; text 1-4, 10-4, 1-13, 10-13, 8-9; close 1-5, 10-5, 14-4, 14-13, 14-5
    assert tuple(r) == ("x", 8, 5, len(pairs), 4, 5, 5)
    assert sorted((r["kind"], r["common"]) for r in o.class_links(p).collect()) == [("close", 39), ("close", 39), ("close", 40), ("image", None), ("image", None), ("image", None), ("text", None), ("text", None)]
    assert o.overlaps(o.pages(df.limit(0), "words", "s", "f", "t")).count() == 0
    assert o.report(o.pages(df.limit(0), "words", "s", "f", "t"), [F.lit(1)]).count() == 0


def test_salted_join(spark):
    """A key that holds most rows of both sides is dealt to several tasks and pairs every row with every other once."""
    a = spark.range(95).select(F.when(F.col("id") < 70, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("x"))
    b = spark.range(60).select(F.when(F.col("id") < 45, "hot").otherwise((F.col("id") + 20).cast("string")).alias("k"), F.col("id").alias("y"))
    plain = a.join(b, "k")
    got = o.salted_join(a, b, "k", hot=10).select("k", "x", "y")
    assert plain.count() > 3000 and got.exceptAll(plain).count() == 0 == plain.exceptAll(got).count()


def test_own_partitions(spark):
    for n in (1, 2, 13, 200):
        k = o.own_partitions(spark, n)
        where = spark.createDataFrame([(x,) for x in k], "slot int").repartition(n, "slot").select(F.spark_partition_id()).collect()
        assert len(k) == n and sorted(r[0] for r in where) == list(range(n))


def test_repeated_words_stay_small():
    """A text of one word over and over looks its one run up once."""
    index = fmindex.Index.load(fmindex.Index.build(["a"], [" ".join(["a"] * 50_000)], 2).dump())
    assert list(o.close_to(index, ["b", "c"], [["a"] * 45_000, ["a"] * 20_000])) == [("b", "a", 45_000, 1, 45_000)]


def test_shards():
    s = o.plan_shards({3: 2, 5: 10, 8: 10, 30: 1000, 31: 1}, most=500)
    assert [(x.shortest, x.longest, x.run, x.parts) for x in s] == [(3, 3, 1, 1), (5, 8, 2, 1), (30, 30, 2, 62), (31, 31, 2, 1)]
    assert [x.no for x in s] == [0, 1, 2, 64]
    assert o.deals(s, {31: 1, 3: 2, 8: 1, 5: 1}) == [(3, 0, 1, 1), (5, 1, 2, 1), (8, 1, 2, 1), (31, 64, 2, 1)]
    assert o.plan_routes(s[:2], {3: 10, 4: 1, 10: 4, 11: 9}, 0.75, 20) == [(3, 0, 2), (4, 0, 2), (4, 1, 3), (10, 1, 3)]
    assert o.plan_shards({}) == []


def test_least_common_runs():
    """Whatever the lengths, texts that are almost the same share a run by the bound."""
    for n in range(3, 300):
        for m in range(3, 400):
            c, run = o.common_due(n, m), o.run_length(n)
            assert min(n, m) < c or (o.least_common(n, m, run) >= 1 and o.least_covered(n, m, run) >= run), (n, m)


def every_fourth(w, rnd):
    return [f"x{rnd.randrange(10**6)}" if k % 4 == 3 else x for k, x in enumerate(w)]


def swapped(w, rnd):
    w = list(w)
    for k in range(0, len(w) - 1, 4):
        w[k], w[k + 1] = w[k + 1], w[k]
    return w


def inserted(w, rnd):
    return [y for k, x in enumerate(w) for y in ((x, f"x{rnd.randrange(10**6)}") if k % 3 == 1 else (x,))]


def moved(w, rnd):
    w = list(w)
    for _ in range(len(w) // 4):
        w.insert(rnd.randrange(len(w)), w.pop(rnd.randrange(len(w))))
    return w


def both(w, rnd):
    """Words left out of each side, at different places."""
    return [y for k, x in enumerate(w) for y in ((f"x{rnd.randrange(10**6)}", x) if k % 4 == 1 else () if k % 4 == 3 else (x,))]


def test_no_pair_is_filtered(spark):
    """Swaps, insertions, moves and every fourth word changed, long and short: every pair of the rule is found."""
    rnd = random.Random(5)
    lengths = (3, 4, 5, 6, 7, 8, 9, 12, 16, 24, 40, 41, 45, 60, 120, 400)
    train = [[f"w{rnd.randrange(2000)}" for _ in range(n)] for n in lengths for _ in range(6 if n < 400 else 2)]
    held = [f(w, rnd) for w in train for f in (every_fourth, swapped, inserted, moved, both)]
    rows = [(i, "train" if i < len(train) else "eval", None, f"k{i}", " ".join(w), len(w)) for i, w in enumerate(train + held)]
    want = set()
    for i, a in enumerate(train):
        for j, b in enumerate(held):
            if min(len(a), len(b)) >= 0.75 * max(len(a), len(b)) and plain_lcs(a, b) >= 0.75 * max(len(a), len(b)):
                want.add((f"k{i}", f"k{len(train) + j}"))
    assert len(want) > 250
    for shard_words in (1500, 1_500_000):
        got = [(r[0], r[1]) for r in o.close_texts(spark.createDataFrame(rows, o.PAGES), shard_words=shard_words, part_words=2000).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want
