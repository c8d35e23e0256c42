import random

import numpy as np

from regionlab.llm import subjects as s

OWN = {"sea": "ship wave anchor harbour sailor deck mast".split(), "farm": "cow barn tractor wheat plough field hay".split(), "law": "court judge verdict statute appeal clause witness".split()}
COMMON = "large small old seems often with beside again today".split()
SUBJECTS = [(1, "sea", "Ships and harbours"), (2, "farm", None), (3, "law", "Courts")]


def corpus(n, seed):
    rnd = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        mine = rnd.sample(sorted(OWN), rnd.choice((1, 1, 2)))
        text = ". ".join(" ".join(rnd.choice(OWN[mine[k % len(mine)]]) if rnd.random() < 0.4 or j == 0 else rnd.choice(COMMON) for j in range(6)) for k in range(10))
        rows.append((i, text))
        truth[i] = set(mine)
    return rows, truth


def frames(spark, rows, labels):
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id bigint, subject string"),
        spark.createDataFrame(SUBJECTS, "subject_id int, subject string, description string"),
    )


def test_held_out(spark):
    """A fifth of the documents is labelled, one label in ten wrongly; the others get their subjects."""
    rows, truth = corpus(300, 1)
    rnd = random.Random(2)
    labels = [(i, rnd.choice(sorted(OWN)) if rnd.random() < 0.1 else f" {x.upper()}") for i in range(60) for x in truth[i]] + [(5, None), (None, "law"), (6, "nothing"), (99999, "sea")]
    docs, labelled, named = frames(spark, rows, labels)
    got = {}
    for r in s.subjects_of(s.subject_mixtures(docs, labelled, named)).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i) == truth[i] for i in range(60, 300))
    assert right >= 0.95 * 240


def test_headings_are_of_no_subject(spark):
    """A line that heads most documents of one subject and some of the others, which differ in length, is no sentence of it."""
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        x = sorted(OWN)[i % 3]
        head = "Notebook page\n" if rnd.random() < (0.6 if x == "law" else 0.4) else ""
        rows.append((i, head + ". ".join(" ".join(rnd.choice(OWN[x] if j % 2 else COMMON) for j in range(6)) for _ in range(4 if x == "sea" else 12))))
        labels.append((i, x))
    docs, labelled, named = frames(spark, rows, labels[:200])
    got = s.subject_mixtures(docs, labelled, named).collect()
    assert {(r["doc_id"], r["subject"]) for r in got} == set(labels)
    # a sentence with words and without subject counts in the share
    assert all(r["share"] == r["sentences"] / (r["sentences"] + (1 if rows[r["doc_id"]][1].startswith("Notebook") else 0)) for r in got)


def test_document_weights(spark):
    rows, truth = corpus(120, 8)
    docs, labels, named = frames(spark, rows, [(i, x) for i in range(60) for x in truth[i]])
    weights = {}
    for r in s.subject_mixtures(docs, labels, named, whole=True).collect():
        weights.setdefault(r["doc_id"], {})[r["subject"]] = r["weight"]
    assert all(sum(w.values()) <= 1 + 1e-5 and set(w) == truth[i] for i, w in weights.items()) and len(weights) == 120


def test_updates_settle(spark):
    rows, truth = corpus(200, 9)
    docs, labels, _ = frames(spark, rows, [(i, x) for i in range(80) for x in truth[i]])
    matrix = s.term_matrix(docs, "doc_id", "text")
    start = s.seed(matrix, "doc_id", labels, [x[1] for x in SUBJECTS], ["", "", ""])
    model = s.factor(matrix, start, sweeps=30)
    assert model.moved[-1] <= s.SETTLED and len(model.moved) < 30 and model.moved[0] > model.moved[-1]
    again = s.factor(matrix, start, sweeps=60, settled=1e-6)
    same = lambda m: {(r[0], r[1]) for r in s.subjects_of(s.mixtures(matrix, "doc_id", m)).collect()}
    assert len(same(model) ^ same(again)) <= 2


def test_edges(spark):
    """Null, empty and wordless texts have no subject; a repeated id, a long text; no labels; no documents."""
    rows, truth = corpus(60, 3)
    docs, labels, named = frames(spark, [*rows, (1000, None), (1001, ""), (1002, "… 12 !"), (1, rows[1][1]), (1003, "ship. " * 20_000)], [(i, x) for i in range(40) for x in truth[i]])
    got = s.subjects_of(s.subject_mixtures(docs, labels, named)).collect()
    assert not {1000, 1001, 1002} & {r["doc_id"] for r in got}
    assert {r["subject"] for r in got if r["doc_id"] == 1003} == {"sea"}
    assert s.subject_mixtures(docs, labels.limit(0), named).count() >= 0
    assert s.subject_mixtures(docs.limit(0), labels, named).count() == 0


def test_updates_lower_the_divergence():
    rnd = np.random.default_rng(0)
    v = rnd.poisson(2, (30, 40)).astype(np.float32)
    row, col = np.nonzero(v)
    n = v[row, col]
    h = rnd.random((4, 40)).astype(np.float32)
    h /= h.sum(1, keepdims=True)

    def loss(w, h):
        wh = (w * v.sum(1)).T @ h
        return float((wh - v * np.log(wh + 1e-12)).sum())

    losses = []
    for _ in range(8):
        _, w, q = s._solve(row, h[:, col], n, 4)
        losses.append(loss(w, h))
        h = np.stack([np.bincount(col, weights=q[k], minlength=40) for k in range(4)])
        h = (h / h.sum(1, keepdims=True)).astype(np.float32)
    assert all(b <= a + 1e-3 for a, b in zip(losses, losses[1:], strict=False))
