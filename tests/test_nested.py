import pytest
from pyspark.sql import functions as F

from regionlab.operators import nested

SCHEMA = "row_id int, node_pre int, regions array<struct<text:string,node_pre:int,lines:array<struct<text:string,words:array<struct<text:string>>>>,marks:array<struct<k:int>>>>"
ROWS = [
    (1, 7, [("a", 1, [("l", [("w",), None, ("v",)]), None, ("m", None)], [(1,)]), None, ("b", 2, None, []), (None, None, [], None)]),
    (2, None, None),
    (3, 9, []),
    (None, 1, [("c", 3, [(None, [])], None)]),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return nested.interval_nodes(spark.createDataFrame(ROWS, SCHEMA), "regions", ["row_id", "node_pre"])


def walk(kind, items, children, at=()):
    """The nodes of a record in depth-first order, by plain recursion."""
    for i, x in enumerate(items or []):
        if x is not None:
            yield (kind, *at, i)
            for name, pos in children.get(kind, []):
                yield from walk(name, x[pos], children, (*at, i))


def test_depth_first(nodes):
    children = {"regions": [("regions.lines", 2), ("regions.marks", 3)], "regions.lines": [("regions.lines.words", 1)]}
    for row_id, _, regions in ROWS:
        want = list(walk("regions", regions, children))
        got = nodes.where(F.col("row_id").eqNullSafe(F.lit(row_id))).orderBy("node_pre").collect()
        assert [(r["node_kind"], *[r[f"idx_{k}"] for k in range(1, r["node_level"] + 1)]) for r in got] == want
        assert [r["node_pre"] for r in got] == list(range(1, len(want) + 1))
        # post-order: a bijection, and ancestors are those with a smaller pre and a larger post
        assert sorted(r["node_post"] for r in got) == list(range(len(want)))
        for a in got:
            for b in got:
                inside = a["node_pre"] < b["node_pre"] <= a["node_last"]
                assert inside == (a["node_pre"] < b["node_pre"] and a["node_post"] > b["node_post"])


def test_clashing_names(nodes, spark):
    assert nodes.columns[:2] == ["row_id", "kept_node_pre"]
    t = nested.node_tables(spark.createDataFrame(ROWS, SCHEMA), "regions", ["row_id", "node_pre"])
    assert set(t) == {"regions", "regions.lines", "regions.lines.words", "regions.marks"}
    assert t["regions"].columns == ["row_id", "kept_node_pre", "node_level", "node_pre", "node_post", "node_last", "idx_1", "text", "regions_node_pre"]
    assert {(r["idx_1"], r["text"], r["regions_node_pre"], r["kept_node_pre"]) for r in t["regions"].where("row_id = 1").collect()} == {(0, "a", 1, 7), (2, "b", 2, 7), (3, None, None, 7)}


def test_links(spark):
    """Links are exactly the pairs of intervals of a record of which one holds the other."""
    nodes = nested.interval_nodes(spark.createDataFrame(ROWS, SCHEMA), "regions", ["row_id"], ancestors=True)
    got = {(r["row_id"], r["ancestor_pre"], r["ancestor_level"], r["node_pre"], r["node_level"]) for r in nested.contained(nodes, "row_id").collect()}
    rows = nodes.collect()
    assert got == {
        (a["row_id"], a["node_pre"], a["node_level"], b["node_pre"], b["node_level"])
        for a in rows for b in rows if a["row_id"] == b["row_id"] and a["node_pre"] < b["node_pre"] <= a["node_last"]
    }
    assert nested.contained(nodes, "row_id").count() == len(got) == 8
    assert {(r["row_id"], r["ancestor_pre"], r["node_pre"]) for r in nested.parents(nodes, "row_id").collect()} == {(1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 1, 5), (1, 1, 6), (None, 1, 2)}


def test_empty_and_large(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert nested.interval_nodes(df.limit(0), "regions", ["row_id"]).count() == 0
    big = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.struct(F.repeat(F.lit("x"), F.lit(50)).alias("text"))).alias("regions"))
    r = nested.interval_nodes(big, "regions", ["id"]).agg(F.max("node_pre"), F.max("node_post"), F.count("*")).first()
    assert tuple(r) == (20_000, 19_999, 20_000)
    with pytest.raises(TypeError):
        nested.interval_nodes(df, "row_id", [])
