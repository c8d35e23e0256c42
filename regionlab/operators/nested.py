"""Deeply nested records to flat node tables, tied by interval labels.

Every struct in (possibly repeated) arrays of structs below one column is a *node* of its record's tree; the record itself is the
root. A depth-first traversal gives each node a pre-order and a post-order number. Node ``a`` is an ancestor of ``b`` in the same
record exactly if ``a.pre < b.pre and b.pre <= a.last`` (``last = pre + number of descendants``), or, which is the same,
``a.pre < b.pre and a.post > b.post``.

The traversal happens inside the row: children are concatenated behind their parent by higher-order functions, so the position in
the resulting array *is* the pre-order number and the post-order number follows from ``post = pre + descendants - level``. The whole
operator is a projection and a generator: no shuffle, no Python, no window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlab.session import kept


@dataclass
class NodeKind:
    """One level of the tree: ``name`` is the dotted path of the array below the root column."""

    name: str
    level: int
    path: tuple[str, ...]
    scalars: tuple[T.StructField, ...]
    children: list["NodeKind"] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    @property
    def payload_type(self) -> T.StructType:
        return T.StructType(list(self.scalars))


def _is_node_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)


def node_kinds(column: str, dtype: T.DataType, level: int = 1, path: tuple[str, ...] = ()) -> NodeKind:
    """The tree of node kinds of an array of structs, from its schema alone."""
    if not _is_node_array(dtype):
        raise TypeError(f"{column}: an array of structs is needed, not {dtype.simpleString()}")
    path = (*path, column)
    fields = dtype.elementType.fields
    kind = NodeKind(".".join(path), level, path, tuple(f for f in fields if not _is_node_array(f.dataType)))
    kind.children = [node_kinds(f.name, f.dataType, level + 1, path) for f in fields if _is_node_array(f.dataType)]
    return kind


def _node_type(root: NodeKind, depth: int, payload: bool, ancestors: bool) -> T.StructType:
    fields = [T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("descendants", T.IntegerType())]
    fields += [T.StructField(f"i{k}", T.IntegerType()) for k in range(1, depth + 1)]
    if payload:
        fields += [T.StructField(f"at_{k.level}_{n}", k.payload_type) for n, k in enumerate(root.walk()) if k.scalars]
    if ancestors:
        fields += [T.StructField(f"up_{k}", T.IntegerType()) for k in range(1, depth)]
    return T.StructType(fields)


def _traverse(array: Column, kind: NodeKind, root: NodeKind, depth: int, payload: bool, ancestors: bool, node_type: T.StructType, above: list[Column]) -> Column:
    empty = F.array().cast(T.ArrayType(node_type))
    numbered = {k.name: n for n, k in enumerate(root.walk())}

    def element(x: Column, i: Column) -> Column:
        at = [*above, i.cast("int")]
        below = [_traverse(x[c.path[-1]], c, root, depth, payload, ancestors, node_type, at) for c in kind.children]
        below_all = F.concat(*below) if len(below) > 1 else below[0] if below else empty

        def own(rest: Column) -> Column:
            parts = [F.lit(kind.name), F.lit(kind.level), F.size(rest)]
            parts += [at[k] if k < len(at) else F.lit(-1) for k in range(depth)]
            if payload:
                for k in root.walk():
                    if k.scalars:
                        same = numbered[k.name] == numbered[kind.name]
                        parts.append(F.struct(*[x[f.name].alias(f.name) for f in k.scalars]) if same else F.lit(None).cast(k.payload_type))
            if ancestors:
                parts += [F.lit(None).cast("int")] * (depth - 1)
                # every descendant learns how far before it its ancestor of this level stands
                rest = F.transform(rest, lambda d, k: d.withField(f"up_{kind.level}", k.cast("int") + 1)) if kind.children else rest
            named = F.struct(*[p.alias(f.name) for p, f in zip(parts, node_type.fields, strict=True)])
            return F.concat(F.array(named), rest)

        # the one-element transform binds the children once: they are both counted and kept
        nodes = F.flatten(F.transform(F.array(below_all), own)) if kind.children else own(empty)
        return F.when(x.isNull(), empty).otherwise(nodes)

    return F.coalesce(F.flatten(F.transform(array, element)), empty)


def interval_nodes(df: DataFrame, column: str, keep: list[str], payload: bool = True, ancestors: bool = False) -> DataFrame:
    """All nodes below ``column``, one row each.

    Columns: ``keep`` (of the record), then ``node_kind``, ``node_level`` (1 for the elements of ``column``), ``node_pre``,
    ``node_post``, ``node_last`` (the pre-order number of its last descendant), ``idx_1..idx_depth`` (0-based array positions, null
    elements counted, -1 below the node's own level) and, with ``payload``, one struct ``at_<level>_<n>`` per node kind. With
    ``ancestors``, ``ancestor_1 ..`` are the pre-order numbers of the nodes of higher levels whose intervals hold the node, else null.

    Null records (a null array), null elements and empty arrays give no node; what lies below a null element does not exist.
    Positions still count null elements. Records that occur twice give their nodes twice. A column of ``keep`` that bears the name of a
    node column comes out as ``kept_<name>``.
    """
    root = node_kinds(column, df.schema[column].dataType)
    depth = max(k.level for k in root.walk())
    node_type = _node_type(root, depth, payload, ancestors)
    made = ["node_kind", "node_level", "node_pre", "node_post", "node_last"] + [f"idx_{k}" for k in range(1, depth + 1)]
    made += [f.name for f in node_type.fields if f.name.startswith("at_")] + [f"ancestor_{k}" for k in range(1, depth)]
    carried = [F.col(f"`{k}`").alias(n) for k, n in kept(keep, {*made, "__pos", "__node"}).items()]
    nodes = _traverse(F.col(f"`{column}`"), root, root, depth, payload, ancestors, node_type, [])
    flat = df.select(*carried, F.posexplode(nodes).alias("__pos", "__node"))
    pre = F.col("__pos") + 1
    n = F.col("__node")
    out = [
        n["kind"].alias("node_kind"), n["level"].alias("node_level"), pre.alias("node_pre"),
        (pre + n["descendants"] - n["level"]).alias("node_post"), (pre + n["descendants"]).alias("node_last"),
    ]
    out += [n[f"i{k}"].alias(f"idx_{k}") for k in range(1, depth + 1)]
    if payload:
        out += [n[f.name].alias(f.name) for f in node_type.fields if f.name.startswith("at_")]
    if ancestors:
        out += [(pre - n[f"up_{k}"]).alias(f"ancestor_{k}") for k in range(1, depth)]
    return flat.select(*[c for c in flat.columns if c not in ("__pos", "__node")], *out)


def node_tables(df: DataFrame, column: str, keep: list[str]) -> dict[str, DataFrame]:
    """One flat table per node kind: ``keep``, the interval labels, the positions and the kind's own scalar fields.

    Fields whose name already occurs among the columns before them get the prefix ``<last part of the kind>_``.
    """
    root = node_kinds(column, df.schema[column].dataType)
    nodes = interval_nodes(df, column, keep)
    carried = nodes.columns[: len(keep)]
    tables = {}
    for n, kind in enumerate(root.walk()):
        own = nodes.where(F.col("node_kind") == kind.name)
        base = [*carried, "node_level", "node_pre", "node_post", "node_last", *[f"idx_{k}" for k in range(1, kind.level + 1)]]
        cols = [F.col(f"`{c}`") for c in base]
        for f in kind.scalars:
            name = f.name if f.name not in base else f"{kind.path[-1]}_{f.name}"
            cols.append(F.col(f"at_{kind.level}_{n}")[f.name].alias(name))
        tables[kind.name] = own.select(*cols)
    return tables


def contained(nodes: DataFrame, *record: str) -> DataFrame:
    """(``record``, ``ancestor_pre``, ``ancestor_level``, ``node_pre``, ``node_level``): a row for every node and node whose interval holds it.

    ``nodes``: result of ``interval_nodes`` with ``ancestors``. A node has one ancestor a level, so the rows are as many as the nodes times
    their levels, and come out where the nodes are.
    """
    levels = [c for c in nodes.columns if c.startswith("ancestor_")]
    held = F.array(*[F.struct(F.col(c).alias("pre"), F.lit(int(c.removeprefix("ancestor_"))).alias("level")) for c in levels])
    each = nodes.select(*[F.col(f"`{c}`") for c in record], F.explode(F.filter(held, lambda a: a["pre"].isNotNull())).alias("a"), "node_pre", "node_level")
    return each.select(*[F.col(f"`{c}`") for c in record], F.col("a.pre").alias("ancestor_pre"), F.col("a.level").alias("ancestor_level"), "node_pre", "node_level")


def parents(nodes: DataFrame, *record: str) -> DataFrame:
    """Those pairs of ``contained`` that are parent and child (adjacent levels)."""
    return contained(nodes, *record).where(F.col("node_level") == F.col("ancestor_level") + 1)
