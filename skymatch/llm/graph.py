"""Connected components, in one task (arrays) and over a whole table (joins)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructType

from .common import materialise


def merge_labels(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after linking ``x[i]`` with ``y[i]``; a label is the smallest index of its component."""
    while len(x):
        a, b = labels[x], labels[y]
        differ = a != b
        if not differ.any():
            break
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        labels = parent[labels]
    return labels


def merge_forest(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after linking ``x[i]`` with ``y[i]``, and the positions ``i`` of links that form a forest joining the same."""
    open_, picked = np.arange(len(x)), [np.zeros(0, "i8")]
    while len(open_):
        a, b = labels[x[open_]], labels[y[open_]]
        differ = a != b
        open_, high, low = open_[differ], np.maximum(a, b)[differ], np.minimum(a, b)[differ]
        if not len(open_):
            break
        roots, first = np.unique(high, return_index=True)  # each root takes one link to a smaller one
        picked.append(open_[first])
        parent = np.arange(len(labels))
        parent[roots] = low[first]
        while not ((up := parent[parent]) == parent).all():
            parent = up
        labels = parent[labels]
    return labels, np.concatenate(picked)


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes ``(leaf, root)``, a row each, that join what the links ``x[i]`` to ``y[i]`` join: every node with the smallest of its component."""
    held, at = np.unique(np.concatenate([x, y]), axis=0, return_inverse=True)
    at = at.reshape(-1)
    labels = merge_labels(np.arange(len(held)), at[: len(x)], at[len(x) :])
    leaf = np.nonzero(labels != np.arange(len(held)))[0]
    return held[leaf], held[labels[leaf]]


#: Edges that a task contracts at once.
PART = 200_000


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``, with the smallest node as component.

    Tasks first contract ``part`` edges at a time to stars around their smallest
    nodes; edges that are no more than that are settled by it. The stars of many
    parts are united by the large-star and small-star steps in turn (Kiveris et
    al., 2014). Each is an aggregate with map-side combine and a join, so a hub of
    any degree is one row per task; nothing is gathered. Loops and repeated edges
    are allowed, edges with a null end are dropped, and no edges give no rows. The
    rounds go on until nothing changes; their number grows with the logarithm of the longest path.
    """
    now = materialise(edges.select("src", "dst").where(F.col("src") != F.col("dst")), "edges")
    rows, whole = now.count(), False
    if all(_numbers(f.dataType) for f in now.schema):
        now = materialise(_contracted(now, rows, part), "stars")
        whole = rows <= part
    if not whole:
        now = materialise(_directed(now), "edges")
        seen = _digest(now)
        while seen[0]:
            now = materialise(_small_star(_large_star(now)), "edges")
            was, seen = seen, _digest(now)
            if seen == was:
                break
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def _numbers(kind: DataType) -> bool:
    """Nodes that arrays can hold: longs, or structs of them."""
    return isinstance(kind, LongType) or isinstance(kind, StructType) and all(isinstance(f.dataType, LongType) for f in kind)


def _contracted(edges: DataFrame, rows: int, part: int) -> DataFrame:
    """Edges that join what ``edges`` join, as stars for each ``part`` of the ``rows``."""

    def numbers(column: pa.Array) -> np.ndarray:
        return np.stack([np.asarray(c) for c in (column.flatten() if pa.types.is_struct(column.type) else [column])], axis=1)

    def column(nodes: np.ndarray, kind: pa.DataType) -> pa.Array:
        parts = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in nodes.T]
        return pa.StructArray.from_arrays(parts, [kind.field(k).name for k in range(kind.num_fields)]) if pa.types.is_struct(kind) else parts[0]

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = (np.concatenate([numbers(b.column(k)) for b in held]) for k in range(2))
        return pa.RecordBatch.from_arrays([column(n, held[0].column(0).type) for n in stars(*ends)], ["src", "dst"])

    def run(batches):
        held, waiting = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, part):
                some = batch.slice(k, part)
                if held and waiting + some.num_rows > part:
                    yield star(held)
                    held, waiting = [], 0
                held.append(some)
                waiting += some.num_rows
        if held:
            yield star(held)

    kinds = dict(edges.dtypes)
    return edges.coalesce(max(1, -(-rows // part))).mapInArrow(run, f"src {kinds['src']}, dst {kinds['dst']}")


def _directed(edges: DataFrame) -> DataFrame:
    """From the larger to the smaller end, each once."""
    return edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return _directed(both.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return _directed(moved.unionByName(least.select("src", F.col("m").alias("dst"))))


def _digest(edges: DataFrame) -> tuple:
    """Row count and an order-free sum over the edges' hashes."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
