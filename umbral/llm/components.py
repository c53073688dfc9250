"""Connected components of a table of links by contraction.

Every task links the nodes of its own rows and keeps one star for each component that it sees. A star's members, and its
centre too, are then sent to the task that holds the member's key: no node gets more rows than there were tasks, however
many links it has. That task links the centres which its nodes got. Left over are links between centres, a smaller
graph that is contracted the same way, until one bounded task can end it; the maps from nodes to centres are then
followed back. Centres are chosen by a hash that changes with every turn, so that chains shrink by a constant part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links gathered before they are reduced to stars.
GATHER = 1 << 19


def _stars(u: pa.Array, v: pa.Array, turn: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct nodes, and the position of the centre of each."""
    nodes = pc.unique(pa.chunked_array([u, v]).combine_chunks())
    names = nodes.to_pandas().astype(str).to_numpy(object)
    order = np.argsort(pd.util.hash_array(names, hash_key=f"{turn:016d}", categorize=False), kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    a, b = (place[pc.index_in(x, nodes).to_numpy(zero_copy_only=False)] for x in (u, v))
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, order[label[place]]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not ((jump := label[label]) == label).all():
            label = jump


def _gathered(batches, turn: int):
    """Rows u, v of a task, reduced to stars whenever there are many."""
    held, n, most = [], 0, GATHER
    for b in batches:
        held.append(b.select(["u", "v"]))
        n += b.num_rows
        if n > most:
            u, v = (pa.chunked_array([x.column(i) for x in held]).combine_chunks() for i in (0, 1))
            nodes, centre = _stars(u, v, turn)
            held, n = [pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(centre))], names=["u", "v"])], len(nodes)
            most = max(GATHER, 2 * n)
    if n:
        yield tuple(pa.chunked_array([x.column(i) for x in held]).combine_chunks() for i in (0, 1))


def _own(turn: int):
    """A row for each node of a task's rows: the node and its centre."""

    def run(batches):
        for u, v in _gathered(batches, turn):
            nodes, centre = _stars(u, v, turn)
            yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(centre))], names=["u", "v"])

    return run


def _met(turn: int):
    """Of the rows of a task's keys u: each key's centre (left false), and links between centres (left true)."""

    def run(batches):
        keys, centres, rows = [], [], []
        for b in batches:
            keys.append(b.column(0))
            centres.append(b.column(1))
        if not keys:
            return
        u, v = pa.chunked_array(keys).combine_chunks(), pa.chunked_array(centres).combine_chunks()
        nodes, centre = _stars(u, v, turn)
        for x, left in ((pc.unique(u), False), (pc.unique(v), True)):
            at = pc.index_in(x, nodes).to_numpy(zero_copy_only=False)
            keep = centre[at] != at if left else np.ones(len(at), bool)
            rows.append((nodes.take(pa.array(at[keep])), nodes.take(pa.array(centre[at[keep]])), pa.array(np.full(int(keep.sum()), left))))
        for r in rows:
            yield pa.RecordBatch.from_arrays(list(r), names=["u", "v", "left"])

    return run


def components(edges: DataFrame, few: int = 1 << 18) -> DataFrame:
    """edges: u, v of one type. Returns node, label: for every node that has a link, one node of its component, the same for all.

    A graph of up to `few` links, a bound for one task, is ended in a task; beyond it contraction goes on. Links may
    repeat or lead back to their node; empty links give an empty table.
    """
    kind = edges.schema["u"].dataType.simpleString()
    edges = cut(edges.select("u", "v").where("u <> v"), "links")
    maps, turn = [], 0
    while edges.count() > few:
        met = edges.mapInArrow(_own(turn), f"u {kind}, v {kind}").repartition("u").mapInArrow(_met(turn), f"u {kind}, v {kind}, left boolean")
        met = cut(met, "links")
        maps.append(met.where("not left").select(F.col("u").alias("node"), F.col("v").alias("label")))
        edges, turn = met.where("left").select("u", "v"), turn + 1
    labels = edges.coalesce(1).mapInArrow(_own(turn), f"u {kind}, v {kind}").select(F.col("u").alias("node"), F.col("v").alias("label"))
    for m in reversed(maps):
        onward = cut(labels.select(F.col("node").alias("label"), F.col("label").alias("last")), "onward")
        labels = m.join(onward, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return cut(labels, "labels")
