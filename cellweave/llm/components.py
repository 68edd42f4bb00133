"""Connected components of a graph of links, by least labels and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's group, under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def least_labels(nodes: DataFrame, links: DataFrame, space: Workspace) -> DataFrame:
    """nodes (node, label): unique nodes and the label each brings; links (a, b) in both directions. Returns (node,
    label), label being the least of a node's component. A round takes the least label of the neighbours, then that of
    the node which brought it; sums are per key with partial aggregation, and joins are plain ones that adaptive
    execution splits where a key is hot. Each round is a table in the shared folder; rounds go on until no label changes,
    about as often as the logarithm of the longest path."""
    owner = nodes.select("node", F.col("label").alias("of"))
    now = nodes
    for k in count():
        near = links.join(now.select(F.col("node").alias("b"), F.col("label").alias("got")), "b").groupBy(F.col("a").alias("node")).agg(F.min("got").alias("got"))
        step = now.join(near, "node", "left").select("node", F.least("label", "got").alias("label"), F.col("label").alias("old"))
        # A label names the node that brought it; that node's own label may be less by now.
        of = owner.join(step.select("node", F.col("label").alias("next")), "node").select(F.col("of").alias("label"), "next")
        step = step.join(of.groupBy("label").agg(F.min("next").alias("next")), "label", "left").select("node", F.least("label", "next").alias("label"), "old")
        saved = space.save(step, f"labels{k}")
        changed = saved.filter(F.col("label") < F.col("old")).limit(1).count()
        now = saved.select("node", "label")
        if k:
            space.remove(f"labels{k - 1}")
        if not changed:
            return now
