"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import forget, join_hot, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the (a, b) links.

    Every round takes the least label of a node's neighbours and then its label's label, so
    rounds grow with the logarithm of a path's length. Each round is a written table, and the
    one before it goes. Hubs and the label of a giant component are hot keys; join_hot splits
    them. Null ends and links of a node with itself take no part; no links give no rows.
    """
    links = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    links = keep(links.union(links.select("b", "a")).distinct())
    labels = keep(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        heard = join_hot(links, labels.select(F.col("node").alias("from"), "component"), "a", "from").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        near = keep(labels.join(heard, "node").select("node", F.least("component", "heard").alias("near"), F.col("component").alias("old")))
        up = near.select(F.col("node").alias("_n"), F.col("near").alias("_up"))
        after = keep(join_hot(near, up, "near", "_n", "left").select("node", F.least("near", F.coalesce("_up", "near")).alias("component"), "old"))
        forget(labels, near)
        labels = after
        if after.where("component <> old").limit(1).count() == 0:
            forget(links)
            return after.select("node", "component")


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the local sets (labels: the smallest member, flat) of each pair a[i], b[i]."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            flat = labels[labels]
            if np.array_equal(flat, labels):
                break
            labels = flat


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of each pair a[i], b[i] in ``labels``, in place; the indexes of the pairs that joined two sets, a tree for each."""
    index, used = np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return np.concatenate(used)
        a, b, index, x, y = a[apart], b[apart], index[apart], x[apart], y[apart]
        # Every set but the smallest of those that meet hangs itself below one that is smaller.
        upper, first = np.unique(np.maximum(x, y), return_index=True)
        labels[upper] = np.minimum(x, y)[first]
        used.append(index[first])
        while not np.array_equal(flat := labels[labels], labels):
            labels[:] = flat
