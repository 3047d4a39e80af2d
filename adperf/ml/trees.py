"""Fitted tree ensembles as node tables: cutting small nodes, and exact attributions.

``min_split`` (M5, M8) turns nodes with too few rows into leaves.  It rewrites the node
table that a saved model consists of and loads it again, so the result is an
ordinary Spark model.

``tree_shap`` (X2, X3) gives exact Shapley values of the ensemble for every row, where a
feature that is not in a coalition is averaged over the training rows at each
node (path-dependent expectations).  A leaf's share of a feature's value is

    v (o_i - z_i) * integral over t in (0, 1) of prod over j <> i of (z_j (1 - t) + o_j t)

with o_j = 1 where the row meets all of the path's conditions on feature j and z_j
the product of the training shares along them; the integral stands for the weights of
all coalitions.  It is a polynomial below the path's number of features, so Gauss-Legendre
points of half that number make it exact.  Subtree sums are passed up, so a tree costs its nodes
times the points for each row.  Rows are explained in blocks where they lie; the node arrays
are broadcast in parts of bounded size, and the parts' values are added.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adperf.ml.encode import slot_names
from adperf.ml.linear import dense, non_zeros
from adperf.session import ensure_checkpoint_dir

#: Nodes of one broadcast, about 100 bytes each.
MOST_NODES = 500_000
LEAF = {"gain": -1.0, "leftChild": -1, "rightChild": -1, "split": (-1, [], -1)}


def _saved(model, spark: SparkSession) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/adperf-models/{uuid.uuid4().hex}"
    model.write().save(path)
    return path


def node_table(model, spark: SparkSession) -> DataFrame:
    """(treeID, nodeData) of a fitted ensemble, as Spark saves it."""
    return spark.read.parquet(f"{_saved(model, spark)}/data")


def cut_small(nodes: dict[int, dict], least: int) -> list[dict]:
    """Nodes of one tree, numbered anew in pre-order, where no inner node has under ``least`` rows."""
    out: list[dict] = []
    stack = [(0, None, "")]
    while stack:
        at, parent, side = stack.pop()
        node = dict(nodes[at])
        if parent is not None:
            out[parent][side] = len(out)
        inner = node["leftChild"] >= 0 and node["rawCount"] >= least
        children = (node["leftChild"], node["rightChild"])
        node.update(id=len(out))
        if not inner:
            node.update(LEAF)
        out.append(node)
        if inner:
            stack += [(children[1], node["id"], "rightChild"), (children[0], node["id"], "leftChild")]
    return out


def add_nodes(like: tuple[type, str], new: str, nodes: list[tuple], spark: SparkSession) -> None:
    """Store rows of the node table of the model that will be at ``new``."""
    spark.createDataFrame(nodes, spark.read.parquet(f"{like[1]}/data").schema).write.mode("append").parquet(f"{new}/data")


def load_with(like: tuple[type, str], nodes: list[tuple], spark: SparkSession):
    """The model that was saved as (class, path), with other rows of its node table."""
    new = f"{like[1]}-{uuid.uuid4().hex}"
    add_nodes(like, new, nodes, spark)
    return load_at(like, new, spark)


def load_at(like: tuple[type, str], new: str, spark: SparkSession):
    """The model that was saved as (class, path), with the node table that is at ``new``."""
    kind, path = like
    spark.read.parquet(f"{path}/treesMetadata").write.parquet(f"{new}/treesMetadata")
    spark.read.text(f"{path}/metadata").coalesce(1).write.text(f"{new}/metadata")
    return kind.load(new)


def min_split(model, least: int, spark: SparkSession):
    """The ensemble with every node under ``least`` rows made a leaf (its own prediction stays); the model itself if none is.

    Growing stops at such a node in the same way: what is below a node has no
    influence on what is above it, or on other trees of a forest.
    """
    if least <= 2:
        return model
    path = _saved(model, spark)
    table = spark.read.parquet(f"{path}/data")
    small = (F.col("nodeData.leftChild") >= 0) & (F.col("nodeData.rawCount") < least)
    if table.where(small).isEmpty():
        return model
    trees: dict[int, dict[int, dict]] = {}
    for r in table.collect():  # as many rows as the model has nodes
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData.asDict()
    rows = [(t, tuple(n[c] for c in table.schema["nodeData"].dataType.names)) for t, nodes in sorted(trees.items()) for n in cut_small(nodes, least)]
    return load_with((type(model), path), rows, spark)


@dataclass
class Tree:
    """One tree as arrays by node; ``left_values`` of a split by categories, else a threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left_values: list[list[float] | None]
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def depth(self) -> int:
        deep = np.zeros(len(self.left), int)
        for k in range(len(self.left)):  # parents come before their children
            for c in (self.left[k], self.right[k]):
                if c >= 0:
                    deep[c] = deep[k] + 1
        return int(deep.max(initial=0))


def trees_of(model, spark: SparkSession) -> list[Tree]:
    """The trees with their weights in the explained output.

    A classifier forest: probability of class 1.  Boosted classifiers: log-odds of class 1.
    Regressors: the prediction.
    """
    rows = node_table(model, spark).collect()  # as many rows as the model has nodes
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.treeID, []).append(r.nodeData)
    boosted = "GBT" in type(model).__name__
    forest = not boosted and "Classification" in type(model).__name__
    weights = list(model.treeWeights)
    scale = (2.0 if isinstance(model, GBTClassificationModel) else 1.0) if boosted else 1.0 / sum(weights)
    out = []
    for t, nodes in sorted(by.items()):
        nodes.sort(key=lambda n: n.id)
        stats = [np.array(n.impurityStats) for n in nodes]
        value = [s[1] / s.sum() for s in stats] if forest else [n.prediction for n in nodes]
        cover = [s.sum() for s in stats] if forest else [s[0] for s in stats]
        split = [n.split for n in nodes]
        out.append(Tree(
            np.array([s.featureIndex for s in split]), np.array([s.leftCategoriesOrThreshold[0] if s.numCategories == -1 and s.leftCategoriesOrThreshold else 0.0 for s in split]),
            [list(s.leftCategoriesOrThreshold) if s.numCategories > 0 else None for s in split],
            np.array([n.leftChild for n in nodes]), np.array([n.rightChild for n in nodes]), np.array(cover, float), np.array(value) * weights[t] * scale,
        ))
    return out


def add_shap(tree: Tree, x: np.ndarray, phi: np.ndarray) -> None:
    """Add the tree's exact attributions of the rows x to phi (rows x slots)."""
    points, weights = np.polynomial.legendre.leggauss(max(1, (tree.depth() + 1) // 2))
    t, weights = (points + 1) / 2, weights / 2
    held: dict[int, tuple[np.ndarray, float]] = {}

    def factors(met: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """z (1 - t) + o t, and (o - z) over it, by row and point."""
        f = np.stack([share * (1 - t), share * (1 - t) + t])
        g = np.array([[-share], [1 - share]]) / f
        at = met.astype(np.int8)
        return f[at], g[at]

    def visit(node: int, p: np.ndarray) -> np.ndarray:
        if tree.left[node] < 0:
            return p * tree.value[node]
        f = int(tree.feature[node])
        values = tree.left_values[node]
        goes = x[:, f] <= tree.threshold[node] if values is None else np.isin(x[:, f], values)
        before = held.get(f)
        total = np.zeros_like(p)
        if before is not None:
            f_old, g_old = factors(*before)
            p = p / f_old
        for child, met in ((int(tree.left[node]), goes), (int(tree.right[node]), ~goes)):
            share = tree.cover[child] / tree.cover[node]
            now = (met, share) if before is None else (before[0] & met, before[1] * share)
            held[f] = now
            f_new, g_new = factors(*now)
            below = visit(child, p * f_new)
            # leaves below count the feature as it is here, no longer as it was above
            phi[:, f] += ((g_new if before is None else g_new - g_old) * below) @ weights
            total += below
        if before is None:
            del held[f]
        else:
            held[f] = before
        return total

    visit(0, np.ones((len(x), len(t))))


def base_value(trees: list[Tree]) -> float:
    """The ensemble's expectation without any feature."""
    total = 0.0
    for tree in trees:
        reach = np.ones(len(tree.left))
        for k in range(len(tree.left)):
            if tree.left[k] >= 0:
                for c in (tree.left[k], tree.right[k]):
                    reach[c] = reach[k] * tree.cover[c] / tree.cover[k]
            else:
                total += reach[k] * tree.value[k]
    return total


def unique_ids(rows: DataFrame) -> DataFrame:
    """``row_id`` of the first row that has it stays, its n-th repetition gets ``#n`` appended."""
    n = F.row_number().over(Window.partitionBy("row_id").orderBy("row_id"))
    return rows.withColumn("_n", n).withColumn("row_id", F.when(F.col("_n") == 1, F.col("row_id")).otherwise(F.concat("row_id", F.lit("#"), F.col("_n")))).drop("_n")


def tree_shap(model: PipelineModel, rows: DataFrame, slots: bool = False, most_nodes: int = MOST_NODES) -> DataFrame:
    """(row_id, feature, shap, feature_value) of every row, exactly.

    ``rows`` have a row_id and the raw columns.  The values of the one-hot slots
    of a column are added up, or stay apart with ``slots``.  Per row they sum to the
    output less :func:`base_value`.  feature_value is the raw number, NULL for a category, or
    the encoded number of a slot.
    """
    spark = rows.sparkSession
    names = slot_names(model)
    trees = trees_of(model.stages[-1], spark)
    parts, size = [[]], 0
    for tree in trees:
        if size and size + len(tree.left) > most_nodes:
            parts.append([])
            size = 0
        parts[-1].append(tree)
        size += len(tree.left)
    columns = list(dict.fromkeys(raw for _, raw in names))
    features = [s for s, _ in names] if slots else columns
    # slot -> place of its feature
    place = np.arange(len(names)) if slots else np.array([columns.index(raw) for _, raw in names])
    numeric = {c for s, c in names if s == c}
    encoded = PipelineModel(model.stages[:-1]).transform(unique_ids(rows))
    at, values = non_zeros()
    raw = F.array(*[F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double") for c in columns])
    data = encoded.select("row_id", at.alias("at"), values.alias("x"), raw.alias("raw"))
    out = None
    for part in parts:
        held = spark.sparkContext.broadcast([vars(tree) for tree in part])

        def run(batches, held=held):
            mine = [Tree(**arrays) for arrays in held.value]
            for b in batches:
                for rows_of, x in dense(b, len(names)):
                    phi = np.zeros(x.shape)
                    for tree in mine:
                        add_shap(tree, x, phi)
                    if slots:
                        sums, value = phi, pa.array(x.reshape(-1))
                    else:
                        sums = np.zeros((len(x), len(features)))
                        np.add.at(sums.T, place, phi.T)
                        value = b.column("raw").slice(rows_of.start, len(x)).flatten()
                    ids = b.column("row_id").slice(rows_of.start, len(x))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.repeat(np.arange(len(x)), len(features)))), pa.array(features * len(x)), pa.array(sums.reshape(-1)), value],
                        names=["row_id", "feature", "shap", "feature_value"],
                    )

        more = data.mapInArrow(run, "row_id string, feature string, shap double, feature_value double")
        out = more if out is None else out.unionByName(more)
    if len(parts) > 1:
        out = out.groupBy("row_id", "feature").agg(F.sum("shap").alias("shap"), F.first("feature_value").alias("feature_value"))
    return out
