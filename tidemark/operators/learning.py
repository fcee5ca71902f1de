"""Learned operators: destination classes, arrival times, anomaly scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Percentiles of all rows have a rank error of at most 1 / RANKS.
RANKS = 100_000


def frequent_classes(rows: DataFrame, label: str, most: int = 80, least: tuple[int, ...] = (100, 50, 20, 5, 1)) -> DataFrame:
    """(label, n): the most frequent classes under the first threshold that leaves two or more."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(most)
    small = counts.collect()  # at most `most` rows
    floor = next((t for t in least if sum(r["n"] >= t for r in small) >= 2), 1)
    return counts.filter(F.col("n") >= floor)


def fit_destination(rows: DataFrame, label: str, numeric: list[str], text: list[str], trees: int = 20, depth: int = 5) -> PipelineModel:
    """Random forest with median imputation, indexed text and inverse class frequencies as weights."""
    keep = frequent_classes(rows, label)
    own = rows.join(F.broadcast(keep), label)  # bounded by frequent_classes
    own = own.withColumn("_weight", 1.0 / F.col("n"))
    stages = [
        Imputer(strategy="median", inputCols=numeric, outputCols=[f"_{c}" for c in numeric]),
        StringIndexer(inputCols=text, outputCols=[f"_{c}" for c in text], handleInvalid="keep"),
        StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep"),
        VectorAssembler(inputCols=[f"_{c}" for c in [*numeric, *text]], outputCol="_features"),
        RandomForestClassifier(labelCol="_label", featuresCol="_features", weightCol="_weight", numTrees=trees, maxDepth=depth, maxBins=512, seed=7),
    ]
    return Pipeline(stages=stages if text else [s for k, s in enumerate(stages) if k != 1]).fit(own)


def top_classes(model: PipelineModel, rows: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """(key, rank, label, probability) of each row's k likeliest classes."""
    labels = next(s for s in model.stages if s.hasParam("outputCol") and s.isSet("outputCol") and s.getOutputCol() == "_label").labels
    scored = model.transform(rows).select(
        key, F.posexplode(vector_to_array("probability")).alias("_i", "probability"),
    ).filter(F.col("_i") < len(labels))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("probability"), "_i"))
    names = F.array(*map(F.lit, labels))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "rank", F.get(names, F.col("_i")).alias(label), "probability")


def fit_eta(rows: DataFrame, target: str, numeric: list[str], iterations: int = 20) -> PipelineModel:
    """Boosted trees on labels in (0, 14 days] of minutes."""
    own = rows.filter((F.col(target) > 0) & (F.col(target) <= 14 * 1440))
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=numeric, outputCols=[f"_{c}" for c in numeric]),
        VectorAssembler(inputCols=[f"_{c}" for c in numeric], outputCol="_features"),
        GBTRegressor(labelCol=target, featuresCol="_features", maxIter=iterations, maxDepth=4, seed=7),
    ]).fit(own)


def eta_errors(model: PipelineModel, rows: DataFrame, target: str) -> DataFrame:
    """MAE, RMSE and median absolute error."""
    err = F.col("prediction") - F.col(target)
    return model.transform(rows).agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.median(F.abs(err)).alias("medae"))


class IsolationForest:
    """Isolation trees; arrays of a bounded size travel to the tasks."""

    def __init__(self, trees: int = 200, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _scaled(self, n: int, median: np.ndarray, center: np.ndarray, scale: np.ndarray) -> int:
        """Keep what rows are filled and scaled by, and the bounds of trees over a draw from n rows; the draw's size."""
        self.median, self.center, self.scale = median, center, np.where(scale > 0, scale, 1)
        size = min(self.sample, n)
        self.limit, self.usual = int(np.ceil(np.log2(max(size, 2)))), _path(np.array([float(size)]))[0]
        return size

    def _plain(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.median, x) - self.center) / self.scale

    def fit(self, x: np.ndarray, median: np.ndarray, center: np.ndarray, scale: np.ndarray) -> IsolationForest:
        """x is filled by `median` and scaled by the mean and deviation of all filled rows."""
        rng = np.random.default_rng(self.seed)
        n = self._scaled(len(x), median, center, scale)
        x = self._plain(x)
        self.nodes = [_grown(x[rng.choice(len(x), n, replace=False)], self.limit, rng) for _ in range(self.trees)]
        return self

    def fit_drawn(self, rows: DataFrame, key: str, features: list[str], n: int, median: np.ndarray, center: np.ndarray, scale: np.ndarray) -> IsolationForest:
        """A forest of draws() from n rows: trees grow in parallel tasks, and only they come back."""
        self._scaled(n, median, center, scale)

        def grow(table: pa.Table) -> pa.Table:
            table = table.sort_by([("draw", "ascending"), ("copy", "ascending")]).slice(0, self.sample)
            tree = table.column("tree")[0].as_py()
            x = np.column_stack([table.column(f"f{i}").to_numpy().astype(float) for i in range(len(features))])
            parts = _grown(self._plain(x), self.limit, np.random.default_rng([self.seed, tree]))
            return pa.table({"tree": pa.array([tree], pa.int32()), **{name: pa.array([part.tolist()], pa.list_(pa.float64())) for name, part in zip(("feature", "cut", "depth"), parts, strict=True)}})

        drawn = draws(rows, key, features, n, self.trees, self.sample)
        grown = drawn.groupBy("tree").applyInArrow(grow, "tree int, feature array<double>, cut array<double>, depth array<double>").collect()  # a row a tree
        self.nodes = [(np.array(r["feature"], int), np.array(r["cut"]), np.array(r["depth"])) for r in sorted(grown, key=lambda r: r["tree"])]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score: the lower, the more unusual."""
        x = self._plain(x)
        total = np.zeros(len(x))
        for feature, cut, depth in self.nodes:
            at = np.ones(len(x), int)
            for _ in range(self.limit):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, 2 * at + (x[np.arange(len(x)), np.maximum(f, 0)] >= cut[at]), at)
            total += depth[at]
        return -np.power(2.0, -total / len(self.nodes) / max(self.usual, 1e-9))


def _grown(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as arrays by node, the root at 1 and children of i at 2i and 2i + 1: feature (-1 in leaves), cut, path length."""
    size = 2 ** (limit + 1)
    feature, cut, depth = np.full(size, -1), np.zeros(size), np.zeros(size)
    todo = [(1, x, 0)]
    while todo:
        at, rows, level = todo.pop()
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
        if level >= limit or len(rows) <= 1 or not (spread > 0).any():
            depth[at] = level + _path(np.array([float(len(rows))]))[0]
            continue
        f = rng.choice(np.flatnonzero(spread > 0))
        c = rng.uniform(rows[:, f].min(), rows[:, f].max())
        feature[at], cut[at] = f, c
        todo += [(2 * at, rows[rows[:, f] < c], level + 1), (2 * at + 1, rows[rows[:, f] >= c], level + 1)]
    return feature, cut, depth


def draws(rows: DataFrame, key: str, features: list[str], n: int, trees: int, size: int) -> DataFrame:
    """(tree, draw, copy, f0, ...): for each tree about 2 * size of the n rows (all, of fewer), of which the `size` first by draw and copy are its own.

    Rows are drawn by hashes of the whole row. One hash for each row leaves a pool of about 2 * size * trees rows; in it each
    tree has a hash of its own, so trees are drawn alike and rows may be in several. A tree short of rows is a chance below
    1e-30. Equal rows are one draw with copies, and counted before they are moved.
    """
    uniform = lambda *c: F.xxhash64(*c).bitwiseAND(2**53 - 1) / F.lit(float(2**53))
    pool = min(1.0, 2.0 * size * trees / max(n, 1))
    each = min(1.0, 2.0 * size / max(n, 1) / pool)
    row = [F.col(key), *[F.col(c) for c in features]]
    own = rows.filter(uniform(F.lit(-1), *row) < pool).groupBy(key, *features).agg(F.least(F.count("*"), F.lit(size)).cast("int").alias("_copies"))
    tree = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("draw", uniform(F.col("tree"), *row)).filter(F.col("draw") < each)
    return tree.select("tree", "draw", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(features)])


def _path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n."""
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def anomaly_scores(rows: DataFrame, key: str, features: list[str], trees: int = 200, sample: int = 256) -> DataFrame:
    """(key, raw_score, score): isolation scores of all rows, brought to 0 at the median and 1 at the 1 % quantile.

    Medians, scales and quantiles are of all rows (percentiles to a rank error of RANKS), and each tree's rows are drawn from
    all. A table without rows has no scores.
    """
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    columns = [number(c).alias(c) for c in features]
    own = rows.select(F.col(key).cast("long"), *columns)
    n, *median = own.agg(F.count("*"), *[F.percentile_approx(c, 0.5, RANKS) for c in features]).first()
    median = [m or 0.0 for m in median]
    filled = own.fillna(dict(zip(features, median, strict=True)))
    spread = filled.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    center, scale = np.array([s or 0.0 for s in spread], float).reshape(2, -1)
    forest = IsolationForest(trees, sample)
    if n:
        forest.fit_drawn(own, key, features, n, np.array(median), center, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x))], names=[key, "raw_score"])

    scored = written(own.mapInArrow(run, f"{key} long, raw_score double"), "anomaly")
    low, mid = scored.agg(F.percentile_approx("raw_score", [0.01, 0.5], RANKS)).first()[0] or (0.0, 0.0)
    return scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mid - F.col("raw_score")) / (mid - low if mid > low else 1.0))))
