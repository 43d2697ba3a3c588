"""Models: folds and latent text vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import network
from .scoring import folds
from .shared import kept
from .stats import fisher_greater
from .vectors import as_ml


def fisher_udf():
    """A vectorised one-sided exact test of (shared, size a, size b, background)."""

    @F.pandas_udf("double")
    def p(shared: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        if not len(shared):
            return pd.Series([], dtype=float)
        rows = np.stack([shared, a, b, n]).astype(np.int64)
        _, first, of = np.unique(np.ravel_multi_index(tuple(rows), tuple(rows.max(1) + 1)), return_index=True, return_inverse=True)
        return pd.Series(np.array([fisher_greater(s, x - s, y - s, m - x - y + s) for s, x, y, m in rows[:, first].T.tolist()])[of])

    return p


TREES = 10


def _redrawn(x: Column, n: Column, seed: int) -> Column:
    """How often each point is drawn for a tree: the sum of n draws by Poisson's law of mean 1, one for each row, is a draw of mean n."""

    @F.pandas_udf("double")
    def draws(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(poisson(key.to_numpy().view(np.uint64), n.to_numpy()))

    return draws(F.xxhash64(x, F.lit(seed)), n)


def poisson(keys: np.ndarray, means: np.ndarray) -> np.ndarray:
    """A draw for each key (64 random bits), which decides it: by the inverse of the distribution for small means, by a generator of its own for others."""
    out, u = np.zeros(len(keys)), (keys >> np.uint64(11)) * 2.0**-53
    for mean in np.unique(means[means <= 64]).tolist():
        own, j = means == mean, np.arange(1, int(mean + 12 * mean**0.5 + 20))
        out[own] = np.searchsorted((np.exp(-mean) * np.concatenate([[1.0], np.cumprod(mean / j)])).cumsum(), u[own], "right")
    for i in np.flatnonzero(means > 64).tolist():
        out[i] = np.random.default_rng(int(keys[i])).poisson(means[i])
    return out


def out_of_fold(df: DataFrame, group: str, features: str, target: str, k: int, kinds: Sequence[str]) -> DataFrame:
    """df with model and prediction: each row is predicted by models that saw none of its group. A key of the rows as the group gives plain folds.

    Kinds are linear, forest, boosted and network (a multilayer perceptron). Models are trained on ``network.points``, rows of equal features as one that
    counts as often: their squared errors differ from those of their mean by what no model can change. A forest still draws row by row. df is read twice.
    """
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    folded = df.withColumn("_fold", folds(F.col(group), k))
    rows = network.points(folded, features, target, "_fold")
    held, parts = as_ml(rows, "x", "_f"), []
    learned = {"labelCol": "y", "featuresCol": "_f"}
    if "network" in kinds:
        held = held.withColumn("_network", network.fitted(rows, k)("x", "fold"))
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    for i in range(k):
        rest, own = held.drop("_network").where(F.col("fold") != i), held.where(F.col("fold") == i)
        for kind in kinds:
            if kind == "linear":  # Spark divides the parameter by the deviation of the labels: here those of the points, not of the rows
                m = rest.agg(mean(F.col("q")).alias("q"), mean(F.col("y")).alias("y"), mean(F.col("y") * F.col("y")).alias("p")).first()
                narrow = ((m.p - m.y**2) / (m.q - m.y**2)) ** 0.5 if m.y is not None and m.q > m.y**2 and m.p > m.y**2 else 1.0
                own = LinearRegression(regParam=0.01 * min(narrow, 1.0), weightCol="n", predictionCol="_linear", **learned).fit(rest).transform(own)
            elif kind == "forest":
                names = [f"_tree{t}" for t in range(TREES)]
                for t, name in enumerate(names):
                    drawn = kept(rest.withColumn("n", _redrawn(F.struct("fold", "x"), F.col("n"), 7 + t)).where("n > 0"))
                    tree = RandomForestRegressor(numTrees=1, maxDepth=4, seed=7 + t, featureSubsetStrategy="onethird", bootstrap=False, weightCol="n", predictionCol=name, **learned)
                    own = tree.fit(drawn).transform(own)
                own = own.withColumn("_forest", reduce(Column.__add__, map(F.col, names)) / len(names)).drop(*names)
            elif kind == "boosted":
                own = GBTRegressor(maxIter=10, maxDepth=4, seed=7, weightCol="n", predictionCol="_boosted", **learned).fit(rest).transform(own)
        parts.append(own.select("fold", "x", F.array(*(F.struct(F.lit(kind).alias("model"), F.col(f"_{kind}").alias("prediction")) for kind in kinds)).alias("_p")))
    predicted = reduce(DataFrame.unionByName, parts).withColumnsRenamed({"fold": "_fold", "x": "_x"})
    out = folded.join(predicted, (folded["_fold"] == predicted["_fold"]) & (folded[features] == predicted["_x"]))
    return out.select(*(folded[c] for c in df.columns), F.explode("_p").alias("_p")).select(*df.columns, "_p.prediction", "_p.model")


def _grams(column: str, n: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(column) - (n - 1), F.lit(1)))
    return F.transform(places, lambda i: F.substring(column, i, F.lit(n)))


def char_latent(df: DataFrame, column: str, vocabulary: int, size: int) -> DataFrame:
    """df with latent: TF-IDF of 2- to 4-grams of characters, reduced by a distributed SVD."""
    from pyspark.ml.feature import IDF, CountVectorizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    grams: Column = F.flatten(F.array(*(_grams(column, n) for n in (2, 3, 4))))
    counted = CountVectorizer(inputCol="_g", outputCol="_c", vocabSize=vocabulary).fit(held := df.withColumn("_g", grams)).transform(held)
    weighed = IDF(inputCol="_c", outputCol="_w").fit(counted).transform(counted)
    rows = MLUtils.convertVectorColumnsFromML(weighed.select("_w"), "_w")
    v = RowMatrix(rows).computeSVD(size).V.toArray()
    space = df.sparkSession.sparkContext.broadcast(v.astype(np.float64))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_list()) @ space.value
        return pd.Series(list(m))

    return weighed.withColumn("latent", project(vector_to_array("_w"))).drop("_g", "_c", "_w")
