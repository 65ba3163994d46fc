"""Boosted trees for several classes with one joint softmax loss.

Each round fits one MLlib regression tree per class to the gradient of the loss, whose rows never leave
Spark; a leaf's value is the Newton step of its rows, from one aggregate per tree over its leaves. Margins
are an array column that each round writes anew, so that a round costs the same however many came before.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.sources.workspace import checkpointed


def softmax(margins: Column) -> Column:
    top = F.array_max(margins)
    raised = F.transform(margins, lambda m: F.exp(m - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


@dataclass
class SoftmaxModel:
    """Starting margins (log shares of the classes), and per round the trees with their leaves' values."""
    features: str
    start: list[float]
    rounds: list[list[tuple[DecisionTreeRegressionModel, dict[int, float]]]] = field(default_factory=list)

    def stepped(self, df: DataFrame, margins: str, trees) -> DataFrame:
        """``margins`` with the steps of one round's trees added."""
        kept = df.columns
        for k, (tree, _) in enumerate(trees):
            df = tree.setLeafCol(f"_leaf{k}").setPredictionCol(f"_tree{k}").transform(df)
        steps = [F.element_at(F.create_map(*[F.lit(v) for pair in leaves.items() for v in (float(pair[0]), float(pair[1]))]), F.col(f"_leaf{k}"))
                 for k, (_, leaves) in enumerate(trees)]
        added = F.zip_with(margins, F.array(*steps), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
        return df.withColumn(margins, added).select(*kept)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (one number per class, adding up to one) and ``prediction``."""
        out = df.withColumn("_margins", F.array(*[F.lit(v) for v in self.start]))
        for trees in self.rounds:
            out = self.stepped(out, "_margins", trees)
        out = out.withColumn("probability", softmax(F.col("_margins"))).drop("_margins")
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def softmax_boost(df: DataFrame, y: str, features: str = "features", rounds: int = 20, depth: int = 3, rate: float = 0.1,
                  seed: int = 7, parallelism: int = 4) -> SoftmaxModel:
    """Boost ``rounds`` times; labels are 0..k-1. Rows without label or features are left out.

    A round's trees fit the same probabilities. The Newton step of a leaf for class c is
    (k - 1) / k * sum(r) / sum(|r| (1 - |r|)) over the gradients r of its rows. Only leaves, at most
    2^depth of each tree, reach the driver.
    """
    data = df.select(F.col(y).cast("int").alias("_y"), features).dropna()
    shares = {r["_y"]: r["count"] for r in data.groupBy("_y").count().collect()}        # one row per class
    if len(shares) < 2 or set(shares) != set(range(len(shares))):
        raise ValueError(f"labels must be 0..k-1 with at least two classes, not {sorted(shares)}")
    k, total = len(shares), sum(shares.values())
    model = SoftmaxModel(features, [])
    model.start = [log(shares[c] / total) for c in range(k)]
    state = checkpointed(data.withColumn("_margins", F.array(*[F.lit(v) for v in model.start])))
    for n in range(rounds):
        probability = softmax(F.col("_margins"))
        gradients = state.withColumn("_p", probability).select("*", *[((F.col("_y") == c).cast("double") - F.get("_p", F.lit(c))).alias(f"_r{c}") for c in range(k)])
        gradients = checkpointed(gradients.drop("_p"))

        def fit(c: int, gradients=gradients, n=n):
            tree = DecisionTreeRegressor(featuresCol=features, labelCol=f"_r{c}", maxDepth=depth, seed=seed + n * k + c, leafCol="_leaf").fit(gradients)
            r = F.col(f"_r{c}")
            steps = tree.transform(gradients).groupBy("_leaf").agg(
                F.sum(r).alias("up"), F.sum(F.abs(r) * (1.0 - F.abs(r))).alias("down")).collect()
            return tree, {int(s["_leaf"]): rate * (k - 1) / k * s["up"] / s["down"] if s["down"] > 1e-12 else 0.0 for s in steps}

        with ThreadPool(min(k, parallelism)) as pool:        # the classes' trees don't wait for each other
            trees = pool.map(inheritable_thread_target(gradients.sparkSession)(fit), range(k))
        model.rounds.append(trees)
        state = checkpointed(model.stepped(gradients.select("_y", features, "_margins"), "_margins", trees))
    return model
