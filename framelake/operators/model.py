"""A learned preference: penalised logistic regression with folds by group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.vectors import dot
from framelake.operators.windows import ranked
from framelake.staging import stage


@dataclass
class Preference:
    """The final model and the held-out scores of the training rows."""

    model: LogisticRegressionModel
    held_out: DataFrame

    def score(self, rows: DataFrame) -> DataFrame:
        return _scored(self.model, rows)


def training_rows(rows: DataFrame) -> DataFrame:
    """Rows of groups that have a positive."""
    return rows.join(rows.where("label").select("grp").distinct(), "grp", "left_semi")


def _fit(rows: DataFrame, c: float) -> LogisticRegressionModel:
    n = rows.agg(F.count_if("label").alias("p"), F.count("*").alias("n")).first()
    weight = F.when(F.col("label"), n["n"] / (2.0 * n["p"])).otherwise(n["n"] / (2.0 * max(1, n["n"] - n["p"])))
    ready = rows.select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"), weight.alias("weight"))
    return LogisticRegression(weightCol="weight", standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * n["n"]), maxIter=200, tol=1e-9).fit(ready)


def _scored(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """``p`` from the coefficients, as built-in expressions (the model itself would drag its session into the tasks)."""
    weights = F.array(*[F.lit(float(x)) for x in model.coefficients])
    margin = dot(F.transform("v", lambda x: x.cast("double")), weights) + F.lit(float(model.intercept))
    return rows.withColumn("p", 1 / (1 + F.exp(-margin)))


def fit_preference(rows: DataFrame, c: float = 0.5, folds: int = 5, least_positives: int = 50, least_groups: int = 5) -> Preference | None:
    """Fit on ``rows`` (``id``, ``grp``, ``v``, boolean ``label``); None if there are too few positives or groups.

    Classes are balanced by weights; the penalty is 1 / (C n).  Folds hold
    whole groups, dealt out in the order of a hash, so each has its share of
    them and, as every group has a positive, none leaves the others without
    one.  Only with a single group there is nothing to fit on: its rows are
    held out with a null ``p``.
    """
    train = stage(training_rows(rows.where("v is not null and label is not null")), "train")
    have = train.agg(F.count_if("label").alias("p"), F.count_distinct("grp").alias("g")).first()
    if have["p"] < least_positives or have["g"] < least_groups:
        return None
    folds = min(folds, have["g"])
    groups = ranked(train.select("grp").distinct(), [F.xxhash64("grp"), F.col("grp")], "_fold").withColumn("_fold", F.pmod("_fold", F.lit(folds)))
    dealt = stage(train.join(groups, "grp"), "folds")
    out = None
    for k in range(folds):
        part, rest = dealt.where(F.col("_fold") == k).drop("_fold"), dealt.where(F.col("_fold") != k)
        s = _scored(_fit(rest, c), part) if folds > 1 else part.withColumn("p", F.lit(None).cast("double"))
        out = s if out is None else out.unionByName(s)
    return Preference(_fit(train, c), out)


def mlp(layers: list[tuple]) -> object:
    """A pandas UDF for a stack of linear layers ((weights, biases), ...) on a vector, without activations between, as regression heads have at inference.

    The weights are given, not trained here; the first output is the score.
    """
    stack = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in layers]

    @F.pandas_udf(T.DoubleType())
    def score(v: pd.Series) -> pd.Series:
        ok = v.notna()
        out = pd.Series(np.nan, index=v.index)
        if ok.any():
            x = np.stack(v[ok].to_numpy()).astype(float)
            for w, b in stack:
                x = x @ w.T + b
            out[ok] = x[:, 0]
        return out

    return score
