"""Learning on features: perceptron, neural network, trees, text triage. Seeded; results are rows of scores."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task of boosting holds.
TASK = 500_000


def held_out(df: DataFrame, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, rows to judge by): one in `parts` by a hash of all columns, so copies never stand on both sides."""
    own = F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == 0
    return df.where(~own), df.where(own)


def perceptron(df: DataFrame, features: list[str], label: str, rounds: int = 20, rate: float = 1.0) -> list[float]:
    """Weights (bias last) by the batch perceptron rule: each round adds the sum over misclassified rows.

    The online rule depends on row order; the batch rule does not. A round is one aggregate over the rows.
    """
    w = [0.0] * (len(features) + 1)
    sign = F.when(F.col(label) == 1, 1.0).otherwise(-1.0)
    n = max(1, df.count())
    for _ in range(rounds):
        margin = sum((F.lit(a) * F.col(c) for a, c in zip(w, features, strict=False)), F.lit(w[-1]))
        wrong = df.where(sign * margin <= 0)
        got = wrong.agg(F.count("*"), *[F.sum(sign * F.col(c)) for c in features], F.sum(sign)).first()
        if not got[0]:
            break
        w = [a + rate * g / n for a, g in zip(w, got[1:], strict=True)]
    return w


def perceptron_predict(df: DataFrame, features: list[str], w: list[float]) -> DataFrame:
    margin = sum((F.lit(a) * F.col(c) for a, c in zip(w, features, strict=False)), F.lit(w[-1]))
    return df.withColumn("prediction", (margin > 0).cast("int"))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def mlp(df: DataFrame, features: list[str], label: str, hidden: int = 8, classes: int = 2, seed: int = 0):
    return MultilayerPerceptronClassifier(layers=[len(features), hidden, classes], labelCol=label, seed=seed, maxIter=60).fit(assembled(df, features))


def forest(df: DataFrame, features: list[str], label: str, seed: int = 0):
    return RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=6, seed=seed).fit(assembled(df, features))


def boosted(df: DataFrame, features: list[str], label: str, seed: int = 0):
    """Boosted trees; rows are dealt out by a hash to tasks of about TASK, which hold them in memory from tree to tree."""
    rows = df.select(*features, label)
    rows = rows.repartition(max(1, -(-rows.count() // TASK)), *rows.columns)
    return GBTRegressor(labelCol=label, maxIter=15, maxDepth=4, seed=seed).fit(assembled(rows, features))


def triage(df: DataFrame, text: str, label: str):
    """TF-IDF and multinomial logistic regression over the words of a text."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=1 << 15),
        IDF(inputCol="_tf", outputCol="features"), LogisticRegression(labelCol=label, maxIter=30, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(df)
