"""Hooks for models that are trained elsewhere, and the parts of image restoration that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType


def model_udf(make: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch: int = 256) -> Callable[[Column], Column]:
    """A column function from array<float> of a width to array<float>: make() loads a model once a worker.

    No weights come with this library; convolutional, adversarial or diffusion networks are passed in here.
    """
    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[width]])


def autoencode(df: DataFrame, features: str, k: int):
    """df with code and restored arrays: the linear autoencoder, whose best weights are the principal components."""
    model = PCA(k=k, inputCol=features, outputCol="_code").fit(df)
    axes = model.pc.toArray()
    code = vector_to_array("_code")
    back = F.array(*[sum((F.get(code, j) * float(axes[i, j]) for j in range(k)), F.lit(0.0)) for i in range(len(axes))])
    return model.transform(df).withColumn("code", code).withColumn("restored", back).drop("_code")


def noised(df: DataFrame, t: int, steps: int = 1000, low: float = 1e-4, high: float = 0.02, seed: int = 0) -> DataFrame:
    """df(…, data) with noisy (array<float>): the diffusion model's forward process at step t in closed form."""
    keep = float(np.prod(1 - np.linspace(low, high, steps)[:t]))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data in pdf.data:
                x = np.frombuffer(data, np.uint8).astype(np.float32) / 127.5 - 1
                r = np.random.default_rng([seed, t, len(x), int(x[:64].sum() * 1000) & 0xFFFF])
                out.append((np.sqrt(keep) * x + np.sqrt(1 - keep) * r.normal(size=len(x))).astype(np.float32))
            yield pdf.assign(noisy=out)

    return df.mapInPandas(work, StructType([*df.schema.fields]).add("noisy", ArrayType(FloatType())))
