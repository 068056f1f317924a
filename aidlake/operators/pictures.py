"""Pictures: three handcrafted features, and haze made up from the scattering model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def features(df: DataFrame) -> DataFrame:
    """(path, label, red_share, brightness, contrast) of pictures(path, label, height, width, channels, data)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                x = np.frombuffer(r.data, np.uint8).reshape(-1, r.channels)[:, :3].astype(float)
                light = x.mean(1)
                rows.append((r.path, r.label, float(x[:, -1].sum() / max(1.0, x.sum())), float(light.mean() / 255), float(light.std() / 255)))
            yield pd.DataFrame(rows, columns=["path", "label", "red_share", "brightness", "contrast"])

    return df.select("path", "label", "channels", "data").mapInPandas(work, "path string, label string, red_share double, brightness double, contrast double")


def hazed(df: DataFrame, beta: float = 1.0, air: float = 0.9) -> DataFrame:
    """df with data under haze: I = J t + A (1 - t), t = exp(-beta depth), depth growing to the top of the picture."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels).astype(float)
                t = np.exp(-beta * np.linspace(1, 0, r.height))[:, None, None]
                out.append(np.rint(x * t + 255 * air * (1 - t)).astype(np.uint8).tobytes())
            yield pdf.assign(data=out)

    return df.mapInPandas(work, StructType(df.schema.fields))


def psnr(a: bytes, b: bytes) -> float:
    """Peak signal-to-noise ratio of two pictures' bytes in dB."""
    e = np.mean((np.frombuffer(a, np.uint8).astype(float) - np.frombuffer(b, np.uint8)) ** 2)
    return float("inf") if e == 0 else float(10 * np.log10(255**2 / e))
