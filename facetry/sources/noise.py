"""Gaussian noise, alike for all rows or as a mixture over groups or rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counter
from ..functions.arrays import row_uniform
from ..operators.blocks import dense, lists, replace_column, vector


# Shares of the noise levels by group (of ten) and by row, and the row preset's shares.
GROUP_SHARES = (3, 6, 1)
ROW_SHARES = (0.3, 0.6, 0.1)
ROW_PRESET_SHARES = (0.3, 0.3, 0.4)


def add_gaussian(df: DataFrame, sd: float | Column = 0.01, seed: int = 0) -> DataFrame:
    """features + sd * N(0,1) per cell; ``sd`` may be a Column, that is, differ by row."""
    out = df.schema
    marked = df.withColumn("_noise_sd", (F.lit(float(sd)) if isinstance(sd, (int, float)) else sd).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense(batch)
            ids, sds = vector(batch, "row_id"), vector(batch, "_noise_sd")
            loud = sds != 0.0
            if loud.any():
                x = x.copy()
                slots = np.arange(x.shape[1])[None, :]
                x[loud] += sds[loud, None] * counter.normal(ids[loud, None], slots, seed)
            keep = batch.drop_columns(["_noise_sd"])
            yield replace_column(keep, "features", lists(x))

    return marked.mapInArrow(run, out)


def _levels(position: Column, sds: Sequence[float], cuts: Sequence[float], closed: bool) -> Column:
    level = F.lit(float(sds[-1]))
    for sd, cut in reversed(list(zip(sds[:-1], cuts))):
        inside = position <= F.lit(cut) if closed else position < F.lit(cut)
        level = F.when(inside, F.lit(float(sd))).otherwise(level)
    return level


def group_noise_level(sds: Sequence[float], props: Sequence[float], groups: int, group_id: str = "group_id") -> Column:
    """Noise level of a group: the first share ``props[0]`` of the groups gets ``sds[0]``, and so on.

    With 20 groups and (3, 6, 1): groups 0-5, 6-17 and 18-19.
    """
    cuts = np.cumsum(props)[:-1] / np.sum(props) * groups
    return _levels(F.col(group_id).cast("double"), sds, [round(float(c), 9) for c in cuts], closed=False)


def row_noise_level(sds: Sequence[float], props: Sequence[float] = ROW_SHARES, seed: int = 0) -> Column:
    """Noise level drawn per row: u <= .3, <= .9, else, with the default shares."""
    cuts = np.cumsum(props)[:-1] / np.sum(props)
    return _levels(row_uniform("row_id", seed), sds, [round(float(c), 9) for c in cuts], closed=True)


def add_group_mixture(
    df: DataFrame, sds: Sequence[float], props: Sequence[float] = GROUP_SHARES, groups: int = 20, seed: int = 0
) -> DataFrame:
    return add_gaussian(df, group_noise_level(sds, props, groups), seed)


def add_row_mixture(
    df: DataFrame, sds: Sequence[float], props: Sequence[float] = ROW_SHARES, seed: int = 0
) -> DataFrame:
    return add_gaussian(df, row_noise_level(sds, props, seed), seed)


def group_preset(std: float) -> tuple[tuple[float, float, float], tuple[int, int, int]]:
    """Most groups clean, the last tenth noisy."""
    return (0.0, 0.0, std), GROUP_SHARES


def row_preset(std: float) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """The row-wise preset; its shares say .3/.3/.4, the row mixture's own default cuts at .3 and .9."""
    return (0.0, 0.0, std), ROW_PRESET_SHARES
