"""Chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_label(year: Column, train_end: int = 2022, cal_end: int = 2023, val_end: int = 2024) -> Column:
    return (
        F.when(year <= train_end, "train").when(year <= cal_end, "calibration")
        .when(year <= val_end, "validation").otherwise("test")
    )


def split_3way(
    df: DataFrame, target: str | None = "Disaster_Next_Month", year: str = "Year",
    train_end: int = 2022, val_end: int = 2024,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train / validation / test by year; rows without target are dropped.

    Pass ``target=None`` to keep them (loss regression).
    """
    usable = df if target is None else df.where(F.col(target).isNotNull())
    y = F.col(year)
    return (
        usable.where(y <= train_end),
        usable.where((y > train_end) & (y <= val_end)),
        usable.where(y > val_end),
    )


def split_4way(
    df: DataFrame, target: str = "Disaster_Next_Month", year: str = "Year",
    train_end: int = 2022, cal_end: int = 2023, val_end: int = 2024,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Train / calibration / validation / test by year, without target NULLs."""
    usable = df.where(F.col(target).isNotNull())
    y = F.col(year)
    return (
        usable.where(y <= train_end),
        usable.where((y > train_end) & (y <= cal_end)),
        usable.where((y > cal_end) & (y <= val_end)),
        usable.where(y > val_end),
    )


def split_regression(
    df: DataFrame, year: str = "Year", train_end: int = 2022, val_end: int = 2024
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return split_3way(df, None, year, train_end, val_end)
