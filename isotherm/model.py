"""Datasets, their grids, reserved columns, and the catalogue of variables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    name: str
    resolution: float | None  # degrees; none for stations

    @property
    def gridded(self) -> bool:
        return self.resolution is not None

    @property
    def decimals(self) -> int:
        """Decimals that coordinates are kept with: those of the resolution, 6 for stations."""
        return len(repr(self.resolution).split(".")[1]) if self.resolution else 6

    @property
    def view(self) -> str:
        return view_name(self.name)


#: The datasets that queries may name.
DATASETS = {d.name: d for d in (Dataset("era5", 0.25), Dataset("era5-land", 0.1), Dataset("inmet", None))}
#: Columns that are never variables.
GRID_RESERVED = ("latitude", "longitude", "hour_utc", "date")
STATION_META = ("station_id", "latitude", "longitude", "altitude", "uf", "regiao", "nome", "data_fundacao")
CORNERS = tuple(f"{grid}_{axis}_{side}" for grid in ("era5", "era5_land") for axis, side in (("lat", "top"), ("lat", "bottom"), ("lon", "left"), ("lon", "right")))
STATION_RESERVED = (*STATION_META, "date", "hour_utc", "year", *CORNERS)


def view_name(dataset: str) -> str:
    return dataset.replace("-", "_")


def variables(df: DataFrame, reserved: tuple[str, ...] = GRID_RESERVED) -> list[str]:
    """Every column that is not reserved."""
    return [c for c in df.columns if c not in reserved]


def merged_catalogue(catalogue: DataFrame) -> DataFrame:
    """(dataset, api_name, unit) rows -> one row for each variable, with the datasets that have it, joined in order."""
    return catalogue.groupBy("api_name").agg(F.array_join(F.sort_array(F.collect_set("dataset")), ", ").alias("datasets"), F.min("unit").alias("unit"))
