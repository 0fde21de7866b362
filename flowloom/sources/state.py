"""Stored state and results: fitted encoders, thresholds, coefficients, metrics."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.features import encoder_from_state, fit_vocab, scaler_rows
from flowloom.sources.flows import FeatureSpec


def save_scaler(scaler_state: DataFrame, path: str) -> None:
    scaler_state.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    """Scaler rows; using them means that features are scaled, whatever the spec said."""
    return spark.read.parquet(path)


def save_state(tables: Mapping[str, DataFrame], root: str, run_id: str, by: str = "silo") -> None:
    """Every table below `root`, in the folder of its run and partitioned by silo where it has one."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if by in table.columns:
            writer = writer.partitionBy(by)
        writer.parquet(f"{root}/{name}/run_id={run_id}")


def load_state(spark: SparkSession, root: str, run_id: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of one run.  Silo names are kept as text even if they look like numbers."""
    keep = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        return {n: spark.read.parquet(f"{root}/{n}/run_id={run_id}") for n in names}
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", keep)


def encoder_state(flows: DataFrame, encoder: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> dict[str, DataFrame]:
    """The rows an encoder is stored as."""
    return {"scaler_state": scaler_rows(encoder, spec, keys), "vocab_state": fit_vocab(flows, spec, keys)}


def restore_encoder(state: Mapping[str, DataFrame], spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    return encoder_from_state(state["scaler_state"], state["vocab_state"], spec, keys)


def write_metrics(metrics: DataFrame, json_path: str, csv_path: str, columns: Sequence[str]) -> None:
    """All columns as JSON, and those of `columns` that are present as CSV."""
    metrics.write.mode("overwrite").json(json_path)
    present = [c for c in columns if c in metrics.columns]
    metrics.select(*present).write.mode("overwrite").option("header", True).csv(csv_path)


class RoundLog:
    """Tables of a run of rounds below `root`, each round with a marker once all of its tables are written.

    A run that finds a log goes on after the last marked round; a round without a marker is
    written again.  The marker holds the settings of the run, and a log of other settings is refused.
    """

    MARKER = "committed.json"

    def __init__(self, spark: SparkSession, root: str, settings: Mapping) -> None:
        self.spark, self.root, self.settings = spark, root.rstrip("/"), json.dumps(dict(settings), sort_keys=True)
        known = self._marked()
        self.last = max(known, default=0)
        for number in known[-1:]:
            if (found := spark.read.text(f"{self._folder(number)}/{self.MARKER}").first()[0]) != self.settings:
                raise ValueError(f"the log at {root} is of a run with other settings: {found}")

    def _folder(self, number: int) -> str:
        return f"{self.root}/round={number:06d}"

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self) -> list[int]:
        place, files = self._files(self.root)
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        numbers = sorted(int(n.removeprefix("round=")) for n in names if n.startswith("round="))
        return [n for n in numbers if files.exists(self._files(f"{self._folder(n)}/{self.MARKER}")[0])]

    def write(self, table: DataFrame, number: int, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{self._folder(number)}/{name}")
        return self.spark.read.schema(table.schema).parquet(f"{self._folder(number)}/{name}")

    def read(self, number: int, name: str) -> DataFrame | None:
        place, files = self._files(f"{self._folder(number)}/{name}")
        return self.spark.read.parquet(place.toString()) if files.exists(place) else None

    def commit(self, number: int) -> None:
        place, files = self._files(f"{self._folder(number)}/{self.MARKER}")
        out = files.create(place, True)
        out.writeBytes(self.settings)
        out.close()
        self.last = number


def pending(silos: DataFrame, done: DataFrame, key: str = "silo") -> DataFrame:
    """Silos without stored metrics."""
    return silos.join(done.select(key).distinct(), key, "left_anti")


def resume(silos: DataFrame, done: DataFrame, new: DataFrame, key: str = "silo", pos: str = "silo_pos") -> DataFrame:
    """Old and new metric rows together in the canonical order of the silos."""
    both = done.unionByName(new, allowMissingColumns=True)
    return both.join(silos.select(key, pos), key).orderBy(F.col(pos)).drop(pos)
