"""Readers and writers of the formats around the engine."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.panel import Panel, from_dataframe

TS_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def parse_timestamp(x):
    """The first format that fits, then RFC 3339, as a UTC time without zone; null for none."""
    c = F.col(x) if isinstance(x, str) else x
    plain = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in TS_FORMATS]
    zoned = F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.to_utc_timestamp(F.try_to_timestamp(c), F.current_timezone()).cast("timestamp_ntz"))
    return F.coalesce(zoned, *plain)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; the schema is given, not guessed, and malformed rows are errors."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_panel_csv(spark: SparkSession, path: str, p: Panel) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return from_dataframe(rows.withColumn(p.ts, parse_timestamp(p.ts)), p)


# The keys under which files hold a geometry.
GEOMETRY = "struct<type:string,coordinates:string>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(kind, x, y, ring, properties): points and the outer rings of polygons; the geometry may be under ``geometry``
    or ``cartometry``."""
    schema = f"features array<struct<geometry:{GEOMETRY},cartometry:{GEOMETRY},properties:string>>"
    return _shapes(spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f")).select("f.*"))


def _shapes(f: DataFrame) -> DataFrame:
    g = F.coalesce("geometry", "cartometry")
    rows = f.select(g["type"].alias("kind"), g["coordinates"].alias("at"), "properties")
    point = F.from_json("at", "array<double>")
    ring = F.transform(F.from_json("at", "array<array<array<double>>>")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    isp, isq = F.col("kind") == "Point", F.col("kind") == "Polygon"
    return rows.select("kind", F.when(isp, point[0]).alias("x"), F.when(isp, point[1]).alias("y"), F.when(isq, ring).alias("ring"), "properties")


def write_predictions(df: DataFrame, path: str, row: str = "row", prediction: str = "prediction") -> None:
    df.select(F.col(row).alias("row"), F.col(prediction).alias("prediction")).write.csv(path, header=True)


def write_forecast(df: DataFrame, path: str, model: str, horizon: int) -> None:
    """Forecast rows as parquet with a JSON manifest beside them, through Spark's file systems."""
    df.write.parquet(f"{path}/forecast.parquet")
    manifest = json.dumps({"version": 1, "model": model, "horizon": horizon, "forecast": "forecast.parquet"})
    df.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_forecast(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("version") != 1:
        raise ValueError("an unknown manifest version")
    return manifest, spark.read.parquet(f"{path}/{manifest['forecast']}")


def model_specs(text: str) -> list[dict]:
    """Models and their parameters of a TOML or JSON configuration: [[models]] with a ``name`` each."""
    from loomgrid.operators.forecasting import MODELS

    config = json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)
    specs = config.get("models", [])
    for spec in specs:
        if spec.get("name") not in MODELS:
            raise ValueError(f"unknown model {spec.get('name')}")
    return specs


def run_specs(df: DataFrame, p: Panel, horizon: int, specs: list[dict]) -> DataFrame:
    """The union of all configured models' forecasts."""
    from loomgrid.operators.forecasting import MODELS

    out = None
    for spec in specs:
        made = MODELS[spec["name"]](df, p, horizon, **{k: v for k, v in spec.items() if k != "name"})
        out = made if out is None else out.unionByName(made)
    return out


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_geojson``, of files with a feature a line, which split over tasks."""
    schema = f"geometry {GEOMETRY}, cartometry {GEOMETRY}, properties string"
    return _shapes(spark.read.json(path, schema=schema))


def save_model(spark: SparkSession, model, path: str) -> None:
    """A fitted booster as one JSON line."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(path)


def load_model(spark: SparkSession, path: str):
    from loomgrid.operators.boosting import Model

    return Model.from_json(spark.read.text(path).first()[0])


def save_weights(spark: SparkSession, model, path: str) -> None:
    """A booster's trees and first margin alone, without what it was fitted with."""
    spark.createDataFrame([(json.dumps({"version": 2, "init": model.init, "trees": model.trees}),)], "value string").coalesce(1).write.text(path)


def load_weights(spark: SparkSession, path: str, spec):
    """The saved trees as a model of the given specification."""
    from loomgrid.operators.boosting import Model

    d = json.loads(spark.read.text(path).first()[0])
    if d.get("version") != 2:
        raise ValueError("an unknown version of weights")
    return Model(spec, d["init"], d["trees"])
