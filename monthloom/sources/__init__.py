"""Readers and writers: observations, events, versions, results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATIONS = "date string, territory_id int, category string, value double"
EVENTS = "event_id string, published_at timestamp, available_at date, effective_date date, rate double, delta_pp double, scope string, source_url string"
LOCAL_EVENTS = "territory_id int, name string, published_at string, available_at string, event_month string, summary string, url string"
TERRITORIES = "territory_id int, municipal_district_name_short string, municipal_district_name string, region_name string, oktmo string, year_from int, year_to int"
NATIONAL = "date string, food double, nonfood double, catering double, services double"


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file, a folder of parts, or a folder partitioned by origin, whose partitions are pruned by filters on it."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header; .gz is read by its suffix."""
    return spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)


def json_rows(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """An array of objects, or an object a line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def excel(spark: SparkSession, path: str, columns: list[str], schema: str) -> DataFrame:
    """Columns of a small dictionary sheet, read on the driver; needs a workbook reader for pandas."""
    import pandas as pd

    try:
        sheet = pd.read_excel(path, usecols=columns)
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    return spark.createDataFrame(sheet[columns], schema)


def national(spark: SparkSession, path: str) -> DataFrame:
    """field, date, v of a national file, with the total of its four fields."""
    fields = ["food", "nonfood", "catering", "services"]
    wide = csv(spark, path, NATIONAL).withColumn("total", sum(F.col(c) for c in fields))
    return wide.unpivot(["date"], [*fields, "total"], "field", "v")


def write_parquet(df: DataFrame, path: str, rows_a_file: int = 0, by: list[str] | None = None, once: bool = True) -> None:
    """Once: an existing output is an error. rows_a_file bounds the rows of each part."""
    w = df.write.mode("errorifexists" if once else "overwrite")
    w = w.option("maxRecordsPerFile", rows_a_file) if rows_a_file else w
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.mode("errorifexists").option("compression", "gzip" if gzip else "none").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def small_json(value: object) -> str:
    """A policy or configuration as text; a value that is not a number is an error."""
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, indent=2)


def content_hash(df: DataFrame) -> str:
    """The same for equal rows in whatever order and files: a digest of the sum of row hashes and their number."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    r = df.agg(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{sorted(df.columns)}:{r.n}:{r.s}".encode()).hexdigest()


def cached_by_origin(spark: SparkSession, path: str, origin: int, signature: str, make) -> DataFrame:
    """The rows of an origin from path/origin=<c>, made once; another signature than the stored one is an error."""
    here = f"{path}/origin={origin}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{here}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        make(origin).withColumn("signature", F.lit(signature)).write.mode("overwrite").parquet(here)
    rows = spark.read.parquet(here)
    other = rows.where(F.col("signature") != signature).limit(1).count()
    if other:
        raise ValueError(f"{here} was made with other inputs")
    return rows.drop("signature")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
