"""Parquet tables, delimited metadata with stringified code maps, and recording headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.staging import share_package

#: Columns of a cohort's metadata file.
METADATA = "ecg_id long, patient_id long, age double, sex int, scp_codes string, strat_fold int, filename_lr string, filename_hr string"
STATEMENTS = "code string, diagnostic double, diagnostic_class string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=METADATA, escape='"')


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """The codes that name a diagnosis and its class; a small dimension."""
    return spark.read.csv(path, header=True, schema=STATEMENTS, escape='"').where("diagnostic = 1 and diagnostic_class is not null").select("code", "diagnostic_class")


def header_fields(text: Column) -> list[Column]:
    """age and sex of a header's text: '#Age: 61' and '#Sex: Male' lines; what can't be read is null."""
    age = F.regexp_extract(text, r"(?i)#\s*Age:\s*([0-9.]+)", 1).try_cast("double")
    sex = F.lower(F.substring(F.regexp_extract(text, r"(?i)#\s*Sex:\s*(\w+)", 1), 1, 1))
    return [age.alias("age"), F.when(sex == "m", 0).when(sex == "f", 1).alias("sex")]


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, path, age, sex of header files, in order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hea").option("recursiveFileLookup", "true").load(folder)
    fields = header_fields(F.col("content").cast("string"))
    return files.select(F.regexp_extract("path", r"([^/]+)\.hea$", 1).alias("record_id"), F.regexp_replace("path", r"\.hea$", "").alias("path"), *fields).orderBy("path")


def usable_headers(headers: DataFrame, low: float = 18, high: float = 89) -> DataFrame:
    """Headers with an age in range and a known sex; an error where none is left."""
    found = headers.where(F.col("age").between(low, high) & F.col("sex").isNotNull())
    if found.isEmpty():
        raise ValueError("no header has a usable age and sex")
    return found


def read_predictions(spark: SparkSession, path: str, part: str = "test") -> DataFrame:
    """index, age_gap, a row a recording, of one part of prediction files, each a JSON object with two arrays a part.

    Runs are to be joined on index, never by position: they need not list recordings in one order. Where the arrays of a
    part differ in length, what has no partner is left out.
    """
    arrays = "struct<index: array<bigint>, age_gap: array<double>>"
    files = spark.read.json(path, multiLine=True, schema=f"`{part}` {arrays}")
    n = F.least(F.size(f"{part}.index"), F.size(f"{part}.age_gap"))
    pairs = F.arrays_zip(F.col(f"{part}.index").alias("index"), F.col(f"{part}.age_gap").alias("age_gap"))
    return files.where(n > 0).select(F.explode(F.slice(pairs, F.lit(1), n)).alias("p")).select(F.col("p.index").alias("index"), F.col("p.age_gap").alias("age_gap"))
