"""Sources and sinks in files: CSV, JSON lines, an append-only audit log, catalogs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "file_path string, tags array<string>, source string, license string, attribution string, source_url string"
CATALOG = "map<string, struct<title:string,regs:array<string>,min_hours:int,max_hours:int,regional:boolean,default_modules:array<string>>>"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_audit(df: DataFrame, path: str, created: str = "created_at") -> None:
    """Appends to a log that is partitioned by day, so that a reader of some days prunes the others."""
    df.withColumn("day", F.to_date(created)).write.mode("append").partitionBy("day").parquet(path)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of images with their tags a file, or, with ``lines``, one on each line, so that large files are split."""
    return spark.read.schema(MANIFEST).option("multiLine", not lines).json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Images as lines of one-element arrays, as ``read_manifest(lines=True)`` takes them."""
    columns = [f.split()[0] for f in MANIFEST.split(", ")]
    df.select(F.to_json(F.array(F.struct(*columns))).alias("value")).write.mode("overwrite").text(path)


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Course types from JSON objects keyed by slug, one a file or, with ``lines``, one a line: slug, title, regs, min_hours, max_hours, regional
    (false where it isn't given), default_modules. Text that is no such object gives no row."""
    entries = F.from_json("value", CATALOG)
    found = spark.read.text(path, wholetext=not lines).select(F.explode(entries).alias("slug", "x")).select("slug", "x.*")
    return found.withColumn("regional", F.coalesce("regional", F.lit(False)))


def write_catalog(df: DataFrame, path: str) -> None:
    """Course types as lines of objects with one slug each."""
    entry = F.struct("title", "regs", "min_hours", "max_hours", "regional", "default_modules")
    df.select(F.to_json(F.create_map("slug", entry)).alias("value")).write.mode("overwrite").text(path)


def catalog(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """Course types from a configuration: slug, title, regulations, least and most hours, regional, default modules."""
    return spark.createDataFrame(entries, "slug string, title string, regs array<string>, min_hours int, max_hours int, regional boolean, default_modules array<string>")


def slides_of(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with ``slides`` from JSON text of any of the three shapes; an empty array of anything else."""
    flat, nested = "array<struct<title:string,index:int,module_index:int>>", "array<struct<slides:array<struct<title:string,index:int,module_index:int>>>>"
    text = F.trim(raw)
    listed = F.from_json(text, nested)
    of_modules = F.flatten(F.transform(listed, lambda m: m["slides"]))
    has_modules = F.exists(F.coalesce(listed, F.array().cast(nested)), lambda m: m["slides"].isNotNull())
    inside = F.from_json(text, f"struct<slides:{flat},completed_modules:{nested}>")
    of_object = F.coalesce(inside["slides"], F.flatten(F.transform(inside["completed_modules"], lambda m: m["slides"])))
    found = F.when(F.startswith(text, F.lit("[")), F.when(has_modules, of_modules).otherwise(F.from_json(text, flat))).when(F.startswith(text, F.lit("{")), of_object)
    return df.withColumn("slides", F.coalesce(found, F.array().cast(flat)))
