"""Sources: survey sheets, polygon layers, stage tables, CSV shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import with_climatology_parts

SURVEY_SCHEMA = ("id BIGINT, Date_ DOUBLE, LAT_DD DOUBLE, LNG_DD DOUBLE, Sol DOUBLE, Trans DOUBLE, Greg DOUBLE, "
                 "`Sol larve` DOUBLE, `Trans larve` DOUBLE, `Greg larve` DOUBLE, DI_dif_moy DOUBLE, DL_dif_moy DOUBLE, "
                 "Decade INT, Campagne STRING, Sol_NSE DOUBLE")
FEATURE_SCHEMA = ("type STRING, properties STRUCT<poly_id: BIGINT, AIRE_CODE: INT, SECT_NO: INT, AIRE_NOM: STRING>, "
                  "geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
SHARD_COLUMNS = {"chirps_sum": "chirps_sum_mean", "NDVI": "ndvi_mean", "EVI": "evi_mean", "lst": "lst_mean",
                 "chirps_baseline": "chirps_baseline_mean"}


def read_surveys(spark: SparkSession, path: str, schema: str = SURVEY_SCHEMA) -> DataFrame:
    """Survey sheet exported as CSV, typed by schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features, one per line, as rings: ``(poly_id, attributes, ring_no, ring)``.

    The closing vertex is dropped. ``poly_id`` is read, or else derived from the area and sector codes."""
    f = spark.read.schema(FEATURE_SCHEMA).json(path)
    rings = f.select("properties.*", F.posexplode("geometry.coordinates").alias("ring_no", "pts"))
    ring = F.transform(F.slice("pts", 1, F.size("pts") - 1), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return rings.select(F.coalesce("poly_id", (F.col("AIRE_CODE") * 1000 + F.col("SECT_NO")).cast("bigint")).alias("poly_id"),
                        "AIRE_CODE", "SECT_NO", "AIRE_NOM", "ring_no", ring.alias("ring"))


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_shards(spark: SparkSession, folder: str, source: str, schema: str, keep: list[str],
                names: dict[str, str] = SHARD_COLUMNS, prefix: str = "v04") -> DataFrame:
    """All CSV shards of a source, tile taken from the file name, cell key kept as text."""
    df = (spark.read.schema(schema).option("header", True).csv(f"{folder}/{prefix}_{source}_*")
          .select("*", F.regexp_extract(F.col("_metadata.file_path"), prefix + "_" + source + r"_[^/]*_t=?(\d+)", 1).cast("int").alias("tile")))
    df = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    return df.select(*[c for c in keep if c in df.columns], "tile")


def read_climatology(spark: SparkSession, folder: str, prefix: str = "v04") -> DataFrame:
    schema = "cell_id STRING, doy_id INT, chirps_baseline DOUBLE"
    df = read_shards(spark, folder, "BASELINE", schema, ["cell_id", "doy_id", "chirps_baseline_mean"], prefix=prefix)
    return with_climatology_parts(df.drop("tile"))


def read_cell_ids(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Only the key column is scanned."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    return df.select(F.col("cell_id").cast("string").alias("cell_id")).distinct()


def cached_table(spark: SparkSession, path: str, compute) -> DataFrame:
    """Write-once table: computed and stored the first time, read back ever after. A write that broke off left no
    success marker; it is made anew."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """In whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
