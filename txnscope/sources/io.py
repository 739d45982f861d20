"""S1-S3, S5 metadata: readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnscope.schema import FEATURE_NAMES, ID_COLUMNS, LABEL, TRANSACTION_SCHEMA, feature_type


#: Rows of a day that go to one file.
FILE_ROWS = 1_000_000


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv",
                      schema: T.StructType = TRANSACTION_SCHEMA) -> DataFrame:
    """Raw transactions with a declared schema (never inferred).

    CSV timestamps are parsed leniently (``try_to_timestamp``) so a bad value
    becomes NULL, which ``validate_raw`` then rejects. Numbers that are none
    (text ``NaN`` or ``Infinity``, stored NaN or infinite doubles) become
    NULL too."""
    if fmt == "csv":
        raw = (spark.read.option("header", True)
               .schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
               .csv(path))
        cols = []
        for f in schema:
            c = F.col(f.name)
            if isinstance(f.dataType, T.TimestampType):
                cols.append(F.try_to_timestamp(c).alias(f.name))
            elif isinstance(f.dataType, T.BooleanType):
                cols.append(F.lower(c).isin("true", "1", "t", "yes").alias(f.name))
            else:
                cols.append(c.try_cast(f.dataType).alias(f.name))
        return finite_numbers(raw.select(*cols))
    return finite_numbers(spark.read.schema(schema).format(fmt).load(path))


def finite_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles as NULL; all else unchanged."""
    odd = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)).alias(c) if c in odd else F.col(c)
                       for c in df.columns])


def write_features(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partition_by_date: bool = True, file_rows: int = FILE_ROWS) -> None:
    """Id columns + 43 features + label, partitioned by event date so
    later reads prune by day. A day has one file for every ``file_rows`` of its
    own rows, about: a quiet day is a single file, a busy one is dealt to many
    tasks. The days' counts (a row per day) come from a narrow pass before."""
    cols = [c for c in ID_COLUMNS if c in df.columns] + FEATURE_NAMES + \
        ([LABEL] if LABEL in df.columns else [])
    out = df.select(*cols).withColumn("event_date", F.to_date("timestamp"))
    if partition_by_date:
        days = out.groupBy("event_date").agg(F.ceil(F.count(F.lit(1)) / F.lit(file_rows)).alias("_files")).withColumnRenamed("event_date", "_day")
        out = out.join(F.broadcast(days), F.col("event_date").eqNullSafe(F.col("_day")))
        out = out.withColumn("_salt", F.pmod(F.xxhash64("transaction_id"), F.col("_files")))
        out = out.repartition("event_date", "_salt").drop("_salt", "_files", "_day")
    w = out.write.mode(mode).format(fmt)
    if partition_by_date:
        w = w.partitionBy("event_date")
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def features_schema() -> T.StructType:
    fields = [T.StructField("transaction_id", T.StringType()),
              T.StructField("user_id", T.StringType()),
              T.StructField("timestamp", T.TimestampType())]
    fields += [T.StructField(n, feature_type(n)) for n in FEATURE_NAMES]
    fields.append(T.StructField(LABEL, T.BooleanType()))
    return T.StructType(fields)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: feature rows back, typed. ``event_date`` (if the files have it)
    stays, so that a filter on it prunes days."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).schema(features_schema())
    df = r.load(path)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in features_schema() if f.name in df.columns]
    return df.select(*cols, *[c for c in ("event_date",) if c in df.columns])
