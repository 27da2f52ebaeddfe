"""The canonical flow table: schema, coercion, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowloom import fixed

_TYPES = {
    "flow_id": T.LongType(), "scenario": T.StringType(),
    "src_ip": T.StringType(), "dst_ip": T.StringType(),
    "src_port": T.IntegerType(), "dst_port": T.IntegerType(),
    "protocol": T.StringType(),
    "start_time": T.TimestampType(), "end_time": T.TimestampType(),
    "duration_s": T.DoubleType(),
    "bytes_fwd": T.LongType(), "bytes_bwd": T.LongType(),
    "pkts_fwd": T.LongType(), "pkts_bwd": T.LongType(),
    "mean_iat_ms": T.DoubleType(), "std_iat_ms": T.DoubleType(),
    "min_pkt_size": T.DoubleType(), "max_pkt_size": T.DoubleType(),
    "label": T.StringType(), "detailed_label": T.StringType(),
}
FLOW_SCHEMA = T.StructType([T.StructField(c, _TYPES[c]) for c in fixed.FLOW_COLUMNS])
NULLABLE_STATS = ["mean_iat_ms", "std_iat_ms", "min_pkt_size", "max_pkt_size"]


class SchemaError(ValueError):
    """A DataFrame does not follow the canonical flow table."""


def empty_flow_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FLOW_SCHEMA)


def coerce_to_schema(df: DataFrame) -> DataFrame:
    """Cast to the canonical types in the canonical order; NaN becomes NULL."""
    cols = []
    for name in fixed.FLOW_COLUMNS:
        c = F.col(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) and name in NULLABLE_STATS:
            c = F.when(~F.isnan(c), c)
        if isinstance(df.schema[name].dataType, T.TimestampNTZType):
            c = ntz_to_utc(c)
        cols.append(c.cast(_TYPES[name]).alias(name))
    return df.select(*cols)


def ntz_to_utc(c):
    """A zone-less timestamp read as UTC, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, c))


def invalid_values(df: DataFrame) -> DataFrame:
    """Label and protocol values outside the allowed sets, with row counts.

    The result has one row per distinct bad value; valid rows drop out before
    the shuffle.
    """
    pairs = F.explode(F.array(
        F.struct(F.lit("label").alias("column"), F.col("label").alias("value")),
        F.struct(F.lit("protocol").alias("column"), F.col("protocol").alias("value")),
    ))
    ok = (
        F.col("value").isNull()
        | ((F.col("column") == "label") & F.col("value").isin(fixed.LABELS))
        | ((F.col("column") == "protocol") & F.col("value").isin(fixed.PROTOCOLS))
    )
    return (
        df.select(pairs.alias("p")).select("p.*").where(~ok)
        .groupBy("column", "value").agg(F.count("*").alias("rows"))
    )


def duplicate_ids(df: DataFrame, within: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """Flow ids that occur more than once (keyed by id, so it spreads evenly)."""
    return (
        df.groupBy(*within, "flow_id").agg(F.count("*").alias("rows"))
        .where("rows > 1")
    )


def validate_flow_df(df: DataFrame, strict: bool = True,
                     unique_within: tuple[str, ...] = ("scenario",)) -> None:
    """Raise :class:`SchemaError` unless ``df`` is a valid flow table."""
    if df.columns != fixed.FLOW_COLUMNS:
        raise SchemaError(f"Column mismatch: expected {fixed.FLOW_COLUMNS}, got {df.columns}")
    for c in ("start_time", "end_time"):
        if not isinstance(df.schema[c].dataType, T.TimestampType):
            raise SchemaError(f"{c} must be a timestamp with time zone")
    if strict:
        for f in FLOW_SCHEMA:
            got = df.schema[f.name].dataType
            if got != f.dataType:
                raise SchemaError(
                    f"dtype mismatch for {f.name!r}: want {f.dataType.simpleString()}, got {got.simpleString()}")
    # Some offending values of each column are enough for the message.
    found = invalid_values(df)
    bad = [r for c in ("label", "protocol")
           for r in found.where(F.col("column") == c).orderBy(F.desc("rows"), "value").limit(20).collect()]
    for column, title in (("label", "Invalid labels"), ("protocol", "Invalid protocols")):
        values = sorted(r["value"] for r in bad if r["column"] == column)
        if values:
            raise SchemaError(f"{title}: {values}")
    dup = duplicate_ids(df, unique_within).agg(F.sum(F.col("rows") - 1).alias("n")).first()["n"]
    if dup:
        raise SchemaError(f"flow_id is not unique ({dup} duplicates)")
