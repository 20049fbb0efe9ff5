"""Registered queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.plans.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query over ``Tables``; ``sql`` is its equivalent over the named views."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(Tables(spark, sf_dir)))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return build

    return register


def _plain(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        c = c.cast("timestamp_ntz")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.round(c.cast("double"), 6)
    elif isinstance(kind, T.DateType):
        c = c.cast("string")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        c = c.cast("bigint")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        names = kind.elementType.names
        c = F.array_join(
            F.transform(c, lambda s: F.concat_ws(":", *[s[n].cast("string") for n in names])), "|"
        )
    elif isinstance(kind, T.ArrayType):
        c = F.array_join(c.cast("array<string>"), ",")
    return c.alias(name)


def plain(df: DataFrame) -> DataFrame:
    """Scalar columns only, in types that every engine compares alike: lists become text, fractions
    keep six digits, timestamps lose their zone."""
    return df.select(*[_plain(f.name, f.dataType) for f in df.schema.fields])
