"""Small hand-made tables; only the columns a query reads need values."""

from datetime import date
from decimal import Decimal

from cartlake.schemas import TABLE_SCHEMAS, Tables


def rows(spark, table, **columns):
    """A table from column lists; columns not given are NULL."""
    schema = TABLE_SCHEMAS[table]
    size = len(next(iter(columns.values())))
    data = list(zip(*[columns.get(f.name, [None] * size) for f in schema]))
    return spark.createDataFrame(data, schema)


def money(*amounts):
    return [Decimal(a) if a is not None else None for a in amounts]


def days(*texts):
    return [date.fromisoformat(t) for t in texts]


def lake(spark, **given):
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLE_SCHEMAS.items()}
    return Tables(**{**empty, **given})


def values(df):
    return [tuple(r) for r in df.collect()]
