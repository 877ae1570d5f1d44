"""Declared columns of every table. Struct types, select lists and null rules derive from these lists."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type words of the declared schema and the Spark type each stands for.
SPARK_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "float": T.DoubleType(),
    "int": T.LongType(),
    "boolean": T.BooleanType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = True

    @property
    def spark_type(self) -> T.DataType:
        if self.kind not in SPARK_TYPES:
            raise ValueError(f"unknown column type {self.kind!r} for {self.name!r}")
        return SPARK_TYPES[self.kind]


# The canonical price columns, in order.
PRICES = (
    Field("ticker", "string", False),
    Field("date", "date", False),
    Field("open", "float"),
    Field("high", "float"),
    Field("low", "float"),
    Field("close", "float"),
    Field("volume", "int"),
    Field("source", "string", False),
    Field("fetched_at", "datetime", False),
    Field("raw_checksum", "string", False),
)
RETURNS = (
    Field("ticker", "string", False),
    Field("date", "date", False),
    Field("return_value", "float", False),
    Field("return_type", "string", False),
    Field("created_at", "datetime", False),
)
SNAPSHOT_CATALOG = (
    Field("id", "string", False),
    Field("ticker", "string"),
    Field("created_at", "datetime"),
    Field("payload", "string"),
    Field("snapshot_path", "string"),
    Field("rows", "int"),
    Field("checksum", "string"),
    Field("job_id", "string"),
    Field("size_bytes", "int"),
    Field("archived", "boolean"),
    Field("archived_at", "datetime"),
)
JOB_LOG = (
    Field("job_id", "string", False),
    Field("ticker", "string"),
    Field("source", "string"),
    Field("status", "string"),
    Field("started_at", "datetime"),
    Field("finished_at", "datetime"),
    Field("rows", "int"),
    Field("error_message", "string"),
    Field("extras", "string"),
)
PRICE_KEY = ("ticker", "date")
RETURN_KEY = ("ticker", "date", "return_type")
OHLC = ("open", "high", "low", "close")
FEED_COLUMNS = (*OHLC, "volume")
# Columns that change on every pull and so never count as a change of a bar.
VOLATILE = ("fetched_at", "raw_checksum")

ERROR_TYPE = "struct<column:string,reason_code:string,reason_message:string,failure_value:string>"


def struct_type(fields: tuple[Field, ...], text: bool = False) -> T.StructType:
    """The StructType of a field list; ``text=True`` reads every column as a string.

    Columns are declared nullable because files do not carry the constraint; the rules check it.
    """
    return T.StructType([T.StructField(f.name, T.StringType() if text else f.spark_type) for f in fields])


def names(fields: tuple[Field, ...]) -> list[str]:
    return [f.name for f in fields]


def required(fields: tuple[Field, ...]) -> list[str]:
    return [f.name for f in fields if not f.nullable]


def fields_from_json(text: str) -> tuple[Field, ...]:
    """Read a declared schema ``{"columns": [{"name", "type", "nullable"}, ...]}``."""
    fields = tuple(
        Field(c["name"], c["type"], bool(c.get("nullable", True))) for c in json.loads(text)["columns"]
    )
    for field in fields:
        field.spark_type  # an unknown type raises here, before any job starts
    return fields


def fields_to_json(fields: tuple[Field, ...]) -> str:
    """The declared schema as :func:`fields_from_json` reads it."""
    return json.dumps({"columns": [{"name": f.name, "type": f.kind, "nullable": f.nullable} for f in fields]})


def conform(df: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Select the declared columns in order; a missing nullable column becomes nulls."""
    missing = [f.name for f in fields if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"missing required columns {missing}; got {df.columns}")
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.spark_type).alias(f.name)
            for f in fields
        )
    )


def no_nan(value: Column) -> Column:
    """Turn NaN into null at the edge, so that both mean "no value" from then on."""
    return F.when(~F.isnan(value), value)
