"""CSV files: schema inference, reading, ingesting into tables and exporting queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INTEGER, _NUMBER = r"^[+-]?\d{1,18}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _number(c: str) -> Column:
    """A column's text without what numbers are dressed in: spaces, $ , % and parentheses for minus."""
    value = F.regexp_replace(F.trim(F.col(f"`{c}`")), r"^\((.+)\)$", "-$1")
    return F.regexp_replace(value, "[$,%\ufeff\u00a0]", "")


def _text(spark: SparkSession, path: str, header: bool, delimiter: str, null_token: str | None) -> DataFrame:
    options = {"header": header, "sep": delimiter, "inferSchema": False, "mode": "PERMISSIVE", "multiLine": False, "quote": '"', "escape": '"'}
    return spark.read.options(**options, **({"nullValue": null_token} if null_token is not None else {})).csv(path)


def infer_schema(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", null_token: str | None = None) -> dict[str, str]:
    """Types of the columns from all rows: bigint, double or string.

    A column is numeric if all its values are, aside from what ``_number`` takes off.
    """
    rows = _text(spark, path, header, delimiter, null_token)
    checks = []
    for i, c in enumerate(rows.columns):
        value = _number(c)
        checks += [F.count(value).alias(f"n{i}"), F.count_if(value.rlike(_INTEGER)).alias(f"i{i}"), F.count_if(value.rlike(_NUMBER)).alias(f"d{i}")]
    found = rows.agg(*checks).first()
    kinds = {}
    for i, c in enumerate(rows.columns):
        n = found[f"n{i}"]
        kinds[c] = "bigint" if n and found[f"i{i}"] == n else "double" if n and found[f"d{i}"] == n else "string"
    return kinds


def read_csv(spark: SparkSession, path: str, schema: dict[str, str] | None = None, header: bool = True, delimiter: str = ",", null_token: str | None = None) -> DataFrame:
    """A CSV file or folder with inferred or given types; a value that isn't of its given type is NULL."""
    rows = _text(spark, path, header, delimiter, null_token)
    kinds = schema or infer_schema(spark, path, header, delimiter, null_token)
    names = list(kinds)

    def typed(c: str, kind: str) -> Column:
        if kind == "string":
            return F.col(f"`{c}`")
        value = _number(c) if kind.startswith(_NUMERIC) else F.trim(F.col(f"`{c}`"))
        return value.try_cast(kind) if schema else value.cast(kind)

    return rows.toDF(*names).select(*[typed(c, k).alias(c) for c, k in kinds.items()])


def ingest_csv(session, path: str, table: str, mapping: dict[str, str] | None = None, **options) -> int:
    """Append a CSV file to a table, creating it if it is not there; ``mapping``: file to table columns."""
    from tidewater.catalog import Column as TableColumn
    from tidewater.catalog import Table
    from tidewater.operators import dml

    rows = read_csv(session.spark, path, **options)
    for old, new in (mapping or {}).items():
        rows = rows.withColumnRenamed(old, new)
    key = session.key(table.split("."))
    session.flush()
    if key not in session.state.tables:
        return dml.insert_frame(session, Table(key, tuple(TableColumn(f.name, f.dataType.simpleString()) for f in rows.schema)), (), rows, fresh=True)
    return dml.insert_frame(session, session.table(key), tuple(rows.columns), rows)


def export_csv(frame: DataFrame, path: str, columns: dict[str, Column | str] | None = None, where: Column | str | None = None, header: bool = True, delimiter: str = ",", null_token: str = "") -> None:
    """Write rows as CSV part files; ``columns``: output names and what they hold."""
    rows = frame.where(where) if where is not None else frame
    if columns:
        rows = rows.select(*[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in columns.items()])
    rows.write.mode("overwrite").options(header=header, sep=delimiter, nullValue=null_token, emptyValue='""', quote='"', escape='"').csv(path)
