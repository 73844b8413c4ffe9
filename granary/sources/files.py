"""COPY: delimited text in and out, and generic table files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Signs that the text format writes with a backslash (fixed values).
ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r", "\b": "\\b", "\f": "\\f", "\v": "\\v"}
#: What stands behind a backslash for another sign (fixed values).
LETTERS = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}
#: A sign of the text format: an escape (octal, hexadecimal or any sign) or any other sign.
SIGN = r"\\[0-7]{1,3}|\\x[0-9A-Fa-f]{1,2}|\\.|[^\\]|\\$"


def _escaped(value: Column, delimiter: str) -> Column:
    for sign, written in ESCAPES.items():
        value = F.replace(value, F.lit(sign), F.lit(written))
    return value if delimiter in ESCAPES else F.replace(value, F.lit(delimiter), F.lit("\\" + delimiter))


def _read_sign(s: Column) -> Column:
    code = F.when(s.rlike(r"^\\[0-7]"), F.conv(F.substring(s, 2, 3), 8, 10)).when(s.rlike(r"^\\x[0-9A-Fa-f]"), F.conv(F.substring(s, 3, 2), 16, 10))
    out = F.when(code.isNotNull(), F.char(code.cast("int")))
    for letter, sign in LETTERS.items():
        out = out.when(s == "\\" + letter, F.lit(sign))
    return out.when((F.length(s) == 2) & F.startswith(s, F.lit("\\")), F.substring(s, 2, 1)).otherwise(s)


def _unescaped(value: Column) -> Column:
    """Escapes are read from left to right, a sign at a time; cells without a backslash stay as they are."""
    signs = F.regexp_extract_all(value, F.lit("(?s)" + SIGN), 0)
    return F.when(F.contains(value, F.lit("\\")), F.array_join(F.transform(signs, _read_sign), "")).otherwise(value)


def _cells(line: Column, sep: str) -> Column:
    """Cells of a line of the text format: delimiters behind a backslash don't part them."""
    d = re.escape(sep)
    whole = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(rf"(?s)((?:\\.|(?!{d})[^\\])*){d}"), 1)
    return F.when(F.contains(line, F.lit("\\")), whole).otherwise(F.split(line, d, -1))


#: Stands for a quoted empty cell while a csv file is read.
EMPTY = "\x01\x02 quoted and empty \x02\x01"


def copy_from(spark: SparkSession, path: str, schema: str, *, format: str = "csv", delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None, force_null: bool = False, bad_rows: str = "fail") -> DataFrame:
    """COPY FROM: text (tab, \\N) or csv (comma, empty is null unless quoted); malformed rows fail or are dropped or kept as null.

    Cells of csv may hold line breaks; a quoted empty cell is an empty text unless ``force_null``.
    """
    if format == "text":
        sep, none = delimiter or "\t", "\\N" if null is None else null
        fields = StructType.fromDDL(schema).fields
        parts = _cells(F.col("value"), sep)
        wrong = F.when(F.size(parts) != len(fields), F.raise_error(F.lit("wrong number of columns")).cast("string"))
        cells = [F.get(parts, F.lit(i)) if bad_rows != "fail" else wrong.otherwise(F.get(parts, F.lit(i))) for i in range(len(fields))]
        texts = [F.when(c != none, _unescaped(c)) for c in cells]
        lines = spark.read.text(path)
        lines = lines.filter(F.size(parts) == len(fields)) if bad_rows == "drop" else lines
        return lines.select(*[(t.cast(f.dataType) if bad_rows == "fail" else t.try_cast(f.dataType)).alias(f.name) for t, f in zip(texts, fields)])
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "null": "PERMISSIVE"}[bad_rows]
    reader = spark.read.schema(schema).option("header", header).option("mode", mode).option("enforceSchema", True)
    reader = reader.option("multiLine", True).option("sep", delimiter or ",").option("quote", quote).option("escape", escape or quote)
    fields = StructType.fromDDL(schema).fields
    if null is not None:
        reader = reader.option("nullValue", null).option("emptyValue", "")
        return reader.csv(path)
    # an empty cell is null and a quoted one, read as a mark that no cell can be, is empty
    found = reader.option("nullValue", "").option("emptyValue", EMPTY).csv(path)
    back = lambda f: F.when(F.col(f.name) != EMPTY, F.col(f.name)).when(F.col(f.name) == EMPTY, F.lit(None if force_null else ""))
    return found.select(*[back(f).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in fields])


def copy_to(df: DataFrame, path: str, *, format: str = "csv", delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', force_quote: bool = False) -> None:
    """COPY TO of a table or query; parts are written in parallel."""
    if format == "text":
        sep, none = delimiter or "\t", "\\N" if null is None else null
        cells = [F.coalesce(_escaped(F.col(c).cast("string"), sep), F.lit(none)) for c in df.columns]
        df.select(F.concat_ws(sep, *cells).alias("value")).write.text(path)
        return
    writer = df.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("header", header).option("sep", delimiter or ",").option("nullValue", "" if null is None else null)
    writer.option("quote", quote).option("escape", quote).option("quoteAll", force_quote).option("emptyValue", quote * 2).csv(path)


def foreign_table(spark: SparkSession, format: str, **options) -> DataFrame:
    """A table outside: any data source by name; filters and columns are pushed where the source takes them."""
    return spark.read.format(format).options(**options).load()


def jdbc_table(spark: SparkSession, url: str, table: str, *, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table on another server: filters, projections, aggregates, limits and joins are pushed to it where it can run them.

    ``partition`` is (column, lowest, highest, number): so many ranges of the column are read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    for push in ("pushDownPredicate", "pushDownAggregate", "pushDownLimit", "pushDownOffset"):
        reader = reader.option(push, True)
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.load()


def remote_query(spark: SparkSession, url: str, sql: str, **options) -> DataFrame:
    """The rows of a query that another server runs."""
    return spark.read.format("jdbc").option("url", url).option("query", sql).options(**options).load()


def large_objects(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, length, content); read a stretch of one with substring of its content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def materialized_view(df: DataFrame, path: str, with_data: bool = True) -> DataFrame:
    """Write a query's result and read it; REFRESH is writing again."""
    (df if with_data else df.limit(0)).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
