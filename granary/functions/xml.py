"""XML: elements from columns, and rows from documents by XPath."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def escape(value: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#x0d;")):
        value = F.replace(value, F.lit(sign), F.lit(entity))
    return value


def element(name: str, *content: Column, attributes: dict[str, Column] | None = None) -> Column:
    """xmlelement: content is XML already; null attributes are left out, null content counts as empty."""
    marks = [F.coalesce(F.concat(F.lit(f' {k}="'), F.replace(escape(v.cast("string")), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    inside = F.concat(*[F.coalesce(c, F.lit("")) for c in content]) if content else F.lit("")
    head = F.concat(F.lit(f"<{name}"), *marks)
    return F.when(inside == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inside, F.lit(f"</{name}>")))


def forest(**values: Column) -> Column:
    """xmlforest: an element per value; nulls are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"<{k}>"), escape(v.cast("string")), F.lit(f"</{k}>")), F.lit("")) for k, v in values.items()])


def concat(*values: Column) -> Column:
    """xmlconcat: nulls are passed over; null if all are."""
    whole = F.concat(*[F.coalesce(v, F.lit("")) for v in values])
    return F.when(F.coalesce(*values).isNotNull(), whole)


def agg(value: Column, order: Column) -> Column:
    """xmlagg: fragments in order, nulls passed over."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), "")


def row_elements(df: DataFrame, row: str = "row", nulls: bool = False) -> DataFrame:
    """table_to_xml and query_to_xml by rows: one fragment per row in the column ``xml``, an element per column.

    Nulls are left out, or marked xsi:nil with ``nulls``. A document of all rows is text files of these fragments
    between a head and a tail; no task ever holds the table.
    """
    nil = ' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"' if nulls else ""
    cells = []
    for c in df.columns:
        cell = F.concat(F.lit(f"<{c}>"), escape(F.col(f"`{c}`").cast("string")), F.lit(f"</{c}>"))
        cells.append(F.coalesce(cell, F.lit(f'<{c} xsi:nil="true"/>' if nulls else "")))
    return df.select(F.concat(F.lit(f"<{row}{nil}>"), *cells, F.lit(f"</{row}>")).alias("xml"))


def xpath(document: Column, path: str) -> Column:
    """The texts at a path, as an array."""
    return F.xpath(document, F.lit(path))


def xpath_list(document: Column, path: str, separator: str = ",") -> Column:
    """xml2: the texts at a path in one string."""
    return F.array_join(F.xpath(document, F.lit(path)), separator)


def xpath_exists(document: Column, path: str) -> Column:
    """Whether a path finds a node."""
    return F.xpath_boolean(document, F.lit(path))


def _schema(paths: list[list[str]]) -> str:
    """DDL of a struct that has a text field at each path."""
    below: dict[str, list[list[str]]] = {}
    for p in paths:
        below.setdefault(p[0], []).append(p[1:])
    parts = []
    for name, rest in below.items():
        deeper = [r for r in rest if r]
        parts.append(f"`{name}`: " + (_schema(deeper) if deeper else "STRING"))
    return f"STRUCT<{', '.join(parts)}>"


def table_rows(df: DataFrame, document: str, row_path: str, columns: dict[str, tuple[str, str, object]], *, required: tuple[str, ...] = (), ordinality: str | None = None) -> DataFrame:
    """XMLTABLE: a row per node of ``row_path``, columns name -> (path, type, default).

    ``row_path`` is '/root/.../row' (only the last step may repeat); a column's path is steps, '@attribute' or '.' for
    the row's own text (for rows without children). A null row path or column path fails; so does a required column
    without a value.
    """
    if row_path is None:
        raise ValueError("row filter expression must not be null")
    if any(path is None for path, *_ in columns.values()):
        raise ValueError("column filter expression must not be null")
    steps = row_path.strip("/").split("/")
    places = {name: ["_VALUE"] if path == "." else [x.replace("@", "_", 1) for x in path.split("/")] for name, (path, *_) in columns.items()}
    fields = _schema(list(places.values()) + [["_unused"]])
    schema = f"ARRAY<{fields}>"
    for step in reversed(steps[1:]):
        schema = f"STRUCT<`{step}`: {schema}>"
    parsed = F.from_xml(F.col(document), StructType.fromDDL(schema[len("STRUCT<") : -1].replace(": ", " ", 1)), {"mode": "FAILFAST"})
    nodes = parsed
    for step in steps[1:]:
        nodes = nodes.getField(step)
    rows = df.select(*[c for c in df.columns if c != document], F.posexplode(nodes).alias("_k", "_node"))
    out = []
    for name, (_, kind, default) in columns.items():
        value = F.col("_node")
        for step in places[name]:
            value = value.getField(step)
        value = F.coalesce(value.cast(kind), F.lit(default).cast(kind))
        if name in required:
            value = F.coalesce(value, F.raise_error(F.lit(f'null is not allowed in column "{name}"')).cast(kind))
        out.append(value.alias(name))
    if ordinality:
        out.append((F.col("_k") + 1).cast("long").alias(ordinality))
    return rows.select(*[c for c in df.columns if c != document], *out)
