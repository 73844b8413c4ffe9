"""JSON functions on text columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def path_text(j: Column, *keys) -> Column:
    """#>>: the value at a path of keys and 0-based places, as text."""
    path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)
    return F.get_json_object(j, path)


def top_keys(j: Column) -> Column:
    """What ? looks at: an object's keys, an array's texts, or the text itself."""
    v = F.try_parse_json(j)
    kind = F.schema_of_variant(v)
    texts = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    found = F.when(kind.startswith("OBJECT"), F.json_object_keys(j)).when(kind.startswith("ARRAY"), F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")))
    return found.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.array().cast("array<string>"))


def exists(j: Column, key: str) -> Column:
    """? : the key is at the top of an object, an element of an array, or the text."""
    return F.when(j.isNotNull(), F.coalesce(F.array_contains(top_keys(j), key), F.lit(False)))


def exists_any(j: Column, keys: list[str]) -> Column:
    return F.when(j.isNotNull(), F.coalesce(F.arrays_overlap(top_keys(j), F.array(*map(F.lit, keys))), F.lit(False)))


def exists_all(j: Column, keys: list[str]) -> Column:
    return F.when(j.isNotNull(), F.size(F.array_intersect(top_keys(j), F.array(*map(F.lit, sorted(set(keys)))))) == len(set(keys)))


def contains_constant(j: Column, constant: str) -> Column:
    """@> with a constant right side, as native expressions over the parsed value; see contains for two columns."""

    def matcher(want):
        return lambda e: F.coalesce(holds(e, want), F.lit(False))

    def holds(v: Column, want, top: bool = False) -> Column:
        kind = F.schema_of_variant(v)
        if isinstance(want, dict):
            parts = [F.coalesce(holds(F.try_variant_get(v, f"$['{k}']", "variant"), x), F.lit(False)) for k, x in want.items()]
            out = kind.startswith("OBJECT")
            for p in parts:
                out = out & p
            return out
        if isinstance(want, list):
            elements, out = F.try_variant_get(v, "$", "array<variant>"), kind.startswith("ARRAY")
            for x in want:
                out = out & F.coalesce(F.exists(elements, matcher(x)), F.lit(False))
            return out
        if want is None:
            same = kind == "VOID"
        elif isinstance(want, bool):
            same = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == want)
        elif isinstance(want, str):
            same = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == want)
        else:
            same = ~kind.isin("STRING", "BOOLEAN") & (F.try_variant_get(v, "$", "decimal(38,9)") == F.lit(str(want)).cast("decimal(38,9)"))
        if not top:
            return same
        elements = F.try_variant_get(v, "$", "array<variant>")
        return F.when(kind.startswith("ARRAY"), F.exists(elements, matcher(want))).otherwise(same)

    return F.when(j.isNotNull(), F.coalesce(holds(F.parse_json(j), json.loads(constant), True), F.lit(False)))


def _holds(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _inside(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_inside(x, y) for x in a) for y in b)
    return type(a) is type(b) and a == b


def _inside(a, b) -> bool:
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    return _holds(a, b)


@F.pandas_udf(BooleanType())
def contains(a: pd.Series, b: pd.Series) -> pd.Series:
    """@> : deep containment; an array holds a bare scalar that it has, objects and others never hold each other."""

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = json.loads(x), json.loads(y)
        if isinstance(x, list) and not isinstance(y, (list, dict)):
            return any(_inside(e, y) for e in x)
        return _inside(x, y)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)


def each(j: Column) -> Column:
    """Key and text pairs of an object as an array of structs (for inline)."""
    return F.map_entries(F.from_json(j, "map<string,string>"))


def contained(a: Column, b: Column) -> Column:
    """<@ : the commuted containment."""
    return contains(b, a)


def elements(j: Column) -> Column:
    """The elements of an array as JSON texts (for explode)."""
    return F.transform(F.try_variant_get(F.try_parse_json(j), "$", "array<variant>"), lambda x: F.to_json(x))


def type_of(j: Column) -> Column:
    """typeof: object, array, string, number, boolean or null."""
    kind = F.schema_of_variant(F.parse_json(j))
    out = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
    return out.when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def populate_record(j: Column, schema: str) -> Column:
    """populate_record: a struct of the schema from an object's fields, null where it has none."""
    return F.from_json(j, schema)


def _changed(f):
    """An Arrow function over JSON texts that changes each parsed value; null stays null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json.dumps(f(json.loads(t)), ensure_ascii=False, separators=(",", ":")) for t in texts], dtype=object)

    return run


def strip_nulls(j: Column) -> Column:
    """Without object fields that are null, at all depths; nulls in arrays stay."""

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if v is not None}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return _changed(strip)(j)


def _placed(value, path: list, new, insert: bool, missing: bool, after: bool = False):
    """``value`` with ``new`` at the path; a path that leads nowhere leaves it as it is."""
    if not path:
        return new
    head, rest = path[0], path[1:]
    if isinstance(value, dict):
        if head in value:
            if not rest and insert:
                raise ValueError("cannot replace existing key")
            return value | {head: _placed(value[head], rest, new, insert, missing, after)}
        return value | {head: new} if not rest and missing else value
    if isinstance(value, list):
        i = int(head)
        at = i + len(value) if i < 0 else i
        if not rest and insert:
            at = min(max(at + after, 0), len(value))
            return [*value[:at], new, *value[at:]]
        if 0 <= at < len(value):
            return [*value[:at], _placed(value[at], rest, new, insert, missing, after), *value[at + 1 :]]
        return ([*value, new] if i >= 0 else [new, *value]) if not rest and missing else value
    return value


def set_path(j: Column, path: list, new: str, create_missing: bool = True) -> Column:
    """jsonb_set: the value at the path replaced by ``new`` (JSON), added if it is missing and that is wanted."""
    return _changed(lambda x: _placed(x, path, json.loads(new), False, create_missing))(j)


def insert_path(j: Column, path: list, new: str, after: bool = False) -> Column:
    """jsonb_insert: ``new`` before or after an array's place, or as a new key; an existing key fails."""
    return _changed(lambda x: _placed(x, path, json.loads(new), True, True, after))(j)


def _order(x) -> tuple:
    """Sort key of a value: null, texts, numbers, booleans, arrays, objects; shorter arrays and objects first."""
    if x is None:
        return (1,)
    if isinstance(x, str):
        return (2, x)
    if isinstance(x, bool):
        return (4, x)
    if isinstance(x, (int, float)):
        return (3, x)
    if isinstance(x, list):
        return (0 if not x else 5, len(x), [_order(e) for e in x])
    names = sorted(x, key=lambda k: (len(k.encode()), k))
    return (6, len(x), [(k, _order(x[k])) for k in names])


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the total order of JSON values."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None:
                return None
            u, v = _order(json.loads(p)), _order(json.loads(q))
            return (u > v) - (u < v)

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="Int32")

    return run(a, b)
