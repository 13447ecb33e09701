"""Nested records: paths through structs and arrays, profiles and schemas by path, and checks with the path in every error.

A path names struct fields with dots and elements of arrays with brackets: `a.b[].c` is the field c
of every element of the array b in a. Records are structs and arrays, or JSON text, which becomes
such by the type that all rows together have (`schema_of_variant_agg`, one aggregate). Checks go
through a row's arrays where they are, once for all rules of what lies in them, and multiply no
rows; profiles take places as rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegralType, StructType

from tributary.functions import text as t
from tributary.operators.schemas import LADDER, Field, kind_of, typed

ROOT = ""


def from_json(rows: DataFrame, column: str) -> DataFrame:
    """rows with a JSON text column as structs and arrays, by the type that holds all rows' values; text that is no JSON becomes null.

    Where rows disagree on a value's type, or a value is always null, it stays text.
    """
    variant = F.try_parse_json(column)
    found = rows.agg(F.schema_of_variant_agg(variant)).first()[0] or "VOID"
    kind = re.sub(r"\bVOID\b|\bVARIANT\b", "STRING", found.replace("OBJECT<", "STRUCT<"))
    kind = re.sub(r"\bDECIMAL\(\d+, ?\d+\)|\bFLOAT\b", "DOUBLE", kind)
    if not re.match(r"(STRUCT|ARRAY)<.", kind) or "STRUCT<>" in kind:
        return rows.withColumn(column, F.when(variant.isNotNull(), F.col(column)))
    return rows.withColumn(column, F.from_json(F.when(variant.isNotNull(), F.col(column)), kind))


def paths(kind: DataType, at: str = ROOT) -> list[tuple[str, DataType]]:
    """(path, type) of everything below a type, in order; containers before what they hold."""
    out = []
    if isinstance(kind, StructType):
        for f in kind.fields:
            name = f"{at}.{f.name}" if at else f.name
            out += [(name, f.dataType), *paths(f.dataType, name)]
    elif isinstance(kind, ArrayType):
        out += [(f"{at}[]", kind.elementType), *paths(kind.elementType, f"{at}[]")]
    return out


def steps(path: str) -> list[str]:
    """The steps of a path: field names, and `[]` for all elements."""
    return [s for part in path.split(".") for s in (*filter(None, [part.split("[")[0]]), *["[]"] * part.count("[]"))]


def values(path: str) -> Column:
    """An array of a path's values in a row, nulls included where the place is there and the value is not."""
    *before, last = steps(path)
    if not before:
        return F.array(F.col(f"`{last}`"))
    below = F.filter(_walk(before), lambda x: x.isNotNull())
    return F.flatten(below) if last == "[]" else F.transform(below, _field(last))


def _walk(way: Sequence[str]) -> Column:
    at = F.array(F.col(f"`{way[0]}`"))
    for step in way[1:]:
        there = F.filter(at, lambda x: x.isNotNull())
        at = F.flatten(there) if step == "[]" else F.transform(there, _field(step))
    return at


def _field(name: str):
    return lambda x: x[name]


def _array(path: str) -> Column:
    """The array whose elements an array's path (`p[]`) names; for arrays in arrays, all their elements."""
    first, *before = steps(path)[:-1]
    if "[]" in before:
        return values(path)
    at = F.col(f"`{first}`")
    for step in before:
        at = at[step]
    return at


def _reached(path: str, holder: str, element: Column | None) -> tuple[Column, Column]:
    """Whether a path's place is there in an element of its innermost array (in a row, without one), and its value."""
    there, at = F.lit(True), element
    for step in steps(path[len(holder) :]):
        if at is None:
            at = F.col(f"`{step}`")
        else:
            there, at = at.isNotNull(), at[step]
    return there, at


def _holder(path: str) -> str:
    """The path of the innermost array's elements that a path lies in; empty without one."""
    return path[: path.rindex("[]") + 2] if "[]" in path else ""


def _by_holder(found: Sequence[tuple]) -> dict[str, list[tuple]]:
    """Tuples that begin with a path by the array whose elements hold it."""
    out: dict[str, list[tuple]] = {}
    for entry in found:
        out.setdefault(_holder(entry[0]), []).append(entry)
    return out


def _whole(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def _cell(path: str, kind: DataType, there: Column, v: Column) -> Column:
    """(path, there, of, v, number) of a place: its kind and number where its type tells them, else its text only."""
    none = F.lit(None)
    if isinstance(kind, (StructType, ArrayType)):
        of, v, number = F.when(v.isNotNull(), F.lit("array" if isinstance(kind, ArrayType) else "object")), none, none
    elif _whole(kind):
        of, number = F.when(v.isNotNull(), F.lit("integer")), v
    elif isinstance(kind, DoubleType):
        real = ~F.isnan(v) & (F.abs(v) != float("inf"))
        of, number = F.when(v.isNotNull(), F.when(real, F.lit("float")).otherwise(F.lit("string"))), F.when(real, v)
    else:
        of, number = none, none
    return F.struct(F.lit(path).alias("path"), there.alias("there"), F.lit(not isinstance(kind, (StructType, ArrayType))).alias("leaf"), of.cast("string").alias("of"), v.cast("string").alias("v"), number.cast("double").alias("number"))


def _measures(rows: DataFrame, found: Sequence[tuple[str, DataType]], forms: bool) -> DataFrame:
    """A row for each path: what profile gives, and with forms also whether all its values have each of FORMS.

    Elements of arrays and places in them are rows for as long as they are counted: by path and kind
    first, which is a partial aggregate of few groups. No step does so much in one go that its code
    would be too long to be compiled.
    """
    cells = None
    for holder, entries in _by_holder(found).items():
        at = rows.select(F.explode(_array(holder)).alias("x")) if holder else rows
        some = F.array(*[_cell(path, kind, *_reached(path, holder, F.col("x") if holder else None)) for path, kind in entries])
        at = at.select(F.inline(some)).where("there").drop("there")
        cells = at if cells is None else cells.unionByName(at)
    open_ = F.col("leaf") & F.col("of").isNull() & F.col("v").isNotNull()  # nothing but the text tells
    cells = cells.withColumn("text", F.when(open_, t.strip(F.col("v"))))
    cells = cells.withColumn("kind", F.when(open_, kind_of(F.col("text"))).otherwise(F.col("of")))
    cells = cells.withColumn("number", F.when(open_ & F.col("kind").isin("integer", "float"), F.col("v").try_cast("double")).otherwise(F.col("number")))
    shapes = [(name, F.when(open_, t.py_match(F.col("v"), form)).otherwise(F.when(F.col("v").isNotNull(), F.lit(False)))) for name, form in FORMS] if forms else []  # numbers have none
    measured = {"shortest": F.min, "longest": F.max, "low": F.min, "high": F.max} | {name: F.bool_and for name, _ in shapes}
    cells = cells.select("path", "kind", F.length("v").alias("shortest"), F.length("v").alias("longest"), F.col("number").alias("low"), F.col("number").alias("high"), *[test.alias(name) for name, test in shapes])
    by_kind = cells.groupBy("path", "kind").agg(F.count("*").alias("n"), *[f(name).alias(name) for name, f in measured.items()])
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return by_kind.groupBy("path").agg(
        F.sum("n").alias("total"),
        n(F.col("kind").isNull()).alias("nulls"),
        *[n(F.col("kind") == k).alias(k) for k in [k for k, _ in LADDER] + ["string", "array", "object"]],
        *[F.coalesce(f(name), F.lit(True)).alias(name) if f is F.bool_and else f(name).alias(name) for name, f in measured.items()],
    )


def profile(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(path, total, nulls, one count for each kind, shortest, longest, low, high) of every path, in one aggregate over all rows.

    total counts the places of a path that are there: a field of a missing struct, or of elements of
    an empty array, has none.
    """
    schema = StructType([f for f in rows.schema.fields if f.name in columns]) if columns is not None else rows.schema
    return _measures(rows, paths(schema), False)


# Forms that strings of one column may share, most particular first.
FORMS = (
    ("uuid", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+$"),
    ("url", r"https?://\S+$"),
    ("phone", r"\+?[0-9][0-9() -]{6,}[0-9]$"),
    ("upper_code", r"[A-Z]+[-_#]?[0-9]+$"),
)


def infer(rows: DataFrame, threshold: float = 0.95) -> list[Field]:
    """A field for each path: its most frequent kind, bounds, and whether so many of its places have a value; a form if all its strings share one."""
    found = paths(rows.schema)
    by_path = {r["path"]: r for r in _measures(rows, found, True).collect()}  # one row for each path
    out = []
    for path, kind in found:
        r = by_path.get(path)
        nested = "array" if isinstance(kind, ArrayType) else "object" if isinstance(kind, StructType) else None
        if r is None or r["total"] == r["nulls"]:
            out.append(Field(path, nested or "string", False, True))
            continue
        best = nested or max([k for k, _ in LADDER] + ["string"], key=lambda k: r[k])  # noqa: B023
        number, text = best in ("integer", "float"), best == "string"
        form = next((f for name, f in FORMS if r[name]), None) if text else None
        out.append(Field(path, best, 1 - r["nulls"] / r["total"] >= threshold, r["nulls"] > 0, pattern=form, low=r["low"] if number else None, high=r["high"] if number else None, shortest=r["shortest"] if text else None, longest=r["longest"] if text else None))
    return sorted(out, key=lambda f: f.name)


def _valued(v: Column, kind: DataType, wanted: str) -> Column:
    """A value as a field's kind, by its text unless its type is that kind's."""
    if wanted == "float" and (_whole(kind) or isinstance(kind, DoubleType)):
        return v.cast("double")
    return v.cast("long") if wanted == "integer" and _whole(kind) else typed(v.cast("string"), wanted)


def _tests(f: Field, kind: DataType) -> list[tuple]:
    """(error, test of a value) of a field's rules."""
    value, text = lambda v: _valued(v, kind, f.kind), lambda v: v.cast("string")
    found = [("wrong_type", lambda v: v.isNotNull() & value(v).isNull())]
    if f.kind in ("integer", "float"):
        found += [("too_small", lambda v: value(v) < f.low)] if f.low is not None else []
        found += [("too_large", lambda v: value(v) > f.high)] if f.high is not None else []
    found += [("too_short", lambda v: F.length(text(v)) < f.shortest)] if f.shortest is not None else []
    found += [("too_long", lambda v: F.length(text(v)) > f.longest)] if f.longest is not None else []
    found += [("wrong_pattern", lambda v: ~t.py_match(text(v), f.pattern))] if f.pattern else []
    return found + ([("not_allowed", lambda v: ~text(v).isin(list(f.values)))] if f.values is not None else [])


def errors(rows: DataFrame, schema: Sequence[Field], extra: bool = True) -> DataFrame:
    """rows with errors: (path, error, n), n places of a path that break a rule, in the order of the schema.

    A required path must have a value wherever what holds it is there: `a.b` if a is, `a[].b` in
    every element. A path that the type lacks misses all its places; without `extra`, a path of
    the type that the schema lacks is unknown. The elements of an array are gone through once, for
    all rules of what lies in them.
    """
    types = dict(paths(rows.schema))
    found: list[tuple] = []  # (path that is looked at, path that is named, error, test)
    there = lambda v: v.isNotNull()
    for f in schema:
        if f.name not in types:
            holder = f.name.rpartition(".")[0]
            if f.required and f.default is None and (not holder or holder in types):
                found.append((holder, f.name, "missing_required", there if holder else None))
            continue
        kind = types[f.name]
        if f.required and f.default is None:
            found.append((f.name, f.name, "missing_required", lambda v: v.isNull()))
        if isinstance(kind, (StructType, ArrayType)):
            if f.kind not in ("any", "array" if isinstance(kind, ArrayType) else "object"):
                found.append((f.name, f.name, "wrong_type", there))
        elif f.kind in ("array", "object"):
            found.append((f.name, f.name, "wrong_type", there))
        else:
            found += [(f.name, f.name, error, test) for error, test in _tests(f, kind)]
    if not extra:
        known = {f.name for f in schema}
        found += [(path, path, "unknown_field", there) for path in types if path not in known and not path.startswith("_") and not path.endswith("[]")]
    if not found:
        return rows.withColumn("errors", F.array().cast("array<struct<path:string,error:string,n:int>>"))

    def hit(entry: tuple, holder: str, element: Column | None) -> Column:
        path, _, _, test = entry
        if test is None:
            return F.lit(1)
        place, value = _reached(path, holder, element)
        return (place & F.coalesce(test(value), F.lit(False))).cast("int")

    def sums(holder: str, chosen: Sequence[int]):
        return lambda n, x: F.struct(*[(n[f"n{k}"] + hit(found[k], holder, x)).alias(f"n{k}") for k in chosen])

    counted, places = [], {}
    for i, (holder, entries) in enumerate(_by_holder([(e[0], k) for k, e in enumerate(found)]).items()):
        chosen = [k for _, k in entries]
        places |= {k: F.col(f"__n{i}")[f"n{k}"] for k in chosen}
        if holder:
            counted.append(F.aggregate(_array(holder), F.struct(*[F.lit(0).alias(f"n{k}") for k in chosen]), sums(holder, chosen)).alias(f"__n{i}"))
        else:
            counted.append(F.struct(*[hit(found[k], "", None).alias(f"n{k}") for k in chosen]).alias(f"__n{i}"))
    said = [F.when(places[k] > 0, F.struct(F.lit(name).alias("path"), F.lit(error).alias("error"), places[k].alias("n"))) for k, (_, name, error, _) in enumerate(found)]
    return rows.select("*", *counted).select(*[F.col(f"`{c}`") for c in rows.columns], F.array_compact(F.array(*said)).alias("errors"))


def error_counts(checked: DataFrame) -> DataFrame:
    """(path, error, rows, places) over all rows."""
    # the outer form, since Spark tests the size of an inner one's array beforehand, for which it makes all errors again and again
    return checked.select(F.inline_outer("errors")).where("path is not null").groupBy("path", "error").agg(F.count("*").alias("rows"), F.sum("n").alias("places"))
