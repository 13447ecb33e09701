"""Schemas of records: inference, compatibility, validation and migration.

A schema is a list of Field. Inference is one aggregate over the whole table; everything about two
schemas is plain Python over their few fields; records are checked and migrated as columns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import text as t

# How strings of a type look, and which changes of type keep or lose values.
LADDER = (
    ("datetime", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
    ("date", r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"),
    ("integer", r"[+-]?\d+$"),
    ("float", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
    ("boolean", r"(?i)(true|false|yes|no)$"),
)
WIDER = {
    "integer": {"float", "string", "any"},
    "float": {"string", "any"},
    "boolean": {"string", "integer", "any"},
    "date": {"datetime", "string", "any"},
    "datetime": {"string", "any"},
    "string": {"any"},
    "array": {"any"},
    "object": {"any"},
}
NARROWER = {
    "any": {"string", "integer", "float", "boolean", "date", "datetime", "array", "object"},
    "string": {"integer", "float", "boolean", "date", "datetime"},
    "float": {"integer"},
    "datetime": {"date"},
}
SPARK = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    nullable: bool = True
    default: str | None = None
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    shortest: int | None = None
    longest: int | None = None
    values: tuple | None = None


def kind_of(c: Column) -> Column:
    """The type that a string looks like; null for null."""
    text = t.strip(c)
    out = None
    for kind, form in LADDER:
        out = F.when(t.py_match(text, form), kind) if out is None else out.when(t.py_match(text, form), kind)
    return F.when(c.isNotNull(), out.otherwise("string"))


def profile(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, total, nulls, one count for each kind, shortest, longest, low, high) of each column, in one pass over all rows."""
    columns = [c for c in (columns or rows.columns) if not c.startswith("_")]
    kinds = [k for k, _ in LADDER] + ["string"]
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    cells = rows.select(F.inline(cells)).withColumn("kind", kind_of(F.col("v")))
    v, number = F.col("v"), F.when(F.col("kind").isin("integer", "float"), F.col("v").try_cast("double"))
    return cells.groupBy("field").agg(
        F.count("*").alias("total"),
        F.count_if(v.isNull()).alias("nulls"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
        F.min(F.length(v)).alias("shortest"),
        F.max(F.length(v)).alias("longest"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
    )


def infer(rows: DataFrame, threshold: float = 0.95) -> list[Field]:
    """The most frequent kind of each column; required if that many of its values are there."""
    out = []
    for r in profile(rows).collect():  # one row for each column
        kind = max([k for k, _ in LADDER] + ["string"], key=lambda k: r[k]) if r["total"] > r["nulls"] else "string"
        filled = 1 - r["nulls"] / r["total"] if r["total"] else 0
        number = kind in ("integer", "float")
        out.append(
            Field(
                r["field"], kind, filled >= threshold, r["nulls"] > 0, low=r["low"] if number else None, high=r["high"] if number else None,
                shortest=r["shortest"] if kind == "string" else None, longest=r["longest"] if kind == "string" else None,
            )
        )
    out += [Field(c) for c in rows.columns if not c.startswith("_") and c not in {f.name for f in out}]  # no rows at all
    return sorted(out, key=lambda f: f.name)


def fingerprint(schema: Sequence[Field]) -> str:
    return hashlib.sha256(json.dumps([asdict(f) for f in sorted(schema, key=lambda f: f.name)], sort_keys=True).encode()).hexdigest()[:32]


def compatible(old: Sequence[Field], new: Sequence[Field], mode: str = "backward") -> list[str]:
    """What breaks compatibility; empty if nothing does. mode: none, backward, forward or full.

    Backward: the new schema reads old data. Forward: the old schema reads new data.
    """
    if mode == "none":
        return []
    if mode.startswith("full"):
        return compatible(old, new, "backward") + compatible(old, new, "forward")
    if mode.startswith("forward"):
        return [f"forward: {x.removeprefix('backward: ')}" for x in compatible(new, old, "backward")]
    before, after, out = {f.name: f for f in old}, {f.name: f for f in new}, []
    for name, f in after.items():
        if name not in before and f.required and f.default is None:
            out.append(f"backward: {name} is required and has no default")
    for name in before.keys() & after.keys():
        a, b = before[name], after[name]
        if a.kind != b.kind and b.kind not in WIDER.get(a.kind, set()):
            out.append(f"backward: {name} changes from {a.kind} to {b.kind}" + (", which loses values" if b.kind in NARROWER.get(a.kind, set()) else ""))
        if b.required and not a.required and b.default is None:
            out.append(f"backward: {name} becomes required")
        if a.nullable and not b.nullable and b.default is None:
            out.append(f"backward: {name} is no longer nullable")
        tighter = [
            (a.low, b.low, lambda x, y: y > x), (a.high, b.high, lambda x, y: y < x), (a.shortest, b.shortest, lambda x, y: y > x), (a.longest, b.longest, lambda x, y: y < x),
        ]
        if any(y is not None and (x is None or worse(x, y)) for x, y, worse in tighter) or (b.pattern and b.pattern != a.pattern):
            out.append(f"backward: {name} has tighter bounds")
        if b.values is not None and not (a.values is not None and set(a.values) <= set(b.values)):
            out.append(f"backward: {name} allows fewer values")
    return sorted(out)


def transitive(versions: Sequence[Sequence[Field]], new: Sequence[Field], mode: str = "backward") -> list[str]:
    return [x for old in versions for x in compatible(old, new, mode)]


def compare(old: Sequence[Field], new: Sequence[Field]) -> dict[str, list[str]]:
    before, after = {f.name: f for f in old}, {f.name: f for f in new}
    return {
        "added": sorted(after.keys() - before.keys()),
        "removed": sorted(before.keys() - after.keys()),
        "changed": sorted(n for n in before.keys() & after.keys() if before[n] != after[n]),
    }


def typed(c: Column, kind: str) -> Column:
    """A string column as a kind; null where it cannot be one."""
    if kind == "boolean":
        return F.when(F.lower(t.strip(c)).isin("true", "yes", "1"), True).when(F.lower(t.strip(c)).isin("false", "no", "0"), False)
    return c if kind in ("string", "any", "array", "object") else t.strip(c).try_cast(SPARK[kind])


def errors(rows: DataFrame, schema: Sequence[Field], extra: bool = True, partial: bool = False) -> DataFrame:
    """rows with errors: (field, error) for every required field that is missing and value that does not fit.

    extra: columns outside the schema are allowed (names that begin with _ always are).
    """
    found = []
    say = lambda test, f, e: found.append(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(e).alias("error"))))
    for f in schema:
        there = f.name in rows.columns
        c = F.col(f"`{f.name}`").cast("string") if there else F.lit(None).cast("string")
        if f.required and f.default is None and not partial:
            say(c.isNull(), f.name, "missing_required")
        if not there:
            continue
        x = typed(c, f.kind)
        say(c.isNotNull() & x.isNull(), f.name, "wrong_type")
        if f.kind in ("integer", "float"):
            say(x < f.low if f.low is not None else None, f.name, "too_small") if f.low is not None else None
            say(x > f.high, f.name, "too_large") if f.high is not None else None
        say(F.length(c) < f.shortest, f.name, "too_short") if f.shortest is not None else None
        say(F.length(c) > f.longest, f.name, "too_long") if f.longest is not None else None
        say(~t.py_match(c, f.pattern), f.name, "wrong_pattern") if f.pattern else None
        say(~c.isin(list(f.values)), f.name, "not_allowed") if f.values is not None else None
    if not extra:
        for name in rows.columns:
            if name not in {f.name for f in schema} and not name.startswith("_"):
                say(F.lit(True), name, "unknown_field")
    return rows.withColumn("errors", F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<field:string,error:string>>"))


def plan(old: Sequence[Field], new: Sequence[Field]) -> list[tuple]:
    """Steps that turn records of one schema into the other's."""
    before, after = {f.name: f for f in old}, {f.name: f for f in new}
    steps: list[tuple] = [("remove", n) for n in sorted(before.keys() - after.keys())]
    steps += [("add", n, after[n].kind, after[n].default) for n in sorted(after.keys() - before.keys())]
    for n in sorted(before.keys() & after.keys()):
        if before[n].kind != after[n].kind:
            steps.append(("type", n, before[n].kind, after[n].kind))
        if after[n].default is not None and after[n].default != before[n].default:
            steps.append(("default", n, after[n].default))
    return steps


def undo(steps: Sequence[tuple]) -> list[tuple]:
    """The way back; what was removed comes back empty."""
    back = {
        "remove": lambda s: ("add", s[1], "string", None),
        "add": lambda s: ("remove", s[1]),
        "type": lambda s: ("type", s[1], s[3], s[2]),
        "rename": lambda s: ("rename", s[2], s[1]),
    }
    return [back[s[0]](s) for s in reversed(steps) if s[0] in back]


def migrate(rows: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """rows after all steps, with _lost: the names of fields whose value could not be turned into its new type.

    Steps: (remove, name), (add, name, kind, default), (type, name, from, to), (default, name, value),
    (rename, old, new), (merge, names, name, separator), (split, name, names, separator).
    """
    lost = F.array().cast("array<string>")
    rows = rows.withColumn("_lost", lost)
    for step in steps:
        what, name = step[0], step[1]
        if what == "remove":
            rows = rows.drop(name)
        elif what == "add":
            rows = rows.withColumn(name, typed(F.lit(step[3]).cast("string"), step[2]))
        elif what == "rename":
            rows = rows.withColumnRenamed(name, step[2])
        elif what == "default":
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(step[2]).cast(dict(rows.dtypes)[name])))
        elif what == "type":
            old = F.col(name)
            if step[2] == "float" and step[3] == "integer":
                new = F.floor(F.abs(old)).cast("bigint") * F.signum(old).cast("bigint")
            elif step[2] == "boolean" and step[3] == "integer":
                new = F.when(old, 1).otherwise(0).cast("bigint")
            elif step[2] == "integer" and step[3] == "boolean":
                new = old != 0
            else:
                new = typed(old.cast("string"), step[3])
            rows = rows.withColumn("__new", new).withColumn("_lost", F.when(old.isNotNull() & F.col("__new").isNull(), F.array_append("_lost", F.lit(name))).otherwise(F.col("_lost")))
            rows = rows.withColumn(name, F.col("__new")).drop("__new")
        elif what == "merge":
            rows = rows.withColumn(step[2], F.concat_ws(step[3], *name)).drop(*[n for n in name if n != step[2]])
        elif what == "split":
            pieces = F.split(F.col(name), step[3])
            rows = rows.withColumns({n: F.try_element_at(pieces, F.lit(i + 1)) for i, n in enumerate(step[2])})
        else:
            raise ValueError(f"no such step: {what}")
    return rows


def migrate_all(rows: DataFrame, steps: Sequence[tuple], on_error: str = "null") -> DataFrame:
    """rows after all steps; a row with a value that cannot be turned into its new type is left out (skip), ends the job (fail), or has a null there (null), with _lost naming the fields."""
    done = migrate(rows, steps)
    lost = F.size("_lost") > 0
    if on_error == "skip":
        return done.where(~lost).drop("_lost")
    if on_error == "fail":
        names = [c for c in done.columns if c != "_lost"]
        checked = done.where(F.when(lost, F.raise_error(F.concat(F.lit("values cannot be migrated: "), F.array_join("_lost", ", "))).cast("boolean")).otherwise(True))
        return checked.select(*names)
    if on_error != "null":
        raise ValueError(f"no such mode: {on_error}")
    return done


def migration_counts(rows: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """One row: total, migrated and failed rows of a migration."""
    return migrate(rows, steps).agg(F.count("*").alias("total"), F.count_if(F.size("_lost") == 0).alias("migrated"), F.count_if(F.size("_lost") > 0).alias("failed"))


def estimate(rows: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """(step, action, field, affected, lost) of each step, taken by itself, from one aggregate over the rows as they are.

    affected: rows that the step changes; lost: values that it drops or cannot turn.
    """
    made, said = [], []
    for i, step in enumerate(steps):
        what, name = step[0], step[1]
        there = F.col(name).isNotNull() if isinstance(name, str) and name in rows.columns else F.lit(False)
        affected, lost = F.lit(True), F.lit(False)
        if what == "remove":
            affected = lost = there
        elif what in ("rename", "split"):
            affected = there
        elif what == "default":
            affected = ~there
        elif what == "merge":
            affected = F.coalesce(*[F.col(n).cast("string") for n in name]).isNotNull()
        elif what == "type":
            affected = there
            lost = there & (F.lit(False) if step[3] in ("string", "any") else typed(F.col(name).cast("string"), step[3]).isNull() if (step[2], step[3]) not in (("float", "integer"), ("boolean", "integer"), ("integer", "boolean")) else F.lit(False))
        made += [F.count_if(affected).alias(f"a{i}"), F.count_if(lost).alias(f"l{i}")]
        said.append(F.struct(F.lit(i).alias("step"), F.lit(what).alias("action"), F.lit(name if isinstance(name, str) else ",".join(name)).alias("field"), F.col(f"a{i}").alias("affected"), F.col(f"l{i}").alias("lost")))
    return rows.agg(*made).select(F.inline(F.array(*said)))


def loosened(schema: Sequence[Field]) -> list[Field]:
    """A schema without the bounds of the values that it was inferred from."""
    return [replace(f, low=None, high=None, shortest=None, longest=None) for f in schema]


def drift(expected: Sequence[Field], rows: DataFrame) -> list[str]:
    """How a table differs from its schema: types, and fields that came or went."""
    return compatible(expected, loosened(infer(rows)), "full")
