"""Nested records against a recursive version in plain Python, on random documents."""

import json
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tributary.operators import nested
from tributary.operators.schemas import LADDER, Field


def _random_value(rng, depth):
    kind = rng.choice(("object", "array", "text", "number", "none", "flag") if depth else ("text", "number", "none", "flag"))
    if kind == "object":
        return {k: _random_value(rng, depth - 1) for k in ("a", "b") if rng.random() < 0.8}
    if kind == "array":
        return [{"e": rng.choice((1, 2.5, 30, None))} for _ in range(rng.randrange(4))]
    return {"text": rng.choice(("x1", "2024-01-02", "12", "")), "number": rng.randrange(100), "none": None, "flag": True}[kind]


def _document(rng):
    """Documents of one shape, with missing parts everywhere."""
    some = lambda v: v if rng.random() < 0.8 else None
    line = lambda: some({"qty": some(rng.randrange(9)), "price": some(rng.choice(("1.50", "n/a", "7"))), "tags": some([rng.choice(("red", "AB-12")) for _ in range(rng.randrange(3))])})
    whole = {"id": rng.randrange(1_000), "who": some({"name": some(rng.choice(("Ann", "Bo"))), "mail": f"u{rng.randrange(9)}@x.org", "at": some({"city": some("S")})}), "lines": some([line() for _ in range(rng.randrange(4))]), "grid": some([[1, None], [], [3]])}
    return {k: v for k, v in whole.items() if v is not None or rng.random() < 0.5}


def _walk(value, shape, at, out):
    """Values by path, as a recursion over one document and the shape of them all."""
    if isinstance(shape, dict):
        for k, below in shape.items():
            path = f"{at}.{k}" if at else k
            v = value.get(k)
            out[path].append(v)
            if v is not None:
                _walk(v, below, path, out)
    elif isinstance(shape, list):
        for v in value:
            out[f"{at}[]"].append(v)
            if v is not None:
                _walk(v, shape[0], f"{at}[]", out)


SHAPE = {"doc": {"id": None, "who": {"name": None, "mail": None, "at": {"city": None}}, "lines": [{"qty": None, "price": None, "tags": [None]}], "grid": [[None]]}}


def _kind(v):
    if isinstance(v, (dict, list)):
        return "object" if isinstance(v, dict) else "array"
    text = str(v).strip()
    return next((k for k, form in LADDER if re.match(form, text)), "string")


def _all(documents):
    out = defaultdict(list)
    for d in documents:
        _walk({"doc": d}, SHAPE, "", out)
    return out


def _rows(spark, documents):
    raw = spark.createDataFrame([(json.dumps(d),) for d in documents] + [("{broken",), (None,)], "doc string")
    return nested.from_json(raw, "doc")


def test_profiles_of_random_documents(spark):
    rng = random.Random(1)
    documents = [_document(rng) for _ in range(80)]
    want = {}
    for path, vs in _all([*documents, None, None]).items():
        kinds = [_kind(v) for v in vs if v is not None]
        want[path] = (len(vs), vs.count(None), {k: kinds.count(k) for k in set(kinds)})
    got = {r["path"]: (r["total"], r["nulls"], {k: r[k] for k in [k for k, _ in LADDER] + ["string", "array", "object"] if r[k]}) for r in nested.profile(_rows(spark, documents)).collect()}
    assert got == want


def test_schemas_of_random_documents(spark):
    rng = random.Random(2)
    documents = [_document(rng) for _ in range(60)]
    found = {f.name: f for f in nested.infer(_rows(spark, documents))}
    for path, vs in _all([*documents, None, None]).items():
        kinds = [_kind(v) for v in vs if v is not None]
        f = found.pop(path)
        assert kinds.count(f.kind) == max(kinds.count(k) for k in kinds)
        assert f.required == (1 - vs.count(None) / len(vs) >= 0.95) and f.nullable == (None in vs)
        if f.kind == "integer":
            assert (f.low, f.high) == (min(v for v in vs if v is not None), max(v for v in vs if v is not None))
    assert not found
    assert next(f for f in nested.infer(_rows(spark, documents)) if f.name == "doc.who.mail").pattern == dict(nested.FORMS)["email"]


def test_errors_of_random_documents(spark):
    rng = random.Random(3)
    documents = [_document(rng) for _ in range(60)]
    schema = [
        Field("doc", "object", True), Field("doc.who", "object", True), Field("doc.who.name", "string", True, values=("Ann",)), Field("doc.who.at.city", "string", True, longest=0), Field("doc.lines", "object"), Field("doc.lines[]", "object", True), Field("doc.lines[].qty", "integer", True, low=2, high=6),
        Field("doc.lines[].price", "float"), Field("doc.lines[].tags[]", "string", True, pattern="[a-z]+$"), Field("doc.grid[][]", "integer", True), Field("doc.lines[].new", "string", True), Field("doc.none.x", "string", True), Field("doc.id", "array"),
    ]
    want = []
    for d in [*documents, None, None]:
        out, bad = _all([d]), {}

        def say(path, error, n):
            if n:
                bad[path, error] = n  # noqa: B023

        for f in schema:
            vs = out.get(f.name, [])
            there = [v for v in vs if v is not None]
            if f.name == "doc.lines[].new":
                say(f.name, "missing_required", len([v for v in out.get("doc.lines[]", []) if v is not None]))
                continue
            if f.required:
                say(f.name, "missing_required", vs.count(None))
            nested_kind = {"doc": "object", "doc.who": "object", "doc.lines": "array", "doc.lines[]": "object"}.get(f.name)
            if nested_kind or f.kind == "array":
                say(f.name, "wrong_type", len(there) if f.kind != nested_kind else 0)
            elif f.kind == "float":
                say(f.name, "wrong_type", there.count("n/a"))
            if f.low is not None:
                say(f.name, "too_small", sum(v < f.low for v in there))
                say(f.name, "too_large", sum(v > f.high for v in there))
            if f.longest is not None:
                say(f.name, "too_long", sum(len(v) > f.longest for v in there))
            if f.pattern:
                say(f.name, "wrong_pattern", sum(not re.match(f.pattern, v) for v in there))
            if f.values:
                say(f.name, "not_allowed", sum(v not in f.values for v in there))
        for path in ("doc.who.mail", "doc.who.at", "doc.grid", "doc.lines[].tags"):
            say(path, "unknown_field", len([v for v in out.get(path, []) if v is not None]))
        want.append(sorted((*k, n) for k, n in bad.items()))
    checked = nested.errors(_rows(spark, documents), schema, extra=False)
    assert sorted(sorted(tuple(e) for e in r["errors"]) for r in checked.collect()) == sorted(want)
    assert nested.error_counts(checked.limit(0)).count() == 0


def test_odd_json(spark):
    one = lambda *texts: nested.from_json(spark.createDataFrame([(t,) for t in texts], "doc string"), "doc")
    assert one("{broken", None).where("doc is not null").count() == 0
    mixed = one('{"a": 1}', '{"a": {"b": 2}}', '{"a": [1]}')
    assert [r["a"] for r in mixed.select("doc.a").collect()] == ["1", '{"b":2}', "[1]"]
    assert [p for p, _ in nested.paths(one('[{"a": 1}]', "[]").schema)] == ["doc", "doc[]", "doc[].a"]
    assert nested.profile(one('{"a": []}').select(F.col("doc")), ["doc"]).count() >= 1


def test_elements_are_gone_through_once(spark):
    """Rules of one array share a pass over its elements, and measures take elements as rows."""
    rows = spark.createDataFrame([(1, ([(1.0, "a"), (None, "b")],))], "id long, doc struct<lines: array<struct<qty: double, name: string>>>").select("doc")
    schema = [Field("doc.lines[].qty", "float", True, low=3.0, high=45.0), Field("doc.lines[].name", "string", True, longest=1, pattern="[A-M]")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    checked = nested.errors(rows, schema, extra=False)
    assert plan(checked).count("aggregate(") == 1 and "transform(" not in plan(checked)
    assert "lambdafunction" not in plan(nested.profile(rows))
    assert [tuple(e) for e in checked.first()["errors"]] == [("doc.lines[].qty", "missing_required", 1), ("doc.lines[].qty", "too_small", 1), ("doc.lines[].name", "wrong_pattern", 2), ("doc", "unknown_field", 1), ("doc.lines", "unknown_field", 1)]
