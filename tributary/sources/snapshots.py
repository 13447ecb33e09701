"""Snapshots of a data set on files: full ones, and differences to an earlier one.

A snapshot is a folder of Parquet files and a manifest entry, a small JSON file that is written
when the data is whole, so a crash leaves no snapshot that cannot be read. A full snapshot stands
alone; a differential one holds what changed since the last full one, an incremental one what
changed since the last of any kind. Each names its parent, the snapshot that it continues.

Restoring reads a snapshot's chain, its parents back to a full one, and takes each key's latest
row: one shuffle, however long the chain is. Expiry removes a snapshot only when no other that
stays has it in its chain.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.changes import delta, last_by_key, materialized
from tributary.session import file_system, write_bytes

KINDS = ("full", "differential", "incremental")
ENTRY = "number int, id string, kind string, parent string, taken_at string, records long, stored long, digest string"


def manifest(spark: SparkSession, path: str) -> list[dict]:
    """Entries of all snapshots, oldest first: a few hundred bytes each."""
    place, fs = file_system(spark, f"{path}/_manifest")
    if not fs.exists(place) or not fs.listStatus(place):
        return []
    return [r.asDict() for r in spark.read.schema(ENTRY).json(f"{path}/_manifest/*.json").orderBy("number", "id").collect()]


def chain(entries: Sequence[dict], snapshot: str) -> list[dict]:
    """The entries that restore a snapshot, from a full one on."""
    by_id, found, at = {e["id"]: e for e in entries}, [], snapshot
    while at is not None:
        if at not in by_id:
            raise ValueError(f"snapshot {snapshot} needs {at}, which is not there")
        found.append(by_id[at])
        at = by_id[at]["parent"]
    return found[::-1]


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a sum of their hashes, which does not depend on their order."""
    names = sorted(rows.columns)
    whole = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    n, total = rows.agg(F.count("*"), F.sum(whole.cast("decimal(38,0)"))).first()
    return n, str(total or 0)


def take(rows: DataFrame, path: str, keys: Sequence[str], kind: str, taken_at: str, order: str | None = None) -> str:
    """Write rows as the next snapshot and return its id; the first is always a full one."""
    if kind not in KINDS:
        raise ValueError(f"no such kind of snapshot: {kind}")
    spark, rows = rows.sparkSession, last_by_key(rows, keys, order)
    entries = manifest(spark, path)
    if not entries:
        kind = "full"
    parent = None
    if kind != "full":
        parent = next(e["id"] for e in reversed(entries) if kind == "incremental" or e["kind"] == "full")
    stored = rows if parent is None else delta(restore(spark, path, keys, parent), rows, keys)
    name = uuid.uuid4().hex
    stored.write.option("compression", "zstd").parquet(f"{path}/{name}")
    records, total = digest(rows)
    entry = {"number": max((e["number"] for e in entries), default=0) + 1, "id": name, "kind": kind, "parent": parent, "taken_at": taken_at, "records": records, "stored": spark.read.parquet(f"{path}/{name}").count(), "digest": total}
    write_bytes(spark, f"{path}/_manifest/{entry['number']:012d}-{name}.json", json.dumps(entry).encode())
    return name


def restore(spark: SparkSession, path: str, keys: Sequence[str], snapshot: str) -> DataFrame:
    """The data set as it was when a snapshot was taken."""
    links = [spark.read.parquet(f"{path}/{e['id']}") for e in chain(manifest(spark, path), snapshot)]
    if len(links) == 1:
        return links[0]
    names = [c for c in links[-1].columns if c != "_op"]
    return materialized(links[0], links[1:], keys).select(*names)


def as_of(spark: SparkSession, path: str, keys: Sequence[str], moment: str) -> DataFrame | None:
    """The data set of the last snapshot at or before a moment; None if there is none."""
    earlier = [e for e in manifest(spark, path) if e["taken_at"] <= moment]
    return restore(spark, path, keys, max(earlier, key=lambda e: (e["taken_at"], e["number"]))["id"]) if earlier else None


def intact(spark: SparkSession, path: str, keys: Sequence[str], snapshot: str) -> bool:
    """Whether a snapshot restores to the rows that it was taken of."""
    entry = next(e for e in manifest(spark, path) if e["id"] == snapshot)
    return digest(restore(spark, path, keys, snapshot)) == (entry["records"], entry["digest"])


def references(entries: Sequence[dict], kept: Sequence[str]) -> Counter:
    """How many of the kept snapshots have each one in their chain."""
    return Counter(e["id"] for k in kept for e in chain(entries, k))


def expire(spark: SparkSession, path: str, before: str, keep: int = 1) -> dict[str, int]:
    """Remove snapshots taken before a moment, except the last `keep` and what those that stay need.

    Returns the number of references of each snapshot; those with none are gone. A manifest entry
    goes before its data, so what is left can always be restored.
    """
    entries = manifest(spark, path)
    last = {e["id"] for e in entries[len(entries) - keep :]} if keep else set()
    kept = [e["id"] for e in entries if e["taken_at"] >= before or e["id"] in last]
    counts = references(entries, kept)
    for e in reversed(entries):  # children before parents
        if not counts[e["id"]]:
            for name in (f"_manifest/{e['number']:012d}-{e['id']}.json", e["id"]):
                place, fs = file_system(spark, f"{path}/{name}")
                fs.delete(place, True)
    return {e["id"]: counts[e["id"]] for e in entries}
