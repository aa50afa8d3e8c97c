"""Publishing a set of output tables: staged, checked, and switched to in one step.

Below ``root``, a folder of each run in ``versions`` holds Parquet tables and ``current/<number>`` small manifests, of which the one
with the greatest number counts. A manifest is written beside and renamed, so readers see the old set or the new one, never a
mixture; a set that fails its gate or a contract is removed and the old one stays. Publishing the current version again does
nothing, and what a run that was lost half-way has left is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimsieve.sources.tables import ContractError, latest_by_key, require_outputs


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _path(spark, f"{root}/current")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())


def manifest(spark: SparkSession, root: str) -> dict | None:
    """``version``, ``folder`` and ``tables`` (schema and rows by name) of the current set; None if nothing is published."""
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    return json.loads(spark.read.text(f"{root}/current/{numbers[-1]:012}", wholetext=True).first()[0])


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the current set by name; empty if nothing is published."""
    found = manifest(spark, root)
    return {} if found is None else {name: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{root}/versions/{found['folder']}/{name}") for name, t in found["tables"].items()}


def breaches(df: DataFrame, checks: Mapping[str, Column], key: Sequence[str] = ()) -> dict[str, int]:
    """How many rows break each check (NULL breaks it), and how many keys stand more than once; those with any."""
    row = df.agg(F.count(F.lit(1)), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items())).first().asDict()
    found = {name: row[name] for name in checks}
    if key:
        found["duplicate_key"] = df.groupBy(*key).count().where("count > 1").count()
    return {name: n for name, n in found.items() if n}


def publish(
    spark: SparkSession, root: str, version: str, tables: Mapping[str, DataFrame], mode: str = "real", checks: Mapping[str, Mapping[str, Column]] | None = None, keys: Mapping[str, Sequence[str]] | None = None, merge: Mapping[str, str] | None = None
) -> dict:
    """Publish a version and return its manifest.

    ``mode`` is that of ``require_outputs``; in fixture mode a missing table is left out. ``checks`` and ``keys`` are contracts
    of tables by name, tested on what was written. A table in ``merge`` (name: column of time) keeps the rows that are published
    and replaces those of equal keys by later ones. Two runs that publish at the same time: the second to switch gets an error.
    """
    checks, keys, merge = checks or {}, keys or {}, merge or {}
    if any(c in version for c in "/\\") or version.strip(". ") == "":
        raise ValueError(f"version {version!r}")
    unknown = sorted({*checks, *keys, *merge} - set(tables)) or sorted(set(merge) - set(keys))
    if unknown:
        raise ValueError(f"no table or key: {', '.join(unknown)}")
    numbers, now = _numbers(spark, root), manifest(spark, root)
    if now is not None and now["version"] == version:
        return now
    require_outputs(mode, tables)
    old, own = published(spark, root), f"{version}-{uuid.uuid4().hex}"
    folder = f"{root}/versions/{own}"
    fs, stage = _path(spark, folder)
    told: dict[str, dict] = {}
    try:
        for name, df in tables.items():
            if df is None:
                continue
            if name in merge and name in old:
                df = latest_by_key(old[name], df, keys[name], merge[name])
            df.write.parquet(f"{folder}/{name}")
            written = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
            if bad := breaches(written, checks.get(name, {}), keys.get(name, ())):
                raise ContractError(f"{name} breaks its contract: " + ", ".join(f"{k} {n} times" for k, n in bad.items()))
            told[name] = {"schema": written.schema.jsonValue(), "rows": written.count()}
        made = {"version": version, "folder": own, "tables": told}
        _switch(spark, root, (numbers[-1] if numbers else 0) + 1, made)
    except Exception:
        fs.delete(stage, True)
        raise
    return made


def _switch(spark: SparkSession, root: str, number: int, made: dict) -> None:
    fs, to = _path(spark, f"{root}/current/{number:012}")
    _, beside = _path(spark, f"{root}/current/_{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(beside, to):
        fs.delete(beside, False)
        raise ContractError(f"another run has published number {number}")


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` published sets (one at least) and return the versions that are gone."""
    numbers = _numbers(spark, root)
    entries = {n: json.loads(spark.read.text(f"{root}/current/{n:012}", wholetext=True).first()[0]) for n in numbers}
    last = numbers[-max(keep, 1) :]
    gone = [n for n in numbers if n not in last]
    for n in gone:
        for path in (f"current/{n:012}", f"versions/{entries[n]['folder']}"):
            fs, p = _path(spark, f"{root}/{path}")
            fs.delete(p, True)
    return [entries[n]["version"] for n in gone]
