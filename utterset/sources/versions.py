"""Replacing a set of tables so that a crash at any moment leaves a whole one (GE-4, IO-6, SE-2).

Overwriting a folder in place loses the old rows when the job dies before the new ones,
or the tables that belong to them, are written. Here every replacement is a new folder:

    <base>/versions/<name>/<table>      the tables of one version
    <base>/manifests/<number>           which version is current: the highest number

The manifest is written last. It ends in a checksum of its content, so a manifest whose
writing was cut off doesn't count, and it is created under a new number, so two writers
can't both believe to have won. No rename is needed, and object stores do as well.
Folders that no manifest names are what a crashed job left; ``recover`` removes them.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists


class VersionConflict(RuntimeError):
    """Another job replaced the tables in the meantime."""


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    if not path_exists(spark, folder):
        return []
    where, files = _files(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(where))


def _checked(content: str) -> dict | None:
    body, _, check = content.rpartition("\n")
    return json.loads(body) if body and hashlib.sha256(body.encode()).hexdigest() == check else None


def _read(spark: SparkSession, path: str) -> dict | None:
    where, files = _files(spark, path)
    stream = files.open(where)
    try:
        return _checked(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, manifest: dict) -> None:
    body = json.dumps(manifest, sort_keys=True)
    where, files = _files(spark, path)
    try:
        stream = files.create(where, False)
    except Exception as e:  # noqa: BLE001
        raise VersionConflict(path) from e
    stream.write(bytearray(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode()))
    stream.close()


def current(spark: SparkSession, base: str) -> dict | None:
    """The current manifest: ``number``, ``version`` and ``tables`` (name -> format); None
    before the first version."""
    for name in reversed(_names(spark, os.path.join(base, "manifests"))):
        found = _read(spark, os.path.join(base, "manifests", name)) if name.isdigit() else None
        if found is not None:
            return found
    return None


def table_path(base: str, manifest: dict, name: str) -> str:
    return os.path.join(base, "versions", manifest["version"], name)


def read_current(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """A table of the current version, or None if there is none."""
    manifest = current(spark, base)
    if manifest is None or name not in manifest["tables"]:
        return None
    return spark.read.format(manifest["tables"][name]).load(table_path(base, manifest, name))


def replace(spark: SparkSession, base: str, tables: dict[str, tuple[DataFrame, str, list[str]]], seen: dict | None) -> dict:
    """Write ``tables`` (name -> rows, format, partition columns) as the next version after
    ``seen``, the manifest that the caller read (None: there was none), and make it current."""
    version = uuid.uuid4().hex
    manifest = {"number": 1 + (seen["number"] if seen else 0), "version": version, "tables": {name: t[1] for name, t in tables.items()}}
    for name, (rows, fmt, parts) in tables.items():
        rows.write.partitionBy(*parts).format(fmt).save(table_path(base, manifest, name))
    used = [int(n) for n in _names(spark, os.path.join(base, "manifests")) if n.isdigit()]
    now = current(spark, base)
    if (now or {}).get("version") != (seen or {}).get("version"):
        raise VersionConflict(f"{base} is at {now} and no longer at {seen}")
    manifest["number"] = max([manifest["number"], *(n + 1 for n in used)])  # past manifests that were cut off
    _write(spark, os.path.join(base, "manifests", f"{manifest['number']:012d}"), manifest)
    return manifest


def recover(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Remove the folders of crashed jobs and all but the last ``keep`` versions; to be called
    while no other job replaces the tables. Returns the removed versions."""
    folder, held = os.path.join(base, "manifests"), []
    for name in _names(spark, folder):
        found = _read(spark, os.path.join(folder, name)) if name.isdigit() else None
        if found is not None:
            held.append(found["version"])
    gone = [v for v in _names(spark, os.path.join(base, "versions")) if v not in held[-keep:]]
    for version in gone:
        where, files = _files(spark, os.path.join(base, "versions", version))
        files.delete(where, True)
    return gone
