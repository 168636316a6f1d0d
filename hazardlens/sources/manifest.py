"""Several tables that change together: numbered manifests that name every table's files.

Data are written under new paths first. A version exists from the moment its manifest is put in place
under the next number, which the file system does for one writer only; whoever comes second finds the
number taken, and works its change out anew on the version it then sees. Readers take the manifest
of the highest number, so they see all tables of one version, and old versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


class Conflict(Exception):
    """Another writer has made the version that this one wanted to make."""


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _name(root: str, number: int) -> str:
    return f"{root}/_versions/{number:020d}.json"


def version(spark: SparkSession, root: str) -> int:
    """The number of the newest version; 0 before the first."""
    system, path = _system(spark, root)
    folder = path(f"{root}/_versions")
    if not system.exists(folder):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return max((int(n[:20]) for n in names if n[:20].isdigit() and n.endswith(".json")), default=0)


def _entries(spark: SparkSession, root: str, number: int) -> dict[str, dict]:
    if not number:
        return {}
    (row,) = spark.read.option("wholetext", True).text(_name(root, number)).collect()  # a line a table
    return json.loads(row.value)


def read(spark: SparkSession, root: str, number: int | None = None) -> Tables:
    """All tables of one version, the newest if none is named."""
    from pyspark.sql.types import StructType

    entries = _entries(spark, root, version(spark, root) if number is None else number)
    return {name: spark.read.schema(StructType.fromJson(e["schema"])).parquet(*e["paths"]) for name, e in entries.items()}


def commit(spark: SparkSession, root: str, base: int, replaced: Tables | None = None, added: Tables | None = None) -> int:
    """Make version ``base + 1``: tables replaced as a whole and rows added to tables, all or nothing.

    Tables that aren't named stay. Raises ``Conflict`` if that version has been made meanwhile; what was
    written for it then belongs to no version.
    """
    entries = _entries(spark, root, base)
    for name, df in (replaced or {}).items():
        entries[name] = {"paths": [_put(df, root, name)], "schema": df.schema.jsonValue()}
    for name, df in (added or {}).items():
        old = entries.get(name, {"paths": [], "schema": df.schema.jsonValue()})
        columns = [f["name"] for f in old["schema"]["fields"]]
        entries[name] = {"paths": [*old["paths"], _put(df.select(*[f"`{c}`" for c in columns]), root, name)], "schema": old["schema"]}
    system, path = _system(spark, root)
    draft = path(f"{root}/_versions/.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(entries).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, path(_name(root, base + 1)), never_over)
    except Py4JJavaError as e:
        system.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {base + 1} of {root} is there already") from None
        raise
    return base + 1


def _put(df: DataFrame, root: str, name: str) -> str:
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def update(spark: SparkSession, root: str, change: Callable[[Tables], tuple[Tables, Tables]], attempts: int = 10) -> int:
    """Apply ``change(tables) -> (replaced, added)`` to the newest version, again if another writer was first."""
    for _ in range(attempts):
        base = version(spark, root)
        replaced, added = change(read(spark, root, base))
        try:
            return commit(spark, root, base, replaced, added)
        except Conflict:
            continue
    raise Conflict(f"{root}: {attempts} other versions came first")
