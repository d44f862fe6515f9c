"""Several tables committed as one: versioned folders, and a manifest that is moved into place last.

``path`` holds ``versions/<id>/<table>`` and ``commits/<number>.json``. Readers go by the manifest with the highest number, so they see
all tables of one commit or all of the one before, also while a writer is at work or after it was killed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from docketry.schemas import ConstraintError, reject


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *parts)))
    return jvm, at, at().getFileSystem(conf)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits that are there, in order."""
    _, at, fs = _hadoop(spark, path)
    if not fs.exists(at("commits")):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(at("commits")))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a commit, the latest unless one is named, consists of."""
    found = versions(spark, path)
    if not found or version not in (None, *found):
        raise ConstraintError(f"{path} has no commit" + ("" if version is None else f" {version}"))
    lines = spark.read.text(f"{path.rstrip('/')}/commits/{version or found[-1]:012d}.json", wholetext=True)
    return json.loads(lines.first()[0])


def commit_tables(tables: dict[str, DataFrame], path: str, violations: tuple[DataFrame, ...] = (), metadata: dict | None = None, base: int | None = None) -> int:
    """Write ``tables`` and make them the latest version, all or none; its number is returned.

    ``violations`` (rule, key) have to be empty before anything is written. The commit builds on ``base``, the latest version at the
    start unless given; if another commit has come in between, this one is an error and its files go. A killed writer leaves a
    folder that no manifest names. An empty table is committed as such.
    """
    if not tables:
        raise ConstraintError("a commit needs a table")
    spark = next(iter(tables.values())).sparkSession
    if violations:
        reject(*violations)
    jvm, at, fs = _hadoop(spark, path)
    base = (versions(spark, path) or [0])[-1] if base is None else base
    name = f"{base + 1:012d}-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/versions/{name}"
    try:
        parts = {}
        for table, df in tables.items():
            df.write.parquet(f"{folder}/{table}")
            parts[table] = {"schema": df.schema.json(), "rows": spark.read.parquet(f"{folder}/{table}").count()}
        text = json.dumps({"version": base + 1, "folder": name, "tables": parts, "metadata": metadata or {}}, ensure_ascii=False, sort_keys=True)
        out = fs.create(at("commits", f".{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()
        never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        try:
            context.rename(at("commits", f".{name}"), at("commits", f"{base + 1:012d}.json"), never_over)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise ConstraintError(f"{path} has a commit {base + 1} already") from e
            raise
    except BaseException:
        fs.delete(at("versions", name), True)
        fs.delete(at("commits", f".{name}"), False)
        raise
    return base + 1


def read_tables(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one commit, the latest unless one is named."""
    from pyspark.sql.types import StructType

    found = manifest(spark, path, version)
    at = f"{path.rstrip('/')}/versions/{found['folder']}"
    return {name: spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{at}/{name}") for name, t in found["tables"].items()}


def forget(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete all but the latest ``keep`` commits, manifests first; the numbers that went are returned."""
    _, at, fs = _hadoop(spark, path)
    gone = versions(spark, path)[: -max(1, keep)]
    for version in gone:
        folder = manifest(spark, path, version)["folder"]
        fs.delete(at("commits", f"{version:012d}.json"), False)
        fs.delete(at("versions", folder), True)
    return gone
