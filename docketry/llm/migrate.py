"""Rewrite of Parquet files whose schema has drifted: fields are matched by their ids, each file is brought to one schema.

Drift is read off a file's footer as bits, and each bit has one transform of Arrow tables: ``widen`` casts fields to wider
types, ``add`` fills fields that are missing, ``reorder`` puts them into the schema's order, ``rename`` gives them its names.
A file's chain is the composition of the transforms of its bits; it is applied to one slice of a file after another, so a
file of any length passes through one task with the memory of a row group's slice. Files are the unit of work: their
paths are dealt to tasks, which replace a file by its rewritten one in a single move. A rewritten file carries what it
came from in its own footer, so a task that is repeated after a lost executor finds it done and reports the same.

Edge cases: an empty table has no files; null values stay null; repeated rows stay; fields with ids that the schema doesn't
have are dropped (a bit of ``reorder``); a file without ids, with an id twice, or with a type that doesn't widen to the schema's
raises before anything is replaced.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import discard, fresh_path, settle, trimmed

#: Bits of drift, one for each transform.
RENAME, REORDER, ADD, WIDEN = 1, 2, 4, 8
_ID = b"PARQUET:field_id"
#: Footer key of a rewritten file; its value says what the file was.
_FROM = b"docketry.migrated_from"
#: Rows that are written as a row group and held at once, at most.
GROUP_ROWS = 1 << 16


def field(name: str, kind: pa.DataType, number: int) -> pa.Field:
    return pa.field(name, kind, metadata={_ID: str(number).encode()})


def ids(schema: pa.Schema) -> list[int | None]:
    return [int(f.metadata[_ID]) if f.metadata and _ID in f.metadata else None for f in schema]


#: Types and those that hold all their values.
_WIDER = {pa.int8(): (pa.int16(), pa.int32(), pa.int64()), pa.int16(): (pa.int32(), pa.int64()), pa.int32(): (pa.int64(), pa.float64()), pa.float32(): (pa.float64(),)}


class Target:
    """The schema that files are brought to, with the value of each field (by id) where a file lacks it; null if not given."""

    def __init__(self, schema: pa.Schema, fill: dict[int, object] | None = None):
        self.schema, self.fill, self.of = schema, fill or {}, dict(zip(ids(schema), schema))

    # ---- drift

    def drift(self, schema: pa.Schema) -> int:
        """Bits in which a file's schema differs; raises if the chain can't bring it here."""
        there = ids(schema)
        if None in there or len(set(there)) < len(there):
            raise ValueError("each field has to have an id of its own")
        for i, f in zip(there, schema):
            if i in self.of and f.type != self.of[i].type and self.of[i].type not in _WIDER.get(f.type, ()):
                raise ValueError(f"field {i} of type {f.type} can't become {self.of[i].type}")
        common = [i for i in there if i in self.of]
        bits = RENAME * any(f.name != self.of[i].name for i, f in zip(there, schema) if i in self.of)
        bits |= REORDER * (common != [i for i in self.of if i in common] or len(common) < len(there))
        bits |= ADD * (len(common) < len(self.of))
        return bits | WIDEN * any(f.type != self.of[i].type for i, f in zip(there, schema) if i in self.of)

    # ---- the transforms: tables in, tables out

    def widen(self, t: pa.Table) -> pa.Table:
        kinds = [self.of[i].type if i in self.of else f.type for i, f in zip(ids(t.schema), t.schema)]
        return t.cast(pa.schema([f.with_type(k) for f, k in zip(t.schema, kinds)]))

    def add(self, t: pa.Table) -> pa.Table:
        there = set(ids(t.schema))
        for i, f in self.of.items():
            if i not in there:
                t = t.append_column(f, pa.repeat(pa.scalar(self.fill.get(i), f.type), t.num_rows))
        return t

    def reorder(self, t: pa.Table) -> pa.Table:
        at = {i: k for k, i in enumerate(ids(t.schema))}
        places = [at[i] for i in self.of if i in at]
        return pa.Table.from_arrays([t.column(k) for k in places], schema=pa.schema([t.schema.field(k) for k in places]))

    def rename(self, t: pa.Table) -> pa.Table:
        fields = [f.with_name(self.of[i].name) if i in self.of else f for i, f in zip(ids(t.schema), t.schema)]
        return pa.Table.from_arrays(t.columns, schema=pa.schema(fields))

    def chain(self, bits: int) -> Callable[[pa.Table], pa.Table]:
        """The composition of the bits' transforms. Added fields come last, so ``add`` brings ``reorder`` with it."""
        bits |= REORDER * bool(bits & ADD)
        steps = [f for bit, f in ((WIDEN, self.widen), (ADD, self.add), (REORDER, self.reorder), (RENAME, self.rename)) if bits & bit]
        return lambda table: reduce(lambda t, f: f(t), steps, table)


# ---- files


def _at(uri: str):
    """The file system of a path as Spark names it, and the path there."""
    from pyarrow import fs

    uri = "s3" + uri[3:] if uri.startswith("s3a:") else uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _slices(f: pq.ParquetFile) -> Iterator[pa.Table]:
    """A file's rows, ``GROUP_ROWS`` at once, as tables whose fields carry the ids of the footer."""
    schema = f.schema_arrow
    for b in f.iter_batches(GROUP_ROWS):
        yield pa.Table.from_arrays(b.columns, schema=schema.remove_metadata())


def _swap(disk, path: str, schema: pa.Schema, tables: Iterator[pa.Table], note: dict) -> None:
    """Write a file beside ``path``, under a name that no reader lists, and move it there."""
    from pyspark import TaskContext

    there = posixpath.join(posixpath.dirname(path), f"_{posixpath.basename(path)}.{TaskContext.get().taskAttemptId()}")
    try:
        with disk.open_output_stream(there) as out, pq.ParquetWriter(out, schema.with_metadata({_FROM: json.dumps(note).encode()} if note else None)) as writer:
            for t in tables:
                writer.write_table(t, GROUP_ROWS)
        disk.move(there, path)
    except BaseException:
        disk.delete_file(there)
        raise


def write_files(rows: DataFrame, name: str, schemas: Callable[[int], Callable[[pa.Table], pa.Table]], schema: pa.Schema, folder: str) -> None:
    """One Parquet file below ``folder`` for each value of column ``name``, whose rows are each in one partition, sorted by it.

    A task streams its rows into one file after another; ``schemas`` gives a file's transform of tables with ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, pa.Table]]:
            held, of, n = [], None, 0
            for b in batches:
                number = b.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
                for lo, to in zip(edges, edges[1:]):
                    if lo == to:
                        continue
                    if held and (of != number[lo] or n >= GROUP_ROWS):
                        yield of, pa.Table.from_batches(held)
                        held, n = [], 0
                    of, n = int(number[lo]), n + to - lo
                    held.append(b.slice(lo, to - lo))
            if held:
                yield of, pa.Table.from_batches(held)

        parts = pieces()
        now = next(parts, None)
        while now:
            number, change = now[0], schemas(now[0])

            def of_file() -> Iterator[pa.Table]:
                nonlocal now
                while now and now[0] == number:
                    t = now[1].drop_columns([name])
                    yield change(pa.Table.from_arrays([t.column(f.name).cast(f.type) for f in schema], schema=schema))
                    now = next(parts, None)

            disk, at = _at(f"{folder}/part-{number:05d}.parquet")
            _swap(disk, at, change(schema.empty_table()).schema, of_file(), {})
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], ["file_no"])

    _at_made(rows.sparkSession, folder)
    rows.select(name, *schema.names).mapInArrow(trimmed(run), "file_no long").write.format("noop").mode("overwrite").save()


def _at_made(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path of each Parquet file of a folder, dealt to tasks by name; contents aren't read."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    named = F.concat(F.lit(folder + "/"), F.element_at(F.split("path", "/"), -1)).alias("path")  # as the folder was named
    return found.select(named).repartitionByRange(n, "path")


_DONE = "path string, bits int, start_columns string, rewritten boolean, n_rows long"


def rewrite(spark: SparkSession, folder: str, target: Target) -> DataFrame:
    """Bring every file of ``folder`` to the target's schema, in place, and return path, bits, start_columns, rewritten, n_rows.

    Files without drift are only looked at. The result is a written table: a file is rewritten once, whoever reads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                disk, at = _at(path)
                with disk.open_input_file(at) as source:
                    f = pq.ParquetFile(source)
                    schema, note = f.schema_arrow, (f.schema_arrow.metadata or {}).get(_FROM)
                    was = json.loads(note) if note else {"bits": target.drift(schema), "columns": schema.names}
                    if was["bits"] and not note:
                        change, n = target.chain(was["bits"]), 0

                        def checked() -> Iterator[pa.Table]:
                            nonlocal n
                            for t in _slices(f):
                                n += t.num_rows
                                yield change(t)

                        _swap(disk, at, target.schema, checked(), was)
                        if n != f.metadata.num_rows:
                            raise ValueError(f"{path} has other rows than its footer says")
                    row = [path], [was["bits"]], [",".join(was["columns"])], [bool(was["bits"])], [f.metadata.num_rows]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64()), strict=True)], ["path", "bits", "start_columns", "rewritten", "n_rows"])

    return settle(files(spark, folder).mapInArrow(trimmed(run), _DONE), "rewritten")


def fields_text(t: pa.Table) -> pa.ChunkedArray | pa.Array:
    """Each row as text: fields joined by ``|``, nulls as ``?``, times as microseconds since 1970, fractions as floor(2^20 x)."""
    columns = []
    for c in t.columns:
        c = c.combine_chunks()
        if pa.types.is_timestamp(c.type):
            c = c.cast(pa.timestamp("us", c.type.tz)).cast(pa.int64())
        elif pa.types.is_floating(c.type):
            finite = pc.is_finite(c)
            whole = pc.cast(pc.floor(pc.multiply(pc.if_else(finite, c, 0.0), 1048576.0)), pa.int64(), safe=False).cast(pa.string())
            c = pc.if_else(finite, whole, c.cast(pa.string()))  # NaN and the infinities by their names
        columns.append(pc.fill_null(c.cast(pa.string()), "?"))
    return pc.binary_join_element_wise(*columns, "|")


_SEEN = "path string, columns string, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string"


def describe(done: DataFrame, key: int) -> DataFrame:
    """path, columns, n_rows, n_nulls, ids_sha256, rows_sha256 as read back from each file; ``key`` is the id of the field whose values are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                disk, at = _at(path)
                rows = nulls = 0
                joined = {"ids": (hashlib.sha256(), b","), "rows": (hashlib.sha256(), b"\n")}
                with disk.open_input_file(at) as source:
                    f = pq.ParquetFile(source)
                    schema = f.schema_arrow
                    k = ids(schema).index(key)
                    for t in _slices(f):
                        if not t.num_rows:
                            continue
                        nulls += sum(c.null_count for c in t.columns)
                        texts = {"ids": pc.fill_null(t.column(k).cast(pa.string()), "?"), "rows": fields_text(t)}
                        for what, (sha, mark) in joined.items():
                            sha.update((mark if rows else b"") + mark.join(x.encode() for x in texts[what].to_pylist()))
                        rows += t.num_rows
                row = [path], [",".join(schema.names)], [rows], [nulls], *([joined[x][0].hexdigest()] for x in ("ids", "rows"))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [c.split()[0] for c in _SEEN.split(", ")])

    n = int(done.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return done.select("path").repartitionByRange(n, "path").mapInArrow(trimmed(run), _SEEN)


# ---- a table dealt to files in the order of a hash


def placed(rows: DataFrame, order: list[str], per_file: Callable[[int], int]) -> tuple[DataFrame, int, DataFrame]:
    """``rows`` with file_no and place (row number in the given order, from 0), the number of files, and the table behind them.

    Rows are sorted in ranges; Spark numbers them within each. One count for each range goes to the driver.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the number that Spark gives to rows has the partition above its 33 lower bits
    dealt = settle(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__m", 33)
    counts = sorted(dealt.groupBy(part.alias("p")).count().collect())
    before, seen = [], 0
    for r in counts:
        before.append((r["p"], seen))
        seen += r["count"]
    size = per_file(seen)
    offsets = spark.createDataFrame(before, "__p long, __before long")  # one row for each range
    place = F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    found = dealt.join(F.broadcast(offsets), part == F.col("__p")).withColumn("place", place).drop("__p", "__before", "__m")
    return found.withColumn("file_no", F.floor(F.col("place") / size)), -(-seen // size), dealt


#: The evolved schema of the shop's clients, and what stands in for fields that a file lacks.
_CLIENT = [("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string())]
_CLIENT += [("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int64()), ("segment", pa.string()), ("balance", pa.float64())]
CLIENTS = Target(pa.schema([field(name, kind, k) for k, (name, kind) in enumerate(_CLIENT, 1)]), {8: -1, 9: "none"})


def version(file_no: int) -> int:
    import zlib

    v = zlib.crc32(f"19:{file_no}".encode()) % 24
    return v if v < 16 else 0


def drifted(bits: int) -> Callable[[pa.Table], pa.Table]:
    """The evolved table as a writer of an older version wrote it: the four bits' drift, ids kept."""

    def change(t: pa.Table) -> pa.Table:
        fields, columns = list(t.schema), list(t.columns)
        if bits & WIDEN:
            for k, kind in ((9, pa.float32()), (7, pa.int32())):
                fields[k], columns[k] = fields[k].with_type(kind), columns[k].cast(kind, safe=False)
        if bits & RENAME:
            fields[4], fields[5] = fields[4].with_name(fields[5].name), fields[5].with_name(fields[4].name)
        places = [k for k in range(len(fields)) if not (bits & ADD and k in (7, 8))]
        if bits & REORDER:
            places = [places[0], *reversed(places[1:])]
        return pa.Table.from_arrays([columns[k] for k in places], schema=pa.schema([fields[k] for k in places]))

    return change


def migrate_clients(clients: DataFrame) -> DataFrame:
    """Deal ``clients`` to drifted files in a new folder, rewrite these there, and describe each final file.

    file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, path, rewritten.
    """
    spark = clients.sparkSession
    folder = fresh_path(spark, "clients")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.timestamp("us"): "timestamp_ntz", pa.float64(): "double"}
    rows = clients.select(*(F.col(f.name).cast(kinds[f.type]).alias(f.name) for f in CLIENTS.schema))
    rows = rows.withColumn("__h", F.crc32(F.col("client_id").cast("string").cast("binary")))
    # ids that repeat, or are null (first), are in the order of their other values
    order = ["__h", *CLIENTS.schema.names]
    found, n, held = placed(rows, order, lambda total: 1 + total // 250)
    if not n:
        discard(held)
        return spark.createDataFrame([], RESULT)
    each = found.repartitionById(n, F.col("file_no").cast("int")).sortWithinPartitions("file_no", "place")
    write_files(each, "file_no", lambda k: drifted(version(k)), CLIENTS.schema, folder)
    discard(held)
    done = rewrite(spark, folder, CLIENTS)
    number = F.regexp_extract("path", r"part-(\d+)\.parquet$", 1).cast("long")
    seen = describe(done, 1).join(done.select("path", "bits", "start_columns", "rewritten"), "path")
    return seen.select(number.alias("file_no"), F.col("bits").cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")


RESULT = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"
