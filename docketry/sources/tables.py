"""CSV and JSONL sources with their constraints, path rules, manifests, and the sinks."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import uuid
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.keys import example_id, safe_name, subject_key
from docketry.schemas import LABELS, PORTABLE_ROW, ConstraintError, blank, label_domain, reject, require_exact_columns, violations
from docketry.shared import numbered, set_digest

# readers


def read_strings(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """CSV whose columns are all strings and whose blanks stay blank, with file and row (from 0, in the file's order).

    The header has to have these columns, in any order; others are dropped. Row numbers come from one scan of each file.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\0")
    if gone := [c for c in columns if c not in raw.columns]:
        raise ConstraintError(f"{path}: columns are missing: {', '.join(gone)}")
    df = raw.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("__n"))
    return df.withColumn("row", (F.row_number().over(W.partitionBy("file").orderBy("__n")) - 1).cast("int")).drop("__n")


def read_labelled(spark: SparkSession, path: str, stem: str, allowed: tuple[str, ...] = LABELS) -> DataFrame:
    """premise, hypothesis, source, tag with example ids; blank fields and labels outside their domain are rejected."""
    df = read_strings(spark, path, ("premise", "hypothesis", "source", "tag"))
    reject(violations(df, "row", {"blank_premise": blank("premise"), "blank_hypothesis": blank("hypothesis"), "unknown_label": label_domain("tag", allowed)}))
    return df.withColumn("example_id", example_id(stem, "row"))


def read_balanced(spark: SparkSession, path: str, columns: tuple[str, ...], label: str) -> DataFrame:
    """CSV with exactly these columns, nothing blank, labels in their domain."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\0")
    require_exact_columns(raw, columns)
    key = F.concat_ws("|", *columns)
    reject(violations(raw, key, {f"blank_{c}": blank(c) for c in columns} | {"unknown_label": label_domain(label)}))
    return raw


def read_portable(spark: SparkSession, path: str) -> DataFrame:
    """Nine-column split: exact header, unique ids, error type only and always beside a contradiction, contained paths."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\0")
    require_exact_columns(raw, tuple(PORTABLE_ROW.names))
    df = raw.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns))
    contra = F.col("label") == LABELS[0]
    rules = {"blank_id": blank("id"), "unknown_label": label_domain("label"), "error_type": contra == blank("error_type"), "path": ~portable_path("text_path")}
    twice = df.groupBy("id").count().where("count > 1").select(F.lit("repeated_id").alias("rule"), F.col("id").alias("key"))
    reject(violations(df, "id", rules), twice)
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, lines that aren't objects of the schema are rejected by their text."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    reject(violations(df, F.substring("value", 1, 80), {"not_an_object": F.col("r._corrupt").isNotNull() | F.col("r").isNull() | ~F.ltrim("value").startswith("{")}))
    return df.select("r.*").drop("_corrupt")


def read_expert_rules(cells: DataFrame, include: str = "да") -> DataFrame:
    """Rules of an expert sheet (rule_id, name, kind, weight, comment, instruction, use): rows marked for use, weight as a number."""
    from docketry.functions.dates import percent

    return cells.where(F.lower(F.trim("use")) == include).withColumn("weight_percent", percent("weight")).drop("weight", "use")


def gold_arrays(rows: DataFrame) -> DataFrame:
    """Rows (row, hypothesis, reference, text) of a headerless sheet as one row per hypothesis key with arrays in order.

    A blank reference means that the hypothesis has no gold; of equal citations the last stays.
    """
    from docketry.functions.keys import loose_key

    df = rows.withColumn("hypothesis_key", loose_key("hypothesis"))
    item = F.when(~blank("reference"), F.struct("row", "reference", "text"))
    return df.groupBy("hypothesis_key").agg(F.array_sort(F.collect_list(item)).alias("g")).select(
        "hypothesis_key", F.array_distinct(F.transform("g", lambda x: x["reference"])).alias("references"), F.array_distinct(F.transform("g", lambda x: x["text"])).alias("texts")
    )


def pair_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files (path) matched by subject key: key, left, right, n_left, n_right; anything but one of each isn't a pair."""
    side = lambda df, name: df.groupBy(subject_key("path").alias("key")).agg(F.min("path").alias(name), F.count("*").alias(f"n_{name}"))
    out = side(left, "left").join(side(right, "right"), "key", "full").fillna(0, ["n_left", "n_right"])
    return out.withColumn("paired", (F.col("n_left") == 1) & (F.col("n_right") == 1))


def attach_documents(rows: DataFrame, documents: DataFrame, key: str = "document") -> DataFrame:
    """Every row with the whole text of its document; rows without one are violations for the caller (text is null)."""
    return rows.join(documents.select(key, F.col("text").alias("document_text")), key, "left")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256, edition of the files at ``path``."""
    from docketry.functions.dates import edition_label

    df = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return df.withColumn("edition", edition_label("path"))


# paths and manifests


def portable_path(column: str | Column) -> Column:
    """True for a relative path that stays below its root: no drive, backslash, empty or dot parts."""
    c = F.col(column) if isinstance(column, str) else column
    parts = F.split(c, "/")
    return (F.trim(c) != "") & ~c.startswith("/") & ~F.contains(c, F.lit("\\")) & ~c.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def resolve_path(root: str, relative: str) -> str:
    """A file below a local root; absolute, escaping, backslashed and linked paths are refused."""
    p = PurePosixPath(relative)
    if not relative or "\\" in relative or p.is_absolute() or any(x in ("..", ".", "") for x in relative.split("/")):
        raise ConstraintError(f"not a portable path: {relative!r}")
    at = root
    for part in p.parts:
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise ConstraintError(f"a link is in the path: {relative!r}")
    return at


def tree_hash(files: DataFrame) -> DataFrame:
    """A digest of the relative paths and digests of files (path, sha256), and their number."""
    return files.agg(set_digest(F.concat_ws("\0", "path", "sha256")).alias("sha256"), F.count("*").alias("files"))


def frame_hash(df: DataFrame, order: str | None = None) -> DataFrame:
    """A digest of the rows' JSON, and their number; with ``order``, a column that numbers the rows, their order counts."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.agg(set_digest(line if order is None else F.concat_ws("\0", F.col(order).cast("string"), line)).alias("sha256"), F.count("*").alias("rows"))


def check_manifest(expected: dict, actual: dict) -> None:
    """Every expected key has to be there and equal."""
    if bad := sorted(k for k, v in expected.items() if actual.get(k) != v):
        raise ConstraintError(f"the manifest differs in {', '.join(bad)}")


def merge_parameters(defaults: dict, given: dict) -> dict:
    if unknown := sorted(set(given) - set(defaults)):
        raise ConstraintError(f"unknown parameters: {', '.join(unknown)}")
    return defaults | given


# sinks


def metadata_table(spark: SparkSession, values: dict) -> DataFrame:
    """key, value in key order; values that aren't strings as JSON."""
    rows = [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)) for k, v in sorted(values.items())]
    return spark.createDataFrame(rows, "key string, value string")


def replace(write: Callable[[str], None], path: str, spark: SparkSession, check: Callable[[str], None] | None = None) -> None:
    """Write to a staging path, check what is there, and only then put it in the target's place; what was there goes last."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged, old = (f"{path.rstrip('/')}.{name}-{uuid.uuid4().hex}" for name in ("staged", "old"))
    at = {p: jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged, old)}
    fs = at[path].getFileSystem(conf)
    try:
        write(staged)
        if check:
            check(staged)
    except BaseException:
        fs.delete(at[staged], True)
        raise
    if had := fs.exists(at[path]):
        fs.rename(at[path], at[old])
    if not fs.rename(at[staged], at[path]):
        if had:
            fs.rename(at[old], at[path])
        raise OSError(f"{path} could not be replaced")
    if had:
        fs.delete(at[old], True)


def write_tables(tables: dict[str, DataFrame], path: str, metadata: dict | None = None) -> None:
    """A folder of Parquet tables and one of run metadata, replaced as a whole once all are written."""
    spark = next(iter(tables.values())).sparkSession
    every = tables | {"run_metadata": metadata_table(spark, metadata or {})}
    replace(lambda at: [df.write.parquet(f"{at}/{name}") for name, df in every.items()], path, spark)


def workbook_path(folder: str, name: str, now: datetime.datetime | None = None) -> str:
    """Name of a workbook with its time in UTC."""
    return f"{folder.rstrip('/')}/{name}_{(now or datetime.datetime.now(datetime.UTC)):%Y%m%dT%H%M%SZ}.xlsx"


def write_workbook(tables: dict[str, DataFrame], path: str, metadata: dict | None = None, most: int = 1_000_000) -> None:
    """A workbook with a sheet for each table and one of run metadata, for people: tables of more rows than a sheet takes are refused."""
    from docketry.sources.office import write_xlsx

    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if df.limit(most + 1).count() > most:
            raise ConstraintError(f"{name} has more rows than a sheet; write_tables takes it")
    every = tables | {"run_metadata": metadata_table(spark, metadata or {})}
    staged = f"{path}.staged"
    write_xlsx({name: df.toPandas() for name, df in every.items()}, staged)
    os.replace(staged, path)


def write_review_package(pairs: DataFrame, path: str) -> None:
    """Pairs with blank expert columns, a folder for each dataset, document and task."""
    df = pairs.withColumn("expert_label", F.lit("")).withColumn("expert_comment", F.lit("")).withColumn("document", safe_name("document"))
    df.repartition("test_dataset", "document", "task").sortWithinPartitions("test_dataset", "document", "task", "hypothesis", "rank").write.mode("overwrite").partitionBy("test_dataset", "document", "task").option("header", True).csv(path)


def write_export(units: DataFrame, notes: DataFrame, path: str) -> dict:
    """CSV with byte-order mark and JSONL of units, JSONL of notes, and a manifest of hashes, which is returned."""
    spark = units.sparkSession
    first = units.columns[0]
    units.select(*(F.col(c).cast("string") if k.startswith(("array", "struct")) else F.col(c) for c, k in units.dtypes)).withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).csv(f"{path}/units_csv")
    units.write.mode("overwrite").json(f"{path}/units_jsonl")
    notes.write.mode("overwrite").json(f"{path}/notes_jsonl")
    h = frame_hash(units).first()
    manifest = {"units": h.rows, "units_sha256": h.sha256, "notes": notes.count()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_split(rows: DataFrame, path: str, label: str = "label", targets: DataFrame | None = None) -> None:
    """A split as CSV with and without labels, metadata, pending rows, weights, a report against targets and a snapshot of all rows; replaced as a whole."""
    from docketry.operators.curation import selected_rows, split_report, weighted_rows

    chosen = selected_rows(rows)
    parts = {"metadata": chosen.select("id", "status", "split"), "pending": rows.where(F.col("status") == "pending"), "weights": weighted_rows(chosen, label).select("id", "weight"), "snapshot": rows}
    if targets is not None:
        parts["report"] = split_report(chosen, targets, ("split", label))
    flat = chosen.select(*(F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in chosen.dtypes))

    def write(at: str) -> None:
        for name, df in (("labelled", flat), ("unlabelled", flat.drop(label))):
            df.write.option("header", True).csv(f"{at}/{name}")
        for name, df in parts.items():
            df.write.parquet(f"{at}/{name}")

    replace(write, path, rows.sparkSession)


def write_links(rows: DataFrame, array: str, key: str, path: str) -> None:
    """The 1:n table of an array of structs."""
    rows.select(key, F.posexplode(array).alias("position", "t")).select(key, "position", "t.*").write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_lines(rows: DataFrame, line: Column, order: str, path: str) -> None:
    """Numbered lines of a report as text, in as many files as there are ranges; the files' names follow the order."""
    n = numbered(rows.select(line.alias("__line"), order), [order], "__n")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = n.select("__n", F.concat(F.col("__n").cast("string"), F.lit(". "), F.col("__line")).alias("value")).repartitionByRange(parts, "__n").sortWithinPartitions("__n")
    replace(lambda at: ranged.select("value").write.text(at), path, rows.sparkSession)


def write_review_report(reviewed: DataFrame, path: str) -> None:
    """A review (doc_id, reasons, evidence, flags) for people: its counts and findings as text, and a workbook of three sheets."""
    counts = reviewed.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("documents")).orderBy("reason")
    decisions = reviewed.select("doc_id", F.when(F.size("reasons") > 0, "exclude").otherwise("keep").alias("action"), F.array_join("reasons", ", ").alias("reasons"))
    evidence = reviewed.select("doc_id", F.explode("evidence").alias("reason", "passages")).select("doc_id", "reason", F.explode("passages").alias("passage"))
    flags = reviewed.select("doc_id", F.explode("flags").alias("flag", "passages")).select("doc_id", "flag", F.explode("passages").alias("passage"))
    write_workbook({"decisions": decisions.orderBy("doc_id"), "evidence": evidence.orderBy("doc_id", "reason"), "review": flags.orderBy("doc_id", "flag")}, f"{path}/review.xlsx", {r.reason: str(r.documents) for r in counts.collect()})
    write_lines(evidence.withColumn("key", F.concat_ws("|", F.col("doc_id").cast("string"), "reason", "passage")), F.concat_ws(": ", F.col("doc_id").cast("string"), "reason", "passage"), "key", f"{path}/findings")


def write_index(vectors: DataFrame, path: str) -> dict:
    """Vector table (id, vector): staged, read back and counted before it takes the old one's place; returns its manifest."""
    from docketry.functions.vectors import is_vector

    spark = vectors.sparkSession
    if vectors.where(~is_vector("vector")).limit(1).count():
        raise ConstraintError("vectors have to be finite and other than zero")
    want = frame_hash(vectors).first()

    def check(at: str) -> None:
        if frame_hash(spark.read.parquet(at).select(*vectors.columns)).first() != want:
            raise ConstraintError("the index doesn't hold all vectors")

    replace(lambda at: vectors.write.parquet(at), path, spark, check)
    return {"rows": want.rows, "sha256": want.sha256}


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
