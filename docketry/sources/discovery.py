"""What is found on the driver before a run: datasets, models, prompts, bundles, documents, archives, charts."""

from __future__ import annotations

import ast
import hashlib
import json
import os
import shutil
from collections.abc import Sequence
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.citations import law_numbers
from docketry.schemas import ConstraintError
from docketry.sources.tables import check_manifest, file_inventory, pair_files, tree_hash

# datasets and documents


def paired_datasets(left: str, right: str, first: Sequence[str] = ()) -> list[tuple[str, str, str]]:
    """(name, left folder, right folder) of child folders of two roots whose names agree but for case, ``first`` ones in their order, then by name."""
    side = lambda root: {d.casefold(): d for d in sorted(os.listdir(root)) if os.path.isdir(os.path.join(root, d))}
    a, b = side(left), side(right)
    if alone := sorted(set(a) ^ set(b)):
        raise ConstraintError(f"folders without a counterpart: {', '.join(alone)}")
    order = {name.casefold(): n for n, name in enumerate(first)}
    return [(a[k], os.path.join(left, a[k]), os.path.join(right, b[k])) for k in sorted(a, key=lambda k: (order.get(k, len(order)), k))]


def dataset_pairs(spark: SparkSession, datasets: list[tuple[str, str, str]]) -> DataFrame:
    """dataset and the paired files of all datasets; see ``tables.pair_files``."""
    out = None
    for name, left, right in datasets:
        files = lambda root: spark.read.format("binaryFile").load(root).select("path")
        pairs = pair_files(files(left), files(right)).select(F.lit(name).alias("dataset"), "*")
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        raise ConstraintError("no dataset was found")
    return out


def chosen_documents(paths: Sequence[str], suffix: str = ".docx") -> list[str]:
    """Explicitly chosen files, each there and of this kind, each once, by name."""
    bad = [p for p in paths if not p.lower().endswith(suffix) or not os.path.isfile(p)]
    if bad or not paths:
        raise ConstraintError(f"no {suffix} files: {', '.join(bad) or 'none is named'}")
    return sorted(dict.fromkeys(paths), key=lambda p: (os.path.basename(p), p))


def code_inventory(spark: SparkSession, path: str, text: DataFrame | None = None) -> DataFrame:
    """path, length, sha256, edition of code files, and the law numbers that their texts (path, text) name."""
    files = file_inventory(spark, path)
    if text is None:
        return files
    return files.join(text.select("path", law_numbers("text").alias("law_numbers")), "path", "left")


# models, prompts and bundles


def model_artifacts(root: str | None = None, listed: str | None = None, manifest: str = "manifest.json") -> list[dict]:
    """Manifests of models with their folder: all below a root, or those that a JSON list names; a model is there once."""
    if (root is None) == (listed is None):
        raise ConstraintError("either a root or a list of models has to be given")
    if listed is not None:
        with open(listed, encoding="utf-8") as f:
            folders = [os.path.join(os.path.dirname(listed), p) for p in json.load(f)]
    else:
        folders = sorted(d for d, _, names in os.walk(root) if manifest in names)
    out = []
    for d in folders:
        with open(os.path.join(d, manifest), encoding="utf-8") as f:
            out.append(json.load(f) | {"path": d})
    names = [m.get("name") for m in out]
    if None in names or len(set(names)) != len(names):
        raise ConstraintError("models need names of their own")
    return out


def prompt_constants(path: str, names: Sequence[str]) -> tuple[dict[str, object], str]:
    """Literal constants of a Python file, read without running it, and the file's SHA-256."""
    with open(path, "rb") as f:
        source = f.read()
    found = {}
    for node in ast.parse(source).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value else []
        for t in targets:
            if isinstance(t, ast.Name) and t.id in names:
                try:
                    found[t.id] = ast.literal_eval(node.value)
                except ValueError as e:
                    raise ConstraintError(f"{t.id} is no literal") from e
    if gone := [n for n in names if n not in found]:
        raise ConstraintError(f"constants are missing: {', '.join(gone)}")
    return found, hashlib.sha256(source).hexdigest()


def load_bundle(spark: SparkSession, folder: str, manifest: str = "manifest.json") -> tuple[DataFrame, DataFrame, dict]:
    """Corpus and index of a bundle and its manifest, whose digests of both have to be right."""
    with open(os.path.join(folder, manifest), encoding="utf-8") as f:
        said = json.load(f)
    tables, actual = [], {}
    for name in ("corpus", "index"):
        at = os.path.join(folder, said[name])
        files = spark.read.format("binaryFile").load(at).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))
        actual[f"{name}_sha256"] = tree_hash(files.where(~F.col("path").startswith("_"))).first().sha256
        tables.append(spark.read.parquet(at))
    check_manifest({k: said.get(k) for k in actual}, actual)
    return tables[0], tables[1], said


# archives


def archive_plan(files: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, sha256) to be moved to the archive, those of ``excluded`` (path, sha256), and the exclusions that don't fit the files."""
    e = excluded.select("path", F.col("sha256").alias("__hash"))
    both = files.join(e, "path", "right")
    rule = F.when(F.col("sha256").isNull(), "not_found").when(F.col("sha256") != F.col("__hash"), "changed")
    bad = both.select(rule.alias("rule"), F.col("path").alias("key")).where("rule is not null")
    return files.join(e, "path", "left_semi"), bad


def move_to_archive(moves: Sequence[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """Move local files (from, to, sha256): all are checked before any is moved, and if one move fails all are taken back.

    Returns the moves by which ``take_back`` undoes them.
    """
    for src, dst, want in moves:
        with open(src, "rb") as f:
            if hashlib.sha256(f.read()).hexdigest() != want:
                raise ConstraintError(f"{src} has changed")
        if os.path.exists(dst):
            raise ConstraintError(f"{dst} is there already")
    done: list[tuple[str, str]] = []
    try:
        for src, dst, _ in moves:
            os.makedirs(os.path.dirname(dst), exist_ok=True)
            shutil.move(src, dst)
            done.append((src, dst))
    except OSError:
        take_back(done)
        raise
    return done


def take_back(done: Sequence[tuple[str, str]]) -> None:
    for src, dst in reversed(done):
        os.makedirs(os.path.dirname(src), exist_ok=True)
        shutil.move(dst, src)


# charts


def grouped_bars(rows: Sequence[tuple[str, dict[str, float | None]]], panels: Sequence[str], width: int = 760, height: int = 260) -> str:
    """An SVG with a panel for each metric (0 to 1) and a bar for each row; a missing value has no bar."""
    parts, bar = [], (width - 80) / max(len(rows), 1)
    for n, panel in enumerate(panels):
        top = n * height
        parts.append(f'<text x="10" y="{top + 20}" font-size="14">{escape(panel)}</text><line x1="60" y1="{top + height - 50}" x2="{width - 20}" y2="{top + height - 50}" stroke="black"/>')
        for k, (name, values) in enumerate(rows):
            v, x = values.get(panel), 60 + k * bar
            parts.append(f'<text x="{x + bar / 2:.1f}" y="{top + height - 32}" font-size="11" text-anchor="middle">{escape(name)}</text>')
            if v is not None:
                h = (height - 90) * min(max(v, 0.0), 1.0)
                parts.append(f'<rect x="{x + bar * 0.15:.1f}" y="{top + height - 50 - h:.1f}" width="{bar * 0.7:.1f}" height="{h:.1f}" fill="#4477aa"/><text x="{x + bar / 2:.1f}" y="{top + height - 54 - h:.1f}" font-size="11" text-anchor="middle">{v:.2f}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height * len(panels)}" font-family="sans-serif">{"".join(parts)}</svg>'
