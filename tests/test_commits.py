"""Commits of several tables as one."""

import os

import pytest
from pyspark.sql import functions as F

from docketry.plans.curation_queries import committed_splits
from docketry.schemas import ConstraintError
from docketry.sources import commits


def test_both_splits_or_none(spark, tmp_path):
    at = f"file://{tmp_path}/splits"
    train, val = (spark.range(n).withColumn("label", F.lit(n)) for n in (5, 3))
    ids = lambda version=None: {k: sorted(r.id for r in v.collect()) for k, v in commits.read_tables(spark, at, version).items()}
    with pytest.raises(ConstraintError):
        commits.read_tables(spark, at)
    assert commits.commit_tables({"train": train, "val": val}, at, metadata={"run": "é"}) == 1
    assert ids() == {"train": [0, 1, 2, 3, 4], "val": [0, 1, 2]} and commits.manifest(spark, at)["metadata"] == {"run": "é"}
    # the second table's write fails: readers keep both tables of the first commit, and nothing is left behind
    broken = val.withColumn("label", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        commits.commit_tables({"train": train.where("id > 2"), "val": broken}, at)
    assert ids() == {"train": [0, 1, 2, 3, 4], "val": [0, 1, 2]} and len(os.listdir(tmp_path / "splits/versions")) == 1
    # a killed writer leaves a folder and a draft that no reader looks at
    train.write.parquet(f"{at}/versions/000000000002-killed/train")
    (tmp_path / "splits/commits/.000000000002-killed").write_text("{")
    assert commits.versions(spark, at) == [1] and ids()["train"] == [0, 1, 2, 3, 4]
    # what is wrong in either split stops both before anything is written
    bad = spark.createDataFrame([("label", "7")], "rule string, key string")
    with pytest.raises(ConstraintError, match="label"):
        commits.commit_tables({"train": train, "val": val}, at, (bad,))
    # tables of earlier commits stay readable; two writers from one base: the second one loses
    assert commits.commit_tables({"train": train.where("id > 2"), "val": val.where("false")}, at) == 2
    with pytest.raises(ConstraintError, match="commit 2"):
        commits.commit_tables({"train": train.where("id = 0"), "val": val}, at, base=1)
    assert ids() == {"train": [3, 4], "val": []} and ids(1)["train"] == [0, 1, 2, 3, 4]
    assert commits.read_tables(spark, at)["val"].columns == ["id", "label"]
    assert commits.forget(spark, at) == [1] and commits.versions(spark, at) == [2] and ids()["train"] == [3, 4]
    with pytest.raises(ConstraintError):
        commits.commit_tables({}, at)


def test_committed_splits_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").collect()
    want = {}
    for version in (1, 2):
        for r in rows:
            if version == 1 or r.lang is not None:
                name = "train" if r.doc_id % 7 < 4 else "val" if r.doc_id % 7 < 6 else "test"
                n, ids, langs, chars = want.get((version, name), (0, 0, 0, 0))
                want[version, name] = n + 1, ids + r.doc_id, langs + (r.lang is not None), chars + len(r.text or "")
    got = {(r.version, r.split): (r.n, r.ids, r.with_lang, r.chars) for r in committed_splits(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(got) == 6
