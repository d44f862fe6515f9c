"""Drifted files and their rewrite against a brute force over whole tables, and what happens to interrupted rewrites."""

import hashlib
import math
import os
import re
import zlib
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from docketry.llm import migrate
from docketry.llm.migrate import ADD, CLIENTS, RENAME, REORDER, WIDEN, Target, drifted, field, migrate_clients, rewrite

NAMES = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


def expected(rows):
    """file_no -> what the query says of it, from a list of dictionaries."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["client_id"]).encode()), r["client_id"]))
    size, found = 1 + len(rows) // 250, {}
    for k in range(0, len(rows), size):
        part, number = rows[k : k + size], k // size
        v = zlib.crc32(f"19:{number}".encode()) % 24
        v = 0 if v > 15 else v
        names, lines, nulls = list(NAMES), [], 0
        if v & 1:
            names[4], names[5] = names[5], names[4]
        if v & 4:
            names = [x for x in names if x not in ("nation_id", "segment")]
        if v & 2:
            names = names[:1] + names[:0:-1]
        for r in part:
            r = dict(r)
            if v & 8 and r["balance"] is not None:
                r["balance"] = float(pa.scalar(r["balance"], pa.float64()).cast(pa.float32(), safe=False).as_py())
            if v & 4:
                r["nation_id"], r["segment"] = -1, "none"
            if r["balance"] is not None:
                r["balance"] = math.floor(1048576 * r["balance"])
            if r["updated_at"] is not None:
                d = r["updated_at"].replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
                r["updated_at"] = (d.days * 86400 + d.seconds) * 10**6 + d.microseconds
            nulls += sum(r[n] is None for n in NAMES)
            lines.append("|".join("?" if r[n] is None else str(r[n]) for n in NAMES))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[number] = (v, len(part), nulls, sha(",".join(str(r["client_id"]) for r in part)), sha("\n".join(lines)), ",".join(names), ",".join(NAMES), v > 0)
    return found


def seen(frame):
    return {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in frame.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf, monkeypatch):
    from docketry.llm.queries import op12_schema_rewrite

    clients = spark.read.parquet(f"/root/testdata/{sf}/clients.parquet")
    monkeypatch.setattr(migrate, "GROUP_ROWS", 3)  # several row groups in a file
    frame = op12_schema_rewrite(spark, f"/root/testdata/{sf}")
    want = expected([r.asDict() for r in clients.collect()])
    assert seen(frame) == want
    assert {v for v, *_ in want.values()} == set(range(16))
    paths = [re.sub("^file:/+", "/", r.path) for r in frame.collect()]
    (folder,) = {os.path.dirname(p) for p in paths}
    assert sorted(os.listdir(folder)) == sorted(map(os.path.basename, paths))
    for p in paths:
        assert pq.read_schema(p).equals(CLIENTS.schema) and migrate.ids(pq.read_schema(p)) == list(range(1, 11))


def test_messy_rows_and_empty_tables(spark):
    at = datetime(2024, 2, 29, 23, 59, 59, 999999)
    plain = (None, None, "s", at, "a|b\n", None, "ö" * 5000, 2, None, -0.1)
    rows = [(k, *plain[1:]) for k in range(-3, 20)] + [(100, k, None, None, None, None, None, None, None, None) for k in range(3)]
    schema = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
    frame = spark.createDataFrame([(*r, "x") for r in rows], schema + ", place string")
    want = expected([dict(zip(NAMES, r)) for r in rows])
    assert seen(migrate_clients(frame)) == want and sum(w[1] for w in want.values()) == 26
    odd = migrate_clients(frame.limit(1).withColumn("client_id", F_null()).withColumn("balance", F_null("double"))).first()
    assert odd.n_rows == 1 and odd.ids_sha256 == hashlib.sha256(b"?").hexdigest()
    assert migrate_clients(frame.limit(0)).count() == 0


def F_null(kind="long"):
    from pyspark.sql import functions as F

    return F.lit(None).cast(kind)


TABLE = pa.Table.from_arrays([pa.array([None, 5]).cast(f.type) if f.type != pa.timestamp("us") else pa.array([None, 5], pa.timestamp("us")) for f in CLIENTS.schema], schema=CLIENTS.schema)


@pytest.mark.parametrize("bits", range(16))
def test_chains(bits):
    old = drifted(bits)(TABLE)
    assert CLIENTS.drift(old.schema) == bits
    new = CLIENTS.chain(bits)(old)
    assert new.schema.equals(CLIENTS.schema, check_metadata=False) and migrate.ids(new.schema) == list(range(1, 11))
    want = TABLE if not bits & ADD else TABLE.set_column(7, CLIENTS.schema.field(7), pa.array([-1, -1])).set_column(8, CLIENTS.schema.field(8), pa.array(["none"] * 2))
    assert new.equals(want)


def test_transforms_commute_with_concatenation():
    for bits in (RENAME, REORDER, ADD, WIDEN, 15):
        old, change = drifted(bits)(TABLE), CLIENTS.chain(bits)
        assert change(old).equals(pa.concat_tables([change(old.slice(0, 1)), change(old.slice(1))]))


def test_what_can_not_be_migrated():
    t = Target(pa.schema([field("a", pa.int64(), 1), field("b", pa.string(), 2)]))
    extra = pa.schema([field("z", pa.int8(), 9), field("a", pa.int32(), 1), field("b", pa.string(), 2)])
    assert t.drift(extra) == REORDER | WIDEN
    got = t.chain(t.drift(extra))(pa.table([[1], [2], ["x"]], schema=extra))
    assert got.to_pylist() == [{"a": 2, "b": "x"}]
    lacking = pa.schema([field("b", pa.string(), 2)])
    assert t.chain(t.drift(lacking))(pa.table([["x"]], schema=lacking)).to_pylist() == [{"a": None, "b": "x"}]
    for bad in (pa.schema([("a", pa.int64())]), pa.schema([field("a", pa.int64(), 1), field("b", pa.string(), 1)]), pa.schema([field("a", pa.string(), 1)])):
        with pytest.raises(ValueError):
            t.drift(bad)


def test_a_repeated_rewrite_reports_the_same(spark, tmp_path):
    """As after a lost executor: some files are done, one has left a part of a file behind."""
    for k in range(6):
        pq.write_table(drifted(3 * k % 16)(TABLE), tmp_path / f"part-{k}.parquet")
    before = {k: (tmp_path / f"part-{k}.parquet").read_bytes() for k in range(6)}
    first = sorted(map(tuple, rewrite(spark, str(tmp_path), CLIENTS).collect()))
    (tmp_path / "part-2.parquet").write_bytes(before[2])
    (tmp_path / "_part-2.parquet.7").write_bytes(before[2][:50])
    assert sorted(map(tuple, rewrite(spark, str(tmp_path), CLIENTS).collect())) == first
    assert (tmp_path / "part-0.parquet").read_bytes() == before[0]
    assert pc.all(pc.equal(pq.read_table(tmp_path / "part-2.parquet")["client_id"], TABLE["client_id"])).as_py()
    assert [r[1] for r in first] == [0, 3, 6, 9, 12, 15] and [r[3] for r in first] == [False] + [True] * 5


def test_a_file_that_can_not_be_migrated_stays(spark, tmp_path):
    pq.write_table(pa.table({"client_id": ["x"]}), tmp_path / "part-0.parquet")
    with pytest.raises(Exception, match="id of its own"):
        rewrite(spark, str(tmp_path), CLIENTS)
    assert os.listdir(tmp_path) == ["part-0.parquet"]
