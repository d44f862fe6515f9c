"""Work that must be done once: requests to a server, and preparation that stopped halfway."""

from pyspark.sql import functions as F

from docketry import models
from docketry.streaming import ledger


def test_each_payload_is_sent_once_however_often_the_answers_are_read(spark, tmp_path):
    log = str(tmp_path / "sent")

    def send(request):
        with open(log, "a") as f:
            f.write(request["p"] + "\n")
        return {"said": request["p"].upper()}

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, prompt string")
    answered, new = models.ask_server(rows, send, lambda p: {"p": p})
    for _ in range(2):
        assert new.count() == 2 and {r.id: r.response for r in answered.collect()} == {1: '{"said": "A"}', 2: '{"said": "B"}', 3: '{"said": "A"}'}
    assert sorted(open(log).read().split()) == ["a", "b"]
    again, none = models.ask_server(rows, send, lambda p: {"p": p}, cache=new)
    assert none.count() == 0 and again.where("response IS NOT NULL").count() == 3
    assert sorted(open(log).read().split()) == ["a", "b"]


def test_a_run_that_stopped_halfway_is_done_again(spark, tmp_path):
    variants = spark.createDataFrame([("v1",), ("v2",)], "variant_id string")
    torn = tmp_path / "out" / "fingerprint=f" / "run-0"
    variants.where("variant_id = 'v1'").withColumn("part", F.lit("half")).write.parquet(str(torn))
    (torn / "_SUCCESS").unlink()
    got = ledger.prepare_missing(variants, str(tmp_path / "out"), "f", lambda df: df.withColumn("part", F.lit("whole")))
    assert sorted(tuple(r) for r in got.collect()) == [("v1", "whole"), ("v2", "whole")]
    assert ledger.prepare_missing(variants.limit(0), str(tmp_path / "new"), "f", lambda df: df.withColumn("part", F.lit("whole"))).count() == 0
