"""Running accuracy over a stream against the same over a table, across a restart."""

import datetime
import random

import pytest

from parley.operators import windows
from parley.session import share_code
from parley.streaming import running

pytest.importorskip("google.protobuf")


def test_running_share(spark, tmp_path):
    """Rows arrive out of order in several batches, the query is stopped and started again; late rows aren't counted."""
    share_code(spark)
    for k, v in running.STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(3)
    start = datetime.datetime(2020, 1, 1)
    rows = [(rng.choice("ab"), start + datetime.timedelta(minutes=i), i, rng.random() < 0.6 if i % 9 else None) for i in range(60)]
    schema, source = "model string, at timestamp, pos long, hit boolean", str(tmp_path / "in")

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        made = running.running_share(stream, "model", "at", "pos", "hit", "20 minutes")
        query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect()

    mixed = [x for i in range(0, 60, 15) for x in rng.sample(rows[i : i + 15], 15)]
    arrive(mixed[:20])
    first = run()
    assert len(first) < 20
    arrive(mixed[20:45])
    arrive(mixed[45:])
    # A row that is far too late, then one that lets all others go.
    arrive([("a", start - datetime.timedelta(hours=9), -1, True), ("a", start + datetime.timedelta(days=9), 999, True)])
    arrive([("b", start + datetime.timedelta(days=9, minutes=1), 1000, True)])
    found = run()
    want = {}
    for name in "ab":
        table = spark.createDataFrame([x for x in rows if x[0] == name], schema)
        want |= {(name, r.pos): r.share for r in windows.running_share(table, "pos", "hit").collect()}
    got = {(r.model, r.pos): r.share for r in found}
    assert {k: v for k, v in got.items() if k[1] < 999} == pytest.approx(want)
    assert len(found) == len(got)
    assert {(r.model, r.pos) for r in first} <= set(got)
