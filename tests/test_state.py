"""State of the trailing-flow stream goes when an entity stays away."""

import datetime as dt
import time

from moorline.plans.scratch import folder
from moorline.streaming import streams as S

SCHEMA = "system_id string, station_id string, observed_at timestamp_ntz, fetched_at timestamp_ntz, bikes int"


def test_state_is_empty_after_the_entity_is_forgotten(spark, tmp_path):
    S.with_state(spark)
    at = lambda minute: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)
    files = [
        [("x", 0, 5), ("x", 10, 3), ("y", 5, 1)],
        [("y", 200, 2)],  # the watermark passes x's last observation by more than 60 minutes after this batch
        [("y", 240, 4)],
        [("y", 250, 4), ("x", 260, 9), ("x", 265, 8)],
    ]
    for n, rows in enumerate(files):
        df = spark.createDataFrame([("s", k, at(m), at(m + 1), b) for k, m, b in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n < len(files) - 1:
            time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}
    for forget in (60, 100_000):
        path = folder(spark, f"flow{forget}")
        write = S.flow(stream, 60, 60, forget).writeStream.format("parquet").outputMode("append").option("path", path)
        q = write.option("checkpointLocation", folder(spark, "flow-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        out[forget] = {(r.station_id, r.us // 60_000_000 % 1440): (r.rentals, r.returns, r.n_changes, r.since_change_min) for r in spark.read.parquet(path).collect()}
    far, near = out[100_000], out[60]
    same = {k for k in far if k not in {("x", 260), ("x", 265)}}
    assert {k: near[k] for k in same} == {k: far[k] for k in same}
    assert far["x", 260] == (0, 6, 1, 0.0)  # the old count was still there
    assert near["x", 260] == (0, 0, 0, None)  # forgotten: x starts anew
    assert near["x", 265] == (1, 0, 1, 0.0)
