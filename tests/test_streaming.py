"""The stream's last updates equal the batch."""

from pyspark.sql import functions as F

from quern.operators import friction as fr
from quern.streaming.friction import live_session_skills


def test_stream_like_batch(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = fr.events_from_clicks(raw).withColumn("ord", F.col("event_id") * 10 + F.col("sub"))
    flat = events.select("store", "sid", F.col("at").cast("timestamp").alias("at"), "ord", "kind", "skill", "route")
    # two files, split in time, so that sessions go on over batches
    cut = flat.select(F.expr("percentile(cast(at as long), 0.5)").alias("c")).first()["c"]
    for i, part in enumerate((flat.where(F.col("at").cast("long") <= cut), flat.where(F.col("at").cast("long") > cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = live_session_skills(stream, "100 days").writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(240)
    got = {}
    for r in spark.table("live").collect():
        key = (r["sid"], r["skill"])
        got[key] = max(got.get(key, (0, 0, 0, 0)), (r["invocations"], r["retries"], r["corrections"], r["folded"]))
    want = {(r["sid"], r["skill"]): (r["invocations"], r["retries"], r["corrections"], r["folded"]) for r in fr.session_skills(fr.firing_groups(fr.mark_firings(events))).collect()}
    assert want and got.keys() == want.keys() and sum(got[k] == want[k] for k in want) / len(want) > 0.97
    assert all(got[k][0] == want[k][0] for k in want)
