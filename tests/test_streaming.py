"""Streaming forms give what the batch operators give, however the stream is split."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import metering
from quillmill.streaming import admission

CAPS = metering.Caps(user=1, user_aux=3, total=12, total_aux=8)


def stream_of(spark, rows, parts, folder, late):
    """Rows (ts, event_id, user, op, failed, refund_of) written as one file a batch, then one far ahead that lets all others pass."""
    schema = "s string, event_id long, user string, op string, failed boolean, refund_of long"
    ends = [[("2031-01-01 00:00:00", -1, None, "end", False, None)], [("2032-01-01 00:00:00", -2, None, "end", False, None)]]
    for i, part in enumerate([*parts, *ends]):
        if part:
            spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("s")).drop("s").coalesce(1).write.mode("append").parquet(f"{folder}/b{i:03d}")
    read = spark.readStream.schema("event_id long, user string, op string, failed boolean, refund_of long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")
    decided = admission.admission_stream(read, CAPS, failed=F.col("failed"), refund_of=F.col("refund_of"), late=late)
    spark.conf.set(*admission.STATE_STORE)
    try:
        q = decided.writeStream.format("memory").queryName("decided").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}-cp").start()
        q.awaitTermination(300)
        assert q.exception() is None
    finally:
        spark.conf.unset(admission.STATE_STORE[0])
    return {r["event_id"]: (r["admitted"], r["reason"]) for r in spark.table("decided").collect() if r["event_id"] >= 0}


def plain(rows):
    out = {}
    days = {}
    for s, i, user, op, failed, refund_of in sorted(rows, key=lambda r: (r[0], r[5] is not None, r[1])):
        d = days.setdefault(s[:10], {"n": 0, "aux": 0, "own": {}, "in": {}})
        if refund_of is not None:
            if refund_of in d["in"]:
                u, o = d["in"].pop(refund_of)
                d["n"] -= 1
                d["aux"] -= o == "aux"
                d["own"][u, o] -= 1
            continue
        own = d["own"].get((user, op), 0)
        reason = "global" if d["n"] >= CAPS.total else "aux_global" if op == "aux" and d["aux"] >= CAPS.total_aux else "user" if own >= (CAPS.user_aux if op == "aux" else CAPS.user) else None
        out[i] = (reason is None, reason)
        if reason is None and not failed:
            d["n"] += 1
            d["aux"] += op == "aux"
            d["own"][user, op] = own + 1
            d["in"][i] = user, op
    return out


def calls(rng, refunds):
    rows = [(f"2024-03-0{rng.randint(1, 3)} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 9):02d}", i, rng.choice(["u", "v", "w", "x", None]), rng.choice(["aux", "aux", "persona"]), rng.random() < 0.2, None) for i in range(150)]
    if refunds:
        rows += [(f"{s[:10]} 23:59:{i % 60:02d}" if i % 3 else s, 1000 + i, user, op, False, i) for s, i, user, op, *_ in rows[::4]]
    return rows


@pytest.mark.parametrize("split", ["ordered", "shuffled"])
def test_admission_by_any_split(spark, tmp_path, split):
    rng = random.Random(split)
    rows = calls(rng, refunds=False)
    batch = metering.admission(spark.createDataFrame([r[:5] for r in rows], "s string, event_id long, user string, op string, failed boolean").withColumn("ts", F.to_timestamp("s")), CAPS, failed=F.col("failed"))
    want = {r["event_id"]: (r["admitted"], r["reason"]) for r in batch.collect()}
    assert want == plain(rows)
    if split == "ordered":
        rows.sort()
        parts = [rows[i : i + 37] for i in range(0, len(rows), 37)]
    else:
        parts = [[r for r in rows if r[1] % 5 == i] for i in range(5)]
    assert stream_of(spark, rows, parts, str(tmp_path / "in"), "1 hour" if split == "ordered" else "5 days") == want


def test_refunds_as_later_events(spark, tmp_path):
    rng = random.Random(3)
    rows = calls(rng, refunds=True)
    want = plain(rows)
    assert want != plain([r for r in rows if r[5] is None])
    parts = [[r for r in rows if r[1] % 3 == i] for i in range(3)]
    assert stream_of(spark, rows, parts, str(tmp_path / "in"), "5 days") == want


def test_near_duplicates_in_batches(spark, tmp_path):
    from quillmill.operators import similarity
    from quillmill.streaming import near_dup

    rng = random.Random(12)
    base = [[f"{c}{rng.randint(0, 999)}" for c in rng.choices("abcdefgh", k=40)] for _ in range(12)]
    texts = []
    for i in range(150):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(40)] = f"x{rng.randint(0, 50)}"
        texts.append(" ".join(w))
    texts += ["", None, "same few words", "same few words", texts[3], texts[3]]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r["id"]: r["twin"] for r in similarity.survivors(docs, "id", "text", [F.col("id")]).collect()}
    for i, (lo, hi) in enumerate([(0, 39), (40, 79), (1, 0), (80, 119), (120, 199)]):  # in rank order, a file a batch; the third is empty
        docs.where(F.col("id").between(lo, hi)).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    got, index = {}, near_dup.AcceptedIndex(spark, f"file://{tmp_path}/index")

    def sink(rows, batch):
        got.update({batch: {r["id"]: r["twin"] for r in rows.collect()}})

    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b*"))
    each = near_dup.near_dup_batches(index, "id", "text", lambda: [F.col("id")], sink)
    q = stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(600)
    assert q.exception() is None and len(got) >= 4
    assert {i: t for rows in got.values() for i, t in rows.items()} == want
    again = max(got)
    was = got[again]
    ids = list(was)
    each(docs.where(F.col("id").isin(ids)), again)  # a replay
    assert got[again] == was
