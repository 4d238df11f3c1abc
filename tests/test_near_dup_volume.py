"""What near duplicates move: sets are compared whole only where their sketches do not rule a pair out."""

import random

from pyspark.sql import functions as F

from quillmill.operators import similarity as S


def test_sketches_never_rule_out_a_similar_pair(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for n in (1, 3, 31, 32, 33, 64, 120, 129, 700):  # pairs whose sketches differ in length too
        for drop in (0, n // 9, n // 5, n // 2, n):
            a = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
            rows += [(k, n, sorted(a)), (k + 1, n, sorted(a[drop:] + [rng.getrandbits(64) - (1 << 63) for _ in range(drop)])), (k + 2, max(1, n - drop), sorted(a[: max(1, n - drop)]))]
            k += 3
    sets = spark.createDataFrame(rows, "k long, n int, hashes array<long>")
    made = {r["k"]: r["sketch"] for r in S.sketches(sets).collect()}
    whole = {r[0]: set(r[2]) for r in rows}
    pairs = [(i, i + j) for i in range(0, k, 3) for j in (1, 2)]
    assert all(S.bits_apart(made[a], made[b]) <= len(whole[a] ^ whole[b]) for a, b in pairs)
    assert any(len(made[a]) != len(made[b]) and 100 * len(whole[a] & whole[b]) >= 80 * len(whole[a] | whole[b]) for a, b in pairs)
    df = spark.createDataFrame(pairs, "a long, b long")
    left = {tuple(r) for r in S.likely(df, spark.createDataFrame([(k, len(whole[k]), bytearray(v)) for k, v in made.items()], "k long, n int, sketch binary"), 80).collect()}
    true = {(a, b) for a, b in pairs if 100 * len(whole[a] & whole[b]) >= 80 * len(whole[a] | whole[b])}
    assert true <= left and len(left) < len(pairs) - 20


def test_rows_are_told_by_marks(spark):
    keys = [0, 1, 7, 8, 32767, 32768, (1 << 33) + 5, (3 << 33) + 40000]
    rows = spark.createDataFrame([(k + d, str(k)) for k in keys for d in (0, 2)], "k long, x string").distinct()
    got = [r["k"] for r in S.among(rows, S.marks(spark.createDataFrame([(k,) for k in keys], "k long"))).collect()]
    assert sorted(got) == keys and S.among(rows, S.marks(rows.select("k").limit(0))).count() == 0


def test_only_likely_pairs_are_compared_whole(spark, monkeypatch):
    """Documents that share a passage are candidates, but their hashes do not go through a join."""
    passage = " ".join(f"p{i}" for i in range(14))
    texts = [passage + " " + " ".join(f"t{d}x{i}" for i in range(60)) for d in range(60)]
    texts += [t + " more" for t in texts[:5]]
    counts = []
    alike = S.alike
    monkeypatch.setattr(S, "alike", lambda pairs, *a: counts.append(pairs.count()) or alike(pairs, *a))
    seen = []
    led = S.led_pairs
    monkeypatch.setattr(S, "led_pairs", lambda *a: seen.append(led(*a)) or seen[-1])
    monkeypatch.setattr(S, "rare_first", lambda sets, *a: lambda h: F.struct(F.lit(0).alias("often"), h.alias("h")))
    got = {r["id"]: r["twin"] for r in S.survivors(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", [F.col("id")]).collect()}
    assert got == {i: i - 60 if i >= 60 else None for i in range(65)}
    assert sum(counts) == 5
