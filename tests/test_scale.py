"""Operators that work on long sequences and many keys, against plain versions."""

import random

from pyspark.sql import functions as F

from quillmill.operators import attribution
from quillmill.operators.running import running
from quillmill.sources import gitlog


def test_running_over_blocks(spark):
    rng = random.Random(3)
    rows = [(k, p, rng.randint(0, 5), rng.choice([None, None, f"a{p}"])) for k in ("x", "y", None) for p in sorted(rng.sample(range(500), 120))]
    df = spark.createDataFrame(rows, "k string, p long, n int, a string").repartition(5)
    for block in (7, 64, 1 << 16):
        got = running(df, ["k"], "p", {"s": F.col("n")}, {"last": F.col("a")}, block).collect()
        assert len(got) == len(rows)
        for r in got:
            up_to = [x for x in rows if x[0] == r["k"] and x[1] <= r["p"]]
            assert r["s"] == sum(x[2] for x in up_to)
            assert r["last"] == next((x[3] for x in reversed(up_to) if x[3]), None)
    assert running(df.limit(0), ["k"], "p", {"s": F.col("n")}).count() == 0


def test_blame_of_one_long_file_uses_many_tasks(spark):
    lines = 300_000  # porcelain rows of one file, in blocks of 65,536
    text = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("author-mail <a"), (F.col("pos") % 7).cast("string"), F.lit("@x>"))).when(F.col("pos") % 3 == 2, "\tcode").otherwise("summary")
    rows = spark.range(lines).select(F.lit("f").alias("path"), F.col("id").alias("pos")).withColumn("line", text)
    blame = gitlog.parse_blame(rows, "me@x")
    got = blame.agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.countDistinct("line_no").alias("d"), F.sum((F.col("author") == F.concat(F.lit("a"), ((F.col("line_no") - 1) * 3 % 7).cast("string"), F.lit("@x"))).cast("int")).alias("right")).first()
    assert (got["n"], got["lo"], got["hi"], got["d"], got["right"]) == (lines // 3, 1, lines // 3, lines // 3, lines // 3)
    plan = blame._jdf.queryExecution().toString()
    assert "_block" in plan


def test_owned_blocks_by_prefix_sums(spark):
    rng = random.Random(5)
    blame = [(f"f{f}", i, rng.choice(["me@x", "you@x", None])) for f in range(4) for i in range(1, 60) if f != 3 or i % 5]  # f3 has gaps
    blocks = [(rng.choice(["f0", "f1", "f2", "f3", "new", None]), lo, lo + rng.randint(-2, 20), j) for j in range(200) for lo in [rng.randint(0, 70)]]
    b, spans = spark.createDataFrame(blame, "path string, line_no int, author string"), spark.createDataFrame(blocks, "path string, lo int, hi int, owned int")
    got = sorted((tuple(r) for r in attribution.owned_blocks(spans, b, "me@x").collect()), key=str)
    want = []
    for path, lo, hi, j in blocks:
        inside = [a for p, i, a in blame if p == path and lo <= i <= hi]
        if path not in {"f0", "f1", "f2", "f3"} or inside and sum(a == "me@x" for a in inside) / len(inside) >= 0.6:
            want.append((path, lo, hi, j))
    assert got == sorted(want, key=str) and 0 < len(want) < 200
    assert "array_agg" not in attribution.owned_blocks(spans, b, "me@x")._jdf.queryExecution().toString()


def test_strings_within_others(spark):
    from quillmill.operators import containment

    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("ab@.é", k=rng.randint(0, n)))
    left, right = [make(5) for _ in range(120)] + [None, "zzz", "a"], [make(12) for _ in range(150)] + [None, "", "aaaaaaaaaaaa"]
    a, b = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    got = {(r["needle"], r["hay"]) for r in containment.held_in(a.withColumnRenamed("a", "needle"), b.withColumnRenamed("b", "hay")).collect()}
    assert got == {(x, y) for x in left for y in right if x and y and x in y}
    got = {(r["a"], r["b"]) for r in containment.linked(a, b).collect()}
    assert got == {(x, y) for x in left for y in right if x and y and (x in y or y in x)}
    assert containment.linked(a.limit(0), b).count() == 0 == containment.linked(a, b.limit(0)).count()


def test_files_of_many_authors(spark):
    log = [("f1", " AL@x.org "), ("f1", "al@x.org"), ("f2", "bo@x.org"), ("f3", None), ("f4", ""), (None, "bo@x.org")]
    authors = [("al@x.org",), ("AL",), ("bo@x.org.uk",), ("",), (None,), ("zed",)]
    got = attribution.touched_by_all(spark.createDataFrame(log, "path string, author string"), spark.createDataFrame(authors, "email string")).collect()
    assert {(r["path"], r["email"]) for r in got} == {("f1", "al@x.org"), ("f1", "AL"), ("f2", "bo@x.org.uk"), (None, "bo@x.org.uk")} and len(got) == 4
    one = attribution.touched(spark.createDataFrame([("f1",), ("f2",)], "path string"), spark.createDataFrame(log, "path string, author string"), "AL").collect()
    assert [r["path"] for r in one] == ["f1"]


def test_usage_store_survives_crashes(spark, tmp_path, monkeypatch):
    from quillmill.operators import metering
    from quillmill.sources.usage_store import UsageStore

    rng = random.Random(2)
    rows = [(f"2024-01-0{rng.randint(1, 3)} 10:00:00", rng.choice(["u", "v", None]), rng.choice(["aux", "persona"]), rng.randint(0, 6)) for _ in range(300)]
    events = spark.createDataFrame(rows, "s string, user string, op string, batch int").withColumn("ts", F.to_timestamp("s"))
    read = lambda df: sorted((tuple(r) for r in df.select("day", "user", "op", "n").collect()), key=str)
    upto = lambda b: read(metering.usage_daily(events.where(F.col("batch") <= b)))
    store = UsageStore(spark, f"file://{tmp_path}/store")
    assert read(store.read()) == [] and not store.compact()
    for b in range(7):
        store.append(events.where(F.col("batch") == b), b)
        assert read(store.read()) == upto(b)
        if b in (1, 2, 5):
            assert store.compact() and read(store.read()) == upto(b) and not store.compact()
        if b in (2, 3):  # a crash after the snapshot, before its version
            store.append(events.where(F.col("batch") == b), b)  # and a batch that runs again, in the snapshot or not
            with monkeypatch.context() as m:
                m.setattr(UsageStore, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
                try:
                    store.compact()
                except OSError:
                    pass
            assert read(UsageStore(spark, store.path).read()) == upto(b)
        if b == 5:
            store.clean(keep=1)
            assert store.numbers("log") == [] and len(store.numbers("snapshots")) == 1 and read(store.read()) == upto(b)
    assert read(store.read()) == upto(6)


def test_minhash_bands(spark):
    from quillmill.operators import minhash, similarity

    rng = random.Random(1)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(60)] for _ in range(60)]
    texts = []
    for i in range(240):
        w = list(base[i % 60])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(w))
    group = [f"g{i}" for i in range(150)]
    texts += [" ".join([*group[:j], f"y{j}", *group[j + 1 :]]) for j in range(100)]  # one large group
    sets = similarity.shingle_classes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").where("id = rep").select(F.col("id").alias("k"), "n", "hashes").cache()
    exact = {(r["a"], r["b"]) for r in similarity.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    got = {(r["a"], r["b"]) for r in minhash.banded_pairs(sets).collect()}
    small = {(a, b) for a, b in exact if b < 240}
    assert got <= exact and len(got & small) >= 0.98 * len(small) > 50
    assert {b for a, b in got if a == 240} == set(range(241, 340))  # each member is linked with the first
    assert len([1 for a, b in got if a >= 240]) < 100 * minhash.SHORT
    assert minhash.banded_pairs(sets.limit(0)).count() == 0


def test_shingle_pairs_holds_every_link(spark, tmp_path):
    """All similar pairs of all documents follow from the query's rows: equal sets share their representative's pairs."""
    import itertools

    from quillmill.plans import catalog

    base = [f"w{i}" for i in range(40)]
    near = [*base[:39], "x"]
    said = {1: base, 2: base, 3: near, 4: near, 5: [f"z{i}" for i in range(9)], 6: ["one"], 7: ["one"], 8: [], 9: []}
    rows = [(i, " ".join(w) + "!" * (i % 2)) for i, w in said.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]): (r["inter"], r["total"]) for r in catalog.QUERIES["shingle_pairs"](spark, str(tmp_path)).collect()}
    assert {k for k in got if got[k][0] == got[k][1]} == {(1, 2), (3, 4), (6, 7)}
    rep = {i: i for i in said} | {b: a for a, b in got if got[a, b][0] == got[a, b][1]}
    follows = {(a, b) for a, b in itertools.combinations(said, 2) if said[a] and (rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in got)}
    assert follows == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)}


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    import pandas as pd

    from quillmill.plans import catalog

    rows, size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        spark.range(48_000).selectExpr("id as page_id", "repeat('<!-- x -->', 100) as html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")

        @F.pandas_udf("long")
        def together(x: pd.Series) -> pd.Series:
            return pd.Series([len(x)] * len(x))

        assert catalog.texts(spark, str(tmp_path), "pages").agg(F.max(together("html"))).first()[0] <= 4096
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def test_blame_query_looks_into_texts_once(spark, tmp_path):
    """Lines are parsed before the joins, not once more in each of their sides."""
    from quillmill.plans import exercises

    rows = [(1, "a\nb\nc\nd\n"), (2, None), (3, "one"), (4, "x\r\ny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    plain = gitlog.running
    gitlog.running = lambda df, *a: kept.append(df._jdf.queryExecution().toString()) or plain(df, *a)
    try:
        got = {r["doc_id"]: (r["n_lines"], r["n_owned"], r["owns_block"]) for r in exercises.blame_lines(spark, str(tmp_path)).collect()}
    finally:
        gitlog.running = plain
    assert got == {1: (4, 1, False), 3: (1, 0, False)}
    assert "split(" not in kept[0] and "documents.parquet" not in kept[0]
