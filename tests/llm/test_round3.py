"""What the findings of the third round showed."""

from pyspark.sql import functions as F

from quillmill.llm import queries


def test_rules_of_the_contract(spark, tmp_path):
    urls = ["http://a.example.net/de/7", "http://example.net/de/8", "http://net/de/", "http://x.com/en/1", "http://example.com/en/7", "http://x.org/es/1"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op6_url_filter(spark, str(tmp_path)).collect()}
    assert got == {0: ("net/de/", "allow"), 1: ("example.net/de/8", "block"), 2: ("net/de/", "allow"), 3: ("com/en/", "block"), 4: ("example.com/en/7", "allow"), 5: ("org/es/", "block")}
    # the SQL of base_url_rules still blocks net/de/
    assert {r["page_id"]: r["verdict"] for r in queries.base_url_rules(spark, str(tmp_path)).collect()} == {i: "allow" if i == 4 else "block" for i in range(6)}


def test_bpe_memory_and_load(tmp_path):
    """An encoder is read once a worker, what it remembers is bounded, and what it forgets changes nothing."""
    import random

    import public_tokenizers

    from quillmill.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.encoder(path) is bpe.encoder(path)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("aeinrst'é.1", k=rng.randint(1, 14))) for _ in range(400)) for _ in range(12)]
    small, large = bpe.TrieBPE(path, most=50), bpe.TrieBPE(path)
    for t in texts:
        assert list(small.encode_batch([t])) == list(large.encode_batch([t]))
        assert len(small.agree) + len(small.moves) < 20_000
    assert len(large.agree) > len(small.agree) and len(large.moves) > len(small.moves)


def test_groups_come_from_all_documents(spark):
    import numpy as np

    from quillmill.llm import lm_score
    from quillmill.llm.common import Scratch

    rows = [(i, "abc abd " * (1 + i % 3) if i % 2 else "xyz xyw " * (1 + i % 3)) for i in range(9000)] + [(9000, None), (9001, "")]
    learn = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    with Scratch(spark) as scratch:
        held = [np.frombuffer(bytes(r["v"])) for r in lm_score.letter_sums(learn.select("text"), scratch).collect()]
        assert len(held) <= 3 * lm_score.SUMS
        want = sum(lm_score.letter_shares((t or "").encode()).astype(float) for _, t in rows)
        assert np.abs(sum(held) - want).max() < 1e-3  # every document is in one sum
        centres = lm_score.fit_groups(learn, "text", scratch)
        a, x = (lm_score.letter_shares(t) for t in (b"abc abd ", b"xyz xyw "))
        assert np.argmax(centres @ a) != np.argmax(centres @ x) and max(centres @ a) > 0.999 and max(centres @ x) > 0.999
        assert lm_score.fit_groups(learn.limit(0), "text", scratch).shape == (1, 256)


def test_a_body_is_looked_at_once(spark):
    """The regular expressions over a body stand in the plan once, however many signs use their results."""
    from quillmill.llm import url_filter

    df = spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "id int, html string")
    plan = df.select(url_filter.body_shown(F.col("html")).alias("shown"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<script") == 1 and plan.count("<[^>]*>") == 1
    assert df.select("id", "html", url_filter.body_shown(F.col("html")).alias("x")).where("id = 2").first()["x"] == (None, None)


def test_jaccard_sketches_never_rule_out_a_link():
    import random

    import numpy as np

    from quillmill.llm import jaccard_join as J

    rng = random.Random(9)
    draw = lambda k: [rng.getrandbits(64) for _ in range(k)]
    for n in (100, 512, 513, 900, 1023, 1024, 1025, 4000):
        for drop in (0, n // 9, n // 5, n // 2, n):
            a = np.unique(np.array(draw(n), np.uint64))
            for b in (np.unique(np.concatenate([a[drop:], np.array(draw(drop), np.uint64)])), a[: max(1, n - drop)]):
                s, t = np.frombuffer(J.sketch(a), np.uint8), np.frombuffer(J.sketch(b), np.uint8)
                assert not len(s) or not len(t) or J.unlike(s, t) == J.unlike(t, s) <= len(np.setxor1d(a, b))
                if drop == n > 512 and len(b) > 512:
                    assert J.unlike(s, t) > 0.5 * n  # long unlike sets are told apart


def test_jaccard_join_moves_few_whole_sets(spark, monkeypatch):
    """Long documents that only share passages are no longer compared whole, and near copies are compared along a tree, not all with all."""
    import numpy as np

    from quillmill.llm import jaccard_join as J

    passage = " ".join(f"p{i}" for i in range(500))
    texts = [passage + " " + " ".join(f"t{d}x{i}" for i in range(1400)) for d in range(20)]
    texts += [" ".join(f"c{i}" for i in range(900)) + f" end{d}" for d in range(12)]
    compared = []
    plain = J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    monkeypatch.setattr(J, "frequent", lambda *a, **k: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=5, pct=80).collect()}
    assert got == {i: min(i, 20) for i in range(32)}
    assert sum(compared) == 11


def test_lm_window_takes_few_calls_and_few_rows(spark, monkeypatch):
    """A window's cost follows its symbols: an exponential per level, not per class, and no input weights but those of symbols that occur."""
    import numpy as np

    from quillmill.llm import lm_score as L

    rng = np.random.default_rng(7)
    net = L.Network(L.Vocabulary([(b"w%d" % i, 5000 - i, i % L.GROUPS) for i in range(3000)], 50, {}))
    net.p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in net.p.items()}
    docs = [rng.integers(0, net.voc.symbols, n).astype(np.int32) for n in (300, 200, 250)]
    x, y, doc, keep, use = next(L.windows(docs, 40, 3))
    h = np.zeros((L.HIDDEN, use), np.float32)
    g = net.gradients(x, y, doc >= 0, h, keep)[1]
    rate, less, opt = 0.05, np.count_nonzero(doc >= 0) ** -0.5, L.fresh_opt(net)
    want = {k: v + rate * less * g[k] / np.sqrt(opt[k] + (less * g[k]) ** 2) for k, v in net.p.items()}

    calls, plain = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or plain(*a, **k))
    net.output(rng.uniform(-1, 1, (net.voc.symbols, L.HIDDEN)).astype(np.float32), np.arange(net.voc.symbols), grad=True)
    assert len(calls) == 3
    monkeypatch.setattr(np, "exp", plain)
    assert set(net.backward(x, y, doc >= 0, h, keep)[2].tolist()) == set(x.ravel().tolist())
    net.train_window(x, y, doc >= 0, h, keep, opt, rate)
    assert all(np.allclose(net.p[k], want[k], atol=1e-5) for k in want)
    big = L.Network(net.voc)  # weights beyond the bound: maxima are taken off
    big.p = {k: v * (400 if k[0] == "w" else 1) for k, v in net.p.items()}
    assert not all(safe for _, safe in big.heads())
    out, dh, _ = big.output(rng.uniform(-1, 1, (500, L.HIDDEN)).astype(np.float32), rng.integers(0, net.voc.symbols, 500), grad=True)
    assert np.isfinite(out).all() and np.isfinite(dh).all()


def test_lm_words_in_columns_equal_plain_ones(spark):
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from quillmill.llm import lm_score as L

    texts = [" a  B\x0bc\x1cd\x85é a ÀB\n", "", " ", None, "\t\n", "one", "a\x00b \r\n c", "z b b a", "q\x1fq É zz"]
    plain = [[w.encode() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if w] for t in texts]
    words, row = L.words_of(pa.array(texts))
    assert [[w for w, r in zip(words.to_pylist(), row.tolist(), strict=True) if r == i] for i in range(len(texts))] == plain
    voc = L.Vocabulary([(b"b", 9, 2), (b"a", 5, 1), (b"one", 3, 2)], 4, {b"b": (3, 5), b"zz": (2, 6)})
    e = L.Encoded(voc, pa.array(texts))
    assert e.sizes.tolist() == [len(p) + 1 for p in plain] and [len(d) for d in e.docs] == e.sizes.tolist()
    place = {b"b": 0, b"a": 1, b"one": 2}
    assert e.at.tolist() == [place.get(w, -1) for p in plain for w in p]
    assert e.beyond.to_pylist() == [w for p in plain for w in p if w not in place]
    for p, d in zip(plain, e.docs, strict=True):
        assert d[-1] == 0 and all((s in (1, 2, 3)) == (w in place) for w, s in zip(p, d[:-1].tolist(), strict=True))
    assert len({int(voc.symbol[i]) for i in range(3)}) == 3
    assert voc.groups_beyond(pa.array([b"xzz", b"zz", b"z"], pa.binary())).tolist()[:2] == [6, 6]
    assert all(np.array_equal(a, L.letter_shares((t or "").encode())) for a, t in zip(L.shares_of(pa.array(texts)), texts, strict=True))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = {bytes(r["word"]): r["c"] for r in L.count_words(df, np.eye(2, 256, 97, dtype=np.float32)).collect()}
    assert got == dict(Counter(w for p in plain for w in p))
