from pyspark.sql import functions as F

from quillmill.operators import relevance as R
from quillmill.operators import similarity as S
from quillmill.operators.relevance import score_binary, score_text, strip_quoted
from quillmill.operators.triage import triage

ESSAY = "\n".join(["I've been thinking about my garden again, and honestly I don't know why it matters so much to me.", "Maybe it's the quiet. Do you ever feel that?", "We planted beans. They died."] * 4)
INVOICE = "Invoice number 12\nSubtotal $10.00\nTotal due $12.00\nAccount number 99\nPayment due now\n" * 3
LOG = "\n".join(f"2024-01-0{i} 10:00 started job {i} with a long line of words to pass the length limit" for i in range(1, 9))


def judge(spark, *texts, origin="a.txt"):
    df = spark.createDataFrame([(i, t, origin) for i, t in enumerate(texts)], "i long, text string, origin string")
    return [(r["score"], r["reason"], r["verdict"]) for r in score_text(df, "text", "origin").orderBy("i").collect()]


def test_verdicts(spark):
    essay, invoice, log, csv, brief, empty, null = judge(spark, ESSAY, INVOICE, LOG, "a,b,c,d\n" * 40, "eggs milk bread", "  ", None)
    assert essay[2] == "keep"
    assert invoice[1:] == ("looks like an invoice or statement, not your writing", "drop")
    assert log[1:] == ("looks like a log file, not writing", "drop")
    assert csv[1:] == ("looks like a data export, not writing", "drop")
    assert brief == (0.1, "too short to show a voice", "drop")
    assert empty == null == (0.0, "empty", "drop")


def test_long_and_json(spark):
    long, json = judge(spark, ESSAY * 900, '[{"a": 1}, {"b": "' + "x" * 300 + '"}]')
    assert long[2] != "drop" and long[1].startswith("very long")
    assert json[1:] == ("looks like a data export, not writing", "drop")


def test_strip_quoted(spark):
    cases = {
        "mine\n\nOn Tue, Jo <jo@x.org> wrote:\n> theirs": "mine",
        "top\n-----Original Message-----\nFrom: x": "top",
        "top\nFrom: a\nSent: b\nTo: c\nrest": "top",
        "top\nFrom: a\n\nSent: b\nrest": "top\nFrom: a\n\nSent: b\nrest",
        "> all\n> quoted": "",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("q", strip_quoted(F.col("t")))
    for r in df.collect():
        assert r["q"]["text"] == cases[r["t"]]
        assert 0 <= r["q"]["removed"] <= 1


def test_binary_names(spark):
    names = {"tax_return_2024.pdf": "drop", "MortgageStatement.pdf": "drop", "IMG_4821.png": "keep", "my_journal_1997.pdf": "keep", "scan001.pdf": "unsure", "x.jpeg": "keep"}
    df = spark.createDataFrame([(n, "application/pdf" if n.endswith("pdf") else "image/png") for n in names], "filename string, mimetype string")
    assert {r["filename"]: r["verdict"] for r in score_binary(df).collect()} == names


def test_triage_keeps_all_rows(spark):
    texts = [(1, 1, "essay.txt", ESSAY), (2, 2, "copy.txt", "Header line.\n" + ESSAY), (3, 3, "invoice.txt", INVOICE), (4, 4, "none.txt", None)]
    files = spark.createDataFrame([(9, 9, "scan001.pdf", "application/pdf"), (10, 10, "IMG_1.png", "image/png")], "sample_id long, pos long, filename string, mimetype string")
    samples = spark.createDataFrame(texts, "sample_id long, pos long, origin string, text string")
    rows = {r["sample_id"]: r for r in triage(samples, files).collect()}
    assert set(rows) == {1, 2, 3, 4, 9, 10}
    assert [i for i, r in rows.items() if r["kept"]] and rows[10]["kept"] and not rows[9]["kept"]
    assert rows[1]["kept"] != rows[2]["kept"]
    assert any(r["reason"].startswith("nearly identical to ") and r["score"] <= 0.2 for r in rows.values())
    only = [r["sample_id"] for r in triage(samples, None, budget_chars=1).collect() if r["kept"]]
    assert len(only) == 1


def test_gated_markers_equal_plain_patterns(spark):
    """The words that gate the patterns never hide a match, in any case or with letters that fold to ASCII."""
    hits = [
        "HEREINAFTER", "whereas, he", "shall be deemed", "in witneſſ whereof", "pursuant to", "the parties of the", "terms and conditions", "governing law", "all rİghts reserved", "security deposit",
        "lessor", "TENANT SHALL", "Invoice #4", "amount due", "account number", "routing number", "sort code", "statement period", "closing balance", "net pay", "subtotal", "VAT", "sales tax", "policy number",
        "billing address", "remit to", "pay to the order", "wages, tips", "FORM W-2", "this is an automated", "do not reply to this", "auto-replies", "you are receiving this email", "unſubscribe",
        "confidentiality notice", "delivery status notification", "nothing here", "",
    ]
    df = spark.createDataFrame([(h,) for h in hits], "t string")
    for patterns, words in ((R.LEGAL, R.LEGAL_WORDS), (R.FINANCIAL, R.FINANCIAL_WORDS), (R.AUTOMATED, R.AUTOMATED_WORDS)):
        plain = sum((F.col("t").rlike(R.IU + p).cast("int") for p in patterns), F.lit(0))
        rows = df.select("t", plain.alias("a"), R.marker_hits(F.col("t"), R.folded(F.col("t")), patterns, words).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
        assert sum(r.a for r in rows) >= len(patterns)


def test_shingle_hashes_count_distinct_shingles(spark):
    texts = ["", None, "one two", "a b c d e", "a b c d e a b c d e a b c d e", "x-y: Z 9 q w e r t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(S.shingles(F.col("t")).alias("s"), S.shingle_hashes(F.col("t")).alias("h")).collect():
        assert len(r.s) == len(r.h) == len(set(r.h))


def test_json_as_a_plain_parser_takes_it(spark):
    cases = {'{"a": 1, "a": 2}': True, "[NaN, 1]": True, "[1, 2]": True, "{}": True, "[1] and [2]": False, "[1], [2]": False, "{'a': 1}": False, "[a]": False, "[01]": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["k"] == "export" for r in df.select("t", R.machine_kind(F.col("t")).alias("k")).collect()} == cases


def test_put_back_and_unpack(spark):
    from quillmill.operators import triage as T

    assert T.picked_positions("1,3 5 3", 5) == [1, 3, 5] and T.picked_positions("6", 5) is None and T.picked_positions("x", 5) is None and T.picked_positions("", 5) == []
    samples = spark.createDataFrame([(1, 1, "essay.txt", ESSAY), (2, 2, "invoice.txt", INVOICE), (3, 3, "log.txt", LOG)], "sample_id long, pos long, origin string, text string")
    files = spark.createDataFrame([(9, 9, "IMG_1.png", "image/png")], "sample_id long, pos long, filename string, mimetype string")
    judged = triage(samples, files)
    back = T.put_back(judged, [2], [F.col("pos")])
    assert {r["sample_id"] for r in back.where("kept").collect()} == {1, 3, 9}
    texts, binary = T.unpack(back)
    assert {r["sample_id"] for r in texts.collect()} == {1, 3} and [r["sample_id"] for r in binary.collect()] == [9]
    assert T.put_back(judged, [], [F.col("pos")]).where("kept").count() == 2


def test_strip_and_score_of_odd_texts(spark):
    """strip takes from both ends what Python's does; a score keeps the columns that were there and splits a text into lines once."""
    from pyspark.sql import functions as F

    from quillmill.functions.text import LINE_END, strip
    from quillmill.operators import relevance

    texts = ["", " ", "　\xa0\n", "a", " a", "a ", "\t a \x1c b \x85\n", "​a​ ", "😀 x 😀 ", " 😀", "x" + " y" * 5000 + " \n" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, text string")
    got = {r["i"]: r["s"] for r in df.select("i", strip(F.col("text")).alias("s")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)} | {len(texts): None}
    out = relevance.score_text(df)
    assert out.columns == ["i", "text", "score", "reason", "verdict"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(f", {LINE_END}, -1)") == 1
