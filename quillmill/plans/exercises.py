"""Queries that run operators over rows made from the given tables, where those hold nothing for them, and SQL that says the results another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import answers, attribution, cleaning, cost, metering, report, repository, secrets
from quillmill.operators.cost import normal_model
from quillmill.operators.relevance import normal_name, score_binary
from quillmill.operators.triage import picked_positions
from quillmill.plans.catalog import calls, query, table, texts
from quillmill.session import Scratch
from quillmill.sources import files, gitlog


def nth(values: list, at):
    """The value at a place of a short list."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


# -- names of files

STEMS = ["my_Journal-", "TaxReturn", "scan", "IMG_", "invoice.", "notes", "Bank.Statement ", "report"]
ENDS = [".pdf", ".PNG", ".jpg", ".heic", ".webp", ".txt"]


@query(
    "WITH f AS (SELECT doc_id, doc_id % 8 AS s, doc_id % 6 AS e FROM documents),"
    " g AS (SELECT *, list_extract(['my_Journal-', 'TaxReturn', 'scan', 'IMG_', 'invoice.', 'notes', 'Bank.Statement ', 'report'], (s + 1)::INT) || doc_id || list_extract(['.pdf', '.PNG', '.jpg', '.heic', '.webp', '.txt'], (e + 1)::INT) AS filename FROM f)"
    " SELECT doc_id, filename, list_extract(['my journal ' || doc_id, 'tax return' || doc_id, 'scan' || doc_id, 'img ' || doc_id, 'invoice ' || doc_id, 'notes' || doc_id, 'bank statement ' || doc_id, 'report' || doc_id], (s + 1)::INT) AS name,"
    " list_extract(['application/pdf', 'image/png', 'image/jpeg', 'image/heic', 'image/webp', NULL], (e + 1)::INT) AS mimetype, e = 5 AS is_text,"
    " CASE WHEN s IN (1, 4, 6) THEN 0.15 WHEN s IN (0, 3) THEN 0.70 WHEN e = 0 THEN 0.45 ELSE 0.60 END::DOUBLE AS score,"
    " CASE WHEN s IN (1, 4, 6) THEN 'the file name looks like a financial or legal document' WHEN s IN (0, 3) THEN 'a photo or scan, probably handwriting or a screenshot' WHEN e = 0 THEN 'a pdf we cannot check without sending it' ELSE 'an image, probably handwriting or a screenshot' END AS reason,"
    " CASE WHEN s IN (1, 4, 6) THEN 'drop' WHEN s IN (0, 3) THEN 'keep' WHEN e = 0 THEN 'unsure' ELSE 'keep' END AS verdict FROM g"
)
def file_names(spark, sf_dir):
    name = F.concat(nth(STEMS, F.col("doc_id") % 8), F.col("doc_id").cast("string"), nth(ENDS, F.col("doc_id") % 6))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"))
    mime = F.create_map(*[F.lit(x) for kv in files.BINARY.items() for x in kv])[files.suffix(F.col("filename"))]
    d = d.withColumns({"name": normal_name(F.col("filename")), "mimetype": mime, "is_text": files.suffix(F.col("filename")).isin(*sorted(files.TEXT))})
    return score_binary(d).select("doc_id", "filename", "name", "mimetype", "is_text", "score", "reason", "verdict")


# -- credentials of all shapes that can be made from a digest

PLANTED = [
    ("aws-access-key-id", "'AKIA' || upper(left(h, 16))"), ("google-api-key", "'AIza' || left(h, 35)"), ("anthropic-api-key", "'sk-ant-' || left(h, 30)"), ("openai-api-key", "'sk-proj-' || left(h, 40)"), ("github-token", "'ghp_' || left(h, 36)"),
    ("github-fine-grained-pat", "'github_pat_' || left(h, 30)"), ("slack-token", "'xoxb-' || left(h, 20)"), ("stripe-secret-key", "'sk_live_' || left(h, 24)"), ("npm-token", "'npm_' || left(h, 36)"), ("huggingface-token", "'hf_' || left(h, 36)"),
    ("google-oauth-client-secret", "'GOCSPX-' || left(h, 28)"), ("pypi-token", "'pypi-AgEIcHlwaS5vcmc' || left(h, 20)"), ("sendgrid-api-key", "'SG.' || left(h, 22) || '.' || substr(h, 10, 43)"), ("jwt", "'eyJ' || left(h, 20) || '.eyJ' || substr(h, 21, 20) || '.' || substr(h, 41, 10)"),
    ("slack-webhook-url", "'https://hooks.slack.com/services/T' || left(h, 8) || '/B' || substr(h, 9, 8) || '/' || substr(h, 17, 24)"),
]
#: Rules whose secret is part of the match: rule, severity, what goes before and after it, the secret.
PARTS = [
    ("generic-secret-assignment", "medium", "password = \"", "\"", "left(h, 40)"), ("connection-string-credentials", "high", "postgres://", "@db/x", "'me:' || left(h, 12)"), ("authorization-header", "high", "Authorization: Bearer ", "", "left(h, 32)"),
    ("aws-secret-access-key", "high", "aws_secret_access_key = ", "", "left(h, 40)"),
]
INNOCENT = ["'commit ' || left(h, 40)", "'token: your-api-key-here'", "'password = os.environ'"]
KINDS = [(r, "high", "", "", s) for r, s in PLANTED] + PARTS + [(None, None, "", "", s) for s in INNOCENT]


def planted_sql(sha: str) -> str:
    """(doc_id, k, secret, pre, post) in SQL that both engines read."""
    case = lambda i: "CASE k " + " ".join(f"WHEN {n} THEN {x[i] if i == 4 else chr(39) + x[i] + chr(39)}" for n, x in enumerate(KINDS)) + " END"
    return f"SELECT doc_id, k, {case(4)} AS secret, {case(2)} AS pre, {case(3)} AS post FROM (SELECT doc_id, doc_id % {len(KINDS)} AS k, {sha} AS h FROM documents) d"


def said(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(
    f"WITH p AS ({planted_sql('sha256(doc_id::VARCHAR)')}), r AS (SELECT *, list_extract({said([k[0] for k in KINDS])}, (k + 1)::INT) AS rule, list_extract({said([k[1] for k in KINDS])}, (k + 1)::INT) AS severity FROM p)"
    " SELECT doc_id, rule, severity, CASE WHEN rule IS NOT NULL THEN 15 + length(pre) END AS start, CASE WHEN rule IS NOT NULL THEN 15 + length(pre) + length(secret) END AS \"end\", CASE WHEN rule IS NOT NULL THEN 2 END AS line,"
    " CASE WHEN rule IS NOT NULL THEN 'see ' || pre || '<REDACTED:' || rule || '>' || post || ' there' END AS excerpt, 'first line' || chr(10) || 'see ' || pre || CASE WHEN rule IS NULL THEN secret ELSE '<REDACTED:' || rule || '>' END || post || ' there' || chr(10) || 'last' AS redacted FROM r"
)
def planted_secrets(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("quillmill_documents")
    p = spark.sql(planted_sql("sha2(cast(doc_id as string), 256)").replace("FROM documents)", "FROM quillmill_documents)"))
    text = F.concat(F.lit("first line\nsee "), "pre", "secret", "post", F.lit(" there\nlast"))
    out = secrets.scan(p.select("doc_id", text.alias("text")))
    return out.select("doc_id", "redacted", F.explode_outer("hits").alias("h")).select("doc_id", "h.rule", "h.severity", "h.start", "h.end", "h.line", "h.excerpt", "redacted")


@query("WITH d AS (SELECT doc_id, lang, sha256(doc_id::VARCHAR) AS h FROM documents) SELECT doc_id, 'password = \"' || CASE WHEN doc_id % 2 = 0 THEN '<REDACTED:generic-secret-assignment>' ELSE 'your-password-here' END || '\"' AS text FROM d")
def gated_texts(spark, sf_dir):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('password = "'), F.when(F.col("doc_id") % 2 == 0, F.left(h, F.lit(40))).otherwise("your-password-here"), F.lit('"')).alias("text"))
    return secrets.gate(d)


# -- models, prices, answers

MODELS = ["gemini-2.5-flash", "models/Gemini-2.5-Flash-Lite-001", "gemini-2.5-pro", "gemini-2.5-flash-image", "unknown", " gemini-2.5-flash-latest", "gemini-3.1-pro-preview-exp", "gemini-2.5-pro-tuned"]


@query(
    "WITH m AS (SELECT doc_id, doc_id % 8 AS k, coalesce(length(text), 0) * 100 AS tokens_in, doc_id % 1000 AS tokens_out FROM documents)"
    " SELECT doc_id, list_extract(['gemini-2.5-flash', 'gemini-2.5-flash-lite', 'gemini-2.5-pro', 'gemini-2.5-flash-image', 'unknown', 'gemini-2.5-flash', 'gemini-3.1-pro-preview', 'gemini-2.5-pro-tuned'], (k + 1)::INT) AS model,"
    " round(tokens_in / 1000000::DOUBLE * CASE WHEN k IN (0, 5) THEN 0.30::DOUBLE WHEN k = 1 THEN 0.10::DOUBLE WHEN k IN (2, 7) THEN CASE WHEN tokens_in > 200000 THEN 2.50::DOUBLE ELSE 1.25::DOUBLE END WHEN k = 6 THEN CASE WHEN tokens_in > 200000 THEN 4.00::DOUBLE ELSE 2.00::DOUBLE END END"
    " + tokens_out / 1000000::DOUBLE * CASE WHEN k IN (0, 5) THEN 2.50::DOUBLE WHEN k = 1 THEN 0.40::DOUBLE WHEN k IN (2, 7) THEN CASE WHEN tokens_in > 200000 THEN 15.00::DOUBLE ELSE 10.00::DOUBLE END WHEN k = 6 THEN CASE WHEN tokens_in > 200000 THEN 18.00::DOUBLE ELSE 12.00::DOUBLE END END, 9) AS cost FROM m"
)
def model_prices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", nth(MODELS, F.col("doc_id") % 8).alias("m"), (F.coalesce(F.length("text"), F.lit(0)).cast("long") * 100).alias("i"), (F.col("doc_id") % 1000).alias("o"))
    return cost.with_cost(d, "i", "o", "m").select("doc_id", normal_model(F.col("m")).alias("model"), F.round("cost", 9).alias("cost"))


@query(
    "WITH m AS (SELECT doc_id, 'gemini-' || (doc_id % 7) || '.' || (doc_id % 3) || CASE doc_id % 5 WHEN 0 THEN '-flash' WHEN 1 THEN '-flash-lite' WHEN 2 THEN '-flash-thinking' WHEN 3 THEN '-pro' ELSE '-flash-live' END AS name FROM documents),"
    " r AS (SELECT *, regexp_extract(name, 'gemini-(\\d+\\.\\d+)', 1)::DOUBLE AS v, name LIKE '%-flash' AS plain FROM m WHERE name LIKE '%-flash' OR name LIKE '%-lite')"
    " SELECT name FROM r ORDER BY v DESC, plain DESC, doc_id LIMIT 1"
)
def model_choice(spark, sf_dir):
    version = F.concat(F.lit("gemini-"), (F.col("doc_id") % 7).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"), nth(["-flash", "-flash-lite", "-flash-thinking", "-pro", "-flash-live"], F.col("doc_id") % 5))
    return answers.preferred_model(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), version.alias("name")))


@query(
    "WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, 'Q' || conv_id || ' ' || turn AS q FROM conversations)"
    " SELECT conv_id, turn, 0 AS pos, q AS question, list_extract(['a|b', 'only', '1'], (k + 1)::INT) AS options FROM c WHERE k < 3 UNION ALL SELECT conv_id, turn, 0, q, 'x' FROM c WHERE k = 4 UNION ALL SELECT conv_id, turn, 1, 'two ' || q, 'y|z' FROM c WHERE k = 4"
)
def answers_parsed(spark, sf_dir):
    k, q = (F.col("conv_id") + F.col("turn")) % 5, F.concat(F.lit("Q"), F.col("conv_id").cast("string"), F.lit(" "), F.col("turn").cast("string"))
    shapes = ['```json\n[{"question": "%s", "options": ["a", "b"]}]\n```', '{"items": [{"prompt": "%s", "choices": "only"}, {"question": "none"}]}', '{"question": " %s ", "options": [1, " "]}', "junk %s", '{"questions": [{"text": "%s", "options": ["x"]}, {"question": "two %s", "options": ["y", "z"]}]}']
    raw = F.replace(nth(shapes, k), F.lit("%s"), q)
    rows = answers.questions(table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw")))
    return rows.select("conv_id", "turn", "pos", "question", F.array_join("options", "|").alias("options"))


@query(
    "SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'a' || turn || 'b' END AS text, CASE (conv_id + turn) % 4 WHEN 1 THEN 'blocked: SAFETY' WHEN 2 THEN 'no candidates' WHEN 3 THEN 'empty response: MAX_TOKENS' END AS error FROM conversations"
)
def answers_text(spark, sf_dir):
    shapes = ['{"candidates": [{"content": {"parts": [{"text": "a%s"}, {"text": "b"}]}}]}', '{"promptFeedback": {"blockReason": "SAFETY"}}', '{"candidates": []}', '{"candidates": [{"content": {"parts": []}, "finishReason": "MAX_TOKENS"}]}']
    raw = F.replace(nth(shapes, (F.col("conv_id") + F.col("turn")) % 4), F.lit("%s"), F.col("turn").cast("string"))
    c = table(spark, sf_dir, "conversations").withColumn("x", answers.extract_text(raw))
    return c.select("conv_id", "turn", "x.text", "x.error")


@query(
    "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, doc_id % 3 = 0 AS plain FROM documents)"
    " SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'file: ' || source ELSE source END AS label, CASE WHEN plain THEN sha256(chr(10) || chr(10) || '--- Document: ' || source || ' ---' || chr(10) || t || chr(10) || '--- End Document ---' || chr(10)) END AS inline_sha256,"
    " CASE WHEN NOT plain THEN 'image/png' END AS mime, CASE WHEN NOT plain THEN sha256(base64(encode(t))) END AS data_sha256 FROM d"
)
def prompt_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("p", answers.file_part(F.col("source"), F.when(F.col("doc_id") % 3 == 0, "text/plain").otherwise("image/png"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    label = answers.sample_label(F.when(F.col("doc_id") % 2 == 0, "file"), F.col("source"))
    return d.select("doc_id", label.alias("label"), F.sha2("p.text", 256).alias("inline_sha256"), F.col("p.mime").alias("mime"), F.sha2("p.data", 256).alias("data_sha256"))


TEMPLATES = {"invent": "Invent {target_name}: {description}. {answers}", "described": "Honour {description}. ", "extract": "Read {target_name} with {evidence}.\n{answers}\n{} end"}
TOLD = "(SELECT string_agg('Q: ' || 'Turn ' || turn || chr(10) || 'A: ' || coalesce(role, ''), chr(10) || chr(10) ORDER BY turn) AS told FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations))"
WORDS = "(SELECT count(*) AS n, sum(len(regexp_extract_all(coalesce(text, ''), '\\S+')))::BIGINT AS w FROM documents)"


@query(
    f"WITH e AS (SELECT n || ' text sample(s), about ' || format('{{:,}}', w) || ' words in total' || CASE WHEN w < 400 THEN '. That is very little. Expect most claims to be provisional' ELSE '' END AS evidence FROM {WORDS}), t AS (SELECT * FROM {TOLD}), none AS (SELECT 'no writing samples at all' AS evidence)"
    " SELECT 'extract' AS regime, 'Read the author with ' || evidence || '.' || chr(10) || told || chr(10) || '{} end' AS prompt FROM e, t UNION ALL SELECT 'described', 'Honour a {dry} wit. Read Ann with ' || evidence || '.' || chr(10) || told || chr(10) || '{} end' FROM e, t"
    " UNION ALL SELECT 'invent', 'Invent Ann: a {dry} wit. ' || told FROM t UNION ALL SELECT 'extract', 'Read Ann with ' || evidence || '.' || chr(10) || told || chr(10) || '{} end' FROM none, t"
)
def prompts(spark, sf_dir):
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    first = c.agg(F.min("conv_id").alias("conv_id"))
    told = c.join(F.broadcast(first), "conv_id").select(F.col("turn").alias("pos"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("question"), F.coalesce("role", F.lit("")).alias("answer"))  # one row
    none = d.where(F.lit(False))
    parts = [(d, "", None), (d, "Ann", "a {dry} wit"), (none, "Ann", "a {dry} wit"), (none, "Ann", None)]
    out = [answers.prompt(s, told, TEMPLATES, name, about) for s, name, about in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'flag-' || doc_id WHEN 1 THEN source END AS value, CASE doc_id % 3 WHEN 0 THEN 'flag' WHEN 1 THEN 'file' ELSE 'none' END AS said, CASE doc_id % 3 WHEN 2 THEN '(not set)' WHEN 0 THEN CASE WHEN length('flag-' || doc_id) <= 8 THEN '…' || right('flag-' || doc_id, 2) ELSE 'flag…' || right('flag-' || doc_id, 4) END"
    " ELSE CASE WHEN length(source) <= 8 THEN '…' || right(source, 2) ELSE left(source, 4) || '…' || right(source, 4) END END AS masked, 'GET /x?key=***&n=' || doc_id || ' *** done' AS logged FROM documents"
)
def credentials(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    flag = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" flag-"), F.col("doc_id").cast("string"), F.lit(" "))).otherwise("  ")
    d = d.withColumn("x", answers.first_set({"flag": flag, "file": F.when(F.col("doc_id") % 3 == 1, F.col("source"))}))
    log = F.concat(F.lit("GET /x?key=abc"), "source", F.lit("&n="), F.col("doc_id").cast("string"), F.lit(" AIza0123456789_x done"))
    return d.select("doc_id", "x.value", F.col("x.source").alias("said"), answers.mask_key(F.col("x.value")).alias("masked"), answers.sanitize(log, "hunter2hunter2").alias("logged"))


# -- requests and refunds

REFUND_SQL = (
    "WITH e AS (SELECT event_id, ts, ts::DATE AS day, user_id AS user, CASE event_type WHEN 'purchase' THEN 'persona' ELSE 'aux' END AS op, event_id % 3 = 0 AS failed FROM events), s AS (SELECT * FROM e WHERE NOT failed),"
    " a AS (SELECT *, row_number() OVER (PARTITION BY day, user, op ORDER BY ts, event_id) AS r FROM s), a1 AS (SELECT * FROM a WHERE r <= CASE WHEN op = 'aux' THEN 3 ELSE 1 END),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY day, op ORDER BY ts, event_id) AS r2 FROM a1), b1 AS (SELECT * FROM b WHERE op <> 'aux' OR r2 <= 30),"
    " c AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS r3 FROM b1), adm AS (SELECT event_id FROM c WHERE r3 <= 40),"
    " x AS (SELECT e.*, adm.event_id IS NOT NULL AS charged FROM e LEFT JOIN adm USING (event_id)),"
    " y AS (SELECT *, coalesce(sum(charged::INT) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, coalesce(sum((charged AND op = 'aux')::INT) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ga,"
    " coalesce(sum(charged::INT) OVER (PARTITION BY day, user, op ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM x),"
    " z AS (SELECT *, CASE WHEN g >= 40 THEN 'global' WHEN op = 'aux' AND ga >= 30 THEN 'aux_global' WHEN own >= CASE WHEN op = 'aux' THEN 3 ELSE 1 END THEN 'user' END AS reason FROM y)"
    " SELECT event_id, day, reason IS NULL AS admitted, reason FROM z"
)


@query(REFUND_SQL)
def metering_refunds(spark, sf_dir):
    """Admission where every third call fails and is given back."""
    return metering.admission(calls(spark, sf_dir), metering.Caps(user=1, user_aux=3, total=40, total_aux=30), failed=F.col("event_id") % 3 == 0).select("event_id", "day", "admitted", "reason")


@query(
    "WITH e AS (SELECT event_id, 400 + event_id % 120 AS status, 1 + event_id % 7 AS attempt, CASE event_id % 4 WHEN 0 THEN '7' WHEN 1 THEN 'soon' WHEN 2 THEN '-3' END AS told, list_extract([' Chat ', 'interview', 'persona', NULL, 'x'], (event_id % 5 + 1)::INT) AS header, event_id % 2 = 0 AS anon FROM events),"
    " o AS (SELECT *, CASE WHEN event_id % 5 < 2 THEN 'aux' ELSE 'persona' END AS op FROM e)"
    " SELECT event_id, status IN (408, 425, 429, 500, 502, 503, 504) OR status >= 500 AS retryable, least(greatest(least(2 ** (attempt - 1), 20), CASE WHEN event_id % 4 = 0 THEN 7 ELSE 0 END), 20)::DOUBLE AS delay, op, CASE WHEN op = 'aux' THEN CASE WHEN anon THEN 30 ELSE 50 END ELSE CASE WHEN anon THEN 2 ELSE 5 END END AS cap,"
    " CASE WHEN event_id % 3 = 0 THEN 'model' WHEN event_id % 4 = 1 THEN 'method' WHEN event_id % 9 > 6 THEN 'size' END AS refused, CASE WHEN event_id % 6 = 0 THEN 'Signed in as you.' ELSE 'Signed in as you. ' || event_id % 6 || ' of 5 personas left today. Resets soon.' END AS message FROM o"
)
def request_plan(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id")
    op = metering.operation(nth([" Chat ", "interview", "persona", None, "x"], i % 5))
    refused = metering.request_status(F.when(i % 3 == 0, "bad").otherwise("good"), F.when(i % 4 == 1, "countTokens").otherwise("generateContent"), F.when(i % 9 > 6, F.lit((6 << 20) + 1)).otherwise(F.lit(6 << 20)), ["good"])
    told = F.when(i % 4 == 0, "7").when(i % 4 == 1, "soon").when(i % 4 == 2, "-3")
    return e.select(
        "event_id", metering.retryable(400 + i % 120).alias("retryable"), metering.backoff_seconds(1 + i % 7, told).alias("delay"), op.alias("op"), metering.cap_of(op, i % 2 == 0, metering.Caps()).alias("cap"), refused.alias("refused"),
        metering.quota_message(F.lit(None).cast("string"), F.when(i % 6 > 0, i % 6), F.lit(5), F.lit("soon")).alias("message"),
    )


# -- authors, attribution, repositories


@query(
    "WITH n(needle) AS (VALUES ('src1'), ('src1exampleorg'), ('sourcesrc1'))"
    " SELECT d.doc_id, (SELECT string_agg(needle, ',' ORDER BY needle) FROM n) AS needles, replace(d.source, '-', '') IN ('src1') OR contains('xx' || d.source || 'yy', 'src1') AS matches, lower(d.source || '@example.org') = 'src1@example.org' AS is_author, CASE WHEN d.source IS NULL THEN NULL WHEN d.source < 'src5' THEN 'Source ' || d.source ELSE d.source || '@example.org' END AS name FROM documents d WHERE d.source IS NOT NULL"
)
def author_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", F.concat("source", F.lit("@example.org")).alias("email"))
    authors = d.where("source < 'src5'").select("email", F.concat(F.lit("Source "), "source").alias("name")).distinct()
    needles = sorted(r["needle"] for r in attribution.author_needles(authors, " SRC1@example.org ").collect())  # fragments of one author's names
    named = attribution.display_name(authors, d)
    matches = attribution.author_matches(needles, F.concat(F.lit("XX-"), "source", F.lit("-yy")), F.lit(None).cast("string"))
    return named.select("doc_id", F.lit(",".join(needles)).alias("needles"), matches.alias("matches"), attribution.email_matches(F.col("email"), F.lit("src1@EXAMPLE.org")).alias("is_author"), "name")


def porcelain(d):
    """Porcelain lines of documents: an author every third line, the local user's where lines are not committed."""
    who = F.when((F.col("i") + F.col("doc_id")) % 2 == 0, "A@x.org").when((F.col("i") + F.col("doc_id")) % 5 == 0, "not.committed.yet").otherwise("b@x.org")
    at = d.select("doc_id", F.posexplode("a").alias("i", "s"))
    line = F.struct((F.col("i") * 2 + 1).alias("pos"), F.concat(F.lit("\t"), "s").alias("line"))
    mail = F.struct((F.col("i") * 2).alias("pos"), F.concat(F.lit("author-mail <"), who, F.lit(">")).alias("line"))
    return at.select(F.col("doc_id").alias("path"), F.explode(F.when(F.col("i") % 3 == 0, F.array(mail, line)).otherwise(F.array(line))).alias("r")).select("path", "r.pos", "r.line")


@query(
    "WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')), k AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM d),"
    " w AS (SELECT *, list_transform(range(0, len(a)), lambda i: (CASE WHEN ((i - i % 3) + doc_id) % 2 = 0 THEN 'a@x.org' WHEN ((i - i % 3) + doc_id) % 5 = 0 THEN 'a@x.org' ELSE 'b@x.org' END) = 'a@x.org') AS own FROM k WHERE len(a) > 0)"
    " SELECT doc_id, len(a) AS n_lines, len(list_filter(own, lambda o: o)) AS n_owned, sha256(array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN own[i] THEN a[i] ELSE '' END), chr(10))) AS masked_sha256,"
    " len(list_filter(own[2:4], lambda o: o)) >= 0.6 * len(own[2:4]) AND len(own[2:4]) > 0 AS owns_block FROM w"
)
def blame_lines(spark, sf_dir):
    """Documents as files with blame: parsed, lines of others masked, and whether lines 2 to 4 are the author's."""
    from quillmill.functions.text import lines

    with Scratch(spark) as scratch:  # texts are searched for line ends once, and the blame that three joins read is parsed once
        d = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~F.col("text").rlike(r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"))
        d = scratch.stash(d.withColumn("n_lines", F.size(lines(F.col("text"))).cast("long"))).where("n_lines > 0")
        blame = scratch.stash(gitlog.parse_blame(porcelain(d.withColumn("a", lines(F.col("text")))), "a@x.org", keep=scratch.stash))
        masked = attribution.mask_lines(d.select(F.col("doc_id").alias("path"), "text", "n_lines"), blame, "a@x.org")
        masked = masked.select("path", "n_lines", F.sha2("masked", 256).alias("masked_sha256"))
        owned = blame.groupBy("path").agg(F.count_if(attribution.email_matches(F.col("author"), F.lit("a@x.org"))).alias("n_owned"))
        spans = attribution.owned_blocks(d.select(F.col("doc_id").alias("path"), F.lit(2).alias("lo"), F.lit(4).alias("hi")), blame, "a@x.org").select("path", F.lit(True).alias("owns_block"))
        out = masked.join(owned, "path").join(spans, "path", "left")
        return scratch.finish(out.select(F.col("path").alias("doc_id"), "n_lines", "n_owned", "masked_sha256", F.coalesce("owns_block", F.lit(False)).alias("owns_block")))


@query("SELECT doc_id AS path FROM documents WHERE source IN ('src1', 'src2') OR (source = 'src3' AND doc_id % 2 = 0)")
def touched_files(spark, sf_dir):
    """Files that an author touched: by the log, or by changes not committed yet."""
    d = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id"))
    log = d.where("source in ('src1', 'src2', 'src4')").select("path", F.lit(1).alias("pos"), F.when(F.col("source") == "src4", "other@x.org").otherwise(" ME@x.org").alias("author"))
    changed = d.where("source = 'src3' and doc_id % 2 = 0").select("path")
    return attribution.touched(d.select("path"), log, "me@x.org", pos="pos", uncommitted=changed, local_user="me@x.org")


PATHS = ["README-%s.md", "lib/contributing%s.rst", "docs/a%s.md", "AGENTS%s.md", "x/y%s.txt", "CHANGELOG-%s.md", "vendor/z%s.md", "x/y%s.py"]


@query(
    "WITH f AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 12 AS w, replace(list_extract(['README-%s.md', 'lib/contributing%s.rst', 'docs/a%s.md', 'AGENTS%s.md', 'x/y%s.txt'], (doc_id % 8 + 1)::INT), '%s', doc_id::VARCHAR) AS path FROM documents),"
    " g AS (SELECT *, trim(repeat('plain words here ', w::INT)) AS text FROM f WHERE k < 5 AND w >= 5), r AS (SELECT *, row_number() OVER (ORDER BY k, path) AS pos FROM g) SELECT pos, path AS origin, text FROM r WHERE pos <= 20"
)
def docs_mined(spark, sf_dir):
    """The reference's first 20 documents of a repository, in order of importance."""
    d = table(spark, sf_dir, "documents")
    path = F.replace(nth(PATHS, F.col("doc_id") % 8), F.lit("%s"), F.col("doc_id").cast("string"))
    rows = d.select(path.alias("path"), F.expr("repeat('plain words here ', cast(doc_id % 12 as int))").alias("text"))
    return repository.mine_docs(rows).select("pos", "origin", "text")


@query(
    "WITH f AS (SELECT doc_id, 'src/d' || doc_id || list_extract(['.sh', '.ts', '.d.ts', '_pb2.py'], (doc_id % 4 + 1)::INT) AS path FROM documents WHERE doc_id % 4 < 2), b AS (SELECT path, 'This comment of file ' || path || ' says in plain words what is done' || chr(10) || 'and on a second line it says why that is so.' AS text FROM f),"
    " r AS (SELECT *, row_number() OVER (ORDER BY path) AS pos FROM b) SELECT pos, path AS origin, text FROM r WHERE pos <= 150"
)
def comments_mined(spark, sf_dir):
    """The reference's first 150 comment blocks: runs of two lines, without stubs and generated files."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), nth([".sh", ".ts", ".d.ts", "_pb2.py"], F.col("doc_id") % 4))
    mark = F.when(F.col("doc_id") % 4 == 0, "# ").otherwise("// ")
    source = F.concat(mark, F.lit("This comment of file "), "path", F.lit(" says in plain words what is done\n"), mark, F.lit("----\n"), mark, F.lit("and on a second line it says why that is so.\nx = 1\n"), mark, F.lit("one line alone is not a block of prose that is kept here\n"))
    return repository.mine_comments(d.withColumn("path", path).select("path", source.alias("text"))).select("pos", "origin", "text")


@query(
    "WITH c AS (SELECT conv_id, turn, ltrim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS t, role FROM conversations), k AS (SELECT * FROM c WHERE role = 'user' AND length(rtrim(t)) >= 80), r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM k) SELECT pos, 'PR #' || conv_id AS origin, rtrim(t) AS text, 'user-login' AS author FROM r WHERE pos <= 30"
)
def prs_mined(spark, sf_dir):
    """The reference's first 30 texts of pull requests: conversations as requests, turn 0 as the body, the user's turns only."""
    text = F.ltrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.struct(F.concat("role", F.lit("-login")).alias("login"), F.lit(None).cast("string").alias("name")).alias("author"), text.alias("body")).alias("t"))
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    notes = F.transform("ts", lambda t: F.struct(t["author"].alias("author"), t["body"].alias("body")))
    one = F.struct(F.col("conv_id").alias("number"), F.lit("t").alias("title"), F.lit("").alias("body"), F.get("ts", F.lit(0))["author"].alias("author"), notes.alias("comments"))
    # one export of all requests would be one row: each conversation is one of its own, put in order by its number
    rows = per.select("conv_id", F.to_json(F.array(one)).alias("raw"))
    return repository.mine_prs(rows, ["userlogin"], order="conv_id").select("pos", "origin", "text", "author")


# -- totals and selections


@query("SELECT lang AS kind, grouping(lang) = 1 AS is_total, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars, sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE (length(text) + 3) // 4 END)::BIGINT AS tokens FROM documents GROUP BY ROLLUP (lang)")
def totals_by_lang(spark, sf_dir):
    return report.totals_by_kind(table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), "text", F.lit(0).alias("tokens")))


@query("SELECT doc_id, doc_id IN (2, 4, 7) AS picked, doc_id IN (1) AS bad FROM documents")
def selections(spark, sf_dir):
    some, none = picked_positions("2, 4 4 7", 10), picked_positions("1 99", 10) or []
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").isin(*some).alias("picked"), (F.col("doc_id").isin(1) & F.lit(not none)).alias("bad"))


@query("SELECT doc_id, CASE WHEN k < 1 THEN 0 WHEN k < 3 THEN 1 WHEN k < 5 THEN 2 WHEN k = 5 THEN 3 ELSE 4 END AS priority FROM (SELECT doc_id, doc_id % 7 AS k FROM documents)")
def doc_priorities(spark, sf_dir):
    paths = ["x/ReadMe.md", "CONTRIBUTING.md", "design-notes.md", "docs/x.md", "a/Docs/x.md", "CLAUDE.md", "notes.md"]
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.doc_priority(nth(paths, F.col("doc_id") % 7)).alias("priority"))
