"""Named queries over the given tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import strip
from quillmill.operators import answers, attribution, budget, cleaning, cost, metering, minhash, relevance, repository, report, secrets, similarity
from quillmill.operators import triage as triage_ops
from quillmill.operators.triage import triage
from quillmill.session import Scratch, bound_batches, spread
from quillmill.sources.usage_store import UsageStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "triage_budget"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table with long texts, for expressions that cost more than dealing rows out to all cores; to Python they go in small batches."""
    bound_batches(spark)
    return spread(table(spark, sf_dir, name))


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# -- pieces of SQL that several oracles share

SIGNALS = f"""
b AS (SELECT *, trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM src),
w AS (SELECT *, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z'']+') AS words,
  list_transform(list_filter(string_split_regex(body, '[.!?]+'), lambda s: regexp_matches(s, '\\S')), lambda s: len(regexp_extract_all(s, '[A-Za-z'']+'))) AS sent FROM b),
v AS (SELECT *, len(words) AS n_words, len(list_filter(words, lambda x: x IN ({quoted(relevance.FIRST_PERSON)}))) AS n_first,
  len(list_filter(words, lambda x: x IN ({quoted(relevance.DISCOURSE)}))) > 0 AS has_discourse,
  len(sent) >= 4 AND len(sent) * list_sum(list_transform(sent, lambda x: x * x)) - list_sum(sent) * list_sum(sent) >= 16 * len(sent) * len(sent) AS varied FROM w),
s AS (SELECT *, CASE WHEN n_words > 0 THEN n_first::DOUBLE / n_words ELSE 0::DOUBLE END AS density,
  CASE WHEN regexp_matches(body, '(?i)\\b\\w+''(?:s|t|re|ve|ll|d|m)\\b') THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN contains(body, '?') THEN 0.05::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN has_discourse THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN varied THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS prose FROM v)"""


def sql_hits(patterns: list[str]) -> str:
    return " + ".join("regexp_matches(flat, '(?i)" + p.replace("'", "''") + "')::INT" for p in patterns)


VERDICTS = f"""
WITH src AS (SELECT doc_id, text, source, lang FROM documents),{SIGNALS},
l AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls, regexp_replace(body, '\\s+', ' ', 'g') AS flat FROM s),
m AS (SELECT *, {sql_hits(relevance.LEGAL)} AS legal, {sql_hits(relevance.FINANCIAL)} AS fin, {sql_hits(relevance.AUTOMATED)} AS auto,
  CASE WHEN len(ls) >= 4 THEN len(list_filter(ls, lambda x: regexp_matches(x, '[$£€]\\s?\\d[\\d,]*(?:\\.\\d{{2}})?|\\b\\d[\\d,]*\\.\\d{{2}}\\b')))::DOUBLE / len(ls) ELSE 0 END AS money,
  CASE WHEN len(ls) >= 4 THEN len(list_filter(ls, lambda x: regexp_matches(regexp_replace(x, '\\PL', '', 'g'), '^\\p{{Lu}}{{3,}}$') AND length(trim(x)) <= 60))::DOUBLE / len(ls) ELSE 0 END AS caps,
  CASE WHEN starts_with(body, 'BEGIN:VCALENDAR') OR contains(body, chr(10) || 'BEGIN:VEVENT') THEN 'export'
    WHEN len(ls) >= 5 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(?:\\[)?\\d{{4}}-\\d{{2}}-\\d{{2}}[ T]\\d{{2}}:\\d{{2}}|^\\s*(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\\b')))::DOUBLE / len(ls) >= 0.6 THEN 'log'
    WHEN len(ls) >= 5 AND len(list_filter(ls, lambda x: length(x) - length(replace(x, ',', '')) >= 3))::DOUBLE / len(ls) >= 0.8 THEN 'export' END AS machine FROM l),
p AS (SELECT *, length(body) < 160 AS short, density >= 0.025::DOUBLE AND n_words >= 120 AND prose >= 0.10::DOUBLE AS protected,
  (0.20::DOUBLE * least(legal + fin + auto, 4) + CASE WHEN money >= 0.20 THEN 0.35::DOUBLE ELSE 0::DOUBLE END + CASE WHEN caps >= 0.30 THEN 0.15::DOUBLE ELSE 0::DOUBLE END)
  * greatest(0.20::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - density * 10.0::DOUBLE)) AS penalty FROM m),
q AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 0.45::DOUBLE + least(density / 0.04::DOUBLE, 1::DOUBLE) * 0.30::DOUBLE + prose - penalty - CASE WHEN length(body) > 200000 THEN 0.20::DOUBLE ELSE 0::DOUBLE END)) AS raw FROM p),
r AS (SELECT *, CASE WHEN short THEN least(raw, 0.80::DOUBLE) ELSE raw END AS sc FROM q),
t AS (SELECT *, CASE WHEN sc >= 0.55::DOUBLE THEN 'keep' WHEN sc < 0.32::DOUBLE AND NOT (protected OR short) THEN 'drop' ELSE 'unsure' END AS ve,
  CASE WHEN greatest(fin, auto, legal) = 0 THEN NULL WHEN fin = greatest(fin, auto, legal) THEN 'financial' WHEN auto = greatest(fin, auto, legal) THEN 'automated' ELSE 'legal' END AS b0 FROM r),
u AS (SELECT *, CASE WHEN money >= 0.20 AND (b0 IS NULL OR b0 = 'legal') THEN 'financial' ELSE b0 END AS bucket,
  short AND NOT (n_first >= 1 AND n_words >= 10 AND (density >= 0.03::DOUBLE OR prose >= 0.10::DOUBLE)) AS voiceless FROM t),
verdicts AS (SELECT doc_id, text, body, lang, source,
  CASE WHEN body = '' THEN 0 WHEN voiceless THEN 0.1 WHEN machine IS NOT NULL AND NOT protected THEN 0.05 ELSE sc END AS raw, round(CASE WHEN body = '' THEN 0 WHEN voiceless THEN 0.1 WHEN machine IS NOT NULL AND NOT protected THEN 0.05 ELSE sc END, 6) AS score, length(body) AS cost,
  CASE WHEN body = '' THEN 'empty' WHEN voiceless THEN 'too short to show a voice' WHEN machine IS NOT NULL AND NOT protected THEN CASE machine WHEN 'log' THEN '{relevance.REASONS["log"]}' ELSE '{relevance.REASONS["export"]}' END
    WHEN short THEN 'short, but it does sound like you'
    WHEN ve = 'drop' OR (ve = 'unsure' AND penalty > 0.15::DOUBLE) THEN CASE bucket WHEN 'legal' THEN '{relevance.REASONS["legal"]}' WHEN 'financial' THEN '{relevance.REASONS["financial"]}' WHEN 'automated' THEN '{relevance.REASONS["automated"]}' ELSE 'does not read like personal writing' END
    WHEN length(body) > 200000 THEN 'very long, more like a book than a note' WHEN ve = 'keep' THEN 'sounds like you, first person and conversational' ELSE 'some of your voice, but hard to be sure' END AS reason,
  CASE WHEN body = '' OR voiceless OR (machine IS NOT NULL AND NOT protected) THEN 'drop' ELSE ve END AS verdict FROM u)
"""

SHINGLED = """
w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS a FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM e x JOIN e y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, inter, na.n + nb.n - inter AS total FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * inter >= 4 * (na.n + nb.n - inter))"""


#: Triage in SQL: verdicts, a walk in rank order that drops near twins of accepted texts, and a walk that fills the budget.
TRIAGE_SQL = "WITH RECURSIVE" + VERDICTS.replace("\nWITH src", "\nsrc", 1) + """,
o AS (SELECT *, row_number() OVER (ORDER BY raw DESC, cost, source, doc_id) AS k FROM verdicts WHERE verdict <> 'drop'),
sw AS (SELECT k, list_filter(string_split_regex(regexp_replace(lower(body), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS a FROM o),
se AS (SELECT DISTINCT k, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS s FROM sw),
sn AS (SELECT k, count(*) AS n FROM se GROUP BY k),
si AS (SELECT x.k AS better, y.k AS worse, count(*) AS inter FROM se x JOIN se y ON x.s = y.s AND x.k < y.k GROUP BY ALL),
g AS (SELECT worse, list(better) AS ups FROM si JOIN sn na ON na.k = better JOIN sn nb ON nb.k = worse WHERE 5 * inter >= 4 * (na.n + nb.n - inter) GROUP BY worse),
walk(step, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.worse, CASE WHEN len(list_filter(g.ups, lambda u: NOT list_contains(walk.dropped, u))) > 0 THEN list_append(walk.dropped, g.worse) ELSE walk.dropped END FROM walk JOIN g ON g.worse = (SELECT min(worse) FROM g g2 WHERE g2.worse > walk.step)),
fin AS (SELECT dropped FROM walk ORDER BY step DESC LIMIT 1),
tw AS (SELECT o.*, t.source AS twin FROM o CROSS JOIN fin LEFT JOIN g ON g.worse = o.k AND list_contains(fin.dropped, o.k) LEFT JOIN o t ON t.k = list_min(list_filter(g.ups, lambda u: NOT list_contains(fin.dropped, u)))),
c AS (SELECT doc_id, cost, row_number() OVER (ORDER BY k) AS r FROM tw WHERE twin IS NULL),
room(r, used, fits, begun) AS (SELECT 0::BIGINT, 0::BIGINT, false, false UNION ALL SELECT c.r, CASE WHEN c.cost > 0 AND begun AND used + c.cost > 180000 THEN used ELSE used + c.cost END, NOT (c.cost > 0 AND begun AND used + c.cost > 180000), begun OR NOT (c.cost > 0 AND begun AND used + c.cost > 180000) FROM room JOIN c ON c.r = room.r + 1),
j AS (SELECT v.doc_id, v.source, tw.twin, v.score, v.reason, v.verdict, room.fits FROM verdicts v LEFT JOIN tw USING (doc_id) LEFT JOIN c ON c.doc_id = v.doc_id LEFT JOIN room ON room.r = c.r)
SELECT doc_id AS sample_id, source AS origin, CASE WHEN twin IS NOT NULL THEN least(score, 0.2) ELSE score END AS score, CASE WHEN twin IS NOT NULL THEN 'nearly identical to ' || twin WHEN verdict <> 'drop' AND NOT fits THEN 'no room left in this run' ELSE reason END AS reason,
  CASE WHEN twin IS NOT NULL THEN 'drop' ELSE verdict END AS verdict, coalesce(fits, false) AS kept FROM j"""


# -- documents: signals, verdicts, near duplicates, budgets


@query(f"WITH src AS (SELECT doc_id, text FROM documents),{SIGNALS} SELECT doc_id, n_words, n_first, round(density, 6) AS density, round(prose, 6) AS prose FROM s")
def doc_signals(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", strip(F.coalesce("text", F.lit(""))).alias("b")).withColumn("w", relevance.word_signals(F.col("b")))
    density = F.when(F.col("w.n") > 0, F.col("w.first") / F.col("w.n")).otherwise(0.0)
    return d.select("doc_id", F.col("w.n").cast("long").alias("n_words"), F.col("w.first").cast("long").alias("n_first"), F.round(density, 6).alias("density"), F.round(relevance.prose_bonus(F.col("b"), F.col("w.discourse")), 6).alias("prose"))


@query("SELECT lang, count(*) AS n_docs, sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE (length(text) + 3) // 4 END)::BIGINT AS tokens FROM documents GROUP BY lang")
def token_estimate_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(cost.estimate_tokens(F.col("text"))).alias("tokens"))


@query(
    "WITH prices(model, i, o, t, io, oo) AS (VALUES " + ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in row) + ")" for row in cost.PRICES) + "),"
    " t AS (SELECT source, sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE (length(text) + 3) // 4 END)::BIGINT AS tokens_in, count(*) * 100 AS tokens_out FROM documents GROUP BY source)"
    " SELECT source, model, tokens_in, tokens_out, tokens_in / 1000000::DOUBLE * CASE WHEN tokens_in > t.t THEN io ELSE i END + tokens_out / 1000000::DOUBLE * CASE WHEN tokens_in > t.t THEN oo ELSE o END AS cost FROM (SELECT a.*, p.* FROM t a CROSS JOIN prices p) t"
)
def cost_by_model(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(cost.estimate_tokens(F.col("text"))).alias("tokens_in"), (F.count("*") * 100).alias("tokens_out"))
    rows = per.withColumn("model", F.explode(F.array(*[F.lit(r[0]) for r in cost.PRICES])))
    return cost.with_cost(rows, "tokens_in", "tokens_out", "model").select("source", "model", "tokens_in", "tokens_out", "cost")


def judged(spark, sf_dir):
    return relevance.score_text(texts(spark, sf_dir), "text", "source").withColumn("score", F.round("score", 6))


@query(VERDICTS + "SELECT doc_id, score, reason, verdict FROM verdicts")
def doc_verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "score", "reason", "verdict")


@query(VERDICTS + "SELECT verdict, quality, count(*) AS n FROM verdicts JOIN labels USING (doc_id) GROUP BY ALL")
def verdict_vs_quality(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "verdict").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("verdict", "quality").agg(F.count("*").alias("n"))


@query(
    "WITH l AS (SELECT conv_id, turn, coalesce(text, '') AS t, string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r]') AS a FROM conversations),"
    " f AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN regexp_matches(a[i], '(?i)^\\s*On\\b.{0,200}?\\bwrote:\\s*$|^\\s*-{2,}\\s*(original message|forwarded message|begin forwarded)\\b|^\\s*(unsubscribe\\b|to unsubscribe|this (e-?mail|message) (is|and any)|sent from my \\w+|confidentiality notice|you are receiving this)') THEN i ELSE 1000000 END) AS st,"
    " list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(a[i], '(?i)^\\s*(from|sent|to|cc|bcc|subject|date|reply-to)\\s*:\\s*\\S') AND regexp_matches(a[i - 1], '(?i)^\\s*(from|sent|to|cc|bcc|subject|date|reply-to)\\s*:\\s*\\S') THEN i ELSE 1000000 END) AS hd FROM l),"
    " c AS (SELECT *, CASE WHEN list_min(st) <= list_min(hd) THEN list_min(st) ELSE list_min(hd) - 1 END AS cut FROM f),"
    " k AS (SELECT conv_id, turn, t, trim(array_to_string(list_filter(a[1:(cut - 1)], lambda s: NOT regexp_matches(s, '^\\s*>')), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS kept FROM c)"
    " SELECT conv_id, turn, kept AS text, round(CASE WHEN length(t) = 0 THEN 0 ELSE greatest(0, 1 - length(kept)::DOUBLE / length(t)) END, 6) AS removed FROM k"
)
def strip_quoted_conversations(spark, sf_dir):
    c = texts(spark, sf_dir, "conversations").withColumn("q", relevance.strip_quoted(F.col("text")))
    return c.select("conv_id", "turn", F.col("q.text").alias("text"), F.round("q.removed", 6).alias("removed"))


@query(
    "WITH s AS (SELECT 'doc' AS origin, doc_id AS id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS b FROM documents UNION ALL SELECT 'event', event_id, trim(coalesce(props, '')) FROM events),"
    " l AS (SELECT *, list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM s)"
    " SELECT origin, CASE WHEN regexp_matches(b, '^(?s:[\\[{].*[\\]}])$') AND json_valid(b) THEN 'export' WHEN len(ls) >= 5 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(?:\\[)?\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}|^\\s*(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\\b')))::DOUBLE / len(ls) >= 0.6 THEN 'log'"
    " WHEN len(ls) >= 5 AND len(list_filter(ls, lambda x: length(x) - length(replace(x, ',', '')) >= 3))::DOUBLE / len(ls) >= 0.8 THEN 'export' END AS kind, count(*) AS n FROM l GROUP BY ALL"
)
def machine_generated(spark, sf_dir):
    docs = texts(spark, sf_dir).select(F.lit("doc").alias("origin"), strip(F.coalesce("text", F.lit(""))).alias("b"))
    props = table(spark, sf_dir, "events").select(F.lit("event").alias("origin"), strip(F.coalesce("props", F.lit(""))).alias("b"))
    return docs.unionByName(props).groupBy("origin", relevance.machine_kind(F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


SETS = "sets AS (SELECT d.doc_id, coalesce(n.n, 0) AS n, min(d.doc_id) OVER (PARTITION BY md5(said)) AS rep FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS said FROM e GROUP BY doc_id) USING (doc_id))"


@query("WITH" + SHINGLED + ", " + SETS + " SELECT a, b, inter, total FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE x.rep = a AND y.rep IN (a, b)")
def shingle_pairs(spark, sf_dir):
    """Similar pairs of distinct sets, by the smallest document of each, and a pair of that one with every other document of an equal set, from which all other pairs follow."""
    with Scratch(spark) as scratch:
        pairs = similarity.pairs_and_copies(texts(spark, sf_dir), "doc_id", "text", 80, scratch)
        return scratch.finish(pairs.select("a", "b", F.col("inter").cast("long").alias("inter"), F.col("total").cast("long").alias("total")))


@query()
def shingle_pairs_banded(spark, sf_dir):
    """shingle_pairs by MinHash bands, which may miss a pair; tests compare with all pairs."""
    with Scratch(spark) as scratch:
        reps = similarity.shingle_classes(texts(spark, sf_dir), "doc_id", "text").where("id = rep and n > 0").select(F.col("id").alias("k"), "n", "hashes")
        return scratch.finish(minhash.banded_pairs(scratch.stash(reps)))


@query("WITH" + SHINGLED + ", " + SETS + " SELECT doc_id, n, rep FROM sets")
def shingle_sets(spark, sf_dir):
    """Documents with equal sets, by the smallest of them."""
    return similarity.shingle_classes(texts(spark, sf_dir), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n"), "rep")


@query(
    "WITH RECURSIVE" + SHINGLED + ", r AS (SELECT doc_id, row_number() OVER (ORDER BY length(coalesce(text, '')), doc_id) AS k FROM documents),"
    " o AS (SELECT least(x.k, y.k) AS better, greatest(x.k, y.k) AS worse FROM pairs JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b),"
    " g AS (SELECT worse, list(better) AS ups FROM o GROUP BY worse),"
    " walk(step, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.worse, CASE WHEN len(list_filter(g.ups, lambda u: NOT list_contains(walk.dropped, u))) > 0 THEN list_append(walk.dropped, g.worse) ELSE walk.dropped END FROM walk JOIN g ON g.worse = (SELECT min(worse) FROM g g2 WHERE g2.worse > walk.step)),"
    " fin AS (SELECT dropped FROM walk ORDER BY step DESC LIMIT 1)"
    " SELECT r.doc_id, t.doc_id AS twin FROM r CROSS JOIN fin LEFT JOIN g ON g.worse = r.k AND list_contains(fin.dropped, r.k) LEFT JOIN r t ON t.k = list_min(list_filter(g.ups, lambda u: NOT list_contains(fin.dropped, u)))"
)
def near_dup_survivors(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return similarity.survivors(d, "doc_id", "text", [F.length("text"), F.col("doc_id")]).select(F.col("id").alias("doc_id"), "twin")


def samples(spark, sf_dir):
    return texts(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("pos"), F.col("source").alias("origin"), "text")


@query(TRIAGE_SQL)
def triage_budget(spark, sf_dir):
    """Triage of all documents: what is kept, what is set aside, and why."""
    return triage(samples(spark, sf_dir)).select("sample_id", "origin", F.round("score", 6).alias("score"), "reason", "verdict", "kept")


BUDGET_SQL = (
    "WITH d AS (SELECT doc_id, doc_id % 4 AS m, length(coalesce(text, '')) AS n FROM documents), k AS (SELECT doc_id, CASE m WHEN 0 THEN 'commit' WHEN 1 THEN 'doc' WHEN 2 THEN 'comment' ELSE 'pr' END AS kind, n FROM d),"
    " q(kind, quota) AS (VALUES ('commit', 72000), ('doc', 45000), ('comment', 36000), ('pr', 27000)),"
    " t AS (SELECT k.*, quota, sum(n) OVER (PARTITION BY kind) - coalesce(sum(n) OVER (PARTITION BY kind ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM k JOIN q USING (kind))"
    " SELECT doc_id, kind, n FROM t WHERE rest <= quota"
)


@query(BUDGET_SQL)
def budget_trim_by_source(spark, sf_dir):
    """Quotas and trimming with kind taken from doc_id; every kind holds more than its share in the given tables."""
    kind = F.element_at(F.array(*map(F.lit, budget.KIND_SHARE)), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    totals = {r["kind"]: r["n"] for r in d.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    return budget.trim_to_quota(d, "kind", F.col("n"), "doc_id", budget.quotas(totals, budget.BUDGET_CHARS))


def filled_sql(turns: int) -> str:
    """Quotas of KIND_SHARE in SQL: what a kind does not need goes to those that want more, turn by turn."""
    shares = ", ".join(f"('{k}', {s}::DOUBLE)" for k, s in budget.KIND_SHARE.items())
    out = f"share(kind, share) AS (VALUES {shares}), q0 AS (SELECT kind, share, floor({budget.BUDGET_CHARS} * share)::BIGINT AS quota, coalesce(n, 0) AS need FROM share LEFT JOIN (SELECT kind, sum(n)::BIGINT AS n FROM m GROUP BY kind) USING (kind))"
    for i in range(turns):
        out += f", s{i} AS (SELECT sum(greatest(quota - need, 0)) AS spare, coalesce(sum(share) FILTER (need > quota), 0) AS whole FROM q{i}), q{i + 1} AS (SELECT kind, share, CASE WHEN spare = 0 OR whole = 0 THEN quota WHEN need > quota THEN quota + floor(spare * (share / whole))::BIGINT ELSE least(quota, need) END AS quota, need FROM q{i}, s{i})"
    return out + f", t AS (SELECT m.*, quota, sum(n) OVER (PARTITION BY kind) - coalesce(sum(n) OVER (PARTITION BY kind ORDER BY n DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM m JOIN q{turns} USING (kind))"


@query(
    "WITH m AS (SELECT 'commit' AS kind, doc_id AS pos, text, length(text) AS n FROM documents WHERE lang = 'en' AND text IS NOT NULL UNION ALL SELECT 'doc', doc_id, text, length(text) FROM documents WHERE lang <> 'en' AND text IS NOT NULL"
    " UNION ALL SELECT 'comment', conv_id * 1000 + turn, text, length(text) FROM conversations WHERE text IS NOT NULL AND turn < 1000 UNION ALL SELECT 'pr', item_id, text, length(text) FROM benchmark WHERE text IS NOT NULL), "
    + filled_sql(4)
    + " SELECT kind, pos, sha256(text) AS text_sha256 FROM t WHERE rest <= quota"
)
def mined_all(spark, sf_dir):
    """Four kinds of texts within one budget; what the benchmark's items leave of their share goes to the others."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    rows = lambda df, kind, pos: df.select(pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), F.lit(kind).alias("origin"), "text", F.lit(None).cast("string").alias("author"))
    talk = table(spark, sf_dir, "conversations").where("text is not null and turn < 1000")
    parts = [rows(d.where("lang = 'en'"), "commit", F.col("doc_id")), rows(d.where("lang <> 'en'"), "doc", F.col("doc_id")), rows(talk, "comment", F.col("conv_id") * 1000 + F.col("turn")), rows(table(spark, sf_dir, "benchmark").where("text is not null"), "pr", F.col("item_id"))]
    return repository.mine_all(parts).select("kind", "pos", F.sha2("text", 256).alias("text_sha256"))


@query(VERDICTS + ", o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, cost, source, doc_id) AS r FROM verdicts WHERE verdict <> 'keep') SELECT doc_id, verdict, verdict = 'keep' OR coalesce(r, 0) IN (1, 3, 4, 20) AS kept FROM verdicts LEFT JOIN o USING (doc_id)")
def put_back(spark, sf_dir):
    """Verdicts, with four of the texts that were set aside taken back by their places in rank order."""
    with Scratch(spark) as scratch:
        j = judged(spark, sf_dir).select(F.col("doc_id").alias("pos"), "source", "score", "verdict", F.length(strip(F.coalesce("text", F.lit("")))).alias("cost"))
        j = scratch.stash(j).withColumn("kept", F.col("verdict") == "keep")
        out = triage_ops.put_back(j, triage_ops.picked_positions("1,3 4, 20", 1000), [-F.col("score"), F.col("cost"), F.col("source"), F.col("pos")])
        return scratch.finish(out.select(F.col("pos").alias("doc_id"), "verdict", "kept"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY lower(regexp_replace(text, '\\s+', ' ', 'g'))")
def first_wins_distinct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(cleaning.distinct_key(F.col("text")), 256).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


#: The one shape of credentials in the given documents; exercises.planted_secrets holds the others.
TOKEN = '(?i)\\btoken = "[0-9a-f]{40}"'
REDACTED = "regexp_replace({}, '(?i)(\\btoken = \")[0-9a-f]{{40}}\"', '\\1<REDACTED:generic-secret-assignment>\"', 'g')"
HITS_SQL = (
    f"WITH m AS (SELECT doc_id, source, text, regexp_extract_all(text, '{TOKEN}') AS ms, string_split_regex(text, '{TOKEN}') AS ps FROM documents WHERE regexp_matches(text, '{TOKEN}')), k AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),"
    " s AS (SELECT doc_id, source, text, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + 50 * (i - 1) + 9)::BIGINT AS start FROM k), l AS (SELECT *, 1 + length(left(text, start)) - length(replace(left(text, start), chr(10), '')) AS line FROM s),"
    f" r AS (SELECT *, trim({REDACTED.format('string_split(text, chr(10))[line]')}, ' ' || chr(9) || chr(13)) AS red FROM l), p AS (SELECT *, strpos(red, '<REDACTED:') - 1 AS mark FROM r)"
)


@query(
    HITS_SQL + " SELECT doc_id, 'generic-secret-assignment' AS rule, 'medium' AS severity, start, start + 40 AS \"end\", line, CASE WHEN length(red) <= 200 THEN red ELSE CASE WHEN mark > 60 THEN '... ' ELSE '' END || substr(red, greatest(0, mark - 60) + 1, least(length(red), mark + 155) - greatest(0, mark - 60)) || CASE WHEN mark + 155 < length(red) THEN ' ...' ELSE '' END END AS excerpt FROM p"
)
def secret_findings(spark, sf_dir):
    return secrets.findings(texts(spark, sf_dir).select("doc_id", "text"))


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n_hits, sha256({REDACTED.format("coalesce(text, '')")}) AS redacted_sha256 FROM documents")
def redacted_docs(spark, sf_dir):
    out = secrets.scan(texts(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))


@query(
    "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]{16,}')) AS word FROM documents), c AS (SELECT word, unnest(string_split(word, '')) AS ch FROM w), g AS (SELECT word, ch, count(*)::DOUBLE AS k FROM c WHERE ch <> '' GROUP BY ALL)"
    " SELECT word, round(-sum(k / length(word) * log2(k / length(word))), 5) AS bits FROM g GROUP BY word"
)
def entropy_words(spark, sf_dir):
    w = texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]{16,})"), 1)).alias("word")).distinct()
    return w.select("word", F.round(secrets.entropy_column(F.col("word")), 5).alias("bits"))


PROSE_SQL = "WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS b FROM documents) SELECT doc_id, length(b) >= 60 AND NOT regexp_matches(b, '(?i)^\\s*(?:see\\s+)?https?://\\S+\\s*$') AND NOT regexp_matches(b, '(?i)" + cleaning.PRAGMA + "') AND NOT regexp_matches(b, '(?i)" + cleaning.LICENSE + "') AND len(regexp_extract_all(b, '[A-Za-z'']{2,}')) >= 8 AND length(regexp_replace(b, '[^\\pL\\s]', '', 'g'))::DOUBLE / greatest(length(b), 1) > 0.6 AS prose FROM t"


@query(PROSE_SQL)
def license_and_prose(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", cleaning.looks_like_prose(F.col("text")).alias("prose"))


HTML_SQL = (
    "WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g') AS t FROM pages),"
    " l AS (SELECT page_id, list_transform(string_split(t, chr(10)), lambda x: struct_pack(raw := x, s := trim(x, ' ' || chr(9) || chr(13)))) AS a FROM b),"
    " f AS (SELECT page_id, list_filter(a, lambda x: x.s = '' OR NOT (starts_with(x.s, '|') OR regexp_matches(x.s, '^[-=~^_*+|: ]{3,}$') OR regexp_matches(x.s, '^\\s*\\[[^\\]]+\\]:\\s*\\S+') OR ((starts_with(x.raw, '    ') OR starts_with(x.raw, chr(9))) AND NOT regexp_matches(x.s, '^[-*>#]')))) AS a FROM l),"
    " i AS (SELECT page_id, list_transform(a, lambda x: struct_pack(was := x.s, s := trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x.s, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>\\n]{1,200}>', '', 'g'), '`{1,3}([^`]*)`{1,3}', '\\1', 'g'), '^#{1,6}\\s*', ''), ' ' || chr(9) || chr(13)))) AS a FROM f)"
    " SELECT page_id, trim(regexp_replace(array_to_string(list_transform(list_filter(a, lambda x: x.was = '' OR x.s <> ''), lambda x: x.s), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM i"
)


@query(HTML_SQL)
def html_clean(spark, sf_dir):
    p = texts(spark, sf_dir, "pages")
    return p.select("page_id", cleaning.clean_markdown(F.col("html")).alias("text"))


# -- events: roll-ups and metering

OP_SQL = "CASE event_type WHEN 'purchase' THEN 'persona' ELSE 'aux' END"
CAPS = metering.Caps(user=1, user_aux=3, total=40, total_aux=30)


def calls(spark, sf_dir):
    op = F.when(F.col("event_type") == "purchase", "persona").otherwise("aux")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("user"), op.alias("op"))


@query("SELECT 'u' || user_id AS email, arg_min(event_type, event_id) AS name, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def author_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), F.col("event_type").alias("name"), F.col("event_id").alias("pos"))
    return attribution.author_rollup(e)


@query(
    "WITH a AS (SELECT DISTINCT source || '@example' AS email FROM documents UNION SELECT DISTINCT 'src' || user_id FROM events), d AS (SELECT doc_id AS path, ' ' || upper(source) || '@example.org' AS author FROM documents)"
    " SELECT DISTINCT path, email FROM d JOIN a ON contains(lower(trim(author)), email) OR contains(email, lower(trim(author)))"
)
def files_of_all_authors(spark, sf_dir):
    """Documents as files of their source's address, attributed to every address that it may be."""
    d = table(spark, sf_dir, "documents")
    log = d.select(F.col("doc_id").alias("path"), F.concat(F.lit(" "), F.upper("source"), F.lit("@example.org")).alias("author"))
    authors = d.select(F.concat("source", F.lit("@example")).alias("email")).union(table(spark, sf_dir, "events").select(F.concat(F.lit("src"), F.col("user_id").cast("string"))))
    return attribution.touched_by_all(log, authors)


@query(f"SELECT ts::DATE AS day, user_id AS user, {OP_SQL} AS op, count(*) AS n FROM events GROUP BY ALL")
def usage_daily(spark, sf_dir):
    return metering.usage_daily(calls(spark, sf_dir))


@query(f"SELECT ts::DATE AS day, user_id::VARCHAR AS user, {OP_SQL} AS op, count(*) AS n FROM events GROUP BY ALL")
def usage_compacted(spark, sf_dir):
    """The counter as a store of four batches, merged after the second and the third; the last one is read from the log."""
    with Scratch(spark) as scratch:
        store, rows = UsageStore(spark, f"{scratch.path}/usage"), calls(spark, sf_dir)
        for batch in range(4):
            store.append(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == batch), batch)
            if batch in (1, 2):
                store.compact()
        return scratch.finish(store.read())


@query(
    f"WITH e AS (SELECT event_id, ts, ts::DATE AS day, user_id AS user, {OP_SQL} AS op FROM events),"
    " a AS (SELECT *, row_number() OVER (PARTITION BY day, user, op ORDER BY ts, event_id) AS r FROM e), a1 AS (SELECT * FROM a WHERE r <= CASE WHEN op = 'aux' THEN 3 ELSE 1 END),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY day, op ORDER BY ts, event_id) AS r2 FROM a1), b1 AS (SELECT * FROM b WHERE op <> 'aux' OR r2 <= 30),"
    " c AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS r3 FROM b1), adm AS (SELECT event_id FROM c WHERE r3 <= 40),"
    " x AS (SELECT e.*, adm.event_id IS NOT NULL AS admitted FROM e LEFT JOIN adm USING (event_id)),"
    " y AS (SELECT *, coalesce(sum(admitted::INT) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, coalesce(sum((admitted AND op = 'aux')::INT) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ga FROM x)"
    " SELECT event_id, day, admitted, CASE WHEN admitted THEN NULL WHEN g >= 40 THEN 'global' WHEN op = 'aux' AND ga >= 30 THEN 'aux_global' ELSE 'user' END AS reason FROM y"
)
def metering_admission(spark, sf_dir):
    return metering.admission(calls(spark, sf_dir), CAPS).select("event_id", "day", "admitted", "reason")


@query(
    f"WITH u AS (SELECT ts::DATE AS day, user_id AS user, count(*) FILTER ({OP_SQL} <> 'aux') AS used, count(*) FILTER ({OP_SQL} = 'aux') AS aux_used FROM events GROUP BY ALL)"
    " SELECT day, user, used, 1 AS cap, greatest(1 - used, 0) AS remaining, aux_used, 3 AS aux_cap, greatest(3 - aux_used, 0) AS aux_remaining, (day + INTERVAL 1 DAY)::TIMESTAMP AS resets_at FROM u"
)
def quota_view(spark, sf_dir):
    return metering.quota_view(metering.usage_daily(calls(spark, sf_dir)), CAPS)


@query("SELECT user_id AS user, time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, count(*) AS n, count(*) > 12 AS limited FROM events GROUP BY ALL")
def burst_windows(spark, sf_dir):
    return metering.burst_windows(calls(spark, sf_dir), metering.Caps())


@query("SELECT DISTINCT user_id AS user, substr(sha256('salt:' || user_id), 1, 16) AS anon FROM events")
def anon_identity(spark, sf_dir):
    return calls(spark, sf_dir).select("user").distinct().select("user", metering.anonymous_id(F.col("user").cast("string"), "salt").alias("anon"))


# -- conversations and reports


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'model' END || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS contents FROM conversations GROUP BY conv_id")
def chat_history(spark, sf_dir):
    h = answers.chat_history(table(spark, sf_dir, "conversations"))
    return h.select("conv_id", F.array_join(F.transform("contents", lambda t: F.concat(t["role"], F.lit(":"), F.coalesce(t["text"], F.lit("")))), "\n").alias("contents"))


@query("WITH s AS (SELECT count(*) AS n_samples, sum(len(regexp_extract_all(coalesce(text, ''), '\\S+')))::BIGINT AS n_words FROM documents) SELECT *, n_samples > 0 AND n_words < 400 AS thin FROM s")
def evidence_summary(spark, sf_dir):
    return answers.evidence_summary(table(spark, sf_dir, "documents"))


@query(
    f"SELECT count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars, sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE (length(text) + 3) // 4 END)::BIGINT AS tokens, sum(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')))::BIGINT AS n_findings, 0 AS n_high FROM documents"
)
def report_totals(spark, sf_dir):
    d = texts(spark, sf_dir).select(F.col("source").alias("origin"), "text", F.lit(0).alias("tokens"))
    return report.totals(d, secrets.findings(d.select("origin", "text")))


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
COMMITS_SQL = (
    f"WITH s AS (SELECT doc_id, source, coalesce(text, '') AS body, trim(split_part(trim(coalesce(text, ''), {SPACES}), chr(10), 1), {SPACES}) AS subject FROM documents),"
    " g AS (SELECT * FROM s WHERE subject <> '' AND NOT regexp_matches(source, '(?i)dependabot|renovate|github-actions|greenkeeper|snyk-bot|imgbot|pre-commit-ci|allcontributors|weblate|crowdin|\\[bot\\]') AND NOT regexp_matches(subject, '(?i)^merge\\b|^revert\\b|^bump\\b|^\\w+\\(deps(?:-dev)?\\)|^(?:chore|ci|build|style)\\b[^:]*:\\s*(?:bump|update|upgrade|pin)\\b"
    "|^(?:chore|ci|build)\\b[^:]*:\\s*(?:lint|format|prettier|reformat)\\b|^update\\s+(?:dependenc|changelog|lock|submodule|snapshot|package-lock)|^upgrade\\s+dependenc|^(?:release|version|chore\\(release\\))\\b|^v?\\d+\\.\\d+(?:\\.\\d+)?(?:[-+][\\w.]+)?\\s*$|^\\[?(?:automated|auto|bot|skip ci)\\]?\\b"
    "|^(?:apply|run)\\s+(?:black|prettier|gofmt|rustfmt|isort|clang-format)|^regenerate\\b|^(?:wip|tmp|temp|test|asdf|foo|stuff|misc|minor|cleanup|typo|fixes|fix)\\s*[.!]?$|^(?:fix|fixed)\\s+typos?\\b|^initial commit\\s*$|^(?:add|update)\\s+\\.?gitignore\\s*$')),"
    f" c AS (SELECT doc_id, source, trim(regexp_replace(array_to_string(list_transform(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(trim(x, {SPACES}), '(?i)generated with|co-?authored-?by|^\\s*(?:signed-off-by|acked-by|reviewed-by|tested-by|reported-by|suggested-by|helped-by|cc|change-id|pr-link|differential revision|reviewed-on|git-svn-id|bug)\\s*:|^\\s*[A-Za-z][A-Za-z-]*-by\\s*:')),"
    f" lambda x: rtrim(x, {SPACES})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {SPACES}) AS t FROM g),"
    " f AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(t, '\\s+', ' ', 'g')) ORDER BY doc_id) AS r FROM c WHERE length(t) >= 40)"
    " SELECT doc_id AS pos, 'git log ' || left(sha1(doc_id::VARCHAR), 7) AS origin, sha256(t) AS text_sha256, source || '@example.org' AS author FROM f WHERE r = 1"
)


@query(COMMITS_SQL)
def commits_mined(spark, sf_dir):
    """Documents as commit messages: trailers off, noise out, each text once, newest first."""
    c = texts(spark, sf_dir).select(F.col("doc_id").alias("pos"), F.sha1(F.col("doc_id").cast("string")).alias("sha"), F.concat("source", F.lit("@example.org")).alias("email"), F.col("source").alias("name"), F.col("text").alias("body"))
    return repository.mine_commits(c, limit=None).select("pos", "origin", F.sha2("text", 256).alias("text_sha256"), "author")


@query(
    "WITH e AS (SELECT doc_id, list_distinct(CASE WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS s FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS a FROM documents) WHERE len(a) > 0),"
    " q AS (SELECT item_id, list_distinct(CASE WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS s FROM (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS a FROM benchmark) WHERE len(a) > 0),"
    " eu AS (SELECT doc_id, unnest(s) AS s FROM e), qu AS (SELECT item_id, len(s) AS n, unnest(s) AS s FROM q)"
    " SELECT item_id, doc_id, count(*) AS shared, any_value(n)::BIGINT AS n FROM eu JOIN qu USING (s) GROUP BY item_id, doc_id"
)
def benchmark_overlap(spark, sf_dir):
    """An extension: shingles that documents share with benchmark items, by a join on the items' shingles."""
    s = lambda df: F.explode(similarity.shingles(F.col("text"))).alias("s")
    items = table(spark, sf_dir, "benchmark").withColumn("n", F.size(similarity.shingles(F.col("text"))).cast("long"))
    q = items.select("item_id", "n", s(items))
    d = texts(spark, sf_dir)
    return d.select("doc_id", s(d)).join(q, "s").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
