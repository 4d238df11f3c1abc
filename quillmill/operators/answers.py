"""The boundary to a hosted model: prompts in, structured answers out. No network here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import strip

BODY = "struct<promptFeedback:struct<blockReason:string>,candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>>"
ENTRY = "struct<question:string,prompt:string,text:string,options:variant,choices:variant>"


def strip_fences(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return strip(F.regexp_replace(F.regexp_replace(t, r"\A```(?:json)?", ""), r"```\z", ""))


def extract_text(raw: Column) -> Column:
    """struct(text, error): all text parts of the first candidate, or why there is none."""
    body = F.from_json(raw, BODY)
    texts = F.filter(F.transform(F.get(body["candidates"], F.lit(0))["content"]["parts"], lambda p: p["text"]), lambda t: t.isNotNull())
    blocked, many = body["promptFeedback"]["blockReason"], F.coalesce(F.size(texts), F.lit(0))
    reason = F.get(body["candidates"], F.lit(0))["finishReason"]
    error = F.when(F.coalesce(blocked, F.lit("")) != "", F.concat(F.lit("blocked: "), blocked)).when(F.coalesce(F.size(body["candidates"]), F.lit(0)) <= 0, "no candidates").when(many <= 0, F.concat(F.lit("empty response"), F.coalesce(F.concat(F.lit(": "), reason), F.lit(""))))
    return F.struct(F.when(error.isNull(), F.array_join(texts, "")).alias("text"), error.alias("error"))


def questions(df: DataFrame, raw: str = "raw", limit: int | None = None) -> DataFrame:
    """df's other columns, pos, question, options from any shape that answers come in.

    A bare array, the first list under questions, Questions, items or data, or one
    object; aliases prompt, text and choices; a lone option becomes a list. Entries
    without a question or options are left out.
    """
    keep = [c for c in df.columns if c != raw]
    v = F.try_parse_json(strip_fences(F.col(raw)))
    entries = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.questions", "$.Questions", "$.items", "$.data")], F.when(F.try_variant_get(v, "$.question", "variant").isNotNull(), F.array(v)))
    rows = df.select(*keep, F.posexplode(entries).alias("_at", "_e"))
    said = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("_e", f"$.{n}", "string"), F.lit("")) for n in names])
    listed = lambda n: F.coalesce(F.try_variant_get("_e", f"$.{n}", "array<string>"), F.array(F.nullif(F.try_variant_get("_e", f"$.{n}", "string"), F.lit(""))))
    some = lambda a: F.filter(a, lambda o: o.isNotNull() & (strip(o) != ""))
    first = F.when(F.size(some(listed("options"))) > 0, some(listed("options"))).otherwise(some(listed("choices")))
    out = rows.select(*keep, F.col("_at"), strip(said("question", "prompt", "text")).alias("question"), first.alias("options"))
    out = out.where((F.coalesce("question", F.lit("")) != "") & (F.size("options") > 0))
    from pyspark.sql import Window

    out = out.withColumn("pos", F.row_number().over(Window.partitionBy(*keep).orderBy("_at")) - 1) if keep else out.withColumn("pos", F.col("_at"))
    return (out.where(F.col("pos") < limit) if limit is not None else out).select(*keep, "pos", "question", "options")


def document_part(label: Column, text: Column) -> Column:
    return F.concat(F.lit("\n\n--- Document: "), label, F.lit(" ---\n"), text, F.lit("\n--- End Document ---\n"))


def sample_label(kind: Column, origin: Column) -> Column:
    return F.when(F.coalesce(kind, F.lit("")) != "", F.concat(kind, F.lit(": "), origin)).otherwise(origin)


def file_part(filename: Column, mimetype: Column, content: Column) -> Column:
    """struct(text, mime, data): text kinds inline, others in base64 without line ends."""
    mime = F.coalesce(F.nullif(mimetype, F.lit("")), F.lit("application/octet-stream"))
    text = mime.startswith("text/") | mime.isin("application/json", "message/rfc822")
    return F.struct(F.when(text, document_part(filename, F.make_valid_utf8(content.cast("string")))).alias("text"), F.when(~text, mime).alias("mime"), F.when(~text, F.regexp_replace(F.base64(content), r"[\r\n]", "")).alias("data"))


def fill_template(template: str, **values: Column) -> Column:
    """``{name}`` replaced by columns; braces in values survive."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def evidence_summary(samples: DataFrame, text: str = "text") -> DataFrame:
    """n_samples, n_words, thin (some samples, but under 400 words)."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?U)\S+")).cast("long")
    per = samples.agg(F.count("*").alias("n_samples"), F.coalesce(F.sum(words), F.lit(0)).alias("n_words"))
    return per.withColumn("thin", (F.col("n_samples") > 0) & (F.col("n_words") < 400))


def chat_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, contents: turns in order; the user stays user, any other role is model."""
    row = F.struct(F.col(turn).alias("turn"), F.when(F.col(role) == "user", "user").otherwise("model").alias("role"), F.col(text).alias("text"))
    return turns.groupBy(conv).agg(F.sort_array(F.collect_list(row)).alias("contents"))


def sanitize(text: Column, key: str | None = None) -> Column:
    """Text without a known key, key parameters and key-shaped words."""
    out = F.replace(text, F.lit(key), F.lit("***")) if key and len(key) >= 8 else text
    return F.regexp_replace(F.regexp_replace(out, r"([?&]key=)[^&\s\"']+", "$1***"), r"AIza[0-9A-Za-z_\-]{10,}", "***")


def mask_key(key: Column) -> Column:
    k = F.coalesce(key, F.lit(""))
    return F.when(k == "", "(not set)").when(F.length(k) <= 8, F.concat(F.lit("…"), F.right(k, F.lit(2)))).otherwise(F.concat(F.left(k, F.lit(4)), F.lit("…"), F.right(k, F.lit(4))))


def first_set(values: dict[str, Column]) -> Column:
    """struct(value, source): the first value that is not blank, trimmed, with its name; ``none`` where all are blank."""
    some = {name: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit("")) for name, c in values.items()}
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in some.items()], F.lit("none"))
    return F.struct(F.coalesce(*some.values()).alias("value"), source.alias("source"))


def model_rank(name: Column) -> Column:
    """struct(family, version, plain): flash models that neither think nor speak live, then pro ones; null for others."""
    has = lambda s: F.contains(name, F.lit(s))
    family = F.when(has("flash") & ~has("thinking") & ~has("live"), 2).when(has("pro"), 1)
    version = F.coalesce(F.nullif(F.regexp_extract(name, r"gemini-(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))
    plain = F.regexp_replace(name, r"[0-9.\-]+\z", "").endswith("flash").cast("int")
    return F.when(family.isNotNull(), F.struct(family.alias("family"), version.alias("version"), plain.alias("plain")))


def preferred_model(models: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """The best model's name, one row: the newest flash, a plain one first, then the first listed; without any flash among all, the newest pro; no row without either."""
    ranked = models.withColumn("_r", model_rank(F.col(name))).where("_r is not null")
    best = ranked.groupBy().agg(F.max(F.struct("_r", (-F.col(pos)).alias("p"), F.col(name).alias("name"))).alias("best"))
    return best.where("best is not null").select(F.col("best.name").alias(name))


def evidence_line(samples: DataFrame, files: DataFrame | None = None, text: str = "text") -> DataFrame:
    """evidence: what there is to work from, in words, one row."""
    n = evidence_summary(samples, text)
    some = F.when(F.col("n_samples") > 0, F.format_string("%d text sample(s), about %s words in total", "n_samples", F.format_number("n_words", 0)))
    count = files.agg(F.count("*").alias("n_files")) if files is not None else samples.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_files"))
    both = n.crossJoin(F.broadcast(count))  # one row each
    seen = F.when(F.col("n_files") > 0, F.format_string("%d image(s) or document(s) you must read yourself", "n_files"))
    said = F.coalesce(F.nullif(F.concat_ws(" and ", some, seen), F.lit("")), F.lit("no writing samples at all"))
    return both.select("n_samples", "n_files", F.concat(said, F.when(F.col("thin"), ". That is very little. Expect most claims to be provisional").otherwise("")).alias("evidence"))


def prompt(samples: DataFrame, answers: DataFrame, templates: dict[str, str], name: str, description: str | None = None, files: DataFrame | None = None, text: str = "text") -> DataFrame:
    """regime, prompt, one row: how to ask for a persona.

    ``templates`` has ``invent`` (from a description alone, without any evidence),
    ``extract`` and ``described`` (which goes before it if there is a description), with
    places for {target_name}, {description}, {evidence} and {answers}; answers has pos,
    question and answer, of one interview. Braces in values survive.
    """
    pairs = F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("said"))))
    told = answers.agg(F.array_join(F.transform(pairs, lambda x: x["said"]), "\n\n").alias("answers"))
    row = evidence_line(samples, files, text).crossJoin(F.broadcast(told))  # one row each
    alone = (F.col("n_samples") == 0) & (F.col("n_files") == 0) if description else F.lit(False)
    values = {"evidence": F.col("evidence"), "target_name": F.lit(name or "the author"), "answers": F.col("answers"), "description": F.lit(description or "")}
    extract = fill_template((templates["described"] if description else "") + templates["extract"], **values)
    regime = F.when(alone, "invent").otherwise("described" if description else "extract")
    return row.select(regime.alias("regime"), F.when(alone, fill_template(templates["invent"], **values)).otherwise(extract).alias("prompt"))


def answered(prompts: DataFrame, call, prompt_col: str = "prompt") -> DataFrame:
    """prompts with raw, what ``call(prompt)`` returns, and error, what it raises; ``call`` is the caller's own, run on executors. Nothing here opens a connection."""

    @F.pandas_udf("raw string, error string")
    def ask(texts):
        import pandas as pd

        rows = []
        for t in texts:
            try:
                rows.append((call(t), None))
            except Exception as e:  # the caller's own errors are data here
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["raw", "error"])

    return prompts.withColumn("_a", ask(prompt_col)).withColumns({"raw": F.col("_a.raw"), "error": F.col("_a.error")}).drop("_a")
