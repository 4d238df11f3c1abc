"""Cleaning of quoted mail and scoring of personal prose, as expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import WS, is_blank, let, letter_words, lines, strip

# Thresholds, word lists, patterns and reasons that results must agree with.
KEEP_AT, DROP_BELOW, SHORT_CHARS, LONG_CHARS = 0.55, 0.32, 160, 200_000
FIRST_PERSON = ["i", "i'm", "i've", "i'd", "i'll", "im", "ive", "me", "my", "mine", "myself", "we", "we're", "we've", "our", "ours", "us", "ourselves"]
DISCOURSE = ["anyway", "honestly", "actually", "basically", "though", "besides", "obviously", "frankly", "maybe", "probably", "kind", "sort", "really", "just", "still", "but", "so", "because", "well", "guess", "suppose"]
LEGAL = [
    r"\bhereinafter\b", r"\bwhereas,", r"\bshall be deemed\b", r"\bin witness whereof\b", r"\bpursuant to\b", r"\bthe part(?:y|ies) of the\b", r"\bterms and conditions\b",
    r"\bgoverning law\b", r"\ball rights reserved\b", r"\bsecurity deposit\b", r"\blessee\b|\blessor\b|\btenant shall\b|\blandlord shall\b",
]
FINANCIAL = [
    r"\binvoice\s*(?:#|no\.?\b|number\b)", r"\b(?:total|amount|balance|payment)\s+due\b", r"\baccount\s+number\b", r"\brouting\s+number\b", r"\bsort\s+code\b", r"\bstatement\s+period\b",
    r"\b(?:beginning|opening|closing|ending|available)\s+balance\b", r"\b(?:gross|net)\s+pay\b", r"\bsubtotal\b", r"\bsales tax\b|\bvat\b|\btax withheld\b", r"\bpolicy\s+number\b",
    r"\bbill(?:ing)?\s+(?:period|address|cycle)\b", r"\bremit\s+to\b|\bpay\s+to\s+the\s+order\b", r"\bwages,?\s+tips\b|\bform\s+w-?2\b|\bform\s+1099\b",
]
AUTOMATED = [
    r"\bthis is an automated\b|\bdo not reply to this\b", r"\bauto(?:matic|mated)[- ]repl(?:y|ies)\b", r"\byou are receiving this (?:e-?mail|message)\b", r"\bunsubscribe\b",
    r"\bconfidentiality notice\b", r"\bdelivery status notification\b",
]
# For each pattern above, in lower case, what a text it matches must contain (any of them).
LEGAL_WORDS = ["hereinafter", "whereas,", "deemed", "witness", "pursuant", "the part", "conditions", "governing", "reserved", "deposit", "lessee|lessor|tenant|landlord"]
FINANCIAL_WORDS = ["invoice", "due", "account", "routing", "sort", "statement", "balance", "pay", "subtotal", "tax|vat", "policy", "bill", "remit|pay", "wages|form"]
AUTOMATED_WORDS = ["automated|reply", "repl", "receiving", "unsubscribe", "confidentiality", "notification"]
MONEY = r"[$£€]\s?\d[\d,]*(?:\.\d{2})?|\b\d[\d,]*\.\d{2}\b"
LOG_LINE = r"^\s*(?:\[)?\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}|^\s*(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b"
CONTRACTION = r"(?i)\b\w+'(?:s|t|re|ve|ll|d|m)\b"
ON_WROTE = r"^\s*On\b.{0,200}?\bwrote:\s*$"
ORIGINAL = r"^\s*-{2,}\s*(original message|forwarded message|begin forwarded)\b"
HEADER = r"^\s*(from|sent|to|cc|bcc|subject|date|reply-to)\s*:\s*\S"
FOOTER = r"^\s*(unsubscribe\b|to unsubscribe|this (e-?mail|message) (is|and any)|sent from my \w+|confidentiality notice|you are receiving this)"
NAME_DROP = (
    r"\b(?:invoice|invoices|receipt|receipts|statement|statements|payslip|payslips|paystub|paystubs|payroll|payment|payments|w2|w4|w9|1099|1040|p60|p45|tax|taxes|taxreturn|irs|hmrc|vat"
    r"|bill|billing|utility|utilities|lease|tenancy|tenant|landlord|mortgage|deed|escrow|contract|agreement|nda|terms|policy|policies|insurance|claim"
    r"|bank|banking|amex|visa|mastercard|paypal|venmo|stripe|refund|invoiced|quote|estimate|purchase|order|po|passport|licence|license|ssn|medicare|medicaid|benefit|benefits)\b"
)
NAME_KEEP = (
    r"\b(?:img|image|pxl|dsc|dscn|photo|photos|pic|pics|picture|screenshot|screen shot|signal|scan note|journal|diary|letter|letters|note|notes|essay|essays|draft|drafts"
    r"|poem|poems|story|stories|handwriting|handwritten|writing|writings|memoir|entry|entries)\b"
)
REASONS = {
    "legal": "looks like a contract, not your writing",
    "financial": "looks like an invoice or statement, not your writing",
    "automated": "reads like an automated message",
    "export": "looks like a data export, not writing",
    "log": "looks like a log file, not writing",
}

U, IU = "(?U)", "(?iU)"  # Unicode classes, as Python's patterns have them


def strip_quoted(text: Column) -> Column:
    """struct(text, removed): a message without quoted lines, and cut at a reply's start, a footer or a header block.

    The cut is at the first line that stops, or at the second of two header lines in
    direct succession, and then the first of them goes too. Null counts as empty.
    """
    source = F.coalesce(text, F.lit(""))
    head = lambda s: s.rlike(IU + HEADER)
    stop = lambda s: s.rlike(f"{IU}{ON_WROTE}|{ORIGINAL}|{FOOTER}")
    last = F.lit(1 << 30)

    def cut(a: Column) -> Column:
        at = F.transform(a, lambda s, i: F.when(stop(s), i).otherwise(last))
        second = F.transform(a, lambda s, i: F.when((i > 0) & head(s) & head(F.get(a, F.greatest(i - 1, F.lit(0)))), i).otherwise(last))
        return let(F.struct(F.coalesce(F.array_min(at), last).alias("stop"), F.coalesce(F.array_min(second), last).alias("second")), lambda c: F.when(c["stop"] <= c["second"], c["stop"]).otherwise(c["second"] - 1))

    body = let(lines(source), lambda a: let(cut(a), lambda c: F.filter(a, lambda s, i: (i < c) & ~s.rlike(rf"{U}^\s*>"))))
    kept = strip(F.array_join(body, "\n"))
    return let(kept, lambda k: F.struct(k.alias("text"), F.when(F.length(source) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.length(k) / F.length(source)))).alias("removed")))


def word_signals(text: Column) -> Column:
    """struct(n, first, discourse): counts over the letter words."""
    return let(letter_words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x: x.isin(FIRST_PERSON))).alias("first"), F.exists(w, lambda x: x.isin(DISCOURSE)).alias("discourse")))


def varied_sentences(text: Column) -> Column:
    """At least four sentences whose word counts have a population deviation of 4 or more (in integers)."""
    counts = F.transform(F.filter(F.split(text, "[.!?]+"), lambda s: ~is_blank(s)), lambda s: F.regexp_count(s, F.lit("[A-Za-z']+")).cast("long"))
    zero = F.lit(0).cast("long")
    sums = let(counts, lambda c: F.struct(F.size(c).cast("long").alias("n"), F.aggregate(c, zero, lambda a, x: a + x).alias("s"), F.aggregate(c, zero, lambda a, x: a + x * x).alias("q")))
    return let(sums, lambda v: (v["n"] >= 4) & (v["n"] * v["q"] - v["s"] * v["s"] >= 16 * v["n"] * v["n"]))


def prose_bonus(text: Column, discourse: Column) -> Column:
    one = lambda c: F.when(c, 0.05).otherwise(0.0)
    return one(text.rlike(U + CONTRACTION)) + one(F.contains(text, F.lit("?"))) + one(discourse) + one(varied_sentences(text))


def full_lines(body: Column) -> Column:
    return F.filter(lines(body), lambda s: ~is_blank(s))


def machine_kind(body: Column, full: Column | None = None) -> Column:
    """``export``, ``log`` or null; ``full`` are the body's full_lines where they are known. JSON is recognised by its parsing as one value, with repeated keys and NaN too."""
    values = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    json = body.rlike(r"(?s)\A[\[{].*[\]}]\z") & F.coalesce(F.size(values) == 1, F.lit(False))
    full = full_lines(body) if full is None else full
    by_lines = let(full, lambda a: F.when(F.size(a) >= 5, F.when(F.size(F.filter(a, lambda s: s.rlike(U + LOG_LINE))) / F.size(a) >= 0.6, "log").when(F.size(F.filter(a, lambda s: F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) >= 3)) / F.size(a) >= 0.8, "export")))
    return F.when(json | body.startswith("BEGIN:VCALENDAR") | F.contains(body, F.lit("\nBEGIN:VEVENT")), "export").otherwise(by_lines)


def line_shares(body: Column, full: Column | None = None) -> Column:
    """struct(money, caps): shares of non-blank lines with an amount, and of short shouted ones; 0 under four lines."""

    def shares(a: Column) -> Column:
        enough = F.size(a) >= 4
        shouted = lambda s: let(F.regexp_replace(s, r"\P{L}", ""), lambda x: (F.length(x) >= 3) & x.rlike(r"\A\p{Lu}+\z")) & (F.length(s) <= 60)
        share = lambda test: F.when(enough, F.size(F.filter(a, test)) / F.size(a)).otherwise(0.0)
        return F.struct(share(lambda s: s.rlike(U + MONEY)).alias("money"), share(lambda s: shouted(strip(s))).alias("caps"))

    return let(full_lines(body) if full is None else full, shares)


def folded(text: Column) -> Column:
    """Lower case, with the letters that patterns without case take for ASCII ones."""
    return F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii"))


def marker_hits(flat: Column, low: Column, patterns: list[str], words: list[str]) -> Column:
    """How many patterns are found in flat; each is tried only where low, the folded text, holds one of its words."""
    hits = []
    for p, some in zip(patterns, words, strict=True):
        held = [F.contains(low, F.lit(w)) for w in some.split("|")]
        hits.append((reduce(or_, held) & flat.rlike(IU + p)).cast("int"))
    return sum(hits[1:], hits[0])


def normal_name(name: Column) -> Column:
    """File stem, camel case and separators opened up, lower case."""
    stem = F.regexp_replace(name, r"(?s)\.[^.]*\z", "")
    return F.lower(strip(F.regexp_replace(F.regexp_replace(stem, r"(?<=[a-z0-9])(?=[A-Z])", " "), rf"[_\-.{WS}]+", " ")))


def score_text(df: DataFrame, text: str = "text", origin: str | None = None) -> DataFrame:
    """df with score, reason and verdict (keep, unsure, drop) of a text column.

    Intermediate columns are removed; null counts as empty. Rules apply in a fixed
    order: empty, too short, machine-made, then a sum of bonuses and penalties.
    """
    body = strip(F.coalesce(F.col(text), F.lit("")))
    out = df.withColumn("_b", body).withColumn("_w", word_signals(F.col("_b")))
    out = out.withColumns({"_n": F.length("_b"), "_prose": prose_bonus(F.col("_b"), F.col("_w.discourse")), "_d": F.when(F.col("_w.n") > 0, F.col("_w.first") / F.col("_w.n")).otherwise(0.0)})
    flat = F.regexp_replace("_b", rf"[{WS}]+", " ")  # collapse of what is stripped
    named = F.coalesce(F.col(origin), F.lit("")) if origin else F.lit("")
    out = out.withColumns({"_f": flat, "_x": full_lines(F.col("_b"))})
    out = out.withColumns({"_m": machine_kind(F.col("_b"), F.col("_x")), "_s": line_shares(F.col("_b"), F.col("_x"))})
    out = out.withColumn("_l", folded(F.col("_f")))
    hits = lambda patterns, words: marker_hits(F.col("_f"), F.col("_l"), patterns, words)
    out = out.withColumns({"_legal": hits(LEGAL, LEGAL_WORDS), "_fin": hits(FINANCIAL, FINANCIAL_WORDS), "_auto": hits(AUTOMATED, AUTOMATED_WORDS)})
    d, prose, short = F.col("_d"), F.col("_prose"), F.col("_n") < SHORT_CHARS
    protected = (d >= 0.025) & (F.col("_w.n") >= 120) & (prose >= 0.10)
    voiceless = short & ~((F.col("_w.first") >= 1) & (F.col("_w.n") >= 10) & ((d >= 0.03) | (prose >= 0.10)))
    some = lambda c, x: F.when(c, x).otherwise(0.0)
    penalty = F.lit(0.20) * F.least(F.col("_legal") + F.col("_fin") + F.col("_auto"), F.lit(4)) + some(normal_name(named).rlike(IU + NAME_DROP), 0.15) + some(F.col("_s.money") >= 0.20, 0.35) + some(F.col("_s.caps") >= 0.30, 0.15)
    out = out.withColumn("_p", penalty * F.greatest(F.lit(0.20), F.least(F.lit(1.0), F.lit(1.0) - d * F.lit(10.0))))
    raw = F.lit(0.45) + F.least(d / F.lit(0.04), F.lit(1.0)) * F.lit(0.30) + prose - F.col("_p") - some(F.col("_n") > LONG_CHARS, 0.20)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    out = out.withColumn("_score", F.when(short, F.least(clamped, F.lit(0.80))).otherwise(clamped))
    s = F.col("_score")
    out = out.withColumn("_v", F.when(s >= KEEP_AT, "keep").when((s < DROP_BELOW) & ~(protected | short), "drop").otherwise("unsure"))
    most = F.greatest("_fin", "_auto", "_legal")
    bucket = F.when(most == 0, F.lit(None)).when(F.col("_fin") == most, "financial").when(F.col("_auto") == most, "automated").otherwise("legal")
    bucket = F.when((F.col("_s.money") >= 0.20) & (bucket.isNull() | (bucket == "legal")), "financial").otherwise(bucket)
    named_reason = F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[bucket], F.lit("does not read like personal writing"))
    reason = (
        F.when(short, "short, but it does sound like you")
        .when((F.col("_v") == "drop") | ((F.col("_v") == "unsure") & (F.col("_p") > 0.15)), named_reason)
        .when(F.col("_n") > LONG_CHARS, "very long, more like a book than a note")
        .when(F.col("_v") == "keep", "sounds like you, first person and conversational")
        .otherwise("some of your voice, but hard to be sure")
    )
    machine = F.col("_m").isNotNull() & ~protected
    pick = lambda empty, brief, made, rest: F.when(F.col("_n") == 0, empty).when(voiceless, brief).when(machine, made).otherwise(rest)
    out = out.withColumns({
        "score": pick(F.lit(0.0), F.lit(0.1), F.lit(0.05), s),
        "reason": pick(F.lit("empty"), F.lit("too short to show a voice"), F.when(F.col("_m") == "log", REASONS["log"]).otherwise(REASONS["export"]), reason),
        "verdict": pick(F.lit("drop"), F.lit("drop"), F.lit("drop"), F.col("_v")),
    })
    return out.drop("_b", "_w", "_n", "_prose", "_d", "_f", "_l", "_m", "_s", "_x", "_legal", "_fin", "_auto", "_p", "_score", "_v")


def score_binary(df: DataFrame, filename: str = "filename", mimetype: str = "mimetype") -> DataFrame:
    """df with score, reason and verdict judged by a file's name and type only."""
    name = normal_name(F.col(filename))
    pdf = F.contains(F.lower(F.coalesce(F.col(mimetype), F.lit(""))), F.lit("pdf")) | F.lower(filename).endswith(".pdf")
    bad, good = name.rlike(IU + NAME_DROP), name.rlike(IU + NAME_KEEP)
    pick = lambda a, b, c, d: F.when(bad, a).when(good, b).when(pdf, c).otherwise(d)
    return df.withColumns({
        "score": pick(F.lit(0.15), F.lit(0.70), F.lit(0.45), F.lit(0.60)),
        "reason": pick(F.lit("the file name looks like a financial or legal document"), F.lit("a photo or scan, probably handwriting or a screenshot"), F.lit("a pdf we cannot check without sending it"), F.lit("an image, probably handwriting or a screenshot")),
        "verdict": pick(F.lit("drop"), F.lit("keep"), F.lit("unsure"), F.lit("keep")),
    })
