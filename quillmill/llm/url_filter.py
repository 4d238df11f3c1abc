"""URL filters: host and path rules, and gradient-boosted trees on lexical features, all native.

Labelled URLs are reduced to counts per vector of binned features before anything
is fitted, and every level of a tree is one aggregate of gradient sums per node,
feature and bin; the driver sees only those sums. The fitted trees are one
conditional expression. Hosts fall in folds by hash: the suffix statistic of a URL
that is learnt from comes from the other folds, and one fold is held out to choose
the probability from which the trees block, so that the precision there is met.
Where no labels are given, what the pages themselves show labels their URLs.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, ascii_lower

#: Trees, levels, shrinkage, ridge; bins of a feature; buckets of host suffixes.
TREES, DEPTH, RATE, RIDGE, BINS, BUCKETS = 10, 3, 0.4, 1.0, 16, 4096
#: Folds of labelled URLs, of which the last is held out; the precision on it that blocking must meet; steps of probability.
FOLDS, PRECISION, GRAIN = 5, 0.9, 1000
#: Signs of an unwanted page in its body: shares of repeated blocks, of text in links, of marks, and characters of a text that is hardly one. A page with EVIDENCE signs is labelled 1, others 0.
REPEATED, LINKED, MARKED, SCANT, EVIDENCE = 0.25, 0.5, 0.02, 200, 2
#: Characters of a block that counts, blocks from which on repetition is looked at, and the marks.
BLOCK_CHARS, FEW_BLOCKS, MARKS = 20, 4, "!$%&*#|"
#: How many pages a rule's verdict on a URL weighs.
RULE_WEIGHT = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; empty without ``://``."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_verdict(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; null if none.

    A rule is ``host/path-start``; it fits its host and all subdomains.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, start = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def entropy(s: Column) -> Column:
    """Bits per character."""
    n = F.length(s)
    letters = F.array_distinct(F.split(s, ""))
    shares = F.transform(F.filter(letters, lambda c: c != ""), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, share: acc - share * F.log2(share))
    return F.when(n > 0, bits).otherwise(0.0)


def suffix_bucket() -> Column:
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(BUCKETS)).cast("int")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def body_shown(html: Column) -> Column:
    """Struct of signs, those in the body itself, and body, a hash of its text; null for a null body."""

    def told(bare: Column, blocks: Column, text: Column) -> Column:
        linked = F.length(F.array_join(F.regexp_extract_all(bare, F.lit(r"(?is)<a\b[^>]*>([^<]*)</a>"), 1), ""))
        n = F.greatest(F.length(text), F.lit(1))
        repeated = (F.size(blocks) >= FEW_BLOCKS) & (F.size(F.array_distinct(blocks)) <= (1 - REPEATED) * F.size(blocks))
        marked = F.length(text) - F.length(F.translate(text, MARKS, "")) >= MARKED * n
        signs = repeated.cast("int") + (linked >= LINKED * n).cast("int") + marked.cast("int") + (F.length(text) < SCANT).cast("int")
        return F.struct(F.when(html.isNotNull(), signs).alias("signs"), F.when(F.length(text) > 0, F.xxhash64(text)).alias("body"))

    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    blocks = lambda bare: F.filter(F.transform(F.split(F.regexp_replace(bare, r"<[^>]*>", "\n"), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= BLOCK_CHARS)
    return once(bare, lambda bare: once(blocks(bare), lambda found: once(F.array_join(found, " "), lambda text: told(bare, found, text))))


def body_signs(html: Column) -> tuple[Column, Column]:
    """(signs in the body itself, hash of its text); null for a null body."""
    shown = body_shown(html)
    return shown["signs"], shown["body"]


def evidence(rows: DataFrame) -> DataFrame:
    """rows (host, signs, body) with label: 1 for EVIDENCE signs or more, of which a body that several hosts show is one; null without a body."""
    shown = rows.where("body is not null").groupBy("body").agg((F.min("host") < F.max("host")).cast("int").alias("copied"))
    return rows.join(shown, "body", "left").withColumn("label", (F.col("signs") + F.coalesce("copied", F.lit(0)) >= EVIDENCE).cast("int")).drop("copied")


def binned(url: Column) -> list[Column]:
    """Lexical features as bins 0..BINS-1 (columns host and path are there)."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    digits = n - F.greatest(F.length(F.translate(u, "0123456789", "")), F.lit(0))
    count = lambda s, c: F.length(s) - F.length(F.translate(s, c, ""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    params = F.when(F.length(query) > 0, 1 + count(query, "&")).otherwise(0)
    raw = [F.length(u) / 8, count(F.col("path"), "/"), digits / n * BINS, entropy(u) * 3, params, F.length("host") / 3, count(F.col("host"), "."), count(u, "_~%@"), count(F.col("host"), "-0123456789")]
    return [F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(x))).cast("int") for x in raw]


def split_gain(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def tree_column(tree: dict) -> Column:
    """A fitted tree as an expression over f0.. ."""
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.col(f"f{tree['feature']}") <= tree["bin"], tree_column(tree["left"])).otherwise(tree_column(tree["right"]))


def node_column(tree: dict, at: int = 1) -> Column:
    """The number of the leaf that a row falls in (root 1, children 2n and 2n+1)."""
    if "feature" not in tree:
        return F.lit(at)
    return F.when(F.col(f"f{tree['feature']}") <= tree["bin"], node_column(tree["left"], 2 * at)).otherwise(node_column(tree["right"], 2 * at + 1))


def fit_trees(counts: DataFrame, features: int) -> tuple[float, list[dict]]:
    """Boosted trees from counts: columns f0.., n rows, y of them blocked. Returns (base margin, trees)."""
    total = counts.agg(F.sum("n"), F.sum("y")).first()
    n, y = float(total[0] or 0), float(total[1] or 0)
    base = math.log((y + 1) / (n - y + 1))
    trees: list[dict] = []
    margin = F.lit(base)
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("b")) for i in range(features))))
    for _ in range(TREES if 0 < y < n else 0):
        tree: dict = {}
        leaves = {1: tree}
        p = 1 / (1 + F.exp(-margin))
        for level in range(DEPTH):
            rows = counts.select(node_column(tree).alias("node"), (F.col("n") * p - F.col("y")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), cells.alias("c"))
            sums: dict = {}
            for r in rows.groupBy("node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x BINS
                sums.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            fresh = {}
            for at, leaf in leaves.items():
                per = sums.get(at)
                if not per:
                    leaf["value"] = 0.0
                    continue
                g_all, h_all = (sum(per[0][b][k] for b in sorted(per[0])) for k in (0, 1))
                best = (1e-6, None, None, None)
                for f in sorted(per):
                    g = h = 0.0
                    for b in sorted(per[f])[:-1]:
                        g, h = g + per[f][b][0], h + per[f][b][1]
                        gain = round(split_gain(g, h) + split_gain(g_all - g, h_all - h) - split_gain(g_all, h_all), 9)
                        if gain > best[0]:
                            best = (gain, f, b, (g, h))
                value = lambda g, h: -RATE * g / (h + RIDGE)
                if best[1] is None:
                    leaf["value"] = value(g_all, h_all)
                    continue
                g, h = best[3]
                leaf |= {"feature": best[1], "bin": best[2], "left": {}, "right": {}}
                fresh |= {2 * at: leaf["left"], 2 * at + 1: leaf["right"]}
                if level == DEPTH - 1:
                    leaf["left"]["value"], leaf["right"]["value"] = value(g, h), value(g_all - g, h_all - h)
            leaves = fresh
            if not leaves:
                break
        trees.append(tree)
        margin = margin + tree_column(tree)
    return base, trees


def suffix_share(counts: DataFrame, prior: float, own: str | None = None) -> DataFrame:
    """(bucket, share): the smoothed share of labelled 1 per suffix bucket, BUCKETS rows at most; with ``own`` a share per bucket and fold, from the other folds."""
    per = counts.groupBy("bucket", "fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    every = per.groupBy("bucket").agg(F.sum("n").alias("all_n"), F.sum("y").alias("all_y"))
    binned_share = lambda y, n: F.least(F.lit(BINS - 1), F.floor((y + 5 * F.lit(prior)) / (n + 5) * BINS)).cast("int").alias("share")
    if own is None:
        return every.select("bucket", binned_share(F.col("all_y"), F.col("all_n")))
    return per.join(F.broadcast(every), "bucket").select("bucket", "fold", binned_share(F.col("all_y") - F.col("y"), F.col("all_n") - F.col("n")))  # BUCKETS rows


def surely(y: int, n: int, z: float = 1.645) -> float:
    """The lower end of Wilson's interval for a share of y in n, so that a few lucky rows prove nothing."""
    p = y / n if n else 0.0
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) if n else 0.0


def threshold(rows: list[tuple[int, int, int]], precision: float = PRECISION) -> tuple[float, float, float, float]:
    """(probability, area under the ROC curve, precision, recall) from (GRAIN-th of probability, rows, rows labelled 1).

    The probability is the least one from which on the share of rows labelled 1 is
    surely (see :func:`surely`) at least ``precision``; 2, which nothing reaches,
    where there is none.
    """
    n = y = area = 0
    found, met, at_y = 2.0, 1.0, 0
    for at, m, k in sorted(rows, reverse=True):
        area += (m - k) * (y + k / 2)
        n, y = n + m, y + k
        if surely(y, n) >= precision:
            found, met, at_y = at / GRAIN, y / n, y
    return found, area / (y * (n - y)) if 0 < y < n else 0.5, met, at_y / y if y else 0.0


def fit_filter(known: DataFrame, lexical: list[str], scratch: Scratch) -> dict:
    """The model from labelled rows (bucket, fold, label, weight, held, lexical features): base margin, trees, prior, suffix table, threshold, and the area, precision and recall on held-out hosts.

    Rows that are not ``held`` never enter the held-out figures.
    """
    counts = scratch.stash(known.groupBy("bucket", "fold", "held", *lexical).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("y")))
    learn, last = counts.where(F.col("fold") < FOLDS - 1), f"f{len(lexical)}"
    prior = float(learn.agg((F.sum("y") + 1) / (F.sum("n") + 2)).first()[0] or 0.5)
    out_of_fold = scratch.stash(suffix_share(learn, prior, "fold"))
    suffix = scratch.stash(suffix_share(learn, prior))
    rows = learn.join(F.broadcast(out_of_fold), ["bucket", "fold"]).withColumnRenamed("share", last)
    base, trees = fit_trees(scratch.stash(rows.groupBy(*lexical, last).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))), len(lexical) + 1)
    model = {"base": base, "trees": trees, "prior": prior, "suffix": suffix, "last": last}
    held = probability(counts.where((F.col("fold") == FOLDS - 1) & F.col("held")), model)
    grains = held.groupBy(F.floor(F.col("probability") * GRAIN).cast("int").alias("at")).agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()  # GRAIN + 1 rows at most
    model["block"], model["area"], model["precision"], model["recall"] = threshold([(r["at"], r["n"], r["y"]) for r in grains])
    return model


def probability(rows: DataFrame, model: dict) -> DataFrame:
    """rows (bucket and lexical features) with probability."""
    margin = F.lit(model["base"])
    for t in model["trees"]:
        margin = margin + tree_column(t)
    prior = F.lit(min(BINS - 1, int(model["prior"] * BINS)))
    out = rows.join(F.broadcast(model["suffix"]), "bucket", "left").withColumn(model["last"], F.coalesce("share", prior))  # BUCKETS rows
    return out.withColumn("probability", 1 / (1 + F.exp(-margin))).drop("share", model["last"])


def with_features(df: DataFrame, url: str, keep: list[Column]) -> DataFrame:
    out = df.select(*keep, F.col(url).cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    out = out.withColumns({"host": host, "path": path})
    more = {f"f{i}": c for i, c in enumerate(binned(F.col("__url")))}
    return out.withColumns(more | {"bucket": suffix_bucket(), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")}).drop("__url")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labels: DataFrame | None = None) -> DataFrame:
    """``id_col``, host, path, rule, verdict, probability of every URL.

    ``rules`` is a list of (``host/path-start``, ``block`` or ``allow``); the longest that
    fits decides. Elsewhere the trees decide from the URL alone. They learn from ``labels`` (url,
    label 1 = block) if given, else from what pages show: the signs of an unwanted
    body (see :func:`evidence`), and the rules' verdicts with a weight of RULE_WEIGHT.
    Folds are dealt by host. The trees block from the least probability whose
    precision on the pages of held-out hosts is PRECISION; where none has it, bodies
    say nothing of URLs, only rules block, and a warning says so. Null bodies give
    no label; without the body column only rules do. Null URLs and
    those without ``://`` have an empty host and path and are judged by their other
    features. Repeated rows give repeated results, an empty table an empty result.
    """
    with Scratch(pages.sparkSession) as scratch:
        rule, verdict = rule_verdict(rules)
        shown = body_shown(F.col(html_col).cast("string")) if html_col in pages.columns and labels is None else F.lit(None).cast("struct<signs: int, body: bigint>")
        # written as one struct, so that a body is looked at once
        rows = scratch.stash(with_features(pages, url_col, [F.col(id_col).alias("id"), shown.alias("shown")]).withColumns({"rule": rule, "ruled": verdict}))
        rows = rows.withColumns({"signs": F.col("shown.signs"), "body": F.col("shown.body")}).drop("shown")
        lexical = [c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]
        if labels is None:
            shown = evidence(rows).where("label is not null").withColumns({"weight": F.lit(1), "held": F.lit(True)})
            told = rows.where("ruled is not null").withColumns({"label": (F.col("ruled") == "block").cast("int"), "weight": F.lit(RULE_WEIGHT), "held": F.lit(False)})
            known = shown.unionByName(told)
        else:
            known = with_features(labels, "url", [F.col("label").cast("int").alias("label")]).withColumns({"weight": F.lit(1), "held": F.lit(True)})
        model = fit_filter(known, lexical, scratch)
        if model["block"] > 1:
            warnings.warn(f"no probability has a precision of {PRECISION} on held-out hosts (area under the curve {model['area']:.2f}): only rules block", stacklevel=2)
        out = probability(rows, model)
        judged = F.coalesce("ruled", F.when(F.col("probability") >= model["block"], "block").otherwise("allow"))
        return scratch.finish(out.select(F.col("id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), "probability"))
