"""Quality rules: robust multivariate outliers per language and source, in DataFrame operations only.

Text statistics are computed inside each row. A minimum-covariance-determinant
estimate per group takes concentration steps (mean and covariance of the rows
nearest to the centre, then new distances) from several starts: medians with
absolute deviations, mean with covariance, and medians with one spread for all.
After two steps the start of the least determinant goes on until no group's
determinant falls any more. All of it is aggregates per group; parameters, a row a
group, are broadcast where their count allows and else joined by salted keys, so
rows are never dealt out by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, sized

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Share of a group's rows in the core; steps from each start; rows that a group needs for estimates of its own.
CORE, FIRST_STEPS, LEAST_ROWS = 0.75, 2, 200
#: A determinant that falls by less than this share (of medians that are approximate to a thousandth) has converged; steps after which a group that swings within such shares stops.
SETTLED, MOST_STEPS = 0.01, 30
#: Groups whose parameters may be broadcast (30 numbers each, 12 MB in all); salts of the join otherwise.
BROADCAST_GROUPS, SALTS = 50_000, 64
#: Rows that the estimates from all rows need.
LEAST_ALL = 20
#: Least standard deviation of each transformed statistic: differences below it count as none.
FLOORS = (0.25, 0.08, 0.15, 0.15, 0.15)
#: Median of chi-squared with five degrees of freedom, and the squared distance (in its scale) that rejects: about three
#: times its 0.999 quantile of 20.515, as text statistics have longer tails than normal ones.
CHI_MEDIAN, CUTOFF = 4.351460191095526, 60.0
P = len(FLOORS)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(a: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the word array.

    Windows are compared by 64-bit hashes. Sorted by hash, equal ones are neighbours;
    their places, sorted again, cover min(3, distance to the last place) new words each.
    """
    windows = F.when(F.size(a) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(a, i + 1), F.get(a, i + 2))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = let(placed, lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))))
        places = F.sort_array(F.transform(same, lambda x: x["p"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def text_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: none)."""
    t = F.coalesce(text, F.lit(""))
    both = let(words(t), lambda a: F.struct(F.size(a).cast("long").alias("n"), repeated_words(a).alias("r")))
    return {
        "both": both,
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(F.filter(F.split(t, "\n"), lambda s: F.length(F.translate(s, SPACES, "")) > 0), lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")),
    }


def vector() -> list[Column]:
    """Transformed statistics of a row with words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.asin(F.sqrt(F.least(F.lit(1.0), c)))
    return [F.log1p(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share(F.col("n_symbols") / n), share(10 * F.col("n_dup_lines") / n), share(F.col("n_repeat_words") / n)]


X = [f"x{i}" for i in range(P)]


def pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def factored(params: DataFrame) -> DataFrame:
    """params with c_i_j replaced by the lower Cholesky factor l_i_j; floors are added to the diagonal."""
    for i, j in sorted(pairs(), key=lambda p: (p[1], p[0])):
        rest = F.col(f"c_{i}_{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return params.drop(*(f"c_{i}_{j}" for i, j in pairs()))


def by_group(rows: DataFrame, params: DataFrame, most: int = BROADCAST_GROUPS) -> DataFrame:
    """rows with their group's parameters; rows are not dealt out by group."""
    if params.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(params), "g")
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"]).drop("salt")


def with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d of each row under its group's parameters."""
    out = by_group(rows, params)
    for i in range(P):
        z = F.col(f"x{i}") - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l_{i}_{i}"))
    d = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))
    return out.withColumn("d", d).drop(*(f"z{i}" for i in range(P)), *(f"m_{i}" for i in range(P)), *(f"l_{i}_{j}" for i, j in pairs()))


def start_params(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Parameters of each group's starts; g is then a struct of the group and the start's number."""
    mid = scratch.stash(rows.groupBy("g").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(X)), *(F.avg(x).alias(f"a_{i}") for i, x in enumerate(X)), *(F.covar_pop(X[i], X[j]).alias(f"v_{i}_{j}") for i, j in pairs())))
    centre = mid.select("g", *(f"m_{i}" for i in range(P)))
    away = by_group(rows, centre).groupBy("g").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"s_{i}") for i, x in enumerate(X)))
    both = scratch.stash(mid.join(away, "g"))
    diagonal = lambda f: [(f(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs()]
    medians = [F.col(f"m_{i}") for i in range(P)]
    starts = [(medians, diagonal(lambda i: F.pow(1.4826 * F.col(f"s_{i}"), 2))), ([F.col(f"a_{i}").alias(f"m_{i}") for i in range(P)], [F.col(f"v_{i}_{j}").alias(f"c_{i}_{j}") for i, j in pairs()]), (medians, diagonal(lambda i: F.lit(0.1)))]
    out = None
    for n, (m, c) in enumerate(starts):
        one = both.select(F.struct("g", F.lit(n).alias("start")).alias("g"), *m, *c)
        out = one if out is None else out.unionByName(one)
    return factored(out)


def concentrated(rows: DataFrame, params: DataFrame, scratch: Scratch) -> DataFrame:
    """One concentration step."""
    far = with_distance(rows, params)
    reach = scratch.stash(far.groupBy("g").agg(F.percentile_approx("d", CORE, 1000).alias("q")))
    near = by_group(far, reach).where("d <= q")
    moments = near.groupBy("g").agg(*(F.avg(x).alias(f"m_{i}") for i, x in enumerate(X)), *(F.covar_pop(X[i], X[j]).alias(f"c_{i}_{j}") for i, j in pairs()))
    return scratch.stash(factored(moments))


def log_determinant() -> Column:
    return sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, P)), F.log(F.col("l_0_0"))) * 2


def least_determinants(fit: DataFrame, scratch: Scratch) -> DataFrame:
    """Each group's minimum-covariance-determinant parameters."""
    several = scratch.stash(fit.select(F.explode(F.array(*(F.struct("g", F.lit(n).alias("start")) for n in range(3)))).alias("g"), *X))
    params = scratch.stash(start_params(fit, scratch))
    for _ in range(FIRST_STEPS):
        params = concentrated(several, params, scratch)
    numbers = [c for c in params.columns if c != "g"]
    params = scratch.stash(params.groupBy("g.g").agg(F.min(F.struct(log_determinant().alias("size"), F.col("g.start").alias("start"), *numbers)).alias("p")).select("g", *(f"p.{c}" for c in numbers)))
    for _ in range(MOST_STEPS):
        after = concentrated(fit, params, scratch)
        falls = params.select("g", log_determinant().alias("was")).join(after.select("g", log_determinant().alias("now")), "g").agg(F.max(F.col("was") - F.col("now"))).first()[0]
        params = after
        if falls is None or falls < SETTLED:
            break
    return params


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: under 50 words, or more than half of the words in repeated 3-word
    windows. Other rows are kept unless their distance (squared, scaled so that the
    group's median is chi-squared's) exceeds CUTOFF. Groups are language and source
    (null is a value of its own); those with under LEAST_ROWS rows are pooled by
    language, then all together, and if there are still fewer they are judged by
    estimates from all rows that pass base_failed (with under LEAST_ALL such rows
    nothing is rejected). A null text has no words. Repeated rows give repeated results, an empty
    table an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        s = text_statistics(F.col(text_col))
        name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
        stats = docs.select(F.col(id_col).alias("id"), name(lang_col).alias("lang"), name(source_col).alias("source"), *(c.alias(k) for k, c in s.items()))
        stats = stats.select("id", "lang", "source", F.col("both.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("both.r").alias("n_repeat_words"))
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        stats = scratch.stash(stats.withColumn("base_failed", failed))
        good = stats.where("not base_failed")
        sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
        langs = sizes.where(F.col("n") < LEAST_ROWS).groupBy("lang").agg(F.sum("n").alias("pooled"))
        group = F.when(F.col("n") >= LEAST_ROWS, F.concat_ws("\x01", "lang", "source")).when(F.col("pooled") >= LEAST_ROWS, F.col("lang")).otherwise(F.lit(""))
        groups = scratch.stash(sizes.join(langs, "lang", "left").select("lang", "source", "n", group.alias("g")))
        last = groups.where("g = ''").agg(F.sum("n").alias("n")).first()["n"] or 0
        rows = stats.join(sized(groups.drop("n"), BROADCAST_GROUPS), ["lang", "source"], "left").withColumn("g", F.when(~F.col("base_failed"), F.col("g")))
        rows = scratch.stash(rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "g", *(x.alias(f"x{i}") for i, x in enumerate(vector()))))
        fit = rows.where("g is not null").select("g", *X)
        if 0 < last < LEAST_ROWS:
            fit = fit.where("g <> ''").union(fit.withColumn("g", F.lit("")))
        params = least_determinants(scratch.stash(fit), scratch)
        scale = scratch.stash(with_distance(fit, params).groupBy("g").agg((F.percentile_approx("d", 0.5, 1000) / CHI_MEDIAN).alias("scale"), F.count("*").alias("members")))
        far = by_group(with_distance(rows.where("g is not null"), params), scale)
        distance = F.when(F.col("members") >= LEAST_ALL, F.col("d") / F.greatest("scale", F.lit(1e-9))).otherwise(F.lit(0.0))
        cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        judged = far.select("id", *cols, distance.alias("distance"))
        out = judged.unionByName(rows.where("g is null").select("id", *cols, F.lit(None).cast("double").alias("distance")))
        return scratch.finish(out.select(F.col("id").alias(id_col), *cols, (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"), "distance"))
