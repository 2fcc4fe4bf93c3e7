"""Summaries, paired and rank statistics, resampling and agreement measures over result rows, mostly as plain aggregates
and windows; only p-values and quantiles come from numpy, on one row a test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from ..sources.staging import written


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """The two-sided 95 % point of Student's t."""
    return df.map(lambda n: special.t_quantile(0.975, int(n)) if n and n > 0 else None)


def cell_summary(rows: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """n, mean, sample deviation and the 95 % interval of a metric by group. Null metrics are skipped; a group of one has
    deviation 0 and its mean as both ends. The interval isn't clipped."""
    cells = rows.filter(F.col(metric).isNotNull()).groupBy(*[F.col(c).cast("string").alias(c) for c in by]).agg(
        F.count("*").alias("n"),
        F.avg(metric).alias("mean"),
        F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"),
    )
    half = F.when(F.col("n") > 1, t_critical(F.col("n") - 1) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return cells.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def efficiency(rows: DataFrame, score: str, tokens: str, per: int = 1000) -> DataFrame:
    """rows with `efficiency`: score for each `per` tokens; null without tokens."""
    return rows.withColumn("efficiency", F.when(F.col(tokens) > 0, F.col(score) * per / F.col(tokens)))


def category_coverage(rows: DataFrame, totals: str, missing: str) -> DataFrame:
    """Coverage by fact category from JSON columns: {category: facts} and [missing facts]. Rows with broken JSON are
    skipped, missing facts of categories without totals ignored, a total of 0 is covered in full."""
    parsed = rows.select(F.from_json(totals, "map<string,bigint>").alias("t"), F.from_json(missing, "array<string>").alias("m")).filter("t is not null and m is not null")
    named = parsed.withColumn("lost", F.transform("m", lambda f: F.substring_index(f, ":", 1)))
    each = named.select(F.explode("t").alias("category", "total"), "lost").withColumn("lost", F.size(F.filter("lost", lambda x: x == F.col("category"))))
    out = each.groupBy("category").agg(F.sum("total").alias("total"), F.sum("lost").cast("long").alias("missing"), F.count("*").alias("rows"))
    return out.withColumn("coverage", F.when(F.col("total") > 0, (F.col("total") - F.col("missing")) / F.col("total")).otherwise(1.0))


def smaller(counts: DataFrame, value: str, by: list[str], m: str = "_m", to: str = "_before") -> DataFrame:
    """counts, rows with a number m for each value of a group, with the sum of m over the group's smaller values.

    No window has a whole group: rows are dealt to tasks by ranges of (group, value), and written with the number of their
    range; sums run within a range of a group, and over a group's ranges by another window, of a row a range."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(counts.repartitionByRange(n, *by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_{i}_of_range" for i, c in enumerate(by)}
    over = Window.partitionBy(*(names.values() if by else [F.lit(0)])).orderBy("_range_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*(F.col(c).alias(n) for c, n in names.items()), F.col("_range").alias("_range_of")).agg(F.sum(m).alias("_all"))
    below = sums.withColumn("_below", F.coalesce(F.sum("_all").over(over), F.lit(0))).drop("_all")
    same = F.col("_range") == F.col("_range_of")
    for c, n in names.items():
        same &= F.col(c).eqNullSafe(F.col(n))
    out = rows.withColumn(to, F.coalesce(F.sum(m).over(within), F.lit(0))).join(below, same)
    return out.withColumn(to, F.col(to) + F.col("_below")).drop("_range", "_range_of", "_below", *names.values())


def signed_ranks(diffs: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """By group: n pairs, mean difference, non-zero pairs, W+, W-, the matched-pairs rank-biserial correlation and the tie
    sum (of t**3 - t over equal magnitudes). Average ranks come from counts by magnitude."""
    counts = diffs.filter(F.col(d) != 0).groupBy(*by, F.abs(d).alias("_v")).agg(F.count_if(F.col(d) > 0).alias("_p"), F.count("*").alias("_m"))
    ranked = smaller(counts, "_v", by).withColumn("_r", F.col("_before") + (F.col("_m") + 1) / 2)
    ties = F.sum(F.col("_m").cast("double") * F.col("_m") * F.col("_m") - F.col("_m"))
    w = ranked.groupBy(*by).agg(
        F.sum("_m").alias("n_nonzero"),
        F.sum(F.col("_r") * F.col("_p")).alias("w_plus"),
        F.sum(F.col("_r") * (F.col("_m") - F.col("_p"))).alias("w_minus"),
        ties.alias("tie_sum"),
    )
    out = diffs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg(d).alias("mean_diff")).join(w, by, "left").fillna(0, ["n_nonzero"]).fillna(0.0, ["w_plus", "w_minus", "tie_sum"])
    return out.withColumn("rank_biserial", F.when(F.col("n_nonzero") > 0, (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus"))))


def level_pairs(rows: DataFrame, metric: str, factor: str, unit: list[str], fixed: list[str]) -> DataFrame:
    """(fixed, a, b, unit, d): differences between all pairs of levels a < b of a factor, within units. The join is by
    unit, where a level has one row (the largest metric), so it makes levels squared rows a unit and no more."""
    each = rows.filter(F.col(metric).isNotNull()).groupBy(*fixed, *unit, factor).agg(F.max(metric).alias("v"))
    left, right = each.withColumnsRenamed({factor: "a", "v": "x"}), each.withColumnsRenamed({factor: "b", "v": "y"})
    return left.join(right, [*fixed, *unit]).filter("a < b").withColumn("d", F.col("x") - F.col("y"))


def paired_tests(diffs: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """signed_ranks() with the two-sided p of the signed-rank test and a note where there is none. The p needs a group's
    sums only: it is exact where up to 50 differences have neither zeros nor ties, else normal."""

    @F.pandas_udf("double")
    def p_of(pairs: pd.Series, kept: pd.Series, plus: pd.Series, minus: pd.Series, ties: pd.Series) -> pd.Series:
        each = zip(pairs, kept, plus, minus, ties)
        return pd.Series([special.signed_rank_p(int(k), min(a, b), t, int(n) == int(k)) if n >= 2 else None for n, k, a, b, t in each], dtype="float64")

    out = signed_ranks(diffs, by, d).withColumn("p_value", p_of("n_pairs", "n_nonzero", "w_plus", "w_minus", "tie_sum"))
    return out.withColumn("note", F.when(F.col("n_pairs") < 2, "fewer than two pairs").when(F.col("n_nonzero") == 0, "all differences are zero"))


def graph_diff(actual: DataFrame, expected: DataFrame, by: list[str], item: str = "item") -> DataFrame:
    """Precision, recall and F1 of sets of items by group; two empty sets agree in full. Missing and extra are sorted."""
    a = actual.select(*by, item).distinct().withColumn("_a", F.lit(True))
    e = expected.select(*by, item).distinct().withColumn("_e", F.lit(True))
    both = a.join(e, [*by, item], "full_outer")
    out = both.groupBy(*by).agg(
        F.count_if("_a").alias("n_actual"),
        F.count_if("_e").alias("n_expected"),
        F.count_if(F.col("_a") & F.col("_e")).alias("n_common"),
        F.array_sort(F.collect_list(F.when(F.col("_a").isNull(), F.col(item)))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("_e").isNull(), F.col(item)))).alias("extra"),
    )
    p, r = F.coalesce(F.try_divide("n_common", "n_actual"), F.lit(0.0)), F.coalesce(F.try_divide("n_common", "n_expected"), F.lit(0.0))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1",
        F.coalesce(F.try_divide(2 * F.col("n_common"), F.col("n_actual") + F.col("n_expected")), F.lit(1.0)),
    )


def diagram_f1(diffs: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """(by, one F1 for each of diffs, overall_f1) from graph_diff() of each kind of a diagram's parts: nodes, edges,
    endpoints. A kind that a group lacks on both sides agrees in full; the overall F1 is the mean of the rounded ones."""
    out, names = None, [f"{kind}_f1" for kind in diffs]
    for name, d in zip(names, diffs.values()):
        part = d.select(*by, F.round("f1", 4).alias(name))
        out = part if out is None else out.join(part, by, "full_outer")
    out = out.fillna(1.0, names)
    return out.withColumn("overall_f1", F.round(sum((F.col(n) for n in names), F.lit(0.0)) / len(names), 4))


def diagram_report(scores: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """cell_summary() of several score columns at once: a row for each field and group."""
    long = scores.select(
        *by,
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))).alias("x"),
    ).select(*by, "x.*")
    return cell_summary(long, "value", ["field", *by])


def holm(tests: DataFrame, p: str = "p_value", family: list[str] | None = None) -> DataFrame:
    """tests with `p_holm`: step-down Bonferroni within a family, a running maximum capped at 1. Null p-values stay null."""
    known = F.col(p).isNotNull()
    by = Window.partitionBy(*(family or [F.lit(0)]), known)
    order = by.orderBy(p)
    scaled = (F.count("*").over(by) - F.row_number().over(order) + 1) * F.col(p)
    rows = tests.withColumn("_s", F.when(known, F.least(scaled, F.lit(1.0))))
    return rows.withColumn("p_holm", F.when(known, F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks over rows with both values; null where one of them has a single value. Rows are counted
    by pair of values first."""
    by = by or []
    use = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_m"))
    return rho_of_counts(written(use, "pairs"), x, y, by)


def rho_of_counts(use: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho): spearman() of distinct pairs (by, x, y) with their number _m, a table."""
    ranked = use
    for c, to in ((x, "_rx"), (y, "_ry")):
        counts = use.groupBy(*by, c).agg(F.sum("_m").alias("_m"))
        ranks = smaller(counts, c, by).select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate([*by, c])], (F.col("_before") + (F.col("_m") + 1) / 2).alias(to))
        same = F.lit(True)
        for i, k in enumerate([*by, c]):
            same &= F.col(k).eqNullSafe(F.col(f"_of{i}"))
        ranked = ranked.join(ranks, same).drop(*(f"_of{i}" for i in range(len(by) + 1)))
    part = lambda a, b: F.sum("_m") * F.sum(F.col("_m") * F.col(a) * F.col(b)) - F.sum(F.col("_m") * F.col(a)) * F.sum(F.col("_m") * F.col(b))
    rho = F.try_divide(part("_rx", "_ry"), F.sqrt(part("_rx", "_rx")) * F.sqrt(part("_ry", "_ry")))
    return ranked.groupBy(*by).agg(F.sum("_m").alias("n"), rho.alias("rho"))


def kendall(rows: DataFrame, x: str, y: str, key: str, by: list[str]) -> DataFrame:
    """Tau-b within groups of two rows or more, by counts: no two rows are paired. Ranks of y are compared by their
    highest differing bit, so a row is read once for each bit of its group's highest rank."""
    use = rows.dropna(subset=[x, y, *by]).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_m"))
    values = smaller(use.select(*by, "_y").distinct().withColumn("_one", F.lit(1)), "_y", by, "_one", "_r").select(*by, "_y", F.col("_r").cast("long").alias("_r"))
    highest = values.groupBy(*by).agg(F.length(F.bin(F.max("_r"))).alias("_bits"))
    ranked = use.join(values, [*by, "_y"]).join(highest, by)
    bits = ranked.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    bit, head = F.expr("shiftright(_r, _b) & 1"), F.expr("shiftright(_r, _b + 1)")
    counts = bits.groupBy(*by, "_b", head.alias("_head"), "_x").agg(
        F.sum(F.when(bit == 0, F.col("_m")).otherwise(0)).alias("_low"),
        F.sum(F.when(bit == 1, F.col("_m")).otherwise(0)).alias("_high"),
    )
    part = [*by, "_b", "_head"]
    lows = counts.groupBy(*part).agg(F.sum("_low").alias("_lows"))
    scored = smaller(counts, "_x", part, "_low").join(lows, part).withColumn("_s", F.col("_high") * (2 * F.col("_before") + F.col("_low") - F.col("_lows")))
    score = scored.groupBy(*by).agg(F.sum("_s").cast("double").alias("score"))

    def unequal(c: str, to: str) -> DataFrame:
        n = use.groupBy(*by, c).agg(F.sum("_m").alias("_m"))
        pairs = F.floor((F.sum("_m") * F.sum("_m") - F.sum(F.col("_m") * F.col("_m"))) / 2)
        return n.groupBy(*by).agg(pairs.cast("long").alias(to), F.sum("_m").alias("_n"))

    c = score.join(unequal("_x", "nx"), by).join(unequal("_y", "ny").drop("_n"), by).filter("_n > 1").drop("_n")
    return c.withColumn("tau", F.try_divide(F.col("score"), F.sqrt(F.col("nx")) * F.sqrt(F.col("ny"))))


def mann_whitney(rows: DataFrame, value: str, first: Column, by: list[str] | None = None) -> DataFrame:
    """By group: sizes, U of the rows where `first` holds, the tie sum and the two-sided normal p. Works on counts by
    value, so a value in many rows is one row."""
    by = by or []
    use = rows.filter(F.col(value).isNotNull() & first.isNotNull()).withColumn("_f", first)
    counts = use.groupBy(*by, value).agg(F.count_if("_f").alias("_n1"), F.count("*").alias("_m"))
    ranks = smaller(counts, value, by).withColumn("_r", F.col("_before") + (F.col("_m") + 1) / 2)
    out = ranks.groupBy(*by).agg(
        F.sum("_n1").alias("n1"),
        F.sum(F.col("_m") - F.col("_n1")).alias("n2"),
        F.sum(F.col("_r") * F.col("_n1")).alias("rank_sum"),
        F.sum(F.col("_m").cast("double") * F.col("_m") * F.col("_m") - F.col("_m")).alias("tie_sum"),
    )

    @F.pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([special.mann_whitney_p(*x) for x in zip(u, n1, n2, ties)], dtype="float64")

    out = out.withColumn("u", F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2)
    return out.withColumn("p_value", p("u", "n1", "n2", "tie_sum"))


def confusion(rows: DataFrame, truth: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, sensitivity, specificity and balanced accuracy; null where a denominator is 0."""
    use = rows.withColumn("_t", truth).withColumn("_s", said).filter("_t is not null and _s is not null")
    counts = {"tp": "_t and _s", "fn": "_t and not _s", "fp": "not _t and _s", "tn": "not _t and not _s"}
    out = use.groupBy(*(by or [])).agg(*(F.count_if(F.expr(e)).alias(n) for n, e in counts.items()))
    out = out.withColumn(
        "sensitivity",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
    ).withColumn("specificity", F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")))
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def agreement(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, rho) for each two score columns."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            part = spearman(rows, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "rho")
            out = part if out is None else out.unionByName(part)
    return out


def judge_acceptance(rows: DataFrame, score: str, by: list[str], distinct: int = 15, share: float = 0.60) -> DataFrame:
    """Distinct scores, the share at 1.0 and whether the judge tells texts apart."""
    out = rows.filter(F.col(score).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_distinct(score).alias("distinct_scores"),
        F.avg((F.col(score) == 1.0).cast("int")).alias("share_at_one"),
    )
    return out.withColumn("accepted", (F.col("distinct_scores") > distinct) & (F.col("share_at_one") < share))


def pivot_means(rows: DataFrame, row: str, column: str, levels: list, value: str) -> DataFrame:
    """Means by row and level, with the mean of the row's cells."""
    out = rows.groupBy(row).pivot(column, levels).agg(F.avg(value))
    cells = F.filter(F.array(*(F.col(f"`{c}`") for c in levels)), lambda x: x.isNotNull())
    return out.withColumn("row_mean", F.try_divide(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), F.size(cells)))


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n")).withColumn("low", F.col("bin") * width)


def best_levels(rows: DataFrame, level: str, value: str, by: list[str], highest: bool = True) -> DataFrame:
    """Means by level with a flag at the best (all of equal best mean)."""
    means = rows.filter(F.col(value).isNotNull()).groupBy(*by, level).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    top = (F.max if highest else F.min)("mean").over(Window.partitionBy(*(by or [F.lit(0)])))
    return means.withColumn("best", F.col("mean") == top)


def hash_sample(rows: DataFrame, key: list[str], n: int, seed: int = 11) -> DataFrame:
    """n rows in the order of a hash of their key: the same ones in every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
