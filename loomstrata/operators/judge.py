"""Judges' answers as numbers: calibration of confidences, weighted criterion scores, generated overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_object, without_fence
from ..sources.staging import written

REQUIRED_KEYS = ["overview", "tech_stack", "services", "dependencies"]


def confidence(rows: DataFrame, keys: list[str], logprobs: str = "logprobs") -> DataFrame:
    """The geometric mean of token probabilities, from an array of their logarithms; null without tokens."""
    each = rows.select(*keys, F.explode_outer(logprobs).alias("lp"))
    return each.groupBy(*keys).agg(F.exp(F.avg("lp")).alias("confidence"))


#: Newton steps between two writes of the fits, and in all. A group is done when the gradient, a sample, is below NIL.
STEPS, MOST_STEPS, NIL = 4, 100, 1e-11


def platt(counts: DataFrame, by: list[str], conf: str = "confidence", right: str = "right", wrong: str = "wrong") -> DataFrame:
    """(by, a, b) of 1 / (1 + exp(a s + b)) by maximum likelihood for every group at once; both null with under four
    samples or one class only. counts: for each distinct confidence of a group the number of right and wrong samples.

    Each Newton step is one aggregation of gradient, second derivatives and loss by group, which Spark combines before it
    shuffles; groups that are done don't take part in further ones. A step that raised the loss is halved. Where confidence
    parts the classes without fail there is no maximum: a and b are those at which the mean loss fell below 1e-7."""
    table = written(
        counts.select(*by, F.col(conf).cast("double").alias("_s"), F.col(right).cast("double").alias("_r"), F.col(wrong).cast("double").alias("_w")),
        "counts",
    )
    sizes = table.groupBy(*by).agg(F.sum("_r").alias("_right"), F.sum("_w").alias("_wrong"))
    fits = F.col("_right") + F.col("_wrong") >= 4
    able = fits & (F.col("_right") > 0) & (F.col("_wrong") > 0)
    zero = F.lit(0.0)
    state = written(
        sizes.select(
            *by,
            (F.col("_right") + F.col("_wrong")).alias("_n"),
            able.alias("able"),
            (~able).alias("done"),
            zero.alias("a"),
            zero.alias("b"),
            zero.alias("a0"),
            zero.alias("b0"),
            F.lit(None).cast("double").alias("loss0"),
        ),
        "fits",
    )
    ended = []
    for _ in range(MOST_STEPS // STEPS):
        for _ in range(STEPS):
            state = _newton(state, table, by)
        state = written(state, "fits")
        ended.append(state.filter("done"))
        state = state.filter("not done")
        if state.isEmpty():
            break
    every = reduce(DataFrame.unionByName, [*ended, state])
    return every.select(*by, F.when(F.col("able"), F.col("a")).alias("a"), F.when(F.col("able"), F.col("b")).alias("b"))


STATE = ("_n", "able", "done", "a", "b", "a0", "b0", "loss0")


def _newton(state: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """The fits one step on: from (a0, b0), the last accepted place with loss0, to (a, b), which is judged now."""
    names = {c: f"_of{i}" for i, c in enumerate(by)}
    same = F.lit(True)
    for c, to in names.items():
        same &= F.col(c).eqNullSafe(F.col(to))
    z = F.col("a") * F.col("_s") + F.col("b")
    up = lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))  # noqa: E731  log(1 + exp(x))
    miss = 1 / (1 + F.exp(-z))
    n = F.col("_r") + F.col("_w")
    slope, bend = n * miss - F.col("_w"), n * miss * (1 - miss)
    s = F.col("_s")
    sums = {"loss": F.col("_r") * up(z) + F.col("_w") * up(-z), "ga": s * slope, "gb": slope, "haa": s * s * bend, "hab": s * bend, "hbb": bend}
    each = table.join(state.withColumnsRenamed(names), same)
    rows = each.groupBy(*by).agg(*(F.any_value(c).alias(c) for c in STATE), *(F.sum(x).alias(f"_{c}") for c, x in sums.items()))
    worse = F.coalesce(F.col("_loss") > F.col("loss0") * (1 + 1e-14), F.lit(False))
    det = F.col("_haa") * F.col("_hbb") - F.col("_hab") ** 2
    both = det > 1e-13 * F.col("_haa") * F.col("_hbb")
    da = F.when(both, (F.col("_hbb") * F.col("_ga") - F.col("_hab") * F.col("_gb")) / det).otherwise(0.0)
    db = F.when(both, (F.col("_haa") * F.col("_gb") - F.col("_hab") * F.col("_ga")) / det).otherwise(F.coalesce(F.try_divide(F.col("_gb"), F.col("_hbb")), F.lit(0.0)))
    flat = (F.greatest(F.abs("_ga"), F.abs("_gb")) <= NIL * F.col("_n")) | (F.col("_loss") <= 1e-7 * F.col("_n"))
    still = F.abs(F.col("a") - F.col("a0")) + F.abs(F.col("b") - F.col("b0")) < 1e-13
    ends = F.col("done") | (~worse & flat) | (worse & still)
    moved = {"a": (F.col("a") - da, (F.col("a") + F.col("a0")) / 2), "b": (F.col("b") - db, (F.col("b") + F.col("b0")) / 2)}
    new = {c: F.when(ends, F.col(c)).when(worse, back).otherwise(on) for c, (on, back) in moved.items()}
    kept = {c0: F.when(ends | worse, F.col(c0)).otherwise(F.col(c)) for c, c0 in (("a", "a0"), ("b", "b0"), ("_loss", "loss0"))}
    return rows.select(*by, "_n", "able", ends.alias("done"), *(x.alias(c) for c, x in (new | kept).items()))


def calibration(rows: DataFrame, by: list[str], conf: str = "confidence", correct: str = "correct", bins: int = 5) -> DataFrame:
    """By group: Platt's a and b, and over calibrated probabilities the Brier score, its skill against the base rate and
    the expected calibration error in equal bins. All of it works on the numbers of samples by distinct confidence; where
    nothing can be fitted, confidences are used as they are and a and b are null."""
    use = rows.filter(F.col(conf).isNotNull() & F.col(correct).isNotNull()).select(*by, F.col(conf).cast("double").alias("_c"), F.col(correct).cast("int").alias("_y"))
    counts = written(use.groupBy(*by, "_c").agg(F.sum("_y").alias("_right"), F.sum(1 - F.col("_y")).alias("_wrong")), "confidences")
    return calibration_at(counts, platt(counts, by, "_c", "_right", "_wrong"), by, bins)


def calibration_at(counts: DataFrame, fitted: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """calibration() of counts (by, _c, _right, _wrong) at given (by, a, b)."""
    names = {c: f"_of{i}" for i, c in enumerate(by)}
    same = F.lit(True)
    for c, to in names.items():
        same &= F.col(c).eqNullSafe(F.col(to))
    p = F.when(F.col("a").isNull(), F.col("_c")).otherwise(1 / (1 + F.exp(F.col("a") * F.col("_c") + F.col("b"))))
    each = counts.join(fitted.withColumnsRenamed(names), same).withColumn("_p", F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))
    n, square = F.col("_right") + F.col("_wrong"), F.col("_right") * (1 - F.col("_p")) ** 2 + F.col("_wrong") * F.col("_p") ** 2
    binned = each.withColumn("_bin", F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1))).groupBy(*by, "a", "b", "_bin")
    binned = binned.agg(F.sum(n).alias("_n"), F.sum(F.col("_p") * n).alias("_ps"), F.sum("_right").alias("_ys"), F.sum(square).alias("_sq"))
    total = F.sum("_n")
    ece = F.sum(F.abs(F.col("_ps") - F.col("_ys"))) / total
    out = binned.groupBy(*by, "a", "b").agg(total.alias("n"), (F.sum("_sq") / total).alias("brier"), ece.alias("ece"), (F.sum("_ys") / total).alias("base_rate"))
    return out.withColumn("skill", 1 - F.try_divide(F.col("brier"), F.col("base_rate") * (1 - F.col("base_rate"))))


def weighted_digit(tokens: Column) -> Column:
    """The expected score at the first token that is a digit 1 to 5, its alternatives weighted by probability. tokens: an
    array of (token, logprob, top array of (token, logprob)); null without such a token."""
    digit = lambda t: F.rlike(F.trim(t), F.lit("^[1-5]$"))
    first = F.try_element_at(F.filter(tokens, lambda x: digit(x["token"])), F.lit(1))
    own = F.trim(first["token"])
    others = F.filter(F.transform(F.coalesce(
        first["top"],
        F.array().cast("array<struct<token:string,logprob:double>>"),
    ), lambda x: F.struct(F.trim(x["token"]).alias("token"), x["logprob"].alias("logprob"))), lambda x: digit(x["token"]) & x["logprob"].isNotNull())
    seen = F.when(F.exists(others, lambda x: x["token"] == own), others).otherwise(F.array_append(
        others,
        F.struct(own.alias("token"), F.coalesce(first["logprob"], F.lit(0.0)).alias("logprob")),
    ))
    total = F.aggregate(seen, F.lit(0.0), lambda a, x: a + F.exp(x["logprob"]))
    return F.when(first.isNotNull(), F.aggregate(seen, F.lit(0.0), lambda a, x: a + F.exp(x["logprob"]) * x["token"].cast("double")) / total)


def criterion_score(rows: DataFrame, tokens: str = "tokens", samples: str = "samples") -> DataFrame:
    """rows with score and method: weighted by log probabilities, else the mean digit of sampled answers, else unparsed."""
    digits = F.filter(F.transform(samples, lambda s: F.regexp_extract(s, r"(?i)Score:\s*([1-5])", 1)), lambda d: d != "")
    mean = F.try_divide(F.aggregate(digits, F.lit(0.0), lambda a, d: a + d.cast("double")), F.size(digits))
    weighted = weighted_digit(F.col(tokens))
    method = F.when(weighted.isNotNull(), "logprob_weighted").when(F.size(digits) > 0, "sample_averaged").otherwise("unparsed")
    return rows.withColumn("score", F.coalesce(weighted, mean, F.lit(0.0))).withColumn("method", method)


def mean_criterion(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over criteria that were parsed; null if none was."""
    return scored.groupBy(*keys).agg(F.avg(F.when(F.col("method") != "unparsed", F.col("score"))).alias("quality"))


def valid_summary(raw: Column) -> Column:
    """Whether the answer, out of its code fence, is an object with all required keys."""
    keys = F.json_object_keys(without_fence(raw))
    return F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, REQUIRED_KEYS)))) == len(REQUIRED_KEYS), F.lit(False))


def overview(raw: Column) -> Column:
    """The overview of a summary object, else the raw text."""
    got = F.get_json_object(json_object(raw), "$.overview")
    return F.coalesce(F.when(F.trim(got) != "", got), raw)
