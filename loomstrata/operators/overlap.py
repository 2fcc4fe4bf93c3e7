"""Overlap of generated texts with references in columns: BLEU-4, ROUGE-L, METEOR.

A row has both texts, so it is scored where it is: nothing but the caller's rows is sent, whatever the number of tokens.
Tokens of both sides are sorted as one array, where equal ones are runs, first those of the text, then those of the reference.
A hit of an n-gram is the lesser of two neighbouring runs' lengths. METEOR pairs the k-th last occurrences of a token in such
runs, and its chunks are neighbours in that alignment. The longest common subsequence is a fold over bit vectors: a row of the
textbook table has a bit for each token of the reference, and a token of the text changes all of them by one addition.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.overlap import stem
from ..sources.staging import written

# BLEU's longest n-gram, the constant of its smoothing (method 4 of Chen and Cherry, 2014), METEOR's weights.
GRAMS, SMOOTH = 4, 5
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
#: Bits of a limb of the vectors: sums of two limbs and a carry stay within a long.
LIMB = 62
FULL = (1 << LIMB) - 1


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda words: None if words is None else [stem(w) for w in words])


def words(text: Column) -> Column:
    """What stands between blanks of any kind."""
    return F.filter(F.split(text, r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; words of over three letters are stemmed."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.zip_with(found, stems(found), lambda w, s: F.when(F.length(w) > 3, s).otherwise(w))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sides(rows: DataFrame, keys: list[str], text: str, reference: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(keys, h, r): tokens of both sides, of rows that have both texts."""
    use = rows.filter(F.col(text).isNotNull() & F.col(reference).isNotNull())
    return use.select(*keys, tokens(F.col(text)).alias("h"), tokens(F.col(reference)).alias("r"))


def _tagged(tokens: Column, side: int) -> Column:
    return F.transform(tokens, lambda w, i: F.struct(w.alias("key"), F.lit(side).alias("side"), i.alias("at")))


def _runs(tokens: Column) -> Column:
    """(key, begin, end) of each run of one key and side in sorted (key, side, ...)."""
    first = lambda x: (x["begin"] == 0) | (x["key"] != F.get(tokens, x["begin"] - 1)["key"]) | (x["side"] != F.get(tokens, x["begin"] - 1)["side"])
    heads = F.filter(F.transform(tokens, lambda x, k: F.struct(x["key"].alias("key"), x["side"].alias("side"), k.alias("begin"))), first)
    ended = lambda h: F.transform(h, lambda x, k: F.struct(
        x["key"].alias("key"),
        x["begin"].alias("begin"),
        F.coalesce(F.get(h, k + 1)["begin"], F.size(tokens)).alias("end"),
    ))
    return _let(heads, ended)


def _shared(runs: Column) -> Column:
    """(a, b, end) of each key that both sides have: where its runs begin and end."""
    both = F.transform(runs, lambda x, k: F.struct(
        x["begin"].alias("a"),
        x["end"].alias("b"),
        F.when(F.get(runs, k + 1)["key"] == x["key"], F.get(runs, k + 1)["end"]).alias("end"),
    ))
    return F.filter(both, lambda x: x["end"].isNotNull())


def _fewer(x: Column) -> Column:
    return F.least(x["b"] - x["a"], x["end"] - x["b"])


def clipped_counts(h: Column, r: Column) -> Column:
    """For n up to GRAMS: n-grams of h that r has as often."""
    def grams(c: Column, n: int) -> Column:
        each = F.transform(c, lambda w, i: F.when(i <= F.size(c) - n, F.concat_ws(" ", *(F.get(c, i + k) for k in range(n)))))
        return F.filter(each, lambda g: g.isNotNull())

    def count(h: Column, r: Column, n: int) -> Column:
        tokens = F.sort_array(F.concat(_tagged(grams(h, n), 0), _tagged(grams(r, n), 1)))
        shared = _let(tokens, lambda t: _let(_runs(t), _shared))
        return F.aggregate(shared, F.lit(0).cast("long"), lambda a, x: a + _fewer(x))

    return _let(h, lambda h: _let(r, lambda r: F.array(*(count(h, r, n) for n in range(1, GRAMS + 1)))))


def bleu_score(hits: Column, nh: Column, nr: Column) -> Column:
    """Sentence BLEU to 4-grams by clipped_counts() and numbers of tokens; n-grams without a hit are smoothed, and a text
    without any hit has 0."""
    logs, missed = F.lit(0.0), F.lit(0)
    for n in range(1, GRAMS + 1):
        found, total = F.get(hits, F.lit(n - 1)), F.greatest(nh - n + 1, F.lit(1))
        missed = missed + (found == 0).cast("int")
        smoothed = F.when(nh > 1, 1 / (F.pow(F.lit(2.0), missed) * SMOOTH / F.log(nh.cast("double"))) / total)
        logs = logs + F.coalesce(F.log(F.when(found > 0, found / total).otherwise(smoothed)), F.lit(0.0)) / GRAMS
    brevity = F.when(nh > nr, 1.0).otherwise(F.exp(1 - nr / nh))
    return F.when((nh > 0) & (nr > 0) & (F.get(hits, F.lit(0)) > 0), brevity * F.exp(logs)).otherwise(0.0)


def bleu4(sides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bleu4)."""
    counted = sides.select(*keys, clipped_counts(F.col("h"), F.col("r")).alias("hits"), F.size("h").alias("nh"), F.size("r").alias("nr"))
    return counted.select(*keys, bleu_score(F.col("hits"), F.col("nh"), F.col("nr")).alias("bleu4"))


def common_length(h: Column, r: Column) -> Column:
    """The length of the longest common subsequence (bit vectors of Hyyrö, 2004)."""
    def step(row: Column, mask: Column) -> Column:
        def limb(state: Column, k: Column) -> Column:
            v, m = F.get(row, k), F.get(mask, k)
            total = v + v.bitwiseAND(m) + state["carry"]
            new = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(F.lit(FULL))
            return F.struct(F.shiftright(total, LIMB).alias("carry"), F.array_append(state["out"], new).alias("out"))

        none = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), none, limb)["out"]

    def folded(tokens: Column, shared: Column, nr: Column) -> Column:
        last = F.floor((nr - 1) / LIMB).cast("int")
        limbs = F.sequence(F.lit(0), last)
        # the places of one token, a long for each limb
        places = lambda x: F.transform(F.sequence(x["b"], x["end"] - 1), lambda t: F.get(tokens, t)["at"])
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at % LIMB)
        mask = lambda x: _let(places(x), lambda ps: F.transform(limbs, lambda k: F.aggregate(
            F.filter(ps, lambda at: F.floor(at / LIMB) == k),
            F.lit(0).cast("long"),
            lambda a, at: a.bitwiseOR(bit(at)),
        )))
        read = lambda x: _let(mask(x), lambda m: F.transform(F.sequence(x["a"], x["b"] - 1), lambda t: F.struct(F.get(tokens, t)["at"].alias("at"), m.alias("mask"))))
        steps = F.sort_array(F.flatten(F.transform(shared, read)))
        begin = F.transform(limbs, lambda k: F.when(k < last, F.lit(FULL)).otherwise(F.call_function("shiftright", F.lit((1 << 63) - 1), 63 - (nr - LIMB * last))))
        # zero bits of the reference's places are the length; bits above them are cut off
        ones = lambda end, start: F.aggregate(F.zip_with(end, start, lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda a, b: a + b)
        return _let(begin, lambda start: nr - ones(F.aggregate(steps, start, lambda row, x: step(row, x["mask"])), start))

    both = F.concat(_tagged(h, 0), _tagged(r, 1))
    found = lambda tokens: _let(_let(_runs(tokens), _shared), lambda shared: F.when(F.size(shared) > 0, folded(tokens, shared, F.aggregate(tokens, F.lit(0), lambda n, x: n + x["side"]))).otherwise(0))
    return _let(F.sort_array(both), found)


def rouge_score(h: Column, r: Column) -> Column:
    """The F-measure of the longest common subsequence."""
    return _let(h, lambda h: _let(r, lambda r: F.coalesce(F.try_divide(2 * common_length(h, r), F.size(h) + F.size(r)), F.lit(0.0))))


def rouge_l(sides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rouge_l)."""
    return sides.select(*keys, rouge_score(F.col("h"), F.col("r")).alias("rouge_l"))


def _matched(tokens: Column) -> Column:
    """pairs, and left, the others: the k-th last tokens of one key on both sides, for every k. tokens: (key, side, at, ...),
    at grows to the front. A pair is a long, the place in the text above the place in the reference."""
    def pairs(tokens: Column, runs: Column) -> Column:
        pair = lambda x, t: F.get(tokens, x["a"] + t)["at"] * F.lit(-(1 << 32)) - F.get(tokens, x["b"] + t)["at"]
        return F.flatten(F.transform(_shared(runs), lambda x: F.transform(F.sequence(F.lit(0), _fewer(x) - 1), lambda t: pair(x, t))))

    def left(tokens: Column, runs: Column) -> Column:
        size = lambda x: x["end"] - x["begin"]

        def rest(x: Column, k: Column) -> Column:
            before, after = F.get(runs, k - 1), F.get(runs, k + 1)
            used = F.when(after["key"] == x["key"], F.least(size(x), size(after))).when(before["key"] == x["key"], F.least(size(x), size(before))).otherwise(0)
            free = lambda n: F.filter(F.sequence(x["begin"], x["end"] - 1), lambda t: t >= x["begin"] + n)
            return F.transform(_let(used, free), lambda t: F.get(tokens, t))

        return F.flatten(F.transform(runs, rest))

    return _let(F.sort_array(tokens), lambda t: _let(_runs(t), lambda runs: F.struct(pairs(t, runs).alias("pairs"), left(t, runs).alias("left"))))


def alignment(h: Column, r: Column, h_stems: Column | None = None, r_stems: Column | None = None) -> Column:
    """pairs of METEOR's matches, and left, the others (key, side, at, w, s): equal words and, with stems, of what is left
    equal stems."""
    def side(words: Column, stems: Column, n: int) -> Column:
        return F.zip_with(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), stems, lambda x, s: F.struct(
            x["w"].alias("key"),
            F.lit(n).alias("side"),
            (-x["i"]).alias("at"),
            x["w"].alias("w"),
            s.alias("s"),
        ))

    words = _matched(F.concat(side(h, h if h_stems is None else h_stems, 0), side(r, r if r_stems is None else r_stems, 1)))
    if h_stems is None:
        return words
    by_stem = lambda x: F.struct(x["s"].alias("key"), x["side"].alias("side"), x["at"].alias("at"), x["w"].alias("w"), x["s"].alias("s"))
    both = lambda a, b: F.struct(F.concat(a["pairs"], b["pairs"]).alias("pairs"), b["left"].alias("left"))
    return _let(words, lambda a: _let(_matched(F.transform(a["left"], by_stem)), lambda b: both(a, b)))


def chunk_counts(pairs: Column) -> Column:
    """(matched, chunks) of an alignment: its matches, and the runs of them that are neighbours on both sides."""
    following = lambda p: F.size(F.array_intersect(p, F.transform(p, lambda x: x + F.lit((1 << 32) + 1))))
    return _let(pairs, lambda p: F.struct(F.size(p).cast("long").alias("matched"), (F.size(p) - following(p)).cast("long").alias("chunks")))


def _by_sense(left: DataFrame, keys: list[str], senses: dict[str, set[str]]) -> DataFrame:
    """(keys, more): matches of what is left, from the end, of words that are equal or share a sense."""
    def shared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free, found = sorted(zip(b["at"], b["w"]), reverse=True), []
        for i, w in sorted(zip(a["at"], a["w"]), reverse=True):
            at = next((k for k, (_, x) in enumerate(free) if w == x or senses.get(w, set()) & senses.get(x, set())), None)
            if at is not None:
                found.append((i << 32) + free.pop(at)[0])
        own = {c: pd.Series([a[c].iloc[0]] * len(found) if len(a) else [], dtype=object) for c in keys}
        return pd.DataFrame(own | {"pair": pd.Series(found, dtype="int64")})

    words = written(left.select(*keys, F.explode("left").alias("x")).select(*keys, "x.side", (-F.col("x.at")).cast("long").alias("at"), "x.w"), "left")
    schema = "".join(f"`{c}` {left.schema[c].dataType.simpleString()}, " for c in keys) + "pair long"
    grouped = lambda side: words.filter(F.col("side") == side).drop("side").groupBy(*keys)
    return grouped(0).cogroup(grouped(1)).applyInPandas(shared, schema).groupBy(*keys).agg(F.collect_list("pair").alias("more"))


def meteor(sides: DataFrame, keys: list[str], senses: dict[str, set[str]] | None = None) -> DataFrame:
    """(keys, meteor), from sides in lower case. Words that share a sense match where senses of words are given."""
    numbers = [F.size("h").alias("nh"), F.size("r").alias("nr")]
    rows = sides.select(*keys, *numbers, alignment(F.col("h"), F.col("r"), stems(F.col("h")), stems(F.col("r"))).alias("m"))
    if senses:
        rows = written(rows.select(*keys, "nh", "nr", "m.*"), "aligned")
        rows = rows.join(_by_sense(rows, keys, senses), keys, "left")
        rows = rows.select(*keys, "nh", "nr", F.struct(F.concat("pairs", F.coalesce("more", F.array().cast("array<long>"))).alias("pairs")).alias("m"))
    return rows.select(*keys, "nh", "nr", chunk_counts(F.col("m")["pairs"]).alias("m")).select(*keys, meteor_score(F.col("m"), F.col("nh"), F.col("nr")).alias("meteor"))


def meteor_score(found: Column, nh: Column, nr: Column) -> Column:
    """METEOR by chunk_counts() and numbers of tokens."""
    p, q = found["matched"] / nh, found["matched"] / nr
    score = p * q / (ALPHA * p + (1 - ALPHA) * q) * (1 - GAMMA * F.pow(found["chunks"] / found["matched"], F.lit(BETA)))
    return F.when(found["matched"] > 0, score).otherwise(0.0)


def overlap_scores(rows: DataFrame, keys: list[str], text: str, reference: str, senses: dict[str, set[str]] | None = None) -> DataFrame:
    """(keys, bleu4, rouge_l, meteor) of every row; keys, which name a row, are not null. Scores are null where a text is,
    and 0 where one has no words. BLEU takes words as they are, METEOR in lower case, ROUGE-L runs of letters and digits."""
    own = {c: f"_key{k}" for k, c in enumerate(keys)}
    use, named = rows.select(*(F.col(c).alias(to) for c, to in own.items()), F.col(text).alias("_text"), F.col(reference).alias("_reference")), [*own.values()]
    if senses:
        use = written(use, "texts")
    both = F.col("_text").isNotNull() & F.col("_reference").isNotNull()
    sides = {"": words, "_plain": plain_words, "_low": lambda t: words(F.lower(t))}
    split = use.select(*named, both.alias("_both"), *(f(F.col(c)).alias(c + kind) for kind, f in sides.items() for c in ("_text", "_reference")))
    h, r = F.col("_text_low"), F.col("_reference_low")
    scored = split.select(
        *named,
        "_both",
        F.size("_text").alias("nh"),
        F.size("_reference").alias("nr"),
        clipped_counts(F.col("_text"), F.col("_reference")).alias("hits"),
        rouge_score(F.col("_text_plain"), F.col("_reference_plain")).alias("rouge_l"),
        F.size(h).alias("low_h"),
        F.size(r).alias("low_r"),
        *([] if senses else [chunk_counts(alignment(h, r, stems(h), stems(r))["pairs"]).alias("m")]),
    )
    parts = {"bleu4": bleu_score(F.col("hits"), F.col("nh"), F.col("nr")), "rouge_l": F.col("rouge_l")}
    if not senses:
        parts["meteor"] = meteor_score(F.col("m"), F.col("low_h"), F.col("low_r"))
    out = scored.select(*named, *(F.when(F.col("_both"), x).alias(c) for c, x in parts.items()))
    if senses:
        out = out.join(meteor(_sides(use, named, "_text", "_reference", sides["_low"]), named, senses), named, "left")
    return out.withColumnsRenamed({to: c for c, to in own.items()})
