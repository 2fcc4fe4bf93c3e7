"""Which strings of a group lie in others of it, by an inverted index of character n-grams.

A string that lies in another has all its n-grams there, so it is looked up by its rarest one: the gram that the fewest of
the other side's strings have. A gram that none has ends the search at once. Strings shorter than a gram are indexed by grams
of their own length, where equality is containment. Rows are joined on (group, gram), never on the group alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct substrings of n characters; none in a shorter text."""
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _lookups(inner: DataFrame, outer: DataFrame, by: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(by, s, gram) of every inner string whose grams all are in the index, with its rarest; the index (by, t, gram).
    inner: (by, s), outer: (by, t), distinct; strings of fewer than `least` characters lie in nothing."""
    sizes = range(min(least, GRAM), GRAM + 1)
    index = outer.select(*by, "t", F.explode(F.concat(*(grams(F.col("t"), n) for n in sizes))).alias("gram"))
    counts = index.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("s") > GRAM, grams(F.col("s"))).otherwise(F.array("s"))
    each = inner.filter(F.length("s") >= least).select(*by, "s", F.explode(own).alias("gram")).join(counts, [*by, "gram"], "left")
    rarest = each.groupBy(*by, "s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    return rarest.filter("x.n > 0").select(*by, "s", F.col("x.gram").alias("gram")), index


def lying_in(inner: DataFrame, outer: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Distinct (by, s) of inner that lie in some t of the same group of outer. Both are read more than once, so they
    should be tables and not long plans. Nulls and empty strings lie in nothing."""
    rarest, index = _lookups(inner, outer, by, max(1, least))
    short = rarest.filter(F.length("s") <= GRAM).select(*by, "s")
    long = rarest.filter(F.length("s") > GRAM).join(index, [*by, "gram"]).filter(F.contains("t", F.col("s")))
    return short.unionByName(long.select(*by, "s").distinct())


def holding(outer: DataFrame, inner: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Distinct (by, t) of outer in which some s of the same group of inner lies."""
    rarest, index = _lookups(inner, outer, by, max(1, least))
    # of strings that are a gram themselves, one row for each gram is all that is needed
    found = rarest.join(index, [*by, "gram"]).filter((F.length("s") <= GRAM) | F.contains("t", F.col("s")))
    return found.select(*by, "t").distinct()
