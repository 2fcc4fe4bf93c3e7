"""N-gram Jaccard self-join with several global token orders, and its components.

Texts become sets of distinct word shingles; texts of one set are one class. Two sets of Jaccard similarity t or more
share a token of their prefixes under *any* order of all tokens, a set's prefix being its first n - ceil(t n) + 1 tokens.
Three orders are used, and a pair has to pass all of them:

1. by hash, over the whole corpus, to find classes that can have a partner at all. Prefixes longer by k tokens must share
   k of them, so a class whose prefix meets others in fewer tokens goes;
2. by document frequency among those, rarest first, which generates the candidates. A token that one class has alone
   takes up prefix and generates nothing;
3. by a second hash. Each class carries its prefix under it as 256 bits, and where those of two have none in common no
   pair is formed; sets are only fetched for pairs that both orders leave, and only compared if the prefixes do meet.

A large group of near copies has about as many links as pairs. Its component is found without them: in each posting
list all classes are compared with one of them, the pivot, and a pair is formed only if its classes are in different
components after that and could be similar, given how far each is from the pivot: with D(x) the symmetric difference of
x and the pivot and u(x) the tokens that x has alone, x and y differ in |D(y)| - |D(x)| + 2 u(x) tokens or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, only_ids, restored, shielded, shuffle_partitions, spread, staged, tidy
from .components import components
from .shingles import chunks, mix, set_keys, shingle_sets

#: Text bytes for each bucket of the first order; a bucket's postings are in one task, seven bytes each.
BUCKET_BYTES = 16 << 20
#: Rows of a posting list that one task pairs with others, about.
SALT_ROWS = 2000
#: A class has to share this part of its size, besides one token, in the first order.
SHARE = Fraction(1, 4)


def _least_shared(n: np.ndarray, t: Fraction) -> np.ndarray:
    return -(-n * t.numerator // t.denominator)


def _extra(n: np.ndarray) -> np.ndarray:
    return 1 + n * SHARE.numerator // SHARE.denominator


def _third(tokens: np.ndarray, t: Fraction) -> np.ndarray:
    """A set's prefix under the third order."""
    n = len(tokens)
    return np.sort(mix(tokens))[: n - -(-n * t.numerator // t.denominator) + 1]


def _bits(prefix: np.ndarray) -> list[int]:
    """A prefix as 256 bits, in four longs."""
    on = np.zeros(256, np.uint8)
    on[(mix(prefix) >> np.uint64(56)).astype(np.int64)] = 1
    return np.packbits(on).view(np.int64).tolist()


def _meet(a: str, b: str):
    """Whether the bits of two third prefixes do; without, the prefixes have no token in common."""
    some = F.lit(0).cast("long")
    for k in range(4):
        some = some.bitwiseOR(F.col(f"{a}.b{k}").bitwiseAND(F.col(f"{b}.b{k}")))
    return some != 0


def _signatures(rows: DataFrame, k: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for i, j in chunks(texts):
                values, at = shingle_sets(texts[i:j], k)
                keys = set_keys(values, at)
                yield pd.DataFrame({"id": b["id"].iloc[i:j], "no_id": b["no_id"].iloc[i:j], "n": np.diff(at), "cls": [r.tobytes() for r in keys], "cls8": keys[:, 0].view(np.int64)})

    return restored(shielded(rows).mapInPandas(tidy(each), "id long, no_id boolean, n long, cls binary, cls8 long"), "id")


def _may_match(rows: DataFrame, k: int, t: Fraction, buckets: int) -> DataFrame:
    """(cls8): first halves of the keys of all classes that pass the first order, and of few others.

    A task sends each bucket of tokens the postings of its classes as packed arrays. A token that two of its classes have
    is known there to be shared and is sent once, whatever the classes, so a frequent token is one posting a batch.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        size = 0
        for b in batches:
            for x in b["text"]:
                held.append(x)
                size += len(x)
                if size >= 4 << 20 or len(held) == 50_000:  # 16 bits number a batch's classes
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def packed(texts: list[str]) -> pd.DataFrame:
        sets = [shingle_sets(texts[i:j], k) for i, j in chunks(texts)]
        keys = np.concatenate([set_keys(v, at)[:, 0] for v, at in sets])
        n = np.concatenate([np.diff(at) for _, at in sets])
        begin = np.concatenate([at[:-1] + base for (_, at), base in zip(sets, np.cumsum([0] + [len(v) for v, _ in sets]))])
        values = np.concatenate([v for v, _ in sets])
        _, one = np.unique(keys, return_index=True)  # a class once a batch
        one = one[n[one] > 0]
        keys, n, begin = keys[one], n[one], begin[one]
        take = np.minimum(n, n - _least_shared(n, t) + _extra(n))
        local = np.repeat(np.arange(len(n), dtype=np.uint32), take)
        tokens = values[np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(begin, take)]
        order = np.argsort(tokens, kind="stable")
        tokens, local = tokens[order], local[order]
        same = tokens[1:] == tokens[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(tokens) else np.zeros(0, bool)
        here = np.bincount(local[shared], minlength=len(n)).astype(np.uint32)
        first = np.concatenate([[True], ~same]) if len(tokens) else np.zeros(0, bool)
        tokens, who = tokens[first], np.where(shared[first], 0, local[first] + 1).astype(np.uint32)  # 0: shared
        # a set's smallest values lie low, so buckets are taken from a second hash, whose upper 40 bits are sent
        tokens = mix(tokens)
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        tokens >>= np.uint64(24)
        order = np.lexsort((tokens, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        tokens, who = tokens[order], who[order]
        out = []
        for x in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[x], cuts[x + 1]
            named, to = np.unique(who[a:b], return_inverse=True)
            refs = np.concatenate([np.zeros(1, np.uint64), keys])[named]
            planes = tokens[a:b].view(np.uint8).reshape(-1, 8)[:, 4::-1].T  # sorted, so the first ones compress
            out.append((int(x), b - a, planes.tobytes() + to.astype("<u2").tobytes() + refs.tobytes()))
        home = (mix(keys) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        for x in np.flatnonzero(np.diff(cuts)):
            s = order[cuts[x] : cuts[x + 1]]
            out.append((int(x), 0, keys[s].tobytes() + n[s].astype("<u4").tobytes() + here[s].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "postings", "packed"])

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        tokens, whose, out = [], [], []
        for m, raw in zip(b["postings"].tolist(), b["packed"]):
            if m:
                wide = np.zeros((m, 8), np.uint8)
                wide[:, 4::-1] = np.frombuffer(raw, np.uint8, 5 * m).reshape(5, m).T
                tokens.append(wide.view("<u8").ravel())
                whose.append(np.frombuffer(raw, "<u8", -1, 7 * m)[np.frombuffer(raw, "<u2", m, 5 * m)])
            else:
                m = len(raw) // 16
                out.append(pd.DataFrame({"cls8": np.frombuffer(raw, "<i8", m), "n": np.frombuffer(raw, "<u4", m, 8 * m).astype(np.int64), "shared": np.frombuffer(raw, "<u4", m, 12 * m).astype(np.int64)}))
        if tokens:
            token, who = np.concatenate(tokens), np.concatenate(whose)
            order = np.lexsort((who, token))
            token, who = token[order], who[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1]) | (who[1:] == 0)
            token, who = token[fresh], who[fresh]
            same = token[1:] == token[:-1]
            more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            who, m = np.unique(who[more & (who != 0)], return_counts=True)
            out.append(pd.DataFrame({"cls8": who.view(np.int64), "n": np.zeros(len(who), np.int64), "shared": m.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"cls8": [], "n": [], "shared": []}).astype(np.int64)

    sent = rows.select("text").mapInPandas(tidy(send), "bucket int, postings int, packed binary")
    met = sent.groupBy("bucket").applyInPandas(meet, "cls8 long, n long, shared long")
    counts = met.groupBy("cls8").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"))
    # a partner has at least t n tokens, and shares as many as the shorter of the two longer prefixes asks for
    fewest = f"(n * {t.numerator} + {t.denominator - 1}) div {t.denominator}"
    need = F.expr(f"1 + ({fewest}) * {SHARE.numerator} div {SHARE.denominator}")
    return counts.filter(F.col("shared") >= need).select("cls8")


def _prefixes(sets: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(result, staged table that it reads), the result being (token, id, n, alone): prefixes by document frequency among sets, without tokens that one class has alone, which
    are counted."""
    each = sets.select("id", "n", F.explode("tokens").alias("token"))
    # tables to join with are written first: a join of two plain scans is split by adaptive execution where a key is hot
    often = staged(each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    known = each.join(often, "token").groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("known"))
    least = F.floor((F.col("n") * t.numerator + (t.denominator - 1)) / t.denominator)
    alone = F.col("n") - F.size("known")
    left = (F.col("n") - least + 1 - alone).cast("int")
    out = known.withColumn("left", left).filter("left > 0").select("id", "n", alone.alias("alone"), F.explode(F.slice("known", F.lit(1), F.col("left"))["token"]).alias("token"))
    return out, often


def _compared(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """pairs (u, v) with how many tokens they have in common, null if the third order keeps them from being compared, and
    whether they link: their similarity is t or more."""
    a = sets.select(F.col("id").alias("u"), F.col("tokens").alias("x"))
    b = sets.select(F.col("id").alias("v"), F.col("tokens").alias("y"))
    num, den = t.numerator, t.denominator

    @F.pandas_udf("common long, link boolean")
    def compare(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(xs, ys):
            x, y = (np.asarray(z, np.int64).view(np.uint64) for z in (x, y))
            if not len(np.intersect1d(_third(x, t), _third(y, t), assume_unique=True)):
                out.append((None, False))
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append((common, den * common >= num * (len(x) + len(y) - common)))
        return pd.DataFrame({"common": pd.array([c for c, _ in out], dtype="Int64"), "link": [bool(k) for _, k in out]})

    return pairs.join(a, "u").join(b, "v").select("u", "v", compare("x", "y").alias("c")).select("u", "v", "c.*")


def _sized(t: Fraction):
    return F.least("n1", "n2") * t.denominator >= F.greatest("n1", "n2") * t.numerator


def _one_of_each_list(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result, staged table that it reads): prefixes without the tokens that one class has alone, and with one token for each posting list (tokens that the
    same classes have generate the same pairs)."""
    lists = prefixes.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64(F.lit("other"), "id")).alias("s2")).filter("m > 1")
    one = staged(lists.groupBy("m", "s1", "s2").agg(F.min("token").alias("token")).select("token"), "list_tokens")
    return prefixes.join(one, "token", "left_semi"), one


def links(prefixes: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """(u, v): links, such that every two sets of similarity t or more are in one component of them."""
    one, tokens = _one_of_each_list(prefixes)
    prefixes = staged(one.join(sets.select("id", "third"), "id"), "posting_lists")
    discard(tokens)
    pivot = prefixes.groupBy("token").agg(F.min_by(F.struct(F.col("id").alias("u"), F.col("n").alias("n1"), F.col("third").alias("t1")), F.struct("alone", "id")).alias("p")).select("token", "p.*")
    lists = prefixes.select("token", F.col("id").alias("v"), F.col("n").alias("n2"), F.col("alone").alias("a2"), F.col("third").alias("t2")).join(pivots := staged(pivot, "pivots"), "token")
    first = staged(_compared(pairs := staged(_unique(lists.filter((F.col("u") != F.col("v")) & _meet("t1", "t2")), t), "pivot_pairs"), sets, t), "compared")
    discard(pairs)
    label = components(first.filter("link"))

    # distances to the pivot; null where sizes or the third order kept the two from being compared
    near = first.select(F.col("u").alias("x"), F.col("v").alias("y"), "common")
    far = F.when(F.col("u") == F.col("v"), 0).otherwise(F.col("n1") + F.col("n2") - 2 * F.col("common"))
    placed = lists.join(near, (F.least("u", "v") == F.col("x")) & (F.greatest("u", "v") == F.col("y")), "left").join(label, F.col("v") == F.col("node"), "left")
    # lists of one pivot are one list from here on, so a pair is formed once for a pivot and not for each common token
    placed = staged(placed.select(F.col("u").alias("token"), "v", "n2", "a2", "t2", far.alias("d2"), F.coalesce("root", "v").alias("c2")).distinct(), "placed")
    discard(prefixes, pivots)

    parts = placed.groupBy("token", "c2").agg(F.count("*").alias("m"))
    split = parts.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("c2", F.struct("m", "c2")).alias("largest"), F.ceil(F.sum("m") / SALT_ROWS).cast("int").alias("salts")).filter("parts > 1")
    # the most that a partner in the list allows; a class beyond it has no partner there
    most = placed.groupBy("token").agg(F.max("n2").alias("n_most"), F.max(F.coalesce(F.col("d2") - 2 * F.col("a2"), F.lit(1 << 40))).alias("reach"))
    room = _room(F.col("n2") + F.least(F.col("n_most"), F.floor(F.col("n2") * t.denominator / t.numerator)), t)
    lists = placed.join(heads := staged(split.join(most, "token"), "split_lists"), "token").filter(F.col("d2").isNull() | (F.col("d2") - room <= F.col("reach")))
    salt = F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")
    lists = staged(lists.select("token", "v", "n2", "a2", "t2", "d2", "c2", (F.col("c2") != F.col("largest")).alias("rest2"), "salts", salt.alias("salt")), "open_lists")
    discard(placed, heads)
    # a long list lies in several tasks, and the rows outside its largest component go to each
    rest = lists.filter("rest2").select("token", *(F.col(c).alias(n) for c, n in (("v", "u"), ("n2", "n1"), ("a2", "a1"), ("t2", "t1"), ("d2", "d1"), ("c2", "c1"))), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    gap = F.col("d2") - F.col("d1")
    could = F.coalesce(F.greatest(gap + 2 * F.col("a1"), 2 * F.col("a2") - gap) <= _room(F.col("n1") + F.col("n2"), t), F.lit(True))
    once = (F.col("c1") != F.col("c2")) & (~F.col("rest2") | (F.col("c1") < F.col("c2")))
    pairs = staged(_unique(rest.join(lists, (rest["token"] == lists["token"]) & (rest["salt"] == lists["salt"]) & once & could & _sized(t) & _meet("t1", "t2")), t), "pairs")
    second = staged(_compared(pairs.join(first, ["u", "v"], "left_anti"), sets, t), "compared_rest")
    discard(lists, pairs)
    return first.filter("link").select("u", "v").unionByName(second.filter("link").select("u", "v"))


def _room(sizes, t: Fraction):
    """How many tokens two linked sets, of so many in all, differ in at most."""
    return F.floor(sizes * (t.denominator - t.numerator) / (t.denominator + t.numerator) + 1e-9)


def _unique(pairs: DataFrame, t: Fraction) -> DataFrame:
    return pairs.filter(_sized(t)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, t: Fraction = Fraction(3, 4)) -> DataFrame:
    """For every row of df: id_col (a long), n_shingles, component_id.

    Two texts link when their shingle sets have Jaccard similarity t or more; component_id is the smallest id reachable by
    links, the row's own included. Null and empty texts, and those without words, have no shingles and link with nothing.
    Rows with a null id count as no one's partner by themselves; they get the component of their text's class. Rows that
    repeat an id get a row each. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = staged(_signatures(rows, k).withColumn("run", spread("id")), "signatures")
    # the rows of one id are counted first, so it is known which class has its id, and so its set, more than once
    each = signed.filter("n > 0 and id is not null").groupBy("cls", "cls8", "id").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    classes = staged(each.groupBy("cls", "cls8").agg(F.min(F.struct("id", "n", "times")).alias("x")).select("cls", "cls8", "x.*"), "classes")
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    may = _may_match(rows, k, t, max(shuffle_partitions(spark), math.ceil(total / BUCKET_BYTES)))
    chosen = staged(classes.join(may, "cls8").select("id", "cls", "times"), "chosen")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for i, j in chunks(texts):
                values, at = shingle_sets(texts[i:j], k)
                keys = set_keys(values, at)
                sets = [values[p:q] for p, q in zip(at[:-1], at[1:])]
                third = [dict(zip(("b0", "b1", "b2", "b3"), _bits(_third(s, t)))) for s in sets]
                yield pd.DataFrame({"id": b["id"].iloc[i:j].tolist(), "cls": [r.tobytes() for r in keys], "n": np.diff(at), "third": third, "tokens": [s.view(np.int64) for s in sets]})

    read_again = only_ids(rows, chosen, "id").mapInPandas(tidy(whole), "id long, cls binary, n long, third struct<b0:long,b1:long,b2:long,b3:long>, tokens array<long>")
    sets = staged(read_again.join(chosen, ["id", "cls"]).select("id", "times", "n", "third", "tokens"), "sets")
    if not chosen.filter("times > 1").isEmpty():
        repeated = sets.filter("times > 1").groupBy("id", "times", "n").agg(F.any_value(F.struct("third", "tokens")).alias("x")).select("id", "times", "n", "x.*")
        sets, with_repeats = staged(sets.filter("times = 1").unionByName(repeated), "sets"), sets
        discard(with_repeats)
    prefixes, often = _prefixes(sets, t)
    prefixes = staged(prefixes, "prefixes")
    discard(often)
    roots = components(links(prefixes, sets, t))
    discard(chosen, sets, prefixes)
    found = classes.join(roots, F.col("id") == F.col("node"), "left").select("cls", F.coalesce("root", "id").alias("component"))
    out = attach(signed.select("id", "n", "cls", "run"), found, ["cls"])
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))
