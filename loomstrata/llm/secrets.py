"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are found by patterns. A fourth, `owned`, is added by the method: long mixed strings are candidates
everywhere, their hashes are counted by distinct repositories and owners over the whole corpus, and a candidate of one
owner, in however many repositories, or of few owners and few repositories looks live; others are copied examples. Base
spans stay whatever their frequency; they get the same verdict in the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, attach, spread, staged

#: Kinds with their patterns, and the group whose length counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24)]
#: One of these is in every text that ASSIGN matches, in any case.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
#: Numbers that are added one by one; longer arrays are added by blocks.
BLOCK = 256
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _running(steps: Column) -> Column:
    """Running sums of an array of numbers. Appending copies an array, so sums are taken within blocks, and over blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(steps) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    onto = lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s))
    before = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s)), F.array(F.lit(0)), onto)
    within = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, o: F.slice(F.aggregate(b, F.array(o), onto), 2, F.size(b)))
    return F.flatten(within)


def _spans(text: Column, rank: int, kind: str, pattern: str, gate: Column, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches as (start, rank, end, kind, value), where the group has least characters.
    Gaps between the matches come from split(), so positions are sums of lengths in code points. Rows that fail gate, a
    cheaper test that every counted match passes, are not split."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    ends = _running(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m)))
    found = F.transform(F.arrays_zip(ends.alias("end"), matches.alias("m"), values.alias("v")), lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
    counted = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.when(gate, counted).otherwise(F.array().cast(SPANS)).cast(SPANS)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row for each row of df: id, owner, repo, base (spans by start, then kind as listed) and extra (candidates that
    overlap no base span, with upper- and lower-case letters and digits)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols)).alias("repo"), text.alias("t"))
    t = F.col("t")
    rows, assigned = rows.withColumn("low", F.lower("t")), F.lit(False)
    for word in ASSIGN_WORDS:
        assigned |= F.contains("low", F.lit(word))
    gates = {"assign": assigned & t.rlike(ASSIGN), "access": F.contains(t, F.lit("AKIA")) & t.rlike(r"AKIA[A-Z0-9]{16}"), "hex": t.rlike(r"[0-9a-f]{24}")}
    patterns = {"hex": r"[0-9a-f]{24,}"}  # runs are maximal, so asking for the length in the pattern finds the same ones
    base = F.array_sort(F.concat(*(_spans(F.col("t"), k, kind, patterns.get(kind, p), gates[kind], g, n) for k, (kind, p, g, n) in enumerate(KINDS))))
    mixed = t.rlike(r"[A-Za-z0-9+/_=-]{20}")
    extra = F.filter(_spans(F.col("t"), len(KINDS), "owned", CANDIDATE, mixed, 0, 20), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))
    rows = rows.select("id", "owner", "repo", base.alias("base"), extra.alias("extra"))
    return rows.withColumn("extra", F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))


def ownership(scanned: DataFrame) -> DataFrame:
    """For each hash of a candidate value: n (rows and places), repos, owners. Aggregated in three steps, each with its
    partial sums before the shuffle, so that a value in very many rows is a few rows a task."""
    values = scanned.select("owner", "repo", F.explode(F.concat("base", "extra")).alias("x")).select("owner", "repo", _key("x").alias("key"))
    by_repo = values.groupBy("key", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("key", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("key").agg(F.sum("n").alias("n"), F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def _key(span: str) -> Column:
    return F.unhex(F.sha2(F.col(f"{span}.value"), 256))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 2, most_repos: int = 4) -> DataFrame:
    """For every row of df: id_col, spans (array of start, rank, end, kind, value, live), n_dropped (added candidates that
    turned out to be copied examples). Base spans are all there; live says whether one owner has the value, or at most
    most_owners owners in at most most_repos repositories. Positions are code points, end exclusive.

    Null and empty texts have no spans; null owners and repositories count as one owner named "". Rows that repeat an id
    keep a row each. An empty table gives an empty result. Columns other than those named are not read.
    """
    scanned = staged(scan(df, id_col, text_col, owner_col, repo_cols).withColumn(ROW, F.monotonically_increasing_id()), "scanned")
    own = (F.col("owners") == 1) | ((F.col("owners") <= most_owners) & (F.col("repos") <= most_repos))
    wide = ownership(scanned).select("key", own.alias("live"))
    # verdicts go back by row number, so a group has the values of one text, whatever rows share an id
    places = scanned.select(ROW, F.explode(F.concat("base", "extra")).alias("x")).select(ROW, _key("x").alias("key")).distinct().withColumn("run", spread(ROW))
    verdicts = attach(places, wide, ["key"], "inner").filter("live").groupBy(ROW).agg(F.collect_set("key").alias("live_keys"))
    rows = scanned.join(verdicts, ROW, "left").select("id", "base", "extra", F.coalesce("live_keys", F.array().cast("array<binary>")).alias("live_keys"))
    judged = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"), F.array_contains(F.col("live_keys"), F.unhex(F.sha2(x["value"], 256))).alias("live")))
    rows = rows.select("id", judged("base").alias("base"), judged("extra").alias("extra"))
    added = F.filter("extra", lambda x: x["live"])
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", added)).alias("spans"), (F.size("extra") - F.size(added)).alias("n_dropped"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of find_secrets()."""
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live")
    return found.select(id_col, *(of(k[0]) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), live, F.col("n_dropped").cast("long").alias("n_dropped"))
