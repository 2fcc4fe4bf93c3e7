"""Whole evaluations: every model over every representation of every repository, scored, judged and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, facts, graph, judge, overlap, statistics
from ..sources.providers import Provider, ask, prompt_from
from ..sources.staging import written

SUMMARY_PROMPT = "Summarise this repository as JSON with the keys overview, tech_stack, services, dependencies.\n\n%s"
CLAIMS_PROMPT = "Reference facts:\n%s\n\nSummary:\n%s\n\nAnswer as JSON with total_claims and unsupported_claims."
COVERAGE_PROMPT = "Numbered facts:\n%s\n\nSummary:\n%s\n\nAnswer as JSON with missing_facts."


def representations(tables: dict[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """(repo_name, context_variant, context) of the graph's texts and, with files (repo_name, path, text), of the source."""
    dep = context.dependency_text(graph.dependency_view(tables["modules"], tables["import_edges"], tables["external_deps"]))
    names = ("repositories", "modules", "import_edges", "classes", "endpoints", "functions", "external_deps", "config_files", "db_entities")
    kg = context.knowledge_text(graph.knowledge_view(*(tables[n] for n in names)))
    tag = lambda t, v: t.select("repo_name", F.lit(v).alias("context_variant"), "context")
    out = tag(dep, "dependency_graph").unionByName(tag(kg, "knowledge_graph"))
    if files is not None:
        raw = context.raw_text(files.join(tables["modules"].select("repo_name", "path", "pos"), ["repo_name", "path"]), [F.col("pos")])
        out = out.unionByName(tag(raw, "raw"))
    return out


def check_judge(models: list[str], judge_model: str) -> None:
    """A model never judges its own texts."""
    if judge_model in models:
        raise ValueError(f"{judge_model} would judge its own summaries")


def generate(contexts: DataFrame, models: list[str], provider: Provider) -> DataFrame:
    """A run for each context and model, with summary_text (the overview) and whether the answer has the asked form. Runs
    are written out, so each is asked for once, whatever reads them."""
    prompts = contexts.withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("prompt", prompt_from(SUMMARY_PROMPT, ["context"]))
    runs = written(ask(prompts, provider).drop("prompt", "context"), "runs")
    return runs.withColumn("valid_json", judge.valid_summary(F.col("raw_text"))).withColumn("summary_text", judge.overview(F.col("raw_text")))


def score(runs: DataFrame, tables: dict[str, DataFrame], judge_model: str, provider: Provider, references: DataFrame | None = None) -> DataFrame:
    """runs with deterministic coverage and unsupported-identifier rate, the judge's two scores (null where its answer
    can't be read), overlap with a reference where there is one, and failure tags. Failed runs stay, with null scores and
    the tag of malformed output. The judge's answers are written out, so each is asked for once."""
    keys = ["repo_name", "model", "context_variant"]
    every, runs = runs, runs.filter("status = 'success'")
    listed = facts.coverable_facts(tables["repositories"], tables["external_deps"], tables["endpoints"], tables["classes"], tables["db_entities"])
    covered = facts.with_empty(facts.coverage(facts.match_facts(listed, runs.select(*keys, "summary_text")), keys), runs, keys)
    candidates = facts.identifier_candidates(runs, keys)
    rate = facts.unsupported_rate(facts.unsupported(candidates, facts.known_identifiers(tables)), runs, keys)

    numbered = listed.groupBy("repo_name").agg(F.sort_array(F.collect_list(F.struct("section", "pos", "fact"))).alias("f")).select(
        "repo_name",
        F.array_join(F.transform(F.col("f.fact"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n").alias("numbered"),
    )
    asked = runs.select(*keys, "summary_text").join(numbered, "repo_name").withColumnRenamed("model", "writer").withColumn("model", F.lit(judge_model))
    answers = ask(
        asked.withColumn("prompt", prompt_from(COVERAGE_PROMPT, ["numbered", "summary_text"])),
        provider,
    ).select("repo_name", F.col("writer").alias("model"), "context_variant", "raw_text")
    answers = written(answers, "coverage_answers")
    verdicts = answers.withColumn("items", facts.missing_facts(answers)).withColumn("judged", F.col("items").isNotNull())
    resolved = facts.resolve_verdict(verdicts.select(*keys, F.posexplode("items").alias("pos", "item")), listed, keys)
    coverage_judged = facts.judged_coverage(resolved, listed, verdicts.select(*keys, "judged"), keys).select(
        *keys,
        F.col("score").alias("judge_coverage"),
        F.col("judged").alias("coverage_judged"),
        "unmatched",
    )
    lost = resolved.filter("fact is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("fact")).alias("missing_facts"))

    claims = ask(asked.withColumn("prompt", prompt_from(CLAIMS_PROMPT, ["numbered", "summary_text"])), provider).select(
        "repo_name",
        F.col("writer").alias("model"),
        "context_variant",
        facts.hallucination_verdict(F.col("raw_text")).alias("v"),
    )
    claims = written(claims, "claim_answers")
    claimed = claims.select(
        *keys,
        F.try_divide(F.size("v.unsupported"), F.col("v.total")).alias("judge_hallucination"),
        F.col("v").isNotNull().alias("hallucination_judged"),
        F.col("v.unsupported").alias("unsupported_claims"),
    )

    terms = tables["external_deps"].groupBy("repo_name").agg(F.collect_set("name").alias("known_terms"))
    out = every
    for part in (covered, rate, coverage_judged, claimed, lost):
        out = out.join(part, keys, "left")
    out = out.join(terms, "repo_name", "left")
    if references is not None:
        out = out.join(references.select("repo_name", F.col("overview").alias("reference")), "repo_name", "left")
        out = out.join(overlap.overlap_scores(written(out.select(*keys, "summary_text", "reference"), "overlap"), keys, "summary_text", "reference"), keys, "left")
    judged = F.coalesce("coverage_judged", F.lit(False)) & F.coalesce("hallucination_judged", F.lit(False))
    return facts.failure_tags(out, overview="summary_text", judged=judged)


def scored_ablation(
    tables: dict[str, DataFrame],
    models: list[str],
    judge_model: str,
    provider: Provider,
    files: DataFrame | None = None,
    references: DataFrame | None = None,
) -> DataFrame:
    """The flagship: representations, runs, scores."""
    check_judge(models, judge_model)
    return score(generate(representations(tables, files), models, provider), tables, judge_model, provider, references)


def report(scored: DataFrame, metric: str = "coverage_strict") -> dict[str, DataFrame]:
    """Runs and how many of them failed, cell means with intervals, paired contrasts between representations with Holm's correction, failure counts."""
    pairs = statistics.level_pairs(scored, metric, "context_variant", ["repo_name"], ["model"])
    runs = scored.groupBy("model", "context_variant").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )
    return {
        "runs": runs,
        "cells": statistics.cell_summary(scored, metric, ["model", "context_variant"]),
        "contrasts": statistics.holm(statistics.paired_tests(pairs, ["model", "a", "b"])),
        "failures": facts.tag_frequencies(scored, ["model"]),
    }
