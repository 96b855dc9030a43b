"""Rules over per-project aggregates: risk notes, presence audit, upgrade plan, resolved options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import labels, paths
from sedimenta.functions.text import filled
from sedimenta.operators.skew import top_rows


def selection_flags(selected: DataFrame) -> DataFrame:
    return selected.groupBy("project").agg(
        F.bool_or(paths.is_env_template(F.col("path"))).alias("has_env_template"),
        F.bool_or(paths.is_test_path(F.col("path"))).alias("has_tests"),
        F.bool_or(paths.is_auth_path(F.col("path"))).alias("has_auth"),
        F.count_if("redacted").alias("n_redacted"),
        F.count("*").alias("n_selected"),
    )


def finding_heads(found: DataFrame, shown: int = 5) -> DataFrame:
    """Rows and files with findings per project, and the first few file paths."""
    per_file = found.groupBy("project", "path").agg(F.count("*").alias("_rows"))
    counts = per_file.groupBy("project").agg(F.sum("_rows").alias("n_findings"), F.count("*").alias("n_files"))
    first = top_rows(per_file, ["project"], [F.col("path")], shown).groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("first_files")
    )
    return counts.join(first, "project")


def risk_notes(projects: DataFrame, stats: DataFrame, found: DataFrame, selected: DataFrame, tech: DataFrame) -> DataFrame:
    """(project, ord, note). The template rule looks at selected files only, where a template never is."""
    df = (
        projects.select("project")
        .join(stats.select("project", "env_template_skipped"), "project", "left")
        .join(finding_heads(found), "project", "left")
        .join(selection_flags(selected), "project", "left")
        .join(tech.select("project", "frameworks", "tools", "testing_tools"), "project", "left")
    )
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    has_framework = F.coalesce(F.size("frameworks") > 0, F.lit(False))
    has_testing = F.coalesce(F.size("testing_tools") > 0, F.lit(False))
    has_docker = F.coalesce(F.array_contains("tools", "Docker"), F.lit(False))
    notes = [
        F.when(F.col("n_findings") > 0, F.concat(
            filled(rules.NOTE_SECRETS, "n_findings", "n_files", "first_files"),
            F.when(F.col("n_files") > rules.NOTE_FILES_SHOWN, "...").otherwise(""))),
        F.when(~flag("has_env_template") & has_framework, rules.NOTE_NO_ENV_TEMPLATE),
        F.when(~flag("has_tests") & ~has_testing, rules.NOTE_NO_TESTS),
        F.when(~has_docker, rules.NOTE_NO_DOCKER),
        F.when(~flag("has_auth") & has_framework, rules.NOTE_NO_AUTH),
        F.when(F.col("n_redacted") > 0, filled(rules.NOTE_REDACTED, "n_redacted")),
        F.when(flag("env_template_skipped"), rules.NOTE_TEMPLATE_SKIPPED),
    ]
    return df.select("project", F.posexplode_outer(F.array_compact(F.array(*notes))).alias("ord", "note")).filter(
        F.col("note").isNotNull()
    )


def _present(fact: str) -> Column:
    kind, what = fact.split(":", 1)
    if kind == "file":
        return F.col("path") == what
    if kind == "under":
        return (F.col("path") == what) | F.col("path").startswith(what + "/")
    source, needle = what.split("|", 1)
    return (F.col("path") == source) & F.col("content").contains(needle)


def repo_audit(files: DataFrame, audit_rules=rules.AUDIT_RULES) -> DataFrame:
    """(project, ord, category, severity, title, detail, recommendation) for every rule nothing satisfies.

    One pass: each rule is a boolean aggregate, combined on the map side, over the unpruned file list.
    """
    checks, missing = [], []
    for i, (category, severity, title, detail, recommendation, any_of) in enumerate(audit_rules):
        met = F.lit(False)
        for fact in any_of:
            met = met | _present(fact)
        checks.append(F.bool_or(F.coalesce(met, F.lit(False))).alias(f"_met{i}"))
        missing.append(F.when(~F.col(f"_met{i}"), F.struct(
            F.lit(i).alias("ord"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            F.lit(title).alias("title"), F.lit(detail).alias("detail"), F.lit(recommendation).alias("recommendation"),
        )))
    met = files.groupBy("project").agg(*checks)
    return met.select("project", F.explode_outer(F.array_compact(F.array(*missing))).alias("a")).filter(
        F.col("a").isNotNull()
    ).select("project", "a.*")


def upgrade_plan(projects: DataFrame, audit: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("- ["), F.upper("severity"), F.lit("] "), "title", F.lit(": "), "detail", F.lit(" → "), "recommendation"
    )
    lines = audit.groupBy("project").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda r: r["line"]
    ), "\n").alias("_lines"))
    head = F.concat(F.lit("# Project Upgrade Plan ("), F.substring_index("project", "/", -1), F.lit(")\n"),
                    F.lit("\n".join(rules.UPGRADE_PLAN_LINES) + "\n"))
    return projects.select("project").join(lines, "project", "left").select("project", F.concat(
        head, F.coalesce("_lines", F.lit(rules.NO_AUDIT_FINDINGS)), F.lit("\n")
    ).alias("plan"))


def resolve_options(requests: DataFrame) -> DataFrame:
    """requests(project, mode, use_enrichment, max_files, max_chars) with nulls for values not given."""
    mode = F.col("mode")
    return requests.select(
        "project", "mode", labels.uses_enrichment(mode, F.col("use_enrichment")).alias("use_enrichment"),
        labels.resolved_max_files(mode, F.col("max_files")).alias("max_files"),
        labels.resolved_max_chars(mode, F.col("max_chars")).alias("max_chars"),
        labels.enrichment_cap(mode).alias("enrich_max"),
    )
