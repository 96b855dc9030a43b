"""Labels that depend on mode, enrichment and domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions.cases import case
from sedimenta.functions.text import filled


def _mode_value(mode: Column, position: int) -> Column:
    return case((mode == name, defaults[position]) for name, defaults in rules.MODES.items())


def resolved_max_files(mode: Column, explicit: Column) -> Column:
    return F.coalesce(explicit, _mode_value(mode, 0))


def resolved_max_chars(mode: Column, explicit: Column) -> Column:
    return F.coalesce(explicit, _mode_value(mode, 1))


def enrichment_cap(mode: Column) -> Column:
    return _mode_value(mode, 2)


def uses_enrichment(mode: Column, asked: Column) -> Column:
    """Enrichment only when asked for, and never in fast mode."""
    return F.coalesce(asked, F.lit(False)) & (mode != "fast")


def check_mode(mode: str) -> str:
    if mode not in rules.MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {', '.join(rules.MODES)}")
    return mode


def check_targets(target: str) -> tuple[str, ...]:
    wanted = target.strip().lower()
    if wanted == "all":
        return rules.TARGETS
    if wanted not in rules.TARGETS:
        raise ValueError(f"unknown target {target!r}, expected one of {', '.join((*rules.TARGETS, 'all'))}")
    return (wanted,)


def evidence_level(mode: Column, enriched: Column) -> Column:
    return F.when((mode == "deep") & enriched, "high").when(mode == "balanced", "medium").otherwise("limited")


def analysis_type(mode: Column, enriched: Column) -> Column:
    return (
        F.when((mode == "deep") & enriched, rules.ANALYSIS_DEEP)
        .when((mode == "balanced") & enriched, rules.ANALYSIS_BALANCED)
        .when(mode == "balanced", rules.ANALYSIS_BALANCED_STATIC)
        .otherwise(rules.ANALYSIS_LIMITED)
    )


def evidence_disclaimer(enriched: Column, n_files: Column, error: Column) -> Column:
    """Text of the disclaimer block, empty when there is nothing to say."""
    parts = F.array_compact(F.array(
        F.when(~enriched, rules.DISCLAIMER_STATIC),
        F.when(n_files < 20, rules.DISCLAIMER_FEW_FILES),
        F.when(error.isNotNull() & (error != "") & ~enriched, filled(rules.DISCLAIMER_ERROR, error)),
    ))
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("> ⚠ "), p)), "\n\n")
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit("## Evidence Disclaimer\n\n"), body, F.lit("\n")))


def special_section(domain: Column, confidence: Column) -> Column:
    sure = confidence.isin("medium", "high")
    return case((((domain == name) & sure, shown) for name, shown in rules.DOMAIN_SECTIONS.items()), "")
