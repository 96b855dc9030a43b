"""Budgets and the rows of per-target context documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import labels
from sedimenta.operators.skew import prefix_sum
from sedimenta.operators.tree import tree_head

CONTEXT_COLUMNS = ["project", "target", "section", "section_ord", "line_key", "text"]
SECTION_ORDER = (
    "facts", "project_summary", "tech_stack", "file_tree", "important_files", "file_summaries", "risk_notes",
    "redaction", "metadata", "disclaimer", "domain_risk",
)


def budget_pack(
    rows: DataFrame, group: Sequence[str], order: str, text: str = "text",
    per_item: int = rules.PREVIEW_ITEM_CHARS, total: int = rules.PREVIEW_TOTAL_CHARS,
) -> DataFrame:
    """Greedy preview budget in ``order`` (unique in the group).

    Adds ``preview`` and ``truncated``. With c = least(length, per_item) and prev = sum of earlier c, a row takes
    greatest(0, least(c, total - prev)) characters, so a prefix sum replaces the sequential loop. The sum is taken over
    lengths only; what comes back to the texts is the few rows that still get characters.
    """
    keys = [*group, order]
    lengths = rows.select(*keys, F.least(F.length(text), F.lit(per_item)).cast("bigint").alias("_c"))
    within = prefix_sum(lengths, group, order, "_c", "_prev").filter(F.col("_prev") < total).select(*keys, "_prev")
    packed = rows.withColumn("_head", F.substring(F.col(text), 1, per_item)).join(within, keys, "left")
    left = F.coalesce(F.lit(total) - F.col("_prev"), F.lit(0))
    cap = F.least(F.lit(per_item), left).cast("int")
    cut = F.length(text) > cap
    preview = (
        F.when(left <= 0, "(preview omitted: size budget reached)")
        .when(cut, F.concat(F.substring(F.col("_head"), F.lit(1), cap), F.lit("\n\n...(preview truncated after "), cap, F.lit(" characters)")))
        .otherwise(F.col("_head"))
    )
    return packed.select(*rows.columns, preview.alias("preview"), ((left <= 0) | cut).alias("truncated"))


def _join_nonempty(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _per_target(targets: Sequence[str], shape) -> Column:
    """Array of (target, text) for the targets where ``shape`` gives a text: one row becomes one per target."""
    return F.array_compact(F.array(*[
        F.when(shape(t).isNotNull(), F.struct(F.lit(t).alias("target"), shape(t).alias("text"))) for t in targets
    ]))


def section_rows(df: DataFrame, section: str, key: Column, targets: Sequence[str], shape) -> DataFrame:
    return df.select("project", key.cast("string").alias("line_key"), F.explode_outer(_per_target(targets, shape)).alias("t")).filter(
        F.col("t").isNotNull()
    ).select(
        "project", "t.target", F.lit(section).alias("section"), F.lit(SECTION_ORDER.index(section)).alias("section_ord"),
        "line_key", "t.text",
    )


def _rank_key() -> Column:
    return F.lpad(F.col("rank").cast("string"), 6, "0")


def _file_line(target: str) -> Column:
    path, score = F.col("path"), F.col("priority_score")
    tick = lambda c: F.concat(F.lit("- `"), c, F.lit("`"))
    mark = lambda note: F.when(F.col("redacted"), note).otherwise("")
    lines = {
        "chatgpt": F.concat(tick(path), F.lit(" (priority: "), score, F.lit(", size: "), "size", F.lit("B"), mark(", redacted"), F.lit(")")),
        "claude": F.concat(F.lit("- "), path, F.lit(" (score: "), score, F.lit(")"), mark(" [REDACTED]")),
        "gemini": F.concat(tick(path), F.lit(" — priority score: "), score, mark(" *(contains redacted secrets)*")),
        "minimax": F.concat(tick(path), mark(" [REDACTED]")),
        "generic": F.concat(tick(path), F.lit(" (priority: "), score, F.lit(")"), mark(" *(redacted)*")),
    }
    return F.when(F.col("rank") <= rules.TARGET_CAPS[target][0], lines[target])


def _summary_line(target: str) -> Column:
    _, shown, chars, _ = rules.TARGET_CAPS[target]
    path, summary = F.col("path"), F.col("summary")
    if chars:
        summary = F.when(F.length(summary) > chars, F.concat(F.substring(summary, 1, chars), F.lit("..."))).otherwise(summary)
    plain = F.concat(F.lit("### `"), path, F.lit("`\n"), summary, F.lit("\n"))
    lines = {
        "claude": F.concat(F.lit("["), path, F.lit("]\n"), summary, F.lit("\n")),
        "gemini": F.concat(F.lit("**`"), path, F.lit("`**\n"), summary, F.lit("\n")),
        "minimax": F.concat(F.lit("["), path, F.lit("] "), summary),
    }
    return F.when(F.col("summary_rank") <= shown, lines.get(target, plain))


def _finding_line(target: str) -> Column:
    path, kind, count = F.col("path"), F.col("finding_type"), F.col("count")
    lines = {
        "chatgpt": F.concat(F.lit("| `"), path, F.lit("` | "), kind, F.lit(" | "), count, F.lit(" |")),
        "gemini": F.concat(F.lit("- `"), path, F.lit("`: **"), kind, F.lit("** — "), count, F.lit(" occurrence(s)")),
        "minimax": F.concat(F.lit("- `"), path, F.lit("`: "), kind, F.lit(" ("), count, F.lit("x) — REDACTED")),
        "claude": F.concat(F.lit("- "), path, F.lit(": "), kind, F.lit(" ("), count, F.lit(" occurrence(s))")),
        "generic": F.concat(F.lit("- `"), path, F.lit("`: "), kind, F.lit(" ("), count, F.lit(" occurrence(s))")),
    }
    return lines[target]


# fixed values: texts shown when a section has no rows, and lines around the redaction rows
_EMPTY = {
    "important_files": {"chatgpt": "_No important files identified._", "claude": "No important files identified.",
                        "gemini": "_No important files identified._", "minimax": "None identified.",
                        "generic": "_No important files identified._"},
    "file_summaries": {"chatgpt": "_No file summaries available (static analysis mode)._",
                       "claude": "No file summaries available.",
                       "gemini": "_No file summaries available (static analysis mode)._",
                       "minimax": "Not available (static mode).",
                       "generic": "_No file summaries available (static analysis mode)._"},
    "risk_notes": {"chatgpt": "_No specific risk notes generated._", "claude": "No specific risk notes generated.",
                   "gemini": "_No specific risk notes generated._", "minimax": "None noted.",
                   "generic": "_No specific risk notes generated._"},
    "redaction": {"chatgpt": "_No secrets were detected or redacted._", "claude": "No secrets were detected or redacted.",
                  "gemini": "_No secrets were detected or redacted._", "minimax": "No secrets detected.",
                  "generic": "_No secrets were detected or redacted._"},
}
_REDACTION_HEAD = {
    "chatgpt": "The following secret patterns were detected and redacted before this prompt was generated:\n\n"
               "| File | Finding Type | Count |\n|---|---|---|",
    "claude": "The following secret patterns were detected and redacted:",
    "gemini": "The following secret patterns were detected and redacted before this prompt was generated:",
    "generic": "The following secret patterns were detected and redacted:",
}
_REDACTION_TAIL = {
    "chatgpt": "\n> ⚠ Secret values were replaced with placeholders. They are NOT included in this prompt.",
    "claude": "\nSecret values are NOT included in this prompt. They were replaced with placeholders.",
    "gemini": "\n> Secret values are NOT included in this prompt.",
    "generic": "\n> Secret values are NOT included in this prompt.",
}


def _facts(target: str) -> Column:
    pairs = {
        "chatgpt": ("| {} | {} |", "Project Path", "Files Scanned", "Files Skipped", "Files Redacted", "Ollama Used"),
        "claude": ("- {}: {}", "Project path", "Files scanned", "Files skipped", "Files with redacted secrets", "Ollama summarization used"),
        "gemini": ("- {}: {}", "Project Path", "Files Scanned", "Files Skipped", "Files with Redacted Secrets", "Ollama Summarization Used"),
    }
    used = F.initcap(F.col("enriched").cast("string"))
    if target == "minimax":
        return F.concat(F.lit("**Project:** `"), "project", F.lit("`\n**Files:** "), "files_scanned", F.lit(" scanned, "),
                        "files_skipped", F.lit(" skipped\n**Ollama Used:** "), used)
    if target == "generic":
        return F.concat(F.lit("**Project Path:** `"), "project", F.lit("`"))
    shape, *names = pairs[target]
    left, mid, right = shape.split("{}")
    project = F.concat(F.lit("`"), "project", F.lit("`")) if target == "chatgpt" else F.col("project")
    values = [project, F.col("files_scanned"), F.col("files_skipped"), F.col("files_redacted"), used]
    lines = [F.concat(F.lit(f"{left}{n}{mid}"), v, F.lit(right)) for n, v in zip(names, values)]
    if target == "claude":
        lines += [
            F.when(F.size("languages") > 0, F.concat(F.lit("- Detected languages: "), F.array_join("languages", ", "))),
            F.when(F.size("frameworks") > 0, F.concat(F.lit("- Detected frameworks: "), F.array_join("frameworks", ", "))),
            F.when(F.col("n_findings") > 0, F.concat(F.lit("- Secret patterns found and redacted: "), "n_findings", F.lit(" finding(s)"))),
        ]
    return _join_nonempty(*lines)


def metadata_text() -> Column:
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n"))
    named = F.col("domain") != "generic"
    return F.concat(
        F.lit("## Analysis Metadata\n\n| Field | Value |\n|---|---|\n"),
        row("Analysis Type", labels.analysis_type(F.col("mode"), F.col("enriched"))),
        row("Evidence Level", F.initcap(labels.evidence_level(F.col("mode"), F.col("enriched")))),
        row("Full Source Audit", F.lit("No")),
        row("Ollama Used", F.initcap(F.col("enriched").cast("string"))),
        row("Included File Evidence Count", F.col("n_selected")),
        row("Skipped Files Count", F.col("files_skipped")),
        row("Mode", F.col("mode")),
        row("Detected Domain", F.col("domain")),
        row("Domain Confidence", F.col("confidence")),
        F.when(named, row("Domain Score", F.col("score"))).otherwise(""),
        F.when(named & (F.size("matched") > 0), row("Domain Indicators", F.array_join("matched", ", "))).otherwise(""),
    )


def project_facts(projects, stats, tech, selected, found, notes, detected, summary, mode: str = "fast", enriched: bool = False) -> DataFrame:
    """One bounded row per project with everything the sections need besides their own rows."""
    chosen = selected.groupBy("project").agg(
        F.count("*").alias("n_selected"), F.count_if(F.length("content_preview") > 0).alias("n_summaries")
    )
    n_found = found.groupBy("project").agg(F.count("*").alias("n_findings"))
    n_notes = notes.groupBy("project").agg(F.count("*").alias("n_notes"))
    df = projects.select("project")
    for part in (stats, tech, chosen, n_found, n_notes, detected, summary):
        df = df.join(part, "project", "left")
    counts = ("files_found", "files_scanned", "files_skipped", "files_redacted", "n_selected", "n_summaries", "n_findings", "n_notes")
    return df.fillna(0, subset=list(counts)).withColumn("mode", F.lit(mode)).withColumn("enriched", F.lit(enriched)).withColumn(
        "enrichment_error", F.lit(None).cast("string")
    )


def with_summary_rank(summaries: DataFrame) -> DataFrame:
    """Summaries are shown in selection order; files without text do not use up a place."""
    return summaries.withColumn("summary_rank", F.row_number().over(Window.partitionBy("project").orderBy("rank")))


def context_rows(facts: DataFrame, selected: DataFrame, summaries: DataFrame, notes: DataFrame, found: DataFrame,
                 tree: DataFrame, target: str = "all") -> DataFrame:
    """(project, target, section, section_ord, line_key, text) rows of every section under the target's caps.

    Targets multiply rows by an array inside the row, not by a join. Sections without a bound (redaction, tree)
    stay one row per line; sorting by project, target, section_ord and line_key gives the document.
    """
    targets = labels.check_targets(target)
    only = lambda wanted: [t for t in targets if t in wanted]
    head, body, tail = F.lit("0"), F.concat(F.lit("1"), F.col("path"), F.lit("\u0001"), F.col("ord")), F.lit("2")
    ranked = with_summary_rank(summaries)
    uncut = [t for t in targets if rules.TARGET_CAPS[t][3] is None]
    parts = [
        section_rows(facts, "facts", head, targets, _facts),
        section_rows(facts, "project_summary", head, targets, lambda t: F.col("summary")),
        section_rows(facts, "tech_stack", head, targets, lambda t: F.col("tech_table")),
        section_rows(selected, "important_files", _rank_key(), targets, _file_line),
        section_rows(ranked, "file_summaries", _rank_key(), targets, _summary_line),
        section_rows(notes, "risk_notes", F.lpad(F.col("ord").cast("string"), 3, "0"), targets, lambda t: F.concat(F.lit("- "), "note")),
        section_rows(found, "redaction", body, targets, _finding_line),
        section_rows(facts, "metadata", head, targets, lambda t: metadata_text()),
        section_rows(facts, "disclaimer", head, targets, lambda t: F.nullif(
            labels.evidence_disclaimer(F.col("enriched"), F.col("n_selected"), F.col("enrichment_error")), F.lit(""))),
        section_rows(facts, "domain_risk", head, targets, lambda t: F.nullif(
            labels.special_section(F.col("domain"), F.col("confidence")), F.lit(""))),
    ]
    empty = {"important_files": "n_selected", "file_summaries": "n_summaries", "risk_notes": "n_notes", "redaction": "n_findings"}
    for section, counter in empty.items():
        parts.append(section_rows(facts, section, head, targets, lambda t, s=section, c=counter: F.when(F.col(c) == 0, _EMPTY[s][t])))
    with_findings = facts.filter(F.col("n_findings") > 0)
    if only(_REDACTION_HEAD):
        parts.append(section_rows(with_findings, "redaction", head, only(_REDACTION_HEAD), lambda t: F.lit(_REDACTION_HEAD[t])))
        parts.append(section_rows(with_findings, "redaction", tail, only(_REDACTION_TAIL), lambda t: F.lit(_REDACTION_TAIL[t])))
    if uncut:
        parts.append(section_rows(tree, "file_tree", F.col("sort_key"), uncut, lambda t: F.col("line")))
    for t in targets:
        if rules.TARGET_CAPS[t][3] is not None:
            cut = tree_head(tree, rules.TARGET_CAPS[t][3])
            parts.append(section_rows(cut, "file_tree", head, [t], lambda _: F.col("tree_head")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*CONTEXT_COLUMNS)
