"""Report documents as ordered line rows.

A report may list every finding or file of a project, so it stays a table of lines: (project, report, block,
line_key, line). Sorting by those columns gives the document; the sink writes it that way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta import __version__, rules
from sedimenta.functions import labels
from sedimenta.operators.skew import top_rows

GENERATOR = f"sedimenta {__version__}"


@dataclass(frozen=True)
class ScanInfo:
    """What a scan knows that its tables do not hold; the caller passes it."""

    scan_id: str = "N/A"
    scanned_at: str = "N/A"
    duration_seconds: float = 0.0
    model: str = "N/A"
    model_available: bool = False
    model_wanted: bool = False
    error: str | None = None
    assumptions: tuple[str, ...] = ()
    options: tuple[tuple[str, str], ...] = ()


REPORT_COLUMNS = ["project", "report", "block", "line_key", "line"]


def _fixed(df: DataFrame, report: str, block: int, *parts: Column | str) -> DataFrame:
    """A few lines per project; null parts are left out."""
    lines = F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return df.select("project", F.posexplode_outer(lines).alias("pos", "line")).filter(F.col("line").isNotNull()).select(
        "project", F.lit(report).alias("report"), F.lit(block).alias("block"), F.lpad(F.col("pos").cast("string"), 4, "0").alias("line_key"), "line"
    )


def _listed(df: DataFrame, report: str, block: int, key: Column, line: Column) -> DataFrame:
    return df.select("project", F.lit(report).alias("report"), F.lit(block).alias("block"), key.cast("string").alias("line_key"), line.alias("line"))


def _finding_key() -> Column:
    return F.concat("path", F.lit("\u0001"), F.col("ord").cast("string"))


def _footer(df: DataFrame, report: str) -> DataFrame:
    return _fixed(df, report, 99, "", "---", "", f"_Generated by {GENERATOR}_")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary_md(facts: DataFrame, info: ScanInfo = ScanInfo()) -> DataFrame:
    tech = [
        F.when(F.size(c) > 0, F.concat(F.lit(f"- **{label}:** "), F.array_join(c, ", ")))
        for c, label in list(zip(rules.TECH_CATEGORIES, rules.TECH_TABLE_LABELS))[:7]
    ]
    count = lambda name, column: F.concat(F.lit(f"| {name} | "), F.col(column).cast("string"), F.lit(" |"))
    body = _fixed(
        facts, "project_summary", 0, "# Project Summary", "",
        F.concat(F.lit("**Project Path:** `"), "project", F.lit("`")), f"**Scanned At:** {info.scanned_at}", f"**Scan ID:** `{info.scan_id}`", "", "---", "",
        "## Overview", "", F.coalesce(F.nullif("summary", F.lit("")), F.lit(rules.REPORT_NO_SUMMARY)),
        "", "---", "", "## Technology Stack", "", *tech,
        F.when(F.col("is_empty"), F.lit("_No technologies detected._")),
        "", "---", "", "## Scan Statistics", "", "| Metric | Value |", "|---|---|",
        count("Files Scanned", "files_scanned"), count("Files Skipped", "files_skipped"), count("Files Redacted", "files_redacted"),
        F.concat(F.lit("| Ollama Used | "), F.initcap(F.col("enriched").cast("string")), F.lit(" |")),
        f"| Ollama Model | {info.model} |", f"| Duration | {info.duration_seconds:.1f}s |",
        *(["", "---", "", rules.REPORT_ERROR_NOTE.format(info.error)] if info.error else []),
    )
    closing = _fixed(facts, "project_summary", 100, *rules.REPORT_LOCAL_ONLY)
    return _union([body, _footer(facts, "project_summary"), closing])


def tree_md(facts: DataFrame, tree: DataFrame) -> DataFrame:
    return _union([
        _fixed(facts, "file_tree", 0, "# File Tree", "", "```"),
        _listed(tree, "file_tree", 1, F.col("sort_key"), F.col("line")),
        _fixed(facts, "file_tree", 2, "```"),
        _footer(facts, "file_tree"),
    ])


def tech_md(facts: DataFrame) -> DataFrame:
    names = list(rules.TECH_TABLE_LABELS[:6]) + ["Testing Tools"]
    rows = [
        F.concat(F.lit(f"| {label} | "), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("_None detected_"), F.lit(" |"))
        for c, label in zip(rules.TECH_CATEGORIES, names)
    ]
    return _union([
        _fixed(facts, "tech_stack", 0, "# Detected Technology Stack", "", "| Category | Detected Technologies |", "|---|---|", *rows),
        _fixed(facts, "tech_stack", 1, "", "---", "", "## Detection Method", "", *rules.REPORT_DETECTION_METHOD, ""),
        _fixed(facts, "tech_stack", 2, f"_Generated by {GENERATOR}_"),
    ])


def _finding_rows(found: DataFrame, report: str, block: int, with_placeholder: bool) -> DataFrame:
    from sedimenta.operators.scan import redaction_report

    cells = [F.concat(F.lit("| `"), "path", F.lit("` | "), "finding_type", F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))]
    rows = found
    if with_placeholder:
        rows = redaction_report(found)
        cells.append(F.concat(F.lit(" `"), "placeholder", F.lit("` |")))
    return _listed(rows, report, block, _finding_key(), F.concat(*cells))


def risk_md(facts: DataFrame, notes: DataFrame, found: DataFrame) -> DataFrame:
    some, none = facts.filter(F.col("n_findings") > 0), facts.filter(F.col("n_findings") == 0)
    r = "risk_notes"
    return _union([
        _fixed(facts, r, 0, "# Risk Notes", "", rules.REPORT_RISK_INTRO, ""),
        _listed(notes, r, 1, F.lpad(F.col("ord").cast("string"), 3, "0"), F.concat(F.lit("- "), "note")),
        _fixed(facts.filter(F.col("n_notes") == 0), r, 1, rules.REPORT_RISK_NONE),
        _fixed(facts, r, 2, "", "---", "", "## Redaction Summary", ""),
        _fixed(some, r, 3, F.concat(F.lit("**"), F.col("n_findings").cast("string"), F.lit(" secret pattern(s) were detected and redacted.**")),
               "", "| File | Finding Type | Count |", "|---|---|---|"),
        _finding_rows(found, r, 4, False),
        _fixed(some, r, 5, "", rules.REPORT_RISK_REDACTED),
        _fixed(none, r, 3, rules.REPORT_REDACTED_NONE),
        _footer(facts, r),
    ])


def redaction_md(facts: DataFrame, totals: DataFrame, found: DataFrame) -> DataFrame:
    r = "redaction_report"
    none = facts.filter(F.col("n_findings") == 0)
    return _union([
        _fixed(facts, r, 0, "# Redaction Report", "",
               *rules.REPORT_REDACTION_INTRO, "", "---", ""),
        _fixed(none, r, 1, "## Result", "", *rules.REPORT_REDACTION_NONE),
        _fixed(totals, r, 1, "## Summary", "",
               F.concat(F.lit("- **Total redactions:** "), F.col("total_redactions").cast("string")),
               F.concat(F.lit("- **Affected files:** "), F.col("affected_files").cast("string")),
               F.concat(F.lit("- **Finding types:** "), "finding_types"),
               "", "---", "", "## Findings", "", "| File | Finding Type | Count | Placeholder Used |", "|---|---|---|---|"),
        _finding_rows(found, r, 2, True),
        _fixed(totals, r, 3, "", "---", "", "## Security Notes", "",
               *rules.REPORT_SECURITY_NOTES),
        _footer(facts, r),
    ])


def scan_report(facts: DataFrame, totals: DataFrame, selected: DataFrame, notes: DataFrame, info: ScanInfo = ScanInfo()) -> DataFrame:
    """One JSON object per project. Findings and affected files have no bound and are written as JSON lines of their own
    (``scan_report_findings``); every other part is bounded and nested here."""
    first = top_rows(selected.drop("rank"), ["project"], [F.col("priority_score").desc(), F.col("path")], rules.REPORT_FILES)
    files = first.groupBy("project").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.struct("path", "priority_score", "size", "redacted").alias("f")))), lambda r: r["f"]
    ).alias("important_files"))
    texts = notes.groupBy("project").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "note"))), lambda r: r["note"]
    ).alias("risk_notes"))
    df = facts.join(totals, "project", "left").join(files, "project", "left").join(texts, "project", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = F.struct(
        F.lit(info.scan_id).alias("scan_id"), F.lit(info.scanned_at).alias("scanned_at"), F.col("project").alias("project_path"),
        (F.create_map(*[F.lit(str(x)) for pair in info.options for x in pair]) if info.options else F.expr("cast(map() as map<string,string>)")).alias("options"),
        F.struct("mode", labels.evidence_level(F.col("mode"), F.col("enriched")).alias("evidence_level"),
                 F.col("domain").alias("detected_domain"), F.col("confidence").alias("domain_confidence"),
                 F.col("score").alias("domain_score")).alias("analysis"),
        F.struct(F.col("files_found").alias("total_files_found"), "files_scanned", "files_skipped", "files_redacted",
                 F.lit(info.duration_seconds).alias("duration_seconds")).alias("statistics"),
        F.struct(F.col("enriched").alias("used"), F.lit(info.model_available).alias("available"), F.lit(info.model).alias("model"),
                 F.lit(info.error).cast("string").alias("error"),
                 F.when(F.col("enriched"), "completed").otherwise("skipped_unavailable" if info.model_wanted else "skipped_disabled").alias("summarization_status"),
                 ).alias("ollama"),
        F.struct(*rules.TECH_CATEGORIES[:7]).alias("tech_stack"),
        F.struct(zero(F.col("finding_rows")).alias("total_findings"), zero(F.col("total_redactions")).alias("total_redactions"),
                 zero(F.col("affected_files")).alias("n_affected_files")).alias("redaction"),
        F.coalesce("important_files", F.array().cast("array<struct<path:string,priority_score:int,size:bigint,redacted:boolean>>")).alias("important_files"),
        F.coalesce("risk_notes", F.array().cast("array<string>")).alias("risk_notes"),
        F.array(*[F.lit(a) for a in info.assumptions]).cast("array<string>").alias("assumptions"),
        F.lit(GENERATOR).alias("generator"), F.lit(rules.REPORT_SECURITY_NOTE).alias("security_note"),
    )
    return df.select("project", F.to_json(report).alias("report"))


def scan_report_findings(found: DataFrame) -> DataFrame:
    return found.select("project", _finding_key().alias("line_key"), F.to_json(F.struct(
        F.col("path").alias("file_path"), "finding_type", "count"
    )).alias("line"))


def affected_files(found: DataFrame) -> DataFrame:
    return found.select("project", "path").distinct().select(
        "project", F.col("path").alias("line_key"), F.to_json(F.struct(F.col("path").alias("affected_file"))).alias("line")
    )


def report_lines(
    facts: DataFrame, tree: DataFrame, notes: DataFrame, found: DataFrame, totals: DataFrame, scan_json: DataFrame | None = None,
    info: ScanInfo = ScanInfo(),
) -> DataFrame:
    parts = [summary_md(facts, info), tree_md(facts, tree), tech_md(facts), risk_md(facts, notes, found), redaction_md(facts, totals, found)]
    if scan_json is not None:
        parts.append(_listed(scan_json, "scan_report", 0, F.lit("0"), F.col("report")))
        parts.append(scan_report_findings(found).select(
            "project", F.lit("scan_report").alias("report"), F.lit(1).alias("block"), "line_key", "line"
        ))
        parts.append(affected_files(found).select(
            "project", F.lit("scan_report").alias("report"), F.lit(2).alias("block"), "line_key", "line"
        ))
    return _union(parts).select(*REPORT_COLUMNS)
