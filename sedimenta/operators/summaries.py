"""Structural summaries of files, symbol tables and the roll-ups built on selected files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import paths, symbols, text
from sedimenta.functions.cases import case, sql_string

def with_symbols(scanned: DataFrame, languages: Iterable[str] = tuple(rules.LANGUAGE_SUFFIXES), column: str = "content_preview") -> DataFrame:
    """Add ``lang``, ``symbols`` and ``parsed`` to each row. Only Python texts go to Python workers, the others are null there."""
    df = scanned.withColumn("lang", symbols.language(F.col("extension")))
    found = []
    for lang in languages:
        own = F.col("lang") == lang
        if lang == "python":
            found.append((own, symbols.python_symbols(F.when(own, F.col(column)))))
        else:
            found.append((own, symbols.native_symbols(F.col(column), lang)))
    df = df.withColumn("symbols", case(found, F.lit(None).cast(symbols.SYMBOL_TYPE)))
    return df.withColumn("parsed", F.col("symbols").isNotNull())


def symbol_rows(described: DataFrame) -> DataFrame:
    """(project, path, lang, kind, ordinal, name): ordinal counts inside a kind, in the order of appearance."""
    by_kind = described.select(
        "project", "path", "lang", F.explode_outer(F.array_distinct(F.transform("symbols", lambda s: s["kind"]))).alias("kind"), "symbols",
    ).filter(F.col("kind").isNotNull())
    names = F.transform(F.filter("symbols", lambda s: s["kind"] == F.col("kind")), lambda s: s["name"])
    return by_kind.select("project", "path", "lang", "kind", F.posexplode(names).alias("ordinal", "name"))


def symbol_counts(rows: DataFrame, kind: str) -> DataFrame:
    """Use of each name over all projects. Counting per project first keeps frequent names off one task."""
    per_project = rows.filter(F.col("kind") == kind).groupBy("lang", "name", "project").agg(F.count("*").alias("n"))
    return per_project.groupBy("lang", "name").agg(F.sum("n").alias("n_uses"), F.count("*").alias("n_projects"))


_UNLIMITED = 2**31 - 1


def _section_table() -> str:
    """Sections per language as one constant: (kind, title, cap, unique)."""
    cases = []
    for lang, sections in rules.SUMMARY_SECTIONS.items():
        rows = ", ".join(
            f"named_struct('kind', '{kind}', 'title', {sql_string(title)}, 'cap', {cap or _UNLIMITED}, 'uniq', {str(unique).lower()})"
            for kind, title, cap, unique in sections
        )
        cases.append(f"WHEN '{lang}' THEN array({rows})")
    return "CASE lang " + " ".join(cases) + " END"


def _sections() -> Column:
    """Text of all sections of a row from its ``symbols``, ``_effects`` and ``_risks``; empty when there are none.

    Written as one SQL expression over the constant table, which keeps the plan small.
    """
    named = (
        f"transform({_section_table()}, s -> named_struct('title', s.title, 'cap', s.cap, 'uniq', s.uniq, "
        "'names', transform(filter(symbols, x -> x.kind = s.kind), x -> x.name)))"
    )
    capped = (
        f"transform({named}, s -> named_struct('title', s.title, "
        "'names', slice(IF(s.uniq, array_distinct(s.names), s.names), 1, s.cap)))"
    )
    every = (
        f"concat({capped}, array(named_struct('title', 'External / Side Effects', 'names', _effects), "
        "named_struct('title', 'Potential Risk Areas', 'names', _risks)))"
    )
    lines = "concat(s.title, ':\n', array_join(transform(s.names, n -> concat('  - ', n)), '\n'))"
    return F.expr(f"array_join(transform(filter({every}, s -> size(s.names) > 0), s -> {lines}), '\n\n')")


def summary_text(column: str = "content_preview") -> Column:
    """Summary of one file from its own columns: no join and no shuffle."""
    path, size, content = F.col("path"), F.col("size"), F.col(column)
    header = F.concat(
        F.lit("### "), path, F.lit("\nType: "), paths.file_type_label(F.col("extension")), F.lit("  Size: "),
        paths.size_kb_text(size, 1), F.lit(" KB  Priority: "), F.col("priority_score"), F.lit("\n"),
    )
    tier, kb = paths.size_tier(size), paths.size_kb_text(size, 0)
    warning = (
        F.when(tier == "critical", text.filled(rules.SUMMARY_CRITICAL, path, kb))
        .when(tier == "large", text.filled(rules.SUMMARY_LARGE, path, kb))
        .otherwise("")
    )
    broken = F.concat(F.lit("Parse error. Preview:\n"), text.preview_lines(content, rules.PARSE_ERROR_LINES, keep_blank=True))
    nothing = case((F.col("lang") == lang, shown) for lang, shown in rules.NOTHING_FOUND.items())
    body = case(
        [((F.col("lang") == "python") & ~F.col("parsed"), broken),
         (F.col("lang").isNotNull(), F.coalesce(F.nullif("_sections", F.lit("")), nothing))],
        F.concat(F.lit("Preview:\n"), text.preview_lines(content)),
    )
    return F.concat(header, warning, body)


def structural_summaries(selected: DataFrame, languages: Iterable[str] = tuple(rules.LANGUAGE_SUFFIXES)) -> DataFrame:
    """Add ``summary`` to selected files; files without text have none."""
    described = with_symbols(_with_text(selected), languages)
    # lower case once per text, not once per searched word
    described = described.withColumn("_low", F.lower("content_preview"))
    content, low = F.col("content_preview"), F.col("_low")
    effects = case(
        (F.col("lang") == lang, text.side_effects(content, lang, low)) for lang in rules.LANGUAGE_SUFFIXES
    )
    risks = F.when(F.col("lang").isNotNull(), text.risk_keywords(content, low=low))
    described = described.withColumn("_effects", effects).withColumn("_risks", risks)
    described = described.withColumn("_sections", _sections())
    return described.withColumn("summary", summary_text()).drop("_low", "_effects", "_risks", "_sections")


def large_file_note(path: Column, size: Column) -> Column:
    tier, kb = paths.size_tier(size), paths.size_kb_text(size, 0)
    return F.when(tier == "critical", text.filled(rules.NOTE_CRITICAL, path, kb)).when(
        tier == "large", text.filled(rules.NOTE_LARGE, path, kb)
    )


def _with_text(selected: DataFrame) -> DataFrame:
    """Files whose text is not empty.

    As a plain filter the length would be pushed below the redaction steps. Each step names the text before it three
    times, so the condition would hold the first text three to the power of the number of rules. The outer explode of
    one element keeps the filter above them.
    """
    there = selected.select("*", F.explode_outer(F.array(F.length("content_preview") > 0)).alias("_there"))
    return there.filter("_there").drop("_there")


def large_file_notes(selected: DataFrame) -> DataFrame:
    return _with_text(selected).select(
        "project", "path", "rank", large_file_note(F.col("path"), F.col("size")).alias("note")
    ).filter(F.col("note").isNotNull())


def module_rollup(selected: DataFrame) -> DataFrame:
    """Selected files with text by first path segment; the selection bounds the list."""
    selected = _with_text(selected)
    listed = F.array_sort(F.collect_list(F.struct("rank", "path")))
    return selected.groupBy("project", paths.module(F.col("path")).alias("module")).agg(
        F.count("*").alias("n_files"), F.min("rank").alias("ord"),
        F.array_join(F.transform(listed, lambda r: r["path"]), ", ").alias("_files"),
    ).select("project", "module", "n_files", "ord", F.concat(F.lit("Module '"), "module", F.lit("': "), "_files").alias("text"))


def project_summary(tech: DataFrame, selected: DataFrame, mode: str = "fast") -> DataFrame:
    notes = large_file_notes(selected).groupBy("project").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "note"))), lambda r: F.concat(F.lit("- "), r["note"])), "\n"
    ).alias("_notes"))
    static = text.filled(rules.STATIC_SUMMARY, F.lit(mode), "tech_text")
    return tech.join(notes, "project", "left").select("project", F.concat(
        static, F.coalesce(F.concat(F.lit("\n\n## Large File Risks\n"), "_notes"), F.lit(""))
    ).alias("summary"))
