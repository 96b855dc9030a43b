"""Domain classification: evidence rows -> scores -> best domain per project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions.cases import case, sql_string
from sedimenta.functions import text
from sedimenta.functions.dialect import WORD
from sedimenta.operators.skew import salted_join


def domain_texts(projects: DataFrame, status: DataFrame, scanned: DataFrame, summaries: DataFrame, tech: DataFrame) -> DataFrame:
    """All searched texts as (project, channel, path, text).

    The path branch needs no content, the markdown branch filters before any pattern runs; both read only the
    columns they use. An absent summary table (dry run) is passed as an empty one.
    """
    nowhere = F.lit(None).cast("string").alias("path")
    symbols = F.col("summary").contains("Classes:") | F.col("summary").contains("Functions:")
    branches = [
        projects.select("project", F.lit("project_name").alias("channel"), nowhere, F.substring_index("project", "/", -1).alias("text")),
        status.select("project", F.lit("file_path").alias("channel"), "path", F.col("path").alias("text")),
        summaries.select(
            "project", F.when(symbols, "structure_symbols").otherwise("structure_body").alias("channel"), "path",
            F.col("summary").alias("text"),
        ),
        scanned.filter(F.col("extension") == ".md").select(
            "project", F.lit("markdown").alias("channel"), "path", F.col("content_preview").alias("text")
        ),
        tech.select("project", F.lit("dependencies").alias("channel"), nowhere, F.col("dependency_text").alias("text")),
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


# letters from rare to frequent; what is not listed is rarer still
_FREQUENT = "qjxzkwvybgpfmuhdclnrsoiaet-. "
_LEAST_FRAGMENT = 3


def _fragment(word: str) -> str:
    """The end of a word from its rarest letter on, three letters at least: any text with the word has it."""
    starts = range(max(1, len(word) - _LEAST_FRAGMENT + 1))
    return word[min(starts, key=lambda i: (_FREQUENT.find(word[i]), i)):]


def _escaped(word: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in word)


def _found_words(low: str, words: list[str], pattern: str, group: int, behind: Callable[[str], str]) -> str:
    """SQL array of what stands ``behind`` each different match of a pattern."""
    cases = " ".join(f"WHEN {sql_string(w)} THEN {behind(w)}" for w in words)
    return f"flatten(transform(array_distinct(regexp_extract_all({low}, {sql_string(pattern)}, {group})), w -> CASE w {cases} END))"


def indicator_hits(low: str, indicators=rules.DOMAIN_INDICATORS) -> Column:
    """Array of (domain, indicator, is_strong) found in a column of lower-cased text; no rule table is joined.

    Two passes over a text find everything. One takes out the whole-word indicators. The other takes out fragments of the
    rest at every place, overlapping ones too: a fragment begins with a word's rarest letter, so most places are given
    up at their first character, and the words are searched for only behind a fragment that was found.
    """
    rows: dict[str, list[str]] = {}
    for domain, (strong, weak) in indicators.items():
        for words, is_strong in ((strong, "true"), (weak, "false")):
            for word in words:
                if word:
                    rows.setdefault(word.lower(), []).append(
                        f"named_struct('domain', {sql_string(domain)}, 'indicator', {sql_string(word)}, 'is_strong', {is_strong})"
                    )
    whole = [w for w in rows if text.is_whole_word(w)]
    # of fragments that begin at one place the longest is found, which stands for those that it begins with
    fragments = sorted({_fragment(w) for w in rows if w not in whole}, key=lambda f: (-len(f), f))
    first = lambda ws: "(?=[" + "".join(_escaped(c) for c in sorted({w[0] for w in ws})) + "])"

    def tests(fragment: str) -> str:
        near = [w for w in rows if w not in whole and fragment.startswith(_fragment(w))]
        return "array_compact(array(" + ", ".join(f"IF(contains({low}, {sql_string(w)}), {row}, NULL)" for w in near for row in rows[w]) + "))"

    parts = []
    if whole:
        pattern = f"{first(whole)}(?<![{WORD}])(?:{'|'.join(whole)})(?![{WORD}])"
        parts.append(_found_words(low, whole, pattern, 0, lambda w: f"array({', '.join(rows[w])})"))
    if fragments:
        # by first letter, so that few alternatives are tried at a place
        letters = {c: [_escaped(f[1:]) for f in fragments if f[0] == c] for c in sorted({f[0] for f in fragments})}
        pattern = f"{first(fragments)}(?=({'|'.join(_escaped(c) + '(?:' + '|'.join(ends) + ')' for c, ends in letters.items())}))"
        parts.append(f"array_distinct({_found_words(low, fragments, pattern, 1, tests)})")
    none = "filter(array(named_struct('domain', '', 'indicator', '', 'is_strong', false)), x -> false)"
    return F.expr(f"coalesce(concat({', '.join(parts)}), {none})" if parts else none)


def _points() -> Column:
    return case(
        (F.col("channel") == channel, F.when(F.col("is_strong"), strong).otherwise(weak))
        for channel, (strong, weak) in rules.CHANNEL_POINTS.items()
    )


def _where() -> Column:
    body = F.when(F.col("channel") == "structure_symbols", "classes/funcs").otherwise("body")
    return (
        F.when(F.col("channel") == "project_name", F.lit("project name"))
        .when(F.col("channel") == "file_path", F.concat(F.lit("file path ("), "path", F.lit(")")))
        .when(F.col("channel").startswith("structure") & F.col("is_strong"), F.concat(F.lit("structure ("), body, F.lit(") in "), "path"))
        .when(F.col("channel").startswith("structure"), F.concat(F.lit("structure in "), "path"))
        .when(F.col("channel") == "markdown", F.concat(F.lit("markdown content in "), "path"))
        .otherwise(F.lit("dependencies/imports"))
    )


def domain_evidence(texts: DataFrame, indicators=rules.DOMAIN_INDICATORS) -> DataFrame:
    """One row per hit; only hits leave the scan, nothing is shuffled."""
    hits = texts.withColumn("_low", F.lower("text")).select(
        "project", "channel", "path", F.explode_outer(indicator_hits("_low", indicators)).alias("h")
    ).filter(F.col("h").isNotNull()).select("project", "h.*", "channel", "path")
    grade = F.when(F.col("is_strong"), "Strong").otherwise("Weak")
    return hits.withColumn("points", _points()).withColumn("evidence", F.concat(
        F.lit("["), grade, F.lit("] '"), "indicator", F.lit("' in "), _where(), F.lit(" (+"), "points", F.lit(")")
    ))


def domain_scores(evidence: DataFrame) -> DataFrame:
    """Sum of points, strong hits (per row, not per indicator) and the set of matched indicators."""
    return evidence.groupBy("project", "domain").agg(
        F.sum("points").alias("score"), F.count_if("is_strong").alias("strong_count"),
        F.array_sort(F.collect_set("indicator")).alias("matched"),
    ).withColumn("confidence", confidence(F.col("domain"), F.col("score"), F.col("strong_count")))


def confidence(domain: Column, score: Column, strong: Column) -> Column:
    return (
        F.when((score >= 12) & (strong >= 3), "high")
        .when((score >= 8) & (strong >= 2), "medium")
        .when((domain == "data_science") & (score >= 3) & (strong >= 1), "medium")
        .otherwise("low")
    )


def detect_domain(scores: DataFrame, projects: DataFrame, indicators=rules.DOMAIN_INDICATORS) -> DataFrame:
    """Best candidate per project by score, strong hits, confidence, list order; else generic."""
    order = case(((F.col("domain") == domain, i) for i, domain in enumerate(indicators)), len(indicators))
    best = scores.filter(F.col("confidence") != "low").groupBy("project").agg(F.max_by(
        F.struct("domain", "confidence", "score", "strong_count", "matched"),
        F.struct("score", "strong_count", (F.col("confidence") == "high").cast("int").alias("c"), (-order).alias("o")),
    ).alias("b"))
    return projects.select("project").join(best, "project", "left").select(
        "project", F.coalesce("b.domain", F.lit("generic")).alias("domain"),
        F.coalesce("b.confidence", F.lit("low")).alias("confidence"),
        F.coalesce("b.score", F.lit(0)).alias("score"), F.coalesce("b.strong_count", F.lit(0)).alias("strong_count"),
        F.coalesce("b.matched", F.array().cast("array<string>")).alias("matched"),
    )


def winning_evidence(evidence: DataFrame, detected: DataFrame) -> DataFrame:
    """Evidence rows of each project's detected domain, as rows because their number has no bound."""
    return salted_join(evidence, detected.select("project", "domain"), ["project", "domain"], ["path", "indicator"], "left_semi")
