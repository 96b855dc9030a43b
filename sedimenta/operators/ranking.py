"""Scores and top-k selections per project."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import paths
from sedimenta.operators import scan
from sedimenta.operators.skew import top_rows
from sedimenta.session import written


def with_priority(scanned: DataFrame) -> DataFrame:
    return scanned.withColumn("priority_score", paths.priority_score(F.col("path")))


def _best(paths_of: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows per project by score, ties by path. The rows carry no text."""
    return top_rows(with_priority(paths_of), ["project"], [F.col("priority_score").desc(), F.col("path")], k)


def top_files(scanned: DataFrame, k: int) -> DataFrame:
    """Best ``k`` readable files per project of a scan, ties by path.

    Only paths are ranked; the winners are then joined to their rows by project and path, which name a file.
    """
    rows = scanned.filter(F.col("skipped_reason").isNull())
    best = _best(rows.select("project", "path"), k)
    return rows.join(_renamed(best), _same_file(rows)).drop("_project", "_path")


def top_files_of(files: DataFrame, k: int, exclude: Sequence[str] = (), max_chars: int | None = None) -> DataFrame:
    """The rows of ``top_files`` over ``scan`` straight from files: ranked by path first, so that only the texts of at
    most ``k`` files per project are truncated and redacted."""
    # written, so that the plan of the files stands once in what follows
    best = written(_best(scan.readable(files, exclude), k), "winners")
    given = best.select(F.col("project").alias("_project"), F.col("given").alias("_path"))
    rows = scan.scanned_files(files.join(given, _same_file(files), "left_semi"), exclude, max_chars)
    return rows.join(_renamed(best.drop("given")), _same_file(rows)).drop("_project", "_path")


def _renamed(best: DataFrame) -> DataFrame:
    return best.withColumnsRenamed({"project": "_project", "path": "_path"})


def _same_file(rows: DataFrame):
    return rows["project"].eqNullSafe(F.col("_project")) & (rows["path"] == F.col("_path"))


def enrichment_candidates(selected: DataFrame, k: int) -> DataFrame:
    """Selected files worth a model call, re-ranked."""
    eligible = selected.filter(~paths.is_enrichment_excluded(F.col("path"), F.col("size"))).drop("rank")
    return top_rows(eligible, ["project"], [F.col("priority_score").desc(), F.col("path")], k)


def retain_newest(
    rows: DataFrame, keys: list[str], newest_first: list, max_rows: int = rules.RETAINED_MAX,
    batch: int = rules.RETAINED_BATCH,
) -> DataFrame:
    """Rows left after evicting the oldest ``batch`` rows while a group holds ``max_rows`` or more.

    The number kept follows from the group size n: with b = ceil((n - max + 1) / batch) evictions, the newest
    n - b * batch rows stay. It is always below ``max_rows``, so the ranking is a bounded top-k, and the sizes
    are an ordinary pre-aggregated count.
    """
    if max_rows < 1 or batch < 1:
        raise ValueError("max_rows and batch must be positive")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    evictions = F.ceil((F.col("_n") - max_rows + 1) / batch)
    keep = F.when(F.col("_n") >= max_rows, F.greatest(F.lit(0), F.col("_n") - evictions * batch)).otherwise(F.col("_n"))
    ranked = top_rows(rows, keys, newest_first, max_rows - 1, "_rank")
    kept = ranked.join(sizes.withColumn("_keep", keep), keys)
    return kept.filter(F.col("_rank") <= F.col("_keep")).drop("_rank", "_n", "_keep")


def retained_count(n: int, max_rows: int = rules.RETAINED_MAX, batch: int = rules.RETAINED_BATCH) -> int:
    return n if n < max_rows else max(0, n - math.ceil((n - max_rows + 1) / batch) * batch)


def output_count(target: str) -> int:
    return rules.REPORT_COUNT + (len(rules.TARGETS) if target == "all" else 1)


def dry_run_preview(selected: DataFrame, tech: DataFrame, projects: DataFrame, target: str = "all") -> DataFrame:
    """One row per project: the first selected files, the number not shown, detected items, expected outputs."""
    shown = F.col("rank") <= rules.REPORT_FILES
    line = F.struct("rank", F.concat(F.lit("["), F.col("priority_score"), F.lit("] "), "path").alias("line"))
    picked = selected.groupBy("project").agg(
        F.count("*").alias("n_selected"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, line))), lambda r: r["line"]), "\n").alias("files"),
    )
    return (
        projects.select("project").join(picked, "project", "left").join(tech.select("project", "all_detected"), "project", "left")
        .select(
            "project", F.coalesce("files", F.lit("(none)")).alias("files"),
            F.greatest(F.coalesce("n_selected", F.lit(0)) - rules.REPORT_FILES, F.lit(0)).alias("more_files"),
            F.coalesce(F.nullif("all_detected", F.lit("")), F.lit("Unknown")).alias("detected"),
            F.lit(output_count(target)).alias("estimated_outputs"),
        )
    )
