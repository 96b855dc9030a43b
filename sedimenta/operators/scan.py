"""Scan: one status row per file, secrets removed from the text that is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import paths, text
from sedimenta import rules
from sedimenta.functions.cases import case


def path_status(files: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Files plus one signal row per outermost ignored folder; reads no content.

    Rows below an ignored folder are folded into that folder's row. Only those narrow rows are shuffled; the
    kept files stay where they are.
    """
    located = files.withColumn("path", paths.normalized(F.col("path"))).withColumn(
        "_pruned", paths.ignored_prefix(F.col("path"), exclude)
    )
    kept = located.filter(F.col("_pruned") == "").select(
        "project", "path", paths.suffix(F.col("path")).alias("extension"), "size",
        paths.skip_reason(F.col("path")).alias("skipped_reason"),
    )
    return kept.unionByName(pruned_folders(files, exclude))


def pruned_folders(files: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    prefix = paths.ignored_prefix(paths.normalized(F.col("path")), exclude)
    return (
        files.select("project", prefix.alias("path")).filter(F.col("path") != "").distinct()
        .select("project", "path", F.lit("").alias("extension"), F.lit(0).cast("bigint").alias("size"),
                F.lit("ignored_folder").alias("skipped_reason"))
    )


def readable(files: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(project, given, path) of the files whose text is kept; ``given`` is the path as the table has it."""
    located = files.select("project", F.col("path").alias("given"), paths.normalized(F.col("path")).alias("path"), F.col("content").isNotNull().alias("_there"))
    return located.filter(
        F.col("_there") & (paths.ignored_prefix(F.col("path"), exclude) == "") & paths.skip_reason(F.col("path")).isNull()
    ).drop("_there")


def scan(
    files: DataFrame,
    exclude: Sequence[str] = (),
    max_chars: int | None = None,
    secret_rules=None,
) -> DataFrame:
    """Status rows with prepared text.

    Columns: project, path, extension, size, skipped_reason, content_preview, redacted, findings. Text of skipped
    files is dropped before any pattern runs. ``max_chars=None`` keeps whole texts; a mode's limit keeps head
    and tail. A file whose content is null could not be read and becomes a ``read_error`` row.
    """
    none_found = F.array().cast("array<struct<ord:int,finding_type:string,count:bigint>>")
    folders = pruned_folders(files, exclude).select(
        "*", F.lit(None).cast("string").alias("content_preview"), F.lit(False).alias("redacted"),
        none_found.alias("findings"),
    )
    return scanned_files(files, exclude, max_chars, secret_rules).unionByName(folders)


def scanned_files(files: DataFrame, exclude: Sequence[str] = (), max_chars: int | None = None, secret_rules=None) -> DataFrame:
    """The rows of ``scan`` that are files, without those of pruned folders."""
    located = files.withColumn("path", paths.normalized(F.col("path")))
    located = located.filter(paths.ignored_prefix(F.col("path"), exclude) == "")
    message = F.coalesce("read_error", F.lit("unreadable")) if "read_error" in files.columns else F.lit("unreadable")
    unreadable = F.when(F.col("content").isNull(), F.concat(F.lit("read_error: "), message))
    kept = located.select(
        "project", "path", paths.suffix(F.col("path")).alias("extension"), "size", "content",
        F.coalesce(paths.skip_reason(F.col("path")), unreadable).alias("skipped_reason"),
    )
    kept = kept.withColumn("_content", F.when(
        F.col("skipped_reason").isNull(), text.head_tail_truncate(F.col("content"), max_chars)
    )).drop("content")
    kept = text.with_redaction(kept, "_content", secret_rules)
    return kept.select(
        "project", "path", "extension", "size", "skipped_reason",
        F.col("redacted_text").alias("content_preview"), (F.size("findings") > 0).alias("redacted"), "findings",
    )


def findings(scanned: DataFrame) -> DataFrame:
    """One row per file and secret type.

    The outer explode keeps Spark from deriving a size filter, which it would push below the redaction steps and
    so run every pattern a second time.
    """
    rows = scanned.select("project", "path", F.explode_outer("findings").alias("f"))
    return rows.select(
        "project", "path", F.col("f.ord").alias("ord"), F.col("f.finding_type").alias("finding_type"),
        F.col("f.count").alias("count"),
    ).filter(F.col("count").isNotNull())


def skip_histogram(status: DataFrame) -> DataFrame:
    return status.filter(F.col("skipped_reason").isNotNull()).groupBy("project", "skipped_reason").agg(
        F.count("*").alias("n_files")
    )


def scan_stats(scanned: DataFrame) -> DataFrame:
    """Counts per project; found includes the signal rows of pruned folders."""
    return scanned.groupBy("project").agg(
        F.count("*").alias("files_found"),
        F.count_if(F.col("skipped_reason").isNull()).alias("files_scanned"),
        F.count_if(F.col("skipped_reason").isNotNull()).alias("files_skipped"),
        F.count_if("redacted").alias("files_redacted"),
        F.coalesce(
            F.bool_or((F.col("skipped_reason") == "env_file") & paths.is_env_template(F.col("path"))), F.lit(False)
        ).alias("env_template_skipped"),
    )


def redaction_totals(found: DataFrame) -> DataFrame:
    """Per project: rows, occurrences, files and types. Types are few, so their set stays small.

    Files are counted from the partial result per file, never from a set of all paths in one group.
    """
    per_file = found.groupBy("project", "path").agg(
        F.count("*").alias("rows"), F.sum("count").alias("occurrences"), F.collect_set("finding_type").alias("types")
    )
    return per_file.groupBy("project").agg(
        F.sum("rows").alias("finding_rows"), F.sum("occurrences").alias("total_redactions"),
        F.count("*").alias("affected_files"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), ", ").alias("finding_types"),
    )


def redaction_report(found: DataFrame, secret_rules=rules.SECRET_RULES) -> DataFrame:
    placeholder = case(((F.col("finding_type") == name, shown) for name, _, shown in secret_rules), rules.DEFAULT_PLACEHOLDER)
    return found.select("project", "path", "finding_type", "ord", "count", placeholder.alias("placeholder"))
