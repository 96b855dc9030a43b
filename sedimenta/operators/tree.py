"""Folder roll-up and printable folder tree, as rows.

A project may hold any number of files, so its tree is never assembled in one task: every line carries a
``sort_key`` and the sink sorts by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import paths
from sedimenta.operators.skew import salted_join, top_rows

# separators below every character that occurs in file names: level < spelling < name
_LEVEL, _SPELLING = "\u0001", "\u0002"


def _ancestors(path: Column) -> Column:
    """Folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )).otherwise(F.array().cast("array<string>"))


def dir_rollup(files: DataFrame) -> DataFrame:
    """Files and bytes below every folder."""
    return files.select("project", "size", F.explode(_ancestors(F.col("path"))).alias("folder")).groupBy("project", "folder").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_bytes")
    ).withColumn("depth", paths.depth(F.col("folder")) + 1)


def _part(name: Column, is_file: bool) -> Column:
    """Order inside a folder: folders first, then names without case, then spelling."""
    return F.concat(F.lit("1" if is_file else "0"), F.lower(name), F.lit(_SPELLING), name)


def _folder_key(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), lambda s: _part(s, False)), _LEVEL)


def _nodes(files: DataFrame, exclude: Sequence[str], max_depth: int) -> tuple[DataFrame, DataFrame]:
    pruned = paths.ignored_prefix(F.col("path"), exclude)
    visible = files.select("project", "path", pruned.alias("pruned"))
    shown = F.when(F.col("pruned") == "", F.col("path")).otherwise(F.col("pruned"))
    folders = (
        visible.select("project", F.explode(_ancestors(shown)).alias("path")).distinct()
        .filter(paths.depth(F.col("path")) <= max_depth)
        .select("project", "path", paths.folder(F.col("path")).alias("parent"), paths.file_name(F.col("path")).alias("name"),
                F.lit(False).alias("is_file"), _part(paths.file_name(F.col("path")), False).alias("part"))
    )
    leaves = visible.filter((F.col("pruned") == "") & (paths.depth(F.col("path")) <= max_depth)).select(
        "project", "path", paths.folder(F.col("path")).alias("parent"), paths.file_name(F.col("path")).alias("name"),
        F.lit(True).alias("is_file"), _part(paths.file_name(F.col("path")), True).alias("part"),
    )
    return folders, leaves


def dir_tree(files: DataFrame, exclude: Sequence[str] = (), max_depth: int = rules.TREE_DEPTH) -> DataFrame:
    """(project, sort_key, path, line): the lines of each project's tree, ordered by ``sort_key``."""
    folders, leaves = _nodes(files, exclude, max_depth)
    # last entry of every folder: a pre-aggregated maximum instead of a ranking per folder
    last = folders.select("project", "parent", "part").unionByName(leaves.select("project", "parent", "part")).groupBy(
        "project", "parent"
    ).agg(F.max("part").alias("last_part"))
    flagged = salted_join(folders, last, ["project", "parent"], ["path"]).select(
        "project", F.col("path").alias("above"), (F.col("part") == F.col("last_part")).alias("is_last")
    )
    chain = folders.select("project", "path", F.posexplode(F.concat(_ancestors(F.col("path")), F.array("path"))).alias("level", "above"))
    step = F.when(F.col("is_last"), "    ").otherwise("│   ")
    indents = salted_join(chain, flagged, ["project", "above"], ["path"]).groupBy("project", "path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", step.alias("s")))), lambda r: r["s"]), "").alias("indent")
    )
    parents = last.join(indents.select("project", F.col("path").alias("parent"), "indent"), ["project", "parent"], "left")
    nodes = folders.unionByName(leaves)
    joined = salted_join(nodes, parents, ["project", "parent"], ["path"])
    category = F.when(F.col("is_file"), paths.secret_file_category(F.col("path")))
    label = F.coalesce(F.concat(F.lit("[SECRET_FILE_SKIPPED: "), category, F.lit("]")), F.col("name"))
    connector = F.when(F.col("part") == F.col("last_part"), "└── ").otherwise("├── ")
    key = F.when(F.col("parent") == "", F.col("part")).otherwise(
        F.concat(_folder_key(F.col("parent")), F.lit(_LEVEL), "part")
    )
    lines = joined.select(
        "project", key.alias("sort_key"), "path", F.concat(F.coalesce("indent", F.lit("")), connector, label).alias("line")
    )
    roots = files.select("project").distinct().select(
        "project", F.lit("").alias("sort_key"), F.lit("").alias("path"), F.concat("project", F.lit("/")).alias("line")
    )
    return roots.unionByName(lines)


def tree_head(tree: DataFrame, chars: int) -> DataFrame:
    """The first ``chars`` characters of each tree, with a mark when it is longer.

    A line is at least five characters plus its line end, so ``chars // 6 + 2`` lines always suffice: a bounded
    top-k that never gathers a whole tree.
    """
    first = top_rows(tree.select("project", "sort_key", "line"), ["project"], [F.col("sort_key")], chars // 6 + 2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]), "\n")
    return first.groupBy("project").agg(text.alias("_head")).select(
        "project", F.when(F.length("_head") > chars, F.concat(F.substring("_head", 1, chars), F.lit("...[truncated]")))
        .otherwise(F.col("_head")).alias("tree_head"),
    )
