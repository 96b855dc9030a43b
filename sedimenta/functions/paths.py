"""Path expressions: parts, skip reasons, categories, priority and size labels (all native, no text read)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions.cases import case
from sedimenta.functions.dialect import portable


def normalized(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last ``.ext`` in lower case; empty for names without one or with only a leading dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def module(path: Column) -> Column:
    """First path segment, ``root`` for a file at the top."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("root"))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def normalize_excludes(names: Sequence[str], strict: bool = False) -> tuple[str, ...]:
    """Clean user folder names; ``strict`` rejects absolute and parent paths."""
    cleaned = []
    for name in names:
        value = name.strip().strip("/\\")
        if strict and value and (".." in value or re.match(r"^([/\\]|[A-Za-z]:[/\\])", value)):
            raise ValueError("folder names to exclude must be plain names")
        if value and value not in cleaned:
            cleaned.append(value)
    return tuple(cleaned)


def ignored_folder(segment: Column, exclude: Sequence[str] = ()) -> Column:
    return segment.isin(*rules.IGNORED_FOLDERS, *normalize_excludes(exclude))


def ignored_prefix_pattern(exclude: Sequence[str] = ()) -> str:
    names = "|".join(re.escape(n) for n in (*rules.IGNORED_FOLDERS, *normalize_excludes(exclude)))
    return rf"^((?:[^/]+/)*?(?:{names}))/"


def ignored_prefix(path: Column, exclude: Sequence[str] = ()) -> Column:
    """Path of the outermost ignored folder above the file, empty when there is none."""
    return F.regexp_extract(path, ignored_prefix_pattern(exclude), 1)


def is_env_file(path: Column) -> Column:
    return file_name(path).rlike(portable(rules.ENV_FILE_PATTERN))


def is_lock_file(path: Column) -> Column:
    return file_name(path).isin(*rules.LOCK_FILES)


def is_minified(path: Column) -> Column:
    return F.lower(file_name(path)).contains(".min.")


def is_allowed_extension(path: Column) -> Column:
    return (file_name(path) == "Dockerfile") | suffix(path).isin(*rules.READABLE_SUFFIXES)


def skip_reason(path: Column) -> Column:
    """First rule that excludes the file by its name, null for a readable file."""
    name, ext = file_name(path), suffix(path)
    return (
        F.when(is_env_file(path), "env_file")
        .when(name.isin(*rules.IGNORED_NAMES), "secret_file")
        .when(ext.isin(*rules.IGNORED_SUFFIXES), "secret_extension")
        .when(ext.isin(*rules.BINARY_SUFFIXES), "binary_or_asset")
        .when(is_lock_file(path), "lock_file")
        .when(is_minified(path), "minified")
        .when(~is_allowed_extension(path), "unsupported_extension")
    )


def secret_file_category(path: Column) -> Column:
    return (
        F.when(is_env_file(path), "env file")
        .when(suffix(path).isin(*rules.CERTIFICATE_SUFFIXES), "private key/certificate")
        .when(file_name(path).isin(*rules.SSH_KEY_NAMES), "credential file")
    )


def is_test_path(path: Column) -> Column:
    return path.contains(".test.") | path.contains(".spec.") | path.contains("/test")


def is_auth_path(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("auth") | low.contains("security")


def is_env_template(path: Column) -> Column:
    return path.contains(".env.example")


def is_enrichment_excluded(path: Column, size: Column) -> Column:
    """Too large or not worth a model call. Skipped files never reach this point."""
    low = F.lower(path)
    hit = F.lit(False)
    for needle in rules.ENRICHMENT_EXCLUDED:
        hit = hit | low.contains(needle)
    return hit | (size > rules.ENRICH_MAX_KB * 1024)


def priority_score(path: Column, patterns=rules.PRIORITY_PATTERNS, names=rules.PRIORITY_NAMES) -> Column:
    """Weight of a path: 5 for generated files, else the best matching rule, at least 10.

    Patterns of equal weight are one alternation and the weights are tried from high to low, so most rows stop
    early instead of running every pattern.
    """
    low = F.lower(normalized(path))
    by_weight: dict[int, list[str]] = {}
    for weight, pattern in patterns:
        by_weight.setdefault(weight, []).append(pattern)
    score = F.when(low.rlike("|".join(f"(?:{p})" for p in rules.LOW_PRIORITY_PATTERNS)), rules.LOW_PRIORITY_SCORE)
    named = file_name(low).isin(*names)
    for weight in sorted({*by_weight, rules.NAMED_FILE_SCORE}, reverse=True):
        hit = F.lit(False)
        if weight == rules.NAMED_FILE_SCORE:
            hit = named
        if weight in by_weight:
            hit = hit | low.rlike("|".join(f"(?:{p})" for p in by_weight[weight]))
        score = score.when(hit, weight)
    return score.otherwise(rules.DEFAULT_SCORE)


def file_type_label(ext: Column) -> Column:
    return case(((ext == known, text) for known, text in rules.TYPE_LABELS.items()), F.concat(ext, F.lit(" file")))


def size_tier(size: Column) -> Column:
    return F.when(size >= rules.CRITICAL_KB * 1024, "critical").when(size >= rules.LARGE_KB * 1024, "large")


def size_kb_text(size: Column, digits: int) -> Column:
    """Kilobytes with fixed digits; ties round to even as C-style formatting of exact binary values does."""
    return F.format_string(f"%.{digits}f", F.bround(size / F.lit(1024.0), digits))
