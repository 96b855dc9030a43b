"""Text expressions: decoding, truncation, redaction, keyword and indicator search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions.cases import sql_string
from sedimenta.functions.dialect import LINE_BREAK, SPACE, STRIP, WORD, portable


def decode_text(content: Column) -> Column:
    """Bytes -> text: invalid UTF-8 is dropped and every line end becomes ``\\n``."""
    text = content.cast("string")
    valid = F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    )
    return F.regexp_replace(valid, "\r\n?", "\n")


# objects of names and versions in the manifests that are read
MANIFEST_FIELDS = ("dependencies", "devDependencies", "require", "require-dev")


def parse_manifest(content: Column, fields: Sequence[str] = MANIFEST_FIELDS) -> Column:
    """Struct of maps from the named objects of a JSON manifest; of a key that occurs twice the last one counts.

    Null for text that is not one whole JSON object: inside brackets it would not be a list of one element.
    """
    whole = (F.json_array_length(F.concat(F.lit("["), content, F.lit("]"))) == 1) & F.trim(F.regexp_replace(content, r"\s+$", "")).endswith("}")
    return F.when(whole, F.from_json(content, ", ".join(f"`{f}` map<string,string>" for f in fields)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def _omitted(chars: Column) -> Column:
    return F.concat(F.lit("... [MIDDLE SECTION OMITTED — "), chars.cast("string"), F.lit(" chars] ..."))


def head_tail_truncate(text: Column, max_chars: int | None) -> Column:
    """Keep 70 % head and 30 % tail around a marker so that the result fits ``max_chars``; None keeps all."""
    if max_chars is None:
        return text
    length = F.length(text)
    if max_chars <= 0:
        return F.when(length > max_chars, _omitted(length)).otherwise(text)
    # the marker is 43 characters with its four line ends, plus the digits of the omitted count
    available = F.lit(max_chars) - F.length(_omitted(length)) - 4
    head = (available * F.lit(0.7)).cast("int")
    tail = available - head
    gap = F.lit("\n\n")
    cut = F.concat(
        F.substring(text, F.lit(1), head), gap, _omitted(length - available), gap,
        F.when(tail > 0, F.substring(text, length - tail + 1, tail)).otherwise(""),
    )
    return (
        F.when(length <= max_chars, text)
        .when(available <= 0, F.concat(gap, _omitted(length), gap))
        .otherwise(cut)
    )


def _replacement(placeholder: str) -> str:
    return "$1" + placeholder + "$3"


def redact_secrets(text: Column, secret_rules=rules.SECRET_RULES) -> Column:
    """Replace secret values, each rule working on the output of the one before."""
    for _, pattern, placeholder in secret_rules:
        text = F.regexp_replace(text, portable(pattern), _replacement(placeholder))
    return text


def may_hold_secret(text: Column, low: Column, rule: str) -> Column:
    """Cheap necessary condition for one rule: its words and signs stand in the text.

    ``low`` is the lower-cased text. Three letters that the patterns fold but lower case does not (long s, dotless
    i, dotted I) let a text pass.
    """
    odd = text.contains("ſ") | text.contains("ı") | text.contains("İ")
    needed = F.lit(True)
    for words in rules.SECRET_NEEDS[rule]:
        some = F.lit(False)
        for word in words:
            some = some | low.contains(word)
        needed = needed & some
    return needed | odd


def with_redaction(df: DataFrame, column: str, secret_rules=None) -> DataFrame:
    """Add ``redacted_text`` and ``findings`` (array of rule order, type and count) for ``column``.

    A text goes through a rule's pattern only if it may hold such a secret, and is written anew only where it does.
    Each rule is one projection: its count is taken on the text the previous rule left. Every step is referenced
    twice (count, replacement), so Spark keeps the projections apart and runs each pattern once instead of nesting the
    whole chain in every count.
    """
    kept = df.columns
    work = df
    if secret_rules is None:
        secret_rules = rules.SECRET_RULES
        work = work.withColumn("_low", F.lower(column))
        may = [may_hold_secret(F.col(column), F.col("_low"), name) for name, _, _ in secret_rules]
    else:
        may = [F.lit(True) for _ in secret_rules]
    work = work.select(*kept, F.col(column).alias("_t0"), *[m.alias(f"_may{i}") for i, m in enumerate(may)])
    for i, (_, pattern, placeholder) in enumerate(secret_rules):
        java, before, n = portable(pattern), F.col(f"_t{i}"), F.col(f"_n{i}")
        work = work.withColumn(f"_n{i}", F.when(F.col(f"_may{i}"), F.regexp_count(before, F.lit(java)))).withColumn(
            f"_t{i + 1}", F.when(n > 0, F.regexp_replace(before, java, _replacement(placeholder))).otherwise(before)
        )
    found = F.array_compact(F.array(*[
        F.when(F.col(f"_n{i}") > 0, F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("finding_type"), F.col(f"_n{i}").cast("long").alias("count"),
        ))
        for i, (name, _, _) in enumerate(secret_rules)
    ]))
    return work.select(*kept, F.col(f"_t{len(secret_rules)}").alias("redacted_text"), found.alias("findings"))


def has_suspicious_content(text: Column, secret_rules=rules.SECRET_RULES) -> Column:
    hit = F.lit(False)
    for _, pattern, _ in secret_rules:
        hit = hit | text.rlike(portable(pattern if pattern.startswith("(?i)") else "(?i)" + pattern))
    return hit


def words_present(low: Column, words: Sequence[str]) -> Column:
    """The listed words that occur in already lower-cased text, in list order."""
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))


def risk_keywords(text: Column, cap: int = rules.RISK_WORD_CAP, low: Column | None = None) -> Column:
    return F.slice(words_present(F.lower(text) if low is None else low, rules.RISK_WORDS), 1, cap)


def known_packages(text: Column) -> Column:
    return words_present(F.lower(text), rules.KNOWN_PACKAGES)


def requirement_names(text: Column) -> Column:
    """Package names of a requirements file: comments skipped, version and extras cut off."""
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda s: (s != "") & ~s.startswith("#"))
    return F.transform(lines, lambda s: F.lower(strip(F.regexp_extract(s, r"^(.*?)(==|>=|<=|\[|$)", 1))))


def indicator_pattern(indicator: str) -> str:
    return f"(?<![{WORD}]){indicator}(?![{WORD}])"


def is_whole_word(indicator: str) -> bool:
    """Short alphabetic indicators match whole words only."""
    return len(indicator) <= 4 and indicator.isalpha()


def indicator_test(low: str, indicator: str) -> str:
    """SQL condition on a column of lower-cased text: short alphabetic indicators match whole words, all others
    match as substrings. The substring test is cheap and rejects nearly every text before the pattern runs."""
    word = indicator.lower()
    if not word:
        return "false"
    test = f"contains({low}, {sql_string(word)})"
    if is_whole_word(word):
        return f"({test} AND {low} RLIKE {sql_string(indicator_pattern(word))})"
    return test


def match_indicator(low: str, indicator: str) -> Column:
    return F.expr(indicator_test(low, indicator))


def lines(text: Column) -> Column:
    """Lines without a trailing empty one, as ``str.splitlines`` gives them."""
    return _ended(F.split(text, LINE_BREAK))


def _ended(parts: Column) -> Column:
    # bound by a lambda, so that the text is split once wherever this stands
    return F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))[0]


def preview_lines(text: Column, n: int = rules.PREVIEW_LINES, keep_blank: bool = False) -> Column:
    """The first lines, indented; what follows them is not cut up."""
    parts = F.split(text, LINE_BREAK, n + 1)
    first = F.slice(_ended(parts) if keep_blank else parts, 1, n)
    if not keep_blank:
        first = F.filter(first, lambda s: s.rlike(f"[^{SPACE}]"))
    return F.array_join(F.transform(first, lambda s: F.concat(F.lit("  "), s)), "\n")


def clip(text: Column, n: int, ellipsis: str = "") -> Column:
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(cut, F.lit(ellipsis))).otherwise(text) if ellipsis else cut


def sha_key(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def side_effects(text: Column, language: str, low: Column | None = None) -> Column:
    """``low`` may name a column that already holds the lower-cased text."""
    low = F.lower(text) if low is None else low
    labels = []
    for label, exact, folded in rules.SIDE_EFFECTS[language]:
        hit = F.lit(False)
        for needle in exact:
            hit = hit | text.contains(needle)
        for needle in folded:
            hit = hit | low.contains(needle)
        labels.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*labels))


def filled(template: str, *values: Column | str) -> Column:
    """A fixed text whose braces are replaced by columns."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [F.col(value) if isinstance(value, str) else value, F.lit(part)]
    return F.concat(*out)
