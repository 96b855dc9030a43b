"""Technology detection.

Every file contributes a few facts out of a fixed vocabulary ("file:package.json", "js:react", ...). Facts are
reduced to one set per project in a single shuffle, pre-aggregated on the map side and bounded by the size of
the vocabulary; all rules are then evaluated on that set.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import paths, text
from sedimenta.functions.cases import sql_string, sql_strings


def _vocabulary(config_rules, gates) -> set[str]:
    wanted: set[str] = set()
    for _, _, _, facts in config_rules:
        wanted.update(facts)
    for any_of, none_of in gates.values():
        wanted.update(any_of)
        wanted.update(none_of)
    wanted.update(rules.TECH_BLOCKED_BY.values())
    return wanted


def _with(prefix: str, vocabulary: Iterable[str]) -> list[str]:
    return sorted(v[len(prefix):] for v in vocabulary if v.startswith(prefix))


def _dependency_names(content: Column, *fields: str) -> Column:
    """Keys of the named objects of a JSON manifest, each once."""
    parsed = text.parse_manifest(content, fields)
    return F.array_distinct(F.concat(*[F.coalesce(F.map_keys(parsed[f]), F.array().cast("array<string>")) for f in fields]))


def _kept(names: Column, prefix: str, vocabulary: set[str]) -> Column:
    known = _with(prefix, vocabulary)
    return F.transform(F.array_intersect(names, F.expr(sql_strings(known))), lambda n: F.concat(F.lit(prefix), n))


def config_facts(files: DataFrame, config_rules=rules.TECH_CONFIG_RULES, gates=rules.TECH_GATES) -> DataFrame:
    """(project, fact) rows from the unpruned file list and raw manifest text."""
    vocabulary = _vocabulary(config_rules, gates)
    path, name, content = F.col("path"), paths.file_name(F.col("path")), F.col("content")
    low = F.lower(content)
    empty = F.array().cast("array<string>")

    endings = [a for a in _with("any:", vocabulary) if a.startswith("*")]
    names = [a for a in _with("any:", vocabulary) if not a.startswith("*")]
    parts = [
        F.when(path.isin(*_with("file:", vocabulary)), F.array(F.concat(F.lit("file:"), path))),
        F.array_compact(F.array(*[F.when(name.endswith(e[1:]), F.lit(f"any:{e}")) for e in endings])),
        F.when(name.isin(*names), F.array(F.concat(F.lit("any:"), name))),
        F.when(path == "package.json", _kept(_dependency_names(content, "dependencies", "devDependencies"), "js:", vocabulary)),
        F.when(path == "composer.json", _kept(_dependency_names(content, "require", "require-dev"), "php:", vocabulary)),
        F.when(path == "requirements.txt", _kept(text.requirement_names(content), "py:", vocabulary)),
        F.when(path.isin("pyproject.toml", "Pipfile"), _kept(text.known_packages(content), "py:", vocabulary)),
    ]
    for source in sorted({t.split("|")[0] for t in _with("text:", vocabulary)}):
        needles = [t.split("|", 1)[1] for t in _with("text:", vocabulary) if t.split("|")[0] == source]
        where = {
            "schema.prisma": name == "schema.prisma",
            "docker-compose": path.isin("docker-compose.yml", "docker-compose.yaml"),
        }.get(source, path == source)
        parts.append(F.when(where, F.array_compact(F.array(*[
            F.when(low.contains(n), F.lit(f"text:{source}|{n}")) for n in needles
        ]))))
    facts = F.concat(*[F.coalesce(p, empty) for p in parts])
    return files.select("project", F.explode_outer(facts).alias("fact")).filter(F.col("fact").isNotNull())


def _any(low: Column, needles) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | low.contains(n)
    return hit


def _rule_hits(low: Column, rule_rows, prefix: str, also: dict[str, tuple[str, ...]]) -> list[Column]:
    out = []
    for i, (_, item, needles) in enumerate(rule_rows):
        hit = _any(low, needles)
        if item in also:
            hit = hit & _any(low, also[item])
        out.append(F.when(hit, F.lit(f"{prefix}{i}")))
    return out


def text_facts(scanned: DataFrame) -> DataFrame:
    """(project, fact) rows from prepared text: imports of .py files and named documents."""
    low = F.col("_low")
    empty = F.array().cast("array<string>")
    is_doc = F.lower(paths.file_name(F.col("path"))).isin(*rules.TECH_DOC_NAMES)
    # no filter on the text itself: Spark would push it below the redaction steps and run them twice
    imports = F.array_compact(F.array(*_rule_hits(low, rules.TECH_IMPORT_RULES, "imports:", rules.TECH_IMPORT_ALSO)))
    docs = F.array_compact(F.array(*_rule_hits(low, rules.TECH_DOC_RULES, "docs:", {})))
    readable = scanned.filter((F.col("extension") == ".py") | is_doc)
    readable = readable.select("project", "path", "extension", F.lower("content_preview").alias("_low"))
    return readable.select("project", F.explode_outer(F.concat(
        F.when(F.col("extension") == ".py", imports).otherwise(empty), F.when(is_doc, docs).otherwise(empty),
    )).alias("fact")).filter(F.col("fact").isNotNull())


def tech_items(
    files: DataFrame, scanned: DataFrame, config_rules=rules.TECH_CONFIG_RULES, gates=rules.TECH_GATES
) -> DataFrame:
    """(project, category, item, sources, ord): ``ord`` is the rule order inside a category."""
    facts = (
        config_facts(files, config_rules, gates).unionByName(text_facts(scanned))
        .groupBy("project").agg(F.collect_set("fact").alias("facts"))
    )
    table = F.expr("array(" + ", ".join(_rule_struct(*row) for row in _rule_table(config_rules, gates)) + ")")
    met = F.filter(table, lambda r: (
        ((F.size(r["gate"]) == 0) | F.arrays_overlap("facts", r["gate"]))
        & ((F.size(r["needs"]) == 0) | F.arrays_overlap("facts", r["needs"]))
        & ~F.arrays_overlap("facts", r["blocked"])
    ))
    rows = facts.select("project", F.explode_outer(met).alias("h")).filter(F.col("h").isNotNull())
    return rows.groupBy("project", F.col("h.category").alias("category"), F.col("h.item").alias("item")).agg(
        F.array_sort(F.collect_set("h.source")).alias("sources"), F.min("h.ord").alias("ord")
    )


def _rule_struct(ord_: int, category: str, item: str, source: str, gate, needs, blocked) -> str:
    texts = ", ".join(f"'{n}', {sql_string(v)}" for n, v in (("category", category), ("item", item), ("source", source)))
    lists = ", ".join(f"'{n}', {sql_strings(v)}" for n, v in (("gate", gate), ("needs", needs), ("blocked", blocked)))
    return f"named_struct('ord', {ord_}, {texts}, {lists})"


def _rule_table(config_rules, gates):
    """All rules in one shape; Spark folds the table into a single constant."""
    for ord_, (gate, category, item, needs) in enumerate(config_rules):
        any_of, none_of = gates[gate]
        blocked = [*none_of, *filter(None, [rules.TECH_BLOCKED_BY.get((category, item))])]
        yield ord_, category, item, "config", any_of, needs, blocked
    for source, offset, rule_rows in (("imports", 1000, rules.TECH_IMPORT_RULES), ("docs", 2000, rules.TECH_DOC_RULES)):
        for i, (category, item, _) in enumerate(rule_rows):
            yield offset + i, category, item, source, (), (f"{source}:{i}",), ()


def _ordered(column: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(column.isNotNull(), F.struct("ord", column.alias("v"))))), lambda r: r["v"])


def tech_wide(tech: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per project: an ordered array per category, the flat list and the one-line text."""
    with_sources = F.concat("item", F.lit(" ("), F.array_join("sources", ", "), F.lit(")"))
    wide = tech.groupBy("project").agg(
        *[_ordered(F.when(F.col("category") == c, F.col("item"))).alias(c) for c in rules.TECH_CATEGORIES],
        *[_ordered(F.when(F.col("category") == c, with_sources)).alias(f"{c}_table") for c in rules.TECH_CATEGORIES],
    )
    empty = F.array().cast("array<string>")
    wide = projects.select("project").join(wide, "project", "left")
    wide = wide.select("project", *[F.coalesce(c, empty).alias(c) for c in wide.columns[1:]])
    flat = F.concat(*map(F.col, rules.TECH_CATEGORIES))
    shown = ("languages", "frameworks", "databases", "tools", "testing_tools")
    labels = ("Languages", "Frameworks", "Databases", "Tools", "Testing")
    one_line = F.concat_ws("; ", *[
        F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "))) for c, label in zip(shown, labels)
    ])
    rows = F.concat_ws("\n", *[
        F.when(F.size(c) > 0, F.concat(F.lit(f"| {label} | "), F.array_join(f"{c}_table", ", "), F.lit(" |")))
        for c, label in zip(rules.TECH_CATEGORIES, rules.TECH_TABLE_LABELS)
    ])
    return wide.select(
        "project", *rules.TECH_CATEGORIES,
        F.array_join(flat, ", ").alias("all_detected"), F.array_join(flat, " ").alias("dependency_text"),
        (F.size(flat) == 0).alias("is_empty"),
        F.coalesce(F.nullif(one_line, F.lit("")), F.lit("Unknown")).alias("tech_text"),
        F.when(rows == "", F.lit("_No technologies detected._"))
        .otherwise(F.concat(F.lit("| Category | Detected |\n|---|---|\n"), rows)).alias("tech_table"),
    )
