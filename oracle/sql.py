"""DuckDB statements that state each query's result independently of the Spark plans."""

from __future__ import annotations

import re

from sedimenta import rules
from sedimenta.functions import labels
from sedimenta.functions.dialect import LINE_BREAK, STRIP, WORD, portable_re2
from sedimenta.functions.paths import ignored_prefix_pattern
from sedimenta.sources import corpus


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return q(portable_re2(pattern)[0])


def lst(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]" if values else "CAST([] AS VARCHAR[])"


def tup(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def with_(ctes: list[tuple[str, str]], body: str, recursive: bool = False) -> str:
    seen, parts = set(), []
    for name, sql in ctes:
        if name not in seen:
            seen.add(name)
            parts.append(f"{name} AS ({sql})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


# --- files -----------------------------------------------------------------------------------------

_SNIPS = "[" + ", ".join(lst(corpus.SNIPPETS.get(t, ("",))) for t in range(corpus.N_PATHS)) + "]"


def _json(text: str) -> str:
    for raw, escaped in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        text = f"replace({text}, {raw}, {escaped})"
    return text


FILES = ("files", f"""
SELECT {lst(corpus.PREFIXES)}[(g % {len(corpus.PREFIXES)}) + 1] || '_' || g AS project,
  CASE WHEN note THEN 'notes/page_' || t || '.md' ELSE {lst(corpus.PATHS)}[t + 1] END AS path,
  n_chars * 16 AS size, doc_id,
  CASE WHEN note THEN text
    WHEN t IN ({', '.join(map(str, corpus.JSON_PATHS))}) THEN '{{' || snip || ', "description": "' || {_json('text')} || '"}}'
    WHEN t IN ({', '.join(map(str, corpus.HASH_PATHS))}) THEN snip || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
    ELSE snip || chr(10) || text END AS content
FROM (SELECT *, (t * 31 + g * 17) % 5 = 0 AS note, snips[t + 1][(g % len(snips[t + 1])) + 1] AS snip
      FROM (SELECT doc_id, text, n_chars, doc_id % {corpus.N_PATHS} AS t, doc_id // {corpus.N_PATHS} AS g, {_SNIPS} AS snips FROM documents))
""")

NAME = "regexp_extract(path, '[^/]*$')"
EXT = f"lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1))"
PRUNED = f"regexp_extract(path, {q(ignored_prefix_pattern())}, 1)"
DEPTH = "(length(path) - length(replace(path, '/', '')))"
MODULE = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END"


def skip_reason() -> str:
    return f"""CASE WHEN regexp_matches({NAME}, {re2(rules.ENV_FILE_PATTERN)}) THEN 'env_file'
  WHEN {NAME} IN {tup(rules.IGNORED_NAMES)} THEN 'secret_file'
  WHEN {EXT} IN {tup(rules.IGNORED_SUFFIXES)} THEN 'secret_extension'
  WHEN {EXT} IN {tup(rules.BINARY_SUFFIXES)} THEN 'binary_or_asset'
  WHEN {NAME} IN {tup(rules.LOCK_FILES)} THEN 'lock_file'
  WHEN contains(lower({NAME}), '.min.') THEN 'minified'
  WHEN NOT ({NAME} = 'Dockerfile' OR {EXT} IN {tup(rules.READABLE_SUFFIXES)}) THEN 'unsupported_extension' END"""


SECRET_CATEGORY = f"""CASE WHEN regexp_matches({NAME}, {re2(rules.ENV_FILE_PATTERN)}) THEN 'env file'
  WHEN {EXT} IN {tup(rules.CERTIFICATE_SUFFIXES)} THEN 'private key/certificate'
  WHEN {NAME} IN {tup(rules.SSH_KEY_NAMES)} THEN 'credential file' END"""


def score() -> str:
    low = f"lower(path)"
    tests = " OR ".join(f"regexp_matches({low}, {q(p)})" for p in rules.LOW_PRIORITY_PATTERNS)
    points = ", ".join(f"CASE WHEN regexp_matches({low}, {q(p)}) THEN {s} ELSE 10 END" for s, p in rules.PRIORITY_PATTERNS)
    name = f"regexp_extract({low}, '[^/]*$')"
    return f"CASE WHEN {tests} THEN 5 ELSE greatest(10, {points}, CASE WHEN {name} IN {tup(rules.PRIORITY_NAMES)} THEN 80 ELSE 10 END) END"


def type_label(ext: str) -> str:
    cases = " ".join(f"WHEN {ext} = {q(k)} THEN {q(v)}" for k, v in rules.TYPE_LABELS.items())
    return f"CASE {cases} ELSE {ext} || ' file' END"


TIER = "CASE WHEN size >= 102400 THEN 'critical' WHEN size >= 51200 THEN 'large' END"


def status(exclude=()) -> list[tuple[str, str]]:
    pruned = f"regexp_extract(path, {q(ignored_prefix_pattern(exclude))}, 1)"
    return [FILES, ("status", f"""
SELECT project, path, {EXT} AS extension, size, {skip_reason()} AS skipped_reason FROM files WHERE {pruned} = ''
UNION ALL SELECT DISTINCT project, {pruned}, '', 0, 'ignored_folder' FROM files WHERE {pruned} <> ''""")]


# --- text ------------------------------------------------------------------------------------------


def truncated(text: str, cap: int | None) -> str:
    if cap is None:
        return text
    mark = lambda n: f"('... [MIDDLE SECTION OMITTED — ' || {n} || ' chars] ...')"
    if cap <= 0:
        return f"CASE WHEN length({text}) > {cap} THEN {mark(f'length({text})')} ELSE {text} END"
    gap = "chr(10) || chr(10)"
    avail = f"({cap} - length({mark(f'length({text})')}) - 4)"
    head = f"trunc({avail} * 0.7::DOUBLE)::BIGINT"
    tail = f"({avail} - {head})"
    return f"""CASE WHEN length({text}) <= {cap} THEN {text}
  WHEN {avail} <= 0 THEN {gap} || {mark(f'length({text})')} || {gap}
  ELSE substr({text}, 1, {head}) || {gap} || {mark(f'(length({text}) - {avail})')} || {gap}
    || CASE WHEN {tail} > 0 THEN right({text}, {tail}) ELSE '' END END"""


def redaction(source: str, keep: str, text: str) -> list[tuple[str, str]]:
    """Chain of CTEs ending in ``redacted`` with columns t8 and n0..n7."""
    steps, previous = [], f"(SELECT {keep}, {text} AS t0 FROM {source})"
    counts = ""
    for i, (_, pattern, placeholder) in enumerate(rules.SECRET_RULES):
        pat = re2(pattern)
        rep = q("\\1" + placeholder + "\\3")
        name = f"step{i + 1}"
        steps.append((name, f"""SELECT {keep}, regexp_replace(t{i}, {pat}, {rep}, 'g') AS t{i + 1}{counts},
  len(regexp_extract_all(t{i}, {pat})) AS n{i} FROM {previous}"""))
        previous, counts = name, counts + f", n{i}"
    steps.append(("redacted", "SELECT * FROM step8"))
    return steps


FOUND = " + ".join(f"coalesce(n{i}, 0)" for i in range(8)) + " > 0"


def findings_of(keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, {i} AS ord, '{name}' AS finding_type, n{i} AS count FROM redacted WHERE n{i} > 0"
        for i, (name, _, _) in enumerate(rules.SECRET_RULES)
    )


def scanned(cap: int | None = None) -> list[tuple[str, str]]:
    base = ("base", f"SELECT project, path, {EXT} AS extension, size, content, {skip_reason()} AS skipped_reason FROM files WHERE {PRUNED} = ''")
    text = truncated("CASE WHEN skipped_reason IS NULL THEN content END", cap)
    return [
        FILES, base, *redaction("base", "project, path, extension, size, skipped_reason", text),
        ("scanned", f"""
SELECT project, path, extension, size, skipped_reason, t8 AS content_preview, {FOUND} AS redacted FROM redacted
UNION ALL SELECT DISTINCT project, {PRUNED}, '', 0, 'ignored_folder', NULL, false FROM files WHERE {PRUNED} <> ''"""),
        ("findings", findings_of("project, path")),
    ]


def selected(k: int = 40) -> list[tuple[str, str]]:
    return [*scanned(), ("selected", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY priority_score DESC, path) AS rank
  FROM (SELECT *, {score()} AS priority_score FROM scanned WHERE skipped_reason IS NULL)) WHERE rank <= {k}""")]


def words(low: str, needles) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({low}, {q(w)}) THEN {q(w)} END" for w in needles) + "], lambda w: w IS NOT NULL)"


def risk_words(text: str) -> str:
    return f"({words(f'lower({text})', rules.RISK_WORDS)})[1:10]"


def effects(text: str, lang: str) -> str:
    items = []
    for label, exact, folded in rules.SIDE_EFFECTS[lang]:
        tests = [f"contains({text}, {q(n)})" for n in exact] + [f"contains(lower({text}), {q(n)})" for n in folded]
        items.append(f"CASE WHEN {' OR '.join(tests)} THEN {q(label)} END")
    return "list_filter([" + ", ".join(items) + "], lambda w: w IS NOT NULL)"


def lines(text: str) -> str:
    parts = f"regexp_split_to_array({text}, {q(LINE_BREAK)})"
    return f"(CASE WHEN ({parts})[-1] = '' THEN ({parts})[:-2] ELSE {parts} END)"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {q(STRIP)}, '', 'g')"


def preview(text: str, n: int = 15, keep_blank: bool = False) -> str:
    if keep_blank:
        return f"coalesce(array_to_string(['  ' || s for s in ({lines(text)})[1:{n}]], chr(10)), '')"
    return f"coalesce(array_to_string(['  ' || s for s in ({lines(text)})[1:{n}] if {strip('s')} <> ''], chr(10)), '')"


LANG = "CASE " + " ".join(f"WHEN extension IN {tup(s)} THEN {q(lang)}" for lang, s in rules.LANGUAGE_SUFFIXES.items()) + " END"


# --- symbols ---------------------------------------------------------------------------------------


# Python by line patterns: less than what the library reads (doc strings, brackets of any depth), the same on these tables
PATTERNS = rules.SYMBOL_PATTERNS | {
    "python_import": r"(?m)^([ \t]*)(?:import[ \t]+([^\n#;(]+)|from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;(]+))",
    "python_class": r"(?m)^([ \t]*)class[ \t]+(\w+)[ \t]*[(:]",
    "python_function": r"(?m)^([ \t]*)(async[ \t]+)?def[ \t]+(\w+)[ \t]*\(\s*((?:[^\s():][^()]*(?:\([^()]*\)[^()]*)*)?)\)",
    "python_function_start": r"(?m)^[ \t]*(?:async[ \t]+)?def\b",
    "python_decorators": r"(?m)^([ \t]*)(@[^\n]*\n(?:[ \t]*@[^\n]*\n)*)[ \t]*(?:async[ \t]+)?def[ \t]",
    "python_decorator": r"(?m)^[ \t]*@([\w.]+)",
    "python_env": r"(?:\.get|getenv)[ \t]*\(\s*['\"]([^'\"\n]*)['\"]",
}


def ex(key: str, group: int = 1, text: str = "content_preview", pattern: str | None = None) -> str:
    return f"regexp_extract_all({text}, {re2(pattern or PATTERNS[key])}, {group})"


def zipped(key: str, shape: str, groups=(1, 2), pattern: str | None = None, keep: str | None = None) -> str:
    """``shape`` and ``keep`` use {1}, {2}, {3} for the groups of one match."""
    def fill(s: str) -> str:
        for g in groups:
            s = s.replace("{%d}" % g, f"({ex(key, g, pattern=pattern)})[i]")
        return s

    cond = f" if {fill(keep)}" if keep else ""
    return f"[{fill(shape)} for i in range(1, len({ex(key, groups[0], pattern=pattern)}) + 1){cond}]"


def unique(name: str) -> str:
    return f"[{name}[i] for i in range(1, len({name}) + 1) if list_position({name}, {name}[i]) = i]"


def block_lines(word: str) -> str:
    texts = zipped("go_declaration_block", "{2}", keep="{1} = '%s'" % word)
    rows = f"flatten([regexp_split_to_array(b, {q(LINE_BREAK)}) for b in {texts}])"
    return f"[substr({strip('s')}, 1, 80) for s in {rows} if {strip('s')} <> '' AND NOT starts_with({strip('s')}, '//')]"


def call(n: int, name: str = "{1}", args: str = "{2}", stripped: bool = False) -> str:
    cut = f"substr({args}, 1, {n})"
    return f"{name} || '(' || {strip(cut) if stripped else cut} || ')'"


def deep(key: str, shape: str, groups, keep: str | None = None) -> str:
    """Like ``zipped``, in order of the indent (group 1) and then of the text."""
    made = zipped(key, "{'d': length({1}), 'i': i, 'v': %s}" % shape, groups, keep=keep)
    return f"[s.v for s in list_sort({made})]"


def python_args(args: str) -> str:
    plain = f"regexp_replace({args}, '{PYTHON_COMMENT}', '', 'g')"
    for _ in range(2):
        plain = f"regexp_replace({plain}, {q(PYTHON_BRACKETS)}, '', 'g')"
    names = f"list_filter([{strip(chr(114) + 'egexp_extract(a, ' + q('^[^:=]*') + ')')} for a in string_split({plain}, ',')], lambda x: x <> '')"
    cut = f"list_reduce({names}, lambda acc, x: CASE WHEN acc[-1:] = '*' OR x[1] = '*' THEN rtrim(acc, '*') || '*' WHEN x = '/' THEN '' ELSE acc || ',' || x END, '')"
    positional = f"list_filter(string_split(rtrim({cut}, '*'), ','), lambda x: x <> '')"
    return f"array_to_string(CASE WHEN len({positional}) > 4 THEN list_append(({positional})[1:4], '...') ELSE {positional} END, ', ')"


def python_parses(text: str = "content_preview") -> str:
    return f"len({ex('python_function_start', 0)}) = len({ex('python_function', 0)})"


PYTHON_COMMENT = "#[^\n]*"
PYTHON_BRACKETS = r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}"
_PY_LISTED = f"string_split(regexp_replace(coalesce({{2}}, '') || coalesce({{4}}, ''), '{PYTHON_COMMENT}|[()\\\\]', '', 'g'), ',')"
_PY_MODULE = "regexp_replace(coalesce({3}, ''), '^[.]+', '')"
_PY_NAMES = f"[CASE WHEN {_PY_MODULE} = '' THEN '' ELSE {_PY_MODULE} || '.' END || {strip('regexp_replace(' + strip('n') + ', ' + q('(?s)[ \t]+as[ \t].*$') + ', ' + chr(39) * 2 + ')')} for n in {_PY_LISTED} if {strip('n')} <> '']"
_PY_CALL = "{3} || '(' || " + python_args("{4}") + " || ')'"
_PY_MARKS = deep("python_decorators", f"regexp_extract_all({{2}}, {re2(PATTERNS['python_decorator'])}, 1)", (1, 2))
_ANY_FUNCTION = r"(async\s)?function\s+(\w+)\s*\(([^)]*)\)"
KINDS = {
    "python": {
        "import": f"flatten({deep('python_import', _PY_NAMES, (1, 2, 3, 4))})", "class": deep("python_class", "{2}", (1, 2)),
        "function": deep("python_function", _PY_CALL, (1, 2, 3, 4), "coalesce({2}, '') = ''"),
        "async_function": deep("python_function", _PY_CALL, (1, 2, 3, 4), "coalesce({2}, '') <> ''"),
        "env": ex("python_env"), "decorator": unique(f"(flatten({_PY_MARKS}))"),
    },
    "js": {
        "import": ex("js_import"), "export": ex("js_export"), "class": ex("js_class"),
        "async_function": f"list_concat({zipped('js_async_named', call(40))}, {zipped('js_async_arrow', call(40))})",
        "function": zipped("js_function", call(40, "{2}", "{3}"), (1, 2, 3), _ANY_FUNCTION, "coalesce({1}, '') = ''"),
        "route": zipped("js_route", "upper({1}) || ' ' || {2}"), "env": ex("js_env"),
    },
    "go": {
        "package": f"({ex('go_package')})[1:1]",
        "import": f"list_concat(flatten([{ex('go_import_item', 1, 'b')} for b in {ex('go_import_block')}]), {ex('go_import_single')})",
        "type": zipped("go_type", "{1} || ' ' || {2}"),
        "function": zipped("go_function", call(60, stripped=True)),
        "constant": f"list_concat({block_lines('const')}, {ex('go_const')})",
        "variable": f"list_concat({block_lines('var')}, {ex('go_var')})",
        "route": zipped("go_route", "CASE WHEN {1} = 'HandleFunc' THEN 'ANY' ELSE upper({1}) END || ' ' || {2}"),
        "env": ex("go_env"),
    },
    "rust": {
        "import": f"[{strip('s')} for s in {ex('rust_use')}]", "module": ex("rust_module"),
        "type": zipped("rust_type", "{2} || ' ' || {1}"), "impl": f"[{strip('s')} for s in {ex('rust_impl')}]",
        "function": zipped("rust_function",
                           "CASE WHEN contains({1}, 'pub') THEN 'pub ' ELSE '' END || CASE WHEN contains({1}, 'async') THEN 'async ' ELSE '' END || "
                           + call(60, "{2}", "{3}", True), (1, 2, 3)),
        "env": f"list_concat({ex('rust_env_var')}, {ex('rust_env_macro')})",
    },
    "ruby": {
        "import": ex("ruby_require"), "module": ex("ruby_module"),
        "class": zipped("ruby_class", "{1} || CASE WHEN coalesce({2}, '') <> '' THEN ' < ' || {2} ELSE '' END"),
        "function": zipped("ruby_method", "{1} || '(' || substr(" + strip("coalesce({2}, '') || coalesce({3}, '')") + ", 1, 60) || ')'", (1, 2, 3)),
        "attribute": zipped("ruby_attribute", "{1} || ' ' || substr(" + strip("{2}") + ", 1, 80)"),
        "association": zipped("ruby_association", "{1} || ' :' || {2}"),
        "route": f"list_concat({zipped('ruby_route', 'upper({1}) || chr(32) || {2}')}, ['RESOURCES ' || r for r in {ex('ruby_resource')}])",
        "env": f"list_concat({ex('ruby_env_index')}, {ex('ruby_env_fetch')})",
    },
}


def symbol_lists(lang: str, source: str = "scanned") -> tuple[str, str]:
    columns = ", ".join(f"{expr} AS k_{kind}" for kind, expr in KINDS[lang].items())
    columns += f", {python_parses() if lang == 'python' else 'true'} AS parsed"
    return (f"lists_{lang}", f"SELECT * FROM (SELECT *, {columns} FROM {source} WHERE extension IN {tup(rules.LANGUAGE_SUFFIXES[lang])} AND content_preview IS NOT NULL)")


def symbol_rows(lang: str) -> str:
    return " UNION ALL ".join(
        f"SELECT project, path, '{lang}' AS lang, '{kind}' AS kind, unnest(range(0, len(k_{kind}))) AS ordinal, unnest(k_{kind}) AS name FROM lists_{lang} WHERE parsed"
        for kind in KINDS[lang]
    )


def all_symbols() -> list[tuple[str, str]]:
    return [*scanned(), *[symbol_lists(lang) for lang in KINDS], ("symbols", " UNION ALL ".join(symbol_rows(lang) for lang in KINDS))]


def symbol_counts(kind: str) -> str:
    return with_(all_symbols(), f"SELECT lang, name, count(*) AS n_uses, count(DISTINCT project) AS n_projects FROM symbols WHERE kind = '{kind}' GROUP BY ALL")


def _section(title: str, names: str) -> str:
    return f"CASE WHEN len({names}) > 0 THEN '{title}:' || chr(10) || array_to_string(['  - ' || n for n in {names}], chr(10)) END"


def summaries() -> list[tuple[str, str]]:
    header = f"""'### ' || path || chr(10) || 'Type: ' || {type_label('extension')} || '  Size: ' || printf('%.1f', size / 1024.0::DOUBLE) || ' KB  Priority: ' || priority_score || chr(10)"""
    kb = "printf('%.0f', size / 1024.0::DOUBLE)"
    warning = f"""CASE WHEN size >= 102400 THEN '⚠ HIGH PRIORITY ARCHITECTURE RISK: ' || path || ' is ' || {kb} || ' KB. This likely violates single-responsibility. Recommend splitting into focused modules.' || chr(10) || chr(10)
  WHEN size >= 51200 THEN '⚠ Large File Risk: ' || path || ' is ' || {kb} || ' KB. May indicate too many responsibilities. Recommend splitting orchestration, config, and business logic.' || chr(10) || chr(10) ELSE '' END"""
    ctes = [*selected()]
    parts = []
    for lang in KINDS:
        ctes.append(symbol_lists(lang, "selected"))
        sections = []
        for kind, title, cap, uniq in rules.SUMMARY_SECTIONS[lang]:
            names = f"k_{kind}"
            if uniq:
                names = f"({unique(names)})"
            sections.append(_section(title, f"({names})[1:{cap}]" if cap else names))
        sections.append(_section("External / Side Effects", effects("content_preview", lang)))
        sections.append(_section("Potential Risk Areas", risk_words("content_preview")))
        body = f"coalesce(nullif(concat_ws(chr(10) || chr(10), {', '.join(sections)}), ''), {q(rules.NOTHING_FOUND[lang])})"
        broken = f"'Parse error. Preview:' || chr(10) || {preview('content_preview', 10, keep_blank=True)}"
        body = f"CASE WHEN parsed THEN {body} ELSE {broken} END"
        parts.append(f"SELECT project, path, '{lang}' AS lang, {header} || {warning} || {body} AS summary FROM lists_{lang} WHERE length(content_preview) > 0")
    known = tuple(s for suffixes in rules.LANGUAGE_SUFFIXES.values() for s in suffixes)
    parts.append(f"""SELECT project, path, NULL AS lang, {header} || {warning} || 'Preview:' || chr(10) || {preview('content_preview')} AS summary
  FROM selected WHERE extension NOT IN {tup(known)} AND length(content_preview) > 0""")
    return [*ctes, ("summaries", " UNION ALL ".join(parts))]


# --- technology ------------------------------------------------------------------------------------


def tech() -> list[tuple[str, str]]:
    vocab = {f for _, _, _, fs in rules.TECH_CONFIG_RULES for f in fs}
    for a, b in rules.TECH_GATES.values():
        vocab |= {*a, *b}
    of = lambda p: sorted(v[len(p):] for v in vocab if v.startswith(p))
    parts = [f"SELECT project, 'file:' || path AS fact FROM files WHERE path IN {tup(of('file:'))}"]
    for name in of("any:"):
        test = f"ends_with(path, {q(name[1:])})" if name.startswith("*") else f"{NAME} = {q(name)}"
        parts.append(f"SELECT project, {q('any:' + name)} FROM files WHERE {test}")
    for path, prefix, fields in (("package.json", "js:", ("dependencies", "devDependencies")), ("composer.json", "php:", ("require", "require-dev"))):
        for field in fields:
            parts.append(f"""SELECT project, '{prefix}' || k FROM (SELECT project, unnest(json_keys(content::JSON, '$."{field}"')) AS k
  FROM files WHERE path = '{path}' AND json_valid(content)) WHERE k IN {tup(of(prefix))}""")
    parts.append(f"""SELECT project, 'py:' || package FROM ({REQUIREMENTS}) WHERE package IN {tup(of('py:'))}""")
    for name in sorted(set(rules.KNOWN_PACKAGES) & set(of("py:"))):
        parts.append(f"SELECT project, {q('py:' + name)} FROM files WHERE path IN ('pyproject.toml', 'Pipfile') AND contains(lower(content), {q(name)})")
    for text in of("text:"):
        source, needle = text.split("|", 1)
        where = {"schema.prisma": f"{NAME} = 'schema.prisma'", "docker-compose": "path IN ('docker-compose.yml', 'docker-compose.yaml')"}.get(source, f"path = {q(source)}")
        parts.append(f"SELECT project, {q('text:' + text)} FROM files WHERE {where} AND contains(lower(content), {q(needle)})")
    for i, (_, item, needles) in enumerate(rules.TECH_IMPORT_RULES):
        test = " OR ".join(f"contains(lower(content_preview), {q(n)})" for n in needles)
        if item in rules.TECH_IMPORT_ALSO:
            test = f"({test}) AND (" + " OR ".join(f"contains(lower(content_preview), {q(n)})" for n in rules.TECH_IMPORT_ALSO[item]) + ")"
        parts.append(f"SELECT project, 'imports:{i}' FROM scanned WHERE extension = '.py' AND ({test})")
    for i, (_, _, needles) in enumerate(rules.TECH_DOC_RULES):
        test = " OR ".join(f"contains(lower(content_preview), {q(n)})" for n in needles)
        parts.append(f"SELECT project, 'docs:{i}' FROM scanned WHERE lower({NAME}) IN {tup(rules.TECH_DOC_NAMES)} AND ({test})")
    rows = []
    for i, (gate, category, item, needs) in enumerate(rules.TECH_CONFIG_RULES):
        any_of, none_of = rules.TECH_GATES[gate]
        blocked = [*none_of, *filter(None, [rules.TECH_BLOCKED_BY.get((category, item))])]
        rows.append(f"({i}, {q(category)}, {q(item)}, 'config', {lst(any_of)}, {lst(needs)}, {lst(blocked)})")
    for source, offset, rule_rows in (("imports", 1000, rules.TECH_IMPORT_RULES), ("docs", 2000, rules.TECH_DOC_RULES)):
        for i, (category, item, _) in enumerate(rule_rows):
            rows.append(f"({offset + i}, {q(category)}, {q(item)}, '{source}', {lst(())}, {lst([f'{source}:{i}'])}, {lst(())})")
    ordered = lambda c: f"string_agg(item, ', ' ORDER BY ord) FILTER (category = '{c}')"
    table = lambda c: f"string_agg(item || ' (' || sources || ')', ', ' ORDER BY ord) FILTER (category = '{c}')"
    columns = ", ".join(f"{ordered(c)} AS {c}, {table(c)} AS {c}_table" for c in rules.TECH_CATEGORIES)
    shown = (("languages", "Languages"), ("frameworks", "Frameworks"), ("databases", "Databases"), ("tools", "Tools"), ("testing_tools", "Testing"))
    one_line = ", ".join(f"'{label}: ' || {c}" for c, label in shown)
    rows_text = ", ".join(f"'| {label} | ' || {c}_table || ' |'" for c, label in zip(rules.TECH_CATEGORIES, rules.TECH_TABLE_LABELS))
    return [
        *scanned(), ("facts", "SELECT project, list(DISTINCT fact) AS facts FROM (" + " UNION ALL ".join(parts) + ") GROUP BY project"),
        ("tech_rules", "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(ord, category, item, source, gate, needs, blocked)"),
        ("tech", """SELECT project, category, item, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources, min(ord) AS ord
FROM facts, tech_rules WHERE (len(gate) = 0 OR list_has_any(facts, gate)) AND (len(needs) = 0 OR list_has_any(facts, needs)) AND NOT list_has_any(facts, blocked)
GROUP BY project, category, item"""),
        ("tech_wide0", f"SELECT project, {columns} FROM tech GROUP BY project"),
        ("tech_wide", f"""SELECT p.project, {', '.join(rules.TECH_CATEGORIES)}, concat_ws(', ', {', '.join(rules.TECH_CATEGORIES)}) AS all_detected,
  coalesce(nullif(concat_ws('; ', {one_line}), ''), 'Unknown') AS tech_text,
  CASE WHEN concat_ws('', {', '.join(c + '_table' for c in rules.TECH_CATEGORIES)}) = '' THEN '_No technologies detected._'
   ELSE '| Category | Detected |' || chr(10) || '|---|---|' || chr(10) || concat_ws(chr(10), {rows_text}) END AS tech_table
FROM (SELECT DISTINCT project FROM files) p LEFT JOIN tech_wide0 USING (project)"""),
    ]


REQUIREMENTS = f"""SELECT project, lower({strip("regexp_extract(s, '^(.*?)(==|>=|<=|\\[|$)', 1)")}) AS package FROM
 (SELECT project, {strip('l')} AS s FROM (SELECT project, unnest(regexp_split_to_array(content, {q(LINE_BREAK)})) AS l FROM files WHERE path = 'requirements.txt'))
 WHERE s <> '' AND NOT starts_with(s, '#')"""


# --- domain ----------------------------------------------------------------------------------------


def indicator_table() -> tuple[str, str]:
    rows = [
        f"({q(domain)}, {n}, {q(w)}, {is_strong}, {str(len(w) <= 4 and w.isalpha()).lower()})"
        for n, (domain, (strong, weak)) in enumerate(rules.DOMAIN_INDICATORS.items())
        for words_, is_strong in ((strong, "true"), (weak, "false")) for w in words_
    ]
    return ("indicators", "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(domain, domain_ord, indicator, is_strong, whole_word)")


def indicator_hits(source: str) -> list[tuple[str, str]]:
    """``hits``: rows of ``source`` (with a column ``low``) by indicator. Whole words are tested with constant patterns."""
    short = sorted({w for pair in rules.DOMAIN_INDICATORS.values() for words_ in pair for w in words_ if len(w) <= 4 and w.isalpha()})
    words_found = " UNION ALL ".join(
        f"SELECT *, {q(w)} AS word FROM lowered WHERE contains(low, {q(w)}) AND regexp_matches(low, {q(f'(?:^|[^{WORD}]){w}(?:$|[^{WORD}])')})" for w in short
    )
    return [
        indicator_table(), ("lowered", source),
        ("hits", f"""SELECT l.*, i.* FROM lowered l, indicators i WHERE NOT whole_word AND contains(low, indicator)
UNION ALL SELECT l.* EXCLUDE (word), i.* FROM ({words_found}) l JOIN indicators i ON i.whole_word AND i.indicator = l.word"""),
    ]


def evidence(texts: str) -> list[tuple[str, str]]:
    pts = " ".join(f"WHEN channel = '{c}' THEN CASE WHEN is_strong THEN {s} ELSE {w} END" for c, (s, w) in rules.CHANNEL_POINTS.items())
    where = """CASE channel WHEN 'project_name' THEN 'project name' WHEN 'file_path' THEN 'file path (' || path || ')'
  WHEN 'markdown' THEN 'markdown content in ' || path WHEN 'dependencies' THEN 'dependencies/imports'
  ELSE CASE WHEN NOT is_strong THEN 'structure in ' || path WHEN channel = 'structure_symbols' THEN 'structure (classes/funcs) in ' || path
    ELSE 'structure (body) in ' || path END END"""
    return [
        ("texts", texts), *indicator_hits("SELECT project, channel, path, lower(text) AS low FROM texts"),
        ("evidence", f"""SELECT *, '[' || CASE WHEN is_strong THEN 'Strong' ELSE 'Weak' END || '] ''' || indicator || ''' in ' || {where} || ' (+' || points || ')' AS evidence
FROM (SELECT *, CASE {pts} END AS points FROM hits)"""),
        ("scores", """SELECT *, CASE WHEN score >= 12 AND strong_count >= 3 THEN 'high' WHEN score >= 8 AND strong_count >= 2 THEN 'medium'
  WHEN domain = 'data_science' AND score >= 3 AND strong_count >= 1 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT project, domain, any_value(domain_ord) AS domain_ord, sum(points) AS score, count(*) FILTER (is_strong) AS strong_count,
  array_to_string(list_sort(list(DISTINCT indicator)), ', ') AS matched FROM evidence GROUP BY project, domain)"""),
        ("detected", """SELECT p.project, coalesce(domain, 'generic') AS domain, coalesce(confidence, 'low') AS confidence, coalesce(score, 0) AS score,
  coalesce(strong_count, 0) AS strong_count, coalesce(matched, '') AS matched
FROM (SELECT DISTINCT project FROM files) p LEFT JOIN (SELECT * FROM scores WHERE confidence <> 'low'
  QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, strong_count DESC, confidence = 'high' DESC, domain_ord) = 1) USING (project)"""),
    ]


STRUCTURE_CHANNEL = "CASE WHEN contains(summary, 'Classes:') OR contains(summary, 'Functions:') THEN 'structure_symbols' ELSE 'structure_body' END"


def whole_domain() -> list[tuple[str, str]]:
    return [*tech(), *status(), *summaries(), *evidence(f"""
SELECT project, {STRUCTURE_CHANNEL} AS channel, path, summary AS text FROM summaries UNION ALL
SELECT DISTINCT project, 'project_name' AS channel, NULL AS path, project AS text FROM files
UNION ALL SELECT project, 'file_path', path, path FROM status
UNION ALL SELECT project, 'markdown', path, content_preview FROM scanned WHERE extension = '.md'
UNION ALL SELECT project, 'dependencies', NULL, replace(all_detected, ', ', ' ') FROM tech_wide""")]


EVIDENCE = "SELECT project, domain, indicator, is_strong, channel, path, points, evidence FROM evidence"


# --- notes and context -----------------------------------------------------------------------------


def risk_notes() -> list[tuple[str, str]]:
    note = lambda i, test, text: f"SELECT project, {i} AS pos, {text} AS note FROM flags WHERE {test}"
    notes = [
        note(0, "n_findings > 0", """'WARNING: ' || n_findings || ' secret pattern(s) detected and redacted in ' || n_files || ' file(s): ' || first_files || CASE WHEN n_files > 5 THEN '...' ELSE '' END"""),
        note(1, "frameworks IS NOT NULL AND NOT coalesce(has_template, false)", "'No .env.example file detected — consider adding one to document required environment variables.'"),
        note(2, "NOT coalesce(has_tests, false) AND testing_tools IS NULL", "'No test files or testing tools detected — consider adding a test suite.'"),
        note(3, "NOT docker", "'No Docker configuration detected — containerization may improve deployment consistency.'"),
        note(4, "NOT coalesce(has_auth, false) AND frameworks IS NOT NULL", "'No explicit authentication/authorization files detected — verify auth implementation.'"),
        note(5, "n_redacted > 0", "n_redacted || ' source file(s) contained secrets that were redacted before analysis. Review these files and move secrets to environment variables.'"),
        note(6, "template_skipped", "'INFO: .env.example was skipped for safety. Environment templates are not read to prevent accidental secret exposure.'"),
    ]
    return [
        *selected(), *tech(),
        ("flags", """SELECT p.project, f.*, s.*, t.frameworks, t.testing_tools,
  EXISTS (SELECT 1 FROM tech x WHERE x.project = p.project AND category = 'tools' AND item = 'Docker') AS docker,
  EXISTS (SELECT 1 FROM scanned x WHERE x.project = p.project AND skipped_reason = 'env_file' AND contains(path, '.env.example')) AS template_skipped
FROM (SELECT DISTINCT project FROM files) p JOIN tech_wide t USING (project)
LEFT JOIN (SELECT project AS fp, count(*) AS n_findings, count(DISTINCT path) AS n_files,
  array_to_string(list_sort(list(DISTINCT path))[1:5], ', ') AS first_files FROM findings GROUP BY project) f ON fp = p.project
LEFT JOIN (SELECT project AS sp, bool_or(contains(path, '.env.example')) AS has_template,
  bool_or(contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '/test')) AS has_tests,
  bool_or(contains(lower(path), 'auth') OR contains(lower(path), 'security')) AS has_auth,
  count(*) FILTER (redacted) AS n_redacted FROM selected GROUP BY project) s ON sp = p.project"""),
        ("notes", "SELECT project, row_number() OVER (PARTITION BY project ORDER BY pos) - 1 AS ord, note FROM (" + " UNION ALL ".join(notes) + ")"),
    ]


def audit() -> list[tuple[str, str]]:
    def test(fact: str) -> str:
        kind, what = fact.split(":", 1)
        if kind == "file":
            return f"path = {q(what)}"
        if kind == "under":
            return f"(path = {q(what)} OR starts_with(path, {q(what + '/')}))"
        source, needle = what.split("|", 1)
        return f"(path = {q(source)} AND contains(content, {q(needle)}))"

    parts = []
    for i, (category, severity, title, detail, advice, any_of) in enumerate(rules.AUDIT_RULES):
        met = " OR ".join(map(test, any_of))
        parts.append(f"""SELECT DISTINCT project, {i} AS ord, {q(category)} AS category, {q(severity)} AS severity, {q(title)} AS title, {q(detail)} AS detail, {q(advice)} AS recommendation
 FROM files f WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.project = f.project AND ({met.replace('path', 'g.path').replace('content', 'g.content')}))""")
    return [FILES, ("audit", " UNION ALL ".join(parts))]


LARGE_NOTE = """CASE WHEN size >= 102400 THEN 'Large File Risk: ' || path || ' is ' || printf('%.0f', size / 1024.0::DOUBLE) || ' KB. This may indicate too many responsibilities in a single entry point. Recommendation: split orchestration, configuration, runtime loop, and business logic into separate modules.'
 WHEN size >= 51200 THEN 'Large File Warning: ' || path || ' is ' || printf('%.0f', size / 1024.0::DOUBLE) || ' KB. Consider splitting into smaller focused modules.' END"""


def tree() -> list[tuple[str, str]]:
    return [
        FILES,
        ("visible", f"SELECT project, path, {PRUNED} AS pruned, CASE WHEN {PRUNED} = '' THEN path ELSE {PRUNED} END AS shown FROM files"),
        ("nodes", f"""
SELECT DISTINCT project, array_to_string(parts[1:i], '/') AS path, true AS is_dir, i AS level FROM
  (SELECT project, parts, unnest(range(1, len(parts))) AS i FROM (SELECT project, string_split(shown, '/') AS parts FROM visible))
UNION ALL SELECT project, path, false, len(string_split(path, '/')) FROM visible WHERE pruned = ''"""),
        ("placed", f"""SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, {NAME} AS name, {SECRET_CATEGORY} AS category,
  row_number() OVER (PARTITION BY project, regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY is_dir, lower({NAME}) DESC, {NAME} DESC) = 1 AS is_last,
  row_number() OVER (PARTITION BY project, regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY is_dir DESC, lower({NAME}), {NAME}) AS pos
FROM nodes WHERE level <= {rules.TREE_DEPTH + 1}"""),
        ("walk", """
SELECT project, path, is_dir, name, category, is_last, '' AS indent, [pos] AS place FROM placed WHERE parent = ''
UNION ALL SELECT c.project, c.path, c.is_dir, c.name, c.category, c.is_last, w.indent || CASE WHEN w.is_last THEN '    ' ELSE '│   ' END, list_append(w.place, c.pos)
FROM walk w JOIN placed c ON c.project = w.project AND c.parent = w.path WHERE w.is_dir"""),
        ("tree", """SELECT project, path, place, indent || CASE WHEN is_last THEN '└── ' ELSE '├── ' END ||
  CASE WHEN NOT is_dir AND category IS NOT NULL THEN '[SECRET_FILE_SKIPPED: ' || category || ']' ELSE name END AS line FROM walk
UNION ALL SELECT DISTINCT project, '', [0], project || '/' FROM files"""),
    ]


def report_documents() -> list[tuple[str, str]]:
    """All report documents as lines, written out line by line."""
    from sedimenta.operators.reports import GENERATOR

    def fixed(report: str, block: int, parts: list, source: str = "facts_row") -> str:
        items = "list_filter([" + ", ".join(x if x.startswith(("(", "CASE")) else q(x) for x in parts) + "], lambda x: x IS NOT NULL)"
        return f"""SELECT project, '{report}' AS report, {block} AS block, lpad(unnest(range(0, len(a)))::VARCHAR, 4, '0') AS line_key, unnest(a) AS line
 FROM (SELECT project, {items} AS a FROM {source})"""

    footer = lambda report: fixed(report, 99, ["", "---", "", f"_Generated by {GENERATOR}_"])
    key = "path || chr(1) || ord"
    holders = " ".join(f"WHEN '{n}' THEN {q(p)}" for n, _, p in rules.SECRET_RULES)
    found = "'| `' || path || '` | ' || finding_type || ' | ' || count || ' |'"
    some, none = "(SELECT * FROM facts_row WHERE n_findings > 0)", "(SELECT * FROM facts_row WHERE n_findings = 0)"
    shown = list(zip(rules.TECH_CATEGORIES, rules.TECH_TABLE_LABELS))
    tech_rows = [f"('| {label} | ' || coalesce({c}, '_None detected_') || ' |')" for c, label in [*shown[:6], ("testing_tools", "Testing Tools")]]
    lists = ", ".join(f"'{c}': coalesce({c}_list, [])" for c in rules.TECH_CATEGORIES[:7])
    report = f"""to_json({{'scan_id': 'N/A', 'scanned_at': 'N/A', 'project_path': project, 'options': '{{}}'::JSON,
 'analysis': {{'mode': 'fast', 'evidence_level': 'limited', 'detected_domain': domain, 'domain_confidence': confidence, 'domain_score': score::BIGINT}},
 'statistics': {{'total_files_found': files_found, 'files_scanned': files_scanned, 'files_skipped': files_skipped, 'files_redacted': files_redacted, 'duration_seconds': 0.0::DOUBLE}},
 'ollama': {{'used': false, 'available': false, 'model': 'N/A', 'summarization_status': 'skipped_disabled'}}, 'tech_stack': {{{lists}}},
 'redaction': {{'total_findings': n_findings, 'total_redactions': coalesce(total_redactions, 0), 'n_affected_files': coalesce(n_affected, 0)}},
 'important_files': coalesce(files_list, []), 'risk_notes': coalesce(notes_list, []), 'assumptions': '[]'::JSON, 'generator': {q(GENERATOR)}, 'security_note': {q(rules.REPORT_SECURITY_NOTE)}}})::VARCHAR"""
    part = "CASE WHEN i = len(parts) AND NOT is_dir THEN '1' ELSE '0' END || lower(parts[i]) || chr(2) || parts[i]"
    parts = [
        fixed("project_summary", 0, [
            "# Project Summary", "", "('**Project Path:** `' || project || '`')", "**Scanned At:** N/A", "**Scan ID:** `N/A`", "", "---", "", "## Overview", "",
            "(summary)", "", "---", "", "## Technology Stack", "", *[f"CASE WHEN {c} IS NOT NULL THEN '- **{label}:** ' || {c} END" for c, label in shown[:7]],
            "CASE WHEN all_detected = '' THEN '_No technologies detected._' END", "", "---", "", "## Scan Statistics", "", "| Metric | Value |", "|---|---|",
            *[f"('| {label} | ' || {c} || ' |')" for label, c in (("Files Scanned", "files_scanned"), ("Files Skipped", "files_skipped"), ("Files Redacted", "files_redacted"))],
            "| Ollama Used | False |", "| Ollama Model | N/A |", "| Duration | 0.0s |",
        ]), footer("project_summary"), fixed("project_summary", 100, list(rules.REPORT_LOCAL_ONLY)),
        fixed("file_tree", 0, ["# File Tree", "", "```"]), fixed("file_tree", 2, ["```"]), footer("file_tree"),
        "SELECT project, 'file_tree', 1, line_key, line FROM tree_lines",
        fixed("tech_stack", 0, ["# Detected Technology Stack", "", "| Category | Detected Technologies |", "|---|---|", *tech_rows]),
        fixed("tech_stack", 1, ["", "---", "", "## Detection Method", "", *rules.REPORT_DETECTION_METHOD, ""]), fixed("tech_stack", 2, [f"_Generated by {GENERATOR}_"]),
        fixed("risk_notes", 0, ["# Risk Notes", "", rules.REPORT_RISK_INTRO, ""]),
        "SELECT project, 'risk_notes', 1, lpad(ord::VARCHAR, 3, '0'), '- ' || note FROM notes",
        fixed("risk_notes", 1, [rules.REPORT_RISK_NONE], "(SELECT * FROM facts_row WHERE n_notes = 0)"),
        fixed("risk_notes", 2, ["", "---", "", "## Redaction Summary", ""]),
        fixed("risk_notes", 3, ["('**' || n_findings || ' secret pattern(s) were detected and redacted.**')", "", "| File | Finding Type | Count |", "|---|---|---|"], some),
        f"SELECT project, 'risk_notes', 4, {key}, {found} FROM findings",
        fixed("risk_notes", 5, ["", rules.REPORT_RISK_REDACTED], some), fixed("risk_notes", 3, [rules.REPORT_REDACTED_NONE], none), footer("risk_notes"),
        fixed("redaction_report", 0, ["# Redaction Report", "", *rules.REPORT_REDACTION_INTRO, "", "---", ""]),
        fixed("redaction_report", 1, ["## Result", "", *rules.REPORT_REDACTION_NONE], none),
        fixed("redaction_report", 1, ["## Summary", "", "('- **Total redactions:** ' || total_redactions)", "('- **Affected files:** ' || n_affected)",
                                      "('- **Finding types:** ' || finding_types)", "", "---", "", "## Findings", "",
                                      "| File | Finding Type | Count | Placeholder Used |", "|---|---|---|---|"], some),
        f"SELECT project, 'redaction_report', 2, {key}, {found} || ' `' || CASE finding_type {holders} ELSE '[REDACTED_SECRET]' END || '` |' FROM findings",
        fixed("redaction_report", 3, ["", "---", "", "## Security Notes", "", *rules.REPORT_SECURITY_NOTES], some), footer("redaction_report"),
        f"SELECT project, 'scan_report', 0, '0', {report} FROM facts_row",
        f"SELECT project, 'scan_report', 1, {key}, to_json({{'file_path': path, 'finding_type': finding_type, 'count': count}})::VARCHAR FROM findings",
        "SELECT DISTINCT project, 'scan_report', 2, path, to_json({'affected_file': path})::VARCHAR FROM findings",
    ]
    lists_cte = ", ".join(f"list(item ORDER BY ord) FILTER (category = '{c}') AS {c}_list" for c in rules.TECH_CATEGORIES[:7])
    return [
        *whole_domain(), *risk_notes(), *tree(),
        ("stats", STATS), ("summary_text", PROJECT_SUMMARY),
        ("totals", """SELECT project, sum(count)::BIGINT AS total_redactions, count(DISTINCT path) AS n_affected, count(*) AS found_rows,
 array_to_string(list_sort(list(DISTINCT finding_type)), ', ') AS finding_types FROM findings GROUP BY project"""),
        ("facts_row", f"""SELECT p.project, s.* EXCLUDE (project), t.* EXCLUDE (project), x.* EXCLUDE (project), d.* EXCLUDE (project), y.summary, l.* EXCLUDE (project),
 coalesce(found_rows, 0) AS n_findings, coalesce(n.n_notes, 0) AS n_notes, n.notes_list, k.files_list
FROM (SELECT DISTINCT project FROM files) p JOIN stats s USING (project) JOIN tech_wide t USING (project) LEFT JOIN totals x USING (project) JOIN detected d USING (project)
JOIN summary_text y USING (project) LEFT JOIN (SELECT project, {lists_cte} FROM tech GROUP BY project) l USING (project)
LEFT JOIN (SELECT project, count(*) AS n_notes, list(note ORDER BY ord) AS notes_list FROM notes GROUP BY project) n USING (project)
LEFT JOIN (SELECT project, list({{'path': path, 'priority_score': priority_score, 'size': size, 'redacted': redacted}} ORDER BY rank) AS files_list FROM selected WHERE rank <= {rules.REPORT_FILES} GROUP BY project) k USING (project)"""),
        ("tree_lines", f"""SELECT project, place, CASE WHEN path = '' THEN '' ELSE array_to_string([{part} for i in range(1, len(parts) + 1)], chr(1)) END AS line_key, line
 FROM (SELECT t.*, coalesce(w.is_dir, true) AS is_dir, string_split(t.path, '/') AS parts FROM tree t LEFT JOIN walk w USING (project, path))"""),
        ("lines", " UNION ALL ".join(parts)),
    ]


def context_documents(files: dict[str, str], found: dict[str, str]) -> list[tuple[str, str]]:
    """All rows of the context documents, from the lines of files and findings per target."""
    from sedimenta.operators import context

    def rows(section: str, key: str, text: dict[str, str], source: str = "facts_row") -> list[str]:
        order = context.SECTION_ORDER.index(section)
        return [f"SELECT project, '{t}' AS target, '{section}' AS section, {order} AS section_ord, {key} AS line_key, x AS text FROM (SELECT *, {expr} AS x FROM {source}) WHERE x IS NOT NULL" for t, expr in text.items()]

    every = lambda expr: {t: expr for t in rules.TARGETS}
    nl = "chr(10)"
    counts = ("files_scanned", "files_skipped", "files_redacted")
    path = "'`' || project || '`'"
    labelled = {
        "chatgpt": ("| ", " | ", " |", path, ("Project Path", "Files Scanned", "Files Skipped", "Files Redacted", "Ollama Used")),
        "claude": ("- ", ": ", "", "project", ("Project path", "Files scanned", "Files skipped", "Files with redacted secrets", "Ollama summarization used")),
        "gemini": ("- ", ": ", "", "project", ("Project Path", "Files Scanned", "Files Skipped", "Files with Redacted Secrets", "Ollama Summarization Used")),
    }
    facts = {t: [f"'{a}{n}{b}' || {v} || '{c}'" for n, v in zip(names, (p, *counts, "'False'"))] for t, (a, b, c, p, names) in labelled.items()}
    facts["claude"] += ["'- Detected languages: ' || languages", "'- Detected frameworks: ' || frameworks",
                        "CASE WHEN n_findings > 0 THEN '- Secret patterns found and redacted: ' || n_findings || ' finding(s)' END"]
    facts["minimax"] = [f"'**Project:** ' || {path}", "'**Files:** ' || files_scanned || ' scanned, ' || files_skipped || ' skipped'", "'**Ollama Used:** False'"]
    facts["generic"] = [f"'**Project Path:** ' || {path}"]
    heads = {"claude": "'[' || path || ']' || chr(10)", "gemini": "'**`' || path || '`**' || chr(10)", "minimax": "'[' || path || '] '"}
    summary = {}
    for t, (_, shown, chars, _) in rules.TARGET_CAPS.items():
        body = f"CASE WHEN length(summary) > {chars} THEN substr(summary, 1, {chars}) || '...' ELSE summary END" if chars else "summary"
        end = "" if t == "minimax" else " || chr(10)"
        summary[t] = f"CASE WHEN summary_rank <= {shown} THEN {heads.get(t, chr(39) + '### `' + chr(39) + ' || path || ' + chr(39) + '`' + chr(39) + ' || chr(10)')} || {body}{end} END"
    field = lambda name, value: f"'| {name} | ' || {value} || ' |' || chr(10)"
    metadata = " || ".join([
        q("## Analysis Metadata\n\n| Field | Value |\n|---|---|\n"), field("Analysis Type", q(rules.ANALYSIS_LIMITED)), field("Evidence Level", "'Limited'"),
        field("Full Source Audit", "'No'"), field("Ollama Used", "'False'"), field("Included File Evidence Count", "n_selected"),
        field("Skipped Files Count", "files_skipped"), field("Mode", "'fast'"), field("Detected Domain", "domain"), field("Domain Confidence", "confidence"),
        f"CASE WHEN domain <> 'generic' THEN {field('Domain Score', 'score')} ELSE '' END",
        f"CASE WHEN domain <> 'generic' AND matched <> '' THEN {field('Domain Indicators', 'matched')} ELSE '' END",
    ])
    disclaimer = f"'## Evidence Disclaimer' || {nl} || {nl} || '> ⚠ ' || {q(rules.DISCLAIMER_STATIC)} || CASE WHEN n_selected < 20 THEN {nl} || {nl} || '> ⚠ ' || {q(rules.DISCLAIMER_FEW_FILES)} ELSE '' END || {nl}"
    special = "CASE WHEN confidence IN ('medium', 'high') THEN CASE domain " + " ".join(f"WHEN '{d}' THEN {q(t)}" for d, t in rules.DOMAIN_SECTIONS.items()) + " END END"
    some = "(SELECT * FROM facts_row WHERE n_findings > 0)"
    head = "'0'"
    parts = [
        *rows("facts", head, {t: f"concat_ws({nl}, {', '.join(lines_)})" for t, lines_ in facts.items()}),
        *rows("project_summary", head, every("summary")), *rows("tech_stack", head, every("tech_table")),
        *rows("important_files", "lpad(rank::VARCHAR, 6, '0')", {t: f"CASE WHEN rank <= {rules.TARGET_CAPS[t][0]} THEN {x} END" for t, x in files.items()}, "selected"),
        *rows("file_summaries", "lpad(rank::VARCHAR, 6, '0')", summary, "ranked_summaries"),
        *rows("risk_notes", "lpad(ord::VARCHAR, 3, '0')", every("'- ' || note"), "notes"),
        *rows("redaction", "'1' || path || chr(1) || ord", found, "findings"),
        *rows("metadata", head, every(metadata)), *rows("disclaimer", head, every(disclaimer)), *rows("domain_risk", head, every(special)),
        *[r for section, n in (("important_files", "n_selected"), ("file_summaries", "n_summaries"), ("risk_notes", "n_notes"), ("redaction", "n_findings"))
          for r in rows(section, head, {t: f"CASE WHEN {n} = 0 THEN {q(x)} END" for t, x in context._EMPTY[section].items()})],
        *rows("redaction", head, {t: q(x) for t, x in context._REDACTION_HEAD.items()}, some),
        *rows("redaction", "'2'", {t: q(x) for t, x in context._REDACTION_TAIL.items()}, some),
        *rows("file_tree", "line_key", {t: "line" for t, c in rules.TARGET_CAPS.items() if c[3] is None}, "tree_lines"),
        *[r for t, c in rules.TARGET_CAPS.items() if c[3] for r in rows("file_tree", head, {
            t: f"CASE WHEN length(t) > {c[3]} THEN substr(t, 1, {c[3]}) || '...[truncated]' ELSE t END"}, "(SELECT project, string_agg(line, chr(10) ORDER BY place) AS t FROM tree_lines GROUP BY project)")],
    ]
    base = [c for c in report_documents() if c[0] != "lines"]
    return [
        *[(n, x.replace("k.files_list", "k.files_list, coalesce(k.n_selected, 0) AS n_selected, coalesce(k.n_summaries, 0) AS n_summaries").replace(
            "ORDER BY rank) AS files_list FROM selected", "ORDER BY rank) AS files_list, count(*) AS n_selected, count(*) FILTER (length(content_preview) > 0) AS n_summaries FROM selected") if n == "facts_row" else x) for n, x in base],
        ("ranked_summaries", "SELECT s.*, r.rank, row_number() OVER (PARTITION BY s.project ORDER BY r.rank) AS summary_rank FROM summaries s JOIN selected r USING (project, path)"),
        ("context", " UNION ALL ".join(parts)),
    ]


STATS = """SELECT project, count(*) AS files_found, count(*) FILTER (skipped_reason IS NULL) AS files_scanned, count(*) FILTER (skipped_reason IS NOT NULL) AS files_skipped,
 count(*) FILTER (redacted) AS files_redacted, coalesce(bool_or(skipped_reason = 'env_file' AND contains(path, '.env.example')), false) AS env_template_skipped FROM scanned GROUP BY project"""
PROJECT_SUMMARY = f"""SELECT project, 'Static analysis completed (mode: fast, Ollama: disabled). Detected technologies: ' || tech_text ||
 '. Structural summaries were generated for all important files. Review the file tree and structural summaries for architecture insights.' ||
 coalesce(chr(10) || chr(10) || '## Large File Risks' || chr(10) || notes, '') AS summary FROM tech_wide LEFT JOIN (SELECT project, string_agg('- ' || {LARGE_NOTE}, chr(10) ORDER BY rank) AS notes
 FROM selected WHERE length(content_preview) > 0 AND size >= 51200 GROUP BY project) USING (project)"""


def per_target(lines_by_target: dict[str, str], caps: dict[str, str] | None = None, source: str = "selected", key: str = "lpad(rank::VARCHAR, 6, '0')") -> str:
    return " UNION ALL ".join(
        f"SELECT project, '{t}' AS target, {key} AS line_key, {line} AS text FROM {source}" + (f" WHERE {caps[t]}" if caps else "")
        for t, line in lines_by_target.items()
    )


def _mode_case(position: int) -> str:
    return "CASE mode " + " ".join(f"WHEN '{m}' THEN {v[position]}" for m, v in rules.MODES.items()) + " END"


REQUESTS = f"""SELECT doc_id::VARCHAR AS project, {lst(rules.MODES)}[(doc_id % 3) + 1] AS mode,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 = 0 END AS use_enrichment,
  CASE WHEN doc_id % 4 = 0 THEN n_chars END AS max_files, CASE WHEN doc_id % 7 = 0 THEN n_chars END AS max_chars FROM documents"""
RESOLVED = f"""SELECT project, mode, coalesce(use_enrichment, false) AND mode <> 'fast' AS use_enrichment,
  coalesce(max_files, {_mode_case(0)}) AS max_files, coalesce(max_chars, {_mode_case(1)}) AS max_chars, {_mode_case(2)} AS enrich_max FROM requests"""


def budget(per_item: int, total: int) -> str:
    left = f"({total} - prev)"
    cap = f"least({per_item}, {left})"
    return f"""SELECT source, doc_id, CASE WHEN {left} <= 0 THEN '(preview omitted: size budget reached)'
  WHEN length(text) > {cap} THEN substr(text, 1, {cap}) || chr(10) || chr(10) || '...(preview truncated after ' || {cap} || ' characters)' ELSE text END AS preview,
  {left} <= 0 OR length(text) > {cap} AS truncated
FROM (SELECT *, coalesce(sum(least(length(text), {per_item})) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prev FROM documents)"""


def admitted(limit: int, window: int, source: str = "events", columns: str = "user_id, event_id") -> str:
    w = window * 1_000_000
    alive = f"list_filter(a.taken, lambda x: x >= o.us - {w})"
    wait = f"greatest(1, trunc({window + 1} - (o.us - ({alive})[1]) / 1000000.0::DOUBLE)::BIGINT)"
    return with_([
        ("ordered", "SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM " + source),
        ("walk", f"""SELECT user_id, event_id, rn, [us] AS taken, true AS admitted, 0::BIGINT AS retry_after FROM ordered WHERE rn = 1
UNION ALL SELECT o.user_id, o.event_id, o.rn,
  CASE WHEN len({alive}) < {limit} THEN list_append({alive}, o.us) ELSE {alive} END, len({alive}) < {limit},
  CASE WHEN len({alive}) < {limit} THEN 0 ELSE {wait} END
FROM walk a JOIN ordered o ON o.user_id = a.user_id AND o.rn = a.rn + 1"""),
    ], f"SELECT {columns}, admitted, retry_after FROM walk", recursive=True)


def retained(source: str, keys: str, newest: str, max_rows: int, batch: int, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {newest} DESC) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM {source})
WHERE rn <= CASE WHEN n >= {max_rows} THEN greatest(0, n - ((n - {max_rows} + 1 + {batch} - 1) // {batch}) * {batch}) ELSE n END"""


def _docs_redaction() -> list[tuple[str, str]]:
    return redaction("documents", "doc_id, source", "text")


def _suspicious() -> str:
    return " OR ".join(f"regexp_matches(content, {re2(p if p.startswith('(?i)') else '(?i)' + p)})" for _, p, _ in rules.SECRET_RULES)


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    f = lambda body: with_([FILES], body)
    s["path_parts"] = f(f"SELECT project, path, {NAME} AS name, {EXT} AS extension, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, {MODULE} AS module, {DEPTH} AS depth FROM files")
    excluded = " OR ".join(f"contains(lower(path), {q(n)})" for n in rules.ENRICHMENT_EXCLUDED)
    s["path_rules"] = f(f"""SELECT project, path, {skip_reason()} AS skip_reason, {PRUNED} AS ignored_prefix, {NAME} IN {tup(rules.LOCK_FILES)} AS is_lock,
 contains(lower({NAME}), '.min.') AS is_minified, ({NAME} = 'Dockerfile' OR {EXT} IN {tup(rules.READABLE_SUFFIXES)}) AS is_allowed, {SECRET_CATEGORY} AS secret_category,
 (contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '/test')) AS is_test,
 (contains(lower(path), 'auth') OR contains(lower(path), 'security')) AS is_auth, ({excluded} OR size > 20480) AS not_enriched,
 {type_label(EXT)} AS type_label, {TIER} AS tier, printf('%.1f', size / 1024.0::DOUBLE) AS kb, {score()} AS score FROM files""")
    s["prune_folders"] = with_(status(), "SELECT * FROM status")
    s["prune_folders_with_excludes"] = with_(status(("docs", "cart")), "SELECT * FROM status")
    s["skip_histogram"] = with_(status(), "SELECT project, skipped_reason, count(*) AS n_files FROM status WHERE skipped_reason IS NOT NULL GROUP BY ALL")
    caps = ", ".join(f"{truncated('text', c)} AS cap_{c}" for c in (0, 30, 100, 3000))
    s["truncate_docs"] = f"SELECT doc_id, {caps} FROM documents"
    s["redacted_docs"] = with_(_docs_redaction(), f"SELECT doc_id, sha256(t8) AS redacted_hash, {FOUND} AS redacted FROM redacted")
    s["redacted_files"] = with_(scanned(), "SELECT project, path, extension, size, skipped_reason, redacted, sha256(content_preview) AS content_hash, length(content_preview) AS n_chars FROM scanned")
    s["scan_fast_mode"] = with_(scanned(3000), "SELECT project, path, skipped_reason, redacted, content_preview FROM scanned")
    s["secret_findings_docs"] = with_(_docs_redaction(), f"SELECT source AS project, doc_id || '.md' AS path, finding_type, count FROM ({findings_of('source, doc_id')})")
    s["secret_findings_files"] = with_(scanned(), "SELECT project, path, finding_type, count FROM findings")
    s["secret_findings_conversations"] = with_(
        redaction("conversations", "conv_id, turn, role", "text"),
        f"SELECT conv_id::VARCHAR AS project, lpad(turn::VARCHAR, 6, '0') || '_' || role || '.md' AS path, finding_type, count FROM ({findings_of('conv_id, turn, role')})")
    s["redaction_by_project"] = with_(scanned(), "SELECT project, finding_type, count(*) AS n_files, sum(count)::BIGINT AS n_redactions FROM findings GROUP BY ALL")
    s["redaction_totals"] = with_(scanned(), """SELECT project, count(*) AS finding_rows, sum(count)::BIGINT AS total_redactions, count(DISTINCT path) AS affected_files,
 array_to_string(list_sort(list(DISTINCT finding_type)), ', ') AS finding_types FROM findings GROUP BY project""")
    holders = " ".join(f"WHEN '{n}' THEN {q(p)}" for n, _, p in rules.SECRET_RULES)
    s["redaction_report"] = with_(scanned(), f"SELECT project, path, finding_type, count, CASE finding_type {holders} ELSE '[REDACTED_SECRET]' END AS placeholder FROM findings")
    s["suspicious_content"] = f(f"SELECT project, path, {_suspicious()} AS suspicious FROM files")
    s["risk_keywords"] = f(f"SELECT project, path, array_to_string({risk_words('content')}, ', ') AS words FROM files")
    parts = " UNION ALL ".join(
        f"SELECT project, path, '{lang}' AS lang, array_to_string({effects('content', lang)}, ', ') AS effects FROM files WHERE {EXT} IN {tup(sfx)}"
        for lang, sfx in rules.LANGUAGE_SUFFIXES.items())
    s["side_effects"] = f(parts)
    s["preview_lines"] = f"SELECT doc_id, {preview('text')} AS preview FROM documents"
    s["requirement_names"] = f(REQUIREMENTS)
    stamp = "path || ':' || size || ':' || (1704067200 + doc_id * 60) * 1000000"
    s["file_keys"] = f(f"SELECT project, path, substr(sha256(path), 1, 12) AS path_hash, substr(sha256({stamp}), 1, 16) AS key FROM files")
    s["scan_stats"] = with_(scanned(), STATS)
    s["priority_topk"] = with_(selected(), "SELECT project, path, priority_score, size, redacted, rank FROM selected")
    s["enrichment_candidates"] = with_(selected(80), f"""SELECT * FROM (SELECT project, path, priority_score, row_number() OVER (PARTITION BY project ORDER BY priority_score DESC, path) AS rank
 FROM selected WHERE NOT ({excluded} OR size > 20480)) WHERE rank <= 20""")
    s["dry_run_preview"] = with_([*selected(), *tech()], f"""SELECT t.project, coalesce(files, '(none)') AS files, greatest(coalesce(n, 0) - 50, 0) AS more_files,
 coalesce(nullif(all_detected, ''), 'Unknown') AS detected, 11 AS estimated_outputs FROM tech_wide t LEFT JOIN (SELECT project, count(*) AS n,
 string_agg('[' || priority_score || '] ' || path, chr(10) ORDER BY rank) FILTER (rank <= 50) AS files FROM selected GROUP BY project) USING (project)""")
    s["retain_newest"] = retained("conversations", "conv_id", "turn", 5, 2, "conv_id, turn")
    s["retain_newest_by_source"] = retained("documents", "source", "doc_id", 100, 10, "source, doc_id")
    s["module_rollup"] = with_(selected(), f"""SELECT project, module, count(*) AS n_files, min(rank) AS ord, 'Module ''' || module || ''': ' || string_agg(path, ', ' ORDER BY rank) AS text
 FROM (SELECT *, {MODULE} AS module FROM selected WHERE length(content_preview) > 0) GROUP BY project, module""")
    s["url_module_rollup"] = f"""SELECT host, {MODULE} AS module, count(*) AS n_pages, sum(length(html))::BIGINT AS total_chars, max({DEPTH}) AS max_depth FROM
 (SELECT html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/?([^?#]*)', 1) AS path FROM pages) GROUP BY ALL"""
    s["dir_rollup"] = f("""SELECT project, folder, count(*) AS n_files, sum(size)::BIGINT AS total_bytes, len(string_split(folder, '/')) AS depth FROM
 (SELECT project, size, array_to_string(parts[1:i], '/') AS folder FROM (SELECT project, size, parts, unnest(range(1, len(parts))) AS i FROM (SELECT project, size, string_split(path, '/') AS parts FROM files))) GROUP BY ALL""")
    s["dir_tree"] = with_(tree(), "SELECT project, path, line FROM tree", recursive=True)
    s["dir_tree_head"] = with_(tree(), """SELECT project, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...[truncated]' ELSE t END AS tree_head
 FROM (SELECT project, string_agg(line, chr(10) ORDER BY place) AS t FROM tree GROUP BY project)""", recursive=True)
    s["large_file_notes"] = with_(selected(), f"SELECT project, path, rank, {LARGE_NOTE} AS note FROM selected WHERE length(content_preview) > 0 AND size >= 51200")
    s["project_summary"] = with_([*selected(), *tech()], PROJECT_SUMMARY)
    s["report_lines"] = with_(report_documents(), "SELECT project, report, block, line_key, line FROM lines", recursive=True)
    s["tech_items"] = with_(tech(), "SELECT project, category, item, sources, ord FROM tech")
    s["tech_table"] = with_(tech(), "SELECT project, all_detected, tech_text, tech_table, all_detected = '' AS is_empty FROM tech_wide")
    for lang in KINDS:
        s[f"symbols_{lang}"] = with_([*scanned(), symbol_lists(lang)], symbol_rows(lang))
    s["top_imports"], s["env_var_usage"], s["route_catalog"] = (symbol_counts(k) for k in ("import", "env", "route"))
    s["structural_summary"] = with_(summaries(), "SELECT project, path, lang, summary FROM summaries")
    s["domain_evidence"] = with_(whole_domain(), EVIDENCE)
    s["structural_summary_all"] = s["structural_summary"]
    s["domain_evidence_structure"] = with_(whole_domain(), EVIDENCE + " WHERE channel LIKE 'structure%'")
    s["domain_scores"] = with_(whole_domain(), "SELECT project, domain, score::BIGINT AS score, strong_count, matched, confidence FROM scores")
    s["detect_domain"] = with_(whole_domain(), "SELECT project, domain, confidence, score::BIGINT AS score, strong_count, matched FROM detected")
    s["detect_domain_full"] = s["detect_domain"]
    s["winning_evidence"] = with_(whole_domain(), "SELECT project, domain, evidence FROM evidence JOIN detected USING (project, domain)")
    for table, column in (("documents", "text"), ("pages", "html")):
        s[f"{table[:-1] if table == 'pages' else 'doc'}_indicator_hits"] = with_(
            indicator_hits(f"SELECT lower({column}) AS low FROM {table}"),
            f"SELECT domain, indicator, count(*) AS n_{'pages' if table == 'pages' else 'docs'} FROM hits GROUP BY ALL")
    planted = "[" + ", ".join(q(w) for w in dict.fromkeys(w.lower() for pair in rules.DOMAIN_INDICATORS.values() for words_ in pair for w in words_)) + "]"
    s["planted_indicator_hits"] = with_(
        indicator_hits(f"""SELECT lower(text) || CASE WHEN doc_id % 7 < 4 THEN ' ' || word || '.' WHEN doc_id % 7 = 4 THEN ' x' || word ELSE ' ' || word || 'x' END AS low
  FROM (SELECT doc_id, text, {planted}[1 + doc_id % len({planted})] AS word FROM documents)"""),
        "SELECT domain, indicator, count(*) AS n_docs FROM hits GROUP BY ALL")
    s["risk_notes"] = with_(risk_notes(), "SELECT project, ord, note FROM notes")
    s["repo_audit"] = with_(audit(), "SELECT * FROM audit")
    head = "'# Project Upgrade Plan (' || project || ')' || chr(10) || " + q("\n".join(rules.UPGRADE_PLAN_LINES) + "\n")
    s["upgrade_plan"] = with_(audit(), f"""SELECT project, {head} || coalesce(rows, {q(rules.NO_AUDIT_FINDINGS)}) || chr(10) AS plan FROM (SELECT DISTINCT project FROM files) LEFT JOIN
 (SELECT project, string_agg('- [' || upper(severity) || '] ' || title || ': ' || detail || ' → ' || recommendation, chr(10) ORDER BY ord) AS rows FROM audit GROUP BY project) USING (project)""")
    s["resolve_options"] = with_([("requests", REQUESTS)], RESOLVED)
    full = "Do not claim to have performed a full source-code audit. Base findings only on file tree, structural summaries, config previews, and included evidence."
    few = "Evidence is limited. Produce a limited architecture and risk review, not a definitive security audit."
    parts = f"""concat_ws(chr(10) || chr(10), CASE WHEN NOT use_enrichment THEN '> ⚠ {full}' END, CASE WHEN max_files < 20 THEN '> ⚠ {few}' END,
 CASE WHEN project::BIGINT % 6 = 0 AND NOT use_enrichment THEN '> ⚠ Ollama was unavailable: timeout. Static-only analysis was used.' END)"""
    s["evidence_labels"] = with_([("requests", REQUESTS), ("resolved", RESOLVED)], f"""SELECT project, mode,
 CASE WHEN mode = 'deep' AND use_enrichment THEN 'high' WHEN mode = 'balanced' THEN 'medium' ELSE 'limited' END AS evidence_level,
 CASE WHEN mode = 'deep' AND use_enrichment THEN 'Deep Architecture Review (Static + Ollama)' WHEN mode = 'balanced' AND use_enrichment THEN 'Balanced Architecture Review (Static + Ollama)'
  WHEN mode = 'balanced' THEN 'Balanced Static Architecture Review' ELSE 'Limited Static Architecture Review' END AS analysis_type,
 CASE WHEN {parts} = '' THEN '' ELSE '## Evidence Disclaimer' || chr(10) || chr(10) || {parts} || chr(10) END AS disclaimer FROM resolved""")
    sections = " ".join(f"WHEN '{d}' THEN {q(shown)}" for d, shown in rules.DOMAIN_SECTIONS.items())
    s["special_section"] = with_(whole_domain(), f"SELECT project, CASE WHEN confidence IN ('medium', 'high') THEN CASE domain {sections} ELSE '' END ELSE '' END AS section FROM detected")
    s["budget_pack"] = budget(2_000, 60_000)
    s["budget_pack_default"] = f"SELECT source, doc_id, length(preview) AS preview_chars, truncated FROM ({budget(40_000, 500_000)})"
    mark = lambda n: f"CASE WHEN redacted THEN {q(n)} ELSE '' END"
    listed = {
        "chatgpt": f"'- `' || path || '` (priority: ' || priority_score || ', size: ' || size || 'B' || {mark(', redacted')} || ')'",
        "claude": f"'- ' || path || ' (score: ' || priority_score || ')' || {mark(' [REDACTED]')}",
        "gemini": f"'- `' || path || '` — priority score: ' || priority_score || {mark(' *(contains redacted secrets)*')}",
        "minimax": f"'- `' || path || '`' || {mark(' [REDACTED]')}",
        "generic": f"'- `' || path || '` (priority: ' || priority_score || ')' || {mark(' *(redacted)*')}",
    }
    s["context_files"] = with_(selected(), per_target(listed, {t: f"rank <= {c[0]}" for t, c in rules.TARGET_CAPS.items()}))
    found = {
        "chatgpt": "'| `' || path || '` | ' || finding_type || ' | ' || count || ' |'",
        "claude": "'- ' || path || ': ' || finding_type || ' (' || count || ' occurrence(s))'",
        "gemini": "'- `' || path || '`: **' || finding_type || '** — ' || count || ' occurrence(s)'",
        "minimax": "'- `' || path || '`: ' || finding_type || ' (' || count || 'x) — REDACTED'",
        "generic": "'- `' || path || '`: ' || finding_type || ' (' || count || ' occurrence(s))'",
    }
    s["context_redaction"] = with_(scanned(), per_target(found, None, "findings", "path || '|' || ord"))
    s["context_rows"] = with_(context_documents(listed, found), "SELECT project, target, section, section_ord, line_key, text FROM context", recursive=True)
    s["window_request_count"] = """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n_requests FROM events"""
    s["rate_limit_admit"] = admitted(2, 86_400)
    s["rate_limit_minute"] = admitted(60, 60)
    s["rate_limit_one_key"] = admitted(50, 86_400, "(SELECT 0 AS user_id, event_id, ts FROM events)", "event_id")
    s["stream_rate_limit"] = s["rate_limit_admit"]
    kept = """SELECT source AS project, substr(sha256(doc_id || '.md'), 1, 12) AS path_hash, substr(sha256(doc_id || '.md:' || (n_chars + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) || ':0'), 1, 16) AS key,
 CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS summary FROM documents SEMI JOIN labels USING (doc_id)"""
    s["summary_cache"] = kept
    s["clear_cache"] = f"""WITH kept AS ({kept}), n AS (SELECT project, count(*) AS rows_before FROM kept GROUP BY project)
SELECT project, rows_before, CASE WHEN project < 'src2' THEN 0 ELSE rows_before END AS rows_after, (SELECT coalesce(sum(rows_before), 0)::BIGINT FROM n WHERE project < 'src2') AS removed FROM n"""
    s["incremental_changed"] = """SELECT source AS project, doc_id || '.md' AS path, doc_id, substr(sha256(doc_id || '.md'), 1, 12) AS path_hash
 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
    s["incremental_refresh"] = """SELECT source AS project, doc_id || '.md' AS path, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'cached' ELSE 'fresh' END AS summary FROM documents d"""
    s["stream_redact"] = with_(_docs_redaction(), f"SELECT source AS project, doc_id || '.md' AS path, n_chars AS size, sha256(t8) AS redacted_hash, {FOUND} AS redacted FROM redacted JOIN documents USING (doc_id, source)").replace("n_chars AS size, ", "")
    return s
