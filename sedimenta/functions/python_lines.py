"""Symbols of Python source from its logical lines.

One pattern cuts a text into tokens; a pass over them keeps the bracket stack, joins physical lines to logical ones, keeps
the indent stack and so the depth of every statement in the tree of blocks. Definitions are listed breadth first: by depth,
then by place, as a walk over a syntax tree meets them.

A text is refused (None) for what tokens and blocks show: open strings, brackets that do not match, indents that fit no
block, blocks without body, malformed headers and imports, and operands without an operator between them. Inside an
f-string nothing is looked at.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

ARGS = 4
_PREFIX = r"(?:[rRbBuU]|[fF]|[rR][bBfF]|[bBfF][rR])?"
_FIELDS = r"(?:[^{quote}\\\n{{}}]|\\.|\{{\{{|\}}\}}|\{{[^{{}}\n]*\}})*"
TOKEN = re.compile(
    "(?P<string>" + "|".join([
        _PREFIX + r'"""(?:[^\\]|\\.)*?"""', _PREFIX + r"'''(?:[^\\]|\\.)*?'''",
        r"(?:[fF]|[rR][fF]|[fF][rR])\"" + _FIELDS.format(quote='"') + '"', r"(?:[fF]|[rR][fF]|[fF][rR])'" + _FIELDS.format(quote="'") + "'",
        _PREFIX + r'"(?:[^"\\\n]|\\.)*"', _PREFIX + r"'(?:[^'\\\n]|\\.)*'",
    ]) + r""")|(?P<skip>\#[^\n]*|\\\n|[ \t\f]+)|(?P<newline>\n)|(?P<word>\w+)|(?P<open>[(\[{])|(?P<close>[)\]}])"""
    r"|(?P<sign>:=|->|\*\*|[-+*/%@&|^~<>=!]=?|[.,:;])",
    re.S,
)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_WORDS = frozenset(keyword.kwlist) - {"None", "True", "False"}
_BLOCKS = frozenset("if elif else for while with try except finally def class async".split())
_SOFT = frozenset(("match", "case", "type"))
_BLANK = re.compile(r"[ \t\f]*")
# whole lines without a statement
_NO_LINES = re.compile(r"(?:[ \t\f]*+(?:\#[^\n]*+)?\n)*+")


class NotPython(ValueError):
    """The text is not well formed."""


def _indent(blank: str) -> tuple[int, int]:
    """Width with tabs to multiples of eight, and with tabs as one: both must agree on what is deeper."""
    blank = blank.rpartition("\f")[2]
    wide = 0
    for c in blank:
        wide = (wide // 8 + 1) * 8 if c == "\t" else wide + 1
    return wide, len(blank)


def logical_lines(text: str) -> Iterator[tuple[tuple[int, int], list[tuple[str, str, int]]]]:
    """(indent, tokens) of each logical line; tokens are (kind, text, bracket depth). Blank and comment lines give none."""
    at, brackets, line, indent, joined = 0, [], [], (0, 0), False
    fresh, end = True, len(text)
    while at < end:
        if fresh and not brackets and not joined:
            blank = _BLANK.match(text, _NO_LINES.match(text, at).end())
            indent, at, fresh = _indent(blank[0]), blank.end(), False
            continue
        token = TOKEN.match(text, at)
        if token is None:
            raise NotPython
        kind, found, at = token.lastgroup, token[0], token.end()
        joined = found == "\\\n"
        if kind == "newline":
            if not brackets:
                if line:
                    yield indent, line
                line, fresh = [], True
        elif kind == "open":
            line.append((kind, found, len(brackets)))
            brackets.append(found)
        elif kind == "close":
            if not brackets or brackets.pop() != _PAIRS[found]:
                raise NotPython
            line.append((kind, found, len(brackets)))
        elif kind != "skip":
            line.append((kind, found, len(brackets)))
    if brackets or joined:
        raise NotPython
    if line:
        yield indent, line


def _check_operands(line: list) -> None:
    """Two operands next to each other: no expression has them."""
    for k, ((kind, a, _), (after, b, _)) in enumerate(zip(line, line[1:])):
        ends = kind == "string" or kind == "close" or kind == "word" and a not in _WORDS and not (k == 0 and a in _SOFT)
        starts = after == "string" or after == "word" and b not in _WORDS
        if ends and starts and not kind == after == "string":
            raise NotPython


def _header_end(line: list) -> int:
    """Place of the colon that ends a block's header."""
    lambdas = 0
    for k, (_, found, depth) in enumerate(line):
        if depth == 0 and found == "lambda":
            lambdas += 1
        elif depth == 0 and found == ":":
            if not lambdas:
                return k
            lambdas -= 1
    raise NotPython


def _statements(line: list) -> Iterator[list]:
    part = []
    for token in line:
        if token[1] == ";" and token[2] == 0:
            if not part:
                raise NotPython
            yield part
            part = []
        else:
            part.append(token)
    if part:
        yield part


def _dotted(tokens: list) -> str:
    """A dotted name, dots in front of it allowed."""
    name = "".join(t for _, t, _ in tokens)
    if not re.fullmatch(r"\.*(?:[^\W\d]\w*(?:\.[^\W\d]\w*)*)?", name) or not name:
        raise NotPython
    return name


def _split(tokens: list, depth: int) -> list[list]:
    parts: list[list] = [[]]
    for token in tokens:
        if token[1] == "," and token[2] == depth:
            parts.append([])
        else:
            parts[-1].append(token)
    return parts


def _imports(line: list) -> Iterator[str]:
    words = [t for _, t, _ in line]
    base = ""
    if words[0] == "from":
        if "import" not in words:
            raise NotPython
        at = words.index("import")
        module = _dotted(line[1:at]).lstrip(".")
        base, names = module and f"{module}.", line[at + 1:]
        if names and names[0][1] == "(" and names[-1][1] == ")":
            names = names[1:-1]
            names = names[:-1] if names and names[-1][1] == "," else names
        if [t for _, t, _ in names] == ["*"]:
            yield base + "*"
            return
        if not names:
            raise NotPython
        depth = names[0][2]
    else:
        names, depth = line[1:], 0
    for part in _split(names, depth):
        plain = [t for _, t, _ in part]
        if "as" in plain:
            if plain.index("as") != len(plain) - 2:
                raise NotPython
            part = part[:-2]
        name = _dotted(part)
        if name.startswith(".") or base and "." in name:
            raise NotPython
        yield base + name


def _function(header: list) -> str:
    """``name(first arguments)``: those that can be given by place or name, without types and defaults."""
    if len(header) < 4 or not header[1][1].isidentifier() or header[1][1] in _WORDS:
        raise NotPython
    at = next((k for k, (_, t, d) in enumerate(header) if t == "(" and d == 0), None)
    if at is None or at != 2 and header[2][1] != "[":
        raise NotPython
    end = next(k for k, (_, t, d) in enumerate(header) if t == ")" and d == 0 and k > at)
    if end != len(header) - 1 and header[end + 1][1] != "->":
        raise NotPython
    names: list[str] = []
    for part in _split(header[at + 1:end], 1):
        if not part:
            continue
        first = part[0][1]
        if first in ("*", "**"):
            break
        if first == "/":
            names = []
            continue
        if part[0][0] != "word" or first in _WORDS or len(part) > 1 and part[1][1] not in (":", "="):
            raise NotPython
        names.append(first)
    return f"{header[1][1]}({', '.join(names[:ARGS] + ['...'] * (len(names) > ARGS))})"


def _decorator(tokens: list) -> str | None:
    """Dotted name of what is applied; parts that are not names show as ``?``."""
    if not tokens:
        return None
    if tokens[0][1] == "(":
        end = next(e for e in range(1, len(tokens)) if tokens[e][1] == ")" and tokens[e][2] == tokens[0][2])
        name, k = _decorator(tokens[1:end]), end + 1
        plain = name is not None and tokens[end - 1][0] == "word"
    elif tokens[0][0] == "word":
        name, plain, k = tokens[0][1], True, 1
    else:
        return None
    while k < len(tokens):
        kind, found, depth = tokens[k]
        if found == "." and k + 1 < len(tokens) and tokens[k + 1][0] == "word":
            name, plain, k = f"{name if plain else '?'}.{tokens[k + 1][1]}", True, k + 2
        elif kind == "open" and found != "{":
            end = next(e for e in range(k + 1, len(tokens)) if tokens[e][0] == "close" and tokens[e][2] == depth)
            name, plain, k = name if found == "(" else None, False, end + 1
        else:
            return None
    return name


def _string(token: str) -> str | None:
    """Value of a plain string; None for bytes and f-strings."""
    quote = min(k for k in (token.find('"'), token.find("'")) if k >= 0)
    prefix, wide = token[:quote].lower(), 3 if token[quote:quote + 3] in ('"""', "'''") and len(token) >= quote + 6 else 1
    if "b" in prefix or "f" in prefix:
        return None
    body = token[quote + wide:-wide]
    if "\\" in body and "r" not in prefix:
        try:
            body = body.encode("latin-1", "backslashreplace").decode("unicode_escape")
        except UnicodeDecodeError:
            raise NotPython from None
    return body


def _env_reads(line: list) -> Iterator[str]:
    """String first arguments of ``.get``, ``.getenv`` and ``getenv`` calls."""
    for k in range(len(line) - 2):
        if line[k][1] in ("get", "getenv") and line[k + 1][1] == "(" and line[k + 2][0] == "string":
            if line[k][1] == "get" and (k == 0 or line[k - 1][1] != ".") or k and line[k - 1][1] == "def":
                continue
            end = next(e for e in range(k + 2, len(line)) if line[e][0] != "string")
            parts = [_string(t) for _, t, _ in line[k + 2:end]]
            if line[end][1] in (",", ")") and None not in parts:
                yield "".join(parts)


def python_symbols(text: str) -> list[tuple[str, str]] | None:
    """(kind, name) rows: imports, classes, functions, async functions, env reads, decorators; None if not well formed."""
    try:
        return _symbols(text.replace("\r\n", "\n").replace("\r", "\n"))
    except (NotPython, StopIteration):
        return None


def _symbols(text: str) -> list[tuple[str, str]]:
    if "\0" in text:
        raise NotPython
    found: list[tuple[int, str, str, list]] = []
    # indent, depth of the statements there, depth of the last one
    levels, opened, marks = [[(0, 0), 1, 1]], None, []
    for indent, line in logical_lines(text):
        if opened is not None:
            if not (indent[0] > levels[-1][0][0] and indent[1] > levels[-1][0][1]):
                raise NotPython
            levels.append([indent, opened, opened])
        else:
            while indent[0] < levels[-1][0][0]:
                levels.pop()
            if indent != levels[-1][0]:
                raise NotPython
        level, opened = levels[-1], None
        _check_operands(line)
        first = line[0][1]
        if first == "@":
            marks.append(_decorator(line[1:]))
            found += [(level[1], "env", e, []) for e in _env_reads(line)]
            continue
        soft = first in ("match", "case") and len(line) > 2 and line[1][1] not in (":", "=", ".", ",") and any(t == ":" and d == 0 for _, t, d in line)
        if first in _BLOCKS or soft:
            end = _header_end(line)
            header, body = line[:end], line[end + 1:]
            if first == "elif":
                level[2] += 1
            elif first not in ("else", "except", "finally"):
                level[2] = level[1]
            depth = level[2] + (1 if first in ("else", "except", "finally") else 0)
            kind = header[1][1] if first == "async" and len(header) > 1 else first
            if first == "async" and kind not in ("def", "for", "with"):
                raise NotPython
            if kind == "def":
                start = 1 if first == "async" else 0
                found.append((level[2], "async_function" if start else "function", _function(header[start:]), [m for m in marks if m]))
            elif kind == "class":
                if len(header) < 2 or not header[1][1].isidentifier() or header[1][1] in _WORDS or len(header) > 2 and header[2][1] not in ("(", "["):
                    raise NotPython
                found.append((level[2], "class", header[1][1], []))
            found += [(level[2], "env", e, []) for e in _env_reads(header)]
            if marks and kind not in ("def", "class"):
                raise NotPython
            inner = depth + 1 if first == "except" else depth if first in ("else", "finally") else level[2] + 1
            if not body:
                opened, marks = inner, []
                continue
            statements, marks = [(inner, s) for s in _statements(body)], []
        else:
            level[2] = level[1]
            statements = [(level[1], s) for s in _statements(line)]
        if marks:
            raise NotPython
        for depth, statement in statements:
            if statement[0][1] in ("import", "from"):
                found += [(depth, "import", name, []) for name in _imports(statement)]
            elif statement[0][1] in _BLOCKS:
                raise NotPython
            found += [(depth, "env", e, []) for e in _env_reads(statement)]
    if opened is not None or marks:
        raise NotPython
    found.sort(key=lambda f: f[0])
    kinds = {k: [] for k in ("import", "class", "function", "async_function", "env", "decorator")}
    for _, kind, name, decorators in found:
        kinds[kind].append(name)
        kinds["decorator"] += decorators
    kinds["decorator"] = list(dict.fromkeys(kinds["decorator"]))
    return [(kind, name) for kind, names in kinds.items() for name in names]
