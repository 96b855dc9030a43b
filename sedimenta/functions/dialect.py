"""Regular expressions that mean the same in Python, Spark (Java) and RE2.

Python's ``\\s``, ``\\w`` and ``\\b`` are Unicode aware, those of Java and RE2 are ASCII. The rule patterns
are written in the Python dialect; ``portable`` spells the classes out and sets the flags so that Spark finds
the same matches as Python would.
"""

from __future__ import annotations

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
LINE_BREAK = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
STRIP = rf"^[{SPACE}]+|[{SPACE}]+\z"
_OUTSIDE = {"s": f"[{SPACE}]", "S": f"[^{SPACE}]", "w": f"[{WORD}]"}
_INSIDE = {"s": SPACE, "w": WORD}


def _spell_out(pattern: str, boundary: tuple[str, str]) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                out.append(boundary[0] if not out else boundary[1])
            else:
                out.append((_INSIDE if in_class else _OUTSIDE).get(nxt, ch + nxt))
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def portable(pattern: str) -> str:
    """Python pattern -> Java pattern with the same matches (``u``: Unicode folding, ``d``: only \\n ends a line)."""
    flags = ""
    if pattern.startswith("(?"):
        head = pattern[2 : pattern.index(")")]
        if head.isalpha():
            flags, pattern = head, pattern[len(head) + 3 :]
    body = _spell_out(pattern, (f"(?<![{WORD}])", f"(?![{WORD}])"))
    return f"(?{flags.replace('i', 'iu')}d){body}"


def portable_re2(pattern: str) -> tuple[str, str]:
    """Python pattern -> (RE2 pattern, flag letters); ``\\b`` stays ASCII because RE2 has no look-around."""
    flags = ""
    if pattern.startswith("(?"):
        head = pattern[2 : pattern.index(")")]
        if head.isalpha():
            flags, pattern = head, pattern[len(head) + 3 :]
    body = _spell_out(pattern, (r"\b", r"\b"))
    return (f"(?{flags})" if flags else "") + body, flags
