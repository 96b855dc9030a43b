"""Symbols from logical lines against Python's own parse, on written cases and on random programs."""

import ast
import random
import re

import pytest

from sedimenta.functions.python_lines import python_symbols


def parsed(text):
    """What a walk over the syntax tree finds; env reads as a sorted list, as their depth inside expressions is not kept."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None

    def chain(node):
        if isinstance(node, ast.Attribute):
            return f"{chain(node.value)}.{node.attr}"
        return node.id if isinstance(node, ast.Name) else "?"

    def mark(node):
        if isinstance(node, ast.Call):
            return mark(node.func)
        return chain(node) if isinstance(node, (ast.Name, ast.Attribute)) else None

    out = {k: [] for k in ("import", "class", "function", "async_function", "decorator", "env")}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out["import"] += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["import"] += [f"{node.module}.{a.name}" if node.module else a.name for a in node.names]
        elif isinstance(node, ast.ClassDef):
            out["class"].append(node.name)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            names = [a.arg for a in node.args.args]
            shown = ", ".join(names[:4] + ["..."] * (len(names) > 4))
            out["function" if isinstance(node, ast.FunctionDef) else "async_function"].append(f"{node.name}({shown})")
            out["decorator"] += [m for m in map(mark, node.decorator_list) if m and m not in out["decorator"]]
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            if isinstance(node.func, ast.Attribute) and node.func.attr in ("get", "getenv") or isinstance(node.func, ast.Name) and node.func.id == "getenv":
                out["env"].append(node.args[0].value)
    return out | {"env": sorted(out["env"])}


def found(text):
    rows = python_symbols(text)
    if rows is None:
        return None
    out = {k: [n for kind, n in rows if kind == k] for k in ("import", "class", "function", "async_function", "decorator", "env")}
    return out | {"env": sorted(out["env"])}


CASES = [
    "", "\n\n# only a comment", "\ufeffimport a\n", "x = 1\\\n  + 2\nimport b",
    '"""Doc.\n\ndef not_one(a): pass\nimport nothing\n"""\nimport real\n',
    "def f(a, b=(1, [2, {3: 'x,y'}]), *, c=lambda q: {q: [q]}, **kw) -> dict[str, int]:\n    '''class No: pass'''\n    return 1\n",
    "from a.b import (\n    c as d,  # with a comment, and more\n    e,\n)\nimport os, sys as system, \\\n    json.decoder\nfrom . import x\nfrom ..y import z\nfrom q import *\n",
    "class A(Base, metaclass=M):\n    x: int = 1\n    class B:\n        def m(self): pass\n    @staticmethod\n    @app.route('/x', f=[1])\n    async def n(a, /, b, c, d, e, f, *args): return os.getenv('IN' 'NER')\n",
    "if a:\n    import one\nelif b:\n    import two\nelse:\n    import three\nimport four\nfor x in y:\n    import five\nelse:\n    import six\n",
    "try:\n    import a\nexcept (E, F) as e:\n    import b\nelse:\n    import c\nfinally:\n    import d\nwhile x: import e; import f\n",
    "match x:\n    case [1, *rest] if rest:\n        import a\n    case {'k': v}: import b\nmatch = 1\nmatch.get('M')\ncase = match\nprint(match)\n",
    "@a.b().c\n@d[0]\n@(e)\n@f()()\ndef g(): ...\n@h\nclass I: ...\n",
    "x = f\"{a['b']} {c!r:>{w}}\" f'{{}}'; y = rb'\\x' Rb\"\"\"q\n\"\"\"\nd.get('k', 1); d.get(k); d.get('a' + b); get('no'); getenv(\"yes\"); d.get(b'no'); d.get(f'no')\n",
    "d.get('a\\n\\x41\\u00e9')\nos.environ.get(r'a\\n')\nx.get('''t\n''')\n",
    "def f[T: (int, str)](x: T) -> T: return x\nclass C[T](B): pass\ntype X = int\n",
    "a = 1 if b else 2; c = not d; e = (yield) if f else (await g)\nlambda: (yield)\nprint(*a, **b)\nx[1:2, ::3] = y\n", "if (n := 10) > 5: import w\n",
    "async def f():\n    async for a in b: pass\n    async with c as d:\n        await e\n", "with (open('a') as a, open('b') as b):\n\timport t\n",
    "class A: pass\ndef b(): pass;\n", "def f():\r\n  import a\r\n  return a\r\n", "x = '\\\n'\nimport a\n", "if x:\n    # comment\n\n    import a\n  # less\n    import b\n",
    # not well formed
    "def f(:\n  pass", "x = (1, 2", "x = 1)", "x = [1, 2)", "def f():\npass", "  import a", "if x:\n    a = 1\n  b = 2\n", "x = 'open\n", '"""open', "import\n", "from a import\n",
    "class:\n  pass", "def f()\n    pass", "if x\n    y = 1\n", "this is prose\n", "print 'hello'\n", "x = 1\n    y = 2\n", "a = b c\n", "@x\ny = 1\n", "x = 1;;\n", "import a as\n",
    "if x:\n\ta = 1\n        b = 2\n", "def f(): if x: pass\n", "x = $y\n", "x \\ y\n", "for\n", "a\0b", "import a.b.\n", "from x import (a, b\n", "def 1f(): pass\n",
]


@pytest.mark.parametrize("text", CASES)
def test_written_cases(text):
    assert found(text) == parsed(text)


class Program:
    """Random well-formed source."""

    def __init__(self, seed):
        self.rng, self.n = random.Random(seed), 0

    def name(self):
        self.n += 1
        return self.rng.choice(["alpha", "beta_", "_c", "été", "get_it", "Import", "classy", "defs"]) + str(self.n)

    def string(self):
        body = self.rng.choice(["", "KEY", "a b", "import no", "def f(", "# no", "[(", "a, b", "\\'\\\"", "\\\\", "x:"])
        quote = self.rng.choice(['"', "'", '"""', "'''"])
        if len(quote) == 3:
            body += self.rng.choice(["", "\nclass No:\n", "\n", " ' ", ' " '])
            body = body if not body.endswith(quote[0]) else body + " "
        elif body in ("'", '"'):
            body = ""
        return self.rng.choice(["", "", "", "r", "b", "f", "Rb"]) .replace("Rb" if not body.isascii() else "", "") + quote + body + quote

    def value(self, depth=0):
        pick = self.rng.randrange(13 if depth < 4 else 4)
        v = lambda: self.value(depth + 1)
        gap = self.rng.choice(["", " ", "\n   ", "  # why [ not\n "])
        if pick < 2:
            return self.name()
        if pick == 2:
            return self.rng.choice(["1", "0x1f", "1_000", "None", "True", "3 .real"])
        if pick == 3:
            return self.string()
        if pick == 4:
            return f"({gap}{v()}{gap})"
        if pick == 5:
            return f"[{gap}{v()},{gap}{v()}]"
        if pick == 6:
            return f"{{{v()}: {v()},{gap}}}"
        if pick == 7:
            return f"{self.name()}({v()},{gap}{self.name()}={v()})"
        if pick == 8:
            return f"{self.name()}.get({gap}{self.string()}{self.rng.choice(['', ', 1'])})"
        if pick == 9:
            return self.rng.choice(["os.getenv", "getenv", "os.environ.get"]) + f"({self.string()})"
        if pick == 10:
            return f"({v()} if {v()} else {v()})"
        if pick == 11:
            return f"(lambda {self.name()}: {v()})"
        return f"{v()} {self.rng.choice(['+', 'and', 'not in', '**', '==', '|'])} {v()}"

    def arguments(self):
        one = lambda: self.name() + self.rng.choice(["", ": int", f": dict[str, {self.name()}]"])
        parts = [one() for _ in range(self.rng.randrange(7))]
        if parts and self.rng.random() < 0.3:
            parts.insert(self.rng.randint(1, len(parts)), "/")
        parts += [f"{self.name()}={self.value(2)}" for _ in range(self.rng.randrange(2))]
        if self.rng.random() < 0.3:
            parts += [self.rng.choice(["*args", f"*, {self.name()}"]), "**kw"][:self.rng.randint(1, 2)]
        return self.rng.choice([", ", ",\n        "]).join(parts)

    def simple(self):
        pick = self.rng.randrange(9)
        n = self.name
        if pick == 0:
            return f"import {n()}.{n()}" + self.rng.choice(["", f" as {n()}", f", {n()}", f", \\\n  {n()} as {n()}"])
        if pick == 1:
            return f"from {self.rng.choice(['', '.', '..'])}{n()} import {n()} as {n()}, {n()}"
        if pick == 2:
            return f"from {n()} import (\n{n()},  # one\n  {n()} as {n()},\n)"
        if pick == 3:
            return f"return_{n()} = {self.value()}"
        if pick == 4:
            return f"{n()}: {n()} = {self.value()}"
        if pick == 5:
            return "pass"
        if pick == 6:
            return f"assert {self.value()}, {self.value()}"
        if pick == 7:
            return self.value()
        return f"del {n()}; {n()} = {self.value()}"

    def block(self, depth, pad):
        out = []
        for _ in range(self.rng.randint(1, 3 if depth else 6)):
            out += self.statement(depth, pad)
            if self.rng.random() < 0.2:
                out.append(self.rng.choice(["", "# import no", "      # odd (", pad + "# (["]))
        return out

    def body(self, head, depth, pad):
        if depth > 3 or self.rng.random() < 0.15:
            return [f"{pad}{head}: {self.rng.choice(['pass', self.simple()])}"]
        return [f"{pad}{head}:" + self.rng.choice(["", "  # so"]), *self.block(depth + 1, pad + self.rng.choice(["  ", "    ", "\t"]))]

    def statement(self, depth, pad):
        n, v = self.name, lambda: self.value(2)
        pick = self.rng.randrange(14)
        if pick < 5:
            return [pad + self.simple()]
        if pick < 8:
            marks = [pad + "@" + self.rng.choice([n(), f"{n()}.{n()}", f"{n()}.{n()}({self.value(3)})", f"{n()}()({v()}).{n()}", f"{n()}[{v()}]"]) for _ in range(self.rng.randrange(3))]
            return [*marks, *self.body(f"{self.rng.choice(['', '', 'async '])}def {n()}({self.arguments()}){self.rng.choice(['', ' -> ' + n()])}", depth, pad)]
        if pick < 10:
            return self.body(f"class {n()}{self.rng.choice(['', '()', f'({n()}, {n()}={v()})'])}", depth, pad)
        if pick == 10:
            out = self.body(f"if {v()}", depth, pad)
            for _ in range(self.rng.randrange(3)):
                out += self.body(f"elif {v()}", depth, pad)
            return out + (self.body("else", depth, pad) if self.rng.random() < 0.5 else [])
        if pick == 11:
            out = self.body("try", depth, pad) + self.body(f"except {n()} as {n()}", depth, pad)
            return out + (self.body("else", depth, pad) if self.rng.random() < 0.4 else []) + (self.body("finally", depth, pad) if self.rng.random() < 0.4 else [])
        if pick == 12:
            return self.body(self.rng.choice([f"for {n()} in {v()}", f"while {v()}", f"with {v()} as {n()}"]), depth, pad)
        return [f"{pad}match {n()}:", *self.body(f"case {n()} if {v()}", depth + 1, pad + "  "), *self.body("case [1, _]", depth + 1, pad + "  ")]

    def text(self):
        return "\n".join(self.block(0, "")) + self.rng.choice(["", "\n", "\n\n# end"])


def test_random_programs():
    right = 0
    for seed in range(1500):
        text = Program(seed).text()
        want = parsed(text)
        got = found(text)
        if want is not None:
            right += 1
            assert got == want, text
    assert right > 800


def test_damaged_programs():
    """One bracket taken out outside of strings: no text passes that Python refuses for it."""
    rng = random.Random(9)
    for seed in range(600):
        text = re.sub(r"#[^\n]*", "", Program(seed).text())
        if parsed(text) is None or any(q in text for q in "\"'") or not set("()[]{}") & set(text):
            text = "def f(a, b=[1, {2: (3, 4)}]):\n    return [g(x)[0] for x in {1, 2}]\n" * (seed % 3 + 1)
        k = rng.choice([k for k, c in enumerate(text) if c in "()[]{}"])
        assert python_symbols(text) is not None and python_symbols(text[:k] + text[k + 1:]) is None


def test_damaged_texts_that_still_parse():
    rng = random.Random(9)
    for seed in range(1000):
        text = Program(seed).text()
        k = rng.randrange(len(text))
        broken = text[:k] + text[k + 1:]
        want = parsed(broken)
        # digits that run into a word are split by Python, with a warning
        if want is not None and not re.search(r"\b\d\w*(?:if|else|and|or|in|is|not)", broken):
            assert found(broken) == want, broken
