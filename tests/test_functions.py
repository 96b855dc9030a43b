import random
import re

import pytest
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import labels, paths, text
from sedimenta.functions.dialect import portable


def test_path_parts(one):
    names = ["a/B.TS", ".env", "x/.env.example", "Makefile", "a.tar.gz", "d.e/f"]
    assert one(paths.suffix, *names) == [".ts", "", ".example", "", ".gz", ""]
    assert one(paths.file_name, *names) == ["B.TS", ".env", ".env.example", "Makefile", "a.tar.gz", "f"]
    assert one(paths.module, "src/a/b.py", "b.py") == ["src", "root"]
    assert one(paths.normalized, "a\\b\\c.py") == ["a/b/c.py"]


def test_skip_reason_order(one):
    cases = {
        ".env": "env_file", ".env.local": "env_file", "x/.env.example": "env_file", "id_rsa": "secret_file",
        "Thumbs.db": "secret_file", "server.pem": "secret_extension", "a.LOG": "secret_extension", "logo.PNG": "binary_or_asset",
        "data.sqlite": "binary_or_asset", "yarn.lock": "lock_file", "package-lock.json": "lock_file", "app.MIN.js": "minified",
        "a.txt": "unsupported_extension", "b.gradle": "unsupported_extension", "Dockerfile": None, "LICENSE": None,
        "a.py": None, "environment.ts": None,
    }
    assert dict(zip(cases, one(paths.skip_reason, *cases))) == cases


def test_ignored_prefix_is_outermost(one):
    got = one(paths.ignored_prefix, "media/temp_audios/a.mp3", "src/build/x/dist/y.js", "builder/a.py", "dist", "a/Dist/b.py", "node_modules/a.js")
    assert got == ["media", "src/build", "", "", "", "node_modules"]
    assert one(lambda c: paths.ignored_prefix(c, ["/docs/ "]), "a/docs/x.md", "docs.md") == ["a/docs", ""]


def test_normalize_excludes():
    assert paths.normalize_excludes([" docs/ ", "/x", "", "  "]) == ("docs", "x")
    for bad in ("../up", "/x/../y"):
        with pytest.raises(ValueError):
            paths.normalize_excludes([bad], strict=True)


def plain_score(path):
    low = path.lower().replace("\\", "/")
    if any(re.search(p, low) for p in rules.LOW_PRIORITY_PATTERNS):
        return 5
    best = max([10] + [s for s, p in rules.PRIORITY_PATTERNS if re.search(p, low)])
    return max(best, 80) if low.split("/")[-1] in rules.PRIORITY_NAMES else best


def test_priority_score_equals_plain_loop(one):
    stems = ["main", "index", "app", "server", "routes", "api", "auth", "user_service", "model", "models", "config", "util", "x.test",
             "README", "package", "Dockerfile", "schema", "conftest", "pytest", "handlers", "a.generated", "lib.min", "migrations/001", "tests/t"]
    exts = ["", ".py", ".ts", ".js", ".json", ".md", ".java", ".sql", ".css", ".ini", ".prisma"]
    folders = ["", "src/", "dist/", "a/generated/", "test/", "Migrations/", ".next/"]
    every = [f + s + e for f in folders for s in stems for e in exts]
    assert one(paths.priority_score, *every) == [plain_score(p) for p in every]


def test_size_labels(one):
    assert one(paths.size_tier, 51199, 51200, 102400, kind="bigint") == [None, "large", "critical"]
    sizes = [0, 16, 80, 128, 256, 384, 1536, 2560, 51200, 99_999, 1_234_567]
    assert one(lambda c: paths.size_kb_text(c, 1), *sizes, kind="bigint") == [f"{s / 1024:.1f}" for s in sizes]
    assert one(lambda c: paths.size_kb_text(c, 0), *sizes, kind="bigint") == [f"{s / 1024:.0f}" for s in sizes]


def test_secret_file_category(one):
    got = one(paths.secret_file_category, ".env.prod", "a.key", "id_ed25519", "a.py", "a.log")
    assert got == ["env file", "private key/certificate", "credential file", None, None]


def plain_truncate(s, cap):
    def mark(n):
        return f"... [MIDDLE SECTION OMITTED — {n} chars] ..."
    if len(s) <= cap:
        return s
    if cap <= 0:
        return mark(len(s))
    room = cap - len(f"\n\n{mark(len(s))}\n\n")
    if room <= 0:
        return f"\n\n{mark(len(s))}\n\n"
    head = int(room * 0.70)
    tail = room - head
    return s[:head] + f"\n\n{mark(len(s) - room)}\n\n" + s[len(s) - tail:]


@pytest.mark.parametrize("cap", [0, 10, 47, 48, 60, 100, 3000])
def test_truncate_equals_plain_loop(one, cap):
    texts = ["", "abcdef", "H" * 70 + "M" * 60 + "T" * 30, "é" * 5000, "x" * 100, "y" * 3001]
    assert one(lambda c: text.head_tail_truncate(c, cap), *texts) == [plain_truncate(t, cap) for t in texts]


def test_truncate_known_numbers(one):
    out = one(lambda c: text.head_tail_truncate(c, 100), "H" * 70 + "M" * 60 + "T" * 30)[0]
    assert out.count("H") >= 36 and out.endswith("T" * 16) and "108 chars" in out and len(out) <= 100


def plain_redact(s):
    found = {}
    for name, pattern, placeholder in rules.SECRET_RULES:
        hits = len(re.findall(pattern, s))
        if hits:
            found[name] = hits
            s = re.sub(pattern, lambda m, p=placeholder: m.group(1) + p + m.group(3), s)
    return s, found


def secret_texts(n=400):
    rng = random.Random(7)
    keys = ["api_key", "API-KEY", "apikey", "access_token", "jwt-secret", "password", "db_pass", "secret_key", "client-secret",
            "database_url", "DB_URL", "aws_access_key_id", "token", "credential", "key", "connection_string", "pa\u017fsword", "note"]
    values = ["A1b2" * 6, "short", "x" * 40, "postgres://u:p@h/db", "se cret", "[REDACTED_SECRET]", "a.b-c_d" * 5, "é" * 8, "-----BEGIN RSA PRIVATE KEY-----"]
    seps = ["=", ": ", " = ", "\u00a0=\u00a0", " ", ":\n"]
    quotes = ["", "'", '"']
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            quote = rng.choice(quotes)
            parts.append(rng.choice(keys) + rng.choice(seps) + quote + rng.choice(values) + quote)
        out.append(rng.choice(["\n", " ", "; "]).join(parts))
    return out


def test_redaction_equals_plain_loop(spark):
    texts = secret_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = text.with_redaction(df, "x").orderBy("i").collect()
    for row, source in zip(rows, texts):
        expected, found = plain_redact(source)
        assert row.redacted_text == expected
        assert {f.finding_type: f["count"] for f in row.findings} == found
    assert sum(bool(r.findings) for r in rows) > 200


def test_a_text_goes_only_through_rules_it_may_match(spark):
    # each rule alone would match the text behind its name
    texts = {
        "API_KEY": "API-KEY: " + "a" * 20, "TOKEN": "jwt_secret=" + "b" * 20, "PASSWORD": "db_pass = changeme", "AWS_KEY": "aws-access-keyid=" + "c" * 16,
        "PRIVATE_KEY": "-----BEGIN PRIVATE KEY-----", "SECRET": "app_secret: " + "d" * 16, "CONNECTION_STRING": "dbUrl=my://u:p@h",
        "GENERIC_SECRET": "credential='" + "e" * 32 + "'",
    }
    names = [name for name, _, _ in rules.SECRET_RULES]
    every = [*texts.values(), *secret_texts(100), "pa\u017fsword=changeme", "\u212aey = '" + "f" * 32 + "'", "plain text: nothing = here"]
    df = spark.createDataFrame(list(enumerate(every)), "i int, x string").withColumn("low", F.lower("x"))
    rows = df.select("x", *[text.may_hold_secret(F.col("x"), F.col("low"), name).alias(name) for name in names]).orderBy("i").collect()
    for row in rows:
        left = row.x
        for name, pattern, placeholder in rules.SECRET_RULES:
            assert row[name] or not re.search(pattern, left), (name, row.x)
            left = re.sub(pattern, lambda m, p=placeholder: m.group(1) + p + m.group(3), left)
    for name, row in zip(texts, rows):
        assert row[name]
    assert not any(rows[-1][name] for name in names)
    assert [name for name in names if rows[2][name]] == ["PASSWORD"]


def test_redaction_column_form_and_suspicion(one):
    texts = secret_texts(100) + ["-----begin private key-----", "nothing here"]
    assert one(text.redact_secrets, *texts) == [plain_redact(t)[0] for t in texts]
    plain = [any(re.search(p, t, re.IGNORECASE) for _, p, _ in rules.SECRET_RULES) for t in texts]
    assert one(text.has_suspicious_content, *texts) == plain


def test_connection_string_is_bounded(one):
    long = "database_url=postgres://" + "u" * 300 + ":p@h/x"
    assert one(text.redact_secrets, long) == [long]


def test_indicator_word_rule(spark):
    cases = [("my cart", "cart", True), ("my_cart", "cart", False), ("écart", "cart", False), ("cartoon", "cart", False), ("pytorch", "torch", True),
             ("s3s", "s3", True), ("limit order now", "limit order", True), ("", "cart", False), ("cart", "cart", True)]
    for low, word, expected in cases:
        assert spark.createDataFrame([(low,)], "x string").select(text.match_indicator("x", word)).first()[0] is expected, (low, word)


def test_lines_and_preview(one):
    texts = ["a\nb\n", "", "a\r\n\r\nb", "\n\n x \n", "a\x0bb\u2028c", "\n".join(map(str, range(30)))]
    assert one(text.lines, *texts) == [t.splitlines() for t in texts]
    plain = ["\n".join("  " + s for s in t.splitlines()[:15] if s.strip()) for t in texts]
    assert one(text.preview_lines, *texts) == plain


def test_preview_of_few_lines_splits_each_text_once(spark, one):
    texts = ["a\nb\n", "", "\n\n x \n", "a\r\nb\r\nc\r\n", "a\nb\nc", "a\n\u00a0\nb", "a\n\n", None]
    for n in (1, 2, 3):
        for blank in (False, True):
            plain = [None if t is None else "\n".join("  " + s for s in t.splitlines()[:n] if blank or s.strip()) for t in texts]
            assert one(lambda c, n=n, blank=blank: text.preview_lines(c, n, blank), *texts) == plain, (n, blank)
    df = spark.createDataFrame([(1, "a")], "i int, x string")
    shown = F.when(F.col("i") == 1, text.preview_lines(F.col("x"), 2)).when(F.col("i") == 2, text.preview_lines(F.col("x"), 2, True))
    plan = df.select(shown.alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(x") == 2


def test_decode_text(one):
    raw = [b"ok\r\nx\ry", b"a\xffb\xc3", "é\ufffd".encode()]
    assert one(text.decode_text, *raw, kind="binary") == ["ok\nx\ny", "ab", "é\ufffd"]


def test_requirement_names(one):
    got = one(text.requirement_names, "Flask==1\n# no\n\n numpy >=2 \nuvicorn[standard]>=0.1\nx<=3")
    assert got == [["flask", "numpy", "uvicorn", "x"]]


def test_portable_classes(spark):
    samples = ["a\u00a0b", "é_1", "a b", "\u2003x", "line\rend"]
    for pattern in (r"a\sb", r"^\w+$", r"[\w.]+\s", r"(?m)^end", r"(?i)\bA"):
        for s in samples:
            got = spark.createDataFrame([(s,)], "x string").select(F.col("x").rlike(portable(pattern))).first()[0]
            assert got == bool(re.search(pattern, s)), (pattern, s)


def test_modes_and_labels(spark):
    with pytest.raises(ValueError):
        labels.check_mode("turbo")
    with pytest.raises(ValueError):
        labels.check_targets("unknown")
    assert labels.check_targets(" ALL ") == rules.TARGETS
    rows = [("fast", True), ("balanced", True), ("balanced", False), ("deep", True), ("deep", False)]
    df = spark.createDataFrame(rows, "mode string, e boolean")
    got = df.select(labels.evidence_level(F.col("mode"), F.col("e")), labels.uses_enrichment(F.col("mode"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("limited", False), ("medium", True), ("medium", False), ("high", True), ("limited", False)]
    assert rules.DOMAIN_SECTIONS.get("ecommerce").startswith("## Special Domain Risk: E-commerce / Payments\n\n⚠ This")
