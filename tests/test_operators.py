import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.plans import catalog
from sedimenta.operators import context, domain, notes, ranking, ratelimit, scan, skew, summaries, tech, tree
from sedimenta.plans.analysis import Analysis


def hot_rows(n=3000, seed=3):
    """One group holds a third of all rows."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.34 else f"g{rng.randrange(40)}", i, rng.randrange(0, 50)) for i in range(n)]


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame(hot_rows(), "k string, i int, v int")
    right = spark.createDataFrame([("hot", 1)] + [(f"g{i}", i) for i in range(20)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.salted_join(left, right, ["k"], ["i"], how)
        expected = left.join(right, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(*got.columns).collect())), how


@pytest.mark.parametrize("block", [1, 3, 16])
def test_prefix_sum_equals_loop(spark, block):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.i: r.before for r in skew.prefix_sum(df, ["k"], "i", "v", "before", block).collect()}
    running, expected = {}, {}
    for k, i, v in rows:
        expected[i] = running.get(k, 0)
        running[k] = expected[i] + v
    assert got == expected


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_prefix_sum_over_any_order(spark, kind):
    """Sparse, negative and text orders, null groups, ties, and as many ranges as asked for, not as numbers lie apart."""
    rng = random.Random(3)
    rows = [(g, (k - 150) * 1_000_000, rng.randint(0, 9)) for k in range(300) for g in (None, "a")]
    df = spark.createDataFrame(rows, "g string, o bigint, v int").withColumn("o", F.col("o").cast(kind))
    got = {(r.g, r.o): r.before for r in skew.prefix_sum(df, ["g"], "o", "v", "before", 7).collect()}
    seen, want = {}, {}
    for g, o, v in sorted(((r.g, r.o, r.v) for r in df.collect()), key=lambda r: r[1]):
        want[g, o], seen[g] = seen.get(g, 0), seen.get(g, 0) + v
    assert got == want
    tied = spark.createDataFrame([("a", 1, 5)] * 4 + [("a", 2, 1)], "g string, o int, v int")
    assert sorted(r.before for r in skew.prefix_sum(tied, ["g"], "o", "v", "before", 3).collect()) == [0, 5, 10, 15, 20]


def plain_budget(texts, per_item, total):
    used, out = 0, []
    for t in texts:
        left = total - used
        if left <= 0:
            out.append(("(preview omitted: size budget reached)", True))
            continue
        cap = min(per_item, left)
        if len(t) > cap:
            out.append((f"{t[:cap]}\n\n...(preview truncated after {cap} characters)", True))
            used += cap
        else:
            out.append((t, False))
            used += len(t)
    return out


def test_budget_equals_loop(spark):
    rng = random.Random(5)
    rows = [(k, i, "x" * rng.choice([0, 1, 5, 30, 90])) for i, (k, _, _) in enumerate(hot_rows(400))]
    df = spark.createDataFrame(rows, "k string, i int, text string")
    for per_item, total in ((20, 200), (50, 1000), (5, 0)):
        got = {r.i: (r.preview, r.truncated) for r in context.budget_pack(df, ["k"], "i", per_item=per_item, total=total).collect()}
        for group in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == group]
            for (_, i, _), expected in zip(mine, plain_budget([t for _, _, t in mine], per_item, total)):
                assert got[i] == expected


def event_rows(n=1500):
    rng = random.Random(11)
    base = 1_700_000_000
    out = []
    for i in range(n):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 12)
        out.append((key, float(base + rng.choice([rng.randrange(0, 900), rng.randrange(5000, 5400)]) + rng.choice([0, 0.25, 0.5])), i))
    return out


def events(spark, rows):
    df = spark.createDataFrame(rows, "user int, at double, id int")
    return df.select("user", "id", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")).alias("ts"))


def plain_admit(rows, limit, window):
    out = {}
    for key in {r[0] for r in rows}:
        taken = deque()
        for _, at, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            while taken and taken[0] < at - window:
                taken.popleft()
            if len(taken) >= limit:
                out[i] = (False, max(1, int(window + 1 - (at - taken[0]))))
            else:
                taken.append(at)
                out[i] = (True, 0)
    return out


@pytest.mark.parametrize("limit,window", [(1, 10), (3, 60), (60, 60), (0, 60)])
def test_admission_equals_loop(spark, limit, window):
    rows = event_rows()
    got = {r.id: (r.admitted, r.retry_after) for r in ratelimit.rate_limit_admit(events(spark, rows), "user", "ts", "id", limit, window).collect()}
    assert got == (plain_admit(rows, limit, window) if limit else {i: (True, 0) for _, _, i in rows})


@pytest.mark.parametrize("limit,window,block_events,rounds", [(1, 10, 40, 6), (3, 60, 100, 6), (60, 60, 150, 6), (2, 7, 30, 1), (3, 60, 1, 0)])
def test_one_key_that_is_never_idle(spark, limit, window, block_events, rounds):
    """All events of one key without an empty window: worked on in blocks, equal to the loop."""
    rng = random.Random(limit)
    at, rows = 0.0, []
    for i in range(2500):
        at += rng.choice([0, 0.25, 0.5, 1, 2, 4])
        rows.append((1, at, i))
    rows += [(2, float(k), 5000 + k) for k in range(5)]
    done = ratelimit.admission(events(spark, rows).repartition(4), "user", "ts", "id", limit, window, block_events, rounds)
    got = done.rows.collect()
    assert len(got) == len(rows) and {r.id: (r.admitted, r.retry_after) for r in got} == plain_admit(rows, limit, window)
    assert done.rounds <= rounds + 1 and (done.in_sequence <= 1)
    if rounds == 0:
        assert done.in_sequence == 1 and done.reruns == 0


def test_blocks_that_agree_are_not_run_again(spark):
    """Nothing is refused, so the guess from the windows before a block is right and one round does."""
    rows = [(1, float(k), k) for k in range(3000)]
    done = ratelimit.admission(events(spark, rows), "user", "ts", "id", 60, 50, 100)
    assert done.rows.filter("admitted").count() == 3000 and (done.rounds, done.reruns, done.in_sequence) == (0, 0, 0)


def test_malformed_limit():
    assert ratelimit.checked_limit("abc") == 60 and ratelimit.checked_limit(None) == 60 and ratelimit.checked_limit("3") == 3


@pytest.mark.parametrize("splits", [1, 4, 60])
def test_window_count_equals_loop(spark, splits):
    rows = event_rows(800)
    got = {r.id: r.n_requests for r in ratelimit.window_request_count(events(spark, rows), "user", "ts", "id", 60, splits).collect()}
    assert got == {i: sum(1 for k, t, _ in rows if k == key and at - 60 <= t <= at) for key, at, i in rows}


def test_retention_equals_eviction_loop(spark):
    for n in (0, 4, 5, 6, 7, 99, 100, 101, 115, 260):
        for max_rows, batch in ((5, 2), (100, 10), (5, 50)):
            left = list(range(n))
            while len(left) >= max_rows:
                left = left[batch:]
            assert ranking.retained_count(n, max_rows, batch) == len(left), (n, max_rows, batch)
    df = spark.createDataFrame([("a", i) for i in range(115)] + [("b", i) for i in range(5)], "k string, i int")
    kept = ranking.retain_newest(df, ["k"], [F.col("i").desc()]).collect()
    assert sorted(r.i for r in kept if r.k == "a") == list(range(20, 115)) and sum(r.k == "b" for r in kept) == 5


def test_scan_rows(make_files):
    files = make_files({
        "src/a.py": 'password = "hunter2hunter2"\n', "media/temp_audios/x.mp3": "", "media/y.py": "", "b.txt": "", "lost.py": None, "win\\c.ts": "x",
    })
    rows = {r.path: r for r in scan.scan(files).collect()}
    assert rows["media"].skipped_reason == "ignored_folder" and rows["media"].size == 0 and "media/y.py" not in rows
    assert rows["b.txt"].skipped_reason == "unsupported_extension" and rows["b.txt"].content_preview is None
    assert rows["lost.py"].skipped_reason == "read_error: unreadable" and rows["win/c.ts"].skipped_reason is None
    assert rows["src/a.py"].redacted and rows["src/a.py"].content_preview == 'password = "[REDACTED_PASSWORD]"\n'
    stats = scan.scan_stats(scan.scan(files)).first()
    assert (stats.files_found, stats.files_scanned, stats.files_skipped, stats.files_redacted) == (5, 2, 3, 1)


def test_top_files_order_and_limit(make_files):
    files = make_files({f"src/file{i:03d}.ts": "x" for i in range(200)} | {"README.md": "r", "src/main.py": "m"})
    rows = ranking.top_files(scan.scan(files), 5).orderBy("rank").collect()
    assert [r.path for r in rows] == ["README.md", "src/main.py", "src/file000.ts", "src/file001.ts", "src/file002.ts"]


def detected(files):
    return {(r.category, r.item): r.sources for r in tech.tech_items(files, scan.scan(files)).collect()}


def test_tech_rules(make_files):
    got = detected(make_files({
        "package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"vitest": "1"}}', "yarn.lock": "", "tsconfig.json": "{}",
        "pyproject.toml": "[project] deps fastapi redis deepgram", "requirements.txt": "Flask==2\ntorch>=1", "a/b/schema.prisma": "postgresql",
        "docker-compose.yml": "image: mysql", "readme.md": "uses redis", "x.py": "import redis",
    }))
    assert ("frameworks", "React") in got and ("languages", "TypeScript") in got and ("package_managers", "yarn") in got
    assert ("package_managers", "pip/poetry") in got and ("package_managers", "pip") not in got
    assert got["databases", "Redis"] == ["config", "docs", "imports"] and ("libraries", "PyTorch") in got
    assert ("databases", "PostgreSQL") in got and ("databases", "MySQL") in got and ("tools", "Docker") in got
    assert ("ai_services", "Deepgram") not in got and ("frameworks", "Flask") in got


def test_tech_tolerates_bad_json_and_shadowing(make_files):
    got = detected(make_files({"package.json": "{oops", "build.gradle": "x", "build.gradle.kts": "spring-boot", "node_modules/a/b.cs": ""}))
    assert {i for _, i in got} == {"JavaScript", "npm", "Node.js", "Java", "Gradle", "C#", ".NET"}


def classify(make_files, contents, project="p"):
    return Analysis(make_files(contents, project)).domain.first()


def test_domain_cases(make_files):
    assert classify(make_files, {"a.py": "x = 1"}).domain == "generic"
    trading = classify(make_files, {"src/binance_portfolio.py": "x", "README.md": "a trading bot for futures"})
    assert trading.domain == "trading_fintech" and trading.confidence == "high"
    single = classify(make_files, {"requirements.txt": "pandas", "a.md": "hello"})
    assert (single.domain, single.confidence) == ("data_science", "medium")


def test_domain_scores_count_rows(spark):
    texts = spark.createDataFrame([("p", "file_path", f"cart/{i}.py", f"cart/{i}.py") for i in range(3)], "project string, channel string, path string, text string")
    row = domain.domain_scores(domain.domain_evidence(texts)).filter("domain = 'ecommerce'").first()
    assert (row.score, row.strong_count, row.matched, row.confidence) == (15, 3, ["cart"], "high")


def test_audit_and_plan(make_files):
    bare = make_files({"a.py": "x"})
    assert [r.ord for r in notes.repo_audit(bare).orderBy("ord").collect()] == [0, 1, 2, 3, 4, 5]
    full = make_files({"tests/t.py": "", ".github/workflows/ci.yml": "", "SECURITY.md": "", "pyproject.toml": "[tool.coverage.run]", "uv.lock": ""})
    assert notes.repo_audit(full).count() == 0
    plan = notes.upgrade_plan(full.select("project").distinct(), notes.repo_audit(full)).first().plan
    assert plan.endswith("## Current Findings\n" + rules.NO_AUDIT_FINDINGS + "\n")


def test_tree(make_files):
    files = make_files({"b.py": "", "A/z.py": "", "A/sub/k.pem": "", "A/sub/Q.py": "", "dist/x.js": "", "c/node_modules/y.js": "", ".env": "", "/".join("abcdefghijk"): ""})
    lines = [r.line for r in tree.dir_tree(files).orderBy("sort_key").collect()]
    assert lines[:8] == [
        "p/", "├── A", "│   ├── sub", "│   │   ├── [SECRET_FILE_SKIPPED: private key/certificate]", "│   │   └── Q.py", "│   └── z.py", "├── a", "│   └── b",
    ]
    assert lines[-3:] == ["├── c", "├── [SECRET_FILE_SKIPPED: env file]", "└── b.py"]
    assert any(x.endswith("└── i") for x in lines) and not any(x.endswith("└── j") for x in lines)
    head = tree.tree_head(tree.dir_tree(files), 40).first().tree_head
    assert head == "\n".join(lines)[:40] + "...[truncated]"


def test_context_and_targets(make_files):
    a = Analysis(make_files({f"src/f{i:02d}.ts": "x" for i in range(45)} | {"README.md": "readme text " * 60}), max_files=40)
    rows = a.context("all").collect()
    count = lambda t, s: sum(r.target == t and r.section == s for r in rows)
    assert count("minimax", "important_files") == 20 and count("chatgpt", "important_files") == 30
    assert count("minimax", "file_summaries") == 30 and count("generic", "file_summaries") == 40
    short = next(r.text for r in rows if r.target == "minimax" and r.section == "file_summaries" and "README" in r.text)
    assert short.endswith("...") and len(short) == len("[README.md] ") + 303
    assert next(r.text for r in rows if r.target == "claude" and r.section == "redaction") == "No secrets were detected or redacted."
    assert {r.target for r in a.context("gemini").collect()} == {"gemini"}
    with pytest.raises(ValueError):
        a.context("nobody")


def test_risk_notes_texts(make_files):
    a = Analysis(make_files({"package.json": "{}", ".env.example": "", "src/a.ts": "token = '" + "F" * 40 + "'"}))
    texts = [r.note for r in a.risk_notes.orderBy("ord").collect()]
    assert texts[0] == "WARNING: 1 secret pattern(s) detected and redacted in 1 file(s): src/a.ts"
    assert texts[1].startswith("No .env.example") and texts[-1].startswith("INFO: .env.example") and len(texts) == 7


def test_dry_run(make_files):
    a = Analysis(make_files({"README.md": "x", "package.json": "{}"}), dry_run=True)
    row = ranking.dry_run_preview(a.selected, a.tech, a.projects).first()
    assert row.files == "[90] README.md\n[85] package.json" and row.estimated_outputs == 11 and "Node.js" in row.detected
    assert a.summaries.count() == 0 and ranking.output_count("claude") == 7


def test_times_without_zone_do_not_follow_the_session(spark):
    """Across the end of daylight saving in New York the answers are those of UTC."""
    rows = [(i, "u", s) for i, s in enumerate(["2024-11-03 00:30:00", "2024-11-03 01:15:00", "2024-11-03 02:00:00", "2024-11-03 02:45:00.25"])]
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = {}
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            events = spark.createDataFrame(rows, "event_id int, user string, s string").selectExpr("event_id", "user", "cast(s as timestamp_ntz) as ts")
            counts = ratelimit.window_request_count(events, "user", "ts", "event_id", 3600)
            admitted = ratelimit.rate_limit_admit(events, "user", "ts", "event_id", 1, 3600)
            found[z] = (sorted(map(tuple, counts.collect())), sorted(map(tuple, admitted.collect())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found["UTC"] == found["America/New_York"]
    assert [r[2] for r in found["UTC"][0]] == [1, 2, 2, 2]


def test_admission_in_pieces():
    import numpy as np

    rng = random.Random(2)
    times = np.sort(np.array([rng.randrange(300) * 500_000 for _ in range(400)]))
    whole = ratelimit.Admitted(5, 10).walk(times)
    kept, parts = (), []
    for k in range(0, 400, 37):
        state = ratelimit.Admitted(5, 10, kept)
        parts.append(state.walk(times[k:k + 37]))
        kept = state.times()
    assert all((np.concatenate(p) == w).all() for p, w in zip(zip(*parts), whole))
    latest = []
    for now, ok in zip(times.tolist(), whole[0].tolist()):
        inside = [t for t in latest if t >= now - 10_000_000]
        assert ok == (len(inside) < 5)
        latest += [now] if ok else []


def test_many_short_keys_leave_a_batch_as_one():
    """The work of a batch does not hang on the number of its keys: 20,000 keys give one batch, equal to the loop."""
    import numpy as np
    import pandas as pd

    rows = [(k, float(t), 10 * k + i) for k in range(20_000) for i, t in enumerate((0, 20, 30, 100) if k % 50 == 0 else (0, 70))]
    pdf = pd.DataFrame({"user": [r[0] for r in rows], "id": [r[2] for r in rows], "_us": [int(r[1] * 1_000_000) for r in rows]})
    walk = ratelimit._walk_keys("user", "id", 2, 60)
    whole = list(walk(iter([pdf])))
    assert len(whole) == 1
    pieces = pd.concat(walk(pdf.iloc[k:k + 27] for k in range(0, 999, 27)))
    want = plain_admit([r for r in rows if r[0] < 1000], 2, 60)
    for got in (whole[0][whole[0].user < 1000], pieces):
        assert all(want[i] == (ok, wait) for i, ok, wait in zip(got.id, got.admitted, got.retry_after))


def test_a_key_that_stays_full_is_settled_after_few_rounds(spark):
    """Every guess is wrong and stays so: no block is run again round after round, and the answers are the loop's."""
    rows = [(1, k * 0.5, k) for k in range(4000)]
    done = ratelimit.admission(events(spark, rows), "user", "ts", "id", 3, 60, 100)
    assert {r.id: (r.admitted, r.retry_after) for r in done.rows.collect()} == plain_admit(rows, 3, 60)
    assert done.rounds <= 2 and done.reruns <= 40


def test_top_rows_beyond_the_group_limit(spark):
    df = spark.range(3000).selectExpr("id % 2 as g", "cast(id * 7919 % 3001 as int) as v", "id")
    for k in (1000, 1001, 1400):
        got = {(r.g, r.id): r["rank"] for r in skew.top_rows(df, ["g"], [F.col("v"), F.col("id")], k).collect()}
        want = {}
        for g in (0, 1):
            rows = sorted((i * 7919 % 3001, i) for i in range(3000) if i % 2 == g)[:k]
            want |= {(g, i): n + 1 for n, (_, i) in enumerate(rows)}
        assert got == want


def test_manifests_that_are_no_json_object(make_files, spark):
    from sedimenta.operators.tech import _dependency_names

    texts = ['{"dependencies": {"react": "1", "react": "2"}}', '{"dependencies": {"a": "1"}, "dependencies": {"b": {"x": 1}}}\n',
             '{"dependencies": {"a": "1"}} x', '{"dependencies": {"a": "1"}', '{"dependencies": ["a"]}', "", None, '{}, {"dependencies": {"a": "1"}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n or [] for r in df.orderBy("i").select(_dependency_names(F.col("t"), "dependencies", "devDependencies").alias("n")).collect()]
    assert got == [["react"], ["b"], [], [], [], [], [], []]


def test_winning_evidence_searches_texts_once(spark):
    rows = catalog.winning_evidence(spark, "/root/testdata/sf0.001")
    # the searches are behind it: evidence comes from a written table, for the scores and for the list
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() > 0


def replacements(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")


def with_and_without_text(make_files):
    return make_files({"src/a.py": "password = 'hunter2hunter2'", "src/empty.py": "", "src/lost.py": None, "top.py": "x"}, size=60 * 1024)


def test_large_file_notes_redact_once(make_files):
    """Each rule replaces in one place of the plan; the condition on the text's length does not hold the rules again."""
    files = with_and_without_text(make_files)
    few = ranking.top_files(scan.scan(files, secret_rules=rules.SECRET_RULES[:3]), 9)
    assert replacements(summaries.large_file_notes(few)) == 3
    notes = summaries.large_file_notes(Analysis(files).selected)
    assert replacements(notes) == len(rules.SECRET_RULES)
    assert sorted(r.path for r in notes.collect()) == ["src/a.py", "top.py"]


def test_module_rollup_redacts_once(make_files):
    files = with_and_without_text(make_files)
    few = ranking.top_files(scan.scan(files, secret_rules=rules.SECRET_RULES[:3]), 9)
    assert replacements(summaries.module_rollup(few)) == 3
    rows = summaries.module_rollup(Analysis(files).selected)
    assert replacements(rows) == len(rules.SECRET_RULES)
    assert {(r.module, r.n_files, r.text) for r in rows.collect()} == {("src", 1, "Module 'src': src/a.py"), ("root", 1, "Module 'root': top.py")}
