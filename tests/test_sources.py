import json

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import text
from sedimenta.operators import cache, scan
from sedimenta.operators.ratelimit import rate_limit_admit
from sedimenta.plans.analysis import Analysis
from sedimenta.session import shared_dir, written
from sedimenta.sources import files as source
from sedimenta.sources import sinks
from sedimenta.streaming import streams


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "proj"
    for path, data in {
        "src/a.py": b"import os\r\nx = 1\n", "bad.py": b"a\xffb", "dist/x.js": b"1", ".env": b"K=1", "README.md": b"# cart and checkout",
        "with space/c d.ts": b"import x from 'y'\npassword='abcdefgh'\n",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    return root


def test_read_files(spark, folder):
    rows = {r.path: r for r in source.read_files(spark, str(folder)).collect()}
    assert rows["src/a.py"].content == "import os\nx = 1\n" and rows["bad.py"].content == "ab" and rows["bad.py"].size == 3
    assert rows["with space/c d.ts"].project == "proj" and len(rows) == 6
    many = source.read_files(spark, str(folder.parent), many_projects=True)
    assert {(r.project, r.path) for r in many.collect()} == {("proj", p) for p in rows}
    assert rows[".env"].content is None and rows["dist/x.js"].content is None
    assert {r.skipped_reason for r in scan.scan(many).collect()} == {None, "env_file", "ignored_folder"}
    assert source.list_files(spark, str(folder)).count() == 6


def test_unreadable_file_is_a_row(spark, folder, monkeypatch):
    import pandas as pd

    pdf = pd.DataFrame({"uri": [str(folder / "gone.py"), str(folder / "bad.py")], "size": [1, 3], "wanted": [True, True]})
    out = pd.concat(source._load(str(folder))(iter([pdf])))
    assert out["content"].tolist() == [None, b"a\xffb"] and "gone.py" in out["read_error"].iloc[0]


def test_parse_manifest(spark):
    df = spark.createDataFrame([('{"dependencies": {"a": "1"}, "x": 2}',), ("{bad",), ("[]",), ("{} {}",)], "c string")
    got = [r[0] for r in df.select(text.parse_manifest(F.col("c"))["dependencies"]).collect()]
    assert got == [{"a": "1"}, None, None, None]


def test_reports_are_complete_documents(spark, folder, tmp_path):
    a = Analysis(source.read_files(spark, str(folder))).settled()
    lines = a.report_lines()
    sinks.write_reports(lines, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "project=proj" / "report=redaction_report").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.startswith("# Redaction Report\n") and "| `with space/c d.ts` | PASSWORD | 1 | `[REDACTED_PASSWORD]` |" in text
    assert "- **Total redactions:** 1" in text
    tree = "".join(p.read_text() for p in sorted((tmp_path / "out" / "project=proj" / "report=file_tree").glob("part-*")))
    assert "proj/\n├── src\n│   └── a.py\n├── with space\n│   └── c d.ts\n├── [SECRET_FILE_SKIPPED: env file]\n├── bad.py\n└── README.md\n" in tree
    report = lines.filter("report = 'scan_report'").orderBy("block", "line_key").collect()
    head = json.loads(report[0].line)
    assert head["statistics"]["files_skipped"] == 2 and head["redaction"]["total_redactions"] == 1
    assert head["scan_id"] == "N/A" and head["ollama"]["summarization_status"] == "skipped_disabled" and head["security_note"]
    assert json.loads(report[-1].line) == {"affected_file": "with space/c d.ts"}
    stack = [r.line for r in lines.filter("report = 'tech_stack'").orderBy("block", "line_key").collect()]
    assert "## Detection Method" in stack and stack[-1].startswith("_Generated")
    assert json.loads(report[1].line) == {"file_path": "with space/c d.ts", "finding_type": "PASSWORD", "count": 1}
    assert {r.report for r in lines.select("report").distinct().collect()} == {
        "project_summary", "file_tree", "tech_stack", "risk_notes", "redaction_report", "scan_report"}
    sinks.write_context(a.context("claude"), str(tmp_path / "ctx"))
    assert (tmp_path / "ctx" / "project=proj" / "target=claude").exists()


def test_incremental_cache(spark, make_files, tmp_path):
    store = cache.SummaryCache(spark, str(tmp_path / "cache"))
    describe = lambda df: df.withColumn("summary", F.concat(F.lit("S:"), "path"))
    first = make_files({"a.py": "1", "b.py": "22"})
    assert cache.incremental_changed(first, store.read(), "fast").count() == 2
    store.save(describe(cache.with_cache_key(first, "fast")))
    assert cache.incremental_changed(first, store.read(), "fast").count() == 0
    assert cache.incremental_changed(first, store.read(), "deep").count() == 2
    later = make_files({"a.py": "1", "b.py": "changed"})
    assert [r.path for r in cache.incremental_changed(later, store.read(), "fast").collect()] == ["b.py"]
    assert cache.refresh(later, store.read(), "fast", describe).count() == 2
    store.save(describe(cache.incremental_changed(later, store.read(), "fast")))
    assert store.read().count() == 2 and store.clear(["other"]) == 0
    assert store.clear() == 2 and store.read().count() == 0


def test_cache_rewrites_touched_buckets_only(spark, make_files, tmp_path):
    store = cache.SummaryCache(spark, str(tmp_path / "cache"), buckets=8)
    describe = lambda df, s: cache.with_cache_key(df, "fast").withColumn("summary", F.lit(s))
    many = {f"f{k}.py": "x" * k for k in range(60)}
    store.save(describe(make_files(many, "one").unionByName(make_files(many, "two")), "old"))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "cache" / "rows").rglob("*.parquet")}
    before = files()
    store.save(describe(make_files({"f7.py": "changed"}, "one"), "new"))
    after = files()
    # one bucket of one project has new files, all others the same ones
    folder = lambda names: {n.rpartition("/")[0] for n in names}
    assert len(folder(set(after) - set(before))) == 1 and folder(set(before) - set(after)) == folder(set(after) - set(before))
    rows = store.read().groupBy("project", "summary").count().collect()
    assert {(r.project, r.summary, r["count"]) for r in rows} == {("one", "old", 59), ("one", "new", 1), ("two", "old", 60)}
    assert store.clear(["one"]) == 60 and {n: t for n, t in after.items() if n in files()} == files()
    assert store.read().count() == 60 and store.clear(["one", "three"]) == 0


def test_cache_after_a_job_that_died(spark, make_files, tmp_path, monkeypatch):
    store = cache.SummaryCache(spark, str(tmp_path / "cache"))
    describe = lambda df, s: cache.with_cache_key(df, "fast").withColumn("summary", F.lit(s))
    store.save(describe(make_files({f"{k}.py": "x" for k in range(20)}), "old"))
    # laid down, but the buckets not replaced, and one of them already gone
    with monkeypatch.context() as m:
        m.setattr(cache.SummaryCache, "_finish", lambda self: self._remove(next(str(p) for p in (tmp_path / "cache" / "rows").glob("part=*/bucket=*"))))
        store.save(describe(make_files({f"{k}.py": "changed" for k in range(20)} | {"n.py": ""}), "new"))
    found = cache.SummaryCache(spark, str(tmp_path / "cache")).read().groupBy("summary").count().collect()
    assert {(r.summary, r["count"]) for r in found} == {("new", 21)}
    # a half laid down save was never promised
    (tmp_path / "cache" / "_ahead").mkdir()
    (tmp_path / "cache" / "_ahead" / "part-0.parquet").write_bytes(b"half")
    assert store.read().count() == 21 and store.clear() == 21 and store.read().count() == 0


def drain(stream, tmp_path, name):
    out = str(tmp_path / name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_stream_redact_equals_batch(spark, folder, tmp_path):
    done = drain(streams.stream_redact(source.stream_files(spark, str(folder), max_files=2)), tmp_path, "redacted")
    batch = scan.scan(source.read_files(spark, str(folder))).filter("skipped_reason is null")
    assert {(r.path, r.redacted_text) for r in done.collect()} == {(r.path, r.content_preview) for r in batch.collect()}


def test_stream_admit_equals_batch(spark, tmp_path):
    rows = [(u, u * 1000 + i, 1_700_000_000 + i * (7 + u)) for u in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "user int, id int, s bigint").select("user", "id", F.timestamp_seconds("s").alias("ts"))
    for n, part in enumerate((df.filter("id % 1000 < 30"), df.filter("id % 1000 >= 30"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    done = drain(streams.stream_admit(stream, "user", "ts", "id", 2, 60, delay="1 day"), tmp_path, "admitted")
    batch = rate_limit_admit(df, "user", "ts", "id", 2, 60)
    assert {tuple(r) for r in done.collect()} == {tuple(r) for r in batch.collect()}


def test_stream_admit_of_a_hot_key(spark, tmp_path):
    """One key with all events in each trigger, in chunks of a few rows and out of order."""
    rows = [(1, 1000 + ((k * 7919) % 4000) / 4, k) for k in range(4000)] + [(2, 1005.0, 9000), (2, 1900.0, 9001)]
    df = spark.createDataFrame(rows, "user int, at double, id int").select("user", "id", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")).alias("ts"))
    for part in (df.filter("ts < timestamp_seconds(1400)"), df.filter("ts >= timestamp_seconds(1400)")):
        part.repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, 100)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
        done = drain(streams.stream_admit(stream, "user", "ts", "id", 3, 60, delay="1 day"), tmp_path, "hot")
    finally:
        spark.conf.set(name, old)
    batch = rate_limit_admit(df, "user", "ts", "id", 3, 60)
    got = [tuple(r) for r in done.collect()]
    assert len(got) == len(rows) and set(got) == {tuple(r) for r in batch.collect()}


def test_incremental_stream(spark, folder, tmp_path):
    store = cache.SummaryCache(spark, str(tmp_path / "cache"))
    sink = streams.incremental_sink(store, "fast", lambda df: df.withColumn("summary", F.lit("s")))
    for _ in range(2):
        query = source.stream_files(spark, str(folder)).writeStream.foreachBatch(sink).option(
            "checkpointLocation", str(tmp_path / f"state{_}")).trigger(availableNow=True).start()
        query.awaitTermination()
        # .env is hidden from the streaming source
        assert store.read().count() == 5


def test_written_uses_shared_dir(spark):
    df = written(spark.range(5), "numbers")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    """A larger table is a folder of part files: every row arrives, as from the one file."""
    from sedimenta.plans import catalog

    for name in ("documents", "events"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (catalog.stream_redact, catalog.stream_rate_limit):
        parts, whole = (sorted(map(str, query(spark, sf).collect())) for sf in (str(tmp_path), "/root/testdata/sf0.001"))
        assert parts == whole and whole


def test_summaries_read_redacted_texts_from_a_table(spark):
    """Winners are redacted once and written; the summary's searches do not plan the redaction again."""
    from sedimenta.plans import catalog

    read = catalog.structural_summary(spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not any("documents.parquet" in f for f in read)
