"""Named queries over the shipped tables; each reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import labels, paths, symbols, text
from sedimenta.operators import cache, context, domain, notes, ranking, ratelimit, scan, summaries, tech, tree
from sedimenta.plans.analysis import Analysis
from sedimenta.session import scratch_path, written
from sedimenta.sources import corpus
from sedimenta.streaming import streams

DAY = 86_400
RATE_LIMIT_PER_DAY = 2
ONE_KEY_LIMIT = 50


def files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.project_files(spark, sf)


def analysis(spark: SparkSession, sf: str, **kw) -> Analysis:
    return Analysis(files(spark, sf), **kw)


def _joined(column: str) -> F.Column:
    return F.array_join(column, ", ").alias(column)


# --- paths -----------------------------------------------------------------------------------------


def path_parts(spark, sf):
    p = F.col("path")
    return files(spark, sf).select(
        "project", "path", paths.file_name(p).alias("name"), paths.suffix(p).alias("extension"), paths.folder(p).alias("folder"),
        paths.module(p).alias("module"), paths.depth(p).alias("depth"),
    )


def path_rules(spark, sf):
    p, size = F.col("path"), F.col("size")
    return files(spark, sf).select(
        "project", "path", paths.skip_reason(p).alias("skip_reason"), paths.ignored_prefix(p).alias("ignored_prefix"),
        paths.is_lock_file(p).alias("is_lock"), paths.is_minified(p).alias("is_minified"),
        paths.is_allowed_extension(p).alias("is_allowed"), paths.secret_file_category(p).alias("secret_category"),
        paths.is_test_path(p).alias("is_test"), paths.is_auth_path(p).alias("is_auth"),
        paths.is_enrichment_excluded(p, size).alias("not_enriched"), paths.file_type_label(paths.suffix(p)).alias("type_label"),
        paths.size_tier(size).alias("tier"), paths.size_kb_text(size, 1).alias("kb"), paths.priority_score(p).alias("score"),
    )


def prune_folders(spark, sf):
    return scan.path_status(files(spark, sf))


def prune_folders_with_excludes(spark, sf):
    return scan.path_status(files(spark, sf), exclude=(" /docs/ ", "cart"))


def skip_histogram(spark, sf):
    return scan.skip_histogram(scan.path_status(files(spark, sf)))


# --- text ------------------------------------------------------------------------------------------


def truncate_docs(spark, sf):
    t = F.col("content")
    return corpus.documents(spark, sf).select("doc_id", *[
        text.head_tail_truncate(t, cap).alias(f"cap_{cap}") for cap in (0, 30, 100, 3000)
    ])


def redacted_docs(spark, sf):
    out = text.with_redaction(corpus.documents(spark, sf), "content")
    return out.select("doc_id", F.sha2("redacted_text", 256).alias("redacted_hash"), (F.size("findings") > 0).alias("redacted"))


def redacted_files(spark, sf):
    return analysis(spark, sf).scanned.select(
        "project", "path", "extension", "size", "skipped_reason", "redacted", F.sha2("content_preview", 256).alias("content_hash"),
        F.length("content_preview").alias("n_chars"),
    )


def scan_fast_mode(spark, sf):
    a = Analysis.for_mode(files(spark, sf), "fast")
    return a.scanned.select("project", "path", "skipped_reason", "redacted", "content_preview")


def secret_findings_docs(spark, sf):
    docs = corpus.documents(spark, sf).select("project", "path", "content")
    return scan.findings(text.with_redaction(docs, "content")).drop("ord")


def secret_findings_files(spark, sf):
    return analysis(spark, sf).findings.drop("ord")


def secret_findings_conversations(spark, sf):
    turns = corpus.conversations(spark, sf).select("project", "path", "content")
    return scan.findings(text.with_redaction(turns, "content")).drop("ord")


def redaction_by_project(spark, sf):
    return analysis(spark, sf).findings.groupBy("project", "finding_type").agg(
        F.count("*").alias("n_files"), F.sum("count").alias("n_redactions")
    )


def redaction_totals(spark, sf):
    return analysis(spark, sf).totals


def redaction_report(spark, sf):
    return scan.redaction_report(analysis(spark, sf).findings).drop("ord")


def suspicious_content(spark, sf):
    return files(spark, sf).select("project", "path", text.has_suspicious_content(F.col("content")).alias("suspicious"))


def risk_keywords(spark, sf):
    return files(spark, sf).select("project", "path", F.array_join(text.risk_keywords(F.col("content")), ", ").alias("words"))


def side_effects(spark, sf):
    df = files(spark, sf).withColumn("lang", symbols.language(paths.suffix(F.col("path")))).filter(F.col("lang").isNotNull())
    effects = F.coalesce(*[F.when(F.col("lang") == lang, text.side_effects(F.col("content"), lang)) for lang in rules.SIDE_EFFECTS])
    return df.select("project", "path", "lang", F.array_join(effects, ", ").alias("effects"))


def preview_lines(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", text.preview_lines(F.col("content")).alias("preview"))


def requirement_names(spark, sf):
    rows = files(spark, sf).filter(F.col("path") == "requirements.txt")
    return rows.select("project", F.explode(text.requirement_names(F.col("content"))).alias("package"))


def file_keys(spark, sf):
    return cache.with_cache_key(files(spark, sf), "fast").select("project", "path", "path_hash", "key")


# --- counts and selections -------------------------------------------------------------------------


def scan_stats(spark, sf):
    return analysis(spark, sf).stats


def priority_topk(spark, sf):
    return analysis(spark, sf).selected.select("project", "path", "priority_score", "size", "redacted", "rank")


def enrichment_candidates(spark, sf):
    a = analysis(spark, sf, mode="deep", max_files=80)
    return ranking.enrichment_candidates(a.selected, rules.MODES["deep"][2]).select("project", "path", "priority_score", "rank")


def dry_run_preview(spark, sf):
    a = analysis(spark, sf).scanned_once()
    return ranking.dry_run_preview(a.selected, a.tech, a.projects)


def retain_newest(spark, sf):
    turns = corpus.conversations(spark, sf).select("conv_id", "turn")
    return ranking.retain_newest(turns, ["conv_id"], [F.col("turn").desc()], max_rows=5, batch=2)


def retain_newest_by_source(spark, sf):
    docs = corpus.documents(spark, sf).select(F.col("project").alias("source"), "doc_id")
    return ranking.retain_newest(docs, ["source"], [F.col("doc_id").desc()])


def module_rollup(spark, sf):
    return summaries.module_rollup(analysis(spark, sf).selected)


def url_module_rollup(spark, sf):
    p = F.col("path")
    return corpus.pages(spark, sf).groupBy(F.col("project").alias("host"), paths.module(p).alias("module")).agg(
        F.count("*").alias("n_pages"), F.sum("size").alias("total_chars"), F.max(paths.depth(p)).alias("max_depth")
    )


def dir_rollup(spark, sf):
    return tree.dir_rollup(files(spark, sf))


def dir_tree(spark, sf):
    return tree.dir_tree(files(spark, sf)).select("project", "path", "line")


def dir_tree_head(spark, sf):
    return tree.tree_head(tree.dir_tree(files(spark, sf)), 200)


def large_file_notes(spark, sf):
    return summaries.large_file_notes(analysis(spark, sf).selected)


def project_summary(spark, sf):
    return analysis(spark, sf).scanned_once().project_summary


# --- technology ------------------------------------------------------------------------------------


def tech_items(spark, sf):
    return analysis(spark, sf).tech_items.select("project", "category", "item", _joined("sources"), "ord")


def tech_table(spark, sf):
    return analysis(spark, sf).tech.select("project", "all_detected", "tech_text", "tech_table", "is_empty")


# --- symbols ---------------------------------------------------------------------------------------


def _described(spark, sf, languages) -> DataFrame:
    """Symbols of files in some languages. The suffix decides before any text is redacted or searched."""
    suffixes = [s for lang in languages for s in rules.LANGUAGE_SUFFIXES[lang]]
    chosen = files(spark, sf).filter(paths.suffix(F.col("path")).isin(suffixes))
    return summaries.with_symbols(Analysis(chosen).scanned, languages)


def _symbols(lang: str) -> Callable:
    return lambda spark, sf: summaries.symbol_rows(_described(spark, sf, [lang]))


def _counts(kind: str) -> Callable:
    return lambda spark, sf: summaries.symbol_counts(summaries.symbol_rows(_described(spark, sf, list(rules.LANGUAGE_SUFFIXES))), kind)


def structural_summary(spark, sf):
    a = analysis(spark, sf)
    # else the texts' redaction is planned into each search of the summary
    a.selected = written(a.selected, "selected")
    return a.summaries.select("project", "path", "lang", "summary")


# --- domain ----------------------------------------------------------------------------------------


def _evidence(spark, sf) -> tuple[Analysis, DataFrame]:
    a = analysis(spark, sf).scanned_once()
    return a, a.evidence


def domain_evidence(spark, sf):
    return _evidence(spark, sf)[1].select("project", "domain", "indicator", "is_strong", "channel", "path", "points", "evidence")


def domain_evidence_structure(spark, sf):
    return domain_evidence(spark, sf).filter(F.col("channel").startswith("structure"))


def domain_scores(spark, sf):
    return domain.domain_scores(_evidence(spark, sf)[1]).withColumn("matched", F.array_join("matched", ", "))


def detect_domain(spark, sf):
    a, evidence = _evidence(spark, sf)
    return domain.detect_domain(domain.domain_scores(evidence), a.projects).withColumn("matched", F.array_join("matched", ", "))


def winning_evidence(spark, sf):
    a, evidence = _evidence(spark, sf)
    # scored and listed: else all texts are described and searched once for each
    evidence = written(evidence, "evidence")
    detected = domain.detect_domain(domain.domain_scores(evidence), a.projects)
    return domain.winning_evidence(evidence, detected).select("project", "domain", "evidence")


def doc_indicator_hits(spark, sf):
    docs = corpus.documents(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.lower("content").alias("low"))
    hits = docs.select("path", F.explode_outer(domain.indicator_hits("low")).alias("h")).filter(F.col("h").isNotNull())
    return hits.groupBy("h.domain", "h.indicator").agg(F.count("*").alias("n_docs"))


def planted_indicator_hits(spark, sf):
    """Documents with an indicator behind each text: by itself, or as the end or the start of a longer word."""
    words = list(dict.fromkeys(w.lower() for kinds in rules.DOMAIN_INDICATORS.values() for ws in kinds for w in ws))
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % len(words) + 1).cast("int"))
    form = F.when(F.col("doc_id") % 7 < 4, F.format_string(" %s.", word)).when(F.col("doc_id") % 7 == 4, F.concat(F.lit(" x"), word)).otherwise(F.concat(F.lit(" "), word, F.lit("x")))
    docs = corpus.documents(spark, sf).select("doc_id", F.concat(F.lower("content"), form).alias("low"))
    hits = docs.select(F.explode_outer(domain.indicator_hits("low")).alias("h")).filter(F.col("h").isNotNull())
    return hits.groupBy("h.domain", "h.indicator").agg(F.count("*").alias("n_docs"))


def page_indicator_hits(spark, sf):
    low = corpus.pages(spark, sf).select(F.lower("content").alias("low"))
    hits = low.select(F.explode_outer(domain.indicator_hits("low")).alias("h")).filter(F.col("h").isNotNull())
    return hits.groupBy("h.domain", "h.indicator").agg(F.count("*").alias("n_pages"))


# --- notes, options, context -----------------------------------------------------------------------


def risk_notes(spark, sf):
    return analysis(spark, sf).scanned_once().risk_notes


def repo_audit(spark, sf):
    return analysis(spark, sf).audit


def upgrade_plan(spark, sf):
    a = analysis(spark, sf)
    return notes.upgrade_plan(a.projects, a.audit)


def _requests(spark, sf) -> DataFrame:
    """One request per document: mode and given values follow from the document number and length."""
    n = F.col("doc_id")
    return corpus.documents(spark, sf).select(
        n.cast("string").alias("project"),
        F.element_at(F.array(*map(F.lit, rules.MODES)), (n % 3 + 1).cast("int")).alias("mode"),
        F.when(n % 5 == 0, F.lit(None)).otherwise(n % 2 == 0).alias("use_enrichment"),
        F.when(n % 4 == 0, F.col("size").cast("int")).alias("max_files"), F.when(n % 7 == 0, F.col("size").cast("int")).alias("max_chars"),
    )


def resolve_options(spark, sf):
    return notes.resolve_options(_requests(spark, sf))


def evidence_labels(spark, sf):
    resolved = notes.resolve_options(_requests(spark, sf))
    mode, enriched = F.col("mode"), F.col("use_enrichment")
    error = F.when(F.col("project").cast("bigint") % 6 == 0, "timeout")
    return resolved.select(
        "project", "mode", labels.evidence_level(mode, enriched).alias("evidence_level"),
        labels.analysis_type(mode, enriched).alias("analysis_type"),
        labels.evidence_disclaimer(enriched, F.col("max_files"), error).alias("disclaimer"),
    )


def special_section(spark, sf):
    a, evidence = _evidence(spark, sf)
    detected = domain.detect_domain(domain.domain_scores(evidence), a.projects)
    return detected.select("project", labels.special_section(F.col("domain"), F.col("confidence")).alias("section"))


def budget_pack(spark, sf):
    docs = corpus.documents(spark, sf).select(F.col("project").alias("source"), "doc_id", F.col("content").alias("text"))
    packed = context.budget_pack(docs, ["source"], "doc_id", per_item=2_000, total=60_000)
    return packed.select("source", "doc_id", "preview", "truncated")


def budget_pack_default(spark, sf):
    docs = corpus.documents(spark, sf).select(F.col("project").alias("source"), "doc_id", F.col("content").alias("text"))
    return context.budget_pack(docs, ["source"], "doc_id").select(
        "source", "doc_id", F.length("preview").alias("preview_chars"), "truncated"
    )


def context_files(spark, sf):
    a = analysis(spark, sf)
    rows = context.section_rows(a.selected, "important_files", context._rank_key(), rules.TARGETS, context._file_line)
    return rows.select("project", "target", "line_key", "text")


def context_redaction(spark, sf):
    a = analysis(spark, sf)
    key = F.concat("path", F.lit("|"), F.col("ord"))
    return context.section_rows(a.findings, "redaction", key, rules.TARGETS, context._finding_line).select("project", "target", "line_key", "text")


def context_rows(spark, sf):
    return analysis(spark, sf).settled().context("all")


def report_lines(spark, sf):
    return analysis(spark, sf).settled().report_lines()


# --- events, cache, streams ------------------------------------------------------------------------


def _events(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")


def window_request_count(spark, sf):
    return ratelimit.window_request_count(_events(spark, sf), "user_id", "ts", "event_id", DAY)


def rate_limit_admit(spark, sf):
    return ratelimit.rate_limit_admit(_events(spark, sf), "user_id", "ts", "event_id", RATE_LIMIT_PER_DAY, DAY)


def rate_limit_one_key(spark, sf):
    """All events under one key, so that it is never idle, in blocks of a fortieth of them."""
    events = _events(spark, sf).select(F.lit(0).alias("user_id"), "ts", "event_id")
    block = max(1, events.count() // 40)
    return ratelimit.rate_limit_admit(events, "user_id", "ts", "event_id", ONE_KEY_LIMIT, DAY, block).select("event_id", "admitted", "retry_after")


def rate_limit_minute(spark, sf):
    """The default: 60 requests in 60 seconds."""
    return ratelimit.rate_limit_admit(_events(spark, sf), "user_id", "ts", "event_id")


def _labelled_cache(spark, sf, docs: DataFrame) -> DataFrame:
    """Cache as an earlier run left it: the documents that carry a label."""
    labelled = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id")
    return cache.with_cache_key(docs.join(labelled, "doc_id", "left_semi"), "fast").withColumn("summary", F.lit("cached"))


def incremental_changed(spark, sf):
    """Files to describe when the labelled ones are cached."""
    docs = corpus.documents(spark, sf)
    return cache.incremental_changed(docs, _labelled_cache(spark, sf, docs), "fast").select("project", "path", "doc_id", "path_hash")


def incremental_refresh(spark, sf):
    docs = corpus.documents(spark, sf)
    describe = lambda df: df.withColumn("summary", F.lit("fresh"))
    return cache.refresh(docs, _labelled_cache(spark, sf, docs), "fast", describe).select("project", "path", "summary")


def _kept_cache(spark, sf) -> cache.SummaryCache:
    """A cache in which the labelled documents were described, and of those every second one once more after a change."""
    store = cache.SummaryCache(spark, scratch_path(spark, "summary-cache"))
    docs = corpus.documents(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    store.save(cache.with_cache_key(docs, "fast").withColumn("summary", F.lit("first")))
    later = docs.filter("doc_id % 2 = 0").withColumn("size", F.col("size") + 1)
    store.save(cache.incremental_changed(later, store.read(), "fast").withColumn("summary", F.lit("second")))
    return store


def summary_cache(spark, sf):
    return _kept_cache(spark, sf).read().select("project", "path_hash", "key", "summary")


def clear_cache(spark, sf):
    """Rows that clearing the sources before 'src2' removed, and those that are left, by source."""
    store = _kept_cache(spark, sf)
    before = store.read().groupBy("project").agg(F.count("*").alias("rows_before"))
    before = written(before, "cache-before")
    first = [r.project for r in before.select("project").filter("project < 'src2'").collect()]
    removed = store.clear(first) if first else 0
    after = store.read().groupBy("project").agg(F.count("*").alias("rows_after"))
    return before.join(after, "project", "left").select("project", "rows_before", F.coalesce("rows_after", F.lit(0)).cast("bigint").alias("rows_after"), F.lit(removed).cast("bigint").alias("removed"))


def _arriving(spark, sf: str, name: str) -> DataFrame:
    """A shipped table as a stream, be it one file or a folder of files; a pattern of one letter stands for either."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything that has arrived and read back what it wrote."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_redact(spark, sf):
    arriving = _arriving(spark, sf, "documents").select(
        F.col("source").alias("project"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("n_chars").alias("size"), F.col("text").alias("content"),
    )
    done = _drained(streams.stream_redact(arriving), "stream-redact")
    return done.select("project", "path", F.sha2("redacted_text", 256).alias("redacted_hash"), (F.size("findings") > 0).alias("redacted"))


def stream_rate_limit(spark, sf):
    events = _arriving(spark, sf, "events").select("event_id", "user_id", "ts")
    return _drained(streams.stream_admit(events, "user_id", "ts", "event_id", RATE_LIMIT_PER_DAY, DAY, delay="60 days"), "stream-admit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        path_parts, path_rules, prune_folders, prune_folders_with_excludes, skip_histogram, truncate_docs, redacted_docs,
        redacted_files, scan_fast_mode, secret_findings_docs, secret_findings_files, secret_findings_conversations,
        redaction_by_project, redaction_totals, redaction_report, suspicious_content, risk_keywords, side_effects,
        preview_lines, requirement_names, file_keys, scan_stats, priority_topk, enrichment_candidates, dry_run_preview,
        retain_newest, retain_newest_by_source, module_rollup, url_module_rollup, dir_rollup, dir_tree, dir_tree_head,
        large_file_notes, project_summary, tech_items, tech_table, structural_summary,
        domain_evidence, domain_evidence_structure, domain_scores, detect_domain, winning_evidence,
        doc_indicator_hits, planted_indicator_hits, page_indicator_hits, risk_notes, repo_audit, upgrade_plan, resolve_options, evidence_labels, special_section,
        budget_pack, budget_pack_default, context_files, context_redaction, context_rows, report_lines,
        window_request_count, rate_limit_admit, rate_limit_minute, rate_limit_one_key, incremental_changed, incremental_refresh, summary_cache, clear_cache,
        stream_redact, stream_rate_limit,
    )
}
# names from when Python files were left out of the shorter ones
QUERIES |= {"structural_summary_all": structural_summary, "detect_domain_full": detect_domain}
QUERIES |= {f"symbols_{lang}": _symbols(lang) for lang in ("js", "go", "rust", "ruby", "python")}
QUERIES |= {"top_imports": _counts("import"), "env_var_usage": _counts("env"), "route_catalog": _counts("route")}
