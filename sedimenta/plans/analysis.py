"""The whole dataflow from a files table to context rows, as named DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta import rules
from sedimenta.functions import labels
from sedimenta.operators import context, domain, notes, ranking, reports, scan, summaries, tech, tree
from sedimenta.session import written


@dataclass
class Analysis:
    """Steps are built on first use; Spark plans each one together with what it needs.

    ``max_chars=None`` keeps whole texts; ``for_mode`` applies the mode's limits. Call ``settled`` before producing
    whole documents, or pass an already written scan as ``prepared``.
    """

    files: DataFrame
    mode: str = "fast"
    max_files: int = rules.MODES["fast"][0]
    max_chars: int | None = None
    exclude: Sequence[str] = ()
    dry_run: bool = False
    prepared: DataFrame | None = None

    @classmethod
    def for_mode(cls, files: DataFrame, mode: str, max_files: int | None = None, max_chars: int | None = None, **kw) -> Analysis:
        n, chars, _ = rules.MODES[labels.check_mode(mode)]
        return cls(files, mode, n if max_files is None else max_files, chars if max_chars is None else max_chars, **kw)

    def scanned_once(self) -> Analysis:
        """Write the scan to a table in the shared folder, for results that look at it from several sides."""
        self.scanned = self.prepared = written(self.scanned, "scanned")
        return self

    def settled(self) -> Analysis:
        """The same analysis with its shared steps written to tables in the shared folder.

        Documents combine a dozen views of the same scan; without this each view would scan and redact again. The
        text table is written once, later steps read only the columns they need.
        """
        self.scanned_once()
        for step in ("findings", "selected", "summaries", "tech_items", "tree", "risk_notes", "domain", "facts"):
            setattr(self, step, written(getattr(self, step), step))
        return self

    @cached_property
    def projects(self) -> DataFrame:
        return self.files.select("project").distinct()

    @cached_property
    def status(self) -> DataFrame:
        return scan.path_status(self.files, self.exclude)

    @cached_property
    def scanned(self) -> DataFrame:
        return self.prepared if self.prepared is not None else scan.scan(self.files, self.exclude, self.max_chars)

    @cached_property
    def findings(self) -> DataFrame:
        return scan.findings(self.scanned)

    @cached_property
    def stats(self) -> DataFrame:
        return scan.scan_stats(self.scanned)

    @cached_property
    def totals(self) -> DataFrame:
        return scan.redaction_totals(self.findings)

    @cached_property
    def selected(self) -> DataFrame:
        # a scan that is written anyway is read for its winners; else only the winners are scanned
        if self.prepared is not None:
            return ranking.top_files(self.scanned, self.max_files)
        return ranking.top_files_of(self.files, self.max_files, self.exclude, self.max_chars)

    @cached_property
    def tech_items(self) -> DataFrame:
        return tech.tech_items(self.files, self.scanned)

    @cached_property
    def tech(self) -> DataFrame:
        return tech.tech_wide(self.tech_items, self.projects)

    @cached_property
    def summaries(self) -> DataFrame:
        rows = summaries.structural_summaries(self.selected)
        return rows.filter(F.lit(False)) if self.dry_run else rows

    @cached_property
    def tree(self) -> DataFrame:
        return tree.dir_tree(self.files, self.exclude)

    @cached_property
    def evidence(self) -> DataFrame:
        texts = domain.domain_texts(self.projects, self.status, self.scanned, self.summaries, self.tech)
        return domain.domain_evidence(texts)

    @cached_property
    def domain_scores(self) -> DataFrame:
        return domain.domain_scores(self.evidence)

    @cached_property
    def domain(self) -> DataFrame:
        return domain.detect_domain(self.domain_scores, self.projects)

    @cached_property
    def risk_notes(self) -> DataFrame:
        return notes.risk_notes(self.projects, self.stats, self.findings, self.selected, self.tech)

    @cached_property
    def project_summary(self) -> DataFrame:
        return summaries.project_summary(self.tech, self.selected, self.mode)

    @cached_property
    def facts(self) -> DataFrame:
        return context.project_facts(
            self.projects, self.stats, self.tech, self.selected, self.findings, self.risk_notes, self.domain,
            self.project_summary, self.mode,
        )

    @cached_property
    def audit(self) -> DataFrame:
        return notes.repo_audit(self.files)

    def context(self, target: str = "all") -> DataFrame:
        return context.context_rows(self.facts, self.selected, self.summaries, self.risk_notes, self.findings, self.tree, target)

    def report_lines(self, info: reports.ScanInfo = reports.ScanInfo()) -> DataFrame:
        as_json = reports.scan_report(self.facts, self.totals, self.selected, self.risk_notes, info)
        return reports.report_lines(self.facts, self.tree, self.risk_notes, self.findings, self.totals, as_json, info)
