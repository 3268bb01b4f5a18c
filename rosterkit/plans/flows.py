"""Composed runs on the stand-in extracts: raw -> clean -> cohorts -> roster -> marts.

``Run`` builds every DataFrame lazily, once per attribute.  The roster feeds
several marts; within one query Spark reuses identical exchanges, and
``persist_roster`` (or ``checkpoint_roster`` to cut lineage into the shared
checkpoint folder) serves runs that write several marts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..config import Inputs, RunConfig, Source
from ..operators import checks, cohorts, overlap, reports, roster, summary, timeline, worklist
from ..operators.cohorts import ID
from ..sources import files, standin


class Run:
    """``Run(spark, folder)`` works on the stand-in extracts of the driver's tables; ``Run(spark, cfg=..., inputs=...)`` on files."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, cfg: RunConfig | None = None, inputs: Inputs | None = None):
        if (sf_dir is None) == (inputs is None):
            raise ValueError("a run reads either the tables of a folder or the files of its inputs")
        if inputs is not None and cfg is None:
            raise ValueError("a run from files needs its configuration (run date, codes)")
        self.spark, self.sf_dir, self.inputs = spark, sf_dir, inputs
        self.cfg = cfg or standin.standin_config()

    def _read(self, source: Source, dedupe: bool = False) -> DataFrame:
        return files.read_many(self.spark, source.paths, skip=source.skip, dedupe=dedupe, keep_source=False,
                               drop_rows_after_header=source.drop_rows_after_header, multiline=source.multiline)

    # -- raw extracts -------------------------------------------------------
    @cached_property
    def raw_services(self) -> DataFrame:
        if self.inputs:
            return self._read(self.inputs.services)
        return standin.raw_services(self.spark, self.sf_dir)

    @cached_property
    def raw_attributes(self) -> DataFrame:
        if self.inputs:
            return self._read(self.inputs.attributes)
        return standin.raw_attributes(self.spark, self.sf_dir)

    @cached_property
    def raw_assessments(self) -> DataFrame:
        if self.inputs:
            return self._read(self.inputs.assessments)
        return standin.raw_assessments(self.spark, self.sf_dir, self.cfg.clock_format_change)

    @cached_property
    def deferral_sources(self):
        if self.inputs:
            return [(self._read(source), key, date, kind) for source, key, date, kind in self.inputs.deferrals]
        return standin.raw_deferral_sources(self.spark, self.sf_dir)   # the extract does not depend on the run date

    @cached_property
    def raw_admissions(self) -> DataFrame:
        # the admission reader de-duplicates whole rows (S3)
        if self.inputs:
            return self._read(self.inputs.admissions, dedupe=True)
        return standin.raw_admissions(self.spark, self.sf_dir).distinct()

    # -- clean tables and cohorts -------------------------------------------
    @cached_property
    def services(self) -> DataFrame:
        return cohorts.prep_services(self.raw_services, self.cfg.provider_recode)

    @cached_property
    def attributes(self) -> DataFrame:
        return cohorts.prep_attributes(self.raw_attributes)

    @cached_property
    def assessments(self) -> DataFrame:
        return cohorts.prep_assessments(self.raw_assessments, self.cfg.as_of, self.cfg.clock_format_change)

    @cached_property
    def deferrals(self) -> DataFrame:
        return cohorts.prep_deferrals(self.deferral_sources, self.cfg.as_of, self.cfg.deferral_days)

    @cached_property
    def admissions(self) -> DataFrame:
        return cohorts.open_admissions(self.raw_admissions)

    @cached_property
    def elig_svs(self) -> DataFrame:
        return cohorts.eligible_by_service(self.services, self.cfg.procedure_codes, self.cfg.payer_codes)

    @cached_property
    def elig_qi(self) -> DataFrame:
        c = self.cfg
        return cohorts.eligible_by_attributes(self.attributes, c.as_of, c.min_age, c.days_per_year,
                                              c.blank_uses_proxies)

    @cached_property
    def latest(self) -> DataFrame:
        return cohorts.latest_assessment(self.assessments)

    # -- roster and marts ----------------------------------------------------
    @cached_property
    def many(self) -> DataFrame | None:
        """The people whose roster rows are split over tasks (one small job over deferrals and admissions), or None."""
        limit = self.cfg.fan_out_limit
        return None if limit is None else roster.people_of_many_rows(self.deferrals, self.admissions, limit)

    @cached_property
    def roster(self) -> DataFrame:
        return roster.build_roster(self.services, self.elig_qi, self.assessments, self.deferrals,
                                   self.admissions, self.cfg, self.many)

    def persist_roster(self) -> DataFrame:
        self.__dict__["roster"] = self.roster.persist()
        return self.roster

    def checkpoint_roster(self) -> DataFrame:
        """Cut the roster's lineage into the shared checkpoint folder (survives executor loss)."""
        self.__dict__["roster"] = self.roster.checkpoint(eager=True)
        for mart in ("worklist", "summary", "monthly"):  # built on the roster before the cut
            self.__dict__.pop(mart, None)
        self._checkpointed = True
        return self.roster

    def cut_roster(self) -> DataFrame:
        """The checkpointed roster, for results that read it more than once."""
        return self.roster if getattr(self, "_checkpointed", False) else self.checkpoint_roster()

    def checkpoint_fy_roster(self) -> DataFrame:
        self.__dict__["fy_roster"] = self.fy_roster.checkpoint(eager=True)
        for mart in ("fy_worklist", "fy_summary"):
            self.__dict__.pop(mart, None)
        return self.fy_roster

    @cached_property
    def worklist(self) -> DataFrame:
        return worklist.worklist(self.roster, self.cfg.dense_priority, spread=self.many is not None)

    @cached_property
    def summary(self) -> DataFrame:
        return summary.completion_summary(self.roster, self.cfg.total_label)

    @cached_property
    def monthly(self) -> DataFrame:
        return summary.monthly_completions(self.roster)

    @cached_property
    def fy_roster(self) -> DataFrame:
        return roster.build_fy_roster(self.services, self.elig_qi, self.assessments, self.deferrals, self.cfg)

    @cached_property
    def fy_worklist(self) -> DataFrame:
        return worklist.fy_worklist(self.fy_roster)

    @cached_property
    def fy_summary(self) -> DataFrame:
        return summary.fy_summary(self.fy_roster, self.cfg.total_label)

    def summary_timeline(self, dates) -> DataFrame:
        """The point-in-time summary at many run dates (each its own cut-off), from one pass over the claims."""
        changes = timeline.pair_changes(self.services, timeline.attribute_start(self.attributes, self.cfg), self.assessments, self.deferrals, self.cfg)
        return timeline.summary_at(changes, dates, self.cfg.total_label)

    def trailing_months(self) -> DataFrame:
        return reports.trailing_months(self.monthly)

    def narrative(self) -> DataFrame:
        return reports.narrative_metrics(self.roster)

    @cached_property
    def providers(self) -> list[str]:
        """Provider labels from the provider dimension (a handful of rows), in key order; from files, those that occur."""
        if self.inputs:
            found = self.services.select("PROVIDER_NAME").where("PROVIDER_NAME IS NOT NULL").distinct()
            return sorted(r[0] for r in found.collect())
        return standin.provider_labels(self.spark, self.sf_dir, self.cfg.provider_recode)

    def crosstab(self) -> DataFrame:
        return reports.priority_crosstab(self.worklist, self.providers)

    def reconcile_rows(self) -> DataFrame:
        r = self.cut_roster()
        return checks.flagged_not_in_worklist(r, self.worklist)

    def reconcile_counts(self) -> DataFrame:
        r = self.cut_roster()
        return checks.reconcile(r, self.worklist)

    def coverage_gap(self) -> DataFrame:
        return checks.coverage_gap(self.services, self.elig_qi, self.assessments, self.deferrals, self.admissions,
                                   self.cfg)

    def overlap(self, count_null_id: bool = False) -> DataFrame:
        from ..config import OVERLAP_LABELS
        sets = [(OVERLAP_LABELS[0], self.elig_svs, cohorts.ID), (OVERLAP_LABELS[1], self.elig_qi, cohorts.ID),
                (OVERLAP_LABELS[2], self.latest, "mcaid_id"), (OVERLAP_LABELS[3], self.deferrals, cohorts.ID)]
        return overlap.set_overlap(self.spark, sets, count_null_id)

    # -- outputs (K1-K3) ------------------------------------------------------
    def write_outputs(self, base: str, checkpoint: bool = True) -> dict[str, str]:
        """Write the run's outputs: the dated summary (report headers, providers in order, total
        last) and worklist (latest service first) as CSV, one worklist folder per provider, the
        point-in-time summary and worklist with row numbers, and the report tables.  Both rosters
        feed several outputs, so each is checkpointed once into the shared checkpoint folder
        first (lineage cut: an executor loss does not rerun the claims scan).  Returns the
        written locations.
        """
        from pyspark.sql import functions as F

        from ..sources import sinks
        if checkpoint:
            self.cut_roster()
            self.checkpoint_fy_roster()
        as_of = self.cfg.as_of
        latest_first = [F.col("most_recent_service").desc_nulls_last(), F.col(ID).asc_nulls_last(),
                        F.col("PROVIDER_NAME").asc_nulls_last()]
        out = {
            "summary": sinks.write_csv(summary.display_names(summary.in_order(self.summary)),
                                       f"{base}/percent_complete_summary", as_of),
            "worklist": sinks.write_csv(self.worklist.orderBy(*latest_first), f"{base}/need_assessment", as_of),
            "trailing_months": sinks.write_csv(self.trailing_months().orderBy("month_complete"), f"{base}/trailing_months", as_of),
            "narrative": sinks.write_csv(self.narrative(), f"{base}/narrative", as_of),
            "crosstab": sinks.write_csv(self.crosstab().orderBy("priority"), f"{base}/priority_crosstab", as_of),
            "director": sinks.write_csv(reports.director_table(summary.in_order(self.summary)), f"{base}/director", as_of),
            "supervisor": sinks.write_csv(reports.supervisor_table(summary.in_order(self.summary)), f"{base}/supervisor", as_of),
            "per_provider": sinks.write_split(self.worklist, "PROVIDER_NAME",
                                              sinks.dated_path(f"{base}/per_provider/need_assessment", as_of),
                                              "most_recent_service"),
        }
        out["fy_summary"] = sinks.write_csv_with_row_names(
            self.fy_summary, f"{base}/percent_complete_summary_fy", [F.col("is_total"), F.col("PROVIDER_NAME")])
        out["fy_worklist"] = sinks.write_csv_with_row_names(self.fy_worklist, f"{base}/need_assessment_fy", latest_first)
        return out
