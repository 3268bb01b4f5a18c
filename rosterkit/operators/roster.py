"""Compliance roster and its point-in-time variant.

Plan shape (see README "Scale notes"):

* The claim lines are aggregated once to (person, provider) pairs with
  partial map-side combine (``service_person_provider``).
* A *person spine* replaces the original chain of full outer joins: the
  person ids of services, attribute eligibility and the raw assessment rows
  are unioned and grouped by person in ONE shuffle, which also computes the
  latest assessment date (NULL-propagating) and the source flags.  A full
  outer USING-join would lose the key's partitioning after every join;
  the spine keeps it, so the following joins are left joins on the same
  key and never re-shuffle the spine.
* Deferrals and admissions are de-duplicated on the columns they add before
  they are joined.  The original de-duplicates the joined rows at the end;
  distinct inputs give the same rows without a shuffle of the wide result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import add_calendar_months, add_years, fiscal_year_end, floor_at
from .cohorts import ID, service_person_provider
from .schema import reorder


def person_spine(pairs: DataFrame, elig_attr: DataFrame, assessments: DataFrame, cutoff=None,
                 with_span: bool = False) -> DataFrame:
    """One row per non-NULL person id seen in services, attribute eligibility or assessments.

    Columns: ``in_svs``, ``in_qi`` (booleans), ``has_sis`` (any assessment
    row), ``sis_completed_dt`` (latest date; NULL when any of the person's
    dates is NULL or when there is none) and ``providers``: the person's
    eligible (provider, first, last service) structs.  That list is bounded
    by the number of providers, not by the data: ``pairs`` is already one
    row per (person, provider).  Carrying it here lets the claim-line
    aggregate feed a single branch, so the claims are scanned and shuffled
    once; the union is grouped with partial (map-side) aggregation.
    ``with_span`` carries the person's service-date span (pairs built with
    ``with_span=True``) as ``svc_n``, ``svc_nd``, ``svc_min``, ``svc_max``.
    """
    nd = F.lit(None).cast("date")
    z = F.lit(0).cast("long")
    prov_t = F.struct(F.col("PROVIDER_NAME"), F.col("initial_service"), F.col("most_recent_service"))
    no_prov = F.lit(None).cast(
        "struct<PROVIDER_NAME:string,initial_service:date,most_recent_service:date>")
    span = ([F.col("_n"), F.col("_nd"), F.col("_mn"), F.col("_mx")] if with_span else [])
    no_span = [z.alias("_n"), z.alias("_nd"), nd.alias("_mn"), nd.alias("_mx")] if with_span else []
    svs = pairs.select(ID, F.lit(1).alias("_s"), F.lit(0).alias("_q"), F.lit(0).alias("_a"), nd.alias("_d"),
                       F.when(F.col("eligible_svs"), prov_t).otherwise(no_prov).alias("_p"), *span)
    qi = (elig_attr.where(F.col(ID).isNotNull())
          .select(ID, F.lit(0).alias("_s"), F.lit(1).alias("_q"), F.lit(0).alias("_a"), nd.alias("_d"),
                  no_prov.alias("_p"), *no_span))
    a = assessments.where(F.col("mcaid_id").isNotNull())
    if cutoff is not None:
        a = a.where(F.col("sis_completed_dt") <= F.lit(cutoff))
    sis = a.select(F.col("mcaid_id").alias(ID), F.lit(0).alias("_s"), F.lit(0).alias("_q"), F.lit(1).alias("_a"),
                   F.col("sis_completed_dt").alias("_d"), no_prov.alias("_p"), *no_span)
    span_aggs = ([F.sum("_n").alias("svc_n"), F.sum("_nd").alias("svc_nd"), F.min("_mn").alias("svc_min"),
                  F.max("_mx").alias("svc_max")] if with_span else [])
    g = (svs.unionByName(qi).unionByName(sis).groupBy(ID)
         .agg(F.max("_s").alias("_s"), F.max("_q").alias("_q"), F.sum("_a").alias("_a"),
              F.count("_d").alias("_dn"), F.max("_d").alias("_d"), F.collect_list("_p").alias("providers"),
              *span_aggs))
    return g.select(
        ID,
        (F.col("_s") == 1).alias("in_svs"),
        (F.col("_q") == 1).alias("in_qi"),
        (F.col("_a") > 0).alias("has_sis"),
        F.when((F.col("_a") > 0) & (F.col("_a") == F.col("_dn")), F.col("_d")).alias("sis_completed_dt"),
        "providers",
        *([c for c in ("svc_n", "svc_nd", "svc_min", "svc_max")] if with_span else []),
    )


def _explode_providers(spine: DataFrame, side=None) -> DataFrame:
    """One row per eligible provider; one row with NULL provider when there is none.

    ``side``: rows outside it get no provider rows (see ``build_fy_roster``).
    """
    provs = F.col("providers") if side is None else F.when(side, F.col("providers"))
    x = spine.select("*", F.explode_outer(provs).alias("_p")).drop("providers")
    return x.select(*[c for c in x.columns if c != "_p"],
                    F.col("_p.PROVIDER_NAME").alias("PROVIDER_NAME"),
                    F.col("_p.initial_service").alias("initial_service"),
                    F.col("_p.most_recent_service").alias("most_recent_service"),
                    F.when(F.col("_p").isNotNull(), F.lit(True)).alias("eligible_svs"))


def _deferral_side(deferrals: DataFrame) -> DataFrame:
    return (deferrals.where(F.col(ID).isNotNull())
            .select(ID, "defer_date", "deferral", "deferral_active").distinct())


def _left_join_on_side(left: DataFrame, right: DataFrame, side) -> DataFrame:
    """Left join on the person id that only matches left rows where ``side`` holds.

    Rows outside the side keep NULLs (the original joins these inputs before
    the assessment-only persons enter the table).
    """
    r = right.withColumnRenamed(ID, "_rid")
    cols = [c for c in r.columns if c != "_rid"]
    return left.join(r, (left[ID] == r["_rid"]) & side, "left").select(*left.columns, *cols)


def eligibility_flags(df: DataFrame) -> DataFrame:
    """eligible = both cohorts; completed among eligible / ineligible / any."""
    done = F.col("sis_completed_dt").isNotNull()
    elig = F.col("eligible_svs") & F.col("eligible_qi")
    return (df.withColumn("sis_eligible", elig)
            .withColumn("sis_complete_elig", done & F.col("sis_eligible"))
            .withColumn("sis_complete_inel", done & ~F.col("sis_eligible"))
            .withColumn("sis_complete_any", F.col("sis_complete_elig") | F.col("sis_complete_inel")))


def due_date(df: DataFrame, due_floor=None) -> DataFrame:
    """When the next assessment is due.

    No assessment and an expired deferral: deferral + 1 year.  No
    assessment otherwise: admission + 9 months.  Assessed: completion + 3
    years.  Calendar additions that land on a missing day are NULL.  Dates
    before ``due_floor`` move to it (NULL stays NULL).
    """
    done = F.col("sis_completed_dt")
    due = (F.when(done.isNull() & (F.col("deferral_active") == F.lit(False)), add_years("defer_date", 1))
           .when(done.isNull(), add_calendar_months("agency_admission_date", 9))
           .otherwise(add_years(done, 3)))
    if due_floor is not None:
        due = floor_at(due, due_floor)
    return df.withColumn("due_by_dt", due)


def compliance_flags(df: DataFrame, as_of, rollover_month: int = 10, coming_days: int = 90) -> DataFrame:
    """FY end, overdue (assessed and due before as_of), due within ``coming_days``, due in FY."""
    a = F.lit(as_of)
    due = F.col("due_by_dt")
    return (df.withColumn("end_of_fy", fiscal_year_end(as_of, rollover_month))
            .withColumn("sis_overdue", (due < a) & F.col("sis_completed_dt").isNotNull())
            .withColumn("sis_coming90", (due < F.date_add(a, coming_days)) & (due >= a))
            .withColumn("due_in_fy", due <= F.col("end_of_fy")))


ROSTER_ORDER = dict(named=[ID, "PROVIDER_NAME"], suffixes=["_dt", "_date", "_service"], prefixes=["eligible"])


BROADCAST_PEOPLE = 1_000_000   # more people of many rows than this join by shuffle


def _admission_side(admissions: DataFrame) -> DataFrame:
    return (admissions.where(F.col("medicaid_id").isNotNull())
            .select(F.col("medicaid_id").alias(ID), "agency_admission_date").distinct())


def people_of_many_rows(deferrals: DataFrame, admissions: DataFrame, limit: int) -> DataFrame | None:
    """(id, _nd, _na): into how many parts the deferrals and admissions of a person are split, for people with more
    than ``limit`` distinct ones of either; None when there are none.

    A person's roster rows are the product of providers, deferrals and admissions.  One small job over the two
    inputs (not the claims) finds the people whose product would be one long task.
    """
    parts = lambda d, name: d.groupBy(ID).agg(F.ceil(F.count(F.lit(1)) / limit).alias(name)).where(F.col(name) > 1)
    one = F.lit(1).cast("long")
    d, a = parts(_deferral_side(deferrals), "_nd"), parts(_admission_side(admissions), "_na")
    both = d.select(ID, "_nd", one.alias("_na")).unionByName(a.select(ID, one.alias("_nd"), "_na"))
    both = both.groupBy(ID).agg(F.max("_nd").alias("_nd"), F.max("_na").alias("_na")).checkpoint(eager=True)
    return None if both.isEmpty() else both


class _Spread:
    """Salts that deal a person's product of deferrals and admissions to a grid of ``_nd`` x ``_na`` parts.

    Without people of many rows every salt is 0 and no column is added.
    """

    def __init__(self, many: DataFrame | None):
        self.many = None
        if many is not None:
            many = many.select(F.col(ID).alias("_many"), "_nd", "_na")
            self.many = F.broadcast(many) if many.count() <= BROADCAST_PEOPLE else many
        self.keys = [ID] if many is None else [ID, "_salt"]

    def _salted(self, df: DataFrame, salts) -> DataFrame:
        """``df`` with one row per salt of ``salts`` (an array over ``_nd``, ``_na``); people of few rows have salt 0."""
        d = df.join(self.many, F.col(ID) == F.col("_many"), "left")
        some = F.when(F.col("_many").isNull(), F.array(F.lit(0).cast("long"))).otherwise(salts)
        return d.withColumn("_salt", F.explode(some)).drop("_many", "_nd", "_na")

    def people(self, df: DataFrame) -> DataFrame:
        """Each person's rows in every part of the grid."""
        return df if self.many is None else self._salted(df, F.sequence(F.lit(0).cast("long"), F.col("_nd") * F.col("_na") - 1))

    def deferrals(self, df: DataFrame) -> DataFrame:
        """A deferral in its row of the grid."""
        if self.many is None:
            return df
        own = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_nd")) * F.col("_na")
        return self._salted(df, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_na") - 1), lambda j: own + j)).withColumn("_has_d", F.lit(True))

    def admissions(self, df: DataFrame) -> DataFrame:
        """An admission in its column of the grid."""
        if self.many is None:
            return df
        own = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_na"))
        return self._salted(df, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_nd") - 1), lambda i: i * F.col("_na") + own)).withColumn("_has_a", F.lit(True))

    def whole(self, df: DataFrame) -> DataFrame:
        """The joined rows, each once: a person of many rows has no empty part, so a part without a match is none of theirs.

        A person split by one input only and without a row of the other keeps the row of the parts where the split one matched.
        """
        if self.many is None:
            return df
        d = df.join(self.many, F.col(ID) == F.col("_many"), "left")
        kept = F.col("_many").isNull() | ((F.col("_has_d").isNotNull() | (F.col("_nd") == 1)) & (F.col("_has_a").isNotNull() | (F.col("_na") == 1)))
        return d.where(kept).drop("_many", "_nd", "_na", "_has_d", "_has_a", "_salt")


def build_roster(services: DataFrame, elig_attr: DataFrame, assessments: DataFrame, deferrals: DataFrame,
                 admissions: DataFrame, cfg: RunConfig, many: DataFrame | None = None) -> DataFrame:
    """M9: one row per person x eligible provider x deferral x admission.

    ``many``: the people whose rows are split over tasks (``people_of_many_rows``).

    ``services`` as returned by ``prep_services``; ``elig_attr`` by
    ``eligible_by_attributes``; ``assessments`` has ``mcaid_id`` and
    ``sis_completed_dt``; ``deferrals`` by ``prep_deferrals``; ``admissions``
    by ``open_admissions``.
    """
    pairs = service_person_provider(services, cfg.procedure_codes, cfg.payer_codes)
    spine = person_spine(pairs, elig_attr, assessments)
    return reorder(roster_rows(spine, deferrals, admissions, cfg, many=many), **ROSTER_ORDER)


def roster_rows(spine: DataFrame, deferrals: DataFrame, admissions: DataFrame, cfg: RunConfig,
                keep_all: bool = False, many: DataFrame | None = None) -> DataFrame:
    """The roster from a person spine.

    ``keep_all=False``: the roster's filters drop rows.  ``keep_all=True``:
    every spine person is kept and ``_in_roster`` marks the roster rows
    (used by the coverage check, which also needs the persons the roster
    drops; extra spine columns are carried along).
    """
    # Persons seen only in assessments have NULL eligibility (the NULL fill
    # precedes their join in the original) and are dropped by the filters
    # below, so only the services / attribute side can enter the roster.
    side = F.col("in_svs") | F.col("in_qi")
    extra = [c for c in spine.columns if c not in (ID, "in_svs", "in_qi", "has_sis", "sis_completed_dt", "providers")]
    if not keep_all:
        spine = spine.where(side)
        extra = []
    else:
        spine = spine.withColumn("_side", side)
        extra = ["_side", *extra]
    spread = _Spread(many)
    salt = spread.keys[1:] + ["_has_d"] * (many is not None)
    r = (_explode_providers(spread.people(spine))
         .join(spread.deferrals(_deferral_side(deferrals)), spread.keys, "left")
         .select(*salt, ID, "PROVIDER_NAME", "initial_service", "most_recent_service",
                 F.coalesce("eligible_svs", F.lit(False)).alias("eligible_svs"),
                 F.col("in_qi").alias("eligible_qi"),
                 "defer_date", F.coalesce("deferral", F.lit(False)).alias("deferral"), "deferral_active",
                 "sis_completed_dt", *extra))
    kept = F.col("eligible_svs") | F.col("eligible_qi") | F.col("sis_completed_dt").isNotNull()
    if not keep_all:
        r = r.where(kept)
    else:
        r = r.withColumn("_kept", kept)
    r = eligibility_flags(r)
    in_roster = F.col("sis_eligible") | F.col("sis_complete_inel")
    if not keep_all:
        r = r.where(in_roster)
    else:
        r = (r.withColumn("_in_roster", F.col("_side") & F.col("_kept") & in_roster & F.col(ID).isNotNull())
             .drop("_side", "_kept"))
    r = spread.whole(r.join(spread.admissions(_admission_side(admissions)), spread.keys, "left"))
    return compliance_flags(due_date(r, cfg.due_floor), cfg.as_of, cfg.rollover_month, cfg.coming_days)


def build_fy_roster(services: DataFrame, elig_attr: DataFrame, assessments: DataFrame, deferrals: DataFrame,
                    cfg: RunConfig) -> DataFrame:
    """Point-in-time roster for the fiscal year ending ``cfg.fy_cutoff``.

    Services and assessments after the cut-off are ignored (the original
    computes the cut assessment table but joins the uncut one; the cut one
    is used here unless ``cfg.fy_uncut_assessments``).  Overdue = completed + ``reassess_days_fy`` < as_of.
    Persons known only from assessments stay, with NULL eligibility flags.
    """
    cutoff = cfg.fy_cutoff
    pairs = service_person_provider(services, cfg.procedure_codes, cfg.payer_codes, cutoff)
    spine = person_spine(pairs, elig_attr, assessments, None if cfg.fy_uncut_assessments else cutoff)
    spine = spine.where(F.col("in_svs") | F.col("in_qi") | F.col("has_sis"))
    side = F.col("in_svs") | F.col("in_qi")
    r = _left_join_on_side(_explode_providers(spine, side), _deferral_side(deferrals), side)
    on_side = F.col("in_svs") | F.col("in_qi")
    r = r.select(ID, "PROVIDER_NAME", "initial_service", "most_recent_service",
                 F.when(on_side, F.coalesce("eligible_svs", F.lit(False))).alias("eligible_svs"),
                 F.when(on_side, F.col("in_qi")).alias("eligible_qi"),
                 "defer_date", F.when(on_side, F.coalesce("deferral", F.lit(False))).alias("deferral"),
                 "deferral_active", "sis_completed_dt")
    r = r.where(F.col("eligible_svs") | F.col("eligible_qi") | F.col("sis_completed_dt").isNotNull())
    a = F.lit(cfg.as_of)
    expiry = F.date_add("sis_completed_dt", cfg.reassess_days_fy)
    r = r.withColumns({
        "sis_eligible": F.col("eligible_svs") & F.col("eligible_qi"),
        "sis_complete": F.col("sis_completed_dt").isNotNull(),
        "sis_overdue": expiry < a,
        "sis_coming30": (expiry < F.date_add(a, cfg.coming_days_fy)) & (expiry >= a),
    })
    return r.where(F.col("sis_eligible") | F.col("sis_complete"))
