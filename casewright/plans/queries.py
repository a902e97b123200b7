"""Registered queries over the provided tables, with the fixtures' scaled-down parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import dims
from casewright.functions import formats, names, text
from casewright.functions.geometry import ordinal
from casewright.operators import bursts, channel, coverage, followups, geo, index, its, joins, neardup, series, templates, windows
from casewright.sources import extraction, readers
from casewright.sources.fixtures import complaints, facts, population, scored, table
from casewright.storage import spread
from casewright.streaming import events as ev

AS_OF = "2001-08-15"
TEMPLATE_MIN = 2
CUT = "1998-11-30"
OUT = ("NATION_24", "")
SEGMENT = "automobile"
GROUP_EVENTS = (
    ("COMPANY 1", "1996-03-10", "first event"), ("COMPANY 5", "1997-06-20", "second event"), ("COMPANY 9", "1998-02-01", "third event"), ("COMPANY 13", "1999-05-05", "fourth event"), ("COMPANY 30", "1996-09-09", "fifth event"),
)
SEGMENT_EVENTS = (("automobile", "1998-10-01", "tariff"), ("automobile", "1997-01-01", "too early"), ("building", "1999-03-01", "permit rule"), ("machinery", "1998-12-01", "strike"))
MILESTONES = (("first", "1998-11-30"), ("second", "1999-03-14"), ("third", "1999-01-31"))
GATES = {"complaints": 10_000, "low_pct": 1.0, "high_pct": 70.0, "trend": 60, "states": 20, "companies": 8, "days": 75}


def _c(spark, d):
    return complaints(spark, d)


def _s(spark, d):
    return scored(facts(spark, d))


def _f(spark, d):
    return templates.flagged(_s(spark, d), TEMPLATE_MIN)


def _idx(name):
    return lambda spark, d: index.fold(facts(spark, d))[name]


def _pruned(spark, d) -> DataFrame:
    t = index.prune(index.fold(facts(spark, d)), 2, 10)
    parts = [t[n].groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).withColumn("tbl", F.lit(n)) for n in ("text_state_month", "text_company_month", "relief_month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _refreshed(spark, d) -> DataFrame:
    """Tables folded from the cases before a month, then refreshed with the rest twice: equal to one full fold."""
    c = facts(spark, d)
    months = index.refresh_months("2001-03", "2001-08", 3)
    once = index.refresh(index.fold(c.where(~F.col("month").isin(months))), c, months)
    twice = index.refresh(once, c, months)
    return twice["company_month"]


def _backfilled(spark, d) -> DataFrame:
    """Firms' text detail whose last months were counted wrongly, after their backfill."""
    c = facts(spark, d)
    tables = index.fold(c)
    months = index.backfill_months(tables, 18)
    wrong = tables["text_company_month"].withColumn("n", F.col("n") + F.col("month").isin(months).cast("long"))
    return index.backfill_companies(tables | {"text_company_month": wrong}, c, months, 10)["text_company_month"]


def _merged(spark, d) -> DataFrame:
    """The company table of an index merged from those of two spans."""
    c = facts(spark, d)
    return index.merge(index.fold(c.where("month < '1998-01'")), index.fold(c.where("month >= '1998-01'")))["company_month"]


def _shown(spark, d) -> DataFrame:
    pct = F.lit(100.0) * F.col("narratives") / F.col("complaints")
    return series.monthly_counts(_c(spark, d)).select("month", formats.month_label(F.col("month")).alias("label"), formats.grouped(F.col("complaints")).alias("cases"), formats.percent(pct, 2).alias("coverage"))


def _extracted(spark, d) -> DataFrame:
    """A resumed extraction in two passes: the days up to 1998 are in the ledger, the recent ones come again."""
    c = _c(spark, d)
    products, passes = [r[0] for r in table(spark, d, "customer").select("c_mktsegment").distinct().collect()], {"split": ((1, 50), (0, 2000))}
    windows = extraction.plan(c, products, "1992-01-01", "2001-12-31", passes=passes)
    first = windows.where("window_end < '1998-01-01'")
    ledger = extraction.entries(first, extraction.extract(c, first, products), c.limit(0))
    again = extraction.extract(c, extraction.pending(windows, ledger, "2001-12-31"), products)
    both = extraction.extract(c, first, products).unionByName(again)
    return both.groupBy("month", "has_narrative").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("complaint_id").alias("ids"))


def _bursts(spark, d):
    return bursts.company_bursts(_c(spark, d), AS_OF, 5, 2.5)


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), digits))
    return df


def _explained(spark, d):
    found = bursts.explain_bursts(_bursts(spark, d).select("entity", "month_start", "z"), dims.dated(spark, GROUP_EVENTS, "grp"), 120)
    return _r(found.select("entity", "month_start", "z", "event_date", "description", "gap"), "z")


def _competing(spark, d):
    breaks = _c(spark, d).select("segment").distinct().withColumn("cut", F.lit(CUT).cast("date"))
    return joins.within_days(breaks, dims.dated(spark, SEGMENT_EVENTS, "segment"), F.col("cut"), 180, ["segment"], "inner").select("segment", "event_date", "description", "gap")


def _nearest(spark, d):
    days = _c(spark, d).select("date_received").distinct()
    return joins.nearest_event(days, dims.milestones(spark, MILESTONES), F.col("date_received")).select("date_received", "nearest_event", "nearest_gap")


def _crosswalk(spark, d):
    labels = [(x,) for xs in dims.SEGMENTS.values() for x in xs] + [(" Mortgage ",), ("MORTGAGE",), ("Widgets",), ("",), (None,), ("   ",)]
    return names.with_segment(spark.createDataFrame(labels, "product string"))


def _unmapped(spark, d):
    return names.unmapped_labels(_c(spark, d))


def _series(spark, d) -> DataFrame:
    counts = series.monthly_counts(_c(spark, d), "segment", AS_OF)
    return series.gap_filled(counts, "segment").withColumnRenamed("segment", "series")


def _fit(spark, d, model="nbinom"):
    s = _series(spark, d)
    dates = s.select("series").distinct().withColumn("date", F.lit(CUT).cast("date"))
    return its.fit_dates(s, dates, model)


def _placebo(spark, d):
    s = _series(spark, d)
    return its.placebo_test(_fit(spark, d), its.fit_dates(s, its.placebo_dates(s)))


def _upsert(spark, d):
    old = _c(spark, d).select("complaint_id", "date_received", "company", "has_narrative", "narrative")
    new = old.where("complaint_id % 10 = 0").withColumn("company", F.lit("changed")).withColumn("narrative", F.when(F.col("complaint_id") % 20 == 0, "").otherwise("new text")).withColumn("has_narrative", F.when(F.col("narrative") == "", 0).otherwise(1))
    out = index.upsert(old, new)
    return out.select("complaint_id", "company", "has_narrative", F.md5("narrative").alias("narrative_md5"))


def _near(spark, d):
    return neardup.near_duplicate_clusters(_c(spark, d))


def _unpivot(spark, d):
    n = table(spark, d, "nation")
    wide = n.select(F.lit("040").alias("SUMLEV"), F.col("n_name").alias("NAME"), *[(F.col("n_nationkey") * 1000 + y).cast("string").alias(f"POPESTIMATE{y}") for y in (2019, 2020)], F.lit("1").alias("POPESTIMATE042020"))
    later = n.where("n_nationkey < 5").select(F.lit("040").alias("SUMLEV"), F.col("n_name").alias("NAME"), F.lit("77").alias("POPESTIMATE2020"))
    return readers.population_long(wide, later)


def _shingle_stats(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.normalize(F.col("text")).alias("norm"))
    return docs.select("doc_id", text.token_count(F.col("norm")).cast("long").alias("tokens"), F.size(text.shingles(F.col("norm"))).cast("long").alias("shingles"))


def _jaccard_pairs(spark, d):
    b = table(spark, d, "benchmark").select("item_id", text.shingles(text.normalize(F.col("text")), 2).alias("g"))
    grams = b.select("item_id", F.size("g").alias("n"), F.explode("g").alias("x"))
    x, y = grams.alias("x"), grams.alias("y")
    both = x.join(y, (F.col("x.x") == F.col("y.x")) & (F.col("x.item_id") < F.col("y.item_id"))).groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count(F.lit(1)).alias("common"))
    return both.select("a", "b", "common", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"))


def _events(spark, d):
    return table(spark, d, "events")


def _checks(spark, d):
    t = index.fold(facts(spark, d))
    pop = population(spark)
    return index.payload_checks(
        index.emit_headline(t, TEMPLATE_MIN), index.emit_trend(t, AS_OF, TEMPLATE_MIN, "1995-01", 5), index.emit_volume(t, AS_OF), index.emit_states(t, pop, AS_OF, TEMPLATE_MIN, 5, 12, OUT), index.emit_companies(t, AS_OF, TEMPLATE_MIN, 5), "2001-08-01", AS_OF, GATES
    )


def _rates(spark, d):
    return geo.state_year_rates(_c(spark, d), population(spark), non_states=OUT)


QUERIES = {
    "templated_share_by_month": lambda s, d: templates.templated_share(_f(s, d), ["segment", "month"]),
    "templated_share_by_state": lambda s, d: templates.templated_share(_f(s, d), ["segment", "state"]),
    "templated_share_combined": lambda s, d: templates.combined_share(_f(s, d), 10),
    "templating_headline": lambda s, d: templates.headline(_s(s, d), TEMPLATE_MIN),
    "template_set": lambda s, d: templates.template_set(_s(s, d), TEMPLATE_MIN),
    "exact_duplicate_groups": lambda s, d: templates.exact_duplicate_groups(_s(s, d)),
    "template_lifespan": lambda s, d: templates.lifespan(_f(s, d)).drop("ord"),
    "template_long_lived": lambda s, d: templates.long_lived_complaints(templates.lifespan(_f(s, d))),
    "dow_profile": lambda s, d: templates.day_of_week(_f(s, d), SEGMENT),
    "monthly_counts": lambda s, d: series.monthly_counts(_c(s, d), as_of=AS_OF),
    "monthly_by_channel": lambda s, d: series.monthly_counts(_c(s, d), "submitted_via", AS_OF),
    "daily_counts": lambda s, d: series.daily_counts(_c(s, d).where(series.in_scope((SEGMENT,), "1996-01-01", "1997-12-31"))),
    "gap_filled_series": lambda s, d: series.gap_filled(series.monthly_counts(_c(s, d), "company", AS_OF), "company"),
    "gap_filled_companies": lambda s, d: series.gap_filled(series.monthly_counts(_c(s, d), "company", AS_OF), "company"),
    "segment_and_all": lambda s, d: series.per_segment_and_all(_c(s, d), (SEGMENT, "building")),
    "against_others": lambda s, d: _r(series.against_others(_c(s, d), SEGMENT, "1995-01"), "log_complaints", "log_others"),
    "display_formats": _shown,
    "escaped_texts": lambda s, d: table(s, d, "documents").select("doc_id", formats.escaped(F.col("text")).alias("shown")),
    "coverage_ends": lambda s, d: joins.ends(series.monthly_counts(_c(s, d)).select("month", "complaints"), ["month"], 7, 4),
    "top_templates": lambda s, d: templates.top_templates(_s(s, d), _c(s, d)),
    "coverage": lambda s, d: coverage.coverage(_c(s, d)),
    "segment_counts": lambda s, d: coverage.segment_counts(_c(s, d)),
    "narrative_coverage": lambda s, d: coverage.narrative_coverage(_c(s, d), "1996-01"),
    "label_windows": lambda s, d: coverage.label_windows(_c(s, d)),
    "thin_months": lambda s, d: coverage.thin_months(_c(s, d)),
    "size_estimate": lambda s, d: coverage.size_estimate(_c(s, d)),
    "company_normalize": lambda s, d: _c(s, d).select("company").distinct().withColumn("key", names.normalize_company(F.col("company"))),
    "company_group_counts": lambda s, d: names.with_company_group(_c(s, d)).groupBy("company_group").agg(series.cases(), series.narratives()),
    "segment_crosswalk": _crosswalk,
    "unmapped_labels": _unmapped,
    "display_names": lambda s, d: s.createDataFrame([(x,) for x in ("CNG OF THE WEST", "BANK OF AMERICA", "TransUnion", "THE LDF", "A AND B", "")], "company string").withColumn("shown", names.display_name(F.col("company"))),
    "robust_z_trailing": lambda s, d: _r(windows.trailing_robust_z(series.gap_filled(series.monthly_counts(_c(s, d), "segment", AS_OF), "segment"), ["segment"], "month_start", "complaints"), "baseline", "scale", "z"),
    "segment_bursts": lambda s, d: _r(bursts.segment_bursts(_c(s, d), AS_OF, 2.0), "baseline", "scale", "z", "multiple"),
    "company_bursts": lambda s, d: _r(_bursts(s, d), "baseline", "scale", "z", "multiple"),
    "burst_event_join": _explained,
    "bursts_explained": lambda s, d: bursts.explained(_explained(s, d)),
    "new_entrants": lambda s, d: bursts.new_entrants(_c(s, d), (SEGMENT, "building", "machinery"), 3),
    "company_lockstep": lambda s, d: _r(bursts.lockstep(_c(s, d), "2001-06"), "ratio"),
    "channel_mix": lambda s, d: _r(channel.channel_mix(_c(s, d)), "share"),
    "channel_mix_year": lambda s, d: _r(channel.channel_mix(_c(s, d), "year"), "share"),
    "channel_pivot": lambda s, d: _r(channel.pivoted(channel.channel_mix(_c(s, d)), ["1-URGENT", "2-HIGH"]), "1-URGENT_share", "2-HIGH_share"),
    "channel_shift": lambda s, d: _r(channel.channel_shift(_c(s, d), CUT), "pre_share", "post_share", "share_change_pp", "pct_volume_change"),
    "state_year_rates": lambda s, d: _r(_rates(s, d), "rate_per_100k"),
    "excluded_states": lambda s, d: geo.excluded_count(_c(s, d), non_states=OUT),
    "rate_anomalies": lambda s, d: _r(geo.rate_anomalies(_rates(s, d), 1996), "rate_per_100k", "median", "robust_z", "ratio_to_median"),
    "state_rate_changes": lambda s, d: _r(geo.state_rate_changes(_c(s, d), population(s), CUT, non_states=OUT), "pre_rate", "post_rate", "pct_change", "national_pct_change", "excess_pp"),
    "zip_concentration": lambda s, d: geo.zip_concentration(_c(s, d), 50, OUT),
    "rate_vs_templating": lambda s, d: geo.rate_vs_templating(_c(s, d), _f(s, d), population(s), SEGMENT, 1996, 2, OUT),
    "rate_templating_corr": lambda s, d: _r(geo.correlation(geo.rate_vs_templating(_c(s, d), _f(s, d), population(s), SEGMENT, 1996, 2, OUT), "rate_per_100k", "templated_pct"), "r"),
    "issue_topk": lambda s, d: followups.issue_topk(_c(s, d), F.year("date_received"), 3),
    "channel_by_year": lambda s, d: followups.channel_by_year(_c(s, d)),
    "geo_split": lambda s, d: _r(followups.geo_split(_f(s, d), population(s), SEGMENT, 1996, 1, OUT), "templated_per_100k", "organic_per_100k"),
    "rate_ratio": lambda s, d: _r(followups.rate_ratio(followups.geo_split(_f(s, d), population(s), SEGMENT, 1996, 1, OUT)), "templated_per_100k", "organic_per_100k", "ratio"),
    "geo_split_stats": lambda s, d: _r(followups.geo_split_stats(followups.geo_split(_f(s, d), population(s), SEGMENT, 1996, 1, OUT)), "templated_max_min", "organic_max_min", "templated_cv", "organic_cv", "r", digits=5),
    "relief_mix": lambda s, d: followups.relief_mix(_f(s, d), 1996),
    "relief_breakdown": lambda s, d: followups.relief_breakdown(_f(s, d), 1996),
    "relief_factor": lambda s, d: _r(followups.relief_factor(followups.relief_mix(_f(s, d), 1996)), "factor"),
    "respondent_monthly_ilike": lambda s, d: followups.respondent_monthly(_c(s, d), "company 1,", "COMPANY 2 ", more_than=3),
    "product_issue_topk": lambda s, d: followups.product_issue_topk(_c(s, d), "company 1", year=1997),
    "respondent_samples": lambda s, d: followups.samples(_c(s, d), "company 1", month_prefix="1997-1"),
    "tail_daily": lambda s, d: followups.tail_daily(_c(s, d), "2001-07-01"),
    "nearest_event": _nearest,
    "competing_events": _competing,
    **{f"idx_{n}": _idx(n) for n in ("text_month", "text_state_month", "text_company_month", "monthly", "company_month", "state_month", "relief_month")},
    "idx_refresh_equals_rebuild": _refreshed,
    "idx_prune": _pruned,
    "idx_backfill_companies": _backfilled,
    "idx_merge": _merged,
    "idx_stats": lambda s, d: index.stats(index.fold(facts(s, d))),
    "emit_headline": lambda s, d: index.emit_headline(index.fold(facts(s, d)), TEMPLATE_MIN),
    "emit_trend": lambda s, d: index.emit_trend(index.fold(facts(s, d)), AS_OF, TEMPLATE_MIN, "1995-01", 5),
    "emit_volume": lambda s, d: index.emit_volume(index.fold(facts(s, d)), AS_OF),
    "emit_states": lambda s, d: index.emit_states(index.fold(facts(s, d)), population(s), AS_OF, TEMPLATE_MIN, 5, 12, OUT),
    "emit_companies": lambda s, d: index.emit_companies(index.fold(facts(s, d)), AS_OF, TEMPLATE_MIN, 5),
    "emit_relief": lambda s, d: index.emit_relief(index.fold(facts(s, d)), AS_OF, TEMPLATE_MIN, 3),
    "payload_checks": _checks,
    "extraction_resumed": _extracted,
    "upsert_latest": _upsert,
    "population_unpivot": _unpivot,
    "sextile_buckets": lambda s, d: windows.quantile_buckets(_rates(s, d).where("year = 1997").select("state", "rate_per_100k"), "rate_per_100k").select("state", "bucket"),
    "histogram_26": lambda s, d: _r(windows.histogram(_rates(s, d).where("year = 1997"), "rate_per_100k"), "low", "high"),
    "cluster_size_bands": lambda s, d: neardup.size_bands(templates.exact_duplicate_groups(_s(s, d)).select("size")),
    "bucket_counts": lambda s, d: readers.bucket_counts(_c(s, d), ["product", "state", "submitted_via"]),
    "time_index": lambda s, d: windows.time_index(_series(s, d), ["series"], "month_start", "1998-11-01").select("series", "month_start", "t", "post", "t_post"),
    "ordinals": lambda s, d: s.range(32).select("id", ordinal(F.col("id")).alias("shown")),
    "shingle_stats": _shingle_stats,
    "jaccard_pairs_exact": _jaccard_pairs,
    "neardup_clusters": lambda s, d: neardup.cluster_summary(_near(s, d), _c(s, d)).withColumns({n: F.array_join(n, "," if n == "complaint_ids" else "|") for n in ("complaint_ids", "company_list", "state_list")}),
    "neardup_cohesion": lambda s, d: neardup.cohesion(_near(s, d), min_size=3),
    "cohesion_bands": lambda s, d: neardup.cohesion_bands(neardup.cohesion(_near(s, d), min_size=3)),
    "its_fit": _fit,
    "its_ols_log": lambda s, d: _fit(s, d, "ols_log"),
    "its_placebo": _placebo,
    "changepoints": lambda s, d: its.changepoints(_series(s, d)),
    "events_tumbling": lambda s, d: ev.tumbling(_events(s, d)),
    "events_sliding": lambda s, d: ev.sliding(_events(s, d)),
    "events_session": lambda s, d: ev.sessions(_events(s, d)),
    "events_late_dedup": lambda s, d: ev.deduplicated(_events(s, d).unionByName(_events(s, d))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")),
}


def flagship(spark, d) -> DataFrame:
    return QUERIES["templated_share_by_month"](spark, d)
