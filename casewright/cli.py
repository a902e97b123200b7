"""Command line: probe, fetch, status, its, bursts, dedupe, geo, report.

Data is a folder: ``complaints`` (parquet by month), ``out`` (CSV and Markdown results).
Results shown are of report size; everything else is written by Spark.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import dims, schema, session
from casewright.functions import names
from casewright.operators import bursts, channel, coverage, geo, index, its, joins, neardup, series, templates
from casewright.sources import extraction, readers, sinks
from casewright.sources.fixtures import scored
from casewright.storage import discard, materialize


def _data(spark, args) -> DataFrame:
    rows = spark.read.schema(schema.COMPLAINTS).parquet(f"{args.data}/complaints")
    return rows.where(series.in_scope(_segments(args), args.start, args.end) & series.in_months(args.start, args.end))


def _segments(args) -> list[str]:
    chosen = args.segments or list(dims.SELECTED)
    unknown = [s for s in chosen if s not in dims.SEGMENTS]
    if unknown:
        raise SystemExit(f"unknown segments {unknown}; known: {sorted(dims.SEGMENTS)}")
    return chosen


def _show(args, **frames: DataFrame) -> None:
    for name, df in frames.items():
        print(f"\n## {name}\n\n{sinks.markdown_table(df, args.limit)}")
        if args.out:
            sinks.write_csv(df, f"{args.out}/{name}")


def _series(c: DataFrame, args) -> DataFrame:
    counts = series.per_segment_and_all(c, _segments(args)).where(series.complete_months(args.as_of))
    counts = counts.withColumn("month_start", F.to_date(F.concat("month", F.lit("-01"))))
    return series.gap_filled(counts, "segment").withColumnRenamed("segment", "series")


def probe(spark, args) -> None:
    """Cases, narratives and download size by label of an extract, and labels no segment covers."""
    c = readers.extract_csv(spark, args.source, args.start, args.end)
    _show(args, sizes=coverage.size_estimate(c), unmapped=names.unmapped_labels(c), products=readers.bucket_counts(c, ["product", "state"]))


def fetch(spark, args) -> None:
    """Load an extract: rows replace those of the same id, in the months they fall into.

    With ``--append`` the extract is taken in passes by narrative flag (``--narratives``), and
    windows that the ledger holds are passed over unless they are recent (``--anew``: none is).
    The ledger is written last, so a run that breaks off is repeated, not trusted.
    """
    c = readers.extract_csv(spark, args.source, args.start, args.end).where(F.col("segment").isin(_segments(args)))
    path, log = f"{args.data}/complaints", f"{args.data}/ledger"
    if not args.append:
        sinks.write_months(c, path)
        return
    ends = c.agg(F.min("date_received").cast("string").alias("first"), F.max("date_received").cast("string").alias("last")).first()
    if ends["first"] is None:
        return
    start, end = args.start or ends["first"], args.end or ends["last"]
    products = sorted(x for s in _segments(args) for x in dims.SEGMENTS[s])
    windows = extraction.plan(c, products, start, end, args.narratives)
    windows = materialize(extraction.pending(windows, extraction.read_ledger(spark, log), end, not args.anew), "windows")
    fetched = extraction.extract(c, windows, products)
    months = [r[0] for r in fetched.select("month").distinct().collect()]
    stored = spark.read.schema(schema.COMPLAINTS).parquet(path)
    done = materialize(extraction.entries(windows, fetched, stored), "done")
    if months:
        both = materialize(index.upsert(stored.where(F.col("month").isin(months)), fetched.select(*stored.columns)), "staged")
        sinks.write_months(both, path)
        discard(both)
    done.write.mode("append").parquet(log)
    _show(args, ledger=done.orderBy("filter_key", "window_start"))


def status(spark, args) -> None:
    c = _data(spark, args)
    _show(args, coverage=coverage.coverage(c), segments=coverage.segment_counts(c), narratives=coverage.narrative_coverage(c).orderBy(F.desc("month")), labels=coverage.label_windows(c), thin=coverage.thin_months(c))


def its_(spark, args) -> None:
    s = _series(_data(spark, args), args)
    breaks = its.changepoints(s)
    near = joins.nearest_event(breaks, dims.milestones(spark), F.col("date"))
    events = dims.dated(spark, dims.CONFOUNDERS, "segment").withColumnRenamed("segment", "series")
    competing = joins.within_days(breaks.select("series", "date"), events, F.col("date"), 180, ["series"], "inner")
    fits = its.fit_dates(s, s.select("series").distinct().withColumn("date", F.lit(args.date).cast("date")), args.model)
    placebo = its.placebo_test(fits, its.fit_dates(s, its.placebo_dates(s), args.model))
    _show(args, breaks=near, competing=competing, its_results=its.fit_row(fits), placebo=placebo)


def bursts_(spark, args) -> None:
    c = _data(spark, args)
    found = bursts.explain_bursts(bursts.company_bursts(c, args.as_of, args.min_monthly, args.z), dims.dated(spark, dims.CORPORATE_EVENTS, "grp"))
    _show(args, segment_bursts=bursts.segment_bursts(c, args.as_of), company_bursts=found.orderBy(F.desc("z")), new_entrants=bursts.new_entrants(c), channel_shift=channel.channel_shift(c, args.date).orderBy(F.desc("share_change_pp")))


def dedupe(spark, args) -> None:
    c = _data(spark, args)
    members = neardup.near_duplicate_clusters(c, args.threshold)
    clusters, found = neardup.cluster_summary(members, c), neardup.cohesion(members)
    exact = templates.exact_duplicate_groups(scored(c)).orderBy(F.desc("size"), "first_id")
    _show(args, exact_duplicate_groups=exact, top_templates=templates.top_templates(scored(c), c), near_duplicate_clusters=neardup.cluster_row(clusters.where(F.col("size") >= args.export_floor), found).orderBy(F.desc("size"), "cluster"), sizes=neardup.size_bands(clusters), cohesion=neardup.cohesion_bands(found))


def geo_(spark, args) -> None:
    c, pop = _data(spark, args), readers.population_csv(spark, args.population)
    rates = geo.state_year_rates(c, pop)
    _show(args, state_year_rates=rates.orderBy(F.desc("year"), F.desc("rate_per_100k")), anomalies=geo.rate_anomalies(rates).orderBy(F.desc("robust_z")), changes=geo.state_rate_changes(c, pop, args.date).orderBy(F.desc("excess_pp")), zip_concentration=geo.zip_concentration(c).orderBy(F.desc("hhi")))


def report(spark, args) -> None:
    for part in (status, its_, bursts_, dedupe, *([geo_] if args.population else [])):
        part(spark, args)


VERBS = {"probe": probe, "fetch": fetch, "status": status, "its": its_, "bursts": bursts_, "dedupe": dedupe, "geo": geo_, "report": report}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="casewright", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    for flag, kind, default in (
        ("--data", str, "data"), ("--out", str, None), ("--source", str, None), ("--population", str, None), ("--start", str, None), ("--end", str, None), ("--as-of", str, None), ("--date", str, dims.MILESTONES[0][1]),
        ("--model", str, "nbinom"), ("--limit", int, 25), ("--min-monthly", int, 50), ("--z", float, 5.0), ("--threshold", float, 0.8), ("--export-floor", int, 10),
    ):
        p.add_argument(flag, type=kind, default=default)
    p.add_argument("--segments", nargs="*")
    p.add_argument("--append", action="store_true")
    p.add_argument("--anew", action="store_true")
    p.add_argument("--narratives", choices=extraction.PASSES, default="split")
    return p


def main(argv=None, spark=None) -> None:
    args = parser().parse_args(argv)
    VERBS[args.verb](spark or session.build(), args)


if __name__ == "__main__":
    main()
