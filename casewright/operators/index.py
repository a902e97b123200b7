"""Month-keyed aggregate tables: fold, refresh, prune, upsert, ledger.

All seven tables are sums by key and month, so replacing months replaces their rows and
nothing else. Pruned tables are always derived from the unpruned ones: the result does not
depend on the order of refreshes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import dims, schema
from casewright.functions.names import with_company_group
from casewright.functions.text import normalize, text_hash
from casewright.storage import materialize

# Fixed values of the published tables: the totals' key, the least copies of a text in the detail, the firms with text detail.
#: Key of the rows that count all scored narratives of a state or firm.
ALL = "ALLNARRS"
DETAIL_MIN, COMPANY_TOP = 5, 40


def fold(c: DataFrame, min_tokens: int = 25) -> dict[str, DataFrame]:
    """The seven tables of ``c``, each one partial aggregation of its facts.

    Cases with texts are hashed once and their facts written; cases that carry a hash already are used as they are.
    """
    normal = F.when(F.col("has_narrative") == 1, normalize(F.col("narrative")))
    facts = c if "hash" in c.columns else c.withColumn("norm", normal).withColumn("hash", text_hash(F.col("norm"), min_tokens))
    facts = facts.select("month", "segment", "state", "company", "company_response", "has_narrative", "hash")
    if "hash" not in c.columns:
        facts = materialize(facts, "facts")
    facts = with_company_group(facts, "company", "grp").drop("company").withColumnRenamed("grp", "company")
    n, cases, narr = F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("complaints"), F.sum(F.col("has_narrative").cast("long")).alias("narratives")
    scored = facts.where("hash is not null")
    text = lambda key: scored.select(F.explode(F.array("hash", F.lit(ALL))).alias("hash"), key, "month").groupBy("hash", key, "month").agg(n)
    relieved = F.col("company_response").isin(list(dims.RELIEF)).cast("int").alias("relieved")
    closed = scored.where(~F.col("company_response").isin(list(dims.NON_FINAL)))
    return {
        "text_month": scored.groupBy("hash", "month").agg(n),
        "text_state_month": text("state"),
        "text_company_month": text("company"),
        "monthly": facts.groupBy("segment", "month").agg(cases, narr),
        "company_month": facts.groupBy("company", "segment", "month").agg(cases, narr),
        "state_month": facts.groupBy("state", "month").agg(cases, narr),
        "relief_month": closed.groupBy("segment", "month", "hash", relieved).agg(n),
    }


def merge(*parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sum of tables that hold different cases."""
    out = {}
    for name in parts[0]:
        measures = [f for f in ("n", "complaints", "narratives") if f in schema.INDEX[name].fieldNames()]
        keys = [f for f in schema.INDEX[name].fieldNames() if f not in measures]
        rows = parts[0][name]
        for p in parts[1:]:
            rows = rows.unionByName(p[name])
        out[name] = rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    return out


def purge(tables: dict[str, DataFrame], months: list[str]) -> dict[str, DataFrame]:
    return {name: t.where(~F.col("month").isin(months)) for name, t in tables.items()}


def refresh(tables: dict[str, DataFrame], fresh: DataFrame, months: list[str], min_tokens: int = 25) -> dict[str, DataFrame]:
    """``tables`` with the given months replaced by the cases of ``fresh``; cases of other months are not taken."""
    new = fold(fresh.where(F.col("month").isin(months)), min_tokens)
    return {name: t.unionByName(new[name]) for name, t in purge(tables, months).items()}


def backfill_months(tables: dict[str, DataFrame], last: int = 18, since: str | None = None) -> list[str]:
    """The index's months from ``since`` on, else its ``last`` ones."""
    months = sorted(r[0] for r in tables["monthly"].select("month").distinct().collect())
    return [m for m in months if m >= since] if since else months[-last:]


def backfill_companies(tables: dict[str, DataFrame], c: DataFrame, months: list[str], company_top: int = COMPANY_TOP, min_tokens: int = 25) -> dict[str, DataFrame]:
    """``tables`` with the firms' text detail of the given months counted anew from ``c``, and kept for the largest firms only; no other table changes."""
    new = fold(c.where(F.col("month").isin(months)), min_tokens)["text_company_month"].where("company <> ''")
    detail = purge({"detail": tables["text_company_month"]}, months)["detail"].unionByName(new)
    detail = detail.join(F.broadcast(_largest(tables, company_top)), "company", "left_semi")
    return tables | {"text_company_month": detail.select(*schema.INDEX["text_company_month"].fieldNames())}


def _largest(tables: dict[str, DataFrame], k: int) -> DataFrame:
    """The ``k`` firms with the most cases (ties: name)."""
    return tables["company_month"].groupBy("company").agg(F.sum("complaints").alias("_c")).orderBy(F.desc("_c"), "company").limit(k).select("company")


def refresh_months(watermark: str, as_of: str, months_back: int = 3) -> list[str]:
    """Months from ``months_back`` before the watermark's to that of ``as_of``, both included."""
    count = lambda m: int(m[:4]) * 12 + int(m[5:7]) - 1
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(count(watermark) - months_back, count(as_of) + 1)]


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table partitioned by month; only months present are replaced, after all rows are computed."""
    for name, t in tables.items():
        t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/{name}")


def read(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in schema.INDEX.items()}


def prune(tables: dict[str, DataFrame], detail_min: int = DETAIL_MIN, company_top: int = COMPANY_TOP) -> dict[str, DataFrame]:
    """Tables for publication: rare texts leave the detail, only the largest firms keep text detail, rare relief rows fold into hash ''."""
    common = tables["text_month"].groupBy("hash").agg(F.sum("n").alias("_n")).where(F.col("_n") >= detail_min).select("hash")
    kept = common.unionByName(common.sparkSession.createDataFrame([(ALL,)], "hash string"))
    top = _largest(tables, company_top)
    relief = tables["relief_month"].join(common.withColumn("_common", F.lit(True)), "hash", "left")
    relief = relief.withColumn("hash", F.when(F.col("_common"), F.col("hash")).otherwise("")).groupBy("segment", "month", "hash", "relieved").agg(F.sum("n").alias("n"))
    detail = lambda name: tables[name].join(kept, "hash", "left_semi")
    return tables | {"text_state_month": detail("text_state_month"), "text_company_month": detail("text_company_month").join(F.broadcast(top), "company", "left_semi"), "relief_month": relief}


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in sorted(tables.items()):
        row = t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def upsert(existing: DataFrame, new: DataFrame, key: str = "complaint_id") -> DataFrame:
    """Rows by key, those of ``new`` winning column by column; a blank new narrative leaves the old one, and the flag follows what is kept."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    other = [c for c in existing.columns if c not in (key, "narrative", "has_narrative")]
    text = F.when(F.col("narrative") != "", F.struct("_new", "narrative"))
    out = both.groupBy(key).agg(F.max_by(F.struct(*other), "_new").alias("_r"), F.coalesce(F.max(text)["narrative"], F.lit("")).alias("narrative"))
    return out.select(key, "_r.*", "narrative", (F.col("narrative") != "").cast("int").alias("has_narrative")).select(*existing.columns)


def put(meta: DataFrame, key: str, value: str) -> DataFrame:
    """Key/value table with one key set."""
    return meta.where(F.col("key") != key).unionByName(meta.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def log_window(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Ledger with the windows of ``rows`` replaced."""
    return ledger.join(rows, ["filter_key", "window_start", "window_end"], "left_anti").unionByName(rows)


def watermark(c: DataFrame) -> DataFrame:
    return c.agg(F.max("date_received").cast("string").alias("last_date"))


def last_months(tables: dict[str, DataFrame], as_of: str, k: int) -> DataFrame:
    """The last ``k`` months with data before the month of ``as_of`` (one column; at most ``k`` rows)."""
    months = tables["monthly"].where(F.col("month") < as_of[:7]).select("month").distinct()
    return months.orderBy(F.desc("month")).limit(k)


def _templates(tables: dict[str, DataFrame], template_min: int) -> DataFrame:
    return tables["text_month"].groupBy("hash").agg(F.sum("n").alias("_n")).where(F.col("_n") >= template_min).select("hash", F.lit(1).alias("templated"))


def _pct(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.try_divide(100 * part, whole), digits)


def emit_trend(tables, as_of: str, template_min: int = 50, since: str = "2016-01", floor: int = 150) -> DataFrame:
    """Templated share by complete month with enough narratives."""
    rows = tables["text_month"].where((F.col("month") >= since) & (F.col("month") < as_of[:7])).join(_templates(tables, template_min), "hash", "left")
    out = rows.groupBy("month").agg(F.sum("n").alias("narratives"), F.coalesce(F.sum(F.when(F.col("templated") == 1, F.col("n"))), F.lit(0)).alias("templated"))
    return out.where(F.col("narratives") >= floor).withColumn("pct", _pct(F.col("templated"), F.col("narratives"), 2))


def emit_volume(tables, as_of: str) -> DataFrame:
    """Dense (segment, month, complaints), with each segment's rank by its total over all months."""
    months = tables["monthly"].where(F.col("month") < as_of[:7]).select("month").distinct()
    totals = tables["monthly"].groupBy("segment").agg(F.sum("complaints").alias("total"))
    seen = tables["monthly"].where(F.col("month") < as_of[:7]).select("segment").distinct()
    totals = totals.join(seen, "segment", "left_semi").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "segment")))
    # Both sides are dimensions: distinct months, and segments of the crosswalk.
    spine = months.join(F.broadcast(totals.select("segment", "rank")))
    return spine.join(tables["monthly"].select("segment", "month", "complaints"), ["segment", "month"], "left").withColumn("complaints", F.coalesce("complaints", F.lit(0)))


def _text_share(tables, table: str, key: str, months: DataFrame, template_min: int) -> DataFrame:
    rows = tables[table].join(F.broadcast(months), "month", "left_semi").join(_templates(tables, template_min), "hash", "left")
    return rows.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("hash") == ALL, F.col("n"))), F.lit(0)).alias("scored"), F.coalesce(F.sum(F.when((F.col("hash") != ALL) & (F.col("templated") == 1), F.col("n"))), F.lit(0)).alias("_t"))


def emit_states(tables, population: DataFrame, as_of: str, template_min: int = 50, floor: int = 200, window: int = 12, non_states=dims.NON_STATES) -> DataFrame:
    months = last_months(tables, as_of, window)
    latest = population.join(F.broadcast(population.agg(F.max("year").alias("year"))), "year", "left_semi").select("state", "population")
    counts = tables["state_month"].join(F.broadcast(months), "month", "left_semi").where(~F.col("state").isin(list(non_states))).groupBy("state").agg(F.sum("complaints").alias("complaints"))
    share = _text_share(tables, "text_state_month", "state", months, template_min)
    out = counts.join(F.broadcast(latest), "state").join(share, "state", "left")
    return out.select("state", "complaints", F.round(F.col("complaints") / F.col("population") * 100000, 1).alias("per_100k"), F.when(F.col("scored") >= floor, _pct(F.col("_t"), F.col("scored"), 1)).alias("templated_pct"))


def emit_companies(tables, as_of: str, template_min: int = 50, floor: int = 200, window: int = 12, top: int = 20) -> DataFrame:
    """The largest firms of the window; a blank one is dropped after the cut, so fewer than ``top`` may remain."""
    months = last_months(tables, as_of, window)
    counts = tables["company_month"].join(F.broadcast(months), "month", "left_semi").groupBy("company").agg(F.sum("complaints").alias("complaints"), F.sum("narratives").alias("narratives"))
    counts = counts.orderBy(F.desc("complaints"), "company").limit(top).where("company <> ''")
    share = _text_share(tables, "text_company_month", "company", months, template_min)
    return share.join(F.broadcast(counts), "company", "right").select("company", "complaints", "narratives", F.when(F.col("scored") >= floor, _pct(F.col("_t"), F.col("scored"), 1)).alias("templated_pct"))


def emit_relief(tables, as_of: str, template_min: int = 50, floor: int = 500, window: int = 24) -> DataFrame:
    """Relief among templated and organic closed cases by segment, both sides at least ``floor``."""
    rows = tables["relief_month"].join(F.broadcast(last_months(tables, as_of, window)), "month", "left_semi").join(_templates(tables, template_min), "hash", "left")
    is_t = F.coalesce(F.col("templated") == 1, F.lit(False))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    out = rows.groupBy("segment").agg(part(is_t).alias("t_closed"), part(is_t & (F.col("relieved") == 1)).alias("t_relief"), part(~is_t).alias("o_closed"), part(~is_t & (F.col("relieved") == 1)).alias("o_relief"))
    out = out.where((F.col("t_closed") >= floor) & (F.col("o_closed") >= floor))
    return out.select("segment", "t_closed", _pct(F.col("t_relief"), F.col("t_closed"), 1).alias("t_relief_pct"), "o_closed", _pct(F.col("o_relief"), F.col("o_closed"), 1).alias("o_relief_pct"))


def emit_headline(tables, template_min: int = 50) -> DataFrame:
    """Totals over all months, the current one included."""
    cases = tables["monthly"].agg(F.sum("complaints").alias("complaints"), F.sum("narratives").alias("narratives"))
    texts = tables["text_month"].groupBy("hash").agg(F.sum("n").alias("n"))
    big = F.col("n") >= template_min
    texts = texts.agg(F.sum("n").alias("scored_narratives"), F.coalesce(F.sum(F.when(big, F.col("n"))), F.lit(0)).alias("templated"), F.count_if(big).alias("distinct_templates"))
    return cases.join(F.broadcast(texts)).withColumn("templated_pct", _pct(F.col("templated"), F.col("scored_narratives"), 2))


#: Plausibility limits of a published payload (fixed values).
GATES = {"complaints": 15_000_000, "low_pct": 5.0, "high_pct": 70.0, "trend": 60, "states": 40, "companies": 8, "days": 75}


def payload_checks(headline: DataFrame, trend: DataFrame, volume: DataFrame, states: DataFrame, companies: DataFrame, data_through: str, as_of: str, gates: dict = GATES) -> DataFrame:
    """(check, ok) for every gate a payload has to pass. All inputs are report-sized."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    tail = trend.orderBy(F.desc("month")).limit(3).agg(F.coalesce(F.max("pct"), F.lit(1.0)).alias("tail"))
    row = headline.select(F.col("complaints").alias("h_complaints"), F.col("templated_pct").alias("h_pct"))
    for part in (count(trend, "n_trend"), count(states, "n_states"), count(companies, "n_companies"), tail, volume.agg(F.sum("complaints").alias("v_complaints"))):
        row = row.join(F.broadcast(part))
    age = F.datediff(F.lit(as_of).cast("date"), F.lit(data_through).cast("date"))
    checks = {
        "complaints": F.col("h_complaints") >= gates["complaints"],
        "templated_pct": F.col("h_pct").between(gates["low_pct"], gates["high_pct"]),
        "trend_points": F.col("n_trend") >= gates["trend"],
        "states": F.col("n_states") >= gates["states"],
        "companies": F.col("n_companies") >= gates["companies"],
        "fresh": age <= gates["days"],
        "tail_not_zero": F.col("tail") > 0,
        "volume": F.col("v_complaints") >= F.lit(gates["complaints"]) * 0.5,
    }
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()])).alias("c")).select("c.check", "c.ok")


def payload(tables, population: DataFrame, as_of: str, data_through: str, template_min: int = 50) -> dict:
    """The nested payload of all panels (report-sized; collected to the driver)."""
    from casewright.functions.names import display_name
    from casewright.sources.sinks import records

    months = sorted(r["month"] for r in records(last_months(tables, as_of, 10_000)))
    volume = records(emit_volume(tables, as_of).orderBy("rank", "month"))
    segments = list(dict.fromkeys(r["segment"] for r in volume))
    companies = emit_companies(tables, as_of, template_min).withColumn("company", display_name(F.col("company")))
    relief = [{"segment": r["segment"], "templated": {"closed": r["t_closed"], "relief_pct": r["t_relief_pct"]}, "organic": {"closed": r["o_closed"], "relief_pct": r["o_relief_pct"]}} for r in records(emit_relief(tables, as_of, template_min))]
    return {
        "meta": {"data_through": data_through, "last_complete_month": months[-1] if months else None, "template_threshold": template_min, "window_months": len(months[-12:])},
        "headline": records(emit_headline(tables, template_min))[0],
        "trend": records(emit_trend(tables, as_of, template_min).orderBy("month")),
        "volume": {"months": months, "series": [{"segment": s, "counts": [r["complaints"] for r in volume if r["segment"] == s]} for s in segments]},
        "states": records(emit_states(tables, population, as_of, template_min).orderBy(F.desc("complaints"), "state")),
        "companies": records(companies.orderBy(F.desc("complaints"), "company")),
        "relief": sorted(relief, key=lambda r: -(r["templated"]["closed"] + r["organic"]["closed"])),
        "relief_window": {"from": months[-24] if len(months) >= 24 else (months or [None])[0], "to": (months or [None])[-1], "months": len(months[-24:])},
    }
