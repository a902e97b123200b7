from __future__ import annotations

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright import dims
from casewright.functions.text import normalize
from casewright.operators import bursts, components, index, its, joins, neardup, series, windows
from casewright.sources import readers, sinks
from casewright.streaming import events as ev

CASE = "complaint_id long, date_received date, month string, segment string, company string, state string, company_response string, has_narrative int, narrative string"


def case(i, day, text="", segment="card", company="A", state="TX", response="Closed with explanation"):
    d = dt.date.fromisoformat(day)
    return (i, d, day[:7], segment, company, state, response, int(bool(text)), text)


def monthly(spark, values, start=(2010, 1), name="s"):
    months = [dt.date(start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1, 1) for i in range(len(values))]
    return spark.createDataFrame([(name, m, int(v)) for m, v in zip(months, values)], "series string, month_start date, complaints long")


def trailing(values, window=12, least=6):
    base, resid, out = [], [], []
    for i, x in enumerate(values):
        past = values[max(0, i - window) : i]
        b = statistics.median(past) if len(past) >= least else None
        base.append(b)
        r = [v for v in resid[max(0, i - window) : i] if v is not None]
        mad = statistics.median(r) * windows.MAD_SCALE if len(r) >= least else None
        sd = statistics.stdev(past) if len(past) >= least else None
        scale = mad if mad and mad > 0 else (sd or None)
        out.append(None if b is None or scale is None else (x - b) / scale)
        resid.append(None if b is None else abs(x - b))
    return out


@pytest.mark.parametrize("values", [[10] * 12 + [100], [3, 5, 4, 8, 2], list(range(5, 18)), [7, 9, 4, 6, 8, 30, 5, 6, 7, 9, 4, 50, 6, 5, 8, 90, 3, 4, 6, 7]])
def test_trailing_z_against_plain_python(spark, values):
    got = windows.trailing_robust_z(monthly(spark, values), ["series"], "month_start", "complaints").orderBy("month_start").collect()
    assert [None if r.z is None else round(r.z, 9) for r in got] == [None if z is None else round(z, 9) for z in trailing(values)]


def test_gap_fill_keeps_to_own_months(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 2), ("a", dt.date(2020, 4, 1), 3), ("b", dt.date(2020, 3, 1), 1)], "e string, month_start date, complaints long")
    got = sorted((r.e, r.month_start.month, r.complaints) for r in series.gap_filled(df, "e").collect())
    assert got == [("a", 1, 2), ("a", 2, 0), ("a", 3, 0), ("a", 4, 3), ("b", 3, 1)]


def test_the_registered_gap_filled_series_counts_every_case(spark):
    from casewright.plans import queries
    from tests.conftest import SF

    c = queries.complaints(spark, SF).where(F.col("month") < queries.AS_OF[:7]).select("company", "month").collect()
    want = {}
    for r in c:
        want.setdefault(r.company, {}).setdefault(r.month, 0)
        want[r.company][r.month] += 1
    got = {}
    for r in queries.QUERIES["gap_filled_series"](spark, SF).collect():
        got.setdefault(r.company, {})[r.month_start.isoformat()[:7]] = r.complaints
    assert {e: {m: n for m, n in by.items() if n} for e, by in got.items()} == want
    assert all(min(by) == min(want[e]) and max(by) == max(want[e]) for e, by in got.items())


@pytest.mark.parametrize("name", ["gap_filled_series", "gap_filled_companies"])
def test_negative_customer_keys_have_the_names_of_the_sql(spark, tmp_path, name):
    import duckdb

    from casewright.plans import oracle, queries
    from tests.conftest import SF, rows_of

    con = duckdb.connect()
    for t, k in (("orders", "o_custkey"), ("customer", "c_custkey"), ("nation", None), ("documents", None)):
        con.sql(f"copy (select * {f'replace (-{k} as {k})' if k else ''} from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(oracle.ORACLE["gap_filled_companies"])  # every case; the twin of gap_filled_series keeps a third
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


def test_nearest_event_takes_the_first_of_equals(spark):
    day = spark.createDataFrame([(dt.date(2000, 1, 11),)], "d date")
    got = joins.nearest_event(day, dims.milestones(spark, (("b", "2000-01-01"), ("a", "2000-01-21"))), F.col("d")).first()
    assert (got.nearest_event, got.nearest_gap) == ("b", 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_the_transitive_closure(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in list(parent)}
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_duplicates_join_chains_and_copies(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    one, two = base.copy(), base.copy()
    two[100] = "changed"
    texts = [" ".join(base), " ".join(one), " ".join(two), " ".join(f"v{rnd.randrange(5000)}" for _ in range(200)), "short text"]
    c = spark.createDataFrame([case(i, "2020-01-05", t, company=f"c{i}") for i, t in enumerate(texts)], CASE)
    members = neardup.near_duplicate_clusters(c)
    assert {r.complaint_id: r.cluster for r in members.collect()} == {0: 0, 1: 0, 2: 0}
    summary = neardup.cluster_summary(members, c).first()
    assert (summary.size, summary.companies, list(summary.complaint_ids)) == (3, 3, [0, 1, 2])
    found = neardup.cohesion(members, min_size=2).first()
    assert found.sampled == 2 and 0.9 < found.mean_similarity < 1
    assert neardup.near_duplicate_clusters(c, verify=True).count() == 3


def test_near_duplicates_against_plain_python(spark):
    """Clusters, cohesion and bands of the smallest tables, from signatures computed one shingle and permutation at a time."""
    import xxhash

    from casewright.plans import queries
    from tests.conftest import SF

    c = queries.complaints(spark, SF)
    rows = {r.complaint_id: r.norm for r in c.where("has_narrative = 1").select("complaint_id", normalize(F.col("narrative")).alias("norm")).collect() if len(r.norm.split()) >= 25}
    factor, shift = (x.tolist() for x in neardup.permutations(64))
    full, odd = (1 << 64) - 1, int(neardup._ODD)

    def grams(text):
        words, out = [xxhash.xxh64_intdigest(w.encode()) for w in text.split()], set()
        for i in range(len(words) - 4):
            h = 0
            for w in words[i : i + 5]:
                h = ((h + w) & full) * odd & full
                h ^= h >> 29
            out.add(h)
        return out

    bands, width = neardup.bands_for(0.8, 64)
    sets, parent, met = {n: grams(t) for n, t in rows.items()}, {n: n for n in rows}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n in sorted(rows):
        low = []
        for f, s in zip(factor, shift):
            mixed = ((g * f + s) & full for g in sets[n])
            low.append(min((m ^ m >> 32) * odd & full for m in mixed))
        for b in range(bands):
            other = met.setdefault((b, tuple(low[b * width : (b + 1) * width])), n)
            x, y = sorted((find(other), find(n)))
            parent[y] = x
    want = {}
    for n in rows:
        want.setdefault(find(n), []).append(n)
    want = {k: sorted(v) for k, v in want.items() if len(v) > 1}
    members = neardup.near_duplicate_clusters(c)
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster, []).append(r.complaint_id)
        assert r.norm == rows[r.complaint_id]
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 3
    alike = lambda x, y: len(x & y) / len(x | y)
    sims = {k: [alike(sets[n], sets[k]) for n in v[:40] if n != k] for k, v in want.items() if len(v) >= 3}
    found = neardup.cohesion(members, min_size=3)
    assert {r.cluster: (r.size, r.sampled, round(r.mean_similarity, 9), round(r.cohesion_pct, 9)) for r in found.collect()} == {
        k: (len(want[k]), len(v), round(statistics.fmean(v), 9), round(100 * sum(x >= 0.8 for x in v) / len(v), 9)) for k, v in sims.items()
    }
    bands_ = {}
    for k, v in sims.items():
        pct = 100 * sum(x >= 0.8 for x in v) / len(v)
        name = "tight" if pct >= 80 else "moderate" if pct >= 50 else "loose" if pct >= 20 else "chained"
        clusters, cases = bands_.get(name, (0, 0))
        bands_[name] = clusters + 1, cases + len(want[k])
    assert {r.band: (r.clusters, r.complaints) for r in neardup.cohesion_bands(found).collect()} == bands_


def test_no_band_is_left_out(spark):
    text = [f"w{i}" for i in range(60)]
    rows = [case(i, "2020-01-05", " ".join([*text, *[f"u{i}x{j}" for j in range(3)]])) for i in range(40)]
    c = spark.createDataFrame(rows, CASE)
    every = neardup.near_duplicate_clusters(c)
    assert {r.cluster for r in every.collect()} == {0} and every.count() == 40
    assert neardup.near_duplicate_clusters(c, max_group=3).count() < 40


def test_near_duplicates_of_nothing(spark):
    c = spark.createDataFrame([case(1, "2020-01-05", ""), case(2, "2020-01-05", "XXXX " * 40), case(3, "2020-01-05", "a b c")], CASE)
    members = neardup.near_duplicate_clusters(c)
    assert members.count() == 0 and neardup.cohesion(members).count() == 0


def test_cluster_rows_are_whole(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [case(5, "2020-01-05", "XXXX " + text, "s1", "B", "TX"), case(7, "2020-02-05", text, "s2", "A", ""), case(9, "2020-01-09", text + " XX/XX", "s1", "", "NY"), case(11, "2020-01-09", text, "s1", "C", "NY"), case(12, "2020-01-09", text, "s1", "D", "NY")]
    c = spark.createDataFrame(rows, CASE)
    members = neardup.near_duplicate_clusters(c)
    summary = neardup.cluster_summary(members, c)
    got = summary.first()
    assert (got.cluster, got.company_list, got.state_list, got.exemplar) == (5, ["A", "B", "C", "D"], ["NY", "TX"], text)
    assert got.mean_redaction_ratio == pytest.approx((1 / 41 + 0 + 1 / 41 + 0 + 0) / 5)
    flat = neardup.cluster_row(summary, neardup.cohesion(members, min_size=2), chars=8).first()
    assert (flat.top_companies, flat.exemplar, flat.cohesion_mean, flat.cohesion_pct, flat.cohesion_sampled) == ("A | B | C", text[:8], 1.0, 100.0, 4)
    assert (flat.mean_redaction_ratio, flat.segments, flat.ids) == (0.01, "s1,s2", "5, 7, 9, 11, 12")
    bare = neardup.cluster_row(summary, neardup.cohesion(members)).first()
    assert (bare.cohesion_mean, bare.cohesion_pct, bare.cohesion_sampled) == (None, None, 0)


def test_refresh_equals_rebuild_and_is_idempotent(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [case(i, f"2020-{1 + i % 4:02d}-10", text if i % 2 else "", company=f"c{i % 3}", state="TX" if i % 2 else "") for i in range(20)]
    c = spark.createDataFrame(rows, CASE)
    months = ["2020-03", "2020-04"]
    partial = index.fold(c.where(~F.col("month").isin(months)))
    again = index.refresh(index.refresh(partial, c, months), c, months)
    for name, want in index.fold(c).items():
        assert sorted(map(tuple, again[name].select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    merged = index.merge(index.fold(c.where("month < '2020-03'")), index.fold(c.where("month >= '2020-03'")))
    assert sorted(map(tuple, merged["monthly"].collect())) == sorted(map(tuple, index.fold(c)["monthly"].collect()))


def test_month_tables_on_disk(spark, tmp_path):
    c = spark.createDataFrame([case(1, "2020-01-10"), case(2, "2020-02-10")], CASE)
    index.write(index.fold(c), str(tmp_path))
    index.write(index.fold(spark.createDataFrame([case(3, "2020-02-11"), case(4, "2020-02-12")], CASE)), str(tmp_path))
    assert {(r.month, r.complaints) for r in index.read(spark, str(tmp_path))["monthly"].collect()} == {("2020-01", 1), ("2020-02", 2)}


def test_upsert_keeps_text_and_its_flag(spark):
    old = spark.createDataFrame([case(1, "2020-01-10", "kept"), case(2, "2020-01-10", "old")], CASE)
    new = spark.createDataFrame([case(1, "2020-02-10", ""), case(2, "2020-02-10", "new"), case(3, "2020-02-10")], CASE)
    got = {r.complaint_id: (r.month, r.narrative, r.has_narrative) for r in index.upsert(old, new).collect()}
    assert got == {1: ("2020-02", "kept", 1), 2: ("2020-02", "new", 1), 3: ("2020-02", "", 0)}


def test_refresh_window():
    assert index.refresh_months("2020-02", "2020-03", 3) == ["2019-11", "2019-12", "2020-01", "2020-02", "2020-03"]


@pytest.mark.parametrize("model", ["poisson", "nbinom", "ols_log"])
def test_its_finds_a_step(spark, model):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.poisson(100, 30), rng.poisson(150, 18)])
    s = monthly(spark, values)
    dates = spark.createDataFrame([("s", dt.date(2012, 7, 1))], "series string, date date")
    got = its.fit_dates(s, dates, model).first()
    assert 15 < got.level_pct < 110 and got.level_p < 0.01 and got.n == 48


def test_its_score_equations_vanish():
    rng = np.random.default_rng(2)
    months = np.arange("2010-01", "2014-01", dtype="datetime64[M]")
    y = rng.poisson(50, 48).astype(float)
    x = its.design(months, np.datetime64("2012-05-20"))
    _, _, mu, ok = its.glm(x, y)
    assert ok and np.abs(x.T @ (y - mu)).max() < 1e-3
    assert its.fit(months[:20], y[:20], "2010-08-01") is None


def test_placebo_bounds_and_changepoints(spark):
    values = [100 + (i * 7) % 5 for i in range(30)] + [300 + (i * 5) % 7 for i in range(30)]
    s = monthly(spark, values)
    real = its.fit_dates(s, spark.createDataFrame([("s", dt.date(2012, 7, 1))], "series string, date date"))
    got = its.placebo_test(real, its.fit_dates(s, its.placebo_dates(s))).first()
    assert got.percentile == 100 and got.as_large == 0 and got.verdict == "distinctive"
    breaks = its.changepoints(s).collect()
    assert [r.date for r in breaks] == [dt.date(2012, 7, 1)] and breaks[0].change_pct > 180
    assert its.changepoints(monthly(spark, values[:10])).count() == 0


def _greedy_breaks(y, penalty, jump=5, least=2):
    """The best split of all segments again and again, costs by definition."""
    cost = lambda a, b: float(((y[a:b] - y[a:b].mean()) ** 2).sum())
    cuts = [0, len(y)]
    while True:
        gains = [(cost(a, b) - cost(a, k) - cost(k, b), -k) for a, b in zip(cuts, cuts[1:]) for k in range(jump, len(y), jump) if k - a >= least and b - k >= least]
        if not gains or max(gains)[0] <= penalty + 1e-9:
            return cuts[1:-1]
        cuts = sorted([*cuts, -max(gains)[1]])


@pytest.mark.parametrize("levels", [[100, 300] * 6, [50, 80, 200, 20, 500, 90, 700, 10, 300, 33], [100] * 4])
def test_changepoints_have_no_limit(spark, levels):
    values = [v for v in levels for _ in range(20)]
    y = np.log1p(np.array(values, float))
    want = _greedy_breaks(y, 3 * y.std())
    assert its.binary_segmentation(y) == want and (len(want) > 5 or set(levels) == {100})
    got = its.changepoints(monthly(spark, values)).orderBy("date").collect()
    assert [r.date.year * 12 + r.date.month for r in got] == [2010 * 12 + 1 + k for k in want]


def test_changepoints_of_noise_against_brute_force():
    rng = np.random.default_rng(11)
    for size in (24, 60, 131):
        y = np.log1p(rng.poisson(np.repeat(rng.integers(1, 60, size // 12 + 1), 12)[:size]).astype(float))
        assert its.binary_segmentation(y, 0.5) == _greedy_breaks(y, 0.5)


def test_new_entrants_look_at_all_segments(spark):
    rows = [case(1, "2020-01-01", segment="mortgage", company="X"), *[case(10 + i, "2020-02-01", company="X") for i in range(5)], *[case(20 + i, "2020-02-01", company="Y") for i in range(5)]]
    got = bursts.new_entrants(spark.createDataFrame(rows, CASE), ["card"], 3).collect()
    assert [(r.company, r.first_month_complaints, r.total) for r in got] == [("Y", 5, 5)]


def test_extract_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Date received,Product,Complaint ID,Consumer complaint narrative,Other\n2020-01-05,Mortgage,7," told, ""twice""\nover",z\n2020-01-06,Widgets,x,,\n2020-1-7,Mortgage,8,,\n2020-02-01, mortgage ,9,,\n')
    got = readers.extract_csv(spark, str(tmp_path / "x.csv"), "2020-01-05", "2020-02-01").orderBy("complaint_id").collect()
    assert [(r.complaint_id, r.month, r.segment, r.has_narrative, r.narrative) for r in got] == [(7, "2020-01", "mortgage", 1, 'told, "twice"\nover'), (9, "2020-02", "mortgage", 0, "")]


def test_windows_cover_all_days():
    day = dt.date(2020, 1, 1)
    daily = [(day + dt.timedelta(i), 1000 if i != 50 else 0) for i in range(200)]
    found = readers.plan_windows(daily, day, day + dt.timedelta(199), 10_000)
    assert sum(n for *_, n in found) == 199_000 and max(n for *_, n in found) <= 10_000
    assert all((b - a).days >= 0 for a, b, _ in found)
    split = readers.split_overflow([(day, day + dt.timedelta(1))], {day: 5, day + dt.timedelta(1): 50}, {day + dt.timedelta(1): {"a": 20, "b": 30}}, 25)
    assert split == [(day, day, None, 5), (day + dt.timedelta(1), day + dt.timedelta(1), "a", 20), (day + dt.timedelta(1), day + dt.timedelta(1), "b", -1)]


def test_ledger(spark):
    w = "filter_key string, window_start date, window_end date"
    d = dt.date
    windows_ = spark.createDataFrame([("k", d(2020, 1, 1), d(2020, 1, 31)), ("k", d(2020, 5, 1), d(2020, 5, 31)), ("k", d(2020, 2, 1), d(2020, 2, 28))], w)
    done = spark.createDataFrame([("k", d(2020, 1, 1), d(2020, 1, 31), 5), ("k", d(2020, 5, 1), d(2020, 5, 31), 5)], w + ", received long")
    assert sorted(r.window_start.month for r in readers.pending_windows(windows_, done, "2020-06-15").collect()) == [2, 5]


def test_sinks_and_buckets(spark, tmp_path):
    df = spark.createDataFrame([(1, [3, 4])], "id long, ids array<long>")
    sinks.write_csv(df, str(tmp_path / "o"))
    back = spark.read.option("header", True).csv(str(tmp_path / "o")).select(sinks.read_array("ids").alias("ids")).first()
    assert back.ids == [3, 4]
    deep = '{"buckets":[{"key":"a","doc_count":2},{"key":7}]}'
    for _ in range(9):
        deep = '{"n":[1],"p":' + deep + ',"q":{"buckets":[]}}'
    texts = [deep, '{"buckets":3,"x":{"buckets":[]}}', '{"x":[{"buckets":[1]}]}', "no json", "", None]
    got = [r.b for r in spark.createDataFrame([(t,) for t in texts], "j string").coalesce(1).select(readers.find_buckets(F.col("j")).alias("b")).collect()]
    assert [None if b is None else [tuple(x) for x in b] for b in got] == [[("a", 2), ("7", None)], [], None, None, None, None]
    assert sinks.markdown_table(spark.createDataFrame([(1, "x")], "a int, b string")).splitlines()[2] == "| 1 | x |"


def test_streams_equal_their_batch_twins(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    want = sorted(map(tuple, ev.tumbling(batch).collect()), key=str)
    assert sorted(map(tuple, ev.run_available(ev.tumbling(stream)).collect()), key=str) == want


def test_month_stream_replaces(spark, tmp_path):
    rows = [(1, "2020-01", "a"), (2, "2020-01", "b"), (3, "2020-02", "c")]
    kind = "complaint_id long, month string, v string"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    for run in ("c1", "c2"):  # a second run over the same input replays every row
        ev.to_month_tables(spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
    assert sorted((r.complaint_id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("gate, change", [("complaints", {"complaints": 10**9}), ("fresh", {"days": 1}), ("states", {"states": 60})])
def test_payload_gates(spark, gate, change):
    from casewright.plans import queries as q

    tables = index.fold(q.complaints(spark, "/root/testdata/sf0.001"))
    pop = q.population(spark)
    checks = index.payload_checks(
        index.emit_headline(tables, 2), index.emit_trend(tables, q.AS_OF, 2, "1995-01", 1), index.emit_volume(tables, q.AS_OF), index.emit_states(tables, pop, q.AS_OF, 2, 1), index.emit_companies(tables, q.AS_OF, 2, 1),
        "2001-08-01", q.AS_OF, q.GATES | {"complaints": 100, "trend": 5, "states": 5, "companies": 1} | change,
    )
    assert {r.check: r.ok for r in checks.collect()}[gate] is False


def test_payload_shape(spark):
    from casewright.plans import queries as q

    payload = index.payload(index.fold(q.complaints(spark, "/root/testdata/sf0.001")), q.population(spark), q.AS_OF, "2001-08-01", 2)
    assert {"meta", "headline", "trend", "volume", "states", "companies", "relief", "relief_window"} <= set(payload)
    assert all(len(s["counts"]) == len(payload["volume"]["months"]) for s in payload["volume"]["series"])
    assert sinks.to_json(payload)


def test_passes_take_each_case_once_and_done_windows_are_passed_over(spark):
    import datetime as dt

    from casewright.sources import extraction

    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(200)]
    rows = [(1000 * i + k, d, "A" if k else "B", int(k % 3 == 0)) for i, d in enumerate(days) for k in range(1 + i % 7)]
    c = spark.createDataFrame(rows, "complaint_id long, date_received date, product string, has_narrative int")
    passes = {"split": ((1, 5), (0, 40)), "with": ((1, 5),), "without": ((0, 40),), "any": ((None, 30),)}
    want = {"split": lambda r: True, "any": lambda r: True, "with": lambda r: r[3] == 1, "without": lambda r: r[3] == 0}
    for mode in passes:
        windows = extraction.plan(c, ["A"], "2020-01-01", "2020-07-18", mode, passes)
        got = extraction.extract(c, windows, ["A"])
        assert sorted(r.complaint_id for r in got.collect()) == sorted(r[0] for r in rows if r[2] == "A" and want[mode](r))
        done = extraction.entries(windows, got, c.where("complaint_id < 50000"))
        assert all(r.received == r.expected for r in done.collect())
        left = extraction.pending(windows, done, "2020-07-18").collect()
        assert left and all(r.window_end >= dt.date(2020, 5, 19) for r in left)
        assert extraction.pending(windows, done, "2020-07-18", resume=False).count() == windows.count()
    assert extraction.plan(c.limit(0), ["A"], "2020-01-01", "2020-07-18").count() == 0
    with pytest.raises(ValueError):
        extraction.plan(c, ["A"], "2020-01-01", "2020-07-18", "none")


def test_events_within_days_meet_by_block(spark):
    import datetime as dt

    from casewright.operators import joins

    base = dt.date(1969, 12, 20)
    left = spark.createDataFrame([(i, base + dt.timedelta(i)) for i in range(60)] + [(99, None)], "id long, day date")
    events = spark.createDataFrame([(base + dt.timedelta(i), f"e{i}") for i in (0, 3, 11, 12, 29, 29, 58)], "event_date date, description string")
    for days in (0, 1, 5, 40):
        got = sorted((r.id, r.description, r.gap) for r in joins.within_days(left, events, F.col("day"), days, how="inner").collect())
        want = sorted((i, f"e{e}", abs(i - e)) for i in range(60) for e in (0, 3, 11, 12, 29, 29, 58) if abs(i - e) <= days)
        assert got == want
        assert joins.within_days(left, events, F.col("day"), days).select("id").distinct().count() == 61


def test_large_sides_are_not_marked_for_broadcast(spark):
    from casewright.storage import small

    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(small(spark.range(10))) and not hinted(small(spark.range(10), limit=1))
