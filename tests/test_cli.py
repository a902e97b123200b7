from __future__ import annotations

import csv
import datetime as dt

import pytest

from casewright import cli, schema


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    text = " ".join(f"word{i}" for i in range(40))
    with (folder / "x.csv").open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(schema.EXTRACT_HEADERS)
        for i in range(400):
            day = dt.date(2019, 1, 3) + dt.timedelta(days=4 * i)
            row = dict.fromkeys(schema.EXTRACT_HEADERS, "") | {
                "Date received": day.isoformat(), "Product": "Mortgage" if i % 3 else "Student loan", "Company": f"Firm {i % 5} Inc", "State": ("TX", "CA", "NY")[i % 3], "ZIP code": f"{100 + i % 7}XX",
                "Submitted via": "Web" if i % 4 else "Phone", "Company response to consumer": "Closed with explanation", "Consumer complaint narrative": text if i % 6 == 0 else "", "Complaint ID": str(1000 + i),
            }
            w.writerow(row.values())
    (folder / "pop.csv").write_text("state,year,population\n" + "".join(f"{s},{y},{1000000 + y}\n" for s in ("TX", "CA", "NY") for y in range(2019, 2023)))
    cli.main(["fetch", "--data", str(folder), "--source", str(folder / "x.csv")], spark)
    return folder


@pytest.mark.parametrize("verb", ["probe", "status", "its", "bursts", "dedupe", "geo"])
def test_verbs(spark, data, capsys, verb):
    cli.main([verb, "--data", str(data), "--source", str(data / "x.csv"), "--population", str(data / "pop.csv"), "--date", "2021-02-10", "--export-floor", "2", "--segments", "mortgage", "student_loan", "--out", str(data / "out")], spark)
    assert "## " in capsys.readouterr().out


def test_fetch_again_changes_nothing(spark, data):
    before = spark.read.parquet(f"{data}/complaints").count()
    cli.main(["fetch", "--append", "--data", str(data), "--source", str(data / "x.csv")], spark)
    assert spark.read.parquet(f"{data}/complaints").count() == before == 400


def test_unknown_segment(spark, data):
    with pytest.raises(SystemExit):
        cli.main(["status", "--data", str(data), "--segments", "nothing"], spark)


def test_fetch_goes_on_from_its_ledger(spark, data):
    args = ["fetch", "--append", "--data", str(data), "--source", str(data / "x.csv")]
    cli.main([*args, "--anew"], spark)
    before = {(r.filter_key, r.window_start) for r in spark.read.parquet(f"{data}/ledger").collect()}
    rows = spark.read.parquet(f"{data}/ledger").count()
    cli.main(args, spark)
    log = spark.read.parquet(f"{data}/ledger").collect()
    again = [r for r in log if r.window_end >= dt.date(2019, 1, 3) + dt.timedelta(days=4 * 399 - 60)]
    assert {(r.filter_key, r.window_start) for r in log} == before and len({r.filter_key for r in log}) == 2
    assert rows < len(log) <= rows + len(again) and all(r.received == r.expected and r.inserted == 0 for r in log)
    assert spark.read.parquet(f"{data}/complaints").count() == 400
