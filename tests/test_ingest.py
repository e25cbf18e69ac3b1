import datetime as dt
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import observation
from tideline import cli
from tideline.config import Config, quarters_between
from tideline.operators import crosscheck, ingest
from tideline.schema import MEMBERS, OBSERVATIONS
from tideline.sources import archive, companyfacts, observations
from tideline.sources.download import DownloadError, download, read_manifest
from tideline.streaming import arrivals


def tsv(member, rows, header=None):
    columns = MEMBERS[member]
    lines = ["\t".join(header or columns)] + ["\t".join(str(r.get(c, "")) for c in columns) for r in rows]
    return "\n".join(lines) + "\n"


QUARTER = "2022q2"
MINE, CORRECTED, PROSPECTUS = "0000007-22-000031", "0000007-22-000044", "0000009-22-000002"
#: What becomes of each row of the archive below, and how often.
WANT = dict(drop_segments=2, drop_qtrs=2, drop_form=2, drop_custom=1, drop_ambiguous=2, drop_duplicate=1, kept=4)


def archive_of(config, headers=None):
    """An archive with three filings: a report, its amendment, and one of a form that doesn't count."""
    forms = {MINE: ("7", "10-Q", "20220506"), CORRECTED: ("7", "10-Q/A", "20220610"), PROSPECTUS: ("9", "S-1", "20220512")}
    sub = [dict(adsh=a, cik=c, form=f, period="20220331", fy="2022", fp="Q1", filed=d, accepted=f"{d[:4]}-{d[4:6]}-{d[6:]} 08:05:00.0") for a, (c, f, d) in forms.items()]

    def told(adsh, tag, value, qtrs="0", version="gaap/2022", **more):
        return dict(adsh=adsh, tag=tag, version=version, ddate="20220331", qtrs=qtrs, uom="USD", value=value) | more

    num = [
        told(MINE, "Cash", "100"),
        told(MINE, "Cash", "60", coreg="Subsidiary"),
        told(CORRECTED, "Revenues", "9", "1", segments="Region=North;"),
        told(MINE, "Revenues", "250", "1"),
        told(MINE, "Revenues", "900", "6"),
        told(CORRECTED, "Revenues", "900", "one"),
        told(PROSPECTUS, "Cash", "1"),
        told(PROSPECTUS, "Revenues", "2", "1"),
        told(MINE, "WidgetBacklog", "3", version=MINE),
        told(CORRECTED, "Cash", "101"),
        told(CORRECTED, "Debt", "7"),
        told(CORRECTED, "Debt", "7.0"),
        told(MINE, "Debt", "40"),
        told(MINE, "Debt", "40"),
    ]
    tag = [dict(tag=t, version="gaap/2022", custom="0") for t in ("Cash", "Revenues", "Debt")] + [dict(tag="WidgetBacklog", version=MINE, custom="1")]
    config.raw_dir.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(config.raw_dir / f"{QUARTER}.zip", "w") as z:
        for member, rows in (("sub.txt", sub), ("num.txt", num), ("tag.txt", tag)):
            z.writestr(member, tsv(member, rows, (headers or {}).get(member)))


def test_every_dropped_row_is_counted_and_runs_repeat(spark, tmp_path):
    config = Config.of(QUARTER, tmp_path)
    archive_of(config)
    for _ in range(2):
        assert archive.build_quarter(spark, config, QUARTER) == WANT | dict(total_in=sum(WANT.values()))
    rows = observations.load(spark, config).collect()
    assert sorted((r["adsh"], r["tag"], r["qtrs"], r["value"]) for r in rows) == [(MINE, "Cash", 0, 100.0), (MINE, "Debt", 0, 40.0), (MINE, "Revenues", 1, 250.0), (CORRECTED, "Cash", 0, 101.0)]
    (row,) = observations.load(spark, config, ciks=[7], tags=["Revenues"], ddate_max=dt.date(2022, 3, 31), qtrs=1, years=[2022]).collect()
    assert (row["filed"], row["accepted"], row["fp"], row["filed_year"]) == (dt.date(2022, 5, 6), dt.datetime(2022, 5, 6, 8, 5), "Q1", 2022)
    assert observations.load(spark, config, ciks=[9]).count() == 0 == observations.load(spark, config, years=[2021]).count()


def test_a_changed_header_stops_everything(spark, tmp_path):
    config = Config.of(QUARTER, tmp_path)
    num, tag = MEMBERS["num.txt"], MEMBERS["tag.txt"]
    swapped, more = (tag[1], tag[0], *tag[2:]), (*tag, "extra")
    for headers, said in (({"num.txt": num[:-1]}, f"num.txt: column {len(num)}, '{num[-1]}', is not there"), ({"tag.txt": swapped}, f"tag.txt: column 1 is '{tag[1]}' in place of '{tag[0]}'"), ({"tag.txt": more}, f"tag.txt: column {len(more)}, 'extra'")):
        archive_of(config, headers)
        with pytest.raises(archive.UnexpectedHeader, match=said):
            archive.build_quarter(spark, config, QUARTER)
        (member,) = headers
        with pytest.raises(Exception, match=said):  # the scan itself raises too
            archive.scan(spark, archive.published(spark, config, [QUARTER]), member).count()
    assert not Path(config.observations).exists()
    with pytest.raises(FileNotFoundError):
        observations.load(spark, config)
    with pytest.raises(FileNotFoundError):
        archive.build_quarter(spark, config, "2022q3")


def test_a_null_beside_a_value_is_a_contradiction_and_beside_a_null_a_duplicate(spark, tmp_path):
    config = Config.of(QUARTER, tmp_path)
    archive_of(config)
    sub, num, tag = (df.drop("quarter") for df in archive.members(spark, archive.published(spark, config, [QUARTER])))
    one = num.where(F.col("adsh") == MINE).where("tag = 'Cash' and coreg is null")
    gap = one.withColumn("value", F.lit(None).cast("string"))
    for rows, reason, n in ((one.union(gap), "drop_ambiguous", 2), (gap.union(gap), "drop_duplicate", 1)):
        counts = {r["reason"]: r["n_rows"] for r in ingest.audited(sub, rows, tag)[1].collect()}
        assert counts[reason] == n and sum(counts.values()) == 2


def test_a_scan_of_many_archives_opens_each_in_a_task(spark, tmp_path):
    """Ragged and odd lines are read as Spark's own reader does, chunk by chunk; a build replaces the quarters it names only."""
    quarters, odd = [f"20{y}q{q}" for y in (21, 22) for q in (1, 2, 3, 4)], ["a\tb", "", "\t\tc\r", "x\t" * 14, 'q"\t"z', "é😀\t\ufffd", "last"]
    uris = {}
    for k, quarter in enumerate(quarters):
        uris[quarter] = str(tmp_path / f"{quarter}.zip")
        with zipfile.ZipFile(uris[quarter], "w") as z:
            z.writestr("num.txt", "\t".join(MEMBERS["num.txt"]) + "\n" + "\n".join(odd * (k + 1)))
    df = archive.scan(spark, uris, "num.txt")
    assert df.rdd.getNumPartitions() == len(quarters)
    plain_file = tmp_path / "plain"
    plain_file.mkdir()
    (plain_file / "num.txt").write_text("\t".join(MEMBERS["num.txt"]) + "\n" + "\n".join(odd) + "\n")
    spark_read = spark.read.csv(str(plain_file), schema=", ".join(f"{c} string" for c in MEMBERS["num.txt"]), sep="\t", quote="", header=True, enforceSchema=True)
    want = sorted(map(str, spark_read.collect()))
    assert sorted(map(str, df.where("quarter = '2021q1'").drop("quarter").collect())) == want
    assert {r["quarter"]: r["count"] for r in df.groupBy("quarter").count().collect()} == {q: len(want) * (k + 1) for k, q in enumerate(quarters)}
    assert archive.scan(spark, uris, "num.txt", ["value", "adsh"]).columns == ["value", "adsh"]
    with zipfile.ZipFile(uris["2022q4"]) as z, z.open("num.txt") as f, z.open("num.txt") as g:
        assert sum(archive.lines(f, 7), []) == sum(archive.lines(g), [])
    assert archive.scan(spark, uris, archive.HEADERS).where("member = 'sub.txt'").count() == len(quarters)
    broken = uris | {"2023q1": str(tmp_path / "none.zip")}
    with pytest.raises(Exception, match="none.zip"):
        archive.scan(spark, broken, "num.txt").count()


def test_point_reads_skip_row_groups(spark, tmp_path):
    """Of a company's rows few row groups are opened, of one filing's those that may hold it."""
    import pyarrow.parquet as pq

    days = [f"2022-{m:02d}-11" for m in range(1, 13)]
    rows = spark.createDataFrame([observation(16 * c, f"{c:05d}-22-{k}", day_, float(c)) for c in range(300) for k, day_ in enumerate(days)], OBSERVATIONS)
    config = Config.of("2022q1", tmp_path)
    ingest.write(rows.coalesce(1), config.observations, "2022q1", row_group=1 << 14)
    groups = [g for f in Path(config.observations).rglob("*.parquet") for g in [pq.ParquetFile(f).metadata.row_group(k).column(0).statistics for k in range(pq.ParquetFile(f).num_row_groups)]]
    assert len(groups) >= 8 and sum(g.min <= 16 * 7 <= g.max for g in groups) <= 2
    assert observations.load(spark, config, ciks=[16 * 7]).count() == len(days)
    files_ = list(Path(config.observations).rglob("*.parquet"))
    assert all(pq.ParquetFile(f).metadata.row_group(0).column(1).path_in_schema == "adsh" for f in files_)


def test_command_line(spark, tmp_path):
    config = Config.of(QUARTER, tmp_path)
    archive_of(config)
    args = ["--quarters", QUARTER, "--root", str(tmp_path)]
    for command in (["build", "--offline"], ["census"], ["demo"], ["renames"]):
        assert cli.main([*command, *args], spark) == 0
    assert json.loads((config.out_dir / "summary.json").read_text())["n_rows"] == 4
    second = config.raw_dir / "companyfacts"
    second.mkdir()
    record = {"end": "2022-03-28", "val": 100, "filed": "2022-05-06"}
    (second / "CIK0000000007.json").write_text(json.dumps({"facts": {"us-gaap": {"Cash": {"units": {"USD": [record]}}}}}))
    assert cli.main(["crosscheck", "--offline", *args], spark) == 0
    report = json.loads((config.out_dir / "crosscheck_summary.json").read_text())
    assert (report["matched_observations"], report["value_agreement"], report["our_rows"]) == (1, 1.0, 4)
    one = ["case", "--offline", "--cik", "7", "--tag", "Cash", "--uom", "USD", "--end", "2022-03-28", "--first", "100", "--final", "90"]
    with pytest.raises(SystemExit, match="Cash"):
        cli.main([*one, *args], spark)
    assert json.loads((config.out_dir / "known_case.json").read_text())["first_as_expected"]
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        return
    assert cli.main(["figure", *args], spark) == 0 and (config.figures_dir / "census.png").exists()


def test_second_source(spark):
    concept = {"units": {"EUR": [{"start": "2021-07-01", "end": "2022-01-02", "val": 12.25, "filed": "2022-02-14"}, {"end": "2022-03-16", "val": None, "filed": "2022-04-29"}, {"end": "mid-year", "val": 1, "filed": "2022-04-29"}]}}
    texts = [json.dumps({"facts": {"us-gaap": {"Inventory": concept}, "dei": {}}}), "[1, 2", "{}", None]
    docs = spark.createDataFrame([(30 + k, t) for k, t in enumerate(texts)], "cik long, json string")
    rows = {tuple(r) for r in companyfacts.flattened(docs).collect()}
    assert rows == {(30, "Inventory", "EUR", dt.date(2021, 12, 31), 2, dt.date(2022, 2, 14), 12.25), (30, "Inventory", "EUR", dt.date(2022, 3, 31), 0, dt.date(2022, 4, 29), None)}


def test_the_second_source_is_fetched_once_and_faults_are_passed_over(spark, tmp_path):
    """Against a service of our own: what is there isn't asked for again, a fault is a row, a passing one is tried again, and all requests keep to the rate."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked, lock = [], threading.Lock()

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            cik = int(self.path.strip("/"))
            with lock:
                asked.append((cik, time.monotonic()))
                again = sum(c == cik for c, _ in asked)
            self.send_response(404 if cik == 8 else 503 if cik == 9 and again == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"facts": {}, "cik": cik, "agent": self.headers["User-Agent"]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        config = Config.of(QUARTER, tmp_path, rate_limit_sleep=0.1, user_agent="tests of ours")
        url, ciks = f"http://127.0.0.1:{server.server_port}/{{cik}}", [7, 8, 9, *range(20, 32)]
        first = {r["cik"]: r for r in companyfacts.fetch(spark, config, ciks, url).collect()}
        assert set(first) == set(ciks) and first[8]["json"] is None and first[8]["error"] == "status 404"
        assert all(json.loads(first[c]["json"]) == {"facts": {}, "cik": c, "agent": "tests of ours"} for c in ciks if c != 8)
        times = sorted(t for _, t in asked)
        counts = {c: sum(a == c for a, _ in asked) for c in ciks}
        assert counts[9] == 2 and counts[8] == 2 and all(counts[c] == 1 for c in ciks if c not in (8, 9))  # the row of a fault is asked for by each of two scans
        assert (len(ciks) - 1) / (times[len(ciks) - 1] - times[0]) < 2 / config.rate_limit_sleep
        asked.clear()
        again = {r["cik"]: r["source"] for r in companyfacts.fetch(spark, config, [c for c in ciks if c != 8], url).collect()}
        assert set(again.values()) == {"folder"} and not asked
        assert {r["cik"] for r in companyfacts.read(spark, companyfacts.folder(config)).collect()} == set(ciks) - {8}
        assert not list(Path(companyfacts.folder(config)).glob("*.part"))
    finally:
        server.shutdown()


def test_a_known_case(spark):
    def told(filed, accn, form, val, end="2020-06-30", start="2020-01-01"):
        return {"start": start, "end": end, "val": val, "filed": filed, "accn": accn, "form": form}

    records = [told("2021-08-02", "b", "10-Q", 310), told("2020-08-03", "a", "10-Q", -40), told("2021-08-02", "c", "10-Q", 320), told("2020-08-03", "a", "10-Q", 1, end="2020-03-31")]
    docs = spark.createDataFrame([(5, json.dumps({"facts": {"us-gaap": {"OtherGains": {"units": {"USD": records}}}}}))], "cik long, json string")
    series = companyfacts.series(docs, 5, "OtherGains", "USD", dt.date(2020, 6, 30))
    assert [(r["accn"], r["value"]) for r in series.collect()] == [("a", -40.0), ("b", 310.0), ("c", 320.0)]
    row = companyfacts.known_case(series, -40.0, 320.0).first()
    assert (row["first_as_expected"], row["final_as_expected"], row["both_kept"], row["silent"], row["lag_days"], row["holds"]) == (True, True, True, True, 364, True)
    assert not companyfacts.known_case(series, -40.0, 310.0).first()["holds"] and not companyfacts.known_case(series.limit(0), 1.0, 2.0).first()["holds"]


def test_ambiguous_keys_are_not_compared(make):
    ours = make([observation(3, "x-1", "2022-03-07", 70.0), observation(3, "x-2", "2022-03-07", 71.0), observation(6, "y-1", "2022-03-07", 20.0), observation(9, "z-1", "2022-03-07", 1.0)])
    theirs = make([observation(3, "x-1", "2022-03-07", 70.0), observation(6, "y-1", "2022-03-07", 25.0), observation(9, "z-1", "2022-03-07", None)])
    row = crosscheck.summary(ours, theirs).first()
    assert (row["our_rows"], row["our_unique_keys"], row["our_ambiguous_keys"], row["companyfacts_unique_keys"]) == (4, 2, 1, 3)
    assert (row["matched_observations"], row["n_conflicts"], row["conflict_rel_median"]) == (2, 1, 0.2)
    empty = crosscheck.summary(ours.limit(0), theirs.limit(0)).first()
    assert (empty["our_rows"], empty["matched_observations"], empty["value_agreement"]) == (0, 0, 0.0)


def test_windows_and_dates():
    c = Config(quarters=quarters_between("2009q2", "2026q2"))
    assert len(c.quarters) == 69 and c.window_end == dt.date(2026, 6, 30) and c.left_cutoff == dt.date(2009, 7, 1)
    assert len(c.as_of_dates) == 24 and c.as_of_dates[0] == dt.date(2009, 12, 31) and c.as_of_dates[-1] == dt.date(2026, 3, 31) and len(c.truncation_points) == 5
    assert Config.of("2025q1,2025q2").as_of_dates == (dt.date(2025, 3, 31),)
    with pytest.raises(ValueError):
        Config.of("2025q5")


def test_download_skips_retries_and_records(tmp_path):
    config = Config.of("2022q2,2022q3", tmp_path, max_retries=3)
    calls, naps = [], []

    def get(url, _):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("once")
        return [b"zi", b"p"]

    manifest = download(config, get=get, sleep=naps.append)
    assert len(calls) == 3 and {(m["status"], m["bytes"]) for m in manifest.values()} == {("ok", 3)} and naps[0] == 1
    assert download(config, get=get, sleep=naps.append) == manifest and len(calls) == 3
    assert (config.raw_dir / "2022q3.zip").read_bytes() == b"zip" and not list(config.raw_dir.glob("*.part"))


def test_a_download_that_never_comes_raises_and_is_noted(tmp_path):
    def get(url, _):
        yield b"half"
        raise OSError("gone")

    config = Config.of("2022q2", tmp_path, max_retries=2)
    with pytest.raises(DownloadError, match="2022q2"):
        download(config, get=get, sleep=lambda _: None)
    assert read_manifest(config)["2022q2"]["status"] == "failed" and not (config.raw_dir / "2022q2.zip").exists()


def test_arrivals(spark, tmp_path):
    rows = [observation(71, "n-1", "2022-02-18", 640.0), observation(71, "n-2", "2022-03-04", 655.0)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], OBSERVATIONS).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals.append(arrivals.stream(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
        assert [r["value"] for r in arrivals.latest_of(spark, str(tmp_path / "table")).collect()] == [row[13]]
