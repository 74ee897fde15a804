"""Readers, writers, quality gates and streams on temporary files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import labels as L
from tidepanel.operators import quality as Q
from tidepanel.operators import stateful as U
from tidepanel import schema
from tidepanel.sources import bar_files, files, sinks
from tidepanel.streaming import bars as S
from tidepanel.sources import tables as src

HEADER = "-Ticker\tDate Time\tOpen\tHigh\tLow\tLast\tVolume\tOpen Interest"


def bar_line(ticker, stamp, last=100.5):
    return f"{ticker}\t{stamp}\t100\t101\t99\t{last}\t10\t1"


def codes(spark, folder):
    raw = files.with_lines(files.read_delimited(spark, str(folder), "\t"))
    issues = Q.issues_from_profile(Q.profile_bar_files(raw))
    return {(r.source_file, r.code) for r in issues.collect()}


def test_issue_codes(spark, tmp_path):
    good = [bar_line("ESU6", f"2026-01-{d:02d} 00:00:00", 100 + d / 50) for d in range(1, 32)]
    (tmp_path / "ESU6_Export.csv").write_text("\n".join([HEADER, *good]))
    bad = [HEADER, bar_line("NQU6", "2026-01-01 00:01:00"), bar_line("NQU6", "2026-01-01 00:00:00"),
           bar_line("NQU6", "2026-01-01 00:00:00"), HEADER, bar_line("NQU6", "oops")]
    (tmp_path / "CLU6_Export.csv").write_text("\n".join(bad))
    found = codes(spark, tmp_path)
    assert {c for f, c in found if f.startswith("CL")} == {
        "embedded_headers", "filename_symbol_mismatch", "invalid_timestamps", "out_of_order",
        "exact_duplicate_rows", "duplicate_symbol_timestamp", "constant_price_series", "short_history",
    }
    assert not {c for f, c in found if f.startswith("ES")} - {"short_history"}


def test_order_check_across_blocks(spark):
    times = [1, 2, 3, 2, 5, 6, 4, 8]
    names = HEADER.split("\t")
    rows = [("f.txt", i, *bar_line("F", f"2024-01-01 00:0{t}:00", 100 + i).split("\t")) for i, t in enumerate(times)]
    rows.insert(4, ("f.txt", 100, *names))
    df = spark.createDataFrame(rows, ["source_file", "line", *names])
    for block in (1, 3, 1000):
        got = Q.profile_bar_files(df, block_rows=block).first()
        assert (got.out_of_order, got.embedded_headers, got.duplicate_symbol_timestamp, got.exact_duplicate_rows) == (2, 1, 1, 0)


def test_both_layouts_become_canonical_bars(spark, tmp_path):
    comma = "Date,Time,Open,High,Low,Close,Volume"
    days = [f"2026-0{1 + d // 28}-{1 + d % 28:02d}" for d in range(40)]
    (tmp_path / "ES_continuous.csv").write_text("\n".join(
        [comma] + [f"{d},00:00:00,100,101,99,{100 + i % 2},5" for i, d in enumerate(days)]) + "\n")
    swapped = "Volume\tDate Time\t-Ticker\tOpen\tHigh\tLow\tLast"
    (tmp_path / "CLU6_Export.txt").write_text("\r\n".join(
        [swapped] + [f"7\t{d} 10:00:00\t clu6\t100\t101\t99\t{100 + i % 2}" for i, d in enumerate(days)]) + "\r\n")
    faults = {
        "NQU6_zone.txt": [bar_line("NQU6", f"{days[0]}T10:00:00+01:00"), bar_line("NQU6", f"{days[39]} 10:00:00", 101)],
        "NQU6_gap.txt": [bar_line("NQU6", "2026-03-08 02:30:00"), bar_line("NQU6", "2026-05-08 02:30:00", 101)],
        "NQU6_fold.txt": [bar_line("NQU6", "2025-11-02 01:30:00"), bar_line("NQU6", "2026-05-08 02:30:00", 101)],
        "NQU6_forms.txt": [bar_line("NQU6", "2026-01-08 02:30:00"), bar_line("NQU6", "2026-01-08T02:30", 100.7)],
        "NQU6_name.txt": [bar_line("ESU6", "2026-01-08 02:30:00"), bar_line("ESU6", "2026-05-08 02:30", 100.7)],
        "NQU6_only_header.txt": [],
    }
    for name, lines in faults.items():
        (tmp_path / name).write_text("\n".join([HEADER, *lines]) + "\n")
    (tmp_path / "x.txt").write_text("a,b\n1,2\n")
    bars, report = bar_files.normalize(spark, str(tmp_path), 2026, fingerprints=files.fingerprint(spark, str(tmp_path)))
    status = {r.source_file: r.status for r in report.collect()}
    assert status == {
        "ES_continuous.csv": "normalized", "CLU6_Export.txt": "normalized", "NQU6_zone.txt": "rejected", "NQU6_gap.txt": "rejected",
        "NQU6_fold.txt": "rejected", "NQU6_forms.txt": "rejected", "NQU6_name.txt": "quarantined", "NQU6_only_header.txt": "rejected",
        "x.txt": "blocked"}
    rows = bars.orderBy("symbol", "timestamp_utc").collect()
    assert bars.columns == list(schema.CANONICAL_COLUMNS) and len(rows) == 80
    first = {r.symbol: r for r in reversed(rows)}
    assert first["ES"].timestamp_utc == dt.datetime(2026, 1, 1) and first["ES"].root_symbol == "ES"
    assert first["CLU6"].timestamp_utc == dt.datetime(2026, 1, 1, 15) and first["CLU6"].contract_year == 2026
    assert all(len(r.source_sha256) == 64 and r.open_interest is None for r in rows)


def test_profile_reads_its_rows_once_and_sends_only_times_and_hashes(spark):
    raw = spark.createDataFrame([("f.txt", 1, *bar_line("F", "2024-01-01 00:01:00").split("\t"))], ["source_file", "line", *HEADER.split("\t")])
    frame = Q.profile_bar_files(raw)
    frame.collect()
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "-Ticker" not in plan and plan.count("RepartitionByExpression") == 1


def test_layouts_and_fingerprints(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time,Open,High,Low,Close,Volume\n2026-01-01,00:00,1,1,1,1,1\n")
    (tmp_path / "b.txt").write_text(HEADER + "\n")
    (tmp_path / "c.tsv").write_text("x\ty\n")
    kinds = {r.source_file: r.layout for r in files.headers(spark, str(tmp_path)).collect()}
    assert kinds == {"a.csv": "bar_comma", "b.txt": "bar_tab", "c.tsv": "unknown"}
    assert files.fingerprint(spark, str(tmp_path), "*.csv").count() == 1
    assert files.list_files(spark, str(tmp_path)).count() == 3


def test_canonical_bars(spark, tmp_path):
    lines = [HEADER.replace("\tOpen Interest", "\tOpen Interest"), "esu6\t2026-01-02 10:00:00\t1\t2\t1\t2\t5\t0"]
    (tmp_path / "ESU6.csv").write_text("\n".join(lines))
    raw = files.read_delimited(spark, str(tmp_path), "\t")
    row = files.canonical_bars(raw, files.fingerprint(spark, str(tmp_path)), "America/New_York", 2026).first()
    assert (row.symbol, row.root_symbol, row.contract_year, row.open_interest) == ("ESU6", "ES", 2026, None)
    assert row.timestamp_utc == dt.datetime(2026, 1, 2, 15) and len(row.source_sha256) == 64


def test_ledger_totals_are_enforced(spark, tmp_path):
    head = "Ticket;Symbol;Type;Open time;Open price;Size;Close time;Close price;Profit/Loss;Close type"
    line = "1;ES;Buy;2025.01.02 10:00:00;1;1;2025.01.02 11:00:00;2;12.5;TP"
    (tmp_path / "strategy_ES.csv").write_text(f"{head}\n{line}\n")
    df = files.read_ledger(spark, str(tmp_path), expected_trades=1, expected_pnl=12.5)
    assert df.first().strategy == "ES"
    with pytest.raises(ValueError, match="expected 2"):
        files.read_ledger(spark, str(tmp_path), expected_trades=2)


def test_position_reports(spark, tmp_path):
    head = ("CFTC_Contract_Market_Code,Report_Date_as_YYYY-MM-DD,Open_Interest_All,Prod_Merc_Positions_Long_All,"
            "Prod_Merc_Positions_Short_All,M_Money_Positions_Long_All,M_Money_Positions_Short_All")
    (tmp_path / "r.csv").write_text(f"{head}\n 067651 ,2024-01-02,100,10,30,40,15\n999999,2024-01-02,1,1,1,1,1\n")
    rows = files.read_position_reports(spark, str(tmp_path), {"CL": "067651"}).collect()
    assert len(rows) == 1 and rows[0].hedging_pressure == pytest.approx(0.2)
    assert rows[0].release_date == dt.date(2024, 1, 5)
    assert rows[0].managed_money_net_share == pytest.approx(0.25)


def test_split_sink_hides_the_holdout(spark, tmp_path):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=30 * i), float(i)) for i in range(40)]
    df = L.holdout_split(spark.createDataFrame(rows, "symbol string, trading_date date, x double"))
    sinks.write_split(df, str(tmp_path / "t"))
    development = files.read_split(spark, str(tmp_path / "t"))
    with pytest.raises(PermissionError):
        files.read_split(spark, str(tmp_path / "t"), "holdout")
    held = files.read_split(spark, str(tmp_path / "t"), "holdout", unseal=True)
    last = development.agg(F.max("trading_date")).first()[0]
    assert last < held.agg(F.min("trading_date")).first()[0]


def test_versions_appear_whole(spark, tmp_path):
    root = str(tmp_path / "v")
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    with pytest.raises(Exception):
        sinks.read_swapped(spark, root, "t")
    sinks.write_swapped({"t": one, "u": two}, root)
    assert sinks.read_swapped(spark, root, "t").count() == 3 and sinks.read_swapped(spark, root, "u").count() == 5
    broken = two.withColumn("x", F.raise_error(F.lit("dead")).cast("long"))
    with pytest.raises(Exception, match="dead"):
        sinks.write_swapped({"t": two, "u": broken}, root)
    assert sinks.read_swapped(spark, root, "t").count() == 3  # the version before stays
    sinks.write_swapped({"t": two}, root)
    assert sinks.read_swapped(spark, root, "t").count() == 5


def test_symbol_partitions_are_replaced(spark, tmp_path):
    root = str(tmp_path / "p")
    schema = "symbol string, trading_date date, x double"
    day = dt.date(2024, 1, 1)
    sinks.write_by_symbol(spark.createDataFrame([("A", day, 1.0), ("B", day, 2.0)], schema), root)
    sinks.write_by_symbol(spark.createDataFrame([("A", day, 3.0)], schema), root, keep_other_symbols=True)
    assert {(r.symbol, r.x) for r in files.read_partitioned(spark, root).collect()} == {("A", 3.0), ("B", 2.0)}
    sinks.write_by_symbol(spark.createDataFrame([("A", day, 4.0)], schema), root)
    assert {r.symbol for r in files.read_partitioned(spark, root).collect()} == {"A"}


@pytest.mark.parametrize("order", ["asc", "desc", "hash"])
def test_streams_fold_rows_of_any_order_as_the_batch_does(spark, order):
    day = dt.date(2024, 1, 1)
    rows = [(s, day, dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m), 900 + m, ((m * 37 + k * 11) % 29 - 14) / 14, 100.0 + (m * 13 + k) % 17,
             95.0 + (m * 7 + k) % 11) for k, s in enumerate("AB") for m in range(40) if (m + k) % 9]
    df = spark.createDataFrame(rows, "symbol string, trading_date date, timestamp_utc timestamp, session_minute int, score double, high double, low double")
    by = {"asc": F.col("timestamp_utc"), "desc": F.desc("timestamp_utc"), "hash": F.xxhash64("timestamp_utc", "symbol")}[order]
    at = F.unix_millis("timestamp_utc").alias("at_ms")
    with S.timer_store(spark):
        stream, lateness = S.replay(spark, df, "timestamp_utc", by, 4, "alerts-in")
        got = S.run_available(S.live_alerts(stream, lateness=lateness), "alerts").where("symbol is not null")
        want = U.hysteresis(df, "score").select("symbol", "trading_date", at, "position_signal")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("position_signal <> 0").count() > 5
        if order == "hash":
            stream, lateness = S.replay(spark, df, "timestamp_utc", by, 4, "sar-in")
            got = S.run_available(S.live_sar(stream, lateness=lateness), "sar").where("symbol is not null")
            want = U.parabolic_sar(df, "sar", "symbol", "timestamp_utc", 0.02, 0.2).select("symbol", at, "sar")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped_and_state_is_given_up(spark, tmp_path):
    schema = "symbol string, trading_date date, timestamp_utc timestamp, session_minute int, score double"
    day = dt.date(2024, 1, 1)
    for part in ([(0, 0.6), (20, 0.4)], [(25, 0.5)], [(3, -0.9), (60 * 48, 0.7)], [(60 * 48 + 30, 0.0)]):
        spark.createDataFrame([("A", day, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), m % 600, s) for m, s in part], schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    with S.timer_store(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = S.run_available(S.live_alerts(stream, lateness="10 minutes"), "late").orderBy("at_ms").collect()
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert [((r.at_ms - start) // 60_000, r.position_signal) for r in out] == [(0, 1.0), (20, 1.0), (25, 1.0), (2880, 1.0)]


@pytest.mark.parametrize("layout", ["file", "directory", "shuffled"])
def test_streaming_bars_keep_every_print(spark, tmp_path, layout):
    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    folder = source
    if layout != "file":
        folder = str(tmp_path)
        order = F.xxhash64("event_id") if layout == "shuffled" else F.col("ts")
        events.repartitionByRange(6, order).write.parquet(f"{folder}/events.parquet")
    stream = S.event_stream(spark, folder)
    if layout == "shuffled":
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events.parquet")
    for width, seconds in (("1 hour", 3600), ("4 hours", 14_400)):
        got = S.run_backfill(S.live_bars(stream, width), "bars", "symbol", "timestamp_utc").collect()
        start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds
        priced = events.withColumn("price", src.tick_price(src.tick_count(F.col("value"))))
        want = priced.groupBy("event_type", start.alias("start")).agg(
            F.min(F.struct("ts", "price"))["price"].alias("open"), F.max(F.struct("ts", "price"))["price"].alias("close"),
            F.count("*").alias("n")).collect()
        assert sum(r.prints for r in got) == events.count()
        assert {(r.symbol, r.timestamp_utc.timestamp(), r.open, r.close, r.prints) for r in got} == {
            (r.event_type, float(r.start), r.open, r.close, r.n) for r in want}


def test_packed_key_refuses_what_does_not_fit(spark):
    row = spark.range(1).select(src.print_key(F.lit((1 << 42) - 1), F.lit(5)).alias("k"))
    assert row.first().k > 0
    with pytest.raises(Exception, match="packed key"):
        spark.range(1).select(src.print_key(F.col("id") + (1 << 42), F.lit(5)).alias("k")).collect()


def test_minute_table_from_events_is_unique(spark):
    minutes = src.minute_bars(spark, "/root/testdata/sf0.001")
    assert minutes.count() == minutes.select("symbol", "timestamp_utc").distinct().count()
