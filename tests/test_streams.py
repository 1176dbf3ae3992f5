"""Streams and files."""

import gzip
import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest

from tidemark.operators import bars as batch
from tidemark.sources import archive, files
from tidemark.sources.replayed import TickSource
from tidemark.streaming import ahead, bars, live, paper


def drained(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    t = spark.createDataFrame([("G", i * 20, i, 2000.0 + (i * 7) % 11) for i in range(60)], "symbol string, epoch_s long, seq long, price double")
    t.selectExpr("symbol", "timestamp_seconds(epoch_s) AS ts", "seq", "price").write.parquet(str(tmp_path / "t"))
    s = spark.readStream.schema("symbol string, ts timestamp, seq long, price double").parquet(str(tmp_path / "t"))
    drained(bars.bars(s), "complete", "streamed_bars")
    assert sorted(map(tuple, spark.table("streamed_bars").collect())) == sorted(map(tuple, batch.aggregate(t, 60).collect()))


def test_a_slot():
    def run(ticks):
        s = paper.Slot("G", paper.Rules())
        s.signal(1000, "LONG", 8, 2500.0, 2.0)
        return s, [x for t, bid in ticks for x in s.tick(1000 + t, bid, round(bid + 0.25, 2))]

    s, out = run([(15, 2500.1), (45, 2499.7), (60, 2500.5), (90, 2502.0)])
    (row,) = out
    assert (row["state"], row["result"], row["entry_price"], row["r_multiple"], row["entry_time"]) == ("CLOSED", "TP1", 2499.95, 1.0, 1045)
    assert run([(15, 2500.1), (121, 2500.2)])[1][0]["state"] == "TIMED_OUT"
    assert run([(15, 2498.4)])[1][0]["state"] == "INVALIDATED"
    s, _ = run([])
    assert s.signal(1000, "LONG", 8, 2500.0, 2.0) == []  # seen before
    assert s.signal(1060, "SHORT", 8, 2500.0, 2.0)[0]["state"] == "CONCURRENCY_BLOCKED"
    assert s.signal(1120, "LONG", 6, 2500.0, 2.0) == []


T0 = 1_704_067_200


def stamp(t):
    return pd.Timestamp(T0 + t, unit="s", tz="UTC").to_pydatetime()


def journalled(spark, folder, rows, per_file, rules, stop_after=None):
    """The journal of rows that come in files of per_file, with a restart after some of them."""
    files_ = [rows[i : i + per_file] for i in range(0, len(rows), per_file)]
    cuts = [files_] if stop_after is None else [files_[:stop_after], files_[stop_after:]]
    for part in cuts:
        for f in part:
            spark.createDataFrame(f, paper.INPUT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(paper.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = files.append_journal(paper.journal(s, rules, "5 minutes"), f"{folder}/out", f"{folder}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(paper.JOURNAL).json(f"{folder}/out").collect())


class States:
    """Stands for the handle and the states of one key."""

    def __init__(self):
        self.maps, self.values, self.timers, self.most = {}, {}, [], 0

    def getMapState(self, name, *schemas):  # noqa: N802
        held = self.maps.setdefault(name, {})
        return SimpleNamespace(keys=lambda: iter(list(held)), containsKey=held.__contains__, getValue=held.get, updateValue=held.__setitem__, removeKey=held.pop)

    def getValueState(self, name, schema):  # noqa: N802
        held = self.values.setdefault(name, {})
        return SimpleNamespace(exists=lambda: "x" in held, get=lambda: held["x"], update=lambda x: held.update(x=x), clear=held.clear)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def of_watermark(t):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: t * 1000)


def test_a_trader_keeps_ids_only_until_they_cannot_come_again():
    n, trader, states = 3000, paper.PaperTrader(paper.Rules(wait_s=50, hold_s=100)), States()
    trader.init(states)
    rows = [("G", pd.Timestamp(t, unit="s"), "signal", t, None, None, "LONG", 8, 2500.0, 2.0) for t in range(1, n) for _ in (1, 2)]
    frames = [pd.DataFrame(rows[i::7], columns=[x.split()[0] for x in paper.INPUT.split(", ")]) for i in range(7)]
    assert list(trader.handleInputRows(("G",), iter(frames), of_watermark(0))) == []
    assert states.timers == [1000] and not states.maps["seen"]
    got = [x for f in trader.handleExpiredTimer(("G",), of_watermark(n - 10), None) for x in f.itertuples()]
    assert len(got) == n - 11  # each of the due once: blocked, or given up with time
    assert set(states.maps["seen"]) == {(n - 10, "LONG")}
    assert states.timers[-1] == (n - 9) * 1000
    got = [x for f in trader.handleInputRows(("G",), iter([frames[0].tail(1)]), of_watermark(n)) for x in f.itertuples()]
    assert len(got) == 9 and not states.maps["ahead"]


def test_live_indicators_take_what_waits_in_pieces(monkeypatch):
    monkeypatch.setattr(ahead, "RUN", 64)
    monkeypatch.setattr(ahead, "PIECE", 16)
    held, merged = [], ahead.Ahead._sorted
    monkeypatch.setattr(ahead.Ahead, "_sorted", lambda self, tables: held.append(sum(map(len, tables))) or merged(self, tables))
    rows = [("G", pd.Timestamp(1 + i // 3, unit="s"), i, float(i % 50)) for i in range(3000)]
    rows = [*rows[::2], *rows[1::2]]
    p, states = live.LiveIndicators(60, live.Throttle(0, 0)), States()
    p.init(states)
    frames = (pd.DataFrame(rows[i : i + 10], columns=["symbol", "ts", "seq", "price"]) for i in range(0, 3000, 10))
    assert list(p.handleInputRows(("G",), frames, of_watermark(0))) == [] and max(map(len, states.maps["ahead"].values())) == 1
    frames = list(p.handleExpiredTimer(("G",), of_watermark(900), None))
    assert max(map(len, frames)) <= 16 and max(held) < 300  # before, all 2,700 at once
    assert [(r.at, r.price) for f in frames for r in f.itertuples()] == [(1 + i // 3, float(i % 50)) for i in range(2700)]
    frames = list(p.handleExpiredTimer(("G",), of_watermark(2000), None))
    assert [r.at for f in frames for r in f.itertuples()] == [1 + i // 3 for i in range(2700, 3000)] and not states.maps["ahead"]


def by_a_loop(rows, rules, upto):
    """The rules said anew, over all rows in order."""
    out = []
    for symbol in sorted({r[0] for r in rows}):
        slot = paper.Slot(symbol, rules)
        mine = sorted((r for r in rows if r[0] == symbol and r[1] <= stamp(upto)), key=lambda r: (r[1], r[2] != "tick", r[3]))
        for _, ts, kind, _, bid, ask, d, k, p, atr in mine:
            t = int(ts.timestamp())
            out += slot.until(t)
            out += slot.tick(t, bid, ask) if kind == "tick" else slot.signal(t, d, k, p, atr)
        out += slot.until(T0 + upto + 1)
    return sorted(tuple(x.values()) for x in out)


def test_journal_does_not_depend_on_batches_or_restarts(spark, tmp_path):
    rng = random.Random(8)
    rules, rows = paper.Rules(wait_s=300, hold_s=1500), []
    for symbol in ("G", "H"):
        price = 2500.0
        for i in range(220):
            price = round(price + rng.uniform(-0.8, 0.8), 2)
            t = i * 40 + rng.randrange(20)
            rows.append((symbol, stamp(t), "tick", i, price, round(price + 0.2, 2), None, None, None, None))
            if i % 9 == 0:
                rows.append((symbol, stamp(t), "signal", i, None, None, rng.choice(["LONG", "SHORT"]), rng.choice([6, 8]), price, rng.choice([None, 2.0])))
    rows.append(("H", stamp(12_000), "tick", 999, 2500.0, 2500.2, None, None, None, None))
    rng.shuffle(rows[-40:])
    rows.sort(key=lambda r: (r[1], rng.random()))
    for i in range(0, len(rows) - 4, 4):  # rows come somewhat out of order
        rows[i], rows[i + 3] = rows[i + 3], rows[i]
    want = by_a_loop(rows, rules, 12_000 - 300)
    assert len(want) > 20 and {r[3] for r in want} >= {"CLOSED", "TIMED_OUT", "CONCURRENCY_BLOCKED"}
    assert "EXPIRED" in {r[7] for r in want}
    assert journalled(spark, str(tmp_path / "a"), rows, 500, rules) == want
    assert journalled(spark, str(tmp_path / "b"), rows, 150, rules, stop_after=2) == want


def test_throttle():
    assert bars.changed({}, 1, 0, False)
    assert not bars.changed({"at": 0, "price": 1.0}, 1.2, 1.0, False)
    assert bars.changed({"at": 0, "price": 1.0}, 1.2, 2.0, False)


def test_archives_and_reports(spark, tmp_path):
    rows = [{"time": 60 * i, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "tick_volume": 3} for i in range(5)]
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump(rows, f)
    b = files.read_archive(spark, str(tmp_path / "a.json.gz"), "G")
    assert b.count() == 5 and b.first().spread is None
    files.write_bars(b, str(tmp_path / "p"))
    assert files.read_bars(spark, str(tmp_path / "p")).where("symbol = 'G' AND month = '1970-01'").count() == 5
    files.write_report(b.limit(1), str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().spread == "N/A"
    with pytest.raises(Exception):  # noqa: B017
        files.read_archive(spark, str(tmp_path / "none.json"), "G").count()


def test_chunked_reads(spark):
    ranges = files.chunks(0, 10 * 86400, 4)
    assert ranges[0][2] == 10 * 86400 and ranges[-1][1] == 0 and all(a[1] + 3600 == b[2] for a, b in zip(ranges, ranges[1:], strict=False))

    def fetch(lo, hi):
        t = list(range(lo - lo % 3600, hi, 3600)) if lo > 0 else []
        return pd.DataFrame({"epoch_s": t, "open": float(lo), "high": float(lo), "low": float(lo), "close": float(lo), "tick_volume": 1})

    rows, manifest = files.read_chunked(spark, ranges, fetch, "G")
    assert rows.count() == rows.select("epoch_s").distinct().count()
    assert {r.chunk: r.status for r in manifest.collect()}[len(ranges) - 1] == "EMPTY"


def test_synthetic_bars_do_not_depend_on_partitions(spark):
    a = files.synthetic_bars(spark, ["A", "B"], 50)
    assert a.count() == 100 and a.where("high < greatest(open, close) OR low > least(open, close)").count() == 0
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(7).collect()))


def test_live_indicators_with_late_ticks_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows, price = [], 2000.0
    for i in range(900):
        price = round(price + rng.uniform(-1, 1), 2)
        rows.append(("G", stamp(i * 7 + 2000), i, price))
    rows.append(("G", stamp(20_000), 999, 2000.0))
    late = [*rows[:400], *sorted(rows[400:800], key=lambda r: (r[2] // 20, -r[2])), *rows[800:]]  # up to 140 seconds out of order
    schema = "symbol string, ts timestamp, seq long, price double"
    for part in (late[:450], late[450:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        w = live.analyses(s, 60, live.Throttle(1e12, 1e12)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        w.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(live.ANALYSIS).parquet(str(tmp_path / "out")).orderBy("at").collect()
    bars_ = {}
    for _, ts, _, p in rows[:-1]:
        bars_.setdefault(int(ts.timestamp()) // 60 * 60, []).append(p)
    sums, want = {"n": 0} | dict.fromkeys(("close", "ema9", "ema21", "ema50", "up", "down", "tr"), 0.0), []
    closes = []
    for t in sorted(bars_):
        want.append((t, closes[:]))
        closes.append(bars_[t][-1])
        sums = live.closed(sums, max(bars_[t]), min(bars_[t]), closes[-1])
    assert [r.at // 60 * 60 for r in got] == [t for t, _ in want]
    for r, (_, c) in zip(got, want, strict=True):
        e = sum(c[:21]) / 21 if len(c) >= 21 else None
        for x in c[21:]:
            e = x * 2 / 22 + e * 20 / 22
        assert (r.ema21 is None) == (e is None) and (e is None or abs(r.ema21 - e) < 1e-3)


def test_state_of_an_earlier_run_is_taken_up(spark, tmp_path):
    rows = [("G", stamp(t), "tick", t, bid, bid + 0.2, None, None, None, None) for t, bid in ((10, 2500.0), (20, 2502.5), (900, 2500.0))]
    spark.createDataFrame(rows, paper.INPUT).coalesce(1).write.parquet(str(tmp_path / "in"))
    names = ["time", "direction", "atr", "sign", "target", "floor", "entry", "entry_time", "dist", "stop", "one", "two", "mfe", "mae"]
    open_trade = spark.createDataFrame([("G", T0 - 60, "LONG", 2.0, 1, 2499.7, 2498.5, 2500.0, T0 - 30, 2.0, 2498.0, 2502.0, 2504.0, 0.0, 0.0)], "symbol string, " + ", ".join(f"{n} {'string' if n == 'direction' else 'long' if 'time' in n else 'int' if n == 'sign' else 'double'}" for n in names))
    s = spark.readStream.schema(paper.INPUT).parquet(str(tmp_path / "in"))
    q = files.append_journal(paper.journal(s, initial=open_trade), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    (row,) = spark.read.schema(paper.JOURNAL).json(str(tmp_path / "out")).collect()
    assert (row.result, row.r_multiple, row.at) == ("TP1", 1.0, T0 + 20)


def test_tick_source_resumes_where_it_stopped(spark, small, tmp_path):
    spark.dataSource.register(TickSource)
    for end in (T0 + 3 * 86400, T0 + 9 * 86400):
        t = spark.readStream.format("ticks").options(path=f"{small}/events.parquet", start=T0, end=end, days=1).load()
        q = t.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = spark.read.parquet(f"{small}/events.parquet").where(f"unix_timestamp(ts) >= {T0} AND unix_timestamp(ts) < {T0 + 9 * 86400}")
    assert len(got) > 0 and sorted(got) == sorted(r.event_id for r in want.collect())


def test_an_archive_keeps_what_a_broken_load_does_not_finish(spark, tmp_path):
    at = str(tmp_path / "a")
    day = 86400
    bars_of = lambda days, close: spark.createDataFrame([("G", T0 + d * day, 1.0, 9.0, 0.5, close, 5) for d in days], archive.BARS)
    assert archive.manifest(spark, at).count() == 0 and archive.read(spark, at).count() == 0
    archive.commit(bars_of(range(0, 60, 5), 1.0), at, "one")
    first = {r.month: r.commit for r in archive.manifest(spark, at).collect()}
    archive.commit(bars_of([35, 36], 2.0), at, "two")
    second = {r.month: r.commit for r in archive.manifest(spark, at).collect()}
    assert first["2024-01"] == second["2024-01"] and first["2024-02"] != second["2024-02"]
    assert {r.epoch_s: r.close for r in archive.read(spark, at).where("close = 2").collect()} == {T0 + 35 * day: 2.0, T0 + 36 * day: 2.0}
    assert archive.read(spark, at).count() == 13
    before = sorted(map(tuple, archive.read(spark, at).collect()))
    # a load that wrote its bars, but no manifest
    bars_of([1, 2], 3.0).selectExpr("epoch_s", "open", "high", "low", "close", "tick_volume", "symbol", "'2024-01' AS month").write.partitionBy("symbol", "month").parquet(f"{at}/data/commit=broken")
    assert sorted(map(tuple, archive.read(spark, at).collect())) == before
    archive.commit(bars_of([], 0.0), at)
    assert sorted(map(tuple, archive.read(spark, at).collect())) == before


def test_an_archive_of_amounts_keeps_and_counts_those_of_nothing(spark, tmp_path):
    day = 86400
    source = spark.createDataFrame([("G", T0 + k * day, 1.0, 2.0, low, 1.0, 3, k) for k, low in enumerate((0.0, 0.5, 0.5, 0.0))], f"{archive.BARS}, seq long")
    for signed, kept in ((False, 2), (True, 4)):
        at = str(tmp_path / f"a{signed}")
        archive.commit(source.where("seq = 1"), at)
        r = archive.refresh(source, at, T0, T0 + 3 * day, slack=0, signed=signed).first()
        assert (r.total, r.invalid, r.kept, r.bars) == (kept, 0, kept, kept)
    # bars that were committed as they are
    archive.commit(source.where("seq = 0"), str(tmp_path / "b"))
    r = archive.refresh(source.limit(0), str(tmp_path / "b"), T0, T0 + 3 * day, signed=True).first()
    assert (r.total, r.invalid, r.bars) == (1, 0, 1)
