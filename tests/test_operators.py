"""Operators on small hand-written fixtures: quirks and properties."""

import datetime as dt
import math
import os
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexframe.operators import channels, clean, compare, laps, media, timebase, track
from apexframe.plans import boards, convert
from apexframe.sources import logs, tracks

LINE = (0.0, -5.0, 0.0, 5.0)


def samples(spark, rows, session="s"):
    return spark.createDataFrame([(session, i, float(t), float(x), float(y)) for i, (t, x, y) in enumerate(rows)], "session_id string, seq long, t double, x double, y double")


def values_of(df, column, *order):
    return [r[column] for r in df.orderBy(*order).collect()]


def circuit(spark, n=4, hz=20, lap_s=40.0):
    rows = []
    for i in range(int(n * lap_s * hz) + 10):
        a = 2 * math.pi * (i / hz) / lap_s - math.pi / 4
        rows.append((i / hz, 100 * math.sin(a), 100 * math.cos(a) - 100))
    return samples(spark, rows)


def test_both_detectors_find_the_laps_of_a_circuit(spark):
    s = circuit(spark)
    a = values_of(laps.crossings_by_segment(s, LINE), "t_cross", "k")
    b = values_of(laps.crossings_by_sign(s, LINE, 20.0, 30.0), "t_cross", "k")
    assert a == pytest.approx([5, 45, 85, 125], abs=1e-3) and b == pytest.approx(a, abs=1e-3)
    lapped = laps.assign_laps(s, laps.crossings_by_segment(s, LINE), mark_end=True)
    assert sorted(r[0] for r in lapped.select("lap").distinct().collect()) == [-1, 0, 1, 2, 3]
    durations = laps.lap_durations(s, laps.crossings_by_segment(s, LINE))
    done = durations.where("completed").agg(F.sum("duration")).first()[0]
    assert done == pytest.approx(a[-1] - a[0])
    assert laps.best_laps(durations).first()["duration"] == pytest.approx(40, abs=1e-3)


def test_a_sample_on_the_line_counts_once(spark):
    s = samples(spark, [(0, -1, 0), (1, 0, 0), (2, 1, 0)])
    assert values_of(laps.crossings_by_segment(s, LINE), "t_cross", "k") == [1.0]


def test_row_order_does_not_matter(spark):
    s = circuit(spark, 2)
    shuffled = s.orderBy(F.xxhash64("seq"))
    one = laps.assign_laps(s, laps.crossings_by_segment(s, LINE)).select("seq", "lap").orderBy("seq").collect()
    assert one == laps.assign_laps(shuffled, laps.crossings_by_segment(shuffled, LINE)).select("seq", "lap").orderBy("seq").collect()


def test_debounce_counts_from_the_last_kept(spark):
    c = spark.createDataFrame([("s", float(t)) for t in (0, 20, 35, 50, 66)], "session_id string, t_cross double")
    assert values_of(laps.debounce(c, 30.0), "t_cross", "k") == [0.0, 35.0, 66.0]


def test_no_crossings_still_give_tables(spark):
    s = samples(spark, [(0, 5, 0), (1, 6, 0)])
    c = laps.crossings_by_segment(s, LINE)
    assert c.count() == 0 and values_of(laps.assign_laps(s, c), "lap", "seq") == [0, 0]
    assert laps.lap_durations(s, c).count() == 1
    assert laps.best_laps(laps.lap_durations(s, c)).count() == 0


def test_resampling_on_own_times_is_identity(spark):
    s = samples(spark, [(i * 0.5, i * i, 0) for i in range(9)])
    out = timebase.resample(s, ["x"], 2.0)
    assert values_of(out, "x", "frame") == [float(i * i) for i in range(8)]


def test_resampling_clamps_and_keeps_the_first_of_equal_times(spark):
    s = samples(spark, [(0, 1, 0), (0, 9, 0), (1, 3, 0)])
    out = timebase.resample(s, ["x"], 2.0, duration=2.0, time_shift=-0.5)
    assert values_of(out, "t", "frame") == [0.0, 0.0, 0.5, 1.0] and values_of(out, "x", "frame") == [1.0, 1.0, 2.0, 3.0]


def test_distance_uses_the_median_for_bad_steps(spark):
    s = samples(spark, [(0, 36, 0), (1, 36, 0), (1, 36, 0), (2, 36, 0)])
    assert values_of(timebase.add_distance(s, "x"), "distance", "seq") == pytest.approx([10, 20, 30, 40])
    assert timebase.infer_frequency(s).first()["freq_hz"] == 1.0
    assert timebase.infer_frequency(samples(spark, [(0, 0, 0)])).first()["freq_hz"] == 10.0


def test_fills(spark):
    rows = spark.createDataFrame([("s", i, float(i), v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "session_id string, seq long, t double, v double")
    out = rows.withColumns({"f": timebase.forward_fill(F.col("v")), "b": timebase.backward_fill(F.col("v"))})
    assert values_of(out, "f", "seq") == [None, 1.0, 1.0, 3.0, 3.0] and values_of(out, "b", "seq") == [1.0, 1.0, 3.0, 3.0, None]
    assert values_of(timebase.interpolate(rows, ["v"]), "v", "seq") == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_stitching_follows_first_appearance(spark):
    rows = spark.createDataFrame([("s", i, lap, t) for i, (lap, t) in enumerate([(2, 1.0), (2, 5.0), (1, 2.0), (None, 3.0), (2, None)])], "session_id string, seq long, lap int, t double")
    assert values_of(timebase.stitch_laps(rows), "t", "seq") == [1.0, 5.0, 7.0, 8.0]


def test_projection_and_nearest_segment(spark):
    points = spark.createDataFrame([("t", i, float(x), float(y), i // 2) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (10, 10)])], "track_id string, pt_idx int, x double, y double, segment int")
    s = spark.createDataFrame([("s", 0, "t", 4.0, 3.0), ("s", 1, "t", 20.0, 5.0), ("s", 2, "t", 10.0, 30.0)], "session_id string, seq long, track_id string, x double, y double")
    out = track.project(s, track.track_pieces(points), ["session_id", "seq"])
    assert values_of(out, "along", "seq") == [4.0, 15.0, 20.0] and values_of(out, "off", "seq") == [3.0, 10.0, 20.0]
    assert track.track_length(points).first()["length"] == 20.0
    assert values_of(track.nearest_segment(s, points, ["session_id", "seq"]), "segment", "seq") == [0, 0, 1]


def test_turns_and_straights_of_an_oval(spark):
    pts = [(float(i), 0.0) for i in range(80)]
    pts += [(79 + 20 * math.sin(a), 20 - 20 * math.cos(a)) for a in (math.pi * i / 40 for i in range(1, 41))]
    pts += [(79.0 - i, 40.0) for i in range(1, 80)]
    points = spark.createDataFrame([("t", i, x, y) for i, (x, y) in enumerate(pts)], "track_id string, pt_idx int, x double, y double")
    segs = track.segments(track.turns_and_straights(points)).orderBy("segment").collect()
    assert [s["kind"] for s in segs] == ["straight", "turn", "straight"] and sum(s["points"] for s in segs) == len(pts)
    assert [s["label"] for s in segs] == ["S1", "T2", "S3"]


def test_quadratic_fit_recovers_coefficients(spark):
    rows = spark.createDataFrame([("g", float(x), 3 + 2.0 * x - 0.5 * x * x) for x in range(1000, 1050)], "g string, x double, y double")
    fit = compare.quadratic_fit(rows, "x", "y", ["g"]).first()
    assert (fit["a"], fit["b"], fit["c"], fit["r2"]) == pytest.approx((-0.5, 2.0, 3.0, 1.0), rel=1e-5)
    flat = compare.quadratic_fit(rows.where("x < 1002"), "x", "y", ["g"]).first()
    assert flat["a"] is None


def test_channel_names_and_suffixes(spark):
    raw = spark.createDataFrame([("s", 0, i, c, "1") for i, c in enumerate(["T1", "speed gps", "T2", "Odd"])], "session_id string, seq long, col_idx int, channel string, value string")
    out = channels.normalise_long(raw, channels.alias_table(spark)).orderBy("col_idx").collect()
    assert [(r["name"], r["unit"]) for r in out] == [("Temperature", "°C"), ("GPS Speed", "km/h"), ("Temperature_2", "°C"), ("Odd", "")]
    assert channels.list_channels(channels.alias_table(spark)).count() == len(channels.CHANNELS)
    wide = spark.createDataFrame([(1, 2, 3)], "`T1` int, `Lat.` int, `T2` int")
    names = [(a.lower(), n) for n, _, al in channels.CHANNELS for a in al]
    assert channels.rename_columns(wide, names).columns == ["Temperature", "GPS Latitude", "Temperature_2"]


def test_cleaning(spark):
    rows = spark.createDataFrame([("s", 1, "sec", None, "km"), ("s", 2, "0.1", None, "5"), ("s", 3, "0.2", None, "6")], "session_id string, seq long, a string, b string, c string")
    out = clean.drop_empty(clean.strip_units_row(rows, "a"), ("session_id", "seq"))
    assert out.columns == ["session_id", "seq", "a", "c"] and out.count() == 2
    line = spark.createDataFrame([("t", 0, 1.0, 2.0), ("t", 1, 1.0, 2.0), ("t", 2, 3.0, 4.0), ("u", 0, 1.0, 1.0)], "track_id string, pt_idx int, x double, y double")
    assert [tuple(r) for r in clean.line_ends(line).collect()] == [("t", 1.0, 2.0, 3.0, 4.0)]


def test_clips_of_one_recording_and_a_misread_year(spark):
    rows = [("c", "a.mp4", "2025-04-01 10:00:00", 60.0), ("c", "b.mp4", "2025-04-01 10:01:01", 60.0), ("c", "c.mp4", "2015-04-01 10:02:01", 60.0), ("c", "d.mp4", "2025-04-01 12:00:00", 60.0), ("c", "e.mp4", None, 60.0)]
    clips = spark.createDataFrame(rows, "camera_id string, path string, ts string, duration double").withColumn("start_ts", F.col("ts").cast("timestamp_ntz"))
    out = media.group_clips(clips).orderBy("path").collect()
    assert [r["group_no"] for r in out] == [1, 1, 1, 2, 3]
    assert out[2]["start_ts"].year == 2025
    assert [r["group_name"] for r in out][2:] == ["2025-04-01_10-00-00.mp4", "2025-04-01_12-00-00.mp4", "unknown_e.mp4"]


def test_clock_tick_ignores_jumps(spark):
    frames = spark.createDataFrame([("c", i, float(s)) for i, s in enumerate([10, 10, 50, 10, 11, 12])], "clip_id string, frame long, clock_s double")
    row = media.clock_ticks(frames, 2.0).first()
    assert (row["frame"], row["clock_s"], row["video_start_s"]) == (4, 11.0, 9.0)


def test_vote_takes_the_common_date_and_upper_median(spark):
    frames = spark.createDataFrame([("c", 0.0, "08/11/2025 10:00:00"), ("c", 1.0, "08/11/2025 10:00:05"), ("c", 2.0, "09/11/2025 10:00:02"), ("c", 3.0, "junk")], "clip_id string, frame_offset double, text string")
    assert str(media.vote_text(frames).first()["ts"]) == "2025-11-08 10:00:04"


def test_beacon_files_agree_with_their_stated_laps(spark, tmp_path):
    def beacons(name, times, laps_, fastest, lap):
        marks = "".join(f'<Marker ClassName="BCN" Name="Auto GPS {i + 1}" Time="{t * 1e6:.8e}"/>' for i, t in enumerate(times))
        details = f'<String Id="Total Laps" Value="{laps_}"/><String Id="Fastest Time" Value="{fastest}"/><String Id="Fastest Lap" Value="{lap}"/>'
        (tmp_path / name).write_text(f"<File><Layers><Layer><MarkerBlock><MarkerGroup>{marks}</MarkerGroup></MarkerBlock></Layer><Details>{details}</Details></Layers></File>")

    beacons("a.ldx", [50.0, 112.5, 173.2499, 235.0], 5, "1:00.749", 2)
    beacons("b.ldx", [10.0, 70.0, 131.0], 4, "1:00.000", 1)
    beacons("c.ldx", [10.0, 70.0, 129.0], 4, "1:00.000", 1)  # misstated
    report = {r["path"][-5:]: r for r in boards.beacon_report(*logs.read_beacons(spark, f"{tmp_path}/*.ldx")).collect()}
    assert [report[k]["agrees"] for k in ("a.ldx", "b.ldx", "c.ldx")] == [True, True, False]
    assert (report["a.ldx"]["total_laps"], report["a.ldx"]["fastest_lap"]) == (5, 2)


def test_lap_log_and_summary(spark, tmp_path):
    folder = tmp_path / "X_301025_17H02_Nik_VEN"
    folder.mkdir()
    (folder / "SN1.csv").write_text("30-10-2025,17:02,2\n" + ",".join(f"c{i}" for i in range(27)) + "\n1,62610,62610,0,0,0,0,0,7664,13648,544,1008" + ",0" * 15 + "\n2,61200,61200,0,0,0,0,0,7585,13764,534,1015" + ",0" * 15 + "\n")
    summary = logs.read_lap_summary(spark, f"{folder}/SN*.csv").orderBy("lap").collect()
    assert [(r["lap"], r["time_s"], r["min_speed"], r["max_speed"], r["max_rpm"]) for r in summary] == [(1, 62.61, 54.4, 100.8, 13648.0), (2, 61.2, 53.4, 101.5, 13764.0)]
    (folder / "LAP_1_x.csv").write_text("Partiel,RPM,Speed GPS,T1,T2,Gf. X,Lat.\n" + "".join(f"1,{5000 + i},360,1,2,{990 + i},41565833\n" for i in range(21)))
    rows = convert.convert_lap_logs(spark, f"{folder}/LAP_*.csv", channels.alias_table(spark), [r[1:] for r in channels.TRANSFORMS])
    last = rows.orderBy(F.desc("t")).first()
    assert rows.count() == 21 and last["t"] == pytest.approx(2.0) and last["distance"] == pytest.approx(21.0)  # 36 km/h: scaled first
    assert last["gps_latitude"] == pytest.approx(41.565833) and last["extra"]["temperature_2"] == 2.0
    assert rows.agg(F.avg("gps_accel_lat")).first()[0] == pytest.approx(0, abs=1e-9)


def whole_lines(files):
    """Lines of text files by number, as a reader of whole files has them (without what follows the last line feed if empty)."""
    return {(f.name, i): line for f in files for i, line in enumerate(f.read_bytes().decode().replace("\r", "").removesuffix("\n").split("\n")) if f.stat().st_size}


def test_line_numbers_of_splittable_logs(spark, tmp_path):
    rng = random.Random(3)
    texts = {
        "a.csv": "".join(f"{i}," + "x" * rng.randrange(90) + rng.choice(["\n", "\r\n"]) for i in range(4000)), "b.csv": "one\n\n\ntwo", "c.csv": "", "d.csv": "\n",
        "e.csv": "short\n" + "long " * 9000 + "\nlast\n", "f.csv": "\u00e9" * 700 + "\n" + "\n" * 3000 + "end",
    }
    files = []
    for name, text in texts.items():
        files.append(tmp_path / "s" / name)
        files[-1].parent.mkdir(exist_ok=True)
        files[-1].write_bytes(text.encode())
    settings = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "16"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lines = logs.numbered_lines(spark, str(tmp_path / "s"))
        assert spark.read.text(str(tmp_path / "s" / "a.csv"), lineSep="\n").rdd.getNumPartitions() > 20
        got = lines.collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert {(r["path"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in got} == whole_lines(files)
    assert len(got) == len(whole_lines(files)) and {r["session_id"] for r in got} == {"s"}


def test_layouts_read_alike_however_files_are_split(spark, tmp_path):
    rows = "".join(f'"{i / 20}","{30 + i % 40}","{i % 7}"\n' for i in range(3000))
    for k, head in enumerate(['"Format","x"\n"Racer","A, B"\n"Time","2:05 PM"\n\n', '"Racer","C"\n', "\n"]):
        (tmp_path / f"s{k}").mkdir()
        (tmp_path / f"s{k}" / "aim.csv").write_text(head + '"Time","GPS Speed","T1"\n"s","km/h","C"\n' + rows)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "Excel_1.csv").write_text("Time;Lap;Speed GPS: km/h;UTC time : 170203\n" + "".join(f"{t};1;36;\n" for t in range(3000)))
    (tmp_path / "x" / "LAP_1_q.csv").write_text("Partiel,RPM,Speed GPS\n" + "".join(f"1,{t},360\n" for t in range(3000)))

    def read():
        long, meta = logs.read_aim(spark, f"{tmp_path}/s*/aim.csv")
        export, clocks = logs.read_excel_export(spark, f"{tmp_path}/x/Excel_*.csv")
        return [sorted(map(tuple, df.collect()), key=str) for df in (long, meta, export, clocks, logs.read_lap_logs(spark, f"{tmp_path}/x/LAP_*.csv"))]

    whole = read()
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "16"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert read() == whole
    finally:
        for k in settings:
            spark.conf.unset(k)
    long, meta, export, _, laps_ = whole
    assert len(long) == 3 * 3000 * 3 and {r[0]: r[1] for r in meta} == {"s0": {"Racer": "A, B", "Time": "2:05 PM"}, "s1": {"Racer": "C"}}
    assert len(export) == 3000 * 3 and len(laps_) == 3000
    assert min(r[1] for r in long) == 2  # seq counts from the header; the units row is 1


def test_reruns_convert_only_what_changed(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")

    def lap_log(session, n, speed):
        (root / session).mkdir(parents=True, exist_ok=True)
        (root / session / "LAP_1_x.csv").write_text("Partiel,RPM,Speed GPS\n" + f"1,5000,{speed}\n" * n)

    def aim(session, n):
        (root / session).mkdir(parents=True, exist_ok=True)
        (root / session / "aim.csv").write_text('"Racer","R"\n\n"Time","GPS Speed"\n"s","km/h"\n' + "".join(f'"{i / 10}","36"\n' for i in range(n)))

    rows = lambda df: Counter((r["session_id"], r["seq"], r["t"], r["gps_speed"], r["device"]) for r in df.collect())
    names = lambda df: sorted(r["session_id"] for r in df.collect())
    read, numbered = [], logs.numbered_lines
    monkeypatch.setattr(logs, "numbered_lines", lambda spark, paths: read.append(paths) or numbered(spark, paths))
    assert convert.read_converted(spark, out).count() == 0
    lap_log("a [1] b+c d", 5, 360)
    lap_log("two", 4, 720)
    aim("three", 6)
    assert names(convert.convert_changed(spark, str(root), out)) == ["a [1] b+c d", "three", "two"]
    first = rows(convert.read_converted(spark, out))
    assert first == rows(convert.convert_all(spark, str(root))) and sum(first.values()) == 15
    read.clear()
    assert names(convert.convert_changed(spark, str(root), out)) == [] and read == []
    lap_log("two", 7, 720)
    aim("four", 3)
    (root / "three" / "aim.csv").unlink()

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(convert, "canonical", die)
        with pytest.raises(RuntimeError):
            convert.convert_changed(spark, str(root), out)
    assert rows(convert.read_converted(spark, out)) == first
    assert names(convert.convert_changed(spark, str(root), out)) == ["four", "two"]
    assert {p.rsplit("/", 2)[1] for paths in read for p in paths} == {"two", "four"}
    assert rows(convert.read_converted(spark, out)) == rows(convert.convert_all(spark, str(root)))
    more = channels.alias_table(spark).union(spark.createDataFrame([("nonesuch", "None Such", "")], channels.alias_table(spark).schema))
    assert names(convert.convert_changed(spark, str(root), out, aliases=more)) == ["a [1] b+c d", "four", "two"]


def test_conversion_of_all_layouts(spark, tmp_path):
    aim = tmp_path / "2025-11-08-mychron5-Rim-Rotax-Ivan-01"
    aim.mkdir()
    (aim / "aim.csv").write_text('"Format","x"\n"Racer","Ivan, P"\n"Date","Saturday, November 8, 2025"\n"Time","2:05 PM"\n\n"Time","GPS Speed","T1","T2","Odd"\n"s","km/h","C","C",""\n' + "".join(f'"{i / 10}","36","1","2","{i}"\n' for i in range(20)))
    excel = tmp_path / "X-Nik-RUS"
    excel.mkdir()
    (excel / "Excel_1.csv").write_text("Time;Lap;Speed GPS: km/h;UTC time : 170203;Empty\n" + "".join(f"{t};{lap};36;;\n" for lap in (1, 2) for t in (0, 1, 2)))
    for n, speed in ((10, 720), (2, 360)):
        lap = tmp_path / "ALFANO_301025_17H02_N_V"
        lap.mkdir(exist_ok=True)
        (lap / f"LAP_{n}_x.csv").write_text("Partiel,RPM,Speed GPS\n" + f"1,5000,{speed}\n" * 5)
    kinds = {r["session_id"]: r["device"] for r in logs.classify_sessions(logs.list_files(spark, str(tmp_path))).collect()}
    assert sorted(kinds.values()) == ["aim", "alfano", "alfano_excel"]
    out = convert.convert_all(spark, str(tmp_path))
    rows = {r["device"]: r for r in out.groupBy("device").agg(F.count("*").alias("n"), F.max("t").alias("t"), F.max("distance").alias("d"), F.max("temperature").alias("t1")).collect()}
    assert (rows["aim"]["n"], rows["aim"]["t"], rows["aim"]["t1"]) == (20, 1.9, 1.0) and rows["aim"]["d"] == pytest.approx(20)
    assert (rows["alfano_excel"]["n"], rows["alfano_excel"]["t"]) == (6, 4.0)
    first = out.where("device = 'alfano'").orderBy("t").first()
    assert rows["alfano"]["n"] == 10 and first["gps_speed"] == 36.0  # lap 2 before lap 10, scaled before use
    assert out.where("device = 'aim'").select(F.col("extra")["odd"]).agg(F.max("extra[odd]")).first()[0] == 19.0
    _, meta = logs.read_aim(spark, f"{tmp_path}/*/aim.csv")
    told = logs.session_metadata(meta.selectExpr("session_id", "'aim' AS device", "meta", "'aim.csv' AS file_name", "'' AS utc_clock")).first()
    assert (told["driver"], told["venue"], told["event_date"], told["event_time"]) == ("Ivan, P", "mychron5", "2025-11-08", "14:05")
    convert.write_csv(out, str(tmp_path / "out"))
    convert.write_csv(out.where("device = 'aim'"), str(tmp_path / "out"))
    assert len([p for p in os.listdir(tmp_path / "out") if p.startswith("session_id=")]) == 3
    convert.write_fixed_rate(out, spark.createDataFrame([(k, "d") for k in kinds], "session_id string, driver string"), 10.0, str(tmp_path / "rate"), ["gps_speed"])
    assert spark.read.parquet(str(tmp_path / "rate")).where("driver = 'd'").count() > 20


def test_conversion_takes_one_layout_a_folder_and_each_file_its_header(spark, tmp_path):
    both, lap = tmp_path / "BOTH-1", tmp_path / "LAPS_1"
    for folder in (both, lap, lap / "old"):
        folder.mkdir()
    (both / "aim.csv").write_text('"Format","x"\n\n"Time","GPS Speed","Logger Temperature"\n' + "".join(f'"{i / 10}","36","7"\n' for i in range(20)))
    (both / "LAP_1_x.csv").write_text("Partiel,RPM,Speed GPS\n" + "1,5000,360\n" * 5)
    (lap / "LAP_1_x.csv").write_text("Partiel,RPM,Speed GPS\n" + "1,5000,360\n" * 4)
    (lap / "LAP_2_x.csv").write_text("Speed GPS,Odd,Partiel,RPM\n" + "720,,2,6000\n" * 3)
    (lap / "old" / "LAP_3_x.csv").write_text("Partiel,RPM,Speed GPS\n1,1,1\n")
    out = convert.convert_all(spark, str(tmp_path))
    rows = [(r["session_id"], r["device"], r["n"]) for r in out.groupBy("session_id", "device").agg(F.count("*").alias("n")).orderBy("session_id").collect()]
    assert rows == [("BOTH-1", "aim", 20), ("LAPS_1", "alfano", 7)]
    told = [(r["rpm"], r["gps_speed"], r["lap_number"]) for r in out.where("device = 'alfano'").orderBy("t").collect()]
    assert told == [(5000.0, 36.0, 1.0)] * 4 + [(6000.0, 72.0, 2.0)] * 3
    assert out.where("device = 'aim' AND temperature = 7").count() == 20
    fixed = convert.at_fixed_rates(out, ["gps_speed"]).groupBy("session_id").agg(F.count("*").alias("n"), F.max("hz").alias("hz"), F.max("t").alias("t"))
    assert {(r["session_id"], r["hz"]) for r in fixed.collect()} == {("BOTH-1", 20.0), ("LAPS_1", 10.0)} and fixed.where("session_id = 'BOTH-1'").first()["n"] == 38
    (tmp_path / "none").mkdir()
    empty = convert.convert_all(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and set(out.columns) == set(empty.columns)


def test_samples_without_a_place_stay(spark):
    samples = spark.createDataFrame([("s", 1, "t", 1.0, 1.0), ("s", 2, "t", None, 1.0), ("s", 3, None, 1.0, 1.0), ("s", 4, "other", 1.0, 1.0)], "session_id string, seq long, track_id string, x double, y double")
    points = spark.createDataFrame([("t", i, float(i), 0.0, i) for i in range(3)], "track_id string, pt_idx long, x double, y double, segment int")
    near = {r["seq"]: r["segment"] for r in track.nearest_segment(samples, points, ["session_id", "seq"]).collect()}
    assert near == {1: 1, 2: None, 3: None, 4: None}
    off = {r["seq"]: r["off"] for r in track.project(samples, track.track_pieces(points), ["session_id", "seq"]).collect()}
    assert off == {1: 1.0, 2: None, 3: None, 4: None}


def test_media_catalogue(spark):
    files = spark.createDataFrame([("/a/B.MP4", 1), ("/a/c.txt", 1), ("/a/a.mov", 2), ("/a/a.mov", 2)], "path string, length long")
    assert [r["path"] for r in logs.media_files(files).collect()] == ["/a/B.MP4", "/a/a.mov"]
    probe = spark.createDataFrame([("p", '{"streams": [{"codec_type": "video", "width": 1920, "height": 1080, "r_frame_rate": "30000/1001"}], "format": {"duration": "12.5"}}'), ("q", "{}")], "path string, json string")
    out = logs.media_properties(probe).orderBy("path").collect()
    assert out[0]["fps"] == pytest.approx(29.97, abs=0.01) and out[0]["duration"] == 12.5 and (out[1]["fps"], out[1]["duration"]) == (30.0, 0.0)


def test_track_geometry_in_metres(spark):
    wkt = spark.createDataFrame([("t", "centerline", "EPSG:3857", "MULTILINESTRING((0 0, 10 0),(10 0, 10 5))"), ("t", "start-finish-line", None, "LINESTRING(44.9 41.5, 44.95 41.5)")], "track_id string, layer string, crs string, wkt string")
    pts = tracks.to_mercator(tracks.parse_linestrings(wkt))
    assert pts.where("layer = 'centerline'").agg(F.max("x")).first()[0] == 10.0
    assert tracks.start_finish(pts).agg(F.min("x")).first()[0] > 4.9e6


def test_frames_beside_a_crossing_and_odd_samples(spark):
    """Lap times restart at the line itself; the first of equal times counts; gaps in position and value are bridged."""
    from apexframe.plans import frames

    rows = [(1, i, None if t is None else float(t), x, 0.0, v) for i, (t, x, v) in enumerate([
        (0, -5.0, 1.0), (10, 5.0, 3.0), (10, 7.0, 99.0), (20, None, None), (30, -5.0, 7.0), (30, None, None), (70, -5.0, 7.0), (80, 5.0, 9.0), (None, 1.0, 1.0)])]
    rows += [(2, 0, 5.0, 1.0, 1.0, 4.0), (3, 0, None, 1.0, 1.0, 4.0)]
    s = spark.createDataFrame(rows, "session_id long, seq long, t double, x double, y double, gps_speed double")
    s = timebase.add_distance(s, "gps_speed")
    got = {(r["session_id"], r["frame"]): r for r in frames.session_frames(s, (0.0, -9.0, 0.0, 9.0), 0.2, ["gps_speed"]).collect()}
    one = [got[1, i] for i in range(16)]
    assert len(got) == 17 and [r["t"] for r in one] == [5.0 * i for i in range(16)]
    # crossings at 5 (10 s between x -5 and 5), at 10 + 20 * 7 / 12 and at 75
    back = 10 + 20 * 7 / 12
    assert [r["lap"] for r in one] == [0 if t < 5 else 1 if t < back else 2 if t < 75 else 3 for t in range(0, 80, 5)]
    assert [r["lap_time"] for r in one] == pytest.approx([t if t < 5 else t - 5 if t < back else t - back if t < 75 else t - 75 for t in range(0, 80, 5)])
    assert [r["gps_speed"] for r in one[:7]] == pytest.approx([1, 2, 3, 4, 5, 6, 7])
    assert all(r["min_gps_speed"] == 1 and r["max_gps_speed"] == 99 for r in one)
    assert (got[2, 0]["lap"], got[2, 0]["t"], got[2, 0]["gps_speed"], got[2, 0]["delta"]) == (0, 5.0, 4.0, None)
    assert frames.session_frames(s.limit(0), (0.0, -9.0, 0.0, 9.0), 0.2, ["gps_speed"]).count() == 0


def brute_nearest(p, pieces):
    best = None
    for k, (x0, y0, dx, dy) in enumerate(pieces):
        n = dx * dx + dy * dy
        u = min(1.0, max(0.0, ((p[0] - x0) * dx + (p[1] - y0) * dy) / n)) if n else 0.0
        d = math.hypot(x0 + u * dx - p[0], y0 + u * dy - p[1])
        best = min(best or (d, k), (d, k))
    return best[0]


@pytest.mark.parametrize("shape", ["circle", "zigzag", "points", "line"])
def test_grid_finds_the_nearest_piece(spark, monkeypatch, shape):
    rng, n = random.Random(shape), 400
    if shape == "circle":
        pts = [(500 + 300 * math.cos(i / 50), 3 * math.sin(i / 50)) for i in range(n)]
    elif shape == "line":
        pts = [(float(i * i), 7.0) for i in range(n)]
    else:
        pts = [(rng.uniform(-5, 5), rng.uniform(-100, 100)) for _ in range(n)]
    monkeypatch.setattr(track, "DIRECT_PIECES", 10)
    points = spark.createDataFrame([("a", i, x, y, i % 7) for i, (x, y) in enumerate(pts)] + [("b", 0, 1.0, 1.0, 3), ("b", 1, 1.0, 1.0, 2)], "track_id string, pt_idx long, x double, y double, segment long")
    where = [(rng.uniform(-900, 900), rng.uniform(-300, 300)) for _ in range(40)] + [pts[5], pts[-1], (500.0, 0.0)]
    rows = [(1, i, "a", x, y) for i, (x, y) in enumerate(where)] + [(2, 0, "b", 4.0, 5.0), (3, 0, "none", 0.0, 0.0), (3, 1, "a", None, 1.0), (3, 2, None, 1.0, 1.0)]
    samples = spark.createDataFrame(rows, "session_id long, seq long, track_id string, x double, y double")
    if shape == "points":
        got = {(r["session_id"], r["seq"]): r["segment"] for r in track.nearest_segment(samples, points, ["session_id", "seq"]).collect()}
        assert got[2, 0] == 2 and got[3, 0] is None and got[3, 1] is None and got[3, 2] is None
        assert [got[1, i] for i in range(len(where))] == [min((math.hypot(x - p[0], y - p[1]), i % 7) for i, (x, y) in enumerate(pts))[1] for p in where]
        return
    pieces = [(a[0], a[1], b[0] - a[0], b[1] - a[1]) for a, b in zip(pts, pts[1:])]
    placed = track.project(samples, track.track_pieces(points), ["session_id", "seq"])
    got = {(r["session_id"], r["seq"]): r["off"] for r in placed.collect()}
    assert got[2, 0] == pytest.approx(5.0) and got[3, 0] is None and got[3, 1] is None
    assert [got[1, i] for i in range(len(where))] == pytest.approx([brute_nearest(p, pieces) for p in where], abs=1e-9)
    assert "NestedLoop" not in placed._jdf.queryExecution().executedPlan().toString()


def test_a_track_of_100_000_pieces(spark):
    """Samples a known way beside a spiral of 100,000 pieces; pairs that meet are few."""
    at = lambda i: (F.lit(1.0) + i / 10_000) * 100
    angle = F.col("id") / 500
    points = spark.range(100_001).select(F.lit("s").alias("track_id"), F.col("id").alias("pt_idx"), (at(F.col("id")) * F.cos(angle)).alias("x"), (at(F.col("id")) * F.sin(angle)).alias("y"))
    samples = points.where("pt_idx % 500 = 250").select(F.lit(1).alias("session_id"), F.col("pt_idx").alias("seq"), "track_id", (F.col("x") * 1.001).alias("x"), (F.col("y") * 1.001).alias("y"), F.hypot("x", "y").alias("r"))
    out = track.project(samples, track.track_pieces(points), ["session_id", "seq"]).collect()
    assert len(out) == 200 and all(abs(r["off"] - r["r"] * 0.001) < 2e-3 for r in out)


def plain_groups(clips, tolerance=2.0):
    """(group, start, end) by the rule, clip by clip."""
    out, end, no = [], None, 0
    for start, stop, duration in clips:
        joined = False
        if start is not None and end is not None:
            if abs((start - end).total_seconds()) < tolerance:
                joined = True
            else:
                try:
                    moved = start.replace(year=end.year)
                    if abs((moved - end).total_seconds()) < tolerance:
                        joined, start = True, moved
                        try:
                            stop = stop and stop.replace(year=end.year)
                        except ValueError:
                            pass
                except ValueError:
                    pass
        no += not joined
        out.append((no, start, stop))
        end = None if start is None else start + dt.timedelta(seconds=duration)
    return out


def test_clip_groups_over_new_year_leap_days_and_misread_years(spark):
    at = dt.datetime
    cameras = {
        "new_year": [(at(2024, 12, 31, 23, 59), None, 60.0), (at(2025, 1, 1), None, 30.0), (at(2025, 1, 1, 0, 0, 30), None, 5.0)],
        "misread": [(at(2025, 5, 1, 10), None, 60.0), (at(2026, 5, 1, 10, 1), at(2026, 5, 1, 10, 2), 60.0), (at(2035, 5, 1, 10, 2), None, 60.0), (at(2025, 5, 1, 10, 3), None, 60.0)],
        "leap": [(at(2025, 2, 28, 23, 59), None, 60.0), (at(2024, 2, 29), None, 60.0), (at(2024, 2, 29, 0, 1), None, 60.0), (at(2023, 3, 1, 0, 0, 59), None, 9.0)],
        "edge": [(at(2025, 1, 1), None, 10.0), (at(2025, 1, 1, 0, 0, 12), None, 10.0), (at(2025, 1, 1, 0, 0, 23, 999999), None, 10.0), (None, None, 5.0), (at(2025, 1, 1, 0, 0, 34), None, 1.0)],
        "year_end": [(at(2024, 12, 31, 23, 59, 59), None, 0.5), (at(2031, 1, 1), None, 4.0)],
    }
    rng = random.Random(4)
    for k in range(6):
        t, rows = at(2024, 12, 31, 22), []
        for _ in range(30):
            d = rng.choice([30.0, 600.0, 3600.0])
            start = t + dt.timedelta(seconds=rng.choice([0, 1, 1.9, 2, 5000]))
            year = start.year + rng.choice([0, 0, 0, 1, 7])
            rows.append((start.replace(year=year), None, d))
            t = start + dt.timedelta(seconds=d)
        cameras[f"random{k}"] = rows
    rows = [(c, f"{i:03}.mp4", s, e, d) for c, clips in cameras.items() for i, (s, e, d) in enumerate(clips)]
    df = spark.createDataFrame(rows, "camera_id string, path string, start_ts timestamp_ntz, end_ts timestamp_ntz, duration double")
    got = {(r["camera_id"], r["path"]): (r["group_no"], r["start_ts"], r["end_ts"]) for r in media.group_clips(df).collect()}
    for c, clips in cameras.items():
        assert [got[c, f"{i:03}.mp4"] for i in range(len(clips))] == plain_groups(clips), c


def plain_alignment(a, b, tolerance):
    """Least cost by the recurrence over all prefixes."""
    cost = [[(i + j) * tolerance if not i or not j else None for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            off = abs(a[i - 1] - b[j - 1])
            cost[i][j] = min([cost[i - 1][j] + tolerance, cost[i][j - 1] + tolerance, *([cost[i - 1][j - 1] + off] if off <= tolerance else [])])
    return cost[-1][-1]


def test_lap_lists_side_by_side(spark):
    rng = random.Random(8)
    lists = {0: ([60.1, 55.2, 58.3, 57.0], [60.1, 58.31, 57.0]), 1: ([61.0], []), 2: ([], [62.0, 63.0]), 3: ([50.0, 51.0], [50.0, 49.0, 51.0]), 4: ([60.0, 60.0], [60.0, 60.0])}
    for k in range(5, 17):
        a = [round(rng.uniform(50, 54), 2) for _ in range(rng.randrange(1, 9))]
        b = [x + rng.choice([0, 0, 0.01, -0.3]) for x in a if rng.random() > 0.2]
        lists[k] = a, b + ([rng.uniform(50, 54)] if rng.random() > 0.5 else [])
    frame = lambda side: spark.createDataFrame([(k, i + 1, x) for k, v in lists.items() for i, x in enumerate(v[side])] + [(99, 1, None)], "session_id long, lap int, duration double")
    lined, report = boards.session_report(frame(0).withColumn("completed", F.lit(True)), frame(1))
    rows = {}
    for r in lined.collect():
        rows.setdefault(r["session_id"], []).append(r)
    assert set(rows) == set(lists)
    for k, (a, b) in lists.items():
        assert sorted(r["lap"] for r in rows[k] if r["lap"]) == list(range(1, len(a) + 1)) and sorted(r["stated_lap"] for r in rows[k] if r["stated_lap"]) == list(range(1, len(b) + 1))
        pairs = sorted((r["lap"], r["stated_lap"]) for r in rows[k] if r["status"] == "match")
        assert pairs == sorted(pairs, key=lambda p: p[1]) and all(abs(a[i - 1] - b[j - 1]) <= 1 for i, j in pairs)
        assert sum(abs(r["diff"]) if r["status"] == "match" else 1.0 for r in rows[k]) == pytest.approx(plain_alignment(a, b, 1.0))
    told = {r["session_id"]: r for r in report.collect()}
    assert (told[0]["match"], told[0]["extra"], told[0]["missing"], told[0]["best_lap"], told[0]["agrees"]) == (3, 1, 0, 2, False)  # a dropped beacon
    assert (told[3]["missing"], told[3]["agrees"]) == (1, False) and told[4]["agrees"] and not told[1]["agrees"]


def test_polynomial_fit_of_orders_one_to_four_against_numpy(spark):
    rng = random.Random(5)
    rows = [(g, 15000 + rng.uniform(-800, 800), rng.gauss(0, 1)) for g in ("a", None) for _ in range(400)]
    rows = [(g, x, 3 + 2e-3 * x - 4e-7 * (x - 15000) ** 2 + 1e-9 * (x - 15000) ** 3 + e) for g, x, e in rows]
    junk = [("a", None, 1.0), ("a", 1.0, None), ("a", float("nan"), 1.0), ("a", 1.0, float("inf"))]
    df = spark.createDataFrame(rows + junk, "g string, x double, y double")
    for order in (1, 2, 3, 4):
        fits = {r["g"]: r for r in compare.polynomial_fit(df, "x", "y", ["g"], order).collect()}
        assert set(fits) == {"a", None}
        for g, fit in fits.items():
            x, y = (np.array(c) for c in zip(*((x, y) for k, x, y in rows if k == g), strict=True))
            u = (x - fit["centre"]) / fit["scale"]
            want = np.polynomial.polynomial.polyfit(u, y, order)
            assert fit["n"] == 400 and fit["scaled"] == pytest.approx(want, rel=1e-8, abs=1e-9)
            got = np.polynomial.polynomial.polyval(x, np.array(fit["coefs"]))
            assert got == pytest.approx(np.polynomial.polynomial.polyval(u, want), abs=1e-4)
            assert fit["r2"] == pytest.approx(1 - ((y - np.polynomial.polynomial.polyval(u, want)) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_polynomial_fit_without_a_solution_keys_or_rows(spark):
    df = spark.createDataFrame([("two", 1.0, 1.0), ("two", 2.0, 3.0), ("two", 2.0, 3.0), ("one", 5.0, 1.0), ("flat", 0.0, 2.0), ("flat", 1.0, 2.0)], "g string, x double, y double")
    line = {r["g"]: r for r in compare.polynomial_fit(df, "x", "y", ["g"], 1).collect()}
    assert line["two"]["coefs"] == pytest.approx([-1, 2]) and line["two"]["r2"] == pytest.approx(1)
    assert line["one"]["coefs"] is None and line["one"]["r2"] is None and line["one"]["n"] == 1
    assert line["flat"]["coefs"] == pytest.approx([2, 0]) and line["flat"]["r2"] is None
    assert {r["coefs"] for r in compare.polynomial_fit(df, "x", "y", ["g"], 2).collect()} == {None}
    whole = compare.polynomial_fit(df, "x", "y", [], 2)
    assert whole.columns == ["n", "coefs", "centre", "scale", "scaled", "r2"] and whole.first()["n"] == 6
    at = df.crossJoin(whole.select("coefs")).select(compare.polynomial_value(F.col("coefs"), F.col("x")).alias("v"))
    want = np.polynomial.polynomial.polyfit([1, 2, 2, 5, 0, 1], [1, 3, 3, 1, 2, 2], 2)
    assert sorted(r["v"] for r in at.collect()) == pytest.approx(sorted(np.polynomial.polynomial.polyval([1, 2, 2, 5, 0, 1], want)))
    assert compare.polynomial_fit(df.where("false"), "x", "y", ["g"], 3).count() == 0
    with pytest.raises(ValueError):
        compare.polynomial_fit(df, "x", "y", ["g"], 0)


def test_user_mapping_names_an_alias_once(spark, tmp_path):
    (tmp_path / "map.json").write_text('''{"standard_channels": {
        "a": {"standard_name": "Speed", "unit": "km/h", "aliases": ["V", "speed", null]}, "b": {"standard_name": "Pace", "aliases": ["SPEED", "speed"]}},
        "transformations": {"alfano": {"V": {"scale": 0.5, "auto_center": true}, "bad": 3}}}''')
    table = channels.alias_table(spark, str(tmp_path / "map.json"))
    assert {tuple(r) for r in table.collect()} == {("v", "Speed", "km/h"), ("speed", "Pace", "")}
    raw = spark.createDataFrame([("s", k, 0, "Speed", 1.0) for k in range(10)], "session_id string, seq long, col_idx int, channel string, value double")
    assert channels.normalise_long(raw, table).count() == 10
    assert [tuple(r) for r in channels.transform_table(spark, str(tmp_path / "map.json")).collect()] == [("alfano", "V", 0.5, 0.0, True)]


GEO, WEB = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]', 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984"]]'


def shapefile(folder, layer, records, prj=None, kind=3, index=True, order=None):
    """Writes .shp and .shx byte by byte; records are lists of parts of points, None a null shape."""
    folder.mkdir(parents=True, exist_ok=True)
    shp, shx = b"", {}
    for k in order or range(len(records)):
        parts = records[k]
        if parts is None:
            content = struct.pack("<i", 0)
        elif kind == 1:
            content = struct.pack("<i2d", 1, *parts)
        else:
            pts = [p for part in parts for p in part]
            starts = [sum(len(q) for q in parts[:i]) for i in range(len(parts))]
            content = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(pts)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
            if kind in (13, 23):
                content += struct.pack(f"<{2 + len(pts)}d", *[7.0] * (2 + len(pts)))
        shx[k] = struct.pack(">2i", (100 + len(shp)) // 2, len(content) // 2)
        shp += struct.pack(">2i", k + 1, len(content) // 2) + content
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    (folder / f"{layer}.shp").write_bytes(head(100 + len(shp)) + shp)
    if index:
        (folder / f"{layer}.shx").write_bytes(head(100 + 8 * len(shx)) + b"".join(shx[k] for k in range(len(records))))
    if prj:
        (folder / f"{layer}.prj").write_text(prj)


def test_shapefiles_give_the_parts_of_all_records(spark, tmp_path):
    lines = [[[(0, 0), (1, 0)], [(2, 2), (3, 3), (4, 5)]], None, [[(9, 9), (8, 8)], [], [(7, 7), (6, 6)]]]
    shapefile(tmp_path / "Rim" / "centerline", "centerline", lines, WEB)
    shapefile(tmp_path / "Rim" / "start-finish-line", "start-finish-line", [[[(44, 41), (44.5, 41)], [(1, 1), (2, 2)]], [[(3, 3), (4, 4)]]], GEO)
    shapefile(tmp_path / "Bare", "centerline", lines, kind=13, index=False)
    shapefile(tmp_path / "Rim" / "posts", "posts", [(1.0, 2.0)], GEO, kind=1)
    pts = tracks.read_track_points(spark, str(tmp_path), "shapefile")
    assert pts.columns == ["track_id", "layer", "part_id", "pt_idx", "x", "y", "crs"]
    flat = [part for shape in lines if shape for part in shape if part]
    for track_id, crs in (("Rim", "EPSG:3857"), ("Bare", None)):
        got = pts.where(F.col("track_id").eqNullSafe(track_id) & (F.col("layer") == "centerline")).orderBy("part_id", "pt_idx").collect()
        assert [(r["part_id"], r["pt_idx"], r["x"], r["y"], r["crs"]) for r in got] == [(i, j, *p, crs) for i, part in enumerate(flat) for j, p in enumerate(part)]
    assert pts.where("layer = 'posts'").count() == 0
    line = tracks.start_finish(tracks.to_mercator(pts)).orderBy("pt_idx").collect()
    assert [r["x"] for r in line] == pytest.approx([44 * 6378137 * math.pi / 180, 44.5 * 6378137 * math.pi / 180])
    one = tracks.read_track_points(spark, str(tmp_path / "Rim" / "centerline" / "centerline.shp"), "shapefile")
    assert one.count() == 9 and one.select("layer").distinct().count() == 1


def test_shapefiles_are_read_by_ranges_of_records(spark, tmp_path):
    many = [[[(k, j) for j in range(20)]] for k in range(500)]
    shapefile(tmp_path / "T", "centerline", many, GEO, order=[*range(1, 500, 2), *range(0, 500, 2)])
    tracks.read_track_points(spark, str(tmp_path), "shapefile")
    rows = spark.read.format("shapefile").option("pieceBytes", 20_000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 8
    assert {(r["record"], r["pt_idx"], r["x"], r["y"]) for r in rows.collect()} == {(k, j, float(k), float(j)) for k in range(500) for j in range(20)}


def test_shapefiles_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert tracks.read_track_points(spark, str(tmp_path / "none"), "shapefile").count() == 0
    shapefile(tmp_path / "utm", "centerline", [[[(0, 0), (1, 1)]]], 'PROJCS["WGS_1984_UTM_Zone_38N",GEOGCS["GCS_WGS_1984"]]')
    with pytest.raises(Exception, match="UTM_Zone_38N"):
        tracks.read_track_points(spark, str(tmp_path / "utm"), "shapefile").collect()
    shapefile(tmp_path / "cut", "centerline", [[[(0, 0), (1, 1)]]])
    whole = (tmp_path / "cut" / "centerline.shp").read_bytes()
    (tmp_path / "cut" / "centerline.shp").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="record 0 ends beyond the file"):
        tracks.read_track_points(spark, str(tmp_path / "cut"), "shapefile").collect()


def test_pieces_that_lie_on_each_other_are_one(spark, monkeypatch):
    """3 places of a track 200 times each are 3 pieces, which need no index; ties go to the lowest segment and piece."""
    monkeypatch.setattr(track, "_near", lambda *a: pytest.fail("600 copies of 3 points met an index"))
    points = spark.range(600).selectExpr("'t' track_id", "id pt_idx", "double(id % 3) x", "0.0D y", "500 - id % 300 segment")
    samples = spark.createDataFrame([(1, i, "t", x, 1.0) for i, x in enumerate((-5.0, 1.1, 1.1, 7.0))], "session_id long, seq long, track_id string, x double, y double")
    near = {r["seq"]: r["segment"] for r in track.nearest_segment(samples, points, ["session_id", "seq"]).collect()}
    want = {i: min(500 - k % 300 for k in range(600) if k % 3 == p) for i, p in enumerate((0, 1, 1, 2))}
    assert near == want
    along = {r["seq"]: r["along"] for r in track.project(samples, track.track_pieces(points), ["session_id", "seq"]).collect()}
    assert along == pytest.approx({0: 0.0, 1: 1.1, 2: 1.1, 3: 2.0})


def test_samples_far_from_a_track_meet_few_pieces(spark, monkeypatch):
    rng = random.Random(5)
    pts = [(900 + i % 100, rng.uniform(0, 50)) for i in range(3000)]
    points = spark.createDataFrame([("a", i, float(x), y) for i, (x, y) in enumerate(pts)], "track_id string, pt_idx long, x double, y double")
    where = [(rng.uniform(-3000, 6000), rng.uniform(-400, 400)) for _ in range(60)]
    samples = spark.createDataFrame([(1, i, "a", x, y) for i, (x, y) in enumerate(where)], "session_id long, seq long, track_id string, x double, y double")
    met, near = [], track._near
    monkeypatch.setattr(track, "_near", lambda *a: met.append(near(*a)) or met[-1])
    got = {r["seq"]: r["off"] for r in track.project(samples, track.track_pieces(points), ["session_id", "seq"]).collect()}
    best = [brute_distance(p, pts) for p in where]
    assert [got[i] for i in range(len(where))] == pytest.approx(best, abs=1e-9)
    rows, pieces, on = met[0]
    assert rows.join(pieces, on).count() < 60 * 300  # of 60 * 2,999


@pytest.mark.parametrize("direct", [10, 1000])
def test_large_tables_of_a_search_are_not_sent_through_the_driver(spark, monkeypatch, direct):
    """Kept tables beyond BROADCAST_ROWS are joined by merging, however small their files look to Spark."""
    monkeypatch.setattr(track, "DIRECT_PIECES", direct)
    monkeypatch.setattr(track, "BROADCAST_ROWS", 3)
    rng = random.Random(6)
    pts = [(rng.uniform(-5, 5), rng.uniform(-100, 100)) for _ in range(300)]
    points = spark.createDataFrame([("a", i, x, y, i % 7) for i, (x, y) in enumerate(pts)], "track_id string, pt_idx long, x double, y double, segment long")
    where = [(rng.uniform(-9, 9), rng.uniform(-150, 150)) for _ in range(40)]
    samples = spark.createDataFrame([(1, i, "a", x, y) for i, (x, y) in enumerate(where)], "session_id long, seq long, track_id string, x double, y double")
    kept, written = track.kept, []
    monkeypatch.setattr(track, "kept", lambda df, label: written.append(df) or kept(df, label))
    placed, near = track.project(samples, track.track_pieces(points), ["session_id", "seq"]), track.nearest_segment(samples, points, ["session_id", "seq"])
    off, segment = ({r["seq"]: r[c] for r in out.collect()} for out, c in ((placed, "off"), (near, "segment")))
    assert [off[i] for i in range(40)] == pytest.approx([brute_distance(p, pts) for p in where], abs=1e-9)
    assert [segment[i] for i in range(40)] == [min((math.hypot(x - p[0], y - p[1]), i % 7) for i, (x, y) in enumerate(pts))[1] for p in where]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (placed, near, *written)]
    assert "Broadcast" not in plans[0] + plans[1]
    sent = [x for p in plans for x in p.splitlines() if "BroadcastHashJoin" in x]
    assert all(re.search(r"BroadcastHashJoin \[track_id#\d+\], ", x) for x in sent)  # grids, a row a track


def brute_distance(p, pts):
    pieces = [(a[0], a[1], b[0] - a[0], b[1] - a[1]) for a, b in zip(pts, pts[1:])]
    return brute_nearest(p, pieces)


def test_resampled_frames_are_not_sorted(spark):
    """A session of ten hours at 10 frames a second: frames are made after the last exchange and sort."""
    samples = spark.createDataFrame([(1, 0, 0.0, 1.0, 7), (1, 1, 18000.0, None, None), (1, 2, 18000.0, 99.0, 9), (1, 3, 36000.0, 3.0, 8), (1, 4, None, 5.0, 5)], "session_id long, seq long, t double, x double, lap int")
    out = timebase.resample(samples, ["x"], 10.0, lap="lap")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Exchange" not in plan[: plan.index("Generate")] and "Sort" not in plan[: plan.index("Generate")]
    told = out.agg(F.count("*").alias("n"), F.count_distinct("frame").alias("d"), F.max(F.abs(F.col("x") - (1 + F.col("t") / 18000))).alias("off"), F.sum("lap").alias("lap")).first()
    assert (told["n"], told["d"], told["lap"]) == (360_000, 360_000, 7 * 360_000) and told["off"] < 1e-9


def test_resampled_frames_beyond_a_sessions_ends(spark):
    samples = spark.createDataFrame([(1, 0, 10.0, 1.0), (1, 1, 20.0, 3.0), (2, 0, 5.0, None), (2, 1, 6.0, 4.0), (2, 2, 7.0, None)], "session_id long, seq long, t double, x double")
    got = {(r["session_id"], r["frame"]): (r["t"], r["x"]) for r in timebase.resample(samples, ["x"], 0.5, duration=30.0).collect()}
    assert [got[1, i] for i in range(15)] == [(min(20.0, max(10.0, 2.0 * i)), min(3.0, max(1.0, 1 + (2 * i - 10) / 5))) for i in range(15)]
    assert [got[2, i] for i in range(15)] == [(min(7.0, max(5.0, 2.0 * i)), 4.0) for i in range(15)] and len(got) == 30


def test_lap_lists_line_up_at_least_cost():
    """Against all alignments of short lists; a long list takes a byte a cell and no path a cell."""
    def least(a, b, gap):
        if not a or not b:
            return gap * (len(a) + len(b))
        off = abs(a[0] - b[0])
        return min(least(a[1:], b, gap) + gap, least(a, b[1:], gap) + gap, *([least(a[1:], b[1:], gap) + off] if off <= gap else []))

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([float(rng.randrange(6)) for _ in range(rng.randrange(5))] for _ in range(2))
        path = laps.align_seconds(a, b, 2.0)
        assert [i for i, _ in path if i is not None] == list(range(len(a))) and [j for _, j in path if j is not None] == list(range(len(b)))
        assert sum(2.0 if i is None or j is None else abs(a[i] - b[j]) for i, j in path) == least(a, b, 2.0)
    assert laps.align_seconds([1.0] * 1500, [1.0] * 1500, 0.5) == [(i, i) for i in range(1500)]


def test_log_files_are_read_once(spark, tmp_path):
    (tmp_path / "S1").mkdir()
    file = tmp_path / "S1" / "aim.csv"
    file.write_text('"Racer","A"\n\n"Time","GPS Speed"\n"s","km/h"\n"0.0","10"\n"0.1","20"\n')
    samples, meta = logs.read_aim(spark, str(tmp_path))
    file.unlink()
    assert [(r["seq"], r["value"]) for r in samples.where("channel = 'GPS Speed'").orderBy("seq").collect()] == [(2, "10"), (3, "20")]
    assert meta.first()["meta"] == {"Racer": "A"}
