from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from curvestat import schema
from curvestat.sources import coordinates, sinks


def write(folder, name, rows, bom=False):
    folder.mkdir(exist_ok=True)
    text = ("﻿" if bom else "") + "\n".join(",".join(map(str, r)) for r in rows) + "\n"
    (folder / name).write_text(text, encoding="utf-8")


def test_coordinate_files(spark, tmp_path):
    rows = [[float(i), 1.0, 2.0] for i in range(200)]
    padded = [[1.0 + i, 1.0, 2.0] if i < 50 else [0, 0, 0] for i in range(200)]
    write(tmp_path / "a", "bat_120_7_2_5_200_230.csv", rows, bom=True)
    write(tmp_path / "a", "bat_120_8_2_5_200_200.csv", rows + rows)
    write(tmp_path / "a", "bat_120_9_2_5_200_50.csv", padded)
    write(tmp_path / "a", "notes.csv", [[1]])
    frames = coordinates.read_frames(spark, str(tmp_path / "a"), "bat", 3)
    got = {r["global_index"]: r for r in coordinates.observable_frames(frames).collect()}
    assert {k: (r["participant"], r["raw_length"], r["doubled"], len(r["coords"])) for k, r in got.items()} == {7: (5, 230, False, 200), 8: (5, 200, True, 200), 9: (5, 50, False, 50)}
    write(tmp_path / "b", "bat_120_1_1_1_200_200.csv", rows[:10])
    with pytest.raises(Exception, match="malformed"):
        coordinates.read_frames(spark, str(tmp_path / "b"), "bat", 3).collect()


def test_pairs(spark, tmp_path):
    for folder, prefix, indices in (("r", "bat", (1, 2)), ("b", "human", (1,))):
        for i in indices:
            write(tmp_path / folder, f"{prefix}_120_{i}_1_1_200_9.csv", [[1]])
    r, b = (coordinates.list_trials(spark, str(tmp_path / f), p) for f, p in (("r", "bat"), ("b", "human")))
    assert coordinates.pair_files(r, b).count() == 1
    assert [x["global_index"] for x in coordinates.unpaired(r, b).collect()] == [2]


def test_hashes_inventory_and_refusal(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.bin").write_bytes(b"abc")
    path = str(tmp_path / "x")
    row = sinks.inventory(spark, path).first()
    assert row["path"] == "a.bin" and row["bytes"] == 3 and row["sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert sinks.provenance(spark, {"input": path}).first()["role"] == "input"
    coordinates.verify_archive(spark, path, 3, hashlib.md5(b"abc").hexdigest(), row["sha256"])
    with pytest.raises(ValueError):
        coordinates.verify_archive(spark, path, 4, "", "")


def test_round_trips(spark, tmp_path):
    curves = spark.createDataFrame([("racket", 1, 2, 3, [1.0, 2.0])], schema.CURVE)
    written = sinks.write_curves(curves, str(tmp_path / "c")).first()
    assert (written["waveform"], written["curves"], written["sha256"]) == tuple(sinks.cube_digest(curves).first())
    assert sinks.second_name(spark, str(tmp_path / "c"), str(tmp_path / "d")).count() == 1
    assert coordinates.read_curves(spark, str(tmp_path / "c")).select("y").first()["y"] == [1.0, 2.0]
    table = spark.createDataFrame([(1, 2, 0.1 + 0.2)], "a int, b int, v double")
    sinks.write_csv_rounded(table, str(tmp_path / "t"))
    sinks.write_csv(table, str(tmp_path / "u"))
    back = coordinates.read_table(spark, str(tmp_path / "t"), table.schema)
    assert back.first()["v"] == 0.3 and all(f.read_bytes()[:3] == b"\xef\xbb\xbf" for f in (tmp_path / "t").glob("*.csv"))
    sinks.write_summary(table.agg(F.max("v").alias("v")), str(tmp_path / "s.json"))
    assert '"v": 0.3' in (tmp_path / "s.json").read_text()
    assert spark.table(sinks.alias(table, "renamed") and "renamed").count() == 1


def test_the_root_that_holds_both_folders(spark, tmp_path):
    for root, n in (("one/data", 2), ("other", 1)):
        for folder in ("racket", "body"):
            for i in range(n):
                (tmp_path / root / folder).mkdir(parents=True, exist_ok=True)
                (tmp_path / root / folder / f"{i}.csv").write_text("1\n")
    assert coordinates.located(spark, str(tmp_path), {"racket": 2, "body": 2}).endswith("one/data")
    with pytest.raises(ValueError, match="0 folders"):
        coordinates.located(spark, str(tmp_path), {"racket": 3, "body": 2})
