from __future__ import annotations

from duotick.sources import tunes


def _tune(spark):
    empty = [None] * (len(tunes.FRAME_SCHEMA) - 5)
    return spark.createDataFrame([(1, 0, 222, 1, 15, *empty), (1, 24, 123, None, None, *empty)], tunes.FRAME_SCHEMA)


def test_round_trips(spark, tmp_path):
    tune = _tune(spark)
    tunes.write_tune_json(tune, str(tmp_path / "j"))
    tunes.write_tune_csv(tune, str(tmp_path / "c"))
    want = sorted(map(tuple, tune.collect()), key=str)
    assert sorted(map(tuple, tunes.read_tune_json(spark, str(tmp_path / "j")).collect()), key=str) == want
    assert sorted(map(tuple, tunes.read_tune_csv(spark, str(tmp_path / "c")).collect()), key=str) == want


def test_import_dump(spark):
    dense = spark.createDataFrame([(1, 0, 5, 7), (1, 1, 5, 8), (1, 2, 5, 8)], "tune_id long, frame long, r0 int, r1 int")
    assert [tuple(r) for r in tunes.import_dump(dense).orderBy("frame").collect()] == [(1, 0, 5, 7), (1, 1, None, 8), (1, 2, None, None)]
