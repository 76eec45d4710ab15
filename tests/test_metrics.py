"""The writer of model rankings."""

from __future__ import annotations

from folioweave.operators import metrics as M


def test_rankings_are_versions(spark, tmp_path):
    df = spark.createDataFrame([("m1", True, 1), ("m2", False, 2)], "model string, ok boolean, rank int")
    for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        M.write_ranking(df, f"{tmp_path}/speed", at)
    back = spark.read.parquet(f"{tmp_path}/speed")
    assert back.count() == 4 and back.where("made_at = (SELECT max(made_at) FROM {t})".format(t=f"parquet.`{tmp_path}/speed`")).count() == 2
