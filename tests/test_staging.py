"""Written tables and the folder they go to."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from lyrebird.staging import shared_folder, staged


def test_staged_tables_lie_in_the_named_folder(spark):
    df = staged(spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS s"), "some")
    folder = shared_folder(spark)
    assert sorted(r.id for r in df.collect()) == list(range(5)) and df.dtypes == [("id", "bigint"), ("s", "string")]
    assert all(f.startswith(folder) for f in df.inputFiles())
    assert staged(spark.range(0), "none").count() == 0


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_the_setting(master):
    session = SimpleNamespace(
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)), conf=SimpleNamespace(get=lambda k, d: d)
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_cleared(spark, tmp_path, monkeypatch):
    from lyrebird import staging

    monkeypatch.setattr(staging, "_own_folder", lambda spark: f"file://{tmp_path}/own")
    assert staged(spark.range(3), "gone").count() == 3 and list((tmp_path / "own").iterdir())
    staging.clear(spark)
    assert not (tmp_path / "own").exists()
    staging.clear(spark)
    assert staging.free_name("_x", ["a", "_X", "_x_"]) == "_x__"
