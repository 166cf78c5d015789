"""The bitmap lets every wanted row pass, and few others."""

from __future__ import annotations

import pyarrow as pa

from lyrebird.llm.prefilter import likely_in


def test_wanted_rows_pass(spark):
    df = spark.range(0, 20_000, 1, 3).selectExpr("CASE WHEN id % 100 = 7 THEN NULL ELSE id * 1000003 END AS doc_id", "id AS k")
    wanted = spark.range(0, 20_000, 50).selectExpr("id * 1000003 AS x")
    got = {r.k for r in likely_in(df, wanted).collect()}
    assert set(range(0, 20_000, 50)) <= got and len(got) < 500
    assert likely_in(df, wanted.where("false")).count() == 0

    def doubled(batches):
        for b in batches:
            yield pa.record_batch({"k": pa.array([2 * k.as_py() for k in b["k"]], pa.int64())})

    assert {r.k for r in likely_in(df, wanted, then=doubled, schema="k long").collect()} == {2 * k for k in got}
