from __future__ import annotations

import pytest

from wirepost.plans import anomaly


def test_every_capture_has_a_fold(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS vec_id", "CAST(id % 1500 AS INT) AS label")
    found = anomaly.folds_of(rows).collect()
    assert (sum(r.n for r in found), sum(r.captures for r in found)) == (3000, 1500)
    monkeypatch.setattr(anomaly, "MAX_CAPTURES", 1499)
    with pytest.raises(ValueError, match="captures"):
        anomaly.folds_of(rows)
