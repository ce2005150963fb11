"""Shapes of plans and tables that decide how work grows."""

import math

from pyspark.sql import functions as F

from urlrisk.operators import selection as se


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_information_reads_its_cells_once(spark):
    rows = [(f"f{i % 3}", i % 5, "ab"[i % 2], i + 1) for i in range(40)]
    cells = spark.createDataFrame(rows, "feature string, bin int, label string, n long")
    got = {r.feature: r.mi for r in se.information(cells).collect()}
    assert plan(se.information(cells)).count("LogicalRDD") == 1
    for name in ("f0", "f1", "f2"):
        own = [r for r in rows if r[0] == name]
        joint, bins, labels, total = {}, {}, {}, sum(r[3] for r in own)
        for _, b, y, n in own:
            joint[b, y] = joint.get((b, y), 0) + n
            bins[b], labels[y] = bins.get(b, 0) + n, labels.get(y, 0) + n
        merged = spark.createDataFrame([(name, b, y, n) for (b, y), n in joint.items()], cells.schema)
        want = sum(n / total * math.log(n * total / (bins[b] * labels[y])) for (b, y), n in joint.items())
        assert math.isclose(se.information(merged).first().mi, want, rel_tol=1e-9, abs_tol=1e-12)
    assert set(got) == {"f0", "f1", "f2"}


def test_flags_are_counted_before_they_are_unpivoted(spark):
    df = spark.range(3000).select((F.col("id") % 2).cast("string").alias("label"), *[(F.col("id") % k == 0).cast("double").alias(f"x{k}") for k in (2, 3, 4)])
    text = plan(se.flag_information(df, ["x2", "x3", "x4"]))
    # Rows are aggregated below the unpivot: from the top it stands above an aggregate.
    assert text.count("Expand") == 1 and "Aggregate" in text[text.index("Expand"):]
    got = {r.feature: r.mi for r in se.flag_information(df, ["x2", "x3", "x4"]).collect()}
    assert math.isclose(got["x2"], math.log(2), rel_tol=1e-9) and abs(got["x3"]) < 1e-9


def test_leading_counts_merge_over_batches():
    import numpy as np
    import pyarrow as pa

    values = np.arange(200_000, dtype=float) % 70_000
    batches = [pa.record_batch([pa.array(part)], names=["v"]) for part in np.array_split(values, 40)]
    got = list(se._leading(iter(batches), [None], 0, 64))[0]
    keys, counts = np.unique(se._sortable(values), return_counts=True)
    assert got.column("key").to_pylist() == keys.tolist() and got.column("n").to_pylist() == counts.tolist()


def test_a_point_visits_areas_and_finds_its_nearest(spark, monkeypatch):
    import numpy as np

    from urlrisk.operators import smote

    monkeypatch.setattr(smote, "CELL", 10)
    monkeypatch.setattr(smote, "AREA", (4, 64))
    x = np.random.default_rng(3).normal(size=(600, 16))
    points = spark.createDataFrame([(str(i), v.tolist(), 1 + i % 2) for i, v in enumerate(x)], "id string, vec array<double>, m long")
    sent, visits = [], smote._visits
    monkeypatch.setattr(smote, "_visits", lambda *a: sent.append(visits(*a)) or sent[-1])
    got = {r.id: np.array(r.near) for r in smote.nearest_neighbours(points, 5).collect()}
    for i, own in enumerate(x):
        distance = np.repeat(np.sqrt(((x - own) ** 2).sum(1)), [1 + j % 2 for j in range(len(x))])
        want = np.sort(distance)[1:6]
        assert np.allclose(np.sqrt(((got[str(i)] - own) ** 2).sum(1)), want)
    # 60 cells, none of which a bound leaves out, but at most 16 visits of a point.
    assert smote.area_size(60) == 4 and sent[0].count() <= 16 * 600
