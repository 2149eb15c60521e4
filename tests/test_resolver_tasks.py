"""Tables are dealt over tasks by their number of cells, and a header band is matched once; neither changes a result."""

from pyspark.sql import functions as F

from plumbline.operators import schema_resolver as R

HEADS = ("MARK", "WIDTH", "HEIGHT", "DOOR MATERIAL"), ("Door No.", "COLOUR", "WIDTH", "GLASS TYPE")


def cells(spark, n):
    rows = [(t, "door", r, c, HEADS[t % 2][c] if r == 0 else f"N{100 + r}A" if c == 0 else "x") for t in range(n) for r in range(7) for c in range(4)]
    return spark.createDataFrame(rows, "table_id long, kind string, row_ord int, col_ord int, text string")


def test_tasks_grow_with_cells(spark, monkeypatch):
    made = cells(spark, 120)
    want = sorted(map(str, R.table_items(made, ["table_id"], least=0.5).collect()))
    monkeypatch.setattr(R, "CELLS", 200)
    monkeypatch.setattr(R, "ROWS", 50)
    rows = R.table_rows(made, ["table_id"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(rows) > 8 and max(r.n for r in rows) < 300 and sum(r.n for r in rows) == 840
    assert len(want) == 120 * 6 and sorted(map(str, R.table_items(made, ["table_id"], least=0.5).collect())) == want


def test_bands_beyond_a_broadcast(spark, monkeypatch):
    of = lambda: sorted(map(str, R.resolved(R.table_rows(cells(spark, 10), ["table_id"]), ["table_id"]).collect()))
    want = of()
    monkeypatch.setattr(R, "BANDS", 0)
    assert len(want) == 10 and of() == want
