from pyspark.sql import functions as F

from markscope.operators.overlay import overlay, overlay_all


def test_overlay_two_layers(spark):
    base = spark.createDataFrame([("a", 1, "x", 0), ("b", 2, "y", 1), ("c", 3, "z", 2)],
                                 "name string, width int, unit string, ord long")
    user = spark.createDataFrame([("b", 9, None, 0), ("d", 4, "w", 1)], "name string, width int, unit string, ord long")
    got = [(r.name, r.width, r.unit) for r in overlay(base, user).orderBy("ord_group", "ord").collect()]
    # right wins per field, a missing field keeps the left value, right rows go last
    assert got == [("a", 1, "x"), ("c", 3, "z"), ("b", 9, "y"), ("d", 4, "w")]


def test_overlay_three_layers(spark):
    schema = "name string, width int, ord long"
    base = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 3, 2)], schema)
    user = spark.createDataFrame([("b", 20, 0), ("e", 5, 1)], schema)
    work = spark.createDataFrame([("a", 100, 0), ("e", 50, 1)], schema)
    got = [(r.name, r.width) for r in overlay_all([base, user, work]).orderBy("ord_path").collect()]
    # base-only c, then user's b, then workspace rows a and e in their order
    assert got == [("c", 3), ("b", 20), ("a", 100), ("e", 50)]
