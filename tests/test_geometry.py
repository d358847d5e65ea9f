from pyspark.sql import functions as F

from tabulon.operators import geometry as G


def test_colours(spark):
    rows = spark.createDataFrame([("#c7c9cb",), ("#ff0000",), ("#f0f0f0",), ("white",), (None,)], "fill string")
    got = [tuple(r) for r in rows.select(G.is_neutral(F.col("fill")), G.is_background(F.col("fill")), G.region_class(F.col("fill"), F.lit(False), "#c7c9cb")).collect()]
    assert got == [(True, False, "predavanje"), (False, False, "ostali_casovi"), (True, True, "racunske_vezbe"), (False, False, "ostali_casovi"), (False, False, "ostali_casovi")]


def test_compose():
    assert G.compose([("AB", 0, 20), ("C", 25, 35)]) == "AB C"
    assert G.compose([("AB", 0, 20), ("CD", 20, 40)]) == "ABCD"
    assert G.compose([("A C", 0, 30), ("B", 10, 20)]) == "ABC"


def test_lines_and_blocks(spark):
    items = [("p", 0, "Hello", 0.0, 50.0, 100.0, 110.0), ("p", 1, "there", 60.0, 110.0, 101.0, 111.0), ("p", 2, "below", 0.0, 50.0, 88.0, 98.0), ("p", 3, "far", 0.0, 30.0, 10.0, 20.0), ("q", 0, " ", 0.0, 1.0, 0.0, 1.0)]
    lines = G.text_lines(spark.createDataFrame(items, "page string, ord int, text string, x0 double, x1 double, y0 double, y1 double"))
    assert [(r.line, r.text) for r in lines.orderBy("line").collect()] == [(0, "Hello there"), (1, "below"), (2, "far")]
    assert [(r.line, r.block) for r in G.text_blocks(lines).orderBy("line").collect()] == [(0, 0), (1, 0), (2, 2)]
