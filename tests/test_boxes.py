"""Layout boxes whose places repeat."""

from pyspark.sql import functions as F

from pagelode.operators import styles

COLUMNS = "page_id long, pos long, tag string, role string, class string, x double, y double, width double, height double"


def test_boxes_of_one_place_are_numbered_alike_on_every_run(spark):
    rows = [(1, 7, "header", None, "x", float(i), 0.0, 5.0, 5.0) for i in range(30)]

    def numbered(rows, seq):
        df = spark.createDataFrame(rows, COLUMNS).coalesce(1).withColumn("box", F.create_map(F.lit("gap"), F.lit("1px")))
        df = df.withColumn("seq", -F.col("x")) if seq else df
        return [r.x for r in styles.layout_boxes(df).orderBy("box_no").collect()]
    assert numbered(rows, False) == numbered(rows[::-1], False) == [float(i) for i in range(30)]
    assert numbered(rows, True) == numbered(rows[::-1], True) == [float(i) for i in range(29, -1, -1)]
