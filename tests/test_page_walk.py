"""How pages are dealt over tasks, and what one page costs."""

from pagelode.functions.core import TASK_ROWS, spread
from pagelode.operators import dom

PAGE = "<ul class=a>" + "<li class=card><a href='/x'>One &amp; two</a> <b>x</b>&nbsp;</li>" * 3 + "</ul><p>a<p> b"


def _sizes(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_one_large_split_is_dealt(spark):
    lopsided = spark.range(8).repartition(8).union(spark.range(100, 4100, 1, 1))
    assert max(_sizes(spread(lopsided, "id"))) < 4008 / 2


def test_tasks_grow_with_rows(spark):
    assert spread(spark.range(0, 9 * TASK_ROWS, 1, 1), "id").rdd.getNumPartitions() == 9
    assert spread(spark.range(0), "id").count() == 0


def test_a_tag_that_recurs_is_read_once():
    dom._known_tag.cache_clear()
    out = dom._Elements()
    for _ in range(50):
        dom._walk(PAGE, None, True, out)
    assert dom._known_tag.cache_info().misses == len({t for t in dom._PY_TOKEN.findall(PAGE) if t[0] == "<"})
    assert out.pages == [12] * 50 and out.text[:4] == ["One & two x One & two x One & two x", "One & two x", "One & two", "x"]
    assert out.text[10:12] == ["a", "b"]


def test_pages_without_elements_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<i>x"), (4, "u", "no tag < at all")], "page_id long, url string, html string")
    assert [(r.page_id, r.url, r.tag, r.text) for r in dom.dom_nodes(df).collect()] == [(None, "u", "i", "x")]
    assert [r.text for r in dom.dom_nodes(df, with_text=False).collect()] == [None]


def test_rows_that_are_files_take_more_tasks(spark):
    assert spread(spark.range(0, 3000, 1, 1), "id", task_rows=250).rdd.getNumPartitions() == 12
    assert len(_sizes(spread(spark.range(0, 100, 1, 1), "id", task_rows=250))) == spark.sparkContext.defaultParallelism
