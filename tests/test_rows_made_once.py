"""Costly rows are dealt over tasks whatever the input's row groups, and each is parsed once."""

from pyspark.sql import functions as F

from pagelode.functions.core import once
from pagelode.operators import entities as E
from pagelode.operators import tasks as T
from pagelode.plans import calls, tasks
from pagelode.sources import adapters as A

SF = "/root/testdata/sf0.001"


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson")


def test_once_keeps_rows_and_is_not_merged(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "no"), (3, None)], "k int, j string")
    made = once(df, j=F.try_parse_json("j"))
    read = made.select("k", *[F.try_variant_get("j", "$.a", "int").alias(f"c{i}") for i in range(4)])
    assert parses(read) == 1
    assert sorted((r.k, r.c0, r.c3) for r in read.collect()) == [(1, 1, 1), (2, None, None), (3, None, None)]


def test_bodies_are_dealt_and_parsed_once(spark):
    bodies = tasks._bodies(spark, SF)
    assert bodies.rdd.getNumPartitions() >= 4
    assert parses(T.fixture_data_tasks(bodies)) == 1


def test_all_tasks_are_made_once_before_they_are_numbered(spark):
    bodies = tasks._bodies(spark, SF).limit(50)
    numbered = T.all_tasks(T.fixture_data_tasks(bodies))
    assert parses(numbered) == 0
    assert sorted(r.number for r in numbered.collect()) == list(range(1, numbered.count() + 1))


def test_records_are_made_once(spark):
    docs = A.entity_docs(spark, SF)
    assert docs.rdd.getNumPartitions() >= 4
    records = E.document_records(docs)
    for made in (E.entities(records), E.entity_fields(records), E.relation_edges(records)):
        assert parses(made) == 1


def test_calls_with_bodies_are_dealt(spark):
    assert A.calls(spark, SF, dealt_rows=True).rdd.getNumPartitions() >= 4
    assert calls.api(spark, SF).rdd.getNumPartitions() >= 4
    assert calls.c16(spark, SF).rdd.getNumPartitions() >= 4


def test_bodies_of_a_folded_log_are_parsed_once(spark):
    from pagelode.operators import calls as C
    log = spark.createDataFrame([("r", "1", 1, "create", '{"a":1}')], "resource string, id string, seq long, op string, body string")
    plan = C.opened_log(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") + plan.count("parseJson(") == 1


def test_a_batch_of_a_staged_stream_has_many_files(spark):
    from pagelode.plans import streams as P
    rows = P._staged(spark, spark.range(1000).withColumnRenamed("id", "seq"), "seq", 3)
    plan = rows._jdf.queryExecution().analyzed().toString()
    per = max(1, spark.sparkContext.defaultParallelism // 3)
    import re
    path = re.search(r"[^\s\[\],]*stream-[0-9a-f]+/source", plan)[0].replace("file:", "")
    import glob
    assert len(glob.glob(path + "/part-*")) == 3 * per


def test_links_are_resolved_once(spark):
    from pagelode.operators import links as L
    pages = spark.createDataFrame([(1, "https://a.com/x", '<a href="/y">y</a>')], "page_id long, url string, html string")
    found = L.crawl_links(pages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [l for l in plan.split("\n") if "Filter" in l and "isnotnull(_once" in l.lower() or "Generate explode" in l]
    assert plan.count("Generate explode") == 2 and [r.target for r in found.collect()] == ["https://a.com/y"]


def test_controls_are_found_in_one_pass(spark):
    from pagelode.operators import controls, dom
    html = "<nav><a href='/a'>Item 1</a><a href='/b'>Item 2</a><button disabled>x</button></nav><main><a href='/a'>Item 1</a></main>"
    nodes = dom.dom_nodes(spark.createDataFrame([(1, "https://a.example.com/", html)], "page_id long, url string, html string"))
    found = controls.control_fields(controls.controls(nodes))
    assert [(r.pos, r.label, r.same_site_href) for r in found.orderBy("pos").collect()] == [
        (1, "Item 1", "https://a.example.com/a"), (5, "Item 1", "https://a.example.com/a")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
