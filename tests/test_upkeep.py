"""Names, value lists and upkeep operators."""

import pytest
from pyspark.sql import functions as F

from casebolt.functions import people
from casebolt.operators import upkeep


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Anna Maria Berg", ("Anna", "Maria", "Berg", True)), ("Berg, Anna M.", ("Anna", "M", "Berg", True)), ("van Berg, A.", ("A", None, "van Berg", True)), ("Berg", ("Berg", None, None, False)), ("Anna Berg, Esq.", ("Anna", None, "Berg,", True)),
    ],
)
def test_parse_name(text, want):
    n = people.parse_name(text)
    assert (n["given"], n["middle"], n["family"], n["is_full"]) == want


def test_name_edges(spark):
    assert people.parse_name(None) is None and people.parse_name("  ") is None
    d = spark.createDataFrame([("Anna Berg; b@x.example, c@y.example",), (None,), ("",)], "v string")
    assert [r.l for r in d.select(people.value_list("v").alias("l")).collect()] == [["Anna Berg", "b@x.example", "c@y.example"], None, []]
    assert [r.n and r.n.family for r in d.select(people.name_parts(F.lit(None).cast("string")).alias("n")).collect()] == [None] * 3
    e = spark.createDataFrame([("Employee ID: 12-A; Matter No=77",), (None,)], "v string")
    assert e.select(people.external_ids("v").alias("x")).first().x == ["employee id=12-a", "matter no=77"]


def test_upkeep(spark):
    a = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "x")], "k string, n long, t string")
    b = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("d", 4, "x")], "k string, n long, t string")
    assert {r.k: r.state for r in upkeep.load_state(a, b, "k", ["n", "t"]).collect()} == {"a": "unchanged", "b": "changed", "c": "retired", "d": "new"}
    docs = spark.createDataFrame([(1, None, "active"), (2, 1, "active"), (3, None, "active")], "id long, parent_id long, lifecycle_status string")
    assert {r["id"]: r.lifecycle_status for r in upkeep.delete(docs, docs.where("id = 1")).collect()} == {1: "deleted", 2: "deleted", 3: "active"}
    assert {r["id"]: r.lifecycle_status for r in upkeep.delete(docs, docs.where("id = 2")).collect()} == {1: "active", 2: "deleted", 3: "active"}
    p = spark.createDataFrame([(1, 3), (2, 0)], "id long, page_count int")
    items = upkeep.page_items(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, ordinal int"), p)
    assert sorted((r["id"], r.page) for r in items.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]
    empty = docs.limit(0)
    assert upkeep.refresh_membership(empty, spark.createDataFrame([], "document_id long, dataset_name string")).count() == 0
