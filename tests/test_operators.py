"""Operators on small tables, with nulls, ties, repeats, empty input and clashing columns."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casebolt.functions import bates, identifiers
from casebolt.operators import collection, conversations, entities, families, instants, occurrences, packed, runs, search
from casebolt.plans.fields import Catalog
from casebolt.plans.filters import compile_filter
from casebolt.plans.scope import Corpus, Scope, Session, render

ZONES = "account string, home_zone string, day_order string"
GMAIL = "meta_id long, account string, datesent string, datereceived string, labels string, cc string, bcc string"
MAIL = "mail_id long, account string, date_created string"


def utc(spark, value, zone="America/New_York", day_order="mdy"):
    z = spark.createDataFrame([("a", zone, day_order)], ZONES)
    g = spark.createDataFrame([(1, "a", value, None, None, None, None)], GMAIL)
    r = instants.normalise_instants(g, spark.createDataFrame([], MAIL), z).where("field_name = 'datesent'").collect()
    return r[0]["utc_text"]


INSTANTS = [
    ("2021-11-07 01:30", "2021-11-07T05:30:00.000000Z"), ("2021-03-14 02:30:00", "2021-03-14T07:30:00.000000Z"), ("03/04/2021 1:02 pm", "2021-03-04T18:02:00.000000Z"), ("12/31/19 12:05:07 AM", "2019-12-31T05:05:07.000000Z"),
    ("D:20120423124409+02'00'", "2012-04-23T10:44:09.000000Z"), ("1406922959", "2014-08-01T19:55:59.000000Z"), ("1365132918187", "2013-04-05T03:35:18.187000Z"), ("Fri, 24 Dec 2021 22:06:53 GMT", "2021-12-24T22:06:53.000000Z"),
    ("5 Nov 2017 01:43:09 CDT", "2017-11-05T06:43:09.000000Z"), ("2018-07-24T21:15:35+01:00[Europe/London]", "2018-07-24T20:15:35.000000Z"), ("20221028T075859Z", "2022-10-28T07:58:59.000000Z"), ("May 17, 2019 at 8:33 PM", "2019-05-18T00:33:00.000000Z"),
    ("2021-02-30 10:00", None), ("0000-00-00 00:00:00", None), ("2021-05-06", None), ("10:11:12", None), ("n/a", None), ("", None), (None, None), ("13/13/2020 10:00:00", None),
]


def test_instants(spark):
    z = spark.createDataFrame([("a", "America/New_York", "mdy")], ZONES)
    g = spark.createDataFrame([(i, "a", value, None, None, None, None) for i, (value, _) in enumerate(INSTANTS)], GMAIL)
    r = instants.normalise_instants(g, spark.createDataFrame([], MAIL), z).where("field_name = 'datesent'").collect()
    assert {x["record_id"]: x["utc_text"] for x in r} == {i: want for i, (_, want) in enumerate(INSTANTS)}


def test_instants_without_zone(spark):
    assert utc(spark, "2021-11-07 01:30", zone=None) is None
    assert utc(spark, "03.04.2021 10:00", day_order="mdy") == "2021-04-03T14:00:00.000000Z"
    assert instants.found(spark.createDataFrame([], GMAIL), spark.createDataFrame([], MAIL), spark.createDataFrame([], ZONES)).count() == 0


def estimated(spark, rows, accounts=("x",)):
    """Segments from (account, sent, received, loaded)."""
    g = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "meta_id long, account string, datesent string, datereceived string, loaded_at timestamp")
    z = spark.createDataFrame([(a, None, "dmy") for a in accounts] + [("other", "Europe/Berlin", "dmy"), ("third", "America/New_York", "mdy"), ("fourth", "Asia/Tokyo", "dmy")], ZONES)
    m = spark.createDataFrame([], "mail_id long, account string, date_created string, ingested_at timestamp")
    return g, m, z, sorted(tuple(r) for r in instants.zone_estimates(g, m, z, z.where("home_zone is null")).collect())


def test_zone_estimate(spark):
    rows = [("x", f"2020-0{1 + i % 9}-10 12:00:00", f"2020-0{1 + i % 9}-10T{'11' if i % 9 in (0, 1, 2) else '10'}:00:30Z", None) for i in range(18)]
    got = estimated(spark, rows)[-1]
    assert len(got) == 1 and got[0][1] == "Europe/Berlin" and got[0][4] <= 2


def test_zone_estimate_of_a_zone_nobody_states(spark):
    rows = [("x", f"2020-{1 + i % 12:02}-{1 + i:02} 12:00:00", f"2020-{1 + i % 12:02}-{1 + i:02}T06:15:20Z", None) for i in range(24)]
    assert [r[1] for r in estimated(spark, rows)[-1]] == ["Asia/Kathmandu"]


def test_zone_estimate_of_an_account_that_moved(spark):
    day = lambda i: f"20{18 + i // 12}-{1 + i % 12:02}-15"
    rows = [("x", f"{day(i)} 12:00:00", f"{day(i)}T{'03' if i < 18 else '16' if 3 <= 1 + i % 12 - 1 <= 9 else '17'}:00:20Z", None) for i in range(36) for _ in range(5)]
    g, m, z, got = estimated(spark, rows + [("x", "2018-02-01 12:00", None, None), ("x", "2020-12-20 12:00", None, None)])
    assert [(r[1], r[2] is None, r[3] is None) for r in sorted(got, key=lambda r: r[2] or 0)] == [("Asia/Tokyo", True, False), ("America/New_York", False, True)]
    utc = {r["raw_text"]: r["utc_text"] for r in instants.normalise_instants(g, m, z).where("field_name = 'datesent' and zone_basis = 'estimated'").collect()}
    assert utc["2018-02-01 12:00"] == "2018-02-01T03:00:00.000000Z" and utc["2020-12-20 12:00"] == "2020-12-20T17:00:00.000000Z"


def test_zone_estimate_by_load_time(spark):
    """Only zones west of the ones in which a value would follow its own load remain."""
    rows = [("x", f"2020-06-{1 + i:02} 12:00:00", None, datetime(2020, 6, 1 + i, 3, 1)) for i in range(20)]
    assert estimated(spark, rows)[-1] == []
    rows += [("x", "2020-06-21 12:00:00", "2020-06-21T03:00:30Z", None)] * 2
    got = estimated(spark, rows)[-1]
    assert len(got) == 1 and got[0][4] == 0 and got[0][5] == 2


def test_no_zone_estimate_from_contradictions(spark):
    rows = [("x", f"2020-06-{1 + i:02} 12:00:00", f"2020-06-{1 + i:02}T{i:02}:00:30Z", None) for i in range(20)]
    rows += [("x", f"2020-07-{1 + i:02}T{i:02}:00:30Z", f"2020-07-{1 + i:02} 12:00:00", None) for i in range(20)]
    g, m, z, got = estimated(spark, rows)
    assert got == [] and instants.normalise_instants(g, m, z).where("zone_basis = 'estimated'").count() == 0


def test_instants_plan_stays_small(spark):
    g = spark.createDataFrame([], GMAIL)
    df = instants.found(g, spark.createDataFrame([], MAIL), spark.createDataFrame([], ZONES))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 50_000
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation,org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation")
    try:
        df = instants.found(g, spark.createDataFrame([], MAIL), spark.createDataFrame([], ZONES))
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")


def test_packed(spark):
    rows = [(i, None, None, None, "Red,Blue" if i % 2 else "Red", None, None) for i in range(20)] + [(50, None, None, None, 'Blue;"Red, dark"', "Senkor, Kenji; a@x.example", " ; ")]
    got = packed.found(spark.createDataFrame(rows, GMAIL)).collect()
    assert [(r.pos, r.item) for r in sorted((x for x in got if x.meta_id == 50 and x.field_name == "labels"), key=lambda r: r.pos)] == [(1, "Blue"), (2, "Red, dark")]
    assert {(r.pos, r.item) for r in got if r.meta_id == 50 and r.field_name == "cc"} == {(1, "Senkor, Kenji"), (2, "a@x.example")}
    assert {(r.pos, r.item) for r in got if r.meta_id == 1} == {(1, "Red"), (2, "Blue")} and not [r for r in got if r.field_name == "bcc"]
    assert packed.found(spark.createDataFrame([], GMAIL)).count() == 0


DOC = "id long, parent_id long, child_kind string, lifecycle_status string, begin_bates string, end_bates string, lang string, n long, file_name string, title string, date_created string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None, None, "active", "A001", "A010", "en", 5, "x.txt", "T1", "2020-01-01"), (2, 1, None, "active", "A011", None, "de", None, "y.TXT", None, None), (3, 1, "reply_thread", "active", "A1", "A1", None, 7, None, "T3", "2021"),
        (4, None, None, "missing", "B9", "B9", "en", 7, "z", "", "2020-01-01"), (5, None, None, "active", None, None, "EN", -1, "100%_done", "q", " "),
    ]
    return spark.createDataFrame(rows, DOC)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_filters(docs):
    run = lambda e: ids(docs.where(compile_filter(e, Catalog(docs))))
    assert run("n > 5") == [3, 4] and run("NOT n > 5") == [1, 5] and run("NOT NOT n > 5") == [3, 4]
    assert run("lang = 'en'") == [1, 4] and run("lang LIKE 'EN'") == [1, 4, 5] and run("lang != 'en'") == [2, 5]
    assert run("file_name LIKE '%.txt' OR title IS NULL") == [1, 2] and run("n IN (5, 7) AND n BETWEEN 6 AND 9") == [3, 4]
    assert run('title = "T1"') == [1] and run("n = NULL") == []


def test_filter_errors(docs):
    for bad in ("n ==", "n = ", "(n = 1", "title = 'x", "title LIKE 1", "nope = 1", "n = 'abc'", "n = 1 n"):
        with pytest.raises(ValueError):
            compile_filter(bad, Catalog(docs))


def test_bates_columns(spark, docs):
    assert ids(docs.where(bates.overlaps("begin_bates", F.col("end_bates"), F.lit("a010"), F.lit("a011")))) == [1, 2]
    assert ids(docs.where(bates.overlaps("begin_bates", F.col("end_bates"), F.lit("A1"), F.lit("A1")))) == [3]
    order = [r["id"] for r in docs.orderBy(*bates.order("begin_bates")).collect()]
    assert order == [1, 3, 2, 4, 5] or order == [3, 1, 2, 4, 5]
    big = spark.createDataFrame([(1, "X" + "9" * 30)], "id long, b string")
    assert str(big.select(bates.number("b")).first()[0]) == "9" * 30


def test_span_links(spark):
    s = "id long, control_number string, begin_bates string, end_bates string, begin_attachment string, end_attachment string"
    rows = [(1, "c1", "P001", "P003", "P001", "P010"), (2, "c2", "P004", "P006", None, None), (3, "c3", "P020", None, None, None), (4, "c4", "P0001", "P0900", None, None), (5, "c5", "P005", "P005", "P004", "P008"), (6, None, None, None, None, None)]
    got = {(r.child, r.parent) for r in families.link_production_families(spark.createDataFrame(rows, s)).collect()}
    assert got == {(2, 1), (5, 1)}
    p = spark.createDataFrame([("P002", "b.tif"), ("P001", "a.tif"), ("P9", "c.tif"), (None, "d.tif")], "page_bates string, image_path string")
    assert [tuple(r) for r in families.link_pages(spark.createDataFrame(rows[:1], s), p).collect()] == [(1, 2, "a.tif,b.tif")]


def test_families(docs):
    assert ids(docs.where(families.is_attachment())) == [2] and ids(families.has_attachments(docs)) == [1]
    seeds = docs.where("id in (2, 4)").select("id", (-F.col("id")).alias("ordinal"))
    assert [(r["id"], r["first"], r["child"]) for r in families.expand_family(seeds, docs).orderBy("first", "child", "id").collect()] == [(4, -4, 0), (1, -2, 0), (2, -2, 1), (3, -2, 1)]
    inv = collection.inventory(docs).first()
    assert (inv.parents, inv.missing_parents, inv.attachments, inv.documents) == (3, 1, 1, 5)


def test_names_made_unique(spark):
    n = spark.createDataFrame([(1, "A"), (2, "a "), (3, "A"), (4, "A_2"), (5, "b")], "id long, name string")
    assert {r["id"]: r["unique_name"] for r in collection.suffix_collisions(n).collect()} == {1: "A", 2: "a_3", 3: "A_4", 4: "A_2", 5: "b"}


def test_occurrences(spark):
    s = "id long, document_id string, lifecycle_status string, source_kind string, text_status string, has_preview boolean, ingested_at string, custodian string, title string, date_created string, date_modified string"
    rows = [(1, "d", "active", "filesystem", "ok", False, "2", "bob", "x", "2", "3"), (2, "d", "active", "pst", "partial", False, None, "amy", " ", "1", "9"), (3, "d", "missing", "production", "ok", True, "1", "amy", "z", None, None), (4, "e", "missing", "pst", None, None, None, None, None, None, None)]
    o = spark.createDataFrame(rows, s)
    assert {r.document_id: r["id"] for r in occurrences.preferred(o, ["title"]).collect()} == {"d": 2, "e": 4}
    c = {r.document_id: r for r in occurrences.canonical(o, ["title"]).collect()}
    assert (c["d"].title, c["d"].date_created, c["d"].date_modified, c["d"].custodians, c["d"].text_status) == ("z", "1", "9", ["amy", "bob"], "ok") and c["e"].canonical_status == "derelict"
    assert occurrences.conflicts(o, ["title"]).count() == 0 and occurrences.conflicts(o.limit(0), ["title"]).count() == 0


def test_rescan(spark):
    f = "path string, hash string, size long"
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1), ("d", "4", 1), ("e", None, 1)], f)
    new = spark.createDataFrame([("a", "1", 1), ("b", "9", 1), ("x", "3", 1), ("y", "3", 1)], f)
    got = {r.path: (r.state, r.from_path) for r in occurrences.rescan(old, new).collect()}
    assert got == {"a": ("unchanged", None), "b": ("changed", None), "x": ("renamed", "c"), "y": ("new", None), "d": ("missing", None), "e": ("missing", None)}


def test_search(spark):
    d = spark.createDataFrame([(1, "The quick brown fox", "fox tales"), (2, "quick fox, brown", None), (3, None, "über FOX"), (4, "", "")], "id long, body string, title string")
    p = search.index(d, "id", ["body", "title"]).cache()
    hit = lambda q: sorted(r.doc for r in search.matches(p, search.parse_query(q)).collect())
    assert hit("fox") == [1, 2, 3] and hit('"quick brown"') == [1] and hit("title:fox") == [1, 3] and hit("UBER") == [3] and hit("fox NOT quick") == [3]
    assert hit("NEAR(quick fox, 0)") == [2] and hit('"fox fox"') == [] and hit("bro*") == [1, 2] and hit("nothing") == []
    s = {r.doc: r.score for r in search.rank(p, "fox").collect()}
    assert s[1] < 0 and len(s) == 3 and search.rank(p, "nothing").count() == 0


def test_bm25_against_sqlite(spark):
    import sqlite3

    texts = [(i, " ".join(w for k, w in enumerate(("audit", "memo", "ledger", "box") * 3) if (i * 7 + k * 5) % (k + 2) < 2)) for i in range(1, 40)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(body)")
    db.executemany("insert into t(rowid, body) values (?, ?)", texts)
    want = dict(db.execute("select rowid, bm25(t) from t where t match 'audit ledger'"))
    p = search.index(spark.createDataFrame(texts, "id long, body string"), "id", ["body"])
    got = {r.doc: r.score for r in search.rank(p, "audit ledger").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_scope_and_page(spark, docs):
    m = spark.createDataFrame([(1, "one"), (2, "one"), (3, "two"), (4, "one"), (1, "two")], "document_id long, dataset_name string")
    s = Session()
    s.set_scope(Scope(filter="dataset_name = 'one'"))
    s.columns["documents"] = ["id", "title"]
    out = render(s, Corpus(docs, m))
    assert "Documents 1-2 of 2" in out and "| 1 | T1 |" in out
    s.page = 9
    assert "No documents on this page, 2 in all" in render(s, Corpus(docs, m))
    s.command("/filter clear", Catalog(docs))
    s.command("/sort n desc, id", Catalog(docs))
    assert [r["id"] for r in s.current(Corpus(docs, m)).collect()] == [3, 1, 2]


def test_threading(spark):
    s = "id long, date string, message_id string, in_reply_to string, references array<string>, index_root string, topic string, subject string, people array<string>, custodian string, manual string"
    rows = [
        (1, "2020-01-02", "m1", None, [], None, None, "hi", ["a"], "c", None), (2, "2020-01-03", "m2", "m1", ["m1"], None, None, "hi", ["b"], "c", None), (3, "2020-01-01", "m3", "m2", ["m1", "m2"], None, None, "hi", ["a"], "c", None),
        (4, None, None, None, [], None, None, "plan", ["a", "b"], None, None), (5, "2020-02-01", None, None, [], None, None, "plan", ["b"], None, None), (6, "2020-02-02", None, None, [], None, None, "plan", ["z"], None, None), (7, "2020-02-02", None, None, None, None, None, None, None, None, "pinned"), (8, "2020-02-03", None, None, None, None, None, None, None, None, "pinned"),
    ]
    got = {r["id"]: (r.cluster, r.how) for r in conversations.thread_mail(spark.createDataFrame(rows, s)).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == 3 and got[4] == (5, "subject") and got[6] == (6, "new") and got[7][0] == got[8][0]


def test_slack_and_chat(spark):
    m = spark.createDataFrame([("g", "100.1", "100.1", 1), ("g", "200.0", "100.1", 0), ("g", "300.0", "999.9", 0), ("g", "400.0", None, None)], "channel string, ts string, thread_ts string, reply_count long")
    got = {r.ts: r.document for r in conversations.slack_threads(m).collect()}
    assert got == {"100.1": "day:1970-01-01", "200.0": "thread:100.1", "300.0": "day:1970-01-01", "400.0": "day:1970-01-01"}
    assert conversations.is_chat("[2020-01-01 10:00] A B: hi\nmore\n[2020-01-01 10:01] C: yo\n[2020-01-01 10:02] A B: x") and not conversations.is_chat("From: a\nTo: b")


def test_entities(spark):
    c = spark.createDataFrame([(1, ["e:a"], "person"), (2, ["e:a", "e:b"], "unknown"), (3, ["e:b"], "organization"), (4, ["e:c"], "person"), (5, ["e:a", "e:c"], "person"), (6, [], "person")], "candidate_id long, keys array<string>, entity_type string")
    assert {r.candidate_id: (r.entity_id, r.outcome) for r in entities.resolve(c).collect()} == {1: (1, "new"), 2: (1, "reused"), 3: (3, "conflict"), 4: (4, "new"), 5: (5, "ambiguous"), 6: (6, "new")}
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 4)], "id long, merged_into long")
    got = {r["id"]: r.canonical_id for r in entities.canonical(p).collect()}
    assert got[3] == got[2] == 1 and got[4] == got[5] == got[6] == 4
    v = spark.createDataFrame([("<Mailto:A@X.example>;", "+1 (555) 123-4567 ext 9", "Fwd: RE[2]: Hi  there")], "m string, p string, s string")
    assert tuple(v.select(identifiers.email("m"), identifiers.phone("p"), identifiers.subject("s")).first()) == ("a@x.example", "+15551234567x9", "hi there")


def test_runs(spark):
    i = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "document_id long, job_version_id long, input_id string")
    r = spark.createDataFrame([(1, 1, "a", 9, None), (2, 1, "b", 8, datetime(2020, 1, 1))], "document_id long, job_version_id long, input_id string, result_id long, retracted_at timestamp")
    assert {x.document_id: x.state for x in runs.reuse(i, r).collect()} == {1: "reused", 2: "pending"}
    out = {x.document_id: (x.state, x.output) for x in runs.execute(i, "static_template", "{input_id}-{nope}", ["input_id"]).collect()}
    assert out[1][0] == "failed"
    st = spark.createDataFrame([(1, "completed", False), (1, "failed", False), (2, None, False), (3, "pending", True), (4, "pending", False)], "run_id long, state string, canceled boolean")
    assert {x.run_id: x.state for x in runs.progress(st).collect()} == {1: "failed", 2: "completed", 3: "canceled", 4: "planned"}
    pg = spark.createDataFrame([(1, 2, "b", "completed"), (1, 1, "a", "completed"), (2, 1, "a", "pending")], "document_id long, page long, text string, state string")
    assert [tuple(x) for x in runs.assemble_pages(pg).collect()] == [(1, "a\n\nb")]


def test_upsert_prefix_gap(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (3, "w")], "k long, v string")
    assert sorted(map(tuple, occurrences.upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    p = spark.createDataFrame([("a/b/c",), ("ab/c",), (None,)], "path string")
    assert [tuple(r) for r in occurrences.longest_prefix(p, spark.createDataFrame([("a",), ("a/b",), ("b",)], "locator string")).collect()] == [("a/b/c", "a/b")]


def test_streaming_merge(spark, tmp_path):
    from casebolt.streaming import landing

    land, tab, ck = (str(tmp_path / x) for x in ("in", "t", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.json(land)
    landing.merge_landing(spark, land, tab, ck, "id long, v string", ["id"])
    spark.createDataFrame([(2, "c")], "id long, v string").write.mode("append").json(land)
    landing.merge_landing(spark, land, tab, ck, "id long, v string", ["id"])
    assert sorted(map(tuple, landing.current(spark, tab).select("id", "v").collect())) == [(1, "a"), (2, "c")]


def test_streaming_merges_batches_into_a_base(spark, tmp_path, monkeypatch):
    from casebolt.streaming import landing

    monkeypatch.setattr(landing, "MOST_BATCHES", 2)
    land, tab, ck = (str(tmp_path / x) for x in ("in", "t", "ck"))
    with pytest.raises(FileNotFoundError):
        landing.current(spark, tab)
    for n in range(5):
        spark.createDataFrame([(n % 2, f"v{n}"), (None, f"n{n}")], "id long, v string").write.mode("append").json(land)
        landing.merge_landing(spark, land, tab, ck, "id long, v string", ["id"])
        names = [p.name for p in (tmp_path / "t").iterdir()]
        assert len(names) <= 3
    assert any(x.startswith("base=") for x in names)
    assert sorted(map(tuple, landing.current(spark, tab).where("id is not null").select("id", "v").collect())) == [(0, "v4"), (1, "v3")]


def test_export_in_steps(spark, tmp_path):
    from casebolt.sources import sinks

    d, path = spark.range(25).withColumn("x", F.col("id") * 2), str(tmp_path / "e")
    assert sinks.export_step(d, path, "id", 10) == {"state": "running", "cursor": 9, "rows": 10}
    (tmp_path / "e" / "step=1").mkdir()  # a step that was broken off
    assert sinks.export_table(d, path, "id", 10) == {"state": "completed", "cursor": 24, "rows": 5}
    assert sorted(r.id for r in spark.read.parquet(*[str(p) for p in (tmp_path / "e").iterdir()]).collect()) == list(range(25))
    assert sinks.export_step(d.limit(0), str(tmp_path / "f"), "id", 10) == {"state": "completed", "cursor": None, "rows": 0}


def test_files(spark, tmp_path):
    from casebolt.sources import files

    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.mbox").write_bytes(b"From x\nMessage-ID: <1@x>\n\nA\n\nFrom x\nMessage-ID: <1@x>\n\nB\n")
    (tmp_path / "d.dat").write_bytes("þBegBatesþ\x14þEndBatesþ\nþA1þ\x14þA2þ\n".encode("latin-1"))
    got = {(r.extension, r.item_id): (r.text, r.error) for r in files.read_files(files.scan(spark, str(tmp_path), ["txt", "pdf", "mbox"])).collect()}
    assert got[("txt", None)] == ("hello", None) and "unavailable" in got[("pdf", None)][1] and got[("eml", "1@x#2")][0] == "B"
    assert [tuple(r) for r in files.read_dat(spark, str(tmp_path / "d.dat")).select("begin_bates", "end_bates").collect()] == [("A1", "A2")]
