"""Identifiers, content classes, names, header blocks, mail families, reconciliation, jobs and entity decisions on small tables."""

import time
from datetime import datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from casebolt import adapters as A
from casebolt.functions import headers, identifiers, people, text
from casebolt.operators import conversations, entities, families, jobs, reconcile, search
from casebolt.plans.scope import Corpus, Scope, resolve
from casebolt.sources import files


def column(spark, f, values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(d.select("i", f("v")).collect())]


PHONES = {
    "+4420794612": "+4420794612", "5551234": None, "441234567890": "441234567890", "212-555-0199 x12 (office)": "+12125550199x12", "555-0199 ext 1234567": "5550199x1234567",
    "(212) 555-0199": "+12125550199", "12125550199": "+12125550199", "+1 212 555 0199": "+12125550199", "123": None, "1234567890123456": None, "": None, None: None, "call me": None, "２１２-555-0199": "+12125550199",
}
EMAILS = {
    "o#b@x.com": "o#b@x.com", "a&b@x.com": "a&b@x.com", "a=b/c@x.example": "a=b/c@x.example", "<Mailto:A.B@X.Example>;": "a.b@x.example", "a@b": None, "a b@x.com": None, "x@-x.com": None, "": None, None: None,
}


def test_identifiers(spark):
    assert column(spark, identifiers.phone, PHONES) == list(PHONES.values())
    assert column(spark, identifiers.email, EMAILS) == list(EMAILS.values())
    assert column(spark, identifiers.handle, ["@@ab", "@A b", "x", None]) == [None, "ab", None, None]
    assert column(spark, identifiers.nfkc, ["ﬁ", None]) == ["fi", None] and column(spark, identifiers.nfc, ["é"]) == ["é"]


def test_entity_types(spark):
    rows = [("Ann Berg", None), ("Ann", None), (None, "no-reply.x@x.com"), ("Help Desk", "ann@x.com"), ("Legal", "legal@x.com"), ("Berg Partners", "a@x.com"), ("Ann", "ann@x.com"), (None, None), ("Mr. Berg", None), ("Help Desk", None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, m string")
    got = [r[1] for r in sorted(d.select("i", entities.entity_type("n", "m")).collect())]
    assert got == ["person", "unknown", "system_mailbox", "shared_mailbox", "shared_mailbox", "organization", "person", "unknown", "unknown", "person"]


def test_content_classes(spark):
    names = {"a.sql": "Database", "a.JSON": "Database", "a.xml": "Web", "a.py": "Source Code", "a.png": "Image", "a.mp3": "Audio", "a.mp4": "Video", "a.zip": "Container", "a.rsmf": "Message", "a.md": "E-Doc", "a.qqq": None, "a": None, None: None}
    assert column(spark, text.content_type, names) == list(names.values())
    assert text.content_classes(more={"qqq": "CAD"})["qqq"] == "CAD"
    got = column(spark, lambda c: text.content_type_by_text(F.col(c)), ["x BEGIN:VCALENDAR", "plain", None])
    assert got == ["Calendar", None, None]


def test_unique_names(spark):
    assert column(spark, lambda c: text.unique_names(F.col(c)), [" b; a ;b;;", None]) == [["b", "a"], None]


def test_names():
    assert people.parse_name("Berg, Dr. Ann Maria") == {"given": "Ann", "middle": "Maria", "family": "Berg", "full_name": "ann maria berg", "sort_name": "berg ann maria", "is_full": True}
    assert people.parse_name("Ann") == {"given": "Ann", "middle": None, "family": None, "full_name": "ann", "sort_name": "ann", "is_full": False}
    assert people.parse_name("Mailbox Ann Berg")["full_name"] == "ann berg" and people.parse_name("a@x.com") is None and people.parse_name(" ") is None and people.parse_name(None) is None


def test_chunks_begin_an_overlap_before():
    t = ("word " * 900).strip() + "\n" + "x" * 5000
    got = text.chunk_spans(t)
    assert all(t[a:b] == piece for a, b, piece in got) and got[-1][1] == len(t) and all(b[0] <= a[1] for a, b in zip(got, got[1:]))
    assert text.chunk_spans("") == [] and text.chunk_spans(" \n ") == [] and text.chunk_spans("ab") == [(0, 2, "ab")]


PRINTED = "From: A B <a@x.example>\nTo: C; D\n  and E\nSubject: Hi\n\nText\n\nFrom: F\nSent: today\nFrom: G\nDate: now\nmore"


def test_header_blocks(spark):
    got = headers.header_blocks(PRINTED)
    assert got == [{"from": "A B <a@x.example>", "to": "C; D and E", "subject": "Hi"}, {"from": "F", "sent": "today"}, {"from": "G", "date": "now"}]
    assert headers.header_blocks("From: alone\n\ntext") == [] and headers.header_blocks(None) == [] and headers.header_blocks("To: x\nSubject: y") == []
    d = spark.createDataFrame([(1, PRINTED), (2, None), (3, "none")], "i int, t string")
    r = {x.i: x for x in d.select("i", headers.own_headers("t").alias("h"), headers.chain_people(headers.blocks("t")).alias("p")).collect()}
    assert r[1].h["subject"] == "Hi" and r[1].p == ["A B <a@x.example>", "C", "D and E", "F", "G"] and r[3].h["from"] is None and r[3].p == []


def message(number, answers=None, attach=True):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"], m["Message-ID"] = "Ann <ann@x.example>", "bob@x.example", "Plan", f"Mon, 0{number} Jan 2024 10:00:00 +0100", f"<{number}@x.example>"
    if answers:
        m["In-Reply-To"] = f"<{answers}@x.example>"
    m.set_content("body\n")
    if attach:
        m.add_attachment(b"a,b\n1,2\n", maintype="text", subtype="csv", filename="t.csv")
        m.add_attachment(b"PK\x03\x04zip", maintype="application", subtype="zip", filename="z.zip")
    return m


def test_mail_families_and_threads(spark, tmp_path):
    inner = message(3, answers=2)
    outer = message(1)
    outer.add_attachment(inner.as_bytes(), maintype="application", subtype="octet-stream", filename="m.eml")
    (tmp_path / "a.eml").write_bytes(outer.as_bytes())
    (tmp_path / "b.eml").write_bytes(message(2, answers=1, attach=False).as_bytes())
    (tmp_path / "c.zip").write_bytes(b"PK\x03\x04more")
    got = files.read_mails(files.scan(spark, str(tmp_path))).collect()
    rows = {r.item_id: r for r in got}
    assert rows["1@x.example/1"].content_type == "Spreadsheet / Table" and rows["1@x.example/1"].attachment_no == 1 and rows["1@x.example/1"].parent_item_id == "1@x.example"
    assert rows["1@x.example/2"].text_status == "unsupported" and rows["1@x.example/2"].content_type == "Container"
    assert rows["1@x.example/3"].message_id == "3@x.example" and rows["1@x.example/3/1"].parent_item_id == "1@x.example/3"
    t = conversations.thread_mail(files.threading_headers(files.read_mails(files.scan(spark, str(tmp_path))))).collect()
    assert len(t) == 2 and len({r.cluster for r in t}) == 1 and {r.how for r in t} == {"new", "reply"} and {r.conversation_key for r in t} == {"rfc:1@x.example"} and {r.display_name for r in t} == {"plan"}
    zipped = files.read_files(files.scan(spark, str(tmp_path), ["zip"])).first()
    assert zipped.text_status == "unsupported" and zipped.content_type == "Container" and zipped.text == ""


def test_content_decides_the_class():
    assert files.extract("txt", PRINTED.encode())[2] == "Email" and files.extract("txt", b"plain words")[2] == "E-Doc" and files.extract("qqq", b"what")[2] == "Other"
    assert files.extract("txt", b"[2024-01-01 10:00] Ann: hello\n[2024-01-01 10:01] Bob: hi")[2] == "Chat"
    assert files.extract("bin", b"\0\1\2")[1] == "unsupported"


def test_whole_files_are_read():
    """Beyond the first 200,000 bytes, 200 rows and 50 lines."""
    late = ("The quick brown fox jumps over the lazy dog near a river. " * 6000 + "Le café était déjà fermé à midi. " * 40).encode("cp1252")
    assert "café" in files.decode(late)[0]  # no word of it in the first 200,000 bytes
    lines = "\n".join(["x;y"] * 60 + ["p,q;r"] * 60)
    assert files.parse_delimited(lines)[100] == ["p,q", "r"]


def test_load_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("Begin Bates|EndBates|Custodian\nA1|A2|Ann\n")
    r = files.read_dat(spark, str(tmp_path / "a.dat")).first()
    assert (r.begin_bates, r.end_bates, r.custodian) == ("A1", "A2", "Ann")
    (tmp_path / "b.dat").write_bytes("þBegDocþ\x14þEndDocþ\nþB1þ\x14þB2þ\n".encode("latin-1"))
    assert files.read_dat(spark, str(tmp_path / "b.dat")).first().begin_bates == "B1"


def test_chat_names(spark, tmp_path):
    (tmp_path / "general").mkdir()
    (tmp_path / "general" / "2024-01-01.json").write_text('[{"type": "message", "ts": "1.0", "user": "U1", "text": "hi"}, {"type": "message", "ts": "2.0", "user": "U9", "text": "yo"}]')
    (tmp_path / "users.json").write_text('[{"id": "U1", "name": "ann", "profile": {"real_name": "Ann Berg"}}]')
    (tmp_path / "channels.json").write_text('[{"name": "general", "purpose": {"value": "all"}}]')
    got = {r.ts: (r.user_name, r.channel_purpose) for r in files.slack_names(spark, str(tmp_path), files.read_slack(spark, str(tmp_path))).collect()}
    assert got == {"1.0": ("Ann Berg", "all"), "2.0": ("U9", "all")}


def test_wide_spans(spark):
    """Numbers beyond 64 bits, around the edges of buckets and beside narrow ones."""
    big = 10**30
    spans = [(1, "s", big, big + 5), (2, "s", big + 2**70 - 1, big + 2**70 + 2**66), (3, "s", 5, 10**25), (4, "s", 7, 9), (5, "t", big, big)]
    points = [(10, "s", big), (11, "s", big + 5), (12, "s", big + 6), (13, "s", big + 2**70), (14, "s", 8), (15, "s", 10**25), (16, "t", big), (17, "s", 10**25 + 1)]
    s = spark.createDataFrame([(i, k, str(a), str(b)) for i, k, a, b in spans], "span long, series string, lo string, hi string").selectExpr("span", "series", "cast(lo as decimal(38,0)) lo", "cast(hi as decimal(38,0)) hi")
    p = spark.createDataFrame([(i, k, str(n)) for i, k, n in points], "point long, series string, n string").selectExpr("point", "series", "cast(n as decimal(38,0)) n")
    got = {tuple(r) for r in families.points_in_spans(p, s).collect()}
    assert got == {(i, j) for i, k, n in points for j, m, a, b in spans if k == m and a <= n <= b}


def test_virtual_fields_need_their_tables(spark):
    d = spark.createDataFrame([(1, "x")], "id long, subject string")
    m = spark.createDataFrame([(1, "ds")], "document_id long, dataset_name string")
    with pytest.raises(ValueError):
        resolve(Scope(filter="participant = 'a'"), Corpus(d, m))
    with pytest.raises(ValueError):
        resolve(Scope(filter="production_name = 'a'"), Corpus(d, m))
    who = spark.createDataFrame([(1, "participant", None, None, None), (1, "participant", "Ann B", 5, "Ann")], "document_id long, role string, raw_value string, entity_id long, label string")
    run = lambda f: resolve(Scope(filter=f), Corpus(d, m, people=who)).count()
    assert run("participant LIKE 'an%' AND raw_participants = 'Ann B' AND participant_entity_id = 5") == 1 and run("participant != 'Ann'") == 0 and run("custodian IS NULL AND subject = 'participant'") == 0


def test_reconciliation(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "y"), (4, None, None)], "id long, f string, g string")
    g = spark.createDataFrame([(1, 1, "ready"), (1, 2, "ready"), (1, 3, "ready"), (2, 4, "open")], "group_id long, document_id long, status string")
    docs, log = reconcile.reconcile(d, g, ["f", "g"])
    assert {r.id: r.merged_into for r in docs.collect()} == {1: 2, 2: None, 3: 2, 4: None}
    assert {tuple(r) for r in log.collect()} == {(1, 3, "f", "a", "b"), (1, 3, "g", "x", "y")}
    assert reconcile.reconcile(d.limit(0), g.limit(0), ["f"])[1].count() == 0
    ds = spark.createDataFrame([(1, "One"), (2, "Two")], "dataset_id long, name string")
    assert {r.name for r in reconcile.rename_dataset(ds, 1, " New  name ").collect()} == {"New name", "Two"}
    for bad in ("two", " "):
        with pytest.raises(ValueError):
            reconcile.rename_dataset(ds, 1, bad)


def test_entity_decisions(spark):
    e = spark.createDataFrame([(1, "A", "person", "observed", "active", None), (2, "B", "person", "observed", "active", None)], "entity_id long, display_name string, entity_type string, entity_origin string, canonical_status string, merged_into long")
    none = spark.createDataFrame([], "left_entity_id long, right_entity_id long")
    b = entities.block(none, 2, 1)
    assert [tuple(r) for r in b.collect()] == [(1, 2)]
    pair = spark.createDataFrame([(2, 1), (1, 1)], "source_id long, target_id long")
    assert {r.entity_id: r.merged_into for r in entities.merge(e, pair, b).collect()} == {1: None, 2: None}
    assert {r.entity_id: r.merged_into for r in entities.merge(e, pair, none).collect()} == {1: None, 2: 1}
    i = spark.createDataFrame([(10, 1), (11, 1)], "identifier_id long, entity_id long")
    es, moved = entities.split(e, i, 1, [11])
    assert es.count() == 3 and {r.identifier_id: r.entity_id for r in moved.collect()} == {10: 1, 11: 3}
    with pytest.raises(ValueError):
        entities.split(e, i, 2, [11])
    new = entities.edit(e, spark.createDataFrame([(2, None), (9, "Nine")], "entity_id long, display_name string"), ["display_name"])
    assert {r.entity_id: (r.display_name, r.entity_origin) for r in new.collect()} == {1: ("A", "observed"), 2: ("B", "observed"), 9: ("Nine", "manual")}


def test_jobs(spark):
    assert jobs.identifier(" 9 Lives! ") == "job_9_lives" and jobs.reasons(Scope()) == []
    with pytest.raises(ValueError):
        jobs.identifier("!!")
    docs = spark.createDataFrame([(1, None)], "id long, active_revision_id long")
    rev = spark.createDataFrame([(7, 1, "text one"), (8, 2, "other")], "revision_id long, document_id long, text string")
    want = lambda r, by_job=False: spark.createDataFrame([(1, r, 1, by_job)], "document_id long, revision_id long, activated_at int, by_job boolean")
    out, chunks = jobs.activate(docs, rev, want(7))
    assert out.first().active_revision_id == 7 and chunks.first().text_content == "text one"
    assert jobs.activate(docs, rev, want(7, True))[1].count() == 0 and jobs.activate(docs, rev, want(7, True), "always")[1].count() == 1
    with pytest.raises(ValueError):
        jobs.activate(docs, rev, want(8))


def test_threads_equal_one_sequential_run(spark, sf):
    mail = A.threaded(spark, sf)
    pdf = mail.toPandas()
    want = {r.id: (r.cluster, r.how) for r in conversations.cascade(pdf).itertuples()}
    got = {r.id: (r.cluster, r.how) for r in conversations.thread_mail(mail).collect()}
    assert got == want and {"reply", "references", "index", "message", "manual", "new"} <= {h for _, h in got.values()}


def test_threads_take_no_call_a_component(spark):
    """Components are worked off by partition, and one subject of many mails in less than its square."""
    s = "id long, date string, message_id string, in_reply_to string, references array<string>, index_root string, topic string, subject string, people array<string>, custodian string, manual string"
    rows = [(i, "2020-01-01", f"m{i}", f"m{i - 1}" if i % 3 else None, [], None, None, "hi", ["a"], "c", None) for i in range(300)] + [(1000 + i, "2020-01-02", None, None, [], None, None, "weekly", [f"p{i % 2000}"], None, None) for i in range(6000)]
    df = conversations.thread_mail(spark.createDataFrame(rows, s))
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    began = time.monotonic()
    got = {r.id: (r.cluster, r.how) for r in df.collect()}
    assert time.monotonic() - began < 60
    assert len(got) == 6300 and got[5] == (3, "reply") and got[3] == (3, "new") and got[1001] == (1001, "new") and got[5001] == (1001, "subject")


def test_written_index(spark):
    from casebolt.common import Scratch

    d = spark.createDataFrame([(1, "audit ledger audit"), (2, "ledger"), (3, None), (4, "")], "id long, text string")
    i = search.build(d, "id", ["text"], Scratch(spark, "t"))
    postings = search.index(d, "id", ["text"])
    for q in ("audit", "ledger NOT audit", '"ledger audit"', "led*"):
        assert sorted(map(tuple, search.rank(i, q).collect())) == sorted(map(tuple, search.rank(postings, q).collect()))
    plan = i.postings.where("term = 'audit'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,audit)" in plan


def test_unseen_messages_are_retired(spark):
    at = datetime(2024, 1, 2)
    rows = [(1, None, "s", at, "active"), (2, None, "s", None, "active"), (3, 2, "s", at, "active"), (4, None, "t", None, "active"), (5, None, "s", None, "deleted")]
    c = spark.createDataFrame(rows, "id long, parent_id long, source string, last_seen_at timestamp, lifecycle_status string")
    got = {r.id: r.lifecycle_status for r in reconcile.retire_unseen(c, "s", F.lit(at)).collect()}
    assert got == {1: "active", 2: "deleted", 3: "deleted", 4: "active", 5: "deleted"}
