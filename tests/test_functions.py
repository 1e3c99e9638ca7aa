"""Scalar functions and parsers that need no Spark, and properties of them."""

import io
import zipfile
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casebolt.functions import bates, text
from casebolt.operators import packed, search
from casebolt.plans import fields, filters
from casebolt.plans.scope import Scope, Session
from casebolt.sources import files


@given(st.text(alphabet=st.sampled_from("ab \n\tüé.\0\r"), max_size=12_000))
@settings(max_examples=40, deadline=None)
def test_chunks_cover_the_text(t):
    clean = text.clean_text(t)
    spans = text.chunk_spans(t)
    assert all(clean[s:e] == c and 0 < e - s <= text.CHUNK_SIZE for s, e, c in spans)
    covered = set()
    for s, e, _ in spans:
        covered.update(range(s, e))
    assert all(c.isspace() for i, c in enumerate(clean) if i not in covered)


def test_chunk_of_one_long_word():
    assert [(s, e) for s, e, _ in text.chunk_spans("x" * 7000)] == [(0, 3200), (2950, 6150), (5900, 7000)]
    assert text.chunk_spans("") == [] and text.chunk_spans(" \n ") == []


def test_bates_routing():
    assert bates.parse_query("2024") == ("2024", "2024")
    assert bates.parse_query("covid-19") == ("covid-19", "covid-19")
    assert bates.parse_query("ABC-001-ABC-010") == ("ABC-001-ABC-010",) * 2
    assert bates.parse_query("ABC-001 - ABC-010") == ("ABC-001", "ABC-010")
    assert bates.parse_query("contract terms") is None
    assert bates.within(("A001", "A100"), ("A050", "A200")) == ("A050", "A100")
    assert bates.within(("A001", "A010"), ("A011", "A012")) is None and bates.within(("A1", "A9"), ("A01", "A09")) is None


def test_query_parser():
    q = search.parse_query('a AND (b OR "c d") NOT e* title:f')
    assert q.kind == "and" and search._terms(q)[0].words == ("a",)
    assert search.parse_query("foo-bar").words == ("foo", "bar")
    for bad in ('"', "(a", "a AND", "AND"):
        with pytest.raises(search.QueryError):
            search.parse_query(bad)


def test_filter_tokens():
    with pytest.raises(filters.FilterError):
        filters.tokens("a" * 9000)
    assert filters.tokens("""a = 'it''s' AND b >= -2.5""") == [("name", "a"), ("op", "="), ("text", "it's"), ("word", "and"), ("name", "b"), ("op", ">="), ("number", -2.5)]


def test_field_names():
    assert fields.sanitize("Due Date!") == "due_date" and fields.sanitize("2nd pass") == "field_2nd_pass"
    assert [fields.declared_kind(x) for x in ("TIMESTAMP", "BIGINT", "DOUBLE", "VARCHAR")] == ["date", "integer", "real", "text"]


def test_session_round_trip(tmp_path):
    s = Session()
    s.set_scope(Scope().search("audit").where("lang = 'en'").search("ledger", within=True))
    assert s.scope.keyword == "(audit) AND (ledger)" and s.scope.filter == "lang = 'en'"
    s.page, s.page_size = 3, 20
    s.save(" my  scope ")
    s.set_scope(Scope())
    assert s.page == 1
    s.recall("my scope")
    p = str(tmp_path / "s.json")
    s.write(p)
    assert Session.read(p) == s
    (tmp_path / "s.json").write_text("{broken")
    assert Session.read(p) == Session()


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a, b", ["a", "b"]), ('"Hold, legal";Hot', ["Hold, legal", "Hot"]), ('["Unread", "To-do (urgent)"]', ["Unread", "To-do (urgent)"]), ("Hold\\, legal,Hot", ["Hold, legal", "Hot"]),
        ("'Tax; 2nd; draft','Sent'", ["Tax; 2nd; draft", "Sent"]), ('"Needs ""second"" look"\tA', ['Needs "second" look', "A"]), (";A; ;B;", ["A", "B"]), ("Vendor's copy|A", ["Vendor's copy", "A"]), ("", []), (" ; ", []),
    ],
)
def test_label_parses(raw, want):
    assert want == [] and not [p for p in packed.label_parses(raw) if p[2]] or want in [p[2] for p in packed.label_parses(raw)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('"Mergar, Dorothea" <D.M@x.example>', ["d.m@x.example"]), ("Senkor, Kenji;\nFenlor, Amara", ["Senkor, Kenji", "Fenlor, Amara"]), ("a@x.example, B <b@y.example>;c@z.example (C)", ["a@x.example", "b@y.example", "c@z.example"]),
        ("undisclosed-recipients:;", []), ('"Katherine ""Kat"" Merhol"', ['Katherine "Kat" Merhol']), ("Torval, Oluwaseun <o@x.example>; X Y", ["o@x.example", "X Y"]), ("A B,, c@x.example", ["A B", "c@x.example"]),
    ],
)
def test_address_parses(raw, want):
    got = [p[2] for p in packed.address_parses(raw)]
    assert want in got or (want == [] and not any(got))


def test_mail_and_mbox():
    m = files.parse_mail(b"From: A <a@x.example>\nTo: b@y.example\nSubject: Re: Hi\nDate: Fri, 24 Dec 2021 22:06:53 -0500\nMessage-ID: <M1@x>\nIn-Reply-To: <M0@x>\nReferences: <M0@x> <m0@X>\n\nHello\n")
    assert m["message_id"] == "m1@x" and m["references"] == ["m0@x"] and m["date"] == "2021-12-25T03:06:53Z" and m["text"] == "Hello"
    assert len(files.split_mbox(b"From a\nSubject: 1\n\n>From here\n\nFrom b\nSubject: 2\n\nx\n")) == 2
    assert b"\nFrom here" in files.split_mbox(b"From a\nSubject: 1\n\n>From here\n")[0]


def test_office_and_text_formats():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>')
    assert files.extract("docx", b.getvalue())[0] == "One\nTwo"
    assert files.parse_rtf(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par W\'f6rld}") == "Hello\nWörld"
    assert files.describe_table(files.parse_delimited("sep=;\nname;n;when\na;1;2020-01-02\nb;2;2021-03-04\n")) == "name (text), n (integer), when (date)"
    assert files.decode("é".encode("utf-16"))[0] == "é" and files.decode(b"abc") == ("abc", "ok")
    e = files.parse_ics("BEGIN:VEVENT\r\nSUMMARY:A\\, b\r\n c\r\nDTSTART;TZID=Europe/Berlin:20240101T100000\r\nATTENDEE;CN=X:mailto:x@y\r\nEND:VEVENT")
    assert e == [{"attendees": ["X <x@y>"], "summary": "A, bc", "start": "20240101T100000", "zone": "Europe/Berlin"}]
    assert text.strip_html_text("<style>x</style><p>A&amp;B<br>c</p>") == "A&B\nc"
    with pytest.raises(NotImplementedError):
        files.extract("pdf", b"")


def _utc(local: datetime, zone: str) -> str:
    return local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
