"""Files to text: a scan of a folder, one parser for each extension, errors as rows.

Bytes come through Spark's binaryFile source; parsing runs in mapInArrow, so a damaged file becomes a row with an error and never
ends a task. PDF, MSG, XLS and PST need parsers that are not installed: their rows say so.
"""

from __future__ import annotations

import csv
import email
import email.policy
import email.utils
import hashlib
import io
import json
import re
import zipfile
from datetime import timezone
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebolt.functions import identifiers
from casebolt.functions.headers import OWN_LINES, header_blocks
from casebolt.functions.text import clean_text, content_classes, strip_html_text
from casebolt.operators.conversations import is_chat

NO_PARSER = {"pdf", "msg", "xls", "pst", "doc", "ppt"}


def scan(spark: SparkSession, root: str, types: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, extension, size, modified_at, content of the files below a folder; hidden files and files without extension are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    df = df.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1))).where("extension <> '' and not path rlike '/\\\\.[^/]+$'")
    return (df.where(F.col("extension").isin(*types)) if types else df).select("path", "extension", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")


def decode(data: bytes, declared: str | None = None) -> tuple[str, str]:
    """(text, ok|partial): the declared encoding, UTF-8 with or without mark, UTF-16 by mark, then a detector, else replacement."""
    for enc in (declared, "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else None, "utf-8-sig"):
        if enc:
            try:
                return data.decode(enc), "ok"
            except (UnicodeDecodeError, LookupError):
                pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
        if best is not None:
            return data.decode(best.encoding), "ok"
    except (ImportError, UnicodeDecodeError, LookupError):
        pass
    return data.decode("utf-8", "replace"), "partial"


def parse_rtf(data: bytes) -> str:
    """Text of an RTF file: groups that hold no text are skipped, paragraphs become lines, escapes their characters."""
    src = data.decode("latin-1")
    out, stack, skip, i, uc = [], [], False, 0, 1
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "listtable"}
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", src):
        word, num, hexa, sym, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word:
            if word in hidden:
                skip = True
            elif not skip:
                if word in ("par", "line", "sect", "page"):
                    out.append("\n")
                elif word in ("tab", "cell"):
                    out.append("\t")
                elif word == "row":
                    out.append("\n")
                elif word == "u" and num:
                    out.append(chr(int(num) % 65536))
                    i = m.end()
                    uc = 1
        elif sym == "*":
            skip = True
        elif not skip:
            if hexa:
                out.append(bytes([int(hexa, 16)]).decode("cp1252", "replace") if not (m.start() == i and uc) else "")
            elif sym and sym in "\\{}~":
                out.append(" " if sym == "~" else sym)
            elif plain:
                out.append(plain[1:] if m.start() == i and plain[:1] == "?" else plain)
    return clean_text("".join(out))


def _xml_text(z: zipfile.ZipFile, name: str, para: str, run: str) -> str:
    root = ET.fromstring(z.read(name))
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    return "\n".join("".join("\t" if local(r) == "tab" else (r.text or "") for r in p.iter() if local(r) in (run, "tab")) for p in root.iter() if local(p) == para)


def parse_docx(data: bytes) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        meta = {}
        if "docProps/core.xml" in z.namelist():
            for e in ET.fromstring(z.read("docProps/core.xml")):
                meta[e.tag.rsplit("}", 1)[-1]] = (e.text or "").strip()
        return clean_text(_xml_text(z, "word/document.xml", "p", "t")), meta


def parse_pptx(data: bytes) -> str:
    """Slide texts in slide order, shapes from top to bottom and left to right, notes after their slide."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        no = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        out = []
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=no):
            shapes = []
            for sp in ET.fromstring(z.read(name)).iter():
                if local(sp) == "sp":
                    off = next((e for e in sp.iter() if local(e) == "off"), None)
                    at = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
                    text = "\n".join("".join(t.text or "" for t in p.iter() if local(t) == "t") for p in sp.iter() if local(p) == "p").strip()
                    if text:
                        shapes.append((at, text))
            out.append("\n".join(t for _, t in sorted(shapes, key=lambda s: s[0])))
            notes = f"ppt/notesSlides/notesSlide{no(name)}.xml"
            if notes in z.namelist():
                out.append(_xml_text(z, notes, "p", "t"))
        return clean_text("\n\n".join(x for x in out if x.strip()))


def kind_of_values(values: list[str]) -> str:
    """Kind of a table column from its non-empty values: boolean, integer, real, date, else text."""
    v = [x.strip() for x in values if x and x.strip()]
    if not v:
        return "empty"
    for kind, p in (("boolean", r"(?i)true|false|yes|no"), ("integer", r"[-+]?\d{1,3}(,\d{3})*|[-+]?\d+"), ("real", r"[-+]?(\d+|\d{1,3}(,\d{3})*)?\.\d+([eE][-+]?\d+)?|[-+]?\d+[eE][-+]?\d+"), ("date", r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}\.\d{1,2}\.\d{4}")):
        if all(re.fullmatch(p, x) for x in v):
            return kind
    if all(re.fullmatch(r"[-+]?[\d,]*\.?\d+", x) for x in v):
        return "real"
    return "text"


def parse_xlsx(data: bytes) -> str:
    """A summary of the sheets: their header with kinds, from all rows, and defined names."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"]
        book = ET.fromstring(z.read("xl/workbook.xml"))
        names = [e.get("name") for e in book.iter() if local(e) == "sheet"]
        out = []
        for k, name in enumerate(names, 1):
            part = f"xl/worksheets/sheet{k}.xml"
            if part not in z.namelist():
                continue
            table = []
            for row in (e for e in ET.fromstring(z.read(part)).iter() if local(e) == "row"):
                cells = {}
                for c in row:
                    v = next((e for e in c.iter() if local(e) in ("v", "t")), None)
                    text = "" if v is None or v.text is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    col = 0
                    for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                        col = col * 26 + ord(ch) - 64
                    cells[col] = text
                table.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
            out.append(f"Sheet: {name}\n" + describe_table(table))
        defined = [e.get("name") for e in book.iter() if local(e) == "definedName"]
        return "\n\n".join(out + (["Names: " + ", ".join(defined)] if defined else []))


def header_like(first: list[str], rest: list[list[str]]) -> bool:
    """A first row is a header if its cells are distinct, filled and no numbers or dates while some column below is."""
    f = [x.strip() for x in first]
    if not f or not all(f) or len(set(f)) < len(f) or any(kind_of_values([x]) in ("integer", "real", "date") for x in f):
        return False
    return not rest or any(kind_of_values([r[i] for r in rest if i < len(r)]) not in ("text", "empty") for i in range(len(f))) or all(len(x) < 40 for x in f)


def describe_table(table: list[list[str]]) -> str:
    if not table:
        return "(empty)"
    head, body = (table[0], table[1:]) if header_like(table[0], table[1:]) else ([f"column_{i + 1}" for i in range(len(table[0]))], table)
    return ", ".join(f"{h} ({kind_of_values([r[i] for r in body if i < len(r)])})" for i, h in enumerate(head))


def parse_delimited(text: str) -> list[list[str]]:
    """Rows of a delimited text: a sep= line names the delimiter, else it is the most even one of comma, tab, semicolon, pipe."""
    m = re.match(r"^\ufeff?sep=(.)\r?\n", text, re.I)
    if m:
        text, delim = text[m.end() :], m[1]
    else:
        def even(d):
            n = [len(r) for r in csv.reader(io.StringIO(text), delimiter=d) if any(x.strip() for x in r)]
            return (min(n) > 1, -len(set(n)), min(n)) if n else (False, 0, 0)

        delim = max(",\t;|", key=even)
    return [r for r in csv.reader(io.StringIO(text), delimiter=delim) if any(x.strip() for x in r)]


def header_date(value: str | None) -> str | None:
    if not value:
        return None
    try:
        d = email.utils.parsedate_to_datetime(value)
        return d.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if d.tzinfo else d.strftime("%Y-%m-%dT%H:%M:%S")
    except (TypeError, ValueError):
        return value


def parse_mail(data: bytes) -> dict:
    """Headers, body (plain before HTML), attachments and threading of one message. Images that the HTML shows inline are no
    attachments; calendar parts are listed apart."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    plain, rich, files, cal = None, None, [], []
    for p in m.walk():
        if p.is_multipart():
            continue
        kind, name = p.get_content_type(), p.get_filename()
        try:
            body = p.get_payload(decode=True) or b""
        except (ValueError, AssertionError):
            body = b""
        if kind == "text/calendar":
            cal.append(decode(body, p.get_content_charset())[0])
        elif name or (p.get_content_disposition() == "attachment"):
            files.append((name or "attachment", kind, body, str(p.get("Content-ID") or "").strip("<>")))
        elif kind == "text/plain" and plain is None:
            plain = decode(body, p.get_content_charset())[0]
        elif kind == "text/html" and rich is None:
            rich = decode(body, p.get_content_charset())[0]
    shown = set(re.findall(r"cid:([^\"'>\s]+)", rich or ""))
    files = [(n, k, b) for n, k, b, cid in files if not (k.startswith("image/") and cid and cid in shown)]
    h = lambda k: str(m[k]) if m[k] is not None else None
    return {
        "message_id": (h("Message-ID") or "").strip().strip("<>").lower() or None, "in_reply_to": (h("In-Reply-To") or "").strip().strip("<>").lower() or None,
        "references": list(dict.fromkeys(x.lower() for x in re.findall(r"<([^<>\s]+)>", h("References") or ""))), "thread_index": h("Thread-Index"), "thread_topic": h("Thread-Topic"),
        "subject": h("Subject"), "from": h("From"), "to": h("To"), "cc": h("Cc"), "bcc": h("Bcc"), "date": header_date(h("Date")),
        "text": clean_text(plain) if plain and plain.strip() else strip_html_text(rich) if rich else "",
        "attachments": [n for n, _, _ in files], "parts": files, "calendars": cal,
    }


def split_mbox(data: bytes) -> list[bytes]:
    """The messages of an mbox: From lines begin them, >From lines in bodies lose one mark."""
    parts = re.split(rb"(?m)^From [^\r\n]*\r?\n", b"\n" + data)
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", p).strip(b"\r\n") + b"\n" for p in parts[1:] if p.strip()]


def unfold(text: str) -> list[str]:
    return re.sub(r"\r?\n[ \t]", "", text).splitlines()


def parse_ics(text: str) -> list[dict]:
    """The events of a calendar: summary, start, end (with zone), organizer, attendees, location, status."""
    out, now = [], None
    for line in unfold(text):
        m = re.match(r'^([A-Za-z-]+)((?:;[^:;="]+=(?:"[^"]*"|[^:;"]*))*):(.*)$', line)
        if not m:
            continue
        name, params, value = m[1].upper(), dict(x.split("=", 1) for x in re.findall(r';([^:;="]+=(?:"[^"]*"|[^:;"]*))', m[2])), m[3]
        value = re.sub(r"\\([\;,nN])", lambda e: "\n" if e[1] in "nN" else e[1], value)
        if name == "BEGIN" and value.upper() == "VEVENT":
            now = {"attendees": []}
        elif name == "END" and value.upper() == "VEVENT" and now is not None:
            out.append(now)
            now = None
        elif now is not None:
            person = (params.get("CN", "").strip('"') + " <" + re.sub(r"(?i)^mailto:", "", value) + ">").strip()
            if name == "ATTENDEE":
                now["attendees"].append(person)
            elif name == "ORGANIZER":
                now["organizer"] = person
            elif name in ("DTSTART", "DTEND"):
                now[name[2:].lower()] = value
                if "TZID" in params:
                    now["zone"] = params["TZID"].strip('"')
            elif name in ("SUMMARY", "LOCATION", "STATUS", "DESCRIPTION", "UID"):
                now[name.lower()] = value
    return out


def extract(extension: str, data: bytes) -> tuple[str, str, str]:
    """(text, text_status, content_type) of one file."""
    if extension in NO_PARSER:
        raise NotImplementedError(f"parser unavailable: {extension}")
    if extension == "docx":
        return parse_docx(data)[0], "ok", "E-Doc"
    if extension == "pptx":
        return parse_pptx(data), "ok", "Presentation"
    if extension == "xlsx":
        return parse_xlsx(data), "ok", "Spreadsheet / Table"
    if extension == "rtf":
        return parse_rtf(data), "ok", "E-Doc"
    if extension == "eml":
        m = parse_mail(data)
        return m["text"], "ok", "Email"
    kind = CLASSES.get(extension)
    if kind == "Image" and extension != "svg":
        return "", "empty", "Image"
    if kind in ("Container", "Audio", "Video", "CAD") or (b"\0" in data and data[:2] not in (b"\xff\xfe", b"\xfe\xff")):
        return "", "unsupported", kind or "Other"  # left closed
    text, status = decode(data)
    if extension in ("csv", "tsv"):
        return describe_table(parse_delimited(text)), status, "Spreadsheet / Table"
    if kind == "Web" and extension != "xml":
        return strip_html_text(text), status, "Web"
    if kind == "Calendar":
        return "\n\n".join("\n".join(f"{k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in e.items()) for e in parse_ics(text)), status, "Calendar"
    text = clean_text(text)
    shown = kind_by_content(extension, text) if kind in ("E-Doc", "Web", None) else None
    return text, status, shown or kind or "Other"


CLASSES = content_classes()


def kind_by_content(extension: str, text: str) -> str | None:
    """Class that a text itself shows: Email by the headers it begins with, Chat by its lines, Calendar by its first ones."""
    if header_blocks(text, OWN_LINES):
        return "Email"
    if is_chat(text):
        return "Chat"
    head = text[:4000].upper()
    return "Calendar" if "BEGIN:VCALENDAR" in head or "BEGIN:VEVENT" in head or (extension == "xml" and "<VCALENDAR" in head) else None


_FILE_ROWS = "path string, item_id string, extension string, size long, file_hash string, content_type string, text_status string, text string, error string"


def read_files(files: DataFrame) -> DataFrame:
    """One row for each file, one for each message of an mbox (item_id its message id, or its digest; repeats get #2, #3 …)."""

    def rows_of(path, ext, size, data):
        digest = hashlib.sha256(data).hexdigest()
        if ext == "mbox":
            seen: dict[str, int] = {}
            for part in split_mbox(data):
                m = parse_mail(part)
                item = m["message_id"] or hashlib.sha256(part).hexdigest()
                seen[item] = seen.get(item, 0) + 1
                yield path, item if seen[item] == 1 else f"{item}#{seen[item]}", "eml", len(part), hashlib.sha256(part).hexdigest(), "Email", "ok" if m["text"] else "empty", m["text"], None
            return
        try:
            text, status, kind = extract(ext, data)
            yield path, None, ext, size, digest, kind, status if text or status == "unsupported" else "empty", text, None
        except Exception as e:
            yield path, None, ext, size, digest, None, "failed", None, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            rows = [r for x in zip(*(c.to_pylist() for c in b.columns)) for r in rows_of(*x)]
            cols = list(zip(*rows)) or [()] * 9
            types = [pa.string(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _FILE_ROWS.split(", ")])

    return files.select("path", "extension", "size", "content").mapInArrow(run, _FILE_ROWS)


_HEADERS = ("message_id", "in_reply_to", "thread_index", "thread_topic", "subject", "from", "to", "cc", "bcc", "date")
_MAIL_ROWS = "path string, item_id string, parent_item_id string, attachment_no int, file_name string, content_type string, text_status string, text string, file_hash string, size long, error string, references array<string>, " + ", ".join(f"`{h}` string" for h in _HEADERS)


def mail_rows(path: str, data: bytes) -> list[dict]:
    """A message and its attachments as rows: the attachments are its children, numbered from 1 in their order and parsed by their
    extension; an attached message has its own children. A part that cannot be parsed has an error."""
    out: list[dict] = []

    def add(raw: bytes, item: str | None, parent: str | None, number: int | None, name: str | None) -> None:
        m = parse_mail(raw)
        digest = hashlib.sha256(raw).hexdigest()
        item = item or m["message_id"] or digest
        out.append({"path": path, "item_id": item, "parent_item_id": parent, "attachment_no": number, "file_name": name, "content_type": "Email", "text_status": "ok" if m["text"] else "empty", "text": m["text"], "file_hash": digest, "size": len(raw), "references": m["references"]} | {h: m[h] for h in _HEADERS})
        for k, (part, kind, body) in enumerate(m["parts"], 1):
            child = f"{item}/{k}"
            ext = (re.search(r"\.([A-Za-z0-9]{1,8})$", part) or ["", ""])[1].lower()
            if ext == "eml" or kind == "message/rfc822":
                add(body, child, item, k, part)
                continue
            row = {"path": path, "item_id": child, "parent_item_id": item, "attachment_no": k, "file_name": part, "file_hash": hashlib.sha256(body).hexdigest(), "size": len(body)}
            try:
                text, status, kind = extract(ext, body)
                out.append(row | {"content_type": kind, "text_status": status if text else "unsupported" if status == "unsupported" else "empty", "text": text})
            except Exception as e:
                out.append(row | {"text_status": "failed", "error": f"{type(e).__name__}: {e}"})

    add(data, None, None, None, None)
    return out


def read_mails(files: DataFrame) -> DataFrame:
    """Messages of .eml and .mbox files with their headers, and their attachments as child rows (``mail_rows``)."""
    names = [x.strip().split(" ")[0].strip("`") for x in _MAIL_ROWS.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for path, ext, data in zip(*(c.to_pylist() for c in b.columns)):
                for part in split_mbox(data) if ext == "mbox" else [data]:
                    try:
                        rows += mail_rows(path, part)
                    except Exception as e:
                        rows.append({"path": path, "text_status": "failed", "error": f"{type(e).__name__}: {e}"})
            types = {"attachment_no": pa.int32(), "size": pa.int64(), "references": pa.list_(pa.string())}
            yield pa.record_batch([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

    return files.where("extension in ('eml', 'mbox')").select("path", "extension", "content").mapInArrow(run, _MAIL_ROWS)


def threading_headers(mails: DataFrame) -> DataFrame:
    """The messages of read_mails in the shape that conversations.thread_mail takes. Attachments have no threading of their own."""
    people = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "from", "to", "cc", "bcc")), F.lit("([a-z0-9._%+-]+@[a-z0-9.-]+)"), F.lit(1))))
    none = F.lit(None).cast("string")
    return mails.where("parent_item_id is null and error is null").select(
        F.xxhash64("path", "item_id").alias("id"), "date", "message_id", "in_reply_to", "references", identifiers.index_root("thread_index").alias("index_root"), F.col("thread_topic").alias("topic"),
        identifiers.subject("subject").alias("subject"), people.alias("people"), none.alias("custodian"), none.alias("manual"), "item_id",
    )


# ---- structured exports
# Names of load file columns.
LOAD_COLUMNS = {
    "begin_bates": ["begbates", "beginbates", "begdoc", "begno", "beginbatesno", "prodbeg", "batesbegin", "firstbates", "bates_begin"],
    "end_bates": ["endbates", "enddoc", "endno", "prodend", "batesend", "lastbates", "bates_end"],
    "begin_attachment": ["begattach", "beginattachment", "begatt", "attachbegin", "prodbegattach"],
    "end_attachment": ["endattach", "endattachment", "endatt", "attachend", "prodendattach"],
    "native_path": ["nativepath", "nativelink", "nativefile", "filepath"],
    "text_path": ["textpath", "textlink", "extractedtext", "ocrpath", "fulltext"],
}


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """A load file: Concordance (fields parted by \\x14, quoted by þ, Latin-1), or if its header has no \\x14, parted by whichever of comma, tab,
    pipe and semicolon the header has most of (UTF-8, double quotes). Known column names become the standard ones."""
    head = (spark.read.option("encoding", "ISO-8859-1").text(path).first() or [""])[0]  # the header line
    if "\x14" in head:
        df = spark.read.csv(path, sep="\x14", quote="þ", encoding="ISO-8859-1", header=True)
    else:
        df = spark.read.csv(path, sep=max(",\t|;", key=head.count), header=True, multiLine=True, escape='"')
    key = lambda c: re.sub(r"[^a-z0-9_]", "", c.lower())
    to = {a: k for k, v in LOAD_COLUMNS.items() for a in (*v, k, k.replace("_", ""))}
    return df.select(*[F.col(f"`{c}`").alias(to.get(key(c), key(c))) for c in df.columns])


def read_opt(spark: SparkSession, path: str) -> DataFrame:
    """A page image list: page_bates, volume, image_path, first_page."""
    df = spark.read.csv(path, schema="page_bates string, volume string, image_path string, first string, folder string, box string, pages string")
    return df.where("page_bates is not null and image_path is not null").select(F.trim("page_bates").alias("page_bates"), "volume", F.regexp_replace("image_path", r"\\", "/").alias("image_path"), (F.upper(F.trim("first")) == "Y").alias("first_page"))


def read_slack(spark: SparkSession, root: str) -> DataFrame:
    """channel, ts, thread_ts, user, text, reply_count of an export's day files."""
    df = spark.read.schema("type string, ts string, thread_ts string, user string, text string, reply_count long").json(f"{root}/*/*.json", multiLine=True).withColumn("path", F.input_file_name())
    return df.where("type = 'message'").select(F.regexp_extract("path", r"/([^/]+)/[^/]+\.json$", 1).alias("channel"), "ts", "thread_ts", "user", "text", "reply_count")


def slack_names(spark: SparkSession, root: str, messages: DataFrame) -> DataFrame:
    """Messages of read_slack with user_name (real name, else display name, else the id) from users.json and channel_purpose from channels.json."""
    u = spark.read.schema("id string, name string, real_name string, profile struct<real_name:string,display_name:string>").json(f"{root}/users.json", multiLine=True)
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    users = u.select(F.col("id").alias("user"), F.coalesce(full("profile.real_name"), full("real_name"), full("profile.display_name"), full("name")).alias("_name")).dropDuplicates(["user"])
    c = spark.read.schema("name string, purpose struct<value:string>").json(f"{root}/channels.json", multiLine=True)
    channels = c.select(F.col("name").alias("channel"), F.col("purpose.value").alias("channel_purpose")).dropDuplicates(["channel"])
    return messages.join(users, "user", "left").join(channels, "channel", "left").withColumn("user_name", F.coalesce("_name", "user")).drop("_name")


def read_sidecar(spark: SparkSession, path: str, need: list[str], kind: str = "csv") -> DataFrame:
    """A mail export's metadata table; a file without the needed columns is refused."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in df.columns}
    missing = [n for n in need if n.lower() not in have]
    if missing:
        raise ValueError(f"{kind} without column {missing[0]}")
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in have.items()])


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML manifest."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def to_json_list(values) -> str:
    return json.dumps(list(values), ensure_ascii=False)
