"""Text functions: white space, folding and tokens, HTML, chunks, slugs, content classes."""

from __future__ import annotations

import html
import mimetypes
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk size, overlap and the zones in which a chunk end looks for a line end or a blank.
CHUNK_SIZE, CHUNK_OVERLAP = 3200, 250
LEAST_FILL, LINE_ZONE, BLANK_ZONE = 400, 500, 250


def normalize_whitespace(c) -> Column:
    """CRLF to LF, no NUL, no blanks at line ends, at most one empty line, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\u0000", "")
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalize_inline(c) -> Column:
    """Every run of white space one blank, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def token_estimate(c) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def slug(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "item").otherwise(s)


def fold(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    return "".join(x for x in unicodedata.normalize("NFD", text) if not unicodedata.combining(x)).lower()


_SPLIT = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    return _SPLIT.findall(fold(text)) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(s):
    """Folded letter and digit runs, the units of keyword search."""
    return s.map(lambda x: tokens_of(x) if isinstance(x, str) else None)


_TAGS = re.compile(r"<[^>]*>")
_BLOCK_ENDS = re.compile(r"(?i)<\s*br\s*/?>|</\s*(?:p|div|li|tr|h[1-6]|table|blockquote)\s*>")
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")


def strip_html_text(source: str) -> str:
    t = html.unescape(_TAGS.sub("", _BLOCK_ENDS.sub("\n", _HIDDEN.sub(" ", source))))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\xa0]*\n[ \t\xa0]*", "\n", re.sub(r"[ \t\xa0]+", " ", t.replace("\r", "")))).strip()


@F.pandas_udf(T.StringType())
def strip_html(s):
    """Text of HTML: scripts and styles removed, block ends as line ends, entities decoded."""
    return s.map(lambda x: strip_html_text(x) if isinstance(x, str) else None)


def clean_text(text: str) -> str:
    t = re.sub(r"[ \t]+\n", "\n", re.sub(r"\r\n?", "\n", text).replace("\0", ""))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def _chunk_end(t: str, start: int, size: int) -> int:
    """Where the chunk that begins at ``start`` ends: at the last line end of its final zone, else the last blank of it, else at its size."""
    full = start + size
    if full >= len(t):
        return len(t)
    last = [t.rfind(mark, max(start + LEAST_FILL, full - zone), full) for mark, zone in (("\n", LINE_ZONE), (" ", BLANK_ZONE))]
    return next((x for x in last if x > start), full)


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int, str]]:
    """(char_start, char_end, chunk) over the cleaned text: the windows first, each beginning an overlap before the last one's end, then
    their spans without white space around; blank windows have none."""
    t = clean_text(text)
    windows = [(0, _chunk_end(t, 0, size))] if t else []
    while windows and windows[-1][1] < len(t):
        begin = max(windows[-1][1] - overlap, windows[-1][0] + 1)
        windows.append((begin, _chunk_end(t, begin, size)))
    spans = ((a + len(w) - len(w.lstrip()), w.strip()) for a, w in ((a, t[a:b]) for a, b in windows))
    return [(a, a + len(w), w) for a, w in spans if w]


def chunks(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """document_id, chunk_index (from 0), char_start, char_end, token_estimate, text_content. Null and blank texts have none."""

    def run(batches):
        for b in batches:
            rows = [(i, k, s, e, max(1, len(x) // 4), x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for k, (s, e, x) in enumerate(chunk_spans(t))]
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["document_id", "chunk_index", "char_start", "char_end", "token_estimate", "text_content"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "document_id long, chunk_index int, char_start int, char_end int, token_estimate long, text_content string")


# Content classes by file extension. Images, audio and video follow the public media types; extensions of program texts
# are a parameter, as their number grows.
CONTENT_TYPES = {
    "Email": "dbx eml emlx mbox msg nsf ost p7m p7s pst tnef vcf",
    "Spreadsheet / Table": "123 csv dat dif gsheet numbers ods ots qpw slk sxc tsv xla xlam xlm xls xlsb xlsm xlsx xlt xltm xltx xlw",
    "Presentation": "gslides key odp pot potm potx pps ppsm ppsx ppt pptm pptx sdd sldm sldx sti",
    "Database": "accdb bak bson dbf dmp exp frm json ldf mdb mdf myd myi ndf odb ora pdb rdb sql",
    "Web": "htm html mht mhtml xhtm xhtml xml",
    "E-Doc": "doc docm docx dot dotm dotx eps fm md one pdf ps pub rtf txt vdx vsd vsdm vsdx vst vsx wpd wps",
    "Container": "7z alzip bz2 cab e01 ex01 gz l01 lx01 rar tar z zip",
    "Calendar": "calendar ical icalendar ics ifb invite vcal vcs",
    "CAD": "dwg dxf eprt sldasm slddrw sldprt stl",
    "Message": "rsmf",
    "Image": "emf psd tga wmf heic", "Audio": "amr flac m4a ogg wma", "Video": "avi flv mkv wmv",
}
SOURCE_CODE = "bash c cpp cs css go h ini ipynb jar java js jsp jsx kt lua php pl ps1 py r rb rs scala sh swift ts tsx vb yaml yml"
MEDIA = {"image": "Image", "audio": "Audio", "video": "Video"}


def content_classes(source_code: str = SOURCE_CODE, more: dict[str, str] | None = None) -> dict[str, str]:
    """extension -> class: media types first, then the named extensions, then ``more``."""
    out = {e[1:]: MEDIA[m.split("/")[0]] for e, m in mimetypes.MimeTypes(filenames=()).types_map[True].items() if m.split("/")[0] in MEDIA}
    out |= {e: kind for kind, exts in CONTENT_TYPES.items() for e in exts.split()} | {e: "Source Code" for e in source_code.split()}
    return out | (more or {})


def extension(c) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]{1,8})$", 1))


def content_type(c, classes: dict[str, str] | None = None) -> Column:
    """Class of a file name by its extension; null for an unknown one."""
    of: dict[str, list[str]] = {}
    for e, kind in (classes or content_classes()).items():
        of.setdefault(kind, []).append(e)
    e = extension(c)
    return F.coalesce(*[F.when(e.isin(*sorted(v)), kind) for kind, v in of.items()])


def content_type_by_text(text, file_type=None, headers=None, chat=None) -> Column:
    """Class that a text itself shows: mail headers (boolean), a chat (boolean), a calendar in its first lines; else null."""
    head = F.upper(F.substring(text, 1, 4000))
    calendar = head.contains("BEGIN:VCALENDAR") | head.contains("BEGIN:VEVENT")
    if file_type is not None:
        calendar = calendar | ((F.col(file_type) == "xml") & head.contains("<VCALENDAR"))
    none = F.lit(False)
    return F.when(none if headers is None else headers, "Email").when(none if chat is None else chat, "Chat").when(calendar, "Calendar")


def unique_names(c) -> Column:
    """Distinct trimmed entries of a ;-list, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != ""))


def name_list(c: Column, most: int = 3) -> Column:
    """The first names, sorted without case, and how many more there are."""
    s = F.array_sort(c, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))
    more = F.greatest(F.size(s) - most, F.lit(0))
    return F.concat(F.array_join(F.slice(s, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more, F.lit(" more"))).otherwise(""))
