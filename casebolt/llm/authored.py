"""The text a sender newly wrote: mails without quoted history, signatures and disclaimers.

A body is read by a recursive layout grammar over its lines:

    message    := node*
    node       := quote | forward | signature | disclaimer | authored
    quote      := attribution? quoted_line+          (quoted lines hold a message of their own, one level down)
    forward    := (banner | rule)? header_block message   (everything below belongs to the earlier message)
    signature  := (dashes | closing | contact | device) contact_line*
    disclaimer := rule? notice_paragraph
    authored   := any other line

The authored nodes of the outermost message, in order, are the result, with each run of white space as one blank. HTML is laid out
as lines first: blocks and breaks end lines, block quotes become quoted lines, style, script and head vanish, entities are decoded.

Defined results: without a text body the HTML body counts; a mail without both, and a blank body, has no node and is no case; a mail
of quoted text only has the empty new text. Bodies of any length are read whole, in time linear in their lines.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the words of the grammar in English, German, French and Spanish
CLOSINGS = {
    "best", "best regards", "best wishes", "cheers", "kind regards", "kindest regards", "many thanks", "many thanks and best wishes", "regards", "sincerely",
    "sincerely yours", "thank you", "thanks", "thanks and regards", "warm regards", "with best regards", "with kind regards", "yours", "yours faithfully",
    "yours sincerely", "yours truly", "thx", "br", "kr",
    "beste grüße", "beste grüsse", "freundliche grüße", "gruß", "grüße", "herzliche grüße", "hochachtungsvoll", "lg", "liebe grüße", "mfg", "mit besten grüßen",
    "mit freundlichen grüßen", "mit freundlichen grüssen", "schöne grüße", "vg", "viele grüße", "viele grüsse",
    "amicalement", "bien à vous", "bien cordialement", "cdlt", "cordialement", "salutations distinguées", "sincères salutations", "bien à toi", "merci",
    "atentamente", "atte", "cordialmente", "gracias", "saludos", "saludos cordiales", "un cordial saludo", "un saludo", "muchas gracias",
}
_FROM, _SENT, _TO, _SUBJECT, _CC = "from|von|de", "sent|date|gesendet|datum|envoyé|enviado|fecha|received", "to|an|à|para", "subject|betreff|objet|asunto", "cc|bcc|kopie|reply-to|importance"
_LABEL = re.compile(rf"^\W{{0,3}}({_FROM}|{_SENT}|{_TO}|{_SUBJECT}|{_CC})\*?\s?:\*?(\s|$)", re.I)
_FROM_LABEL = re.compile(rf"^\W{{0,3}}(?:{_FROM})\*?\s?:\*?\s+\S", re.I)
_KINDS = [re.compile(f"^(?:{k})$", re.I) for k in (_FROM, _SENT, _TO, _SUBJECT, _CC)]
_BANNER = re.compile(
    r"^\s*(?:-{3,}\s*(?:original message|forwarded message|forwarded by .*|ursprüngliche nachricht|weitergeleitete nachricht|message d['’]origine|message transféré|mensaje original|mensaje reenviado)\s*-{3,}"
    r"|(?:begin forwarded message|anfang der weitergeleiteten nachricht|début du message réexpédié|inicio del mensaje reenviado)\s?:)\s*$",
    re.I,
)
_ATTRIBUTION = re.compile(r"^(?:(?:on|am|le|el|em|il)\b.{4,240}?(?:\bwrote|\bschrieb\b.{0,160}|\ba écrit|\bescribió)\s?:|.{2,160}\bwrote on \d[\d/.\-]{5,9}\s?:)\s*$", re.I | re.S)
#: With an address in it an attribution may be of any length.
_LONG_ATTRIBUTION = re.compile(r"^(?:on|am|le|el|em|il)\b[^<]*.*<[^<>@\s]+@[^<>\s]*>.*(?:\bwrote|\bschrieb\b.*|\ba écrit|\bescribió)\s?:\s*$", re.I | re.S)
_ATTRIBUTION_START = re.compile(r"^(?:on|am|le|el)\b.*\d|.*\bwrote on\b|.*<[^<>@\s]+@[^<>\s]*>?\s*(?:wrote)?", re.I)
_QUOTED = re.compile(r"^[ \t]{0,3}>")
_RULE = re.compile(r"^\s*([-_*=#~])\1{7,}\s*$")
_DASHES = re.compile(r"^--\s*$")
_DEVICE = re.compile(
    r"^(?:sent from (?:my|a|an)\b|sent via\b|get (?:the|outlook)\b.{0,40}\b(?:app|for)\b|von mein\w* .{0,40}\bgesendet|gesendet von\b|envoyé (?:de|depuis)\b|télécharger\b|enviado desde\b|obtener\b).{0,60}$", re.I
)
_PHONE = re.compile(r"(?:^|[\s|:.])\+?\(?\d[\d\s()./-]{6,}\d\s*$")
_CONTACT = re.compile(r"^(?:(?:phone|tel|telefon|tél|teléfono|mobile|mobil|cell|fax|direct|office|e-?mail|mail|web)\b\s?[.:]?.*|\+?\(?\d[\d\s()./-]{6,}\d|www\.\S+|https?://\S+|\S+@\S+\.\S+)$", re.I)
_NAME_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_NAME = re.compile(rf"^{_NAME_WORD}(?: (?:{_NAME_WORD}|de|von|van|der|la|del)){{0,3}}$")
_PIPES = re.compile(r"^[^|]{2,80}(?:\s\|\s[^|]{1,80}){1,6}$")
_NOTICE = [
    re.compile(p, re.I)
    for p in (
        r"^\W*(?:confidentiality|legal|privacy) (?:notice|note)\b|^\W*disclaimer\b|^\W*caution:|^\W*haftungsausschluss",
        r"^\W*(?:the information (?:above|below|in this\b.*|contained\b.*)|any (?:file|attachment)s? sent with this\b.*|the contents? of this (?:e-?mail|message)|this (?:e-?mail|message|communication|transmission)(?: and (?:its|any) \w+)?)\b.*\b(?:confidential|privileged|solely for|must not be|bind the sender|checked for|intended (?:only|solely)|addressee)",
        r"^\W*diese (?:nachricht|e-?mail|mail)\b.*\b(?:vertraulich|empfänger|adressat)",
        r"^\W*(?:ce message|ce courriel|cet e-?mail)\b.*\b(?:confidentiel|destinataire)",
        r"^\W*este (?:mensaje|correo)\b.*\b(?:confidencial|destinatario)",
        r"^\W*(?:please think of the (?:trees|environment)|please consider the environment|unauthorised use|if you (?:are not|received|have received)\b.*\b(?:error|addressee|recipient)|views are those of)",
        r"^\W*(?:falls sie nicht der|sollten sie nicht der)\b|^\W*en cas d['’]erreur\b|^\W*si lo recibe por error\b",
    )
]
_NOTICE_LEAD = re.compile(
    r"^\W*(?:confidentiality|legal|privacy|disclaimer|caution|haftungsausschluss|the (?:information|contents?)|any|this|diese|ce|cet|este|please|unauthorised|if|views|falls|sollten|en cas|si)\b", re.I
)


@dataclass
class Node:
    """A node of the layout tree: its kind, its own lines, and for quotes and forwards the earlier message, ``levels`` quote marks down."""

    kind: str
    lines: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    levels: int = 1


def _kind_of(line: str) -> int | None:
    m = _LABEL.match(line)
    if not m:
        return None
    return next(i for i, k in enumerate(_KINDS) if k.match(m[1]))


def _header_at(lines: list[str], i: int) -> int:
    """Number of lines of a header block that starts here with its sender, else 0: a sender and two other fields, each followed by any
    number of folded lines (indented, after a comma or semicolon, or with an address in them) and up to two others."""
    if not _FROM_LABEL.match(lines[i]):
        return 0
    seen, j, last = {0}, i + 1, i
    while j < len(lines) and j <= last + 3 and lines[j].strip():
        k = _kind_of(lines[j])
        if k is not None:
            seen.add(k)
        if k is not None or lines[j][0] in " \t" or "@" in lines[j] or lines[j - 1].rstrip()[-1:] in ",;":
            last = j
        j += 1
    return j - i if len(seen) >= 3 else 0


def _next_full(lines: list[str], i: int) -> int:
    while i < len(lines) and not lines[i].strip():
        i += 1
    return i


def _attribution_at(lines: list[str], i: int) -> int:
    """Number of lines of an attribution that starts here, however often wrapped, else 0."""
    if not _ATTRIBUTION_START.match(lines[i]):
        return 0
    n = 1
    while i + n <= len(lines):
        last = lines[i + n - 1].rstrip()
        if not last.strip() or _QUOTED.match(last):
            return 0
        if last.endswith(":"):
            text = " ".join(x.strip() for x in lines[i : i + n])
            if _ATTRIBUTION.match(text) or _LONG_ATTRIBUTION.match(text):
                return n
        if last.endswith((".", "!", "?", ":")) and n > 1:
            return 0
        n += 1
    return 0


def _starts_earlier(lines: list[str], i: int) -> bool:
    return bool(_QUOTED.match(lines[i]) or _BANNER.match(lines[i]) or _header_at(lines, i) or _attribution_at(lines, i))


def _paragraph(lines: list[str], i: int) -> int:
    j = i
    while j < len(lines) and lines[j].strip() and not _QUOTED.match(lines[j]):
        j += 1
    return j


def _notice_at(lines: list[str], i: int) -> bool:
    """Whether a disclaimer starts here; its cue may stand anywhere in the paragraph."""
    if not _NOTICE_LEAD.match(" ".join(x.strip() for x in lines[i : i + 2])):
        return False
    text = " ".join(x.strip() for x in lines[i : _paragraph(lines, i)])
    return any(p.search(text) for p in _NOTICE)


def _contact_like(line: str) -> bool:
    """A line of a signature: a name, a title and firm, a number, an address; no sentence."""
    s = line.strip()
    if not s or len(s) > 90:
        return False
    if _CONTACT.match(s) or _PHONE.search(s) and len(s) < 70 or _RULE.match(s) or _DEVICE.match(s) or _NAME.match(s):
        return True
    return len(s) <= 60 and not re.search(r"[.!?;:]$", s) and len(s.split()) <= 8 and s[0].isupper() and sum(w[0].isupper() or not w[0].isalpha() for w in s.split()) * 2 >= len(s.split())


def _signature_at(lines: list[str], i: int) -> bool:
    s = lines[i].strip()
    if _DASHES.match(lines[i]):
        return True
    if _DEVICE.match(s):
        return True
    if _PIPES.match(s) and (_PHONE.search(s) or re.search(r"\S+@\S+\.\S+$", s)):
        return True
    before = i == 0 or not lines[i - 1].strip()
    if s.rstrip(",.!").lower() in CLOSINGS and len(s) < 45:
        j = _next_full(lines, i + 1)
        # the closing ends the text, or a name or another structure follows it
        return j >= len(lines) or bool(_NAME.match(lines[j].strip())) or _starts_earlier(lines, j) or bool(_RULE.match(lines[j])) or (j > i + 1 or s.endswith(",")) and _contact_like(lines[j])
    if before and (_NAME.match(s) or _CONTACT.match(s)) and s.split():
        # a paragraph of contact lines with a number or an address in it
        j = _paragraph(lines, i)
        part = [x.strip() for x in lines[i:j]]
        return j - i <= 8 and all(map(_contact_like, part)) and any(_CONTACT.match(x) or _PHONE.search(x) for x in part)
    return False


_MARKS = re.compile(r"^[ \t]{0,3}>(?:[ ]?>)*")


def parse(lines: list[str]) -> list[Node]:
    """The nodes of a message, with those of the earlier messages in it, however deep."""
    top = Node("message")
    open_ = [(top, lines, 0)]
    while open_:
        node, inner, depth = open_.pop()
        node.children = _level(inner, depth, open_)
    return top.children


def _level(lines: list[str], depth: int, open_: list) -> list[Node]:
    """The nodes of one level; earlier messages are put on ``open_``."""
    out: list[Node] = []
    i, n = 0, len(lines)

    def add(kind: str, part: list[str], earlier: list[str] | None = None) -> None:
        if kind == "authored" and out and out[-1].kind == "authored":
            out[-1].lines += part
        else:
            out.append(Node(kind, part))
            if earlier:
                open_.append((out[-1], earlier, depth + 1))

    while i < n:
        line = lines[i]
        if not line.strip():
            if out:
                out[-1].lines.append(line)
            i += 1
            continue
        if _QUOTED.match(line):
            j = i
            while j < n and (_QUOTED.match(lines[j]) or (not lines[j].strip() and j + 1 < n and _QUOTED.match(lines[j + 1]))):
                j += 1
            alone = j == i + 1 and i > 0 and lines[i - 1].strip() and not (out and out[-1].kind in ("quote", "attribution"))
            if alone and re.match(r"^>\s*[\d.,]+\s", line) and re.search(r"\w$", lines[i - 1]):
                add("authored", [line])  # a wrapped comparison, not a quote
                i += 1
                continue
            # marks that all lines have are taken off at once
            marks = min((_MARKS.match(x)[0].count(">") for x in lines[i:j] if x.strip()), default=1)
            add("quote", lines[i:j], [re.sub(rf"^[ \t]{{0,3}}>(?:[ ]?>){{{marks - 1}}}[ ]?", "", x) for x in lines[i:j]])
            out[-1].levels = marks
            i = j
            continue
        if k := _attribution_at(lines, i):
            j = _next_full(lines, i + k)
            if j < n and _QUOTED.match(lines[j]):
                add("attribution", lines[i:j])
                i = j
                continue
            if j >= n or depth == 0:
                # an attribution without quote marks: the rest is the earlier message
                add("forward", lines[i:], lines[j:])
                break
        start = i
        if _BANNER.match(line) or _RULE.match(line):
            start = _next_full(lines, i + 1)
        if _BANNER.match(line) or (start < n and _header_at(lines, start)):
            k = _header_at(lines, start) if start < n else 0
            add("forward", lines[i:], lines[start + k :])
            break
        if _RULE.match(line) and start < n and _notice_at(lines, start):
            j = _paragraph(lines, start)
            add("disclaimer", lines[i:j])
            i = j
            continue
        if (i == 0 or not lines[i - 1].strip() or (out and out[-1].kind in ("signature", "disclaimer"))) and _notice_at(lines, i):
            j = _paragraph(lines, i)
            add("disclaimer", lines[i:j])
            i = j
            continue
        if _signature_at(lines, i):
            j = i + 1
            while j < n:
                if not lines[j].strip():
                    k = _next_full(lines, j)
                    if k >= n or _starts_earlier(lines, k) or not all(map(_contact_like, lines[k : _paragraph(lines, k)])):
                        break
                    j = k
                    continue
                if _starts_earlier(lines, j) or _notice_at(lines, j) or (_RULE.match(lines[j]) and (e := _next_full(lines, j + 1)) < n and (_header_at(lines, e) or _notice_at(lines, e))):
                    break
                if not _contact_like(lines[j]):
                    break
                j += 1
            add("signature", lines[i:j])
            i = j
            continue
        if _RULE.match(line) and (not out or out[-1].kind != "authored" or start >= n):
            add("rule", [line])
            i += 1
            continue
        add("authored", [line])
        i += 1
    return out


_BLOCK = re.compile(r"<\s*(/?)\s*(br|p|div|tr|table|hr|li|ul|ol|h[1-6]|blockquote|pre|section|article|header|footer|td)\b[^>]*>", re.I)
_DROP = re.compile(r"<!--.*?-->|<\s*(style|script|head|title)\b[^>]*>.*?<\s*/\s*\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")


def html_lines(source: str) -> list[str]:
    """Lines of an HTML body; block quotes as quoted lines, one mark for each level."""
    text = _DROP.sub(" ", source)
    lines: list[str] = []
    now: list[str] = []
    level = 0

    def flush(end_block: bool) -> None:
        s = re.sub(r"[\s ]+", " ", html.unescape(_TAG.sub("", "".join(now)))).strip()
        now.clear()
        if s:
            lines.append("> " * level + s)
        elif lines and lines[-1].strip() and not end_block:
            lines.append("")

    at = 0
    for m in _BLOCK.finditer(text):
        now.append(text[at : m.start()])
        at = m.end()
        name, closing = m[2].lower(), bool(m[1])
        had = bool("".join(now).strip())
        flush(end_block=name != "br" or True)
        if name in ("p", "div", "tr", "table", "hr", "blockquote", "li", "section", "article", "header", "footer", "pre") or name[0] == "h":
            if lines and lines[-1].strip():
                lines.append("> " * level if level else "")
        elif name == "br" and not had and lines and lines[-1].strip():
            lines.append("")
        if name == "blockquote":
            level = max(0, level + (-1 if closing else 1))
    now.append(text[at:])
    flush(True)
    return lines


def read_body(text_body: str | None, html_body: str | None) -> list[Node] | None:
    """The layout tree of a mail's body, None without a body."""
    if text_body is not None:
        return parse(re.split(r"\r\n|\r|\n| | |\x85|\x0b|\x0c", text_body)) if text_body.strip() else None
    if html_body is not None and html_body.strip():
        return parse(html_lines(html_body))
    return None


def new_text(tree: list[Node]) -> str:
    """The authored nodes of the outermost message."""
    return re.sub(r"\s+", " ", " ".join(x for node in tree if node.kind == "authored" for x in node.lines)).strip()


def _batches(batches):
    for b in batches:
        ids, texts, kinds = [], [], []
        for i, t, h in zip(*(c.to_pylist() for c in b.columns)):
            tree = read_body(t, h)
            if tree is None:
                continue
            ids.append(i)
            texts.append(new_text(tree))
            kinds.append(sorted({k.kind for k in tree if k.kind != "authored"}))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["mail_id", "new_text", "removed"])


def authored(mail: DataFrame) -> DataFrame:
    """mail_id, new_text, removed (kinds of nodes taken out) of every mail with a body."""
    # the HTML body is sent to Python only where it is read
    return mail.select("mail_id", "text_body", F.when(F.col("text_body").isNull(), F.col("html_body")).alias("html_body")).mapInArrow(_batches, "mail_id long, new_text string, removed array<string>")


def found(mail: DataFrame) -> DataFrame:
    """Bodies with an earlier message, a signature or a disclaimer."""
    return authored(mail).where("size(array_except(removed, array('rule'))) > 0").select("mail_id", "new_text")
