"""Conversations: mail threads, chats, transcripts, timelines.

Mail threading depends on the order of the documents: each one looks at the clusters that earlier ones formed. Documents that could
ever meet are therefore grouped by connected components over all their signals (in a distributed contraction elsewhere, or by the
key columns given), and the exact ordered cascade runs inside each component, over the components of a partition in one pass.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter, namedtuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebolt.common import Scratch
from casebolt.functions import identifiers


def summary(docs: DataFrame, key: str = "conversation_id", matching: str | None = None) -> DataFrame:
    """Documents, first and last activity, participants, and how many match a selection (boolean column)."""
    return docs.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("documents"), F.min("date_created").alias("first_activity"), F.max("date_created").alias("last_activity"),
        F.array_join(F.sort_array(F.collect_set("participant")), ", ").alias("participants"), F.count_if(matching or F.lit(True)).alias("matching"),
    )


def transcript(messages: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """One text a conversation: speaker: text lines in order."""
    line = F.struct(order, F.concat(F.col(speaker), F.lit(": "), F.coalesce(text, F.lit(""))).alias("line"))
    return messages.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("transcript"))


def chat_key() -> Column:
    """Grouping of chat messages: the thread across the workspace, else the folder, item or document."""
    full = lambda c: F.when(F.trim(c) != "", F.trim(F.col(c)))
    return F.coalesce(F.concat(F.lit("thread:"), full("thread_id")), F.concat(F.lit("folder:"), full("folder")), F.concat(F.lit("item:"), full("item_id")), F.concat(F.lit("doc:"), F.col("id").cast("string")))


def inherit(docs: DataFrame) -> DataFrame:
    """Children take their parent's conversation and assignment mode."""
    p = docs.select(F.col("id").alias("parent_id"), F.col("conversation_id").alias("pc"), F.col("assignment_mode").alias("pm"))
    j = docs.join(p, "parent_id", "left")
    child = F.col("parent_id").isNotNull() & F.col("pc").isNotNull()
    return j.withColumns({"conversation_id": F.when(child, F.col("pc")).otherwise(F.col("conversation_id")), "assignment_mode": F.when(child, F.col("pm")).otherwise(F.col("assignment_mode"))}).drop("pc", "pm")


def clear_unsupported(docs: DataFrame) -> DataFrame:
    """Top-level documents that are neither mail nor chat have no conversation and the automatic mode."""
    other = F.col("parent_id").isNull() & ~F.coalesce(F.col("content_type").isin("Email", "Chat"), F.lit(False))
    return docs.withColumns({"conversation_id": F.when(~other, F.col("conversation_id")), "assignment_mode": F.when(other, "auto").otherwise(F.col("assignment_mode"))})


def overlay(docs: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual assignments (id, conversation_id or null to clear; the newest wins) over automatic ones; they are pinned."""
    m = manual.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("assigned_at")))).where("_r = 1").select("id", F.col("conversation_id").alias("mc"), F.lit(True).alias("pinned"))
    j = docs.join(m, "id", "left")
    return j.withColumns({"conversation_id": F.when(F.col("pinned"), F.col("mc")).otherwise(F.col("conversation_id")), "assignment_mode": F.when(F.col("pinned"), "manual").otherwise(F.col("assignment_mode"))}).drop("mc", "pinned")


def timeline(docs: DataFrame, chat_segment_chars: int = 180_000) -> DataFrame:
    """Segment of each document in its conversation: chats by month, mail in one segment or by year if longer than the limit;
    undated documents are last, in a segment of their own."""
    when = F.coalesce("date_created", "date_modified", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("timestamp"))
    size = docs.groupBy("conversation_id").agg(F.sum(F.length("text")).alias("chars"))
    j = docs.withColumn("at", when).join(size, "conversation_id")
    seg = F.when(F.col("content_type") == "Chat", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("undated"))).when(F.col("chars") > chat_segment_chars, F.coalesce(F.date_format("at", "yyyy"), F.lit("undated"))).otherwise("all")
    return j.select("conversation_id", "id", "at", seg.alias("segment"))


def slack_threads(messages: DataFrame) -> DataFrame:
    """(channel, ts, document): replies leave their day for the thread of their root, if the root itself is among the messages and
    marks a thread; roots stay in their day and open the thread document."""
    m = messages.withColumn("root_ts", F.coalesce("thread_ts", "ts"))
    roots = m.where("thread_ts is null or thread_ts = ts").where("thread_ts = ts or coalesce(reply_count, 0) > 0").select("channel", F.col("ts").alias("root_ts"), F.lit(True).alias("opened"))
    j = m.join(roots, ["channel", "root_ts"], "left")
    day = F.concat(F.lit("day:"), F.date_format(F.timestamp_seconds(F.col("ts").cast("double")), "yyyy-MM-dd"))
    doc = F.when(F.coalesce("opened", F.lit(False)) & (F.col("ts") != F.col("root_ts")), F.concat(F.lit("thread:"), "root_ts")).otherwise(day)
    return j.select("channel", "ts", doc.alias("document"))


# ---- mail threading
THREADED = "id long, cluster long, how string, conversation_key string, display_name string"
Mail = namedtuple("Mail", "id date message_id in_reply_to references index_root topic subject people custodian manual title")


def _cluster(strong: bool) -> dict:
    return {"subjects": set(), "people": set(), "custodians": set(), "last": None, "strong": strong, "ids": set(), "roots": set(), "topics": set(), "name": None}


def _key(v: dict) -> str:
    """The key of a conversation: its least message id, else its Outlook topic and index root, else the root, else a digest of subject and people."""
    if v["ids"]:
        return f"rfc:{min(v['ids'])}"
    if v["roots"]:
        return f"outlook:{min(v['topics'])}:{min(v['roots'])}" if v["topics"] else f"outlook_index:{min(v['roots'])}"
    about = {"subject": min(v["subjects"], default=""), "participants": sorted(v["people"])}
    return "heuristic:" + hashlib.sha256(json.dumps(about, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]


def _known_cluster(of_id: dict, refs: list) -> int | None:
    """The cluster that alone knows the longest trailing part of the references: that of the last known one."""
    return next((of_id[r] for r in reversed(refs) if r in of_id), None)


def _threads(mails: list[Mail]) -> list[tuple]:
    """Rows of THREADED of one component, in the order of the mails' dates (blank last) and ids. Earlier clusters without ids are found by
    subject and person, so a subject of many mails costs what they have in common, not its square."""
    of_id: dict[str, int] = {}
    of_root: dict[tuple, int] = {}
    weak: dict[tuple, list[int]] = {}
    clusters: dict[int, dict] = {}
    out = []
    mails = sorted(mails, key=lambda r: (not (r.date or "").strip(), r.date is None, r.date or "", r.id))
    # pinned conversations exist before any automatic one
    for r in mails:
        if r.manual is not None:
            c = of_root.setdefault(("manual", r.manual), r.id)
            clusters.setdefault(c, _cluster(True))
            if r.message_id:
                of_id.setdefault(r.message_id, c)
    for r in mails:
        refs, people = r.references or [], set(r.people or ())
        root = (r.index_root, r.topic) if r.index_root else None
        strong = bool(r.message_id or r.in_reply_to or refs or root)
        c, how = None, "new"
        if r.manual is not None:
            c, how = of_root[("manual", r.manual)], "manual"
        elif r.message_id and r.message_id in of_id:
            c, how = of_id[r.message_id], "message"
        elif r.in_reply_to and r.in_reply_to in of_id:
            c, how = of_id[r.in_reply_to], "reply"
        elif (hit := _known_cluster(of_id, refs)) is not None:
            c, how = hit, "references"
        elif root and root in of_root:
            c, how = of_root[root], "index"
        elif not strong and r.subject:
            best = []
            for k, both in Counter(k for p in people for k in weak.get((r.subject, p), ())).items():
                v = clusters[k]
                if not (r.custodian and v["custodians"] and r.custodian not in v["custodians"]) and (v["last"] is None or not r.date or v["last"] <= r.date):
                    best.append(((both, v["last"] or ""), k))
            best = heapq.nlargest(2, best)
            if best and (len(best) == 1 or best[0][0] != best[1][0]):
                c, how = best[0][1], "subject"
        if c is None:
            c = r.id
            clusters[c] = _cluster(strong)
        v = clusters[c]
        # a cluster without ids has one subject
        if not v["strong"] and r.subject:
            for p in people - v["people"]:
                weak.setdefault((r.subject, p), []).append(c)
        v["people"] |= people
        if r.subject:
            v["subjects"].add(r.subject)
        if r.custodian:
            v["custodians"].add(r.custodian)
        if r.date:
            v["last"] = max(v["last"] or "", r.date)
        for m in filter(None, [r.message_id, r.in_reply_to, *refs]):
            of_id.setdefault(m, c)
            v["ids"].add(m)
        if root:
            of_root.setdefault(root, c)
            v["roots"].add(root[0])
        if r.topic and r.topic.strip():
            v["topics"].add(r.topic)
        v["name"] = v["name"] or next((x for x in (r.subject, r.title) if x and x.strip()), None)
        out.append((r.id, c, how))
    ends = {c: (_key(v), v["name"] or min(v["topics"], default=None)) for c, v in clusters.items()}
    return [(*x, *ends[x[1]]) for x in out]


def cascade(pdf: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one component, documents by date (blank last) and id. Each one joins the cluster of its message id, of the
    message it answers, of its references (the longest trailing part that one cluster alone knows), of its conversation index, or
    of the best matching earlier cluster with the same subject; otherwise it opens one."""
    text = lambda x: x if isinstance(x, str) else None
    many = lambda x: [] if x is None or isinstance(x, float) else list(x)
    columns = [pdf[c].tolist() if c in pdf else [None] * len(pdf) for c in Mail._fields]
    mails = [Mail(*[int(x) if c == "id" else many(x) if c in ("references", "people") else text(x) for c, x in zip(Mail._fields, row)]) for row in zip(*columns)]
    return pd.DataFrame(_threads(mails), columns=[c.split()[0] for c in THREADED.split(", ")])


def _by_component(batches):
    """Threads of rows (component, fields of a mail) in the order of their components; a component may go on in the next batch."""
    held, current = [], None
    for b in batches:
        out = []
        for component, *mail in zip(*(c.to_pylist() for c in b.columns)):
            if component != current:
                out += _threads(held)
                held, current = [], component
            held.append(Mail(*mail))
        yield _threaded_batch(out)
    yield _threaded_batch(_threads(held))


def _threaded_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [pa.field(n, kinds[k]) for n, k in (c.split() for c in THREADED.split(", "))]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * len(fields), fields)], schema=pa.schema(fields))


def thread_mail(mail: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """id, cluster (its first document), how, conversation_key, display_name (first subject, else the least topic). ``mail`` has id, date (text),
    message_id, in_reply_to, references (array), index_root, topic, subject (normalised), people (array), custodian, manual.

    Only documents without ids and roots can be matched by subject, so a subject ties none but those into one component."""
    full = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    strong = full("message_id") | full("in_reply_to") | full("index_root") | (F.size(F.coalesce("references", F.array().cast("array<string>"))) > 0)
    mail = mail.withColumn("_weak_subject", F.when(~strong, F.nullif("subject", F.lit(""))))
    signals = F.array_compact(F.array_union(F.array(F.concat(F.lit("m:"), "message_id"), F.concat(F.lit("m:"), "in_reply_to"), F.concat(F.lit("i:"), "index_root"), F.concat(F.lit("c:"), "manual"), F.concat(F.lit("s:"), "_weak_subject")), F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda x: F.concat(F.lit("m:"), x))))
    mail = mail.withColumn("_signals", signals).drop("_weak_subject")
    # a clash of two signals puts unrelated mails into one component, where they do not meet
    comp = components(mail.select("id", F.explode(F.transform(F.filter("_signals", lambda x: F.length(x) > 2), lambda x: F.xxhash64(x))).alias("signal")), scratch)
    fields = [F.col(f"`{c}`") if c in mail.columns else F.lit(None).cast("string").alias(c) for c in Mail._fields]
    j = mail.select(*fields).join(comp, "id", "left").select(F.coalesce("component", "id").alias("component"), *Mail._fields)
    # most components are a few mails: a call of Python takes a partition of them
    return j.repartition("component").sortWithinPartitions("component").mapInArrow(_by_component, THREADED)


def components(members: DataFrame, scratch: Scratch | None = None, rounds: int = 60) -> DataFrame:
    """(id, component) of documents that share signals, however far: least labels pass along signals and are compressed by label."""
    scratch = scratch or Scratch(members.sparkSession, "threads")
    members = scratch.put(members.distinct())
    # a signal of one document links nothing
    shared = members.groupBy("signal").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("signal")
    links = scratch.put(members.join(shared, "signal", "left_semi").select("id", "signal"))
    label = scratch.put(links.groupBy("id").agg(F.min("id").alias("component")))
    for _ in range(rounds):
        least = links.join(label, "id").groupBy("signal").agg(F.min("component").alias("component"))
        new = links.join(least, "signal").groupBy("id").agg(F.min("component").alias("component"))
        # pointer jump: the label of the label
        jump = new.join(new.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"))
        jump = scratch.put(jump)
        changed = jump.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        scratch.drop(label)
        label = jump
        if not changed:
            # documents without a shared signal stay alone
            return members.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    raise RuntimeError("labels did not settle")


# ---- texts that are chats
# The forms of a chat line, labels that are no speaker, the longest line and the most words of a speaker.
_CHAT = [
    re.compile(p, re.I)
    for p in (
        r"^\[(?P<at>[^\]]{4,80})\]\s*(?P<speaker>[^:\n]{2,80}?):\s+(?P<message>\S.*)$",
        r"^(?P<at>\d{4}-\d{2}-\d{2}[ T]\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:AM|PM))?(?:\s*(?:Z|UTC|[+\-]\d{2}:?\d{2}))?)\s*[-,]?\s*(?P<speaker>[^:\n]{2,80}?):\s+(?P<message>\S.*)$",
        r"^(?P<at>\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?)\s*[-,]?\s*(?P<speaker>[^:\n]{2,80}?):\s+(?P<message>\S.*)$",
        r"^(?P<speaker>[^:\n]{2,80}?):\s+(?P<message>\S.*)$",
    )
]
_NO_SPEAKERS = set("agenda answer bcc cc date description from message note notes owner priority question sent status subject summary task thread title to topic".split())
CHAT_LINE, SPEAKER_WORDS = 240, 8


def chat_entries(text: str) -> list[tuple[str, str, str]]:
    """(time, speaker, message) of the lines that have the form of a chat line; the time may be empty."""
    out = []
    for line in re.split(r"\r\n|\r|\n", text):
        bare = line.strip()
        hits = (p.match(bare) for p in _CHAT) if bare and len(bare) <= CHAT_LINE else ()
        for m in filter(None, hits):
            speaker = " ".join(m["speaker"].split()).strip("[]() ")
            if speaker and speaker.lower() not in _NO_SPEAKERS and len(speaker.split()) <= SPEAKER_WORDS and not speaker[0] == '"':
                out.append((m.groupdict().get("at") or "", speaker, " ".join(m["message"].split())))
                break
    return out


def is_chat(text: str) -> bool:
    """Two timed lines by two speakers, or three lines, in which without two times somebody speaks twice."""
    e = chat_entries(text)
    speakers = [s.lower() for _, s, _ in e]
    if sum(bool(at) for at, _, _ in e) >= 2:
        return len(set(speakers)) >= 2 or len(e) >= 3
    return len(e) >= 3 and len(set(speakers)) < len(speakers)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("at", "speaker", "message")])))
def chat_lines(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"at": a, "speaker": b, "message": c} for a, b, c in chat_entries(t)] if isinstance(t, str) else None)


normal_subject = identifiers.subject
