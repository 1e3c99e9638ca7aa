"""Views of the test tables in the engine's document model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebolt.common import table


def documents(spark, d) -> DataFrame:
    """Texts as documents: id, control number, names, dataset (its source), hash of the stored text."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "control_number", "content_type", "file_name", F.col("source_rel_path").alias("rel_path"), F.col("source").alias("dataset_name"),
        "lang", F.col("n_chars").alias("file_size"), F.lower("content_hash").alias("content_hash"), F.sha2("text", 256).alias("file_hash"), "text",
    )


def membership(spark, d) -> DataFrame:
    """A document is in the dataset of its source and in that of its language."""
    t = table(spark, d, "documents")
    both = F.explode(F.array("source", F.concat(F.lit("lang:"), F.lower("lang")))).alias("dataset_name")
    return t.select(F.col("doc_id").alias("document_id"), both).where("dataset_name is not null")


def mails(spark, d) -> DataFrame:
    """Extracted mails as documents with a date."""
    return table(spark, d, "mail_messages").select(
        F.col("mail_id").alias("id"), F.lit("Email").alias("content_type"), "subject", F.col("from_addr").alias("author"), F.col("account").alias("custodian"),
        F.lower("rfc822messageid").alias("message_id"), F.col("ingested_at").alias("date_created"), "text_body",
    )


def copies(spark, d) -> DataFrame:
    """Sidecar rows as physical copies of a message."""
    return table(spark, d, "gmail_metadata").select(
        F.col("meta_id").alias("id"), F.lower("rfc822messageid").alias("document_id"), F.lit("mbox").alias("source_kind"), F.col("account").alias("custodian"), "subject",
        F.col("from_addr").alias("author"), F.col("to_addr").alias("recipients"), F.col("filename").alias("file_name"), F.lit("active").alias("lifecycle_status"),
        F.lit("ok").alias("text_status"), F.lit(False).alias("has_preview"), F.col("loaded_at").alias("ingested_at"), F.col("loaded_at").alias("date_created"), F.col("loaded_at").alias("date_modified"),
        "gmailmessageid",
    ).where("document_id is not null")


def production(spark, d) -> DataFrame:
    """Orders as produced parents with a Bates span that covers their lines, lines as their attachments."""
    o = table(spark, d, "orders")
    begin = lambda k: F.concat(F.lit("ORD"), F.lpad((k * 100).cast("string"), 12, "0"))
    end = lambda k: F.concat(F.lit("ORD"), F.lpad((k * 100 + 99).cast("string"), 12, "0"))
    parents = o.select((F.col("o_orderkey") * 1000).alias("id"), begin(F.col("o_orderkey")).alias("begin_bates"), begin(F.col("o_orderkey")).alias("end_bates"), begin(F.col("o_orderkey")).alias("begin_attachment"), end(F.col("o_orderkey")).alias("end_attachment"), begin(F.col("o_orderkey")).alias("control_number"))
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    no = F.concat(F.lit("ORD"), F.lpad((F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("string"), 12, "0"))
    nul = F.lit(None).cast("string")
    children = l.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"), no.alias("begin_bates"), no.alias("end_bates"), nul.alias("begin_attachment"), nul.alias("end_attachment"), no.alias("control_number"))
    return parents.unionByName(children)


def families(spark, d) -> DataFrame:
    """Orders as parents, their lines as children: id, parent_id, child_kind, lifecycle_status."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") * 1000).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("child_kind"), F.when(F.col("o_orderstatus") == "P", "missing").otherwise("active").alias("lifecycle_status"))
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    kind = F.when(F.col("flag") == "R", "reply_thread").when(F.col("flag") == "A", "attachment")
    c = l.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") * 1000).alias("parent_id"), kind.alias("child_kind"), F.when(F.col("status") == "F", "deleted").otherwise("active").alias("lifecycle_status"))
    return o.unionByName(c)


def threaded(spark, d) -> DataFrame:
    """Sidecar rows as mails with threading headers. The rows have none of their own, so they follow from the row before: some answer it, some refer
    to the two before it, some carry a conversation index, some have no id at all and are left to their subject."""
    g = table(spark, d, "gmail_metadata").select("meta_id", "loaded_at", F.lower("rfc822messageid").alias("own"), "subject", "from_addr", "to_addr", "cc", "account")
    before = lambda n: g.select((F.col("meta_id") + n).alias("meta_id"), F.col("own").alias(f"b{n}"))
    j, k = g.join(before(1), "meta_id", "left").join(before(2), "meta_id", "left"), F.col("meta_id")
    people = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "from_addr", "to_addr", "cc")), F.lit("([a-z0-9._+-]+@[a-z0-9.-]+)"), F.lit(1))))
    bare, text = k % 6 == 0, F.lit(None).cast("string")
    return j.select(
        k.alias("id"), F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.when(~bare, F.col("own")).alias("message_id"), F.when(~bare & (k % 4 == 3), F.col("b1")).alias("in_reply_to"),
        F.when(~bare & (k % 5 == 4), F.array_compact(F.array("b2", "b1"))).otherwise(F.array().cast("array<string>")).alias("references"),
        F.when(k % 12 == 0, F.concat(F.lit("root"), F.floor(k / 36))).alias("index_root"), F.when(k % 24 == 0, F.lit("Topic")).alias("topic"),
        F.lower(F.trim(F.regexp_replace("subject", r"(?i)^\s*((re|fwd?)\s*:\s*)+", ""))).alias("subject"), people.alias("people"), F.col("account").alias("custodian"),
        F.when(k % 50 == 1, F.concat(F.lit("pin"), F.floor(k / 100))).otherwise(text).alias("manual"),
    )
