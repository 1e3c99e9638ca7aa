"""Views of documents with what belongs to them: parents, text revisions, threading, results; and the state of stored keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: characters of the summary that a document record shows.
SUMMARY = 1200


def with_parent_and_text(docs: DataFrame, revisions: DataFrame, active: DataFrame) -> DataFrame:
    """Documents (id, parent_id, control_number) with their parent's control number and their active revision's hash and length; both may be
    missing. ``active`` is (document_id, revision_id), ``revisions`` (revision_id, content_hash, char_count)."""
    parent = docs.select(F.col("id").alias("parent_id"), F.col("control_number").alias("parent_control_number"))
    text = active.join(revisions.select("revision_id", "content_hash", "char_count"), "revision_id").withColumnRenamed("document_id", "id")
    return docs.select("id", "parent_id", "control_number").join(parent, "parent_id", "left").join(text, "id", "left")


def with_threading(docs: DataFrame, mail: DataFrame, chat: DataFrame) -> DataFrame:
    """Documents with their mail threading (document_id, message_id, ...) and chat threading (document_id, thread_id, ...), either or none."""
    return docs.join(mail.withColumnRenamed("document_id", "id"), "id", "left").join(chat.withColumnRenamed("document_id", "id"), "id", "left")


def keys_to_mend(wanted: DataFrame, stored: DataFrame, key: str = "key_value") -> DataFrame:
    """(document_id, key): wanted keys that are not stored, or stored for another document."""
    s = stored.select(key, F.col("document_id").alias("_has")).dropDuplicates([key])
    return wanted.join(s, key, "left").where("_has is null or _has <> document_id").select("document_id", key)


def bound_outputs(items: DataFrame, outputs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(document_id, field, output_id, value) of the results of a run's items whose output is bound to a field, each once."""
    j = items.where("result_id is not null").select("document_id", "result_id").join(outputs, "result_id").join(definitions.where("field is not null").select("output_name", "field"), "output_name")
    return j.select("document_id", "field", "output_id", "value").distinct()


def record(docs: DataFrame, text: str = "text", chars: int = SUMMARY) -> DataFrame:
    """Document records: every column but the text, a summary of its beginning and its length."""
    return docs.select(*[c for c in docs.columns if c != text], F.substring(text, 1, chars).alias("summary"), F.length(text).alias("chars"))


def parents_only(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Search hits (doc, score) on documents that are no child of another."""
    return hits.join(docs.where("parent_id is null").select(F.col("id").alias("doc")), "doc", "left_semi")
