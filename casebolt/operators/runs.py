"""Processing runs: frozen selections, pinned inputs, reusable results, execution with errors as rows, publishing."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebolt.operators.families import expand_family

# States of run items.
TERMINAL = ["completed", "failed", "skipped", "canceled"]
STALE_SECONDS = 900


def intersect(selections: list[DataFrame]) -> DataFrame:
    """(id, ordinal) in every selection, in the order of the first."""
    out = selections[0]
    for s in selections[1:]:
        out = out.join(s.select("id"), "id", "left_semi")
    return out


def snapshot(selection: DataFrame, docs: DataFrame, order: list[Column], limit: int | None = None, family: bool = False) -> DataFrame:
    """(id, ordinal) frozen in the selection's order; ``limit`` is the run's own seed limit, taken before families are added."""
    seeds = selection.orderBy(*order)
    if limit is not None:
        seeds = seeds.limit(limit)
    w = W.orderBy(*order)
    if not family:
        return seeds.withColumn("ordinal", F.row_number().over(w)).select("id", "ordinal") if limit is not None else _numbered(selection, order)
    s = seeds.withColumn("ordinal", F.row_number().over(w)).select("id", "ordinal") if limit is not None else _numbered(selection, order)
    return _numbered(expand_family(s, docs), [F.col("first"), F.col("child"), F.col("id")])


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    from casebolt.operators.families import numbered

    return numbered(df, *order).select("id", F.col("ordinal").cast("int").alias("ordinal"))


def pinned(*parts) -> Column:
    """Identity of an input: a digest of its parts, nulls kept apart from empty texts."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.concat(F.lit("="), F.col(p).cast("string")), F.lit("-")) for p in parts]), 256)


def reuse(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with the result that has the same document, job version and input; retracted results do not count. state: reused, pending."""
    r = results.where("retracted_at is null").groupBy("document_id", "job_version_id", "input_id").agg(F.max("result_id").alias("result_id"))
    return items.join(r, ["document_id", "job_version_id", "input_id"], "left").withColumn("state", F.when(F.col("result_id").isNotNull(), "reused").otherwise("pending"))


def progress(items: DataFrame) -> DataFrame:
    """State of each run: canceled, completed (also without items), failed if all ended and one failed, running, planned."""
    g = items.groupBy("run_id").agg(
        F.max("canceled").alias("canceled"), F.count("state").alias("n"), F.count_if(F.col("state").isin(*TERMINAL)).alias("ended"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state").isin("running", *TERMINAL)).alias("begun"),
    )
    st = F.when(F.col("canceled"), "canceled").when(F.col("ended") == F.col("n"), F.when(F.col("failed") > 0, "failed").otherwise("completed")).when(F.col("begun") > 0, "running").otherwise("planned")
    return g.select("run_id", "n", "ended", "failed", st.alias("state"))


def claim(items: DataFrame, now: Column, limit: int, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """The next items to work on, pending or running without a heartbeat, in id order; ``limit`` is the worker's batch."""
    stale = (F.col("state") == "running") & (F.unix_timestamp("heartbeat_at") < F.unix_timestamp(now) - stale_seconds)
    return items.where((F.col("state") == "pending") | stale).withColumn("orphaned", stale).orderBy("item_id").limit(limit)


Provider = Callable[[dict], str]
PROVIDERS: dict[str, Provider] = {}


def provider(name: str):
    def add(f: Provider) -> Provider:
        PROVIDERS[name] = f
        return f

    return add


@provider("static_template")
def static_template(context: dict) -> str:
    """Fills {field} places of the job's template; an unknown place is an error."""
    return str(context["template"]).format_map({k: "" if v is None else v for k, v in context.items()})


@provider("static_json")
def static_json(context: dict) -> str:
    import json

    return json.dumps(json.loads(str(context["template"])), sort_keys=True, separators=(",", ":"))


def execute(items: DataFrame, name: str, template: str, fields: list[str]) -> DataFrame:
    """document_id, state (completed, failed), output, error: each item by the provider, failures as rows."""

    def run(batches):
        call = PROVIDERS[name]
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    rows.append((r["document_id"], "completed", call({**r, "template": template}), None))
                except Exception as e:
                    rows.append((r["document_id"], "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["document_id", "state", "output", "error"])

    return items.select("document_id", *fields).mapInPandas(run, "document_id long, state string, output string, error string")


def publish(results: DataFrame, docs: DataFrame, field: str, kind: str) -> DataFrame:
    """Documents with the newest result's output, in the field's type, in a custom field; what does not convert stays null."""
    types = {"integer": "long", "real": "double", "boolean": "boolean", "date": "date", "text": "string"}
    newest = results.groupBy("document_id").agg(F.max_by("output", "result_id").alias("output"))
    v = F.col("output").try_cast(types[kind])
    return docs.join(newest.select(F.col("document_id").alias("id"), v.alias(field)), "id", "left")


def assemble_pages(pages: DataFrame, heading: bool = False) -> DataFrame:
    """(document_id, text) of documents all of whose pages are there, in page order with an empty line between; with headings,
    blank pages are left out."""
    body = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit("\n"), F.trim("text")) if heading else F.coalesce("text", F.lit(""))
    g = pages.groupBy("document_id").agg(
        F.count_if(F.col("state") != "completed").alias("open"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.lit(not heading) | (F.trim("text") != ""), F.struct("page", body.alias("t"))))), lambda x: x["t"]), "\n\n").alias("text"),
    )
    return g.where("open = 0").select("document_id", "text")


def active_revision(revisions: DataFrame, activations: DataFrame) -> DataFrame:
    """document_id, revision_id: the revision activated last."""
    return activations.join(revisions.select("revision_id", "document_id"), "revision_id").groupBy("document_id").agg(F.max_by("revision_id", F.struct("activated_at", "revision_id")).alias("revision_id"))
