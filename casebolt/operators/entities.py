"""Entities: identifiers, merge policy, canonical pointers, labels, links, caches, similarity, ordered resolution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebolt.common import Scratch
from casebolt.functions import identifiers as ids
from casebolt.functions import people
from casebolt.operators.conversations import components

# Local parts of system and shared mailboxes (letters and digits only), parts that any system mailbox holds, names of shared
# mailboxes, words of organisations.
SYSTEM_BOXES = ["automated", "daemon", "donotreply", "mailerdaemon", "notification", "notifications", "noreply", "postmaster"]
SYSTEM_PARTS = ["donotreply", "noreply"]
SHARED_BOXES = ["admin", "allcompany", "billing", "contact", "events", "help", "hello", "info", "legal", "legalevents", "marketing", "news", "press", "sales", "support", "team"]
SHARED_NAMES = ["all company", "help desk", "legalweek", "support", "team"]
ORG_WORDS = ["inc", "llc", "llp", "ltd", "corp", "corporation", "company", "co", "plc", "gmbh", "sarl", "partners", "holdings"]


def entity_type(name: str, mail: str):
    """system_mailbox, shared_mailbox, organization, person (an address of its own or a full name) or unknown, by the first rule that holds."""
    address = ids.email(mail)
    box = F.regexp_replace(F.substring_index(address, "@", 1), "[^a-z0-9]+", "")
    words = F.coalesce(ids.lookup_text(name), F.lit(""))
    has = lambda xs: words.rlike(r"\b(" + "|".join(xs) + r")\b")
    return (
        F.when(box.isin(*SYSTEM_BOXES) | box.rlike("|".join(SYSTEM_PARTS)), "system_mailbox")
        .when(box.isin(*SHARED_BOXES) | (address.isNotNull() & has(SHARED_NAMES)), "shared_mailbox")
        .when(has(ORG_WORDS), "organization")
        .when(address.isNotNull() | people.is_full_name(name), "person").otherwise("unknown")
    )


def auto_merge(identifiers: DataFrame, policy: dict[str, bool] | None = None) -> DataFrame:
    """Identifiers that may merge entities: e-mails and handles by default, a handle only with provider and scope, a name only with
    its full and sort form, external ids of the named kinds."""
    p = {"email": True, "handle": True, "phone": False, "name": False, "external_id": False} | (policy or {})
    kind = F.lower(F.trim("identifier_type"))
    on = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in p.items() for x in kv]), kind), F.lit(False))
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    need = F.when(kind == "handle", full("provider") & full("provider_scope")).when(kind == "name", full("normalized_full_name") & full("normalized_sort_name")).otherwise(True)
    return identifiers.where(on & need & full("normalized_value"))


def canonical(pointers: DataFrame, scratch: Scratch | None = None, rounds: int = 64) -> DataFrame:
    """id -> the end of its chain of merges (id, merged_into); pointer doubling, a cycle ends at its least member."""
    scratch = scratch or Scratch(pointers.sparkSession, "pointers")
    start = pointers.select("id", F.coalesce("merged_into", "id").alias("to"))
    cur = scratch.put(start)
    for _ in range(rounds):
        up = cur.select(F.col("id").alias("to"), F.col("to").alias("next"))
        nxt = scratch.put(cur.join(up, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        moved = nxt.join(cur.withColumnRenamed("to", "old"), "id").where("to <> old").limit(1).count()
        scratch.drop(cur)
        cur = nxt
        if not moved:
            break
    # whoever does not end at an unmerged entity is on a cycle or leads to one: the least of them all stands for them
    open_ends = pointers.where("merged_into is null").select(F.col("id").alias("to"))
    lost = cur.join(open_ends, "to", "left_anti").select("id")
    if lost.isEmpty():
        return cur.withColumnRenamed("to", "canonical_id")
    both = pointers.join(lost, "id", "left_semi").select("id", F.explode(F.array("id", "merged_into").cast("array<string>")).alias("signal"))
    return cur.join(components(both, scratch), "id", "left").select("id", F.coalesce("component", "to").alias("canonical_id"))


def caches(entities: DataFrame, identifiers: DataFrame) -> DataFrame:
    """entity_id, primary_email, primary_phone, display_name: primary and oldest first; a name with a space before any other."""
    kind = F.lower(F.trim("identifier_type"))
    pick = lambda k, extra=F.lit(0): F.min_by("display_value", F.when((kind == k) & (F.trim("display_value") != ""), F.struct(extra.alias("x"), (1 - F.coalesce("is_primary", F.lit(0))).alias("p"), "identifier_id")))
    g = identifiers.groupBy("entity_id").agg(pick("email").alias("primary_email"), pick("phone").alias("primary_phone"), pick("name", F.when(F.trim("display_value").contains(" "), 0).otherwise(1)).alias("display_name"))
    return entities.select("entity_id").join(g, "entity_id", "left")


def role_inventory(links: DataFrame) -> DataFrame:
    """role, entity_id, documents."""
    return links.groupBy("role", "entity_id").agg(F.countDistinct("document_id").alias("documents"))


def sync_links(candidates: DataFrame, ignored: DataFrame, overrides: DataFrame) -> DataFrame:
    """(document_id, role, ordinal, entity_id): candidates in the order of their copies, without ignored entities, each entity once
    a role. The newest override of a document and entity (a null role stands for every role) removes or replaces it."""
    c = candidates.join(ignored.select("entity_id"), "entity_id", "left_anti")
    w = W.partitionBy("document_id", "entity_id", "for_role").orderBy(F.desc("id"))
    o = overrides.select("id", "document_id", "entity_id", F.coalesce("role", F.lit("*")).alias("for_role"), "action", "to_entity_id")
    both = c.join(o, ["document_id", "entity_id"], "left").where("for_role is null or for_role = '*' or for_role = role")
    last = both.withColumn("_r", F.row_number().over(W.partitionBy("document_id", "role", "entity_id", "copy_order", "position").orderBy(F.col("id").desc_nulls_last()))).where("_r = 1")
    kept = last.where("action is null or action <> 'remove'").withColumn("entity_id", F.when(F.col("action") == "replace", F.col("to_entity_id")).otherwise(F.col("entity_id")))
    first = kept.groupBy("document_id", "role", "entity_id").agg(F.min(F.struct("copy_order", "position")).alias("at"))
    return first.select("document_id", "role", F.row_number().over(W.partitionBy("document_id", "role").orderBy("at", "entity_id")).alias("ordinal"), "entity_id")


def document_caches(links: DataFrame, labels: DataFrame) -> DataFrame:
    """document_id, author (the first), participants, recipients (joined), custodians (list)."""
    j = links.join(labels.select("entity_id", "label"), "entity_id")
    names = lambda r: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("ordinal", "label")))), lambda x: x["label"])
    g = j.groupBy("document_id").agg(names("author").alias("a"), names("participant").alias("p"), names("recipient").alias("r"), names("custodian").alias("custodians"))
    return g.select("document_id", F.get("a", F.lit(0)).alias("author"), F.array_join("p", ", ").alias("participants"), F.array_join("r", ", ").alias("recipients"), "custodians")


def similar(entities: DataFrame, of: DataFrame, most_distance: int = 2) -> DataFrame:
    """(entity_id, other_id, distance) of names within an edit distance, among names that share a word or the start of one."""
    key = lambda c: F.explode(F.array_distinct(F.transform(F.filter(F.split(ids.lookup_text(c), " "), lambda x: F.length(x) >= 3), lambda x: F.substring(x, 1, 4))))
    a = of.select("entity_id", F.lower("display_name").alias("name"), key("display_name").alias("k"))
    b = entities.select(F.col("entity_id").alias("other_id"), F.lower("display_name").alias("other"), key("display_name").alias("k"))
    d = F.levenshtein("name", "other", most_distance)
    return a.join(b, "k").where("entity_id <> other_id").withColumn("distance", d).where("distance >= 0").select("entity_id", "other_id", "distance").distinct()


RESOLVED = "candidate_id long, entity_id long, outcome string"


def replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one component in order: one known entity is reused unless the concrete types conflict, none makes a new one,
    several make a new one that registers no key."""
    owner: dict[str, int] = {}
    kind: dict[int, str] = {}
    out = []
    for r in pdf.sort_values("candidate_id").itertuples():
        keys = list(r.keys)
        hit = {owner[k] for k in keys if k in owner}
        one = next(iter(hit)) if len(hit) == 1 else None
        clash = one is not None and kind[one] != r.entity_type and "unknown" not in (kind[one], r.entity_type)
        if one is not None and not clash:
            e, what = one, "reused"
        else:
            e, what = int(r.candidate_id), "ambiguous" if len(hit) > 1 else "conflict" if clash else "new"
            kind[e] = r.entity_type
        if what in ("reused", "new"):
            for k in keys:
                owner.setdefault(k, e)
            if kind[e] == "unknown":
                kind[e] = r.entity_type
        out.append((int(r.candidate_id), e, what))
    return pd.DataFrame(out, columns=["candidate_id", "entity_id", "outcome"])


def resolve(candidates: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """candidate_id, entity_id (its first candidate), outcome, from candidates(candidate_id, keys array, entity_type). The ordered
    rule runs inside the connected components of shared keys, so the result is that of one sequential run."""
    comp = components(candidates.select(F.col("candidate_id").alias("id"), F.explode("keys").alias("signal")), scratch)
    j = candidates.join(comp.withColumnRenamed("id", "candidate_id"), "candidate_id", "left").withColumn("component", F.coalesce("component", "candidate_id"))
    return j.groupBy("component").applyInPandas(lambda pdf: replay(pdf), RESOLVED)


# ---- hints and manual decisions
def with_hints(hints: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (document_id, role, position, candidate_key, match_keys array) of hints first, then those read from text that share no match
    key and no candidate key with a hint of the same document and role; a repeated candidate key counts once."""
    at = ["document_id", "role"]
    covered = hints.select(*at, F.explode(F.array_union("match_keys", F.array(F.concat(F.lit("#"), "candidate_key")))).alias("k")).distinct()
    asked = candidates.select(*at, "position", F.explode(F.array_union("match_keys", F.array(F.concat(F.lit("#"), "candidate_key")))).alias("k"))
    hit = asked.join(covered, [*at, "k"], "left_semi").select(*at, "position").distinct()
    rest = candidates.join(hit, [*at, "position"], "left_anti")
    both = hints.withColumn("source", F.lit("hint")).unionByName(rest.withColumn("source", F.lit("text")))
    first = W.partitionBy(*at, "candidate_key").orderBy("source", "position")
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def block(blocks: DataFrame, left: int, right: int) -> DataFrame:
    """Pairs that must not be merged, each with its lesser id on the left and once."""
    one = blocks.sparkSession.createDataFrame([(min(left, right), max(left, right))], "left_entity_id long, right_entity_id long")
    both = blocks.select(F.least("left_entity_id", "right_entity_id").alias("left_entity_id"), F.greatest("left_entity_id", "right_entity_id").alias("right_entity_id")).unionByName(one)
    return both.where("left_entity_id < right_entity_id").distinct()


def merge(entities: DataFrame, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entities after merges (source_id, target_id): the source keeps a pointer to the target and the status merged. Blocked pairs, an entity with
    itself and sources that are merged already stay as they are; of several targets of a source the least counts."""
    b = blocks.select(F.least("left_entity_id", "right_entity_id").alias("lo"), F.greatest("left_entity_id", "right_entity_id").alias("hi"))
    ok = pairs.where("source_id <> target_id").withColumns({"lo": F.least("source_id", "target_id"), "hi": F.greatest("source_id", "target_id")}).join(b, ["lo", "hi"], "left_anti")
    to = ok.groupBy(F.col("source_id").alias("entity_id")).agg(F.min("target_id").alias("_to"))
    j = entities.join(to, "entity_id", "left")
    new = F.col("_to").isNotNull() & (F.col("canonical_status") != "merged")
    return j.withColumns({"merged_into": F.when(new, F.col("_to")).otherwise(F.col("merged_into")), "canonical_status": F.when(new, "merged").otherwise(F.col("canonical_status"))}).drop("_to")


def ignore(entities: DataFrame, ids_: DataFrame) -> DataFrame:
    """Entities with those of ``ids_`` ignored: they are linked no more and listed apart."""
    hit = ids_.select("entity_id").distinct().withColumn("_hit", F.lit(True))
    return entities.join(hit, "entity_id", "left").withColumn("canonical_status", F.when(F.col("_hit") & (F.col("canonical_status") != "merged"), "ignored").otherwise(F.col("canonical_status"))).drop("_hit")


def split(entities: DataFrame, identifiers: DataFrame, entity_id: int, identifier_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(entities, identifiers) after some identifiers of an entity moved to a new one of the same type and origin manual."""
    new = entities.agg(F.max("entity_id")).first()[0] + 1  # one number
    mine = (F.col("entity_id") == entity_id) & F.col("identifier_id").isin(identifier_ids)
    if identifiers.where(mine).isEmpty():
        raise ValueError(f"none of the identifiers belongs to entity {entity_id}")
    fresh = entities.where(F.col("entity_id") == entity_id).withColumns({"entity_id": F.lit(new).cast("long"), "entity_origin": F.lit("manual"), "canonical_status": F.lit("active"), "merged_into": F.lit(None).cast("long")})
    return entities.unionByName(fresh), identifiers.withColumn("entity_id", F.when(mine, F.lit(new)).otherwise(F.col("entity_id")))


def assign(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Links (document_id, role, entity_id) after changes (document_id, role, entity_id, action assign | unassign, at): the last one of a link
    decides, and each link is there once."""
    last = changes.groupBy("document_id", "role", "entity_id").agg(F.max_by("action", "at").alias("action"))
    kept = links.join(last.where("action = 'unassign'"), ["document_id", "role", "entity_id"], "left_anti").select("document_id", "role", "entity_id")
    return kept.unionByName(last.where("action = 'assign'").select("document_id", "role", "entity_id")).distinct()


def edit(entities: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Entities after edits (entity_id, fields...): a null leaves a field alone; an unknown id is a new entity of origin manual."""
    c = changes.select("entity_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_c"))
    j = entities.withColumn("_e", F.lit(True)).join(c, "entity_id", "full")
    out = j.withColumns({f: F.coalesce(f"_{f}", f) for f in fields})
    return out.withColumns({"entity_origin": F.when(F.col("_e").isNull(), "manual").otherwise(F.col("entity_origin")), "canonical_status": F.coalesce("canonical_status", F.lit("active"))}).select(entities.columns)


def listing(entities: DataFrame, links: DataFrame, status: str = "active") -> DataFrame:
    """entity_id, label, entity_type, documents of the entities of a status; entities without documents count none."""
    n = links.groupBy("entity_id").agg(F.countDistinct("document_id").alias("documents"))
    e = entities.where(F.col("canonical_status") == status).select("entity_id", ids.label("display_name", "primary_email", "primary_phone", "entity_id").alias("label"), "entity_type")
    return e.join(n, "entity_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
