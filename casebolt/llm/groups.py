"""Groups from pairwise links: randomised contraction.

In every round each vertex hooks to the neighbour (or itself) whose hash, fresh in each round, comes first; edges are relabelled to
the hooks and de-duplicated, and edges within a vertex vanish. When no edge is left the hooks of all rounds are expanded from the
last to the first. The number of rounds grows with the logarithm of the number of vertices. Every round is written to the shared
folder, so lineage stays short. Aggregations combine before the shuffle; the joins split hot vertices by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebolt.common import Scratch, norm_text_key

MAX_ROUNDS = 200
#: Salts of a hot key: its members meet in so many tasks before their representatives meet in one.
SALTS = 64


def contract(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) of every vertex with an edge to another one; vertices are longs. All linked vertices share the root, one of
    them. Loops, repeated edges, either order and nulls are allowed and add nothing."""
    spark = edges.sparkSession
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    e = scratch.put(e.distinct())
    hooks: list[DataFrame] = []
    for r in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        h = lambda c, r=r: F.xxhash64(F.lit(r), F.col(c))
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.col("a").alias("to")))).alias("x")).select("x.*")
        near = both.groupBy("v").agg(F.min(F.struct(h("to").alias("h"), "to")).alias("m"))
        hook = near.select("v", F.when(F.col("m.h") < h("v"), F.col("m.to")).otherwise(F.col("v")).alias("root"))
        hook = scratch.put(hook)
        hooks.append(hook)
        nxt = e.join(hook.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(hook.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
        old = e
        e = scratch.put(nxt.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        scratch.drop(old)
    else:
        raise RuntimeError("contraction did not end")
    if not hooks:
        return spark.createDataFrame([], "v long, root long")
    final = hooks[-1]
    for hook in reversed(hooks[:-1]):
        up = final.select(F.col("v").alias("root"), F.col("root").alias("top"))
        final = scratch.put(hook.join(up, "root", "left").select("v", F.coalesce("top", "root").alias("root")))
    return final


def label(vertices: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, group_id): every vertex with the smallest vertex linked to it, itself if alone. ``vertices`` has the column v."""
    roots = contract(edges, scratch)
    named = vertices.select("v").distinct().join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
    least = named.groupBy("root").agg(F.min("v").alias("group_id"))
    return named.join(least, "root").select("v", "group_id")


def star_edges(members: DataFrame, key: list[str], v: str = "v") -> DataFrame:
    """A tree over the members of each key: a member is linked to the least of its salt, the salts' least to the least of all.
    A key of a third of all rows is spread over SALTS tasks."""
    m = members.select(*key, F.col(v).alias("v")).distinct().withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    near = m.groupBy(*key, "salt").agg(F.min("v").alias("low"))
    top = near.groupBy(*key).agg(F.min("low").alias("top"))
    first = m.join(near, [*key, "salt"]).select(F.col("v").alias("a"), F.col("low").alias("b"))
    second = near.join(top, key).select(F.col("low").alias("a"), F.col("top").alias("b"))
    return first.unionByName(second).where("a <> b")


def consolidate(dedupe_keys: DataFrame, merge_blocks: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """record_kind, record_id, group_id of every document with a non-blank key and every entity in a row with both sides."""
    scratch = scratch or Scratch(dedupe_keys.sparkSession, "groups")
    # one graph for both kinds: documents are even vertices, entities odd ones
    k = dedupe_keys.where("document_id is not null").select(F.col("basis"), norm_text_key(F.col("key_value")).alias("key"), (F.col("document_id") * 2).alias("v")).where("key is not null and basis is not null")
    e = merge_blocks.where("left_entity_id is not null and right_entity_id is not null").select((F.col("left_entity_id") * 2 + 1).alias("a"), (F.col("right_entity_id") * 2 + 1).alias("b"))
    edges = star_edges(k, ["basis", "key"]).unionByName(e)
    vertices = k.select("v").unionByName(e.select(F.explode(F.array("a", "b")).alias("v")))
    g = label(vertices, edges, scratch)
    return g.select(F.when(F.col("v").bitwiseAND(1) == 0, "document").otherwise("entity").alias("record_kind"), F.shiftright("v", 1).alias("record_id"), F.shiftright("group_id", 1).alias("group_id"))


#: Members of a group that one task pairs with the whole group.
PAIR_PART = 2_000


def pairs_within(members: DataFrame, keys: list[str], v: str, left: str, right: str) -> DataFrame:
    """(keys, left, right) of all pairs left < right of each group; for case lists that ask for every pair. A large group's left members
    are spread over parts, each of which meets a copy of the group, so the pairs of a group of any size come from many tasks."""
    size = members.groupBy(*keys).agg(F.ceil(F.count("*") / PAIR_PART).cast("int").alias("_parts"))
    m = members.join(size.where("_parts > 1"), keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    a = m.select(*keys, F.pmod(F.xxhash64(v), F.col("_parts")).cast("int").alias("_part"), F.col(v).alias(left))
    b = m.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col(v).alias(right))
    return a.join(b, [*keys, "_part"]).where(F.col(left) < F.col(right)).select(*keys, left, right)
