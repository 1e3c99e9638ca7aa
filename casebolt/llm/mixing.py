"""Mixing sources to target shares of the total size, with a cap on repeats.

Each source gets a budget of tokens. It is filled with whole passes over the source and, for the rest, with the documents whose
hash lies under a threshold. The threshold comes from nested histograms: token sums by the leading hash digits, then by further
digits inside the one bucket where the budget ends. Rows are filtered by comparing hashes; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebolt.common import Scratch
from casebolt.llm.tokens import DEFAULT_VOCABULARY, count_tokens

#: Hash digits per level: 2 ** DIGIT_BITS buckets of each source.
DIGIT_BITS, LEVELS = 12, 5


def _targets(targets: DataFrame) -> list[dict]:
    """The target table is a short list of sources (one row each; repeated sources are added up)."""
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats")).collect()
    return [r.asDict() for r in rows]


def budgets(targets: list[dict], sizes: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens each source has to give. Without ``total``, the largest total at which every source that has documents can give
    its share within its repeats; a listed source without documents gives nothing. A source never gives more than it can."""
    have = [t for t in targets if sizes.get(t["source"])]
    if not have:
        return {}
    if total is None:
        total = min(sizes[t["source"]] * t["repeats"] / t["share"] for t in have)
    return {t["source"]: min(total * t["share"], sizes[t["source"]] * t["repeats"]) for t in have}


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, vocabulary: str = DEFAULT_VOCABULARY, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats (at least 1) of the chosen documents. Documents of a null or unlisted source and
    empty or null texts (no tokens) are never chosen."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    wanted = _targets(targets)
    listed = spark.createDataFrame([(t["source"], t["share"], t["repeats"]) for t in wanted], "source string, share double, max_repeats int")
    # semi-join, not a literal list, so that any number of sources works
    counted = count_tokens(docs.select("doc_id", "source", "text"), ["doc_id", "source"], vocabulary=vocabulary).where("n_tokens > 0 and source is not null")
    sized = scratch.put(counted.join(listed.select("source"), "source", "left_semi").withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)))
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per listed source
    give = budgets(wanted, sizes, total)
    state = {s: {"passes": int(b // sizes[s]), "rest": b - int(b // sizes[s]) * sizes[s], "prefix": 0} for s, b in give.items()}
    for level in range(1, LEVELS + 1):
        live = {s: st for s, st in state.items() if "below" not in st}
        if not live:
            break
        ask = spark.createDataFrame([(s, st["prefix"], float(st["rest"])) for s, st in live.items()], "source string, prefix long, rest double")
        digit = F.shiftrightunsigned("h", 63 - DIGIT_BITS * level)
        inside = sized.join(ask, "source").where(F.shiftright(digit, DIGIT_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", "rest", digit.alias("digit")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
        run = hist.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("digit").rowsBetween(W.unboundedPreceding, 0)))
        edge = run.where("upto > rest").groupBy("source").agg(F.min(F.struct("digit", "upto", "n", "docs")).alias("e")).collect()  # one row per source
        met = {r["source"]: r["e"] for r in edge}
        for s, st in live.items():
            e = met.get(s)
            if e is None:  # the rest takes every document left under this prefix
                st["below"] = min((st["prefix"] + 1) << (63 - DIGIT_BITS * (level - 1)), 2**63 - 1)
                continue
            st["rest"] -= e["upto"] - e["n"]
            st["prefix"] = e["digit"]
            if e["docs"] <= 1 or level == LEVELS:
                st["below"] = e["digit"] << (63 - DIGIT_BITS * level)
    plan = spark.createDataFrame([(s, st["passes"], st["below"]) for s, st in state.items()], "source string, passes int, below long")
    out = sized.join(plan, "source").withColumn("repeats", F.col("passes") + (F.col("h") < F.col("below")).cast("int"))
    return out.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and actual share of all chosen tokens, documents, copies and the most repeats used."""
    g = chosen.groupBy("source").agg(F.count("*").alias("docs"), F.sum("repeats").cast("long").alias("copies"), F.sum(F.col("n_tokens") * F.col("repeats")).cast("long").alias("tokens"), F.max("repeats").alias("most_repeats"))
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    j = t.join(g, "source", "left").fillna(0, ["docs", "copies", "tokens", "most_repeats"])
    # one row per listed source, so one window holds them all
    j = j.withColumn("all_tokens", F.sum("tokens").over(W.partitionBy(F.lit(1))))
    return j.select("source", "target_share", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), "tokens", "docs", "copies", "most_repeats", "max_repeats")
