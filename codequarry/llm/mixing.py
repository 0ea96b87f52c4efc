"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.llm.common import cut_lineage
from codequarry.llm.tokens import DEFAULT_VOCABULARY, token_count


def water_fill(weights: list[float], caps: list[float], total: float) -> list[float]:
    """Amounts in proportion to the weights that sum to ``total``, none above its cap.

    Items over their cap are clamped and their excess goes to the others in proportion, until
    nothing is over; where all are clamped the sum is less than the total."""
    amounts = [0.0] * len(weights)
    free = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = total
    while free and left > 0:
        scale = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / scale >= caps[i]]
        if not over:
            for i in free:
                amounts[i] = left * weights[i] / scale
            break
        for i in over:
            amounts[i] = caps[i]
            left -= caps[i]
        free = [i for i in free if i not in over]
    return amounts


class Mixture:
    """Every plan's mixture of documents.

    ``total_tokens`` is the size of each mixture; by default the tokens of all documents whose source
    the plan names.  Weights need not add up to 1; null, negative and NaN weights count as 0, a null
    max_repeats as 1, and repeated rows of a (plan, source) once (largest weight).  A document is
    used a whole number of times, at most max_repeats: ``floor(epochs)`` times, and once more for a
    seeded selection of documents that carries the fraction.  Documents with a null source, null or
    empty texts belong to no source; repeated doc_ids count once.

    Selection orders a source by a seeded hash of doc_id: tokens are summed by hash bucket (map-side
    first), the bucket in which the wanted amount ends is found among these sums, and only that bucket
    is ordered by document.  No source is gathered in one task.
    """

    BUCKETS = 4096

    def __init__(self, documents: DataFrame, plan: DataFrame, total_tokens: int | None = None, seed: int = 0, vocabulary: str = DEFAULT_VOCABULARY):
        spark = documents.sparkSession
        sized = documents.where("source is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count(F.col("text"), vocabulary).alias("tokens"))
        sized = sized.where("tokens > 0").groupBy("doc_id").agg(F.max_by("source", F.struct("tokens", "source")).alias("source"), F.max("tokens").alias("tokens"))
        order = F.xxhash64(F.lit(seed), "doc_id")
        self.sized = cut_lineage(sized.select("doc_id", "source", "tokens", order.alias("_order"), F.pmod(order, F.lit(self.BUCKETS)).cast("int").alias("_bucket")))
        per_bucket = cut_lineage(self.sized.groupBy("source", "_bucket").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
        # a plan has one row for each of its sources; what is gathered here is the plan, not documents
        wanted = plan.select("plan_name", F.col("source").cast("string").alias("source"), F.when(F.col("target_weight") > 0, F.nanvl("target_weight", F.lit(0.0))).otherwise(0.0).alias("weight"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).alias("most"))
        wanted = wanted.groupBy("plan_name", "source").agg(F.max("weight").alias("weight"), F.max_by("most", "weight").alias("most"))
        have = per_bucket.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("documents").alias("documents"))
        rows = wanted.join(have, "source", "left").na.fill(0, ["available", "documents"]).collect()
        out = []
        for name in sorted({r["plan_name"] for r in rows}, key=str):
            mine = sorted((r for r in rows if r["plan_name"] == name), key=lambda r: str(r["source"]))
            total = total_tokens if total_tokens is not None else sum(r["available"] for r in mine)
            weights = [float(r["weight"]) for r in mine]
            amounts = water_fill(weights, [float(r["most"] * r["available"]) for r in mine], float(total))
            scale = sum(weights) or 1.0
            for r, w, a in zip(mine, weights, amounts):
                epochs = a / r["available"] if r["available"] else 0.0
                whole = min(int(epochs + 1e-12), r["most"])
                part = 0.0 if whole >= r["most"] else max(0.0, a - whole * r["available"])
                out.append((name, r["source"], w, w / scale, int(r["most"]), int(r["available"]), int(r["documents"]), a / (sum(amounts) or 1.0), epochs, whole, part))
        schema = "plan_name string, source string, target_weight double, target_share double, max_repeats int, available_tokens long, available_documents long, wanted_share double, epochs double, whole int, part double"
        self.plan = spark.createDataFrame(out, schema)
        self.per_bucket = per_bucket

    def selection(self) -> DataFrame:
        """plan_name, source, doc_id, tokens, repeats (at least 1)."""
        plan = self.plan.where("whole > 0 or part > 0").select("plan_name", "source", "whole", "part")
        upto = Window.partitionBy("plan_name", "source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        # at most BUCKETS rows for each source
        edges = self.per_bucket.select("source", "_bucket", "tokens").join(F.broadcast(plan), "source").withColumn("_before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
        edges = edges.select("plan_name", "source", "_bucket", "whole", "part", "_before", (F.col("_before") + F.col("tokens") <= F.col("part")).alias("_in"), ((F.col("_before") < F.col("part")) & (F.col("_before") + F.col("tokens") > F.col("part"))).alias("_edge"))
        docs = self.sized.join(edges, ["source", "_bucket"])
        inside = docs.where("not _edge").select("plan_name", "source", "doc_id", "tokens", (F.col("whole") + F.col("_in").cast("int")).alias("repeats"))
        running = F.sum("tokens").over(Window.partitionBy("plan_name", "source", "_bucket").orderBy("_order", "doc_id"))
        # the last document is taken if most of it is wanted, so that shares are met to half a document
        edge = docs.where("_edge").withColumn("_upto", running).select("plan_name", "source", "doc_id", "tokens", (F.col("whole") + (F.col("_before") + F.col("_upto") - F.col("tokens") / 2 <= F.col("part")).cast("int")).alias("repeats"))
        return inside.unionByName(edge).where("repeats > 0")

    def report(self) -> DataFrame:
        """For each plan and source: target, wanted (after clamping) and actual share of tokens, epochs and documents used."""
        used = self.selection().groupBy("plan_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.sum("repeats").alias("used_documents"), F.max("repeats").alias("most_repeats"))
        out = self.plan.join(used, ["plan_name", "source"], "left").na.fill(0, ["used_tokens", "used_documents", "most_repeats"])
        total = F.sum("used_tokens").over(Window.partitionBy("plan_name"))
        return out.select(
            "plan_name", "source", "target_weight", F.round("target_share", 6).alias("target_share"), F.round("wanted_share", 6).alias("wanted_share"), F.coalesce(F.round(F.col("used_tokens") / F.nullif(total, F.lit(0)), 6), F.lit(0.0)).alias("actual_share"),
            "max_repeats", F.round("epochs", 6).alias("epochs"), "available_tokens", "used_tokens", "available_documents", "used_documents", "most_repeats",
        )
