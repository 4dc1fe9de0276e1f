"""How well image models fit a machine, and which pull requests come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The quantisations in the order in which they are tried, and each one's column.
QUANTS = (("BF16", "vram_bf16"), ("FP8", "vram_fp8"), ("Q4", "vram_q4"))
BONUS = {"perfect": 20, "good": 10, "tight": 5, "no_fit": -30}


def image_fit(models: DataFrame, gpu: Column) -> DataFrame:
    """models with quant, vram_needed, fit and score; gpu is the memory in GB, null or 0 without one.

    The first quantisation that leaves a tenth of the memory is taken; without one, the default at full precision's need.
    Without a GPU there is neither.
    """
    gpu = F.coalesce(gpu, F.lit(0.0))
    takes = [(q, F.col(v)) for q, v in QUANTS]
    quant = need = None
    for q, v in takes:
        ok = v <= gpu * 0.9
        quant = F.when(ok, q) if quant is None else quant.when(ok, q)
        need = F.when(ok, v) if need is None else need.when(ok, v)
    room = gpu - need
    fit = F.when(gpu <= 0, "no_gpu").when(need.isNull(), "no_fit").when(room > gpu * 0.3, "perfect").when(room > gpu * 0.1, "good").otherwise("tight")
    chosen = {"quant": F.coalesce(quant, F.col("default_quant")), "vram_needed": F.coalesce(need, F.col("vram_bf16"), F.lit(0.0))}
    out = models.withColumns({k: F.when(gpu > 0, v) for k, v in chosen.items()} | {"fit": fit})
    bonus = F.when(F.col("fit") == "no_gpu", 0)
    for name, points in BONUS.items():
        bonus = bonus.when(F.col("fit") == name, points)
    return out.withColumn("score", F.round(0.6 * F.col("quality") + 0.2 * F.col("speed") + bonus, 1))


def any_of(text: Column, *words: str) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def pull_score(pulls: DataFrame, now: Column) -> DataFrame:
    """(number, score) of pulls (number, title, files, merge_state, review_decision, updated_at)."""
    shared = pulls.select("number", F.explode("files").alias("f"))
    often = shared.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f")
    overlap = shared.join(often, "f").groupBy("number").agg(F.count(F.lit(1)).alias("overlap"))
    title, paths = F.lower("title"), F.lower(F.array_join("files", " "))
    text = F.concat_ws(" ", title, paths)
    # Words and weights.
    direct = any_of(paths, "auth", "token", "api_key", "api-key", "apikey", "key_manager", "security") & (
        any_of(title, "bearer token", "api token", "api key", "auth", "login", "privilege", "permission") | any_of(title, "deleted", "revoked", "expired", "disabled", "removed")
    )
    days = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))) / 86_400), F.lit(0))
    merge, review = F.lower(F.coalesce("merge_state", F.lit(""))), F.lower(F.coalesce("review_decision", F.lit("")))
    score = (
        F.when(direct, 45).when(any_of(text, "security", "secret", "privilege", "permission"), 22).otherwise(0)
        + F.when(any_of(text, "leak", "exposure", "cross-user", "cross user", "privacy"), 18).otherwise(0)
        + F.when(any_of(text, "data-loss", "persistence", "migration", "database", "sqlite", "postgres"), 20).otherwise(0)
        + F.when(any_of(text, "memory", "vector", "rag", "embedding", "retrieval"), 15).otherwise(0)
        + F.least(F.coalesce("overlap", F.lit(0)) * 3, F.lit(30)) + F.when(merge.isin("clean", "has_hooks"), 3).otherwise(0)
        + F.when(review == "approved", -8).when(review == "changes_requested", 10).when(review == "review_required", 6).when(review.isin("unknown", "", "none"), 4).otherwise(0)
        + F.when(days <= 7, 8).when(days <= 30, 4).otherwise(0)
    )
    return pulls.join(overlap, "number", "left").select("number", score.cast("long").alias("score"))
