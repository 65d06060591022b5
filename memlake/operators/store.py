"""Scans, filters, reports and feeds over the memories table.

Every function takes and gives DataFrames; clocks are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring as S
from memlake.operators import folds as FO

SCAN_LIMIT = 1000


def active(mem: DataFrame, memory_type: str | None = None, user_id: str | None = None) -> DataFrame:
    """Active rows; a tenant of None means all tenants."""
    out = mem.where("status = 'active'")
    if memory_type is not None:
        out = out.where(F.col("memory_type") == memory_type)
    return out if user_id is None else out.where(F.col("user_id") == user_id)


def newest(mem: DataFrame, limit: int = SCAN_LIMIT) -> DataFrame:
    return active(mem).orderBy(F.desc("updated_at"), "memory_id").limit(limit)


def by_subject(mem: DataFrame, subject: str | None = None, relation: str | None = None, domain: str | None = None, limit: int = 50) -> DataFrame:
    out = active(mem, "belief")
    for name, value in (("subject", subject), ("relation", relation), ("domain", domain)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.orderBy(F.desc("confidence"), "memory_id").limit(limit)


def is_local(repo: str | None) -> Column:
    """Rows without a stamp, of the same repository, or about the user, are local."""
    if repo is None:
        return F.lit(True)
    return F.col("repo_id").isNull() | (F.col("repo_id") == repo) | (F.lower(F.trim("subject")) == "user")


def scored(candidates: DataFrame, now: Column, similarity: Column) -> DataFrame:
    """candidates with recency, usage and the composite score by tier; tier TX is dropped after the usage maximum is taken."""
    peak = candidates.agg(F.max("access_count").alias("_most"))
    out = candidates.crossJoin(F.broadcast(peak))  # one row
    score = S.composite(similarity, F.col("confidence"), S.recency(now, F.col("updated_at")), S.usage(F.col("access_count"), F.col("_most")))
    return out.withColumn("score", score * S.tier_factor(F.col("doc_tier"))).where(~F.col("doc_tier").eqNullSafe("TX")).drop("_most")


def recent_feed(mem: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """The newest active rows by composite score with similarity 0."""
    return scored(newest(mem), now, F.lit(0.0)).orderBy(F.desc("score"), F.desc("updated_at"), "memory_id").limit(limit)


def ranked_by_type(hits: DataFrame) -> DataFrame:
    """Rank of each hit within its type, in the order of the whole list."""
    return hits.withColumn("type_rank", F.row_number().over(Window.partitionBy("memory_type").orderBy(F.desc("score"), F.desc("updated_at"), "memory_id")))


def context_rows(mem: DataFrame, now: Column, repo: str, foreign: int = 3, limit: int = 12) -> DataFrame:
    """Rows of a context block: local ones first, few foreign ones, best scores."""
    rows = scored(newest(mem), now, F.lit(0.0)).withColumn("is_foreign", (~is_local(repo)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("is_foreign").orderBy(F.desc("score"), "memory_id"))
    rows = rows.withColumn("place", rank).where((F.col("is_foreign") == 0) | (F.col("place") <= foreign)).where(F.col("place") <= limit)
    return rows.orderBy("is_foreign", F.desc("score"), "memory_id").limit(limit)


def within_budget(rows: DataFrame, order: list, cost: Column, budget: int, partition: list[str] | None = None) -> DataFrame:
    """The prefix of the rows, in order, whose running cost fits the budget."""
    window = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(window)).where(F.col("running") <= budget)


def leaderboard(mem: DataFrame, success: Column, attempts: Column, limit: int = 10) -> DataFrame:
    """Skills by success rate; only the limit*10 most confident are looked at."""
    pool = active(mem, "skill").orderBy(F.desc("confidence"), "memory_id").limit(limit * 10)
    rate = F.when(attempts > 0, success / attempts).otherwise(F.lit(0.0))
    return pool.select("memory_id", "confidence", attempts.alias("attempts"), rate.alias("success_rate")).orderBy(F.desc("success_rate"), F.desc("attempts"), F.desc("confidence"), "memory_id").limit(limit)


def decay_pass(mem: DataFrame, now: Column) -> DataFrame:
    """Every active row with a decay rate after one pass: new confidence, and whether it is archived."""
    days = S.days_between(now, F.col("updated_at"))
    rows = active(mem).where("decay_rate > 0").withColumn("days", days).where("days > 0")
    rows = rows.withColumn("new_confidence", S.decayed(F.col("confidence"), F.col("decay_rate"), F.col("days")))
    gone = (F.col("new_confidence") < S.ARCHIVE_BELOW) & (F.col("memory_type") != "skill")
    return rows.withColumn("new_status", F.when(gone, "archived").otherwise(F.col("status")))


def prune_pass(mem: DataFrame, now: Column, event_days: int = 90, skill_days: int = 60) -> DataFrame:
    """Unlinked old events are archived, unused skills deprecated."""
    age = S.days_between(now, F.col("created_at"))
    idle = S.days_between(now, F.coalesce("last_used", "created_at"))
    unlinked = F.coalesce(F.size("related_beliefs"), F.lit(0)) <= 0
    target = F.when((F.col("memory_type") == "event") & (age > event_days) & unlinked, "archived").when((F.col("memory_type") == "skill") & (idle > skill_days), "deprecated")
    return active(mem).withColumn("new_status", target).where("new_status is not null")


def patterns(mem: DataFrame, now: Column, days: int = 7, least: int = 3) -> DataFrame:
    """Recurring subjects, repeated events and generalised skills of the last days."""
    rows = active(mem).where(S.days_between(now, F.col("created_at")).between(0, days)).withColumn("s", F.lower("subject")).withColumn("r", F.lower("relation")).withColumn("o", F.lower("object"))

    def found(kind: str, part: DataFrame, *keys: str) -> DataFrame:
        grouped = part.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("subject", F.struct("created_at", "memory_id")).alias("subject"))
        return grouped.where(F.col("n") >= least).select(F.lit(kind).alias("pattern"), F.concat_ws("|", *keys).alias("pattern_key"), "subject", "n")

    return found("recurring_subject", rows.where("memory_type = 'belief'"), "s").unionByName(found("repeated_event", rows.where("memory_type = 'event'"), "s", "r", "o")).unionByName(found("skill_generalisation", rows.where("memory_type = 'skill'"), "s", "o"))


def fold_reinforcements(mem: DataFrame, source_weight: float = 0.7) -> DataFrame:
    """Beliefs of one (tenant, subject, relation, object) reinforced in order of creation by the Bayesian update.

    The first belief sets confidence and weight 1; each further one moves both.
    An update is linear in the confidence before it, as its weight is its number, so updates are composed (``operators.folds``).
    """
    keys = ["user_id", "subject", "relation", "object"]
    rows = mem.where("memory_type = 'belief'").select(*keys, F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "memory_id", "confidence", "decay_rate")
    rows = FO.numbered(rows, keys, ["at", "memory_id"], "reinforced")
    days = (F.col("at") - F.col("before.at")) / F.lit(S.DAY * 1e6)
    first, i = F.col("i") == 1, F.col("i")
    kept = F.when(first, 0.0).otherwise((i - 1) * F.exp(-F.col("decay_rate") * days) / i)
    told = F.when(first, F.col("confidence")).otherwise(F.lit(source_weight) * F.col("confidence") / i)
    lo, hi = F.when(first, -FO.BIG).otherwise(0.0), F.when(first, FO.BIG).otherwise(1.0)
    done = FO.folded(rows.withColumn("u", FO.update(kept, told, lo, hi)), keys)
    return done.select(*keys, F.col("n").alias("times"), FO.apply(F.col("u"), F.lit(0.0)).alias("confidence"), F.col("n").cast("double").alias("prior_weight"))


def fold_outcomes(rows: DataFrame, key: str, order: list[str], success: Column) -> DataFrame:
    """``key, confidence, outcomes``: a skill's confidence after its outcomes in order; it begins with SKILL_START, which the first row stands for."""
    rows = FO.numbered(rows, [key], order, "outcomes")
    one = F.when(F.col("i") == 1, FO.update(0.0, S.SKILL_START)).when(success, FO.update(1.0, S.SKILL_GAIN, hi=1.0)).otherwise(FO.update(S.SKILL_LOSS, 0.0))
    done = FO.folded(rows.withColumn("u", one), [key])
    return done.select(key, FO.apply(F.col("u"), F.lit(0.0)).alias("confidence"), F.col("n").alias("outcomes"))


def classify(relation: Column, event: set[str], skill: set[str], world: set[str]) -> Column:
    """Memory type of a normalised relation: event before skill before world_model before belief."""
    name = F.translate(F.lower(F.trim(relation)), " -", "__")
    return F.when(name.isin(*sorted(event)), "event").when(name.isin(*sorted(skill)), "skill").when(name.isin(*sorted(world)), "world_model").otherwise("belief")


def merge_records(existing: DataFrame, incoming: DataFrame, policy: str) -> DataFrame:
    """Rows after an import by id: ``skip`` keeps what exists, ``force`` takes what comes, ``newest`` the later updated_at. ``action`` says what happened."""
    both = existing.alias("e").join(incoming.alias("i"), F.col("e.memory_id") == F.col("i.memory_id"), "full_outer")
    fresh = F.col("e.memory_id").isNull()
    alone = F.col("i.memory_id").isNull()
    take = {"skip": F.lit(False), "force": F.lit(True), "newest": F.col("i.updated_at") > F.col("e.updated_at")}[policy]
    action = F.when(fresh, "inserted").when(alone, "untouched").when(F.coalesce(take, F.lit(False)), "updated").otherwise("skipped")
    use = fresh | (~alone & F.coalesce(take, F.lit(False)))
    return both.select(*[F.when(use, F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in existing.columns], action.alias("action"))


def flattened_text() -> Column:
    """One lower-case text of a memory's named fields, its lists, 'key value' of its properties, and its tags; empty fields are left out."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("subject", "relation", "object", "name", "description", "entity_type", "domain")]
    properties = F.transform(F.map_entries("properties"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    lists = [F.array_join(c, " ") for c in (F.col("trigger_conditions"), F.col("steps"), properties, F.col("tags"))]
    return F.lower(F.concat_ws(" ", *names, *lists))


def with_access(mem: DataFrame, log: DataFrame) -> DataFrame:
    """mem with the reads of a log (memory_id, at) added to access_count and last_used; updated_at stays, as reading changes nothing."""
    reads = log.groupBy("memory_id").agg(F.count("*").alias("_reads"), F.max("at").alias("_last"))
    both = mem.join(reads, "memory_id", "left")
    return both.withColumn("access_count", F.col("access_count") + F.coalesce("_reads", F.lit(0))).withColumn("last_used", F.greatest("last_used", "_last")).drop("_reads", "_last")
