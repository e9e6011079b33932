"""Evaluation of rules over tables: facts joined with rules give violations and decisions.

A rule is (rule_id, type, actor, action, object, has_condition, severity); a fact is (entity_id, actor, action,
object, status, completed, attempted, condition_met, ts). Rules join facts by actor, so the work follows the facts
that a rule is about.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def check_violations(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows that break a CHECK constraint: those for which it is false; an unknown (null) result passes."""
    return rows.where(~F.coalesce(predicate, F.lit(True)))


def prohibition_predicate(status: Column, as_emitted: bool = False) -> Column:
    """What must hold under a prohibition. as_emitted: the doubly negated form, which demands the forbidden status."""
    return status if as_emitted else ~status


#: Rules that go to all tasks at most; beyond, facts and rules meet by actor and salt.
BROADCAST_RULES, SALT = 10_000, 64


def joined(facts: DataFrame, rules: DataFrame, most: int = BROADCAST_RULES) -> DataFrame:
    """Facts with the rules of their actor. Few actors may hold most facts, so facts are not shuffled by actor alone."""
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    if rules.count() <= most:
        return facts.join(F.broadcast(r), F.lower("actor") == F.lower("r_actor"))
    r = r.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = facts.withColumn("__salt", F.pmod(F.xxhash64("entity_id"), F.lit(SALT)).cast("int"))
    return salted.join(r, (F.lower("actor") == F.lower("r_actor")) & (F.col("__salt") == F.col("__r_salt"))).drop("__salt", "__r_salt")


def trigger_log(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Audit rows as triggers would write them: an obligation that isn't met, a prohibition that is violated (always
    critical), and every event of another type. Nothing is raised in a batch."""
    hit = (
        F.when(F.col("r_type") == "obligation", ~F.coalesce("completed", F.lit(False))).when(F.col("r_type") == "prohibition",
            F.coalesce("attempted", F.lit(False))).otherwise(F.lit(True))
    )
    kind = F.when(F.col("r_type") == "obligation", "obligation_not_met").when(F.col("r_type") == "prohibition",
        "prohibition_violated").otherwise(F.concat("r_type", F.lit("_triggered")))
    return joined(facts, rules).where(hit).select("entity_id", F.col("r_rule_id").alias("rule_id"), kind.alias("violation_type"),
        F.when(F.col("r_type") == "prohibition", "critical").otherwise(F.col("r_severity")).alias("severity"),
        F.col("r_type").isin("obligation", "prohibition").alias("blocking"), "ts")


#: Fields of a fact that an image of a changed row holds.
IMAGE = "struct<actor:string,action:string,object:string,status:string,completed:boolean,attempted:boolean,condition_met:boolean>"


def fired(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Audit rows of triggers over a change log (change_id, op, entity_id, before, after, ts), op insert, update or delete, the
    images as IMAGE.

    Obligations are checked on the row to be, before inserts and updates; prohibitions on any change, a delete on the row that
    was. Both block the change. Rules of other types only note inserts and updates that go through, so they never fire for a
    blocked change, and only if their condition, where they have one, is met. Rules join by the actor of the image they are
    checked on. An unknown operation fires nothing; each row of the log is a change of its own; a null flag counts as false.
    """
    image = F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("after"))
    known = changes.where(F.col("op").isin("insert", "update", "delete")).withColumn("image", image)
    facts = known.select("change_id", "op", "entity_id", F.col("before.status").alias("status_before"), F.col("after.status").alias("status_after"), "ts", "image.*")
    kind, deleted = F.col("r_type"), F.col("op") == "delete"
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    hit = F.when(kind == "obligation", ~deleted & ~flag("completed")).when(kind == "prohibition", flag("attempted")).otherwise(
        ~deleted & (~flag("r_has_condition") | flag("condition_met")))
    name = F.when(kind == "obligation", "obligation_not_met").when(kind == "prohibition", "prohibition_violated").otherwise(F.concat(kind, F.lit("_triggered")))
    blocking = kind.isin("obligation", "prohibition")
    rows = joined(facts, rules).where(hit).select("change_id", "op", "entity_id", F.col("r_rule_id").alias("rule_id"), name.alias("violation_type"),
        F.when(kind == "prohibition", "critical").otherwise(F.col("r_severity")).alias("severity"), blocking.alias("blocking"), "status_before", "status_after", "ts")
    stopped = rows.where("blocking").select("change_id").distinct()
    return rows.where("blocking").unionByName(rows.where("NOT blocking").join(stopped, "change_id", "left_anti"))


def split_changes(changes: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) changes, by whether a blocking rule fired."""
    stopped = audit.where("blocking").select("change_id").distinct()
    return changes.join(stopped, "change_id", "left_anti"), changes.join(stopped, "change_id", "left_semi")


def replayed(accepted: DataFrame) -> DataFrame:
    """(entity_id, after): the table that accepted changes leave, by each entity's last change in (ts, change_id); deleted
    entities are gone."""
    last = accepted.groupBy("entity_id").agg(F.max_by(F.struct("op", "after"), F.struct("ts", "change_id")).alias("c"))
    return last.where("c.op <> 'delete'").select("entity_id", F.col("c.after").alias("after"))


def validator_outcomes(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict of each (fact, rule): here a missing completion is a violation, unlike in a CHECK."""
    violated = (
        F.when(F.col("r_type") == "obligation", ~F.coalesce("completed", F.lit(False))).when(F.col("r_type") == "prohibition",
            F.coalesce("attempted", F.lit(False)))
        .otherwise(F.coalesce(F.col("status") == "violation", F.lit(False)))
    )
    warned = (F.col("r_type") == "obligation") & F.col("r_object").isNotNull() & (F.coalesce("object", F.lit("")) == "")
    return joined(facts, rules).select("entity_id", F.col("r_rule_id").alias("rule_id"), violated.alias("violated"),
        F.array_compact(F.array(F.when(warned, F.concat(F.lit("no value for "), "r_object")))).alias("warnings"))


def enforce(facts: DataFrame, rules: DataFrame, raise_on_violation: bool = True, before: Callable[[DataFrame], DataFrame] | None = None,
    after: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """validator_outcomes; unless told otherwise, the first violation that a task meets ends the job with the rule's and
    the entity's id. before and after are hooks: functions of the facts before they are judged, and of the outcomes."""
    out = validator_outcomes(before(facts) if before else facts, rules)
    if raise_on_violation:
        message = F.format_string("rule %s violated by entity %s", F.col("rule_id"), F.col("entity_id").cast("string"))
        out = out.withColumn("violated", F.when(F.col("violated"), F.raise_error(message).cast("boolean")).otherwise(False))
    return after(out) if after else out


def decisions(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(entity_id, allow, violations): a request is allowed if any rule allows it; without a rule it is denied."""
    same = lambda a, b: F.lower(a) == F.lower(b)
    thing = F.col("r_object").isNull() | F.coalesce(same("object", "r_object"), F.lit(False))
    act = F.coalesce(same("action", "r_action"), F.lit(False)) & thing
    met = ~F.col("r_has_condition") | F.coalesce("condition_met", F.lit(False))
    allow = F.when(F.col("r_type") == "obligation", act & met).when(F.col("r_type") == "prohibition", ~act).otherwise(F.lit(True))
    broken = F.when(F.col("r_type") == "obligation", ~F.coalesce("completed", F.lit(False))).when(F.col("r_type") == "prohibition", act).otherwise(F.lit(False))
    found = joined(requests, rules).groupBy("entity_id").agg(F.bool_or(allow).alias("allow"), F.count_if(broken).alias("violations"))
    return requests.select("entity_id").join(found, "entity_id", "left").select("entity_id",
        F.coalesce("allow", F.lit(False)).alias("allow"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def plan_verdicts(changes: DataFrame, kind: str, resource: str) -> DataFrame:
    """(plan_id, resource, enabled) to (plan_id, passed, level). An obligation asks that all changes are of the
    resource and enabled, a prohibition that none of the resource is; other types always pass."""
    own, on = F.col("resource") == resource, F.coalesce("enabled", F.lit(False))
    holds = own & on if kind == "obligation" else ~(own & on) if kind == "prohibition" else F.lit(True)
    return changes.groupBy("plan_id").agg(F.every(holds).alias("passed")).withColumn("level",
        F.lit("hard-mandatory" if kind == "prohibition" else "soft-mandatory"))


def fixture_pairs(rules: DataFrame) -> DataFrame:
    """A compliant and a violating fact for each rule."""
    good, banned = F.col("pair") == "compliant", F.col("type") == "prohibition"
    return rules.withColumn("pair", F.explode(F.array(F.lit("compliant"), F.lit("violating")))).select(
        F.concat("rule_id", F.lit("_"), "pair").alias("entity_id"), "actor", "action", F.when(good, F.col("object")).alias("object"),
            F.when(good, "ok").otherwise("violation").alias("status"),
        F.when(banned, F.lit(None)).otherwise(good).alias("completed"), (banned & ~good).alias("attempted"), good.alias("condition_met"),
    )


def retention(rules: DataFrame) -> DataFrame:
    """How long records of a rule are kept and who is told."""
    banned = F.col("type") == "prohibition"
    return rules.select("rule_id", F.when(banned, 730).otherwise(365).alias("retention_days"),
        F.when(banned, F.array(F.lit("compliance_officer"),
                F.lit("legal"))).otherwise(F.array(F.lit("compliance_officer"))).alias("escalate_to"))
