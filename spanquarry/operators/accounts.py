"""Reports over users, organizations, memberships and prompts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import moment

FREE = "Free"


def effective_plan(plan_tier, owner_type) -> Column:
    return F.coalesce(plan_tier, owner_type)


def _member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("org_id").agg(F.count("*").alias("member_count"))


def _owners(users: DataFrame) -> DataFrame:
    return users.select(F.col("user_id").alias("_owner"), F.col("user_type").alias("owner_type"),
                        F.col("trial_ends_at").alias("owner_trial_ends_at"), F.col("email").alias("owner_email"))


def user_orgs(members: DataFrame, orgs: DataFrame, users: DataFrame) -> DataFrame:
    """Organizations of every user with role, effective plan and size."""
    o = orgs.join(_owners(users), F.col("user_id") == F.col("_owner")).join(_member_counts(members), "org_id", "left").select(
        "org_id", "name", effective_plan("plan_tier", "owner_type").alias("plan"),
        F.coalesce("member_count", F.lit(0)).alias("member_count"), F.col("created_at").alias("org_created_at"))
    return members.select("org_id", "user_id", "role").join(o, "org_id")


def role_rank(role="role") -> Column:
    return F.when(F.col(role) == "owner", 0).when(F.col(role) == "admin", 1).otherwise(2)


def org_members(members: DataFrame, users: DataFrame) -> DataFrame:
    """Members with their name and the rank of their role (owners, admins, others)."""
    return members.join(users.select("user_id", "name", "email"), "user_id").withColumn("role_rank", role_rank())


def members_order() -> list[Column]:
    return [F.col("org_id"), F.col("role_rank"), F.col("created_at"), F.col("user_id")]


def admin_orgs(orgs: DataFrame, users: DataFrame, members: DataFrame) -> DataFrame:
    """All organizations with plan, size and owner, owners that are gone included."""
    return (
        orgs.join(_owners(users), F.col("user_id") == F.col("_owner"), "left")
        .join(_member_counts(members), "org_id", "left")
        .select("org_id", "name", effective_plan("plan_tier", "owner_type").alias("plan"),
                F.coalesce("member_count", F.lit(0)).alias("member_count"), "owner_email", "owner_type", "created_at")
    )


def effective_tier(orgs: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Plan in force: the organization's own, else the owner's with an expired trial as Free."""
    expired = F.coalesce((F.col("owner_trial_ends_at") <= moment(as_of)) & (F.col("owner_type") != FREE), F.lit(False))
    tier = F.coalesce("plan_tier", F.when(expired, FREE).otherwise(F.col("owner_type")))
    return orgs.join(_owners(users), F.col("user_id") == F.col("_owner")).select("org_id", tier.alias("tier"))


def dataset_scorers(scorers: DataFrame, prompts: DataFrame, kinds=("judge", "code")) -> DataFrame:
    """Scorers of datasets with their current prompt; a deleted prompt leaves nulls."""
    usable = prompts.filter(F.col("kind").isin(list(kinds))).select("org_id", "slug", "name", "template", "kind")
    return scorers.join(usable, ["org_id", "slug"], "left")


def effective_prompts(wanted: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Prompt text in force for each wanted (org_id, name): the override, else the platform's.

    ``overrides`` has (org_id, name, template, version).
    """
    d = defaults.select("name", F.col("template").alias("platform_template"))
    o = overrides.select("org_id", "name", F.col("template").alias("_t"), F.col("version").alias("_v"))
    return wanted.join(d, "name").join(o, ["org_id", "name"], "left").select(
        "org_id", "name", "platform_template", F.coalesce("_t", "platform_template").alias("template"),
        F.col("_t").isNotNull().alias("is_overridden"), F.coalesce("_v", F.lit(0)).alias("version"))


def prompt_for_env(environments: DataFrame, prompts: DataFrame, environment: str) -> DataFrame:
    """Deployed snapshot of every prompt in an environment."""
    return environments.filter(F.col("environment") == environment).join(prompts.select("prompt_id", "org_id", "slug"), "prompt_id")


def platform_stats(users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Counts of users, organizations and users by type, as (stat, key, n) rows."""
    by_type = users.groupBy(F.col("user_type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("users_by_type").alias("stat"), "key", "n")
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stat"), F.lit("").alias("key"), "n")
    return total(users, "total_users").unionByName(total(orgs, "total_orgs")).unionByName(by_type)


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))
