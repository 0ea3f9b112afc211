"""Users, organizations, prompts."""
from pyspark.sql import functions as F

from spanquarry.functions.common import page_of
from spanquarry.operators import accounts as A
from spanquarry.plans.registry import query


@query("c17_user_orgs", """SELECT m.org_id, m.user_id, m.role, o.name, coalesce(o.plan_tier, w.user_type) AS plan,
  (SELECT count(*) FROM v_members mm WHERE mm.org_id = o.org_id) AS member_count, o.created_at AS org_created_at
FROM v_members m JOIN v_orgs o ON o.org_id = m.org_id JOIN v_users w ON w.user_id = o.user_id""")
def _(lake):
    return A.user_orgs(lake.members, lake.orgs, lake.users)


@query("f07_members_by_role", """SELECT m.org_id, m.user_id, u.name, m.role FROM v_members m JOIN v_users u USING (user_id)
ORDER BY m.org_id, CASE m.role WHEN 'owner' THEN 0 WHEN 'admin' THEN 1 ELSE 2 END, m.created_at, m.user_id LIMIT 100""")
def _(lake):
    return page_of(A.org_members(lake.members, lake.users), A.members_order(), 100).select("org_id", "user_id", "name", "role")


@query("c17_admin_orgs", """SELECT o.org_id, o.name, coalesce(o.plan_tier, u.user_type) AS plan, (SELECT count(*) FROM v_members m WHERE m.org_id = o.org_id) AS member_count,
  u.email AS owner_email, u.user_type AS owner_type, o.created_at FROM v_orgs o LEFT JOIN v_users u ON u.user_id = o.user_id""")
def _(lake):
    return A.admin_orgs(lake.orgs, lake.users, lake.members)


@query("c24_effective_tier", """SELECT o.org_id, coalesce(o.plan_tier, CASE WHEN u.trial_ends_at <= TIMESTAMP '2024-01-20 00:00:00' AND u.user_type <> 'Free' THEN 'Free' ELSE u.user_type END) AS tier
FROM v_orgs o JOIN v_users u ON u.user_id = o.user_id""")
def _(lake):
    return A.effective_tier(lake.orgs, lake.users, "2024-01-20 00:00:00")


def _prompts(lake):
    kind = F.when(F.col("p_size") % 3 == 0, "judge").when(F.col("p_size") % 3 == 1, "code").otherwise("completion")
    return lake.raw("part").select(F.col("p_partkey").alias("prompt_id"), F.col("p_brand").alias("org_id"), F.concat(F.lit("s"), "p_partkey").alias("slug"),
                                   F.col("p_name").alias("name"), F.col("p_type").alias("template"), kind.alias("kind"))


PROMPTS = """(SELECT p_partkey AS prompt_id, p_brand AS org_id, concat('s', p_partkey) AS slug, p_name AS name, p_type AS template,
  CASE p_size % 3 WHEN 0 THEN 'judge' WHEN 1 THEN 'code' ELSE 'completion' END AS kind FROM part)"""


@query("c14_dataset_scorers", f"""SELECT s.org_id, s.slug, s.threshold, p.name, p.template, p.kind FROM (SELECT p_brand AS org_id, concat('s', p_partkey + p_size % 2) AS slug, p_size / 100.0::DOUBLE AS threshold FROM part) s
LEFT JOIN {PROMPTS} p ON p.org_id = s.org_id AND p.slug = s.slug AND p.kind IN ('judge', 'code')""")
def _(lake):
    scorers = lake.raw("part").select(F.col("p_brand").alias("org_id"), F.concat(F.lit("s"), F.col("p_partkey") + F.col("p_size") % 2).alias("slug"),
                                      (F.col("p_size") / 100).alias("threshold"))
    return A.dataset_scorers(scorers, _prompts(lake))


OVERRIDES = "(SELECT c_nationkey AS org_id, concat('p', c_custkey % 40) AS name, max(c_name) AS template, max(c_custkey) AS version FROM customer GROUP BY 1, 2)"


def _overrides(lake):
    c = lake.raw("customer")
    return c.groupBy(F.col("c_nationkey").alias("org_id"), F.concat(F.lit("p"), F.col("c_custkey") % 40).alias("name")).agg(
        F.max("c_name").alias("template"), F.max("c_custkey").alias("version"))


def _defaults(lake):
    p = lake.raw("part")
    return p.groupBy(F.concat(F.lit("p"), F.col("p_partkey") % 60).alias("name")).agg(F.min("p_type").alias("template"))


DEFAULTS = "(SELECT concat('p', p_partkey % 60) AS name, min(p_type) AS template FROM part GROUP BY 1)"


@query("c15_effective_prompts", f"""SELECT g.org_id, g.name, d.template AS platform_template, coalesce(o.template, d.template) AS template, o.org_id IS NOT NULL AS is_overridden, coalesce(o.version, 0) AS version
FROM (SELECT DISTINCT s_nationkey AS org_id, concat('p', s_suppkey % 60) AS name FROM supplier UNION SELECT DISTINCT c_nationkey, concat('p', c_custkey % 60) FROM customer) g
JOIN {DEFAULTS} d ON d.name = g.name LEFT JOIN {OVERRIDES} o ON o.org_id = g.org_id AND o.name = g.name""")
def _(lake):
    pair = lambda t, n, k: lake.raw(t).select(F.col(n).alias("org_id"), F.concat(F.lit("p"), F.col(k) % 60).alias("name"))
    wanted = pair("supplier", "s_nationkey", "s_suppkey").unionByName(pair("customer", "c_nationkey", "c_custkey")).distinct()
    return A.effective_prompts(wanted, _defaults(lake), _overrides(lake))


@query("c16_prompt_for_env", f"""SELECT prompt_id, environment, version, org_id, slug FROM (SELECT p_partkey AS prompt_id, CASE p_size % 2 WHEN 0 THEN 'prod' ELSE 'dev' END AS environment, p_size AS version FROM part) e
JOIN {PROMPTS} p USING (prompt_id) WHERE environment = 'prod'""")
def _(lake):
    env = lake.raw("part").select(F.col("p_partkey").alias("prompt_id"), F.when(F.col("p_size") % 2 == 0, "prod").otherwise("dev").alias("environment"), F.col("p_size").alias("version"))
    return A.prompt_for_env(env, _prompts(lake), "prod").select("prompt_id", "environment", "version", "org_id", "slug")


@query("d38_platform_stats", """SELECT 'total_users' AS stat, '' AS key, count(*) AS n FROM v_users UNION ALL SELECT 'total_orgs', '', count(*) FROM v_orgs
UNION ALL SELECT 'users_by_type', user_type, count(*) FROM v_users GROUP BY 2""")
def _(lake):
    return A.platform_stats(lake.users, lake.orgs)


@query("d39_leads_by_source", "SELECT event_type AS source_page, count(*) AS n FROM events GROUP BY 1")
def _(lake):
    return A.counts_by(lake.raw("events").withColumnRenamed("event_type", "source_page"), "source_page")
