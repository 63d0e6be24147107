"""Registered queries for M1–M8 over the FX7 request log, keys and members."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import metering as MT
from seriesforge.plans import fixtures as FX
from seriesforge.plans.registry import query, with_ctes

T = dict(log=FX.fx_sql(FX.REQUEST_LOG_SQL), keys=FX.fx_sql(FX.KEYS_SQL), members=FX.fx_sql(FX.MEMBERS_SQL))
MT_SQL = """SELECT email, name, CASE WHEN lower(tier_names) LIKE '%east asia%' OR lower(tier_names) LIKE '%data%' THEN 'premium'
  WHEN lower(tier_names) LIKE '%daily%' THEN 'daily' WHEN status = 'comped' THEN 'premium' ELSE 'free' END AS tier FROM members"""
ADMIN = ", ".join(f"'{k}'" for k in FX.ADMIN_KEYS)
ATTR = f"""SELECT l.event_id, CAST(l.ts AS TIMESTAMP) AS ts, l.user_id, l.kind, l.series, l.api_key, l.bearer_email, x.auth_type,
  CASE x.auth_type WHEN 'user_api_key' THEN k.email WHEN 'member' THEN l.bearer_email WHEN 'api_key' THEN 'api_key_user' END AS email,
  CASE x.auth_type WHEN 'user_api_key' THEN k.tier WHEN 'member' THEN m.tier WHEN 'api_key' THEN 'premium' END AS tier,
  CASE WHEN x.auth_type IS NULL THEN 401 ELSE 200 END AS status
FROM log l LEFT JOIN (SELECT * FROM keys WHERE is_active) k ON k.api_key = l.api_key
LEFT JOIN mt m ON m.email = l.bearer_email,
LATERAL (SELECT CASE WHEN coalesce(starts_with(l.api_key, 'eae_'), false) THEN
                  CASE WHEN k.email IS NOT NULL THEN 'user_api_key' END
                WHEN m.tier IS NOT NULL THEN 'member' WHEN l.api_key IN ({ADMIN}) THEN 'api_key' END AS auth_type) x"""
CHARGED = """SELECT * FROM attr WHERE status = 200 AND (kind = 'multi_series' OR (kind = 'series'
  AND (auth_type = 'api_key' OR series IS NULL OR lower(series) NOT LIKE '%s&p pmi%')))"""
BASE_M = dict(T, mt=MT_SQL, attr=ATTR, charged=CHARGED)
MONTHLY = """SELECT event_id, ts, api_key, tier, month, used, quota, quota IS NULL OR used <= quota AS admitted,
  CAST(CASE WHEN quota IS NOT NULL THEN greatest(0, quota - used) END AS INTEGER) AS remaining FROM (
  SELECT event_id, ts, api_key, tier, strftime(ts, '%Y-%m') AS month,
         row_number() OVER (PARTITION BY api_key, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS used,
         CAST(CASE tier WHEN 'free' THEN 10 WHEN 'daily' THEN 30 END AS INTEGER) AS quota
  FROM charged WHERE auth_type = 'user_api_key') x"""
ANCH = """SELECT email AS identity, event_id, ts, tier,
  row_number() OVER (PARTITION BY email ORDER BY ts, event_id) AS rn,
  CAST(CASE tier WHEN 'free' THEN 10 WHEN 'daily' THEN 30 WHEN 'premium' THEN NULL ELSE 10 END AS INTEGER) AS quota
  FROM charged WHERE auth_type IN ('member', 'api_key')"""
WALK = """SELECT identity, rn, event_id, ts, tier, quota, ts AS window_start, CAST(1 AS BIGINT) AS rank,
         true AS admitted, CASE WHEN quota IS NULL OR quota > 0 THEN 1 ELSE 0 END AS cnt FROM anch WHERE rn = 1
  UNION ALL
  SELECT a.identity, a.rn, a.event_id, a.ts, a.tier, a.quota,
         CASE WHEN a.ts > w.window_start + INTERVAL 1 DAY THEN a.ts ELSE w.window_start END,
         CASE WHEN a.ts > w.window_start + INTERVAL 1 DAY THEN 1 ELSE w.rank + 1 END,
         a.quota IS NULL OR (CASE WHEN a.ts > w.window_start + INTERVAL 1 DAY THEN 0 ELSE w.cnt END) < a.quota,
         (CASE WHEN a.ts > w.window_start + INTERVAL 1 DAY THEN 0 ELSE w.cnt END)
           + CASE WHEN a.quota IS NULL OR (CASE WHEN a.ts > w.window_start + INTERVAL 1 DAY THEN 0 ELSE w.cnt END)
                  < a.quota THEN 1 ELSE 0 END
  FROM walk w JOIN anch a ON a.identity = w.identity AND a.rn = w.rn + 1"""
ANCHORED = """SELECT event_id, ts, identity, tier, window_start, rank, quota, admitted,
  CAST(CASE WHEN admitted THEN cnt END AS BIGINT) AS used FROM walk"""


def _attr(spark, d):
    return MT.attribute_requests(FX.request_log(spark, d), FX.keys(spark, d), FX.members(spark, d), FX.ADMIN_KEYS)


@query("derive_tier", with_ctes("SELECT * FROM mt", **T, mt=MT_SQL))
def derive_tier(spark, d):
    return MT.derive_tier(FX.members(spark, d))


ISSUES_SQL = """SELECT concat('u', CAST(user_id AS VARCHAR(10)), '@x.org') AS email,
  concat('eae_', CAST(user_id AS VARCHAR(10)), '_', CAST(event_id AS VARCHAR(20))) AS api_key, ts AS created_at,
  CASE WHEN event_id % 3 = 0 THEN concat('User ', CAST(event_id AS VARCHAR(20))) END AS name, CASE WHEN event_id % 4 = 0 THEN 'daily' WHEN event_id % 4 = 1 THEN 'free' END AS tier
  FROM {events} WHERE event_type = 'signup'"""


@query("active_keys", with_ctes(
    """SELECT api_key, email, created_at, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, api_key DESC) = 1 AS is_active,
         last_value(name IGNORE NULLS) OVER (PARTITION BY email ORDER BY created_at, api_key ROWS UNBOUNDED PRECEDING) AS name,
         last_value(tier IGNORE NULLS) OVER (PARTITION BY email ORDER BY created_at, api_key ROWS UNBOUNDED PRECEDING) AS tier FROM issues""", issues=FX.fx_sql(ISSUES_SQL)))
def active_keys(spark, d):
    """M2 over a key-issue log derived from signup events (re-issue = rotation)."""
    return MT.active_keys(FX.fx(spark, ISSUES_SQL, d))


@query("sync_tiers", with_ctes(
    """SELECT k.api_key, k.email, k.is_active,
         CASE WHEN k.is_active AND m.tier IS NOT NULL THEN m.name ELSE k.name END AS name,
         CASE WHEN k.is_active AND m.tier IS NOT NULL THEN m.tier ELSE k.tier END AS tier,
         coalesce(k.is_active AND m.tier IS NOT NULL AND (k.tier <> m.tier OR k.name <> m.name), false) AS changed
       FROM keys k LEFT JOIN mt m ON m.email = k.email""", **T, mt=MT_SQL))
def sync_tiers(spark, d):
    out = MT.sync_tiers(FX.keys(spark, d), FX.members(spark, d))
    return out.select("api_key", "email", "is_active", "name", "tier", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("attribute_requests", with_ctes(
    "SELECT event_id, ts, kind, api_key, email, tier, auth_type, status FROM attr", **T, mt=MT_SQL, attr=ATTR))
def attribute_requests(spark, d):
    return _attr(spark, d).select("event_id", "ts", "kind", "api_key", "email", "tier", "auth_type", "status")


@query("monthly_usage", with_ctes(
    "SELECT api_key, strftime(ts, '%Y-%m') AS month, count(*) AS count FROM charged "
    "WHERE auth_type = 'user_api_key' GROUP BY api_key, strftime(ts, '%Y-%m')", **BASE_M))
def monthly_usage(spark, d):
    return MT.monthly_usage(_attr(spark, d), FX.hidden_patterns(spark))


@query("monthly_admission", with_ctes(MONTHLY, **BASE_M))
def monthly_admission(spark, d):
    return MT.monthly_admission(_attr(spark, d), hidden=FX.HIDDEN_PATTERNS)


@query("anchored_admission", with_ctes(ANCHORED, _recursive=True, **BASE_M, anch=ANCH, walk=WALK))
def anchored_admission(spark, d):
    return MT.anchored_admission(_attr(spark, d), hidden=FX.HIDDEN_PATTERNS)


@query("usage_report", with_ctes(
    """SELECT k.api_key, k.email, k.tier, CAST(coalesce(u.count, 0) AS BIGINT) AS used,
         CAST(CASE k.tier WHEN 'premium' THEN NULL WHEN 'daily' THEN 30 ELSE 10 END AS INTEGER) AS quota,
         CAST(CASE WHEN k.tier <> 'premium' THEN greatest(0, (CASE k.tier WHEN 'daily' THEN 30 ELSE 10 END)
              - coalesce(u.count, 0)) END AS BIGINT) AS remaining, '2024-01' AS month
       FROM keys k LEFT JOIN (SELECT api_key, count(*) AS count FROM charged WHERE auth_type = 'user_api_key'
         AND strftime(ts, '%Y-%m') = '2024-01' GROUP BY api_key) u ON u.api_key = k.api_key WHERE k.is_active""",
    **BASE_M))
def usage_report(spark, d):
    out = MT.usage_report(FX.keys(spark, d), MT.monthly_usage(_attr(spark, d), FX.HIDDEN_PATTERNS), "2024-01")
    return out.withColumnRenamed("limit", "quota")


@query("anchored_usage_report", with_ctes(
    """SELECT identity, CAST(count(*) FILTER (WHERE admitted) AS BIGINT) AS used, any_value(quota) AS quota,
         CAST(CASE WHEN any_value(quota) IS NOT NULL THEN greatest(0, any_value(quota) - count(*) FILTER (WHERE admitted))
              END AS BIGINT) AS remaining, window_start + INTERVAL 1 DAY AS reset_at
       FROM walk w WHERE window_start = (SELECT max(window_start) FROM walk v WHERE v.identity = w.identity)
       GROUP BY identity, window_start""", _recursive=True, **BASE_M, anch=ANCH, walk=WALK))
def anchored_usage_report(spark, d):
    return MT.anchored_usage_report(MT.anchored_admission(_attr(spark, d), hidden=FX.HIDDEN_PATTERNS))
