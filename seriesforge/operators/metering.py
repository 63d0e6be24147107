"""M1–M8: tiers, key state, request attribution and usage limits over
request logs.

Skew: one API key or member may send a third of all requests. No step puts
one identity's whole log into one task:
* running counts use a bucketed prefix count (local rank inside
  (key, minute) + an offset from per-bucket counts, see ``running_count``);
* the rolling one-day windows (M7) are found with a bucketed as-of lookup
  (``next_after``) and pointer doubling over request ids - each round an
  equi-join on a unique id - so the work is split by (identity, day).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.dims import DAILY_WINDOW_LIMITS, KEY_PREFIX, MONTHLY_LIMITS
from seriesforge.operators.visibility import with_hidden

CHARGED_KINDS = ["series", "multi_series"]
ADMIN_IDENTITY = "api_key_user"


# ---- M1–M3 ---------------------------------------------------------------------------

def tier_expr(tiers: Column, status: Column) -> Column:
    """M1 rule on member records (tiers: array<struct<name>>)."""
    names = F.transform(F.coalesce(tiers, F.array().cast("array<struct<name:string>>")),
                        lambda t: F.lower(F.coalesce(t["name"], F.lit(""))))
    premium = F.exists(names, lambda n: n.contains("east asia") | n.contains("data"))
    daily = F.exists(names, lambda n: n.contains("daily"))
    return (F.when(premium, F.lit("premium")).when(daily, F.lit("daily"))
            .when(status == "comped", F.lit("premium")).otherwise(F.lit("free")))


def derive_tier(members: DataFrame) -> DataFrame:
    """M1: (email, name, tier) per member."""
    return members.select("email", "name", tier_expr(F.col("tiers"), F.col("status")).alias("tier"))


def active_keys(issues: DataFrame, carry: tuple[str, ...] = ("name", "tier", "member_uuid")) -> DataFrame:
    """M2: from a key-issue log (email, api_key, created_at): the latest key
    of each email is active, rotated ones are not. A rotation keeps what the
    key before it had: null columns of ``carry`` take the last value given."""
    latest = issues.groupBy("email").agg(F.max_by("api_key", F.struct("created_at", "api_key")).alias("_latest"))
    before = Window.partitionBy("email").orderBy("created_at", "api_key").rowsBetween(Window.unboundedPreceding, 0)
    kept = [F.last(c, ignorenulls=True).over(before).alias(c) for c in carry if c in issues.columns]
    return (issues.join(latest, "email")
            .select("api_key", "email", "created_at", (F.col("api_key") == F.col("_latest")).alias("is_active"), *kept))


def sync_tiers(keys: DataFrame, members: DataFrame, now: Column | None = None) -> DataFrame:
    """M3: active keys take the member's tier and name; ``tier_checked_at``
    moves only where one of them changed. Keys without a member stay."""
    now = now if now is not None else F.current_timestamp()
    m = derive_tier(members).select("email", F.col("name").alias("m_name"), F.col("tier").alias("m_tier"))
    j = keys.join(m, "email", "left")
    found = F.col("is_active") & F.col("m_tier").isNotNull()
    changed = found & ((F.col("tier") != F.col("m_tier")) | (F.col("name") != F.col("m_name")))
    cols = [c for c in keys.columns if c not in ("tier", "name", "tier_checked_at")]
    out = j.select(*cols,
                   F.when(found, F.col("m_name")).otherwise(F.col("name")).alias("name"),
                   F.when(found, F.col("m_tier")).otherwise(F.col("tier")).alias("tier"),
                   changed.alias("changed"),
                   (F.when(changed, now).otherwise(F.col("tier_checked_at")) if "tier_checked_at" in keys.columns
                    else F.when(changed, now)).alias("tier_checked_at"))
    return out


# ---- M4 ----------------------------------------------------------------------------

def attribute_requests(log: DataFrame, keys: DataFrame, members: DataFrame, admin_keys: list[str]) -> DataFrame:
    """M4: who sent each request. Precedence: ``eae_`` key (active -> user,
    unknown -> 401 at once), bearer member, admin key, else 401.

    Adds email, tier, auth_type ('user_api_key' / 'member' / 'api_key'),
    identity and status (200 / 401)."""
    k = keys.where("is_active").select("api_key", F.col("email").alias("k_email"), F.col("tier").alias("k_tier"))
    m = derive_tier(members).select(F.col("email").alias("bearer_email"), F.col("tier").alias("m_tier"))
    j = log.join(k, "api_key", "left").join(m, "bearer_email", "left")
    is_key = F.coalesce(F.col("api_key").startswith(KEY_PREFIX), F.lit(False))
    is_admin = F.coalesce(F.col("api_key").isin(list(admin_keys)), F.lit(False)) if admin_keys else F.lit(False)
    auth = (F.when(is_key, F.when(F.col("k_email").isNotNull(), F.lit("user_api_key")))
            .when(F.col("m_tier").isNotNull(), F.lit("member"))
            .when(is_admin, F.lit("api_key")))
    email = (F.when(auth == "user_api_key", F.col("k_email")).when(auth == "member", F.col("bearer_email"))
             .when(auth == "api_key", F.lit(ADMIN_IDENTITY)))
    tier = (F.when(auth == "user_api_key", F.col("k_tier")).when(auth == "member", F.col("m_tier"))
            .when(auth == "api_key", F.lit("premium")))
    return (j.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("auth_type", auth).withColumn("email", email).withColumn("tier", tier)
            .withColumn("status", F.when(auth.isNull(), F.lit(401)).otherwise(F.lit(200)))
            .drop("k_email", "k_tier", "m_tier"))


def charged(attributed: DataFrame, hidden=None) -> DataFrame:
    """Requests that pass authentication and are charged (S-14): a call for one
    hidden series (column ``series``; ``hidden``: patterns, a list or a table) is
    answered "not found" before it is charged, unless an admin key sends it."""
    out = attributed.where((F.col("status") == 200) & F.col("kind").isin(CHARGED_KINDS))
    if hidden is None or "series" not in attributed.columns:
        return out
    refused = (F.col("kind") == "series") & (F.col("auth_type") != "api_key") & F.col("_hidden")
    return with_hidden(out, hidden, "series").where(~refused).drop("_hidden")


# ---- distributed running count ---------------------------------------------------------

def running_count(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "n") -> DataFrame:
    """1-based position of each row inside ``keys`` in ``order``.

    The group is split by ``bucket`` (monotone in ``order``, e.g. the hour
    of the timestamp): a window inside (keys, bucket) gives the local rank, a
    small window over per-bucket counts gives each bucket's offset.
    """
    b = df.withColumn("_b", bucket)
    local = b.withColumn("_lr", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wk), F.lit(0))).drop("_c")
    return local.join(offsets, [*keys, "_b"]).withColumn(out, (F.col("_off") + F.col("_lr")).cast("long")) \
                .drop("_b", "_lr", "_off")


# ---- M5 / M6 --------------------------------------------------------------------------

def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_usage(attributed: DataFrame, hidden=None) -> DataFrame:
    """M5: charged requests per key and UTC month (refused ones included)."""
    c = charged(attributed, hidden).where(F.col("auth_type") == "user_api_key")
    return c.groupBy("api_key", month_key(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("count"))


def monthly_limit(tier: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(0))
    for t, lim in MONTHLY_LIMITS.items():
        expr = expr.when(tier == t, F.lit(lim))
    return expr.otherwise(F.lit(None)).cast("int")  # unknown tier: unlimited here


def monthly_admission(attributed: DataFrame, bucket: str = "minute", hidden=None) -> DataFrame:
    """M6: used = running number in (key, month); refused when used > limit."""
    c = (charged(attributed, hidden).where(F.col("auth_type") == "user_api_key")
         .withColumn("month", month_key(F.col("ts"))))
    r = running_count(c, ["api_key", "month"], ["ts", "event_id"], F.date_trunc(bucket, "ts"), "used")
    lim = monthly_limit(F.col("tier"))
    return r.select("event_id", "ts", "api_key", "tier", "month", "used", lim.alias("quota"),
                    (lim.isNull() | (F.col("used") <= lim)).alias("admitted"),
                    F.when(lim.isNotNull(), F.greatest(F.lit(0), lim - F.col("used"))).cast("int").alias("remaining"))


# ---- M7 --------------------------------------------------------------------------------

def window_limit(tier: Column) -> Column:
    """Rolling-window limit; a tier outside the table gets the free limit."""
    expr = F.when(F.lit(False), F.lit(0))
    for t, lim in DAILY_WINDOW_LIMITS.items():
        expr = expr.when(tier == t, F.lit(lim))
    return expr.otherwise(F.lit(DAILY_WINDOW_LIMITS["free"])).cast("int")


def next_after(req: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (identity, pid, pts): the first request (by ts, event_id)
    of the same identity with ts > pts, as struct ``nxt`` (ts, event_id) or null.

    Split by (identity, hour): inside an hour a reverse running ``last`` finds
    the next request; a probe whose hour has none takes the first request of
    the next non-empty hour (a window over hour-level rows only, bounded by the
    time span, not by the number of requests).
    """
    R = req.select("identity", F.date_trunc("hour", "ts").alias("_d"), F.col("ts"), F.col("event_id"),
                   F.lit(0).alias("_k"), F.lit(None).cast("long").alias("pid"),
                   F.struct("ts", "event_id").alias("_r"))
    P = probes.select("identity", F.date_trunc("hour", "pts").alias("_d"), F.col("pts").alias("ts"),
                      F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("_k"), "pid",
                      F.lit(None).cast("struct<ts:timestamp,event_id:bigint>").alias("_r"))
    u = R.unionByName(P)
    w = (Window.partitionBy("identity", "_d")
         .orderBy(F.col("ts").desc(), F.col("_k").desc(), F.col("event_id").desc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, -1))
    in_day = u.withColumn("_n", F.last("_r", ignorenulls=True).over(w)).where(F.col("_k") == 1) \
              .select("identity", "_d", "pid", "_n")
    firsts = R.groupBy("identity", "_d").agg(F.min("_r").alias("_first"), F.lit(1).alias("_k"))
    marks = P.select("identity", "_d").distinct().select("identity", "_d", F.lit(None).cast(
        "struct<ts:timestamp,event_id:bigint>").alias("_first"), F.lit(0).alias("_k"))
    wd = (Window.partitionBy("identity").orderBy(F.col("_d").desc(), F.col("_k").asc())
          .rowsBetween(Window.unboundedPreceding, -1))
    later = marks.unionByName(firsts).withColumn("_later", F.last("_first", ignorenulls=True).over(wd)) \
                 .where(F.col("_k") == 0).select("identity", "_d", "_later")
    return in_day.join(later, ["identity", "_d"], "left").select(
        "identity", "pid", F.coalesce("_n", "_later").alias("nxt"))


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration (reliable checkpoint, survives executor loss)."""
    from seriesforge.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def window_anchors(req: DataFrame, window: str = "1 day") -> DataFrame:
    """Anchors of the rolling windows: the first request opens a window; the
    first request strictly more than ``window`` after the open anchor opens the
    next one. Returns (identity, anchor_ts, anchor_id).

    succ(v) = first request after v.ts + window (``next_after``); anchors are
    the orbit of each identity's first request under succ, found by pointer
    doubling: ceil(log2(max anchors)) rounds of equi-joins on request id.
    There is at most one anchor per day, so the day count bounds the rounds.
    """
    r = req.select("identity", "ts", "event_id").cache()
    probes = r.select("identity", F.col("event_id").alias("pid"), (F.col("ts") + F.expr(f"INTERVAL {window}")).alias("pts"))
    succ = next_after(r, probes).select("identity", F.col("pid").alias("id"), F.col("nxt.event_id").alias("nxt"))
    jump = _checkpoint(succ)
    first = r.groupBy("identity").agg(F.min(F.struct("ts", "event_id")).alias("_f")) \
             .select("identity", F.col("_f.event_id").alias("id"))
    spans = r.groupBy("identity").agg(F.count_distinct(F.to_date("ts")).alias("_days")).agg(F.max("_days")).first()[0]
    rounds = max(1, math.ceil(math.log2((spans or 1) + 1)))
    reach = first
    for _ in range(rounds):
        step = reach.join(jump, ["identity", "id"]).where(F.col("nxt").isNotNull()) \
                    .select("identity", F.col("nxt").alias("id"))
        reach = _checkpoint(reach.unionByName(step).distinct())
        j2 = jump.alias("a").join(jump.alias("b"), (F.col("a.identity") == F.col("b.identity")) &
                                  (F.col("a.nxt") == F.col("b.id")), "left")
        jump = _checkpoint(j2.select(F.col("a.identity").alias("identity"), F.col("a.id").alias("id"),
                                     F.col("b.nxt").alias("nxt")))
    out = reach.join(r.select("identity", F.col("event_id").alias("id"), F.col("ts").alias("anchor_ts")),
                     ["identity", "id"]).select("identity", "anchor_ts", F.col("id").alias("anchor_id"))
    out = _checkpoint(out)
    r.unpersist()
    return out


def anchored_admission(attributed: DataFrame, bucket: str = "minute", hidden=None) -> DataFrame:
    """M7: requests of member / admin identities under a rolling window that
    starts at the first request; admitted while fewer than ``limit`` were
    admitted in the window (refused requests are not counted)."""
    c = charged(attributed, hidden).where(F.col("auth_type").isin("member", "api_key")) \
        .withColumn("identity", F.col("email"))
    anchors = window_anchors(c, "1 day")
    # each request's window: the latest anchor <= request, found among anchors of its day and the day before
    a = anchors.withColumn("_d", F.to_date("anchor_ts"))
    rq = c.select("identity", "event_id", "ts", "tier", F.explode(F.array(F.to_date("ts"), F.date_sub(F.to_date("ts"), 1))).alias("_d"))
    j = rq.join(a, ["identity", "_d"]).where(F.struct("anchor_ts", "anchor_id") <= F.struct("ts", "event_id"))
    owner = j.groupBy("identity", "event_id", "ts", "tier").agg(F.max(F.struct("anchor_ts", "anchor_id")).alias("_a"))
    owner = owner.select("identity", "event_id", "ts", "tier", F.col("_a.anchor_ts").alias("window_start"),
                         F.col("_a.anchor_id").alias("_aid"))
    ranked = running_count(owner, ["identity", "_aid"], ["ts", "event_id"], F.date_trunc(bucket, "ts"), "rank")
    lim = window_limit(F.col("tier"))
    admitted = lim.isNull() | (F.col("rank") <= lim)
    return ranked.select("event_id", "ts", "identity", "tier", "window_start", "rank", lim.alias("quota"),
                         admitted.alias("admitted"),
                         F.when(admitted, F.col("rank")).cast("long").alias("used"))


# ---- M8 --------------------------------------------------------------------------------

def report_limit(tier: Column) -> Column:
    """Limit shown in reports: unknown tier shows free's limit."""
    expr = F.when(F.lit(False), F.lit(0))
    for t, lim in MONTHLY_LIMITS.items():
        expr = expr.when(tier == t, F.lit(lim))
    return expr.otherwise(F.lit(MONTHLY_LIMITS["free"])).cast("int")


def usage_report(keys: DataFrame, usage: DataFrame, month: str) -> DataFrame:
    """M8 (keys): used / limit / remaining for ``month`` (no usage row = 0)."""
    u = usage.where(F.col("month") == month).select("api_key", F.col("count").alias("used"))
    j = keys.where("is_active").join(u, "api_key", "left")
    lim = report_limit(F.col("tier"))
    used = F.coalesce(F.col("used"), F.lit(0)).cast("long")
    return j.select("api_key", "email", "tier", used.alias("used"), lim.alias("quota"),
                    F.when(lim.isNotNull(), F.greatest(F.lit(0), lim - used)).cast("long").alias("remaining"),
                    F.lit(month).alias("month"))


def anchored_usage_report(admission: DataFrame, window: str = "1 day") -> DataFrame:
    """M8 (rolling identities): admitted count of the last window and its end."""
    last = admission.groupBy("identity").agg(F.max("window_start").alias("window_start"))
    cur = admission.join(last, ["identity", "window_start"])
    return cur.groupBy("identity", "window_start").agg(
        F.count_if("admitted").alias("used"), F.first("quota").alias("quota")).select(
        "identity", "used", "quota",
        F.when(F.col("quota").isNotNull(), F.greatest(F.lit(0), F.col("quota") - F.col("used"))).cast("long")
        .alias("remaining"),
        (F.col("window_start") + F.expr(f"INTERVAL {window}")).alias("reset_at"))
