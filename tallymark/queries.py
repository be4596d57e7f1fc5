"""Registered queries of the usage engine over the driver's tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import reports
from .functions.dates import date_key
from .functions.text import without_date
from .functions.tokens import explained, without_cached
from .operators import aggregate, blocks, carry, dedup, joins, price_book, pricing, resolve
from .plans.bench_view import USAGE_SQL, usage_view
from .schema import COUNTERS, total_tokens
from .sources import copilot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOKENS = "input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens"
SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS)


def query(name: str, sql: str | None = None):
    """Register a query and, with `sql`, what DuckDB computes for it (`u` is the usage view, `c` the priced one)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {USAGE_SQL}{_COST if 'FROM c ' in sql else ''} {sql}"
        return f

    return add


def _rates_sql() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT" if type(v) is int else str(v)
    names = "price_model, input_rate, output_rate, create_rate, read_rate, input_above, output_above, create_above, read_above, threshold, read_explicit, fast_multiplier"
    rows = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in pricing.rate_rows())
    return f"rates({names}) AS (VALUES {rows})"


def _tier_sql(tokens: str, rate: str, above: str) -> str:
    return f"CASE WHEN {above} IS NOT NULL AND {tokens} > 200000 THEN 200000 * {rate} + ({tokens} - 200000) * {above} ELSE {tokens} * {rate} END"


_BUCKETS = [("input_tokens", "input"), ("output_tokens", "output"), ("cache_creation_tokens", "create"), ("cache_read_tokens", "read")]
_PLAIN = " + ".join(f"({_tier_sql(t, f'{k}_rate', f'{k}_above')})" for t, k in _BUCKETS)
_COST = f""", {_rates_sql()},
c AS (
  SELECT u.*, coalesce(CASE WHEN fast THEN floor(({_PLAIN}) * fast_multiplier + 0.5)::BIGINT ELSE {_PLAIN} END, 0)::BIGINT AS cost_pico,
    price_model IS NULL AND {TOKENS} > 0 AS missing_pricing FROM u LEFT JOIN rates ON u.model = price_model)"""
DOLLARS = "((sum(cost_pico) + 500000) // 1000000)::DOUBLE / 1e6 AS cost"
DAY = "strftime(DATE '1970-01-01' + day_no::INTEGER, '%Y-%m-%d')"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.with_cost(usage_view(spark, sf_dir), pricing.rate_table(spark))


def _cost() -> F.Column:
    return aggregate.rounded_dollars(F.col("cost_pico")).alias("cost")


# Periods, sessions and totals


@query("daily_usage", f"SELECT {DAY} AS period, {SUMS}, sum({TOKENS})::BIGINT AS total_tokens, {DOLLARS} FROM c GROUP BY 1")
def daily_usage(spark, sf_dir):
    return aggregate.by_period(priced(spark, sf_dir)).select("period", *COUNTERS, "total_tokens", _cost())


def _period(name: str, period: str, first_day: int, key: str):
    @query(name, f"SELECT {key} AS period, {SUMS}, sum({TOKENS})::BIGINT AS total_tokens, {DOLLARS} FROM c GROUP BY 1")
    def run(spark, sf_dir):
        daily = aggregate.by_period(priced(spark, sf_dir))
        return aggregate.rebucket(daily, period, first_day).select("period", *COUNTERS, "total_tokens", _cost())


_period("weekly_monday", "weekly", 1, "strftime(date_trunc('week', DATE '1970-01-01' + day_no::INTEGER), '%Y-%m-%d')")
_period("weekly_sunday", "weekly", 0, "strftime(date_trunc('week', DATE '1970-01-02' + day_no::INTEGER)::DATE - 1, '%Y-%m-%d')")
_period("monthly_usage", "monthly", 0, "strftime(DATE '1970-01-01' + day_no::INTEGER, '%Y-%m')")


@query("daily_tz", f"SELECT strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') AS period, {SUMS}, sum({TOKENS})::BIGINT AS total_tokens, {DOLLARS} FROM c GROUP BY 1")
def daily_tz(spark, sf_dir):
    return aggregate.by_period(priced(spark, sf_dir), zone="America/New_York").select("period", *COUNTERS, "total_tokens", _cost())


@query("daily_by_model", f"SELECT {DAY} AS period, model, {SUMS}, sum({TOKENS})::BIGINT AS total_tokens, {DOLLARS} FROM c GROUP BY 1, 2")
def daily_by_model(spark, sf_dir):
    rows = aggregate.with_breakdowns(priced(spark, sf_dir)).select("period", F.explode("model_breakdowns").alias("b"))
    return rows.select("period", "b.model", *[f"b.{c}" for c in COUNTERS], "b.total_tokens", aggregate.rounded_dollars(F.col("b.cost_pico")).alias("cost"))


@query("unified_daily_by_agent", f"SELECT {DAY} AS period, agent, {SUMS}, sum({TOKENS})::BIGINT AS total_tokens, {DOLLARS}, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM c WHERE {TOKENS} > 0 GROUP BY 1, 2")
def unified_daily_by_agent(spark, sf_dir):
    rows = aggregate.by_period_and_agent(priced(spark, sf_dir)).select("period", F.explode("agent_breakdowns").alias("b"))
    return rows.select("period", "b.agent", *[f"b.{c}" for c in COUNTERS], "b.total_tokens", aggregate.rounded_dollars(F.col("b.cost_pico")).alias("cost"), F.array_join("b.models_used", ",").alias("models"))


@query("unified_weekly", f"SELECT strftime(date_trunc('week', DATE '1970-01-01' + day_no::INTEGER), '%Y-%m-%d') AS period, {SUMS}, {DOLLARS}, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents FROM c WHERE {TOKENS} > 0 GROUP BY 1")
def unified_weekly(spark, sf_dir):
    rows = aggregate.by_period_and_agent(priced(spark, sf_dir), "weekly")
    return rows.select("period", *COUNTERS, _cost(), F.array_join("agents", ",").alias("agents"))


_SESSIONS = f"""SELECT project, session_id, {SUMS}, sum({TOKENS})::BIGINT AS total_tokens, {DOLLARS}, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
  arg_max(model, {{'a': ts_ms, 'b': -seq}}) AS last_model, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, count(*) AS n_entries FROM c GROUP BY 1, 2"""


def _session_rows(df: DataFrame) -> DataFrame:
    return df.select("project", "session_id", *COUNTERS, "total_tokens", _cost(), "first_ms", "last_ms", "last_model", F.array_join("versions", ",").alias("versions"), "n_entries")


@query("sessions", _SESSIONS)
def sessions(spark, sf_dir):
    return _session_rows(aggregate.sessions(priced(spark, sf_dir)))


@query("sessions_cost_desc", f"SELECT project, session_id, {DOLLARS}, row_number() OVER (ORDER BY sum(cost_pico) DESC, session_id, project) AS place FROM c GROUP BY 1, 2 ORDER BY place LIMIT 25")
def sessions_cost_desc(spark, sf_dir):
    top = aggregate.sessions(priced(spark, sf_dir)).orderBy(F.desc("cost_pico"), "session_id", "project").limit(25)
    return top.select("project", "session_id", _cost(), F.row_number().over(Window.orderBy(F.desc("cost_pico"), "session_id", "project")).cast("long").alias("place"))


@query("session_last_activity_filter", "SELECT project, session_id, max(ts_ms) AS last_ms FROM u GROUP BY 1, 2 HAVING strftime(epoch_ms(max(ts_ms)), '%Y%m%dT%H') >= '20240110' AND strftime(epoch_ms(max(ts_ms)), '%Y%m%dT%H') <= '20240130'")
def session_last_activity_filter(spark, sf_dir):
    rows = aggregate.sessions(usage_view(spark, sf_dir).withColumn("cost_pico", F.lit(0).cast("long")))
    return aggregate.last_activity_filter(rows, "20240110", "20240130").select("project", "session_id", "last_ms")


@query("session_detail", f"SELECT seq, ts_ms, model, {', '.join(COUNTERS)} FROM u WHERE session_id = 's7'")
def session_detail(spark, sf_dir):
    return usage_view(spark, sf_dir).where("session_id = 's7'").orderBy("ts_ms", "seq").select("seq", "ts_ms", "model", *COUNTERS)


@query("grand_totals_by_rollup", f"SELECT agent, model, {SUMS}, {DOLLARS}, count(*) AS n_entries FROM c GROUP BY ROLLUP (agent, model)")
def grand_totals_by_rollup(spark, sf_dir):
    return aggregate.grand_totals(priced(spark, sf_dir), ["agent", "model"]).select("agent", "model", *COUNTERS, _cost(), "n_entries")


@query("totals", f"SELECT {SUMS}, {DOLLARS}, count(*) AS n_entries, count(*) FILTER (WHERE missing_pricing) AS n_unpriced, string_agg(DISTINCT CASE WHEN missing_pricing THEN model END, ',') AS unpriced FROM c ")
def totals(spark, sf_dir):
    p = priced(spark, sf_dir)
    out = p.agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum("cost_pico").alias("cost_pico"), F.count("*").alias("n_entries"),
                F.count_if("missing_pricing").alias("n_unpriced"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("missing_pricing"), F.col("model")))), ",").alias("unpriced"))
    return out.select(*COUNTERS, _cost(), "n_entries", "n_unpriced", "unpriced")


@query("date_range_entries", f"SELECT seq, {DAY} AS date FROM u WHERE {DAY} BETWEEN '2024-01-05' AND '2024-01-09'")
def date_range_entries(spark, sf_dir):
    rows = usage_view(spark, sf_dir).withColumn("date", date_key(F.col("ts_ms")))
    return rows.where(F.col("date").between("2024-01-05", "2024-01-09")).select("seq", "date")


@query("distinct_models", "SELECT agent, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM u GROUP BY 1")
def distinct_models(spark, sf_dir):
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return usage_view(spark, sf_dir).groupBy("agent").agg(text("model").alias("models"), text("version").alias("versions"))


@query("union_sources", "SELECT agent, seq, 'web' AS source FROM u WHERE agent IN ('click', 'view') UNION ALL SELECT agent, seq, 'shop' FROM u WHERE agent = 'purchase'")
def union_sources(spark, sf_dir):
    u = usage_view(spark, sf_dir).select("agent", "seq")
    return u.where("agent in ('click', 'view')").withColumn("source", F.lit("web")).unionByName(u.where("agent = 'purchase'").withColumn("source", F.lit("shop")))


# Removal of duplicates

_ONE = "SELECT seq, message_id, request_id FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM u) WHERE n = 1"


@query("dedup_first", _ONE.format(keys="message_id, session_id", order="seq"))
def dedup_first(spark, sf_dir):
    return dedup.first_of(usage_view(spark, sf_dir), ["message_id", "session_id"]).select("seq", "message_id", "request_id")


@query("dedup_last", _ONE.format(keys="session_id, model", order="ts_ms DESC, seq DESC"))
def dedup_last(spark, sf_dir):
    return dedup.keep_best(usage_view(spark, sf_dir), ["session_id", "model"], [F.col("ts_ms"), F.col("seq")]).select("seq", "message_id", "request_id")


@query("dedup_best_tokens", _ONE.format(keys="message_id, request_id", order=f"is_sidechain, ({TOKENS}) DESC, fast DESC, seq"))
def dedup_best_tokens(spark, sf_dir):
    return dedup.best_request(usage_view(spark, sf_dir), total_tokens()).select("seq", "message_id", "request_id")


def _components(u: DataFrame) -> DataFrame:
    edges = u.select(F.concat(F.lit("u"), "user_id").alias("a"), F.concat(F.lit("k"), F.col("user_id") % 25, F.lit("-"), F.floor(F.col("k") / 90)).alias("b")).distinct()
    return dedup.components(edges, "a", "b")


@query("dedup_components", f"""WITH RECURSIVE {USAGE_SQL},
d AS (SELECT DISTINCT 'u' || user_id AS a, 'k' || (user_id % 25) || '-' || (k // 90) AS b FROM u),
g AS (SELECT a AS x, b AS y FROM d UNION SELECT b, a FROM d),
r AS (SELECT x AS node, x AS root FROM g UNION SELECT g.y, r.root FROM r JOIN g ON g.x = r.node)
SELECT node, min(root) AS root FROM r GROUP BY 1""")
def dedup_components(spark, sf_dir):
    return _components(usage_view(spark, sf_dir))


# Order-dependent operators


@query("cumulative_to_delta", """, t AS (SELECT *, sum(output_tokens // 400) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS total FROM u),
d AS (SELECT *, lag(total) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS p FROM t)
SELECT seq, total::BIGINT AS total, (total - coalesce(p, 0))::BIGINT AS total_delta FROM d WHERE p IS NULL OR total <> p""")
def cumulative_to_delta(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    u = usage_view(spark, sf_dir).withColumn("total", F.sum(F.floor(F.col("output_tokens") / 400)).over(w))
    return carry.deltas(u, ["total"], ["session_id"], ["ts_ms", "seq"]).select("seq", "total", "total_delta")


@query("intervals_by_session_model", """, t AS (SELECT *, sum(input_tokens) OVER (PARTITION BY session_id, model ORDER BY ts_ms, seq) AS total FROM u),
d AS (SELECT *, total - coalesce(lag(total) OVER (PARTITION BY session_id, model ORDER BY ts_ms, seq), 0) AS input FROM t)
SELECT seq, input::BIGINT AS input FROM d WHERE ts_ms >= 1704844800000 AND ts_ms < 1705708800000""")
def intervals_by_session_model(spark, sf_dir):
    w = Window.partitionBy("session_id", "model").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    u = usage_view(spark, sf_dir).withColumn("input", F.sum("input_tokens").over(w))
    return carry.intervals(u, ["input"], ["session_id", "model"], since_ms=1704844800000, until_ms=1705708800000).select("seq", "input")


@query("model_carry_forward", """, t AS (SELECT *, CASE WHEN k % 4 = 1 THEN model END AS said FROM u),
d AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS m FROM t)
SELECT seq, coalesce(m, 'gpt-5') AS model_used, m IS NULL AND row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, seq) = 1 AS is_fallback FROM d""")
def model_carry_forward(spark, sf_dir):
    u = usage_view(spark, sf_dir).withColumn("said", F.when(F.col("k") % 4 == 1, F.col("model")))
    return carry.with_fallback_model(u, "said", ["session_id"], ["ts_ms", "seq"], "gpt-5").select("seq", "model_used", "is_fallback")


@query("tier_carry_with_reset", """, t AS (SELECT *, max(CASE WHEN k % 5 = 0 THEN ts_ms * 1000000 + seq END) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS at FROM u)
SELECT t.seq, CASE WHEN s.k % 10 = 0 THEN s.version END AS tier FROM t LEFT JOIN u s ON s.session_id = t.session_id AND s.ts_ms * 1000000 + s.seq = t.at""")
def tier_carry_with_reset(spark, sf_dir):
    u = usage_view(spark, sf_dir)
    tier = carry.carried_struct(F.col("k") % 5 == 0, F.when(F.col("k") % 10 == 0, F.col("version")), ["session_id"], ["ts_ms", "seq"])
    return u.select("seq", tier.alias("tier"))


@query("replay_bursts", """, t AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY project ORDER BY ts_ms, seq) AS gap FROM u)
SELECT seq, sum(CASE WHEN gap IS NULL OR gap > 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts_ms, seq)::BIGINT AS burst FROM t""")
def replay_bursts(spark, sf_dir):
    return carry.bursts(usage_view(spark, sf_dir), ["project"], "ts_ms", ["ts_ms", "seq"], 600_000).select("seq", "burst")


@query("asof_model_switch", """, s AS (SELECT session_id, ts_ms, max(model) AS switched FROM u WHERE agent = 'signup' GROUP BY 1, 2),
f AS (SELECT session_id, arg_min(switched, ts_ms) AS first_one FROM s GROUP BY 1)
SELECT l.seq, coalesce(s.switched, f.first_one) AS switched FROM (SELECT * FROM u WHERE agent = 'purchase') l
ASOF LEFT JOIN s ON l.session_id = s.session_id AND l.ts_ms >= s.ts_ms LEFT JOIN f ON f.session_id = l.session_id""")
def asof_model_switch(spark, sf_dir):
    u = usage_view(spark, sf_dir)
    switches = u.where("agent = 'signup'").select("session_id", "ts_ms", F.col("model").alias("switched"))
    return carry.as_of(u.where("agent = 'purchase'"), switches, ["session_id"], "ts_ms", "switched").select("seq", "switched")


# Joins


@query("anti_jobs", "SELECT seq FROM u WHERE agent = 'purchase' AND NOT EXISTS (SELECT 1 FROM u t WHERE t.agent = 'error' AND t.session_id = u.session_id AND t.model = u.model)")
def anti_jobs(spark, sf_dir):
    u = usage_view(spark, sf_dir)
    return u.where("agent = 'purchase'").join(u.where("agent = 'error'").select("session_id", "model").distinct(), ["session_id", "model"], "left_anti").select("seq")


@query("theta_anti_after_latest", """, m AS (SELECT session_id, model, max(ts_ms) AS latest FROM u WHERE agent = 'error' GROUP BY 1, 2)
SELECT u.seq FROM u LEFT JOIN m ON u.session_id = m.session_id AND u.model = m.model WHERE u.agent = 'view' AND (m.latest IS NULL OR u.ts_ms > m.latest)""")
def theta_anti_after_latest(spark, sf_dir):
    u = usage_view(spark, sf_dir)
    return joins.after_latest(u.where("agent = 'view'"), u.where("agent = 'error'"), ["session_id", "model"], "ts_ms").select("seq")


@query("semi_recent_group", "SELECT session_id, count(*) AS n FROM u WHERE session_id IN (SELECT session_id FROM u GROUP BY 1 HAVING max(ts_ms) >= (SELECT max(ts_ms) FROM u) - 86400000) GROUP BY 1")
def semi_recent_group(spark, sf_dir):
    by = usage_view(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last"))
    newest = by.agg(F.max("last").alias("newest"))
    return by.join(F.broadcast(newest), F.col("last") >= F.col("newest") - 86_400_000).select("session_id", "n")


@query("cascade_precedence", """, v AS (SELECT *, session_id || model AS trace FROM u),
k0 AS (SELECT seq, message_id, trace FROM v WHERE agent = 'purchase'),
k1 AS (SELECT seq, message_id, trace FROM v WHERE agent = 'signup' AND NOT EXISTS (SELECT 1 FROM k0 WHERE k0.message_id = v.message_id) AND NOT EXISTS (SELECT 1 FROM k0 WHERE k0.trace = v.trace)),
m1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1),
k2 AS (SELECT seq, message_id, trace FROM v WHERE agent = 'view' AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.message_id = v.message_id) AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.trace = v.trace))
SELECT seq FROM m1 UNION ALL SELECT seq FROM k2""")
def cascade_precedence(spark, sf_dir):
    u = usage_view(spark, sf_dir).withColumn("trace", F.concat("session_id", "model")).select("seq", "agent", "message_id", "trace")
    return joins.cascade([u.where(F.col("agent") == a) for a in ("purchase", "signup", "view")], ["message_id", "trace"]).select("seq")


@query("foremost_records", """, v AS (SELECT seq, CASE agent WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS level, project, message_id, session_id || model AS trace FROM u),
b AS (SELECT *, min(level) OVER (PARTITION BY project, message_id) AS by_message, min(level) OVER (PARTITION BY project, trace) AS by_trace FROM v)
SELECT seq, level FROM b WHERE (message_id IS NULL OR level <= by_message) AND (trace IS NULL OR level <= by_trace)""")
def foremost_records(spark, sf_dir):
    level = F.when(F.col("agent") == "purchase", 0).when(F.col("agent") == "signup", 1).when(F.col("agent") == "view", 2).otherwise(3)
    u = usage_view(spark, sf_dir).select("seq", level.alias("level"), "project", "message_id", F.concat("session_id", "model").alias("trace"))
    return joins.foremost(u, "level", ["message_id", "trace"], ["project"]).select("seq", "level")


@query("trace_contexts", """, v AS (SELECT *, nullif(k % 4, 0) AS r FROM u)
SELECT project AS source_file, session_id AS trace, arg_min(model, seq) FILTER (WHERE seq % 3 = 0) AS c_model, arg_min(message_id, seq - r * 1000000000000) FILTER (WHERE r IS NOT NULL) AS c_session
FROM v GROUP BY 1, 2""")
def trace_contexts(spark, sf_dir):
    rank = F.nullif(F.col("k") % 4, F.lit(0).cast("long"))
    u = usage_view(spark, sf_dir).select(
        F.col("project").alias("source_file"), "seq", F.col("session_id").alias("trace"), F.when(F.col("seq") % 3 == 0, F.col("model")).alias("model"), F.when(rank.isNotNull(), F.col("message_id")).alias("session"), rank.alias("rank")
    )
    return copilot.contexts(u)


@query("range_in_zone", """SELECT seq, ts_ms FROM u WHERE strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-09'""")
def range_in_zone(spark, sf_dir):
    return reports.in_range(usage_view(spark, sf_dir), reports.Options(since="20240105", until="2024-01-09", zone="America/New_York")).select("seq", "ts_ms")


@query("fork_prefix_removal", """, p AS (SELECT project, seq, k % 3 AS sig, row_number() OVER (PARTITION BY project ORDER BY seq) AS n FROM u WHERE agent = 'click'),
q AS (SELECT project, seq, k % 3 AS sig, row_number() OVER (PARTITION BY project ORDER BY seq) AS n FROM u WHERE agent = 'view'),
d AS (SELECT q.project, min(q.n) AS first FROM q LEFT JOIN p ON p.project = q.project AND p.n = q.n WHERE p.sig IS DISTINCT FROM q.sig GROUP BY 1)
SELECT q.project, q.seq FROM q JOIN d ON q.project = d.project WHERE q.n >= d.first""")
def fork_prefix_removal(spark, sf_dir):
    u = usage_view(spark, sf_dir).select("project", "seq", "agent", "ts_ms", (F.col("k") % 3).alias("sig"))
    return joins.without_fork_prefix(u.where("agent = 'view'"), u.where("agent = 'click'"), "project", "seq", ["sig"]).select("project", "seq")


@query("fork_replays", """, f AS (SELECT 'f' || user_id AS file, 'f' || (user_id % 40 - 10) AS parent, user_id % 40 >= 10 AS is_fork, seq, ts_ms, k % 2 AS sig, user_id FROM u),
ev AS (SELECT *, row_number() OVER w AS n, max(ts_ms) OVER w AS late, 1704067200000 + user_id * 7200000 AS forked, CASE WHEN user_id % 2 = 0 THEN min(ts_ms) OVER (PARTITION BY file) END AS burst FROM f WINDOW w AS (PARTITION BY file ORDER BY seq)),
j AS (SELECT ev.*, coalesce(p.sig = ev.sig AND p.late <= ev.forked, false) AS same,
  ev.ts_ms - CASE WHEN ev.n = 1 THEN ev.burst ELSE lag(ev.ts_ms) OVER (PARTITION BY ev.file ORDER BY ev.n) END BETWEEN 0 AND 3600000 AS near FROM ev LEFT JOIN ev p ON p.file = ev.parent AND p.n = ev.n WHERE ev.is_fork),
g AS (SELECT *, bool_and(same) OVER w AS repeats, first_value(same) OVER w AS starts, bool_and(coalesce(near, false)) OVER w AS bursts FROM j WINDOW w AS (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT file, seq FROM ev WHERE NOT is_fork UNION ALL SELECT file, seq FROM g WHERE NOT (repeats OR (NOT starts AND burst IS NOT NULL AND bursts))""")
def fork_replays(spark, sf_dir):
    u = usage_view(spark, sf_dir)
    start = F.min("ts_ms").over(Window.partitionBy("file"))
    rows = u.select(F.concat(F.lit("f"), "user_id").alias("file"), F.concat(F.lit("f"), F.col("user_id") % 40 - 10).alias("parent"), (F.col("user_id") % 40 >= 10).alias("is_fork"), "seq", "ts_ms",
                    (F.col("k") % 2).alias("sig"), (F.lit(1_704_067_200_000) + F.col("user_id") * 7_200_000).alias("forked"), "user_id")
    rows = rows.withColumn("burst", F.when(F.col("user_id") % 2 == 0, start))
    return joins.without_replayed(rows, "file", "parent", "is_fork", "seq", ["sig"], "ts_ms", "forked", "burst", 3_600_000).select("file", "seq")


@query("report_by_model", f""", d AS (SELECT *, strftime(date_trunc('week', DATE '1970-01-01' + day_no::INTEGER), '%Y-%m-%d') AS period FROM c )
SELECT period, model, {SUMS}, sum({TOKENS})::BIGINT AS total_tokens, bool_or(is_sidechain) AS is_fallback, bool_or(missing_pricing) AS missing_pricing FROM d GROUP BY 1, 2""")
def report_by_model(spark, sf_dir):
    p = priced(spark, sf_dir).withColumns({"is_fallback": F.col("is_sidechain"), "reasoning_tokens": F.lit(0).cast("long")})
    rows = reports.by_model(p, "weekly").select("period", F.explode("models").alias("m"))
    return rows.select("period", "m.model", *[f"m.{c}" for c in COUNTERS], "m.total_tokens", "m.is_fallback", "m.missing_pricing")


# Billing blocks

_BLOCK_SQL = """WITH RECURSIVE {usage}{cost},
o AS (SELECT {key} AS acct, ts_ms, lag(ts_ms) OVER (PARTITION BY {key} ORDER BY ts_ms, seq) AS before FROM c),
b AS (
  SELECT acct, min(ts_ms) AS f FROM o GROUP BY acct
  UNION ALL
  SELECT b.acct, min(o.ts_ms) FROM b JOIN o ON o.acct = b.acct AND o.ts_ms > b.f AND (o.ts_ms - (b.f - b.f % 3600000) > 18000000 OR o.ts_ms - o.before > 18000000) GROUP BY b.acct, b.f),
s AS (SELECT acct, f, lead(f) OVER (PARTITION BY acct ORDER BY f) AS nxt FROM b),
g AS (
  SELECT s.acct, f - f % 3600000 AS start_ms, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n_entries, sum(input_tokens)::BIGINT AS input_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens,
    sum(cost_pico) AS pico, count(DISTINCT model) AS n_models
  FROM s JOIN c ON {key} = s.acct AND ts_ms >= f AND (nxt IS NULL OR ts_ms < nxt) GROUP BY s.acct, f)
"""
_BLOCK_SQL = _BLOCK_SQL.replace("{usage}", USAGE_SQL).replace("{cost}", _COST)
_BLOCK_COLS = ["start_ms", "first_ms", "last_ms", "n_entries", *blocks.BLOCK_COUNTERS]


@query("blocks", _BLOCK_SQL.replace("{key}", "0") + f"SELECT {', '.join(_BLOCK_COLS)}, ((pico + 500000) // 1000000)::DOUBLE / 1e6 AS cost, n_models FROM g")
def all_blocks(spark, sf_dir):
    rows = blocks.blocks(priced(spark, sf_dir).withColumn("acct", F.lit(0)), ["acct"], gaps=False)
    return rows.select(*_BLOCK_COLS, _cost(), F.size("models").cast("long").alias("n_models"))


@query("blocks_per_user", _BLOCK_SQL.replace("{key}", "user_id") + f"SELECT acct AS user_id, {', '.join(_BLOCK_COLS)}, ((pico + 500000) // 1000000)::DOUBLE / 1e6 AS cost, n_models FROM g")
def blocks_per_user(spark, sf_dir):
    rows = blocks.blocks(priced(spark, sf_dir), ["user_id"], gaps=False)
    return rows.select("user_id", *_BLOCK_COLS, _cost(), F.size("models").cast("long").alias("n_models"))


@query("block_gaps", _BLOCK_SQL.replace("{key}", "user_id") + """, x AS (SELECT acct, last_ms, lead(first_ms) OVER (PARTITION BY acct ORDER BY start_ms, first_ms) AS nxt FROM g)
SELECT acct AS user_id, last_ms + 18000000 AS start_ms, nxt AS end_ms FROM x WHERE nxt - last_ms > 18000000""")
def block_gaps(spark, sf_dir):
    return blocks.blocks(priced(spark, sf_dir), ["user_id"]).where("is_gap").select("user_id", "start_ms", "end_ms")


_NOW = 1_706_659_200_000  # 2024-01-31 00:00 UTC
_BT = "(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens)"


@query("block_burn_rate", _BLOCK_SQL.replace("{key}", "user_id") + f"""SELECT acct AS user_id, start_ms, first_ms, round(CASE WHEN last_ms > first_ms THEN {_BT} / ((last_ms - first_ms) / 60000.0::DOUBLE) END, 4) AS tokens_per_minute,
round(CASE WHEN last_ms > first_ms THEN pico::DOUBLE / 1e12 / ((last_ms - first_ms) / 60000.0::DOUBLE) * 60 END, 4) AS cost_per_hour FROM g""")
def block_burn_rate(spark, sf_dir):
    rows = blocks.burn_rate(blocks.blocks(priced(spark, sf_dir), ["user_id"], gaps=False))
    return rows.select("user_id", "start_ms", "first_ms", F.round("tokens_per_minute", 4).alias("tokens_per_minute"), F.round("cost_per_hour", 4).alias("cost_per_hour"))


@query("block_projection", _BLOCK_SQL.replace("{key}", "project") + f"""SELECT acct AS project, start_ms, floor(({_BT} + {_BT} / ((last_ms - first_ms) / 60000.0::DOUBLE) * ((start_ms + 18000000 - {_NOW}) / 60000.0::DOUBLE)) + 0.5)::BIGINT AS projected_tokens,
floor((start_ms + 18000000 - {_NOW}) / 60000.0::DOUBLE + 0.5)::BIGINT AS remaining_minutes FROM g WHERE {_NOW} - last_ms < 18000000 AND {_NOW} < start_ms + 18000000 AND last_ms > first_ms""")
def block_projection(spark, sf_dir):
    rows = blocks.burn_rate(blocks.blocks(priced(spark, sf_dir), ["project"], now_ms=_NOW, gaps=False))
    return blocks.projection(rows, _NOW).where("is_active and projected_tokens is not null").select("project", "start_ms", "projected_tokens", "remaining_minutes")


@query("block_limit_status", _BLOCK_SQL.replace("{key}", "user_id") + f"""SELECT acct AS user_id, start_ms, first_ms, {_BT} AS tokens, CASE WHEN {_BT} > 20000 THEN 'exceeds' WHEN {_BT} > 16000 THEN 'warning' ELSE 'ok' END AS status FROM g""")
def block_limit_status(spark, sf_dir):
    rows = blocks.blocks(priced(spark, sf_dir), ["user_id"], gaps=False)
    return rows.select("user_id", "start_ms", "first_ms", blocks.block_tokens().alias("tokens"), blocks.limit_status(blocks.block_tokens(), F.lit(20_000)).alias("status"))


# Pricing


@query("price_tiered", f", rows AS (SELECT seq, model, input_tokens * 60 AS input_tokens, output_tokens * 60 AS output_tokens, cache_creation_tokens, cache_read_tokens, rates.* FROM u JOIN rates ON model = price_model), x AS (SELECT 1 FROM c LIMIT 1) SELECT seq, ({_PLAIN})::BIGINT AS cost_pico FROM rows")
def price_tiered(spark, sf_dir):
    u = usage_view(spark, sf_dir).withColumns({c: F.col(c) * 60 for c in ("input_tokens", "output_tokens")})
    return pricing.priced_rows(u, pricing.rate_table(spark)).where("price_model is not null").select("seq", pricing.cost_by_bucket().alias("cost_pico"))


def _long(k: str) -> str:
    return f"CASE WHEN input_tokens + cache_read_tokens + cache_creation_tokens > 8000 THEN coalesce({k}_above, {k}_rate) ELSE {k}_rate END"


@query("price_whole_request", f", rows AS (SELECT u.*, rates.* FROM u JOIN rates ON model = price_model), x AS (SELECT 1 FROM c LIMIT 1) SELECT seq, ({' + '.join(f'{t} * ({_long(k)})' for t, k in _BUCKETS)})::BIGINT AS cost_pico FROM rows")
def price_whole_request(spark, sf_dir):
    rows = pricing.priced_rows(usage_view(spark, sf_dir), pricing.rate_table(spark)).where("price_model is not null")
    return rows.select("seq", pricing.cost_by_request(F.lit(8000)).alias("cost_pico"))


_COD = " + ".join(f"{t} * (CASE WHEN k * 4000 > 200000 THEN coalesce({k}_above, {k}_rate) ELSE {k}_rate END)" for t, k in _BUCKETS)


@query("price_codex", f", rows AS (SELECT u.*, rates.* FROM u JOIN rates ON model = price_model), x AS (SELECT 1 FROM c LIMIT 1) SELECT seq, (CASE WHEN fast THEN floor(({_COD}) * fast_multiplier + 0.5) ELSE {_COD} END)::BIGINT AS cost_pico FROM rows")
def price_codex(spark, sf_dir):
    rows = pricing.priced_rows(usage_view(spark, sf_dir), pricing.rate_table(spark)).where("price_model is not null")
    return rows.select("seq", pricing.cost_codex(F.col("k") * 4000, F.col("fast")).alias("cost_pico"))


_PEAK = "((ts_ms // 86400000 + 4) % 7 BETWEEN 1 AND 5 AND (ts_ms % 86400000 // 3600000 BETWEEN 1 AND 3 OR ts_ms % 86400000 // 3600000 BETWEEN 6 AND 9))"


def _schedule_sql() -> str:
    rows = []
    by: dict[str, list] = {}
    for m, start, off, peak in pricing.SCHEDULE:
        by.setdefault(m, []).append((pricing.era_start(start), off, peak or off))
    for m, eras in by.items():
        for i, (start, off, peak) in enumerate(eras):
            stop = eras[i + 1][0] if i + 1 < len(eras) else 2**62
            rows.append(f"('{m}', {start}, {stop}, {', '.join(str(pricing.pico(x)) for x in (*off, *peak))})")
    return f"sched(s_model, from_ms, to_ms, o1, o2, o3, o4, p1, p2, p3, p4) AS (VALUES {', '.join(rows)})"


@query("price_scheduled", f"""WITH {USAGE_SQL}, {_schedule_sql()}, t AS (SELECT * REPLACE (ts_ms + 86400000000 AS ts_ms) FROM u WHERE model LIKE 'deepseek%')
SELECT seq, CASE WHEN {_PEAK} THEN input_tokens * p1 + output_tokens * p2 + cache_creation_tokens * p3 + cache_read_tokens * p4
  ELSE input_tokens * o1 + output_tokens * o2 + cache_creation_tokens * o3 + cache_read_tokens * o4 END::BIGINT AS cost_pico
FROM t JOIN sched ON s_model = model AND ts_ms >= from_ms AND ts_ms < to_ms""")
def price_scheduled(spark, sf_dir):
    u = usage_view(spark, sf_dir).where("model like 'deepseek%'").withColumn("ts_ms", F.col("ts_ms") + 86_400_000_000)
    rows = pricing.scheduled(pricing.priced_rows(u, pricing.rate_table(spark)), pricing.schedule_table(spark))
    return rows.select("seq", pricing.cost_by_bucket().alias("cost_pico"))


@query("price_override", "SELECT seq, (input_tokens * 2000000 + output_tokens * 10000000 + cache_creation_tokens * 1250000 + cache_read_tokens * 125000)::BIGINT AS cost_pico FROM u WHERE model = 'gpt-5' UNION ALL SELECT seq, (input_tokens * 1000000 + output_tokens * 3000000 + cache_creation_tokens * 1250000 + cache_read_tokens * 100000)::BIGINT FROM u WHERE model = 'unlisted-model'")
def price_override(spark, sf_dir):
    rates = pricing.rate_table(spark, pricing.rate_rows(overrides={"gpt-5": {"input": 2}, "unlisted-model": {"input": 1, "output": 3}}))
    u = usage_view(spark, sf_dir).where("model in ('gpt-5', 'unlisted-model')")
    return pricing.priced_rows(u, rates).select("seq", pricing.cost_by_bucket().alias("cost_pico"))


@query("price_candidates", f""", k AS (SELECT u.*, unnest([{{'p': 1, 'm': 'zai/glm-4.5-flash'}}, {{'p': 2, 'm': model}}, {{'p': 3, 'm': 'moonshot/kimi-k2.5'}}]) AS cand FROM u),
x AS (SELECT 1 FROM c LIMIT 1), r AS (SELECT k.*, rates.*, ({_PLAIN})::BIGINT AS pico FROM k JOIN rates ON cand.m = price_model)
SELECT seq, price_model, pico AS cost_pico FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pico <= 0, CASE WHEN contains(price_model, '/') THEN 1 ELSE 2 END, cand.p) AS n FROM r) WHERE n = 1""")
def price_candidates(spark, sf_dir):
    u = usage_view(spark, sf_dir).withColumn("candidates", F.array(F.lit("zai/glm-4.5-flash"), F.col("model"), F.lit("moonshot/kimi-k2.5")))
    return pricing.best_candidate(u, pricing.rate_table(spark), ["seq"])


@query("price_report", f""", k AS (SELECT u.*, unnest([{{'p': 1, 'm': 'zai/glm-4.5-flash'}}, {{'p': 2, 'm': model}}, {{'p': 3, 'm': 'moonshot/kimi-k2.5'}}]) AS cand FROM u),
x AS (SELECT 1 FROM c LIMIT 1), r AS (SELECT k.*, rates.*, ({_PLAIN} + least(cache_creation_tokens, 40) * (2 * input_rate - create_rate))::BIGINT AS pico FROM k JOIN rates ON cand.m = price_model)
SELECT seq, CASE WHEN fast THEN floor(pico * fast_multiplier + 0.5)::BIGINT ELSE pico END AS cost_pico, false AS missing_pricing
FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pico <= 0, CASE WHEN contains(price_model, '/') THEN 1 ELSE 2 END, cand.p) AS n FROM r) WHERE n = 1""")
def price_report(spark, sf_dir):
    u = usage_view(spark, sf_dir).withColumn("one_hour", F.least("cache_creation_tokens", F.lit(40)))
    u = u.withColumn("candidates", F.array(F.lit("zai/glm-4.5-flash"), F.col("model"), F.lit("moonshot/kimi-k2.5")))
    return reports.price(u, mode="calculate").select("seq", "cost_pico", "missing_pricing")


_VARIANTS = [("''", "''"), ("'SNAP-'", "''"), ("'cat.'", "''"), ("'z'", "''"), ("''", "'-free'"), ("'none/'", "'@x'")]


def _layered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, price_book.Book]:
    """Spellings of the usage view's models, and a book whose snapshot and catalogue are lists derived from them."""
    models = usage_view(spark, sf_dir).select("model").distinct()
    row = lambda name, rate: [name.alias("name"), *[F.lit(rate * (i + 1)).cast("long").alias(f"{k}_rate") for i, k in enumerate(pricing.KINDS)]]
    rest = lambda df, exact: df.select("*", *[F.lit(None).cast("long").alias(f"{k}_above") for k in pricing.KINDS], F.lit(True).alias("create_explicit"), F.lit(True).alias("read_explicit"),
                                       F.lit(None).cast("long").alias("threshold"), F.lit(1.0).alias("fast_multiplier"), F.lit(exact).alias("exact_only"), F.lit(None).cast("long").alias("context"))
    named = lambda prefix: F.concat(F.lit(prefix), "model")
    snapshot = rest(models.select(*row(named("snap-"), 7)), False)
    tails = models.select(*row(named("p1/z"), 3)).union(models.select(*row(named("p22/z"), 3))).union(models.select(*row(named("p/z"), 4)))
    catalogue = rest(models.select(*row(named("cat-"), 2)), True).unionByName(rest(tails, False))
    names = models.select(F.explode(F.array(*[F.concat(F.lit(a.strip("'")), "model", F.lit(b.strip("'"))) for a, b in _VARIANTS])).alias("model"))
    return names, price_book.book(spark, snapshot, catalogue, overrides={"grok-4.3": {"input": 9}, "none/own": {"input": 1}})


_IDENT = "replace(replace(lower({}), '.', '-'), '@', '-')"
_PLAIN_KEY = "replace(replace({}, '.', '-'), '@', '-')"


@query("price_layers", f"""WITH {USAGE_SQL}, {_rates_sql()}, m AS (SELECT DISTINCT model AS base FROM u),
p AS (SELECT 0 AS tab, price_model AS name FROM rates UNION ALL SELECT 0, 'snap-' || base FROM m),
c AS (SELECT 1 AS tab, 'cat-' || base AS name, 2 AS rate, true AS exact_only FROM m UNION ALL SELECT 1, x || base, r, false FROM m, (VALUES ('p1/z', 3), ('p22/z', 3), ('p/z', 4)) AS t(x, r)),
n AS (SELECT {" UNION SELECT ".join(f"{a} || base || {b} AS model FROM m" for a, b in _VARIANTS)}),
h AS (
  SELECT model, 0 AS level, tab, name FROM n JOIN p ON model = name UNION ALL SELECT model, 100, tab, name FROM n JOIN c ON model = name
  UNION ALL SELECT model, 101, tab, name FROM n JOIN c ON exact_only AND {_PLAIN_KEY.format("model")} = {_PLAIN_KEY.format("name")}
  UNION ALL SELECT model, 1000, 0, min(name) FROM n JOIN p ON {_IDENT.format("model")} = {_IDENT.format("name")} GROUP BY 1
  UNION ALL SELECT model, 1100, 1, min(name) FROM n JOIN c ON {_IDENT.format("model")} = {_IDENT.format("name")} GROUP BY 1
  UNION ALL SELECT model, 2000, NULL, NULL FROM n WHERE regexp_matches(lower(model), '[-:]free$')
  UNION ALL SELECT model, 3000, 1, 'p1/' || model FROM n WHERE 'p1/' || model IN (SELECT name FROM c))
SELECT model, tab::INTEGER AS tab, name, CASE WHEN level < 1000 THEN 'exact' WHEN level < 2000 THEN 'identity' WHEN level < 3000 THEN 'free' ELSE 'consensus' END AS how
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY level) AS r FROM h) WHERE r = 1""")
def price_layers(spark, sf_dir):
    names, of = _layered(spark, sf_dir)
    return price_book.resolve_names(names, of, fuzzy=False).select("model", "tab", "name", "how")


@query("price_scheduled_override", f"""WITH {USAGE_SQL}, {_schedule_sql()}, t AS (SELECT * REPLACE (ts_ms + 86400000000 AS ts_ms) FROM u WHERE model LIKE 'deepseek%'),
x AS (SELECT *, {_PEAK} AS peak, model = 'deepseek-v4-pro' AS own FROM t JOIN sched ON s_model = model AND ts_ms >= from_ms AND ts_ms < to_ms)
SELECT seq, (input_tokens * (CASE WHEN own THEN 100000000 WHEN peak THEN p1 ELSE o1 END) + output_tokens * (CASE WHEN own THEN 100000000 WHEN peak THEN p2 ELSE o2 END)
  + cache_creation_tokens * (CASE WHEN peak THEN p3 ELSE o3 END) + cache_read_tokens * (CASE WHEN peak THEN p4 ELSE o4 END))::BIGINT AS cost_pico FROM x""")
def price_scheduled_override(spark, sf_dir):
    u = usage_view(spark, sf_dir).where("model like 'deepseek%'").withColumns({"ts_ms": F.col("ts_ms") + 86_400_000_000, "fast": F.lit(False)})
    return reports.price(u, mode="calculate", overrides={"deepseek-v4-pro": {"input": 100, "output": 100}}).select("seq", "cost_pico")


@query("missing_pricing", "SELECT agent, model, count(*) AS n FROM c WHERE missing_pricing GROUP BY 1, 2")
def missing_pricing(spark, sf_dir):
    return priced(spark, sf_dir).where("missing_pricing").groupBy("agent", "model").agg(F.count("*").alias("n"))


@query("cost_modes", "SELECT seq, CASE WHEN k % 2 = 0 THEN k::BIGINT * 1000000000 ELSE cost_pico END AS auto_pico, CASE WHEN k % 2 = 0 THEN k::BIGINT * 1000000000 ELSE 0 END AS display_pico, cost_pico AS calculate_pico FROM c ")
def cost_modes(spark, sf_dir):
    u = usage_view(spark, sf_dir).withColumn("cost_usd", F.when(F.col("k") % 2 == 0, F.col("k") / 1000))
    out = u
    for mode in ("auto", "display", "calculate"):
        out = pricing.with_cost(out, pricing.rate_table(spark), mode=mode).withColumnRenamed("cost_pico", f"{mode}_pico").drop("missing_pricing")
    return out.select("seq", "auto_pico", "display_pico", "calculate_pico")


@query("identity_lookup", f""", x AS (SELECT 1 FROM c LIMIT 1), r AS (SELECT replace(replace(lower(price_model), '.', '-'), '@', '-') AS identity, min(price_model) AS price_model FROM rates GROUP BY 1)
SELECT DISTINCT upper(replace(model, '.', '@')) AS model, r.price_model FROM u LEFT JOIN r ON replace(lower(model), '.', '-') = r.identity""")
def identity_lookup(spark, sf_dir):
    names = usage_view(spark, sf_dir).select(F.upper(F.translate("model", ".", "@")).alias("model"))
    return resolve.resolve(names, pricing.rate_table(spark), fuzzy=False).select("model", "price_model")


@query("fuzzy_lookup")
def fuzzy_lookup(spark, sf_dir):
    names = usage_view(spark, sf_dir).select(F.concat(F.lit("vendor/"), "model", F.lit("-20250101")).alias("model"))
    return resolve.resolve(names, pricing.rate_table(spark))


# Normalisation of counters, names and JSON


@query("token_fallback", "SELECT seq, CASE WHEN out0 = 0 THEN greatest(total - known, 0) ELSE out0 END AS output_tokens, CASE WHEN out0 = 0 THEN 0 ELSE greatest(total - known, 0) END AS extra_tokens FROM (SELECT seq, CASE WHEN k % 3 = 0 THEN 0 ELSE output_tokens END AS out0, k * 150 AS total, input_tokens + cache_read_tokens + cache_creation_tokens + CASE WHEN k % 3 = 0 THEN 0 ELSE output_tokens END AS known FROM u)")
def token_fallback(spark, sf_dir):
    u = usage_view(spark, sf_dir).withColumn("out0", F.when(F.col("k") % 3 == 0, F.lit(0)).otherwise(F.col("output_tokens")))
    out, extra = explained(F.col("k") * 150, F.col("input_tokens"), F.col("out0"), F.col("cache_creation_tokens"), F.col("cache_read_tokens"))
    return u.select("seq", out.alias("output_tokens"), extra.alias("extra_tokens"))


@query("normalise_cached", "SELECT seq, greatest(input_tokens - cache_read_tokens, 0) AS fresh, least(input_tokens, cache_read_tokens) AS cached FROM u")
def normalise_cached(spark, sf_dir):
    return usage_view(spark, sf_dir).select("seq", without_cached(F.col("input_tokens"), F.col("cache_read_tokens")).alias("fresh"), F.least("input_tokens", "cache_read_tokens").alias("cached"))


@query("json_extract_usage", "SELECT k, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens FROM u GROUP BY 1")
def json_extract_usage(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.from_json("props", "k long").alias("p"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("p.k") * 100 + 50).alias("input_tokens"))


@query("map_explode_models", "SELECT agent, kind, sum(n)::BIGINT AS tokens FROM (SELECT agent, 'fresh' AS kind, input_tokens AS n FROM u UNION ALL SELECT agent, 'cached', cache_read_tokens FROM u UNION ALL SELECT agent, 'out', output_tokens FROM u) GROUP BY 1, 2")
def map_explode_models(spark, sf_dir):
    m = F.create_map(F.lit("fresh"), "input_tokens", F.lit("cached"), "cache_read_tokens", F.lit("out"), "output_tokens")
    return usage_view(spark, sf_dir).select("agent", F.explode(m).alias("kind", "n")).groupBy("agent", "kind").agg(F.sum("n").alias("tokens"))


@query("model_names", "SELECT DISTINCT model || '-20250101' AS raw, model AS base, regexp_replace(regexp_replace(model, '^.*/', ''), '^claude-', '') AS short FROM u")
def model_names(spark, sf_dir):
    raw = F.concat("model", F.lit("-20250101"))
    short = F.regexp_replace(F.element_at(F.split("model", "/"), -1), "^claude-", "")
    return usage_view(spark, sf_dir).select(raw.alias("raw"), without_date(raw).alias("base"), short.alias("short")).distinct()


@query("conversations_turn_delta", "SELECT conv_id, turn, length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS delta FROM conversations")
def conversations_turn_delta(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("n", F.length("text").cast("long"))
    return c.select("conv_id", "turn", (F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(0))).alias("delta"))


@query("orders_rollup", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def orders_rollup(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
