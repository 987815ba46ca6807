"""Queries over stories, readiness, enrichment as of an instant and sequences of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news, pit, ranks, stories
from ..streaming import ready
from .derive import MONTHLY_SQL, monthly, table, text_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story of every document, by address, text, or words of the whole text with a shared company or entity."""
    d = table(spark, sf_dir, "documents").withColumns({"text": F.coalesce("text", F.lit("")), "knowable_at": F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(2 * doc_id AS INT), 0)")})
    n = F.col("n_chars")
    none = F.array().cast("array<string>")
    items = d.select(
        F.col("doc_id").alias("item_id"), F.when(n % 5 == 0, F.concat(F.lit("u"), n.cast("string"))).alias("url"), F.md5(F.col("text").cast("binary")).alias("title_hash"), (n % 9 == 0).alias("strict"), news.title_words(F.col("text")).alias("words"),
        F.when(n % 4 == 0, F.array("source")).otherwise(none).alias("companies"), F.when(n % 4 > 1, F.array(F.concat("source", F.lit("e")))).otherwise(none).alias("entities"), F.col("source").alias("category"),
        F.expr("knowable_at - make_dt_interval(0, 0, CAST(n_chars % 200 AS INT), 0)").alias("at"), "knowable_at",
    )
    return stories.assign(items).select("item_id", "story_id", "method", F.round("score", 4).alias("score"))


@query("""WITH r AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS batch, user_id % 8 AS shard, ts FROM events), days AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 555 MINUTE AS ready_at, CAST(floor(epoch(date_trunc('day', ts)) / 3600) AS BIGINT) AS since FROM events),
p AS (SELECT ready_at, since, shard, min(batch) AS b FROM days JOIN r ON ts >= ready_at AND batch BETWEEN since AND since + 23 GROUP BY ALL), l AS (SELECT ready_at, since, max(b) AS b FROM p GROUP BY ALL HAVING count(*) = 8),
w AS (SELECT ready_at, l.b, shard, max(ts) AS m FROM l JOIN r ON batch BETWEEN since AND l.b GROUP BY ALL)
SELECT CAST(ready_at AS VARCHAR) AS ready_at, b + 1 AS batch, CAST(min(m) AS VARCHAR) AS watermark FROM w GROUP BY ALL""")
def shard_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every day of events, dealt to eight shards in hourly batches, the first batch that begins with all shards past a quarter past nine."""
    e = table(spark, sf_dir, "events").select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("batch"), (F.col("user_id") % 8).alias("shard"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    keyed = e.withColumn("ready_at", F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL '555' MINUTE"))
    days = keyed.select("ready_at").distinct()
    shards = days.join(spark.range(8).select(F.col("id").alias("shard")), F.lit(True))  # days times eight
    got = ready.first_ready_each(keyed, shards, ["ready_at"], F.col("ready_at"))
    return got.selectExpr(f"{text_of('ready_at')} AS ready_at", "batch", f"{text_of('watermark')} AS watermark")


_KINDS = ("view", "click", "signup", "error")


def _sql_kind(name: str, rows: str) -> str:
    return f"{name} AS (SELECT l.event_id, arg_max(f.v, (f.at, f.o)) AS {name}_value FROM l JOIN ({rows}) f ON f.key = l.key AND f.at < l.at GROUP BY 1)"


_ENRICHED = {k: f"SELECT user_id AS key, ts AS at, event_id AS o, value AS v FROM events WHERE event_type = '{k}'" for k in _KINDS} | {
    "placed": "SELECT o_custkey AS key, o_orderdate AS at, o_orderkey AS o, o_totalprice AS v FROM orders",
    "shipped": "SELECT l_suppkey AS key, l_shipdate AS at, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS o, l_extendedprice AS v FROM lineitem",
    "returned": "SELECT l_suppkey AS key, l_shipdate AS at, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS o, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'R'",
}


@query(f"WITH l AS (SELECT event_id, user_id AS key, ts AS at FROM events WHERE event_type = 'purchase'), {', '.join(_sql_kind(k, q) for k, q in _ENRICHED.items())} SELECT l.event_id, {', '.join(f'{k}_value' for k in _ENRICHED)} FROM l {' '.join(f'LEFT JOIN {k} USING (event_id)' for k in _ENRICHED)}")
def enriched_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with the latest of seven kinds of facts of its user before it, in one sort."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("at"))
    facts = {k: (e.where(F.col("event_type") == k).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("time"), F.col("event_id").alias("o"), F.col("value").alias("v")), "time", ["o"], ["v"]) for k in _KINDS}
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("v"))
    l = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS key", "CAST(l_shipdate AS TIMESTAMP_NTZ) AS time", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS o", "l_extendedprice AS v", "l_returnflag")  # noqa: E741
    facts |= {k: (df, "time", ["o"], ["v"]) for k, df in (("placed", orders), ("shipped", l), ("returned", l.where("l_returnflag = 'R'")))}
    got = pit.asof_many(left, facts, ["key"], "at")
    return got.select("event_id", *[F.col(f"{k}.v").alias(f"{k}_value") for k in facts])


_UNIT = "CASE WHEN count(*) OVER s < 2 THEN 0 ELSE (rank() OVER (PARTITION BY session ORDER BY {c}) + (count(*) OVER (PARTITION BY session, {c}) - 1) / 2.0 - 1) / (count(*) OVER s - 1) - 0.5 END AS {c}"


@query(f"""WITH {MONTHLY_SQL}, r AS (SELECT session, key, {', '.join(_UNIT.format(c=c) for c in ('turnover', 'score', 'lines'))} FROM monthly WINDOW s AS (PARTITION BY session)),
axis AS (SELECT session, row_number() OVER (ORDER BY session) AS i FROM (SELECT DISTINCT session FROM monthly)), x AS (SELECT r.*, i FROM r JOIN axis USING (session)),
g AS (SELECT a.session, a.key, k, count(b.key) AS here, coalesce(round(any_value(b.turnover), 6), 0) AS t, coalesce(round(any_value(b.score), 6), 0) AS s, coalesce(round(any_value(b.lines), 6), 0) AS l FROM x a CROSS JOIN (SELECT unnest(range(6)) AS k) LEFT JOIN x b ON b.key = a.key AND b.i = a.i - 5 + k GROUP BY 1, 2, 3)
SELECT session, key, sum(here)::BIGINT AS present, round(sum(t * (k + 1)), 6) + 0.0 AS turnover, round(sum(s * (k + 1)), 6) + 0.0 AS score, round(sum(l * (k + 1)), 6) + 0.0 AS lines FROM g GROUP BY 1, 2""")
def rank_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six months of three unit ranks up to every month of every supplier; each place is weighted by its number, so a shifted sequence shows."""
    m = monthly(spark, sf_dir)
    axis = pit.sessions(m.select(F.col("session").alias("day"))).select(F.col("day").alias("session"), "session_idx")
    got = ranks.rank_sequences(m, axis, ["turnover", "score", "lines"], 6)
    weighed = lambda j: F.round(F.aggregate(F.transform("sequence", lambda x, i: F.round(x[j], 6) * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6) + F.lit(0.0)  # noqa: E731  no negative zero
    return got.select("session", "key", "present", *[weighed(j).alias(c) for j, c in enumerate(("turnover", "score", "lines"))])
