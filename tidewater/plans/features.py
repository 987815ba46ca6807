"""Queries over the remaining features and over the snapshot as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import fundamentals as fund
from ..operators import newsrules, snapshots
from ..operators import snapshot as S
from ..operators import statements as ST
from .derive import bars, bars_sql, known_bars, table
from .desk import _NEWS, _news
from .market import _FEATURE_SQL, AS_OF, _instant, _text
from .newsdesk import HEADLINES, _headlines, _values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pairs(df: DataFrame, names: list[str], digits: int = 6) -> list:
    return [c for n in names for c in (F.round(F.col(f"{n}.value"), digits).alias(n), F.col(f"{n}.reason").alias(f"{n}_reason"))]


_SHORT = "CASE WHEN n < {n} THEN 'INSUFFICIENT_HISTORY' WHEN {bad} THEN 'DIVISION_UNDEFINED' END AS {name}_reason"
_VALUE = "round(CASE WHEN n >= {n} AND NOT ({bad}) THEN CAST(format('{{:.11e}}', {v}) AS DOUBLE) END, 8) AS {name}, " + _SHORT
_MORE = ", ".join(
    _VALUE.format(n=n, bad=bad, v=v, name=name)
    for name, n, bad, v in [
        ("ret_1d", 2, "coalesce(c1 <= 0, false)", "close / c1 - 1"), ("ret_5d", 6, "coalesce(c5 <= 0, false)", "close / c5 - 1"), ("sma_50", 50, "false", "m50"), ("sma_200", 200, "false", "m200"), ("close_to_sma_50", 50, "m50 <= 0", "close / m50 - 1"),
        ("close_to_sma_200", 200, "m200 <= 0", "close / m200 - 1"), ("dist_high_252", 252, "h252 <= 0", "close / h252 - 1"), ("dist_low_252", 252, "l252 <= 0", "close / l252 - 1"),
        ("index_ret_1d", 2, "coalesce(c1 <= 0, false)", "close / c1 - 1"), ("index_ret_5d", 6, "coalesce(c5 <= 0, false)", "close / c5 - 1"), ("index_close_to_sma_50", 50, "m50 <= 0", "close / m50 - 1"),
    ]
)


@query(_FEATURE_SQL + f""", g AS (SELECT *, lag(close) OVER w AS c1, max(high) OVER y AS h252, min(low) OVER y AS l252 FROM f WINDOW w AS (PARTITION BY key ORDER BY bucket), y AS (PARTITION BY key ORDER BY bucket ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT key, CAST(bucket AS VARCHAR) AS bucket, {_MORE} FROM g""")
def bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["ret_1d", "ret_5d", "sma_50", "sma_200", "close_to_sma_50", "close_to_sma_200", "dist_high_252", "dist_low_252", "index_ret_1d", "index_ret_5d", "index_close_to_sma_50"]
    got = B.features(bars(spark, sf_dir), names)
    return got.select("key", *_text("bucket"), *_pairs(got, names, 8))


#: Vendor ratio, its value and its sector's by part number, as text.
RATIOS = ("P/E", "P/B", "ROE", "ROCE", "EV/EBITDA")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 13 AS r, p_retailprice AS v FROM part)
SELECT p_partkey, CASE WHEN r NOT IN (0, 1) THEN round(v, 2) END AS pb, CASE WHEN r = 0 THEN 'MALFORMED_INPUT' WHEN r = 1 THEN 'MISSING_INPUT' END AS pb_reason, CASE WHEN r NOT IN (0, 1) THEN round(v + 1, 2) END AS roe_pct, CASE WHEN r NOT IN (0, 1) THEN round(v + 2, 2) END AS roce_pct,
 CASE WHEN r NOT IN (0, 1) THEN round(v + 3, 2) END AS ev_ebitda, round(CASE WHEN r > 3 THEN round(v * 2, 2) / round(v + 100, 2) END, 6) AS pe_to_sector, CASE WHEN r = 0 THEN 'MALFORMED_INPUT' WHEN r IN (1, 2) THEN 'MISSING_INPUT' WHEN r = 3 THEN 'DIVISION_UNDEFINED' END AS pe_to_sector_reason,
 round(CASE WHEN r > 3 THEN round(v, 2) / round(v + 100, 2) END, 6) AS pb_to_sector FROM p""")
def vendor_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, r = F.col("p_retailprice"), F.col("p_partkey") % 13
    own = {"P/E": v * 2, "P/B": v, "ROE": v + 1, "ROCE": v + 2, "EV/EBITDA": v + 3}
    text = lambda c, end="": F.concat(F.round(c, 2).cast("decimal(18,2)").cast("string"), F.lit(end))
    sector = F.when(r == 2, F.lit("n/a")).when(r == 3, F.lit("0")).otherwise(text(v + 100))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.when(r == 1, "-").otherwise(text(c, "%" if n.startswith("RO") else "")).alias("company"), sector.alias("sector")) for n, c in own.items()])
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").repartition("p_partkey")  # a small file's rows are much work
    df = part.select("p_partkey", F.when(r == 0, F.lit('{"name"')).otherwise(F.to_json(rows)).alias("payload"))
    out = {"pe": "P/E", "pb": "P/B", "roe_pct": "ROE", "roce_pct": "ROCE", "ev_ebitda": "EV/EBITDA"}
    for c, n in out.items():
        df = fund.vendor_ratio(df, "payload", n).withColumnsRenamed({"ratio": c, "to_sector": f"{c}_to_sector"})
    return df.select("p_partkey", *_pairs(df, ["pb"]), *[F.col(f"{n}.value").alias(n) for n in ("roe_pct", "roce_pct", "ev_ebitda")], *_pairs(df, ["pe_to_sector"]), F.round("pb_to_sector.value", 6).alias("pb_to_sector"))


def _statements(spark, sf_dir, unit: str, label: str):
    """A JSON statement per customer: what its orders make in a period, their count as profit less two, profit per share."""
    period = F.date_trunc(unit, "o_orderdate").cast("date")
    month = F.add_months(period, 2)
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.date_format(month, "MMM yyyy").alias("period"), period.alias("at")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("rev"), F.count("*").alias("n"))
    value = {"Revenue": F.col("rev").cast("string"), "Profit After Tax": (F.col("n") - 1).cast("string"), "EPS - Basic": F.concat(((F.col("n") * 2).cast("string")), F.lit(".5"))}
    hist = F.array_sort(F.collect_list(F.struct("at", "period", *[v.alias(f"v{i}") for i, v in enumerate(value.values())])))
    point = lambda i: lambda x: F.struct(x["period"].alias("period"), x[f"v{i}"].alias("value"))
    lines = F.array(*[F.struct(F.lit(n).alias("particular"), F.transform("h", point(i)).alias("history")) for i, n in enumerate(value)])
    got = o.groupBy("key").agg(hist.alias("h")).select("key", F.when(F.col("key") % 29 == 0, F.lit('{"full_statement": 3}')).when(F.col("key") % 31 == 0, F.lit(None)).otherwise(F.to_json(F.struct(lines.alias("full_statement")))).alias("payload"))
    return got.toDF("key", label)


_PERIODS = """q AS (SELECT o_custkey AS key, date_trunc('{u}', o_orderdate)::DATE AS p, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS rev, count(*) - 1.0 AS pat, count(*) * 2 + 0.5 AS eps FROM orders GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p DESC) AS r, count(*) OVER (PARTITION BY key) AS c, min(gap) OVER (PARTITION BY key) AS least FROM (SELECT *, date_diff('month', lag(p) OVER (PARTITION BY key ORDER BY p), p) AS gap FROM q)),
l AS (SELECT a.key, a.c, a.least, a.rev, a.pat, a.eps, b.rev AS rb, b.pat AS pb, b.eps AS eb, b.key IS NULL AS short FROM g a LEFT JOIN g b ON b.key = a.key AND {on} WHERE a.r = 1)"""


def _growth_sql(v: str, base: str, name: str, annual: str) -> str:
    bad = f"key % 29 <> 0 AND key % 31 <> 0 AND NOT ({annual}) AND NOT short"
    return f"round(CASE WHEN {bad} AND {base} > 0 THEN {v} / {base} - 1 END, 6) AS {name}, CASE WHEN key % 29 = 0 THEN 'MALFORMED_INPUT' WHEN key % 31 = 0 THEN 'MISSING_INPUT' WHEN {annual} THEN 'MALFORMED_INPUT' WHEN short THEN 'INSUFFICIENT_HISTORY' WHEN {base} <= 0 THEN 'DIVISION_UNDEFINED' END AS {name}_reason"


@query("WITH " + _PERIODS.format(u="year", on="b.r = 2") + " SELECT key, " + ", ".join(_growth_sql(*x, "false") for x in [("rev", "rb", "revenue_yoy"), ("pat", "pb", "pat_yoy"), ("eps", "eb", "eps_yoy")]) + " FROM l")
def statement_growth_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statements(spark, sf_dir, "year", "payload")
    lines = {"revenue_yoy": "Revenue", "pat_yoy": "Profit After Tax", "eps_yoy": "EPS - Basic"}
    s = s.withColumns({f"_{n}": ST.statement_line(F.col("payload"), p) for n, p in lines.items()})
    s = s.withColumns({n: ST.growth(F.col(f"_{n}"), F.col("payload")) for n in lines})
    return s.select("key", *_pairs(s, list(lines)))


@query("WITH " + _PERIODS.format(u="quarter", on="b.p = a.p - INTERVAL 12 MONTH") + " SELECT key, " + ", ".join(_growth_sql(*x, "coalesce(c >= 2 AND least >= 12, false)") for x in [("rev", "rb", "revenue_yoy_q"), ("pat", "pb", "pat_yoy_q")]) + " FROM l")
def statement_growth_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statements(spark, sf_dir, "quarter", "payload")
    lines = {"revenue_yoy_q": "Revenue", "pat_yoy_q": "Profit After Tax"}
    s = s.withColumns({f"_{n}": ST.statement_line(F.col("payload"), p) for n, p in lines.items()})
    s = s.withColumns({n: ST.growth(F.col(f"_{n}"), F.col("payload"), quarterly=True) for n in lines})
    return s.select("key", *_pairs(s, list(lines)))


@query("""SELECT s_suppkey AS key, round(CASE WHEN s_suppkey % 5 NOT IN (0, 1, 2, 3) THEN (100.5 + s_suppkey + 50) / (1000 + s_suppkey) END, 6) AS liabilities_to_assets,
 CASE s_suppkey % 5 WHEN 0 THEN 'MISSING_INPUT' WHEN 1 THEN 'MALFORMED_INPUT' WHEN 2 THEN 'MISSING_INPUT' WHEN 3 THEN 'DIVISION_UNDEFINED' END AS liabilities_to_assets_reason FROM supplier""")
def leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("s_suppkey"), lambda n, *points: F.concat(F.lit(f'{{"particular": "{n}", "history": ['), F.concat_ws(",", *[F.concat(F.lit(f'{{"period": "{p}", "value": "'), v, F.lit('"}')) for p, v in points]), F.lit("]}"))
    old, new = "Mar 2024", "Mar 2025"
    total = line("Total Assets", (old, F.lit("7")), (new, F.when(k % 5 == 3, "0").otherwise((k + 1000).cast("string"))))
    now = line("Current Liabilities", (new, F.concat((k + 100).cast("string"), F.lit(".5"))))
    later = F.when(k % 5 == 2, line("Non-Current Liabilities", (old, F.lit("50")))).otherwise(line("Non-Current Liabilities", (new, F.lit("50")), (old, F.lit("9"))))
    payload = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit('{"full_statement": "x"}')).otherwise(F.concat(F.lit('{"full_statement": ['), F.concat_ws(",", total, now, later), F.lit("]}")))
    s = table(spark, sf_dir, "supplier").select(k.alias("key"), payload.alias("p")).withColumn("liabilities_to_assets", ST.liabilities_to_assets(F.col("p")))
    return s.select("key", *_pairs(s, ["liabilities_to_assets"]))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) - sum(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS net FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1 HAVING count(DISTINCT o_orderkey % 2) = 2), r AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS r FROM d),
w AS (SELECT 'FII' AS who UNION ALL SELECT 'DII'), n AS (SELECT unnest([1, 5]) AS n) SELECT who, CAST(n AS INTEGER) AS n, CASE WHEN who = 'FII' THEN round((SELECT sum(net) FROM r WHERE r.r <= n.n), 2) END AS net, CASE WHEN who = 'DII' THEN 'MALFORMED_INPUT' END AS reason FROM w, n""")
def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderdate < '1998-01-01'").select(F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 2).alias("side"), "o_totalprice")
    days = o.groupBy("day", "side").agg(F.sum("o_totalprice").alias("value"))
    both = days.join(days.groupBy("day").agg(F.count("*").alias("c")).where("c = 2").select("day"), "day", "left_semi")
    code = lambda who: F.concat(F.lit(f"{who}|NSE_EQ|CASH|1D|"), F.when(F.col("side") == 0, "buy_amt").otherwise("sell_amt"))
    # the second group lacks one side on a day
    series = both.select(code("FII").alias("series_code"), "day", "value").union(both.where("NOT (side = 1 AND day = '1995-06-01')").select(code("DII"), "day", "value")).union(spark.sql("SELECT 'DII|NSE_EQ|CASH|1D|buy_amt', DATE'1991-01-01', 1.0D"))
    previous = both.agg(F.max("day").alias("d")).first().d
    parts = [ST.flow_feature(ST.net_flows(series, who), n, F.lit(previous)).select(F.lit(who).alias("who"), F.lit(n).alias("n"), F.round("flow.value", 2).alias("net"), F.col("flow.reason").alias("reason")) for who in ("FII", "DII") for n in (1, 5)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""WITH q AS (SELECT o_custkey AS key, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE AS p, count(*) - 1.0 AS profit FROM orders GROUP BY 1, 2), qr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p DESC) AS r, max(p) OVER (PARTITION BY key) AS lp FROM q),
t AS (SELECT key, CASE WHEN count(*) FILTER (WHERE p = last_day(lp - to_months(CAST(3 * (r - 1) AS INTEGER)))::DATE) = 4 THEN sum(profit) END AS ttm FROM qr WHERE r <= 4 GROUP BY 1), y AS (SELECT o_custkey AS key, year(o_orderdate) AS p, count(*) - 2.0 AS profit, (count(*) - 3.0) / 4 AS eps, CASE WHEN count(*) > 2 THEN count(*) - 3.0 END AS book FROM orders GROUP BY 1, 2),
s0 AS (SELECT key, arg_max(profit * 1e7 / eps, p) AS shares, make_date(max(p), 3, 31) AS fy FROM y WHERE profit * eps > 0 GROUP BY 1), act AS (SELECT o_custkey AS key, max(CAST(o_orderdate AS DATE)) AS ex FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate <= TIMESTAMP '2001-11-01' GROUP BY 1),
s AS (SELECT s0.key, CASE WHEN ex IS NULL OR ex <= fy THEN shares END AS shares FROM s0 LEFT JOIN act ON act.key = s0.key), b AS (SELECT key, arg_max(book, p) AS book FROM y WHERE book IS NOT NULL GROUP BY 1), st AS (SELECT a.key, a.profit AS q, b.profit AS base FROM qr a LEFT JOIN q b ON b.key = a.key AND last_day(b.p + INTERVAL 12 MONTH)::DATE = a.p WHERE a.r = 1),
x AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS price, ttm, shares, book, q, base, ttm * 1e7 / shares AS eps FROM customer LEFT JOIN t ON t.key = c_custkey LEFT JOIN s ON s.key = c_custkey LEFT JOIN b ON b.key = c_custkey LEFT JOIN st ON st.key = c_custkey),
z AS (SELECT *, CASE WHEN shares IS NULL THEN 'MISSING_INPUT' WHEN ttm IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN price IS NULL THEN 'MISSING_INPUT' END AS w, CASE WHEN q IS NULL THEN 'MISSING_INPUT' WHEN base IS NULL THEN 'INSUFFICIENT_HISTORY' END AS u FROM x)
SELECT key, round(CASE WHEN w IS NULL AND eps > 0 THEN price / eps END, 6) AS pe_ttm, coalesce(w, CASE WHEN eps <= 0 THEN 'DIVISION_UNDEFINED' END) AS pe_ttm_reason, round(CASE WHEN w IS NULL AND price > 0 THEN eps / price END, 6) AS earnings_yield_ttm, coalesce(w, CASE WHEN price <= 0 THEN 'DIVISION_UNDEFINED' END) AS earnings_yield_ttm_reason,
 round(CASE WHEN shares IS NOT NULL AND price IS NOT NULL AND book > 0 THEN price * shares / (book * 1e7) END, 6) AS pb_own, CASE WHEN shares IS NULL OR price IS NULL OR book IS NULL THEN 'MISSING_INPUT' WHEN book <= 0 THEN 'DIVISION_UNDEFINED' END AS pb_own_reason,
 round(CASE WHEN u IS NULL AND base <> 0 THEN (q - base) / abs(base) END, 6) AS eps_surprise_srw, coalesce(u, CASE WHEN base = 0 THEN 'DIVISION_UNDEFINED' END) AS eps_surprise_srw_reason,
 round(CASE WHEN u IS NULL AND shares IS NOT NULL AND price > 0 THEN (q - base) * 1e7 / shares / price END, 6) AS eps_surprise_srw_price, coalesce(u, CASE WHEN shares IS NULL OR price IS NULL THEN 'MISSING_INPUT' WHEN price <= 0 THEN 'DIVISION_UNDEFINED' END) AS eps_surprise_srw_price_reason FROM z""")
def own_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = table(spark, sf_dir, "orders"), F.count("*")
    quarters = o.groupBy(F.col("o_custkey").alias("key"), F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2)).alias("period")).agg((n - 1.0).alias("profit"))
    years = o.groupBy(F.col("o_custkey").alias("key"), F.make_date(F.year("o_orderdate"), F.lit(3), F.lit(31)).alias("period")).agg((n - 2.0).alias("profit"), ((n - 3.0) / 4).alias("eps"), F.when(n > 2, n - 3.0).alias("book"))
    prices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("price"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "SPLIT").when(F.col("o_orderpriority") == "2-HIGH", "BONUS").otherwise("DIVIDEND")
    actions = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"), kind.alias("kind"), F.to_date("o_orderdate").alias("ex_date"))
    got = ST.own_ratios(quarters, years, prices, actions, F.lit("2001-11-01").cast("date"))
    return got.select("key", *_pairs(got, got.columns[1:]))


_LABELLED = f"e AS (SELECT o_orderkey AS id, o_custkey AS key, CAST(o_orderdate AS TIMESTAMP) AS ts, action, verdict FROM orders JOIN {_values([(h[2], h[3]) for h in HEADLINES], 'action, verdict')} ON no = o_orderkey % {len(HEADLINES)})"
_THEN = "TIMESTAMP '1997-06-01'"


@query(f"""WITH {_LABELLED}, v AS (SELECT key, arg_max(verdict, (ts, id)) AS v FROM e WHERE verdict IS NOT NULL AND ts < {_THEN} AND ts >= {_THEN} - INTERVAL 90 DAY GROUP BY 1), a AS (SELECT key, count(*) FILTER (WHERE action = 'UP') AS u, count(*) FILTER (WHERE action = 'DOWN') AS d FROM e WHERE ts < {_THEN} AND ts >= {_THEN} - INTERVAL 30 DAY GROUP BY 1)
SELECT c_custkey AS key, CASE v WHEN 'BEAT' THEN 1.0 WHEN 'MISS' THEN -1.0 WHEN 'INLINE' THEN 0.0 WHEN 'MIXED' THEN 0.0 END::DOUBLE AS street_verdict_90d, CASE WHEN v IS NULL THEN 'NOT_APPLICABLE' END AS street_verdict_90d_reason, coalesce(u, 0)::DOUBLE AS analyst_upgrades_30d, coalesce(d, 0)::DOUBLE AS analyst_downgrades_30d
FROM customer LEFT JOIN v ON v.key = c_custkey LEFT JOIN a ON a.key = c_custkey""")
def street_and_analysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _headlines(spark, sf_dir).withColumnRenamed("o_custkey", "key")
    keys, then = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), F.lit("1997-06-01").cast("timestamp_ntz")
    events = h.select("key", newsrules.street_verdict(F.col("title")).alias("verdict"), F.col("at").alias("known_at"), F.col("item_id").alias("event_id"))
    actions = h.select("item_id", "key", newsrules.analyst_action(F.col("title")).alias("action"), F.col("at").alias("knowable_at"))
    both = ST.street_verdicts(events, keys, then, F.lit(True)).join(snapshots.analyst_counts(actions, keys, then, F.lit(True)), "key")
    return both.select("key", *_pairs(both, ["street_verdict_90d"]), F.col("analyst_upgrades_30d.value").alias("analyst_upgrades_30d"), F.col("analyst_downgrades_30d.value").alias("analyst_downgrades_30d"))


@query(f"""WITH l AS (SELECT o_custkey AS key, (epoch_us({_THEN}) - epoch_us(CAST(o_orderdate AS TIMESTAMP))) / 3.6e9 AS a FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 30 AS INTEGER)) < {_THEN}), g AS (SELECT key, count(*) FILTER (WHERE a <= 24) AS d, count(*) FILTER (WHERE a <= 168) AS w, min(a) AS m FROM l GROUP BY 1)
SELECT c_custkey AS key, coalesce(d, 0)::DOUBLE AS news_count_24h, coalesce(w, 0)::DOUBLE AS news_count_7d, round(m, 6) AS news_hours_since_last, CASE WHEN m IS NULL THEN 'NOT_APPLICABLE' END AS news_hours_since_last_reason FROM customer LEFT JOIN g ON g.key = c_custkey""")
def linked_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").selectExpr("o_custkey AS key", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS published_at", "CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(o_orderkey % 30 AS INT), 0, 0) AS knowable_at")
    got = ST.linked_news(links, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), F.lit("1997-06-01").cast("timestamp_ntz"))
    return got.select("key", F.col("news_count_24h.value").alias("news_count_24h"), F.col("news_count_7d.value").alias("news_count_7d"), *_pairs(got, ["news_hours_since_last"]))


_REST = {
    "news_count_1h": "age <= 1", "news_count_4h": "age <= 4", "news_count_3d": "age <= 72", "breaking_news_count_24h": "age <= 24 AND b", "negative_news_count_24h": "age <= 24 AND direction = 'NEGATIVE'", "positive_news_count_24h": "age <= 24 AND direction = 'POSITIVE'",
    "mixed_news_count_24h": "age <= 24 AND direction = 'MIXED'", "macro_scope_news_count_24h": "age <= 24 AND scope = 'MACRO'", "geopolitical_news_count_24h": "age <= 24 AND scope = 'GEOPOLITICAL'", "commodity_news_count_24h": "age <= 24 AND scope = 'COMMODITY'",
    "global_market_news_count_24h": "age <= 24 AND scope = 'GLOBAL_MARKET'",
}


@query(_NEWS + " SELECT kind AS source_kind, " + ", ".join(f"count(*) FILTER (WHERE {c})::DOUBLE AS {n}" for n, c in _REST.items()) + """, count(DISTINCT publisher) FILTER (WHERE age <= 24)::DOUBLE AS unique_publishers_24h, round(count(*) FILTER (WHERE age <= 1) / nullif(count(*) FILTER (WHERE age > 1 AND age <= 24) / 23.0, 0), 6) AS news_velocity_1h,
 round(count(DISTINCT publisher) FILTER (WHERE age <= 24) / nullif(count(*) FILTER (WHERE age <= 24), 0), 6) AS publisher_diversity_24h, (count(DISTINCT story_id) FILTER (WHERE age <= 24) - count(DISTINCT story_id) FILTER (WHERE age <= 24 AND founder))::DOUBLE AS updated_story_count_24h, round(min(age) * 3600, 1) AS time_since_last_news_s FROM n GROUP BY 1""")
def market_news_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = snapshots.market_news(_news(spark, sf_dir), _instant(), F.lit(True), ["source_kind"])
    names = [*_REST, "unique_publishers_24h", "news_velocity_1h", "publisher_diversity_24h", "updated_story_count_24h"]
    return got.select("source_kind", *[F.round(F.col(f"{n}.value"), 6).alias(n) for n in names], F.round("time_since_last_news_s.value", 1).alias("time_since_last_news_s"))


@query(_NEWS + """, k AS (SELECT c_custkey AS key FROM customer), l AS (SELECT o.o_custkey AS key, a.* FROM a JOIN orders o ON o.o_orderkey = a.item_id), g AS (SELECT key, count(*) FILTER (WHERE age0 <= 1) AS n1, count(*) FILTER (WHERE age0 <= 4) AS n4, min(age0) AS m,
 avg(CASE direction WHEN 'POSITIVE' THEN 1.0 WHEN 'NEGATIVE' THEN -1.0 ELSE 0.0 END) FILTER (WHERE age0 <= 24) AS s FROM l GROUP BY 1)
SELECT k.key, coalesce(n1, 0)::DOUBLE AS company_count_1h, coalesce(n4, 0)::DOUBLE AS company_count_4h, round(m * 3600, 1) AS company_time_since_last_s, round(s, 6) AS company_sentiment_24h, CASE WHEN s IS NULL THEN 'NOT_APPLICABLE' END AS company_sentiment_24h_reason FROM k LEFT JOIN g ON g.key = k.key""")
def company_news_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _news(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("key")), "item_id")
    got = snapshots.company_news(links, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), _instant(), F.lit(True))
    return got.select("key", F.col("company_count_1h.value").alias("company_count_1h"), F.col("company_count_4h.value").alias("company_count_4h"), F.round("company_time_since_last_s.value", 1).alias("company_time_since_last_s"), *_pairs(got, ["company_sentiment_24h"]))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 8 AS r, p_size FROM part) SELECT p_partkey, array_to_string(list_filter([CASE WHEN r = 1 THEN 'SECTOR_PE_IMPLAUSIBLE' END, CASE WHEN r = 2 THEN 'NEGATIVE_EARNINGS' END, CASE WHEN r = 3 THEN 'PE_TWICE_SECTOR' END, CASE WHEN p_size < 5 THEN 'LOW_ROE' END, CASE WHEN r = 4 THEN 'HIGH_LIABILITIES' END,
 CASE WHEN r = 5 THEN 'YEARLY_PROFIT_DOWN' END, CASE WHEN r = 5 THEN 'QUARTERLY_PROFIT_DOWN' END, CASE WHEN r < 4 THEN 'EPS_BELOW_YEAR_AGO' END, CASE WHEN r = 6 THEN 'PROMOTERS_DOWN' END, CASE WHEN r = 7 THEN 'PLEDGED' END], lambda x: x IS NOT NULL), ',') AS red,
 array_to_string(list_filter([CASE WHEN r = 4 THEN 'PE_BELOW_SECTOR' END, CASE WHEN p_size >= 15 THEN 'HIGH_ROE' END, CASE WHEN r = 6 THEN 'YEARLY_PROFIT_UP' END, CASE WHEN r >= 4 THEN 'EPS_ABOVE_YEAR_AGO' END, CASE WHEN r = 0 THEN 'PROMOTERS_UP' END], lambda x: x IS NOT NULL), ',') AS green FROM x""")
def forensic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("p_partkey") % 8
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(r == 2, -3.0).when(r == 3, 50.0).when(r == 4, 5.0).otherwise(20.0).alias("pe"), F.when(r == 1, 400.0).otherwise(20.0).alias("pe_sector"), F.col("p_size").cast("double").alias("roe"), F.when(r == 4, 0.9).otherwise(0.5).alias("liabilities_to_assets"),
        F.when(r == 5, -0.4).when(r == 6, 0.5).alias("pat_yoy"), F.when(r == 5, -0.3).alias("pat_yoy_q"), (r.cast("double") - 3).alias("eps_surprise"), F.when(r == 6, -2.5).when(r == 0, 3.0).alias("promoter_change"), F.when(r == 7, 12.0).otherwise(1.0).alias("pledged"),
    )
    return ST.forensic(p).select("p_partkey", F.array_join("red", ",").alias("red"), F.array_join("green", ",").alias("green"))


_SNAP = _FEATURE_SQL.replace(bars_sql(), bars_sql(name="every") + f""", bars AS (SELECT key, bucket, open, high, low, close, volume FROM every WHERE bucket + to_hours(CAST(1 + volume % 4 AS INTEGER)) < TIMESTAMP '{AS_OF}' AND bucket >= TIMESTAMP '{AS_OF}' - INTERVAL 450 DAY)""")
_KINDS = [("ret_20d", "n > 20", "close / c20 - 1"), ("sma_50", "n >= 50", "m50"), ("breakout_20", "n > 20", "(close > ph)::INTEGER::DOUBLE"), ("turnover_20", "n >= 20", "t20"), ("ret_5d", "n > 5", "close / c5 - 1")]


@query(_SNAP + f""", l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bucket DESC) AS r, (SELECT max(bucket) FROM bars) AS ps FROM f), x AS (SELECT * FROM l WHERE r = 1)
SELECT 'INSTRUMENT' AS scope, key, feature_id, CASE WHEN bucket = ps THEN v END AS value, CASE WHEN bucket <> ps THEN 'MISSING_INPUT' WHEN v IS NULL AND feature_id = 'sector_rs_20' THEN 'MISSING_INPUT' WHEN v IS NULL THEN 'INSUFFICIENT_HISTORY' END AS reason, bars FROM (
{' UNION ALL '.join(f"SELECT key, bucket, ps, '{n}' AS feature_id, round(CASE WHEN {c} THEN {v} END, 6) AS v, n AS bars FROM x" for n, c, v in _KINDS)}
UNION ALL SELECT k.key, x.bucket, x.ps, 'sector_rs_20', round(CASE WHEN x.bucket = x.ps AND count(o.key) >= 3 THEN (x.close / x.c20 - 1) - median(o.close / o.c20 - 1) END, 6), x.n FROM x JOIN x k ON k.key = x.key LEFT JOIN x o ON o.key <> x.key AND o.bucket = o.ps GROUP BY k.key, x.bucket, x.ps, x.close, x.c20, x.n)""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = known_bars(spark, sf_dir)
    seen = S.visible_bars(b, _instant())
    previous = seen.agg(F.max("bucket")).first()[0]
    sectors = b.select("key").distinct().withColumn("sector", F.lit("all"))
    rows = S.snapshot([S.bar_rows(b, b.where("key = 'view'"), _instant(), F.lit(previous), sectors)], _instant())
    counted = seen.groupBy("key").agg(F.count("*").alias("bars"))
    wanted = [n for n, *_ in _KINDS] + ["sector_rs_20"]
    got = rows.where(F.col("feature_id").isin(*wanted)).join(counted, "key")
    return got.select("scope", "key", "feature_id", F.round("value", 6).alias("value"), "reason", "bars")


@query(f"""WITH {bars_sql()}, s AS (SELECT key, close, row_number() OVER (PARTITION BY key ORDER BY bucket) AS n, lag(close) OVER w AS c1, lag(close, 5) OVER w AS c5, avg(close) OVER (PARTITION BY key ORDER BY bucket ROWS 49 PRECEDING) AS m50, bucket FROM bars WHERE bucket + to_hours(CAST(1 + volume % 4 AS INTEGER)) < TIMESTAMP '{AS_OF}' WINDOW w AS (PARTITION BY key ORDER BY bucket)),
i AS (SELECT * FROM s WHERE key = 'view' ORDER BY bucket DESC LIMIT 1), v AS (SELECT * FROM s WHERE key = 'click' ORDER BY bucket DESC LIMIT 1)
SELECT 'index_ret_1d' AS feature_id, round(CASE WHEN n > 1 THEN close / c1 - 1 END, 6) AS value FROM i UNION ALL SELECT 'index_ret_5d', round(CASE WHEN n > 5 THEN close / c5 - 1 END, 6) FROM i UNION ALL SELECT 'index_close_to_sma_50', round(CASE WHEN n >= 50 THEN close / m50 - 1 END, 6) FROM i
UNION ALL SELECT 'india_vix_level', CASE WHEN v.bucket = i.bucket THEN round(v.close, 6) END FROM v, i UNION ALL SELECT 'india_vix_change_5d', CASE WHEN v.bucket = i.bucket AND v.n > 5 THEN round(v.close - v.c5, 6) END FROM v, i""")
def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = known_bars(spark, sf_dir)
    previous = S.visible_bars(b.where("key = 'view'"), _instant()).agg(F.max("bucket")).first()[0]
    rows = S.snapshot([S.context_rows(b.where("key = 'view'"), b.where("key = 'click'"), _instant(), F.lit(previous))], _instant())
    names = ["index_ret_1d", "index_ret_5d", "index_close_to_sma_50", "india_vix_level", "india_vix_change_5d"]
    return rows.where(F.col("feature_id").isin(*names)).select("feature_id", F.round("value", 6).alias("value"))
