"""Queries over replay at many instants, as-if-live knowability and the price basis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basis as BA
from ..operators import pit
from ..operators import replay as R
from ..operators.alike import stored
from .derive import DESK_SQL, INDEX_SQL, MONTHS_SQL, desk_bars, desk_index, months, table, text_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MONTH = 31 * 86_400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {MONTHS_SQL}, o AS (SELECT o_custkey, o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 400 AS INTEGER)) AS knowable_at, o_totalprice FROM orders),
r AS (SELECT i.as_of, o.*, row_number() OVER (PARTITION BY i.as_of, o_custkey ORDER BY knowable_at DESC, o_orderkey DESC) AS n FROM instants i JOIN o ON o.knowable_at < i.as_of)
SELECT CAST(as_of AS VARCHAR) AS as_of, o_custkey, o_orderkey, o_totalprice FROM r WHERE n = 1""")
def replay_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order as every month's start saw it."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(o_orderkey % 400 AS INT), 0, 0)").alias("knowable_at"))
    got = R.versions(o, months(spark, sf_dir), ["o_custkey"], ["o_orderkey"], MONTH)
    return got.selectExpr(f"{text_of('as_of')} AS as_of", "o_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH {DESK_SQL}, {MONTHS_SQL}
SELECT CAST(as_of AS VARCHAR) AS as_of, key, CAST(max(bucket) AS VARCHAR) AS last_bucket, max(bucket) <> previous_session AS stale
FROM instants JOIN desk ON knowable_at < as_of AND as_of <= bucket + INTERVAL 30 DAY GROUP BY instants.as_of, previous_session, key""")
def replay_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that every month's start could trade, and which of them were stale."""
    got = R.universe(desk_bars(spark, sf_dir), months(spark, sf_dir), slot_seconds=MONTH)
    return got.selectExpr(f"{text_of('as_of')} AS as_of", "key", f"{text_of('last_bucket')} AS last_bucket", "stale")


_REPLAYED = [
    ("ret_1d", "n > 1", "close / c1 - 1"), ("ret_5d", "n > 5", "close / c5 - 1"), ("ret_20d", "n > 20", "close / c20 - 1"), ("sma_20", "n >= 20", "m20"), ("dist_high_20", "n >= 20", "close / h20 - 1"),
    ("breakout_20", "n > 20", "(close > ph)::INTEGER::DOUBLE"), ("avg_volume_20", "n >= 20", "v20"), ("turnover_20", "n >= 20", "t20"),
]
_RANGE = "knowable_at < as_of AND as_of <= bucket + INTERVAL 450 DAY"


@query(f"""WITH {DESK_SQL}, {INDEX_SQL}, {MONTHS_SQL},
seen AS (SELECT as_of, previous_session, d.* FROM instants JOIN desk d ON {_RANGE}),
f AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS c1, lag(close, 5) OVER w AS c5, lag(close, 20) OVER w AS c20, avg(close) OVER v AS m20, max(high) OVER v AS h20, max(high) OVER (PARTITION BY as_of, key ORDER BY bucket ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph,
  avg(volume) OVER v AS v20, avg(close * volume) OVER v AS t20, row_number() OVER (PARTITION BY as_of, key ORDER BY bucket DESC) AS r FROM seen WINDOW w AS (PARTITION BY as_of, key ORDER BY bucket), v AS (PARTITION BY as_of, key ORDER BY bucket ROWS 19 PRECEDING)),
x AS (SELECT f.*, s_nationkey AS sector FROM f JOIN supplier ON s_suppkey = key WHERE r = 1),
steps AS (SELECT as_of, key, bucket, close / p - 1 AS r FROM (SELECT *, lag(close) OVER (PARTITION BY as_of, key ORDER BY bucket) AS p FROM seen) WHERE p > 0),
isteps AS (SELECT as_of, bucket, close / p - 1 AS x FROM (SELECT as_of, i.*, lag(close) OVER (PARTITION BY as_of ORDER BY bucket) AS p FROM instants JOIN desk_index i ON {_RANGE}) WHERE p > 0),
paired AS (SELECT as_of, key, r, x, row_number() OVER (PARTITION BY as_of, key ORDER BY bucket DESC) AS n FROM steps JOIN isteps USING (as_of, bucket)),
beta AS (SELECT as_of, key, CASE WHEN count(*) >= 60 THEN regr_slope(r, x) END AS b FROM paired WHERE n <= 60 GROUP BY 1, 2),
fresh AS (SELECT * FROM x WHERE bucket = previous_session AND n > 20),
strength AS (SELECT a.as_of, a.key, CASE WHEN count(b.key) >= 3 THEN (a.close / a.c20 - 1) - median(b.close / b.c20 - 1) END AS s FROM fresh a LEFT JOIN fresh b ON b.as_of = a.as_of AND b.sector = a.sector AND b.key <> a.key GROUP BY a.as_of, a.key, a.close, a.c20),
long AS ({' UNION ALL '.join(f"SELECT as_of, key, bucket = previous_session AS ok, '{n}' AS feature_id, CASE WHEN {c} THEN {v} END AS v, 'INSUFFICIENT_HISTORY' AS why FROM x" for n, c, v in _REPLAYED)}
  UNION ALL SELECT x.as_of, x.key, bucket = previous_session, 'beta_60', b, CASE WHEN beta.key IS NULL THEN 'MISSING_INPUT' ELSE 'INSUFFICIENT_HISTORY' END FROM x LEFT JOIN beta USING (as_of, key)
  UNION ALL SELECT x.as_of, x.key, true, 'sector_rs_20', s, 'MISSING_INPUT' FROM x LEFT JOIN strength USING (as_of, key))
SELECT CAST(as_of AS VARCHAR) AS as_of, key, feature_id, round(CASE WHEN ok THEN v END, 6) AS value, CASE WHEN NOT ok THEN 'MISSING_INPUT' WHEN v IS NULL THEN why END AS reason FROM long""")
def replay_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar features of every supplier as every month's start saw them, with beta and strength against the nation's median."""
    names = tuple(n for n, *_ in _REPLAYED)
    sectors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("sector"))
    rows = R.replay_bars(desk_bars(spark, sf_dir), desk_index(spark, sf_dir), months(spark, sf_dir), sectors, names=names, slot_seconds=MONTH, others=("beta_60",), provenance=False)
    return rows.where(F.col("feature_id").isin(*names, "beta_60", "sector_rs_20")).select(F.col("as_of").cast("string").alias("as_of"), "key", "feature_id", F.round("value", 6).alias("value"), "reason")


_LIVE = "SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day, o_orderkey, o_orderdate + to_hours(CAST(12 + o_orderkey % 90 AS INTEGER)) AS knowable_at FROM orders"


def _live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day"), "o_orderkey", F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(12 + o_orderkey % 90 AS INT), 0, 0)").alias("knowable_at"))


@query(f"""WITH o AS ({_LIVE}), axis AS (SELECT DISTINCT day FROM o WHERE isodow(day) < 6), n AS (SELECT d.day, (SELECT min(a.day) FROM axis a WHERE a.day > d.day) AS nxt FROM (SELECT DISTINCT day FROM o) d)
SELECT o_orderkey, CAST(least(knowable_at, nxt + INTERVAL 32400 SECOND) AS VARCHAR) AS knowable_at, CASE WHEN nxt + INTERVAL 32400 SECOND < knowable_at THEN 'ASSUMED' ELSE 'OBSERVED' END AS knowable_basis FROM o JOIN n USING (day)""")
def as_if_live_next_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as if each had been fetched at nine on the next weekday that has orders."""
    o = _live_orders(spark, sf_dir)
    axis = pit.sessions(o.select("day").where("weekday(day) < 5"))
    return R.next_session_live(o, axis, 32_400).selectExpr("o_orderkey", f"{text_of('knowable_at')} AS knowable_at", "knowable_basis")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 > 0 THEN l_shipdate END AS ex_at, l_shipdate - to_days(CAST(l_partkey % 30 AS INTEGER)) AS announced, l_shipdate + to_days(CAST(l_suppkey % 40 - 10 AS INTEGER)) AS fetched FROM lineitem),
y AS (SELECT *, greatest(announced, fetched) AS strict, CASE WHEN ex_at IS NOT NULL THEN greatest(announced, ex_at + INTERVAL 2 DAY) END AS assumed FROM x)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN assumed < strict THEN assumed ELSE strict END AS VARCHAR) AS knowable_at, CASE WHEN assumed < strict THEN 'ASSUMED' ELSE 'OBSERVED' END AS knowable_basis FROM y""")
def as_if_live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as events: knowable when announced and fetched, or two days after the event if that is earlier."""
    l = table(spark, sf_dir, "lineitem").selectExpr(  # noqa: E741
        "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_shipdate AS TIMESTAMP_NTZ) END AS ex_at",
        "CAST(l_shipdate AS TIMESTAMP_NTZ) - make_dt_interval(CAST(l_partkey % 30 AS INT)) AS knowable_at", "CAST(l_shipdate AS TIMESTAMP_NTZ) + make_dt_interval(CAST(l_suppkey % 40 - 10 AS INT)) AS fetched_at",
    )
    return R.event_live(l, 2 * 86_400).selectExpr("l_orderkey", "l_linenumber", f"{text_of('knowable_at')} AS knowable_at", "knowable_basis")


@query(f"""WITH o AS ({_LIVE}), live AS (SELECT *, isodow(day) - 1 AS weekday FROM o WHERE o_orderkey % 7 = 1 AND isodow(day) <> 7), m AS (SELECT weekday, max(epoch(knowable_at) - epoch(day)) AS f, max(epoch(knowable_at) - epoch(day)) + 3600 AS c FROM live GROUP BY 1),
lags AS (SELECT w.weekday, CAST(ceil(coalesce(f, (SELECT max(f) FROM m)) / 60) * 60 AS BIGINT) AS first_s, CAST(ceil(greatest(coalesce(c, (SELECT max(c) FROM m)), coalesce(f, (SELECT max(f) FROM m)) + 21600) / 60) * 60 AS BIGINT) AS confirm_s FROM (SELECT unnest(range(7)) AS weekday) w LEFT JOIN m USING (weekday)),
y AS (SELECT o_orderkey, knowable_at + INTERVAL 3 DAY AS knowable_at, day + to_seconds(first_s) AS a, day + to_seconds(confirm_s) AS b FROM o JOIN lags ON weekday = isodow(day) - 1)
SELECT o_orderkey, CAST(least(knowable_at, a) AS VARCHAR) AS knowable_at, CASE WHEN a < knowable_at THEN 'ASSUMED' ELSE 'OBSERVED' END AS knowable_basis, CASE WHEN a < knowable_at THEN CAST(b AS VARCHAR) END AS confirmed_at FROM y""")
def as_if_live_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as if each had been fetched its weekday's longest lag, measured on every seventh of them, after midnight."""
    o = _live_orders(spark, sf_dir)
    live = o.where("o_orderkey % 7 = 1 AND weekday(day) <> 6").select("day", F.col("knowable_at").alias("first_at"), F.expr("knowable_at + INTERVAL '1' HOUR").alias("confirmed_at"))
    moved = R.weekday_live(o.withColumn("knowable_at", F.expr("knowable_at + INTERVAL '3' DAY")), R.measured_weekday_lags(live))
    return moved.selectExpr("o_orderkey", f"{text_of('knowable_at')} AS knowable_at", "knowable_basis", f"{text_of('confirmed_at')} AS confirmed_at")


_INSTANT = "2000-06-01 00:00:00"
_ACTION_SQL = """acts AS (
  SELECT l_suppkey AS key, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS action_id, CAST(l_shipdate AS DATE) AS ex_date, list_extract(['SPLIT', 'BONUS', 'SPLIT', 'RIGHTS', 'DIVIDEND', 'MERGER'], CAST(l_orderkey % 6 AS INTEGER) + 1) AS kind,
         l_shipdate + to_days(CAST(l_partkey % 7 - 3 AS INTEGER)) AS knowable_at, CASE WHEN l_partkey % 13 > 0 THEN 2 + CAST(l_quantity AS BIGINT) % 4 END AS face_before, 1 + l_linenumber % 2 AS face_after,
         CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_partkey % 7 = 0 THEN 9 ELSE 1 + l_linenumber % 2 END ELSE 1 + l_linenumber % 3 END AS ratio_new, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_orderkey % 2 = 0 THEN 2 + CAST(l_quantity AS BIGINT) % 4 ELSE 1 + l_partkey % 3 END AS ratio_old
  FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09 AND l_tax >= 0.07)"""
_BARS_SQL = DESK_SQL + """, dbars AS (SELECT *, CAST(bucket AS DATE) AS day, key || '-' || year(bucket) AS payload, CASE WHEN key % 5 = 0 THEN 'intraday' ELSE 'historical' END AS endpoint, CASE WHEN key % 11 = 0 THEN 'GLOBAL_INDEX' ELSE 'EQ' END AS segment,
  CAST(make_date(year(bucket), 1, 1) AS TIMESTAMP) + to_days(CAST(key * 37 % 900 AS INTEGER)) AS fetched_at FROM desk),
basis AS (SELECT payload, CASE WHEN any_value(segment) LIKE 'GLOBAL%' OR any_value(endpoint) = 'intraday' THEN 'RAW_OBSERVED' ELSE 'VENDOR_ADJUSTED' END AS price_basis, CAST(min(fetched_at) AS DATE) AS basis_as_of FROM dbars WHERE key % 17 > 0 GROUP BY payload)"""
_FACTOR_SQL = _BARS_SQL + ", " + _ACTION_SQL + """, statused AS (SELECT *, CASE WHEN kind = 'SPLIT' AND face_before IS NOT NULL AND NOT (ratio_old IS NOT NULL AND (ratio_new <> face_after OR ratio_old <> face_before)) THEN 'EXACT' WHEN kind = 'SPLIT' THEN 'UNCERTAIN'
    WHEN kind = 'BONUS' AND ratio_old IS NOT NULL THEN 'EXACT' WHEN kind = 'BONUS' THEN 'UNCERTAIN' ELSE 'UNSUPPORTED' END AS status FROM acts),
facs AS (SELECT s.*, CASE WHEN status = 'EXACT' THEN CASE WHEN kind = 'SPLIT' THEN face_before ELSE ratio_new + ratio_old END END AS num, CASE WHEN status = 'EXACT' THEN CASE WHEN kind = 'SPLIT' THEN face_after ELSE ratio_old END END AS den FROM statused s),
prior AS (SELECT action_id, arg_max(b.close, b.day) AS pc, arg_max(coalesce(p.basis_as_of, DATE '9999-01-01'), b.day) AS pb FROM facs f JOIN dbars b ON b.key = f.key AND b.day < f.ex_date LEFT JOIN basis p USING (payload) GROUP BY 1),
later AS (SELECT action_id, arg_min(b.open, b.day) AS eo FROM facs f JOIN dbars b ON b.key = f.key AND b.day >= f.ex_date GROUP BY 1),
factors AS (SELECT f.*, CASE WHEN num IS NULL THEN 'N/A' WHEN action_id % 4 = 1 THEN 'APPLIED' WHEN pc IS NOT NULL AND pb < ex_date THEN 'UNKNOWN' WHEN pc IS NULL OR eo IS NULL THEN 'UNKNOWN' WHEN abs(ln(num / den)) < 0.2 THEN 'UNKNOWN'
    WHEN abs(ln(pc / eo) - ln(num / den)) < 0.15 THEN 'NOT_APPLIED' WHEN abs(ln(pc / eo)) < 0.15 THEN 'APPLIED' ELSE 'UNKNOWN' END AS treatment FROM facs f LEFT JOIN prior USING (action_id) LEFT JOIN later USING (action_id))"""


def _desk_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions by rule from the returned lines of high discount and tax; some eight a supplier at every size."""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount >= 0.09 AND l_tax >= 0.07")  # noqa: E741
    return l.selectExpr(
        "l_suppkey AS key", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS action_id", "CAST(l_shipdate AS DATE) AS ex_date", "element_at(array('SPLIT', 'BONUS', 'SPLIT', 'RIGHTS', 'DIVIDEND', 'MERGER'), CAST(l_orderkey % 6 AS INT) + 1) AS kind",
        "CAST(l_shipdate AS TIMESTAMP_NTZ) + make_dt_interval(CAST(l_partkey % 7 - 3 AS INT)) AS knowable_at", "CASE WHEN l_partkey % 13 > 0 THEN 2 + CAST(l_quantity AS BIGINT) % 4 END AS face_before", "1 + l_linenumber % 2 AS face_after",
        "CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_partkey % 7 = 0 THEN 9 ELSE 1 + l_linenumber % 2 END ELSE 1 + l_linenumber % 3 END AS ratio_new", "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_orderkey % 2 = 0 THEN 2 + CAST(l_quantity AS BIGINT) % 4 ELSE 1 + l_partkey % 3 END AS ratio_old",
    )


def _desk_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk_bars(spark, sf_dir).selectExpr(
        "*", "CAST(bucket AS DATE) AS day", "concat(key, '-', year(bucket)) AS payload", "CASE WHEN key % 5 = 0 THEN 'intraday' ELSE 'historical' END AS endpoint", "CASE WHEN key % 11 = 0 THEN 'GLOBAL_INDEX' ELSE 'EQ' END AS segment",
        "CAST(make_date(year(bucket), 1, 1) AS TIMESTAMP_NTZ) + make_dt_interval(CAST(key * 37 % 900 AS INT)) AS fetched_at",
    )


def _derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The bars, what their payloads are based on and the factors; bars and basis are read several times and made once."""
    days, actions = stored(_desk_days(spark, sf_dir), "desk-days"), _desk_actions(spark, sf_dir)
    basis = stored(BA.price_basis(days.where("key % 17 > 0")), "desk-basis")  # the rest has none on record
    return days, basis, BA.derive_factors(actions, days, basis, actions.where("action_id % 4 = 1").select("action_id"))


@query(f"WITH {_BARS_SQL} SELECT payload, price_basis, CAST(basis_as_of AS VARCHAR) AS basis_as_of FROM basis")
def payload_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each payload's prices are based on."""
    return BA.price_basis(_desk_days(spark, sf_dir).where("key % 17 > 0")).selectExpr("payload", "price_basis", f"{text_of('basis_as_of')} AS basis_as_of")


@query(f"WITH {_FACTOR_SQL} SELECT action_id, kind, status, num, den, treatment FROM factors")
def derived_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action's exact factor and whether the vendor's history contains it."""
    return _derived(spark, sf_dir)[2].select("action_id", "kind", "status", "num", "den", "treatment")


_KNOWN_SQL = _FACTOR_SQL + f""", ex AS (SELECT * FROM factors WHERE status = 'EXACT'), excluded AS (SELECT key || '-' || (year(ex_date) - 1) AS payload, action_id FROM ex WHERE action_id % 3 = 0),
horizon AS (SELECT min(ex_date) AS h FROM factors WHERE knowable_at < TIMESTAMP '{_INSTANT}'),
b AS (SELECT d.*, price_basis, basis_as_of FROM dbars d LEFT JOIN basis USING (payload) WHERE knowable_at < TIMESTAMP '{_INSTANT}'),
j AS (SELECT b.key, b.day, list(f.num) FILTER (WHERE f.knowable_at < TIMESTAMP '{_INSTANT}' AND f.ex_date <= DATE '{_INSTANT[:10]}') AS tn, list(f.den) FILTER (WHERE f.knowable_at < TIMESTAMP '{_INSTANT}' AND f.ex_date <= DATE '{_INSTANT[:10]}') AS td,
   list(f.num) FILTER (WHERE price_basis = 'VENDOR_ADJUSTED' AND f.ex_date <= basis_as_of AND treatment = 'APPLIED' AND x.action_id IS NULL) AS bn, list(f.den) FILTER (WHERE price_basis = 'VENDOR_ADJUSTED' AND f.ex_date <= basis_as_of AND treatment = 'APPLIED' AND x.action_id IS NULL) AS bd,
   count(*) FILTER (WHERE price_basis = 'VENDOR_ADJUSTED' AND f.ex_date <= basis_as_of AND treatment = 'UNKNOWN') AS unknown
  FROM b JOIN ex f ON f.key = b.key AND b.day < f.ex_date LEFT JOIN excluded x ON x.payload = b.payload AND x.action_id = f.action_id GROUP BY 1, 2),
p AS (SELECT b.*, h, coalesce(unknown, 0) AS unknown, len(coalesce(tn, [])) AS used, """ + ", ".join(f"list_reduce(list_prepend(1::HUGEINT, list_transform(coalesce({c}, []), lambda v: v::HUGEINT)), lambda v, w: v * w) AS {c}" for c in ("tn", "td", "bn", "bd")) + """ FROM b LEFT JOIN j USING (key, day), horizon),
q AS (SELECT *, tn * bd AS num, td * bn AS den, price_basis IS NULL OR (price_basis = 'VENDOR_ADJUSTED' AND (unknown > 0 OR h IS NULL OR day < h)) AS doubtful FROM p),
known AS (SELECT *, CASE WHEN num = den THEN 'AS_STORED' WHEN num > den THEN 'ADJUSTED' ELSE 'RECONSTRUCTED' END AS status, CASE WHEN doubtful THEN 'low_confidence' WHEN num < den THEN 'reconstructed' END AS refusal FROM q)"""


def _over(value: str, top: str, bottom: str) -> str:
    """SQL: value * top / bottom in millionths, halves to even, as a number."""
    n = f"(CAST(round({value} * 1000000) AS HUGEINT) * {top})"
    return f"((({n} // {bottom}) + CASE WHEN 2 * ({n} % {bottom}) > {bottom} OR (2 * ({n} % {bottom}) = {bottom} AND ({n} // {bottom}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 1000000)"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, basis, factors = _derived(spark, sf_dir)
    factors = stored(factors, "desk-factors")
    excluded = factors.where("status = 'EXACT' AND action_id % 3 = 0").selectExpr("concat(key, '-', year(ex_date) - 1) AS payload", "action_id")
    return BA.bars_as_known(days, factors, basis, excluded, F.lit(_INSTANT).cast("timestamp_ntz"))


@query(f"WITH {_KNOWN_SQL} SELECT key, CAST(day AS VARCHAR) AS day, {_over('open', 'den', 'num')} AS open, {_over('close', 'den', 'num')} AS close, {_over('volume', 'num', 'den')} AS volume, round(num::DOUBLE / den::DOUBLE, 9) AS factor, status, used AS actions_known FROM known WHERE refusal IS NULL")
def bars_on_known_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a trader knew them at an instant: target over baked factors, exactly; refused rows left out."""
    got = BA.usable(_known(spark, sf_dir))
    return got.select("key", F.col("day").cast("string").alias("day"), *[F.col(c).cast("double").alias(c) for c in ("open", "close", "volume")], F.round(F.col("num").cast("double") / F.col("den").cast("double"), 9).alias("factor"), "status", "actions_known")


@query(f"WITH {_KNOWN_SQL} SELECT key, count(*) FILTER (WHERE refusal = 'reconstructed') AS reconstructed, count(*) FILTER (WHERE refusal = 'low_confidence') AS low_confidence FROM known GROUP BY key")
def refused_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bars of each key may not be used at the instant, and why."""
    return BA.refused(_known(spark, sf_dir))
