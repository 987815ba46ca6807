"""Queries over headlines and filings made from orders: each template's labels are written beside it, and the SQL reads those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import newsrules as R
from .derive import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(x) -> str:
    return "NULL" if x is None else f"{x}" if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    """A VALUES list numbered from 0."""
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(_quoted, r))})" for i, r in enumerate(rows)) + f") AS t(no, {names})"


#: Headline, category by keywords, analyst action, verdict, crore, mentions.
HEADLINES = [
    ("beats estimates as Q2 net profit rises", "RESULTS", None, "BEAT", None, ""),
    ("Q3 revenue misses Street forecasts", "RESULTS", None, "MISS", None, ""),
    ("Q1 profit tops estimates but margin misses consensus", "RESULTS", None, "MIXED", None, ""),
    ("earnings in line with expectations", "OTHER", None, "INLINE", None, ""),
    ("brokerage raises target price to 450", "BROKERAGE_ACTION", "UP", None, None, ""),
    ("cut to sell: broker slashes its price target", "OTHER", "DOWN", None, None, ""),
    ("to upgrade systems at two plants", "BROKERAGE_ACTION", None, None, None, ""),
    ("raises Rs 450 crore and targets growth", "OTHER", None, None, 450.0, ""),
    ("bags order worth Rs 1,250.5 cr from railways", "ORDER_CONTRACT", None, None, 1250.5, ""),
    ("sees 2 lakh crore market; Rs 1.5 lakh crore capex", "OTHER", None, None, 150000.0, ""),
    ("Sensex and Nifty 50 fall as crude oil prices jump", "COMMODITIES", None, None, None, "INDEX:NIFTY_50,INDEX:SENSEX,COMMODITY:CRUDE_OIL"),
    ("Nifty Bank slips; RBI holds repo rate, rupee steady", "INTEREST_RATE", None, None, None, "INDEX:NIFTY_BANK,CURRENCY:INR,CENTRAL_BANK:RBI"),
    ("SEBI probe: Supreme Court hears plea", "INVESTIGATION", None, None, None, "REGULATOR:SEBI,COURT:SUPREME_COURT"),
    ("gold and silver up on Iran tension, treasury yields ease", "COMMODITIES", None, None, None, "COMMODITY:GOLD,COMMODITY:SILVER,BOND_YIELD:US_10Y,GEOPOLITICAL:US_IRAN"),
    ("CEO resigns", "MANAGEMENT_CHANGE", None, None, None, ""),
    ("Oil India output rises while oil marketing firms gain", "COMMODITIES", None, None, None, ""),
    ("D-Street expects profit above last year", "OTHER", None, None, None, ""),
    ("opens a new office", "OTHER", None, None, None, ""),
]
_N = len(HEADLINES)


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = "array(" + ", ".join(_quoted(h[0]) for h in HEADLINES) + ")"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS item_id", f"concat('Acme ', element_at({texts}, CAST(o_orderkey % {_N} AS INT) + 1)) AS title", "o_custkey", "o_orderdate AS at")


@query(f"SELECT o_orderkey AS item_id, category, action, verdict, crore::DOUBLE AS crore, mentions FROM orders JOIN {_values([h[1:] for h in HEADLINES], 'category, action, verdict, crore, mentions')} ON no = o_orderkey % {_N}")
def headline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    named = F.array_join(F.transform(R.mentions(t), lambda m: F.concat_ws(":", m["type"], m["id"])), ",")
    return _headlines(spark, sf_dir).select("item_id", R.keyword_category(t).alias("category"), R.analyst_action(t).alias("action"), R.street_verdict(t).alias("verdict"), scalars.crore_amount(t).alias("crore"), named.alias("mentions"))


#: Filing category, summary; kind, meeting, period end, period kind, flag, subject category of the summary.
FILINGS = [
    ("Board Meeting Intimation", "Board Meeting to be held on 24-Oct-2026 to consider financial results for the quarter ended September 30, 2026", "INTIMATION", "2026-10-24", "2026-09-30", "Q", None, "RESULTS"),
    ("Board Meeting Intimation", "Board Meeting to be held on 5 November 2026 to consider a bonus issue", None, None, None, None, None, "BONUS"),
    ("Board Meeting Intimation", "Board Meeting to be held on 14/Nov/2026: Financial Results for the half year ended 30.09.2027", "INTIMATION", "2026-11-14", None, "H", "PERIOD_AFTER_MEETING", "RESULTS"),
    ("Outcome of Board Meeting", "Approved the audited financial results for the year ended March 2026", "OUTCOME", None, "2026-03-31", "FY", None, "RESULTS"),
    ("Outcome of Board Meeting", "Approved the appointment of an auditor", None, None, None, None, None, "MANAGEMENT_CHANGE"),
    ("Financial Results Updates", "Submission for the nine months ended on December 2025", "OUTCOME", None, "2025-12-31", "9M", None, "OTHER"),
    ("Integrated Filing- Financial", "Filing without a period", "OUTCOME", None, None, None, None, "OTHER"),
    ("Credit Rating", "Credit rating reaffirmed", None, None, None, None, None, "RATING_CHANGE"),
    ("Acquisition", "Acquisition of a stake by the promoter", None, None, None, None, None, "MERGER_ACQUISITION"),
]


@query(f"SELECT o_orderkey AS item_id, kind, meeting, period_end, period_kind, flag, subject FROM orders JOIN {_values([f[2:] for f in FILINGS], 'kind, meeting, period_end, period_kind, flag, subject')} ON no = o_orderkey % {len(FILINGS)}")
def filing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: "element_at(array(" + ", ".join(_quoted(f[k]) for f in FILINGS) + f"), CAST(o_orderkey % {len(FILINGS)} AS INT) + 1)"
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS item_id", f"{pick(0)} AS cat", f"{pick(1)} AS summary")
    a = R.announcement(F.col("cat"), F.col("summary"), F.lit("2026-12-01").cast("date"))
    o = o.withColumns({"a": a, "subject": R.subject_category(F.col("summary"))})
    return o.select("item_id", "a.kind", F.col("a.meeting_date").cast("string").alias("meeting"), F.col("a.period_end").cast("string").alias("period_end"), "a.period_kind", "a.flag", "subject")


#: Raw text, raw address; clean text of at most 24 characters, clean address.
RAW = [
    ("<b>Profit</b>&nbsp;rises &amp; sales\tgrow", "https://example.org/a?b=1", "Profit rises & sales gro…", "https://example.org/a?b=1"),
    ("  two\n lines ", "ftp://example.org/x", "two lines", None),
    ("", " http://example.org ", None, "http://example.org"),
    ("<p></p>", "https://", None, None),
    ("a &lt;tag&gt; b", "https://exa mple.org/", "a b", None),
]
RAW[0] = (RAW[0][0], RAW[0][1], "Profit rises & sales gr…", RAW[0][3])


@query(f"SELECT c_custkey, clean_text, clean_url FROM customer JOIN {_values([r[2:] for r in RAW], 'clean_text, clean_url')} ON no = c_custkey % {len(RAW)}")
def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: "element_at(array(" + ", ".join(_quoted(r[k]) for r in RAW) + f"), CAST(c_custkey % {len(RAW)} AS INT) + 1)"
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(pick(0).replace("\n", "\\n").replace("\t", "\\t")).alias("t"), F.expr(pick(1)).alias("u"))
    return c.select("c_custkey", R.clean_text(F.col("t"), 24).alias("clean_text"), R.clean_url(F.col("u")).alias("clean_url"))


#: Segment, ISIN, series, symbol, name, sector, profile, ratios; class, subclass, status.
SECURITIES = [
    ("NSE_INDEX", None, "INDEX", "NIFTY", "Nifty 50", None, 0, 0, "OTHER", "INDEX", "CLASSIFIED"),
    ("NSE_EQ", "INE002A01018", "EQ", "ALPHA", "Alpha Ltd", "Energy", 1, 1, "STOCK", None, "CLASSIFIED"),
    ("NSE_EQ", "INF204KB17I5", "EQ", "BETAETF", "Beta ETF", None, 0, 0, "FUND_UNIT", None, "CLASSIFIED"),
    ("NSE_EQ", "INE002A20018", "RE", "ALPHA-RE", "Alpha rights", None, 0, 0, "RIGHTS_ENTITLEMENT", None, "CLASSIFIED"),
    ("NSE_EQ", "INE0CCU23010", "IV", "TRUST", "Some Trust", None, 0, 0, "OTHER", "INVIT_UNIT", "CLASSIFIED"),
    ("NSE_EQ", "INE002A01018", "EQ", "GAMMA", "GAMMAAMC - GROWTH", None, 0, 0, None, None, "REVIEW"),
    ("NSE_EQ", "INE002A01018", "EQ", "DELTA", "Delta Ltd", None, 1, 0, None, None, "REVIEW"),
    ("NSE_EQ", "INE002A01018", "EQ", "ETA", "Eta Ltd", None, 0, 0, None, None, "UNCLASSIFIED"),
    ("NSE_EQ", None, None, None, None, None, 0, 0, None, None, "UNCLASSIFIED"),
    ("GLOBAL_INDEX", None, None, "DJI", "Dow", None, 0, 0, "OTHER", "GLOBAL", "CLASSIFIED"),
]


@query(f"SELECT p_partkey, security_class, subclass, status FROM part JOIN {_values([x[8:] for x in SECURITIES], 'security_class, subclass, status')} ON no = p_partkey % {len(SECURITIES)}")
def security_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["segment", "isin", "series", "symbol", "name", "sector", "profile", "ratios"]
    pick = lambda k: "element_at(array(" + ", ".join(_quoted(r[k]) for r in SECURITIES) + f"), CAST(p_partkey % {len(SECURITIES)} AS INT) + 1)"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"CAST({pick(k)} AS STRING) AS {n}" for k, n in enumerate(names)])
    c = R.security_class(*[F.col(n) for n in names[:6]], F.col("profile") == "1", F.col("ratios") == "1")
    return p.withColumn("c", c).select("p_partkey", "c.*")


#: Filer, instrument name; agree, agree strictly.
NAMES = [
    ("Sundaram Home Finance Limited", "SUNDARAM FINANCE", 1, 0),
    ("Sundaram Finance Limited", "SUNDARAM FINANCE", 1, 1),
    ("Tata Consultancy Services Limited", "TATA CONSULT SRVCS", 1, 1),
    ("Alpha (Delhi) Motors Ltd", "ALPHA MOTORS", 1, 1),
    ("Kalpataru Projects International Limited", "KALPATARU PROJECT INTERNL", 1, 1),
    ("Beta Motors", "ALPHA MOTORS", 0, 0),
    ("Alpha", "ALPHA", 0, 0),
    ("Motors Alpha", "ALPHA MOTORS", 0, 0),
    ("Larsen & Toubro Limited", "LARSEN AND TOUBRO", 1, 1),
]


@query(f"SELECT s_suppkey, agree = 1 AS agree, strict = 1 AS strict FROM supplier JOIN {_values([x[2:] for x in NAMES], 'agree, strict')} ON no = s_suppkey % {len(NAMES)}")
def name_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: "element_at(array(" + ", ".join(_quoted(r[k]) for r in NAMES) + f"), CAST(s_suppkey % {len(NAMES)} AS INT) + 1)"
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{pick(0)} AS filer", f"{pick(1)} AS name")
    return s.select("s_suppkey", R.names_agree(F.col("filer"), F.col("name")).alias("agree"), R.names_agree(F.col("filer"), F.col("name"), strict=True).alias("strict"))


def _universe(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.concat(F.lit("NSE_EQ|"), F.col("s_suppkey").cast("string")).alias("instrument_key"), F.concat(F.lit("Firm"), F.col("s_suppkey").cast("string"), F.lit(" Trading Ltd")).alias("name")
    )


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT o.o_orderkey AS item_id, 'NSE_EQ|' || s_suppkey AS instrument_key, 'firm' || s_suppkey || ' trading' AS core FROM orders o JOIN l ON l.l_orderkey = o.o_orderkey JOIN supplier ON s_suppkey = l.l_suppkey""")
def headline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    name = F.concat(F.lit("Firm"), F.col("s_suppkey").cast("string"), F.lit(" Trading"))
    names = line.groupBy("item_id").agg(F.concat(F.array_join(F.array_sort(F.collect_list(name)), " and "), F.lit(" win the deal")).alias("title"))
    return R.headline_companies(names, R.name_cores(_universe(spark, sf_dir))).select("item_id", "instrument_key", "core")


@query("""WITH f AS (SELECT o_orderkey AS filing_id, o_orderkey % 6 AS k, s_suppkey FROM orders JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier))
SELECT filing_id, CASE WHEN k IN (0, 1, 2) THEN 'NSE_EQ|' || s_suppkey END AS instrument_key, CASE WHEN k = 0 THEN 'EXACT_SYMBOL' WHEN k IN (1, 2) THEN 'COMPANY_NAME' ELSE 'UNRESOLVED' END AS method, CASE WHEN k = 0 THEN 1.0 WHEN k IN (1, 2) THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM f""")
def filer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = s.count()
    k = F.col("o_orderkey") % 6
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey").withColumn("s_suppkey", F.col("o_custkey") % n).join(s, "s_suppkey")
    firm = F.concat(F.lit("Firm"), F.col("s_suppkey").cast("string"))
    filer = F.when(k == 3, "Nobody Here Ltd").when(k == 4, F.concat(firm, F.lit(" Trading Mutual Fund"))).when(k == 5, F.concat(firm, F.lit(" Housing Trading Ltd"))).otherwise(F.concat(firm, F.lit(" Trading Limited")))
    symbol = F.when(k == 0, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).when(k == 1, "NOSUCH")
    f = o.select(F.col("o_orderkey").alias("filing_id"), filer.alias("filer"), symbol.alias("symbol"), F.col("o_orderdate").alias("at"))
    return R.resolve_filers(f, _universe(spark, sf_dir))


@query("""WITH t AS (SELECT o_orderkey AS item_id, o_orderpriority AS source, CAST(o_custkey AS VARCHAR) AS m, o_orderkey % 4 = 0 AS fix, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS at FROM orders)
SELECT a.item_id, arg_max(b.item_id, (b.at, b.item_id)) AS corrects FROM t a JOIN t b ON a.source = b.source AND a.m = b.m AND a.fix AND NOT b.fix AND b.at < a.at AND b.at >= a.at - INTERVAL 720 HOUR GROUP BY 1""")
def corrected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS item_id", "o_orderpriority AS source", "concat(CASE WHEN o_orderkey % 4 = 0 THEN 'Corrigendum to the order' ELSE 'Order' END, ' in the matter of ', o_custkey, ' holdings') AS title",
        "CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT), 0) AS at",
    )
    return R.corrected_documents(o, 720).select("item_id", "corrects")
