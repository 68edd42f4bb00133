"""The queries of the reference's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import criteria, groups, joins, reshape, stats, tools, windows
from .compiler import with_column
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def engine(spark: SparkSession, d: str, *names: str, order: dict | None = None) -> Engine:
    e = Engine(spark)
    for n in names:
        e.register(n, read(spark, d, n), (order or {}).get(n))
    return e


def rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Grouped summaries.
@query("groupby_sum_total", "SELECT coalesce(l_returnflag, 'Total') AS l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def groupby_sum_total(spark, d):
    return rounded(engine(spark, d, "lineitem").query("=GROUPBY(lineitem[l_returnflag],lineitem[l_extendedprice],SUM)"), "l_extendedprice")


@query("groupby_levels", "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END AS l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def groupby_levels(spark, d):
    return rounded(engine(spark, d, "lineitem").query("=GROUPBY(lineitem[[l_returnflag]:[l_linestatus]],lineitem[l_quantity],SUM,,2)"), "l_quantity")


@query("groupby_sorted_by_value", "SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, round(avg(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY ROLLUP (o_orderpriority)")
def groupby_sorted_by_value(spark, d):
    return rounded(engine(spark, d, "orders").query("=GROUPBY(orders[o_orderpriority],orders[o_totalprice],AVERAGE,,1,-2)"), "o_totalprice")


@query("groupby_no_total", "SELECT c_mktsegment, count(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def groupby_no_total(spark, d):
    return groups.groupby(read(spark, d, "customer"), ["c_mktsegment"], ["c_custkey"], "COUNT", 0)


@query("pivotby_flag_status", """SELECT coalesce(l_returnflag, 'Total') AS l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS "F", round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS "O", round(sum(l_quantity), 2) AS "Total" FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def pivotby_flag_status(spark, d):
    return rounded(engine(spark, d, "lineitem").query("=PIVOTBY(lineitem[l_returnflag],lineitem[l_linestatus],lineitem[l_quantity],SUM)"), "F", "O", "Total")


@query(
    "pivot_refresh_segment_priority",
    """WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O'))
SELECT CASE WHEN grouping(c_mktsegment) = 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority END AS o_orderpriority,
 CAST(1 - grouping(c_mktsegment) AS INTEGER) AS _row_level, CAST(1 - grouping(o_orderpriority) AS INTEGER) AS _col_level, round(sum(o_totalprice), 2) AS "SUM of o_totalprice", round(avg(o_totalprice), 2) AS "AVERAGE of o_totalprice"
FROM j GROUP BY CUBE (c_mktsegment, o_orderpriority)""",
)
def pivot_refresh(spark, d):
    j = joins.tablejoin(read(spark, d, "orders"), read(spark, d, "customer"), ["o_custkey"], ["c_custkey"])
    out = groups.refresh_pivot(j, ["c_mktsegment"], ["o_orderpriority"], [("o_totalprice", "SUM"), ("o_totalprice", "AVERAGE")], {"o_orderstatus": ["F", "O"]})
    return rounded(out, "SUM of o_totalprice", "AVERAGE of o_totalprice")


@query("getpivotdata", "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_orderstatus = 'F'")
def getpivotdata(spark, d):
    o = read(spark, d, "orders")
    pivot = groups.refresh_pivot(o, ["o_orderpriority"], ["o_orderstatus"], [("o_totalprice", "SUM")])
    first = o.agg(F.min("o_orderpriority")).first()[0]
    return rounded(groups.pivot_lookup(pivot, "SUM of o_totalprice", {"o_orderpriority": first, "o_orderstatus": "F"}), "value")


@query("percentof_share", "SELECT o_orderstatus, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 8) AS share FROM orders GROUP BY 1")
def percentof_share(spark, d):
    return rounded(groups.percentof(read(spark, d, "orders"), ["o_orderstatus"], "o_totalprice"), "share", digits=8)


@query(
    "subtotal_runs",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, CASE WHEN lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS DISTINCT FROM o_orderstatus OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 1 ELSE 0 END AS nw FROM orders),
r AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY o_custkey ORDER BY rn) AS BIGINT) AS _run FROM b)
SELECT o_custkey, _run, min(o_orderstatus) AS o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice, false AS is_total FROM r GROUP BY o_custkey, _run
UNION ALL SELECT o_custkey, CAST(NULL AS BIGINT), 'Grand Total', round(sum(o_totalprice), 2), true FROM orders GROUP BY o_custkey""",
)
def subtotal_runs(spark, d):
    return rounded(groups.subtotal(read(spark, d, "orders"), "o_orderstatus", "o_totalprice", ["o_orderdate", "o_orderkey"], "SUM", ["o_custkey"]), "o_totalprice")


@query("nested_total_excluded", "SELECT round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_linenumber <> 1")
def nested_total_excluded(spark, d):
    li = read(spark, d, "lineitem").withColumn("is_total", F.col("l_linenumber") == 1)
    return rounded(groups.nested_total(li, "l_quantity", "is_total"), "value")


# Joins and lookups.
def _join(how: str, sql: str) -> None:
    @query(f"tablejoin_{how}", sql)
    def body(spark, d):
        e = engine(spark, d)
        e.register("o", read(spark, d, "orders").select("o_orderkey", "o_custkey")).register("c", read(spark, d, "customer").select("c_custkey", "c_name"))
        return e.query(f'=TABLEJOIN(o,c,"o_custkey","c_custkey","{how}")')


_join("inner", "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_join("left", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
_join("right", "SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
_join("full", "SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_name FROM orders FULL JOIN customer ON o_custkey = c_custkey")


@query("tablejoin_multikey_suffix", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity AS l_quantity_2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def tablejoin_multikey(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.tablejoin(li, li, ["l_orderkey", "l_linenumber"])


@query("vlookup_exact", "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def vlookup_exact(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.lookup(li, "l_partkey", read(spark, d, "part"), "p_partkey", ["p_name"], ["p_partkey"])


@query("xlookup_if_missing", "SELECT c_custkey, coalesce(min_by(o_orderpriority, o_orderkey), 'none') AS o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def xlookup_if_missing(spark, d):
    return joins.lookup(read(spark, d, "customer").select("c_custkey"), "c_custkey", read(spark, d, "orders"), "o_custkey", ["o_orderpriority"], ["o_orderkey"], "none")


@query("xlookup_last", "SELECT c_custkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def xlookup_last(spark, d):
    return joins.lookup(read(spark, d, "customer").select("c_custkey"), "c_custkey", read(spark, d, "orders"), "o_custkey", ["o_orderstatus"], ["o_orderkey"], last=True)


@query("vlookup_approx_band", "SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1000 THEN 'mid' WHEN p_retailprice >= 500 THEN 'low' END AS band FROM part")
def vlookup_approx(spark, d):
    bands = spark.createDataFrame([(500.0, "low"), (1000.0, "mid"), (1500.0, "high")], "edge double, band string")
    return joins.asof(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bands, "edge", ["band"]).select("p_partkey", "band")


@query("match_asof", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS s FROM events), k AS (SELECT user_id, s, max(event_id) AS before_id FROM e GROUP BY 1, 2) SELECT e.event_id, k.before_id FROM e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.s > k.s")
def match_asof(spark, d):
    e = read(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    keys = e.select("user_id", F.col("s").alias("k"), F.col("event_id").alias("before_id"))
    return joins.asof(e.select("event_id", "user_id", "s"), "s", keys, "k", ["before_id"], ["user_id"], strict=True).select("event_id", "before_id")


@query("fuzzylookup_part_names")
def fuzzylookup_part_names(spark, d):
    parts = read(spark, d, "part").select("p_partkey", "p_name")
    wrong = parts.select("p_partkey", F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")).alias("typed"))
    return joins.fuzzylookup(wrong, "typed", parts, "p_name", "p_name", "p_partkey", 0.8).select("p_partkey", "p_name", F.round("similarity", 6).alias("similarity"))


@query("has_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def has_semi(spark, d):
    return joins.has(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", read(spark, d, "labels"), "doc_id")


@query("countif_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def countif_anti(spark, d):
    return joins.has(read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", read(spark, d, "orders"), "o_custkey", negate=True)


@query("sumifs_per_row", "SELECT c_custkey, coalesce(round(sum(o_totalprice), 2), 0) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def sumifs_per_row(spark, d):
    return rounded(joins.conditional_join(read(spark, d, "customer").select("c_custkey"), {"c_custkey": "o_custkey"}, read(spark, d, "orders"), "o_totalprice"), "value")


@query("wildcard_lookup", "SELECT p_partkey, first_value(p_brand) OVER (PARTITION BY lower(substr(p_type, 1, 2)) ORDER BY p_partkey) AS p_brand FROM part")
def wildcard_lookup(spark, d):
    parts = read(spark, d, "part")
    probes = parts.select("p_partkey", F.concat(F.substring("p_type", 1, 2), F.lit("*")).alias("pat"))
    keys = parts.select("p_type", F.col("p_partkey").alias("ord"), "p_brand")
    return joins.wildcard_lookup(probes, "pat", keys, "p_type", ["p_brand"], "ord").select("p_partkey", "p_brand")


@query(
    "consolidate_labels",
    """WITH u AS (SELECT upper(c_mktsegment) AS k, c_mktsegment AS s, 0 AS n, c_acctbal AS bal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT upper(c_mktsegment), lower(c_mktsegment), 1, c_acctbal FROM customer WHERE c_custkey % 2 = 1)
SELECT min(s) FILTER (WHERE n = (SELECT min(n) FROM u u2 WHERE u2.k = u.k)) AS c_mktsegment, round(sum(bal), 2) AS c_acctbal FROM u GROUP BY k""",
)
def consolidate_labels(spark, d):
    c = read(spark, d, "customer")
    a = c.filter("c_custkey % 2 = 0").select("c_mktsegment", "c_acctbal")
    b = c.filter("c_custkey % 2 = 1").select(F.lower("c_mktsegment").alias("c_mktsegment"), F.col("c_acctbal").alias("C_ACCTBAL"))
    return rounded(joins.consolidate([a, b], "c_mktsegment", ["c_acctbal"]), "c_acctbal")


@query("hstack_zip", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _row, n_nationkey, n_name, r_regionkey, r_name FROM nation LEFT JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region) r ON r.rn = n_nationkey + 1")
def hstack_zip(spark, d):
    return joins.hstack(read(spark, d, "nation").select("n_nationkey", "n_name"), read(spark, d, "region").select("r_regionkey", "r_name"), ["n_nationkey"], ["r_regionkey"])


# Criteria and filters.
@query("sumifs_criteria", "SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'R'")
def sumifs_criteria(spark, d):
    return rounded(engine(spark, d, "lineitem").query('=SUMIFS(lineitem[l_extendedprice],lineitem[l_quantity],">=10",lineitem[l_returnflag],"r")'), "value").select("value")


@query("countifs_wildcard", "SELECT CAST(count(*) AS DOUBLE) AS value FROM part WHERE upper(p_type) LIKE '%E%'")
def countifs_wildcard(spark, d):
    return engine(spark, d, "part").query('=COUNTIFS(part[p_type],"*e*")').select("value")


@query("averageifs_by_group", "SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_discount > 0.05), 6) AS value FROM lineitem GROUP BY 1")
def averageifs_by_group(spark, d):
    return rounded(criteria.conditional(read(spark, d, "lineitem"), "l_quantity", "average", {"l_discount": ">0.05"}, ["l_returnflag"]), "value", digits=6)


@query("maxifs_minifs", "SELECT max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS value FROM orders")
def maxifs_minifs(spark, d):
    return engine(spark, d, "orders").query('=MAXIFS(orders[o_totalprice],orders[o_orderstatus],"F")-MINIFS(orders[o_totalprice],orders[o_orderstatus],"F")').select("value")


@query("dsum_or_of_and", "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority LIKE '1%'")
def dsum(spark, d):
    return rounded(criteria.database(read(spark, d, "orders"), "o_totalprice", "DSUM", [{"o_orderstatus": "F", "o_totalprice": ">100000"}, {"o_orderpriority": "1*"}]), "value")


@query("advanced_filter_begins_with", "SELECT o_orderkey FROM orders WHERE upper(o_orderpriority) LIKE '1%' OR (o_orderstatus = 'O' AND o_totalprice < 50000)")
def advanced_filter(spark, d):
    return criteria.advanced_filter(read(spark, d, "orders"), [{"o_orderpriority": "1*"}, {"o_orderstatus": "=o", "o_totalprice": "<50000"}]).select("o_orderkey")


@query("filter_formula", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 2 * (SELECT avg(o_totalprice) FROM orders) AND o_orderstatus <> 'P'")
def filter_formula(spark, d):
    o = read(spark, d, "orders")
    flagged = with_column(o, "keep", '=AND([@o_totalprice]>2*AVERAGE(o[o_totalprice]),[@o_orderstatus]<>"P")', "o")
    return flagged.filter("keep").drop("keep")


@query("top10_percent_filter", "WITH c AS (SELECT min(o_totalprice) AS m FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) FROM orders))) SELECT o_orderkey, o_totalprice FROM orders, c WHERE o_totalprice >= m")
def top10_percent(spark, d):
    return criteria.top_n(read(spark, d, "orders"), "o_totalprice", 5, percent=True).select("o_orderkey", "o_totalprice")


@query("values_filter_dates", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders) AND month(o_orderdate) = 3")
def values_filter(spark, d):
    o = read(spark, d, "orders")
    y = o.agg(F.min(F.year("o_orderdate"))).first()[0]
    return criteria.values_filter(o, "o_orderdate", [], dates=[{"year": y, "month": 3}]).select("o_orderkey")


@query("remove_duplicates_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY upper(lang), upper(source)")
def remove_duplicates(spark, d):
    return criteria.remove_duplicates(read(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"]).select("doc_id")


@query("unique_exactly_once", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def unique_once(spark, d):
    return engine(spark, d, "orders").query("=UNIQUE(orders[o_custkey],FALSE,TRUE)")


# Order and shape.
@query("sort_take_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_take(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return reshape.sort(o, [("o_totalprice", True)], ["o_orderkey"]).limit(25)


@query("drop_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def drop_rows(spark, d):
    return reshape.drop(read(spark, d, "orders").select("o_orderkey"), 100, ["o_orderkey"])


@query("choosecols", "SELECT n_regionkey, n_nationkey FROM nation")
def choosecols(spark, d):
    return engine(spark, d, "nation").query("=CHOOSECOLS(nation,-1,1)")


@query("chooserows", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (24, 0, 3) UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3")
def chooserows(spark, d):
    return reshape.chooserows(read(spark, d, "nation").select("n_nationkey", "n_name"), [-1, 1, 4, 4], ["n_nationkey"])


@query("vstack_union", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def vstack(spark, d):
    return reshape.vstack([read(spark, d, "region"), read(spark, d, "nation").select("n_nationkey", "n_name")])


@query("transpose_region", "SELECT 'r_name' AS name, max(r_name) FILTER (WHERE r_regionkey = 0) AS \"0\", max(r_name) FILTER (WHERE r_regionkey = 1) AS \"1\", max(r_name) FILTER (WHERE r_regionkey = 2) AS \"2\", max(r_name) FILTER (WHERE r_regionkey = 3) AS \"3\", max(r_name) FILTER (WHERE r_regionkey = 4) AS \"4\" FROM region")
def transpose(spark, d):
    return reshape.transpose(read(spark, d, "region"), "r_regionkey", ["r_name"])


@query("tocol_cells", "SELECT n_nationkey, 0 AS \"column\", n_name AS value FROM nation UNION ALL SELECT n_nationkey, 1, CAST(n_regionkey AS VARCHAR) FROM nation")
def tocol(spark, d):
    return reshape.tocol(read(spark, d, "nation"), ["n_name", "n_regionkey"], ["n_nationkey"])


@query("wraprows_names", "SELECT n_nationkey // 4 AS _row, max(n_name) FILTER (WHERE n_nationkey % 4 = 0) AS c1, max(n_name) FILTER (WHERE n_nationkey % 4 = 1) AS c2, max(n_name) FILTER (WHERE n_nationkey % 4 = 2) AS c3, max(n_name) FILTER (WHERE n_nationkey % 4 = 3) AS c4 FROM nation GROUP BY 1")
def wraprows(spark, d):
    return reshape.wraprows(read(spark, d, "nation"), "n_name", 4, ["n_nationkey"])


# Windows.
@query("rolling_avg_min_periods", "SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN round(avg(value) OVER w, 6) END AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_avg(spark, d):
    return rounded(windows.rolling(read(spark, d, "events"), "value", 5, "AVERAGE", ["ts", "event_id"], ["user_id"], 2).select("event_id", "rolling"), "rolling", digits=6)


@query("rolling_median", "SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(quantile_cont(value, 0.5) OVER w, 6) END AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_median(spark, d):
    return rounded(windows.rolling(read(spark, d, "events"), "value", 3, "MEDIAN", ["ts", "event_id"], ["user_id"]).select("event_id", "rolling"), "rolling", digits=6)


@query("scan_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def scan_total(spark, d):
    return rounded(windows.scan(read(spark, d, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "running"), "running")


@query("filldown_last_value", "SELECT event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def filldown(spark, d):
    e = read(spark, d, "events").withColumn("v", F.when(F.col("value") > 50, F.col("value")))
    return windows.filldown(e, "v", ["ts", "event_id"], ["user_id"], name="filled").select("event_id", "filled")


@query("rank_avg_ties", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def rank_avg(spark, d):
    return windows.rank(read(spark, d, "lineitem"), "l_quantity", average=True).select("l_orderkey", "l_linenumber", "rank")


@query("percentrank", "SELECT p_partkey, floor(percent_rank() OVER (ORDER BY p_retailprice) * 1000 + 1e-9) / 1000 AS percentrank FROM part")
def percentrank(spark, d):
    return windows.percentrank(read(spark, d, "part"), "p_retailprice").select("p_partkey", "percentrank")


@query("offset_lag", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS shifted FROM orders")
def offset_lag(spark, d):
    return windows.shifted(read(spark, d, "orders"), "o_totalprice", -1, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "shifted")


@query("series_trend", "SELECT CAST(m + i AS DOUBLE) AS l_linenumber, round(a + b * (m + i), 4) AS l_quantity FROM (SELECT regr_slope(l_quantity, l_linenumber) AS b, regr_intercept(l_quantity, l_linenumber) AS a, max(l_linenumber) AS m FROM lineitem), (SELECT unnest([1, 2, 3]) AS i)")
def series_trend(spark, d):
    return rounded(windows.series_frame(read(spark, d, "lineitem"), "l_quantity", "l_linenumber", 3), "l_quantity", digits=4)


# Statistics.
@query("bins_equal_width", "WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem), b AS (SELECT unnest(range(7)) AS k) SELECT round(lo + w * k, 6) AS low, round(lo + w * (k + 1), 6) AS high, (SELECT count(*) FROM lineitem WHERE greatest(least(floor((l_quantity - lo) / w), 6), 0) = k) AS count FROM b, e")
def bins_equal(spark, d):
    return rounded(engine(spark, d, "lineitem").query("=BINS(lineitem[l_quantity],7)"), "low", "high", digits=6)


@query("frequency_edges", "SELECT edge, n AS count FROM (SELECT unnest([10.0, 20.0, 40.0, NULL])::DOUBLE AS edge, unnest([(SELECT count(*) FROM lineitem WHERE l_quantity <= 10), (SELECT count(*) FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20), (SELECT count(*) FROM lineitem WHERE l_quantity > 20 AND l_quantity <= 40), (SELECT count(*) FROM lineitem WHERE l_quantity > 40)]) AS n)")
def frequency(spark, d):
    return engine(spark, d, "lineitem").query("=FREQUENCY(lineitem[l_quantity],{10;20;40})")


@query("percentile_inc", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def percentile_inc(spark, d):
    price = F.col("l_extendedprice")
    return rounded(stats.percentiles(read(spark, d, "lineitem"), ["l_returnflag"], {"q1": (price, 0.25), "p90": (price, 0.9)}), "q1", "p90", digits=4)


@query("percentile_exc", "WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders), k AS (SELECT unnest([0.1, 0.5])::DOUBLE AS k) SELECT k, round((SELECT max(x) FROM s WHERE r = floor(k * (n + 1))) + (k * ((SELECT max(n) FROM s) + 1) - floor(k * ((SELECT max(n) FROM s) + 1))) * ((SELECT max(x) FROM s WHERE r = floor(k * (n + 1)) + 1) - (SELECT max(x) FROM s WHERE r = floor(k * (n + 1)))), 4) AS value FROM k")
def percentile_exc(spark, d):
    return rounded(stats.percentile_exc(read(spark, d, "orders"), "o_totalprice", [0.1, 0.5]), "value", digits=4)


@query("mode_first", "SELECT l_quantity AS mode FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber) LIMIT 1")
def mode_first(spark, d):
    return stats.mode(read(spark, d, "lineitem"), "l_quantity", ["l_orderkey", "l_linenumber"])


@query("trimmean", "WITH s AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem) SELECT round(avg(x), 4) AS trimmean FROM s WHERE r > floor(n * 0.2 / 2) AND r <= n - floor(n * 0.2 / 2)")
def trimmean(spark, d):
    return rounded(stats.trimmean(read(spark, d, "lineitem"), "l_extendedprice", 0.2), "trimmean", digits=4)


@query("skew_kurt", "SELECT round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt FROM lineitem")
def skew_kurt(spark, d):
    return rounded(read(spark, d, "lineitem").agg(stats.skew("l_extendedprice").alias("skew"), stats.kurt("l_extendedprice").alias("kurt")), "skew", "kurt", digits=6)


@query("regression_columns", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS rsq, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS steyx, round(corr(l_extendedprice, l_quantity), 6) AS correl FROM lineitem")
def regression(spark, d):
    out = read(spark, d, "lineitem").agg(*stats.regression("l_extendedprice", "l_quantity")).select("slope", "intercept", "rsq", "steyx", "correl")
    return rounded(rounded(out, "slope", "intercept", "steyx", digits=4), "rsq", "correl", digits=6)


# Formulas per row.
@query("formula_net_price", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 ELSE 0 END AS net FROM lineitem")
def formula_net(spark, d):
    return with_column(read(spark, d, "lineitem"), "net", "=IF([@l_quantity]>25,ROUND([@l_extendedprice]*(1-[@l_discount]),2),0)").select("l_orderkey", "l_linenumber", "net")


@query("formula_errors", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 8) END AS ratio, CASE WHEN l_discount = 0 THEN '#DIV/0!' END AS ratio_err, CASE WHEN l_discount = 0 THEN -1 ELSE round(l_tax / l_discount, 8) END AS safe FROM lineitem")
def formula_errors(spark, d):
    a = with_column(read(spark, d, "lineitem"), "ratio", "=[@l_tax]/[@l_discount]", errors=True)
    return rounded(with_column(a, "safe", "=IFERROR([@l_tax]/[@l_discount],-1)").select("l_orderkey", "l_linenumber", "ratio", "ratio_err", "safe"), "ratio", "safe", digits=8)


@query("formula_share_of_total", "SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 12) AS share FROM orders")
def formula_share(spark, d):
    return rounded(with_column(read(spark, d, "orders"), "share", "=[@o_totalprice]/SUM(orders[o_totalprice])", "orders").select("o_orderkey", "share"), "share", digits=12)


@query("text_functions", "SELECT p_partkey, upper(left(p_name, 3)) || '-' || length(p_name) AS a, replace(p_name, 'a', '4') AS b, CAST(length(trim(p_name)) AS DOUBLE) AS c FROM part")
def text_functions(spark, d):
    p = read(spark, d, "part")
    for n, f in (("a", '=UPPER(LEFT([@p_name],3))&"-"&LEN([@p_name])'), ("b", '=SUBSTITUTE([@p_name],"a","4")'), ("c", "=LEN(TRIM([@p_name]))")):
        p = with_column(p, n, f)
    return p.select("p_partkey", "a", "b", "c")


@query("date_functions", "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(date_diff('day', DATE '1899-12-30', last_day(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH)) AS DOUBLE) AS eom FROM orders")
def date_functions(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    for n, f in (("y", "=YEAR([@day])"), ("m", "=MONTH([@day])"), ("eom", "=EOMONTH([@day],1)")):
        o = with_column(o, n, f)
    return o.select("o_orderkey", "y", "m", "eom")


@query("networkdays", "SELECT o_orderkey, CAST(20 + CAST(isodow(CAST(o_orderdate AS DATE)) < 6 AS INTEGER) + CAST(isodow(CAST(o_orderdate AS DATE) + 1) < 6 AS INTEGER) AS DOUBLE) AS days FROM orders")
def networkdays(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return with_column(o, "days", "=NETWORKDAYS([@day],[@day]+29)").select("o_orderkey", "days")


@query("pmt_schedule", "SELECT c_custkey, round(CASE WHEN c_acctbal = 0 THEN 0 ELSE -(c_acctbal * power(1.01, 24)) / ((power(1.01, 24) - 1) / 0.01) END, 6) AS pmt FROM customer")
def pmt_schedule(spark, d):
    return rounded(with_column(read(spark, d, "customer"), "pmt", "=PMT(0.01,24,[@c_acctbal])").select("c_custkey", "pmt"), "pmt", digits=6)


@query("parsejson_path", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def parsejson_path(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


@query("textsplit_explode", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def textsplit(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("textcolumns_split", "SELECT p_partkey, split_part(p_name, ' ', 1) AS a, nullif(split_part(p_name, ' ', 2), '') AS b FROM part")
def textcolumns(spark, d):
    return tools.text_to_columns(read(spark, d, "part"), "p_name", ["a", "b"], " ", merge=True).select("p_partkey", "a", "b")


@query("regex_extract_all", "SELECT p_partkey, regexp_extract(p_brand, '[0-9]+') AS digits FROM part")
def regex_extract(spark, d):
    return with_column(read(spark, d, "part"), "digits", '=REGEXEXTRACT([@p_brand],"[0-9]+")').select("p_partkey", "digits")


@query("lambda_map_reduce", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2 FROM embeddings")
def lambda_map_reduce(spark, d):
    return rounded(with_column(read(spark, d, "embeddings"), "norm2", "=REDUCE(0,MAP([@embedding],LAMBDA(x,x*x)),LAMBDA(a,x,a+x))").select("vec_id", "norm2"), "norm2", digits=6)


@query("byrow_max", "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings")
def byrow_max(spark, d):
    return with_column(read(spark, d, "embeddings"), "m", "=MAX([@embedding])").select("vec_id", "m")


# Tools.
@query("what_if_data_table", "SELECT r AS row_input, c AS column_input, (SELECT round(sum(l_extendedprice * (1 - r) * (1 + c)), 0) FROM lineitem) AS value FROM (SELECT unnest([0.0, 0.05, 0.1])::DOUBLE AS r), (SELECT unnest([0.0, 0.2])::DOUBLE AS c)")
def what_if(spark, d):
    out = tools.data_table(read(spark, d, "lineitem"), lambda r, c: F.sum(F.col("l_extendedprice") * (1 - r) * (1 + c)), [0.0, 0.05, 0.1], [0.0, 0.2])
    return rounded(out, "value", digits=0)


@query("scenario_summary", "SELECT 'base' AS scenario, round(sum(l_quantity * 1.0), 2) AS result FROM lineitem UNION ALL SELECT 'high', round(sum(l_quantity * 1.5), 2) FROM lineitem")
def scenario_summary(spark, d):
    return rounded(tools.scenarios(read(spark, d, "lineitem"), lambda v: F.sum(F.col("l_quantity") * v["f"]), {"base": {"f": 1.0}, "high": {"f": 1.5}}), "result")


@query("conditional_format_flags", "SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS flag FROM orders")
def cf_flags(spark, d):
    return tools.flags(read(spark, d, "orders"), "o_totalprice", "aboveAverage").select("o_orderkey", "flag")


@query("data_validation", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity BETWEEN 2 AND 40 AND l_quantity = floor(l_quantity))")
def data_validation(spark, d):
    return tools.invalid(read(spark, d, "lineitem"), "l_quantity", "whole", 2, 40).select("l_orderkey", "l_linenumber")


@query("flash_fill", "SELECT c_custkey, upper(split_part(c_name, '#', 1)) AS filled FROM customer")
def flash_fill(spark, d):
    return tools.flash_fill(read(spark, d, "customer"), "c_name", [("Customer#000000001", "CUSTOMER"), ("Client#7", "CLIENT")], "filled").select("c_custkey", "filled")


@query("window_tumbling_events", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    out = read(spark, d, "events").groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


# More formulas per row.
def _formulas(name: str, table: str, keys: str, sql: str, digits: dict | None = None, **formulas: str) -> None:
    """A query of one table with a column for each formula."""

    @query(name, sql)
    def body(spark, d):
        df = read(spark, d, table)
        for n, f in formulas.items():
            df = with_column(df, n, f, table)
        df = df.select(*keys.split(), *formulas)
        return df.withColumns({n: F.round(n, k) for n, k in (digits or {}).items()})


_formulas("formula_operators", "part", "p_partkey", "SELECT p_partkey, -CAST(p_size AS DOUBLE) AS a, p_size / 100.0 AS b, CAST(p_size AS DOUBLE) ** 2 AS c, p_brand || '/' || p_size AS d, upper(p_name) < 'M' AS e, p_size <> 10 AS f FROM part", a="=-[@p_size]", b="=[@p_size]%", c="=[@p_size]^2", d='=[@p_brand]&"/"&[@p_size]', e='=[@p_name]<"m"', f="=[@p_size]<>10")
_formulas("formula_logic", "orders", "o_orderkey", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS a, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS b, (o_orderstatus = 'F') <> (o_totalprice > 100000) AS c, NOT (o_orderstatus = 'F' OR o_totalprice < 1000) AS d FROM orders", a='=SWITCH([@o_orderstatus],"f","done","o","open","other")', b='=IFS([@o_totalprice]>200000,"big",[@o_totalprice]>50000,"mid",TRUE,"small")', c='=XOR([@o_orderstatus]="F",[@o_totalprice]>100000)', d='=NOT(OR([@o_orderstatus]="F",[@o_totalprice]<1000))')
_formulas("formula_let", "lineitem", "l_orderkey l_linenumber", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 8) AS gross FROM lineitem", {"gross": 8}, gross="=LET(net,[@l_extendedprice]*(1-[@l_discount]),net*(1+[@l_tax]))")
_formulas("formula_information", "part", "p_partkey", "SELECT p_partkey, p_size IS NULL AS a, true AS b, true AS c, p_size = 0 AS d, p_size % 2 = 0 AS e FROM part", a="=ISBLANK([@p_size])", b="=ISNUMBER([@p_size])", c="=ISTEXT([@p_name])", d="=ISERROR(1/[@p_size])", e="=ISEVEN([@p_size])")
_formulas("math_functions", "part", "p_partkey", "SELECT p_partkey, p_retailprice - 7 * floor(p_retailprice / 7) AS a, floor(p_retailprice) AS b, round(sqrt(p_retailprice), 8) AS c, round(ln(p_retailprice), 8) AS d, floor(p_retailprice / 10 + 0.5) * 10 AS e, ceil(p_retailprice / 25) * 25 AS f, round(sin(p_size), 8) AS g FROM part", {"a": 4, "c": 8, "d": 8, "g": 8}, a="=MOD([@p_retailprice],7)", b="=INT([@p_retailprice])", c="=SQRT([@p_retailprice])", d="=LN([@p_retailprice])", e="=ROUND([@p_retailprice],-1)", f="=CEILING([@p_retailprice],25)", g="=SIN([@p_size])")
_formulas("base_and_bits", "part", "p_partkey", "SELECT p_partkey, printf('%X', p_partkey) AS a, CAST(p_partkey & 12 AS DOUBLE) AS b, CAST(xor(p_partkey, 5) AS DOUBLE) AS c, bin(p_partkey % 256) AS d FROM part", a="=DEC2HEX([@p_partkey])", b="=BITAND([@p_partkey],12)", c="=BITXOR([@p_partkey],5)", d="=BASE(MOD([@p_partkey],256),2)")
_formulas("text_find_mid", "part", "p_partkey", "SELECT p_partkey, substr(p_name, 2, 3) AS a, right(p_name, 2) AS b, CASE WHEN strpos(upper(p_name), 'E') > 0 THEN CAST(strpos(upper(p_name), 'E') AS DOUBLE) ELSE 0 END AS c, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, 1, strpos(p_name, ' ') - 1) ELSE p_name END AS d, regexp_replace(p_name, '[aeiou]', '*', 'g') AS e, repeat(left(p_name, 1), 3) AS f FROM part", a="=MID([@p_name],2,3)", b="=RIGHT([@p_name],2)", c='=IFERROR(SEARCH("e",[@p_name]),0)', d='=IFERROR(TEXTBEFORE([@p_name]," "),[@p_name])', e='=REGEXREPLACE([@p_name],"[aeiou]","*")', f="=REPT(LEFT([@p_name]),3)")

@query("text_format", "SELECT p_partkey, format('{:,.2f}', p_retailprice) AS a, printf('%05d', p_size) AS b FROM part")
def text_format(spark, d):
    p = read(spark, d, "part")
    for n, f in (("a", '=TEXT([@p_retailprice],"#,##0.00")'), ("b", '=TEXT([@p_size],"00000")')):
        p = with_column(p, n, f)
    return p.select("p_partkey", "a", "b")


@query("dates_between", "SELECT o_orderkey, CAST(date_sub('month', DATE '1990-01-15', CAST(o_orderdate AS DATE)) AS DOUBLE) AS m, CAST(date_diff('day', DATE '1990-01-15', CAST(o_orderdate AS DATE)) AS DOUBLE) AS dd, CAST(isodow(o_orderdate) AS DOUBLE) AS wd, CAST(weekofyear(o_orderdate) AS DOUBLE) AS wk FROM orders")
def dates_between(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    for n, f in (("m", '=DATEDIF(DATE(1990,1,15),[@day],"m")'), ("dd", "=DAYS([@day],DATE(1990,1,15))"), ("wd", "=WEEKDAY([@day],2)"), ("wk", "=ISOWEEKNUM([@day])")):
        o = with_column(o, n, f)
    return o.select("o_orderkey", "m", "dd", "wd", "wk")


@query("clock_functions", "SELECT event_id, CAST(hour(ts) AS DOUBLE) AS h, CAST(minute(ts) AS DOUBLE) AS mi, CAST(second(ts) AS DOUBLE) AS s FROM events")
def clock_functions(spark, d):
    e = read(spark, d, "events")
    for n, f in (("h", "=HOUR([@ts])"), ("mi", "=MINUTE([@ts])"), ("s", "=SECOND([@ts])")):
        e = with_column(e, n, f)
    return e.select("event_id", "h", "mi", "s")


_formulas("finance_functions", "customer", "c_custkey", "SELECT c_custkey, round(-(c_acctbal * power(1.02, 10)), 4) AS fv, round((1000 - c_acctbal) / 5, 4) AS sln, round(power(1 + 0.06 / 12, 12) - 1, 10) AS eff FROM customer", {"fv": 4, "sln": 4, "eff": 10}, fv="=FV(0.02,10,0,[@c_acctbal])", sln="=SLN(1000,[@c_acctbal],5)", eff="=EFFECT(0.06,12)")


# More aggregates.
@query("moments", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, min(l_quantity) AS lo, max(l_quantity) AS hi, median(l_quantity) AS med, CAST(count(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def moments(spark, d):
    q = F.col("l_quantity")
    out = stats.percentiles(read(spark, d, "lineitem"), ["l_returnflag"], {"med": (q, 0.5)}, groups.measure("STDEV.S", q).alias("s"), groups.measure("VAR.P", q).alias("v"), groups.measure("MIN", q).alias("lo"), groups.measure("MAX", q).alias("hi"), groups.measure("COUNT", q).alias("n"))
    return rounded(out, "s", "v", digits=6)


@query("sumproduct", "SELECT round(sum(l_quantity * l_discount), 4) AS value FROM lineitem")
def sumproduct(spark, d):
    return rounded(engine(spark, d, "lineitem").query("=SUMPRODUCT(lineitem[l_quantity],lineitem[l_discount])").select("value"), "value", digits=4)


@query("large_small", "SELECT (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET 9) AS large10, (SELECT o_totalprice FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET 4) AS small5")
def large_small(spark, d):
    o = read(spark, d, "orders")
    return spark.createDataFrame([(criteria.kth(o, "o_totalprice", 10), criteria.kth(o, "o_totalprice", 5, False))], "large10 double, small5 double")


@query("mode_mult", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_size FROM c WHERE n = (SELECT max(n) FROM c) AND n > 1")
def mode_mult(spark, d):
    return stats.mode_mult(read(spark, d, "part"), "p_size")


@query("database_family", "SELECT CAST(count(*) AS BIGINT) AS dcount, round(avg(o_totalprice), 4) AS daverage, max(o_totalprice) AS dmax FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def database_family(spark, d):
    o, rule = read(spark, d, "orders"), [{"o_orderstatus": "=F", "o_totalprice": ">=1000"}]
    one = lambda f, n: criteria.database(o, "o_totalprice", f, rule).withColumnRenamed("value", n)
    return rounded(one("DCOUNT", "dcount").crossJoin(one("DAVERAGE", "daverage")).crossJoin(one("DMAX", "dmax")), "daverage", digits=4)


@query("textjoin_by_group", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def textjoin_by_group(spark, d):
    packed = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(packed, lambda x: x["n_name"]), ", ").alias("names"))


@query("groupby_lambda_range", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS value FROM customer GROUP BY 1")
def groupby_lambda_range(spark, d):
    return groups.groupby_lambda(read(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "LAMBDA(v,MAX(v)-MIN(v))")


@query("set_operations", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_operations(spark, d):
    o = read(spark, d, "orders")
    return reshape.intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("session_windows", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def session_windows(spark, d):
    from ..streaming.recalc import sessions

    return sessions(read(spark, d, "events"), "ts", "user_id", "6 hours").select("user_id", "start", "n")


@query("recalculation_waves", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 8) AS net, round(l_extendedprice * (1 - l_discount) * l_tax, 8) AS tax, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 8) AS gross FROM lineitem")
def recalculation_waves(spark, d):
    from ..streaming.recalc import Model

    m = Model({"gross": "=[@net]+[@tax]", "tax": "=[@net]*[@l_tax]", "net": "=[@l_extendedprice]*(1-[@l_discount])"})
    return rounded(m.recalculate(read(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "net", "tax", "gross"), "net", "tax", "gross", digits=8)


@query("goal_seek", "SELECT round(1 - 1000000.0 / sum(l_extendedprice), 6) AS discount FROM lineitem")
def goal_seek(spark, d):
    total = read(spark, d, "lineitem").agg(F.sum("l_extendedprice")).first()[0]
    return spark.createDataFrame([(round(tools.goal_seek(lambda x: total * (1 - x), 1_000_000.0), 6),)], "discount double")


@query("forecast_ets")
def forecast_ets(spark, d):
    import pandas as pd

    daily = read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")).select("event_type", F.datediff("day", F.lit("2000-01-01").cast("date")).cast("double").alias("t"), "v")

    def one(key, rows):
        from ..functions.values import Arr, Err
        from .evaluator import Evaluator
        from ..functions.registry import TABLE

        rows = rows.sort_values("t")
        pack = lambda s: Arr([[float(v)] for v in s])
        out = Evaluator().call(TABLE["FORECAST.ETS"], [float(rows.t.max()) + 1, pack(rows.v), pack(rows.t)], {})
        return pd.DataFrame({"event_type": [key[0]], "forecast": [None if isinstance(out, Err) else round(float(out), 6)]})

    return daily.groupBy("event_type").applyInPandas(one, "event_type string, forecast double")


# Families of functions, called by their formulas.
def table_of(e: Engine, formulas: dict[str, str], digits: int) -> DataFrame:
    """(name, value) of formulas over whole columns."""
    out = None
    for name, formula in formulas.items():
        row = e.query(formula).select(F.lit(name).alias("name"), F.round("value", digits).alias("value"))
        out = row if out is None else out.unionAll(row)
    return out


def columns_of(df: DataFrame, key: str, formulas: dict[str, str], digits: int = 6) -> DataFrame:
    """key and a column for each formula, numbers rounded."""
    for name, formula in formulas.items():
        df = with_column(df, name, formula)
    kinds = dict(df.dtypes)
    return df.select(key, *[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in formulas])


def listed(sql: dict[str, str], table: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, round(CAST({x} AS DOUBLE), {digits}) AS value FROM {table}" for n, x in sql.items())


Q, P, D = "lineitem[l_quantity]", "lineitem[l_extendedprice]", "lineitem[l_discount]"
q_, p_, d_ = (f"CAST({c} AS DOUBLE)" for c in ("l_quantity", "l_extendedprice", "l_discount"))
PAIRED = {
    "CORREL": (f"=CORREL({Q},{P})", f"corr({q_}, {p_})"), "PEARSON": (f"=PEARSON({P},{Q})", f"corr({p_}, {q_})"), "RSQ": (f"=RSQ({P},{Q})", f"regr_r2({p_}, {q_})"),
    "COVARIANCE.P": (f"=COVARIANCE.P({Q},{D})", f"covar_pop({q_}, {d_})"), "COVARIANCE.S": (f"=COVARIANCE.S({Q},{D})", f"covar_samp({q_}, {d_})"), "COVAR": (f"=COVAR({Q},{D})", f"covar_pop({q_}, {d_})"),
    "SLOPE": (f"=SLOPE({P},{Q})", f"regr_slope({p_}, {q_})"), "INTERCEPT": (f"=INTERCEPT({P},{Q})", f"regr_intercept({p_}, {q_})"), "FORECAST.LINEAR": (f"=FORECAST.LINEAR(30,{P},{Q})", f"regr_intercept({p_}, {q_}) + 30 * regr_slope({p_}, {q_})"),
    "STEYX": (f"=STEYX({P},{Q})", f"sqrt((regr_syy({p_}, {q_}) - regr_sxy({p_}, {q_}) ^ 2 / regr_sxx({p_}, {q_})) / (count(*) - 2))"),
    "SUMPRODUCT": (f"=SUMPRODUCT({Q},{D})", f"sum({q_} * {d_})"), "SUMXMY2": (f"=SUMXMY2({Q},{D})", f"sum(({q_} - {d_}) ^ 2)"), "SUMX2PY2": (f"=SUMX2PY2({Q},{D})", f"sum({q_} ^ 2 + {d_} ^ 2)"), "SUMX2MY2": (f"=SUMX2MY2({Q},{D})", f"sum({q_} ^ 2 - {d_} ^ 2)"),
    "PERCENTOF": (f"=PERCENTOF({D},{Q})", f"sum({d_}) / sum({q_})"),
}
SINGLE = {
    "SUMSQ": (f"=SUMSQ({Q})", f"sum({q_} * {q_})"), "DEVSQ": (f"=DEVSQ({Q})", f"var_pop({q_}) * count(*)"), "GEOMEAN": (f"=GEOMEAN({Q})", f"exp(avg(ln({q_})))"), "HARMEAN": (f"=HARMEAN({Q})", f"count(*) / sum(1 / {q_})"),
    "SKEW": (f"=SKEW({P})", f"skewness({p_})"), "KURT": (f"=KURT({P})", f"kurtosis({p_})"), "PERCENTILE.INC": (f"=PERCENTILE.INC({Q},0.9)", f"quantile_cont({q_}, 0.9)"), "PERCENTILE": (f"=PERCENTILE({P},0.25)", f"quantile_cont({p_}, 0.25)"), "QUARTILE.INC": (f"=QUARTILE.INC({Q},3)", f"quantile_cont({q_}, 0.75)"), "QUARTILE": (f"=QUARTILE({Q},1)", f"quantile_cont({q_}, 0.25)"),
    "LARGE": (f"=LARGE({P},7)", f"list_extract(max({p_}, 7), 7)"), "SMALL": (f"=SMALL({P},3)", f"list_extract(min({p_}, 3), 3)"), "COUNTA of UNIQUE": ("=COUNTA(UNIQUE(lineitem[l_shipdate]))", "count(DISTINCT l_shipdate)"), "ROWS of UNIQUE": (f"=ROWS(UNIQUE({Q}))*2", "count(DISTINCT l_quantity) * 2"), "COUNTBLANK": (f"=COUNTBLANK({Q})", "count(*) - count(l_quantity)"),
}


@query("column_pairs", listed({n: x for n, (_, x) in PAIRED.items()}, "lineitem", 3))
def column_pairs(spark, d):
    return table_of(engine(spark, d, "lineitem"), {n: f for n, (f, _) in PAIRED.items()}, 3)


@query("column_statistics", listed({n: x for n, (_, x) in SINGLE.items()}, "lineitem", 3))
def column_statistics(spark, d):
    return table_of(engine(spark, d, "lineitem"), {n: f for n, (f, _) in SINGLE.items()}, 3)


@query("trigonometry_family", "WITH t AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) / 1000 AS x FROM part) SELECT p_partkey, round(1 / tan(x), 6) AS cot, round(1 / cos(x), 6) AS sec, round(1 / sin(x), 6) AS csc, round(1 / tanh(x), 6) AS coth, round(1 / cosh(x), 6) AS sech, round(1 / sinh(x), 6) AS csch, round(pi() / 2 - atan(x), 6) AS acot, round(atanh(1 / (x + 1)), 6) AS acoth, round(acosh(x + 1), 6) AS acosh, round(atanh(x / 10), 6) AS atanh, round(sqrt(x * pi()), 6) AS sqrtpi, round(ln(x + 2) / ln(3), 6) AS log3, round(atanh(x / 10), 6) AS fisher, round(tanh(x), 6) AS fisherinv FROM t")
def trigonometry(spark, d):
    df = read(spark, d, "part").select("p_partkey", (F.col("p_retailprice").cast("double") / 1000).alias("x"))
    return columns_of(df, "p_partkey", {"cot": "=COT([@x])", "sec": "=SEC([@x])", "csc": "=CSC([@x])", "coth": "=COTH([@x])", "sech": "=SECH([@x])", "csch": "=CSCH([@x])", "acot": "=ACOT([@x])", "acoth": "=ACOTH([@x]+1)", "acosh": "=ACOSH([@x]+1)", "atanh": "=ATANH([@x]/10)", "sqrtpi": "=SQRTPI([@x])", "log3": "=LOG([@x]+2,3)", "fisher": "=FISHER([@x]/10)", "fisherinv": "=FISHERINV([@x])"})


@query("multiples_family", "WITH t AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS x FROM part) SELECT p_partkey, ceil(x / 0.5) * 0.5 AS up, floor(x / 7) * 7 AS down, -floor(x / 4) * 4 AS up_math, -ceil(x / 4) * 4 AS down_math, -ceil(x / 4) * 4 AS away_math, ceil(x / 8) * 8 AS precise, floor(x / 8) * 8 AS floor_precise, floor(x / 16 + 0.5) * 16 AS nearest, ceil(x / 2) * 2 AS even, ceil((x - 1) / 2) * 2 + 1 AS odd, CASE WHEN x >= 1000 THEN 1.0 ELSE 0.0 END AS step, CASE WHEN floor(x) = 1000 THEN 1.0 ELSE 0.0 END AS same FROM t")
def multiples(spark, d):
    df = read(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("x"))
    return columns_of(df, "p_partkey", {"up": "=CEILING([@x],0.5)", "down": "=FLOOR([@x],7)", "up_math": "=CEILING.MATH(-[@x],4)", "down_math": "=FLOOR.MATH(-[@x],4)", "away_math": "=CEILING.MATH(-[@x],4,1)", "precise": "=CEILING.PRECISE([@x],8)", "floor_precise": "=FLOOR.PRECISE([@x],8)", "nearest": "=MROUND([@x],16)", "even": "=EVEN([@x])", "odd": "=ODD([@x])", "step": "=GESTEP([@x],1000)", "same": "=DELTA(INT([@x]),1000)"})


@query("number_bases_family", "SELECT p_partkey, upper(to_base(p_partkey, 16)) AS hex, upper(to_base(p_partkey, 8)) AS oct, lpad(to_base(p_size, 2), 8, '0') AS bin, CAST(p_partkey AS DOUBLE) AS back, CAST(p_size AS DOUBLE) AS from_bin, CAST(p_partkey AS DOUBLE) AS from_oct, upper(to_base(p_size, 16)) AS bin2hex, to_base(p_size, 2) AS hex2bin, to_base(p_partkey, 8) AS hex2oct, upper(to_base(p_partkey, 16)) AS oct2hex, to_base(p_size, 8) AS bin2oct, to_base(p_size, 2) AS oct2bin, CAST(p_size * 8 AS DOUBLE) AS left_, CAST(p_size // 4 AS DOUBLE) AS right_ FROM part")
def number_bases(spark, d):
    df = read(spark, d, "part").select("p_partkey", "p_size")
    return columns_of(df, "p_partkey", {"hex": "=DEC2HEX([@p_partkey])", "oct": "=DEC2OCT([@p_partkey])", "bin": "=DEC2BIN([@p_size],8)", "back": "=HEX2DEC(DEC2HEX([@p_partkey]))", "from_bin": "=BIN2DEC(DEC2BIN([@p_size]))", "from_oct": "=OCT2DEC(DEC2OCT([@p_partkey]))", "bin2hex": "=BIN2HEX(DEC2BIN([@p_size]))", "hex2bin": "=HEX2BIN(DEC2HEX([@p_size]))", "hex2oct": "=HEX2OCT(DEC2HEX([@p_partkey]))", "oct2hex": "=OCT2HEX(DEC2OCT([@p_partkey]))", "bin2oct": "=BIN2OCT(DEC2BIN([@p_size]))", "oct2bin": "=OCT2BIN(DEC2OCT([@p_size]))", "left_": "=BITLSHIFT([@p_size],3)", "right_": "=BITRSHIFT([@p_size],2)"})


@query("calendar_family", "WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders) SELECT o_orderkey, CAST(isodow(x) AS DOUBLE) AS weekday2, CAST(dayofweek(x) + 1 AS DOUBLE) AS weekday1, CAST(isodow(x) - 1 AS DOUBLE) AS weekday3, CAST(weekofyear(x) AS DOUBLE) AS isoweek, CAST((dayofyear(x) - 1 + dayofweek(date_trunc('year', x))) // 7 + 1 AS DOUBLE) AS weeknum, CAST(date_diff('day', DATE '1899-12-30', last_day(x)) AS DOUBLE) AS month_end, round(3723 / 86400.0, 6) AS clock FROM t")
def calendar(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("x"))
    return columns_of(df, "o_orderkey", {"weekday2": "=WEEKDAY([@x],2)", "weekday1": "=WEEKDAY([@x])", "weekday3": "=WEEKDAY([@x],3)", "isoweek": "=WEEKNUM([@x],21)", "weeknum": "=WEEKNUM([@x])", "month_end": "=DATE(YEAR([@x]),MONTH([@x])+1,0)", "clock": "=TIME(1,2,3)"})


@query("text_parts_family", "SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS proper, split_part(c_name, '#', 1) AS before, split_part(c_name, '#', 2) AS after, CAST(ascii(c_mktsegment) AS DOUBLE) AS code, chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS char FROM customer")
def text_parts(spark, d):
    return columns_of(read(spark, d, "customer"), "c_custkey", {"proper": "=PROPER([@c_mktsegment])", "before": '=TEXTBEFORE([@c_name],"#")', "after": '=TEXTAFTER([@c_name],"#")', "code": "=CODE([@c_mktsegment])", "char": "=CHAR(65+MOD([@c_custkey],26))"})


@query("annuities_family", "WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS x FROM orders) SELECT o_orderkey, round(-(x * power(1.01, 12) + 100 * (power(1.01, 12) - 1) / 0.01), 4) AS fv, round(-(x * 1.02 * (power(1.02, 10) - 1) / 0.02) / power(1.02, 10), 4) AS pv, round(ln((-(x / 100) / 0.001) / (x - (x / 100) / 0.001)) / ln(1.001), 4) AS nper, round((x - x / 10) / 7, 4) AS sln, round((x - x / 10) * 5 * 2 / 30, 4) AS syd, round(power(1 + 0.05 / 12, 12) - 1, 4) AS effect, round((power(1.05, 1 / 4.0) - 1) * 4, 4) AS nominal, round(ln(2) / ln(1.03), 4) AS pduration FROM t")
def annuities(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("x"))
    return columns_of(df, "o_orderkey", {"fv": "=FV(0.01,12,100,[@x])", "pv": "=PV(0.02,10,[@x],0,1)", "nper": "=NPER(0.001,-[@x]/100,[@x])", "sln": "=SLN([@x],[@x]/10,7)", "syd": "=SYD([@x],[@x]/10,5,1)", "effect": "=EFFECT(0.05,12)", "nominal": "=NOMINAL(0.05,4)", "pduration": "=PDURATION(0.03,[@x],2*[@x])"}, 4)


@query("densities_family", "WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) / 10 AS x FROM lineitem) SELECT id, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) AS phi, round((x - 2) / 1.5, 6) AS z, round(1 - exp(-0.7 * x), 6) AS expon, round(0.7 * exp(-0.7 * x), 6) AS expon_density, round(1 - exp(-power(x / 2, 1.5)), 6) AS weibull, round(1.5 / power(2, 1.5) * power(x, 0.5) * exp(-power(x / 2, 1.5)), 6) AS weibull_density FROM t")
def densities(spark, d):
    df = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity").cast("double") / 10).alias("x"))
    return columns_of(df, "id", {"phi": "=PHI([@x])", "z": "=STANDARDIZE([@x],2,1.5)", "expon": "=EXPON.DIST([@x],0.7,TRUE)", "expon_density": "=EXPON.DIST([@x],0.7,FALSE)", "weibull": "=WEIBULL.DIST([@x],1.5,2,TRUE)", "weibull_density": "=WEIBULL.DIST([@x],1.5,2,FALSE)"})


@query("groupby_filter", "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def groupby_filter(spark, d):
    return rounded(engine(spark, d, "lineitem").query("=GROUPBY(lineitem[l_returnflag],lineitem[l_quantity],SUM,,0,,lineitem[l_quantity]>25)"), "l_quantity")


@query("take_columns", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5")
def take_columns(spark, d):
    return engine(spark, d, "nation").query("=TAKE(nation[[n_nationkey]:[n_name]],5,2)")
