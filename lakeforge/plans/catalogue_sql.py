"""(dialect, DuckDB) by query name; None: the same text serves both."""

QUERIES: dict[str, tuple[str, str | None]] = {
    # scans, projections, filters
    "flagship": (
        "SELECT event_type, count() AS n, quantile(0.95)(value) AS p95, max(value) AS most FROM events WHERE value > 10 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5",
        "SELECT event_type, count(*) AS n, quantile_cont(value, 0.95) AS p95, max(value) AS most FROM events WHERE value > 10 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5",
    ),
    "scan_project": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < '1996-01-01'", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'"),
    "index_lookup": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 100, 1000)", None),
    "metadata_aggregate": ("SELECT count() AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders", "SELECT count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders"),
    "values_rows": ("SELECT c1, c2, c3 FROM (VALUES (1, 'a', 1.5), (2, 'b', 2.25), (3, NULL, 0.125)) AS v", "SELECT * FROM (VALUES (1, 'a', 1.500::DECIMAL(4,3)), (2, 'b', 2.250), (3, NULL, 0.125)) AS v(c1, c2, c3)"),
    "empty_relation": ("SELECT r_name FROM region WHERE 1 = 0", None),
    "select_without_from": ("SELECT 1 AS one, 'x' AS x, 2 + 3 AS five", None),
    "alias_in_where": ("SELECT l_quantity * 2 AS double_quantity, double_quantity + 1 AS more FROM lineitem WHERE double_quantity > 90", "SELECT l_quantity * 2 AS double_quantity, l_quantity * 2 + 1 AS more FROM lineitem WHERE l_quantity * 2 > 90"),
    "prewhere": ("SELECT event_id, value FROM events PREWHERE event_type = 'click' WHERE value > 50", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50"),
    "comparisons": ("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_size != 15 AND p_size <> 12 AND NOT p_size = 13 AND p_retailprice < 1500", None),
    "kleene_logic": ("SELECT c_custkey, xor(c_acctbal > 0, c_nationkey > 10) AS x, nullIf(c_nationkey, 3) = 3 OR c_acctbal > 0 AS y FROM customer", "SELECT c_custkey, (c_acctbal > 0) <> (c_nationkey > 10) AS x, nullif(c_nationkey, 3) = 3 OR c_acctbal > 0 AS y FROM customer"),
    "is_null": ("SELECT count() AS n FROM (SELECT nullIf(n_regionkey, 2) AS k FROM nation) AS t WHERE k IS NULL OR isNotNull(k) AND k > 3", "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 2) AS k FROM nation) AS t WHERE k IS NULL OR k IS NOT NULL AND k > 3"),
    "in_and_between": ("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 3) OR n_nationkey BETWEEN 20 AND 22 OR n_nationkey NOT BETWEEN 1 AND 24", None),
    "like_ilike": ("SELECT p_partkey FROM part WHERE p_name LIKE '%in%' AND p_name NOT LIKE 'z%' AND p_type ILIKE '%small%'", None),
    "case_forms": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", None),
    "casts": ("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS Int32) AS q, l_extendedprice::Decimal(18,2) AS p, CAST(l_shipdate AS Date) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INT) AS q, l_extendedprice::DECIMAL(18,2) AS p, CAST(l_shipdate AS DATE) AS d FROM lineitem"),
    "arithmetic": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_partkey / 7 AS q, l_partkey DIV 7 AS d, l_partkey % 7 AS m, l_suppkey / (l_linenumber - 1) AS z, l_partkey % (l_linenumber - 1) AS zm, -l_linenumber AS neg FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_partkey / 7 AS q, l_partkey // 7 AS d, l_partkey % 7 AS m, l_suppkey / nullif(l_linenumber - 1, 0) AS z, l_partkey % nullif(l_linenumber - 1, 0) AS zm, -l_linenumber AS neg FROM lineitem",
    ),
    "concat_operator": ("SELECT n_name || '/' || n_nationkey AS s FROM nation", None),
    "interval_arithmetic": ("SELECT o_orderkey, toDate(o_orderdate) + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 3 HOUR AS h FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, o_orderdate - INTERVAL 3 HOUR AS h FROM orders"),
    # joins
    "join_inner": ("SELECT c.c_custkey, n.n_name FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 5000", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000", None),
    "join_right": ("SELECT r.r_name, n.n_name FROM nation AS n RIGHT JOIN region AS r ON r.r_regionkey = n.n_regionkey AND n.n_nationkey < 10", None),
    "join_full": ("SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation AS a FULL OUTER JOIN supplier AS b ON a.n_nationkey = b.s_suppkey", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n", None),
    "join_comma": ("SELECT n.n_name, r.r_name FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey", None),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_non_equi": ("SELECT r.r_regionkey AS r, n.n_nationkey AS n FROM region AS r LEFT JOIN nation AS n ON r.r_regionkey > n.n_nationkey", None),
    "join_using": ("SELECT k, a.v AS av, b.w AS bw FROM (SELECT n_regionkey AS k, count() AS v FROM nation GROUP BY n_regionkey) AS a FULL JOIN (SELECT r_regionkey + 2 AS k, r_name AS w FROM region) AS b USING (k)", "SELECT k, a.v AS av, b.w AS bw FROM (SELECT n_regionkey AS k, count(*) AS v FROM nation GROUP BY n_regionkey) AS a FULL JOIN (SELECT r_regionkey + 2 AS k, r_name AS w FROM region) AS b USING (k)"),
    "join_star_chain": ("SELECT r.r_name AS region, sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", None),
    "join_parenthesised": ("SELECT c.c_custkey, r.r_name FROM customer AS c JOIN (nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey", None),
    "join_null_keys": ("SELECT a.n_nationkey, b.n_nationkey AS other FROM nation AS a LEFT JOIN nation AS b ON nullIf(a.n_nationkey, 3) = nullIf(b.n_nationkey, 4)", "SELECT a.n_nationkey, b.n_nationkey AS other FROM nation AS a LEFT JOIN nation AS b ON nullif(a.n_nationkey, 3) = nullif(b.n_nationkey, 4)"),
    "semi_join": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "anti_join": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    # aggregates
    "global_sum": ("SELECT sum(l_extendedprice) AS s, count() AS n FROM lineitem WHERE l_quantity > 10", "SELECT sum(l_extendedprice) AS s, count(*) AS n FROM lineitem WHERE l_quantity > 10"),
    "group_by": ("SELECT l_returnflag, l_linestatus, count() AS n, sum(l_quantity) AS q, avg(l_extendedprice) AS p, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, avg(l_extendedprice) AS p, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "global_aggregate_empty": ("SELECT count() AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo FROM lineitem WHERE l_orderkey < 0", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo FROM lineitem WHERE l_orderkey < 0"),
    "distinct_aggregates": ("SELECT event_type, count(DISTINCT user_id) AS users, sum(DISTINCT user_id) AS s, uniqExact(user_id) AS u FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users, CAST(sum(DISTINCT user_id) AS BIGINT) AS s, count(DISTINCT user_id) AS u FROM events GROUP BY event_type"),
    "group_by_expression": ("SELECT toYear(o_orderdate) AS y, count() AS n FROM orders GROUP BY y", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "group_by_ordinal": ("SELECT o_orderstatus, o_orderpriority, count() AS n FROM orders GROUP BY 1, 2", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"),
    "having": ("SELECT user_id, count() AS n FROM events GROUP BY user_id HAVING n > 3", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 3"),
    "having_without_group": ("SELECT n_name FROM nation HAVING n_regionkey = 2", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "rollup": ("SELECT l_returnflag AS a, l_linestatus AS b, sum(l_quantity) AS q, GROUPING(a, b) AS g FROM lineitem GROUP BY ROLLUP(a, b)", "SELECT l_returnflag AS a, l_linestatus AS b, sum(l_quantity) AS q, GROUPING(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)"),
    "cube": ("SELECT nullIf(l_returnflag, 'A') AS a, l_linestatus AS b, count() AS n, GROUPING(a) AS ga FROM lineitem GROUP BY CUBE(a, b)", "SELECT a, b, count(*) AS n, GROUPING(a) AS ga FROM (SELECT nullif(l_returnflag, 'A') AS a, l_linestatus AS b FROM lineitem) GROUP BY CUBE(a, b)"),
    "grouping_sets": ("SELECT o_orderstatus AS a, o_orderpriority AS b, count() AS n FROM orders GROUP BY GROUPING SETS ((a, b), (a), (a), ())", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderstatus), ())"),
    "group_by_mixed_sets": ("SELECT o_orderstatus AS a, o_orderpriority AS b, count() AS n FROM orders GROUP BY a, ROLLUP(b)", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY o_orderstatus, ROLLUP(o_orderpriority)"),
    "argmin_argmax": ("SELECT c_nationkey, argMin(c_custkey, c_custkey * 7 % 1501) AS lo, argMax(c_name, c_custkey) AS hi FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_custkey, c_custkey * 7 % 1501) AS lo, arg_max(c_name, c_custkey) AS hi FROM customer GROUP BY c_nationkey"),
    "any_of_constant_groups": ("SELECT r_regionkey, any(r_name) AS a, anyLast(r_name) AS b FROM region GROUP BY r_regionkey", "SELECT r_regionkey, any_value(r_name) AS a, last(r_name) AS b FROM region GROUP BY r_regionkey"),
    "uniq_within_error": ("SELECT abs(uniq(user_id) - uniqExact(user_id)) <= 0.03 * uniqExact(user_id) AS close FROM events", "SELECT true AS close"),
    "uniq_empty_and_windowed": ("SELECT r_name, uniq(r_name) OVER (PARTITION BY r_regionkey) AS one, (SELECT uniq(r_name) FROM region WHERE r_regionkey > 99) AS none, (SELECT uniqIf(r_name, r_regionkey > 2) FROM region) AS two FROM region", "SELECT r_name, 1 AS one, 0 AS none, 2 AS two FROM region"),
    "group_array": ("SELECT r_regionkey, groupArray(r_name) AS names, groupArray(1)(r_name) AS one FROM region GROUP BY r_regionkey", "SELECT r_regionkey, string_agg(r_name, ',') AS names, string_agg(r_name, ',') AS one FROM region GROUP BY r_regionkey"),
    "quantiles": ("SELECT l_returnflag, quantile(0.9)(l_extendedprice) AS q9, quantile(l_extendedprice) AS q5, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.9) AS q9, quantile_cont(l_extendedprice, 0.5) AS q5, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag"),
    "quantile_exact": ("SELECT p_brand, quantileExact(0.95)(p_size) AS q95, quantileExact(p_size) AS q50 FROM part GROUP BY p_brand", "SELECT p_brand, CAST(list_sort(list(p_size))[least(CAST(floor(0.95 * count(*)) AS INT), count(*) - 1) + 1] AS DOUBLE) AS q95, CAST(list_sort(list(p_size))[least(CAST(floor(0.5 * count(*)) AS INT), count(*) - 1) + 1] AS DOUBLE) AS q50 FROM part GROUP BY p_brand"),
    "variances": ("SELECT p_brand, round(varPop(p_size), 6) AS vp, round(varSamp(p_size), 6) AS vs, round(stddevPop(p_size), 6) AS sp, round(stddev_samp(p_size), 6) AS ss FROM part GROUP BY p_brand", "SELECT p_brand, round_even(var_pop(p_size), 6) AS vp, round_even(var_samp(p_size), 6) AS vs, round_even(stddev_pop(p_size), 6) AS sp, round_even(stddev_samp(p_size), 6) AS ss FROM part GROUP BY p_brand"),
    "if_combinators": (
        "SELECT l_returnflag, countIf(l_quantity > 25) AS c, sumIf(l_linenumber, l_quantity > 25) AS s, avgIf(l_linenumber, l_quantity > 25) AS a, minIf(l_partkey, l_quantity > 49) AS lo, maxIf(l_partkey, l_quantity > 49) AS hi, uniqExactIf(l_suppkey, l_quantity > 45) AS u, quantileIf(l_quantity, l_tax > 0.02) AS q, medianIf(l_quantity, l_tax > 0.02) AS m, argMaxIf(l_partkey, 0 - l_partkey, l_tax > 0.02) AS am FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS c, CAST(sum(l_linenumber) FILTER (l_quantity > 25) AS BIGINT) AS s, avg(l_linenumber) FILTER (l_quantity > 25) AS a, min(l_partkey) FILTER (l_quantity > 49) AS lo, max(l_partkey) FILTER (l_quantity > 49) AS hi, count(DISTINCT l_suppkey) FILTER (l_quantity > 45) AS u, quantile_cont(l_quantity, 0.5) FILTER (l_tax > 0.02) AS q, median(l_quantity) FILTER (l_tax > 0.02) AS m, arg_max(l_partkey, 0 - l_partkey) FILTER (l_tax > 0.02) AS am FROM lineitem GROUP BY l_returnflag",
    ),
    "decimal_aggregates": ("SELECT l_returnflag, sum(l_extendedprice::Decimal(18,2)) AS s, avg(l_extendedprice::Decimal(18,2)) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DECIMAL(18,2)) AS s, CAST(CAST((CAST(sum(l_extendedprice::DECIMAL(18,2)) * 1000000 AS HUGEINT) * 2 + 1 * count(*)) // (2 * count(*)) AS DECIMAL(24,0)) * 0.000001 AS DECIMAL(18,6)) AS a FROM lineitem GROUP BY l_returnflag"),
    "decimal_arithmetic": ("SELECT p_partkey, p_retailprice::Decimal(18,2) * 0.07 AS t, p_retailprice::Decimal(18,2) + 1.005 AS u, p_retailprice::Decimal(18,2) % 7 AS m FROM part", "SELECT p_partkey, CAST(p_retailprice::DECIMAL(18,2) * 0.07 AS DECIMAL(18,4)) AS t, CAST(p_retailprice::DECIMAL(18,2) + 1.005 AS DECIMAL(18,3)) AS u, CAST(p_retailprice::DECIMAL(18,2) % 7 AS DECIMAL(18,2)) AS m FROM part"),
    "decimal_quantiles": (
        "SELECT l_returnflag, quantileExact(0.9)(1234567890000000 + l_extendedprice::Decimal(18,2)) AS e, quantile(0.3)(123456789012 + l_extendedprice::Decimal(18,2)) AS q, median(l_quantity::Decimal(18,2)) AS m, quantileExactIf(l_tax::Decimal(18,2), l_quantity > 25) AS i FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, list_sort(list(1234567890000000 + l_extendedprice::DECIMAL(18,2)))[least(CAST(floor(0.9 * count(*)) AS INT), count(*) - 1) + 1] AS e, CAST(list_sort(list(123456789012 + l_extendedprice::DECIMAL(18,2)))[(3 * (count(*) - 1)) // 10 + 1] + CAST((list_sort(list(123456789012 + l_extendedprice::DECIMAL(18,2)))[((3 * (count(*) - 1)) + 9) // 10 + 1] - list_sort(list(123456789012 + l_extendedprice::DECIMAL(18,2)))[(3 * (count(*) - 1)) // 10 + 1]) * CAST((3 * (count(*) - 1)) % 10 AS DECIMAL(4,0)) * 0.1 AS DECIMAL(24,6)) AS DECIMAL(18,6)) AS q, CAST(median(l_quantity) AS DECIMAL(18,6)) AS m, list_sort(list(l_tax::DECIMAL(18,2)) FILTER (l_quantity > 25))[least(CAST(floor(0.5 * count(*) FILTER (l_quantity > 25)) AS INT), count(*) FILTER (l_quantity > 25) - 1) + 1] AS i FROM lineitem GROUP BY l_returnflag",
    ),
    "distinct_quantiles": (
        "SELECT p_brand, quantile(0.5)(DISTINCT p_size) AS q, median(DISTINCT p_size) AS m, quantileExact(0.25)(DISTINCT p_size) AS e, uniqExact(DISTINCT p_size) AS u, groupArray(DISTINCT p_brand) AS g, uniq(DISTINCT p_brand) AS n FROM part GROUP BY p_brand",
        "WITH d AS (SELECT DISTINCT p_brand, p_size FROM part) SELECT p_brand, quantile_cont(p_size, 0.5) AS q, median(p_size) AS m, CAST(list_sort(list(p_size))[least(CAST(floor(0.25 * count(*)) AS INT), count(*) - 1) + 1] AS DOUBLE) AS e, count(*) AS u, p_brand AS g, 1 AS n FROM d GROUP BY p_brand",
    ),
    "more_if_combinators": (
        "SELECT l_returnflag, round(varPopIf(l_quantity, l_tax > 0.02), 6) AS vp, round(varSampIf(l_quantity, l_tax > 0.02), 6) AS vs, round(stddevPopIf(l_quantity, l_tax > 0.02), 6) AS sp, round(stddevSampIf(l_quantity, l_tax > 0.02), 6) AS ss, quantileExactIf(0.75)(l_quantity, l_tax > 0.02) AS qe, argMinIf(l_returnflag, l_orderkey, l_tax > 0.02) AS am, anyIf(l_returnflag, l_tax > 0.02) AS an, anyLastIf(l_returnflag, l_tax > 0.02) AS al, groupArrayIf(1)(l_returnflag, l_tax > 0.02) AS ga FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round_even(var_pop(l_quantity) FILTER (l_tax > 0.02), 6) AS vp, round_even(var_samp(l_quantity) FILTER (l_tax > 0.02), 6) AS vs, round_even(stddev_pop(l_quantity) FILTER (l_tax > 0.02), 6) AS sp, round_even(stddev_samp(l_quantity) FILTER (l_tax > 0.02), 6) AS ss, list_sort(list(l_quantity) FILTER (l_tax > 0.02))[least(CAST(floor(0.75 * count(*) FILTER (l_tax > 0.02)) AS INT), count(*) FILTER (l_tax > 0.02) - 1) + 1] AS qe, l_returnflag AS am, l_returnflag AS an, l_returnflag AS al, l_returnflag AS ga FROM lineitem GROUP BY l_returnflag",
    ),
    "arithmetic_functions": (
        "SELECT p_partkey, negate(p_size) AS a, plus(p_size, 2) AS b, minus(p_size, 60) AS c, multiply(p_size, 3) AS d, divide(p_size, 4) AS e, divide(p_size, 0) AS z, ceiling(p_retailprice) AS f, round(log(p_size), 9) AS g, power(p_size, 3) AS h FROM part",
        "SELECT p_partkey, -p_size AS a, p_size + 2 AS b, p_size - 60 AS c, p_size * 3 AS d, p_size / 4 AS e, NULL::DOUBLE AS z, ceil(p_retailprice) AS f, round_even(ln(p_size), 9) AS g, pow(p_size, 3) AS h FROM part",
    ),
    "more_string_functions": (
        "SELECT p_partkey, character_length(p_name) AS a, trimBoth(concat('  ', p_name, ' ')) AS b, trimLeft(concat('  ', p_brand)) AS c, rtrim(concat(p_brand, '  ')) AS d, repeat(p_brand, 2) AS e, repeat(p_brand, -1) AS f FROM part",
        "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS a, trim(p_name) AS b, p_brand AS c, p_brand AS d, p_brand || p_brand AS e, '' AS f FROM part",
    ),
    "wide_conversions": (
        "SELECT n_nationkey, toInt64(1e30) AS a, toInt64(-1e30) AS b, toUInt64(n_nationkey - 3) AS c, toUInt64(-2.5e0) AS d, toUInt64('18446744073709551615') IS NULL AS e, toInt32(3e9) AS f, toUInt32(4294967297) AS g, toInt64('1e30') AS h, toInt64('-7.9') AS i, toInt64('nan') AS j, toInt64(-12.9) AS k FROM nation",
        "SELECT n_nationkey, 9223372036854775807 AS a, CAST('-9223372036854775808' AS BIGINT) AS b, CASE WHEN n_nationkey < 3 THEN 18446744073709551616::HUGEINT + n_nationkey - 3 ELSE (n_nationkey - 3)::HUGEINT END AS c, 0 AS d, false AS e, 3000000000 - 4294967296 AS f, 1 AS g, 9223372036854775807 AS h, -7 AS i, NULL::BIGINT AS j, -12 AS k FROM nation",
    ),
    "more_date_shifts": (
        "SELECT o_orderkey, addMinutes(o_orderdate, 90) AS a, addWeeks(toDate(o_orderdate), 3) AS b, addQuarters(toDate(o_orderdate), 2) AS c, subtractSeconds(o_orderdate, 5) AS d, subtractHours(o_orderdate, 30) AS e, subtractDays(toDate(o_orderdate), 9) AS f, subtractMonths(toDate(o_orderdate), 1) AS g, subtractYears(toDate(o_orderdate), 1) AS h FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 90 MINUTE AS a, CAST(o_orderdate AS DATE) + 21 AS b, CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE) AS c, o_orderdate - INTERVAL 5 SECOND AS d, o_orderdate - INTERVAL 30 HOUR AS e, CAST(o_orderdate AS DATE) - 9 AS f, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS g, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS h FROM orders",
    ),
    "differences_before_1970": (
        "SELECT n_nationkey, date_diff('hour', toDateTime('1969-12-31 23:30:00'), toDateTime('1970-01-01 00:30:00')) AS h, date_diff('minute', toDateTime('1969-12-31 23:59:30'), toDateTime('1970-01-01 00:00:30')) AS m, date_diff('second', toDateTime('1969-12-31 23:59:30'), toDateTime('1970-01-01 00:00:30')) AS s, dateDiff('hour', toDateTime('1960-01-01 05:59:59'), toDateTime('1960-01-01 06:00:00')) AS o FROM nation",
        "SELECT n_nationkey, 1 AS h, 1 AS m, 60 AS s, 1 AS o FROM nation",
    ),
    "now_and_random": (
        "SELECT n_nationkey, now() >= toDateTime('2024-01-01 00:00:00') AS a, today() >= toDate('2024-01-01') AS b, toDate(now()) = today() AS c, rand64() >= 0 AS d FROM nation",
        "SELECT n_nationkey, true AS a, true AS b, true AS c, true AS d FROM nation",
    ),
    "cte_in_subqueries": (
        "SELECT n_name FROM nation WHERE n_regionkey IN (WITH a AS (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 3) SELECT k FROM a) AND n_nationkey IN (WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 4) SELECT k FROM a)",
        "SELECT n_name FROM nation WHERE n_regionkey < 3 AND n_nationkey > 4",
    ),
    "group_array_of_groups": (
        "SELECT r, groupArray(n_name) AS names FROM (SELECT n_regionkey AS r, n_name FROM nation WHERE n_nationkey < 5) AS t GROUP BY r HAVING count() = 1",
        "SELECT n_regionkey AS r, min(n_name) AS names FROM nation WHERE n_nationkey < 5 GROUP BY n_regionkey HAVING count(*) = 1",
    ),
    # windows
    "window_ranking": (
        "SELECT event_id, row_number() OVER w AS rn, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, ntile(3) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
        None,
    ),
    "window_offsets": ("SELECT event_id, lag(value) OVER w AS a, lag(value, 2, 0.0) OVER w AS b, lead(value, 1) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", None),
    "window_values": ("SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)", None),
    "window_aggregates": ("SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS s, count(*) OVER (PARTITION BY user_id) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS m FROM events", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS s, count(*) OVER (PARTITION BY user_id) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS m FROM events"),
    "window_range_peers": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_type) AS n, count(*) OVER (PARTITION BY user_id ORDER BY event_type RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM events", None),
    "window_inherited": ("SELECT event_id, sum(event_id) OVER (w ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events WINDOW w AS (PARTITION BY event_type)", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM events"),
    "window_over_aggregate": ("SELECT event_type, count() AS n, rank() OVER (ORDER BY count() DESC) AS r, sum(count()) OVER () AS total FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events GROUP BY event_type"),
    "window_if_combinator": ("SELECT event_id, countIf(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS n, sumIf(event_id, event_type = 'click') OVER (PARTITION BY user_id) AS s FROM events", "SELECT event_id, count(CASE WHEN value > 50 THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n, CAST(sum(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id) AS BIGINT) AS s FROM events"),
    # scalars
    "math_functions": (
        "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice, 1) AS r, round(p_size / 2) AS h, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(sqrt(p_size), 9) AS s, round(exp(p_size / 50), 9) AS e, round(ln(p_size), 9) AS l, round(log2(p_size), 9) AS l2, round(log10(p_size), 9) AS l10, pow(p_size, 2) AS p, sign(p_size - 25) AS g, intDiv(p_size, 7) AS d, modulo(p_size, 7) AS m FROM part",
        "SELECT p_partkey, abs(p_size - 25) AS a, round_even(p_retailprice, 1) AS r, round_even(p_size / 2, 0) AS h, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round_even(sqrt(p_size), 9) AS s, round_even(exp(p_size / 50), 9) AS e, round_even(ln(p_size), 9) AS l, round_even(log2(p_size), 9) AS l2, round_even(log10(p_size), 9) AS l10, pow(p_size, 2) AS p, CAST(sign(p_size - 25) AS TINYINT) AS g, CAST(p_size // 7 AS BIGINT) AS d, CAST(p_size % 7 AS BIGINT) AS m FROM part",
    ),
    "null_poisoned_extremes": ("SELECT n_nationkey, greatest(n_nationkey, nullIf(n_regionkey, 2)) AS g, least(n_nationkey, 5, n_regionkey) AS l FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE greatest(n_nationkey, n_regionkey) END AS g, least(n_nationkey, 5, n_regionkey) AS l FROM nation"),
    "string_functions": (
        "SELECT doc_id, length(text) AS b, lengthUTF8(text) AS c, lower(substring(text, 1, 20)) AS lo, upper(substring(text, -20)) AS up, substring(text, 3, -5) AS cut, lowerUTF8(substring(text, 1, 9)) AS lu, reverse(substring(text, 1, 5)) AS rv, position(text, 'e') AS p, startsWith(text, 'T') AS st, endsWith(text, '.') AS en, splitByChar(' ', text) AS first, replaceAll(substring(text, 1, 30), 'e', 'E') AS re, repeat(lang, 3) AS rp, leftPad(lang, 5, '*') AS lp, rightPad(lang, 1) AS rr, concat(lang, '-', source) AS cc, trim(concat('  ', lang, ' ')) AS tr FROM documents",
        "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS b, length(text) AS c, translate(substring(text, 1, 20), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo, translate(right(text, 20), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, substring(text, 3, greatest(length(text) - 7, 0)) AS cut, lower(substring(text, 1, 9)) AS lu, reverse(substring(text, 1, 5)) AS rv, CAST(instr(text, 'e') AS BIGINT) AS p, starts_with(text, 'T') AS st, ends_with(text, '.') AS en, split_part(text, ' ', 1) AS first, replace(substring(text, 1, 30), 'e', 'E') AS re, repeat(lang, 3) AS rp, lpad(lang, 5, '*') AS lp, substring(lang, 1, 1) AS rr, concat(lang, '-', source) AS cc, lang AS tr FROM documents",
    ),
    "string_aliases": (
        "SELECT doc_id, substr(text, 2, 5) AS a, mid(text, -4, 2) AS b, ltrim(concat('  ', lang)) AS c, trimRight(concat(lang, '  ')) AS d, lcase(substringUTF8(text, 0, 6)) AS e, ucase(lang) AS f, char_length(source) AS g, replace(lang, 'e', '') AS h, leftPad(lang, 1) AS i, upperUTF8(lang) AS j, positionUTF8(text, 'zzzz') AS k FROM documents",
        "SELECT doc_id, substring(text, 2, 5) AS a, substring(text, -4, 2) AS b, lang AS c, lang AS d, translate(substring(text, 1, 6), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS e, upper(lang) AS f, length(source) AS g, replace(lang, 'e', '') AS h, substring(lang, 1, 1) AS i, upper(lang) AS j, CAST(instr(text, 'zzzz') AS BIGINT) AS k FROM documents",
    ),
    "window_moving_average": ("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS a, varPop(event_id) OVER (PARTITION BY user_id) >= 0 AS v, argMax(event_type, event_id) OVER (PARTITION BY user_id) AS m FROM events", "SELECT event_id, round_even(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS a, true AS v, arg_max(event_type, event_id) OVER (PARTITION BY user_id) AS m FROM events"),
    "like_functions": ("SELECT p_partkey, like(p_name, '%a%') AS a, notLike(p_name, '%a%') AS b, ilike(p_name, '%A%') AS c, notILike(p_name, '%A%') AS d FROM part", "SELECT p_partkey, p_name LIKE '%a%' AS a, p_name NOT LIKE '%a%' AS b, p_name ILIKE '%A%' AS c, p_name NOT ILIKE '%A%' AS d FROM part"),
    "conversions": (
        "SELECT p_partkey, toString(p_size) AS s, toInt32(p_retailprice) AS i, toInt64('42') AS j, toInt64('3.9') AS k, toInt64(p_name) AS bad, toFloat64('2.5') AS f, toUInt32(p_size - 60) AS w, toDate('2024-02-29') AS d, toDate(p_size) AS dn, toDateTime('2024-02-29 12:30:00') AS t, toString(toFloat64(p_size)) AS fs FROM part",
        "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(trunc(p_retailprice) AS BIGINT) AS i, 42::BIGINT AS j, 3::BIGINT AS k, NULL::BIGINT AS bad, 2.5::DOUBLE AS f, CASE WHEN p_size < 60 THEN p_size - 60 + 4294967296 ELSE p_size - 60 END AS w, DATE '2024-02-29' AS d, DATE '1970-01-01' + p_size AS dn, TIMESTAMP '2024-02-29 12:30:00' AS t, CAST(p_size AS VARCHAR) AS fs FROM part",
    ),
    "date_parts": (
        "SELECT event_id, toYear(ts) AS y, toMonth(ts) AS m, toDayOfMonth(ts) AS d, toQuarter(ts) AS q, toHour(ts) AS h, toMinute(ts) AS mi, toSecond(ts) AS s, toDayOfYear(ts) AS dy, toDayOfWeek(ts) AS dw, toUnixTimestamp(ts) AS u FROM events",
        "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(quarter(ts) AS INT) AS q, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, CAST(dayofyear(ts) AS INT) AS dy, CAST(isodow(ts) AS INT) AS dw, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events",
    ),
    "date_starts": (
        "SELECT event_id, toStartOfDay(ts) AS d, toStartOfHour(ts) AS h, toStartOfMinute(ts) AS mi, toStartOfMonth(ts) AS m, toStartOfQuarter(ts) AS q, toStartOfYear(ts) AS y, toMonday(ts) AS w FROM events",
        "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS mi, CAST(date_trunc('month', ts) AS DATE) AS m, CAST(date_trunc('quarter', ts) AS DATE) AS q, CAST(date_trunc('year', ts) AS DATE) AS y, CAST(date_trunc('week', ts) AS DATE) AS w FROM events",
    ),
    "date_differences": (
        "SELECT o_orderkey, dateDiff('day', toDateTime('1995-06-17 00:00:00'), o_orderdate) AS d, dateDiff('month', toDateTime('1995-06-17 00:00:00'), o_orderdate) AS m, dateDiff('year', toDateTime('1995-06-17 00:00:00'), o_orderdate) AS y, dateDiff('week', toDateTime('1995-06-17 00:00:00'), o_orderdate) AS w, dateDiff('hour', toDateTime('1995-06-17 00:00:00'), o_orderdate) AS h, dateDiff('quarter', toDateTime('1995-06-17 00:00:00'), o_orderdate) AS q FROM orders",
        "SELECT o_orderkey, date_diff('day', TIMESTAMP '1995-06-17', o_orderdate) AS d, date_diff('month', TIMESTAMP '1995-06-17', o_orderdate) AS m, date_diff('year', TIMESTAMP '1995-06-17', o_orderdate) AS y, CAST(date_trunc('week', o_orderdate)::DATE - date_trunc('week', TIMESTAMP '1995-06-17')::DATE AS BIGINT) // 7 AS w, date_diff('hour', TIMESTAMP '1995-06-17', o_orderdate) AS h, date_diff('quarter', TIMESTAMP '1995-06-17', o_orderdate) AS q FROM orders",
    ),
    "date_shifts": (
        "SELECT o_orderkey, addDays(toDate(o_orderdate), 40) AS d, addMonths(toDate(o_orderdate), 1) AS m, addYears(toDate(o_orderdate), -1) AS y, addHours(o_orderdate, 5) AS h, subtractWeeks(toDate(o_orderdate), 2) AS w, subtractQuarters(toDate(o_orderdate), 1) AS q, addSeconds(o_orderdate, 61) AS s, subtractMinutes(o_orderdate, 61) AS mi FROM orders",
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 40 AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS y, o_orderdate + INTERVAL 5 HOUR AS h, CAST(o_orderdate AS DATE) - 14 AS w, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS q, o_orderdate + INTERVAL 61 SECOND AS s, o_orderdate - INTERVAL 61 MINUTE AS mi FROM orders",
    ),
    "null_functions": ("SELECT n_nationkey, ifNull(nullIf(n_regionkey, 1), 99) AS a, coalesce(nullIf(n_regionkey, 1), nullIf(n_regionkey, 2), 7) AS b, assumeNotNull(nullIf(n_regionkey, 1)) AS c, isNull(nullIf(n_regionkey, 1)) AS d FROM nation", "SELECT n_nationkey, ifnull(nullif(n_regionkey, 1), 99) AS a, coalesce(nullif(n_regionkey, 1), nullif(n_regionkey, 2), 7) AS b, coalesce(nullif(n_regionkey, 1), 0) AS c, n_regionkey = 1 AS d FROM nation"),
    "logic_functions": ("SELECT n_nationkey, if(n_regionkey > 2, 'hi', 'lo') AS a, not(n_regionkey > 2) AS b, and(n_regionkey > 0, n_regionkey < 3, n_nationkey > 4) AS c, or(n_regionkey = 0, n_regionkey = 4) AS d FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS a, NOT n_regionkey > 2 AS b, n_regionkey > 0 AND n_regionkey < 3 AND n_nationkey > 4 AS c, n_regionkey = 0 OR n_regionkey = 4 AS d FROM nation"),
    "hash_functions": ("SELECT count(DISTINCT h) AS n, min(r) >= 0 AS r, count() AS m FROM (SELECT cityHash64(n_name) AS h, rand() AS r FROM nation) AS t", "SELECT count(DISTINCT n_name) AS n, true AS r, count(*) AS m FROM nation"),
    # sorts and limits
    "order_by_keys": ("SELECT n_nationkey, nullIf(n_regionkey, 2) AS k FROM nation ORDER BY k DESC NULLS FIRST, n_name LIMIT 12", "SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k DESC NULLS FIRST, n_name LIMIT 12"),
    "order_by_default_nulls": ("SELECT n_nationkey, nullIf(n_regionkey, 2) AS k FROM nation ORDER BY k, 1 LIMIT 7", "SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k NULLS FIRST, n_nationkey LIMIT 7"),
    "top_k": ("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", None),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    "offset_only": ("SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "limit_by": ("SELECT c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 2 BY c_nationkey", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2"),
    "limit_by_and_limit": ("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_custkey LIMIT 1 BY c_nationkey, c_mktsegment LIMIT 10", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= 1 ORDER BY c_custkey LIMIT 10"),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderstatus, o_orderpriority", None),
    # set operations
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "union_distinct": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region", None),
    "intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", None),
    "intersect_all": ("SELECT nullIf(n_regionkey, 1) AS k FROM nation INTERSECT ALL SELECT nullIf(n_nationkey % 4, 1) FROM nation", "SELECT nullif(n_regionkey, 1) AS k FROM nation INTERSECT ALL SELECT nullif(n_nationkey % 4, 1) FROM nation"),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000", None),
    "except_all": ("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region", None),
    "set_precedence": ("SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_suppkey FROM supplier ORDER BY k LIMIT 9", None),
    # subqueries
    "cte": ("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 500000) SELECT c.c_name, t.t FROM top AS t JOIN customer AS c ON c.c_custkey = t.o_custkey", None),
    "derived_table": ("SELECT t.k, max(t.n) AS m FROM (SELECT o_custkey AS k, count() AS n FROM orders GROUP BY o_custkey) AS t GROUP BY t.k HAVING m > 12", "SELECT t.k, max(t.n) AS m FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS t GROUP BY t.k HAVING max(t.n) > 12"),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", None),
    "exists_correlated": ("SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", None),
    "not_exists_correlated": ("SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", None),
    "scalar_correlated": ("SELECT c_custkey, (SELECT count(*) FROM orders AS o WHERE o.o_custkey = c.c_custkey) AS n FROM customer AS c", None),
    "not_in_with_nulls": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullIf(r_regionkey, 2) FROM region)", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region)"),
    # whole reports
    "pricing_summary": (
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS net, avg(l_discount) AS disc, count() AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS net, avg(l_discount) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    ),
}
