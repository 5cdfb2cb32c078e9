"""Scans, projections, predicates, joins, aggregates, windows, set operations, subqueries and CTEs as SQL.

BOTH holds text that Spark and DuckDB read alike; PAIRS holds Spark's text and DuckDB's.
"""

FRAME = "SELECT event_id, user_id, value, CAST(floor(value / 10) AS BIGINT) AS grp FROM events"

BOTH = {
    # scans, projection, filters
    "scan_region": "SELECT r_regionkey, r_name FROM region",
    "scan_point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "scan_range_seek": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200 AND o_totalprice > 1000",
    "scan_in_seek": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 77, 1000000)",
    "scan_multi_index_or": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 17 OR l_suppkey = 3",
    "project_expr": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_linenumber AS minus FROM lineitem",
    "filter_between": "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "filter_in_list": "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')",
    "filter_null_safe_eq": "SELECT a.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM customer a LEFT JOIN orders o ON a.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderstatus IS DISTINCT FROM 'F'",
    "filter_truth_tests": "SELECT event_id, (value > 50) IS TRUE AS hi, (value > 50) IS NOT FALSE AS nf FROM events",
    "filter_three_valued": "SELECT x, y, (x = y) IS NULL AS unknown, x IN (2, NULL) AS member FROM (VALUES (1, CAST(NULL AS INT)), (2, 5), (CAST(NULL AS INT), 5), (CAST(NULL AS INT), CAST(NULL AS INT))) AS t(x, y)",
    "case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS own FROM part",
    "row_value_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F')",
    "values_table": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, CAST(NULL AS STRING))) AS t(a, b)",
    "constant_row": "SELECT 1 AS one, 'a' AS letter, CAST(NULL AS INT) AS nothing",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey",
    "join_full_theta": "SELECT r.r_regionkey AS r_regionkey, n.n_nationkey AS n_nationkey FROM region r FULL JOIN nation n ON r.r_regionkey > n.n_regionkey AND n.n_nationkey < 9",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": "SELECT o_orderkey, n, o_custkey FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l USING (o_orderkey)",
    "join_natural": "SELECT o_orderkey, total, o_custkey FROM orders NATURAL JOIN (SELECT l_orderkey AS o_orderkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_orderkey) l",
    "join_semi_exists": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 48)",
    "join_semi_in": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "join_anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "join_not_in_null_aware": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 9 THEN NULL ELSE r_regionkey END FROM region)",
    "join_self": "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_three_way": "SELECT n_name, c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
    "join_star": "SELECT n_name, p_brand, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, p_brand",
    # aggregates
    "agg_global_empty": "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo, avg(l_quantity) AS a FROM lineitem WHERE l_orderkey < 0",
    "agg_group_multi": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_group_expr": "SELECT p_size % 7 AS rest, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_size % 7",
    "agg_group_ordinal": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "agg_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, CAST(sum(DISTINCT user_id) AS BIGINT) AS total FROM events GROUP BY event_type",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS hi, round(sum(value) FILTER (WHERE user_id % 2 = 0), 2) AS even FROM events GROUP BY event_type",
    "agg_total": "SELECT user_id, coalesce(round(sum(CASE WHEN value > 99 THEN value END), 2), 0.0) AS total FROM events GROUP BY user_id",
    "agg_stddev": "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 6) AS v FROM events GROUP BY event_type",
    "agg_count_variants": "SELECT count(*) AS a, count(o_orderkey) AS b, count(DISTINCT o_custkey) AS c FROM orders",
    "agg_min_max_text": "SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY p_brand",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    # windows
    "win_row_number": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM events",
    "win_rank_dense": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part",
    "win_percent_cume": "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS c FROM part",
    "win_ntile": "SELECT event_id, CAST(ntile(7) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS t FROM events",
    "win_lag_lead": "SELECT event_id, lag(value) OVER w AS l, lead(value, 2, -1.0) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "win_first_last_nth": "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 3) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_running_range": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM part",
    "win_rows_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS top FROM events",
    "win_range_offset": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM part",
    "win_moving_minmax": "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lo, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS hi FROM events",
    "win_over_group": "SELECT o_custkey, status, n, CAST(rank() OVER (PARTITION BY status ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT o_custkey, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) t",
    "win_named": "SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS a, count(*) OVER w AS b, count(*) OVER (PARTITION BY event_type) AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
    "win_distinct_output": "SELECT DISTINCT event_type, count(*) OVER (PARTITION BY event_type) AS n FROM events",
    "win_correlated_subquery": "SELECT o_orderkey, (SELECT max(r) FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS r FROM lineitem) x WHERE x.l_orderkey = o.o_orderkey) AS lines FROM orders o",
    # order, limit, sets
    "sort_nulls_last": "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) t ORDER BY v DESC NULLS LAST, k",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 35",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_sets": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25",
    "except_sets": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "compound_order_limit": "SELECT k, src FROM (SELECT c_custkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier) t ORDER BY k, src LIMIT 40",
    # subqueries and CTEs
    "sub_scalar": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)",
    "sub_scalar_correlated": "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS uses FROM part",
    "sub_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity = 50 AND l.l_returnflag = 'R')",
    "sub_from": "SELECT segment, round(avg(n), 6) AS orders_each FROM (SELECT c_custkey, c_mktsegment AS segment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment) t GROUP BY segment",
    "sub_nonequi": "SELECT r_regionkey, n FROM region JOIN (SELECT a.r_regionkey AS k, count(b.n_nationkey) AS n FROM region a LEFT JOIN nation b ON b.n_regionkey < a.r_regionkey GROUP BY a.r_regionkey) t ON k = r_regionkey",
    "cte_multi": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_custkey, c_name, n FROM customer JOIN per ON c_custkey = o_custkey WHERE n > 3",
    "cte_shared": "WITH per AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, revenue FROM per WHERE revenue >= (SELECT max(revenue) FROM per) - 100000",
    "recursive_union_all": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    # analytics
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q4": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24",
    "tpch_q10": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q12": "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus",
    "tpch_q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) t GROUP BY c_count",
    "tpch_q14": "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey",
    "tpch_q15": "WITH revenue AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM revenue)",
    "tpch_q17": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.4 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)",
    "tpch_q18": "SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice",
    "tpch_q19": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30)",
    "tpch_q21": "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey WHERE a.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R') GROUP BY s_name",
    "tpch_q22": "SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY c_nationkey",
    "agg_median": "SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY p_brand",
    "agg_bool": "SELECT p_brand, bool_and(p_size > 1) AS every_one, bool_or(p_size > 49) AS some FROM part GROUP BY p_brand",
    "tpch_q2": "SELECT s_suppkey, s_name, n_name, l_partkey FROM (SELECT DISTINCT l_partkey, l_suppkey, l_extendedprice / l_quantity AS cost FROM lineitem) l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON p_partkey = l_partkey WHERE p_size < 15 AND cost = (SELECT min(m.l_extendedprice / m.l_quantity) FROM lineitem m WHERE m.l_partkey = p_partkey)",
    "tpch_q7": "SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, year(l_shipdate) AS y, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_regionkey = 1 AND b.n_regionkey = 2 GROUP BY a.n_name, b.n_name, year(l_shipdate)",
    "tpch_q8": "SELECT year(o_orderdate) AS y, round(sum(CASE WHEN n.n_regionkey = 1 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation n ON s_nationkey = n.n_nationkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size BETWEEN 10 AND 30 GROUP BY year(o_orderdate)",
    "tpch_q9": "SELECT n_name, year(o_orderdate) AS y, CAST(sum(CAST(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 0.5 AS DECIMAL(18, 4))) AS DOUBLE) AS profit FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size > 20 GROUP BY n_name, year(o_orderdate)",
    "tpch_q11": "SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 12 GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT 0.001 * sum(l_extendedprice) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 12)",
    "tpch_q16": "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size IN (1, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size",
    "tpch_q20": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 20 GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT avg(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) t) * 0.3)",
    "graph_cooccurrence": "SELECT a.l_partkey AS x, b.l_partkey AS y, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY a.l_partkey, b.l_partkey HAVING count(*) > 1",
}

PAIRS = {
    "graph_streaks": ("WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), runs AS (SELECT user_id, d, datediff(d, DATE '2020-01-01') - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS island FROM days), lengths AS (SELECT user_id, island, count(*) AS days FROM runs GROUP BY user_id, island) SELECT user_id, max(days) AS longest, count(*) AS streaks FROM lengths GROUP BY user_id", "WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), runs AS (SELECT user_id, d, datediff('day', DATE '2020-01-01', d) - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS island FROM days), lengths AS (SELECT user_id, island, count(*) AS days FROM runs GROUP BY user_id, island) SELECT user_id, max(days) AS longest, count(*) AS streaks FROM lengths GROUP BY user_id"),
    "agg_mode": ("SELECT o_custkey, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS m FROM orders GROUP BY o_custkey", "SELECT o_custkey, o_orderpriority AS m FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(o_orderpriority) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) t WHERE r = 1"),
    "agg_bare_column_max": ("SELECT p_brand, max(p_retailprice) AS top, max_by(p_partkey, struct(p_retailprice, -p_partkey)) AS p_partkey FROM part GROUP BY p_brand", "SELECT p_brand, p_retailprice AS top, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) t WHERE k = 1"),
    "filter_like_ci": ("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%O%' AND p_name NOT ILIKE 'a!_%' ESCAPE '!'", None),
    "filter_regexp": ("SELECT p_partkey, p_name FROM part WHERE p_name RLIKE '[aeiou]{2}'", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')"),
    "arith_int_div_null": ("SELECT p_partkey, p_size div nullif(p_size % 5, 0) AS q, p_size % nullif(p_size % 5, 0) AS r FROM part", "SELECT p_partkey, CAST(p_size // nullif(p_size % 5, 0) AS BIGINT) AS q, p_size % nullif(p_size % 5, 0) AS r FROM part"),
    "agg_group_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_string_agg_distinct": ("SELECT o_custkey, listagg(DISTINCT o_orderpriority, ';') WITHIN GROUP (ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_custkey"),
    "agg_percentile_cont": ("SELECT event_type, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 6) AS p25, round(median(value), 6) AS p50 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50 FROM events GROUP BY event_type"),
    "agg_percentile_disc": ("SELECT event_type, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90 FROM events GROUP BY event_type", "SELECT event_type, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type"),
    "agg_percentile_100": ("SELECT event_type, round(percentile(value, 37 / 100.0D), 6) AS p FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.37), 6) AS p FROM events GROUP BY event_type"),
    "win_filter": ("SELECT event_id, count(CASE WHEN value > 50 THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events", "SELECT event_id, count(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events"),
    "win_group_concat": ("SELECT n_nationkey, array_join(collect_list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name), ',') AS names FROM nation", "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_name) AS names FROM nation"),
    "win_count_distinct": ("SELECT event_id, CAST(size(collect_set(event_type) OVER (PARTITION BY user_id)) AS BIGINT) AS n FROM events", "SELECT event_id, n FROM events JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id) t USING (user_id)"),
    "generate_series_up": ("SELECT CAST(id AS BIGINT) AS value FROM range(5, 51, 3)", "SELECT CAST(unnest(generate_series(5, 50, 3)) AS BIGINT) AS value"),
    "lateral_series": ("SELECT n_nationkey, CAST(x AS BIGINT) AS x FROM nation, LATERAL explode(sequence(0, n_regionkey)) AS t(x)", "SELECT n_nationkey, CAST(x AS BIGINT) AS x FROM nation, LATERAL (SELECT unnest(generate_series(0, n_regionkey)) AS x)"),
    "window_tumbling": ("SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 day'), event_type", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "fuzzy_leven": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", None),
    "crypto_hash": ("SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s FROM part", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part"),
    "dt_date_parts": ("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, dayofyear(ts) AS doy, weekofyear(ts) AS iso FROM events", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(dayofyear(ts) AS INT) AS doy, CAST(week(ts) AS INT) AS iso FROM events"),
    "dt_trunc": ("SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS m FROM events", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m FROM events"),
    "json_extract": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    # NOT IN as an anti-join: Spark broadcasts the right side of a null-aware one, of whatever size. Any null there excludes every row, a null key is kept by an empty side only
    "sub_in": ("SELECT o_orderkey FROM orders o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_discount > 0.05 AND l_orderkey = o.o_orderkey) AND (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_discount > 0.05) OR (o_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_discount > 0.05 AND l_orderkey IS NULL)))", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)"),
    # equal prices of a size are one cell (of at most 1,024 keys); cells meet by slots of half the band's width, each pair in the one slot of its b
    "join_theta_range": ("WITH cells AS (SELECT p_size, p_retailprice AS price, collect_list(struct(p_partkey)) AS rows FROM (SELECT p_partkey, p_size, p_retailprice, (row_number() OVER (PARTITION BY p_size, p_retailprice ORDER BY p_partkey) - 1) div 1024 AS chunk FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL) GROUP BY p_size, p_retailprice, chunk) SELECT a_key, b_key FROM (SELECT a.rows AS a_rows, b.rows AS b_rows FROM (SELECT *, explode(sequence(floor(least(greatest(price / 2.5D, -9e17D), 9e17D)), floor(least(greatest((price + 5) / 2.5D, -9e17D), 9e17D)))) AS slot FROM cells) a JOIN (SELECT *, floor(least(greatest(price / 2.5D, -9e17D), 9e17D)) AS slot FROM cells) b ON a.p_size = b.p_size AND a.slot = b.slot AND a.price < b.price AND b.price < a.price + 5) LATERAL VIEW inline(a_rows) AS a_key LATERAL VIEW inline(b_rows) AS b_key", "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_retailprice < b.p_retailprice AND b.p_retailprice < a.p_retailprice + 5"),
    # of equal values the least event_id, as the first row of a file in its order; a row without one of both gives no event_id
    "agg_bare_column": ("SELECT user_id, max(value) AS top, max_by(event_id, struct(value, ~event_id)) FILTER (WHERE value IS NOT NULL AND event_id IS NOT NULL) AS at FROM events GROUP BY user_id", "SELECT user_id, max(value) AS top, max_by(event_id, value) AS at FROM events GROUP BY user_id"),
}
