"""Queries of the SQL surface: name -> (Spark SQL, DuckDB SQL; None: the same text)."""

from __future__ import annotations

QUERIES: dict[str, tuple[str, str | None]] = {
    "filter_project": ("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'O'", None),
    "group_agg": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "having": ("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "count_distinct": ("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type", None),
    "agg_filter": ("SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 2) AS high_sum, coalesce(round(sum(value), 2), 0) AS total FROM events GROUP BY event_type", None),
    "group_concat": ("SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "max_by": ("SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS top_order FROM orders GROUP BY o_custkey"),
    "case_cast": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS STRING) AS key_text FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS key_text FROM orders"),
    "try_cast": ("SELECT event_id, try_cast(substr(event_type, 1, 2) AS INT) AS a, try_cast(CAST(event_id AS STRING) AS BIGINT) AS b FROM events", "SELECT event_id, try_cast(substr(event_type, 1, 2) AS INT) AS a, try_cast(CAST(event_id AS VARCHAR) AS BIGINT) AS b FROM events"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC NULLS LAST LIMIT 15 OFFSET 10", None),
    "join_inner": ("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    "join_left": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey", None),
    "join_right": ("SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", None),
    "join_full": ("SELECT coalesce(c.k, s.k) AS nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c.k = s.k", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_using": ("SELECT k, n1, n2 FROM (SELECT c_nationkey AS k, count(*) AS n1 FROM customer GROUP BY c_nationkey) x JOIN (SELECT s_nationkey AS k, count(*) AS n2 FROM supplier GROUP BY s_nationkey) y USING (k)", None),
    "join_natural": ("SELECT k, n1, n2 FROM (SELECT c_nationkey AS k, count(*) AS n1 FROM customer GROUP BY c_nationkey) x NATURAL JOIN (SELECT n_nationkey AS k, n_regionkey AS n2 FROM nation) y", None),
    "join_self": ("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus = 'P' AND b.o_orderstatus = 'P'", None),
    "join_semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", None),
    "join_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')", None),
    "in_subquery": ("SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%')", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", None),
    "window_rank": ("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", None),
    "window_lag_lead": ("SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", None),
    "window_frame": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders", None),
    "cte": ("WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), m AS (SELECT avg(total) AS a FROM t) SELECT k, round(total, 2) AS total FROM t, m WHERE total > 1.5 * a", None),
    # from each urgent order up a tree over the orders (the parent has half the key), to its root; missing orders end a path
    "cte_recursive": (
        "WITH RECURSIVE up(leaf, k, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000 UNION ALL SELECT leaf, o_orderkey, depth + 1 FROM up JOIN orders ON o_orderkey = k DIV 2 WHERE k > 1) SELECT leaf, min(k) AS root, max(depth) AS depth FROM up GROUP BY leaf",
        "WITH RECURSIVE up(leaf, k, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000 UNION ALL SELECT leaf, o_orderkey, depth + 1 FROM up JOIN orders ON o_orderkey = k // 2 WHERE k > 1) SELECT leaf, min(k) AS root, max(depth) AS depth FROM up GROUP BY leaf",
    ),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", None),
    "correlated_subquery": ("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "derived_table": ("SELECT band, count(*) AS n FROM (SELECT CAST(floor(l_quantity / 10) AS INT) AS band FROM lineitem) t GROUP BY band ORDER BY band", None),
    "string_funcs": ("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, substr(p_name, 2, 5) AS s, replace(p_name, 'a', '_') AS r, trim(concat('  ', p_brand, ' ')) AS t, p_name || '/' || p_brand AS c FROM part", None),
    "math_funcs": ("SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, round(l_extendedprice, 1) AS r, round(sqrt(l_quantity), 6) AS q, round(ln(l_extendedprice), 6) AS g, round(power(l_discount, 2), 6) AS p, CAST(ceil(l_tax * 100) AS BIGINT) AS c FROM lineitem", None),
    "conditional_funcs": ("SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS t, ifnull(value, 0) AS v, greatest(value, 50.0) AS g, least(value, 50.0) AS l FROM events", None),
    "safe_divide": ("SELECT l_orderkey, l_linenumber, round(try_divide(l_extendedprice, l_discount), 4) AS q, CAST(l_quantity AS INT) DIV 7 AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS q, CAST(CAST(l_quantity AS INT) // 7 AS BIGINT) AS d FROM lineitem"),
    "date_funcs": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d, date_format(o_orderdate, 'yyyy-MM') AS ym, unix_date(CAST(o_orderdate AS DATE)) + 2440587.5D AS julian, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS later FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 2440587.5 AS julian, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS later FROM orders"),
    "json_extract": ("SELECT event_id, CAST(json_array_length('[1,2,3]') AS BIGINT) AS n, get_json_object(props, '$.k') AS v FROM events", "SELECT event_id, CAST(json_array_length('[1,2,3]') AS BIGINT) AS n, json_extract_string(props, '$.k') AS v FROM events"),
    "like_nocase": ("SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' AND p_brand NOT LIKE '%1'", None),
    "glob": ("SELECT p_partkey FROM part WHERE p_brand RLIKE '^Brand#[1-3].*$'", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]*'"),
    "collate_nocase": ("SELECT count(*) AS n FROM nation WHERE lower(n_name) = lower('nation_1') OR n_name COLLATE UTF8_LCASE = 'NATION_2'", "SELECT count(*) AS n FROM nation WHERE lower(n_name) IN ('nation_1', 'nation_2')"),
    "order_nulls": ("SELECT k FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS i FROM nation) t ORDER BY k ASC NULLS FIRST, i LIMIT 8", None),
}
