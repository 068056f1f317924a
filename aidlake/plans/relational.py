"""Relational core: one text each where Spark SQL and the oracle's dialect agree, two where they do not."""

from __future__ import annotations

#: name -> SQL for both; <NTZ> is the type of a time without zone.
SHARED = {
    "nation_revenue": """
        SELECT n.n_name, count(*) AS n_items, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
        FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey JOIN {customer} c ON c.c_nationkey = n.n_nationkey
        JOIN {orders} o ON o.o_custkey = c.c_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
        WHERE r.r_name = 'ASIA' GROUP BY n.n_name""",
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "semi_join": """
        SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)""",
    "anti_join": """
        SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)""",
    "not_in": """
        SELECT count(*) AS n FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 48)""",
    "exists_in_or": """
        SELECT s_suppkey, s_name FROM {supplier} s
        WHERE s_acctbal > 9000 OR EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09 AND l.l_quantity > 49)""",
    "full_outer_join": """
        SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers
        FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 9500 GROUP BY 1) a
        FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""",
    "left_join_counts": """
        SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey""",
    "cross_join": """
        SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n""",
    "rollup": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "cube": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "grouping_sets": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g
        FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "filtered_agg": """
        SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers, count(DISTINCT event_type) AS kinds FROM {events}""",
    "min_by_max_by": """
        SELECT user_id, min_by(event_id, ts) AS first_event, max_by(event_id, ts) AS last_event FROM {events} GROUP BY user_id""",
    "rank_family": """
        SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, CAST(ntile(4) OVER w AS INT) AS quarter,
               round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type)""",
    "analytic_family": """
        SELECT event_id, lead(event_id) OVER w AS next_id, lag(value, 2) OVER w AS value_2_ago, first_value(event_type) OVER w AS first_type,
               nth_value(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third_id
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "topn_per_group": """
        SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) t WHERE rn <= 3""",
    "topk_offset": """
        SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5""",
    "union_distinct": """
        SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}""",
    "union_all": """
        SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) t GROUP BY k""",
    "except_all": """
        SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}""",
    "intersect_all": """
        SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}""",
    "pivot": """
        SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
               CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views FROM {events} GROUP BY user_id""",
    "dedup": """
        SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM {lineitem}) t WHERE rn = 1""",
    "correlated_scalar": """
        SELECT count(*) AS n FROM {lineitem} l WHERE l.l_quantity < (SELECT 0.4 * avg(l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = l.l_partkey)""",
    "having_filter": """
        SELECT l_suppkey, count(*) AS n, round(max(l_extendedprice), 2) AS top FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 10""",
    "case_buckets": """
        SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM {part} GROUP BY 1""",
    "bounded_paths": """
        WITH RECURSIVE edge AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 7 + n_regionkey + 1) % 25 AS BIGINT) AS dst, CAST(n_regionkey + 1 AS BIGINT) AS cost FROM {nation}),
        path(node, cost, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 UNION ALL SELECT e.dst, p.cost + e.cost, p.depth + 1 FROM path p JOIN edge e ON e.src = p.node WHERE p.depth < 5)
        SELECT node, min(cost) AS cost FROM path GROUP BY node""",
    "moments": """
        SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 4) AS var, round(corr(value, CAST(user_id AS DOUBLE)), 9) AS r, round(regr_slope(value, CAST(user_id AS DOUBLE)), 9) AS slope FROM {events} GROUP BY event_type""",
    "confusion_matrix": """
        SELECT l.quality, l.toxic, count(*) AS n FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY l.quality, l.toxic""",
    "minmax_scale": """
        SELECT e.event_id, round((e.value - m.lo) / (m.hi - m.lo), 9) AS scaled FROM {events} e CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM {events}) m""",
    "lag_features": """
        SELECT event_id, lag(value, 1) OVER w AS lag1, lag(value, 2) OVER w AS lag2, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS mean6
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "hourly_agg": """
        SELECT CAST(date_trunc('hour', ts) AS <NTZ>) AS hour, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM {events} GROUP BY 1""",
    "sessionize_6h": """
        SELECT user_id, session, count(*) AS n, min(ts) AS started, max(ts) AS ended
        FROM (SELECT user_id, ts, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session
              FROM (SELECT event_id, user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6' HOUR THEN 0 ELSE 1 END AS new FROM {events}) a) b
        GROUP BY user_id, session""",
    "cockpit_daily": """
        SELECT day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total
        FROM (SELECT CAST(date_trunc('day', ts) AS <NTZ>) AS day, event_type, user_id, value FROM {events}) t GROUP BY CUBE (day, event_type)""",
    "source_fusion": """
        SELECT k, origin, balance FROM (
            SELECT k, origin, balance, row_number() OVER (PARTITION BY k ORDER BY priority, balance DESC, id) AS rn FROM (
                SELECT c_nationkey AS k, 'customer' AS origin, c_acctbal AS balance, 2 AS priority, c_custkey AS id FROM {customer} WHERE c_acctbal > 0
                UNION ALL SELECT s_nationkey, 'supplier', s_acctbal, 1, s_suppkey FROM {supplier} WHERE s_acctbal > 5000) u) r WHERE rn = 1""",
    "string_fns": """
        SELECT p_partkey, upper(p_name) AS up, substr(p_name, 2, 5) AS part, replace(p_type, ' ', '_') AS typed, CAST(length(p_name) AS INT) AS len, lpad(p_brand, 12, '*') AS padded,
               reverse(p_brand) AS rev, CAST(instr(p_name, 'a') AS INT) AS at, CAST(levenshtein(p_brand, p_type) AS INT) AS dist FROM {part}""",
    "date_fns": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(date_trunc('month', o_orderdate) AS <NTZ>) AS month_start, o_orderdate + INTERVAL '30' DAY AS due FROM {orders}""",
    "math_fns": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_quantity), 9) AS lg, CAST(floor(l_extendedprice) AS BIGINT) AS fl, round(power(l_discount, 2), 9) AS sq, abs(l_tax - l_discount) < 0.02 AS close FROM {lineitem}""",
    "url_scheme": """
        SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'https' WHEN url LIKE 'http://%' THEN 'http' END AS scheme, CAST(length(url) AS INT) AS len FROM {pages}""",
    "first_turns": """
        SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM {conversations}) t WHERE rn = 1""",
    "null_rules": """
        SELECT o.o_orderkey, coalesce(l.l_returnflag, 'none') AS flag, nullif(o.o_orderstatus, 'O') AS status
        FROM {orders} o LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM {lineitem} WHERE l_quantity > 45 GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
}

#: name -> (Spark SQL, oracle SQL).
PAIRS = {
    "range_join": (  # an hour is an equal key: what follows within an hour is in the same or the next one
        """SELECT p.event_id AS purchase_id, e.event_id AS error_id
           FROM (SELECT event_id, user_id, ts, date_trunc('hour', ts) + after * INTERVAL '1' HOUR AS hour FROM {events} LATERAL VIEW explode(array(0, 1)) x AS after WHERE event_type = 'purchase') p
           JOIN (SELECT event_id, user_id, ts, date_trunc('hour', ts) AS hour FROM {events} WHERE event_type = 'error') e
           ON p.user_id = e.user_id AND p.hour = e.hour AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL '1' HOUR""",
        """SELECT p.event_id AS purchase_id, e.event_id AS error_id
           FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL '1' HOUR
           WHERE p.event_type = 'purchase' AND e.event_type = 'error'""",
    ),
    "rolling_1h_sum": (  # a row counts in its own hour and in the next one, so a kind of event is cut into hours
        """SELECT event_id, total FROM (
             SELECT event_id, own, round(sum(value) OVER (PARTITION BY event_type, hour ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW), 4) AS total FROM (
               SELECT event_id, event_type, ts, value, date_trunc('hour', ts) + after * INTERVAL '1' HOUR AS hour, after = 0 AS own FROM {events} LATERAL VIEW explode(array(0, 1)) x AS after) e) t WHERE own""",
        "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 hour' PRECEDING AND CURRENT ROW), 4) AS total FROM events",
    ),
    "sliding_window": (
        """SELECT CAST(start AS TIMESTAMP_NTZ) AS start, count(*) AS n, round(sum(value), 4) AS total FROM (
             SELECT value, explode(sequence(date_trunc('day', ts) - INTERVAL '1' DAY, date_trunc('day', ts), INTERVAL '1' DAY)) AS start FROM {events}) t GROUP BY start""",
        """SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM (
             SELECT value, unnest([date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY, date_trunc('day', ts)::TIMESTAMP]) AS start FROM events) t GROUP BY start""",
    ),
    "gap_fill_1h": (
        """WITH b AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM {events}), h AS (SELECT explode(sequence(lo, hi, INTERVAL '1' HOUR)) AS hour FROM b)
           SELECT CAST(h.hour AS TIMESTAMP_NTZ) AS hour, coalesce(e.n, 0) AS n FROM h LEFT JOIN (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM {events} WHERE event_type = 'error' AND value > 100 GROUP BY 1) e ON e.hour = h.hour""",
        """WITH b AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events), h AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM b)
           SELECT h.hour, coalesce(e.n, 0) AS n FROM h LEFT JOIN (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1) e ON e.hour = h.hour""",
    ),
    "gap_fill_15m": (
        """WITH b AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM {events}), q AS (SELECT explode(sequence(lo, hi, INTERVAL '15' MINUTE)) AS slot FROM b)
           SELECT CAST(q.slot AS TIMESTAMP_NTZ) AS slot, coalesce(e.n, 0) AS n, round(coalesce(e.total, 0.0D), 4) AS total FROM q LEFT JOIN (
             SELECT date_trunc('hour', ts) + make_dt_interval(0, 0, CAST(minute(ts) - minute(ts) % 15 AS INT), 0) AS slot, count(*) AS n, sum(value) AS total FROM {events} GROUP BY 1) e ON e.slot = q.slot""",
        """WITH b AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events), q AS (SELECT unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS slot FROM b)
           SELECT q.slot::TIMESTAMP AS slot, coalesce(e.n, 0) AS n, round(coalesce(e.total, 0.0::DOUBLE), 4) AS total FROM q LEFT JOIN (
             SELECT time_bucket(INTERVAL '15 minutes', ts) AS slot, count(*) AS n, sum(value) AS total FROM events GROUP BY 1) e ON e.slot = q.slot""",
    ),
    "regex_extract": (
        "SELECT doc_id, regexp_extract(text, '([0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}})', 1) AS ip FROM {documents} WHERE regexp_like(text, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}')",
        "SELECT doc_id, regexp_extract(text, '([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})', 1) AS ip FROM documents WHERE regexp_matches(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')",
    ),
    "regex_replace": (
        "SELECT doc_id, CAST(length(regexp_replace(text, '[0-9]+', '#')) AS BIGINT) AS n FROM {documents}",
        "SELECT doc_id, CAST(length(regexp_replace(text, '[0-9]+', '#', 'g')) AS BIGINT) AS n FROM documents",
    ),
    "url_host": (
        "SELECT page_id, parse_url(url, 'HOST') AS host FROM {pages}",
        "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages",
    ),
    "json_extract": (
        "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM {events} GROUP BY 1",
        "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    ),
    "token_count": (
        "SELECT lang, CAST(sum(regexp_count(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS n FROM {documents} GROUP BY lang HAVING sum(regexp_count(text, '[^ \\t\\n\\r]+')) > 0",
        "SELECT lang, count(*) AS n FROM (SELECT lang, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS t FROM documents) t GROUP BY lang",
    ),
    "array_fns": (
        "SELECT vec_id, size(embedding) AS n, CAST(array_max(embedding) AS DOUBLE) AS top, CAST(element_at(embedding, 3) AS DOUBLE) AS third, size(slice(embedding, 1, 5)) AS five FROM {embeddings}",
        "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(embedding[3] AS DOUBLE) AS third, CAST(len(embedding[1:5]) AS INT) AS five FROM embeddings",
    ),
    "collect_sorted": (
        "SELECT user_id, array_join(sort_array(collect_set(event_type)), ',') AS kinds FROM {events} GROUP BY user_id",
        "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id",
    ),
    "map_fns": (
        """SELECT user_id, CAST(m['error'] AS BIGINT) AS errors, array_join(sort_array(map_keys(m)), ',') AS kinds FROM (
             SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY ALL) a GROUP BY user_id) t""",
        """SELECT user_id, CAST(sum(n) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (
             SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) a GROUP BY user_id""",
    ),
    "unpivot": (
        "SELECT * FROM (SELECT l_returnflag, round(avg(l_quantity), 6) AS qty, round(avg(l_tax), 6) AS tax FROM {lineitem} GROUP BY l_returnflag) UNPIVOT (v FOR measure IN (qty, tax))",
        "SELECT l_returnflag, unnest(['qty', 'tax']) AS measure, unnest([qty, tax]) AS v FROM (SELECT l_returnflag, round(avg(l_quantity), 6) AS qty, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY l_returnflag)",
    ),
    "skewness": (
        "SELECT event_type, round((avg(value*value*value) - 3*avg(value)*avg(value*value) + 2*power(avg(value),3)) / power(var_pop(value), 1.5), 6) AS skew FROM {events} GROUP BY event_type",
        "SELECT event_type, round((avg(value*value*value) - 3*avg(value)*avg(value*value) + 2*power(avg(value),3)) / power(var_pop(value), 1.5), 6) AS skew FROM events GROUP BY event_type",
    ),
    "ahp_weights": (
        """WITH c AS (SELECT i.n_nationkey AS i, j.n_nationkey AS j, CAST(i.n_regionkey + 1 AS DOUBLE) / (j.n_regionkey + 1) AS v FROM {nation} i CROSS JOIN {nation} j),
           g AS (SELECT i, exp(avg(ln(v))) AS w FROM c GROUP BY i) SELECT i, round(w / sum(w) OVER (), 9) AS weight FROM g""",
        """WITH c AS (SELECT i.n_nationkey AS i, j.n_nationkey AS j, CAST(i.n_regionkey + 1 AS DOUBLE) / (j.n_regionkey + 1) AS v FROM nation i CROSS JOIN nation j),
           g AS (SELECT i, exp(avg(ln(v))) AS w FROM c GROUP BY i) SELECT i, round(w / sum(w) OVER (), 9) AS weight FROM g""",
    ),
}
