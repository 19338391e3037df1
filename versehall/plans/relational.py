"""Relational operators in SQL that Catalyst plans: projections, filters, joins, aggregates, sorts,
"""

from versehall.plans.registry import plain

# -- projections and predicates ---------------------------------------------------------------

plain("p1_projection", "SELECT l_orderkey AS order_id, l_linenumber AS seq, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
plain("p2_predicates", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')")
plain("p3_in_list", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 7, 15, 49)")
plain("p4_null_or_empty", "SELECT event_id, event_type FROM events WHERE props IS NOT NULL AND props <> '' AND value IS NOT NULL")
plain("p5_like_escape", "SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_name LIKE 'Customer%1%' AND c_name NOT LIKE '%/_%' ESCAPE '/' AND c_mktsegment NOT LIKE 'AUTO%'")
plain("p6_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
plain("p7_coalesce", "SELECT c.c_custkey, coalesce(max(o.o_totalprice), 0.0) AS most FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
plain("p8_boolean_sums", "SELECT l_shipdate::DATE AS day, sum((l_returnflag <> 'N')::INT)::BIGINT AS returned, sum((l_tax > 0.04)::INT)::BIGINT AS taxed FROM lineitem GROUP BY 1")
plain("p9_consistency", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'N') <> (l_linestatus = 'O')")
plain("p10_first_char", "SELECT conv_id, turn, CASE WHEN substr(ltrim(text), 1, 1) BETWEEN 'A' AND 'M' THEN 'early' ELSE 'late' END AS half FROM conversations")
plain("p11_pseudo_sample", "SELECT event_id FROM events ORDER BY (event_id * 2654435761) % 1000003, event_id LIMIT 100")
plain("p13_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")

# -- joins ------------------------------------------------------------------------------------

plain("j1_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
plain("j2_three_way", "SELECT n_name, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
plain(
    "j3_four_way",
    "SELECT r_name, n_name, l_returnflag, count(*) AS lines, count(DISTINCT s_suppkey) AS suppliers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, l_returnflag",
)
plain("j4_key_fallback", "SELECT coalesce(o.o_custkey, c.c_custkey) AS cust, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
plain("j5_left_dimension", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
plain("j6_scalar_subquery", "SELECT event_id, value FROM events WHERE value > (SELECT avg(value) FROM events)")
plain("j7_latest_per_key", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
plain("j8_anti_triple", "SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem l WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_orderkey = l.l_orderkey AND a.l_suppkey = l.l_suppkey AND a.l_returnflag = 'A')")
plain(
    "j9_semi_and_anti",
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') "
    "AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
)
plain(
    "j10_run_diff",
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' ELSE 'changed' END AS state FROM "
    "(SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL OUTER JOIN "
    "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'moved' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k "
    "WHERE a.v IS DISTINCT FROM b.v",
)
plain("j11_symmetric_difference", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1) a FULL OUTER JOIN (SELECT doc_id FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
plain("j12_in_every_run", "SELECT conv_id FROM (SELECT DISTINCT conv_id, role FROM conversations) x GROUP BY conv_id HAVING count(*) = (SELECT count(DISTINCT role) FROM conversations)")
plain("j16_co_occurrence", "SELECT a.role AS a, b.role AS b, count(DISTINCT a.conv_id) AS convs FROM (SELECT DISTINCT conv_id, role FROM conversations) a JOIN (SELECT DISTINCT conv_id, role FROM conversations) b ON a.conv_id = b.conv_id AND a.role < b.role GROUP BY 1, 2")
plain(
    "j21_override",
    "SELECT coalesce(e.k, b.k) AS k, coalesce(e.v, b.v) AS v, e.k IS NOT NULL AS edited FROM (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 4 <> 3) b "
    "FULL OUTER JOIN (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_partkey % 10 = 3) e ON b.k = e.k",
)
plain(
    "j22_content_match",
    "SELECT doc_id, twin FROM documents JOIN (SELECT n_chars AS n, md5(text) AS digest, min(doc_id) AS twin FROM documents GROUP BY n_chars, md5(text) HAVING count(*) > 1) x "
    "ON n_chars = n AND md5(text) = digest AND doc_id > twin",
)

# -- aggregates -------------------------------------------------------------------------------

plain("a1_count_by", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
plain("a2_conditional_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS big, count(*) AS n FROM events GROUP BY user_id")
plain("a3_three_keys", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS qty, min(l_shipdate) AS first_day FROM lineitem GROUP BY 1, 2, 3")
plain("a4_global", "SELECT count(*) AS n, round(coalesce(sum(l_extendedprice), 0), 2) AS total, round(coalesce(sum(l_quantity), 0) / 1000.0, 5) AS thousands FROM lineitem")
plain("a5_min_max", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, max(value) AS most FROM events GROUP BY event_type")
plain("a6_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
plain("a10_most_frequent", "SELECT cust, status FROM (SELECT o_custkey AS cust, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY o_custkey, o_orderstatus) x WHERE r = 1")
plain("a11_top_counter", "SELECT conv_id, max_by(role, n * 1000 - ascii(role)) AS role FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) x GROUP BY conv_id")
plain("a12_weighted_moments", "SELECT event_type, round(sum(value * w) / sum(w), 6) AS mean, round(sqrt(greatest(0.0, sum(value * value * w) / sum(w) - (sum(value * w) / sum(w)) * (sum(value * w) / sum(w)))), 4) AS sd FROM (SELECT event_type, value, 1 + event_id % 5 AS w FROM events) x GROUP BY event_type")
plain("a15_mean_error", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS se FROM customer GROUP BY c_mktsegment")
plain(
    "a16_win_loss_tie",
    "SELECT count(*) FILTER (WHERE d >= 5) AS wins, count(*) FILTER (WHERE d <= -5) AS losses, count(*) FILTER (WHERE abs(d) < 5) AS ties FROM "
    "(SELECT user_id, avg(CASE WHEN event_id % 2 = 0 THEN value END) - avg(CASE WHEN event_id % 2 = 1 THEN value END) AS d FROM events GROUP BY user_id) x",
)
plain(
    "a22_latest_batch_sum",
    "SELECT l_partkey, round(sum(q), 2) AS qty, count(*) AS orders_n FROM (SELECT l_partkey, l_orderkey, max_by(l_quantity, l_linenumber * 1000.0 + l_quantity) AS q FROM lineitem GROUP BY l_partkey, l_orderkey) x GROUP BY l_partkey",
)
plain(
    "a23_ledger_max",
    "SELECT coalesce(a.k, b.k) AS k, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a "
    "FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.k = b.k",
)
plain("a24_exposure_fold", "SELECT upper(trim(p_brand)) AS canonical, max(p_size) AS exposure FROM part GROUP BY 1")
plain("a25_busiest", "SELECT max(n) AS busiest FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey) x")

# -- sorts, limits, top-k ---------------------------------------------------------------------

plain("s4_latest_n", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
plain("s8_lexicographic", "SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal > 0)::INT DESC, length(s_name), s_acctbal DESC, s_suppkey) AS r FROM supplier) x WHERE r <= 3")
plain("s11_lru_keep", "SELECT doc_id FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS size FROM documents) x WHERE size <= 20000")
plain("s12_keep_last_n", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r <= 5")

# -- set operations ---------------------------------------------------------------------------

plain("u1_union", "SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region")
plain("u2_concatenation", "SELECT c_name AS name, c_acctbal AS bal, 'c' AS kind FROM customer UNION ALL SELECT s_name AS name, s_acctbal AS bal, 's' AS kind FROM supplier")
plain("u4_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
plain("u4_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'")
plain("u5_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
plain("u6_first_wins", "SELECT k, src, v FROM (SELECT k, src, v, row_number() OVER (PARTITION BY k ORDER BY src, v) AS r FROM (SELECT c_nationkey AS k, 1 AS src, c_name AS v FROM customer UNION ALL SELECT s_nationkey AS k, 0 AS src, s_name AS v FROM supplier) y) x WHERE r = 1")

# -- windows ----------------------------------------------------------------------------------

plain("w1_sample_turn", "SELECT role, conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY abs(length(text) - 40), conv_id, turn) AS r FROM conversations WHERE length(text) >= 10) x WHERE r = 1")
plain("w5_prefix_sum", "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM conversations")
plain("w7_timeline", "SELECT conv_id, turn, sum(length(text) / 15e0 + 38e-2) OVER (PARTITION BY conv_id ORDER BY turn) - (length(text) / 15e0 + 38e-2) AS starts FROM conversations".replace("sum(", "round(sum(", 1).replace(" AS starts", ", 4) AS starts"))
plain("w13_neighbours", "SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before_text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after_text FROM conversations")
