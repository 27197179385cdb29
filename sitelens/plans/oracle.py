"""Role views as SQL CTEs (FIXTURES.md §2) for oracle engines such as DuckDB."""

ROLE_CTES = """WITH
sites AS (SELECT p_partkey AS site_id, p_name AS name, p_brand AS location, p_type AS type,
  CAST(p_retailprice AS DECIMAL(10,2)) AS ticket_price,
  CASE WHEN p_size % 10 = 0 THEN 'World Heritage' WHEN p_size % 10 < 4 THEN 'Tentative' ELSE 'None' END AS unesco_status,
  CONCAT(p_name, ' ', p_type) AS description,
  DATE '1995-01-01' + CAST(p_partkey AS INT) AS created_at,
  CASE WHEN p_size % 3 = 0 THEN '09:00-17:00' WHEN p_size % 3 = 1 THEN '10:00-18:00' END AS opening_hours FROM part),
evts AS (SELECT event_id, user_id AS site_id, CONCAT(event_type, ' ', CAST(user_id AS STRING)) AS name,
  CAST(ts AS DATE) AS event_date, CAST(value AS DECIMAL(10,2)) AS ticket_price, user_id AS capacity,
  event_type AS description, strftime(ts, '%H:%M:%S') AS event_time FROM events),
visitors AS (SELECT c_custkey AS visitor_id, c_name AS full_name, n_name AS nationality,
  CONCAT(LOWER(c_name), '@example.com') AS email, DATE '1995-01-01' + CAST(c_custkey AS INT) AS created_at,
  CONCAT('017', LPAD(CAST(c_custkey AS VARCHAR), 8, '0')) AS phone
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
bookings AS (SELECT o_orderkey AS booking_id, o_custkey AS visitor_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % (SELECT COUNT(*) FROM part) END AS site_id,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 7) % (SELECT COUNT(*) FROM events) END AS event_id,
  o_orderdate AS booking_date, 1 + o_orderkey % 5 AS no_of_tickets,
  CAST(o_totalprice AS DECIMAL(10,2)) AS booked_ticket_price,
  CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'failed' END AS payment_status FROM orders),
payments AS (SELECT l_orderkey * 4294967296 + CAST('0x' || SUBSTR(MD5(CONCAT_WS('/', l_linenumber, l_suppkey,
  CAST(l_extendedprice AS DECIMAL(10,2)))), 1, 8) AS BIGINT) AS payment_id, l_orderkey AS booking_id, l_linenumber AS attempt_no, l_suppkey AS acquirer_id,
  CAST(l_extendedprice AS DECIMAL(10,2)) AS amount,
  CASE l_linenumber WHEN 1 THEN 'bkash' WHEN 2 THEN 'nagad' WHEN 3 THEN 'rocket' WHEN 4 THEN 'card' ELSE 'bank_transfer' END AS method,
  CASE WHEN l_returnflag = 'A' THEN 'successful' WHEN l_returnflag = 'N' THEN 'initiated' WHEN l_linestatus = 'F' THEN 'failed' ELSE 'refunded' END AS status,
  l_shipdate AS paid_at FROM lineitem),
guides AS (SELECT s_suppkey AS guide_id, s_name AS full_name, n_name AS language, r_name AS specialization,
  CAST(s_acctbal AS DECIMAL(10,2)) AS salary
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
assignments AS (SELECT p_partkey AS assign_id, p_partkey % (SELECT CAST(FLOOR(COUNT(*) * 0.9) AS BIGINT) FROM supplier) AS guide_id,
  CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS site_id,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS event_id,
  CASE p_size % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' ELSE 'Evening' END AS shift_time FROM part),
reviews AS (SELECT event_id AS review_id, user_id AS visitor_id,
  CASE WHEN event_id % 4 <> 0 THEN (event_id * 13) % (SELECT COUNT(*) FROM part) END AS site_id,
  CASE WHEN event_id % 4 = 0 THEN (event_id * 11) % (SELECT COUNT(*) FROM events) END AS event_id,
  CAST(1 + event_id % 5 AS INT) AS rating, event_type AS comment, CAST(ts AS DATE) AS review_date
  FROM events WHERE event_type IN ('view', 'click'))"""


def with_roles(body: str) -> str:
    """Prefix a query body with the role CTEs.

    A body may start with ``, name AS (...)`` to add CTEs of its own.
    """
    body = body.strip()
    sep = "\n" if body.startswith(",") else "\n"
    return ROLE_CTES + sep + body
