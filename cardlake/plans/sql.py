"""Shared parts of the SQL that results are checked against (DuckDB)."""

TXN = """
txn AS (
  SELECT event_id AS transaction_id, user_id, CAST(ts AS TIMESTAMP) AS ts, value AS amount, event_type AS product, k,
         CASE WHEN k < 3 THEN 1 ELSE 0 END AS is_fraud, user_id * 10 + k % 3 AS card1, k // 5 AS addr1,
         CAST(user_id AS VARCHAR) || '_' || CAST(k % 3 AS VARCHAR) AS device,
         CASE event_id % 7 WHEN 0 THEN 'gmail' WHEN 1 THEN 'yahoo' WHEN 2 THEN 'hotmail' WHEN 3 THEN 'outlook' WHEN 4 THEN 'aol' WHEN 5 THEN 'icloud' END AS p_email,
         CAST((epoch_us(CAST(ts AS TIMESTAMP)) - 1704067200000000) // 1000000 AS BIGINT) AS dt
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

PROFILE = (
    TXN
    + """,
daily AS (
  SELECT *, row_number() OVER d AS day_n, sum(amount) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING) AS day_sum
  FROM txn WINDOW d AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, transaction_id)
),
prof AS (
  SELECT *, count(*) OVER b AS total_transactions, coalesce(sum(amount) OVER b, 0) AS total_amount, lag(ts) OVER u AS last_ts,
         coalesce(lag(amount) OVER u, 0) AS last_amount, coalesce(max(amount) OVER b, 0) AS max_amount_before,
         coalesce(lag(day_n) OVER u, 0) AS daily_count, coalesce(lag(day_sum) OVER u, 0) AS daily_amount
  FROM daily WINDOW u AS (PARTITION BY user_id ORDER BY ts, transaction_id),
       b AS (PARTITION BY user_id ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
feat AS (
  SELECT *, CASE WHEN avg_amount > 0 THEN amount / avg_amount ELSE 1.0 END AS amount_vs_avg, CASE WHEN last_amount > 0 THEN amount / last_amount ELSE 1.0 END AS amount_vs_last,
         amount > 150 AS is_high_amount, hour(ts) < 6 OR hour(ts) > 22 AS is_unusual_hour, gap_seconds < 300 AS is_rapid, daily_count / 24.0::DOUBLE AS velocity
  FROM (SELECT *, CASE WHEN total_transactions > 0 THEN total_amount / total_transactions ELSE 0 END AS avg_amount,
               coalesce((epoch_us(ts) - epoch_us(last_ts)) / 1000000.0::DOUBLE, 0) AS gap_seconds FROM prof)
)"""
)

SCORED = (
    PROFILE
    + """,
scored AS (
  SELECT *, least(CASE WHEN amount_vs_avg > 5 THEN 0.3::DOUBLE WHEN amount_vs_avg > 3 THEN 0.2::DOUBLE WHEN amount_vs_avg > 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN is_high_amount THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN is_unusual_hour THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN is_rapid THEN 0.25::DOUBLE ELSE 0 END
      + CASE WHEN velocity > 10 THEN 0.2::DOUBLE WHEN velocity > 5 THEN 0.1::DOUBLE ELSE 0 END
      + CASE WHEN daily_count > 50 THEN 0.15::DOUBLE WHEN daily_count > 25 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS fraud_score,
    least(CASE WHEN is_high_amount THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN is_unusual_hour THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN is_rapid THEN 0.25::DOUBLE ELSE 0 END
      + CASE WHEN velocity > 10 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN amount_vs_avg > 5 THEN 0.2::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS ml_prediction
  FROM feat
)"""
)

ALERTS = (
    SCORED
    + """,
alert0 AS (SELECT * REPLACE (least(1.5::DOUBLE * fraud_score, 1.0::DOUBLE) AS fraud_score) FROM scored WHERE round(fraud_score, 6) >= 0.3),
alerts AS (
  SELECT *, CASE WHEN round(fraud_score, 6) >= 0.9 THEN 'CRITICAL'
    WHEN (round(fraud_score, 6) >= 0.7 OR (amount >= 1000 AND round(fraud_score, 6) >= 0.5)) AND (is_rapid OR velocity > 15) THEN 'HIGH'
    WHEN round(fraud_score, 6) >= 0.4 AND CAST(is_high_amount AS INT) + CAST(is_unusual_hour AS INT) + CAST(is_rapid AS INT) + CAST(velocity > 5 AS INT) >= 2 THEN 'MEDIUM'
    ELSE 'LOW' END AS severity
  FROM alert0
)"""
)
