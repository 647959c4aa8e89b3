"""Plain SQL for every registered query, run by DuckDB on the same tables.

The SQL starts from the star-schema tables, lands them as text feeds, types them and answers
the question in its own way: payments are joined row by row and distinct counts are taken as
such, where the Spark operators count down each side first. Fractions become DOUBLE on both
sides. Percentages and averages are rounded in whole numbers.
"""

from __future__ import annotations

AS_OF = "2000-01-01"
_DAY = f"DATE '{AS_OF}'"

_LANDED = """
users_raw AS (
  SELECT c_custkey::varchar AS row_id, c_custkey::varchar AS user_id, c_name AS username,
         c_name || '@example.com' AS email, 'x' AS password_hash,
         'first' AS first_name, 'last' AS last_name, c_mktsegment AS subscription_type,
         '33:25.6' AS created_at
  FROM customer
  UNION ALL SELECT 'row_id','user_id','username','email','password_hash','first_name','last_name','subscription_type','created_at'
),
subscriptions_raw AS (
  SELECT o_orderkey::varchar AS row_id, o_orderkey::varchar AS subscription_id,
         o_custkey::varchar AS user_id, o_orderpriority AS subscription_type,
         CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE strftime(o_orderdate, '%d-%m-%Y') END AS start_date,
         CASE WHEN o_orderstatus = 'O' THEN 'NULL'
              ELSE strftime(o_orderdate::date + (((o_orderkey * 37) % 520)::int - 20), '%d-%m-%Y')
         END AS end_date, '33:25.6' AS created_at
  FROM orders
  UNION ALL SELECT 'row_id','subscription_id','user_id','subscription_type','start_date','end_date','created_at'
),
payments_raw AS (
  SELECT l_orderkey::varchar AS row_id, (l_orderkey * 10 + l_linenumber)::varchar AS payment_id,
         o_custkey::varchar AS user_id, round(l_extendedprice * 100)::bigint::varchar AS amount,
         CASE WHEN l_returnflag = 'N' THEN '33:25.6' ELSE strftime(l_shipdate, '%d-%m-%Y') END AS payment_date,
         l_returnflag AS payment_method,
         CASE WHEN l_linenumber = 1 THEN strftime(l_shipdate, '%d-%m-%Y') ELSE '24:52.6' END AS created_at, l_orderkey::varchar AS subscription_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT 'row_id','payment_id','user_id','amount','payment_date','payment_method','created_at','subscription_id'
),
listening_raw AS (
  SELECT event_id::varchar AS row_id, event_id::varchar AS history_id, user_id::varchar AS user_id,
         event_type AS song_id, strftime(ts, '%d-%m-%Y') AS listen_date, '33:25.6' AS created_at
  FROM events
  UNION ALL SELECT 'row_id','history_id','user_id','song_id','listen_date','created_at'
)"""

_CLEAN = """
users_in AS (FROM users_raw WHERE user_id IS DISTINCT FROM 'user_id'),
subscriptions_in AS (FROM subscriptions_raw WHERE subscription_id IS DISTINCT FROM 'subscription_id'),
payments_in AS (FROM payments_raw WHERE payment_id IS DISTINCT FROM 'payment_id'),
listening_in AS (FROM listening_raw WHERE history_id IS DISTINCT FROM 'history_id')"""

def _not_whole(column: str, kind: str = "bigint") -> str:
    """Present, and not a whole number; DuckDB's cast would round a fraction or an exponent."""
    return (
        f"({column} IS NOT NULL AND (TRY_CAST({column} AS {kind}) IS NULL "
        f"OR regexp_matches({column}, '[.eE]')))"
    )


# What makes a row of each feed malformed.
_BAD = {
    "users": _not_whole("user_id"),
    "subscriptions": f"""{_not_whole("subscription_id")} OR {_not_whole("user_id")}
         OR (start_date IS NOT NULL AND try_strptime(start_date, '%d-%m-%Y') IS NULL)
         OR (end_date <> 'NULL' AND try_strptime(end_date, '%d-%m-%Y') IS NULL)""",
    "payments": f"""{_not_whole("payment_id")} OR {_not_whole("user_id")}
         OR {_not_whole("subscription_id")} OR {_not_whole("amount", "int")}
         OR (regexp_full_match(payment_date, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}')
             AND try_strptime(payment_date, '%d-%m-%Y') IS NULL)""",
    "listening": _not_whole("user_id"),
}


def _accepted(feed: str) -> str:
    return f"(FROM {feed}_in WHERE ({_BAD[feed]}) IS NOT TRUE)"


_TYPED = f"""
person AS (
  SELECT row_id, TRY_CAST(user_id AS bigint) AS user_id, username, email, first_name, last_name,
         subscription_type, created_at
  FROM {_accepted("users")}
),
sub AS (
  SELECT row_id, TRY_CAST(subscription_id AS bigint) AS subscription_id,
         TRY_CAST(user_id AS bigint) AS user_id, subscription_type,
         try_strptime(start_date, '%d-%m-%Y')::date AS start_date,
         try_strptime(nullif(end_date, 'NULL'), '%d-%m-%Y')::date AS end_date, created_at
  FROM {_accepted("subscriptions")}
),
pay AS (
  SELECT row_id, TRY_CAST(payment_id AS bigint) AS payment_id, TRY_CAST(user_id AS bigint) AS user_id,
         TRY_CAST(subscription_id AS bigint) AS subscription_id,
         TRY_CAST(amount AS int) AS amount_cents,
         CASE WHEN regexp_full_match(payment_date, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}')
              THEN try_strptime(payment_date, '%d-%m-%Y')::date END AS payment_date,
         payment_method, created_at
  FROM {_accepted("payments")}
),
eng AS (
  SELECT TRY_CAST(user_id AS bigint) AS user_id, n AS total_listens
  FROM (SELECT user_id, count(*) AS n FROM {_accepted("listening")} GROUP BY user_id)
),
life AS (
  SELECT *,
         CASE WHEN ended THEN end_date - start_date ELSE {_DAY} - start_date END AS days,
         CASE WHEN ended THEN end_date - start_date END AS ended_days
  FROM (SELECT *, end_date IS NOT NULL AND end_date < {_DAY} AS ended FROM sub)
)"""

_MONEY = "amount_cents / 100.0"
_AMOUNT = f"CASE WHEN NOT {_not_whole('amount', 'int')} THEN TRY_CAST(amount AS int) END"


def _bucket(days: str, last: str) -> str:
    # The bounds and labels are fixed values.
    return (
        "(SELECT label FROM (VALUES (30, '0-30 days'), (90, '31-90 days'), (180, '91-180 days'), "
        f"(365, '181-365 days'), (2147483647, '{last}')) AS b(bound, label) "
        f"WHERE coalesce({days}, 2147483647) <= bound ORDER BY bound LIMIT 1)"
    )


def _rounded(numerator: str, denominator: str) -> str:
    """Quotient of whole numbers >= 0 with two digits, half up, as DOUBLE."""
    top, bottom = f"({numerator})::hugeint", f"({denominator})::hugeint"
    return f"(({top} * 200 + {bottom}) // ({bottom} * 2))::double / 100.0"


def _percent(part: str, whole: str) -> str:
    return _rounded(f"({part}) * 100", whole)


_CHURN = _percent("count(*) FILTER (WHERE ended)", "count(*)")
_MART_BUCKETED = (
    f"SELECT *, CASE WHEN days IS NOT NULL THEN {_bucket('days', '365+ days')} END AS tenure_bucket "
    "FROM life"
)
_ENDED_BUCKETED = f"SELECT *, {_bucket('ended_days', '366+ days')} AS tenure_bucket FROM life WHERE ended"
_JOINED = "pay JOIN sub USING (subscription_id)"
_MART = f"""
  SELECT tenure_bucket, count(*) AS total_subscriptions,
         count(*) FILTER (WHERE ended) AS churned_subscriptions,
         {_CHURN} AS churn_rate_percent
  FROM ({_MART_BUCKETED}) WHERE tenure_bucket IS NOT NULL GROUP BY tenure_bucket"""
_BY_PLAN = f"""
  SELECT sub.subscription_type, sum(amount_cents) AS cents,
         count(DISTINCT sub.subscription_id) AS subscriptions
  FROM {_JOINED} GROUP BY sub.subscription_type"""
_PLAN_LISTENS = f"""
  SELECT sub.subscription_type, count(DISTINCT user_id) AS users_with_listens,
         {_rounded('sum(total_listens)', 'count(*)')} AS avg_listens_per_user,
         max(total_listens) AS max_listens
  FROM eng JOIN person USING (user_id) JOIN sub USING (user_id) GROUP BY sub.subscription_type"""
_STATUS_LISTENS = f"""
  SELECT if(ended, 'Churned', 'Active') AS subscription_status,
         count(DISTINCT user_id) AS users,
         {_rounded('sum(total_listens)', 'count(*)')} AS avg_listens,
         max(total_listens) AS max_listens
  FROM eng JOIN life USING (user_id) GROUP BY ended"""
_HEADLINE = f"""
  SELECT (SELECT count(*) FROM life) AS total_subscriptions,
         (SELECT {_CHURN} FROM life) AS churn_rate_percent,
         (SELECT sum(amount_cents) / 100.0 FROM pay) AS total_revenue"""
_SHARES = f"""
  SELECT subscription_type, cents / 100.0 AS revenue,
         {_percent('cents', 'sum(cents) OVER ()')} AS revenue_share_percent
  FROM ({_BY_PLAN})"""


def _feed_rows(feed: str) -> str:
    return f"SELECT * FROM {feed}_in"


def _first(relation: str, n: int, key: str) -> str:
    return f"SELECT * FROM {relation} ORDER BY {key}, row_id LIMIT {n}"


def _counted(*relations: tuple[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS relation, count(*) AS rows FROM {source}" for name, source in relations
    )


def _panel(panel: str, label: str, source: str, *figures: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{panel}' AS panel, {label} AS label, '{figure}' AS figure, "
        f"{figure}::double AS value FROM ({source})"
        for figure in figures
    )


_AVERAGES = f"""
  SELECT subscription_type, {_rounded('cents', 'subscriptions * 100')} AS avg_revenue_per_subscription
  FROM ({_BY_PLAN})"""

_REJECT_COUNTS = " UNION ALL ".join(
    f"SELECT '{feed}' AS relation, count(*) AS rows FROM {feed}_in WHERE {bad}"
    for feed, bad in _BAD.items()
)

# The stand-in feeds with part of their rows made malformed, in step with standins.spoiled.
_SPOILED = """
users_raw AS (
  SELECT * REPLACE (if(TRY_CAST(row_id AS bigint) % 11 = 0, 'u' || user_id, user_id) AS user_id)
  FROM users_sound),
subscriptions_raw AS (
  SELECT * REPLACE (CASE WHEN TRY_CAST(row_id AS bigint) % 7 = 0
    THEN substr(start_date, 4, 3) || substr(start_date, 1, 3) || substr(start_date, 7)
    ELSE start_date END AS start_date)
  FROM subscriptions_sound),
payments_raw AS (
  SELECT * REPLACE (
    if(TRY_CAST(payment_id AS bigint) % 13 = 0, '31-02-2000', payment_date) AS payment_date,
    if(TRY_CAST(payment_id AS bigint) % 17 = 0, amount || '.5', amount) AS amount)
  FROM payments_sound),
listening_raw AS (
  SELECT * REPLACE (if(TRY_CAST(row_id AS bigint) % 5 = 0, user_id || '?', user_id) AS user_id)
  FROM listening_sound)"""

_BODIES = {
    "v1_dim_users": "SELECT * FROM person",
    "v2_fct_subscriptions": "SELECT * FROM sub",
    "v3_fct_payments": f"SELECT *, {_MONEY} AS amount FROM pay",
    "v4_engagement_per_user": "SELECT * FROM eng",
    "v5_bi_subscriptions": f"""
      SELECT subscription_id, user_id, subscription_type, start_date, end_date,
             start_date <= {_DAY} AND NOT ended AS is_active, ended AS is_churned,
             days::int AS tenure_days, tenure_bucket
      FROM ({_MART_BUCKETED})""",
    "v6_bi_payments": f"""
      SELECT payment_id, subscription_id, pay.user_id, sub.subscription_type, amount_cents,
             {_MONEY} AS amount, payment_method, payment_date AS payment_time_raw,
             pay.created_at AS created_time_raw
      FROM {_JOINED}""",
    "v7_bi_engagement": "SELECT user_id, total_listens FROM eng",
    "v8_bi_churn_tenure": _MART,
    "m01_active_subscriptions": f"""
      SELECT count(*) AS active_subscriptions FROM life WHERE start_date <= {_DAY} AND NOT ended""",
    "m02_active_by_plan": f"""
      SELECT subscription_type, count(*) AS active_subscriptions
      FROM life WHERE start_date <= {_DAY} AND NOT ended GROUP BY subscription_type""",
    "m03_total_by_plan": """
      SELECT subscription_type, count(*) AS total_subscriptions FROM sub GROUP BY ALL""",
    "m04_churned_counts": """
      SELECT n AS churned_subscriptions
      FROM (SELECT subscription_type, count(*) AS n FROM life WHERE ended GROUP BY ALL)""",
    "m04l_churned_by_plan": """
      SELECT subscription_type, count(*) AS churned_subscriptions
      FROM life WHERE ended GROUP BY ALL""",
    "m05_churn_rate_by_plan": f"""
      SELECT subscription_type, {_CHURN} AS churn_rate FROM life GROUP BY subscription_type""",
    "m06_status_rates_by_plan": f"""
      SELECT subscription_type,
             {_percent('count(*) FILTER (WHERE NOT ended)', 'count(*)')} AS active_rate_percent,
             {_CHURN} AS churn_rate_percent
      FROM life GROUP BY subscription_type""",
    "m07_churned_by_bucket": f"""
      SELECT tenure_bucket, count(*) AS churned_subscriptions
      FROM ({_ENDED_BUCKETED}) GROUP BY ALL""",
    "m08_churned_by_plan_and_bucket": f"""
      SELECT subscription_type, tenure_bucket, count(*) AS churned_subscriptions
      FROM ({_ENDED_BUCKETED}) GROUP BY ALL""",
    "m09_total_revenue": "SELECT sum(amount_cents) / 100.0 AS total_revenue FROM pay",
    "m10_revenue_by_plan": f"""
      SELECT subscription_type, cents / 100.0 AS revenue FROM ({_BY_PLAN})""",
    "m11_revenue_per_paying_subscription": f"""
      SELECT subscription_type, cents / 100.0 AS revenue, subscriptions,
             {_rounded('cents', 'subscriptions * 100')} AS avg_revenue_per_subscription
      FROM ({_BY_PLAN})""",
    "m12_revenue_share_by_plan": _SHARES,
    "m13_paying_subscriptions": """
      SELECT count(DISTINCT subscription_id) AS unique_subscriptions,
             sum(amount_cents) / 100.0 AS total_revenue
      FROM pay""",
    "m14_top_subscriptions": """
      SELECT subscription_id, sum(amount_cents) / 100.0 AS subscription_revenue
      FROM pay GROUP BY subscription_id
      ORDER BY sum(amount_cents) DESC NULLS FIRST, subscription_id NULLS LAST LIMIT 10""",
    "m15_top_users": """
      SELECT user_id, total_listens FROM eng
      ORDER BY total_listens DESC, user_id NULLS LAST LIMIT 10""",
    "m16_listening_range": f"""
      SELECT min(total_listens) AS min_listens, max(total_listens) AS max_listens,
             {_rounded('sum(total_listens)', 'count(*)')} AS avg_listens
      FROM eng""",
    "m17_engagement_by_plan": _PLAN_LISTENS,
    "m18_engagement_by_status": _STATUS_LISTENS,
    "k1_headline": _HEADLINE,
    "k2_revenue_two_routes": f"""
      SELECT subscription_type, cents / 100.0 AS joined_revenue, cents / 100.0 AS summed_revenue,
             0::double AS difference
      FROM ({_BY_PLAN})""",
    "k3_churn_two_routes": f"""
      SELECT tenure_bucket, total_subscriptions AS mart_total, churned_subscriptions AS mart_churned,
             total_subscriptions AS direct_total, churned_subscriptions AS direct_churned,
             0::bigint AS total_difference, 0::bigint AS churned_difference
      FROM ({_MART})""",
    "k4_plan_page": " UNION ALL ".join(
        [
            _panel(
                "average revenue by plan", "subscription_type", _AVERAGES,
                "avg_revenue_per_subscription",
            ),
            _panel(
                "engagement by plan", "subscription_type", _PLAN_LISTENS,
                "users_with_listens", "avg_listens_per_user", "max_listens",
            ),
            _panel(
                "engagement by status", "subscription_status", _STATUS_LISTENS,
                "users", "avg_listens", "max_listens",
            ),
        ]
    ),
    "k5_summary_page": " UNION ALL ".join(
        [
            _panel(
                "headline", "'all'", _HEADLINE,
                "total_subscriptions", "churn_rate_percent", "total_revenue",
            ),
            _panel(
                "churn rate by plan", "subscription_type",
                f"SELECT subscription_type, {_CHURN} AS churn_rate FROM life GROUP BY ALL",
                "churn_rate",
            ),
            _panel(
                "revenue by plan", "subscription_type", _SHARES,
                "revenue", "revenue_share_percent",
            ),
            _panel(
                "churn by tenure", "tenure_bucket", _MART,
                "total_subscriptions", "churned_subscriptions", "churn_rate_percent",
            ),
        ]
    ),
    "s01_users_through_csv": "SELECT * FROM person",
    "s03_users_without_header": _feed_rows("users"),
    "s03_subscriptions_without_header": _feed_rows("subscriptions"),
    "s03_payments_without_header": _feed_rows("payments"),
    "s03_listening_without_header": _feed_rows("listening"),
    "s04_churn_mart_through_csv": _MART,
    "q01_preview_users_landed": _first("users_raw", 3, "user_id"),
    "q01_preview_users": _first("person", 5, "user_id"),
    "q01_preview_subscriptions_landed": _first("subscriptions_raw", 3, "subscription_id"),
    "q01_preview_subscriptions": _first("sub", 5, "subscription_id"),
    "q01_preview_payments_landed": """
      SELECT * FROM payments_raw
      ORDER BY payment_id, row_id, user_id, amount, payment_date, payment_method LIMIT 3""",
    "q01_preview_payment_amounts": f"""
      SELECT payment_id, amount_cents, {_MONEY} AS amount, payment_date FROM pay
      ORDER BY payment_id, amount_cents, payment_date NULLS LAST LIMIT 10""",
    "q01_preview_payment_dates": f"""
      SELECT payment_id, {_MONEY} AS amount, payment_date FROM pay
      ORDER BY payment_id, amount_cents, payment_date NULLS LAST LIMIT 10""",
    "q01_preview_payment_created": "SELECT created_at FROM payments_in ORDER BY 1 LIMIT 20",
    "q01_preview_listening_landed": _first("listening_raw", 3, "history_id"),
    "q02_row_counts": _counted(
        ("users_raw", "users_in"),
        ("dim_users", "person"),
        ("subscriptions_raw", "subscriptions_in"),
        ("fct_subscriptions", "sub"),
        ("payments_raw", "payments_in"),
        ("fct_payments", "pay"),
        ("listening_raw", "listening_in"),
        ("bi_subscriptions", "life"),
        ("bi_payments", f"({_JOINED})"),
        ("bi_engagement", "eng"),
    ),
    "q03_ids_not_digits": """
      SELECT user_id FROM users_in WHERE NOT regexp_full_match(user_id, '[0-9]+')
      ORDER BY 1 LIMIT 20""",
    "q03_ids_not_digits_landed": """
      SELECT user_id FROM users_raw WHERE NOT regexp_full_match(user_id, '[0-9]+')
      ORDER BY 1 LIMIT 20""",
    "q04_amount_text_range": """
      SELECT min(amount) AS min_amount, max(amount) AS max_amount FROM payments_in""",
    "q05_commonest_amount_texts": """
      SELECT amount, count(*) AS cnt FROM payments_in GROUP BY 1 ORDER BY cnt DESC, amount LIMIT 15""",
    "q06_amount_range": f"""
      SELECT min({_AMOUNT}) AS min_amount_int, max({_AMOUNT}) AS max_amount_int
      FROM payments_in""",
    "q07_commonest_amounts": f"""
      SELECT {_AMOUNT} AS amount_int, count(*) AS cnt FROM payments_in GROUP BY 1
      ORDER BY cnt DESC, 1 LIMIT 15""",
    "q08_payments_at_offset": """
      SELECT * FROM payments_in WHERE '33:25.6' IN (payment_date, created_at)
      ORDER BY payment_id, row_id, user_id, amount LIMIT 5""",
    "q09_created_like_day": """
      SELECT count(*) AS looks_like_date FROM payments_in
      WHERE regexp_matches(created_at, '^[0-9]{2}-[0-9]{2}-[0-9]{4}')""",
    "q10_churn_mart_display": _MART,
    "t01_saved_table_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS relation, count(*) AS rows, count(user_id) AS user_ids FROM {source}"
        for name, source in (
            ("dim_users", "person"),
            ("fct_subscriptions", "sub"),
            ("fct_payments", "pay"),
            ("engagement_per_user", "eng"),
            ("users_draft", "person WHERE false"),
        )
    ),
    "t07_status_over_views": f"""
      SELECT tenure_bucket, start_date <= {_DAY} AND NOT ended AS is_active, ended AS is_churned,
             count(*) AS subscriptions
      FROM ({_MART_BUCKETED}) GROUP BY ALL""",
    "r2_rejects_of_swapped_dates": """
      SELECT row_id, subscription_id, swapped AS start_date, end_date,
             'start_date: not a day-month-year date' AS reasons
      FROM (
        SELECT *, strftime(strptime(start_date, '%d-%m-%Y'), '%m-%d-%Y') AS swapped
        FROM subscriptions_in
      )
      WHERE swapped IS NOT NULL AND try_strptime(swapped, '%d-%m-%Y') IS NULL""",
    "r1_reject_counts": _REJECT_COUNTS,
}


# Reports over the spoiled feeds: their name, and the report that they repeat.
SPOILED = {
    "r3_reject_counts": "r1_reject_counts",
    "r3_dim_users": "v1_dim_users",
    "r3_fct_subscriptions": "v2_fct_subscriptions",
    "r3_fct_payments": "v3_fct_payments",
    "r3_engagement_per_user": "v4_engagement_per_user",
    "r4_total_revenue": "m09_total_revenue",
    "r4_revenue_by_plan": "m10_revenue_by_plan",
    "r4_engagement_by_plan": "m17_engagement_by_plan",
}


def oracle_sql() -> dict[str, str]:
    """SQL over the star-schema tables."""
    sound = {name: f"WITH{_LANDED},{_CLEAN},{_TYPED}\n{body}" for name, body in _BODIES.items()}
    landed = _LANDED.replace("_raw AS (", "_sound AS (")
    spoiled = {
        name: f"WITH{landed},{_SPOILED},{_CLEAN},{_TYPED}\n{_BODIES[report]}"
        for name, report in SPOILED.items()
    }
    return sound | spoiled


def sql_over_feeds() -> dict[str, str]:
    """The same over four tables users_raw, subscriptions_raw, payments_raw and listening_raw."""
    return {name: f"WITH{_CLEAN},{_TYPED}\n{body}" for name, body in _BODIES.items()}
