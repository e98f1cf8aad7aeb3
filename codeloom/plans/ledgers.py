"""Queries over the ledger, pricing and administration. Events stand for account operations, orders for managed requests, lineitem quantities for tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import numeric
from codeloom.operators import ledger, provenance

from ._common import table

CENTS = "cast(round(value * 100) as bigint)"
KIND = "case event_type when 'purchase' then 'usage' when 'click' then 'refund' when 'error' then 'adjustment' else 'grant' end"


def _transactions(spark, d):
    t = table(spark, d, "events")
    return t.select(F.col("event_id").alias("sequence"), F.concat(F.lit("t"), "event_id").alias("transaction_id"), F.concat(F.lit("u"), "user_id").alias("account_id"), F.expr(KIND).alias("type"), F.expr(f"case when event_type = 'purchase' then -{CENTS} when event_type = 'error' then {CENTS} - 5000 else {CENTS} end").alias("amount"), F.expr("case when event_type in ('purchase', 'click') then props end").alias("request_id"), F.col("event_type").alias("note"))


def _requests(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("u"), F.expr("o_custkey % 50")).alias("account_id"), F.col("o_orderkey").cast("string").alias("request_id"), F.expr("case when o_orderstatus = 'F' then 'SUCCEEDED' when o_orderstatus = 'O' then 'RESERVED' else 'FINALIZATION_FAILED' end").alias("status"), F.expr("cast(floor(o_totalprice) as bigint)").alias("reserved_credits"))


def account_balances(spark, d):
    return ledger.balances(_transactions(spark, d))


def available_credits(spark, d):
    return ledger.available(_transactions(spark, d), _requests(spark, d))


def account_history(spark, d):
    return ledger.history(_transactions(spark, d), "u3").select("sequence", "type", "amount")


def first_writes(spark, d):
    return ledger.first_writes(_transactions(spark, d)).select("transaction_id", "type", "account_id", "request_id", "amount", "conflict")


def idempotent_lookup(spark, d):
    t = _transactions(spark, d)
    keys = ledger.first_writes(t).select("type", "account_id", "request_id", "transaction_id")
    return ledger.idempotent_lookup(keys, t).select("type", "account_id", "request_id", "transaction_id", "amount", "sequence")


def transaction_errors(spark, d):
    t = _transactions(spark, d).withColumn("amount", F.expr("case when sequence % 17 = 0 then 0 when sequence % 19 = 0 then -amount else amount end"))
    error = ledger.transaction_error(F.col("type"), F.col("amount"), F.col("request_id"))
    return t.select("sequence", error.alias("error"))


def _operations(spark, d):
    t = table(spark, d, "events")
    return t.select(F.col("user_id").cast("string").alias("account_id"), F.col("event_id").alias("seq"), F.expr("case event_type when 'purchase' then 'charge' when 'click' then 'refund' when 'error' then 'adjust' else 'grant' end").alias("op"), F.expr("case when event_type in ('purchase', 'click') then props end").alias("request_id"), F.expr(f"{CENTS} - case when event_type = 'error' then 20000 else 0 end").alias("amount"), F.lit("").alias("note"))


def ledger_fold(spark, d):
    return ledger.apply_operations(_operations(spark, d))


def managed_requests(spark, d):
    t = table(spark, d, "events")
    return ledger.managed_requests(t.select(F.col("user_id").cast("string").alias("account_id"), F.col("event_id").alias("seq"), F.expr("case event_type when 'signup' then 'grant' when 'view' then 'reserve' when 'click' then 'finalize' when 'error' then 'fail' else 'reserve' end").alias("event"), F.get_json_object("props", "$.k").alias("request_id"), F.expr(CENTS).alias("amount")))


def _usage(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("tokens_in"), F.expr("cast(l_partkey % 1000 as bigint)").alias("tokens_out"))


def token_pricing(spark, d):
    p = numeric.token_price(F.col("tokens_in"), F.col("tokens_out"), F.lit("2.01").cast("decimal(18,9)"), F.lit("0.125").cast("decimal(18,9)"))
    return _usage(spark, d).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), p.cast("long").alias("credits"))


def exact_pricing(spark, d):
    """Prices beyond 38 digits; compared with short ones by scaling both."""
    usage = _usage(spark, d)
    price = numeric.exact_price_udf()
    big = lambda c: F.concat(F.col(c).cast("string"), F.lit("0" * 40))
    return usage.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), price(big("tokens_in"), big("tokens_out"), F.lit("1"), F.lit("2")).alias("credits"))


def decimal_text(spark, d):
    return table(spark, d, "lineitem").select(numeric.canonical_decimal(F.col("l_discount").cast("decimal(10,4)").cast("string")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def cost_estimate(spark, d):
    items = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("items"))
    total, tokens_in, tokens_out, cost = numeric.estimate_cost(F.col("items"), 350, 0.27, 1.1)
    return items.select("source", total.alias("tokens"), tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), cost.alias("cost"))


def request_migration(spark, d):
    return ledger.migrate_requests(_requests(spark, d)).select("request_id", "pricing_policy_id", "actual_credits")


def usage_backfill(spark, d):
    requests = _requests(spark, d).withColumn("charged_credits", F.col("reserved_credits"))
    known = requests.filter("cast(request_id as bigint) % 3 = 0").select("account_id", "request_id", F.lit(1).cast("long").alias("charged_credits"))
    full = ledger.backfill(known, requests)
    return ledger.success_metadata(requests.drop("charged_credits"), full).select("request_id", "credits")


def request_replay(spark, d):
    return ledger.replay(_requests(spark, d)).groupBy("answer").agg(F.count("*").alias("n"))


def admin_outcomes(spark, d):
    t = table(spark, d, "events").select(F.expr("concat('a', user_id % 3)").alias("actor"), F.get_json_object("props", "$.k").alias("operation_id"), F.col("user_id").cast("string").alias("account_id"), F.lit("grant").alias("type"), F.expr("event_id % 4").alias("amount"), F.lit("why").alias("reason"), F.col("event_id").alias("seq"))
    return ledger.admin_operations(t).select("seq", "outcome")


def review_delay(spark, d):
    """Orders as records: shipped long enough after the order."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_linenumber = 1")
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    both = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", provenance.offset_timestamp(iso("o_orderdate")).alias("a"), provenance.offset_timestamp(iso("l_shipdate")).alias("b"))
    return both.select("o_orderkey", provenance.reviewed_late_enough(F.col("a"), F.col("b")).alias("late_enough"))


def latency_percentiles(spark, d):
    """Nearest-rank percentiles of event values by type."""
    share = lambda s: F.expr(f"percentile_disc({s}) within group (order by value)").alias(f"p{int(s * 100)}")
    return table(spark, d, "events").groupBy("event_type").agg(*[share(s) for s in (0.5, 0.95, 0.99)])


QUERIES = {f.__name__: f for f in (
    account_balances, available_credits, account_history, first_writes, idempotent_lookup, transaction_errors, ledger_fold, managed_requests, token_pricing, exact_pricing,
    decimal_text, cost_estimate, request_migration, usage_backfill, request_replay, admin_outcomes, review_delay, latency_percentiles,
)}

_C = "round(value * 100)::BIGINT"
_TX = f"""tx AS (SELECT event_id AS sequence, 't' || event_id AS transaction_id, 'u' || user_id AS account_id, CASE event_type WHEN 'purchase' THEN 'usage' WHEN 'click' THEN 'refund' WHEN 'error' THEN 'adjustment' ELSE 'grant' END AS type,
  CASE WHEN event_type = 'purchase' THEN -{_C} WHEN event_type = 'error' THEN {_C} - 5000 ELSE {_C} END AS amount, CASE WHEN event_type IN ('purchase', 'click') THEN props END AS request_id, event_type AS note FROM events)"""
_RQ = "rq AS (SELECT 'u' || o_custkey % 50 AS account_id, o_orderkey::VARCHAR AS request_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RESERVED' ELSE 'FINALIZATION_FAILED' END AS status, floor(o_totalprice)::BIGINT AS reserved_credits FROM orders)"
_FIRST = "fw AS (SELECT *, min(amount) OVER k <> max(amount) OVER k OR min(note) OVER k <> max(note) OVER k AS conflict FROM tx WHERE request_id IS NOT NULL WINDOW k AS (PARTITION BY type, account_id, request_id) QUALIFY row_number() OVER (PARTITION BY type, account_id, request_id ORDER BY sequence) = 1)"

ORACLE = {
    "account_balances": f"WITH {_TX} SELECT account_id, sum(amount)::BIGINT AS balance FROM tx GROUP BY 1",
    "available_credits": f"WITH {_TX}, {_RQ}, b AS (SELECT account_id, sum(amount)::BIGINT AS b FROM tx GROUP BY 1), r AS (SELECT account_id, sum(reserved_credits)::BIGINT AS r FROM rq WHERE status <> 'SUCCEEDED' GROUP BY 1) SELECT coalesce(b.account_id, r.account_id) AS account_id, coalesce(b, 0) AS balance, coalesce(r, 0) AS reserved, coalesce(b, 0) - coalesce(r, 0) AS available FROM b FULL JOIN r ON b.account_id = r.account_id",
    "account_history": f"WITH {_TX} SELECT sequence, type, amount FROM tx WHERE account_id = 'u3'",
    "first_writes": f"WITH {_TX}, {_FIRST} SELECT transaction_id, type, account_id, request_id, amount, conflict FROM fw",
    "idempotent_lookup": f"WITH {_TX}, {_FIRST} SELECT type, account_id, request_id, transaction_id, amount, sequence FROM fw",
    "transaction_errors": f"WITH {_TX}, t AS (SELECT sequence, type, request_id, CASE WHEN sequence % 17 = 0 THEN 0 WHEN sequence % 19 = 0 THEN -amount ELSE amount END AS amount FROM tx) SELECT sequence, CASE WHEN amount = 0 THEN 'AMOUNT' WHEN (type IN ('grant', 'refund') AND amount < 0) OR (type = 'usage' AND amount > 0) THEN 'SIGN' WHEN type IN ('usage', 'refund') AND request_id IS NULL THEN 'REQUEST' END AS error FROM t",
    "ledger_fold": f"""WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS account_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'charge' WHEN 'click' THEN 'refund' WHEN 'error' THEN 'adjust' ELSE 'grant' END AS op, CASE WHEN event_type IN ('purchase', 'click') THEN props END AS request, {_C} - CASE WHEN event_type = 'error' THEN 20000 ELSE 0 END AS given, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT account_id, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS op, '' AS status, 0::BIGINT AS amount, 0::BIGINT AS balance, []::VARCHAR[] AS done, []::BIGINT[] AS sums FROM (SELECT DISTINCT account_id FROM o)
  UNION ALL SELECT account_id, k, seq, op, status, CASE WHEN status = 'applied' THEN signed ELSE 0 END, had + CASE WHEN status = 'applied' THEN signed ELSE 0 END,
    CASE WHEN status = 'applied' AND name IS NOT NULL THEN list_append(done, name) ELSE done END, CASE WHEN status = 'applied' AND name IS NOT NULL THEN list_append(sums, given) ELSE sums END
  FROM (SELECT *, CASE WHEN given = 0 OR (op <> 'adjust' AND given < 0) OR (op IN ('charge', 'refund') AND request IS NULL) THEN 'invalid'
      WHEN name IS NOT NULL AND list_contains(done, name) THEN CASE WHEN sums[list_position(done, name)] = given THEN 'replayed' ELSE 'conflict' END
      WHEN had + signed < 0 AND op IN ('charge', 'adjust') THEN 'rejected' ELSE 'applied' END AS status
    FROM (SELECT o.*, r.balance AS had, r.done, r.sums, CASE WHEN o.op = 'charge' THEN -given ELSE given END AS signed, CASE WHEN o.op IN ('charge', 'refund') THEN o.op || ' ' || request END AS name FROM r JOIN o ON o.account_id = r.account_id AND o.k = r.k + 1)))
SELECT account_id, seq, op, status, amount, balance FROM r WHERE k > 0""",
    "token_pricing": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ceil((l_quantity::BIGINT * 2.01 + (l_partkey % 1000) * 0.125) / 1000)::BIGINT AS credits FROM lineitem",
    "exact_pricing": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_quantity::BIGINT + 2 * (l_partkey % 1000)) || repeat('0', 37) AS credits FROM lineitem",
    "decimal_text": "SELECT CASE WHEN l_discount::DECIMAL(10,4) = 0 THEN '0' ELSE rtrim(rtrim(l_discount::DECIMAL(10,4)::VARCHAR, '0'), '.') END AS text, count(*) AS n FROM lineitem GROUP BY 1",
    "cost_estimate": "SELECT source, n * 350 AS tokens, floor(n * 350 * 0.43::DOUBLE)::BIGINT AS tokens_in, floor(n * 350 * 0.57::DOUBLE)::BIGINT AS tokens_out, round((floor(n * 350 * 0.43::DOUBLE) * 0.27::DOUBLE + floor(n * 350 * 0.57::DOUBLE) * 1.1::DOUBLE) / 1e6, 4) AS cost FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
    "request_migration": f"WITH {_RQ} SELECT request_id, 'flat:v1:' || reserved_credits AS pricing_policy_id, CASE WHEN status = 'SUCCEEDED' THEN reserved_credits END AS actual_credits FROM rq",
    "usage_backfill": f"WITH {_RQ} SELECT request_id, CASE WHEN request_id::BIGINT % 3 = 0 THEN 1 ELSE reserved_credits END AS credits FROM rq",
    "request_replay": f"WITH {_RQ} SELECT CASE status WHEN 'SUCCEEDED' THEN 'metadata' WHEN 'RESERVED' THEN 'IN_PROGRESS' ELSE 'FAILED_BEFORE' END AS answer, count(*) AS n FROM rq GROUP BY 1",
    "admin_outcomes": "WITH o AS (SELECT event_id AS seq, 'a' || user_id % 3 AS actor, props::JSON->>'k' AS op, user_id, event_id % 4 AS amount FROM events) SELECT seq, CASE WHEN row_number() OVER w = 1 THEN 'applied' WHEN user_id = first_value(user_id) OVER w AND amount = first_value(amount) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM o WINDOW w AS (PARTITION BY actor, op ORDER BY seq)",
    "review_delay": "SELECT o_orderkey, epoch(date_trunc('second', l_shipdate)) - epoch(date_trunc('second', o_orderdate)) >= 172800 AS late_enough FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1",
}
