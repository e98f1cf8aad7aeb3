"""Credit ledger, managed requests and administration: ordered folds per account, and aggregates over their results."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.rounds import written

OPERATIONS = ("grant", "charge", "refund", "adjust")
#: Statuses whose reservation still holds credits.
HOLDING = ("RESERVED", "FINALIZATION_FAILED")


def transaction_error(kind: Column, amount: Column, request: Column) -> Column:
    """Why a transaction (grant, usage, refund, adjustment) can't be: AMOUNT, SIGN, REQUEST or null."""
    sign = F.when(kind.isin("grant", "refund"), amount > 0).when(kind == "usage", amount < 0).when(kind == "adjustment", F.lit(True))
    return (
        F.when(amount.isNull() | (amount == 0), "AMOUNT")
        .when(~F.coalesce(sign, F.lit(False)), "SIGN")
        .when(kind.isin("usage", "refund") & (F.trim(F.coalesce(request, F.lit(""))) == ""), "REQUEST")
    )


def account_id(c: Column) -> Column:
    """A trimmed id; raises if nothing is left."""
    t = F.trim(c)
    return F.when(F.coalesce(t, F.lit("")) == "", F.raise_error(F.lit("empty id")).cast("string")).otherwise(t)


def balances(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("account_id").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("balance"))


def available(transactions: DataFrame, requests: DataFrame) -> DataFrame:
    """account_id, balance, reserved, available: what running requests hold is not available."""
    held = requests.filter(F.col("status").isin(*HOLDING)).groupBy("account_id").agg(F.sum("reserved_credits").alias("reserved"))
    both = balances(transactions).join(held, "account_id", "full_outer")
    b, r = F.coalesce("balance", F.lit(0)), F.coalesce("reserved", F.lit(0))
    return both.select("account_id", b.alias("balance"), r.alias("reserved"), (b - r).alias("available"))


def history(transactions: DataFrame, account: str) -> DataFrame:
    return transactions.filter(F.col("account_id") == account).orderBy("sequence")


def first_writes(transactions: DataFrame) -> DataFrame:
    """Keyed transactions once per (type, account, request): the first by sequence, and whether a later one says otherwise."""
    key = Window.partitionBy("type", "account_id", "request_id")
    first = Window.partitionBy("type", "account_id", "request_id").orderBy("sequence")
    same = F.min(F.struct("amount", "note")).over(key).eqNullSafe(F.max(F.struct("amount", "note")).over(key))
    return transactions.filter("request_id is not null").withColumns({"_n": F.row_number().over(first), "conflict": ~same}).filter("_n = 1").drop("_n")


def idempotent_lookup(keys: DataFrame, transactions: DataFrame) -> DataFrame:
    """The transactions that keys (type, account_id, request_id, transaction_id) point to."""
    return keys.join(transactions.drop("type", "account_id", "request_id"), "transaction_id")


FOLD = "account_id string, seq long, op string, status string, amount long, balance long"


def _fold_account(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Applies the ordered operations of accounts that come one after the other."""
    account, balance, done = None, 0, {}
    for frame in rows:
        out = []
        for a, seq, op, request, amount, note in frame[["account_id", "seq", "op", "request_id", "amount", "note"]].itertuples(index=False, name=None):
            if a != account:
                account, balance, done = a, 0, {}
            request = None if request is None or request != request else request
            signed = -amount if op == "charge" else amount
            key = (op, request) if op in ("charge", "refund") else None
            if op not in OPERATIONS or amount == 0 or (op != "adjust" and amount < 0) or (key and not request):
                status = "invalid"
            elif key and key in done:
                status = "replayed" if done[key] == (amount, note) else "conflict"
            elif balance + signed < 0 and op in ("charge", "adjust"):
                status = "rejected"
            else:
                status = "applied"
                balance += signed
                if key:
                    done[key] = (amount, note)
            out.append((a, seq, op, status, signed if status == "applied" else 0, balance))
        yield pd.DataFrame(out, columns=["account_id", "seq", "op", "status", "amount", "balance"])


def apply_operations(operations: DataFrame) -> DataFrame:
    """The outcome of every operation (account_id, seq, op, request_id, amount, note), in order within its account.

    Charges and adjustments that would make the balance negative are rejected; a repeated charge or refund with the same
    request is replayed, or a conflict if amount or note differ. Accounts are sorted within partitions and streamed, so
    an account's history is never held as a whole, only its request keys.
    """
    ordered = operations.select(F.col("account_id").cast("string").alias("account_id"), F.col("seq").cast("long").alias("seq"), "op", "request_id", F.col("amount").cast("long").alias("amount"), F.coalesce("note", F.lit("")).alias("note"))
    return ordered.repartition("account_id").sortWithinPartitions("account_id", "seq").mapInPandas(_fold_account, FOLD)


MANAGED = "account_id string, seq long, request_id string, status string, reserved long, charged long, available long"


def _fold_requests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    account = None
    for frame in rows:
        out = []
        for a, seq, event, request, amount in frame[["account_id", "seq", "event", "request_id", "amount"]].itertuples(index=False, name=None):
            if a != account:
                account, balance, open_, closed = a, 0, {}, {}
            status, reserved, charged = "ignored", 0, 0
            if event == "grant":
                balance, status = balance + amount, "GRANTED"
            elif event == "reserve":
                if request in open_ or request in closed:
                    status = closed.get(request, "RESERVED")
                elif balance - sum(open_.values()) < amount:
                    status = "REFUSED"
                else:
                    open_[request], status, reserved = amount, "RESERVED", amount
            elif request in open_ and event == "finalize":
                if amount <= open_[request]:
                    del open_[request]
                    balance, status, charged = balance - amount, "SUCCEEDED", amount
                    closed[request] = status
                else:  # more than was reserved: the reservation stays
                    status, reserved = "FINALIZATION_FAILED", open_[request]
            elif request in open_ and event == "fail":
                del open_[request]
                status = closed[request] = "FAILED"
            out.append((a, seq, request, status, reserved, charged, balance - sum(open_.values())))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MANAGED.split(", ")])


def managed_requests(events: DataFrame) -> DataFrame:
    """Reserve, finalize, fail and grant events (account_id, seq, event, request_id, amount) in order: a reservation needs so many credits available, ends once, and costs at most what it reserved."""
    ordered = events.select(F.col("account_id").cast("string").alias("account_id"), F.col("seq").cast("long").alias("seq"), "event", F.coalesce(F.col("request_id").cast("string"), F.lit("")).alias("request_id"), F.col("amount").cast("long").alias("amount"))
    return ordered.repartition("account_id").sortWithinPartitions("account_id", "seq").mapInPandas(_fold_requests, MANAGED)


def replay(requests: DataFrame) -> DataFrame:
    """What a repeated request gets: the metadata of one that succeeded, never its content; an error for others."""
    answer = F.when(F.col("status") == "SUCCEEDED", "metadata").when(F.col("status") == "RESERVED", "IN_PROGRESS").otherwise("FAILED_BEFORE")
    return requests.withColumn("answer", answer)


def success_metadata(requests: DataFrame, usage: DataFrame) -> DataFrame:
    """Charged credits and usage of each request; the reserved credits where no usage is recorded."""
    return requests.join(usage, ["account_id", "request_id"], "left").withColumn("credits", F.coalesce("charged_credits", "reserved_credits"))


def migrate_requests(requests: DataFrame) -> DataFrame:
    """Old rows with the columns that came later: pricing policy `flat:v1:<credits>`, actual credits, usage known."""
    have = set(requests.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    return requests.withColumns({
        "pricing_policy_id": F.coalesce(col("pricing_policy_id", "string"), F.concat(F.lit("flat:v1:"), F.col("reserved_credits").cast("string"))),
        "actual_credits": F.coalesce(col("actual_credits", "long"), F.when(F.col("status") == "SUCCEEDED", F.col("reserved_credits"))),
    })


def backfill(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records plus one for each succeeded request that has none."""
    new = requests.filter("status = 'SUCCEEDED'").join(records.select("account_id", "request_id"), ["account_id", "request_id"], "left_anti")
    return records.unionByName(new.select(*records.columns))


def admin_operations(operations: DataFrame) -> DataFrame:
    """Administrators' grants and adjustments (actor, operation_id, account_id, type, amount, reason, seq), each (actor, operation) once: applied, replayed or conflict."""
    first = Window.partitionBy("actor", "operation_id").orderBy("seq")
    payload = F.struct("account_id", "type", "amount", "reason")
    same = payload.eqNullSafe(F.first(payload).over(first))
    return operations.withColumn("outcome", F.when(F.row_number().over(first) == 1, "applied").when(same, "replayed").otherwise("conflict"))


def append_transactions(path: str, rows: DataFrame) -> DataFrame:
    """Adds the transactions (account_id, type, amount, request_id, note, sequence) that aren't there yet, with a new id and the time of writing; returns what each became.

    A type, account and request is written once: of several rows the first by sequence, and none if the table has it
    already. outcome: applied, replayed (the same amount and note) or conflict. Rows without a request are always applied.
    The outcome of a second writer at the same moment is left to a table format with transactions.
    """
    spark = rows.sparkSession
    key = ["type", "account_id", "request_id"]
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    keyed = rows.filter("request_id is not null")
    # written once, so that ids and outcomes are the same in the table and in the answer
    first = Window.partitionBy(*key).orderBy("sequence")
    ranked = keyed.withColumns({"_n": F.row_number().over(first), "_amount": F.first("amount").over(first), "_note": F.first("note").over(first)})
    if exists:
        known = spark.read.parquet(path).filter("request_id is not null").select(*key, F.col("amount").alias("_had"), F.col("note").alias("_said"), F.lit(True).alias("_known"))
        ranked = ranked.join(known, key, "left").withColumns({"_amount": F.when(F.col("_known"), F.col("_had")).otherwise(F.col("_amount")), "_note": F.when(F.col("_known"), F.col("_said")).otherwise(F.col("_note"))})
    else:
        ranked = ranked.withColumn("_known", F.lit(None).cast("boolean"))
    same = F.col("amount").eqNullSafe(F.col("_amount")) & F.col("note").eqNullSafe(F.col("_note"))
    outcome = F.when(F.col("_known").isNull() & (F.col("_n") == 1), "applied").when(same, "replayed").otherwise("conflict")
    judged = ranked.withColumn("outcome", outcome).select(*rows.columns, "outcome").unionByName(rows.filter("request_id is null").withColumn("outcome", F.lit("applied")))
    judged, _ = written(judged.withColumns({"transaction_id": F.uuid(), "created_at": F.current_timestamp()}), "outcomes")
    judged.filter("outcome = 'applied'").drop("outcome").write.mode("append").parquet(path)
    return judged


class FlatPricing:
    """A fixed price for each request."""

    def __init__(self, credits: int):
        if isinstance(credits, bool) or not isinstance(credits, int) or credits < 1:
            raise ValueError("the price is a whole number above 0")
        self.credits, self.policy_id = credits, f"flat:v1:{credits}"

    def reserve(self) -> Column:
        return F.lit(self.credits).cast("long")

    def price(self, tokens_in: Column, tokens_out: Column) -> Column:
        return F.lit(self.credits).cast("long")


class TokenPricing:
    """Rates per 1000 tokens of a provider's model, up to its limits; the reservation is the price of both limits."""

    def __init__(self, provider: str, model: str, rate_in: str, rate_out: str, max_in: int, max_out: int):
        if max_in < 0 or max_out < 0 or not (Decimal(rate_in) * max_in + Decimal(rate_out) * max_out) > 0:
            raise ValueError("the limits must give a reservation above 0")
        self.provider, self.model, self.rate_in, self.rate_out, self.max_in, self.max_out = provider, model, rate_in, rate_out, max_in, max_out

    def _of(self, a: Column, b: Column) -> Column:
        from codeloom.functions.numeric import token_price

        return token_price(a, b, F.lit(self.rate_in), F.lit(self.rate_out)).cast("long")

    def reserve(self) -> Column:
        return self._of(F.lit(self.max_in), F.lit(self.max_out))

    def price(self, tokens_in: Column, tokens_out: Column) -> Column:
        over = (tokens_in > self.max_in) | (tokens_out > self.max_out) | (tokens_in < 0) | (tokens_out < 0)
        return F.when(over, F.raise_error(F.lit("usage beyond the limits")).cast("long")).otherwise(self._of(tokens_in, tokens_out))

    def price_usage(self, usage: DataFrame) -> DataFrame:
        """Usage (provider, model, tokens_in, tokens_out) with `credits`; another provider or model raises."""
        other = (F.col("provider") != self.provider) | (F.col("model") != self.model)
        return usage.withColumn("credits", F.when(other, F.raise_error(F.lit("another provider or model")).cast("long")).otherwise(self.price(F.col("tokens_in"), F.col("tokens_out"))))


def payload_hash(fields: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns as JSON with sorted names, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
