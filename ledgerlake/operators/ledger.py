"""Billing: invoice generation, double-entry posting, balances, trial balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefns import as_of_date, as_of_ts
from ..schemas import MONEY, MONEY_SUM, PAYMENT_TERMS_DAYS

AR_ACCOUNT = "accounts_receivable"
REVENUE_ACCOUNT = "revenue"


def generate_invoices(orders: DataFrame, invoices: DataFrame, as_of,
                      terms_days: int = PAYMENT_TERMS_DAYS) -> DataFrame:
    """One new invoice per distinct order not yet invoiced: amount = order
    total, status issued, issued at ``as_of``, due ``as_of + terms``; an
    explicit ``due_date`` column on the order wins."""
    new = orders.join(invoices.select(F.col("order_id").alias("id")), "id", "left_anti")
    # Of rows that repeat an order the earliest counts (then the smallest total).
    order = [c for c in ("created_at", "total_amount", "due_date") if c in orders.columns]
    new = new.groupBy("id").agg(F.min(F.struct(*order)).alias("m")).select("id", "m.*")
    default_due = F.date_add(as_of_date(as_of), terms_days)
    due = F.coalesce(F.col("due_date"), default_due) if "due_date" in orders.columns else default_due
    return new.select(
        F.col("id").alias("id"), F.col("id").alias("order_id"),
        F.col("total_amount").alias("amount"), F.lit("issued").alias("status"),
        as_of_ts(as_of).alias("issued_at"), due.alias("due_date"))


def post_invoices(invoices: DataFrame) -> DataFrame:
    """Two ledger rows per invoice: debit receivables, credit revenue.
    Generated row-locally with ``explode`` (no shuffle)."""
    zero = F.lit(0).cast(MONEY)
    amt = F.col("amount").cast(MONEY)
    entries = F.array(
        F.struct(F.lit(AR_ACCOUNT).alias("account"), amt.alias("debit"), zero.alias("credit"),
                 F.lit("AR debit").alias("kind")),
        F.struct(F.lit(REVENUE_ACCOUNT).alias("account"), zero.alias("debit"), amt.alias("credit"),
                 F.lit("Revenue credit").alias("kind")))
    return (invoices.select("id", "order_id", "issued_at", F.explode(entries).alias("e"))
            .select("e.account", "e.debit", "e.credit", F.lit("invoice").alias("ref_type"),
                    F.col("id").alias("ref_id"),
                    F.concat(F.lit("Invoice for order "), F.col("order_id").cast("string"),
                             F.lit(" - "), F.col("e.kind")).alias("description"),
                    F.col("issued_at").alias("created_at")))


def account_balances(ledger: DataFrame) -> DataFrame:
    """Per account: debits, credits, balance, entries, last transaction.
    Few accounts hold all rows; the partial (map-side) aggregate keeps the
    shuffle at one row per account per map task."""
    return ledger.groupBy("account").agg(
        F.sum("debit").cast(MONEY_SUM).alias("total_debit"),
        F.sum("credit").cast(MONEY_SUM).alias("total_credit"),
        F.sum(F.col("debit") - F.col("credit")).cast(MONEY_SUM).alias("balance"),
        F.count(F.lit(1)).alias("entry_count"),
        F.max("created_at").alias("last_transaction"))


def ledger_unbalanced(ledger: DataFrame) -> DataFrame:
    """References whose debits and credits differ (empty when balanced)."""
    return (ledger.groupBy("ref_type", "ref_id")
            .agg(F.sum("debit").cast(MONEY_SUM).alias("total_debit"),
                 F.sum("credit").cast(MONEY_SUM).alias("total_credit"))
            .filter(F.col("total_debit") != F.col("total_credit")))


def trial_balance(ledger: DataFrame) -> DataFrame:
    """One row: total debits, total credits and their difference (0)."""
    return ledger.agg(
        F.sum("debit").cast(MONEY_SUM).alias("total_debit"),
        F.sum("credit").cast(MONEY_SUM).alias("total_credit"),
        F.sum(F.col("debit") - F.col("credit")).cast(MONEY_SUM).alias("difference"))
