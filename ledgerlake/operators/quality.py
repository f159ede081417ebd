"""Constraint validation and referential checks as row-level data quality.

Each table constraint (CHECK, NOT NULL, enum, uniqueness, FK) becomes a
predicate; violating rows are reported with the rule name instead of the
write being rejected.  Row rules are evaluated in one pass per table
(``array_compact`` of ``when`` columns); uniqueness needs a group-by on the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INVOICE_STATUSES, LEDGER_REF_TYPES, ORDER_STATUSES, UUID_PATTERN


@dataclass(frozen=True)
class Rule:
    name: str
    ok: Column  # TRUE when the row satisfies the rule (NULL counts as violation)


def _nn(*cols: str) -> list[Rule]:
    return [Rule(f"{c}_not_null", F.col(c).isNotNull()) for c in cols]


def uuid_rule(col: str) -> Rule:
    """8-4-4-4-12 hex UUID format (for string id columns)."""
    return Rule(f"{col}_uuid_format", F.col(col).rlike(UUID_PATTERN))


# Rules per model table, from the table constraints and the input validation.
def table_rules() -> dict[str, list[Rule]]:
    c = F.col
    return {
        "customers": _nn("id", "name", "email"),
        "products": _nn("sku", "name", "price") + [
            Rule("price_non_negative", c("price") >= 0),
            Rule("sku_length", F.length("sku") <= 64)],
        "inventory_items": _nn("sku", "qty_on_hand", "reserved_qty", "reorder_point") + [
            Rule("qty_on_hand_non_negative", c("qty_on_hand") >= 0),
            Rule("reserved_non_negative", c("reserved_qty") >= 0),
            Rule("reorder_point_non_negative", c("reorder_point") >= 0),
            Rule("reserved_within_on_hand", c("reserved_qty") <= c("qty_on_hand"))],
        "orders": _nn("id", "customer_id", "status", "total_amount") + [
            Rule("status_valid", c("status").isin(*ORDER_STATUSES)),
            Rule("total_non_negative", c("total_amount") >= 0)],
        "order_items": _nn("order_id", "sku", "qty", "line_total") + [
            Rule("qty_positive", c("qty") > 0),
            Rule("line_total_non_negative", c("line_total") >= 0)],
        "invoices": _nn("id", "order_id", "amount", "status", "due_date") + [
            Rule("amount_non_negative", c("amount") >= 0),
            Rule("status_valid", c("status").isin(*INVOICE_STATUSES))],
        "ledger_entries": _nn("account", "debit", "credit", "ref_type", "ref_id") + [
            Rule("debit_non_negative", c("debit") >= 0),
            Rule("credit_non_negative", c("credit") >= 0),
            Rule("ref_type_valid", c("ref_type").isin(*LEDGER_REF_TYPES)),
            Rule("one_sided_entry", ((c("debit") > 0) & (c("credit") == 0))
                 | ((c("credit") > 0) & (c("debit") == 0)))],
    }


UNIQUE_KEYS = {"customers": ["email"], "products": ["sku"], "inventory_items": ["sku"],
               "orders": ["id"], "invoices": ["id"]}


def violations(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """Rows breaking at least one rule with the list of broken rule names."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules]))
    return (df.select(F.col(key).cast("string").alias("row_key"), broken.alias("violations"))
            .filter(F.size("violations") > 0))


def validate(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split into (good rows, bad rows + ``violations`` array)."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules]))
    tagged = df.withColumn("violations", broken)
    good = tagged.filter(F.size("violations") == 0).drop("violations")
    bad = tagged.filter(F.size("violations") > 0)
    return good, bad


def rule_counts(table: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(table_name, rule, violations) for every rule, zeros included: one
    global aggregate of ``count_if`` per rule, then unpivot."""
    wide = df.agg(*[F.count_if(~F.coalesce(r.ok, F.lit(False))).alias(r.name) for r in rules])
    return (wide.unpivot([], [r.name for r in rules], "rule", "violations")
            .select(F.lit(table).alias("table_name"), "rule", "violations"))


def duplicate_key_count(table: str, df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs more than once.  Counting per key is a partial
    aggregate, so a hot duplicated key does not meet in one task."""
    dup = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
           .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")))
    return dup.select(F.lit(table).alias("table_name"),
                      F.lit("unique_" + "_".join(key)).alias("rule"), "violations")


def quality_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Violation counts per (table, rule) over the given model tables."""
    rules = table_rules()
    parts = []
    for name, df in tables.items():
        if name in rules:
            parts.append(rule_counts(name, df, rules[name]))
        if name in UNIQUE_KEYS:
            parts.append(duplicate_key_count(name, df, UNIQUE_KEYS[name]))
    return reduce(DataFrame.unionByName, parts)


def orders_without_items(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Orders that have no line at all (an order needs at least one item)."""
    return orders.join(order_items.select(F.col("order_id").alias("id")).distinct(), "id", "left_anti")


def valid_references(child: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The rows of ``child`` all of whose references exist: column -> (parent, its key).  Semi-joins, so a
    repeated parent key repeats no row; null references are not valid."""
    for column, (parent, key) in references.items():
        child = child.join(parent.select(F.col(key).alias(column)), column, "left_semi")
    return child


def orphans(customers: DataFrame, products: DataFrame, inventory_items: DataFrame,
            orders: DataFrame, order_items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Foreign-key orphan counts (anti-joins) per relation."""
    def anti(name: str, child: DataFrame, ck: str, parent: DataFrame, pk: str) -> DataFrame:
        keys = parent.select(F.col(pk).alias(ck))
        n = child.select(ck).join(keys, ck, "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows"))
        return n.select(F.lit(name).alias("relation"), "orphan_rows")

    parts = [
        anti("orders.customer_id->customers", orders, "customer_id", customers, "id"),
        anti("order_items.order_id->orders", order_items, "order_id", orders, "id"),
        anti("order_items.sku->products", order_items, "sku", products, "sku"),
        anti("invoices.order_id->orders", invoices, "order_id", orders, "id"),
        anti("inventory_items.sku->products", inventory_items, "sku", products, "sku"),
    ]
    return reduce(DataFrame.unionByName, parts)
