"""Invoice rules as column expressions over a record joined with its baselines.

A rule reads the record's own columns plus, where it needs them, the columns added by
``with_supplier_profile``, ``with_supplier_terms`` and ``with_invoice_history``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as ref
from ..functions.columns import days, has_any, missing, money, terms_days
from .anomaly import anomaly


def _amount() -> Column:
    return F.col("amount")


# --- joins that prepare a record ------------------------------------------------------------


def with_supplier_profile(invoices: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds the profile and ``z_score``; worked out once, as several parts of a rule read it."""
    z = F.when(F.col("std_amount") > 0, F.abs(_amount() - F.col("avg_amount")) / F.col("std_amount"))
    return invoices.join(profile, "supplier", "left").withColumn("z_score", z)


def with_supplier_terms(invoices: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds the agreement, ``agreed_days`` and the ``actual_days`` between issue and due date."""
    return (
        invoices.join(terms, "supplier", "left")
        .withColumn("agreed_days", terms_days("agreed_terms"))
        .withColumn("actual_days", days("due_date", "issue_date"))
    )


def with_invoice_history(invoices: DataFrame, history: DataFrame) -> DataFrame:
    """Adds the history, the ``hist_share`` an amount is off its mean and the ``hist_z`` of it."""
    mean = F.col("hist_avg")
    sd = F.when(F.col("hist_n") > 1, F.col("hist_std")).otherwise(mean * 0.1)
    off = F.abs(_amount() - mean)
    return (
        invoices.join(history, ["supplier", "payment_terms"], "left")
        .withColumn("hist_share", F.when(mean != 0, off / mean))
        .withColumn("hist_z", F.when(sd > 0, off / sd).otherwise(0.0))
    )


# --- amount ---------------------------------------------------------------------------------


def amount_deviation(min_z: float = 2.5) -> Column:
    """Amount far from the supplier's own mean, in sample standard deviations."""
    mean, z = F.col("avg_amount"), F.col("z_score")
    return anomaly(
        (_amount() > 0) & (mean > 0) & (z > min_z),
        "invoice_amount_deviation",
        F.least(F.lit(0.95), z / 5.0),
        F.when(z > 4.0, "high").when(z > 3.0, "medium").otherwise("low"),
        F.concat(
            F.lit("Invoice amount ("), money("amount"), F.lit(") deviates significantly from supplier's historical average ("),
            money("avg_amount"), F.lit(")"),
        ),
        [
            F.concat(F.lit("Invoice amount: "), money("amount")),
            F.concat(F.lit("Supplier average: "), money("avg_amount")),
            F.concat(F.lit("Standard deviation: "), money("std_amount")),
            F.concat(F.lit("Z-score: "), F.format_string("%.2f", z)),
        ],
        supplier=F.col("supplier"),
        amount=_amount(),
        avg_amount=mean,
        z_score=z,
        deviation_percentage=F.abs(_amount() - mean) / mean * 100,
    )


def amount_discrepancy(max_share: float = 0.20) -> Column:
    """Amount off the mean of the same supplier and terms by more than a share of it."""
    mean, share, z = F.col("hist_avg"), F.col("hist_share"), F.col("hist_z")
    return anomaly(
        ~missing("supplier") & ~missing("payment_terms") & (_amount() != 0) & (share > max_share),
        "invoice_amount_discrepancy",
        F.least(F.lit(0.9), 0.5 + F.least(z / 10, F.lit(0.4))),
        None,
        F.concat(
            F.lit("Invoice amount differs by "), F.format_string("%.1f%%", share * 100),
            F.lit(" from historical average ("), money("hist_avg"), F.lit(")"),
        ),
        amount=_amount(),
        historical_avg=mean,
        percentage_difference=share,
        z_score=z,
        sample_size=F.col("hist_n"),
    )


def round_amount(max_share: float = 0.20) -> Column:
    """A round amount, looked at only where the amount did not differ from history."""
    usable = ~missing("supplier") & ~missing("payment_terms")
    near_history = ~F.coalesce(F.col("hist_share") > max_share, F.lit(False))
    return anomaly(
        usable & near_history & (_amount() % 100 == 0) & (_amount() >= 1000),
        "suspicious_round_amount",
        0.65,
        None,
        F.concat(F.lit("Suspiciously round invoice amount: "), money("amount")),
        amount=_amount(),
        pattern_type="round_number",
    )


# --- payment terms and dates ----------------------------------------------------------------


def terms_violation(tolerance: int = 7) -> Column:
    """Days between issue and due date against the terms agreed with the supplier."""
    actual = F.col("actual_days")
    expected = F.coalesce("agreed_days", F.lit(30))
    off = F.abs(actual - expected)
    return anomaly(
        (off > tolerance) & (expected != 0),
        "payment_terms_violation",
        F.least(F.lit(0.9), F.try_divide(off, expected)),
        F.when(off > 5, "medium").otherwise("low"),
        F.concat(
            F.lit("Payment terms ("), actual, F.lit(" days) deviate from expected terms ("), expected,
            F.lit(" days) for supplier "), F.coalesce("supplier", F.lit("unknown")),
        ),
        [
            F.concat(F.lit("Actual payment terms: "), actual, F.lit(" days")),
            F.concat(F.lit("Expected terms for "), F.coalesce("supplier", F.lit("unknown")), F.lit(": "), expected, F.lit(" days")),
            F.concat(F.lit("Deviation: "), off, F.lit(" days")),
            F.concat(F.lit("Issue date: "), F.col("issue_date").cast("string")),
            F.concat(F.lit("Due date: "), F.col("due_date").cast("string")),
        ],
        supplier=F.col("supplier"),
        actual_days=actual,
        expected_days=expected,
        deviation=off,
    )


def own_terms(tolerance: int = 1, risk: float = 0.7, net_only: bool = False) -> Column:
    """Days between issue and due date against the terms printed on the invoice itself."""
    stated = F.regexp_replace("payment_terms", "NET", "").try_cast("int")
    actual = days("due_date", "issue_date")
    ok = F.col("payment_terms").startswith("NET") if net_only else ~missing("payment_terms") & ~missing("supplier")
    return anomaly(
        ok & (F.abs(actual - stated) > tolerance),
        "payment_terms_noncompliance",
        risk,
        None,
        F.concat(
            F.lit("Invoice due date doesn't match payment terms. Expected "), stated, F.lit(" days, got "), actual, F.lit(" days."),
        ),
        supplier=F.col("supplier"),
        payment_terms=F.col("payment_terms"),
        expected_days=stated,
        actual_days=actual,
    )


def wrong_terms() -> Column:
    """Printed terms differ from the agreed ones of a known supplier."""
    agreed = F.col("agreed_terms")
    return anomaly(
        agreed.isNotNull() & ~F.col("payment_terms").eqNullSafe(agreed),
        "incorrect_payment_terms",
        0.75,
        None,
        F.concat(
            F.lit("Payment terms for "), F.col("supplier"), F.lit(" should be "), agreed, F.lit(", got "),
            F.coalesce("payment_terms", F.lit("None")),
        ),
        supplier=F.col("supplier"),
        expected_terms=agreed,
        actual_terms=F.col("payment_terms"),
    )


def wrong_due_date(tolerance: int = 2) -> Column:
    """Right terms, but a due date that does not follow from them."""
    actual, expected = F.col("actual_days"), F.col("agreed_days")
    return anomaly(
        F.col("payment_terms").eqNullSafe(F.col("agreed_terms")) & (F.abs(actual - expected) > tolerance),
        "incorrect_due_date_calculation",
        0.6,
        None,
        F.concat(F.lit("Due date calculation error: expected "), expected, F.lit(" days, calculated "), actual, F.lit(" days")),
        supplier=F.col("supplier"),
        expected_days=expected,
        actual_days=actual,
        tolerance=F.lit(tolerance),
    )


def weekend(risk: float = 0.7) -> Column:
    name = F.date_format("issue_date", "EEEE")
    iso = F.col("issue_date").cast("string")
    return anomaly(
        F.weekday("issue_date") >= 5,
        "weekend_processing",
        risk,
        "medium",
        F.concat(F.lit("Invoice issued on weekend ("), name, F.lit(", "), iso, F.lit(")")),
        [
            F.concat(F.lit("Issue date: "), iso),
            F.concat(F.lit("Day of week: "), name),
            "Weekend processing is unusual for business invoices",
        ],
        issue_date=iso,
        day_of_week=name,
        weekend_flag="true",
    )


# --- fraud and approval ---------------------------------------------------------------------


def fraud_pattern(round_amounts: list[float] = ref.ROUND_AMOUNTS) -> Column:
    """Points for a round amount, missing fields and a risky supplier, counted in tenths."""
    fields = ["supplier", "issue_date", "due_date", "payment_terms"]
    is_round = F.col("amount").isin(round_amounts)
    gaps = F.array_compact(F.array(*[F.when(missing(f), F.lit(f)) for f in fields]))
    risky = F.coalesce(F.col("supplier_risk") == "high", F.lit(False))
    tenths = (
        F.when(is_round, 3).otherwise(0)
        + reduce(lambda a, b: a + b, [F.when(missing(f), 2).otherwise(0) for f in fields])
        + F.when(risky, 5).otherwise(0)
    )
    signs = F.array_compact(
        F.array(
            F.when(is_round, "Round amount pattern"),
            F.when(F.size(gaps) > 0, F.concat(F.lit("Missing fields: "), F.array_join(gaps, ", "))),
            F.when(risky, "High risk supplier"),
        )
    )
    return F.when(
        tenths >= 4,
        F.struct(
            F.lit("fraud_pattern").alias("anomaly_type"),
            F.least(F.lit(0.95), tenths / 10).alias("risk_score"),
            F.when(tenths >= 7, "high").otherwise("medium").alias("severity"),
            F.lit("Multiple fraud indicators detected in invoice").alias("description"),
            signs.alias("evidence"),
            F.create_map(
                F.lit("fraud_score"), (tenths / 10).cast("string"),
                F.lit("supplier"), F.col("supplier"),
                F.lit("amount"), _amount().cast("string"),
            ).alias("metadata"),
        ),
    )


def insufficient_approval(director_from: float = 10000.0, cfo_from: float = 50000.0) -> Column:
    """The approver's title ranks below what the amount asks for; 'director' wins over 'cfo'."""
    low = F.lower("approver")
    need = F.when(_amount() >= cfo_from, "cfo").when(_amount() >= director_from, "director").otherwise("manager")
    have = F.when(low.contains("director"), "director").when(low.contains("cfo"), "cfo").otherwise("manager")
    rank = lambda x: F.when(x == "cfo", 3).when(x == "director", 2).otherwise(1)
    return anomaly(
        ~missing("approver") & (_amount() > 0) & (rank(have) < rank(need)),
        "insufficient_approval",
        0.8,
        "high",
        F.concat(
            F.lit("Invoice amount ("), money("amount"), F.lit(") requires "), need, F.lit(" approval but approved by "), have,
        ),
        [
            F.concat(F.lit("Invoice amount: "), money("amount")),
            F.concat(F.lit("Approver: "), F.col("approver")),
            F.concat(F.lit("Required level: "), need),
            F.concat(F.lit("Actual level: "), have),
        ],
        amount=_amount(),
        approver=F.col("approver"),
        required_level=need,
        approver_level=have,
    )


def approver_level(approver: str | Column = "approver", manager_names: list[str] = ref.MANAGER_NAMES) -> Column:
    return (
        F.when(has_any(approver, ["cfo", "chief financial"]), "cfo")
        .when(has_any(approver, ["director", "vice president"]), "director")
        .when(has_any(approver, ["manager", *manager_names]), "manager")
        .otherwise("unknown")
    )


def approval_authority(levels: dict[str, float] = ref.APPROVAL_LEVELS) -> Column:
    """Approver level below the level of the amount; an unknown approver is below all."""
    need = F.when(_amount() >= levels["cfo"], "cfo").when(_amount() >= levels["director"], "director").otherwise("manager")
    have = approver_level()
    rank = lambda x: F.when(x == "cfo", 2).when(x == "director", 1).when(x == "manager", 0).otherwise(-1)
    return anomaly(
        ~missing("approver") & (_amount() != 0) & (rank(have) < rank(need)),
        "insufficient_approval_authority",
        F.when(_amount() > 25000, 0.8).otherwise(0.6),
        None,
        F.concat(
            money("amount"), F.lit(" invoice requires "), need, F.lit(" approval, but approved by "), have,
        ),
        amount=_amount(),
        required_level=need,
        approver_level=have,
        approver=F.col("approver"),
    )


def approval_workflow(two_from: float = 5000.0, three_above: float = 25000.0) -> Column:
    """More than one approver needed, and neither several names nor a senior title given."""
    needed = F.when(_amount() < two_from, 1).when(_amount() <= three_above, 2).otherwise(3)
    senior = F.col("approver").contains(",") | has_any("approver", ["director", "cfo"])
    return anomaly(
        ~missing("approver") & (_amount() != 0) & (needed > 1) & ~senior,
        "approval_workflow_noncompliance",
        F.when(_amount() > three_above, 0.8).otherwise(0.6),
        None,
        F.concat(F.lit("Invoice requires "), needed, F.lit(" level(s) of approval but only has one approver.")),
        amount=_amount(),
        current_approver=F.col("approver"),
        required_approvers=needed,
    )


def approval_requirement(amount: str | Column = "amount", levels: dict[str, float] = ref.POLICY_APPROVAL) -> Column:
    """What the policy asks for at this amount."""
    a = F.col(amount) if isinstance(amount, str) else amount
    return (
        F.when(a >= levels["cfo"], "CFO approval required")
        .when(a >= levels["director"], "Director approval required")
        .when(a >= levels["manager"], "Manager approval required")
        .when(a >= levels["auto"], "Automatic approval")
        .otherwise("Standard processing")
    )


# --- other ----------------------------------------------------------------------------------


def duplicate_id() -> Column:
    """For rows of ``duplicates.first_seen``."""
    return anomaly(
        F.lit(True), "duplicate_invoice_id", 0.9, None,
        F.concat(F.lit("Duplicate invoice ID detected: "), F.col("invoice_id")),
        original_row=F.col("first_order"),
    )


def duplicate_pattern() -> Column:
    """For rows of ``duplicates.earlier_twin`` on supplier, amount and issue date."""
    iso = F.col("issue_date").cast("string")
    return anomaly(
        F.col("related").isNotNull(), "potential_duplicate", 0.85, "high",
        F.concat(F.lit("Potential duplicate invoice detected for supplier "), F.col("supplier")),
        [
            F.concat(F.lit("Similar invoice found: "), F.col("related")),
            F.concat(F.lit("Amount: "), money("amount")),
            F.concat(F.lit("Issue date: "), iso),
            F.concat(F.lit("Supplier: "), F.col("supplier")),
        ],
        supplier=F.col("supplier"),
        amount=_amount(),
        issue_date=iso,
        related_invoice=F.col("related"),
    )


def early_discount(tolerance: float = 0.005) -> Column:
    given, agreed = F.coalesce("early_discount", F.lit(0.0)), F.col("agreed_discount")
    return anomaly(
        F.abs(given - agreed) > tolerance,
        "incorrect_early_discount",
        0.5,
        None,
        F.concat(
            F.lit("Early discount for "), F.col("supplier"), F.lit(" should be "), F.format_string("%.1f%%", agreed * 100),
            F.lit(", got "), F.format_string("%.1f%%", given * 100),
        ),
        supplier=F.col("supplier"),
        expected_discount=agreed,
        actual_discount=given,
    )


def foreign_currency(home: str = "USD") -> Column:
    cur = F.coalesce("currency", F.lit(home))
    return anomaly(
        cur != home,
        "non_usd_currency",
        0.4,
        None,
        F.concat(F.lit("International invoice in "), cur, F.lit(" requires special handling")),
        currency=cur,
        supplier=F.col("supplier"),
        amount=_amount(),
    )


def late_fee(
    as_of: str, rate: float | Column = ref.LATE_FEE_RATE, free_days: int = ref.LATE_FEE_FREE_DAYS
) -> Column:
    """Linear monthly fee on the days past the free period, to the cent."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    overdue = F.datediff(F.lit(as_of).cast("date"), "due_date")
    fee = _amount() * rate * (overdue - free_days) / 30.0
    cents = F.round(fee.cast("decimal(38,10)"), 2).cast("double")
    return F.when(overdue <= free_days, 0.0).otherwise(cents)


def is_overdue() -> Column:
    by_status = F.lower("status") == "overdue"
    by_note = F.lower("notes").contains("overdue")
    return F.coalesce(by_status, F.lit(False)) | F.coalesce(by_note, F.lit(False))


def main_rules() -> list[Column]:
    """The checks of the wired-in detector, in its order; needs profile, terms and twin columns."""
    return [amount_deviation(), terms_violation(), weekend(), duplicate_pattern(), insufficient_approval(), fraud_pattern()]


def extended_rules() -> list[Column]:
    """The checks of the second detector; needs agreement and history columns."""
    return [
        F.coalesce(wrong_terms(), wrong_due_date()),
        F.coalesce(amount_discrepancy(), round_amount()),
        approval_authority(),
        early_discount(),
        foreign_currency(),
    ]
