"""Fields out of text columns, as regular expressions inside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c

# fixed values: patterns of labelled fields
INVOICE_ID = [r"Invoice\s(?:ID|Number|#):\s*([A-Za-z0-9-]+)", r"Invoice\s*#\s*([A-Za-z0-9-]+)", r"INV[-:]?(\d+)"]
SUPPLIER = r"(?:Supplier|Vendor|From):\s*([A-Za-z0-9\s.,]+)"
AMOUNT = [r"(?:Total|Amount|Sum):\s*[$€£]?\s*([0-9,]+\.[0-9]{2})", r"[$€£]\s*([0-9,]+\.[0-9]{2})"]
CURRENCY = r"(?:Currency|USD|EUR|GBP):\s*([A-Za-z]{3})"
_DATE = r"(\d{1,4}[-/\.]\d{1,2}[-/\.]\d{1,4})"
ISSUE_DATE = r"(?:Issue Date|Invoice Date|Date):\s*" + _DATE
DUE_DATE = r"(?:Due Date|Payment Due|Pay Before):\s*" + _DATE
INVOICE_SHIPMENT = r"(?:Shipment|Delivery|Order)\s(?:ID|Number|#):\s*([A-Za-z0-9-]+)"
SHIPMENT_ID = r"(?:Shipment|Tracking|Waybill)\s(?:ID|Number|#):\s*([A-Za-z0-9-]+)"
ORIGIN = r"(?:Origin|From|Pickup):\s*([A-Za-z0-9\s.,]+)"
DESTINATION = r"(?:Destination|To|Delivery):\s*([A-Za-z0-9\s.,]+)"
CARRIER = r"(?:Carrier|Shipper|Provider):\s*([A-Za-z0-9\s.,]+)"
DEPARTURE = r"(?:Departure|Ship|Pickup) Date:\s*" + _DATE
ARRIVAL = r"(?:Estimated|Expected|Planned) (?:Arrival|Delivery) Date:\s*" + _DATE
DRIVER = r"(?:Driver|Operator)\s(?:ID|Number):\s*([A-Za-z0-9-]+)"
TERMS = [r"(?i)(?:Payment Terms|Terms):\s*([A-Za-z0-9\s]+)", r"(?i)NET\s?(\d+)", r"(?i)(\d+)\s?days"]
DISCOUNT = [
    r"(?i)(?:Early Payment|Prompt Payment|Early Discount):\s*(\d+(?:\.\d+)?)%",
    r"(?i)(\d+(?:\.\d+)?)%\s+(?:discount|off)\s+(?:if paid|for payment)\s+within",
]
STATUS = [
    ("delivered", r"(?i)(?:Delivered|Completed|Received)"),
    ("in_transit", r"(?i)(?:In Transit|On Route|In Progress)"),
    ("pending", r"(?i)(?:Pending|Waiting|Scheduled)"),
    ("delayed", r"(?i)(?:Delayed|Late|Behind Schedule)"),
    ("exception", r"(?i)(?:Exception|Problem|Issue|Missing)"),
]
POLICY_VERSION = r"(?:Version|v)[\s.:]*([0-9.]+)"
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "M-d-yyyy", "M/d/yyyy"]

# fixed values: looser patterns for uploaded text without labels
LOOSE_INVOICE_ID = r"(?i)(?:Invoice|INV)[\s#-]*([A-Z0-9-]+)"
LOOSE_AMOUNT = r"\$?\s*([0-9,]+\.?[0-9]*)"
LOOSE_SUPPLIER = r"(?i)(?:From|Supplier|Vendor)[\s:]+([A-Za-z\s&,.-]+)"
LOOSE_DATE = r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
LOOSE_SHIPMENT_ID = r"(?i)(?:Shipment|SHP|Tracking)[\s#-]*([A-Z0-9-]+)"
LOOSE_ORIGIN = r"(?i)(?:Origin|From)[\s:]+([A-Za-z\s,.-]+)"
LOOSE_DESTINATION = r"(?i)(?:Destination|To)[\s:]+([A-Za-z\s,.-]+)"
LOOSE_CARRIER = r"(?i)(?:Carrier|Shipped by)[\s:]+([A-Za-z\s&,.-]+)"

# fixed values: header names that mean the same column
ITEM_HEADERS = {
    "description": ["item", "description", "product"],
    "quantity": ["quantity", "qty"],
    "unit_price": ["price", "unit price", "rate"],
    "amount": ["amount", "total", "line total"],
}
SHIPMENT_ITEM_HEADERS = {
    "item": ["item", "product", "goods", "description"],
    "quantity": ["quantity", "qty", "count"],
    "value": ["value", "price", "worth"],
    "weight": ["weight", "kg", "lb"],
    "dimensions": ["dimensions", "size", "measurements"],
}


_WHITE = " \t\n\r\x0b\f"


def strip(x: Column) -> Column:
    """str.strip(): white space of any kind off both ends."""
    return F.btrim(x, F.lit(_WHITE))


def first_group(text: str | Column, pattern: str) -> Column:
    """First group of the first match, trimmed; NULL without a match. The group must take a character."""
    return strip(F.nullif(F.regexp_extract(c(text), pattern, 1), F.lit("")))


def first_of(text: str | Column, patterns: list[str]) -> Column:
    return F.coalesce(*[first_group(text, p) for p in patterns])


def normal_date(raw: str | Column) -> Column:
    """ISO day by the first format that fits, else the text as it stands."""
    r = c(raw)
    parsed = F.coalesce(*[F.try_to_timestamp(r, F.lit(f)) for f in DATE_FORMATS])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), r)


def plain_number(raw: str | Column) -> Column:
    """'1,234.50' -> 1234.5"""
    return F.replace(c(raw), F.lit(","), F.lit("")).try_cast("double")


def with_groups(rows: DataFrame, text: str, **patterns: str | list[str]) -> DataFrame:
    """One column per pattern, in a step of its own so that each expression runs once per row."""
    cols = {n: first_of(text, p) if isinstance(p, list) else first_group(text, p) for n, p in patterns.items()}
    return rows.withColumns(cols)


def amount(rows: DataFrame, text: str, out: str = "amount") -> DataFrame:
    found = with_groups(rows, text, _a=AMOUNT[0], _b=AMOUNT[1])
    return found.withColumn(out, F.coalesce(plain_number("_a"), plain_number("_b"), F.lit(0.0))).drop("_a", "_b")


def payment_terms(rows: DataFrame, text: str, out: str = "payment_terms") -> DataFrame:
    found = with_groups(rows, text, _t=TERMS)
    named = F.when(F.col("_t").rlike(r"^\d+"), F.concat(F.lit("NET"), "_t")).otherwise(F.col("_t"))
    return found.withColumn(out, F.coalesce(named, F.lit("NET30"))).drop("_t")


def early_discount(text: str | Column) -> Column:
    return F.coalesce(first_of(text, DISCOUNT).try_cast("double") / 100.0, F.lit(0.0))


def status(text: str | Column) -> Column:
    out = None
    for label, pattern in STATUS:
        cond = c(text).rlike(pattern)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("unknown")


def invoice_fields(rows: DataFrame, text: str, fallback_id: Column) -> DataFrame:
    """Adds the fields of an invoice text; ``fallback_id`` names a text without an id."""
    out = with_groups(
        rows, text, invoice_id=INVOICE_ID, supplier=SUPPLIER, currency=CURRENCY, _issue=ISSUE_DATE, _due=DUE_DATE, shipment_id=INVOICE_SHIPMENT
    )
    out = payment_terms(amount(out, text), text).withColumn("early_discount", early_discount(text))
    return out.withColumns(
        {
            "invoice_id": F.coalesce("invoice_id", F.concat(F.lit("INV-"), fallback_id.cast("string"))),
            "currency": F.coalesce("currency", F.lit("USD")),
            "issue_date": normal_date("_issue"),
            "due_date": normal_date("_due"),
        }
    ).drop("_issue", "_due")


def shipment_fields(rows: DataFrame, text: str) -> DataFrame:
    out = with_groups(
        rows, text, shipment_id=SHIPMENT_ID, origin=ORIGIN, destination=DESTINATION, carrier=CARRIER, _dep=DEPARTURE, _arr=ARRIVAL, driver_id=DRIVER
    )
    return out.withColumns(
        {"departure_date": normal_date("_dep"), "estimated_arrival": normal_date("_arr"), "status": status(text)}
    ).drop("_dep", "_arr")


def loose_invoice_fields(rows: DataFrame, text: str, name: Column) -> DataFrame:
    """Adds the fields of an uploaded text without labels; ``name`` is the file name without suffix."""
    out = with_groups(rows, text, invoice_id=LOOSE_INVOICE_ID, _amount=LOOSE_AMOUNT, supplier=LOOSE_SUPPLIER, issue_date=LOOSE_DATE)
    return out.withColumns(
        {
            "invoice_id": F.coalesce("invoice_id", F.concat(F.lit("INV-"), name)),
            "amount": F.coalesce(plain_number("_amount"), F.lit(0.0)),
            "supplier": F.coalesce(F.substring("supplier", 1, 50), F.lit("Unknown Supplier")),
            "status": F.lit("pending"),
            "payment_terms": F.lit("NET30"),
            "currency": F.lit("USD"),
        }
    ).drop("_amount")


def loose_shipment_fields(rows: DataFrame, text: str, name: Column, as_of: str) -> DataFrame:
    out = with_groups(
        rows, text, shipment_id=LOOSE_SHIPMENT_ID, origin=LOOSE_ORIGIN, destination=LOOSE_DESTINATION, carrier=LOOSE_CARRIER
    )
    return out.withColumns(
        {
            "shipment_id": F.coalesce("shipment_id", F.concat(F.lit("SHP-"), name)),
            "origin": F.substring("origin", 1, 50),
            "destination": F.substring("destination", 1, 50),
            "carrier": F.coalesce(F.substring("carrier", 1, 50), F.lit("Unknown Carrier")),
            "status": F.lit("in_transit"),
            "departure_date": F.lit(as_of).cast("date"),
        }
    )


def _by_synonyms(table: DataFrame, headers: dict[str, list[str]], texts: tuple[str, ...]) -> list[Column]:
    """One column per meaning; of several synonyms in a table the last one counts."""
    out = []
    for meaning, names in headers.items():
        hits = [col for col in table.columns if col.lower() in names]
        if hits:
            col = F.col(f"`{hits[-1]}`")
            value = col.cast("string") if meaning in texts else F.coalesce(F.nanvl(col.try_cast("double"), F.lit(None)), F.lit(0.0))
            out.append(value.alias(meaning))
    return out


def line_items(table: DataFrame, *keep: str) -> DataFrame:
    """Invoice lines of a table whose headers name items; no rows from any other table."""
    if not any(col.lower() in ITEM_HEADERS["description"] for col in table.columns):
        return table.limit(0).select(*keep)
    return table.select(*keep, *_by_synonyms(table, ITEM_HEADERS, ("description",)))


def shipment_items(table: DataFrame, *keep: str) -> DataFrame:
    if not any(col.lower() in ("item", "product", "goods") for col in table.columns):
        return table.limit(0).select(*keep)
    return table.select(*keep, *_by_synonyms(table, SHIPMENT_ITEM_HEADERS, ("item", "dimensions")))


# --- policies -------------------------------------------------------------------------------

HEADER = r"(?md)^#+\s+(?:.*?)$|^(?:[A-Z][A-Za-z\s]+):$"


def policy_sections(text: str | Column) -> Column:
    """Array of (title, body). A title that comes twice keeps its last body; no header, one section."""
    t = c(text)
    raw = F.regexp_extract_all(t, F.lit(HEADER), F.lit(0))
    titles = F.transform(raw, lambda h: strip(F.when(h.startswith("#"), F.regexp_replace(h, r"^#+\s+", "")).otherwise(F.regexp_replace(h, ":$", ""))))
    parts = F.split(t, HEADER)
    blocks = F.when(strip(parts[0]) == "", F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    pairs = F.transform(titles, lambda x, i: F.struct(x.alias("title"), strip(F.get(blocks, i)).alias("body")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(titles, i + 2, F.size(titles)), p.title))
    return F.when(F.size(raw) == 0, F.array(F.struct(F.lit("Full Content").alias("title"), t.alias("body")))).otherwise(last)


def policy_version(text: str | Column) -> Column:
    return first_group(text, POLICY_VERSION)


def _mode_of(line: Column) -> Column:
    return (
        F.when(line.contains("International Air Freight"), "air")
        .when(line.contains("International Ocean Freight"), "ocean")
        .when(line.contains("Domestic Ground"), "ground")
    )


def lines_with_mode(policies: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Every line of a policy with the freight mode of the last heading above it."""
    lines = policies.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("own_mode", _mode_of(F.col("line")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("mode", F.last("own_mode", ignorenulls=True).over(w))


def policy_carriers(policies: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Carriers listed as bullets under a freight heading."""
    rows = lines_with_mode(policies, key, text)
    name = F.regexp_replace("line", "^[- ]+|[- ]+$", "")
    bullet = F.col("own_mode").isNull() & F.col("line").startswith("- ") & F.col("mode").isNotNull() & (name != "")
    return rows.where(bullet).select(key, "mode", name.alias("carrier")).distinct()


def policy_terms(text: str | Column) -> Column:
    """Array of (supplier, terms, discount, penalty), one per numbered supplier section."""
    pieces = F.filter(F.split(c(text), "### "), lambda p, i: (i > 0) & p.rlike(r"^\d+\.\d+ [^\n]+\n"))
    pct = lambda p, label: F.regexp_extract(p, label + r": (\d+(?:\.\d+)?)%", 1).try_cast("double") / 100
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.regexp_extract(p, r"^\d+\.\d+ ([^\n]+)\n", 1).alias("supplier"),
            F.nullif(F.regexp_extract(p, r"Payment terms: (NET\d+)", 1), F.lit("")).alias("terms"),
            pct(p, "Early payment discount").alias("discount"),
            pct(p, "Late payment penalty").alias("penalty"),
        ),
    )


def override_terms(known: DataFrame, policies: DataFrame, order: str, text: str = "content") -> DataFrame:
    """Known agreements with what the latest policy says about each field; unknown suppliers are ignored."""
    said = policies.select(order, F.explode(policy_terms(text)).alias("t")).select(order, "t.*")
    pick = lambda col: F.max_by(col, F.when(F.col(col).isNotNull(), F.col(order)))
    latest = said.groupBy("supplier").agg(*[pick(x).alias(f"new_{x}") for x in ("terms", "discount", "penalty")])
    return known.join(latest, "supplier", "left").select(
        "supplier",
        *[F.coalesce(f"new_{x}", x).alias(x) for x in ("terms", "discount", "penalty")],
    )


def late_fee_rate(text: str | Column) -> Column:
    low = F.lower(c(text))
    rate = F.regexp_extract(low, r"(\d+\.?\d*)%.*per month", 1).try_cast("double") / 100
    return F.when(low.contains("late fee"), rate)


def approval_limits(text: str | Column) -> Column:
    """Dollar amounts as limits, by the titles the text mentions; the last fitting amount counts."""
    t, low = c(text), F.lower(c(text))
    amounts = F.transform(
        F.regexp_extract_all(t, F.lit(r"\$(\d{1,3}(?:,\d{3})*)"), F.lit(1)), lambda a: F.regexp_replace(a, ",", "").cast("bigint")
    )
    is_cfo = lambda a: low.contains("cfo") & (a >= 50000)
    is_director = lambda a: ~is_cfo(a) & low.contains("director") & (a >= 20000)
    is_manager = lambda a: ~is_cfo(a) & ~is_director(a) & low.contains("manager") & (a >= 10000)
    last = lambda test: F.try_element_at(F.filter(amounts, test), F.lit(-1))
    limits = F.struct(last(is_cfo).alias("cfo"), last(is_director).alias("director"), last(is_manager).alias("manager"))
    return F.when(low.contains("approval") & t.contains("$"), limits)


def late_fee_context(text: str | Column) -> Column:
    """The first line about late fees with two lines around it."""
    lines = F.split(c(text), "\n")
    hits = F.transform(lines, lambda x: F.lower(x).contains("late") & F.lower(x).contains("fee"))
    at = F.array_position(hits, True).cast("int")
    start = F.greatest(at - 2, F.lit(1))
    return F.when(at > 0, strip(F.array_join(F.slice(lines, start, F.least(at + 2, F.size(lines)) - start + 1), " ")))


def pattern(text: str | Column, regex: str) -> Column:
    """First group of any regular expression, trimmed; the group may be empty."""
    t = c(text)
    return F.when(t.rlike(regex), strip(F.regexp_extract(t, regex, 1)))
