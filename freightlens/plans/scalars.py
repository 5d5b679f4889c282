"""The scalar functions the rules rest on, and the Python function surface, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc, udfs
from .catalog import Source, query
from .search import SPLIT_SQL, split_check


@query(
    "fn_string",
    """SELECT src_row, lower(supplier) AS lo, upper(supplier) AS up, contains(supplier, '#0') AS has, starts_with(status, 'fl') AS sw, ends_with(payment_terms, '30') AS ew, replace(payment_terms, 'NET', '') AS rep,
 trim(concat('  ', status, ' ')) AS tr, string_split(invoice_id, '-')[2] AS part, array_to_string(string_split(invoice_id, '-'), '/') AS joined, substr(supplier, 1, 8) AS sub,
 concat(upper(status[1]), status[2:]) AS title, length(supplier) AS len, format('{:,.2f}', amount) AS money, printf('%.1f%%', early_discount * 100) AS pct FROM invoices""",
    "invoices",
)
def _(s: Source):
    c = F.col
    parts = F.split("invoice_id", "-")
    return s.invoices.select(
        "src_row", F.lower("supplier").alias("lo"), F.upper("supplier").alias("up"), c("supplier").contains("#0").alias("has"),
        c("status").startswith("fl").alias("sw"), c("payment_terms").endswith("30").alias("ew"),
        F.replace("payment_terms", F.lit("NET"), F.lit("")).alias("rep"), F.trim(F.concat(F.lit("  "), "status", F.lit(" "))).alias("tr"),
        F.get(parts, F.lit(1)).alias("part"), F.array_join(parts, "/").alias("joined"), F.substring("supplier", 1, 8).alias("sub"),
        F.initcap("status").alias("title"), F.length("supplier").cast("bigint").alias("len"), F.format_number("amount", 2).alias("money"),
        F.format_string("%.1f%%", c("early_discount") * 100).alias("pct"),
    )


@query(
    "fn_regex",
    r"""SELECT doc_id, regexp_extract(content, '([A-Z][a-z]+)', 1) AS first_word, len(regexp_extract_all(content, '\d+')) AS numbers, regexp_matches(content, '(?i)the') AS has_the,
 len(string_split_regex(content, '(?m)^[A-Z]')) AS starts FROM docs""",
    "docs",
)
def _(s: Source):
    return s.docs.select(
        "doc_id", F.regexp_extract("content", "([A-Z][a-z]+)", 1).alias("first_word"),
        F.size(F.regexp_extract_all("content", F.lit(r"[0-9]+"), F.lit(0))).cast("bigint").alias("numbers"),
        F.col("content").rlike("(?i)the").alias("has_the"), F.size(F.split("content", "(?md)^[A-Z]")).cast("bigint").alias("starts"),
    )


@query(
    "fn_date",
    """SELECT src_row, date_diff('day', issue_date, due_date) AS days, date_diff('day', issue_date, due_date) * 24 AS hours, isodow(issue_date) - 1 AS weekday, dayname(issue_date) AS name,
 strftime(issue_date, '%m/%d') AS label, CAST(epoch(issue_date) AS BIGINT) AS secs, strptime(strftime(issue_date, '%d.%m.%Y'), '%d.%m.%Y')::DATE AS parsed FROM invoices""",
    "invoices",
)
def _(s: Source):
    d = F.col("issue_date")
    return s.invoices.select(
        "src_row", fc.days("due_date", "issue_date").cast("bigint").alias("days"),
        fc.hours_between(F.col("due_date"), d).cast("bigint").alias("hours"), F.weekday(d).cast("bigint").alias("weekday"),
        F.date_format(d, "EEEE").alias("name"), F.date_format(d, "MM/dd").alias("label"), F.unix_timestamp(d.cast("timestamp")).alias("secs"),
        F.try_to_timestamp(F.date_format(d, "dd.MM.yyyy"), F.lit("dd.MM.yyyy")).cast("date").alias("parsed"),
    )


@query(
    "fn_math",
    """SELECT src_row, abs(amount - 10000) AS off, least(amount, 5000) AS lo, greatest(amount, 5000) AS hi, amount % 100 AS rest, CAST(floor(amount / 1000) AS BIGINT) AS thousands,
 round((amount - m) / sd, 6) AS z FROM invoices, (SELECT avg(amount) AS m, stddev_pop(amount) AS sd FROM invoices) s""",
    "invoices",
)
def _(s: Source):
    a = F.col("amount")
    one = s.invoices.agg(F.avg("amount").alias("m"), F.stddev_pop("amount").alias("sd"))  # a single row
    return s.invoices.join(F.broadcast(one)).select(
        "src_row", F.abs(a - 10000).alias("off"), F.least(a, F.lit(5000.0)).alias("lo"), F.greatest(a, F.lit(5000.0)).alias("hi"),
        (a % 100).alias("rest"), F.floor(a / 1000).alias("thousands"), F.round((a - F.col("m")) / F.col("sd"), 6).alias("z"),
    )


@query(
    "fn_array",
    """SELECT src_row, list_contains(p, 'INV') AS has, len(p) AS n, array_to_string(p[1:2], '+') AS head, len(list_filter(p, lambda x: length(x) > 3)) > 0 AS any_long,
 len(list_intersect(p, ['INV', '1', '2'])) AS common, array_to_string(list_filter([CASE WHEN approver IS NULL THEN 'approver' END, CASE WHEN notes IS NULL THEN 'notes' END], lambda x: x IS NOT NULL), ',') AS gaps
 FROM (SELECT *, string_split(invoice_id, '-') AS p FROM invoices) x""",
    "invoices",
)
def _(s: Source):
    p = F.split("invoice_id", "-")
    gaps = F.array_compact(F.array(*[F.when(fc.missing(x), F.lit(x)) for x in ("approver", "notes")]))
    return s.invoices.select(
        "src_row", F.array_contains(p, "INV").alias("has"), F.size(p).cast("bigint").alias("n"), F.array_join(F.slice(p, 1, 2), "+").alias("head"),
        F.exists(p, lambda x: F.length(x) > 3).alias("any_long"),
        F.size(F.array_intersect(p, F.array(*[F.lit(x) for x in ("INV", "1", "2")]))).cast("bigint").alias("common"), F.array_join(gaps, ",").alias("gaps"),
    )


@query(
    "fn_map_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, json_extract_string(props, '$.k') AS text,
 CAST(event_type AS VARCHAR) AS merged FROM events""",
)
def _(s: Source):
    m = F.from_json("props", "map<string,string>")
    merged = F.map_concat(F.map_filter(m, lambda k, v: k != "kind"), F.create_map(F.lit("kind"), F.col("event_type")))
    return s.events.select(
        "event_id", fc.get(m, "k").cast("bigint").alias("k"), fc.get(m, "missing", "none").alias("missing"),
        F.get_json_object("props", "$.k").alias("text"), fc.get(merged, "kind").alias("merged"),
    )


@query(
    "fn_null",
    """SELECT src_row, coalesce(approver, 'none') AS approver, nullif(status, 'paid') AS status, CASE WHEN isnan(x) THEN NULL ELSE x END AS amount, notes IS NULL OR notes = '' AS gap
 FROM (SELECT *, CASE WHEN status = 'flagged' THEN CAST('NaN' AS DOUBLE) ELSE amount END AS x FROM invoices) i""",
    "invoices",
)
def _(s: Source):
    x = F.when(F.col("status") == "flagged", F.lit(float("nan"))).otherwise(F.col("amount"))
    return s.invoices.select(
        "src_row", F.coalesce("approver", F.lit("none")).alias("approver"), F.nullif("status", F.lit("paid")).alias("status"),
        F.nanvl(x, F.lit(None).cast("double")).alias("amount"), fc.missing("notes").alias("gap"),
    )


@query("fn_safe_cast", "SELECT src_row, TRY_CAST(CASE WHEN status = 'paid' THEN 'n/a' ELSE substr(payment_terms, 4) END AS DOUBLE) AS n FROM invoices", "invoices")
def _(s: Source):
    text = F.when(F.col("status") == "paid", "n/a").otherwise(F.substring("payment_terms", 4, 10))
    return s.invoices.select("src_row", fc.number(text).alias("n"))


@query("fn_hash_id", "SELECT src_row, sha256(concat_ws('|', invoice_id, src_row)) AS id, md5(substr(supplier, 1, 100)) AS prefix FROM invoices", "invoices")
def _(s: Source):
    return s.invoices.select("src_row", fc.text_id("invoice_id", "src_row").alias("id"), F.md5(F.substring("supplier", 1, 100)).alias("prefix"))


@query(
    "udf_row_apply",
    "SELECT src_row, concat('Invoice ', invoice_id, ' by ', coalesce(approver, 'nobody')) AS text FROM invoices",
    "invoices",
)
def _(s: Source):
    fn = lambda b: "Invoice " + b["invoice_id"] + " by " + b["approver"].fillna("nobody")
    return s.invoices.select("src_row", udfs.batch_apply(["invoice_id", "approver"], fn, "string").alias("text"))


@query("udf_filter_apply", "SELECT src_row, amount, status FROM invoices WHERE amount > 10000 AND status = 'flagged'", "invoices")
def _(s: Source):
    rows = s.invoices.select("src_row", "amount", "status")
    return udfs.filter_apply(rows, ["amount", "status"], lambda b: (b["amount"] > 10000) & (b["status"] == "flagged"))


@query("udtf_chunker", SPLIT_SQL, "docs")
def _(s: Source):
    name = udfs.register_chunker(s.spark)
    pieces = s.spark.sql(f"SELECT d.doc_id, d.doc_type, c.chunk_id, c.chunk FROM {{docs}} d, LATERAL {name}(d.content) c", docs=s.docs)
    return split_check(pieces, "chunk")
