"""Freight and finance views over the driver tables, written once in SQL both Spark and DuckDB accept.

``src_row`` is the explicit arrival order: business ids repeat, this key does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SRC_ROW = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT))"

INVOICES = f"""
SELECT {_SRC_ROW} AS src_row,
 concat('INV-', l_orderkey, '-', l_linenumber) AS invoice_id, s_name AS supplier,
 CASE WHEN l_partkey % 211 = 0 THEN CAST(10000 AS DOUBLE) WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 2
      ELSE l_extendedprice / 4 END AS amount,
 CASE WHEN s_nationkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
 CAST(o_orderdate AS DATE) AS issue_date,
 CAST(CAST(o_orderdate AS DATE) + CAST(15 * (1 + l_suppkey % 4) + CAST(l_quantity AS INT) % 21 - 10 AS INT) AS DATE) AS due_date,
 concat('NET', CASE WHEN l_linenumber = 6 THEN 30 ELSE 15 * (1 + l_suppkey % 4) END) AS payment_terms,
 l_discount AS early_discount,
 CASE WHEN l_returnflag = 'R' THEN 'flagged' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'paid' END AS status,
 CASE l_linenumber WHEN 1 THEN 'john.smith' WHEN 2 THEN 'Finance Director' WHEN 3 THEN 'CFO'
      WHEN 4 THEN 'junior.clerk' WHEN 5 THEN 'ops manager' END AS approver,
 concat('SHP-', l_orderkey, '-', l_linenumber) AS shipment_id,
 CASE WHEN l_tax >= 0.07 THEN 'payment overdue, reminder sent' END AS notes
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey
"""

SHIPMENTS = f"""
SELECT {_SRC_ROW} AS src_row,
 concat('SHP-', l_orderkey, '-', l_linenumber) AS shipment_id, sn.n_name AS origin, cn.n_name AS destination,
 concat('Carrier ', l_partkey % 12) AS carrier, CAST(o_orderdate AS DATE) AS departure_date,
 CAST(CAST(o_orderdate AS DATE) + CAST(3 + l_partkey % 10 AS INT) AS DATE) AS estimated_arrival,
 CASE WHEN l_linestatus = 'F' THEN CAST(CAST(o_orderdate AS DATE)
      + CAST(3 + l_partkey % 10 + CAST(l_quantity AS INT) % 12 - 4 AS INT) AS DATE) END AS actual_arrival,
 CASE WHEN l_returnflag = 'R' THEN 'Delayed' WHEN l_linestatus = 'F' THEN 'Delivered' ELSE 'In Transit' END AS status,
 l_extendedprice AS value, round(l_discount * 10, 2) AS risk_score,
 CASE WHEN l_returnflag = 'A' AND l_tax >= 0.07 THEN 'route_deviation' ELSE 'none' END AS anomaly_type,
 concat('DRV-', l_partkey % 50) AS driver_id,
 concat('via ', l_partkey % 3) AS actual_route, concat('via ', l_suppkey % 3) AS expected_route
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
 JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} sn ON s_nationkey = sn.n_nationkey
 JOIN {{nation}} cn ON c_nationkey = cn.n_nationkey
"""

# carriers approved per freight mode, and those of the shipment guidelines
APPROVED_BY_MODE = {
    "air": ["Northwind Shipping", "Skyline Express"],
    "ocean": ["Blue Ocean Lines", "Northwind Shipping", "Maritime Union"],
    "ground": ["Countrywide Express", "Valley Carriers"],
}
GUIDELINE_CARRIERS = ["Northwind Shipping", "Harbour Worldwide"]

_PLACE = """CASE {col} WHEN 'NATION_0' THEN 'New York USA' WHEN 'NATION_1' THEN 'London UK'
 WHEN 'NATION_2' THEN 'Shanghai China' WHEN 'NATION_3' THEN 'Unknown' WHEN 'NATION_4' THEN 'fake'
 WHEN 'NATION_5' THEN 'Hamburg Germany' WHEN 'NATION_6' THEN 'Tokyo Japan' WHEN 'NATION_7' THEN 'Busan Korea'
 WHEN 'NATION_8' THEN 'Chicago USA' ELSE {col} END"""

# the shipments view with place and carrier names that the name-based rules look for
NAMED_SHIPMENTS = f"""
SELECT src_row, shipment_id, {_PLACE.format(col='origin')} AS origin, {_PLACE.format(col='destination')} AS destination,
 CASE carrier WHEN 'Carrier 11' THEN 'Suspicious Cargo' WHEN 'Carrier 10' THEN 'Alternative Freight'
  WHEN 'Carrier 9' THEN 'northwind shipping (air)' WHEN 'Carrier 8' THEN 'Harbour Worldwide'
  WHEN 'Carrier 7' THEN 'Maritime' WHEN 'Carrier 6' THEN 'Countrywide Express' ELSE carrier END AS carrier,
 departure_date, estimated_arrival, actual_arrival, status,
 CASE WHEN driver_id = 'DRV-7' THEN CAST(12000 AS DOUBLE) ELSE value END AS value,
 risk_score, anomaly_type, driver_id, actual_route, expected_route
FROM {{shipments}}
"""

EVENTS = """
SELECT concat('EV-', event_id) AS event_id,
 CASE event_type WHEN 'error' THEN 'driver_risk_increase' WHEN 'view' THEN 'weather_event'
  WHEN 'click' THEN 'shipment_delay' WHEN 'purchase' THEN 'shipment_anomaly' ELSE 'payment_policy_change' END AS event_type,
 concat('ENT-', user_id) AS entity_id,
 CASE WHEN user_id % 2 = 0 THEN 'shipment' ELSE 'driver' END AS entity_type,
 concat(event_type, ' event ', event_id) AS description, ts, value,
 CAST(event_id % 101 AS DOUBLE) / 100 AS risk_score
FROM {events}
"""

SUPPLIER_TERMS = """
SELECT s_name AS supplier, concat('NET', 15 * (1 + s_suppkey % 4)) AS agreed_terms,
 CAST(s_suppkey % 5 AS DOUBLE) / 100 AS agreed_discount,
 CASE WHEN s_suppkey % 10 = 0 THEN 'high' WHEN s_suppkey % 10 = 1 THEN 'medium' ELSE 'low' END AS supplier_risk
FROM {supplier}
"""

# carriers named in the shipments, so the table follows the data
CARRIER_TIER = """
SELECT carrier, CASE WHEN n <= 4 THEN 'tier_1' WHEN n <= 8 THEN 'tier_2' WHEN n = 11 THEN 'blacklisted' ELSE 'none' END AS tier
FROM (SELECT DISTINCT concat('Carrier ', p_partkey % 12) AS carrier, p_partkey % 12 AS n FROM {part}) c
"""

# driver status rows: the last error event of a user stands for the latest incident
DRIVERS = """
SELECT concat('DRV-', user_id) AS driver_id, concat('Driver ', user_id) AS name,
 CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= 16 THEN 'High'
      WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= 13 THEN 'high'
      WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= 10 THEN 'Low' END AS risk_level,
 CAST(CAST(max(CASE WHEN event_type = 'error' THEN ts END) AS DATE) AS {text}) AS last_incident,
 CASE WHEN count(*) % 3 = 0 THEN 'Immediate reassignment required' END AS recommendation
FROM {events} GROUP BY user_id
"""

# a shipment entity is served by the driver entity numbered after it
EDGES = """
SELECT DISTINCT concat('ENT-', user_id) AS source, concat('ENT-', user_id + 1) AS target, 'shipment_to_driver' AS relationship_type
FROM {events} WHERE user_id % 2 = 0
"""

# document rows typed for retrieval; a source name stands for the file a text came from
DOCS = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'shipment' WHEN 2 THEN 'policy' ELSE 'anomaly' END AS doc_type,
 CASE WHEN doc_id % 7 = 0 THEN concat('comprehensive_', source) WHEN doc_id % 7 = 1 THEN concat(source, '_001') ELSE source END AS source,
 text AS content
FROM {documents}
"""

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "invoices": INVOICES,
    "shipments": SHIPMENTS,
    "named_shipments": NAMED_SHIPMENTS,
    "causal_events": EVENTS,
    "supplier_terms": SUPPLIER_TERMS,
    "carrier_tier": CARRIER_TIER,
    "drivers": DRIVERS,
    "entity_edges": EDGES,
    "docs": DOCS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of the views over them."""
    if name in _TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    needed = [t for t in [*_TABLES, *VIEWS] if "{" + t + "}" in sql]
    return spark.sql(sql.replace("{text}", "STRING"), **{t: view(spark, sf_dir, t) for t in needed})


def oracle_view(name: str) -> str:
    """The view's text for DuckDB, where the driver tables are registered by name."""
    sql = VIEWS[name].replace("{text}", "VARCHAR")
    for t in [*_TABLES, *VIEWS]:
        sql = sql.replace("{" + t + "}", t)
    return sql


def with_views(body: str, *names: str, **extra: str) -> str:
    """``body`` preceded by the named views (and extra named selects) as common table expressions."""
    order = [n for n in VIEWS if n in names or (n == "shipments" and "named_shipments" in names)]
    parts = [f"{n} AS ({oracle_view(n)})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
