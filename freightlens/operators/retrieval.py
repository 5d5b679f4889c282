"""Retrieval for many questions at once: neighbours, keyword hits, ranking, context and sources.

Keyword hits come from an inverted index over all chunks. What follows works on the few best of either kind.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata as ref
from ..functions.columns import has_any, words
from ..functions.sizing import sized
from .chunks import common_words
from .inverted import keyword_search
from .questions import doc_types

NEIGHBOURS = 10  # nearest chunks per question and type
ENDS = 4  # characters at either end of an asked id that a record's id is compared with by kind


def term_parts(question: str) -> Column:
    """What ``key_terms`` takes from the text alone: its words, and its whole numbers and quoted phrases."""
    q = F.col(question)
    numbers = F.regexp_extract_all(q, F.lit(r"\b\d+\b"), F.lit(0))
    quoted = F.regexp_extract_all(q, F.lit(r'"([^"]*)"'), F.lit(1))
    return F.struct(words(F.lower(q)).alias("words"), F.concat(numbers, quoted).alias("marked"))


def key_terms(question: str, doc_type: Column, parts: Column | None = None) -> Column:
    """Domain words, whole numbers and quoted phrases of a question; else its first five words.

    A caller with a row per type works out ``parts`` (see ``term_parts``) once per question, before types become rows.
    """
    parts = term_parts(question) if parts is None else parts
    all_words, marked = parts["words"], parts["marked"]
    within = lambda names: F.filter(all_words, lambda w: w.isin(names))
    domain = F.when(doc_type == "invoice", within(ref.INVOICE_KEY_WORDS)).when(doc_type == "shipment", within(ref.SHIPMENT_KEY_WORDS)).otherwise(all_words)
    terms = F.array_distinct(F.concat(domain, marked))
    return F.when(F.size(terms) > 0, terms).otherwise(F.slice(all_words, 1, 5))


def keyword_score(terms: str | Column, content: str = "content") -> Column:
    """Share of the terms found in the text."""
    low, t = F.lower(F.col(content)), F.col(terms) if isinstance(terms, str) else terms
    hits = F.size(F.filter(t, lambda x: low.contains(F.lower(x))))
    return F.when(F.size(t) > 0, hits / F.size(t)).otherwise(0.0)


def relevance(question: str = "question", content: str = "content", keyword: str = "keyword_score") -> Column:
    q, text = F.lower(F.col(question)), F.lower(F.col(content))
    asked = F.array_distinct(words(q))
    share = F.when(F.size(asked) > 0, F.size(common_words(question, content)) / F.size(asked)).otherwise(0.0)
    score = F.when(text.contains(q), 0.4).otherwise(0.0) + share * 0.3 + F.col(keyword) * 0.3
    return F.least(F.lit(1.0), score)


def recency_class(source: str = "source") -> Column:
    """Collected files count as newest, numbered single files as older."""
    return F.when(has_any(source, ["comprehensive"]), 1.0).when(has_any(source, ["001", "002", "003", "004"]), 0.8).otherwise(0.6)


def rank_score() -> Column:
    kind = F.col("doc_type")
    priority = F.when(kind == "invoice", 0.9).when(kind == "shipment", 0.8).when(kind == "policy", 0.7).otherwise(0.5)
    return F.col("relevance") * 0.4 + priority * 0.3 + recency_class() * 0.2 + F.col("keyword_score") * 0.1


def ask(questions: DataFrame, vector: Column) -> DataFrame:
    """Questions with their vector and the document types they are about."""
    return questions.select("query_id", "question", doc_types("question").alias("doc_types"), vector.alias("vector"))


def candidates(near: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Neighbours with their text, the question and the keyword score."""
    rows = near.join(chunks.select("doc_id", "chunk_id", "source", "content"), ["doc_id", "chunk_id"]).join(
        questions.select("query_id", "question"), "query_id"
    )
    return rows.withColumn("keyword_score", keyword_score(key_terms("question", F.col("doc_type"))))


def semantic(rows: DataFrame, k: int = 8) -> DataFrame:
    """Close neighbours; a long question is held to a closer distance."""
    limit = F.when(F.size(words("question")) > 5, 0.7).otherwise(0.8)
    return rows.where((F.col("rank") <= k) & (F.col("distance") < limit))


def asked_terms(questions: DataFrame) -> DataFrame:
    """query_id, question, doc_type and the key terms, per type that a question is about."""
    rows = questions.select("query_id", "question", "doc_types", term_parts("question").alias("parts"))
    rows = rows.select("query_id", "question", F.explode("doc_types").alias("doc_type"), "parts")
    return rows.withColumn("terms", key_terms("question", F.col("doc_type"), F.col("parts"))).drop("parts")


def keyword(asked: DataFrame, folder: str, chunks: DataFrame, k: int = 10) -> DataFrame:
    """The chunks of the whole index that contain key terms, best share first, then by document and chunk."""
    # a few rows per question, so the texts stay where they are
    best = keyword_search(asked, folder, chunks, k).withColumnRenamed("rank", "keyword_rank")
    texts = chunks.select("doc_type", "doc_id", "chunk_id", "source", "content")
    return best.join(texts, ["doc_type", "doc_id", "chunk_id"]).join(asked.select("query_id", "doc_type", "question"), ["query_id", "doc_type"])


HIT = ["query_id", "question", "doc_type", "doc_id", "chunk_id", "source", "content", "keyword_score", "method", "method_rank"]


def combine(rows: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Semantic hits among the neighbours, then keyword hits, each text once."""
    a = semantic(rows).select("*", F.lit("semantic").alias("method"), F.col("rank").alias("method_rank"))
    b = keyword_hits.select("*", F.lit("keyword").alias("method"), F.col("keyword_rank").alias("method_rank"))
    return first_by_content(a.select(*HIT).unionByName(b.select(*HIT)), ["query_id", "doc_type"])


def first_by_content(rows: DataFrame, group: list[str], prefix: int | None = None) -> DataFrame:
    """The first row of each text. With ``prefix`` texts count as one when so many first characters agree."""
    text = F.sha2("content", 256) if prefix is None else F.substring("content", 1, prefix)
    w = Window.partitionBy(*group, text).orderBy(F.desc("method"), "method_rank")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fallback(rows: DataFrame, combined: DataFrame, k: int = 10, limit: float = 1.2, keep: int = 3) -> DataFrame:
    """For questions without any hit: the nearest few under a relaxed distance."""
    open_rows = rows.join(combined.select("query_id").distinct(), "query_id", "left_anti").where((F.col("rank") <= k) & (F.col("distance") < limit))
    return open_rows.where(F.col("rank") <= keep).select("*", F.lit("fallback").alias("method"), F.col("rank").alias("method_rank"))


def ranked(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each question."""
    scored = rows.withColumn("relevance", relevance()).withColumn("score", F.round(rank_score(), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_type", F.desc("method"), "method_rank")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def context(best: DataFrame, questions: DataFrame, per_type: int = 5) -> DataFrame:
    """The ranked documents as one text per question, grouped by type in order of appearance."""
    w = Window.partitionBy("query_id", "doc_type").orderBy("place")
    rows = best.withColumn("no", F.row_number().over(w)).where(F.col("no") <= per_type)
    kind = F.upper("doc_type")
    text = F.concat(
        F.lit("\n["), kind, F.lit(" #"), F.col("no"), F.lit(" from "), F.coalesce("source", F.lit("unknown")), F.lit("]\n"), F.trim("content"), F.lit("\n"),
    )
    groups = rows.groupBy("query_id", "doc_type").agg(
        F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("no", text.alias("text")))).alias("texts")
    )
    block = F.concat(F.lit("\n--- "), kind, F.lit(" DATA ---\n"), F.array_join(F.transform("texts", lambda x: x.text), "\n"))
    whole = groups.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", block.alias("text")))).alias("parts"))
    head = F.concat(F.lit("=== RELEVANT "), F.upper(F.try_element_at("doc_types", F.lit(1))), F.lit(" INFORMATION ===\n"))
    return whole.join(questions.select("query_id", "doc_types"), "query_id").select(
        "query_id",
        F.concat(head, F.lit("\n"), F.array_join(F.transform("parts", lambda x: x.text), "\n"), F.lit("\n\n=== END OF CONTEXT ===")).alias("context"),
    )


def sources(combined: DataFrame, k: int = 5) -> DataFrame:
    """The first sources of each question with their relevance in words."""
    rows = combined.withColumn("relevance", relevance())
    w = Window.partitionBy("query_id").orderBy("doc_type", F.desc("method"), "method_rank")
    mark = F.when(F.col("relevance") > 0.7, " [High Relevance]").when(F.col("relevance") > 0.5, " [Medium Relevance]").otherwise("")
    text = F.concat(F.initcap("doc_type"), F.lit(": "), F.coalesce("source", F.lit("unknown")), F.lit(" (ID: "), F.col("doc_id"), F.lit(")"), mark)
    return rows.withColumn("no", F.row_number().over(w)).where(F.col("no") <= k).select("query_id", "no", text.alias("source"))


def confidence(results: DataFrame) -> DataFrame:
    """Confidence of answers: results hold query_id, question, answer, docs, avg_relevance."""
    answer, docs, n_words = F.coalesce("answer", F.lit("")), F.col("docs"), F.size(words("question"))
    text = F.when(F.length(answer) > 200, 0.1).otherwise(0.0) + F.when(has_any(answer, ["specific", "exactly", "precisely"]), 0.1).otherwise(0.0)
    base = F.when(answer.contains("I don't have enough information"), 0.2).otherwise(0.6 + text)
    base = F.when(docs >= 5, base + 0.15).when(docs >= 3, base + 0.1).when(docs == 0, 0.1).otherwise(base)
    base = base + F.coalesce(F.col("avg_relevance"), F.lit(0.0)) * 0.2
    base = base + F.when(n_words <= 3, 0.05).when(n_words > 10, -0.05).otherwise(0.0)
    return results.select("query_id", F.least(F.lit(0.95), F.greatest(F.lit(0.1), base)).alias("confidence"))


# fixed values: (words in the update, words in the question) that make them match
TOPICS = [
    (["driver", "risk"], ["driver"]),
    (["invoice", "payment", "policy"], ["invoice", "payment", "policy"]),
    (["shipment", "route", "anomaly"], ["shipment", "route", "anomaly"]),
]
ALERT_WORDS = ["alert", "high", "risk", "anomaly"]


def recent_match(questions: DataFrame, updates: DataFrame, alerts: DataFrame, last_updates: int = 20, last_alerts: int = 10) -> DataFrame:
    """Newest updates and alerts that share a topic with a question.

    Only the newest few rows of either log take part, so the pairing side is a constant. The topics of a question are one
    number, so a question is one short row when repeated questions are merged, and the pairs need no merging after that.
    """
    count = len(TOPICS) + 1  # the last topic is that of the alerts
    topics = lambda text, side: F.array_compact(F.array(*[F.when(has_any(text, t[side]), i) for i, t in enumerate(TOPICS)]))
    new_u = updates.orderBy(F.desc("ts"), "update_id").limit(last_updates).select(
        F.lit("update").alias("kind"), F.col("update_id").alias("item_id"), F.explode(topics("content", 0)).alias("topic")
    )
    new_a = alerts.orderBy(F.desc("ts"), "alert_id").limit(last_alerts).select(
        F.lit("alert").alias("kind"), F.col("alert_id").alias("item_id"), F.lit(len(TOPICS)).alias("topic")
    )
    conditions = [has_any("question", words) for _, words in TOPICS] + [has_any("question", ALERT_WORDS)]
    mask = reduce(lambda x, y: x.bitwiseOR(y), [F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(conditions)])
    asked = questions.select("query_id", mask.alias("mask")).where("mask > 0").groupBy("query_id").agg(F.bit_or("mask").alias("mask"))
    masks = questions.sparkSession.range(1, 1 << count).select(F.col("id").cast("int").alias("mask"))
    shares = F.col("mask").bitwiseAND(F.expr("shiftleft(1, topic)")) != 0
    items = masks.join(F.broadcast(new_u.unionByName(new_a)), shares).select("mask", "kind", "item_id").distinct()
    return asked.join(F.broadcast(items), "mask").select("query_id", "kind", "item_id")


# --- structured answers ---------------------------------------------------------------------


def lookup_by_suffix(asked: DataFrame, rows: DataFrame, id_col: str, order: str = "src_row") -> DataFrame:
    """For each asked id the first record whose id equals it or ends with it.

    Ids are cut to the endings that look like an asked one, see ``_shape``, and the first record per ending is found before
    the join, so an ending shared by many records costs one row and most ids none at all. ``asked`` is worked out once.
    """
    asked = sized(asked)
    ends = asked.where("asked_id <> ''").select(F.col("asked_id").alias("ending")).distinct()
    # a few entries per length
    shapes = ends.agg(F.collect_set(_shape(_kinds(F.col("ending")))).alias("shapes"))
    right = lambda n: F.substring("_k", F.length("_k") - n + 1, n)
    fits = F.filter("shapes", lambda x: (x["n"] <= F.length("_k")) & (x["tail"] == right(F.least(x["n"], F.lit(ENDS)))) & (x["head"] == F.substring(right(x["n"]), 1, ENDS)))
    cut = rows.select(F.col(id_col), F.col(order), _kinds(F.col(id_col)).alias("_k")).join(F.broadcast(shapes))
    cut = cut.select(id_col, order, F.explode(F.transform(fits, lambda x: x["n"])).alias("_n"))
    cut = cut.select(id_col, order, F.expr(f"right({id_col}, _n)").alias("ending"))
    firsts = cut.groupBy("ending").agg(F.min_by(F.struct(id_col, order), order).alias("r"))
    firsts = sized(firsts.join(ends, "ending", "left_semi"))
    return asked.join(firsts, F.col("asked_id") == F.col("ending"), "left").select(asked["*"], f"r.{id_col}", f"r.{order}")


def _kinds(text: Column) -> Column:
    """Every digit as 0, every letter as a; equal texts stay equal and so do their endings."""
    return F.translate(text, string.digits + string.ascii_letters, "0" * 10 + "a" * 52)


def _shape(kinds: Column) -> Column:
    """What equal endings have in common: length, first and last few kinds of characters."""
    n = F.length(kinds)
    tail = F.substring(kinds, F.greatest(n - ENDS, F.lit(0)) + 1, ENDS)
    return F.struct(n.alias("n"), F.substring(kinds, 1, ENDS).alias("head"), tail.alias("tail"))


def lookup_equal(asked: DataFrame, rows: DataFrame, id_col: str, order: str = "src_row") -> DataFrame:
    """For each asked id the first record with that id, case-blind; other records go before the grouping."""
    ids = asked.select(F.upper("asked_id").alias("_asked")).where("_asked IS NOT NULL").distinct()
    rows = rows.join(ids, F.upper(id_col) == F.col("_asked"), "left_semi")
    firsts = rows.groupBy(F.upper(id_col).alias("_id")).agg(F.min_by(F.struct(id_col, order), order).alias("r"))
    return asked.join(firsts, F.upper("asked_id") == F.col("_id"), "left").select(asked["*"], f"r.{id_col}", f"r.{order}")


def asked_invoice(question: str = "question") -> Column:
    return F.nullif(F.regexp_extract(question, r"#?(\d+|[A-Z]+-\d+)", 1), F.lit(""))


def asked_shipment(question: str = "question") -> Column:
    named = F.col(question).contains("#") | F.lower(question).contains("shp-")
    return F.when(named, F.nullif(F.regexp_extract(question, r"(?i)(SHP-\d+-\d+|\d+)", 1), F.lit("")))


def anomaly_focus(question: str = "question") -> Column:
    out = F.when(has_any(question, ["low risk", "low-risk"]), "low").when(has_any(question, ["high risk", "high-risk"]), "high")
    return out.when(has_any(question, ["medium risk", "medium-risk"]), "medium").otherwise("overview")


def count_focus(question: str = "question") -> Column:
    inv, shp = has_any(question, ["invoice"]), has_any(question, ["shipment"])
    return F.when(inv & ~shp, "invoices").when(shp & ~inv, "shipments").otherwise("both")


def answers(questions: DataFrame, route: Column, invoices: DataFrame, shipments: DataFrame, facts: DataFrame) -> DataFrame:
    """Routed structured answers: a record, a miss, or the facts of the route.

    ``facts`` has one row per route (route, total, part_1, part_2, part_3).
    """
    # each of the three kinds reads the questions; they are worked out once
    rows = sized(questions.select("query_id", "question", route.alias("route")).where("route IS NOT NULL"))
    by_invoice = lookup_by_suffix(rows.where("route = 'invoice'").withColumn("asked_id", asked_invoice()), invoices, "invoice_id")
    by_shipment = lookup_equal(rows.where("route = 'shipment'").withColumn("asked_id", asked_shipment()), shipments, "shipment_id")
    rest = rows.where("route IN ('anomaly', 'count')").select(
        "*", F.lit(None).cast("string").alias("asked_id"), F.lit(None).cast("string").alias("record_id")
    )
    cols = ["query_id", "question", "route", "asked_id", "record_id"]
    both = reduce(
        DataFrame.unionByName,
        [by_invoice.withColumnRenamed("invoice_id", "record_id").select(*cols), by_shipment.withColumnRenamed("shipment_id", "record_id").select(*cols), rest.select(*cols)],
    )
    kind = (
        F.when(F.col("record_id").isNotNull(), "record")
        .when(F.col("asked_id").isNotNull(), "not_found")
        .when(F.col("route") == "anomaly", anomaly_focus())
        .when(F.col("route") == "count", count_focus())
        .otherwise("summary")
    )
    return both.withColumn("kind", kind).join(F.broadcast(facts), "route").select(
        "query_id", "route", "kind", "asked_id", "record_id", "total", "part_1", "part_2", "part_3"
    )
