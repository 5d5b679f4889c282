"""Queries over chunks and vectors, and structured answers to questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata as ref
from ..functions.sizing import sized, spread
from ..functions.vectors import embed
from ..operators import chunks, filters, knn, questions, retrieval, summaries
from ..operators.intervals import micros
from ..operators.inverted import add_to_index
from ..sources.scratch import scratch
from .catalog import Source, query
from .store import BAND3, CTES as STORE_CTES, VIEWS as STORE_VIEWS, store
from .texts import Q_CTE, asked as all_questions

# one question per benchmark item, worded so that every document type is asked for
ASKED = """SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN concat('policy ', text) WHEN 2 THEN concat('late fee 30 ', text)
 ELSE concat('"the" route ', text) END AS question FROM {benchmark}"""


def asked(s: Source) -> DataFrame:
    return s.spark.sql(ASKED, benchmark=s.benchmark)


def indexed(s: Source) -> DataFrame:
    return chunks.chunk_windows(s.docs)


class Found:
    """Chunks, vectors and index made once, and what a question finds there."""

    def __init__(self, s: Source):
        self.asked = sized(retrieval.ask(asked(s), embed("question")))
        # the documents are read, cut and embedded once
        self.chunks = sized(indexed(s).withColumn("chunk_id", F.col("chunk_id").cast("bigint")).withColumn("vector", embed("content")))
        self.scratch = lambda: scratch(s.spark, "index")

    def near(self) -> DataFrame:
        """The nearest chunks per question and type, with text and scores."""
        near = knn.nearest(self.asked, self.chunks, retrieval.NEIGHBOURS)
        return retrieval.candidates(sized(near), self.asked, self.chunks)

    def keyword(self, *batches: str) -> DataFrame:
        """Keyword hits; the index is written at once or in batches, as it grows."""
        folder = self.scratch()
        for part in batches or ("true",):
            add_to_index(self.chunks.where(part), folder)
        return retrieval.keyword(retrieval.asked_terms(self.asked), folder, self.chunks)

    def combined(self) -> DataFrame:
        return retrieval.combine(self.near(), self.keyword())


_I, _S, _P = (
    "(" + " OR ".join(f"contains(lower(question), '{w}')" for w in words) + ")" for words in (ref.INVOICE_TERMS, ref.SHIPMENT_TERMS, ref.POLICY_TERMS)
)


def _tok(frm: str, keys: str, text: str) -> str:
    return f"""SELECT {keys}, CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n
 FROM (SELECT {keys}, unnest(string_split_regex(lower({text}), '\\s+')) AS w FROM {frm}) t WHERE w <> '' GROUP BY ALL"""


def _wordlist(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"


def _in(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


C = dict(
    chunks="""SELECT * FROM (SELECT doc_id, doc_type, source, i AS chunk_id, substr(content, CAST(i * 800 + 1 AS BIGINT), 1000) AS content FROM
 (SELECT *, unnest(range(0, CAST(greatest(ceil((length(content) - 200) / 800.0), 1) AS BIGINT))) AS i FROM docs WHERE length(trim(content)) > 0) a) b WHERE length(trim(content)) > 0""",
    asked=ASKED.replace("{benchmark}", "benchmark"),
    types=f"""SELECT query_id, question, unnest(CASE WHEN NOT ({_I} OR {_S} OR {_P}) THEN ['invoice', 'shipment'] ELSE list_filter([CASE WHEN {_I} THEN 'invoice' END,
 CASE WHEN {_S} THEN 'shipment' END, CASE WHEN {_P} THEN 'policy' END], lambda x: x IS NOT NULL) END) AS doc_type FROM asked""",
    dtok=_tok("chunks", "doc_id, chunk_id", "content"),
    qtok=_tok("asked", "query_id", "question"),
    dnorm="SELECT doc_id, chunk_id, sqrt(sum(n * n)) AS dn FROM dtok GROUP BY ALL",
    qnorm="SELECT query_id, sqrt(sum(n * n)) AS qn FROM qtok GROUP BY ALL",
    dots="SELECT query_id, doc_id, chunk_id, sum(d.n * q.n) AS dot FROM dtok d JOIN qtok q USING (b) GROUP BY ALL",
    near="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY distance, doc_id, chunk_id) AS rank FROM (
 SELECT t.query_id, t.question, t.doc_type, c.doc_id, c.chunk_id, c.source, c.content, round(greatest(2 - 2 * coalesce(dot, 0) / (qn * dn), 0), 6) AS distance
 FROM types t JOIN chunks c USING (doc_type) JOIN qnorm USING (query_id) JOIN dnorm USING (doc_id, chunk_id) LEFT JOIN dots USING (query_id, doc_id, chunk_id)) x) y WHERE rank <= 10""",
    termed=f"""SELECT query_id, question, doc_type, CASE WHEN len(t0) > 0 THEN t0 ELSE {_wordlist('question')}[1:5] END AS terms FROM (SELECT *, list_distinct(
 CASE doc_type WHEN 'invoice' THEN list_filter({_wordlist('question')}, lambda w: list_contains({_in(ref.INVOICE_KEY_WORDS)}, w))
 WHEN 'shipment' THEN list_filter({_wordlist('question')}, lambda w: list_contains({_in(ref.SHIPMENT_KEY_WORDS)}, w)) ELSE {_wordlist('question')} END
 || regexp_extract_all(question, '\\b\\d+\\b') || regexp_extract_all(question, '"([^"]*)"', 1)) AS t0 FROM types) z""",
    cand="SELECT n.*, CAST(len(list_filter(terms, lambda t: contains(lower(content), lower(t)))) AS DOUBLE) / len(terms) AS keyword_score FROM near n JOIN termed USING (query_id, doc_type)",
    kall="SELECT t.query_id, t.question, t.doc_type, c.doc_id, c.chunk_id, c.source, c.content, CAST(len(list_filter(terms, lambda t: contains(lower(content), lower(t)))) AS DOUBLE) / len(terms) AS keyword_score "
    "FROM termed t JOIN chunks c USING (doc_type)",
    sem=f"SELECT * FROM cand WHERE rank <= 8 AND distance < CASE WHEN len({_wordlist('question')}) > 5 THEN 0.7 ELSE 0.8 END",
    kw="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY keyword_score DESC, doc_id, chunk_id) AS keyword_rank FROM kall WHERE keyword_score > 0) k WHERE keyword_rank <= 10",
    comb="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type, content ORDER BY method DESC, method_rank) AS pn FROM (
 SELECT query_id, question, doc_type, doc_id, chunk_id, source, content, keyword_score, 'semantic' AS method, rank AS method_rank FROM sem
 UNION ALL SELECT query_id, question, doc_type, doc_id, chunk_id, source, content, keyword_score, 'keyword', keyword_rank FROM kw) u) v WHERE pn = 1""",
    rel=f"""SELECT *, least(1.0, CASE WHEN contains(lower(content), lower(question)) THEN 0.4 ELSE 0.0 END
 + CAST(len(list_intersect(list_distinct({_wordlist('question')}), list_distinct({_wordlist('content')}))) AS DOUBLE) / len(list_distinct({_wordlist('question')})) * 0.3 + keyword_score * 0.3) AS relevance FROM comb""",
    scored="""SELECT *, round(relevance * 0.4 + CASE doc_type WHEN 'invoice' THEN 0.9 WHEN 'shipment' THEN 0.8 WHEN 'policy' THEN 0.7 ELSE 0.5 END * 0.3
 + CASE WHEN lower(source) LIKE '%comprehensive%' THEN 1.0 WHEN regexp_matches(source, '001|002|003|004') THEN 0.8 ELSE 0.6 END * 0.2 + keyword_score * 0.1, 9) AS score FROM rel""",
    best="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_type, method DESC, method_rank) AS place FROM scored) b WHERE place <= 10",
)


def q(name: str, sql: str, **extra: str):
    return query(name, sql, "docs", **C, **extra)


KEYS = "query_id, doc_type, doc_id, chunk_id"
K = KEYS.split(", ")


@q("idx_chunk_text", "SELECT doc_id, chunk_id, doc_type, content FROM chunks")
def _(s: Source):
    return indexed(s).select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "doc_type", "content")


# what any splitting must keep: every word of the text (a cut may take a full stop off), and a bounded length
_VOCABULARY = "list_sort(list_distinct(list_filter(string_split_regex(lower(content), '[\\s.]+'), lambda w: w <> '')))"
SPLIT_SQL = f"""SELECT doc_id, doc_type, CAST(len(v) AS BIGINT) AS words, true AS bounded, md5(array_to_string(v, ' ')) AS vocabulary
 FROM (SELECT doc_id, doc_type, {_VOCABULARY} AS v FROM docs) x WHERE len(v) > 0"""


def split_check(pieces: DataFrame, text: str) -> DataFrame:
    """Per document the words its chunks hold and whether every chunk is of allowed length."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[\s.]+"), lambda w: w != ""))
    # a chunk is measured and split once and its text left behind, then its words become rows
    split = pieces.select("doc_id", "doc_type", F.length(text).alias("n"), words.alias("words"))
    per_word = split.select("doc_id", "doc_type", "n", F.explode_outer("words").alias("w")).where("w IS NOT NULL")
    per_word = per_word.groupBy("doc_id", "doc_type", "w").agg(F.max("n").alias("n"))
    every = F.array_join(F.array_sort(F.collect_list("w")), " ")
    return per_word.groupBy("doc_id", "doc_type").agg(F.count("*").alias("words"), (F.max("n") <= chunks.SIZE).alias("bounded"), F.md5(every).alias("vocabulary"))


@query("idx_chunk_separators", SPLIT_SQL, "docs")
def _(s: Source):
    return split_check(chunks.chunk_by_separators(s.docs), "content")


@q(
    "idx_list_documents",
    "SELECT doc_id, chunk_id, doc_type AS type, source, CASE WHEN length(content) > 100 THEN concat(substr(content, 1, 100), '...') ELSE content END AS preview FROM chunks",
)
def _(s: Source):
    rows = chunks.listing(indexed(s).withColumn("ts", F.lit(None).cast("timestamp"))).drop("ts")
    return rows.withColumn("chunk_id", F.col("chunk_id").cast("bigint"))


@q("idx_store_stats", "SELECT doc_type, count(*) AS documents, TIMESTAMP '2024-01-01' + to_days(CAST(max(doc_id) AS INT)) AS last_refresh FROM chunks GROUP BY doc_type")
def _(s: Source):
    day = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 86400)
    return chunks.store_stats(indexed(s).withColumn("ts", day))


# --- vectors --------------------------------------------------------------------------------


@query(
    "join_knn",
    """SELECT label AS query_id, vec_id, distance, rank FROM (SELECT m.label, e.vec_id, round(greatest(1 + list_inner_product(v, v) - 2 * list_inner_product(m.c, v), 0), 6) AS distance,
  row_number() OVER (PARTITION BY m.label ORDER BY round(greatest(1 + list_inner_product(v, v) - 2 * list_inner_product(m.c, v), 0), 6), vec_id) AS rank
 FROM cent m CROSS JOIN vecs e) x WHERE rank <= 8""",
    vecs="SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    sums="SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM vecs) a GROUP BY label, pos",
    cent="SELECT label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM (SELECT label, list(x ORDER BY pos) AS m FROM sums GROUP BY label) s",
)
def _(s: Source):
    vectors = s.embeddings
    qs = knn.centroids(vectors).select(F.col("label").cast("bigint").alias("query_id"), "vector", F.array(F.lit("all")).alias("doc_types"))
    docs = vectors.select(F.lit("all").alias("doc_type"), F.col("vec_id").alias("doc_id"), F.lit(0).cast("bigint").alias("chunk_id"), F.col("embedding").alias("vector"))
    return knn.nearest(qs, docs, 8).select("query_id", F.col("doc_id").alias("vec_id"), "distance", F.col("rank").cast("bigint").alias("rank"))


@q("udf_embed", "SELECT doc_id, chunk_id, b AS slot, round(n / dn, 6) AS weight FROM dtok JOIN dnorm USING (doc_id, chunk_id)")
def _(s: Source):
    rows = indexed(s).select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), embed("content").alias("vector"))
    flat = rows.select("doc_id", "chunk_id", F.posexplode("vector").alias("slot", "weight")).where("weight > 0")
    return flat.select("doc_id", "chunk_id", F.col("slot").cast("bigint").alias("slot"), F.round("weight", 6).alias("weight"))


# --- retrieval ------------------------------------------------------------------------------


@q("ret_semantic", f"SELECT {KEYS}, distance, rank FROM sem")
def _(s: Source):
    return retrieval.semantic(Found(s).near()).select(*K, "distance", F.col("rank").cast("bigint").alias("rank"))


@q("ret_keyword", f"SELECT {KEYS}, round(keyword_score, 6) AS keyword_score, keyword_rank FROM kw")
def _(s: Source):
    return Found(s).keyword("doc_id % 2 = 0", "doc_id % 2 <> 0").select(
        *K, F.round("keyword_score", 6).alias("keyword_score"), F.col("keyword_rank").cast("bigint").alias("keyword_rank")
    )


@query(
    "ret_key_terms",
    f"""SELECT query_id, doc_type, array_to_string(list_sort(CASE WHEN len(t0) > 0 THEN t0 ELSE {_wordlist('question')}[1:5] END), '|') AS terms FROM (SELECT query_id, doc_type, question, list_distinct(
 CASE doc_type WHEN 'invoice' THEN list_filter({_wordlist('question')}, lambda w: list_contains({_in(ref.INVOICE_KEY_WORDS)}, w))
 WHEN 'shipment' THEN list_filter({_wordlist('question')}, lambda w: list_contains({_in(ref.SHIPMENT_KEY_WORDS)}, w)) ELSE {_wordlist('question')} END
 || regexp_extract_all(question, '\\b\\d+\\b') || regexp_extract_all(question, '"([^"]*)"', 1)) AS t0
 FROM (SELECT query_id, question, unnest(['invoice', 'shipment', 'policy']) AS doc_type FROM questions) a) z""",
    "shipments", **Q_CTE,
)
def _(s: Source):
    kinds = F.explode(F.array(*[F.lit(x) for x in ("invoice", "shipment", "policy")]))
    rows = spread(all_questions(s), "query_id").select("query_id", "question", retrieval.term_parts("question").alias("parts"))
    rows = rows.select("query_id", "question", kinds.alias("doc_type"), "parts")
    terms = retrieval.key_terms("question", F.col("doc_type"), F.col("parts"))
    return rows.select("query_id", "doc_type", F.array_join(F.array_sort(terms), "|").alias("terms"))


@q("ret_combine", f"SELECT {KEYS}, method FROM comb")
def _(s: Source):
    return Found(s).combined().select(*K, "method")


@q("ret_relevance", f"SELECT {KEYS}, round(CAST(relevance AS DOUBLE), 6) AS relevance FROM rel")
def _(s: Source):
    return Found(s).combined().select(*K, F.round(retrieval.relevance(), 6).alias("relevance"))


@q("ret_rank", f"SELECT {KEYS}, round(CAST(score AS DOUBLE), 6) AS score FROM scored")
def _(s: Source):
    rows = Found(s).combined().withColumn("relevance", retrieval.relevance())
    return rows.select(*K, F.round(retrieval.rank_score(), 6).alias("score"))


@q("topk_context", f"SELECT {KEYS}, place FROM best")
def _(s: Source):
    return retrieval.ranked(Found(s).combined()).select(*K, F.col("place").cast("bigint").alias("place"))


@q(
    "ret_fallback",
    f"SELECT {KEYS}, distance FROM cand WHERE query_id NOT IN (SELECT query_id FROM sem) AND rank <= 3 AND distance < 1.2",
)
def _(s: Source):
    # asked of semantic hits alone, so that some questions stay open
    rows = Found(s).near()
    return retrieval.fallback(rows, retrieval.semantic(rows)).select(*K, "distance")


@q(
    "ret_context",
    """SELECT query_id, concat('=== RELEVANT ', upper(first_type), ' INFORMATION ===', chr(10), chr(10), body, chr(10), chr(10), '=== END OF CONTEXT ===') AS context FROM (
 SELECT query_id, string_agg(block, chr(10) ORDER BY f) AS body FROM (SELECT query_id, doc_type, min(place) AS f, concat(chr(10), '--- ', upper(doc_type), ' DATA ---', chr(10), string_agg(
  concat(chr(10), '[', upper(doc_type), ' #', no, ' from ', source, ']', chr(10), trim(content), chr(10)), chr(10) ORDER BY no)) AS block
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY place) AS no FROM best) n WHERE no <= 5 GROUP BY query_id, doc_type) g GROUP BY query_id) h
 JOIN (SELECT query_id, min(doc_type) AS first_type FROM types GROUP BY query_id) t USING (query_id)""",
)
def _(s: Source):
    # the first type asked for is alphabetically first among invoice, policy and shipment here
    asked_types = asked(s).select("query_id", F.array_sort(questions.doc_types("question")).alias("doc_types"))
    return retrieval.context(retrieval.ranked(Found(s).combined()), asked_types)


_MARK = "CASE WHEN relevance > 0.7 THEN ' [High Relevance]' WHEN relevance > 0.5 THEN ' [Medium Relevance]' ELSE '' END"


@q(
    "ret_sources",
    f"""SELECT query_id, no, source FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_type, method DESC, method_rank) AS no,
 concat(upper(doc_type[1]), doc_type[2:], ': ', source, ' (ID: ', doc_id, ')', {_MARK}) AS source FROM rel) x WHERE no <= 5""",
)
def _(s: Source):
    return retrieval.sources(Found(s).combined()).select("query_id", F.col("no").cast("bigint").alias("no"), "source")


@q(
    "ret_confidence",
    f"""SELECT query_id, round(CAST(least(0.95, greatest(0.1, CASE WHEN docs >= 5 THEN b + 0.15 WHEN docs >= 3 THEN b + 0.1 WHEN docs = 0 THEN 0.1 ELSE b END + coalesce(r, 0) * 0.2
 + CASE WHEN words <= 3 THEN 0.05 WHEN words > 10 THEN -0.05 ELSE 0 END)) AS DOUBLE), 6) AS confidence FROM (SELECT a.query_id, coalesce(docs, 0) AS docs, r, len({_wordlist('question')}) AS words,
 0.6 + CASE WHEN length(question) > 200 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(question), 'specific|exactly|precisely') THEN 0.1 ELSE 0 END AS b
 FROM asked a LEFT JOIN (SELECT query_id, count(*) AS docs, avg(relevance) AS r FROM rel GROUP BY query_id) d USING (query_id)) x""",
)
def _(s: Source):
    # no model answers here: the question's own text stands for the answer whose wording is judged
    rows = Found(s).combined().withColumn("relevance", retrieval.relevance())
    per = rows.groupBy("query_id").agg(F.count("*").alias("docs"), F.avg("relevance").alias("avg_relevance"))
    results = asked(s).join(per, "query_id", "left").select("query_id", "question", F.col("question").alias("answer"), F.coalesce("docs", F.lit(0)).alias("docs"), "avg_relevance")
    return retrieval.confidence(results).withColumn("confidence", F.round("confidence", 6))


@q(
    "dedup_content_whole",
    """SELECT doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id * 1000 + chunk_id) AS n FROM chunks) x WHERE n = 1""",
)
def _(s: Source):
    rows = indexed(s).select("*", F.lit("keyword").alias("method"), (F.col("doc_id") * 1000 + F.col("chunk_id")).alias("method_rank"))
    return retrieval.first_by_content(rows, []).select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"))


@q(
    "dedup_content_prefix",
    """SELECT doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY substr(content, 1, 100) ORDER BY CASE WHEN doc_type = 'invoice' THEN 'semantic' ELSE 'keyword' END DESC,
 doc_id * 1000 + chunk_id) AS n FROM chunks) x WHERE n = 1""",
)
def _(s: Source):
    rows = indexed(s).select(
        "*", F.when(F.col("doc_type") == "invoice", "semantic").otherwise("keyword").alias("method"), (F.col("doc_id") * 1000 + F.col("chunk_id")).alias("method_rank")
    )
    return retrieval.first_by_content(rows, [], prefix=100).select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"))


@query(
    "intersect_words",
    f"""SELECT u.conv_id, u.turn, CAST(len(list_intersect(list_distinct({_wordlist('u.text')}), list_distinct({_wordlist('a.text')}))) AS BIGINT) AS common
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""",
)
def _(s: Source):
    u = s.conversations.select("conv_id", "turn", "text")
    a = s.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.size(chunks.common_words("text", "reply")).cast("bigint").alias("common"))


# --- questions about the records ------------------------------------------------------------


@query(
    "ret_recent_match",
    """SELECT DISTINCT query_id, kind, item_id FROM (SELECT query_id, CASE WHEN contains(lower(question), 'invoice') OR contains(lower(question), 'payment') OR contains(lower(question), 'policy') THEN 1 ELSE 0 END AS a,
  CASE WHEN contains(lower(question), 'shipment') OR contains(lower(question), 'route') OR contains(lower(question), 'anomaly') THEN 1 ELSE 0 END AS b, contains(lower(question), 'driver') AS m,
  regexp_matches(lower(question), 'alert|high|risk|anomaly') AS al FROM questions) q JOIN (
  SELECT 'update' AS kind, event_id AS item_id, regexp_matches(content, 'invoice|payment|policy') AS ia, regexp_matches(content, 'shipment|route|anomaly') AS ib, regexp_matches(content, 'driver|risk') AS im, false AS ial
   FROM (SELECT event_id, event_type AS content FROM causal_events ORDER BY ts DESC, event_id LIMIT 20) x
  UNION ALL SELECT 'alert', event_id, false, false, false, true FROM (SELECT event_id FROM causal_events WHERE event_type LIKE '%anomaly%' ORDER BY ts DESC, event_id LIMIT 10) y) i
 ON (a = 1 AND ia) OR (b = 1 AND ib) OR (m AND im) OR (al AND ial)""",
    "shipments causal_events", **Q_CTE,
)
def _(s: Source):
    updates = s.causal_events.select(F.col("event_id").alias("update_id"), F.col("event_type").alias("content"), micros("ts").alias("ts"))
    alerts = filters.anomaly_events(s.causal_events).select(F.col("event_id").alias("alert_id"), micros("ts").alias("ts"))
    return retrieval.recent_match(all_questions(s), updates, alerts)


def facts(s: Source) -> DataFrame:
    """One row per route: the numbers a summary answer gives."""
    big = lambda *cols: [F.col(c).cast("bigint").alias(n) for c, n in zip(cols, ("total", "part_1", "part_2", "part_3"))]
    # single rows that several routes read, so each is worked out once
    inv = sized(summaries.invoice_summary(s.invoices).withColumn("cents", F.round("total_amount")))
    shp = sized(summaries.shipment_summary(s.shipments))
    rows = inv.select(F.lit("invoice").alias("route"), *big("invoices", "cents", "overdue", "flagged"))
    rows = rows.unionByName(shp.select(F.lit("shipment").alias("route"), *big("shipments", "in_transit", "delayed", "delivered")))
    rows = rows.unionByName(
        summaries.risk_distribution(store(s)).select(F.lit("anomaly").alias("route"), *big("total", "high_risk", "medium_risk", "low_risk"))
    )
    counts = inv.select("invoices").join(F.broadcast(shp.select("shipments"))).select(
        F.lit("count").alias("route"), (F.col("invoices") + F.col("shipments")).alias("total"), F.col("invoices").alias("part_1"),
        F.col("shipments").alias("part_2"), F.lit(0).cast("bigint").alias("part_3"),
    )
    return rows.unionByName(counts)


def _route_sql() -> str:
    parts = []
    for label, ws in ref.ROUTES:
        parts.append("WHEN " + " OR ".join(f"contains(lower(question), '{w}')" for w in ws) + f" THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


@query(
    "join_lookup_suffix",
    """SELECT query_id, asked_id, f.invoice_id, f.src_row FROM (SELECT query_id, nullif(regexp_extract(question, '#?(\\d+|[A-Z]+-\\d+)', 1), '') AS asked_id FROM questions) a
 LEFT JOIN (SELECT ending, arg_min(invoice_id, src_row) AS invoice_id, min(src_row) AS src_row FROM ends GROUP BY ending) f ON ending = asked_id WHERE asked_id IS NOT NULL""",
    "shipments invoices",
    **Q_CTE,
    ends="SELECT right(invoice_id, n) AS ending, invoice_id, src_row FROM (SELECT invoice_id, src_row, unnest(generate_series(1, length(invoice_id))) AS n FROM invoices) x",
)
def _(s: Source):
    rows = all_questions(s).select("query_id", retrieval.asked_invoice().alias("asked_id")).where("asked_id IS NOT NULL")
    return retrieval.lookup_by_suffix(rows, s.invoices, "invoice_id").select("query_id", "asked_id", "invoice_id", "src_row")


@query(
    "answer_aggregate",
    f"""SELECT query_id, route, CASE WHEN record_id IS NOT NULL THEN 'record' WHEN asked_id IS NOT NULL THEN 'not_found' WHEN route = 'anomaly' THEN
  CASE WHEN regexp_matches(lower(question), 'low.risk') THEN 'low' WHEN regexp_matches(lower(question), 'high.risk') THEN 'high' WHEN regexp_matches(lower(question), 'medium.risk') THEN 'medium' ELSE 'overview' END
  WHEN route = 'count' THEN 'both' ELSE 'summary' END AS kind, asked_id, record_id, total, part_1, part_2, part_3 FROM (
 SELECT r.*, coalesce(f.invoice_id, g.shipment_id) AS record_id FROM (SELECT query_id, question, route, CASE route WHEN 'invoice' THEN nullif(regexp_extract(question, '#?(\\d+|[A-Z]+-\\d+)', 1), '')
  WHEN 'shipment' THEN CASE WHEN contains(question, '#') OR contains(lower(question), 'shp-') THEN nullif(regexp_extract(question, '(SHP-\\d+-\\d+|\\d+)', 1, 'i'), '') END END AS asked_id
  FROM (SELECT *, {_route_sql()} AS route FROM questions) z WHERE route IS NOT NULL) r
 LEFT JOIN (SELECT ending, arg_min(invoice_id, src_row) AS invoice_id FROM ends GROUP BY ending) f ON route = 'invoice' AND ending = asked_id
 LEFT JOIN (SELECT upper(shipment_id) AS uid, arg_min(shipment_id, src_row) AS shipment_id FROM shipments GROUP BY 1) g ON route = 'shipment' AND uid = upper(asked_id)) y JOIN facts USING (route)""",
    "shipments " + STORE_VIEWS,
    **STORE_CTES,
    **Q_CTE,
    ends="SELECT right(invoice_id, n) AS ending, invoice_id, src_row FROM (SELECT invoice_id, src_row, unnest(generate_series(1, length(invoice_id))) AS n FROM invoices) x",
    facts=f"""SELECT 'invoice' AS route, count(*) AS total, CAST(round(sum(amount)) AS BIGINT) AS part_1, count(*) FILTER (lower(status) = 'overdue') AS part_2, count(*) FILTER (status LIKE '%flag%') AS part_3 FROM invoices
 UNION ALL SELECT 'shipment', count(*), count(*) FILTER (status = 'In Transit'), count(*) FILTER (status = 'Delayed'), count(*) FILTER (status = 'Delivered') FROM shipments
 UNION ALL SELECT 'anomaly', count(*), count(*) FILTER ({BAND3} = 'high'), count(*) FILTER ({BAND3} = 'medium'), count(*) FILTER ({BAND3} = 'low') FROM store
 UNION ALL SELECT 'count', (SELECT count(*) FROM invoices) + (SELECT count(*) FROM shipments), (SELECT count(*) FROM invoices), (SELECT count(*) FROM shipments), 0""",
)
def _(s: Source):
    return retrieval.answers(all_questions(s), questions.route("question"), s.invoices, s.shipments, facts(s))


@query(
    "anomaly_context",
    """SELECT query_id, (SELECT count(*) FROM store) AS total_count, (SELECT count(*) FROM store WHERE risk_score >= 0.8) AS high_risk_count,
 (SELECT string_agg(id, ',' ORDER BY risk_score DESC, ts DESC, id) FROM (SELECT * FROM store ORDER BY risk_score DESC, ts DESC, id LIMIT 10) t) AS recent
 FROM questions WHERE """ + " OR ".join(f"contains(lower(question), '{w}')" for w in ref.ANOMALY_WORDS),
    "shipments " + STORE_VIEWS,
    **STORE_CTES,
    **Q_CTE,
)
def _(s: Source):
    rows = store(s)
    ten = summaries.riskiest(rows, 10)
    order = F.struct((-F.col("risk_score")).alias("a"), (-micros("ts")).alias("b"), "id")
    head = ten.agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.id), ",").alias("recent"))
    totals = rows.agg(F.count("*").alias("total_count"), F.count_if(F.col("risk_score") >= 0.8).alias("high_risk_count"))
    # both are single rows
    one = totals.join(F.broadcast(head))
    return all_questions(s).where(questions.is_about_anomalies("question")).select("query_id").join(F.broadcast(one))
