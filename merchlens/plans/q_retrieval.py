"""Registered queries: chunking, TF-IDF index and search, dense top-k, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import dround
from merchlens.operators import chunks as C
from merchlens.operators import dense as D
from merchlens.operators import models as M
from merchlens.operators import retrieval as R
from merchlens.operators.analytics import merchant_filter
from merchlens.operators.filters import infer_filters
from merchlens.plans.catalog import register
from merchlens.plans.q_models import latest_of, stg_of
from merchlens.plans.sqltext import cte, dr, dt, tier, toks, with_ctes
from merchlens.session import ensure_checkpoint_dir
from merchlens.sources import fixtures as FX

# ---------------------------------------------------------------- SQL twins

_CATS = "list_filter(list_transform(string_split(categories, ','), lambda s: trim(s)), lambda s: s <> '')"
_NB = "coalesce(nullif(neighborhood, ''), city)"


def _nz(col: str, none: str) -> str:
    return f"CASE WHEN {col} IS NULL OR {col} = 0 THEN '{none}' ELSE CAST({col} AS VARCHAR) END"


def _s(expr: str) -> str:
    return f"coalesce(CAST({expr} AS VARCHAR), 'None')"


cte("chunks", ["latest"], f"""
SELECT md5(merchant_id || '_' || t) AS doc_id, merchant_id, t AS chunk_type, x AS text, merchant_name, city, state,
       neighborhood, mcc_code, mcc_description, categories, stars, review_count, review_velocity_30d,
       transaction_amount, transaction_value_tier, acceptance_method, price_range, is_open
FROM (
  SELECT merchant_id, merchant_name, city, state, {_NB} AS neighborhood, mcc_code, mcc_description,
         array_to_string(({_CATS})[1:3], ', ') AS categories, stars, review_count, review_velocity_30d,
         transaction_amount, {tier('transaction_amount')} AS transaction_value_tier, acceptance_method,
         price_range, is_open,
         unnest(['identity', 'financial', 'quality']) AS t,
         unnest([
           substr('Merchant: ' || {_s('merchant_name')} || '. ID: ' || {_s('merchant_id')} || '. Location:  '
                  || {_s(_NB)} || ', ' || {_s('city')} || ', ' || {_s('state')} || '. Categories: '
                  || array_to_string({_CATS}, ', ') || '. MCC: ' || {_s('mcc_code')} || ' — '
                  || {_s('mcc_description')} || '.', 1, 2048),
           'Merchant ' || {_s('merchant_name')} || ' financial profile: Average transaction $'
             || {dt('transaction_amount', 2)} || '. Price tier: ' || repeat('$', coalesce(nullif(price_range, 0), 2))
             || '. Acceptance method: ' || {_s('acceptance_method')} || '. Transaction value tier: '
             || {tier('transaction_amount')} || '.',
           'Merchant ' || {_s('merchant_name')} || ' customer metrics: Star rating ' || {_nz('stars', 'N/A')}
             || '. Total reviews: ' || {_nz('review_count', '0')} || '. Review velocity: '
             || {_nz('review_velocity_30d', '0')} || ' reviews/30 days. Currently '
             || CASE WHEN is_open THEN 'open' ELSE 'closed' END || '.'
         ]) AS x
  FROM latest)
""")


def _index_ctes(prefix: str, corpus: str, id_col: str, text_col: str) -> list[tuple[str, str]]:
    """postings / idf / weights over ``corpus`` as statement-local CTEs."""
    return [
        (f"{prefix}_post", f"""SELECT {id_col}, token, count(*) AS tf_count, max(n) AS n_tokens,
       CAST(count(*) AS DOUBLE) / max(n) AS tf
FROM (SELECT {id_col}, len(t) AS n, unnest(t) AS token
      FROM (SELECT {id_col}, regexp_extract_all(lower({text_col}), '{K.TOKEN_PATTERN}') AS t FROM {corpus}))
GROUP BY {id_col}, token"""),
        (f"{prefix}_idf", f"""SELECT token, count(*) AS df,
       ln((CAST((SELECT count(*) FROM {corpus}) AS DOUBLE) + 1) / (count(*) + 1)) + 1 AS idf
FROM {prefix}_post GROUP BY token"""),
        (f"{prefix}_w", f"""SELECT {id_col}, token, tf,
       tf * idf / coalesce(nullif(sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY {id_col})), 0), 1.0) AS weight
FROM {prefix}_post JOIN {prefix}_idf USING (token)"""),
    ]


def _query_ctes(prefix: str, questions: str, qid: str, qtext: str) -> list[tuple[str, str]]:
    return [
        (f"{prefix}_qpost", f"""SELECT {qid}, token, CAST(count(*) AS DOUBLE) / max(n) AS tf
FROM (SELECT {qid}, len(t) AS n, unnest(t) AS token
      FROM (SELECT {qid}, regexp_extract_all(lower({qtext}), '{K.TOKEN_PATTERN}') AS t FROM {questions}))
GROUP BY {qid}, token"""),
        (f"{prefix}_qw", f"""SELECT {qid}, token,
       tf * coalesce(idf, 1.0) / coalesce(nullif(sqrt(sum((tf * coalesce(idf, 1.0)) * (tf * coalesce(idf, 1.0)))
                                  OVER (PARTITION BY {qid})), 0), 1.0) AS q_weight
FROM {prefix}_qpost LEFT JOIN {prefix}_idf USING (token)"""),
    ]


def _scores_cte(prefix: str, qid: str, id_col: str) -> tuple[str, str]:
    return (f"{prefix}_sc", f"""SELECT {qid}, {id_col}, sum(q_weight * weight) AS score
FROM {prefix}_qw JOIN {prefix}_w USING (token) GROUP BY {qid}, {id_col}""")


_DOC_IDX = _index_ctes("d", "documents", "doc_id", "text")
_BQ = [("bq", "SELECT item_id AS query_id, text AS query FROM benchmark")]
_DOC_Q = _BQ + _query_ctes("d", "bq", "query_id", "query") + [_scores_cte("d", "query_id", "doc_id")]

# ---------------------------------------------------------------- Spark side


def _docs(spark, sf):
    return FX.table(spark, sf, "documents").select("doc_id", "text")


def _bench_questions(spark, sf):
    return FX.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(spark, sf, budget=K.DEFAULT_CHUNK_BUDGET):
    return C.chunk_merchants(latest_of(spark, sf), budget)


@register("merchant_chunks", with_ctes("SELECT * FROM chunks", "chunks"), ids=("R1", "R2", "P1", "P6"))
def q_merchant_chunks(spark, sf):
    return _chunks(spark, sf)


@register("document_text", with_ctes(f"""
SELECT merchant_id, 'Merchant: ' || {_s('merchant_name')} || ' | ID: ' || {_s('merchant_id')} || ' | Location: '
   || {_s(_NB)} || ', ' || {_s('city')} || ', ' || {_s('state')} || ' | Categories: ' || array_to_string({_CATS}, ', ')
   || ' | MCC: ' || {_s('mcc_code')} || ' (' || {_s('mcc_description')} || ') | Stars: ' || {_s('stars')}
   || ' | Reviews: ' || {_s('review_count')} || ' | Velocity (30d): ' || {_s('review_velocity_30d')}
   || ' | Amount: $' || {dt('transaction_amount', 2)} || ' | Acceptance: ' || {_s('acceptance_method')}
   || ' | Price tier: ' || repeat('$', coalesce(nullif(price_range, 0), 2))
   || ' | Open: ' || CASE WHEN is_open THEN 'yes' ELSE 'no' END AS document_text
FROM latest""", "latest"), ids=("P13",))
def q_document_text(spark, sf):
    lat = latest_of(spark, sf)
    return lat.select("merchant_id", C.document_text(lat).alias("document_text"))


@register("tokens", with_ctes(f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{K.TOKEN_PATTERN}') AS t FROM documents)"""), ids=("R3",))
def q_tokens(spark, sf):
    from merchlens.functions.text import tokens
    t = _docs(spark, sf).select("doc_id", tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                    F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@register("tfidf_tf", with_ctes("SELECT doc_id, token, tf_count, tf FROM d_post", local=_DOC_IDX[:1]), ids=("R4",))
def q_tfidf_tf(spark, sf):
    return R.postings(_docs(spark, sf)).select("doc_id", "token", "tf_count", "tf")


@register("tfidf_idf", with_ctes(f"SELECT token, df, {dr('idf', 8)} AS idf FROM d_idf", local=_DOC_IDX[:2]),
          ids=("R5",))
def q_tfidf_idf(spark, sf):
    docs = _docs(spark, sf)
    return R.idf_table(R.postings(docs), docs).select("token", "df", dround("idf", 8).alias("idf"))


@register("tfidf_weights", with_ctes(f"SELECT doc_id, token, {dr('weight', 8)} AS weight FROM d_w", local=_DOC_IDX),
          ids=("R6",))
def q_tfidf_weights(spark, sf):
    idx = R.tfidf_fit(_docs(spark, sf))
    return idx.weights.select("doc_id", "token", dround("weight", 8).alias("weight"))


@register("tfidf_scores", with_ctes(f"SELECT query_id, doc_id, {dr('score', 8)} AS score FROM d_sc",
                                    local=_DOC_IDX + _DOC_Q), ids=("R7", "R8", "J4"))
def q_tfidf_scores(spark, sf):
    idx = R.tfidf_fit(_docs(spark, sf))
    return R.scores(idx, _bench_questions(spark, sf)).select("query_id", "doc_id", dround("score", 8).alias("score"))


_DOC_TOPK = f"""
SELECT query_id, rank, doc_id, {dr('score', 4)} AS score FROM (
  SELECT q.query_id, d.doc_id, coalesce(s.score, 0.0) AS score,
         row_number() OVER (PARTITION BY q.query_id ORDER BY {dr('coalesce(s.score, 0.0)', 8)} DESC, d.doc_id DESC)
           AS rank
  FROM bq q CROSS JOIN documents d LEFT JOIN d_sc s ON s.query_id = q.query_id AND s.doc_id = d.doc_id)
WHERE rank <= 5"""


@register("tfidf_documents", with_ctes(_DOC_TOPK, local=_DOC_IDX + _DOC_Q), ids=("R9", "W7", "L13"))
def q_tfidf_documents(spark, sf):
    docs = _docs(spark, sf)
    idx = R.tfidf_fit(docs)
    return R.search_documents(idx, docs, _bench_questions(spark, sf), k=5)


@register("tfidf_documents_bounded", with_ctes(_DOC_TOPK, local=_DOC_IDX + _DOC_Q), ids=("R8", "R9", "J4", "W7"))
def q_tfidf_documents_bounded(spark, sf):
    docs = _docs(spark, sf)
    return R.search_documents(R.tfidf_fit(docs), docs, _bench_questions(spark, sf), k=5, bounded=True)


# merchant search over chunks, with filters inferred from the question text
def _rule_sql(q: str, explicit: str, rules) -> str:
    parts = [f"WHEN nullif({explicit}, '') IS NOT NULL THEN nullif({explicit}, '')"]
    for words, value in rules:
        cond = " OR ".join(f"contains({q}, '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{value}'")
    return "CASE " + " ".join(parts) + " END"


cte("qf", ["questions"], f"""
SELECT query_id, query, city_filter, mcc_filter, value_tier,
       {_rule_sql('lower(query)', 'city_filter', K.CITY_RULES)} AS f_city,
       {_rule_sql('lower(query)', 'mcc_filter', K.MCC_RULES)} AS f_mcc_code,
       {_rule_sql('lower(query)', 'value_tier', K.TIER_RULES)} AS f_value_tier,
       length(query) BETWEEN 3 AND 500 AND 5 BETWEEN 1 AND 20 AS is_valid
FROM questions""")

_CH_IDX = _index_ctes("c", "chunks", "doc_id", "text")
_CH_Q = _query_ctes("c", "qf", "query_id", "query") + [_scores_cte("c", "query_id", "doc_id")]


MS_LOCAL = _CH_IDX + _CH_Q


def merchant_search_body(static: str = "TRUE") -> str:
    return f"""
SELECT r.query_id, r.rank, r.merchant_id, l.merchant_name, l.city, l.mcc_code, l.stars, l.transaction_amount,
       l.acceptance_method, {dr('r.score', 4)} AS score, r.doc_id, substr(r.text, 1, 300) AS chunk_text,
       substr(r.text, 1, 150) AS chunk_preview
FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {dr('score', 8)} DESC, doc_id DESC) AS rank
  FROM (
    SELECT q.query_id, c.doc_id, c.merchant_id, c.text, coalesce(s.score, 0.0) AS score,
           row_number() OVER (PARTITION BY q.query_id, c.merchant_id
                              ORDER BY {dr('coalesce(s.score, 0.0)', 8)} DESC, c.doc_id DESC) AS b
    FROM qf q JOIN chunks c
      ON (q.f_city IS NULL OR lower(c.city) = lower(q.f_city))
     AND (q.f_mcc_code IS NULL OR c.mcc_code = q.f_mcc_code)
     AND (q.f_value_tier IS NULL OR c.transaction_value_tier = q.f_value_tier)
    LEFT JOIN c_sc s ON s.query_id = q.query_id AND s.doc_id = c.doc_id
    WHERE {static})
  WHERE b = 1) r
JOIN latest l ON l.merchant_id = r.merchant_id
WHERE r.rank <= 5"""


def _merchant_search_sql(static: str = "TRUE") -> str:
    return with_ctes(merchant_search_body(static), "chunks", "qf", local=MS_LOCAL)


def merchant_search(spark, sf, static=None, lat=None):
    lat = latest_of(spark, sf) if lat is None else lat
    ch = C.chunk_merchants(lat)
    ensure_checkpoint_dir(spark)
    idx = R.tfidf_fit(ch)
    qs = infer_filters(FX.questions(spark))
    return R.search_merchants(idx, ch, qs, lat, k=5, static_filter=static)


@register("tfidf_search", _merchant_search_sql(), ids=("R9", "F6", "W6", "W7", "J2", "P15"))
def q_tfidf_search(spark, sf):
    return merchant_search(spark, sf)


@register("tfidf_search_filtered",
          _merchant_search_sql("coalesce(c.stars, 0) >= 4.0 AND contains(lower(coalesce(c.neighborhood, '')), 'zone')"),
          ids=("F3", "R9"))
def q_tfidf_search_filtered(spark, sf):
    return merchant_search(spark, sf, static=merchant_filter(min_stars=4.0, neighborhood="zone"))


# Questions as users asked them: benchmark items and the user turns of conversations.
_ASKED = """SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, text AS query, CAST(NULL AS VARCHAR) AS city_filter,
       CAST(NULL AS VARCHAR) AS mcc_filter, CAST(NULL AS VARCHAR) AS value_tier FROM benchmark
UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text, NULL, NULL, NULL
FROM conversations WHERE role = 'user'"""


@register("infer_filters", with_ctes(f"""
SELECT query_id, query, {_rule_sql('lower(query)', 'city_filter', K.CITY_RULES)} AS f_city,
       {_rule_sql('lower(query)', 'mcc_filter', K.MCC_RULES)} AS f_mcc_code,
       {_rule_sql('lower(query)', 'value_tier', K.TIER_RULES)} AS f_value_tier,
       length(query) BETWEEN 3 AND 500 AND 5 BETWEEN 1 AND 20 AS is_valid
FROM asked""", local=[("asked", _ASKED)]), ids=("F6", "F8", "L15"))
def q_infer_filters(spark, sf):
    bench = FX.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), F.col("text").alias("query"))
    turns = FX.table(spark, sf, "conversations").where("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return infer_filters(bench.unionByName(turns)).select("query_id", "query", "f_city", "f_mcc_code", "f_value_tier", "is_valid")


@register("mart_documents", with_ctes(f"""
SELECT md5(merchant_id || '_mart') AS doc_id, merchant_id,
  'Merchant: ' || {_s('merchant_name')} || ' | ID: ' || {_s('merchant_id')} || ' | Location: ' || {_s('neighborhood')}
  || ', ' || {_s('city')} || ', ' || {_s('state')} || ' | Categories: ' || {_s('categories')}
  || ' | MCC: ' || {_s('mcc_code')} || ' (' || {_s('mcc_description')} || ') | Transactions: '
  || {_s('total_transactions')} || ' | Avg amount: $' || {dt('avg_transaction_amount', 2)}
  || ' | Total volume: $' || {dt('total_transaction_volume', 2)} || ' | Avg stars: '
  || coalesce({dt('avg_stars', 2)}, 'None') || ' | Reviews: ' || {_s('review_count')}
  || ' | Price tier: ' || {_s('price_symbol')} || ' | Open: ' || CASE WHEN is_open THEN 'yes' ELSE 'no' END
  || ' | High-volume anomaly: ' || CASE WHEN is_high_volume_anomaly THEN 'yes' ELSE 'no' END
  || ' | Q4 spike: ' || CASE WHEN is_q4_spending_spike THEN 'yes' ELSE 'no' END AS text
FROM mart""", "mart"), ids=("R17",))
def q_mart_documents(spark, sf):
    return C.mart_documents(M.mart(stg_of(spark, sf)))


# ---------------------------------------------------------------- dense

_VEC_LOCAL = [
    ("e", """SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i
FROM embeddings"""),
    ("cen", "SELECT CAST(label AS BIGINT) AS query_id, i, avg(x) AS cx FROM e GROUP BY label, i"),
    ("qn", "SELECT query_id, sqrt(sum(cx * cx)) AS n FROM cen GROUP BY query_id"),
    ("vn", "SELECT vec_id, label, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id, label"),
    ("dots", """SELECT c.query_id, e.vec_id, sum(c.cx * e.x) AS d FROM cen c JOIN e ON c.i = e.i
GROUP BY c.query_id, e.vec_id"""),
    ("cos", """SELECT d.query_id, d.vec_id, vn.label, d.d / (coalesce(nullif(qn.n, 0), 1) * coalesce(nullif(vn.n, 0), 1))
       AS score FROM dots d JOIN qn USING (query_id) JOIN vn USING (vec_id)"""),
]


def _dense_sql(where: str = "TRUE") -> str:
    return f"""
SELECT query_id, vec_id, {dr('score', 4)} AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {dr('score', 8)} DESC, vec_id) AS rank
  FROM cos WHERE {where})
WHERE rank <= 5"""


def _vectors(spark, sf):
    return FX.table(spark, sf, "embeddings")


def _dense(spark, sf, filtered=False):
    v = _vectors(spark, sf)
    q = D.label_centroids(v)
    out = D.dense_topk(v, q, k=5, filter_col="label" if filtered else None)
    return out.select("query_id", "vec_id", dround("score", 4).alias("score"), F.col("rank").cast("long"))


@register("dense_topk", with_ctes(_dense_sql(), local=_VEC_LOCAL), ids=("J5", "R10", "W7", "W9"))
def q_dense_topk(spark, sf):
    return _dense(spark, sf)


@register("dense_topk_filtered", with_ctes(_dense_sql("label = query_id"), local=_VEC_LOCAL), ids=("F4", "R10"))
def q_dense_topk_filtered(spark, sf):
    return _dense(spark, sf, filtered=True)


@register("precision_recall_at_k", with_ctes(f"""
SELECT t.query_id, count(CASE WHEN t.label = t.query_id THEN 1 END) AS hits, r.n_relevant,
       {dr('count(CASE WHEN t.label = t.query_id THEN 1 END) / 5.0', 4)} AS precision_at_k,
       CASE WHEN r.n_relevant = 0 THEN 0.0
            ELSE {dr('CAST(count(CASE WHEN t.label = t.query_id THEN 1 END) AS DOUBLE) / r.n_relevant', 4)} END
         AS recall_at_k
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {dr('score', 8)} DESC, vec_id)
                            AS rank FROM cos) WHERE rank <= 5) t
JOIN (SELECT CAST(label AS BIGINT) AS query_id, count(*) AS n_relevant FROM embeddings GROUP BY label) r
  USING (query_id)
GROUP BY t.query_id, r.n_relevant""", local=_VEC_LOCAL), ids=("E4", "E5", "J6"))
def q_precision_recall(spark, sf):
    v = _vectors(spark, sf)
    top = D.dense_topk(v, D.label_centroids(v), k=5)
    relevant = v.select(F.col("label").cast("long").alias("query_id"), "vec_id")
    return D.precision_recall_at_k(top, relevant, k=5)


def _embed_sql(src: str, key: str) -> list[tuple[str, str]]:
    """Signed feature hashing: slot and sign from the first 32 bits of a token's md5, L2-normalised."""
    return [
        ("emt", f"SELECT {key} AS k, unnest({toks('text')}) AS token FROM {src}"),
        ("emh", "SELECT k, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h FROM emt"),
        ("ems", "SELECT k, h % 64 AS i, sum(CASE WHEN h < 2147483648 THEN 1.0 ELSE -1.0 END) AS x FROM emh GROUP BY k, h % 64"),
        ("emb", """SELECT k, i, CAST(CAST(x / coalesce(nullif(sqrt(sum(x * x) OVER (PARTITION BY k)), 0), 1) AS FLOAT) AS DOUBLE) AS x
FROM ems"""),
    ]


@register("embed_batch", with_ctes(f"""
SELECT d.doc_id, 64 AS dims, {dr('coalesce(sqrt(e.n), 0)', 4)} AS norm, {dr('coalesce(e.s, 0)', 3)} AS weighted_sum
FROM documents d LEFT JOIN (SELECT k, sum(x * x) AS n, sum(x * (i + 1)) AS s FROM emb GROUP BY k) e ON e.k = d.doc_id""",
    local=_embed_sql("documents", "doc_id")), ids=("R12", "UF1"))
def q_embed_batch(spark, sf):
    docs = _docs(spark, sf)
    out = D.embed(docs, "text", lambda: D.hashing_embedder(64), model_key="hashing-64")
    x = F.col("embedding").cast("array<double>")
    weighted = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0).cast("double"), lambda a, v: a + v)
    return out.select("doc_id", F.size("embedding").alias("dims"),
                      dround(F.sqrt(F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v * v)), 4).alias("norm"),
                      dround(weighted, 3).alias("weighted_sum"))


@register("dense_merchants", with_ctes(f"""
SELECT r.query_id, r.rank, l.merchant_id, l.merchant_name, l.city, l.mcc_code, l.stars, r.doc_id, {dr('r.score', 4)} AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {dr('score', 8)} DESC, doc_id) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, merchant_id ORDER BY {dr('score', 8)} DESC, doc_id) AS b
            FROM (SELECT q.query_id, c.doc_id, c.merchant_id, coalesce(s.score, 0.0) AS score
                  FROM questions q JOIN chunks c ON lower(c.city) IN ('nation_7', 'nation_3', 'nation_11')
                    AND c.mcc_code <> '0742' AND c.transaction_value_tier IN ('low', 'mid', 'high')
                  LEFT JOIN dms s ON s.query_id = q.query_id AND s.doc_id = c.doc_id))
      WHERE b = 1) r
JOIN latest l ON l.merchant_id = r.merchant_id WHERE r.rank <= 5""", "chunks", "latest", "questions", local=[
    ("dmt", "SELECT doc_id AS key, text FROM chunks UNION ALL SELECT 'q' || CAST(query_id AS VARCHAR), query FROM questions"),
    *_embed_sql("dmt", "key"),
    ("dmn", "SELECT k, sqrt(sum(x * x)) AS n FROM emb GROUP BY k"),
    ("dms", """SELECT CAST(substr(a.k, 2) AS INTEGER) AS query_id, b.k AS doc_id, sum(a.x * b.x) / any_value(an.n * bn.n) AS score
FROM emb a JOIN emb b ON a.i = b.i JOIN dmn an ON an.k = a.k JOIN dmn bn ON bn.k = b.k
WHERE a.k LIKE 'q%' AND b.k NOT LIKE 'q%' GROUP BY a.k, b.k""")]), ids=("F4", "W9", "R10"))
def q_dense_merchants(spark, sf):
    """Dense merchant search under city, MCC and tier filters: one hit per merchant, joined to its record."""
    lat = latest_of(spark, sf)
    vec = D.embed(C.chunk_merchants(lat), "text", lambda: D.hashing_embedder(64), model_key="hashing-64")
    qs = D.embed(FX.questions(spark), "query", lambda: D.hashing_embedder(64), out_col="qvec", model_key="hashing-64")
    keep = (F.lower("city").isin("nation_7", "nation_3", "nation_11") & (F.col("mcc_code") != "0742")
            & F.col("transaction_value_tier").isin("low", "mid", "high"))
    return D.dense_merchants(vec, qs.select("query_id", "qvec"), lat, k=5, static_filter=keep)


@register("chunk_budget_compare", ids=("R16",))
def q_chunk_budget_compare(spark, sf):
    """For each chunk budget, chunk -> index -> unfiltered search -> precision /
    recall at 5, where a merchant is relevant to a question when its MCC is the
    one the question's keywords name."""
    lat = latest_of(spark, sf)
    qs = infer_filters(FX.questions(spark))
    relevant = (qs.where(F.col("f_mcc_code").isNotNull())
                .join(lat.select("merchant_id", F.col("mcc_code").alias("f_mcc_code")), "f_mcc_code")
                .select("query_id", "merchant_id"))
    plain = qs.withColumns({c: F.lit(None).cast("string") for c in ("f_city", "f_mcc_code", "f_value_tier")})
    out = None
    for budget in K.CHUNK_BUDGETS:
        ch = C.chunk_merchants(lat, budget)
        hits = R.search_merchants(R.tfidf_fit(ch), ch, plain, lat, k=5)
        pr = D.precision_recall_at_k(hits, relevant, k=5, id_col="merchant_id").where("n_relevant > 0")
        row = (pr.agg(dround(F.avg("precision_at_k"), 4).alias("mean_precision_at_k"),
                      dround(F.avg("recall_at_k"), 4).alias("mean_recall_at_k"),
                      F.count(F.lit(1)).alias("n_questions"))
               .select(F.lit(budget).alias("budget"), "*"))
        size = ch.select(F.struct(F.count(F.lit(1)).alias("n_chunks"),
                                  dround(F.avg(F.length("text")), 2).alias("avg_chunk_chars")).alias("s")).scalar()
        row = row.withColumn("_s", size).select("*", "_s.n_chunks", "_s.avg_chunk_chars").drop("_s")
        out = row if out is None else out.unionByName(row)
    return out
