"""Registered queries: answer text, traces, evaluation, feedback and conversation memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.operators import chunks as C
from merchlens.operators import conversation as V
from merchlens.operators import rag as G
from merchlens.operators import retrieval as R
from merchlens.plans.catalog import register
from merchlens.plans.q_models import latest_of
from merchlens.plans.q_retrieval import (MS_LOCAL, _DOC_IDX, _DOC_Q, _DOC_TOPK, _bench_questions, _docs,
                                         merchant_search, merchant_search_body)
from merchlens.plans.sqltext import dr, dt, toks, with_ctes
from merchlens.session import ensure_checkpoint_dir
from merchlens.sources import fixtures as FX

NL = " || chr(10) || "


def sql_text(s: str) -> str:
    """A Python string (with newlines) as a SQL expression."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return NL.join(parts)


def _cats(col: str) -> str:
    return f"list_filter(list_transform(string_split({col}, ','), lambda s: trim(s)), lambda s: s <> '')"


def _nz(col: str, none: str) -> str:
    return f"CASE WHEN {col} IS NULL OR {col} = 0 THEN '{none}' ELSE CAST({col} AS VARCHAR) END"


_HH = ("hh", """SELECT h.*, l.neighborhood AS _nb, l.state AS _state, l.categories AS _cats,
       l.mcc_description AS _desc, l.price_range AS _pr, l.review_count AS _rc, l.review_velocity_30d AS _vel
FROM hits h JOIN latest l USING (merchant_id)""")
_LOC = "coalesce(nullif(_nb, ''), city)"
_BLOCK = (f"'[' || CAST(rank AS VARCHAR) || '] ' || merchant_name || ' (ID: ' || merchant_id || ')'{NL}"
          f"'    Location: ' || {_LOC} || ', ' || city || ', ' || _state{NL}"
          f"'    Categories: ' || array_to_string({_cats('_cats')}, ', '){NL}"
          f"'    MCC: ' || mcc_code || ' — ' || _desc{NL}"
          f"'    Transaction: $' || {dt('transaction_amount', 2)} || ' | Acceptance: ' || acceptance_method"
          f" || ' | Price: ' || repeat('$', coalesce(nullif(_pr, 0), 2)){NL}"
          f"'    Rating: ⭐ ' || {_nz('stars', 'N/A')} || ' | Reviews: ' || {_nz('_rc', '0')} || ' total, '"
          f" || {_nz('_vel', '0')} || '/30d'{NL}"
          f"'    Similarity score: ' || {dt('score', 3)}")
_LINE = (f"'• **' || merchant_name || '** — ' || {_LOC} || ', ' || city || ' | ⭐ ' || {_nz('stars', 'N/A')}"
         f" || ' | ' || array_to_string(({_cats('_cats')})[1:2], ', ') || ' | Avg txn $' || "
         f"{dt('transaction_amount', 2)} || ' | Match score: ' || {dt('score', 3)}")

_CTX = ("ctx_text", f"""SELECT q.query_id, coalesce(c.context, '') AS context FROM questions q LEFT JOIN (
  SELECT query_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) AS context FROM hh GROUP BY query_id) c
  USING (query_id)""")
_ANS = ("ans", f"""SELECT q.query_id,
  CASE WHEN a.n IS NULL THEN {sql_text(K.NO_MATCH_ANSWER)}
       ELSE 'Top ' || CAST(a.n AS VARCHAR) || ' merchants matching your query:' || chr(10) || chr(10) || a.lines END
    AS answer, coalesce(a.n, 0) AS num_sources
FROM questions q LEFT JOIN (
  SELECT query_id, count(*) AS n, string_agg({_LINE}, chr(10) ORDER BY rank) AS lines FROM hh GROUP BY query_id) a
  USING (query_id)""")
_TRACES = ("traces", """SELECT md5('run_' || CAST(q.query_id AS VARCHAR)) AS run_id, q.query_id, q.query,
       substr(a.answer, 1, 200) AS answer_preview, CAST(a.num_sources AS BIGINT) AS num_sources,
       coalesce(t.score, 0.0) AS top_score, 0.0 AS latency_ms, CAST(0 AS BIGINT) AS tokens_used
FROM questions q JOIN ans a USING (query_id) LEFT JOIN (SELECT query_id, score FROM hits WHERE rank = 1) t
  USING (query_id)""")
_HIT_LOCAL = MS_LOCAL + [("hits", merchant_search_body()), _HH, _CTX, _ANS, _TRACES]
_NEED = ("chunks", "qf", "latest", "questions")


def _hits(spark, sf):
    """Search hits, checkpointed: every answer-side query reuses them several times."""
    ensure_checkpoint_dir(spark)
    lat = latest_of(spark, sf)
    return merchant_search(spark, sf, lat=lat).checkpoint(), lat, FX.questions(spark)


@register("rag_context", with_ctes("SELECT * FROM ctx_text", *_NEED, local=_HIT_LOCAL), ids=("R13",))
def q_rag_context(spark, sf):
    hits, lat, qs = _hits(spark, sf)
    return G.context_text(hits, lat, qs)


@register("retrieval_answer", with_ctes("SELECT * FROM ans", *_NEED, local=_HIT_LOCAL), ids=("R14",))
def q_retrieval_answer(spark, sf):
    hits, lat, qs = _hits(spark, sf)
    return G.retrieval_answer(hits, lat, qs)


_pre, _rest = K.RAG_PROMPT.split("{history}")
_mid, _rest = _rest.split("{context}")
_mid2, _post = _rest.split("{query}")


@register("rag_prompt", with_ctes(f"""
SELECT q.query_id, {sql_text(_pre)} || {sql_text(K.NO_HISTORY)} || {sql_text(_mid)} || c.context || {sql_text(_mid2)}
       || q.query || {sql_text(_post)} AS prompt
FROM questions q JOIN ctx_text c USING (query_id)""", *_NEED, local=_HIT_LOCAL), ids=("R15",))
def q_rag_prompt(spark, sf):
    hits, lat, qs = _hits(spark, sf)
    return G.prompt_text(qs, G.context_text(hits, lat, qs))


def _traces(spark, sf):
    hits, lat, qs = _hits(spark, sf)
    ans = G.retrieval_answer(hits, lat, qs)
    return G.trace_rows(qs, ans, hits), ans, hits, lat


@register("query_trace_rows", with_ctes("SELECT * FROM traces", *_NEED, local=_HIT_LOCAL), ids=("S10",))
def q_trace_rows(spark, sf):
    return _traces(spark, sf)[0]


@register("recent_traces", with_ctes("SELECT * FROM traces ORDER BY query_id DESC LIMIT 10", *_NEED,
                                     local=_HIT_LOCAL), ids=("T5",))
def q_recent_traces(spark, sf):
    return G.recent(_traces(spark, sf)[0], 10)


_EVAL_LOCAL = _HIT_LOCAL + [
    ("runs", """SELECT t.run_id, t.query_id, t.query, a.answer FROM traces t JOIN ans a USING (query_id)
WHERE t.num_sources > 0"""),
    ("ectx", f"""SELECT r.run_id, h.rank AS ctx_id, list_distinct({toks('c.text')}) AS c
FROM hits h JOIN runs r USING (query_id) JOIN chunks c ON c.doc_id = h.doc_id"""),
    ("erq", f"""SELECT run_id, query, list_distinct({toks('query')}) AS q, list_distinct({toks('answer')}) AS a
FROM runs"""),
    ("ej", """SELECT erq.run_id, any_value(erq.query) AS query, any_value(q) AS q, any_value(a) AS a,
       count(ectx.ctx_id) AS n_ctx, count(CASE WHEN len(list_intersect(q, c)) > 1 THEN 1 END) AS n_rel,
       coalesce(sum(len(list_intersect(q, c))), 0) AS sum_ov,
       list_distinct(flatten(list(c) FILTER (WHERE c IS NOT NULL))) AS allc
FROM erq LEFT JOIN ectx USING (run_id) GROUP BY erq.run_id"""),
    ("evals", f"""SELECT run_id, query,
       {dr('CASE WHEN n_ctx > 0 THEN n_rel / n_ctx ELSE 0.0 END', 3)} AS precision_at_k, 0.0 AS recall_at_k,
       {dr('least(CASE WHEN len(a) > 0 THEN len(list_intersect(a, allc)) / len(a) ELSE 0.0 END * 1.2, 1.0)', 3)}
         AS answer_faithfulness,
       {dr('least(CASE WHEN n_ctx > 0 THEN sum_ov / greatest(len(q), 1) / n_ctx ELSE 0.0 END * 1.1, 1.0)', 3)}
         AS context_relevance,
       0.0 AS latency_ms
FROM ej"""),
]


def _evals(spark, sf):
    traces, ans, hits, lat = _traces(spark, sf)
    return G.eval_rows(traces, ans, hits, C.chunk_merchants(lat))


@register("eval_rows", with_ctes("SELECT * FROM evals", *_NEED, local=_EVAL_LOCAL), ids=("E6", "E1", "E2", "E3"))
def q_eval_rows(spark, sf):
    return _evals(spark, sf)


@register("eval_store_roundtrip", with_ctes("SELECT * FROM evals", *_NEED, local=_EVAL_LOCAL), ids=("S11",))
def q_eval_store_roundtrip(spark, sf):
    from merchlens.session import scratch_dir
    from merchlens.sources import files as S
    rows = q_eval_rows(spark, sf)
    path = scratch_dir(spark, "eval-store")
    S.append_json(rows, path)
    # an unreadable line in the store is dropped on load, the rest still loads
    spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(path)
    return S.read_json_records(spark, path, rows.schema)


@register("eval_summary", with_ctes(f"""
SELECT count(*) AS total_runs, {dr('avg(coalesce(precision_at_k, 0.0))', 4)} AS avg_precision_at_k,
       {dr('avg(coalesce(answer_faithfulness, 0.0))', 4)} AS avg_faithfulness,
       {dr('avg(coalesce(context_relevance, 0.0))', 4)} AS avg_context_relevance,
       {dr('avg(coalesce(latency_ms, 0.0))', 4)} AS avg_latency_ms
FROM evals""", *_NEED, local=_EVAL_LOCAL), ids=("A15",))
def q_eval_summary(spark, sf):
    return G.eval_summary(_evals(spark, sf))


@register("feedback_by_run", with_ctes(f"""
SELECT t.query_id AS run_id, count(*) AS n_feedback, {dr('avg(CAST(l.quality AS DOUBLE))', 4)} AS avg_score
FROM ({_DOC_TOPK}) t JOIN labels l ON l.doc_id = t.doc_id GROUP BY t.query_id""", local=_DOC_IDX + _DOC_Q),
          ids=("S15",))
def q_feedback_by_run(spark, sf):
    docs = _docs(spark, sf)
    top = R.search_documents(R.tfidf_fit(docs), docs, _bench_questions(spark, sf), k=5)
    labels = FX.table(spark, sf, "labels")
    fb = top.join(labels, "doc_id").select(F.col("query_id").alias("run_id"), F.col("quality").alias("score"))
    return G.feedback_by_run(fb)


# ---------------------------------------------------------------- conversation memory

def _pairs(spark, sf):
    return FX.turn_pairs(spark, sf)


@register("session_last_turns", with_ctes("""
SELECT session_id, turn_no, human, ai, CAST(count(*) OVER (PARTITION BY session_id) - back + 1 AS INTEGER) AS position
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS back
                     FROM turn_pairs) WHERE back <= 10)""", "turn_pairs"), ids=("M1", "W8"))
def q_session_last_turns(spark, sf):
    return V.last_turns(_pairs(spark, sf), K.MAX_TURNS)


@register("session_history_text", with_ctes("""
SELECT session_id, string_agg('Human: ' || human || chr(10) || 'Assistant: ' || substr(ai, 1, 300) || '...', chr(10)
                              ORDER BY turn_no) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS back FROM turn_pairs)
WHERE back <= 3 GROUP BY session_id""", "turn_pairs"), ids=("M2",))
def q_session_history_text(spark, sf):
    return V.history_text(_pairs(spark, sf), K.HISTORY_TURNS)


@register("session_turn_counts", with_ctes("""
SELECT session_id, CAST(least(count(*), 10) AS BIGINT) AS turns_stored, count(*) AS turns_total
FROM turn_pairs GROUP BY session_id""", "turn_pairs"), ids=("M3",))
def q_session_turn_counts(spark, sf):
    return V.turn_counts(_pairs(spark, sf))


@register("session_clear", with_ctes("""
SELECT session_id, turn_no FROM turn_pairs WHERE session_id NOT IN (SELECT min(session_id) FROM turn_pairs)""",
                                     "turn_pairs"), ids=("M4",))
def q_session_clear(spark, sf):
    pairs = _pairs(spark, sf)
    cleared = pairs.agg(F.min("session_id").alias("session_id"))
    return V.clear_sessions(pairs, cleared).select("session_id", "turn_no")


@register("active_sessions", with_ctes("SELECT count(DISTINCT session_id) AS active_sessions FROM turn_pairs",
                                       "turn_pairs"), ids=("A17",))
def q_active_sessions(spark, sf):
    return V.active_sessions(_pairs(spark, sf))


@register("rag_heuristic_eval", with_ctes(f"""
SELECT session_id, turn_no, n_ctx AS n_contexts,
       {dr('least(CASE WHEN len(a) > 0 THEN len(list_intersect(a, allc)) / len(a) ELSE 0.0 END * 1.2, 1.0)', 3)}
         AS faithfulness,
       {dr('least(CASE WHEN n_ctx > 0 THEN sum_ov / greatest(len(q), 1) / n_ctx ELSE 0.0 END * 1.1, 1.0)', 3)}
         AS answer_relevancy,
       {dr('CASE WHEN n_ctx > 0 THEN n_rel / n_ctx ELSE 0.0 END', 3)} AS context_precision,
       0.0 AS context_recall,
       {dr('CASE WHEN n_ctx > 0 THEN n_rel / n_ctx ELSE 0.0 END', 3)} AS precision_at_k
FROM (
  SELECT p.session_id, p.turn_no, any_value(p.q) AS q, any_value(p.a) AS a, count(c.turn) AS n_ctx,
         count(CASE WHEN len(list_intersect(p.q, c.ct)) > 1 THEN 1 END) AS n_rel,
         coalesce(sum(len(list_intersect(p.q, c.ct))), 0) AS sum_ov,
         list_distinct(flatten(list(c.ct) FILTER (WHERE c.ct IS NOT NULL))) AS allc
  FROM (SELECT session_id, turn_no, list_distinct({toks('human')}) AS q, list_distinct({toks('ai')}) AS a
        FROM turn_pairs) p
  LEFT JOIN (SELECT conv_id, turn, list_distinct({toks('text')}) AS ct FROM conversations) c
    ON c.conv_id = p.session_id AND c.turn < p.turn_no
  GROUP BY p.session_id, p.turn_no)""", "turn_pairs"), ids=("E1", "E2", "E3", "U1"))
def q_rag_heuristic_eval(spark, sf):
    return V.conversation_eval(FX.table(spark, sf, "conversations"), _pairs(spark, sf))
