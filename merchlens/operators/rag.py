"""Answer-side text and run records.

Every question's hits are at most k rows, so per-question text is assembled
from a bounded, rank-sorted array (``sort_array`` before ``array_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import dec_text, dround
from merchlens.functions.text import price_symbol, split_categories


def _nz(c: str, none: str):
    v = F.col(c)
    return F.when(v.isNull() | (v == 0), F.lit(none)).otherwise(v.cast("string"))


def _hits_with_merchant(hits: DataFrame, merchants: DataFrame) -> DataFrame:
    m = merchants.select("merchant_id", F.col("neighborhood").alias("_nb"), F.col("state").alias("_state"),
                         F.col("categories").alias("_cats"), F.col("mcc_description").alias("_desc"),
                         F.col("price_range").alias("_pr"), F.col("review_count").alias("_rc"),
                         F.col("review_velocity_30d").alias("_vel"))
    return hits.join(m, "merchant_id")


def context_text(hits: DataFrame, merchants: DataFrame, questions: DataFrame, qid: str = "query_id") -> DataFrame:
    """Numbered context block per question ("" when nothing was retrieved)."""
    h = _hits_with_merchant(hits, merchants)
    loc = F.coalesce(F.nullif(F.col("_nb"), F.lit("")), F.col("city"))
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("merchant_name"), F.lit(" (ID: "),
        F.col("merchant_id"), F.lit(")\n    Location: "), loc, F.lit(", "), F.col("city"), F.lit(", "),
        F.col("_state"), F.lit("\n    Categories: "), F.array_join(split_categories("_cats"), ", "),
        F.lit("\n    MCC: "), F.col("mcc_code"), F.lit(" — "), F.col("_desc"),
        F.lit("\n    Transaction: $"), dec_text("transaction_amount", 2), F.lit(" | Acceptance: "),
        F.col("acceptance_method"), F.lit(" | Price: "), price_symbol(F.nullif(F.col("_pr"), F.lit(0))),
        F.lit("\n    Rating: ⭐ "), _nz("stars", "N/A"), F.lit(" | Reviews: "), _nz("_rc", "0"),
        F.lit(" total, "), _nz("_vel", "0"), F.lit("/30d\n    Similarity score: "), dec_text("score", 3))
    per_q = h.groupBy(qid).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))
    return questions.select(qid).join(per_q, qid, "left").select(qid, F.coalesce("context", F.lit("")).alias("context"))


def retrieval_answer(hits: DataFrame, merchants: DataFrame, questions: DataFrame, qid: str = "query_id") -> DataFrame:
    """The answer used when no language model is configured."""
    h = _hits_with_merchant(hits, merchants)
    loc = F.coalesce(F.nullif(F.col("_nb"), F.lit("")), F.col("city"))
    line = F.concat(
        F.lit("• **"), F.col("merchant_name"), F.lit("** — "), loc, F.lit(", "), F.col("city"),
        F.lit(" | ⭐ "), _nz("stars", "N/A"), F.lit(" | "),
        F.array_join(F.slice(split_categories("_cats"), 1, 2), ", "),
        F.lit(" | Avg txn $"), dec_text("transaction_amount", 2), F.lit(" | Match score: "), dec_text("score", 3))
    per_q = h.groupBy(qid).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))),
                                 lambda s: s["l"]), "\n").alias("_lines"))
    text = F.when(F.col("_n").isNull(), F.lit(K.NO_MATCH_ANSWER)).otherwise(
        F.concat(F.lit("Top "), F.col("_n").cast("string"), F.lit(" merchants matching your query:\n\n"),
                 F.col("_lines")))
    return questions.select(qid).join(per_q, qid, "left").select(qid, text.alias("answer"),
                                                                  F.coalesce("_n", F.lit(0)).alias("num_sources"))


def prompt_text(questions: DataFrame, context: DataFrame, history: DataFrame | None = None,
                qid: str = "query_id", text_col: str = "query") -> DataFrame:
    """The model prompt for each question (history, context, question)."""
    pre, rest = K.RAG_PROMPT.split("{history}")
    mid, rest = rest.split("{context}")
    mid2, post = rest.split("{query}")
    q = questions.select(qid, text_col).join(context, qid, "left")
    if history is not None:
        q = q.join(history, qid, "left")
        hist = F.coalesce(F.nullif(F.col("history"), F.lit("")), F.lit(K.NO_HISTORY))
    else:
        hist = F.lit(K.NO_HISTORY)
    return q.select(qid, F.concat(F.lit(pre), hist, F.lit(mid), F.coalesce("context", F.lit("")), F.lit(mid2),
                                  F.col(text_col), F.lit(post)).alias("prompt"))


def trace_rows(questions: DataFrame, answers: DataFrame, hits: DataFrame, qid: str = "query_id") -> DataFrame:
    """One trace row per answered question (preview 200 chars, sources, top score).

    ``latency_ms`` and ``tokens_used`` are what the answering run measured: columns of
    ``questions`` where it has them, else 0."""
    top = hits.where(F.col("rank") == 1).select(qid, F.col("score").alias("_top"))
    def given(name: str, dtype: str) -> Column:
        return F.coalesce(F.col(name).cast(dtype) if name in questions.columns else F.lit(None).cast(dtype), F.lit(0).cast(dtype))

    measured = (given("latency_ms", "double").alias("latency_ms"), given("tokens_used", "long").alias("tokens_used"))
    return (questions.select(qid, "query", *measured).join(answers, qid).join(top, qid, "left")
            .select(F.md5(F.concat(F.lit("run_"), F.col(qid).cast("string"))).alias("run_id"), qid, "query",
                    F.substring("answer", 1, K.TRACE_PREVIEW_CHARS).alias("answer_preview"),
                    F.col("num_sources").cast("long").alias("num_sources"),
                    F.coalesce("_top", F.lit(0.0)).alias("top_score"),
                    "latency_ms", "tokens_used"))


def recent(traces: DataFrame, n: int = 10, order: str = "query_id") -> DataFrame:
    """T5: the last n traces (a bounded top-n)."""
    return traces.orderBy(F.col(order).desc()).limit(n)


def eval_rows(traces: DataFrame, answers: DataFrame, hits: DataFrame, chunks: DataFrame, qid: str = "query_id") -> DataFrame:
    """Evaluation row per run with results; contexts are the whole texts of the hits' chunks
    (a hit itself carries a preview only)."""
    from merchlens.operators.conversation import heuristic_eval
    runs = (traces.where(F.col("num_sources") > 0).select("run_id", qid, "query", "latency_ms")
            .join(answers.select(qid, "answer"), qid))
    ctx = (hits.select(qid, "rank", "doc_id").join(runs.select("run_id", qid), qid)
           .join(chunks.select("doc_id", "text"), "doc_id").select("run_id", F.col("rank").alias("ctx_id"), "text"))
    scores = heuristic_eval(runs.select("run_id", "query", "answer"), ctx)
    return runs.select("run_id", "query", "latency_ms").join(scores, "run_id").select(
        "run_id", "query", F.col("precision_at_k"), F.col("context_recall").alias("recall_at_k"),
        F.col("faithfulness").alias("answer_faithfulness"), F.col("answer_relevancy").alias("context_relevance"),
        "latency_ms")


def eval_summary(rows: DataFrame) -> DataFrame:
    """Run count and mean scores (missing values count as 0)."""
    def m(c):
        return dround(F.avg(F.coalesce(F.col(c), F.lit(0.0))), 4)
    return rows.agg(F.count(F.lit(1)).alias("total_runs"), m("precision_at_k").alias("avg_precision_at_k"),
                    m("answer_faithfulness").alias("avg_faithfulness"),
                    m("context_relevance").alias("avg_context_relevance"), m("latency_ms").alias("avg_latency_ms"))


def feedback_by_run(feedback: DataFrame, run: str = "run_id") -> DataFrame:
    """Feedback rows (run, score in [0, 1]) averaged per run."""
    return feedback.groupBy(run).agg(F.count(F.lit(1)).alias("n_feedback"),
                                     dround(F.avg(F.col("score").cast("double")), 4).alias("avg_score"))
