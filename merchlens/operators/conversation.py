"""Conversation memory as tables (M1-M4, A17, W8) and heuristic answer scores.

A session's memory is the long-form table ``(session_id, turn_no, human, ai)``.
"Keep the last N turns" is ``row_number() <= N`` per session (partial
WindowGroupLimit, so a very long session is cut map-side); history text is built
from at most N structs per session, sorted before ``array_join``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import dround
from merchlens.functions.text import token_set


def last_turns(turns: DataFrame, n: int = K.MAX_TURNS, session: str = "session_id",
               order: str = "turn_no") -> DataFrame:
    """The last ``n`` turns of every session (position 1 = oldest kept)."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    kept = turns.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    cnt = kept.groupBy(session).agg(F.count(F.lit(1)).alias("_n"))
    return (kept.join(cnt, session).withColumn("position", (F.col("_n") - F.col("_back") + 1).cast("int"))
            .drop("_back", "_n"))


def history_text(turns: DataFrame, n: int = K.HISTORY_TURNS, session: str = "session_id",
                 order: str = "turn_no") -> DataFrame:
    """M2: "Human: ...\\nAssistant: <first 300 chars>..." for the last ``n`` turns, oldest first."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    kept = turns.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    line = F.concat(F.lit("Human: "), F.col("human"), F.lit("\nAssistant: "),
                    F.substring("ai", 1, K.HISTORY_ANSWER_CHARS), F.lit("..."))
    return kept.groupBy(session).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("l")))),
                                 lambda s: s["l"]), "\n").alias("history"))


def turn_counts(turns: DataFrame, max_turns: int = K.MAX_TURNS, session: str = "session_id") -> DataFrame:
    """M3: stored turns per session (capped at ``max_turns``) and all turns seen."""
    return turns.groupBy(session).agg(
        F.least(F.count(F.lit(1)), F.lit(max_turns)).cast("long").alias("turns_stored"),
        F.count(F.lit(1)).alias("turns_total"))


def clear_sessions(turns: DataFrame, cleared: DataFrame, session: str = "session_id") -> DataFrame:
    """M4: memory without the cleared sessions (anti join; the table is rewritten, not mutated)."""
    return turns.join(cleared.select(session), session, "left_anti")


def active_sessions(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """Number of sessions holding memory."""
    return turns.agg(F.count_distinct(session).alias("active_sessions"))


def _tokens_of(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(keys, token): each distinct token of a text, tokenised once (see ``retrieval.postings``)."""
    ex = df.select(*keys, F.explode_outer(token_set(text_col)).alias("token"))
    return ex.where("token is not null")


def _finish(df: DataFrame) -> DataFrame:
    """Shared E1-E3 formulas from per-run counts."""
    n_ctx = F.col("n_contexts")
    prec = F.when(n_ctx > 0, F.col("n_rel_ctx") / n_ctx).otherwise(F.lit(0.0))
    faith = F.when(F.col("n_a") > 0, F.col("a_hits") / F.col("n_a")).otherwise(F.lit(0.0))
    rel = F.when(n_ctx > 0, F.col("sum_overlap") / F.greatest(F.col("n_q"), F.lit(1)) / n_ctx).otherwise(F.lit(0.0))
    return df.withColumns({
        "faithfulness": dround(F.least(faith * 1.2, F.lit(1.0)), 3),
        "answer_relevancy": dround(F.least(rel * 1.1, F.lit(1.0)), 3),
        "context_precision": dround(prec, 3),
        "context_recall": F.lit(0.0),
        "precision_at_k": dround(prec, 3),
    })


def heuristic_eval(runs: DataFrame, contexts: DataFrame, run: str = "run_id") -> DataFrame:
    """E1-E3 for runs ``(run, query, answer)`` with long-form contexts ``(run, ctx_id, text)``.

    Token sets are joined on ``(run, token)`` — each context row meets only its
    own run's question tokens; no pair of unrelated rows is formed."""
    q = _tokens_of(runs, "query", run)
    a = _tokens_of(runs, "answer", run)
    c = _tokens_of(contexts, "text", run, "ctx_id")
    ov = (q.join(c, [run, "token"]).groupBy(run, "ctx_id").agg(F.count(F.lit(1)).alias("ov"))
          .groupBy(run).agg(F.count(F.when(F.col("ov") > 1, F.lit(1))).alias("n_rel_ctx"),
                            F.sum("ov").alias("sum_overlap")))
    a_hits = a.join(c.select(run, "token").distinct(), [run, "token"], "left_semi").groupBy(run).agg(
        F.count(F.lit(1)).alias("a_hits"))
    n_ctx = contexts.groupBy(run).agg(F.count(F.lit(1)).alias("n_contexts"))
    base = runs.select(run, F.size(token_set("query")).alias("n_q"), F.size(token_set("answer")).alias("n_a"))
    out = (base.join(n_ctx, run, "left").join(ov, run, "left").join(a_hits, run, "left")
           .fillna(0, ["n_contexts", "n_rel_ctx", "sum_overlap", "a_hits"]))
    return _finish(out).select(run, "n_contexts", "faithfulness", "answer_relevancy", "context_precision",
                               "context_recall", "precision_at_k")


def conversation_eval(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """E1-E3 per turn pair, contexts = all earlier turns of the same conversation.

    Computed from token postings without forming (pair, earlier turn) rows for
    turns that share nothing: faithfulness uses each token's first turn in the
    conversation; overlaps come from an equi-join on (conversation, token)."""
    turns = conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ctx_turn"), "text")
    ct = _tokens_of(turns, "text", "session_id", "ctx_turn")
    first = ct.groupBy("session_id", "token").agg(F.min("ctx_turn").alias("first_turn"))
    qt = _tokens_of(pairs, "human", "session_id", "turn_no")
    at = _tokens_of(pairs, "ai", "session_id", "turn_no")
    a_hits = (at.join(first, ["session_id", "token"]).where(F.col("first_turn") < F.col("turn_no"))
              .groupBy("session_id", "turn_no").agg(F.count(F.lit(1)).alias("a_hits")))
    ov = (qt.join(ct, ["session_id", "token"]).where(F.col("ctx_turn") < F.col("turn_no"))
          .groupBy("session_id", "turn_no", "ctx_turn").agg(F.count(F.lit(1)).alias("ov"))
          .groupBy("session_id", "turn_no").agg(F.count(F.when(F.col("ov") > 1, F.lit(1))).alias("n_rel_ctx"),
                                                F.sum("ov").alias("sum_overlap")))
    w = Window.partitionBy("session_id").orderBy("ctx_turn")
    before = turns.select("session_id", "ctx_turn",
                          (F.row_number().over(w) - 1).cast("long").alias("n_contexts")) \
        .withColumnRenamed("ctx_turn", "turn_no")
    base = pairs.select("session_id", "turn_no", F.size(token_set("human")).alias("n_q"),
                        F.size(token_set("ai")).alias("n_a"))
    out = (base.join(before, ["session_id", "turn_no"], "left")
           .join(ov, ["session_id", "turn_no"], "left").join(a_hits, ["session_id", "turn_no"], "left")
           .fillna(0, ["n_contexts", "n_rel_ctx", "sum_overlap", "a_hits"]))
    return _finish(out).select("session_id", "turn_no", "n_contexts", "faithfulness", "answer_relevancy",
                               "context_precision", "context_recall", "precision_at_k")
