"""TF-IDF index and search.

Data layout is long-form postings ``(doc_id, token, ...)`` — never a per-doc
dict on the driver.

Plan shape and scale
* documents are hash-partitioned by id, then tokenise + explode +
  ``groupBy(doc, token)`` runs without a further exchange (a document is one
  row, so its groups are already co-located).
* document frequency is ``groupBy(token)`` (partial aggregation absorbs hot
  tokens); idf is joined back on ``token``: that of the most frequent tokens - a bounded
  number - is broadcast, so the bulk of the postings stays where it is, a document's
  together, and only the postings of rarer tokens are shuffled (:func:`with_idf`).
* the L2 norm is a window partitioned by document: a partition holds one
  document's distinct tokens, bounded by document length.
* scoring joins query postings to document postings on ``token`` (only tokens
  present in the question batch survive the join) and sums per (query, doc).
* a top-k search does not score every pair: documents lie in blocks, and per (token, block)
  of the question batch the largest impact is known.  Tokens that cannot lift a document to the question's k-th
  score find no candidates, blocks whose bound stays below it are not read
  (:func:`top_scores`); what is left is scored exactly.
* top-k per query is ``row_number() <= k`` (partial WindowGroupLimit before the
  exchange).  Zero-score padding (a query with fewer than k matches still gets k
  rows, ledger L13) uses a bounded candidate list — the 2k highest ids — held in
  an array per query or per filter key; no cross product of queries and docs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import dround
from merchlens.functions.text import tokens
from merchlens.session import materialize as _stage


#: Documents of one length class per block, were all of one class; scores closer than this may rank alike.
BLOCK_DOCS, SLACK = 1024, 2e-8
#: Distinct tokens beyond which a question is summed in full: the bounds of so many tokens add up past any score
#: and prune nothing (passages as questions at sf0.1: 0.5 % of the blocks, at twice the time).
LONG_QUESTION = 16


#: Most frequent tokens whose idf is broadcast.
FREQUENT_TOKENS = 100_000


@dataclass
class TfidfIndex:
    postings: DataFrame  # id, token, tf
    idf: DataFrame       # token, df, idf
    norms: DataFrame     # id, norm (L2 norm of the tf-idf vector, 0 -> 1), n_distinct (tokens)
    id_col: str

    @property
    def weights(self) -> DataFrame:
        """``(id, token, tf, weight)``, the L2-normalised tf-idf of every posting."""
        return (with_idf(self.postings, self.idf).join(self.norms, self.id_col)
                .select(self.id_col, "token", "tf",
                        (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight")))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             by_document: bool = True) -> DataFrame:
    """R3 + R4: ``(id, token, tf_count, n_tokens, tf)`` over the whole text.

    Documents are hash-partitioned by id first: a document is one row, so
    every ``(id, token)`` group then lives in one partition and the count
    needs no second exchange — the shuffle carries the text once instead of
    the (several times larger) exploded postings.  The document length rides
    along as a grouping key (fixed per document), so the aggregate carries a
    single count buffer.  The partition count is stated (the session's shuffle
    partitions) so AQE does not coalesce the text partitions by bytes:
    tokenising is CPU-bound and needs the tasks, not bigger partitions.
    A question batch (``by_document=False``) is short text and skips the
    repartition: its partial aggregate is already tiny."""
    if by_document:
        docs = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    t = docs.select(id_col, tokens(text_col).alias("_t"))
    # explode_outer: for a plain explode Catalyst infers size > 0 filters over the tokenising
    # expression and pushes them below the exchange, where every text would be tokenised again
    ex = t.select(id_col, F.size("_t").alias("n_tokens"), F.explode_outer("_t").alias("token")).where("token is not null")
    return (ex.groupBy(id_col, "n_tokens", "token")
            .agg(F.count(F.lit(1)).alias("tf_count"))
            .select(id_col, "token", "tf_count", "n_tokens", (F.col("tf_count") / F.col("n_tokens")).alias("tf")))


def idf_table(post: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Smoothed idf ``ln((N+1)/(df+1)) + 1``; N counts every document, empty ones too."""
    n = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    return (post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
            .withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1))


def _l2(df: DataFrame, key: str, w: str = "w") -> DataFrame:
    norm = F.sqrt(F.sum(F.col(w) * F.col(w)).over(Window.partitionBy(key)))
    return df.withColumn("weight", F.col(w) / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))).drop(w)


def block_of(id_col: str, modulus: Column) -> Column:
    """Block of a document: its length class (half powers of two, for long documents have small impacts) and a hash
    of its id, so that a block's documents are alike in the one thing that bounds an impact."""
    length = F.floor(F.log2(F.col("n_distinct").cast("double")) * 2).cast("long")
    return length * F.lit(2 ** 32) + F.pmod(F.xxhash64(id_col), modulus)


def with_idf(post: DataFrame, idf: DataFrame) -> DataFrame:
    """Postings with their token's ``idf``; the postings are read twice: pass written rows."""
    top = idf.orderBy(F.col("df").desc(), "token").limit(FREQUENT_TOKENS).select("token", "idf")
    top = F.broadcast(_stage(top, "frequent-tokens"))
    rare = post.join(top.select("token"), "token", "left_anti").join(idf.select("token", "idf"), "token")
    return post.join(top, "token").unionByName(rare)


def doc_norms(post: DataFrame, idf: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, norm)``: L2 norm of each document's tf-idf vector — a hash
    aggregate by document (no sort), one row per document."""
    w = with_idf(post, idf).select(id_col, (F.col("tf") * F.col("idf")).alias("w"))
    return (w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"), F.count(F.lit(1)).alias("n_distinct"))
            .select(id_col, F.coalesce(F.nullif(F.col("_n"), F.lit(0.0)), F.lit(1.0)).alias("norm"), "n_distinct"))


def tfidf_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              materialize: bool = True) -> TfidfIndex:
    """Postings, idf and per-document norms.

    Building an index is a write-once step: with ``materialize`` (default) the
    corpus is tokenised ONCE into a postings table under the shared checkpoint
    dir and idf and norms are derived from it and written too, so searches
    read these tables instead of re-tokenising the corpus (each consumer of a
    lazy postings plan would re-run the regex over every text).  Written
    tables also cut the lineage: a lost executor re-reads files rather than
    re-running the shuffles.  No full weights table is written: a search only
    touches the postings of its query tokens and divides by the norm."""
    post = postings(docs, id_col, text_col).select(id_col, "token", "tf")
    if materialize:
        post = _stage(post, "tfidf-postings")
    idf = idf_table(post, docs, id_col)
    if materialize:
        idf = _stage(idf, "tfidf-idf")
    norms = doc_norms(post, idf, id_col)
    if materialize:
        norms = _stage(norms, "tfidf-norms")
    return TfidfIndex(post, idf, norms, id_col)


def query_weights(index: TfidfIndex, questions: DataFrame, qid: str = "query_id",
                  text_col: str = "query") -> DataFrame:
    """Query vector ``(qid, token, q_weight, idf)``; unknown tokens take idf 1
    and still count in the norm (their ``idf`` column stays null)."""
    qp = postings(questions, qid, text_col, by_document=False).select(qid, "token", "tf")
    qw = (qp.join(index.idf.select("token", "idf"), "token", "left")
          .select(qid, "token", "idf", (F.col("tf") * F.coalesce(F.col("idf"), F.lit(1.0))).alias("w")))
    return _l2(qw, qid).withColumnRenamed("weight", "q_weight")


def scores(index: TfidfIndex, questions: DataFrame, qid: str = "query_id", text_col: str = "query") -> DataFrame:
    """Sparse dot product of query and document weights, per (query, doc) sharing a token.

    Only postings of tokens that occur in the question batch survive the join
    (AQE turns it into a broadcast of the query side from its measured size);
    the idf comes along with the query weights, and the document norm is
    applied once per (query, doc) after the sum."""
    idc = index.id_col
    qw = query_weights(index, questions, qid, text_col).where(F.col("idf").isNotNull())
    dot = (qw.join(index.postings.select(idc, "token", "tf"), "token")
           .groupBy(qid, idc)
           .agg(F.sum(F.col("q_weight") * F.col("tf") * F.col("idf")).alias("_dot")))
    return dot.join(index.norms, idc).select(qid, idc, (F.col("_dot") / F.col("norm")).alias("score"))


@dataclass
class Bounded:
    """The steps of a bounded search: ``tokens`` of the questions with their bounds, ``cells`` (question, token, block)
    with the block's bound, ``hits`` (question, document) that are scored, ``postings`` of the batch's tokens."""

    tokens: DataFrame
    cells: DataFrame
    hits: DataFrame
    postings: DataFrame


def bounded_search(index: TfidfIndex, questions: DataFrame, k: int, eligible: Callable[[DataFrame], DataFrame] | None = None,
                   qid: str = "query_id", text_col: str = "query") -> Bounded:
    """The candidates of :func:`top_scores`, step by step.

    0. The postings of the batch's tokens - each token once, whatever the number of questions - are written with their
       documents' blocks, and the largest impact (``tf / norm``) of each token in each block is taken from them.
    1. The documents with the rarest tokens of a question - as many tokens as it takes to meet ``2 k`` documents - are
       scored; the k-th of these scores is a lower bound ``theta`` of the k-th score of all (0 where fewer than k match).
    2. A token's ``ub`` is the most that it can add to a score (question weight times the largest impact).  The tokens with
       the smallest bounds, as many as together stay below ``theta``, are not essential: a document with none but
       these cannot be among the k best.  They find no candidates; their bounds add up to ``rest``.
    3. A block is read for a question only if the impacts of its essential tokens and ``rest`` can reach ``theta``,
       and a document is completed only if its own partial score and ``rest`` can."""
    idc = index.id_col
    keep = eligible or (lambda rows: rows.withColumn("_unit", F.col(idc)))
    qw = query_weights(index, questions, qid, text_col).where(F.col("idf").isNotNull()).select(
        qid, "token", (F.col("q_weight") * F.col("idf")).alias("qw"))
    modulus = index.norms.select(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.lit(1)).cast("long")).scalar()
    post = index.postings.join(qw.select("token").distinct(), "token").join(index.norms, idc).withColumn("_m", modulus)
    post = post.withColumn("block", block_of(idc, F.col("_m")))
    post = _stage(post.select(idc, "token", "tf", "norm", "block"), "query-postings")
    blocks = _stage(post.groupBy("token", "block").agg(F.max(F.col("tf") / F.col("norm")).alias("top"), F.count(F.lit(1)).alias("n")),
                    "query-blocks")

    seen = blocks.groupBy("token").agg(F.max("top").alias("top"), F.sum("n").alias("df"))
    qw = qw.join(seen, "token").withColumn("ub", F.col("qw") * F.col("top")).drop("top")
    rarest = Window.partitionBy(qid).orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    met = F.coalesce(F.sum("df").over(rarest), F.lit(0))
    tail = F.sum("ub").over(Window.partitionBy(qid).orderBy(F.desc("ub"), "token").rowsBetween(0, Window.unboundedFollowing))
    qw = qw.withColumns({"met": met, "tail": tail})

    first = keep(qw.where(F.col("met") < 2 * k).join(post, "token").select(qid, idc).distinct())
    first = first.join(qw.select(qid, "token", "qw"), qid).join(post, ["token", idc]).groupBy(qid, idc, "_unit").agg(
        (F.sum(F.col("qw") * F.col("tf")) / F.first("norm")).alias("score"))
    units = first.groupBy(qid, "_unit").agg(F.max("score").alias("score"))
    units = units.withColumn("_rn", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score")))).where(F.col("_rn") <= k)
    theta = units.groupBy(qid).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("theta"))
    qt = qw.join(theta, qid, "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)) - SLACK)
    qt = qt.withColumn("essential", F.col("tail") >= F.col("theta"))
    rest = F.sum(F.when(F.col("essential"), F.lit(0.0)).otherwise(F.col("ub"))).over(Window.partitionBy(qid))
    qt = _stage(qt.withColumn("rest", rest).drop("met", "tail"), "query-bounds")

    cells = qt.where("essential").join(blocks, "token")
    bound = F.sum(F.col("qw") * F.col("top")).over(Window.partitionBy(qid, "block")) + F.col("rest")
    cells = cells.select(qid, "token", "block", "qw", "theta", "rest", bound.alias("bound"))
    read = cells.where(F.col("bound") >= F.col("theta")).select(qid, "token", "block", "qw", "theta", "rest")
    hits = read.join(post, ["token", "block"]).groupBy(qid, idc, "theta", "rest", "norm").agg(F.sum(F.col("qw") * F.col("tf")).alias("dot"))
    hits = hits.where(F.col("dot") / F.col("norm") + F.col("rest") >= F.col("theta"))
    return Bounded(qt, cells, keep(hits).select(qid, idc, "dot", "norm"), post)


def top_scores(index: TfidfIndex, questions: DataFrame, k: int, eligible: Callable[[DataFrame], DataFrame] | None = None,
               qid: str = "query_id", text_col: str = "query") -> DataFrame:
    """``(qid, id, score)`` as :func:`scores` has them, for every pair that can be among a question's ``k`` best:
    exact, without a row for pairs that share only tokens too frequent to matter.

    ``eligible`` keeps the rows that may be found (it gets ``(qid, id, ...)`` rows) and adds ``_unit``, what is
    counted to ``k`` - the document itself, or what it belongs to."""
    idc = index.id_col
    long = F.size(F.array_distinct(tokens(text_col))) > LONG_QUESTION
    summed = scores(index, questions.where(long), qid, text_col)
    if eligible is not None:
        summed = eligible(summed).select(qid, idc, "score")
    b = bounded_search(index, questions.where(~F.coalesce(long, F.lit(False))), k, eligible, qid, text_col)
    other = b.tokens.where(~F.col("essential")).select(qid, "token", "qw")
    rows = b.hits.join(other, qid, "left").join(b.postings.select(idc, "token", "tf"), [idc, "token"], "left")
    full = rows.groupBy(qid, idc, "dot", "norm").agg(F.sum(F.coalesce(F.col("qw") * F.col("tf"), F.lit(0.0))).alias("_more"))
    return full.select(qid, idc, ((F.col("dot") + F.col("_more")) / F.col("norm")).alias("score")).unionByName(summed)


def _rank_key(score: Column) -> Column:
    """Rank on the 8-dp rounded score so engines with different summation order rank alike."""
    return dround(score, 8)


def top_k_padded(matched: DataFrame, questions: DataFrame, candidates: Column, k: int,
                 qid: str, id_col: str, extra: list[str] | None = None,
                 pad_key: DataFrame | None = None, exclude_field: str | None = None) -> DataFrame:
    """Top-k per query of ``matched`` (score > 0), padded to k with zero-score
    candidates taken in order from the array ``candidates`` (ids, best first)
    minus those already matched (compared on ``exclude_field``, default the id).
    ``pad_key``, when given, is a frame ``(qid, cands)`` with a per-query
    candidate array instead."""
    extra = extra or []
    w = Window.partitionBy(qid).orderBy(F.col("_rk").desc(), F.col(id_col).desc())
    top = (matched.withColumn("_rk", _rank_key(F.col("score")))
           .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k))
    hits = top.groupBy(qid).agg(F.collect_list(F.struct(
        F.col("_rn"), F.col(id_col), F.col("score"), *[F.col(c) for c in extra])).alias("_hits"))
    q = questions.select(qid).join(hits, qid, "left")
    if pad_key is not None:
        q = q.join(pad_key, qid, "left")
        cands = F.coalesce(F.col("cands"), F.array().cast(pad_key.schema["cands"].dataType))
    else:
        # project the (scalar-subquery) candidate array first: subqueries may not sit inside lambdas
        q = q.withColumn("_cands", candidates)
        cands = F.col("_cands")
    ex = exclude_field or id_col
    hit_ids = F.coalesce(F.transform(F.col("_hits"), lambda h: h[ex]), F.array())
    n_hits = F.coalesce(F.size("_hits"), F.lit(0))
    pad = F.slice(F.filter(cands, lambda c: ~F.coalesce(F.array_contains(hit_ids, c[ex]), F.lit(False))), 1,
                  F.greatest(F.lit(k) - n_hits, F.lit(0)))
    # hits then padding as ONE array per query, exploded once: a union of two
    # selects over ``q`` would run the whole scoring plan twice
    types = {c: matched.schema[c].dataType for c in [id_col, *extra]}

    def row(rank: Column, src: Column, score: Column) -> Column:
        return F.struct(rank.cast("int").alias("rank"), src[id_col].cast(types[id_col]).alias(id_col),
                        score.cast("double").alias("score"),
                        *[src[c].cast(types[c]).alias(c) for c in extra])

    hit_rows = F.transform(F.coalesce(F.col("_hits"), F.array()), lambda h: row(h["_rn"], h, h["score"]))
    pad_rows = F.transform(pad, lambda c, i: row(n_hits + i + 1, c, F.lit(0.0)))
    out = q.select(qid, F.explode(F.concat(hit_rows, pad_rows)).alias("r"))
    return out.select(qid, "r.rank", f"r.{id_col}", "r.score", *[f"r.{c}" for c in extra])


def search_documents(index: TfidfIndex, docs: DataFrame, questions: DataFrame, k: int = K.DEFAULT_TOP_K,
                     qid: str = "query_id", text_col: str = "query", bounded: bool = False) -> DataFrame:
    """R9 on a plain corpus: top-k documents per question, zero scores eligible.  ``bounded`` searches by
    score bounds (:func:`top_scores`): the same rows, for batches of short questions on a large corpus."""
    id_col = index.id_col

    def kept(rows: DataFrame) -> DataFrame:
        # only the kept documents may be found (an index may hold more than ``docs``)
        return rows.join(docs.select(id_col), id_col, "left_semi").withColumn("_unit", F.col(id_col))

    if bounded:
        s = top_scores(index, questions, k, kept, qid, text_col)
    else:
        s = scores(index, questions, qid, text_col).join(docs.select(id_col), id_col, "left_semi")
    # the 2k highest ids: enough to pad any query that matched fewer than k docs
    cand = (docs.select(id_col).orderBy(F.col(id_col).desc()).limit(2 * k)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(id_col))), asc=False)).scalar())
    out = top_k_padded(s, questions, cand, k, qid, id_col)
    return out.select(qid, "rank", id_col, dround("score", 4).alias("score"))


# --- merchant search: metadata filters + best chunk per merchant ----------------

_MASKS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def _filter_key(city: Column, mcc: Column, tier: Column) -> Column:
    return F.concat_ws("|", F.coalesce(F.lower(city), F.lit("*")), F.coalesce(mcc, F.lit("*")),
                       F.coalesce(tier, F.lit("*")))


def _pad_table(chunks: DataFrame, k: int) -> DataFrame:
    """Per filter key (each of city / mcc / tier either fixed or '*'), the 2k merchants
    with the highest best-chunk id — bounded arrays, computed by a grouped top-n."""
    m = chunks.groupBy("merchant_id").agg(
        F.max("doc_id").alias("doc_id"), F.max(F.lower("city")).alias("c"),
        F.max("mcc_code").alias("m"), F.max("transaction_value_tier").alias("t"))
    keys = F.array(*[
        _filter_key(F.col("c") if a else F.lit(None), F.col("m") if b else F.lit(None),
                    F.col("t") if c else F.lit(None)) for a, b, c in _MASKS])
    ex = m.select("merchant_id", "doc_id", F.explode(keys).alias("fkey"))
    w = Window.partitionBy("fkey").orderBy(F.col("doc_id").desc())
    top = ex.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2 * k)
    return top.groupBy("fkey").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "merchant_id")), asc=False).alias("cands"))


def search_merchants(index: TfidfIndex, chunks: DataFrame, questions: DataFrame, merchants: DataFrame,
                     k: int = K.DEFAULT_TOP_K, static_filter: Column | None = None,
                     qid: str = "query_id", text_col: str = "query") -> DataFrame:
    """Filtered merchant search.

    ``questions`` may carry per-query filters ``f_city`` / ``f_mcc_code`` /
    ``f_value_tier`` (from ``infer_filters``); ``static_filter`` is one predicate
    on chunk metadata applied to every query before scoring.  Each merchant
    appears once, with its best chunk; hits are joined to the merchant rows."""
    ch = chunks.where(static_filter) if static_filter is not None else chunks
    qf = questions.select(qid, *[F.col(c) if c in questions.columns else F.lit(None).cast("string").alias(c)
                                 for c in ("f_city", "f_mcc_code", "f_value_tier")])
    meta = ch.select("doc_id", "merchant_id", F.lower("city").alias("_c"), "mcc_code", "transaction_value_tier")

    def kept(rows: DataFrame) -> DataFrame:
        # a merchant counts once, whatever the number of its chunks
        hit = (rows.join(meta, "doc_id").join(qf, qid)
               .where((F.col("f_city").isNull() | (F.col("_c") == F.lower("f_city")))
                      & (F.col("f_mcc_code").isNull() | (F.col("mcc_code") == F.col("f_mcc_code")))
                      & (F.col("f_value_tier").isNull() | (F.col("transaction_value_tier") == F.col("f_value_tier")))))
        return hit.select(*rows.columns, F.col("merchant_id").alias("_unit"))

    s = top_scores(index, questions, k, kept, qid, text_col)
    hits = s.join(meta.select("doc_id", "merchant_id"), "doc_id")
    wb = Window.partitionBy(qid, "merchant_id").orderBy(_rank_key(F.col("score")).desc(), F.col("doc_id").desc())
    best = hits.withColumn("_b", F.row_number().over(wb)).where(F.col("_b") == 1).select(
        qid, "merchant_id", "doc_id", "score")
    pad = (qf.select(qid, _filter_key(F.col("f_city"), F.col("f_mcc_code"), F.col("f_value_tier")).alias("fkey"))
           .join(_pad_table(ch, k), "fkey").select(qid, "cands"))
    top = top_k_padded(best.withColumnRenamed("merchant_id", "mid"), questions, None, k, qid, "doc_id",
                       extra=["mid"], exclude_field="mid", pad_key=pad.withColumn(
                           "cands", F.transform("cands", lambda c: F.struct(c["doc_id"].alias("doc_id"),
                                                                            c["merchant_id"].alias("mid")))))
    text = chunks.select("doc_id", "text")
    return (top.withColumnRenamed("mid", "merchant_id")
            .join(text, "doc_id")
            .join(merchants.select("merchant_id", "merchant_name", "city", "mcc_code", "stars",
                                   "transaction_amount", "acceptance_method"), "merchant_id")
            .select(qid, "rank", "merchant_id", "merchant_name", "city", "mcc_code", "stars",
                    "transaction_amount", "acceptance_method", dround("score", 4).alias("score"), "doc_id",
                    F.substring("text", 1, K.CHUNK_PREVIEW_CHARS).alias("chunk_text"),
                    F.substring("text", 1, K.SEARCH_PREVIEW_CHARS).alias("chunk_preview")))


def tfidf_search(index: TfidfIndex, questions: DataFrame, chunks: DataFrame, filters: Column | None = None,
                 k: int = K.DEFAULT_TOP_K, merchants: DataFrame | None = None) -> DataFrame:
    """R9 entry point: with ``merchants`` the filtered merchant search (one row per
    merchant, its best chunk); without, top-k chunks per question (``filters``
    then restricts the chunks searched)."""
    if merchants is not None:
        return search_merchants(index, chunks, questions, merchants, k=k, static_filter=filters)
    docs = chunks.where(filters) if filters is not None else chunks
    return search_documents(index, docs.select(index.id_col), questions, k=k)
