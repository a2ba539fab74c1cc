"""Fusing, reranking and judging rankings."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import tokenize
from brindle.operators.lexical import PLACES, top
from brindle.operators.sizes import sent

KS = (1, 3, 5, 10)
MODES = ("bm25", "dense", "image", "hybrid", "hybrid_rerank", "multimodal", "multimodal_rerank")


def channels(rankings: dict[str, DataFrame]) -> DataFrame:
    """One table of query_id, channel, rank, chunk_id, score."""
    out = None
    for name, df in rankings.items():
        part = df.select("query_id", F.lit(name).alias("channel"), "rank", "chunk_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def reciprocal_rank_fusion(ranked: DataFrame, k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, scores (by channel, and rrf). A chunk counts once in a channel, at its first rank."""
    if k < 0:
        raise ValueError("k must not be negative")
    first = ranked.groupBy("query_id", "channel", "chunk_id").agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"))
    fused = first.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("rrf"), F.array_sort(F.collect_list(F.struct("channel", "score"))).alias("by_channel"))
    scores = F.map_concat(F.map_from_entries("by_channel"), F.create_map(F.lit("rrf"), F.col("rrf")))
    return fused.select("query_id", "chunk_id", F.col("rrf").alias("score"), scores.alias("scores"))


def overlap_score(question: Column, passage: Column) -> Column:
    """The default scorer: the share of a question's tokens that a passage has."""
    q = F.array_distinct(tokenize(question))
    return F.size(F.array_intersect(q, tokenize(passage))) / F.greatest(F.size(q), F.lit(1))


def rerank(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, score=overlap_score) -> DataFrame:
    """candidates: query_id, chunk_id. score: a function of question and passage columns; a pandas UDF will do."""
    rows = chunks.join(sent(candidates.select("query_id", "chunk_id").distinct()), "chunk_id").join(sent(questions), "query_id")
    scored = rows.select("query_id", "chunk_id", F.round(score(F.col("question"), F.concat_ws("\n", "section", "content")), PLACES).alias("score"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return top(scored.withColumn("score", F.when(finite, F.col("score")).otherwise(F.raise_error(F.lit("a score is not finite")))), k)


def resolve_mode(mode: str, dense: bool, image: bool, reranker: bool) -> str:
    """auto takes the richest mode there is; a mode that lacks its index or reranker is refused."""
    if mode == "auto":
        mode = ("multimodal" if image else "hybrid" if dense else "bm25") + ("_rerank" if reranker and (image or dense) else "")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode in ("dense", "hybrid", "hybrid_rerank") and not dense or mode in ("image", "multimodal", "multimodal_rerank") and not image or mode.endswith("rerank") and not reranker:
        raise RuntimeError(f"{mode} is unavailable")
    return mode


def retrieved(mode: str, k: int, bm25, dense=None, image=None, rerank=None, candidates: int = 20) -> DataFrame:
    """query_id, chunk_id, score, rank, at most k a query, by one of MODES or auto. bm25, dense and image: functions of a number that give so many a query
    as query_id, chunk_id, score, rank; rerank: a function of candidates and k. A channel that is not there is None: modes that need it are refused, and
    multimodal ones fuse the text vectors only where there are any. Filters belong to the channels, so each fills its places with what passes them."""
    mode = resolve_mode(mode, dense is not None, image is not None, rerank is not None)
    single = {"bm25": bm25, "dense": dense, "image": image}
    if mode in single:
        return single[mode](k)
    n = max(k, candidates)
    used = {name: f for name, f in single.items() if f is not None and (name != "image" or mode.startswith("multimodal"))}
    fused = top(reciprocal_rank_fusion(channels({name: f(n) for name, f in used.items()})), n)
    return rerank(fused, k) if mode.endswith("_rerank") else fused.where(F.col("rank") <= k)


def _at_most(k: int):
    return lambda r: r <= k


def metrics(ranked: DataFrame, gold: DataFrame, ks=KS) -> DataFrame:
    """query_id, mrr, hit_k, recall_k, ndcg_k of queries that have gold. ranked: query_id, rank, chunk_id; gold: query_id, chunk_id."""
    first = ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    gold = gold.distinct()
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = first.join(gold, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.collect_list("rank").alias("ranks"))
    rows = size.join(hits, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
    out = [F.coalesce(1 / F.array_min("ranks"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        within = F.filter("ranks", _at_most(k))
        ideal = gain(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold").cast("int"))))
        out += [(F.size(within) > 0).cast("double").alias(f"hit_{k}"), (F.size(within) / F.col("n_gold")).alias(f"recall_{k}"), F.round(gain(within) / ideal, PLACES).alias(f"ndcg_{k}")]
    return rows.select("query_id", *out)


def summarize(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("n"), *[F.round(F.avg(c), PLACES).alias(c) for c in per_query.columns if c != "query_id"])


