"""Offline replay: rank the candidates of every sample and measure where the positive lands."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import vectors as X
from ..operators.ordering import dense_order, positions, running_total
from . import sample_blocks as B
from .recommend import minmax, rerank_components, rerank_hybrid

S = ["sample_id"]


def with_ids(samples: DataFrame) -> DataFrame:
    extra = [F.col("key")] if "key" in samples.columns else []
    return samples.withColumn("sample_id", F.concat_ws("|", "subject", "event_at", "positive", *extra))


def candidates(samples: DataFrame) -> DataFrame:
    """(sample_id, cpos, article_id): the positive is candidate 0."""
    return samples.select("sample_id", F.posexplode(F.concat(F.array("positive"), "negatives")).alias("cpos", "article_id"))


def histories(samples: DataFrame) -> DataFrame:
    """(sample_id, article_id, age): age 0 is the latest read."""
    return samples.select("sample_id", F.size("history").alias("n"), F.posexplode("history").alias("p", "article_id")).select(
        "sample_id", "article_id", (F.col("n") - 1 - F.col("p")).alias("age"))


def article_meta(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    return articles.join(vectors.select("article_id", "embedding"), "article_id", "left").select(
        "article_id", F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("published_at", F.lit("")).alias("published_at"),
        F.coalesce("trust_score", F.lit(0)).alias("trust_score"), "embedding")


def candidate_rows(samples: DataFrame, meta: DataFrame, dim: int = 64) -> DataFrame:
    """(sample_id, cpos, article_id, category, published_at, trust_score, cosine, has_vector, has_profile)."""
    cols = ["category", "published_at", "trust_score"]
    rows = B.scored_candidates(samples, meta.withColumn("_use", F.lit(B.BOTH)), cols, skip_unknown=True)
    return rows.select("sample_id", "cpos", "article_id", F.coalesce("category", F.lit("unknown")).alias("category"),
                       F.coalesce("published_at", F.lit("")).alias("published_at"), F.coalesce("trust_score", F.lit(0)).alias("trust_score"),
                       F.round("cosine", 9).alias("cosine"), "has_vector", "has_profile")


def _ranked(rows: DataFrame, order: list[Column], strategy: str) -> DataFrame:
    w = W.partitionBy("sample_id").orderBy(*order)
    return rows.select("sample_id", "cpos", "article_id", F.row_number().over(w).alias("rank"), F.lit(strategy).alias("strategy"))


def rank_profile(rows: DataFrame) -> DataFrame:
    """Cosine to the profile; a missing vector scores -1, without a profile the given order stays."""
    score = F.when(F.col("has_profile"), F.when(F.col("has_vector"), F.col("cosine")).otherwise(-1.0)).otherwise(0.0)
    return _ranked(rows, [score.desc(), F.col("cpos")], "profile")


def rank_latest(rows: DataFrame) -> DataFrame:
    return _ranked(rows, [F.col("published_at").desc(), F.col("article_id").desc()], "latest")


def sample_category_weights(samples: DataFrame, meta: DataFrame) -> DataFrame:
    return B.category_weights(samples, meta)


def rank_category(rows: DataFrame, weights: DataFrame) -> DataFrame:
    r = rows.join(weights, ["sample_id", "category"], "left").withColumn("weight", F.round(F.coalesce("weight", F.lit(0.0)), 9))
    return _ranked(r, [F.col("weight").desc(), F.col("published_at").desc(), F.col("article_id").desc()], "category")


def rank_hybrid(rows: DataFrame, weights: DataFrame) -> DataFrame:
    r = rerank_hybrid(rows.withColumn("score", F.coalesce("cosine", F.lit(0.0))), weights, S)
    return r.select("sample_id", "cpos", "article_id", F.col("pos").alias("rank"), F.lit("hybrid").alias("strategy"))


def rank_random(rows: DataFrame, samples: DataFrame, seed: str = "42") -> DataFrame:
    """A repeatable baseline: order by the hash of seed, subject, positive and candidate."""
    r = rows.join(samples.select("sample_id", "subject", "positive"), "sample_id")
    order = F.sha2(F.concat_ws("|", F.lit(seed), "subject", "positive", "article_id"), 256)
    return _ranked(r, [order, F.col("article_id")], "random")


def ranking_metrics(ranked: DataFrame, k: int = 3, by: str = "strategy") -> DataFrame:
    """n, hit rate at k, MRR and NDCG at k of the positive (candidate 0)."""
    r = F.col("rank")
    return ranked.where("cpos = 0").groupBy(by).agg(
        F.count("*").alias("n"), F.avg((r <= k).cast("double")).alias("hit_rate"), F.avg(1.0 / r).alias("mrr"),
        F.avg(F.when(r <= k, 1.0 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg"))


STRATEGIES = ("profile", "hybrid", "category", "latest", "random")


def strategy_ranks(rows: DataFrame, weights: DataFrame, samples: DataFrame, seed: str = "42") -> DataFrame:
    """Candidates with one rank column for each strategy, over a single partitioning by sample."""
    r = rows.join(weights, ["sample_id", "category"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    r = r.join(samples.select("sample_id", "subject", "positive"), "sample_id")
    r = r.withColumns({"score": F.coalesce("cosine", F.lit(0.0)), "_weight": F.round("weight", 9),
                       "_cosine": F.when(F.col("has_profile"), F.when(F.col("has_vector"), F.col("cosine")).otherwise(-1.0)).otherwise(0.0),
                       "_hash": F.sha2(F.concat_ws("|", F.lit(seed), "subject", "positive", "article_id"), 256)})
    newest = [F.col("published_at").desc(), F.col("article_id").desc()]
    orders = {"profile": [F.col("_cosine").desc(), F.col("cpos")], "category": [F.col("_weight").desc(), *newest], "latest": newest,
              "random": [F.col("_hash"), F.col("article_id")]}
    ranks = {n: F.row_number().over(W.partitionBy("sample_id").orderBy(*o)) for n, o in orders.items()}
    return rerank_hybrid(r.withColumns(ranks), None, S).withColumnRenamed("pos", "hybrid")


def offline_replay(samples: DataFrame, meta: DataFrame, k: int = 3, dim: int = 64) -> DataFrame:
    """All strategies on all samples, best MRR first; only the positive's five ranks leave the one pass."""
    ranked = strategy_ranks(candidate_rows(samples, meta, dim), sample_category_weights(samples, meta), samples).where("cpos = 0")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("rank")) for n in STRATEGIES]))
    return ranking_metrics(ranked.select("cpos", each.alias("x")).select("cpos", "x.*"), k).orderBy(F.col("mrr").desc(), "strategy")


def closed_samples(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Samples whose positive, reads and negatives all have features."""
    used = samples.select("sample_id", F.explode(F.array_distinct(F.concat(F.array("positive"), "negatives", "history"))).alias("article_id"))
    bad = used.join(features.select("article_id"), "article_id", "left_anti").select("sample_id").distinct()
    return samples.join(bad, "sample_id", "left_anti")


def time_ordered_split(samples: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Adds ``part``: the first share of the time order is 'train', the rest 'validation', at least one each."""
    keyed = samples.withColumn("_ord", F.concat("event_at", F.lit("\u0001"), "sample_id"))
    placed = positions(keyed, [], "_ord", "_pos")
    total = samples.agg(F.count("*").alias("_n")).withColumn("_o", F.lit(1))
    j = placed.withColumn("_o", F.lit(1)).join(F.broadcast(total), "_o")
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(ratio)))
    cut = F.when(cut >= F.col("_n"), F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(cut)
    return j.withColumn("part", F.when(F.col("_pos") < cut, "train").otherwise("validation")).select(*samples.columns, "part")


def user_split(samples: DataFrame, train_users: int = 14) -> DataFrame:
    """Adds ``part`` by the number at the end of the subject; a subject without one validates."""
    number = F.element_at(F.split("subject", ":"), -1).try_cast("int")
    return samples.withColumn("part", F.when(number < train_users, "train").otherwise("validation"))


# ---- weight search -----------------------------------------------------------------------

def catalog_features(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Articles with a vector: unit vector, trust 0-1 (0.5 when not analysed), freshness 0-1."""
    rows = articles.join(vectors.select("article_id", "embedding"), "article_id").select(
        "article_id", F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("published_at", F.lit("")).alias("published_at"),
        X.l2_normalize(F.col("embedding")).alias("embedding"),
        F.when(F.coalesce("trust_score", F.lit(0)) != 0, F.col("trust_score") / 100.0).otherwise(0.5).alias("trust"))
    return rows.join(global_freshness(rows), "published_at")


def global_freshness(rows: DataFrame) -> DataFrame:
    """(published_at, freshness): rank of the date text among all, divided by the largest rank."""
    order = dense_order(rows, "published_at")
    top = order.agg(F.greatest(F.max("place"), F.lit(1)).alias("top")).withColumn("_o", F.lit(1))
    return order.withColumn("_o", F.lit(1)).join(F.broadcast(top), "_o").select("published_at", (F.col("place") / F.col("top")).alias("freshness"))


def candidate_components(samples: DataFrame, catalog: DataFrame, dim: int = 64) -> DataFrame:
    """(sample_id, cpos, article_id, trust_value, semantic, interest, trust, freshness), min-maxed per sample."""
    # no vector travels with a row: candidates come out of their block with the cosine
    rows = B.scored_candidates(samples, catalog.withColumns({"_use": F.lit(B.BOTH), "_known": F.lit(True)}), ["category", "trust", "freshness", "_known"], skip_unknown=False)
    rows = rows.where("_known and has_read and sample_id is not null and article_id is not null")
    weights = B.category_weights(samples, catalog, known=True).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "weight"))).alias("_weights"))
    r = rows.join(weights, "sample_id", "left").withColumn("weight", F.coalesce(F.col("_weights")[F.col("category")], F.lit(0.0)))
    r = r.withColumn("sem", F.when(F.col("has_vector"), F.round(F.coalesce("cosine", F.lit(0.0)), 9)))
    w = W.partitionBy("sample_id")
    return r.select("sample_id", "cpos", "article_id", F.col("trust").alias("trust_value"), minmax(F.col("sem"), w).alias("semantic"),
                    minmax(F.col("weight"), w).alias("interest"), minmax(F.col("trust"), w).alias("trust"), minmax(F.col("freshness"), w).alias("freshness"))


WEIGHT_GRID = [(a / 10, b / 10, c / 10, (10 - a - b - c) / 10) for a in range(11) for b in range(11 - a) for c in range(11 - a - b)]


_CELLS = "w int, persona string, n bigint, hits double, rr double, gain double, low bigint, shown bigint"


def _weigh(weights: list[tuple], k: int, low_trust: float, step: int = 2048):
    """Per persona and weight tuple: sums over the samples of a batch, all candidates times all weights at once."""
    table = np.array(weights, dtype=np.float64)

    def ranks(rows: pd.DataFrame):
        size = rows["c"].map(len).to_numpy()
        wide = size.max()
        part = np.full((4, len(rows), wide), -np.inf)
        trust = np.full((len(rows), wide), np.inf)
        own = np.zeros(len(rows), dtype=np.int64)
        for i, cells in enumerate(rows["c"]):
            # ties go to the larger (article, place): a stable sort keeps this order
            cells = sorted(cells, key=lambda x: (x["article_id"], x["cpos"]), reverse=True)
            own[i] = next(j for j, x in enumerate(cells) if x["cpos"] == 0)
            part[:, i, :len(cells)] = [[x[c] for x in cells] for c in ("semantic", "interest", "trust", "freshness")]
            trust[i, :len(cells)] = [x["trust_value"] for x in cells]
        with np.errstate(invalid="ignore"):
            score = sum(part[j][:, :, None] * table[:, j] for j in range(4))
        score = np.where(np.isfinite(part[0])[:, :, None], np.round(score, 9), -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")
        place = (order == own[:, None, None]).argmax(axis=1) + 1
        shown = np.minimum(size, k)
        top = np.take_along_axis(np.broadcast_to(trust[:, :, None], score.shape), order[:, :k], axis=1)
        return place, (top < low_trust).sum(axis=1), shown

    def run(batches):
        for batch in batches:
            batch = batch[batch["c"].map(lambda cells: any(x["cpos"] == 0 for x in cells))]
            for at in range(0, len(batch), step):
                rows = batch.iloc[at:at + step]
                place, low, shown = ranks(rows)
                gain = np.where(place <= k, 1.0 / np.log2(place + 1.0), 0.0)
                names, code = np.unique(rows["persona"].to_numpy().astype(str), return_inverse=True)
                for g, name in enumerate(names):
                    m = code == g
                    yield pd.DataFrame({"w": np.arange(len(table), dtype=np.int32), "persona": name, "n": int(m.sum()), "hits": (place[m] <= k).sum(axis=0).astype(float),
                                        "rr": (1.0 / place[m]).sum(axis=0), "gain": gain[m].sum(axis=0), "low": low[m].sum(axis=0), "shown": int(shown[m].sum())})
    return run


def weight_metrics(components: DataFrame, groups: DataFrame, weights: list[tuple] = WEIGHT_GRID, k: int = 3, low_trust: float = 0.4) -> DataFrame:
    """Metrics per weight tuple: n, hit rate, MRR, NDCG, mean and worst group NDCG, low-trust share of the top k.

    ``groups``: (sample_id, persona).  A sample's candidates sit in one small array; a batch of
    samples is multiplied with all weights and summed before anything is shuffled.
    """
    cell = F.struct("cpos", "article_id", "trust_value", "semantic", "interest", "trust", "freshness")
    per = components.groupBy("sample_id").agg(F.collect_list(cell).alias("c")).join(groups, "sample_id").select("persona", "c")
    sums = per.mapInPandas(_weigh(weights, k, low_trust), _CELLS)
    per_group = sums.groupBy("w", "persona").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "rr", "gain", "low", "shown")])
    total = F.sum("n")
    out = per_group.groupBy("w").agg(total.alias("n"), (F.sum("hits") / total).alias("hit_rate"), (F.sum("rr") / total).alias("mrr"),
                                     (F.sum("gain") / total).alias("ndcg"), F.avg(F.col("gain") / F.col("n")).alias("macro_persona_ndcg"),
                                     F.min(F.col("gain") / F.col("n")).alias("worst_persona_ndcg"), (F.sum("low") / F.sum("shown")).alias("low_trust_topk_rate"))
    options = F.array(*[F.struct(*[F.lit(float(x)).alias(f"w{j}") for j, x in enumerate(t)]) for t in weights])
    return out.withColumn("w", F.element_at(options, F.col("w") + 1))


def best_weights(metrics: DataFrame) -> DataFrame:
    """The tuple with the best (macro NDCG, MRR, weights)."""
    return metrics.orderBy(F.round("macro_persona_ndcg", 9).desc(), F.round("mrr", 9).desc(), F.col("w").desc()).limit(1)


def weight_grid_search(train: DataFrame, validation: DataFrame, groups: DataFrame) -> DataFrame:
    """Grid on the training components; the chosen tuple and three baselines on validation."""
    chosen = best_weights(weight_metrics(train, groups)).select("w.*").first()  # one row
    named = {"semantic_only": (1.0, 0.0, 0.0, 0.0), "category_only": (0.0, 1.0, 0.0, 0.0),
             "deployment_candidate": tuple(K.RERANK_WEIGHTS), "selected_hybrid": tuple(chosen)}
    m = weight_metrics(validation, groups, list(dict.fromkeys(named.values())))
    keys = validation.sparkSession.createDataFrame([(n, *w) for n, w in named.items()], "variant string, a double, b double, c double, d double")
    on = (F.col("w.w0") == F.col("a")) & (F.col("w.w1") == F.col("b")) & (F.col("w.w2") == F.col("c")) & (F.col("w.w3") == F.col("d"))
    return F.broadcast(keys).join(m, on).drop("w")


def seed_summary(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Means over seeds of a baseline and a candidate metric, and the relative gain."""
    return rows.agg(F.count("*").alias("seeds"), F.avg(first).alias(first), F.avg(second).alias(second)).withColumn(
        "relative_gain", F.col(second) / F.col(first) - 1)


# ---- embedding spaces ----------------------------------------------------------------------

def vector_spaces(vectors: DataFrame, learned: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw, learned and chunk vectors as unit vectors; missing and zero vectors are dropped."""
    unit = lambda df, c: df.where(F.col(c).isNotNull() & X.has_length(F.col(c))).withColumn(c, X.l2_normalize(F.col(c)))
    return (unit(vectors, "embedding").select("article_id", "embedding"), unit(learned, "learned_embedding").select("article_id", "learned_embedding"),
            unit(chunks, "embedding").select("chunk_id", "article_id", "embedding"))


def cosine_summary(raw: DataFrame, learned: DataFrame) -> DataFrame:
    """Number, mean and median of the paired cosines; the median comes from positions over ranges, not from one task."""
    j = raw.join(learned, "article_id").select("article_id", X.dot(F.col("embedding"), F.col("learned_embedding")).alias("c"))
    one = j.agg(F.count("*").alias("paired_articles"), F.avg("c").alias("mean_cosine"))
    run = running_total(j.withColumn("_w", F.lit(1)), [], "c", "_w").join(F.broadcast(one.select("paired_articles")), how="cross")  # one row
    lower, upper = F.floor((F.col("paired_articles") + 1) / 2), F.floor(F.col("paired_articles") / 2) + 1
    middle = run.agg(F.min(F.when(F.col("upto") >= lower, F.col("c"))).alias("a"), F.min(F.when(F.col("upto") >= upper, F.col("c"))).alias("b"))
    return one.join(F.broadcast(middle), how="cross").select("paired_articles", "mean_cosine", ((F.col("a") + F.col("b")) / 2).alias("median_cosine"))


def self_retrieval_ranks(queries: DataFrame, chunks: DataFrame, index=None) -> DataFrame:
    """(article_id, rank) of every article among all articles by its best chunk; ties by article id, descending.

    Only the article's own best score is needed to rank it: it is the floor from which better articles are
    counted.  ``index``: a saved index of chunk_units(chunks).
    """
    from ..operators.vector_rank import better_articles
    return better_articles(queries, chunks, index)


def embedding_alignment(raw: DataFrame, learned: DataFrame, chunks: DataFrame, index=None) -> DataFrame:
    """Two rows (space raw and learned): paired cosines of the spaces and the self-retrieval of each."""
    pairs = cosine_summary(raw, learned)
    spaces = {"raw": raw.withColumnRenamed("embedding", "vector"), "learned": learned.withColumnRenamed("learned_embedding", "vector")}
    out = None
    for name, q in spaces.items():
        row = retrieval_metrics(self_retrieval_ranks(q, chunks, index)).select(F.lit(name).alias("space"), F.col("n").alias("ranked"), "top1", "top5", "mrr")
        out = row if out is None else out.unionByName(row)
    return out.join(F.broadcast(pairs), how="cross")  # one row


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("n"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"),
                     F.avg((F.col("rank") <= 5).cast("double")).alias("top5"), F.avg(1.0 / F.col("rank")).alias("mrr"))


def mixed_profile_replay(samples: DataFrame, raw: DataFrame, learned: DataFrame, use_mixed: bool, k: int = 3, dim: int = 64) -> DataFrame:
    """Replay with the raw space, or with learned vectors preferred in the profile (the older behaviour)."""
    if use_mixed:
        space = raw.join(learned, "article_id", "full_outer").select("article_id", F.coalesce("learned_embedding", "embedding").alias("embedding"))
        table = raw.select("article_id", "embedding", F.lit(B.SHOWN).alias("_use")).unionByName(space.withColumn("_use", F.lit(B.READ)))
    else:
        table = raw.withColumn("_use", F.lit(B.BOTH))
    rows = B.scored_candidates(samples, table, [], skip_unknown=False).where("whole and has_profile")
    score = F.round("cosine", 9)
    w = W.partitionBy("sample_id").orderBy(score.desc(), F.col("article_id").desc())
    ranked = rows.select("sample_id", "cpos", F.row_number().over(w).alias("rank"), F.lit("mixed" if use_mixed else "raw").alias("strategy"))
    return ranking_metrics(ranked, k)


# ---- trainer input and metrics ---------------------------------------------------------------

def training_batch_export(samples: DataFrame, history_size: int = K.HISTORY_SIZE) -> DataFrame:
    """Padded reads with a mask, candidates and label 0, ready for a writer."""
    h = F.slice("history", F.greatest(F.size("history") - history_size + 1, F.lit(1)), history_size)
    pad = F.lit(history_size) - F.size(h)
    return samples.select("sample_id", F.concat(h, F.array_repeat(F.lit("").cast("string"), pad)).alias("history"),
                          F.concat(F.array_repeat(F.lit(1), F.size(h)), F.array_repeat(F.lit(0), pad)).alias("history_mask"),
                          F.concat(F.array("positive"), "negatives").alias("candidates"), F.lit(0).alias("label"))


def pairwise_auc_recall(scored: DataFrame, k: int = 10) -> DataFrame:
    """Share of negatives strictly below the positive, and recall at k.  ``scored``: sample_id, cpos, score."""
    per = scored.groupBy("sample_id").agg(F.max(F.when(F.col("cpos") == 0, F.col("score"))).alias("p"),
                                          F.collect_list(F.when(F.col("cpos") > 0, F.col("score"))).alias("n"))
    below = F.size(F.filter("n", lambda x: x < F.col("p")))
    above = F.size(F.filter("n", lambda x: x > F.col("p")))
    return per.agg((F.sum(below) / F.sum(F.size("n"))).alias("auc"), F.avg((above < k).cast("double")).alias("recall_at_k"))


def db_readiness(samples: DataFrame, articles: DataFrame, vectors: DataFrame, enough: int = 100) -> DataFrame:
    n = samples.agg(F.count("*").alias("replay_samples"), F.lit(1).alias("_o"))
    have = articles.select("article_id").join(vectors.select("article_id", F.lit(1).alias("v")).distinct(), "article_id", "left").agg(
        F.count("*").alias("articles"), F.count("v").alias("articles_with_vector"), F.lit(1).alias("_o"))
    return n.join(have, "_o").select("replay_samples", "articles", "articles_with_vector",
                                     (F.col("articles_with_vector") / F.col("articles")).alias("coverage"),
                                     (F.col("replay_samples") >= enough).cast("int").alias("enough_for_initial_conclusion"))
