"""Interaction samples from behaviour logs.

Subjects can be extremely uneven (all guests share one), so the log is cut into blocks by
(subject, time).  A block starts with the state its subject had before: the last 20 reads and the
newest items on show that its positives can ask for.  With that state every block can
be replayed on its own, in one sorted pass.
"""
from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import payload as P, text as T
from ..operators.ordering import positions, ranged
from ..session import write_once

DEDUPE_SECONDS = 30
#: Places of the catalog's hash order that are broadcast to all subjects.
HEAD_PLACES = 4096
_NO_IDS = "cast(array() as array<string>)"


def actions(events: DataFrame, feedback: DataFrame, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(impressions: subject, created_at, ids), (positives: subject, created_at, article_id)."""
    subject = P.subject_key(F.col("user_id"), F.col("session_id")).alias("subject")
    at = F.coalesce("created_at", F.lit("")).alias("created_at")
    seen = events.where("event_type = 'impression'").select("log_id", subject, at, P.impression_ids(F.col("event_data")).alias("ids"))
    clicked = (events.where(F.col("event_type").isin(K.POSITIVE_EVENTS) & (F.col("article_id") != ""))
               .select(subject, at, "article_id"))
    liked = (feedback.where((F.col("feedback_type") == "like") & (F.col("article_id") != ""))
             .select(P.subject_key(F.col("user_id"), F.lit(None).cast("string")).alias("subject"), at, "article_id"))
    positives = clicked.unionByName(liked)
    if allowed is not None:
        ok = allowed.select("article_id").distinct()
        positives = positives.join(ok, "article_id", "left_semi")
        # regrouped per event: an impression holds a handful of items; the outer form keeps Spark from testing the
        # list before it is exploded, which would read the JSON again (an empty list's null joins nothing)
        items = seen.select("log_id", "subject", "created_at", F.posexplode_outer("ids").alias("p", "article_id")).join(ok, "article_id", "left_semi")
        seen = items.groupBy("log_id", "subject", "created_at").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("p", "article_id"))), lambda s: s["article_id"]).alias("ids"))
    return seen.where(F.size("ids") > 0).select("subject", "created_at", "ids"), positives.select("subject", "created_at", "article_id")


def _previous(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, block: str) -> DataFrame:
    """Adds the value of the row before, inside the keys; found per time block, then across blocks."""
    inside = W.partitionBy(*keys, block).orderBy(order)
    r = rows.withColumns({"_in": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
    tails = rows.groupBy(*keys, block).agg(F.max_by(value, order).alias("_tail"))
    carried = tails.withColumn("_carry", F.lag("_tail").over(W.partitionBy(*keys).orderBy(block))).drop("_tail")
    return r.join(carried, [*keys, block]).withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in"))).drop(
        "_in", "_first", "_carry")


def _keep_spaced(seconds: int):
    """Per burst in time order: keep a row when it is more than ``seconds`` after the last kept one."""
    def scan(batches):
        group, last = None, 0.0
        for b in batches:
            keep = []
            for s, a, burst, t in zip(b["subject"], b["article_id"], b["burst"], b["t"]):
                if (s, a, burst) != group:
                    group, last, ok = (s, a, burst), t, True
                else:
                    ok = t - last > seconds
                    last = t if ok else last
                keep.append(ok)
            yield b.loc[keep, ["subject", "article_id", "created_at"]]
    return scan


def kept_positives(positives: DataFrame, seconds: int = DEDUPE_SECONDS) -> DataFrame:
    """Drops repeats of (subject, article) within ``seconds`` of the last kept one.

    A gap above ``seconds`` always starts afresh, so rows fall into independent bursts.  A burst
    no longer than ``seconds`` keeps its first row (an aggregate).  Only longer bursts need the
    sequential scan, which holds one row of state.
    """
    keys = ["subject", "article_id"]
    rows = positives.withColumn("t", (F.unix_micros(T.parse_iso(F.col("created_at"))) / 1e6))
    rows = ranged(rows, [*keys, "created_at"]).withColumnRenamed("_r", "_b")  # a hot pair of subject and article has several ranges
    bad = rows.where("t is null").select("subject", "article_id", "created_at")
    r = _previous(rows, keys, "created_at", F.coalesce("t", F.lit(-1e18)), "prev", "_b")
    starts = F.when(F.col("prev").isNull() | (F.col("t") - F.col("prev") > seconds), F.col("created_at"))
    r = r.where("t is not null").withColumn("_start", starts)
    running = F.max("_start").over(W.partitionBy(*keys, "_b").orderBy("created_at").rangeBetween(W.unboundedPreceding, 0))
    tails = r.groupBy(*keys, "_b").agg(F.max("_start").alias("_tail"))
    before = F.max("_tail").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    carried = tails.select(*keys, "_b", before.alias("_carry"))
    r = r.withColumn("_run", running).join(carried, [*keys, "_b"]).withColumn("burst", F.coalesce("_run", "_carry"))
    r = write_once(r.select("subject", "article_id", "created_at", "t", "burst"))
    bursts = r.groupBy(*keys, "burst").agg((F.max("t") - F.min("t")).alias("span"))
    short = bursts.where(F.col("span") <= seconds).select("subject", "article_id", F.col("burst").alias("created_at"))
    long = (r.join(bursts.where(F.col("span") > seconds).drop("span"), [*keys, "burst"], "left_semi")
            .repartition(*keys, "burst").sortWithinPartitions(*keys, "burst", "t"))
    scanned = long.mapInPandas(_keep_spaced(seconds), "subject string, article_id string, created_at string")
    return short.unionByName(scanned).unionByName(bad)


_ROW = ["subject", "blk", "phase", "created_at", "kind", "ids", "pos", "article_id"]


def _replay(history_size: int, negative_count: int):
    """One block after another: phase 1 rows are the last reads before it, phase 2 rows the items on show at its start."""
    def scan(batches):
        at, recent, shown = None, [], OrderedDict()
        for b in batches:
            out = []
            for subject, blk, phase, when, kind, alive, art in zip(b["subject"], b["blk"], b["phase"], b["created_at"], b["kind"], b["alive"], b["article_id"]):
                if (subject, blk) != at:
                    at, recent, shown = (subject, blk), [], OrderedDict()
                if phase == 1:
                    recent.append(art)
                elif phase == 2:
                    shown[art] = None
                elif kind == 0:
                    for i in alive:
                        shown[i] = None
                        shown.move_to_end(i)
                else:
                    if recent:
                        latest = []
                        for i in reversed(shown):
                            if i != art:
                                latest.append(i)
                                if len(latest) == negative_count:
                                    break
                        if len(latest) == negative_count:
                            out.append((subject, when, art, list(recent), latest))
                    recent = (recent + [art])[-history_size:]
                    shown.pop(art, None)
            yield pd.DataFrame(out, columns=["subject", "event_at", "positive", "history", "negatives"], dtype=object)
    return scan


def temporal_samples(events: DataFrame, feedback: DataFrame, allowed: DataFrame | None = None, history_size: int = K.HISTORY_SIZE,
                     negative_count: int = 4, seconds: int = DEDUPE_SECONDS) -> DataFrame:
    """(subject, event_at, positive, history, negatives): only impressions seen before a positive are
    its negatives, newest first; positives without history or with too few negatives give no sample.

    An item leaves the show with its first read, which is known beforehand: every impression carries only
    the items that have not been read before it, so no task keeps the set of all reads.
    """
    seen, positives = actions(events, feedback, allowed)
    kept = write_once(kept_positives(positives, seconds), "positives")
    first = kept.groupBy("subject", "article_id").agg(F.min("created_at").alias("first_read"))
    items = seen.distinct().select("subject", "created_at", "ids", F.posexplode("ids").alias("p", "article_id")).join(first, ["subject", "article_id"], "left")
    item = F.struct("p", F.col("article_id").alias("a"), F.col("first_read").alias("d"))
    fresh = (items.where("first_read is null or first_read >= created_at").groupBy("subject", "created_at", "ids")
             .agg(F.array_sort(F.collect_list(item)).alias("items")))  # an impression holds a handful of items
    null = F.lit(None).cast("string")
    no_items = F.expr("cast(array() as array<struct<p: int, a: string, d: string>>)")
    rows = fresh.select("subject", "created_at", F.lit(0).alias("kind"), "ids", "items", null.alias("article_id")).unionByName(
        kept.select("subject", "created_at", F.lit(1).alias("kind"), F.expr(_NO_IDS).alias("ids"), no_items.alias("items"), "article_id"))
    keyed = ranged(rows, ["subject", "created_at"]).withColumnRenamed("_r", "blk")
    base = keyed.select("subject", "blk", F.lit(3).alias("phase"), "created_at", "kind", "ids", F.transform("items", lambda x: x["a"]).alias("alive"),
                        F.lit(0).alias("pos"), "article_id")
    state = _entry_state(keyed, history_size, negative_count)
    ordered = base.unionByName(state).repartition("subject", "blk").sortWithinPartitions(*_ROW)
    return ordered.mapInPandas(_replay(history_size, negative_count),
                               "subject string, event_at string, positive string, history array<string>, negatives array<string>")


def pruned(shown: list[tuple], most: int) -> list[tuple]:
    """Of (item, first read) from the newest on, those that can still be among the ``most`` newest later: items
    that are never read stay on show for good, so nothing behind ``most`` of them can come up again."""
    out, lasting = [], 0
    for item in shown:
        if lasting == most:
            break
        out.append(item)
        lasting += item[1] is None
    return out


def _on_show():
    """Fold over the blocks of a subject: the newest unread items at the start of each, as many as it can ask for."""
    def fold(batches):
        at, shown = None, []
        for b in batches:
            out = []
            for subject, blk, opens, asks, most, items in zip(b["subject"], b["blk"], b["opens"], b["asks"], b["most"], b["items"]):
                if subject != at:
                    at, shown = subject, []
                shown = [x for x in shown if x[1] is None or x[1] >= opens]
                out += [(subject, blk, len(shown) - n, a) for n, (a, _) in enumerate(shown[:asks])]
                new = [(x["a"], x["d"]) for x in items]
                again = {a for a, _ in new}
                shown = pruned(new + [x for x in shown if x[0] not in again], most)
            yield pd.DataFrame(out, columns=["subject", "blk", "pos", "article_id"], dtype=object)
    return fold


def _entry_state(keyed: DataFrame, history_size: int, negative_count: int) -> DataFrame:
    """Rows that give every later block of a subject its starting state.

    Only subjects cut by a block border have any: at most one per border.  A block gets history_size
    reads and as many items as its positives can ask for, so the rows are linear in the log.
    """
    span = keyed.groupBy("subject").agg(F.min("blk").alias("lo"), F.max("blk").alias("hi")).where("lo < hi").select("subject")
    part = keyed.join(F.broadcast(span), "subject")  # at most one subject per block border
    blocks = part.groupBy("subject", "blk").agg(F.min("created_at").alias("opens"), (F.sum("kind") + negative_count).cast("int").alias("asks"))
    state = lambda phase, when: [F.lit(phase).alias("phase"), when.alias("created_at"), F.lit(phase).alias("kind"), F.expr(_NO_IDS).alias("ids"), F.expr(_NO_IDS).alias("alive")]

    # the last reads up to the end of each block with reads, then of the nearest such block before
    newest = W.partitionBy("subject", "blk").orderBy(F.col("created_at").desc(), F.col("article_id").desc())
    tails = (part.where("kind = 1").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= history_size)
             .groupBy("subject", "blk").agg(F.array_sort(F.collect_list(F.struct("created_at", "article_id"))).alias("tail")))
    upto = W.partitionBy("subject").orderBy("blk").rowsBetween(-history_size + 1, 0)
    reads = F.flatten(F.collect_list("tail").over(upto))
    tails = tails.withColumn("carry", F.slice(reads, F.greatest(F.size(reads) - history_size + 1, F.lit(1)), F.lit(history_size)))
    before = F.last("carry", ignorenulls=True).over(W.partitionBy("subject").orderBy("blk").rowsBetween(W.unboundedPreceding, -1))
    carried = blocks.select("subject", "blk").join(tails.select("subject", "blk", "carry"), ["subject", "blk"], "left").withColumn("carry", before)
    recent = carried.select("subject", "blk", F.inline("carry")).select(
        "subject", "blk", *state(1, F.col("created_at")), F.lit(0).alias("pos"), "article_id")

    # the newest impression of every item in a block, newest first
    most = blocks.withColumn("most", F.max("asks").over(W.partitionBy("subject")))
    last = (part.where("kind = 0").select("subject", "blk", "created_at", "ids", F.inline("items"))
            .groupBy("subject", "blk", "a").agg(F.max(F.struct("created_at", "ids", "p")).alias("l"), F.first("d").alias("d")))
    lists = last.groupBy("subject", "blk").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("l", "a", "d")))), lambda x: F.struct(x["a"].alias("a"), x["d"].alias("d"))).alias("items"))
    steps = most.join(lists, ["subject", "blk"], "left").withColumn("items", F.coalesce("items", F.expr("cast(array() as array<struct<a: string, d: string>>)")))
    shown = steps.repartition("subject").sortWithinPartitions("subject", "blk").mapInPandas(_on_show(), "subject string, blk int, pos int, article_id string")
    return recent.unionByName(shown.select("subject", "blk", *state(2, F.lit("")), "pos", "article_id"))


def legacy_samples(events: DataFrame, feedback: DataFrame, catalog: DataFrame, history_size: int = K.HISTORY_SIZE,
                   negative_count: int = 4, seed: str = "42") -> DataFrame:
    """(subject, event_at, positive, history, negatives, key): impressions never clicked by the subject, in
    first-seen order, topped up from the catalog in a repeatable hash order.

    As in the original sampler the top-up may repeat one of the impressions.
    """
    subject = F.coalesce(F.when(F.col("user_id") != "", F.col("user_id")), F.when(F.col("session_id") != "", F.col("session_id")), F.lit("guest")).alias("subject")
    at = F.coalesce("created_at", F.lit("")).alias("created_at")
    clicked = events.where(F.col("event_type").isin(K.POSITIVE_EVENTS) & (F.col("article_id") != "")).select(subject, at, "article_id", F.concat(F.lit("e"), "log_id").alias("key"))
    liked = feedback.where((F.col("feedback_type") == "like") & (F.col("article_id") != "")).select(
        F.coalesce("user_id", F.lit("guest")).alias("subject"), at, "article_id", F.concat(F.lit("f"), "feedback_id").alias("key"))
    positives = write_once(clicked.unionByName(liked))
    items = events.where("event_type = 'impression'").select(subject, at, "log_id", F.posexplode(P.impression_ids(F.col("event_data"))).alias("p", "article_id"))
    first_seen = items.groupBy("subject", "article_id").agg(F.min(F.struct("created_at", "log_id", "p")).alias("o"))
    unread = first_seen.join(positives.select("subject", "article_id").distinct(), ["subject", "article_id"], "left_anti")
    firsts = unread.withColumn("_n", F.row_number().over(W.partitionBy("subject").orderBy("o"))).where(F.col("_n") <= negative_count)
    negatives = firsts.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "article_id"))), lambda s: s["article_id"]).alias("neg"))
    return _with_history(positives, negatives, catalog, history_size, negative_count, seed)


def _with_history(positives, negatives, catalog, history_size, negative_count, seed) -> DataFrame:
    # Position of every positive inside its subject, found per time block so that a hot subject is spread.
    ordered = positives.withColumn("ord", F.concat("created_at", F.lit("\u0001"), "key"))
    rows = ranged(ordered, ["subject", "ord"]).withColumnRenamed("_r", "_b")
    inside = W.partitionBy("subject", "_b").orderBy("ord")
    tails = rows.withColumn("_n", F.row_number().over(W.partitionBy("subject", "_b").orderBy(F.col("ord").desc()))).where(F.col("_n") <= history_size)
    tails = tails.groupBy("subject", "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "article_id"))), lambda s: s["article_id"]).alias("tail"),
                                               F.count("*").alias("c"))
    before = W.partitionBy("subject").orderBy("_b").rowsBetween(-history_size, -1)
    carried = tails.select("subject", "_b", F.slice(F.flatten(F.collect_list("tail").over(before)), -history_size, history_size).alias("long"),
                           F.flatten(F.collect_list("tail").over(before)).alias("all"))
    carried = carried.select("subject", "_b", F.when(F.size("all") >= history_size, F.col("long")).otherwise(F.col("all")).alias("carry"))
    local = F.collect_list("article_id").over(inside.rowsBetween(-history_size, -1))
    full = F.concat("carry", local)
    hist = F.when(F.size(full) > history_size, F.slice(full, -history_size, history_size)).otherwise(full)
    s = rows.join(carried, ["subject", "_b"]).withColumn("history", hist).where(F.size("history") > 0).join(negatives, "subject", "left")
    spare = _unread_catalog(rows, negatives, catalog, negative_count, seed)
    s = s.join(spare, "subject", "left")
    neg = F.coalesce("neg", F.expr(_NO_IDS))
    usable = F.filter("spare", lambda x: (x["a"] != F.col("article_id")) & F.coalesce(x["first"] >= F.col("ord"), F.lit(True)))
    extra = F.coalesce(F.transform(usable, lambda x: x["a"]), F.expr(_NO_IDS))
    return s.select("subject", F.col("created_at").alias("event_at"), F.col("article_id").alias("positive"), "history",
                    F.slice(F.concat(neg, extra), 1, negative_count).alias("negatives"), "key")


def _unread_catalog(positives: DataFrame, negatives: DataFrame, catalog: DataFrame, need: int, seed: str) -> DataFrame:
    """(subject, spare: array<struct<h, a, first>>) for subjects short of impressions.

    In the catalog's hash order a subject with m reads finds its first ``need`` + 1 unread articles
    among the first m + need + 1, so the rows built here are linear in the log.  Articles read at some
    time stay in the list with their first read, because they still count before it.
    """
    reads = positives.groupBy("subject", "article_id").agg(F.min("ord").alias("first"))
    short = reads.groupBy("subject").agg(F.count("*").alias("m")).join(negatives.where(F.size("neg") >= need).select("subject"), "subject", "left_anti")
    hashed = catalog.select("article_id").distinct().withColumn("h", F.concat(F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col("article_id")), 256), "article_id"))
    placed = positions(hashed, [], "h", "place").select(F.col("article_id").alias("a"), "h", F.col("place").cast("long").alias("place"))
    asked = short.select("subject", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + need)).alias("place"))
    # every subject asks for the first places: those few rows are broadcast; later ones are asked for by busy subjects only
    placed = write_once(placed, "places")
    near, far = F.col("place") < HEAD_PLACES, F.col("place") >= HEAD_PLACES
    rows = asked.where(near).join(F.broadcast(placed.where(near)), "place").unionByName(asked.where(far).join(placed.where(far), "place"))
    rows = rows.join(reads.withColumnRenamed("article_id", "a"), ["subject", "a"], "left")
    unread = F.sum(F.col("first").isNull().cast("int")).over(W.partitionBy("subject").orderBy("h").rowsBetween(W.unboundedPreceding, -1))
    kept = rows.withColumn("_u", F.coalesce(unread, F.lit(0))).where(F.col("_u") <= need)
    return kept.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("h", "a", "first"))).alias("spare"))
