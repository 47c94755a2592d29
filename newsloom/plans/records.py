"""Queries over captured candidates, verification tiers, label audits and stored reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from newsloom.operators import learning as L, matching as M, records as R, review, search as Q, similarity as S
from newsloom.operators.coverage import finite
from newsloom.plans import views as V
from newsloom.plans.review import _dropped
from newsloom.plans.similarity import _j, _list, _tok
from newsloom.session import shared_dir, stage, table
from newsloom.sources import tables as IO
from newsloom.streaming import feeds


def _one(g, **cols):
    return g.select(*[c.alias(k) for k, c in cols.items()])


def _rate(a, b, digits: int = 6):
    return F.round(F.when(b > 0, a / b).otherwise(0.0), digits)


def report(spark, d):
    """Mean outcome of mature rows overall, per source and per category."""
    x = V.learning(spark, d).where("mature and outcome is not null")
    g = x.groupingSets([[], ["source"], ["category"]], "source", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("outcome"), 6).alias("mean_outcome"), F.grouping_id().alias("gid"))
    return g.select(F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "source").otherwise("category").alias("dimension"), F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, F.col("source")).otherwise(F.col("category")).alias("value"), "n", "mean_outcome")


def label_audit(spark, d):
    x = V.learning(spark, d)
    g = x.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("mature").alias("mature_rows"), F.count_if(~F.col("mature")).alias("provisional_rows"), F.count_if(F.expr("mature and selected")).alias("selected_mature_rows"))
    return g.withColumn("coverage", _rate(F.col("mature_rows"), F.col("total_rows")))


def diagnosis(spark, d):
    """Balance of labels, and how selection and a score of 50 agree with them."""
    n = lambda c: F.count_if(F.expr(c))
    g = V.learning(spark, d).agg(F.count("outcome").alias("n"), n("selected and outcome is not null").alias("s"), n("outcome >= 0.5").alias("p"), n("selected and outcome >= 0.5").alias("sp"), n("score >= 50 and outcome is not null").alias("h"), n("score >= 50 and outcome >= 0.5").alias("hp"), F.count(F.lit(1)).alias("all"))
    c = F.col
    return _one(g, samples=c("n"), positive_rate=_rate(c("p"), c("n")), selection_rate=_rate(c("s"), c("n")), selected_hit_rate=_rate(c("sp"), c("s")), score50_precision=_rate(c("hp"), c("h")), score50_recall=_rate(c("hp"), c("p")), label_coverage=_rate(c("n"), c("all")))


def snapshot(spark, d):
    """Hits and false positives (outcome 0) among selected mature rows."""
    n = lambda c: F.count_if(F.expr(c))
    g = V.learning(spark, d).where("mature and outcome is not null").agg(F.count(F.lit(1)).alias("n"), n("selected").alias("s"), n("selected and outcome >= 0.5").alias("h"), n("selected and outcome = 0").alias("f"), F.avg("outcome").alias("m"))
    c = F.col
    return _one(g, samples=c("n"), selected=c("s"), hit_rate=_rate(c("h"), c("s")), false_positive_rate=_rate(c("f"), c("s")), avg_outcome=F.round("m", 6))


def confidence(spark, d):
    """Raw and learned scores: means, how many are at least 80, how many below 60."""
    x = V.learning(spark, d)
    return L.adjusted(x, L.profile(x)).agg(F.count(F.lit(1)).alias("stories"), F.round(F.avg("score"), 4).alias("avg_raw"), F.round(F.avg("adjusted"), 4).alias("avg_calibrated"), F.count_if(F.col("adjusted") >= 80).alias("high_confidence"), F.count_if(F.col("adjusted") < 60).alias("low_confidence"))


def tiered(spark, d):
    return R.tiers(table(spark, d, "news_events"), table(spark, d, "event_sources").select("event_id", "source"), "event_id", "source")


def quality(spark, d):
    g = tiered(spark, d).agg(F.count(F.lit(1)).alias("stories"), F.count_if(F.col("tier") != "unverified").alias("verified"), F.count_if(F.col("tier") == "multi-source").alias("strong"), F.round(F.avg(finite(F.col("importance"))), 6).alias("avg_importance"))
    return g.withColumns({"verification_rate": _rate(F.col("verified"), F.col("stories")), "strong_rate": _rate(F.col("strong"), F.col("stories"))})


def evidence(spark, d):
    """Events of each tier: how many, with how many independent sources, and how many lack a region or headline."""
    x = tiered(spark, d)
    gap = (F.trim(F.coalesce("headline", F.lit(""))) == "") | F.col("region").isNull() | (F.col("independent") == 0)
    return x.groupBy("tier").agg(F.count(F.lit(1)).alias("stories"), F.sum("independent").alias("independent_sources"), F.count_if(gap).alias("with_gaps"))


def source_reliability(spark, d):
    """Of each source (case and outer blanks aside) its events, those of several sources, and those of importance 75 or more."""
    s = table(spark, d, "event_sources").where("event_id is not null").select("event_id", F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source")).where("source is not null").distinct()
    x = s.join(tiered(spark, d).select("event_id", "tier", "importance"), "event_id")
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("tier") == "multi-source").alias("verified"), F.count_if(finite(F.col("importance")) >= 75).alias("high_impact"))


def daily(spark, d):
    """Events opened each day beside the day before: counts and the change of those in the commonest kind of region."""
    x = table(spark, d, "news_events").where("first_seen is not null").groupBy("first_seen").agg(F.count(F.lit(1)).alias("n"), F.count("region").alias("with_region"))
    before = x.select(F.date_add("first_seen", 1).alias("first_seen"), F.col("n").alias("n0"), F.col("with_region").alias("r0"))
    x = x.join(before, "first_seen", "left")
    return x.select(F.col("first_seen").cast("string").alias("day"), "n", F.coalesce("n0", F.lit(0)).alias("yesterday"), (F.col("with_region") - F.coalesce("r0", F.lit(0))).alias("region_delta"))


def provenance(spark, d):
    """State of each text field of a feed row, and the first one that holds text."""
    fields = ["summary", "title", "source", "published"]
    x = table(spark, d, "article_feed").select("feed_pos", *fields)
    state = [R.field_state(F.col(c)).alias(f"{c}_state") for c in fields]
    first = F.coalesce(*[F.when(R.field_state(F.col(c)) == "present", c) for c in fields])
    return x.select("feed_pos", *state, first.alias("selected_field"))


def candidates(spark, d):
    x = table(spark, d, "article_feed").select("feed_pos", "title", "source", "url", "published", "summary", "category")
    return x.withColumn("candidate_id", R.candidate_id(F.col("url"), F.col("source"), F.col("title"), F.col("published"), F.col("feed_pos")))


def capture(spark, d):
    """Candidates of the feed, the first row of each id, and whether the accepted articles include them."""
    x = candidates(spark, d).groupBy("candidate_id").agg(F.min("feed_pos").alias("feed_pos"), F.min_by("url", "feed_pos").alias("url"))
    known = table(spark, d, "articles").where("url is not null").select("url").distinct().withColumn("hit", F.lit(True))
    return x.join(known, "url", "left").select("candidate_id", "feed_pos", F.when(F.col("hit"), "included").otherwise("excluded").alias("disposition"))


def capture_audit(spark, d):
    """Each batch as a captured run: candidates, already known ones, incomplete ones, missing fields and its state."""
    x = table(spark, d, "incoming_articles")
    known = table(spark, d, "articles").where("url is not null").select("url").distinct().withColumn("hit", F.lit(True))
    x = x.join(known, "url", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    g = x.groupBy("batch_no").agg(F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("included"), F.count_if(blank("source") | blank("url") | blank("headline") | blank("date")).alias("incomplete"), *[F.count_if(blank(c)).alias(f"no_{c}") for c in ("source", "url", "headline", "date")])
    return g.withColumn("status", F.when(F.col("incomplete") > 0, "needs_attention").otherwise("reviewed"))


def labelled(spark, d):
    """Orders as stories with the label of their last line, and the state each line's label leaves them in."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("story"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("label"))
    new = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("story"), F.col("l_linenumber").cast("int").alias("at"), F.col("l_returnflag").alias("label"))
    g = base.unionAll(new).groupBy("story").agg(F.max_by("label", F.struct("at", "label")).alias("label"), F.count("label").alias("edits"))
    return g.groupBy(F.coalesce("label", F.lit("pending")).alias("label")).agg(F.count(F.lit(1)).alias("stories"), F.sum("edits").alias("edits"))


def adjudicated(spark, d):
    """One row: precision counts of candidates (parts) with one ship mode and one adjudicated label, the others left out by reason."""
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("c"), F.col("l_linestatus").alias("disposition"), F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    g = x.groupBy("c").agg(F.countDistinct("disposition").alias("nd"), F.min("disposition").alias("disposition"), F.min_by("label", F.struct("o", "n")).alias("label"))
    ok = (F.col("nd") == 1) & F.col("label").isin("A", "N")
    inc, rel = F.col("disposition") == "F", F.col("label") == "A"
    return g.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("nd") > 1).alias("conflicting"), F.count_if(F.col("label") == "R").alias("uncertain"), F.count_if(ok).alias("eligible"), F.count_if(ok & inc & rel).alias("tp"), F.count_if(ok & inc & ~rel).alias("fp"), F.count_if(ok & ~inc & rel).alias("fn"))


def bundle(spark, d):
    """Digest of each evaluation item and of the bundle of all (a fixed table), in the order of their ids."""
    x = table(spark, d, "eval_items").select("item_id", F.sha2(F.coalesce("item_text", F.lit("")), 256).alias("digest"))
    whole = x.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "digest"))), lambda s: s["digest"]), ":"), 256).alias("bundle"))
    return x.crossJoin(F.broadcast(whole))  # one row


def chain(spark, d):
    """A history of days, some of whose entries do not follow the one before or name a run again, and what the audit says of them."""
    x = V.runs(spark, d).groupBy("run_date").agg(F.count(F.lit(1)).alias("n"))
    x = x.select(F.col("run_date").cast("string").alias("day"), F.sha2(F.concat_ws(":", F.col("run_date").cast("string"), F.col("n").cast("string")), 256).alias("digest"))
    first = F.dayofmonth("day")
    before = F.coalesce(F.lag("digest").over(W.orderBy("day")), F.lit("GENESIS"))  # a row a day
    x = x.select("day", "digest", F.when(first == 7, "tampered").otherwise(before).alias("previous"), F.when(first == 9, F.lit("again")).otherwise(F.col("day")).alias("run"))
    return review.chain_audit(x, "day", "digest", "previous", "run")


def syndicated(spark, d):
    """Of each event's accepted reports, in their order, those that copy an earlier one that stays: rows, copies and rows left."""
    from newsloom.operators.folds import first_wins

    x = table(spark, d, "articles").where("event_id is not null").select("row_id", "event_id", M.stopped(F.col("headline")).alias("tokens"))
    pairs = S.self_join(x, "row_id", 0.78, ["event_id"])
    sets = lambda c: x.select(F.col("row_id").alias(f"id_{c}"), F.col("tokens").alias(f"t_{c}"))
    pairs = pairs.join(sets("a"), "id_a").join(sets("b"), "id_b").where("size(array_intersect(t_a, t_b)) >= 6").select("id_a", "id_b")
    kept = first_wins(x.select("row_id"), stage(pairs, "ev18-pairs"), "row_id")
    return x.select("row_id", "event_id").join(kept, "row_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("evidence_rows"), F.count_if(~F.col("kept")).alias("copies"), F.count_if("kept").alias("retained"))


def readiness(spark, d):
    """Documents of each kind: how many hold what an evaluation needs, and what blocks it."""
    x = table(spark, d, "documents")
    g = x.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"with_{c}") for c in ("text", "lang", "source", "event_id")])
    lacks = [F.when(F.col(f"with_{c}") < 0.9 * F.col("n"), f"{c}_missing") for c in ("lang", "source", "event_id")]
    return g.withColumn("blockers", F.array_join(F.array_compact(F.array(*lacks)), ","))


def packets(spark, d):
    """Two reviewers' labels of the same order (its first and second line): how often each pair of labels occurs."""
    x = table(spark, d, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_returnflag"))).alias("first"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_returnflag"))).alias("second"))
    return x.groupBy(F.coalesce("first", F.lit("none")).alias("first"), F.coalesce("second", F.lit("none")).alias("second")).agg(F.count(F.lit(1)).alias("n"))


def contracts(spark, d):
    """Documents held against a contract of required and forbidden words: how many of each language pass."""
    t = F.lower(F.coalesce("text", F.lit("")))
    ok = F.forall(F.array(F.lit("the"), F.lit("of")), lambda w: F.contains(t, w)) & ~F.exists(F.array(F.lit("residents"), F.lit("http")), lambda w: F.contains(t, w))
    g = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"))
    return g.withColumn("pass_rate", _rate(F.col("passed"), F.col("n")))


def merged_evidence(spark, d):
    """Evidence of each queried event: its stored urls first, then the six most similar accepted reports, each url once, eight at most."""
    tok = lambda c: S.token_set(F.col(c), S.WORDS4)
    ev = table(spark, d, "news_events").where("event_no % 50 = 0").select("event_no", "event_id", tok("headline").alias("tokens"))
    old = table(spark, d, "articles").select("row_id", "url", tok("headline").alias("tokens"))
    related = Q.search(ev.select("event_no", "tokens"), old.select("row_id", "tokens"), "event_no", "row_id", 0.0, most=6).join(old.select("row_id", "url"), "row_id").select("event_no", "url", F.lit(1).alias("tier"), F.col("rank").alias("at"))
    stored = ev.join(table(spark, d, "event_sources").where("url is not null and event_id is not null").select("event_id", "url").distinct(), "event_id").withColumn("at", F.row_number().over(W.partitionBy("event_no").orderBy("url"))).where("at <= 8").select("event_no", "url", F.lit(0).alias("tier"), "at")
    x = stored.unionAll(related).groupBy("event_no", "url").agg(F.min(F.struct("tier", "at")).alias("k"))
    r = x.withColumn("rank", F.row_number().over(W.partitionBy("event_no").orderBy("k", "url"))).where("rank <= 8")
    return r.select("event_no", "url", F.col("k.tier").alias("tier"), "rank")


def discovery(spark, d):
    """One row: distinct urls of the incoming rows, and how many of them are evidence of an event."""
    u = table(spark, d, "incoming_articles").where("trim(url) != ''").select("url").distinct()
    hit = table(spark, d, "event_sources").unionByName(table(spark, d, "articles").select("event_id", "source", "url", "date")).where("url is not null and event_id is not null").select("url").distinct().withColumn("hit", F.lit(1))
    g = u.join(hit, "url", "left").agg(F.count(F.lit(1)).alias("articles_found"), F.count("hit").alias("matched_articles"))
    return g.withColumn("match_rate", _rate(F.col("matched_articles"), F.col("articles_found")))


def gaps(spark, d):
    """How many events have each shortcoming."""
    x = tiered(spark, d)
    reports = table(spark, d, "articles").where("event_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("reports"))
    x = x.join(reports, "event_id", "left")
    codes = [F.when(F.col("independent") == 0, "no_evidence"), F.when(F.col("independent") == 1, "single_source"), F.when(F.col("reports").isNull(), "no_accepted_report"), F.when(F.col("region").isNull(), "no_region"), F.when(F.col("importance").isNull() | F.isnan("importance"), "no_importance")]
    return x.select(F.explode(F.array_compact(F.array(*codes))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("events"))


def walk_forward(spark, d):
    """Half-yearly folds after the first year: the threshold of best f1 on all days before (ties: the lower), judged on the fold."""
    return L.rolling_backtest(V.learning(spark, d).where("mature"), [float(t) for t in range(50, 90, 5)], 365, 180, low=True)


def strategies(spark, d):
    """One row: mean f1 and stability of the walk-forward thresholds."""
    return walk_forward(spark, d).agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("test_f1"), 5).alias("f1"), F.round(F.greatest(F.lit(0.0), 1 - F.stddev_pop("test_f1")), 5).alias("stability"))


def drift_windows(spark, d, current: int = 30, baseline: int = 180):
    """One row: the last days and the days before them as two calendar windows, and the rows in each."""
    x = V.learning(spark, d)
    last = x.agg(F.max("run_date").alias("last"))
    x = x.crossJoin(F.broadcast(last))  # one row
    now, before = F.col("run_date") > F.date_sub("last", current), (F.col("run_date") <= F.date_sub("last", current)) & (F.col("run_date") > F.date_sub("last", current + baseline))
    g = x.agg(F.max("last").alias("last"), F.count_if(now).alias("current_rows"), F.count_if(before).alias("baseline_rows"))
    ok = (F.col("current_rows") >= 20) & (F.col("baseline_rows") >= 20)
    return g.select("current_rows", "baseline_rows", F.date_sub("last", current - 1).cast("string").alias("current_start"), F.date_sub("last", current + baseline - 1).cast("string").alias("baseline_start"), F.when(ok, "non_overlapping_calendar_windows").otherwise("insufficient_data").alias("method"))


def composite(spark, d):
    """One row: weights and threshold of the composite of score, source rate and category rate that do best (F1.5, then f1) on the last fifth of the training days, judged on the days after them."""
    x = V.learning(spark, d).where("mature and outcome is not null and score is not null")
    days = x.select("run_date").distinct().withColumn("share", F.percent_rank().over(W.orderBy("run_date")))  # a row a day
    x = x.join(days, "run_date").select("source", "category", (F.least(F.lit(100.0), F.greatest(F.lit(0.0), "score")) / 100).alias("base"), (F.col("outcome") >= 0.5).alias("y"), F.when(F.col("share") < 0.56, "fit").when(F.col("share") < 0.7, "valid").otherwise("test").alias("part"))
    x = stage(x, "wn5-rows")

    def scored(rates_on, rows):
        whole = rates_on.agg(F.avg(F.col("y").cast("double")).alias("whole"))
        for c in ("source", "category"):
            r = rates_on.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("p")).crossJoin(F.broadcast(whole)).select(c, L.shrunk(F.col("p"), F.col("n"), 6.0, F.col("whole")).alias(f"r_{c}"))  # one row
            rows = rows.join(r, c, "left")
        rows = rows.crossJoin(F.broadcast(whole))  # one row
        grid = [(b / 10, s / 10, round(1 - b / 10 - s / 10, 1)) for b in (5, 6, 7, 8) for s in (1, 2, 3) if 10 - b - s >= 1]
        w = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for n, v in zip(("a", "b", "c"), g)]) for k, g in enumerate(grid)]))
        rows = rows.withColumn("w", w).withColumn("value", F.round(F.col("w.a") * F.col("base") + F.col("w.b") * F.coalesce("r_source", "whole") + F.col("w.c") * F.coalesce("r_category", "whole"), 9))
        cells = rows.groupBy("w", F.least(F.floor(F.col("value") * 20 + 1e-9), F.lit(16)).alias("step")).agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
        t = cells.withColumn("t", F.explode(F.sequence(F.lit(9), F.lit(16))))
        over = F.col("step") >= F.col("t")
        g = t.groupBy("w", "t").agg(F.sum(F.when(over, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~over, F.col("p")).otherwise(0)).alias("fn"))
        p, r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
        return g.withColumns({"p": F.round(p, 6), "r": F.round(r, 6), "f1": F.round(2 * p * r / F.greatest(F.lit(1e-9), p + r), 6), "fb": F.round(3.25 * p * r / F.greatest(F.lit(1e-9), 2.25 * p + r), 6)})

    best = scored(x.where("part = 'fit'"), x.where("part = 'valid'")).orderBy(F.desc("fb"), F.desc("f1"), F.desc("p"), F.desc("r"), "w.k", "t").limit(1).select(F.col("w.k").alias("bk"), F.col("t").alias("bt"), F.col("fb").alias("validation_f15"))
    test = scored(x.where("part != 'test'"), x.where("part = 'test'")).crossJoin(F.broadcast(best)).where("w.k = bk and t = bt")  # one row
    return test.select(F.col("w.a").alias("w_score"), F.col("w.b").alias("w_source"), F.col("w.c").alias("w_category"), (F.col("t") / 20).alias("threshold"), "validation_f15", F.col("p").alias("precision"), F.col("r").alias("recall"), "f1")


def due_labels(spark, d):
    """Each day's sightings and how many of them have their label of 1, 2 and 7 days later (a label is given once, when its day has come)."""
    x = L.horizon_labels(V.runs(spark, d), [1, 2, 7])
    return x.groupBy(F.col("run_date").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("n"), *[F.count(f"seen_{h}d").alias(f"due_{h}d") for h in (1, 2, 7)])


def fresh_stream(spark, d):
    """Events of the stream between 72 hours before and 6 hours after the middle of the stored times, by type."""
    as_of = table(spark, d, "events").agg(F.max("ts").alias("m")).first().m
    x = feeds.events(spark, f"{d}/events.parquet")
    x = x.where(R.recent(F.col("ts"), F.lit(as_of).cast("timestamp"), 24 * 30, 6)).select("event_id", "event_type")
    return feeds.run_once(x, "sm1", "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def collected(spark, d, per_source: int = 30, most: int = 700):
    """One row: the first rows of each source in feed order, the first of each url, as many as a collection takes, and what was left out."""
    x = table(spark, d, "article_feed").where("trim(title) != '' and trim(url) != ''").select("feed_pos", F.coalesce("source", F.lit("")).alias("source"), "url")
    x = x.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("feed_pos"))).where(F.col("k") <= per_source)
    g = x.groupBy("url").agg(F.min("feed_pos").alias("feed_pos"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("scanned"), F.count(F.lit(1)).alias("unique"), (F.sum("n") - F.count(F.lit(1))).alias("exact_duplicates"), F.least(F.count(F.lit(1)), F.lit(most)).alias("taken"))


def feed_limit(spark, d):
    """News events written as a landed feed file and read back, the first 30 entries with a title and a link."""
    path = f"{shared_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    x = table(spark, d, "news_events").where("headline is not null").orderBy("event_no").select(F.col("headline").alias("title"), F.concat(F.lit("https://feed.example/"), F.col("event_no").cast("string")).alias("link"))
    x.coalesce(1).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return IO.read_feed(spark, path, limit=30).select("title", "link")


def discovered(spark, d):
    """Incoming rows by what a discovery does with them: without url or headline, known url, without or with an old date, or taken."""
    x = table(spark, d, "incoming_articles")
    known = table(spark, d, "articles").where("url is not null").select("url").distinct().withColumn("hit", F.lit(True))
    as_of = x.agg(F.max(F.to_timestamp(F.substring("date", 1, 10))).alias("as_of"))
    x = x.join(known, "url", "left").crossJoin(F.broadcast(as_of))  # one row
    at = F.try_to_timestamp(F.substring("date", 1, 10))
    why = F.when((F.trim(F.coalesce("url", F.lit(""))) == "") | (F.trim(F.coalesce("headline", F.lit(""))) == ""), "incomplete").when(F.col("hit"), "known_url").when(at.isNull(), "undated").when(~R.recent(at, F.col("as_of"), 24 * 60), "stale").otherwise("taken")
    return x.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def snapshots(spark, d):
    """Events stored as snapshots by category, one of them read back."""
    path = f"{shared_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    x = table(spark, d, "news_events").select("event_no", "event_id", "headline", "category")
    x.write.partitionBy("category").parquet(path)
    return spark.read.schema(x.schema).parquet(path).where(F.col("category") == x.agg(F.min("category")).first()[0]).select("event_no", "event_id", "headline", "category")


def appended(spark, d):
    """Events appended twice by key, the second time with the later half already there, and how many rows each append added."""
    path = f"{shared_dir(spark).rstrip('/')}/append-{uuid.uuid4().hex}"
    x = table(spark, d, "news_events").select("event_id", "event_no")
    n = x.count()
    one = IO.append_absent(x.where("event_no % 2 = 0"), path, ["event_id"])
    two = IO.append_absent(x, path, ["event_id"])
    return IO.read_table(spark, path, "event_id STRING, event_no BIGINT").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("keys")).select("rows", "keys", F.lit(one).cast("bigint").alias("first"), F.lit(two).cast("bigint").alias("second"), F.lit(n).cast("bigint").alias("given"))


def replaced(spark, d):
    """Batches stored by number, one of them replaced by its rows with a url; the others stay."""
    path = f"{shared_dir(spark).rstrip('/')}/replace-{uuid.uuid4().hex}"
    x = table(spark, d, "incoming_articles").select("row_id", "url", "batch_no")
    x.write.partitionBy("batch_no").parquet(path)
    IO.replace_partitions(x.where("batch_no = 3 and row_id % 2 = 0"), path, "batch_no")
    return spark.read.schema(x.schema).parquet(path).groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))


def repaired(spark, d):
    """News events read by another schema: numbers from text, an absent column null, what cannot be read null."""
    return IO.reconciled(table(spark, d, "news_events"), "event_no STRING, source_count INT, headline INT, absent DATE")


def issues(spark, d):
    found = IO.schema_issues(table(spark, d, "news_events"), "event_no BIGINT, source_count BIGINT, absent DATE")
    return spark.createDataFrame([(i,) for i in sorted(found)], "issue string")


def ensured(spark, d):
    """Tables that should be there, made empty where they are not."""
    base = f"{shared_dir(spark).rstrip('/')}/ensure-{uuid.uuid4().hex}"
    return IO.read_csv(spark, f"{base}/none.csv", "event_id STRING, n INT").agg(F.count(F.lit(1)).alias("rows"))


def stats_json(spark, d):
    """One JSON text of the counts of the stored tables."""
    n = {t: table(spark, d, t).agg(F.count(F.lit(1)).alias(t)) for t in ("articles", "incoming_articles", "news_events")}
    x = n["articles"].crossJoin(n["incoming_articles"]).crossJoin(n["news_events"])  # one row each
    return x.select(F.to_json(F.struct("articles", "incoming_articles", "news_events")).alias("snapshot"))


def run_records(spark, d):
    """Each batch written as one run's JSON records, and a run read back."""
    path = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    table(spark, d, "incoming_articles").select("row_id", "headline", "batch_no").write.partitionBy("batch_no").json(path)
    return spark.read.schema("row_id BIGINT, headline STRING, batch_no INT").json(path).where("batch_no = 4").select("row_id", "headline")


def packet(spark, d, k: int = 25):
    """A blinded packet: of each kind of document the first by a seeded hash, under names that do not tell the id."""
    x = table(spark, d, "documents").select("doc_id", F.coalesce("doc_kind", F.lit("none")).alias("stratum"))
    key = F.sha2(F.concat_ws("|", F.lit("packet-1"), "stratum", F.col("doc_id").cast("string")), 256)
    r = x.withColumn("rank", F.row_number().over(W.partitionBy("stratum").orderBy(key, "doc_id"))).where(F.col("rank") <= k)
    return r.select("stratum", "rank", F.substring(F.sha2(F.concat_ws("|", F.lit("blind"), F.col("doc_id").cast("string")), 256), 1, 16).alias("blinded_id"), "doc_id")


def missing_categories(spark, d):
    """Wanted categories without any event."""
    wanted = spark.createDataFrame([("politics",), ("economy",), ("science",), ("weather",), ("business",), ("sport",)], "category string")
    return wanted.join(table(spark, d, "news_events").select(F.lower("category").alias("category")).distinct(), "category", "left_anti")


def ordered_sources(spark, d):
    """Sources of each event in the order in which they first reported, each once."""
    x = table(spark, d, "event_sources").where("event_id is not null and source is not null and date is not null").groupBy("event_id", "source").agg(F.min("date").alias("at"))
    return x.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda s: s["source"]), " > ").alias("sources"))


def publishers(spark, d):
    """Feed rows of each publisher: hosts that end in a listed domain under its name, other hosts under their own, rows without a host under their label."""
    rules = table(spark, d, "feed_hosts").select(F.regexp_replace("host", r"^(www|news|feeds)\.", "").alias("domain"), F.regexp_replace("host", r"^(www|news|feeds)\.|\.example$", "").alias("name")).distinct()
    return R.canonical_publisher(table(spark, d, "article_feed").select("source", "url"), "source", "url", rules).groupBy("publisher").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "ag3_report": report, "ag4_label_audit": label_audit, "ag6_quality": quality, "ag11_diagnosis": diagnosis, "ag22_confidence": confidence, "ag24_evidence": evidence, "ag29_source_reliability": source_reliability, "ag33_snapshot": snapshot, "ag34_daily": daily,
    "fx3_provenance": provenance, "fx9_candidates": lambda s, d: candidates(s, d).select("feed_pos", "candidate_id"), "fx10_first_text": lambda s, d: table(s, d, "article_feed").select("feed_pos", F.sha2(R.first_text(F.col("summary"), F.col("title")), 256).alias("digest")),
    "fx11_publishers": publishers, "fx16_recent": lambda s, d: recent_rows(s, d), "fx19_fx20_valid": lambda s, d: table(s, d, "article_feed").select("feed_pos", R.aware_timestamp(F.col("published")).alias("aware"), R.http_url(F.col("url")).alias("http")),
    "fx22_sm4_maturity": lambda s, d: V.learning(s, d).groupBy(F.when(F.expr("mature and outcome is not null"), "mature").otherwise("provisional").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events")),
    "fx25_sentences": lambda s, d: table(s, d, "documents").select("doc_id", F.size(R.sentences(F.coalesce("text", F.lit("")))).alias("n")),
    "ev1_capture": capture, "ev2_validity": lambda s, d: R.validity(candidates(s, d), "feed_pos", "candidate_id", ["title", "source", "url", "published", "summary"], "url", "published"), "ev3_capture_audit": capture_audit, "ev6_labels": labelled, "ev9_adjudicated": adjudicated, "ev15_bundle": bundle,
    "ev16_wn12_chain_audit": chain, "ev18_syndicated": syndicated, "ev19_readiness": readiness, "ev20_packets": packets, "ev21_contracts": contracts, "jn9_merged_evidence": merged_evidence, "jn18_discovery": discovery, "jn24_gaps": gaps,
    "wn4_walk_forward": walk_forward, "wn4_strategies": strategies, "wn5_composite": composite, "wn9_drift_windows": drift_windows, "sm1_fresh_stream": fresh_stream, "sm3_due_labels": due_labels, "sc1_feed_limit": feed_limit, "sc2_collected": collected, "sc6_snapshot": snapshots, "sc7_discovered": discovered,
    "sk2_appended": appended, "sk3_replaced": replaced, "sk4_ensured": ensured, "sk5_issues": issues, "sk5_repaired": repaired, "sk8_run_records": run_records, "sk10_stats_json": stats_json, "sr11_packet": packet, "fl8_missing_categories": missing_categories, "st2_ordered_sources": ordered_sources,
}


def recent_rows(spark, d):
    """Incoming rows dated at most 60 days before, or 6 hours after, the latest date."""
    x = table(spark, d, "incoming_articles").select("row_id", F.try_to_timestamp(F.substring("date", 1, 10)).alias("at"))
    return x.crossJoin(F.broadcast(x.agg(F.max("at").alias("as_of")))).select("row_id", R.recent(F.col("at"), F.col("as_of"), 24 * 60).alias("recent"))  # one row


_L = f"WITH {V.LEARNING}"
_FIN = "CASE WHEN importance IS NULL OR isnan(importance) OR isinf(importance) THEN 0 ELSE importance END"
_TIERS = """tiers AS (SELECT e.*, coalesce(s.n, 0) AS independent, CASE WHEN coalesce(s.n, 0) >= 2 THEN 'multi-source' WHEN s.n = 1 THEN 'multi-report' ELSE 'unverified' END AS tier FROM news_events e
  LEFT JOIN (SELECT event_id, count(DISTINCT nullif(lower(trim(source)), '')) AS n FROM event_sources WHERE event_id IS NOT NULL GROUP BY event_id) s ON s.event_id = e.event_id)"""


def _r(a: str, b: str, digits: int = 6) -> str:
    return f"round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END, {digits})"


def _clean(x: str) -> str:
    for k, v in R.ENTITIES.items():
        x = f"replace({x}, '{k}', '" + v.replace("'", "''") + "')"
    return rf"regexp_replace(trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ' ([.,;:!?])', '\1', 'g')"


def _state(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'missing_key' WHEN {_clean(x)} = '' THEN 'blank' ELSE 'present' END"


_CAND = """cand AS (SELECT *, 'candidate-' || substr(sha256(coalesce(nullif(trim(url), ''), coalesce(source, '') || '|' || coalesce(title, '') || '|' || coalesce(published, '') || '|' || feed_pos)), 1, 20) AS candidate_id FROM article_feed)"""
_AWARE = r"coalesce(regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}:?\d{{2}})') AND TRY_CAST(substr({x}, 1, 10) AS DATE) IS NOT NULL, false)"
_HTTP = r"coalesce(regexp_matches({x}, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#\s]+'), false)"
_BLANK = "trim(coalesce({x}, '')) = ''"
_FORWARD = f"""{V.RUNS}, s AS (SELECT DISTINCT run_date, event_key FROM runs_v), m AS (SELECT max(run_date) AS last FROM s)"""
SQL = {
    "ag3_report": f"""{_L} SELECT CASE grouping_id(source, category) WHEN 3 THEN 'all' WHEN 1 THEN 'source' ELSE 'category' END AS dimension, CASE grouping_id(source, category) WHEN 3 THEN 'all' WHEN 1 THEN source ELSE category END AS value, count(*) AS n, round(avg(outcome), 6) AS mean_outcome
  FROM learning_v WHERE mature AND outcome IS NOT NULL GROUP BY GROUPING SETS ((), (source), (category))""",
    "ag4_label_audit": f"{_L} SELECT count(*) AS total_rows, count(*) FILTER (mature) AS mature_rows, count(*) FILTER (NOT mature) AS provisional_rows, count(*) FILTER (mature AND selected) AS selected_mature_rows, {_r('count(*) FILTER (mature)', 'count(*)')} AS coverage FROM learning_v",
    "ag6_quality": f"WITH {_TIERS}, g AS (SELECT count(*) AS stories, count(*) FILTER (tier <> 'unverified') AS verified, count(*) FILTER (tier = 'multi-source') AS strong, round(avg({_FIN}), 6) AS avg_importance FROM tiers) SELECT *, {_r('verified', 'stories')} AS verification_rate, {_r('strong', 'stories')} AS strong_rate FROM g",
    "ag11_diagnosis": f"""{_L}, g AS (SELECT count(outcome) AS n, count(*) FILTER (selected AND outcome IS NOT NULL) AS s, count(*) FILTER (outcome >= 0.5) AS p, count(*) FILTER (selected AND outcome >= 0.5) AS sp, count(*) FILTER (score >= 50 AND outcome IS NOT NULL) AS h, count(*) FILTER (score >= 50 AND outcome >= 0.5) AS hp, count(*) AS a FROM learning_v)
  SELECT n AS samples, {_r('p', 'n')} AS positive_rate, {_r('s', 'n')} AS selection_rate, {_r('sp', 's')} AS selected_hit_rate, {_r('hp', 'h')} AS score50_precision, {_r('hp', 'p')} AS score50_recall, {_r('n', 'a')} AS label_coverage FROM g""",
    "ag22_confidence": f"""{_L}, profile AS (SELECT dimension, value, round(least(1.0, greatest(0.0, (total + 2.0) / (n + 4))), 6) AS reliability FROM (SELECT 'source' AS dimension, source AS value, count(*) AS n, sum(outcome) AS total FROM learning_v WHERE selected AND mature GROUP BY source
  UNION ALL SELECT 'category', category, count(*), sum(outcome) FROM learning_v WHERE selected AND mature GROUP BY category) t),
  adj AS (SELECT l.score, round(least(100.0, greatest(0.0, score + least(4.0, greatest(-4.0, 4.0 * (coalesce(ps.reliability, 0.5) - 0.5) + 4.0 * (coalesce(pc.reliability, 0.5) - 0.5))))), 6) AS adjusted FROM learning_v l LEFT JOIN profile ps ON ps.dimension = 'source' AND ps.value = l.source LEFT JOIN profile pc ON pc.dimension = 'category' AND pc.value = l.category)
  SELECT count(*) AS stories, round(avg(score), 4) AS avg_raw, round(avg(adjusted), 4) AS avg_calibrated, count(*) FILTER (adjusted >= 80) AS high_confidence, count(*) FILTER (adjusted < 60) AS low_confidence FROM adj""",
    "ag24_evidence": f"WITH {_TIERS} SELECT tier, count(*) AS stories, CAST(sum(independent) AS BIGINT) AS independent_sources, count(*) FILTER ({_BLANK.format(x='headline')} OR region IS NULL OR independent = 0) AS with_gaps FROM tiers GROUP BY tier",
    "ag29_source_reliability": f"""WITH {_TIERS}, s AS (SELECT DISTINCT event_id, nullif(lower(trim(source)), '') AS source FROM event_sources WHERE event_id IS NOT NULL AND nullif(lower(trim(source)), '') IS NOT NULL)
  SELECT s.source, count(*) AS events, count(*) FILTER (tier = 'multi-source') AS verified, count(*) FILTER ({_FIN} >= 75) AS high_impact FROM s JOIN tiers USING (event_id) GROUP BY s.source""",
    "ag33_snapshot": f"{_L}, g AS (SELECT count(*) AS n, count(*) FILTER (selected) AS s, count(*) FILTER (selected AND outcome >= 0.5) AS h, count(*) FILTER (selected AND outcome = 0) AS f, avg(outcome) AS m FROM learning_v WHERE mature AND outcome IS NOT NULL) SELECT n AS samples, s AS selected, {_r('h', 's')} AS hit_rate, {_r('f', 's')} AS false_positive_rate, round(m, 6) AS avg_outcome FROM g",
    "ag34_daily": "WITH x AS (SELECT first_seen, count(*) AS n, count(region) AS r FROM news_events WHERE first_seen IS NOT NULL GROUP BY first_seen) SELECT CAST(x.first_seen AS VARCHAR) AS day, x.n, coalesce(b.n, 0) AS yesterday, x.r - coalesce(b.r, 0) AS region_delta FROM x LEFT JOIN x b ON b.first_seen = x.first_seen - 1",
    "fx3_provenance": f"""SELECT feed_pos, {_state('summary')} AS summary_state, {_state('title')} AS title_state, {_state('source')} AS source_state, {_state('published')} AS published_state,
  CASE 'present' WHEN {_state('summary')} THEN 'summary' WHEN {_state('title')} THEN 'title' WHEN {_state('source')} THEN 'source' WHEN {_state('published')} THEN 'published' END AS selected_field FROM article_feed""",
    "fx9_candidates": f"WITH {_CAND} SELECT feed_pos, candidate_id FROM cand",
    "fx10_first_text": f"SELECT feed_pos, sha256(coalesce(nullif({_clean('summary')}, ''), nullif({_clean('title')}, ''), '')) AS digest FROM article_feed",
    "fx11_publishers": r"""WITH r AS (SELECT DISTINCT regexp_replace(host, '^(www|news|feeds)\.', '') AS domain, regexp_replace(regexp_replace(host, '^(www|news|feeds)\.', ''), '\.example$', '') AS name FROM feed_hosts),
  f AS (SELECT feed_pos, source, regexp_replace(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), ''), '^www\.|\.$', '', 'g') AS host FROM article_feed),
  h AS (SELECT f.feed_pos, arg_max(r.name, len(r.domain)) AS name FROM f JOIN r ON f.host = r.domain OR f.host LIKE '%.' || r.domain GROUP BY f.feed_pos)
  SELECT coalesce(h.name, nullif(f.host, ''), nullif(trim(regexp_replace(lower(f.source), '\s+', ' ', 'g')), ''), 'unknown') AS publisher, count(*) AS n FROM f LEFT JOIN h ON h.feed_pos = f.feed_pos GROUP BY 1""",
    "fx16_recent": "WITH x AS (SELECT row_id, TRY_CAST(substr(date, 1, 10) AS TIMESTAMP) AS t FROM incoming_articles) SELECT row_id, coalesce(epoch((SELECT max(t) FROM x)) - epoch(t) BETWEEN -21600 AND 5184000, false) AS recent FROM x",
    "fx19_fx20_valid": f"SELECT feed_pos, {_AWARE.format(x='published')} AS aware, {_HTTP.format(x='url')} AS http FROM article_feed",
    "fx22_sm4_maturity": f"{_L} SELECT CASE WHEN mature AND outcome IS NOT NULL THEN 'mature' ELSE 'provisional' END AS state, count(*) AS n, count(DISTINCT event_id) AS events FROM learning_v GROUP BY 1",
    "fx25_sentences": r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS INTEGER) AS n FROM documents",
    "ev1_capture": f"WITH {_CAND}, f AS (SELECT candidate_id, min(feed_pos) AS feed_pos, arg_min(url, feed_pos) AS url FROM cand GROUP BY candidate_id) SELECT candidate_id, feed_pos, CASE WHEN url IN (SELECT url FROM articles WHERE url IS NOT NULL) THEN 'included' ELSE 'excluded' END AS disposition FROM f",
    "ev2_validity": f"""WITH {_CAND}, v AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY feed_pos) AS k FROM cand), e AS (SELECT feed_pos, concat_ws(',', {', '.join(f"CASE WHEN {_BLANK.format(x=c)} THEN '{c}_required' END" for c in ('title', 'source', 'url', 'published', 'summary'))},
  CASE WHEN k > 1 THEN 'candidate_id_duplicate' END, CASE WHEN NOT {_HTTP.format(x='url')} THEN 'url_invalid' END, CASE WHEN NOT {_AWARE.format(x='published')} THEN 'timestamp_must_be_timezone_aware' END) AS errors FROM v) SELECT * FROM e WHERE errors <> ''""",
    "ev3_capture_audit": f"""SELECT batch_no, count(*) AS candidates, count(*) FILTER (url IN (SELECT url FROM articles WHERE url IS NOT NULL)) AS included, count(*) FILTER ({' OR '.join(_BLANK.format(x=c) for c in ('source', 'url', 'headline', 'date'))}) AS incomplete,
  {', '.join(f"count(*) FILTER ({_BLANK.format(x=c)}) AS no_{c}" for c in ('source', 'url', 'headline', 'date'))}, CASE WHEN count(*) FILTER ({' OR '.join(_BLANK.format(x=c) for c in ('source', 'url', 'headline', 'date'))}) > 0 THEN 'needs_attention' ELSE 'reviewed' END AS status FROM incoming_articles GROUP BY batch_no""",
    "ev6_labels": """WITH l AS (SELECT l_orderkey AS story, arg_max(l_returnflag, struct_pack(a := l_linenumber, b := l_returnflag)) AS label, count(*) AS edits FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS story, NULL AS label, 0 AS edits FROM orders WHERE o_orderkey NOT IN (SELECT story FROM l) UNION ALL SELECT * FROM l)
  SELECT coalesce(label, 'pending') AS label, count(*) AS stories, CAST(sum(edits) AS BIGINT) AS edits FROM a GROUP BY 1""",
    "ev9_adjudicated": """WITH g AS (SELECT l_partkey AS c, count(DISTINCT l_linestatus) AS nd, min(l_linestatus) AS d, arg_min(l_returnflag, struct_pack(o := l_orderkey, n := l_linenumber)) AS label FROM lineitem GROUP BY 1), x AS (SELECT *, nd = 1 AND label IN ('A', 'N') AS ok, d = 'F' AS inc, label = 'A' AS rel FROM g)
  SELECT count(*) AS candidates, count(*) FILTER (nd > 1) AS conflicting, count(*) FILTER (label = 'R') AS uncertain, count(*) FILTER (ok) AS eligible, count(*) FILTER (ok AND inc AND rel) AS tp, count(*) FILTER (ok AND inc AND NOT rel) AS fp, count(*) FILTER (ok AND NOT inc AND rel) AS fn FROM x""",
    "ev15_bundle": "WITH x AS (SELECT item_id, sha256(coalesce(item_text, '')) AS digest FROM eval_items) SELECT item_id, digest, (SELECT sha256(string_agg(digest, ':' ORDER BY item_id, digest)) FROM x) AS bundle FROM x",
    "ev16_wn12_chain_audit": f"""WITH {V.RUNS}, x AS (SELECT CAST(run_date AS VARCHAR) AS day, run_date, sha256(CAST(run_date AS VARCHAR) || ':' || count(*)) AS digest FROM runs_v GROUP BY run_date), y AS (SELECT *, coalesce(lag(digest) OVER (ORDER BY day), 'GENESIS') AS real FROM x),
  z AS (SELECT day, digest, real, CASE WHEN day(run_date) = 7 THEN 'tampered' ELSE real END AS previous, CASE WHEN day(run_date) = 9 THEN 'again' ELSE day END AS run FROM y) SELECT run, previous <> real AS broken_link, count(*) OVER (PARTITION BY run) > 1 AS repeated_run FROM z""",
    "ev18_syndicated": f"""WITH f AS (SELECT row_id AS k, event_id, list_filter({_tok('headline')}, lambda w: NOT list_contains({_list(M.STOP)}, w)) AS w FROM articles WHERE event_id IS NOT NULL),
  p AS (SELECT x.k AS a, y.k AS b FROM f x JOIN f y ON x.event_id = y.event_id AND x.k < y.k WHERE {_j('x.w', 'y.w')} >= 0.78 - 1e-12 AND len(list_intersect(x.w, y.w)) >= 6), {_dropped('p')}
  SELECT event_id, count(*) AS evidence_rows, count(*) FILTER (list_contains((SELECT ids FROM gone), k)) AS copies, count(*) FILTER (NOT list_contains((SELECT ids FROM gone), k)) AS retained FROM f GROUP BY event_id""",
    "ev19_readiness": """WITH g AS (SELECT doc_kind, count(*) AS n, count(text) AS with_text, count(lang) AS with_lang, count(source) AS with_source, count(event_id) AS with_event_id FROM documents GROUP BY doc_kind)
  SELECT *, concat_ws(',', CASE WHEN with_lang < 0.9 * n THEN 'lang_missing' END, CASE WHEN with_source < 0.9 * n THEN 'source_missing' END, CASE WHEN with_event_id < 0.9 * n THEN 'event_id_missing' END) AS blockers FROM g""",
    "ev20_packets": "WITH x AS (SELECT l_orderkey, max(l_returnflag) FILTER (l_linenumber = 1) AS f, max(l_returnflag) FILTER (l_linenumber = 2) AS s FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) SELECT coalesce(f, 'none') AS first, coalesce(s, 'none') AS second, count(*) AS n FROM x GROUP BY 1, 2",
    "ev21_contracts": f"WITH x AS (SELECT coalesce(lang, 'none') AS lang, contains(t, 'the') AND contains(t, 'of') AND NOT (contains(t, 'residents') OR contains(t, 'http')) AS ok FROM (SELECT lang, lower(coalesce(text, '')) AS t FROM documents) d), g AS (SELECT lang, count(*) AS n, count(*) FILTER (ok) AS passed FROM x GROUP BY lang) SELECT *, {_r('passed', 'n')} AS pass_rate FROM g",
    "jn9_merged_evidence": """WITH ev AS (SELECT event_no, event_id, list_distinct(regexp_extract_all(lower(coalesce(headline, '')), '[a-z]{4,}')) AS w FROM news_events WHERE event_no % 50 = 0), a AS (SELECT row_id, url, list_distinct(regexp_extract_all(lower(coalesce(headline, '')), '[a-z]{4,}')) AS v FROM articles),
  p AS (SELECT event_no, url, row_number() OVER (PARTITION BY event_no ORDER BY len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) DESC, row_id) AS pos FROM ev, a WHERE len(list_intersect(w, v)) > 0),
  st AS (SELECT event_no, url, row_number() OVER (PARTITION BY event_no ORDER BY url) AS pos FROM ev JOIN (SELECT DISTINCT event_id, url FROM event_sources WHERE url IS NOT NULL AND event_id IS NOT NULL) s USING (event_id)),
  u AS (SELECT event_no, url, 0 AS tier, pos FROM st WHERE pos <= 8 UNION ALL SELECT event_no, url, 1, pos FROM p WHERE pos <= 6), m AS (SELECT event_no, url, min(struct_pack(tier := tier, pos := pos)) AS k FROM u GROUP BY event_no, url)
  SELECT event_no, url, k.tier AS tier, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY k, url) AS rank FROM m) r WHERE rank <= 8""",
    "jn18_discovery": f"""WITH u AS (SELECT DISTINCT url FROM incoming_articles WHERE trim(url) <> ''), h AS (SELECT url FROM event_sources WHERE url IS NOT NULL AND event_id IS NOT NULL UNION SELECT url FROM articles WHERE url IS NOT NULL AND event_id IS NOT NULL),
  g AS (SELECT count(*) AS articles_found, count(*) FILTER (url IN (SELECT url FROM h)) AS matched_articles FROM u) SELECT *, {_r('matched_articles', 'articles_found')} AS match_rate FROM g""",
    "jn24_gaps": f"""WITH {_TIERS}, c AS (SELECT unnest([CASE WHEN independent = 0 THEN 'no_evidence' END, CASE WHEN independent = 1 THEN 'single_source' END, CASE WHEN event_id NOT IN (SELECT event_id FROM articles WHERE event_id IS NOT NULL) THEN 'no_accepted_report' END, CASE WHEN region IS NULL THEN 'no_region' END,
  CASE WHEN importance IS NULL OR isnan(importance) THEN 'no_importance' END]) AS code FROM tiers) SELECT code, count(*) AS events FROM c WHERE code IS NOT NULL GROUP BY code""",
    "wn9_drift_windows": f"""{_L}, m AS (SELECT max(run_date) AS last FROM learning_v), g AS (SELECT count(*) FILTER (run_date > last - 30) AS current_rows, count(*) FILTER (run_date <= last - 30 AND run_date > last - 210) AS baseline_rows, max(last) AS last FROM learning_v, m)
  SELECT current_rows, baseline_rows, CAST(last - 29 AS VARCHAR) AS current_start, CAST(last - 209 AS VARCHAR) AS baseline_start, CASE WHEN current_rows >= 20 AND baseline_rows >= 20 THEN 'non_overlapping_calendar_windows' ELSE 'insufficient_data' END AS method FROM g""",
    "sm1_fresh_stream": "WITH m AS (SELECT max(ts) AS last FROM events) SELECT event_type, count(*) AS n FROM events, m WHERE floor(epoch(last)) - floor(epoch(ts)) BETWEEN -21600 AND 2592000 GROUP BY event_type",
    "sm3_due_labels": f"WITH {_FORWARD} SELECT CAST(run_date AS VARCHAR) AS run_date, count(*) AS n, count(*) FILTER (run_date + 1 <= last) AS due_1d, count(*) FILTER (run_date + 2 <= last) AS due_2d, count(*) FILTER (run_date + 7 <= last) AS due_7d FROM s, m GROUP BY run_date",
    "sc1_feed_limit": "SELECT headline AS title, 'https://feed.example/' || event_no AS link FROM news_events WHERE trim(headline) <> '' ORDER BY event_no LIMIT 30",
    "sc2_collected": """WITH x AS (SELECT url, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY feed_pos) AS k FROM article_feed WHERE trim(title) <> '' AND trim(url) <> ''), g AS (SELECT url, count(*) AS n FROM x WHERE k <= 30 GROUP BY url)
  SELECT CAST(sum(n) AS BIGINT) AS scanned, count(*) AS "unique", CAST(sum(n) - count(*) AS BIGINT) AS exact_duplicates, least(count(*), 700) AS taken FROM g""",
    "sc6_snapshot": "SELECT event_no, event_id, headline, category FROM news_events WHERE category = (SELECT min(category) FROM news_events)",
    "sc7_discovered": f"""WITH x AS (SELECT *, TRY_CAST(substr(date, 1, 10) AS DATE) AS t FROM incoming_articles) SELECT CASE WHEN {_BLANK.format(x='url')} OR {_BLANK.format(x='headline')} THEN 'incomplete' WHEN url IN (SELECT url FROM articles WHERE url IS NOT NULL) THEN 'known_url' WHEN t IS NULL THEN 'undated' WHEN (SELECT max(t) FROM x) - t > 60 THEN 'stale' ELSE 'taken' END AS outcome, count(*) AS n FROM x GROUP BY 1""",
    "sk2_appended": "SELECT count(DISTINCT event_id) AS rows, count(DISTINCT event_id) AS keys, count(DISTINCT event_id) FILTER (event_no % 2 = 0) AS first, count(DISTINCT event_id) - count(DISTINCT event_id) FILTER (event_no % 2 = 0) AS second, count(*) AS given FROM news_events",
    "sk3_replaced": "SELECT batch_no, count(*) FILTER (batch_no <> 3 OR row_id % 2 = 0) AS n FROM incoming_articles GROUP BY batch_no HAVING count(*) FILTER (batch_no <> 3 OR row_id % 2 = 0) > 0",
    "sk4_ensured": "SELECT CAST(0 AS BIGINT) AS rows",
    "sk5_repaired": "SELECT CAST(event_no AS VARCHAR) AS event_no, CAST(source_count AS INTEGER) AS source_count, TRY_CAST(headline AS INTEGER) AS headline, CAST(NULL AS DATE) AS absent FROM news_events",
    "sk5_issues": "SELECT unnest(['extra:category', 'extra:event_id', 'extra:first_seen', 'extra:headline', 'extra:importance', 'extra:last_seen', 'extra:region', 'extra:status', 'missing:absent', 'type:source_count']) AS issue",
    "sk8_run_records": "SELECT row_id, headline FROM incoming_articles WHERE batch_no = 4",
    "sk10_stats_json": "SELECT CAST(json_object('articles', (SELECT count(*) FROM articles), 'incoming_articles', (SELECT count(*) FROM incoming_articles), 'news_events', (SELECT count(*) FROM news_events)) AS VARCHAR) AS snapshot",
    "sr11_packet": """SELECT stratum, CAST(rank AS INTEGER) AS rank, substr(sha256('blind|' || doc_id), 1, 16) AS blinded_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('packet-1|' || stratum || '|' || doc_id), doc_id) AS rank FROM (SELECT doc_id, coalesce(doc_kind, 'none') AS stratum FROM documents) x) t WHERE rank <= 25""",
    "fl8_missing_categories": "SELECT category FROM (SELECT unnest(['politics', 'economy', 'science', 'weather', 'business', 'sport']) AS category) w WHERE category NOT IN (SELECT lower(category) FROM news_events WHERE category IS NOT NULL)",
    "st2_ordered_sources": "SELECT event_id, string_agg(source, ' > ' ORDER BY first, source) AS sources FROM (SELECT event_id, source, min(date) AS first FROM event_sources WHERE event_id IS NOT NULL AND source IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2) x GROUP BY event_id",
}
from newsloom.plans.learning import SQL as _LEARNING_SQL  # noqa: E402

_WALK = _LEARNING_SQL["wn3_rolling_backtest"].replace("[55, 60, 65, 70, 75, 80, 85]", "[50, 55, 60, 65, 70, 75, 80, 85]").replace("train_f1 DESC, threshold DESC", "train_f1 DESC, threshold")
SQL["wn4_walk_forward"] = _WALK
SQL["wn4_strategies"] = f"SELECT count(*) AS folds, round(avg(test_f1), 5) AS f1, round(greatest(0, 1 - stddev_pop(test_f1)), 5) AS stability FROM ({_WALK}) w"
