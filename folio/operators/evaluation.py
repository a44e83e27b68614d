"""Retrieval metrics, slices, resampling, and the abstention gate."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_Q = ["run_id", "query_id"]
HEADLINE = ("recall_1", "recall_3", "recall_5", "rr", "ndcg_10", "ap")


def gold_edges(golden: DataFrame) -> DataFrame:
    return golden.select("qid", F.explode(F.array_distinct("gold_doc_ids")).alias("doc_id")).where("doc_id is not null").distinct()


def retrieval_metrics(doc_hits: DataFrame, golden: DataFrame, by: tuple[str, ...] = tuple(_Q)) -> DataFrame:
    """``doc_hits``: by, doc_id, doc_rank (a document once for each question). One row for each asked
    question with gold documents: recall@1,3,5,10, precision@5, hit@5, rr, ap, ndcg10, first_rank."""
    edges = gold_edges(golden)
    n_gold = edges.groupBy("qid").agg(F.count("*").alias("n_gold"))
    asked = doc_hits.select(*by).distinct().join(n_gold, F.col("query_id") == F.col("qid"))
    found = doc_hits.join(edges.withColumnRenamed("qid", "query_id"), ["query_id", "doc_id"]).select(*by, "doc_rank")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("doc_rank")))
    at = lambda k: F.count_if(F.col("doc_rank") <= k)
    sums = found.groupBy(*by).agg(
        *[at(k).alias(f"g{k}") for k in (1, 3, 5, 10)], F.min("doc_rank").alias("first"), F.sum(F.col("nth") / F.col("doc_rank")).alias("ap"),
        F.sum(F.when(F.col("doc_rank") <= 10, 1 / F.log2(F.col("doc_rank") + 1.0))).alias("dcg"),
    )
    rows = asked.join(sums, list(by), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.select(
        *by, "n_gold", *[F.round(zero(f"g{k}") / F.col("n_gold"), 6).alias(f"recall_{k}") for k in (1, 3, 5, 10)], F.round(zero("g5") / 5, 6).alias("precision_5"), (zero("g5") > 0).cast("int").alias("hit_5"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(zero("ap") / F.col("n_gold"), 6).alias("ap"), F.round(zero("dcg") / ideal, 6).alias("ndcg_10"), zero("first").cast("int").alias("first_rank"),
    )


def slices(metrics: DataFrame, golden: DataFrame, metric: str = "recall_5") -> DataFrame:
    """Means overall, by retrieval_challenge and by stratum in one pass of grouping sets."""
    rows = metrics.join(golden.select(F.col("qid").alias("query_id"), "retrieval_challenge", "stratum"), "query_id")
    sets = rows.groupingSets([["retrieval_challenge"], ["stratum"], []], "retrieval_challenge", "stratum")
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg(metric), 6).alias("mean"))


def bootstrap(values: DataFrame, key: str, value: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """mean, ci_low, ci_high over ``rounds`` resamples of the rows, by a fixed linear congruence, so any
    engine draws the same. ``values`` must be a table of questions (hundreds of rows), not of hits."""
    numbered = values.select(F.row_number().over(Window.orderBy(key)).alias("i"), F.col(value).alias("v"))
    n = values.select(F.count("*").alias("n"))
    draws = values.sparkSession.range(rounds).withColumnRenamed("id", "b").crossJoin(n).select("b", "n", F.explode(F.expr("sequence(1, cast(n as int))")).alias("d"))
    pick = (F.pmod(F.col("b") * 7919 + F.col("d") * 104729 + F.lit(seed) * 1299709 + F.pmod(F.col("b") * F.col("d"), F.lit(10007)) * 15485863, F.lit(2147483647)) % F.col("n") + 1).cast("int")
    means = draws.withColumn("i", pick).join(numbered, "i").groupBy("b").agg(F.avg("v").alias("m"))
    order = means.withColumn("r", F.row_number().over(Window.orderBy("m", "b")))
    low, high = max(1, int(rounds * 0.025)), max(1, int(rounds * 0.975))
    ci = order.agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("lo"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("hi"))
    return numbered.agg(F.avg("v").alias("m")).crossJoin(ci).select(F.round("m", 6).alias("mean"), F.round("lo", 6).alias("ci_low"), F.round("hi", 6).alias("ci_high"))


def paired_bootstrap(differences: DataFrame, key: str, value: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """``bootstrap`` of the differences of one question each, so that both sides have the same draws, and
    ``significant``: whether the interval leaves out 0."""
    return bootstrap(differences, key, value, rounds, seed).withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def confidence_signals(hits: DataFrame) -> DataFrame:
    """Per question: top_dense, mean_top3, top_sparse, score_gap, n_matched from the ranked hits."""
    top = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    first_terms = F.max(F.when(F.col("rank") == 1, F.size(F.array_distinct("matched_terms"))))
    return hits.groupBy(*_Q).agg(
        top("dense", 1).alias("top_dense"), F.avg(F.when(F.col("rank") <= 3, F.col("dense"))).alias("mean_top3"), top("sparse", 1).alias("top_sparse"),
        (top("score", 1) - top("score", 2)).alias("score_gap"), first_terms.cast("double").alias("n_matched"),
    )


def gate_confidence(signals: DataFrame, gate: DataFrame) -> DataFrame:
    """Weight-normalised sum of z-scores; signals that are null, or have no std or weight, are left out."""
    names = ["top_dense", "mean_top3", "top_sparse", "score_gap", "n_matched"]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("x")) for n in names])).alias("c")
    rows = signals.select(*_Q, cells).select(*_Q, "c.*").join(F.broadcast(gate), "signal", "left")
    good = (F.col("std") > 0) & (F.col("weight") > 0) & F.col("x").isNotNull()
    z = F.when(good, F.col("weight") * (F.col("x") - F.col("mean")) / F.col("std"))
    return rows.groupBy(*_Q).agg(F.try_divide(F.sum(z), F.sum(F.when(good, F.col("weight")))).alias("confidence"))


def decide(confidence: DataFrame, threshold: float, active: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """Refuse below the threshold; an active gate also refuses a question without a confidence, an inactive one (see
    ``gate_is_active``) refuses nothing. With ``asked`` (the keys of all questions) questions without hits have a row."""
    rows = confidence if asked is None else asked.select(*_Q).distinct().join(confidence, _Q, "left")
    return rows.withColumn("refused", F.coalesce(F.col("confidence") < threshold, F.lit(True)) if active else F.lit(False))


def gate_is_active(gate: DataFrame) -> bool:
    """Whether some signal has a mean, a positive std and a positive weight (a table of a few signals)."""
    return not gate.where("mean is not null and std > 0 and weight > 0").isEmpty()


def pooled_stats(signals: DataFrame, names: list[str]) -> DataFrame:
    """signal, mean, std (of the population) over all questions, answerable or not."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("x")) for n in names])).alias("c")
    return signals.select(cells).select("c.*").groupBy("signal").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def raw_cutoffs(gate: DataFrame, threshold: float) -> DataFrame:
    """signal, cutoff: the value at which a signal alone would meet the threshold."""
    return gate.where("std > 0 and mean is not null").select("signal", (F.col("mean") + threshold * F.col("std")).alias("cutoff"))


def threshold_curve(labelled: DataFrame, grid: list[float]) -> DataFrame:
    """``labelled``: confidence, answerable. For each threshold the rates and the balanced accuracy;
    the grid is exploded beside each row and aggregated at once."""
    rows = labelled.select("confidence", "answerable", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    low = F.col("confidence") < F.col("threshold")
    agg = rows.groupBy("threshold").agg(
        F.try_divide(F.count_if(~F.col("answerable") & low), F.count_if(~F.col("answerable"))).alias("tr"), F.try_divide(F.count_if(F.col("answerable") & low), F.count_if(F.col("answerable"))).alias("fr"))
    return agg.select("threshold", F.round("tr", 6).alias("true_refusal"), F.round("fr", 6).alias("false_refusal"), F.round((F.col("tr") + 1 - F.col("fr")) / 2, 6).alias("balanced_accuracy"))


def auroc(labelled: DataFrame) -> DataFrame:
    """Probability that an answerable question has the greater confidence, ties half: from the counts
    of distinct confidences, not from pairs."""
    counts = labelled.groupBy("confidence").agg(F.count_if("answerable").alias("p"), F.count_if(~F.col("answerable")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("b", below).agg(F.round(F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)), F.sum("p") * F.sum("n")), 6).alias("auroc"))


def cohens_d(labelled: DataFrame) -> DataFrame:
    a = lambda f, yes: f(F.when(F.col("answerable") == F.lit(yes), F.col("confidence")))
    d = F.try_divide(a(F.avg, True) - a(F.avg, False), F.sqrt((a(F.var_pop, True) + a(F.var_pop, False)) / 2))
    return labelled.agg(F.round(d, 6).alias("cohens_d"))


def mark_subsets(selected: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` best rows of ``select_signals`` in order, the chosen one marked with an asterisk."""
    order = Window.orderBy(F.desc("balanced_accuracy"), "size", "signals")  # a row for each subset of a few signals
    return selected.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).withColumn("mark", F.when(F.col("chosen"), "*").otherwise(""))


def arm_metrics(arms: dict[str, DataFrame], golden: DataFrame) -> DataFrame:
    """``arms``: label to ranked document hits (run_id, query_id, doc_id, doc_rank). One row for each arm and question."""
    out = None
    for label, hits in arms.items():
        rows = retrieval_metrics(hits, golden).withColumn("arm", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


def compare_arms(rows: DataFrame) -> DataFrame:
    """arm, n, and the means of the headline metrics."""
    return rows.groupBy("arm").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in HEADLINE])


def paired_arms(rows: DataFrame, first: str, second: str, metric: str = "recall_5", rounds: int = 2000, seed: int = 42) -> DataFrame:
    """The mean difference ``first`` - ``second`` over questions with its interval and significance; a question's
    runs are averaged first, and both sides have the same draws."""
    sides = rows.where(F.col("arm").isin(first, second)).groupBy("query_id").agg(
        *[F.avg(F.when(F.col("arm") == a, F.col(metric))).alias(n) for a, n in ((first, "x"), (second, "y"))])
    return paired_bootstrap(sides.where("x is not null and y is not null").select("query_id", (F.col("x") - F.col("y")).alias("v")), "query_id", "v", rounds, seed)


def best_arm(means: DataFrame, order: list[str], metric: str = "recall_5") -> DataFrame:
    """The row with the greatest metric; among equals the first of ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("arm"))
    return means.orderBy(F.desc(metric), place).limit(1)


def comparison_table(means: DataFrame, metrics: tuple[str, ...] = ()) -> DataFrame:
    """metric, and a column for each arm (an arm has one row)."""
    metrics = metrics or HEADLINE
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("c")
    return means.select("arm", cells).select("arm", "c.*").groupBy("metric").pivot("arm").agg(F.first("value"))


def gold_positions(doc_hits: DataFrame, golden: DataFrame) -> DataFrame:
    """retrieved (document ids in order), gold_ranks (ascending) of each asked question with gold documents."""
    edges = gold_edges(golden).select(F.col("qid").alias("query_id"), "doc_id", F.lit(True).alias("gold"))
    asked = doc_hits.join(edges.select("query_id").distinct(), "query_id", "left_semi").join(edges, ["query_id", "doc_id"], "left")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("doc_rank", "doc_id"))), lambda x: x["doc_id"])
    return asked.groupBy(*_Q).agg(ranked.alias("retrieved"), F.array_sort(F.collect_list(F.when(F.col("gold"), F.col("doc_rank")))).alias("gold_ranks"))


def evaluate(doc_hits: DataFrame, golden: DataFrame, label: str, backends: dict[str, str], decided: DataFrame | None = None, rounds: int = 2000) -> dict[str, DataFrame]:
    """The small tables of one evaluation: ``rows`` (per question, flat), ``headline`` (means with intervals), ``slices``,
    ``refusal`` if decisions are given, and ``labels``: what the result was made with, a fallback flagged."""
    rows = retrieval_metrics(doc_hits, golden).withColumn("label", F.lit(label))
    headline = None
    for m in HEADLINE:
        values = rows.groupBy("query_id").agg(F.avg(m).alias("v"))
        part = bootstrap(values, "query_id", "v", rounds).select(F.lit(m).alias("metric"), "*")
        headline = part if headline is None else headline.union(part)
    made = [(k, v, v in ("lexical", "extractive", "inactive")) for k, v in sorted(backends.items())]
    out = {"rows": rows, "headline": headline, "slices": slices(rows, golden), "labels": rows.sparkSession.createDataFrame(made, "part string, backend string, fallback boolean")}
    if decided is not None:
        from folio.operators.citations import refusal_block

        out["refusal"] = refusal_block(decided, golden)
    return out


def signal_subsets(names: list[str]) -> list[list[str]]:
    return [list(c) for k in range(1, len(names) + 1) for c in combinations(names, k)]


def select_signals(rows: DataFrame, names: list[str], grid: tuple[float, ...] | None = tuple(i / 10 for i in range(-20, 21)), most_false: float = 0.15) -> DataFrame:
    """``rows``: the signals and ``answerable``. For each subset of signals the threshold with the best
    balanced accuracy among those with at most ``most_false`` false refusals, on pooled z-scores; among
    equals the least threshold. Thresholds are those of ``grid``, or without one every distinct score,
    which gives the best there is: the rates change nowhere else. Subsets (and a grid's thresholds) are
    exploded beside each row; distinct scores are counted first and then cumulated in their order."""
    stats = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    z = rows.crossJoin(F.broadcast(stats)).select("answerable", *[F.coalesce(F.try_divide(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}")), F.lit(0.0)).alias(n) for n in names])  # one row
    subsets = F.explode(F.array(*[F.struct(F.lit("+".join(c)).alias("signals"), F.lit(len(c)).alias("size"), (sum(F.col(n) for n in c) / len(c)).alias("x")) for c in signal_subsets(names)])).alias("u")
    scored = z.select("answerable", subsets).select("answerable", "u.*")
    agg = _rates_by_score(scored) if grid is None else _rates_on_grid(scored, grid)
    best = agg.where(F.col("fr") <= most_false).groupBy("signals", "size").agg(F.max(F.struct(((F.col("tr") + 1 - F.col("fr")) / 2).alias("ba"), (-F.col("threshold")).alias("t"))).alias("b"))
    order = Window.orderBy(F.desc("b.ba"), "size", "signals")
    return best.select("signals", "size", (-F.col("b.t")).alias("threshold"), F.round("b.ba", 6).alias("balanced_accuracy"), (F.row_number().over(order) == 1).alias("chosen"))


def _rates_on_grid(scored: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    each = scored.select("*", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    low = F.col("x") < F.col("threshold")
    return each.groupBy("signals", "size", "threshold").agg(F.try_divide(F.count_if(~F.col("answerable") & low), F.count_if(~F.col("answerable"))).alias("tr"), F.try_divide(F.count_if(F.col("answerable") & low), F.count_if(F.col("answerable"))).alias("fr"))


def _rates_by_score(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("signals", "size", "x").agg(F.count_if(~F.col("answerable")).alias("n"), F.count_if("answerable").alias("p"))
    whole = Window.partitionBy("signals", "size")
    below = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    rate = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(whole))
    return counts.select("signals", "size", F.col("x").alias("threshold"), rate("n").alias("tr"), rate("p").alias("fr"))
