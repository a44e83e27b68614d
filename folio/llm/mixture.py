"""Records of several sources mixed to target shares of all tokens.

Temperature mixing raises the sources' natural token shares to an exponent and normalises. One exponent
cannot meet a share for each source, so the targets come first: a source gets its target share, or as
much as its repetition limit allows. What small and absent sources leave open is mixed by temperature over
the sources that have room: in proportion to their natural shares raised to one exponent, which is bisected
so that the whole mixture has the entropy of the targets (or comes nearest to it); a source that reaches
its limit keeps it and the rest is mixed anew. As no source that can reach its target gets less, the
sum of the shares' errors is the least that the limits allow, twice what is left open, for any exponent.

Weights become token budgets of a total (by default the tokens of all target sources, each document
once), realised as block permutations: whole passes over a source, and for the rest one pass in
random order, block by block, until the budget is met. Blocks are hash buckets of about ``BLOCK``
documents; only the block in which the budget ends is ordered document by document, so no source,
however large, is sorted or windowed in one task. Reached shares differ from the weights by less
than one document a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import tokens
from folio.session import Scratch

BLOCK = 1_024
MOST_BLOCKS = 65_536
MOST_TARGETS = 10_000
HOTTEST = 16.0  # greatest exponent


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _normal(weights: list[float]) -> list[float]:
    total = sum(weights)
    return [w / total for w in weights] if total else weights


def _bisect(f, lo: float, hi: float) -> float:
    """Where ``f`` passes 0 between ends of different sign; without such, the end nearer to 0."""
    at_lo, at_hi = f(lo), f(hi)
    if (at_lo > 0) == (at_hi > 0):
        return lo if abs(at_lo) <= abs(at_hi) else hi
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (f(mid) > 0) == (at_lo > 0) else (lo, mid)
    return (lo + hi) / 2


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised; empty ones stay empty."""
    return _normal([x**exponent if x > 0 else 0.0 for x in _normal(shares)])


def entropy_weights(shares: list[float], target: float) -> tuple[list[float], float]:
    """Tempered shares with the target entropy (or the nearest to it), and the exponent in [0, ``HOTTEST``]."""
    e = _bisect(lambda x: entropy(tempered(shares, x)) - target, 0.0, HOTTEST)
    return tempered(shares, e), e


def _filled(base: list[float], limit: list[float], sizes: list[int], exponent: float) -> list[float]:
    """``base`` and what is left of 1 by tempered natural shares, no source above its limit."""
    weights = [*base]
    room = {i for i, (b, m) in enumerate(zip(base, limit)) if m > b * (1 + 1e-12)}
    while room:
        left = 1.0 - sum(weights)
        if left <= 1e-15:
            break
        part = tempered([sizes[i] if i in room else 0 for i in range(len(sizes))], exponent)
        full = {i for i in room if weights[i] + left * part[i] >= limit[i]}
        if not full:
            return [w + left * q for w, q in zip(weights, part)]
        for i in full:
            weights[i] = limit[i]
        room -= full
    return weights


def target_weights(sizes: list[int], targets: list[float], repeats: list[int], total: int, wanted_entropy: float | None = None) -> tuple[list[float], float | None]:
    """Weights (shares of ``total`` tokens) of the sources, and the exponent, null where every target is met.
    Sources without tokens or target have weight 0; if all reach their limits, the weights add up to less
    than 1. ``wanted_entropy`` is that of the targets unless given."""
    goal = _normal([max(0.0, t) for t in targets])
    limit = [s * r / total if total and t > 0 else 0.0 for s, r, t in zip(sizes, repeats, targets)]
    base = [min(t, m) for t, m in zip(goal, limit)]
    if sum(base) >= 1 - 1e-12 or not any(m > b for m, b in zip(limit, base)):
        return base, None
    want = entropy(goal) if wanted_entropy is None else wanted_entropy
    e = _bisect(lambda x: entropy(_normal(_filled(base, limit, sizes, x))) - want, 0.0, HOTTEST)
    return _filled(base, limit, sizes, e), e


def _key(c: str) -> F.Column:
    return F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))


class Mixture:
    """``documents`` (the mixture) and ``shares`` (the report)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | None = None, seed: int = 7, tokenizer: str = tokens.TOKENIZER):
        spark = documents.sparkSession
        scratch = Scratch(spark)
        goal = targets.select(_key("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        goal = goal.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
        goals = goal.limit(MOST_TARGETS + 1).collect()
        if len(goals) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} target sources")
        wanted = documents.select(F.col(id_col).alias("id"), _key(source_col).alias("source"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        wanted = wanted.join(F.broadcast(goal.select("source")), "source", "left_semi")  # at most MOST_TARGETS rows
        sized = scratch.write(tokens.count_tokens(wanted, ["id", "source"], "text", tokenizer).where("n_tokens > 0"), "sized")
        found = {r.source: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}  # at most MOST_TARGETS rows
        goals.sort(key=lambda r: r.source)
        sizes = [found[g.source].tokens if g.source in found else 0 for g in goals]
        total = sum(sizes) if total_tokens is None else total_tokens
        weights, exponent = target_weights(sizes, [g.target_share for g in goals], [max(0, g.max_repeats) for g in goals], total)
        plan = []
        for g, size, w in zip(goals, sizes, weights):
            budget = min(round(w * total), size * max(0, g.max_repeats))
            docs = found[g.source].docs if g.source in found else 0
            plan.append((g.source, g.target_share, g.max_repeats, size, docs, exponent, w, budget, budget // size if size else 0, budget % size if size else 0, max(1, min(MOST_BLOCKS, -(-docs // BLOCK)))))
        kind = "source string, target_share double, max_repeats int, available_tokens long, available_docs long, exponent double, weight double, budget_tokens long, passes long, rest long, blocks long"
        plan_df = spark.createDataFrame(plan, kind)
        # ids repeat only with repeated rows; each row is a document of its own
        order = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
        placed = sized.join(F.broadcast(plan_df.select("source", "passes", "rest", "blocks")), "source").withColumn("order", order).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id").cast("string")), "blocks"))
        blocks = placed.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("size"))
        run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_BLOCKS rows a source
        edge = blocks.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).withColumn("left", F.col("rest") - F.col("before"))
        edge = edge.select("source", "block", F.when(F.col("left") >= F.col("size"), F.lit(2)).when(F.col("left") > 0, F.lit(1)).otherwise(F.lit(0)).alias("part"), "left")
        with_edge = placed.join(edge, ["source", "block"])
        inside = Window.partitionBy("source", "block").orderBy("order", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
        ends = with_edge.where("part = 1").withColumn("sum", F.sum("n_tokens").over(inside)).withColumn("more", (F.col("sum") <= F.col("left")).cast("int")).select("id", "source", "n_tokens", "passes", "more", "order", "block")
        rest = with_edge.where("part <> 1").select("id", "source", "n_tokens", "passes", (F.col("part") == 2).cast("int").alias("more"), "order", "block")
        self.documents = rest.union(ends).select(F.col("id").alias(id_col), "source", (F.col("passes") + F.col("more")).cast("int").alias("uses"), "n_tokens", "block", "order").where("uses > 0")
        reached = self.documents.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("docs"), F.max("uses").alias("most_uses"))
        report = plan_df.drop("passes", "rest", "blocks").join(F.broadcast(reached), "source", "left")
        all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
        self.shares = report.select(
            "source", "target_share", "max_repeats", "available_tokens", "available_docs", "exponent", "weight", "budget_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.when(all_tokens > 0, F.coalesce("tokens", F.lit(0)) / all_tokens).otherwise(F.lit(0.0)).alias("reached_share"),
        )


def mix_sources(documents: DataFrame, targets: DataFrame, **options) -> Mixture:
    """Mix ``documents`` to ``targets`` (source, target_share, max_repeats).

    ``Mixture.documents``: id, source, uses (1 .. max_repeats), n_tokens, and ``block``, ``order``, by
    which a pass reads its permutation. Sources are compared without regard to case and outer
    spaces. Documents with null id, null or empty text, null or other source are not used. Targets
    entered twice add their shares and keep the smaller limit; a null limit counts as 1. Absent
    sources reach 0; empty tables give an empty mixture. Repeated rows count as documents of their own."""
    return Mixture(documents, targets, **options)
