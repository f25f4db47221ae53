"""Mixing sources to target weights by soft membership.

A multinomial naive Bayes classifier, fitted on a bounded sample of labelled rows,
gives each document a posterior over domains from the hashed words it has (each once);
scoring is column functions only.  Rates r >= 0 then solve the least-squares problem

    minimise |A r - T|^2 in the norm of (A W A')^-1,  A[d, i] = tokens_i * posterior_i(d)

by distributed projected gradient from r = 1: each step is one aggregation of a few
sums over the narrow table (tokens, posteriors), and the step vectors, one number per
domain, are folded into the rate expression.  Steps are
taken in the metric W = diag(1 / tokens), in which the projection on r >= 0 is the same
and a document's rate depends on its membership, not its length.  The Hessian's
eigenvalues are then 0 and 1, so the step size is 1.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.llm.quality import words_of
from opinara.session import cut

#: Share of the corpus' tokens that each domain shall have.
TARGETS = {"clean": 0.96, "poor": 0.01, "toxic": 0.03}
#: Bounds of the classifier's fit: labelled rows per domain, and word buckets.
SAMPLE_PER_DOMAIN = 2000
BUCKETS = 16384
#: Membership stays soft: the evidence of a text counts as that of this many different words at most.
EVIDENCE = 100.0
#: Steps folded into one expression before rates are checkpointed.
FOLD = 8


def label_domain() -> Column:
    """Domain of a row of ``labels``; null where a label is missing."""
    return F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 0), "poor").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean")


def _buckets(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", per_domain: int = SAMPLE_PER_DOMAIN) -> tuple[list[float], list[list[float]]]:
    """Log priors and log word-bucket likelihoods by domain, from at most ``per_domain``
    labelled rows of each (those whose id hashes lowest, so the choice does not depend on
    row order).  What reaches the driver is bounded: domains times buckets counts."""
    order = Window.partitionBy("domain").orderBy(F.xxhash64("id"), "id")
    chosen = labels.select(F.col(id_col).alias("id"), label_domain().alias("domain")).where(F.col("domain").isin(domains) & F.col("id").isNotNull()).distinct()
    sample = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_domain).drop("k")
    totals = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "id")
    counts = rows.select("domain", F.explode(F.array_distinct(_buckets(F.col("text")))).alias("b")).groupBy("domain", "b").count().collect()
    table = np.ones((len(domains), BUCKETS))
    for r in counts:
        table[domains.index(r["domain"]), r["b"]] += r["count"]
    likely = np.log(table / table.sum(axis=1, keepdims=True))
    seen = np.array([totals.get(d, 0) + 1.0 for d in domains])
    return np.log(seen / seen.sum()).tolist(), (likely - likely.mean(axis=0)).tolist()


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, tokens (words) and p, the array of posteriors in the order of the model's domains."""
    priors, likely = model
    kept = [F.col(f"`{c}`") for c in keep]
    words = docs.select(*kept, _buckets(F.col(f"`{text_col}`")).alias("_all"))
    read = words.select(*kept, F.size("_all").cast("long").alias("tokens"), F.array_distinct("_all").alias("_b"))

    def logit(prior: float, row: list[float]) -> Column:
        weights = F.from_json(F.lit(json.dumps(row)), "array<double>")
        share = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.size("_b"), F.lit(1)))
        return F.lit(prior) + share * F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(weights, b))

    logits = [logit(prior, row) for prior, row in zip(priors, likely)]
    scored = read.select(*kept, "tokens", F.array(*logits).alias("_z"))
    raised = scored.select(*kept, "tokens", "_z", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))).alias("_e"))
    return raised.select(*kept, "tokens", F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)).alias("p"))


def _stepped(start: Column, steps: list[list[float]], size: int) -> Column:
    """Rates after ``steps``, each a vector u: r <- max(0, r - <p, u>); a text without tokens keeps its rate."""
    if not steps:
        return start
    plan = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    move = lambda u: sum((F.get("p", F.lit(d)) * F.get(u, F.lit(d)) for d in range(size)), F.lit(0.0))
    return F.aggregate(plan, start, lambda r, u: F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), r - move(u))).otherwise(r))


def _fitted(table: DataFrame, targets: dict[str, float], budget: float | None, tolerance: float, max_steps: int) -> tuple[list[list[float]], float, bool]:
    """The steps of projected gradient, the largest domain's miss as a share of the budget, and
    whether the rates settled; rates are checkpointed every FOLD steps."""
    size = len(targets)
    mass = [F.coalesce(F.sum(F.col("tokens") * F.get("p", F.lit(d))), F.lit(0.0)).alias(f"m{d}") for d in range(size)]
    gram = [F.coalesce(F.sum(F.col("tokens") * F.get("p", F.lit(a)) * F.get("p", F.lit(b))), F.lit(0.0)).alias(f"g{a}_{b}") for a in range(size) for b in range(a, size)]
    got = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), *mass, *gram).first()
    total = float(budget if budget is not None else got["n"])
    want = total * np.array(list(targets.values())) / sum(targets.values())
    square = np.array([[got[f"g{min(a, b)}_{max(a, b)}"] for b in range(size)] for a in range(size)], float)
    inverse = np.linalg.pinv(square, rcond=1e-10)
    reach = np.array([got[f"m{d}"] for d in range(size)], float)
    current, steps, folded = table.select("tokens", "p", F.lit(1.0).alias("rate")), [], 0
    while True:
        miss = float(np.abs(reach - want).max() / total) if total else 0.0
        if miss <= tolerance or not total:
            return steps, miss, True
        if len(steps) == max_steps:
            return steps, miss, False
        steps.append((inverse @ (reach - want)).tolist())
        stepped = current.withColumn("rate", _stepped(F.col("rate"), steps[folded:], size))
        if len(steps) - folded == FOLD:
            current, folded = cut(stepped), len(steps)
            stepped = current
        sums = stepped.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.get("p", F.lit(d))).alias(f"m{d}") for d in range(size)]).first()
        new = np.array([sums[f"m{d}"] for d in range(size)], float)
        if np.abs(new - reach).max() <= 1e-12 * total:
            return steps, miss, True
        reach = new


def fitted(table: DataFrame, targets: dict[str, float], budget: float | None = None, tolerance: float = 1e-7, max_steps: int = 64) -> tuple[list[list[float]], float]:
    """The steps that lead from rate 1 to the fitted rates, and the largest domain's miss as a share
    of the budget.  Warns where a domain misses its target: no nonnegative rates may meet the
    targets, or more steps than ``max_steps`` be needed."""
    steps, miss, settled = _fitted(table, targets, budget, tolerance, max_steps)
    if miss > 1e-3:
        why = "no nonnegative rates meet the targets" if settled else f"rates did not settle in {max_steps} steps"
        warnings.warn(f"{why}: a domain misses its own by {miss:.4f} of all tokens", stacklevel=2)
    return steps, miss


def solve(table: DataFrame, targets: dict[str, float], budget: float | None = None, tolerance: float = 1e-7, max_steps: int = 64) -> tuple[DataFrame, float]:
    """``table`` (tokens, p, ...) with its rate, and the largest domain's miss as a share of the budget.

    budget: expected tokens of the mixture; None: those of the table.  A domain that no
    document can belong to is left out of the fit.
    """
    steps, miss, _ = _fitted(table, targets, budget, tolerance, max_steps)
    return table.withColumn("rate", _rate(steps, len(targets))), miss


def _rate(steps: list[list[float]], size: int) -> Column:
    return F.round(_stepped(F.lit(1.0), steps, size), 9)


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id, tokens, p (posteriors), rate, and miss: by what share of all tokens
    the rates miss the target of the domain that they miss most.

    Null and empty texts have no tokens, the prior as posterior, and rate 1.  Repeated
    rows get equal rates.  Without labels the posteriors are equal.  An empty table
    gives no rows.
    """
    targets = targets or TARGETS
    model = fit(docs, labels, list(targets), id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    table = cut(posteriors(rows, model, ["id"]))
    steps, miss = fitted(table, targets)
    return table.withColumn("rate", _rate(steps, len(targets))).withColumn("miss", F.lit(miss)).withColumnRenamed("id", id_col)


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Rows of ``docs`` as often as their rates say: the whole part of the rate, and once
    more with the probability of the fraction (decided by the seeded hash of id and text).

    The fit reads a narrow table; each row's rate then comes from its own text in one
    projection, so that no text moves.  A null id is an id like any other; null and empty
    texts have rate 1 and stay; repeated rows are treated alike; columns of any name are kept
    as they are; an empty table gives no rows.
    """
    targets = targets or TARGETS
    model = fit(docs, labels, list(targets), id_col, text_col)
    text = F.col(f"`{text_col}`").alias("text")
    steps, _ = fitted(cut(posteriors(docs.select(text), model, [])), targets)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(1 << 30)) / float(1 << 30)
    scored = posteriors(docs.select(row, text, draw.alias("draw")), model, ["row", "draw"])
    copies = F.floor(_rate(steps, len(targets)) + F.col("draw")).cast("int")
    # rates are computed once, below the repetition
    often = scored.select("row", (copies + F.lit(0) * F.spark_partition_id()).alias("copies")).where("copies >= 1")
    return often.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
