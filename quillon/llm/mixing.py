"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives each document posteriors over domains. Distributed projected-gradient
least squares then finds nonnegative rates r for which the expected tokens of each domain, sum of r * tokens *
posterior, match the targets. Among the solutions it prefers rates near 1.

With T tokens in all, share t_i = tokens_i / T and m_k = sum of t_i r_i p_ik, the objective is
  sum_k (m_k - target_k)^2 / (2 m0_k)  +  ridge / 2 * sum_i t_i (r_i - 1)^2,  0 <= r_i <= most.
In the metric given by t the step for a document needs its posteriors and the K residuals only, so a rate is a
function of posteriors and of the residuals of all steps so far. Each step is one pass that sums K numbers.
"""

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, documents, saved
from .features import TextModel, fit, scorer
from .quality import MAX_ROWS, labelled_sample

#: Target token weights of the domains in the labels table: quality and toxicity.
TARGETS = {"q1t0": 0.92, "q1t1": 0.05, "q0t0": 0.025, "q0t1": 0.005}


def domain_of_labels():
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


def fit_domains(docs: DataFrame, labels: DataFrame, domain=None, *, max_rows: int = MAX_ROWS) -> TextModel:
    """Classifier of the labelled rows' domain (null domains are left out), on at most max_rows of them."""
    return fit(labelled_sample(docs, labels, domain_of_labels() if domain is None else domain, max_rows))


@dataclass
class Rates:
    """Rates as a function of posteriors: accelerated projected steps replayed over the residuals of each pass."""

    eta: float
    ridge: float
    most: float
    residuals: list[np.ndarray] = field(default_factory=list)
    #: Share of all tokens that each domain should have and, with the returned rates, has.
    wanted: dict[str, float] = field(default_factory=dict)
    achieved: dict[str, float] = field(default_factory=dict)

    def unmet(self, tolerance: float) -> dict[str, tuple[float, float]]:
        """Domains that miss their target by more than this share of it, or of the total if it is 0: (wanted, achieved)."""
        total = sum(self.wanted.values())
        return {d: (w, self.achieved[d]) for d, w in self.wanted.items() if abs(self.achieved[d] - w) > tolerance * (w or total)}

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, next point to evaluate)."""
        r = y = np.ones(len(p))
        t = 1.0
        for c in self.residuals:
            new = np.clip(y - self.eta * (p @ c + self.ridge * (y - 1)), 0, self.most)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            r, y, t = new, new + (t - 1) / after * (new - r), after
        return r, y


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], *, total: float = 1.0, most: float = 4.0, ridge: float = 1e-4, steps: int = 150, tolerance: float = 0.01) -> Rates:
    """members: n_tokens, p0, p1, ... in the order of domains. total: expected tokens wanted, as a share of those there are.

    Targets of domains that the model doesn't know are left out and the others scaled up to sum to 1. Passes end when,
    with the rates returned, each domain's tokens are within ``tolerance`` of its target, as a share of it, or when five
    passes have changed them by less than a tenth of that: the target is out of reach then. A warning names the domains
    that miss theirs; Rates has what was wanted and achieved.
    """
    k = len(domains)
    names = [f"p{i}" for i in range(k)]
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    rates = Rates(1.0, ridge, most)
    if not weight.sum():
        return rates
    want = total * weight / weight.sum()
    gram = [F.sum(F.col("n_tokens") * F.col(a) * F.col(b)).alias(f"{a}{b}") for a in names for b in names]
    first = members.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.col(a)).alias(a) for a in names), *gram).first()
    if not first.n:
        return rates
    tokens = float(first.n)
    m0 = np.array([first[a] for a in names]) / tokens
    w = 1 / np.maximum(m0, 1e-6)
    root = np.sqrt(w)
    hessian = root[:, None] * np.array([[first[a + b] for b in names] for a in names]) / tokens * root
    rates.eta = 1 / (float(np.linalg.eigvalsh(hessian)[-1]) + ridge)

    both = [f"{point}{i}" for point in "ry" for i in range(k)]

    def sums() -> np.ndarray:
        """Shares of tokens by domain: with the rates so far, and at the next point to evaluate."""

        def part(batches):
            total = np.zeros((2, k))
            for b in batches:
                p = b[names].to_numpy(np.float64)
                total += (b.n_tokens.to_numpy(np.float64) * np.stack(rates.replay(p))) @ p
            yield pd.DataFrame([total.ravel()], columns=both)

        row = numbers.mapInPandas(part, ", ".join(f"{a} double" for a in both)).agg(*(F.sum(a).alias(a) for a in both)).first()
        return np.array([row[a] for a in both]).reshape(2, k) / tokens

    numbers = members.select("n_tokens", *names)
    # Rows of a few numbers: large batches, so that a pass isn't spent on their overhead.
    bound_batches(members.sparkSession, rows=1 << 16)
    have = at = m0
    slack, past = tolerance * np.where(want > 0, want, total), []
    try:
        for _ in range(steps):
            if np.all(np.abs(have - want) <= slack) or len(past) > 5 and all(np.all(np.abs(have - x) <= slack / 10) for x in past[-6:-1]):
                break
            rates.residuals.append(w * (at - want))
            have, at = sums()
            past.append(have)
    finally:
        bound_batches(members.sparkSession)
    rates.wanted, rates.achieved = dict(zip(domains, want.tolist())), dict(zip(domains, have.tolist()))
    if missed := rates.unmet(tolerance):
        warnings.warn("targets not met (wanted, achieved): " + ", ".join(f"{d} ({a:.4f}, {b:.4f})" for d, (a, b) in missed.items()), stacklevel=2)
    return rates


def memberships(docs: DataFrame, model: TextModel) -> DataFrame:
    """docs with n_tokens and p0, p1, ... (posterior of each of model.classes); input columns of these names are replaced."""
    spark = docs.sparkSession
    bound_batches(spark)
    s = docs.withColumn("_s", scorer(model, spark)(F.col("text"))).withColumn("n_tokens", F.col("_s.n_tokens"))
    for i in range(len(model.classes)):
        s = s.withColumn(f"p{i}", F.col("_s.p")[i])
    return s.drop("_s")


def rate_column(rates: Rates, n: int):
    """A UDF from the posterior columns to the rate."""

    @F.pandas_udf("double")
    def rate(p: pd.DataFrame) -> pd.Series:
        return pd.Series(rates.replay(p.to_numpy(np.float64))[0])

    return rate(F.struct(*(F.col(f"p{i}") for i in range(n))))


def copies_of(rate):
    """Whole copies of a document: the rate rounded up or down by a hash of doc_id, right on average. Null ids hash too."""
    dither = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    return F.floor(rate + dither).cast("int")


def mix(docs: DataFrame, labels: DataFrame, *, targets=None, domain=None, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, domains, posteriors, rate, copies.

    Null and empty texts have no tokens: no weight in the fit, but a rate like any document. Without labelled rows
    nothing is known of domains and every rate is 1. Repeated rows are weighted as often as they occur.
    """
    model = fit_domains(docs, labels, domain)
    if not model.classes:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<string>").alias("domains"), F.array().cast("array<double>").alias("posteriors"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    members = saved(memberships(docs.select("doc_id", "text"), model).drop("text"), "members")
    rates = fit_rates(members, model.classes, TARGETS if targets is None else targets, **how)
    n = len(model.classes)
    out = members.withColumn("rate", rate_column(rates, n))
    return out.select("doc_id", "n_tokens", F.array(*(F.lit(c) for c in model.classes)).alias("domains"), F.array(*(F.col(f"p{i}") for i in range(n))).alias("posteriors"), "rate", copies_of(F.col("rate")).alias("copies"))


def mixed_rows(docs: DataFrame, labels: DataFrame, *, targets=None, domain=None, anchor: str | None = None, **how) -> DataFrame:
    """The rows of docs, each as often as its copies say, with the columns of docs, whatever their names.

    Null and empty texts have no tokens, and stay or go by their rate like any other. Rows that repeat a doc_id get the
    same draw. Without labelled rows, or from an empty table, all rows come back as they are.

    anchor: a domain whose tokens set the total, so that it is kept whole and the others are thinned out to it.
    """
    targets = TARGETS if targets is None else targets
    model = fit_domains(docs, labels, domain)
    if not model.classes:
        return docs
    n = len(model.classes)
    # Whole rows are written beside their posteriors: texts are scored once, and the passes of the fit read numbers only.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text")
    members = saved(memberships(rows, model).drop("text"), "members")
    if anchor in model.classes:
        a = f"p{model.classes.index(anchor)}"
        own = members.agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col(a)).alias("a")).first()
        known = sum(targets.get(c, 0.0) for c in model.classes)
        if own.n and targets.get(anchor):
            how["total"] = own.a / own.n * known / targets[anchor]
    rates = fit_rates(members, model.classes, targets, **how)
    kept = members.withColumn("_copies", copies_of(rate_column(rates, n))).where("_copies > 0")
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def mixing_query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
