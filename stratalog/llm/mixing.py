"""Mixing sources to target weights by soft membership.

A multinomial naive Bayes classifier over all words, fitted on a bounded sample of each domain's labelled documents,
gives each document a posterior over all domains that any row has.  A word counts in the bucket of its hash.  A
document then counts towards every domain by its posterior, and nonnegative rates are fitted so that the expected
token total of each domain meets its target:

    minimise  sum_d (T_d - t_d)^2 / (2 s_d) + RIDGE / 2 sum_i n_i (r_i - 1)^2,   r >= floor
    T_d(r) = sum_i r_i n_i p_id,   s_d = T_d(1)

The second part settles which of the many rates that meet the targets are meant: those nearest to 1.  At the optimum
r_i is the projection of 1 - sum_d p_id l_d on r >= floor, with l_d = (T_d - t_d) / (RIDGE s_d), so there are as many unknowns as
domains.  Projected gradient steps move l against the gradient in the metric of the documents that the floor doesn't
hold (sum_i n_i p_id p_ie over these); a step is halved until the objective's dual falls.  The objective is strictly convex
and piecewise quadratic, so the steps end at its optimum, whether or not the floor lets the targets be reached.  Each
step is one or two aggregations over all documents.  A rate is a function of a document's posterior and the few
numbers l; no table of rates is joined back.  Everything is built-in functions: a text is split once and each of its
words looked up once a domain.  The driver sees a few rows of domain totals for each step and the table of bucket counts.

Behaviour: a null text is an empty one; a text without words has the prior as its posterior and weighs nothing;
rows without a label take part in everything but the fit; without any label there is one domain, ``all``; a weight
for a domain that no row has is an error; of rows that share an
id and a label, the least text is learned from, so the fit is the same in every run; repeated rows get the same
rate; targets that the floor keeps out of reach show in the columns of totals and in ``target_met``; an empty table gives no rows; extra
columns, whatever their names, are ignored, and kept as they are by ``mix``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.llm.common import Scratch

#: Labelled documents of each domain to fit on at most, buckets that words are hashed to, what a bucket has been seen
#: before any word, and by what the words' evidence is divided (words of one text are not independent).
SAMPLE_EACH, BUCKETS, UNSEEN, HEAT = 1000, 4096, 0.5, 8.0
#: How far a total may be from its target, by the target; the weight of rates near 1 beside totals on target.
TOLERANCE, RIDGE = 1e-3, 1e-5
#: How far targets flatten the domains' shares.
FLATTEN = 0.7


@dataclass
class Classifier:
    """Domains with the logarithm of their prior and, for each, that of every bucket's frequency."""

    domains: list[str]
    prior: list[float]
    frequency: list[list[float]]  # by domain, then bucket; none if no word was seen


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_classifier(docs: DataFrame, label_col: str, each: int = SAMPLE_EACH) -> Classifier:
    """Domains and priors are those of all labelled rows; words come from ``each`` documents of every domain at most.

    Documents are chosen by a hash of their ids, without reading texts; those without an id go by their text.
    """
    labelled = docs.where(F.col(label_col).isNotNull()).select("doc_id", "text", F.col(label_col).cast("string").alias("domain"))
    rows = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(rows)
    if not domains:
        return Classifier(["all"], [0.0], [])
    by_id = labelled.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("key"), "domain")
    by_text = labelled.where("doc_id is null").select(F.concat(F.lit("t"), F.xxhash64("text")).alias("key"), "domain")
    keys = by_id.unionByName(by_text).distinct()
    # about twice as many as wanted pass this, however many there are; only those are ranked
    some = keys.groupBy("domain").agg(F.least(F.lit(1.0), F.lit(2.0 * each) / F.count("*")).alias("part"))
    chance = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    passed = keys.join(F.broadcast(some), "domain").where(chance < F.col("part"))
    rank = F.row_number().over(W.partitionBy("domain").orderBy(F.xxhash64("key"), "key"))
    sample = passed.withColumn("rank", rank).where(F.col("rank") <= each).select("key", "domain")
    keyed = labelled.where("text is not null").withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.xxhash64("text"))))
    texts = keyed.join(F.broadcast(sample), ["key", "domain"]).groupBy("key", "domain").agg(F.min("text").alias("text"))
    counts = texts.select("domain", F.explode(words(F.col("text"))).alias("word")).groupBy("domain", bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n")).collect()
    seen = {d: [UNSEEN] * BUCKETS for d in domains}
    for r in counts:
        seen[r["domain"]][r["bucket"]] += r["n"]
    everywhere = [sum(column) for column in zip(*seen.values(), strict=True)]
    # a domain whose sample has no words tells nothing: its frequencies are those of all
    told = {r["domain"] for r in counts}
    frequency = []
    for d in domains:
        n = seen[d] if d in told else everywhere
        whole = math.log(sum(n))
        frequency.append([round(math.log(x) - whole, 3) for x in n])
    total = sum(rows.values())
    return Classifier(domains, [math.log(rows[d] / total) for d in domains], frequency if told else [])


def with_posterior(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """(doc, n_tokens, p): each row of ``docs`` as a struct, its number of words and its posterior by domain."""
    counted = docs.select(F.struct(*docs.columns).alias("doc"), F.transform(words(F.col(text_col)), bucket).alias("buckets"))

    def evidence(frequency: list[float]) -> Column:
        table = F.split(F.lit(",".join(map(str, frequency))), ",").cast("array<double>")  # folded to a constant
        return F.aggregate("buckets", F.lit(0.0), lambda z, b: z + F.get(table, b)) / HEAT

    logits = [F.lit(z) for z in model.prior]
    for d, f in enumerate(model.frequency):
        logits[d] = logits[d] + evidence(f)
    scored = counted.select("doc", F.size("buckets").cast("long").alias("n_tokens"), F.array(*logits).alias("z"))
    raised = scored.select("doc", "n_tokens", F.transform("z", lambda z: F.exp(z - F.array_max("z"))).alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda a, e: a + e)
    return raised.withColumn("sum", whole).select("doc", "n_tokens", F.transform("e", lambda e: e / F.col("sum")).alias("p"))


@dataclass
class Rates:
    """What each part of a document's posterior takes off its rate; the totals at these rates, and those wanted."""

    off: list[float]
    floor: float
    total: list[float]
    target: list[float]

    def column(self) -> Column:
        return F.greatest(F.lit(self.floor), F.lit(1.0) - taken_off(self.off))

    def met(self) -> list[bool]:
        return [abs(x - t) <= TOLERANCE * max(t, 1.0) for x, t in zip(self.total, self.target, strict=True)]


def taken_off(off: list[float]) -> Column:
    return sum((F.col("p")[d] * float(c) for d, c in enumerate(off)), F.lit(0.0))


def totals(posterior: DataFrame, off: list[float], floor: float) -> tuple[np.ndarray, float]:
    """The domains' totals at the rates that ``off`` gives, and the sum of minus their integrals from ``off`` = 0 on."""
    x, end = taken_off(off), 1.0 - floor
    integral = F.when(x < end, x - x * x / 2).otherwise(F.lit(end - end * end / 2) + floor * (x - end))
    rate = F.greatest(F.lit(floor), F.lit(1.0) - x)
    parts = posterior.select("p", (rate * F.col("n_tokens")).alias("w"), (integral * F.col("n_tokens")).alias("i"))
    row = parts.agg(*[F.sum(F.col("w") * F.col("p")[d]) for d in range(len(off))], F.sum("i")).first()
    return np.array([float(x or 0.0) for x in row[:-1]]), -float(row[-1] or 0.0)


def metric(posterior: DataFrame, off: list[float], floor: float) -> np.ndarray:
    """Sums of products of posteriors over the documents above the floor; a group of the aggregation is a row of them."""
    k = range(len(off))
    free = posterior.where(F.lit(1.0) - taken_off(off) > floor)
    each = free.select("p", "n_tokens", F.explode(F.array(*map(F.lit, k))).alias("d"))
    rows = each.groupBy("d").agg(*[F.sum(F.col("n_tokens") * F.col("p")[F.col("d")] * F.col("p")[e]) for e in k]).collect()
    products = np.zeros((len(off), len(off)))
    for r in rows:
        products[r["d"]] = [x or 0.0 for x in r[1:]]
    return products


def flattened_targets(have: list[float], cover: bool) -> list[float]:
    """Shares raised to FLATTEN, of as many tokens as there are; ``cover``: of so many that no domain shrinks."""
    shares = [x**FLATTEN for x in have]
    whole = sum(shares) or 1.0
    budget = max((x * whole / s for x, s in zip(have, shares, strict=True) if s), default=0.0) if cover else sum(have)
    return [budget * s / whole for s in shares]


def fit_rates(posterior: DataFrame, domains: list[str], weights: dict[str, float] | None = None, cover: bool = False, floor: float = 0.0) -> Rates:
    """Projected gradient to the optimum, where no domain's part of the gradient is more than a tenth of TOLERANCE."""
    off = np.zeros(len(domains))
    total, integral = totals(posterior, list(off), floor)
    have = total.copy()
    if unknown := sorted(set(weights or ()) - set(domains)):
        raise ValueError(f"weights for domains that no row has: {', '.join(unknown)}")
    if weights:
        whole = sum(weights.get(d, 0.0) for d in domains) or 1.0
        target = np.array([have.sum() * weights.get(d, 0.0) / whole for d in domains])
    else:
        target = np.array(flattened_targets(list(have), cover))
    ridge = RIDGE * np.maximum(have, 1e-9)
    dual = lambda l, integral: (ridge * l * l).sum() / 2 + target @ l + integral
    while np.any(np.abs(slope := ridge * off + target - total) > TOLERANCE / 10 * np.maximum(target, 1.0)):
        way = -np.linalg.solve(metric(posterior, list(off), floor) + np.diag(ridge), slope)
        length, now = 1.0, dual(off, integral)
        while True:
            total, integral = totals(posterior, list(off + length * way), floor)
            if dual(off + length * way, integral) <= now + 1e-4 * length * (slope @ way):
                break
            length /= 2
            if length < 1e-9:
                # no lower value can be told from this one: the optimum to the last digit
                total, integral = totals(posterior, list(off), floor)
                return Rates(off.tolist(), floor, total.tolist(), target.tolist())
        off = off + length * way
    return Rates(off.tolist(), floor, total.tolist(), target.tolist())


def copies(rate: Column, *ids: Column) -> Column:
    """A rate as a whole number of copies: the fraction decides by a hash of the row, the same in every run."""
    part = F.pmod(F.xxhash64(*ids, F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixing_rates(spark: SparkSession, docs: DataFrame, label_col: str = "lang", weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), membership (its posterior), rate, copies of every document, and the
    expected tokens of its domain over all documents at these rates, those wanted, and whether they agree."""
    model = fit_classifier(docs, label_col)
    posterior = with_posterior(docs.select("doc_id", "text"), model).select("doc.doc_id", "n_tokens", "p")
    posterior = Scratch(spark, "mixing").save(posterior, "posterior")
    rates = fit_rates(posterior, model.domains, weights)
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    pick = lambda values: F.array(*map(F.lit, values))[F.col("best")]
    out = posterior.withColumn("best", best).withColumn("rate", rates.column())
    return out.select(
        "doc_id", "n_tokens", pick(model.domains).alias("domain"), F.array_max("p").alias("membership"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"),
        pick(rates.total).alias("domain_tokens"), pick(rates.target).alias("domain_target"), pick(rates.met()).alias("target_met"),
    )


def mix(spark: SparkSession, docs: DataFrame, label_col: str = "lang", cover: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; with ``cover`` every one at least once."""
    model = fit_classifier(docs, label_col)
    posterior = Scratch(spark, "mixing").save(with_posterior(docs, model), "posterior")
    rates = fit_rates(posterior, model.domains, cover=cover, floor=1.0 if cover else 0.0)
    times = copies(rates.column(), F.col("doc.doc_id"), F.col("doc.text"))
    return posterior.select("doc", F.explode(F.array_repeat(F.lit(1), times))).select("doc.*")
