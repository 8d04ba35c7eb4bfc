"""Toxicity by a classifier chain over hashed words and word beginnings.

The categories are predicted one after another: each has a logistic model over the features that tell it best, and the
log-odds of the categories before it. In training those come from models that have not seen the document (out of fold).
The sample is drawn by category value; the intercepts are set back to the labels' own rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marklake.llm.common import as_long, begin_task, forget, pieces, stored, text_buffer
from marklake.llm.linear import fit, labelled_sample, logit, sigmoid, word_features


class Chain:
    """Categories in order; features and weights of each. Small: `most` features a category."""

    def __init__(self, categories: list[str]):
        self.categories = categories
        self.features: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.threshold = 0.5

    def found(self, k: int, doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place among the category's features, value): a feature counts with the logarithm of its occurrences."""
        chosen = self.features[k]
        if not len(chosen):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
        hit = chosen[at] == feature
        pairs, counts = np.unique(doc[hit] * len(chosen) + at[hit], return_counts=True)
        return pairs // len(chosen), pairs % len(chosen), np.log1p(counts)

    def probabilities(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One column per category, one row per text."""
        n = len(starts) - 1
        doc, feature = word_features(data, starts)
        odds = np.zeros((n, 0))
        for k in range(len(self.categories)):
            w, size = self.weights[k], len(self.features[k])
            text, at, value = self.found(k, doc, feature)
            z = w[-1] + odds @ w[size : size + k] + np.bincount(text, weights=w[at] * value, minlength=n)
            odds = np.hstack([odds, logit(sigmoid(z))[:, None]])
        return sigmoid(odds)


def _parts(batches: Iterator[pa.RecordBatch]):
    """Runs of texts of all batches: (batch, first, last, text numbers, features)."""
    begin_task()
    for batch in batches:
        data, starts = text_buffer(batch.column("text"))
        for i, j in pieces(starts):
            yield batch, i, j, *word_features(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])


def _tallied(categories: list[str]):
    """Per feature, in how many texts of a run it occurs, and in how many of each category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, doc, feature in _parts(batches):
            names, at = np.unique(feature, return_inverse=True)
            pairs = np.unique(doc.astype(np.int64) * max(len(names), 1) + at)
            doc, at = pairs // max(len(names), 1), pairs % max(len(names), 1)
            sums = [np.bincount(at, weights=batch.column(c)[i:j].to_numpy()[doc], minlength=len(names)).astype(np.int64) for c in categories]
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(names)), pa.array(np.bincount(at, minlength=len(names))), *map(pa.array, sums)], names=["feature", "n", *categories]
            )

    return run


def _rows_of(chain: Chain, categories: list[str]):
    """Per text and category, the places and values of the category's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, doc, feature in _parts(batches):
            columns, names = [batch.column("doc_id")[i:j], *(batch.column(c)[i:j] for c in categories)], ["doc_id", *categories]
            for k in range(len(categories)):
                text, at, value = chain.found(k, doc, feature)
                ends = pa.array(np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32))
                columns += [pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(value))]
                names += [f"at{k}", f"value{k}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _best_features(tally: DataFrame, category: str, inside: int, everything: int, most: int) -> np.ndarray:
    """The features that stand out most in the texts of a category: likelihood ratio of their presence against its absence."""
    k, n = F.col(category), F.col("n")

    def part(count, size: int, share):
        """log-likelihood of `count` of `size` texts at their own share, less that at the common one."""
        own = count / size
        return F.when(count > 0, count * F.log(own / share)).otherwise(0.0) + F.when(count < size, (size - count) * F.log((1 - own) / (1 - share))).otherwise(0.0)

    gain = part(k, inside, n / everything) + part(n - k, everything - inside, n / everything)
    best = tally.where(n < everything).withColumn("gain", gain).where("gain > 6").orderBy(F.desc("gain"), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))


def best_threshold(p: np.ndarray, y: np.ndarray, rate: float) -> float:
    """The probability from which on rejecting serves best (largest F1 at the labels' own rate), halfway to the next lower one."""
    weight = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    order = np.argsort(-p, kind="stable")
    right, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    ends = np.append(np.flatnonzero(np.diff(p[order])), len(p) - 1)
    best = ends[np.argmax(2 * right[ends] / (all_[ends] + (weight * y).sum()))]
    top = p[order]
    return float(sigmoid((logit(top[best]) + logit(top[min(best + 1, len(p) - 1)])) / 2))


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: list[str], per_class: int = 2500, folds: int = 5, most: int = 300, least_documents: int = 4
) -> Chain:
    """Fit on at most 2 * len(categories) * per_class labelled documents, the only part of the corpus that the driver sees.

    The chain's threshold is the last category's best one out of fold. A category without both values among the labels is predicted by its rate.
    """
    rates = labels.select(*[F.avg(F.col(c).cast("double")).alias(c) for c in categories]).first()
    sample = stored(labelled_sample(docs, labels, categories, per_class).select("doc_id", *categories, "text"), "toxicity-sample")
    kinds = ", ".join(f"{c} int" for c in categories)
    n, *inside = sample.select(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in categories]).first()
    counted = sample.mapInArrow(_tallied(categories), "feature long, n long, " + ", ".join(f"{c} long" for c in categories))
    tally = stored(counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *categories)]).where(F.col("n") >= least_documents), "toxicity-tally")
    chain = Chain(categories)
    for c, k in zip(categories, inside):
        chain.features.append(_best_features(tally, c, k, n, most) if 0 < k < n else np.zeros(0, np.uint64))
    lists = "".join(f", at{k} array<long>, value{k} array<double>" for k in range(len(categories)))
    got = sample.mapInArrow(_rows_of(chain, categories), f"doc_id long, {kinds}{lists}").toArrow().sort_by("doc_id")
    forget(sample, tally)
    fold, odds = np.arange(n) % folds, np.zeros((n, 0))
    for k, category in enumerate(categories):
        y = got.column(category).to_numpy().astype(float)
        rate = min(max(rates[category] or 0.0, 1e-4), 1 - 1e-4)
        if not 0 < y.sum() < n:
            chain.weights.append(np.append(np.zeros(k), logit(rate)))
            odds = np.hstack([odds, np.full((n, 1), logit(rate))])
            continue
        x = np.zeros((n, len(chain.features[k])))
        at, value = (got.column(f"{c}{k}").combine_chunks() for c in ("at", "value"))
        x[np.repeat(np.arange(n), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = value.flatten().to_numpy()
        x = np.hstack([x, odds])
        shift = logit(rate) - logit(y.mean())
        out = np.zeros(n)
        for f in range(folds):
            rest, mine = fold != f, fold == f
            w = fit(x[rest], y[rest]) if 0 < y[rest].sum() < rest.sum() else np.append(np.zeros(x.shape[1]), logit(rate) - shift)
            out[mine] = x[mine] @ w[:-1] + w[-1] + shift
        w = fit(x, y)
        w[-1] += shift
        chain.weights.append(w)
        odds = np.hstack([odds, logit(sigmoid(out))[:, None]])
        chain.threshold = best_threshold(sigmoid(out), y, rate)
    return chain


def with_probabilities(docs: DataFrame, chain: Chain, names: list[str]) -> DataFrame:
    """All columns of `docs` and one probability per category; every row stays, a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            data, starts = text_buffer(batch.column(batch.schema.get_all_field_indices("text")[0]).cast(pa.string()))
            for i, j in pieces(starts):
                p = chain.probabilities(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, k]) for k in range(len(names)))], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(name, DoubleType()) for name in names)]))


CATEGORIES = ["low_quality", "toxic"]


def categories_of(labels: DataFrame) -> DataFrame:
    """The label table's two judgements as the chain's categories."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, rejected) for every row of `docs`.

    A document is rejected when its probability of the last category reaches `threshold`, or the one that the chain
    found best out of fold. A null or empty text has the
    probabilities of no features. Repeated and null ids have their rows; other columns are not read; an empty table
    gives no rows, and without labels nothing is rejected.
    """
    chain = train_chain(docs, categories_of(labels), CATEGORIES)
    names = [f"p_{c}" for c in CATEGORIES]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_probabilities(texts, chain, names).drop("text").withColumn("rejected", F.col(names[-1]) >= (chain.threshold if threshold is None else threshold))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of `docs` that `toxicity` does not reject, with their own columns."""
    chain = train_chain(docs, categories_of(labels), CATEGORIES)
    names = [f"_p{k}_{'_'.join(docs.columns)}" for k in range(len(CATEGORIES))]  # longer than, so unlike, any column
    return with_probabilities(docs, chain, names).where(F.col(f"`{names[-1]}`") < (chain.threshold if threshold is None else threshold)).select(docs.columns)
