"""Quality by hierarchical empirical Bayes: a document's own evidence against what its host and path are like.

A logistic model over how a text is written, fitted on a bounded sample of the labels, gives each document's odds at
the corpus' rate. Host and path levels come from grouped sums over all documents: a host's rate is its documents' mean
probability, shrunk to the global rate as if it had `kappa` documents of it, and a path's rate is shrunk to its host's
in the same way. The strengths are estimated from the spread of the groups' means beyond what their sizes explain. A
document's posterior odds are its own odds times its path's odds over the global odds; its own share is taken out of
the sums first, so that no document counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marklake.llm.common import begin_task, let, pieces, stored, text_buffer
from marklake.llm.linear import dense_features, fit, labelled_sample, logit, sigmoid


class Writing:
    """A logistic model of low quality over dense features and their squares."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.centre, self.scale, self.weights = centre, scale, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([z, z * z])

    def probabilities(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs(dense_features(data, starts)) @ self.weights[:-1] + self.weights[-1])


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_task()
    for batch in batches:
        data, starts = text_buffer(batch.column("text"))
        for i, j in pieces(starts):
            x = dense_features(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("bad")[i:j], pa.array(list(x))], names=["doc_id", "bad", "x"])


def train_writing(docs: DataFrame, labels: DataFrame, per_class: int = 5000) -> Writing:
    """Fit on at most 2 * per_class labelled documents. Without labels of both kinds, every document has the labels' rate."""
    bad = labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("bad"))
    rate = bad.agg(F.avg("bad")).first()[0]
    rate = min(max(0.05 if rate is None else rate, 1e-3), 1 - 1e-3)
    got = labelled_sample(docs, bad, ["bad"], per_class).select("doc_id", "bad", "text").mapInArrow(_dense, "doc_id long, bad int, x array<double>").toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("bad").to_pylist(), got.column("x").to_pylist()), key=str)
    y = np.array([r[1] for r in rows], float)
    if not 0 < y.sum() < len(y):
        k = 2 * dense_features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
        return Writing(np.zeros(k // 2), np.ones(k // 2), np.append(np.zeros(k), logit(rate)))
    x = np.array([r[2] for r in rows])
    model = Writing(x.mean(0), np.maximum(x.std(0), 1e-6), np.zeros(0))
    model.weights = fit(model.inputs(x), y)
    model.weights[-1] += logit(rate) - logit(y.mean())
    return model


def with_evidence(docs: DataFrame, model: Writing, name: str) -> DataFrame:
    """All columns of `docs` and the model's probability of low quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            data, starts = text_buffer(batch.column(batch.schema.get_all_field_indices("text")[0]).cast(pa.string()))
            for i, j in pieces(starts):
                part = batch.slice(i, j - i)
                p = model.probabilities(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def strength(groups: DataFrame, most: float = 1e4, least: float = 20.0) -> float:
    """How many documents a group's parent counts for: from the groups' spread around it beyond sampling noise.

    `groups`: n, s (sum of probabilities), parent (rate). With rates m the variance of a group's mean is
    m(1-m) * (1/(kappa+1)) + its noise; moments over all groups, weighted by size, give kappa. It is held between
    `least` and `most`, so that neither a few odd groups nor a corpus of one group decides.
    """
    noise = F.col("parent") * (1 - F.col("parent"))
    row = groups.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("parent"), 2) - noise).alias("spread"), F.sum(F.col("n") * noise).alias("scale")
    ).first()
    if not row["scale"] or not row["spread"] or row["spread"] <= 0:
        return most
    return min(max(row["scale"] / row["spread"] - 1, least), most)


def site_rates(evidence: DataFrame) -> tuple[DataFrame, float, float]:
    """(host, path, n, s, host_n, host_s, host_rate) of `evidence` (host, path, p), the global rate, and the path strength."""
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    n, s = hosts.agg(F.coalesce(F.sum("host_n"), F.lit(0)), F.coalesce(F.sum("host_s"), F.lit(0.0))).first()
    rate = min(max(s / n if n else 0.05, 1e-4), 1 - 1e-4)
    kappa = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s"), F.lit(rate).alias("parent")))
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + kappa * rate) / (F.col("host_n") + kappa))
    rated = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    under = strength(rated.select("n", "s", F.col("host_rate").alias("parent")))
    return rated.withColumn("kappa", F.lit(kappa)), rate, under


def posterior(site: Column, p: Column, rate: float, under: float) -> Column:
    """A document's probability of low quality given its own evidence and its site's, its own share left out."""
    host = (site["host_s"] - p + site["kappa"] * rate) / (site["host_n"] - 1 + site["kappa"])
    near = F.least(F.greatest((site["s"] - p + under * host) / (site["n"] - 1 + under), F.lit(1e-4)), F.lit(1 - 1e-4))
    own = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = own / (1 - own) * near / (1 - near) * ((1 - rate) / rate)
    return odds / (1 + odds)


SITES = 100_000  # rows of about 100 bytes that may go to every executor


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, name: str) -> DataFrame:
    """All columns of `docs` and, as `name`, the posterior probability of low quality.

    The sites' sums are read twice over: evidence is computed once for the sums and once for the rows, which keeps rows
    and columns as they are whatever repeats among them. A null host or path is a site of its own.
    """
    model = train_writing(docs, labels)
    at = [f"_{name}_{k}" for k in ("p", "host", "path")]
    scored = with_evidence(docs, model, at[0])
    narrow = with_evidence(docs.select(F.col("text").cast("string").alias("text"), host.alias("host"), path.alias("path")), model, "p")
    sites, rate, under = site_rates(narrow.select("host", "path", "p"))
    sites = stored(sites.withColumnsRenamed({c: f"{at[0]}_{c}" for c in sites.columns}), "quality-sites")
    if sites.count() <= SITES:  # a bounded table: the texts stay where they are
        sites = F.broadcast(sites)
    with_site = scored.withColumn(at[1], host).withColumn(at[2], path)
    joined = with_site.join(
        sites, F.col(at[1]).eqNullSafe(F.col(f"{at[0]}_host")) & F.col(at[2]).eqNullSafe(F.col(f"{at[0]}_path"))
    )
    site = F.struct(*[F.col(f"{at[0]}_{c}").alias(c) for c in ("n", "s", "host_n", "host_s", "kappa")])
    value = let(site, lambda x: posterior(x, F.col(at[0]), rate, under))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], value.alias(name))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_low_quality, rejected) for every row: a posterior of `threshold` or more rejects.

    A null or empty text is judged by its features, all zero. Repeated and null ids have their rows; columns other than
    doc_id, text, host and path are not read; an empty table gives no rows; without labels every document has the
    default rate and stays.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host, path)
    out = judged(docs, labels, F.col(host), F.col(path), "p_low_quality")
    return out.select("doc_id", "p_low_quality", (F.col("p_low_quality") >= threshold).alias("rejected"))


def without_poor(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that `quality` does not reject, with their own columns."""
    name = "_p_" + "_".join(docs.columns)  # longer than, so unlike, any column
    return judged(docs, labels, F.col(host), F.col(path), name).where(F.col(f"`{name}`") < threshold).select(docs.columns)
