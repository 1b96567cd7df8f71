"""Quality classifier with hierarchical empirical Bayes over sites.

1. A document classifier: logistic regression on form statistics of the whole text, fitted on a bounded sample of
   labelled rows. Its log likelihood ratio is a document's evidence.
2. Site posteriors: grouped sums of the classifier's probabilities by host and by path within the host give Beta-binomial
   estimates; a host is shrunk toward the global rate and a path toward its host, with strengths estimated from the
   spread between groups (method of moments), so sparse sites stay close to what lies above them.
3. A document's quality is its evidence on top of its path's log odds, the latter weighted by SITE_WEIGHT.

Sums combine before the shuffle; the table of posteriors is joined to documents by an ordinary equi-join, which Spark
broadcasts only below its size limit.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siteweave.llm import _logit
from siteweave.llm._common import materialize

#: Labelled rows that the document classifier is fitted on, at most: one of each labelled id.
SAMPLE = 20_000
#: Part of the site's log odds that counts: the sites' rates stem from the same classifier, not from labels.
SITE_WEIGHT = 0.25
KEEP = 0.5

MARKS = "%$#&*!|<>{}[]=_~^\\/"
ENDS = re.compile(r"[^\w\s]{2,}(?=\s|$)")
FEATURES = 14


def features(text: str | None) -> np.ndarray:
    """Form statistics of a whole text; of an empty one all are zero."""
    t = text or ""
    out = np.zeros(FEATURES)
    words = t.split()
    if not words:
        return out
    n, chars = len(words), max(1, len(t))
    upper = sum(map(str.isupper, words))
    counts = Counter(words)
    lines = [x for x in t.split("\n") if x.strip()]
    marks = sum(t.count(m) for m in MARKS)
    out[0] = np.log1p(n)
    out[1] = np.sqrt(marks / chars)
    out[2] = upper / n
    out[3] = len(ENDS.findall(t)) / n
    out[4] = 1 - len(counts) / n
    out[5] = max(counts.values()) / n if n > 4 else 0
    out[6] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[7] = 1 - len(set(lines)) / max(1, len(lines))
    out[8] = np.log(max(1, chars / n))
    out[9] = np.sqrt(t.count("|") / n)
    out[10] = np.sqrt(sum(map(str.isdigit, words)) / n)
    out[11] = len(counts) / n * np.log1p(n)
    out[12] = sum(len(x) > 40 for x in words) / n
    out[13] = np.log1p(max(map(len, lines), default=0))
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float

    def evidence(self, texts: pd.Series) -> np.ndarray:
        """Log likelihood ratios: log odds less those of the sample."""
        if not len(texts):
            return np.zeros(0)
        x = np.clip((np.stack([features(t) for t in texts]) - self.mean) / self.scale, -30, 30)
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30) - np.log(self.rate / (1 - self.rate))


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit the document classifier on at most SAMPLE of the labelled rows for which `learn` (of doc_id) holds, those with the least hashes."""
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learn)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # so many rows at most are broadcast
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(own), "doc_id")
    # of a repeated id the row whose text has the least hash
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r")).select("r.text", "r.y")

    def described(frames):
        for f in frames:
            yield pd.DataFrame({"y": f["y"], "x": [features(t).tolist() for t in f["text"]]})

    got = rows.select("y", "text").mapInPandas(described, "y double, x array<double>").toPandas()
    if got["y"].nunique() < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), 0.5)
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy()
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.clip((x - mean) / scale, -30, 30)
    return Model(mean, scale, _logit.fit(z, y), float(y.mean()))


def _strength(groups: DataFrame, n: str, rate: str, up: str) -> float:
    """Of a Beta prior with mean `up` over groups with `n` rows and rate `rate`: by moments of the spread beyond sampling, between 1 and 10,000."""
    v = F.col(up) * (1 - F.col(up))
    got = groups.agg(
        F.sum(F.col(n) * (F.col(rate) - F.col(up)) ** 2).alias("spread"), F.sum(v).alias("within"), F.sum(F.col(n) * v).alias("scaled"), F.count(F.lit(1)).alias("k")
    ).first()
    if not got["k"] or not got["scaled"]:
        return 100.0
    part = max(0.0, ((got["spread"] or 0.0) - got["within"]) / got["scaled"])
    return float(min(10_000.0, max(1.0, 1 / part - 1))) if part > 0 else 10_000.0


def posteriors(scored: DataFrame) -> DataFrame:
    """scored (host, path, p) -> host, path, n, host_rate, path_rate: shrunk rates, global over host over path."""
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    n, s = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    rate = min(0.999, max(0.001, (s or 0.0) / n)) if n else 0.5
    hosts = hosts.withColumn("up", F.lit(rate)).withColumn("raw", F.col("host_s") / F.col("host_n"))
    a = _strength(hosts, "host_n", "raw", "up")
    hosts = hosts.select(F.col("host").alias("__h"), ((F.col("host_s") + a * rate) / (F.col("host_n") + a)).alias("host_rate"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("__h"))).drop("__h").withColumn("raw", F.col("s") / F.col("n"))
    b = _strength(both, "n", "raw", "host_rate")
    return both.select("host", "path", "n", "host_rate", ((F.col("s") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))


def classified(docs: DataFrame, model: Model, text: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """docs with three more columns: __evidence, __site (the path's rate) and __quality, the probability of quality 1.

    host and path default to the columns source and lang. Null hosts and paths are groups of their own. Null texts are
    empty. Two passes over the texts, so that they need not be moved; all columns of docs stay as they are.
    """
    host = F.col("source").cast("string") if host is None else host
    path = F.col("lang").cast("string") if path is None else path
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.evidence(texts), dtype="float64")

    odds = float(np.log(model.rate / (1 - model.rate)))
    p = 1 / (1 + F.exp(-(F.col("e") + odds)))
    scored = docs.select(host.alias("host"), path.alias("path"), evidence(F.col(text)).alias("e")).select("host", "path", p.alias("p"))
    sites = materialize(posteriors(scored), "sites")
    sites = sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("path_rate").alias("__site"))
    out = docs.select(*[docs[c] for c in docs.columns], evidence(docs[text]).alias("__evidence"), host.alias("__own_host"), path.alias("__own_path"))
    out = out.join(sites, F.col("__own_host").eqNullSafe(F.col("__host")) & F.col("__own_path").eqNullSafe(F.col("__path")), "left")
    site = F.log(F.col("__site") / (1 - F.col("__site")))
    z = F.col("__evidence") + odds + SITE_WEIGHT * (site - odds)
    return out.select(*[docs[c] for c in docs.columns], "__evidence", "__site", (1 / (1 + F.exp(-z))).alias("__quality"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, evidence, site_rate, quality, keep per row of docs; keep: quality of KEEP or more.

    An empty or null text has the evidence of its (zero) statistics. Without labels of both kinds evidence is 0 and
    quality 0.5, which keeps. Null ids and repeated rows are scored like others. Other columns than id, text, source and
    lang are not looked at.
    """
    own = classified(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "source", "lang"), train(docs, labels, ~held_out(), doc_id, text))
    return own.select("doc_id", held_out().alias("held_out"), F.col("__evidence").alias("evidence"), F.col("__site").alias("site_rate"), F.col("__quality").alias("quality"), (F.col("__quality") >= KEEP).alias("keep"))
