"""Multi-site protocols over an exchange folder: each site uploads sums of its own rows only, and reads those of all.

Steps of the null model: moments -> (pooled) update -> convergence; of the test: statistics -> pooled p-values; of the
meta-analysis: scores and variances -> pooled. Tables carry site and iteration as columns; names hold them too, so that
an upload is made once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.operators import models as L
from siteweave.sources import exchange as X


class Federation:
    def __init__(self, spark: SparkSession, folder: str, sites: int, epsilon: float = 1e-5, kind: str = "NATIVE", wait: float = 3600) -> None:
        self.spark, self.folder, self.sites, self.epsilon, self.kind, self.seconds = spark, folder, sites, epsilon, kind, wait

    def _all(self, what: str) -> DataFrame:
        """The table of every site, once all are there."""
        names = [f"{what}_site_{k}" for k in range(self.sites)]
        X.wait(self.spark, self.folder, names, self.seconds)
        return reduce(DataFrame.unionByName, [X.download(self.spark, self.folder, n) for n in names])

    # ---- null model ----
    def beta(self, iteration: int, p: int) -> list[float]:
        """Weights before an iteration: zero at first."""
        if iteration == 0:
            return [0.0] * p
        rows = X.download(self.spark, self.folder, f"beta_iter_{iteration}").orderBy("feat_idx").collect()
        return [r["w"] for r in rows]

    def share_moments(self, iteration: int, site: int, data: DataFrame, p: int) -> None:
        """A site's X'WX, X'Wz and log-likelihood; data (x, y)."""
        own = data.withColumn("site", F.lit(site))
        X.upload(L.irls_moments(own, self.beta(iteration, p), self.kind), self.folder, f"moments_iter_{iteration}_site_{site}")

    def update(self, iteration: int, p: int, mask: str | None = "full") -> list[float]:
        """Pool, invert under masks, and upload the weights for the next iteration and Z."""
        rows = self._all(f"moments_iter_{iteration}").collect()
        parts, rhs = {}, np.zeros(p)
        for r in rows:
            m = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    m[i, j] = m[j, i] = r[f"xtwx_{i}_{j}"]
            parts[r["site"]] = m
            rhs += [r[f"xtwz_{i}"] for i in range(p)]
        z = L.masked_inverse(parts, mask, 1 + iteration)
        beta = (z @ rhs).tolist()
        X.upload(self.spark.createDataFrame([(k, w) for k, w in enumerate(beta)], "feat_idx int, w double"), self.folder, f"beta_iter_{iteration + 1}")
        X.upload(self.spark.createDataFrame([(i, j, float(z[i, j])) for i in range(p) for j in range(p)], "row int, col int, v double"), self.folder, f"z_iter_{iteration + 1}")
        return beta

    def converged(self, iteration: int) -> bool:
        """Whether the pooled log-likelihood moved by less than epsilon since the iteration before."""
        if iteration == 0:
            return False
        ll = [self._all(f"moments_iter_{k}").agg(F.sum("ll")).first()[0] for k in (iteration - 1, iteration)]
        return abs(ll[1] - ll[0]) < self.epsilon

    def fit(self, data: list[DataFrame], p: int, epochs: int = 10, mask: str | None = "full") -> int:
        """All sites' steps in turn, for one process that holds them all; the number of the last weights."""
        for iteration in range(epochs):
            for site, own in enumerate(data):
                self.share_moments(iteration, site, own, p)
            self.update(iteration, p, mask)
            if self.converged(iteration):
                return iteration + 1
        return epochs

    def z(self, iteration: int, p: int) -> np.ndarray:
        out = np.zeros((p, p))
        for r in X.download(self.spark, self.folder, f"z_iter_{iteration}").collect():
            out[r["row"], r["col"]] = r["v"]
        return out

    # ---- tests ----
    def share_statistics(self, site: int, geno: DataFrame, data: DataFrame, iteration: int, p: int) -> None:
        """A site's sums for each variant; data (subject_idx, x, y)."""
        own = L.fitted(data.withColumn("site", F.lit(site)), self.beta(iteration, p), self.kind)
        X.upload(L.score_stats(geno, own, p, ["site", "var_idx"]), self.folder, f"stats_site_{site}")

    def p_values(self, iteration: int, p: int) -> DataFrame:
        """(var_idx, score, s, t, chisq, p) of the pooled sums."""
        pooled = self._all("stats").groupBy("var_idx").agg(*[F.sum(c).alias(c) for c in ("score", "gwg", *[f"gwx_{i}" for i in range(p)])])
        return L.tested(pooled, self.z(iteration, p), ["var_idx"])

    def share_summary(self, site: int, summary: DataFrame) -> None:
        """(var_idx, score, var) of a site's own analysis."""
        X.upload(summary.select(F.lit(site).alias("site"), "var_idx", "score", "var"), self.folder, f"summary_site_{site}")

    def meta(self) -> DataFrame:
        return L.meta(self._all("summary"))


