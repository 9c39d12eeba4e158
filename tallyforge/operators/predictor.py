"""The facade: a fitted model, candidates, scores, and a report, each as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.draws import BLUES, dim
from . import energy, sampler, stats


@dataclass(frozen=True)
class Prediction:
    recommendations: DataFrame  # r1..r6, blue, energy, score: best first
    ranked: DataFrame  # r1..r6, blue, count, share: what the chains visited most often
    diagnostics: DataFrame  # chain, samples, acceptance, r (lag-one autocorrelation of energies)
    marginals: DataFrame  # colour, ball, p: share of the candidates that hold the ball
    n_candidates: int


@dataclass
class Predictor:
    """prepare, then candidates and scores, or predict for all of it. Without candidates (none asked for)
    the whole space is scored exactly instead, which needs no sampling."""

    spark: SparkSession
    half_life: float = 200
    min_support: float = 0.01
    strictness: float = 0.8
    seed: int = 0
    model: energy.Model | None = None

    def prepare(self, draws: DataFrame, mine: bool = True) -> energy.Model:
        self.model = energy.fit(draws, self.half_life, self.min_support, mine=mine)
        return self.model

    def _fitted(self) -> energy.Model:
        if self.model is None:
            raise ValueError("prepare comes first")
        return self.model

    def sampled(self, n: int, n_chains: int = 4) -> DataFrame:
        """n samples in all, of seeded chains side by side."""
        return sampler.sample(self.spark, self._fitted(), max(1, n // n_chains), n_chains, self.seed)

    def candidates(self, samples: DataFrame) -> DataFrame:
        """Distinct states that meet the constraints."""
        return sampler.distinct_states(samples).where(energy.constraints(self._fitted(), self.strictness))

    def scored(self, candidates: DataFrame) -> DataFrame:
        """Candidates with energy and score, of their own blue too."""
        m = self._fitted()
        return candidates.select("reds", "blue").withColumns({"energy": energy.energy(m) + energy.of_blue(m, "energy"), "score": energy.score(m) + energy.of_blue(m, "score")})

    def predict(self, top_n: int = 10, n_samples: int = 10_000) -> Prediction:
        m = self._fitted()
        if n_samples <= 0:
            whole = energy.recommend(self.spark, m, top_n, self.strictness)
            none = self.spark.createDataFrame([], sampler.SCHEMA)
            return Prediction(whole, stats.rank_by_frequency(none), none.select("chain"), energy.marginal_exact(self.spark, m).select(F.lit("red").alias("colour"), "ball", "p"), 0)
        samples = self.sampled(n_samples)
        found = self.candidates(samples)
        keys = [*[f"r{k}" for k in range(1, 7)], "blue"]
        best = self.scored(found).select(*[F.get("reds", F.lit(k)).alias(f"r{k + 1}") for k in range(6)], "blue", "energy", "score")
        n = found.count()
        share = energy.marginal_share(found).select(F.lit("red").alias("colour"), "ball", "p")
        blues = dim(self.spark, BLUES).join(found.groupBy("blue").agg(F.count("*").alias("c")).withColumnRenamed("blue", "ball"), "ball", "left")
        share = share.unionByName(blues.select(F.lit("blue").alias("colour"), "ball", (F.coalesce("c", F.lit(0)) / max(n, 1)).alias("p")))
        chains = samples.groupBy("chain").agg(F.count("*").alias("samples"), F.max("acceptance").alias("acceptance")).join(sampler.autocorrelation(samples), "chain")
        return Prediction(best.orderBy(F.desc(F.round("score", 9)), *keys).limit(top_n), stats.rank_by_frequency(samples, top_n), chains, share, n)


def report(found: Prediction, reds: int = 12, blues: int = 8) -> DataFrame:
    """(section, place, line): the prediction as lines of text."""
    balls = lambda: F.concat_ws(" ", *[F.lpad(F.col(f"r{k}").cast("string"), 2, "0") for k in range(1, 7)])
    combo = F.format_string("%s + %02d", balls(), F.col("blue"))
    best = _numbered(found.recommendations, "score").select(F.lit("recommendations").alias("section"), "place", F.format_string("%s  score %.2f", combo, F.col("score")).alias("line"))
    often = _numbered(found.ranked, "share").where("place <= 5").select(F.lit("ranked").alias("section"), "place", F.format_string("%s  %.3f %%", combo, F.col("share") * 100).alias("line"))
    out = best.unionByName(often)
    for colour, k in (("red", reds), ("blue", blues)):
        own = _numbered(found.marginals.where(F.col("colour") == colour), "p", "ball").where(F.col("place") <= k)
        out = out.unionByName(own.select(F.lit(f"marginals {colour}").alias("section"), "place", F.format_string("%02d  %.2f %%", F.col("ball"), F.col("p") * 100).alias("line")))
    return out


def _numbered(rows: DataFrame, by: str, *ties: str) -> DataFrame:
    """Rows (of a report: a few dozen) with their place by falling value."""
    from pyspark.sql import Window

    ties = ties or (*[f"r{k}" for k in range(1, 7)], "blue")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(by, 9)), *ties)))
