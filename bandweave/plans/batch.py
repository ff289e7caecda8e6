"""The batch preparation of a data set: words, weights, latent vectors and similarity matrices, each stage made once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import cumulative_bands
from ..operators import similarity, symbolic, weights
from ..operators.latent import Technique, latent
from .stages import Stages


def prepare(series: DataFrame, stages: Stages, r: int = 3, width: int = 3, stride: int = 3, k: int = 4, techniques: tuple[Technique, ...] = tuple(Technique)) -> dict[str, DataFrame]:
    """Tables by name: words, statistics, weights, vocabulary, and for each weighting (tf, tfidf) and technique the latent
    vectors `latent_<weighting>_<technique>` and their cosines `sim_<weighting>_<technique>`. Object ids must be numbers.
    """
    stages = stages.of(series)
    bands = cumulative_bands(r)
    shape = {"r": r, "width": width, "stride": stride}
    scaled = symbolic.minmax(series)
    out = {
        "statistics": stages.get("statistics", lambda: symbolic.statistics(scaled)),
        "words": stages.get("words", lambda: symbolic.windows(symbolic.quantise(scaled, bands), width, stride), ("component",), **shape),
    }
    out["weights"] = stages.get("weights", lambda: weights.tf_idf(out["words"]), **shape)
    out["vocabulary"] = stages.get("vocabulary", lambda: weights.vocabulary(out["words"]), **shape)
    for weighting in ("tf", "tfidf"):
        vectors = stages.get("vectors", lambda w=weighting: weights.dense(out["weights"], out["vocabulary"], out["words"], w), **shape, weighting=weighting)
        objects = vectors.select(F.col("object_id").alias("id"), "vec")
        for technique in techniques:
            name = f"{weighting}_{technique.value}"
            held = stages.get("latent", lambda t=technique, o=objects: latent(o, t, k)[0], **shape, k=k, model=name)
            out[f"latent_{name}"] = held
            out[f"sim_{name}"] = stages.get("sim", lambda h=held: similarity.matrix(h, "cosine", dict(h.dtypes)["id"]), **shape, k=k, model=name)
    return out
