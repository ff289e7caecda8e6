"""A compression classifier: two zstandard dictionaries, one of good and one of bad labelled texts.

A text is cut into chunks; each is compressed with either dictionary. The difference of the two sizes for each byte of the
text becomes a score by a logistic calibration. Dictionaries are trained on one half of the labelled sample, the calibration is
fitted on the other half, so it sees the sizes of texts that the dictionaries don't hold; its intercept is moved from the
sample's class shares to those of all training labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches

#: The classifier is fitted on at most this many labelled documents of each class, those with the smallest hash of their id, of
#: texts up to this many bytes; all texts are scored whole.
PER_CLASS, FITTED_BYTES = 800, 1 << 16
DICTIONARY, CHUNK, LEVEL = 48 << 10, 4096, 3


def _chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


class Difference:
    """How much smaller a text gets with the good dictionary than with the bad one, for each byte of the text."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for data in (good, bad):
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))

    def __call__(self, text: bytes) -> float:
        if not text:
            return 0.0
        good, bad = (sum(len(c.compress(x)) for x in _chunks(text)) for c in self.compressors)
        return (bad - good) / len(text)


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts; where there are too few to train one, their raw content."""
    parts = [c for t in texts for c in _chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY] or b"\0" * 8


class Calibration:
    """A logistic fit of the label on the difference, by Newton steps with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60):
        self.mean, self.scale = x.mean(), max(x.std(), 1e-9)
        self.w = np.zeros(2)
        terms = self._terms(x)
        for _ in range(rounds):
            p = self._share(terms)
            bend = (terms * (p * (1 - p))[:, None]).T @ terms + 1e-2 * np.eye(2)
            step = np.linalg.solve(bend, terms.T @ (y - p) - 1e-2 * self.w)
            self.w = self.w + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-9:
                break

    def _terms(self, x: np.ndarray) -> np.ndarray:
        return np.stack([(x - self.mean) / self.scale, np.ones(len(x))], 1)

    def _share(self, terms: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(terms @ self.w, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._share(self._terms(x))


class Model:
    """Dictionaries and calibration of labelled rows (doc_id, text, quality); totals: all training labels of class 0 and 1."""

    def __init__(self, rows: list[tuple[int, str, int]], totals: tuple[int, int]):
        halves: dict[tuple[int, int], list[bytes]] = {(q, h): [] for q in (0, 1) for h in (0, 1)}
        seen = [0, 0]
        for _, text, quality in rows:
            halves[quality, seen[quality] % 2].append((text or "").encode())
            seen[quality] += 1
        self.dictionaries = tuple(dictionary([t for t in halves[q, 0] if t] or [b""]) for q in (1, 0))
        difference = Difference(*self.dictionaries)
        rest = [(difference(t), q) for q in (0, 1) for t in halves[q, 1]]
        self.calibration, self.constant = None, 0.5
        if len({q for _, q in rest}) == 2:
            x, y = np.array([m for m, _ in rest]), np.array([q for _, q in rest], float)
            self.calibration = Calibration(x, y)
            self.calibration.w[-1] += np.log(totals[1] / totals[0]) - np.log(y.sum() / (len(y) - y.sum()))
        elif sum(totals):
            self.constant = (totals[1] + 1) / (sum(totals) + 2)

    def scores(self, difference: Difference, texts: list[str | None]) -> np.ndarray:
        if self.calibration is None or not texts:
            return np.full(len(texts), self.constant)
        return self.calibration(np.array([difference((t or "").encode()) for t in texts]))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[tuple[int, str, int]], tuple[int, int]]:
    """The labelled rows that the classifier is fitted on (doc_id, text, quality), and all training labels of class 0 and 1.

    A document takes part once, with the smallest of its texts if its doc_id repeats; one that is labelled both ways doesn't.
    """
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~_held_out("id") & F.col("quality").isin(0, 1)).groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.where("quality = most").select("id", "quality")
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(per_class) for q in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * per_class rows of two numbers
    met = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FITTED_BYTES).join(sample, F.col("doc_id") == F.col("id"))
    # repeats of a doc_id are reduced before they are sent: at most 2 * per_class texts of FITTED_BYTES come to the driver
    rows = met.groupBy("id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    found = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    return sorted((r.id, r.text, r.quality) for r in rows), (found.get(0, 0), found.get(1, 0))


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text; other columns are ignored).

    labels: doc_id, quality; rows whose crc32(doc_id) mod 3 is 1 are never learnt from. A score depends on the text alone.
    Null and empty texts get the score of a difference of 0. With too few labels to calibrate, every score is the share of good
    labels, one added to each class; without labels it is 0.5. Labels that repeat count once; a document that is labelled both
    ways is not learnt from. Rows that repeat a doc_id are each scored; a null doc_id is never held out. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = Model(*training_rows(docs, labels, per_class))

    def run(batches):
        difference = Difference(*model.dictionaries)
        for batch in batches:
            for part in blocks([batch], "text"):
                score = model.scores(difference, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
