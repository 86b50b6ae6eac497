"""Compression quality classifier.

zstandard dictionaries are trained on good and on bad labelled text.  Each window
of a text is compressed with both; the difference of the sizes over their sum
says which kind of text explains the window better.  Means and extremes over the
windows are calibrated to the probability of good quality.  A class weighs as the square
root of its share of the training labels, between equal weights and the shares
themselves, and even odds lie at the threshold of 0.7.

Defined results: null and empty texts get the score of a text without windows
(zero features); every input row is scored whole, repeated ids included; without
labelled rows of both classes every score is 1; a null id is not held out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm import compression as C
from veritome.llm import textkit as K

MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Bounds of the training sample: rows a class.
SAMPLE = {1: 2000, 0: 2000}
WINDOW, DICTIONARY_BYTES = 512, 32768


def dictionary(texts: list[str]) -> tuple[bytes, bool]:
    """A dictionary trained on all windows of the whole texts."""
    return C.trained([w for t in texts for w in C.windows(t.encode(), WINDOW)], DICTIONARY_BYTES)


class Model:
    def __init__(self, texts: dict[int, list[str]], rows: dict[int, int] | None = None) -> None:
        """``rows`` are the training labels of each class; without them both weigh the same."""
        good, bad = texts[1], texts[0]
        self.calibration, self._pair = None, None
        if not good or not bad:
            return
        # Half of each class makes the dictionaries and the other half the calibration, so that no text meets its own words.
        self.good, self.bad = dictionary(good[::2]), dictionary(bad[::2])
        good, bad = good[1::2] or good, bad[1::2] or bad
        x = np.array([self.features(t.encode()) for t in [*good, *bad]])
        y = np.repeat([1.0, 0.0], [len(good), len(bad)])
        share = np.sqrt([(rows or {}).get(1, 1), (rows or {}).get(0, 1)])
        share /= share.sum()
        self.calibration = C.Calibration(x, y, np.repeat(share / [len(good), len(bad)], [len(good), len(bad)]) * len(y), ridge=0.05)
        self.calibration.shift(THRESHOLD)

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def features(self, raw: bytes) -> list[float]:
        if self._pair is None:
            self._pair = C.compressor(*self.good), C.compressor(*self.bad)
        pieces = C.windows(raw, WINDOW)
        if not pieces:
            return [0.0] * 4
        g = np.fromiter(map(len, map(self._pair[0].compress, pieces)), float, len(pieces))
        b = np.fromiter(map(len, map(self._pair[1].compress, pieces)), float, len(pieces))
        n = np.fromiter(map(len, pieces), float, len(pieces))
        lean = (g - b) / (g + b)
        return [(g - b).sum() / (g + b).sum(), np.average(lean, weights=n), lean.max(), lean.min()]

    def score(self, data: np.ndarray, offs: np.ndarray) -> dict:
        if self.calibration is None:
            p = np.ones(len(offs) - 1)
        else:
            raw = data.tobytes()
            p = self.calibration(np.array([self.features(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], float).reshape(len(offs) - 1, 4))
        return {"score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return Model(C.sample(docs, labels, label, MODULUS, HELD_OUT, SAMPLE), C.label_counts(labels, label, MODULUS, HELD_OUT))


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every row."""
    scored = K.map_documents(docs, model.score, [("score", T.DoubleType()), ("predicted", T.IntegerType())], id_col, text_col)
    return scored.select(id_col, F.coalesce(C.remainder(F.col(id_col), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
