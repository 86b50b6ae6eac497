"""Compression-distance toxicity.

Two zstandard dictionaries are trained separately, one on the windows of ordinary
texts and one on those of toxic texts.  A window is compressed with the ordinary one
alone and with the toxic one added behind it, so that strings which both know cancel
out; the bytes saved are the window's gain.  Toxic texts are mostly ordinary, so the
toxic dictionary is trained again, several times, on those of its windows that gain as
much as only a few windows of ordinary texts do, and at last to a small size, which
keeps the strings that many of these windows share.

Thresholds on the gain are quantiles of ordinary windows.  A text's largest gains, the
number of its windows beyond each threshold and its mean gain are calibrated to a
probability.  Half of the sampled texts of a class train its dictionary; thresholds
and calibration use the other half.

Defined results: null and empty texts get the score of a text without any gain;
every input row is scored, repeated ids included; without labelled rows of both
classes every score is 0; a null id is not held out.  Training texts and scored texts
of any length are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm import compression as C
from veritome.llm import textkit as K

MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Bounds of the training sample: rows a class.
SAMPLE = {1: 2000, 0: 5000}
#: Bytes of the windows that are scored and of the shorter ones that dictionaries are trained on; shortest match.
WINDOW, TRAINING_WINDOW, MIN_MATCH = 64, 40, 6
#: How dictionaries of toxic text are trained: runs of about ``k`` bytes chosen by their ``d``-byte strings.
COVER = {"k": 16, "d": 8}
#: Bytes of the ordinary dictionary; least and most of the toxic one, and the parts of its training text that it may be: of all toxic windows, and at last of the chosen ones.
ORDINARY_BYTES, TOXIC_BYTES, SHARE, LAST_SHARE = 512 << 10, (512, 2000, 8192), 180, 32
#: Times that the toxic dictionary is trained again, and the ordinary quantile that its windows must reach.
ROUNDS, CHOSEN = 8, 99.8
#: Ordinary quantiles that are the thresholds of the features.
THRESHOLDS = (97.0, 99.5, 99.9)


def _windows(texts: list[str], size: int = TRAINING_WINDOW) -> list[bytes]:
    """Distinct windows of the texts, so that copies count once."""
    return list(dict.fromkeys(w for t in texts for w in C.windows(_blank(t.encode()), size)))


def _blank(raw: bytes) -> bytes:
    return C.blanks(np.frombuffer(raw, np.uint8), True).tobytes()


class Model:
    """Dictionaries and calibration; small enough to travel with a task."""

    def __init__(self, texts: dict[int, list[str]]) -> None:
        toxic, ordinary = texts[1], texts[0]
        self.calibration = None
        self._pair = None
        if not toxic or not ordinary:
            return
        other = ordinary[1::2] or ordinary
        plain, training = _windows(other), _windows(toxic[::2])
        self.ordinary = C.trained(_windows(ordinary[::2]), ORDINARY_BYTES)[0]
        fewest, least_bytes, most_bytes = TOXIC_BYTES
        size = int(np.clip(sum(map(len, training)) // SHARE, least_bytes, most_bytes))
        self._train(training, size)
        for k in range(ROUNDS):
            least = np.percentile(self._gains(plain), CHOSEN)
            if chosen := [w for w, gain in zip(training, self._gains(training)) if gain >= least]:
                self._train(chosen, size if k + 1 < ROUNDS else int(np.clip(sum(map(len, chosen)) // LAST_SHARE, fewest, size)))
        self.thresholds = np.percentile(self._gains(_windows(other, WINDOW)), THRESHOLDS)
        toxic, ordinary = toxic[1::2] or toxic, ordinary[1::2] or ordinary
        x = np.array([self.features(t.encode()) for t in [*toxic, *ordinary]])
        y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
        self.calibration = C.Calibration(x, y, np.ones(len(y)), ridge=0.01)

    def _train(self, windows: list[bytes], size: int) -> None:
        self.toxic, self._pair = C.trained(windows, size, **COVER)[0], None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def _gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        if self._pair is None:
            self._pair = C.compressor(self.ordinary, True, MIN_MATCH), C.compressor(self.ordinary + self.toxic, True, MIN_MATCH)
        ordinary, both = (c.compress for c in self._pair)
        return np.array([len(ordinary(w)) - len(both(w)) for w in windows] or [0])

    def features(self, raw: bytes) -> list[float]:
        gains = self._gains(C.windows(_blank(raw), WINDOW))
        best = np.sort(np.concatenate([[-2, -2, -2], gains]))
        return [min(best[-1], 8), min(best[-2], 8), *(np.log1p((gains > t).sum()) for t in self.thresholds), np.log1p(len(gains)), gains.mean()]

    def score(self, data: np.ndarray, offs: np.ndarray) -> dict:
        if self.calibration is None:
            p = np.zeros(len(offs) - 1)
        else:
            raw = data.tobytes()
            p = self.calibration(np.array([self.features(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], float).reshape(len(offs) - 1, 4 + len(THRESHOLDS)))
        return {"score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    return Model(C.sample(docs, labels, label, MODULUS, HELD_OUT, SAMPLE))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every row."""
    scored = K.map_documents(docs, model.score, [("score", T.DoubleType()), ("predicted", T.IntegerType())], id_col, text_col)
    return scored.select(id_col, F.coalesce(C.remainder(F.col(id_col), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
