"""Quality by compression.

Two Zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed with either,
piece by piece, so that a long text is measured against the dictionaries and not against itself. The difference of the
two sizes over their sum says which of the two it is like, and a logistic curve, fitted on labelled texts that the
dictionaries haven't seen, makes a probability of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe import slices

#: Bytes of a piece and of a dictionary, and the compression level.
PIECE, DICTIONARY, LEVEL = 256, 112 << 10, 3
#: The model is fitted on at most so many labelled rows of a class, of texts of at most so many bytes.
PER_CLASS, LONGEST = 2000, 64 << 10


@dataclass
class QualityModel:
    """Dictionaries of bad and good texts (None where there were none) and the curve 1 / (1 + exp(-(slope * x + offset)))."""

    dictionaries: tuple[bytes | None, bytes | None]
    slope: float = 0.0
    offset: float = 0.0
    piece: int = PIECE
    level: int = LEVEL
    raw: bool = field(default=False)

    @cached_property
    def coders(self) -> list[zstandard.ZstdCompressor]:
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        return [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_dict_id=False) for d in self.dictionaries]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "coders"}

    def difference(self, text: str) -> float:
        """Size with the dictionary of bad texts less that with the one of good texts, over their sum; 0 for an empty text."""
        if None in self.dictionaries or not text:
            return 0.0
        data = text.encode()
        bad, good = (sum(len(coder.compress(data[i : i + self.piece])) for i in range(0, len(data), self.piece)) for coder in self.coders)
        return (bad - good) / (bad + good)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.offset, -500, 500))))


def build_dictionary(texts: list[str], piece: int = PIECE, size: int = DICTIONARY, level: int = LEVEL) -> bytes | None:
    """A trained dictionary of the texts' pieces, None if they are too few to train one."""
    pieces = [data[i : i + piece] for data in map(str.encode, texts) for i in range(0, len(data), piece)]
    try:
        return zstandard.train_dictionary(size, pieces, level=level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, held by a weak prior; with one class only the prior share."""
    scale = float(np.abs(x).max()) if len(x) else 0.0
    z = np.stack([x / scale if scale else x * 0.0, np.ones(len(x))], 1)
    w, ridge = np.zeros(2), np.array([1e-3, 1e-6])
    aim = np.where(y == 1, (np.sum(y == 1) + 1) / (np.sum(y == 1) + 2), 1 / (np.sum(y == 0) + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (aim - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale) if scale else 0.0, float(w[1])


def train(rows: list[tuple[str, int]]) -> QualityModel:
    """rows: (text, label). Of each class every other row goes to its dictionary, the rest to the curve; single rows serve both."""
    texts = {label: [text for text, found in rows if found == label] for label in (0, 1)}
    first = {label: of[::2] for label, of in texts.items()}
    rest = [(text, label) for label, of in texts.items() for text in (of[1::2] or of)]
    labels = np.array([label for _, label in rest])
    model = QualityModel((None, None))
    if all(any(of) for of in first.values()):
        made = tuple(build_dictionary(first[label]) for label in (0, 1))
        raw = None in made
        made = tuple("\n".join(first[label]).encode()[-DICTIONARY:] for label in (0, 1)) if raw else made
        model = QualityModel(made, raw=raw)
    model.slope, model.offset = fit_curve(np.array([model.difference(text) for text, _ in rest]), labels)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, condition: Column, per_class: int = PER_CLASS, longest: int = LONGEST) -> list[tuple[str, int]]:
    """(text, quality) of at most per_class rows of each class, whole texts of at most `longest` bytes, in the order of a hash.

    Rows are chosen among the labels first, so that documents are only looked through for these. Rows that repeat count
    against the bound like others.
    """
    ids = None
    named = labels.filter(condition & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    for label in (0, 1):
        found = named.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = found if ids is None else ids.unionByName(found)
    texts = docs.select("doc_id", "text").filter(condition & F.col("text").isNotNull() & (F.octet_length("text") <= longest)).join(F.broadcast(ids), "doc_id")
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text"))
    return [(r["text"], r["quality"]) for r in texts.withColumn("rank", rank).filter(F.col("rank") <= per_class).select("text", "quality", "rank").orderBy("quality", "rank").collect()]


def held_out() -> Column:
    """Documents whose labels are never learnt: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs' own columns as the struct `doc`, and score: each whole text's probability to be good. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(F.struct("*").alias("doc"))
    place = held.schema["doc"].dataType.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column("doc").field(place)):
                scores = [shared.value.score(text or "") for text in part.column("doc").field(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(scores, pa.float64())], ["doc", "score"])

    return held.mapInArrow(run, T.StructType([held.schema["doc"], T.StructField("score", T.DoubleType())]))


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    The model is fitted on a bounded sample of the labels that aren't held out (see labelled_sample): per_class rows of
    each class at most, of texts of `longest` bytes at most. A score sees the whole text and nothing else. An empty or null
    text has the score of a text that is like neither class. Null labels and labels of unknown documents are passed over; a
    null doc_id is not held out, and is never learnt from. Without labels of both classes every score is the smoothed share
    of good ones (one half without any). Repeated rows are scored alike. Other columns are not read. An empty table gives
    no rows.
    """
    model = train(labelled_sample(docs, labels, ~held_out(), per_class, longest))
    found = score_quality(docs.select("doc_id", "text"), model).select("doc.doc_id", "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
