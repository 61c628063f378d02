"""Language identification by word-first backoff.

A model holds, for every language, log frequencies of the words seen in training and of the character n-grams inside
words. A known word scores by its frequency in each language. An unseen word falls back to its longest n-grams that
are known; if it has none of them, to shorter ones, down to single characters. A text's scores are the sums over its
words, and its language the best one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe import slices
from weftline.llm.common import SMALL_ROWS, give_back, map_batches

UNDETERMINED = "und"
#: Bytes of text that the training sample of all languages together holds at most; each has an equal part.
SAMPLE_BYTES = 16 << 20
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """Rows of `table` are log frequencies by language, `words` and `grams` (by length) say which."""

    languages: list[str]
    table: np.ndarray
    words: dict[str, int]
    grams: list[dict[str, int]]

    def backoff(self, word: str) -> np.ndarray | None:
        """Mean scores of the longest n-grams of the word that are known; None if not even a character is."""
        padded = f"<{word}>"
        for n in range(len(self.grams), 0, -1):
            known = self.grams[n - 1]
            source = padded if n > 1 else word
            found = [known[g] for i in range(len(source) - n + 1) if (g := source[i : i + n]) in known]
            if found:
                return self.table[found].mean(0)
        return None

    def scores(self, text: str, unseen: dict[str, np.ndarray | None]) -> np.ndarray | None:
        """Summed scores by language, None for a text without a letter. unseen keeps what unseen words score."""
        found = LETTERS.findall(text.lower())
        if not found:
            return None
        numbers = list(map(self.words.get, found))
        total = self.table[[i for i in numbers if i is not None]].sum(0)
        if None in numbers:
            for word, n in Counter(w for w, i in zip(found, numbers, strict=True) if i is None).items():
                if word not in unseen:
                    if len(unseen) >= 100_000:
                        unseen.clear()
                    unseen[word] = self.backoff(word)
                if (score := unseen[word]) is not None:
                    total = total + n * score
        return total

    def predict(self, text: str | None, unseen: dict[str, np.ndarray | None] | None = None) -> tuple[str, float]:
        """The language, of equal scores the first by name, and its posterior among the languages."""
        total = self.scores(text or "", {} if unseen is None else unseen)
        if total is None or not self.languages:
            return UNDETERMINED, 0.0
        share = np.exp(total - total.max())
        return self.languages[int(total.argmax())], float(share.max() / share.sum())


def train(rows: list[tuple[str, str]], longest: int = 4, least: int = 2) -> Model:
    """rows: (language, text). Words and n-grams seen `least` times or more are known. Frequencies are smoothed and relative to each language's words or n-grams of that length."""
    languages = sorted({lang for lang, _ in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    words: defaultdict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for lang, text in rows:
        for word, n in Counter(LETTERS.findall(text.lower())).items():
            words[word][place[lang]] += n
    counts = [words] + [defaultdict(lambda: np.zeros(len(languages))) for _ in range(longest)]
    for word, n in words.items():
        padded = f"<{word}>"
        for size in range(1, longest + 1):
            source = padded if size > 1 else word
            for i in range(len(source) - size + 1):
                counts[size][source[i : i + size]] += n
    index, table = [], []
    for found in counts:
        kept = sorted(g for g, n in found.items() if n.sum() >= least)
        index.append({g: len(table) + i for i, g in enumerate(kept)})
        totals = sum((found[g] for g in found), np.zeros(len(languages)))
        table += [np.log((found[g] + 0.5) / (totals + 0.5 * (len(found) + 1))) for g in kept]
    return Model(languages, np.array(table).reshape(len(table), len(languages)), index[0], index[1:])


def training_rows(docs: DataFrame, per_language: int, condition: Column, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """(language, text) of at most per_language labelled documents of each language, and of all together at most sample_bytes.

    The documents of a language come in the order of a hash of id and text. Those with over its part of the bytes are
    passed over, and the sample ends before the sum of the others goes beyond that part.
    """
    labelled = docs.filter(condition & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumns({"place": F.xxhash64("doc_id", "text"), "bytes": F.octet_length("text")})
    languages = labelled.select("lang").distinct().count()
    if not languages:
        return []
    part = sample_bytes // languages
    order = Window.partitionBy("lang").orderBy("place", F.col("doc_id").asc_nulls_first())

    def within(rows: DataFrame) -> DataFrame:
        first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
        return first.withColumn("sum", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("sum") <= part)

    short = labelled.filter(F.col("bytes") <= part)
    last = within(short.select("lang", "place", "bytes", "doc_id")).groupBy("lang").agg(F.max("place").alias("last"))
    # Texts are looked up by where the sample ends; rows alike at its end are cut once more, with their texts.
    near = short.join(F.broadcast(last) if languages <= SMALL_ROWS else last, "lang").filter(F.col("place") <= F.col("last"))
    return sorted((r["lang"], r["text"]) for r in within(near.select("lang", "text", "place", "bytes", "doc_id")).select("lang", "text").collect())


def held_out() -> Column:
    """Documents never learnt from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def with_language(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """doc (docs' own columns as a struct), lang_pred, score; see identify_languages."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, per_language, ~held_out())))
    held = docs.select(F.struct("*").alias("doc"))
    place = held.schema["doc"].dataType.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unseen = model.value, {}
        for batch in batches:
            for part in slices(batch, batch.column("doc").field(place)):
                found = [known.predict(text, unseen) for text in part.column("doc").field(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc", "lang_pred", "score"])
        unseen.clear()
        give_back()

    return map_batches(held, run, T.StructType([held.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify_languages(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    The model is fitted on a bounded sample of labelled documents of each language, of those not held out (see
    training_rows); a prediction sees the whole text, however long, and nothing else. lang_pred is `und`, with score 0, for
    a text that is null or has no letter, and for all texts if nothing is labelled. score is the posterior of the predicted
    language. A null doc_id is not held out. Repeated rows are predicted alike. Other columns are not read. An empty table
    gives no rows.
    """
    found = with_language(docs.select("doc_id", "text", "lang"), per_language)
    return found.select("doc.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
