"""Language identification with bit-sliced Bloom filters over character n-grams.

Every slot of one table holds a bitmask with a bit per language, so the masks at an
n-gram's hash positions, ANDed, give at once all languages whose filter contains it.
Per-language counts over a text's n-grams are turned into hit rates, each corrected
for its filter's false-positive rate f (from the slots it fills):
(hits/n - f) / (1 - f).  The highest corrected rate decides, and is the score.

A language's filter holds the n-grams frequent in it: the ``per_language`` most
frequent, counted by Spark over a bounded sample of labelled rows (about
``sample_rows``, chosen by a hash of id and text).  Prediction reads whole texts and only
them; every row is predicted.

Defined results: null text, and text without a letter, is ``und`` with score 0;
null labels never teach; with nothing to learn from, everything is ``und``; ties go
to the alphabetically first language; repeated rows are judged alike and null ids are
answered; very long texts are counted in slices; other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kestrel.llm.rows import small_batches

UNDECIDED = "und"
#: Lengths of the n-grams, in characters; a word is padded by one space on each side.
GRAMS = (2, 3, 4)
#: Odd multipliers of the rolling key and of the two filter positions (fixed values).
KEY = 0x9E3779B97F4A7C15
PROBES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Code points above this hold no letters.
CODES = 0x34000
SLICE = 1 << 20


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Lower-case code point of every letter; a space (32) for all else."""
    out = np.full(CODES, 32, dtype=np.uint32)
    for c in range(CODES):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _folding()[np.where(codes < CODES, codes, 32)]


def _squeezed(text: str) -> np.ndarray:
    """Letters, lower-cased, in words with one space around each."""
    codes = np.concatenate(([32], _letters(text), [32])).astype(np.uint64)
    space = codes == 32
    return codes[~(space & np.concatenate(([False], space[:-1])))]


def gram_keys(codes: np.ndarray) -> np.ndarray:
    """Keys of all n-grams; 21 bits a character make them unique up to 3, hashed beyond."""
    out = []
    for n in GRAMS:
        if len(codes) >= n:
            key = np.zeros(len(codes) - n + 1, dtype=np.uint64)
            for i in range(n):
                key = key * np.uint64(KEY) + codes[i : len(codes) - n + 1 + i] + np.uint64(1)
            out.append(key)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    mixed = keys ^ (keys >> np.uint64(29))
    return [((mixed * np.uint64(p)) >> np.uint64(64 - bits)).astype(np.int64) for p in PROBES]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: (words of 64 languages, slots)
    masks: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], bits: int = 17) -> Model:
        languages = tuple(sorted(grams))
        masks = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), dtype=np.uint64)
        fill = np.zeros(len(languages))
        for k, language in enumerate(languages):
            word, bit = divmod(k, 64)
            for at in _slots(grams[language], bits):
                np.bitwise_or.at(masks[word], at, np.uint64(1 << bit))
            fill[k] = ((masks[word] >> np.uint64(bit)) & np.uint64(1)).mean()
        return cls(languages, masks, fill ** len(PROBES))

    def rates(self, text: str) -> np.ndarray | None:
        """Corrected hit rate of every language; None if the text has no letter."""
        bits = int(self.masks.shape[1]).bit_length() - 1
        hits, total = np.zeros(len(self.languages), dtype=np.int64), 0
        for at in range(0, len(text), SLICE):
            codes = _squeezed(text[at : at + SLICE])
            if len(codes) < 3:
                continue
            keys = gram_keys(codes)
            slots = _slots(keys, bits)
            total += len(keys)
            for word in range(len(self.masks)):
                mask = self.masks[word][slots[0]] & self.masks[word][slots[1]]
                own = self.languages[64 * word : 64 * word + 64]
                for bit in range(len(own)):
                    hits[64 * word + bit] += int(np.count_nonzero(mask & np.uint64(1 << bit)))
        if not total:
            return None
        return np.clip((hits / total - self.false_rate) / (1 - self.false_rate), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        rates = self.rates(text) if text and self.languages else None
        if rates is None:
            return UNDECIDED, 0.0
        best = int(rates.argmax())
        return self.languages[best], float(rates[best])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id, as text, divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 20_000,
    per_language: int = 2_500,
) -> Model:
    """Learn from labelled rows that are not held out; about ``sample_rows`` of them."""
    small_batches(docs.sparkSession)
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull())
    rows = labelled.count()
    # A share of the hash range, not a sort: no task gathers the sample.
    share = min(1.0, sample_rows / max(1, rows))
    at = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(1 << 30))
    chosen = labelled.where(F.col(text_col).isNotNull() & (at < int(share * (1 << 30)))).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                keys = [
                    gram_keys(_squeezed(t[at : at + SLICE]))
                    for own, t in zip(langs, texts, strict=True)
                    if own == lang
                    for at in range(0, len(t), SLICE)
                ]
                found, n = np.unique(np.concatenate(keys), return_counts=True) if keys else ([], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found)), pa.array(np.asarray(found).view(np.int64)), pa.array(n, pa.int64())]
                    if len(found)
                    else [pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())],
                    names=["lang", "gram", "n"],
                )

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= per_language
    )
    # At most per_language rows for each language reach the driver.
    grams: dict[str, list[int]] = {}
    for lang, gram in top.select("lang", "gram").collect():
        grams.setdefault(lang, []).append(gram)
    return Model.build({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in grams.items()})


def predictions(texts: DataFrame, model: Model, text_col: str, out_lang: str, out_score: str) -> DataFrame:
    """``texts`` with predicted language and score; the model travels with the task (a few MB, fixed size)."""
    small_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(names.index(text_col))]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, out_lang, out_score],
            )

    schema = StructType(
        [*texts.schema.fields, StructField(out_lang, StringType()), StructField(out_score, DoubleType())]
    )
    return texts.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    model = fit(docs)
    given = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predictions(given, model, "text", "lang_pred", "score").drop("text")


def accept(
    docs: DataFrame, min_score: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Rows in a known language, all columns: ``und`` and scores under ``min_score`` go."""
    model = fit(docs, id_col, text_col, lang_col)
    named = predictions(docs, model, text_col, "__lang", "__score")
    return named.where((F.col("__lang") != UNDECIDED) & (F.col("__score") >= min_score)).select(*docs.columns)
