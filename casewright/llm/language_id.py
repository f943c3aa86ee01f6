"""Language identification by interpolated Kneser-Ney character models.

Each language gets a model of order 4 over lower-case letters, with runs of all other characters as one space.
Its n-grams (up to four 16-bit characters in one 64-bit key) lie in sorted arrays of mixed keys, beside their
interpolated log probabilities and the back-off weights of their contexts. A text goes to the model with the
lowest cross-entropy per character; a text whose cross-entropy is above what held-back texts of that language
show is marked as rejected.

Training takes at most `per_language` documents of each language, those with the smallest hash of the id: that
bound is a parameter, and all counts are taken over these documents' whole texts.

Edge cases: a null or empty text, and one without letters, is `und` with score 0; ties go to the language that
sorts first; repeated rows are predicted alike; no training rows make every text `und`; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import bounded_batches, bounded_join, materialise, mix, pieces, tidy

ORDER = 4
#: Documents of each language that a model is trained on, at most.
PER_LANGUAGE = 1500
#: Quantile of the held-back cross-entropies, and the margin in nats above it, that calibrate rejection.
QUANTILE, MARGIN = 0.995, 0.15


#: Stand for all letters and for all combining marks beyond the basic plane; no text has them as letters of its own.
HIGH_LETTER, HIGH_MARK = 0xFFFD, 0xFFFC


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """For each character of the basic plane whether it is a combining mark: part of a word, but no letter."""
    table = np.array([unicodedata.category(chr(i))[0] == "M" for i in range(0x10000)])
    table[HIGH_MARK] = True
    return table


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each character of the basic plane its lower-case letter, or a space."""
    table = np.full(0x10000, 0x20, np.uint16)
    for i in range(0x10000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else i
    return table


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character, where each text's characters begin, and each text's letters.

    A text is preceded by spaces of its own, so a neighbour in the batch has no part in it.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = _letters()[np.minimum(raw, 0xFFFF)]
    high = raw >= 0x10000  # one sign for all letters beyond the basic plane
    if high.any():
        kinds, which = np.unique(raw[high], return_inverse=True)
        chars[high] = np.array([{"L": HIGH_LETTER, "M": HIGH_MARK}.get(unicodedata.category(chr(k))[0], 0x20) for k in kinds.tolist()], np.uint16)[which]
    row = np.repeat(np.arange(len(texts)), sizes)
    space = chars == 0x20
    first = np.zeros(len(chars), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.empty_like(space)
    before[:1], before[1:] = True, space[:-1]
    keep = ~(space & (before | first))
    chars, row, letter = chars[keep].astype(np.uint64), row[keep], ~space[keep]
    letters = np.bincount(row[letter & ~_marks()[chars.astype(np.int64)]], minlength=len(texts))
    at = np.arange(len(chars)) + (ORDER - 1) * (row + 1)
    padded = np.full(len(chars) + (ORDER - 1) * (len(texts) + 1), 0x20, np.uint64)
    padded[at] = chars
    keys = padded[at]
    for j in range(1, ORDER):
        keys |= padded[at - j] << np.uint64(16 * j)
    return keys, np.searchsorted(row, np.arange(len(texts) + 1)), letters


class Model:
    """Interpolated Kneser-Ney model: for each order, sorted hashes with log probabilities and back-off weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float = 0.75):
        self.levels = []
        lower = None
        self.alphabet = max(2, len(np.unique(keys & np.uint64(0xFFFF))))
        tables = {ORDER: (keys, counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # how many different characters stand before each shorter n-gram
            shorter, times = np.unique(tables[n + 1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
            tables[n] = (shorter, times.astype(np.float64))
        for n in range(1, ORDER + 1):
            grams, c = tables[n]
            context, where = np.unique(grams >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(where, c), np.bincount(where)
            below = lower(grams) if lower else np.full(len(grams), 1 / (self.alphabet + 1))
            weight = discount * kinds / total
            p = np.maximum(c - discount, 0) / total[where] + weight[where] * below
            self.levels.append((*self._sorted(grams, np.log(p)), *self._sorted(context, np.log(weight))))
            lower = partial(self._level, n)

    @staticmethod
    def _sorted(keys, values):
        hashed = mix(keys)
        by = np.argsort(hashed)
        return hashed[by], values[by].astype(np.float32)

    @staticmethod
    def _find(hashes, values, keys, missing):
        wanted = mix(keys)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        hit = hashes[at] == wanted
        return np.where(hit, values[at], missing), hit

    def log(self, n: int, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each n-gram after the others."""
        if n == 0:
            return np.full(len(grams), -np.log(self.alphabet + 1), np.float32)
        grams = grams & np.uint64((1 << 16 * n) - 1) if n < ORDER else grams
        hashes, values, contexts, weights = self.levels[n - 1]
        found, hit = self._find(hashes, values, grams, np.float32(0))
        rest = ~hit
        if rest.any():
            weight, _ = self._find(contexts, weights, grams[rest] >> np.uint64(16), np.float32(0))
            found[rest] = weight + self.log(n - 1, grams[rest])
        return found

    def _level(self, n: int, grams: np.ndarray) -> np.ndarray:
        return np.exp(self.log(n, grams))


def entropies(models: list[Model], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text (row) under each model (column), and each text's letters."""
    keys, starts, letters = keys_of(texts)
    out = np.zeros((len(texts), len(models)))
    if len(keys):
        distinct, where = np.unique(keys, return_inverse=True)
        n = np.diff(starts)
        full = n > 0
        for k, model in enumerate(models):
            out[full, k] = -np.add.reduceat(model.log(ORDER, distinct)[where].astype(np.float64), starts[:-1][full]) / n[full]
    return out, letters


def _count(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            rows = np.flatnonzero(langs == lang)
            keys, _, _ = keys_of([t or "" for t in batch.column("text").take(pa.array(rows)).to_pylist()])
            grams, counts = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict:
    """Models and rejection thresholds by language, from at most per_language rows of docs each."""
    first = Window.partitionBy("lang").orderBy("u", "id")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    # A language's share of hashes that holds about twice the wanted rows: only these are sorted, at any size.
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).select("lang", (F.lit(2.0 * per_language * (1 << 31)) / F.col("rows")).alias("most"))
    near = bounded_join(rows, materialise(share), "lang", "inner", limit=10_000).where("u < most").drop("most")
    sample = materialise(near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).drop("u"))
    counts = sample.where("k % 10 <> 0").mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    held = sample.where("k % 10 = 0").select("lang", "text").toPandas()
    models = {}
    for lang, own in sorted(counts.groupby("lang")):
        grams, n = own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy()
        model = Model(grams, n)
        back = held.loc[held["lang"] == lang, "text"].tolist()
        seen, letters = entropies([model], back) if back else (np.zeros((0, 1)), np.zeros(0))
        seen = seen[letters > 0, 0]
        models[lang] = (model, float(np.quantile(seen, QUANTILE)) + MARGIN if len(seen) else float("inf"))
    return models


def _predict(batches, models: dict):
    names, parts = list(models), [m for m, _ in models.values()]
    limits = np.array([t for _, t in models.values()])
    for batch in batches:
        for piece in pieces(batch, "text"):
            ce, letters = entropies(parts, [t or "" for t in piece.column("text").to_pylist()])
            known = (letters > 0) & bool(names)
            best = ce.argmin(axis=1) if names else np.zeros(len(letters), int)
            lowest = ce.min(axis=1) if names else np.zeros(len(letters))
            odds = np.exp(-(ce - lowest[:, None]) * np.clip(letters, 1, 50)[:, None]).sum(axis=1) if names else np.ones(len(letters))
            rejected = known & (lowest > limits[best]) if names else known
            cols = {
                "lang_pred": pa.array([names[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                "score": pa.array(np.where(known, 1 / odds, 0.0)),
                "cross_entropy": pa.array(np.where(known, lowest, np.nan), from_pandas=True),
                "rejected": pa.array(rejected | ~known),
            }
            keep = [n for n in piece.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in keep), *cols.values()], [*keep, *cols])


def identify(docs: DataFrame, models: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1), cross_entropy (nats per character) and rejected of each row."""
    bounded_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(models)
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return narrow.mapInArrow(tidy(lambda batches: _predict(batches, spread.value)), f"`{id_col}` long, lang_pred string, score double, cross_entropy double, rejected boolean")
