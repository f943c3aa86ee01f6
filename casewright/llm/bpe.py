"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid out as one array of symbols. An index maps each rank (a pair that the
vocabulary merges) to all positions where the pair stands; the active ranks are applied in ascending order, each
to all its positions at once, and only the lists of the neighbouring pairs are updated. As a merge can only use
symbols that earlier ranks make (checked when the vocabulary is read), this gives what merging word by word gives.

The vocabulary file is read in each worker from the given path: JSON of a byte-level BPE with a word-end suffix,
NFC, lower case, and white space dropped. Which characters are letters and what their lower case is follows the
installed tokenizers library also where its Unicode tables are newer or older than Python's.

Edge cases: a null or empty text has no ids and decodes to an empty text; the special tokens' strings in a text
are their ids; repeated rows are encoded alike; an empty table gives an empty result; other columns of the input
are ignored, or kept by `encode_documents`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_batches, pieces, tidy

#: Words whose ids a task remembers between batches.
REMEMBERED = 50_000
#: Bytes of text whose words are in a worker's memory at once.
PIECE = 1 << 20


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def _distinct(at: np.ndarray) -> np.ndarray:
    """The values in ascending order, each once."""
    at = np.sort(at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) > 1 else at


@lru_cache(maxsize=1)
def newer_characters() -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """Letters and digits that are symbols to the installed library, and characters with lower case forms that only it has.

    Libraries differ in the age of their Unicode tables; these are the characters newer than Python's own, each
    looked up once in the library, on the driver.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points: list[str] = []
    for start in range(0, 0x110000, 0x1000):
        unknown = "".join([c for c in map(chr, range(start, start + 0x1000)) if unicodedata.category(c) == "Cn"])
        points += regex.findall(r"[\p{L}\p{N}]", unknown)
    line = "".join(points)
    known = {c for word, _ in pre_tokenizers.Split(Regex(r"[^\p{L}\p{N}]+"), "removed").pre_tokenize_str(line) for c in word}
    lower = normalizers.Lowercase().normalize_str("\n".join(points)).split("\n")
    return tuple(c for c in points if c not in known), tuple((c, low) for c, low in zip(points, lower) if low != c.lower())


class Vocabulary:
    def __init__(self, path: str, newer: tuple[tuple[str, ...], tuple[tuple[str, str], ...]] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        self.inner = np.array([ids[s] for s in _byte_symbols()], np.int64)
        self.final = np.array([ids[s + end] for s in _byte_symbols()], np.int64)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.left, self.right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        born = np.full(max(self.tokens) + 1, -1)
        born[self.made[::-1]] = np.arange(len(merges))[::-1]
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that only a later rank makes")
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # Most texts hold Latin letters only; there the same classes are spelt out for the faster module.
        latin = "".join(map(chr, range(0x250)))
        letters, digits, white = ("".join(map(re.escape, regex.findall(p, latin))) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{digits}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")
        self.latin_words = re.compile(spelt)
        self.other = re.compile("[\u0250-\U0010ffff]")
        symbols, lower = newer_characters() if newer is None else newer
        points = list(map(ord, symbols))
        self.lower = {ord(c): low for c, low in lower}
        firsts = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
        lasts = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts))
        least = min([*points, *self.lower], default=0x110000)
        self.high = re.compile(f"[{chr(least)}-\U0010ffff]") if least < 0x110000 else None
        self.newer = re.compile("[" + ranges + "".join(map(chr, self.lower)) + "]") if least < 0x110000 else None
        old = pattern.replace(r"\s", r"\p{White_Space}").replace(r"[\p{L}]+", f"[\\p{{L}}--[{ranges}]]+").replace(r"[\p{N}]", f"[\\p{{N}}--[{ranges}]]")
        self.older_words = regex.compile(old.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]||[{ranges}]]"), regex.V1) if ranges else self.words
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each non-empty word."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(c) for c in coded])
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        n = len(symbols)
        following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        previous[ends - sizes] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Add the positions whose pair has a rank to the index."""
            at = at[following[at] >= 0]
            found = self.ranks(symbols[at], symbols[following[at]])
            at, found = at[found >= 0], found[found >= 0]
            by = np.argsort(found, kind="stable")
            at, found = at[by], found[by]
            if not len(at):
                return
            firsts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist()]
            for s, e, r in zip(firsts, [*firsts[1:], len(at)], found[firsts].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[s:e])

        note(np.arange(n))
        while active:
            r = heapq.heappop(active)
            at = _distinct(np.concatenate(index.pop(r)))
            nxt = following[at]
            at = at[(symbols[at] == self.left[r]) & (nxt >= 0) & (symbols[nxt] == self.right[r])]
            if self.left[r] == self.right[r] and len(at) > 1:  # runs of one symbol: from the left, without overlap
                keep, taken = [], -1
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = int(following[p])
                    else:
                        taken = -1
                at = np.array(keep)
            if not len(at):
                continue
            gone = following[at]
            symbols[at] = self.made[r]
            symbols[gone] = -1
            following[at] = following[gone]
            behind = following[at] >= 0
            previous[following[at][behind]] = at[behind]
            before = previous[at]
            note(_distinct(np.concatenate([at, before[before >= 0]])))
        alive = symbols >= 0
        kept = symbols[alive]
        return np.split(kept, np.cumsum(np.add.reduceat(alive.astype(np.int64), ends - sizes))[:-1])

    def split(self, text: str) -> list[str]:
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not self.other.search(plain):
            return self.latin_words.findall(plain)
        older = self.high and self.high.search(plain) and self.newer.search(plain)
        if older:
            plain = plain.translate(self.lower)
        return (self.older_words if older else self.words).findall(plain)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, as little-endian 32-bit integers, and the decoded text."""
        split = []
        for text in texts:
            parts = self.marks.split(text) if self.marks and self.marks.search(text) else [text]
            split.append([w for p in parts for w in ([p] if p in self.special else self.split(p))])
        if len(self.ids) > REMEMBERED:
            self.forget()
        if not self.ids:
            self.ids |= {t: np.uint32(i).astype("<u4").tobytes() for t, i in self.special.items()}
            self.texts |= {t: t for t in self.special}
        new = list(set().union(*split).difference(self.ids))
        if new:
            for word, ids in zip(new, self.merge(new)):
                self.ids[word] = ids.astype("<u4").tobytes()
                self.texts[word] = " ".join([self.tokens[i] for i in ids.tolist()])
        return [(b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.texts.__getitem__, words))) for words in split]

    def forget(self) -> None:
        """Drop the words that were remembered."""
        self.ids.clear()
        self.texts.clear()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def vocabulary(path: str, newer: tuple) -> Vocabulary:
    return Vocabulary(path, newer)


def _encode(batches, path: str, whole: bool, newer: tuple):
    vocab = vocabulary(path, newer)
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            found = vocab.encode([t or "" for t in piece.column("text").to_pylist()])
            out = {"n_tokens": pa.array([len(i) // 4 for i, _ in found], pa.int64())}
            out["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string())
            out["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in found], pa.string())
            if whole:
                out["ids"] = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in found], pa.list_(pa.int32()))
                out["decoded"] = pa.array([d for _, d in found], pa.string())
            names = [n for n in piece.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *out.values()], [*names, *out])
    vocab.forget()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, with `whole`, ids (array<int>) and decoded (string)."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return narrow.mapInArrow(tidy(partial(_encode, path=path, whole=whole, newer=newer_characters())), f"`{id_col}` long, {DIGESTS}" + ", ids array<int>, decoded string" * whole)
