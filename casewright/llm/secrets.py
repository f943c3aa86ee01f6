"""Secret scan: patterns, and dictionary-primed compression novelty for what the patterns leave.

Base spans come from three patterns. Then each remaining run of token characters in a sensitive context is measured if
it has 16 characters or more, with a letter and a digit among them (runs of letters alone are words and names, runs of
digits alone are numbers, as a rule; such secrets are left to the patterns): the bytes it adds when it is compressed after its surroundings, by a zstandard compressor that is
primed with a dictionary of identifiers, over its length. Names and words of code are cheap there; random strings
aren't, and are reported as kind `novel`.

The dictionary holds the `IDENTIFIERS` most frequent identifiers of all documents, counted relationally. A run of
any length is measured: a long one in overlapping pieces.

Edge cases: a null or empty text has no spans; spans count code points, ends exclusive, and those of one kind
never overlap; repeated rows are scanned alike; identifiers of one frequency enter by name; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_batches, tidy

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: A run of token characters that could be a secret, and the words before it that make the context sensitive.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"auth|bearer|credential|private|pwd|pass|secret|token|key|cert|signature|session|cookie|login|access", re.IGNORECASE)
BEFORE, AROUND = 64, 256
#: Longer runs are measured in overlapping pieces of this length.
PIECE = 200
#: Characters of runs, and the dot that joins them to one token.
_CHAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")
#: Marginal compressed bytes for each character from which a string counts as incompressible.
NOVEL = 0.55

#: Identifiers in the dictionary, and what counts as one: letters and underscores, so that no key with a digit is one.
IDENTIFIERS, IDENTIFIER = 2000, r"[A-Za-z_]{3,40}"


def identifiers(docs: DataFrame, text_col: str = "text", n: int = IDENTIFIERS) -> bytes:
    """The n most frequent identifiers of all texts as a dictionary; the most frequent ones come last, where they are cheapest."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(IDENTIFIER), F.lit(0))).alias("word"))
    most = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n).collect()
    return " ".join(r["word"] for r in reversed(most)).encode()


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=6, write_content_size=False)
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=6)
    return zstandard.ZstdCompressor(dict_data=primed, write_content_size=False)


def novelty(text: str, start: int, end: int, dictionary: bytes = b"") -> float:
    """Bytes that text[start:end] adds to its compressed surroundings, for each of its characters."""
    around = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]).encode()
    zip_ = _compressor(dictionary).compress
    return (len(zip_(around + b"\n" + text[start:end].encode())) - len(zip_(around))) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _novel_part(text: str, start: int, end: int, dictionary: bytes) -> tuple[int, int] | None:
    """The novel part of a run: all of it, or in a long run from the first novel piece to the end of the last."""
    if end - start <= PIECE:
        return (start, end) if novelty(text, start, end, dictionary) >= NOVEL else None
    starts = [*range(start, end - PIECE, PIECE // 2), end - PIECE]
    first = next((p for p in starts if novelty(text, p, p + PIECE, dictionary) >= NOVEL), None)
    if first is None:
        return None
    return first, next(p for p in reversed(starts) if p == first or novelty(text, p, p + PIECE, dictionary) >= NOVEL) + PIECE


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes = b"") -> list[tuple[int, int, int]]:
    found = []
    ahead, reached = 0, -1  # base spans that begin before the run's end, and the farthest end among them
    chain, last = 0, -1  # where the dotted token of the last run began, and where that run ended
    for m in CANDIDATE.finditer(text) if any(c in text for c in "0123456789") else ():
        s, e = m.span()
        head = s
        while head > 0 and head != last and text[head - 1] in _CHAIN:
            head -= 1
        chain, last = chain if head == last else head, e
        while ahead < len(base) and base[ahead][0] < e:
            reached = max(reached, base[ahead][2])
            ahead += 1
        if reached > s:
            continue
        # the later parts of a dotted token have the context of its beginning, too
        if not SENSITIVE.search(text, max(0, s - BEFORE), s) and not SENSITIVE.search(text, max(0, chain - BEFORE), chain):
            continue
        part = _novel_part(text, s, e, dictionary)
        if part:
            found.append((part[0], 3, part[1]))
    return found


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches, dictionary: bytes):
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            every = sorted(base + novel_spans(text or "", base, dictionary))
            n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
            rows.append((*n[:3], hashlib.sha256(_named(base).encode()).hexdigest(), _named(every), n[3]))
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["id", *names])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = narrow.mapInArrow(tidy(partial(_scan, dictionary=identifiers(docs, text_col))), "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
    return found.withColumnRenamed("id", id_col)
