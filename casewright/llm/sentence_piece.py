"""SentencePiece encoding and decoding (merge type) with a table of last tokens of prefixes.

A text's encoding by merges has a property that makes it a table: each prefix has one encoding, and a sequence of tokens
is an encoding just when each pair of neighbours is. So one pass over the matches of an automaton of all pieces gives,
for every prefix, its one last token: the match whose left neighbour, the last token of the prefix before it, is
compatible with it. Two tokens are compatible if merging their joined characters gives them back. The ids are then
recovered backwards from the end. The work is linear in the text, however long a run without spaces is.

No piece holds a space after another character (checked when the model is read), so merges never cross such a
boundary: the table is made for each distinct word once, for all prefixes of one length of many words side by side, and a
task remembers words between batches.

Characters that no piece holds become the ids of their bytes. The model file is read in each worker from the given
path; its pieces and their scores are read by the sentencepiece library, which does none of the encoding.

Edge cases: a null or empty text has only the end id and decodes to an empty text; strings of control pieces in a text
are ordinary text; the character that stands for a space is taken as one; repeated rows are encoded alike; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_batches, pieces, tidy

#: Words whose ids a worker remembers in each of two generations (about 250 bytes each), and pairs whose compatibility it
#: remembers; both stay for its next task.
REMEMBERED, PAIRS = 250_000, 500_000
#: Characters of a word up to which words are worked on side by side; bytes of text whose words are in memory at once.
LONGEST, PIECE = 64, 1 << 20
#: The character that stands for a space in pieces.
SPACE = "▁"


class Model:
    def __init__(self, path: str):
        read = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(read.get_piece_size())
        self.end = read.eos_id()
        texts = read.id_to_piece(list(ids))
        self.byte = {int(texts[i][1:-1], 16): i for i in ids if read.is_byte(i)}
        ordinary = [i for i in ids if not (read.is_byte(i) or read.is_control(i) or read.is_unknown(i))]
        self.id_of = {texts[i]: i for i in ordinary}
        self.score = {i: read.get_score(i) for i in ordinary}
        self.text = {i: texts[i] for i in ordinary}
        self.known = set().union(*self.id_of)
        if len(self.byte) != 256 or any(read.is_unused(i) for i in ids) or read.normalize(" éＡ  x ") != f"{SPACE}{SPACE}éＡ{SPACE}{SPACE}x{SPACE}":
            raise ValueError("only models with byte fallback, a leading space and no normalisation or unused pieces can be read")
        if not self.known <= set(self.id_of) or any(SPACE in t.lstrip(SPACE) for t in self.id_of):
            raise ValueError("a piece holds a character that is no piece, or a space after another character")
        self.bytes = {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()} | {i: bytes([b]) for b, i in self.byte.items()} | {self.end: b"", -1: b""}
        self.length = np.zeros(len(texts), np.int64)
        for text, i in self.id_of.items():
            self.length[i] = len(text)
        self._automaton()
        # a line break that no piece holds parts words, too
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*" if "\n" in self.known else f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+")
        self.neighbours = np.array(sorted({ord(a) << 32 | ord(b) for t in self.id_of for a, b in zip(t, t[1:])}), np.int64)
        self.decimal = np.array([str(i) for i in ids], object)
        self.reached = np.array([i in self.text and self.merged(list(self.text[i])) == [self.text[i]] for i in ids])
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        #: Decimal ids of remembered words, the younger generation and the older one.
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _automaton(self) -> None:
        """A trie of all pieces as arrays: edges by (state, character) in order, their target states, and each state's piece."""
        self.letters = np.full(0x110000, 0, np.int32)
        self.letters[sorted(map(ord, self.known))] = np.arange(1, len(self.known) + 1)
        states, edges, tokens = {"": 0}, {}, [-1]
        for text in sorted(self.id_of, key=len):
            for n in range(1, len(text) + 1):
                if text[:n] not in states:
                    states[text[:n]] = len(tokens)
                    edges[states[text[: n - 1]] << 16 | int(self.letters[ord(text[n - 1])])] = len(tokens)
                    tokens.append(-1)
            tokens[states[text]] = self.id_of[text]
        self.edges = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.tokens = np.array(tokens, np.int64)
        self.roots = np.full(len(self.known) + 1, -1, np.int64)
        self.roots[self.edges[self.edges < 1 << 16]] = self.targets[self.edges < 1 << 16]

    def matches(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of all matches; a match from a position has at most `room` characters."""
        letter = self.letters[codes]
        start = np.flatnonzero(letter)
        state = self.roots[letter[start]]
        starts, found, n = [], [], 1
        while len(start):
            token = self.tokens[state]
            hit = token >= 0
            starts.append(start[hit])
            found.append(token[hit])
            more = room[start] > n
            start, state = start[more], state[more]
            key = state << 16 | letter[start + n]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[at] == key
            start, state, n = start[on], self.targets[at[on]], n + 1
        return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges: the best score first, the leftmost of equal ones."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.id_of.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the joined characters of two pieces are merged to just these two, pair by pair."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(0, len(self.pair_keys) - 1))
        known = self.pair_keys[at] == keys if len(self.pair_keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = np.unique(keys[~known])
            parts = [(self.text[k >> 32], self.text[k & 0xFFFFFFFF]) for k in new.tolist()]
            fits = np.array([self.merged([*a, *b]) == [a, b] for a, b in parts])
            if len(self.pair_keys) > PAIRS:
                self.pair_keys, self.pair_fits = self.pair_keys[:0], self.pair_fits[:0]
                new, where = np.unique(keys, return_index=True)
                return self.compatible(left[where], right[where])[np.searchsorted(new, keys)]
            into = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, into, new), np.insert(self.pair_fits, into, fits)
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_fits[at]

    def last_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each prefix of each word the last token of its encoding, words one after another, and where words start.

        A prefix that ends with a character that no piece holds has -1.
        """
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        last = np.full(int(sizes.sum()), -1, np.int64)
        first = np.repeat(starts, sizes)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin, token = self.matches(codes, np.repeat(starts + sizes, sizes) - np.arange(len(last)))
        begin, token = begin[self.reached[token]], token[self.reached[token]]
        end = begin + self.length[token] - 1
        # prefixes of one length after another: what stands before a match is settled when the match is looked at
        depth = end - first[end]
        by = np.argsort(depth, kind="stable")
        end, token, begin = end[by], token[by], begin[by]
        cuts = np.searchsorted(depth[by], np.arange(int(sizes.max(initial=0)) + 1))
        for s, e in zip(cuts, cuts[1:]):
            before = np.where(begin[s:e] > first[end[s:e]], last[begin[s:e] - 1], -1)
            fits = before < 0
            if not fits.all():
                fits[~fits] = self.compatible(before[~fits], token[s:e][~fits])
            last[end[s:e][fits]] = token[s:e][fits]
        return last, starts

    def last_tokens_of(self, word: str) -> np.ndarray:
        """The same for one long word, prefix by prefix."""
        last, fits = [-1] * len(word), {}
        begin, token = self.matches(np.frombuffer(word.encode("utf-32-le"), np.uint32), np.arange(len(word), 0, -1))
        end = begin + self.length[token] - 1
        by = np.argsort(end, kind="stable")
        for b, e, t in zip(begin[by].tolist(), end[by].tolist(), token[by].tolist()):
            if last[e] < 0 and self.reached[t]:
                before = last[b - 1] if b else -1
                if before >= 0 and (before, t) not in fits:
                    if len(fits) > PAIRS:
                        fits.clear()
                    fits[before, t] = self.merged([*self.text[before], *self.text[t]]) == [self.text[before], self.text[t]]
                if before < 0 or fits[before, t]:
                    last[e] = t
        return np.array(last, np.int64)

    def entries(self, words: list[str]) -> list[str]:
        """The decimal ids of each word, recovered backwards from the last tokens; they decode to the word."""
        if not words:
            return []
        if len(words) == 1 and len(words[0]) > LONGEST:
            last, starts = self.last_tokens_of(words[0]), np.zeros(1, np.int64)
        else:
            last, starts = self.last_tokens(words)
        text = "".join(words)
        ends = np.append(starts[1:], len(last))
        step = np.where(last >= 0, self.length[last], 1)
        kept = np.zeros(len(last), bool)
        if len(words) == 1:
            at, steps = len(last) - 1, step.tolist()
            while at >= 0:
                kept[at] = True
                at -= steps[at]
        else:
            at, first = ends - 1, starts
            while len(at):
                kept[at] = True
                at = at - step[at]
                inside = at >= first
                at, first = at[inside], first[inside]
        where = np.flatnonzero(kept)
        found = last[where]
        ids, decoded = self.decimal[found].tolist(), [self.bytes[i] for i in found.tolist()]
        for k in np.flatnonzero(found < 0).tolist():
            c = text[where[k]]
            spelt = [self.byte[b] for b in c.encode()]
            ids[k], decoded[k] = " ".join(map(str, spelt)), b"".join([self.bytes[i] for i in spelt])
        if b"".join(decoded).decode() != text.replace(SPACE, " "):
            raise ValueError("ids don't decode to their words")
        cuts = np.searchsorted(where, np.append(starts, len(last))).tolist()
        return [" ".join(ids[s:e]) for s, e in zip(cuts, cuts[1:])]

    def parted(self, word: str) -> list[str]:
        """A word cut between characters that no piece holds side by side, where no merge can reach across."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 32 | codes[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pairs), len(self.neighbours) - 1)
        cuts = [0, *(np.flatnonzero(self.neighbours[at] != pairs) + 1).tolist(), len(word)]
        return [word[s:e] for s, e in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text the decimal ids with the end id, their number, and the decoded text."""
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        split = [[p for w in words for p in (self.parted(w) if len(w) > LONGEST else (w,))] if max(map(len, words), default=0) > LONGEST else words for words in split]
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        distinct = set().union(*split)
        known = {w: self.old[w] for w in distinct if w in self.old}
        known |= {w: self.young[w] for w in distinct if w in self.young}
        new = list(distinct.difference(known))
        short = [w for w in new if len(w) <= LONGEST]
        known |= dict(zip(short, self.entries(short)))
        self.young |= known
        known |= {w: self.entries([w])[0] for w in new if len(w) > LONGEST}
        end = str(self.end)
        joined = [" ".join([*map(known.__getitem__, words), end]) for words in split]
        # each word's ids were decoded to it, so the text is what all of them decode to, but for the leading space
        return [(ids, ids.count(" ") + 1, t.replace(SPACE, " ")) for ids, t in zip(joined, texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as a decoder that only has the ids makes it."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _encode(batches, path: str, whole: bool):
    loaded = model(path)
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            found = loaded.encode([t or "" for t in piece.column("text").to_pylist()])
            out = {"n_tokens": pa.array([n for _, n, _ in found], pa.int64())}
            out["ids_sha256"] = pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _, _ in found], pa.string())
            out["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for _, _, d in found], pa.string())
            if whole:
                out["ids"] = pa.array([np.array(i.split(" "), np.int32) for i, _, _ in found], pa.list_(pa.int32()))
                out["decoded"] = pa.array([d for _, _, d in found], pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("id"), *out.values()], ["id", *out])


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, with `whole`, ids (array<int>) and decoded (string), row by row."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole
    return narrow.mapInArrow(tidy(partial(_encode, path=path, whole=whole)), kinds).withColumnRenamed("id", id_col)
