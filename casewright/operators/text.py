"""Text jobs over document tables: cleaning, field extraction, classification, chunking, diff, terms, batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words of the search index, and those that term statistics leave out as well.
STOP_WORDS = ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"]


STATISTIC_STOP_WORDS = ["como", "para", "este", "esta", "estos", "estas", "cuando", "donde", "desde", "hasta", "sobre", "entre", "tiene", "tener", "debe", "siendo", "dicha", "dicho", "dichos", "dichas"]


def clean_text(text: Column, patterns: list[str]) -> Column:
    """Drops every pattern (case-insensitive), squeezes blank lines to one and trims."""
    for p in patterns:
        text = F.regexp_replace(text, f"(?i){p}", "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


#: White space at both ends, as String.trim takes it.
_ENDS = r"^\s+|\s+$"


def _rewrite(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


#: Fixed values. Joins lines that break inside a sentence, parts paragraphs at sentence ends, at most one blank line.
LAYOUT = [
    ("\x00", ""),
    (r"\r\n", "\n"),
    (r"\r", "\n"),
    (r"[ \t\f]{2,}", " "),
    (r"([^.\n:;?!\-])\n([a-záéíóúüñ0-9(\"])", "$1 $2"),
    (r"([.!?])\n([A-ZÁÉÍÓÚÜÑ0-9\"])", "$1\n\n$2"),
    (r"\n{3,}", "\n\n"),
    (_ENDS, ""),
]

#: Fixed values. Paragraphs and headings end with a blank line, list items get a bullet, no other tags; &amp; is decoded first.
HTML = [
    (r"(?i)</p>", "\n\n"),
    (r"(?i)</h[1-6]>", "\n\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<li>", "\n• "),
    (r"(?i)</li>", ""),
    (r"<[^>]+>", ""),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    (r"&#[0-9]+;", " "),
    (r"\n{3,}", "\n\n"),
    (_ENDS, ""),
]


def repair_layout(text: Column) -> Column:
    return _rewrite(text, LAYOUT)


def html_to_text(html: Column) -> Column:
    return _rewrite(html, HTML)


#: Patterns of the fields, and what stands for a missing one; a name ends before a comma, a full stop, a line end or words of identification.
_NAME = r"([A-Za-záéíóúüñÁÉÍÓÚÜÑ][A-Za-záéíóúüñÁÉÍÓÚÜÑ\s'.-]{4,80}?)"
DOCKET = r"(?iu)(?:radicado|radicación|rad\.?)\s*(?:no\.?|nro\.?|número\.?)?\s*[:-]?\s*([0-9\s.-]{8,25})"
BARE_DOCKET = r"(?:^|[^A-Za-z0-9_])([0-9]{11,23})(?:$|[^A-Za-z0-9_])"
COURT = r"(?iu)(juzgado\s+[0-9A-Za-z_°.]+\s+(?:municipal|circuito|promiscuo|administrativo|penal|civil|familia|laboral|ejecuci[oó]n)[^,.\n]{0,60})"
CLAIMANT = r"(?iu)(?:accionante|demandante|tutelante|parte\s+actora)\s*[:-]?\s*" + _NAME + r"(?:\s*[,.\n]|\s+(?:cc|c\.c\.|identificad|mayor|con\s+c))"
SELF = r"(?iu)(?:^|[^A-Za-z0-9_])yo[,\s]+" + _NAME + r"[,\s]+(?:identificad|mayor|cc|c\.c\.)"
NO_DOCKET, UNKNOWN = "POR DEFINIR", "PENDIENTE IDENTIFICAR"


def extract_fields(docs: DataFrame, text: str) -> DataFrame:
    """Docket (labelled first, else the first run of 11 to 23 digits), court and claimant (labelled first, else `Yo, NAME, identificado`), in upper case, with defaults."""
    c = F.coalesce(F.col(text), F.lit(""))
    found = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    tidy = lambda x: F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))
    docket = F.coalesce(F.regexp_replace(found(DOCKET), r"[\s.-]", ""), found(BARE_DOCKET), F.lit(NO_DOCKET))
    labelled, alone = tidy(found(CLAIMANT)), tidy(found(SELF))
    claimant = F.when(labelled.isNotNull(), F.when(F.length(labelled) > 4, labelled)).otherwise(alone)
    return docs.withColumns({"docket": docket, "court": F.coalesce(tidy(found(COURT)), F.lit(UNKNOWN)), "claimant": F.coalesce(claimant, F.lit(UNKNOWN))})


def classify_keywords(docs: DataFrame, text: str, categories: list[tuple[str, list[str]]]) -> DataFrame:
    """The first category, in the given order, one of whose keywords stands in the text as a word; else null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(categories):
        pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(r"\Q" + w + r"\E" for w in words) + r")(?![\p{L}\p{N}])"
        out = F.when(F.col(text).rlike(pattern), name).otherwise(out)
    return docs.withColumn("keyword_class", out)


#: The ordinals that number requests.
ORDINALS = ["primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "séptimo", "octavo", "noveno", "décimo"]
_ANY_ORDINAL = "(?:" + "|".join(ORDINALS) + ")"


def split_requests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, label, request) of a petition's requests, each with all its lines up to the next one.

    Numbered items, else ordinals, if there are two at least; else the whole text as one; none of a blank text.
    """
    c = F.regexp_replace(F.col(text), _ENDS, "")
    numbered = F.regexp_extract_all(c, F.lit(r"(?:^|\n)\s*[0-9]{1,2}[.)-]\s*-?\s*([\s\S]+?)(?=\n\s*[0-9]{1,2}[.)-]|\s*\z)"), 1)
    ordinal = rf"(?iu)(?:^|\n)\s*({_ANY_ORDINAL})[:\s.]+([\s\S]+?)(?=\n\s*{_ANY_ORDINAL}[:\s.]|\s*\z)"
    names, parts = (F.regexp_extract_all(c, F.lit(ordinal), i) for i in (1, 2))
    item = lambda label, request: F.struct(label.alias("label"), request.alias("request"))
    by_number = F.transform(numbered, lambda x, i: item(F.concat((i + 1).cast("string"), F.lit(".")), x))
    by_name = F.zip_with(names, parts, lambda n, x: item(F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substring(n, 2, 20)), F.lit(":")), x))
    items = F.when(F.size(numbered) >= 2, by_number).when(F.size(names) >= 2, by_name).when(c != "", F.array(item(F.lit("1."), c)))
    told = docs.select(key, F.posexplode(items).alias("pos", "x"))
    return told.select(key, (F.col("pos") + 1).alias("number"), F.col("x.label").alias("label"), _rewrite(F.col("x.request"), [(r"\n{3,}", "\n\n"), (_ENDS, "")]).alias("request"))


#: Rows, and characters of text from which on, a task's Python works on at once.
FEW_ROWS, FEW_CHARS = 64, 1 << 20


def few_at_once(work, columns: list[tuple[str, pa.DataType]]):
    """A function for mapInArrow: for each row (k, texts...) those of work(texts...), with its k before them.

    An Arrow batch holds up to 10,000 rows. Some of them at a time become Python objects, and what they give goes on
    before the next ones, so a worker's memory follows neither the batch nor the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FEW_ROWS):
                part = batch.slice(at, FEW_ROWS)
                owner: list[int] = []
                out: list[list] = [[] for _ in columns]
                chars = 0
                for i in range(part.num_rows):
                    for row in work(*(c[i].as_py() for c in part.columns[1:])):
                        owner.append(i)
                        chars += len(row[-1])
                        for values, value in zip(out, row):
                            values.append(value)
                    if chars >= FEW_CHARS or i == part.num_rows - 1:
                        arrays = [pa.array(values, kind) for values, (_, kind) in zip(out, columns)]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int32())), *arrays], ["k", *(name for name, _ in columns)])
                        owner, out, chars = [], [[] for _ in columns], 0

    return run


def chunk_text(text: str, size: int, overlap: int, separator: str) -> list[str]:
    """Greedy packing of paragraphs, joined by blank lines; a paragraph that is too long gives sentences, a sentence that is too long hard cuts.

    A chunk begins with the last `overlap` characters of the one before, whatever its size becomes. Text after the
    last sentence end of a long paragraph is a sentence, too.
    """
    units: list[str] = []
    for paragraph in re.split(separator, text or ""):
        if not paragraph.strip():
            continue
        if len(paragraph) <= size:
            units.append(paragraph.strip())
            continue
        now = ""
        for sentence in re.findall(r"[^.!?]*[.!?]+|[^.!?]+$", paragraph):
            if len(now) + len(sentence) <= size:
                now += sentence
                continue
            if now:
                units.append(now.strip())
            now = sentence
            if len(sentence) > size:
                units += [sentence[i : i + size].strip() for i in range(0, len(sentence), size)]
                now = ""
        if now:
            units.append(now.strip())
    chunks: list[str] = []
    now = ""
    for unit in filter(None, units):
        if len(now) + 2 + len(unit) <= size:
            now = f"{now}\n\n{unit}" if now else unit
            continue
        if now:
            chunks.append(now)
        tail = now[-overlap:] if overlap else ""
        now = f"{tail}\n\n{unit}" if tail else unit
    return chunks + [now] if now else chunks


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 1500, overlap: int | None = None, separator: str = r"\n\s*\n") -> DataFrame:
    """(key, number, chunk) for each chunk of each text. Sequential within a document, so an Arrow-batched function."""
    lap = size // 5 if overlap is None else overlap
    if size <= lap:
        raise ValueError("size must be greater than overlap")

    def split(text: str | None) -> list[tuple[int, str]]:
        return list(enumerate(chunk_text(text, size, lap, separator), 1))

    split_all = few_at_once(split, [("number", pa.int32()), ("chunk", pa.string())])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(split_all, f"k {docs.schema[key].dataType.simpleString()}, number int, chunk string").withColumnRenamed("k", key)


def split_sections(text: Column, most: int) -> Column:
    """Whole paragraphs packed into sections of at most `most` characters, without overlap."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state, paragraph):
        joined = F.when(state["now"] == "", paragraph).otherwise(F.concat(state["now"], F.lit("\n\n"), paragraph))
        full = (F.length(joined) > most) & (state["now"] != "")
        return F.struct(F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"), F.when(full, paragraph).otherwise(joined).alias("now"))

    return F.aggregate(F.split(text, r"\n\s*\n"), start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def split_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; the first or last of them may be empty."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(split_tokens(text), lambda w: w != "")


def searchable(docs: DataFrame, columns: list[str], text: str, most: int | None = None) -> Column:
    """The searchable text: the given columns and the whole text, or its first `most` characters; nulls add nothing."""
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in columns), F.col(text) if most is None else F.substring(F.col(text), 1, most))


def words_of(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """The words of a text, lower-case, without stop words and in order."""
    return F.filter(tokens(text), lambda w: ~w.isin(stop))


def token_table(docs: DataFrame, key: str, text: Column, stop: list[str] = STOP_WORDS) -> DataFrame:
    return docs.select(key, F.explode(words_of(text, stop)).alias("word"))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs_of(ordered: Column) -> Column:
    """(word, n) for each distinct word of a sorted array."""
    def runs(words):
        starts = F.filter(F.transform(words, lambda w, i: F.when(~w.eqNullSafe(F.get(words, i - 1)), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda p, i: F.struct(F.get(words, p).alias("word"), (F.coalesce(F.get(at, i + 1), F.size(words)) - p).alias("n"))))

    return bound(ordered, runs)


def term_stats(docs: DataFrame, text: Column, k: int, stop: list[str] = STOP_WORDS, longer_than: int = 4) -> DataFrame:
    """The k words in most documents: documents and occurrences of each.

    A document's words are sorted and counted inside the row; one row a distinct word goes to the one shuffle, by word.
    """
    words = F.array_sort(F.filter(words_of(text, stop), lambda w: F.length(w) > longer_than))
    seen = docs.select(F.inline(runs_of(words)))
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))
    return counts.orderBy(F.desc("documents"), F.desc("occurrences"), "word").limit(k)


def rank_of(words: Column, query: list[str]) -> Column:
    """Occurrences of the query's words / (1 + ln(words)), 1 at most; null where one of them is missing."""
    wanted = F.array(*(F.lit(q) for q in sorted(set(query))))

    def rank(w):
        hits = F.filter(w, lambda x: x.isin(query))
        held = F.forall(wanted, lambda q: F.array_contains(w, q))
        return F.when(held, F.least(F.lit(1.0), F.size(hits) / (1 + F.ln(F.size(w)))))

    return bound(words, rank)


def text_rank(docs: DataFrame, key: str, text: Column, query: list[str]) -> DataFrame:
    """Documents that hold all query words, with their rank; no shuffle. Texts without one of them as a substring aren't split."""
    low = F.lower(text)
    maybe = docs
    for word in sorted(set(query)):
        maybe = maybe.where(low.contains(word))
    # explode, as a filter on the rank would be computed a second time below the projection
    return maybe.select(key, F.explode(F.array_compact(F.array(rank_of(words_of(text), query)))).alias("rank"))


def hash_dedup(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal texts: content hash, first id and number of copies."""
    hashed = docs.select(key, F.sha2(F.col(text), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def paragraphs(docs: DataFrame, key: str, text: str, separator: str) -> DataFrame:
    """(key, pos, paragraph, canonical) with white space collapsed and case folded in the canonical form."""
    split = docs.select(key, F.posexplode(F.split(text, separator)).alias("pos", "paragraph"))
    return split.withColumn("canonical", F.lower(F.trim(F.regexp_replace("paragraph", r"\s+", " ")))).where("canonical <> ''")


def paragraph_delta(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Multiset difference of canonical paragraphs in both directions."""
    left, right = a.select(on, "canonical"), b.select(on, "canonical")
    return left.exceptAll(right).withColumn("side", F.lit("removed")).unionByName(right.exceptAll(left).withColumn("side", F.lit("added")))


#: Fixed values. Lines that begin with one of these words open a paragraph.
CLAUSE_HEADS = "CLÁUSULA CLAUSULA ARTÍCULO ARTICULO PARÁGRAFO PARAGRAFO CAPÍTULO CAPITULO SECCIÓN SECCION TÍTULO TITULO NUMERAL ANEXO CONSIDERANDO OBJETO DEFINICION DEFINICIÓN".split()
_HEAD = re.compile(rf"\s*(?:{'|'.join(CLAUSE_HEADS)})(?![A-Za-z0-9_])", re.IGNORECASE)


def clauses(text: str) -> list[str]:
    """The paragraphs of a contract: blocks between blank lines, and before each line that begins a clause."""
    lines = [re.sub(r"[ \t]+", " ", line).rstrip() for line in re.split(r"\r\n?|\n", text or "")]
    spaced = [line for i, line in enumerate(lines) for line in ([""] if i and lines[i - 1] and _HEAD.match(line) else []) + [line]]
    return [p.strip() for p in re.split(r"\n\n+", "\n".join(spaced)) if p.strip()]


def _canonical(paragraph: str) -> str:
    return unicodedata.normalize("NFC", " ".join(paragraph.split()).lower())


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return row


#: Edits up to which a diff follows them one by one; beyond, whole rows of places are compared.
FEW_EDITS = 400


def _run(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """How many places on from x and y agree."""
    n, step = 0, 16
    while True:
        size = min(step, len(a) - x - n, len(b) - y - n)
        if size <= 0:
            return n
        differ = a[x + n : x + n + size] != b[y + n : y + n + size]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + size, step * 4


def places_by_edits(a: np.ndarray, b: np.ndarray, most: int = FEW_EDITS) -> list[tuple[int, int]] | None:
    """A longest common subsequence as pairs of places by the fewest edits; None if these are more than `most`.

    With d edits the farthest place on each diagonal is known from those with d - 1 (the greedy O(nd) method): its time
    grows with the length plus the square of the edits.
    """
    n, m, far, steps = len(a), len(b), {1: 0}, []
    for d in range(most + 1):
        steps.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            x += _run(a, b, x, x - k) if x - k >= 0 else 0
            far[k] = x
            if x >= n and x - k >= m:
                return _traced(steps, n, m)
    return None


def _traced(steps: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    """The pairs of places on the way back through the farthest places of each number of edits."""
    out = []
    for d in range(len(steps) - 1, -1, -1):
        k, far = x - y, steps[d]
        down = k == -d or (k != d and far[k - 1] < far[k + 1])
        before = k + 1 if down else k - 1
        start = far[before] if d else 0
        to = (start if down else start + 1) if d else 0  # where the agreeing run of this step begins
        while x > to:
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = start, start - before if d else 0
    return out[::-1]


def common_places(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places: by the edits while they are few, else by divide and conquer over
    whole rows, in memory that is linear in a and b."""
    if min(len(a), len(b)) > FEW_EDITS // 4:
        near = places_by_edits(a, b)
        if near is not None:
            return near
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if j - i == 1:
            same = np.flatnonzero(b[k:m] == a[i])
            out += [(i, k + int(same[0]))] if len(same) else []
            continue
        half = (i + j) // 2
        cut = k + int((_lengths(a[i:half], b[k:m]) + _lengths(a[half:j][::-1], b[k:m][::-1])[::-1]).argmax())
        todo += [(i, half, k, cut), (half, j, cut, m)]
    return sorted(out)


def diff_runs(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Runs (equal, removed or added, paragraphs joined by blank lines); between equal runs the removed one comes first."""
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(_canonical(p), len(names)) for p in side], np.int64) for side in (old, new))
    out: list[tuple[str, str]] = []
    equal: list[str] = []
    i = k = 0

    def flush(part: str, lines: list[str]) -> None:
        if lines:
            out.append((part, "\n\n".join(lines)))

    for x, y in [*common_places(a, b), (len(a), len(b))]:
        if x > i or y > k:
            flush("equal", equal)
            equal = []
            flush("removed", old[i:x])
            flush("added", new[k:y])
        equal += new[y : y + 1]
        i, k = x + 1, y + 1
    flush("equal", equal)
    return out


def diff_pairs(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, seq, part, text): the ordered paragraph diff of each pair, run by run, in the paragraphs' own words.

    Paragraphs are equal that differ in white space, case or composition of characters only; equal pairs are pruned
    before Python sees them.
    """

    def diff(a: str | None, b: str | None) -> list[tuple[int, str, str]]:
        return [(i, part, text) for i, (part, text) in enumerate(diff_runs(clauses(a), clauses(b)))]

    diff_all = few_at_once(diff, [("seq", pa.int32()), ("part", pa.string()), ("text", pa.string())])
    differing = pairs.where(~F.col(old).eqNullSafe(F.col(new))).select(F.col(key).alias("k"), F.col(old).alias("a"), F.col(new).alias("b"))
    return differing.mapInArrow(diff_all, f"k {pairs.schema[key].dataType.simpleString()}, seq int, part string, text string").withColumnRenamed("k", key)


def group_changes(parts: DataFrame, key: str) -> DataFrame:
    """Change events: a removed run right before an added one is one MODIFICACIÓN, others are ELIMINACIÓN or ADICIÓN; texts are on one line."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("seq")
    clean = parts.withColumn("text", _rewrite(F.col("text"), [(r"\n+", " "), (r"\s{2,}", " "), (_ENDS, "")]))
    seen = clean.withColumns({"next_part": F.lead("part").over(w), "next_text": F.lead("text").over(w), "before": F.lag("part").over(w)})
    removed, changed = F.col("part") == "removed", (F.col("part") == "removed") & F.col("next_part").eqNullSafe(F.lit("added"))
    kind = F.when(changed, "MODIFICACIÓN").when(removed, "ELIMINACIÓN").when((F.col("part") == "added") & ~F.col("before").eqNullSafe(F.lit("removed")), "ADICIÓN")
    told = seen.withColumn("change", kind).where(F.col("change").isNotNull())
    return told.select(key, "seq", "change", F.when(removed, F.col("text")).alias("old_text"), F.when(changed, F.col("next_text")).when(~removed, F.col("text")).alias("new_text"))


def pack_batches(items: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Greedy batches of each key's items, in order, under a budget of characters: (key, order, batch).

    Greedy packing is sequential within a key; its items stream through in order, so none is gathered.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, used = None, 0, 0
        for part in batches:
            out = []
            for k, n in zip(part["k"].tolist(), part["n"].fillna(0).tolist()):
                if k != now:
                    now, batch, used = k, 0, 0
                if used > 0 and used + n > budget:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield pd.DataFrame({"k": part["k"], "o": part["o"], "batch": out})

    kinds = f"k {items.schema[key].dataType.simpleString()}, o {items.schema[order].dataType.simpleString()}, batch int"
    dealt = items.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(size).cast("long").alias("n")).repartition("k").sortWithinPartitions("k", "o", "n")
    return dealt.mapInPandas(pack, kinds).withColumnsRenamed({"k": key, "o": order})


def assemble_prompts(df: DataFrame, key: str, sections: list[Column]) -> DataFrame:
    """(key, prompt): the sections that aren't null or blank, parted by blank lines."""
    filled = [F.when(F.trim(s) != "", s) for s in sections]
    return df.select(key, F.concat_ws("\n\n", *filled).alias("prompt"))


def parse_llm_json(df: DataFrame, column: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parsed model answers, from the first { to the last }, without the fences around them; rows that don't parse or lack a required key are rejected."""
    cut = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    parsed = df.withColumn("parsed", F.from_json(cut, schema))
    ok = F.col("parsed").isNotNull()
    for r in required:
        ok = ok & F.col(f"parsed.{r}").isNotNull()
    return parsed.where(ok), parsed.where(~F.coalesce(ok, F.lit(False))).drop("parsed")


def rebuild_document(chunks: DataFrame, key: str, match: str | Column, title: str | None = None) -> DataFrame:
    """The chunks of each document in order, joined, and the number of the first that starts with the first 80 characters of `match`.

    `match` is one text or a column of chunks, alike in all rows of a document. A document comes together in one row, as
    its text is one value.

    A title column loses its ` (i/n)`.
    """
    trimmed = lambda c: F.regexp_replace(c, _ENDS, "")
    head = F.substring(trimmed(F.lit(match) if isinstance(match, str) else match), 1, 80)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("number", "chunk"))), lambda x: x["chunk"])
    aggs = [F.concat_ws("\n", parts).alias("text"), F.min(F.when(trimmed(F.col("chunk")).startswith(head), F.col("number"))).alias("matched")]
    if title:
        aggs.append(F.min(F.regexp_replace(title, r" \([0-9]+/[0-9]+\)$", "")).alias("title"))
    return chunks.groupBy(key).agg(*aggs)
