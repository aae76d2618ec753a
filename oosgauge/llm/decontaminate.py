"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Benchmark items are cut into passages. Each passage's seeds are the rarer half of its word
n-grams, by document frequency over the whole corpus (so seeds mean the same at every
size). A document that holds two seeds of a passage near each other is aligned with it
there, word against word; edited and paraphrased copies keep a high score.

The passages go to all tasks in slices of bounded size, one after the other, however large
the benchmark is.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.llm.text import U64, WordNames, and_row, per_batch, pick, raw, shingles, whole_row

#: A-Z to a-z, ASCII punctuation to spaces
FOLD = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode())
SCHEMA = "doc_id long, item_id long, score double, n_matched long, first_word long, last_word long"


@dataclass(frozen=True)
class Settings:
    n: int = 3  # words in a seed
    rare_share: float = 0.5
    min_seeds: int = 2
    match: int = 2
    mismatch: int = -1
    gap: int = 1
    threshold: float = 0.5  # of the score of a whole copy
    min_words: int = 8  # shorter items are no evidence and are not searched
    part_words: int = 128
    slice_chars: int = 8_000_000  # of benchmark text sent to all tasks at once


def folded(text: bytes | None) -> bytes:
    return (text or b"").translate(FOLD)


class Passages:
    """Passages of one slice of the benchmark with their n-grams, for lookup by name."""

    def __init__(self, items: list[tuple[int | None, str | None]], s: Settings):
        names = WordNames()
        self.s, self.item, self.words = s, [], []
        for item, text in items:
            w = names(folded((text or "").encode()))
            if len(w) < s.min_words:
                continue
            parts = max(1, len(w) // s.part_words)
            for part in np.array_split(w, parts):
                self.item.append(item)
                self.words.append(part)
        grams = [shingles(w, s.n) for w in self.words]
        at = [np.arange(len(g)) for g in grams]
        of = [np.full(len(g), i) for i, g in enumerate(grams)]
        self.gram, self.at, self.of = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((grams, U64), (at, int), (of, int)))
        self.known = np.unique(self.gram)

    def seeded(self, df: dict[int, int]) -> Passages:
        """Keep the rarer half of each passage's n-grams; ties with the last one stay."""
        freq = np.array([df.get(int(g), 0) for g in self.gram.astype(np.int64)])
        keep = np.zeros(len(freq), bool)
        for i in range(len(self.words)):
            mine = np.flatnonzero(self.of == i)
            rank = max(self.s.min_seeds, int(np.ceil(len(mine) * self.s.rare_share)))
            keep[mine] = freq[mine] <= np.sort(freq[mine])[min(rank, len(mine)) - 1]
        order = np.flatnonzero(keep)
        order = order[np.argsort(self.gram[order], kind="stable")]
        self.gram, self.at, self.of = self.gram[order], self.at[order], self.of[order]
        self.known = np.unique(self.gram)
        return self

    def sieve(self) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        table[self.known >> U64(44)] = True
        return table


def align(a: np.ndarray, b: np.ndarray, s: Settings) -> tuple[int, int, int, int]:
    """Best local alignment: score, equal words, first and last word of ``b`` in it."""
    n = len(b)
    h = np.zeros((len(a) + 1, n + 1), np.int64)
    ramp = np.arange(n + 1) * s.gap
    for i in range(len(a)):
        row = h[i + 1]
        row[1:] = np.maximum(h[i, :-1] + np.where(b == a[i], s.match, s.mismatch), h[i, 1:] - s.gap)
        np.maximum(row, 0, out=row)
        row[:] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(np.argmax(h), h.shape)
    best, last, same = int(h[i, j]), int(j) - 1, 0
    while i and j and h[i, j]:
        if h[i, j] == h[i - 1, j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch):
            i, j = i - 1, j - 1
            same += a[i] == b[j]
        elif h[i, j] == h[i - 1, j] - s.gap:
            i -= 1
        else:
            j -= 1
    return best, int(same), int(j), last


def regions(doc_at: np.ndarray, part_at: np.ndarray, length: int, s: Settings):
    """Word ranges of a document where enough seeds of one passage lie within its length."""
    order = np.argsort(doc_at, kind="stable")
    doc_at, part_at = doc_at[order], part_at[order]
    slack = length // 4 + s.n
    cuts = np.flatnonzero(np.diff(doc_at) > length + slack) + 1
    for d, p in zip(np.split(doc_at, cuts), np.split(part_at, cuts)):
        if len(np.unique(p)) >= s.min_seeds:
            yield max(0, int((d - p).min()) - slack), int((d - p).max()) + length + slack


def found_in(words: np.ndarray, grams: np.ndarray, at: np.ndarray, p: Passages, s: Settings) -> dict[int | None, tuple]:
    """By item: the best ``score, n_matched, first_word, last_word`` that reaches the threshold. ``at``: grams to look up."""
    lo, hi = np.searchsorted(p.gram, grams[at], "left"), np.searchsorted(p.gram, grams[at], "right")
    count = hi - lo
    if count.sum() < s.min_seeds:
        return {}
    doc_at = np.repeat(at, count)
    seed = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    of, out = p.of[seed], {}
    for i in np.unique(of):
        mine = of == i
        if mine.sum() < s.min_seeds:
            continue
        full = s.match * len(p.words[i])
        for a, z in regions(doc_at[mine], p.at[seed[mine]], len(p.words[i]), s):
            for x in range(a, min(z, len(words)), 4 * len(p.words[i])):  # a long region in overlapping pieces
                y = min(z, len(words), x + 6 * len(p.words[i]))
                best, same, first, last = align(p.words[i], words[x:y], s)
                if best >= s.threshold * full and (best / full, same, -x) > out.get(p.item[i], ((0, 0, 0),))[0]:
                    out[p.item[i]] = ((best / full, same, -x), best / full, same, x + first, x + last)
                if y >= min(z, len(words)):
                    break
    return {k: v[1:] for k, v in out.items()}


def contaminated(
    docs: DataFrame, items: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, score, n_matched, first_word, last_word``: a row per document row and item it holds.

    ``score`` is the share of a whole copy's score (1.0: word for word). Null and empty
    texts, items under ``min_words`` words and an empty benchmark find nothing; repeated
    documents or items are found each by itself, rows of one item id together.
    """
    rows = pick(docs, id_col, text_col)
    parts = [_search(rows, p, s) for p in _slices(rows, items, s, item_col, item_text)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) == 1:
        return out
    best = F.max(F.struct("score", "n_matched", (-F.col("first_word")).alias("_f"), "first_word", "last_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", "b.n_matched", "b.first_word", "b.last_word")


def _slices(rows: DataFrame, items: DataFrame, s: Settings, item_col: str, item_text: str) -> list[Passages]:
    """All passages of the benchmark with their seeds, in slices of bounded size."""
    bench = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    chars = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_slices, out = 1 + chars // s.slice_chars, []
    for k in range(n_slices):
        mine = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k) if n_slices > 1 else bench
        passages = Passages(sorted((tuple(r) for r in mine.collect()), key=lambda r: (r[0] is None, r)), s)
        out.append(passages.seeded(_document_frequency(rows, passages, s)))
    return out


def clean(
    docs: DataFrame, items: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` in which ``contaminated`` finds nothing, unchanged."""
    for p in _slices(pick(docs, id_col, text_col), items, s, item_col, item_text):
        docs = _search(pick(docs, id_col, text_col, whole_row(docs)), p, s, docs).select("carry.*")
    return docs


def sieved(words: np.ndarray, bounds: np.ndarray, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of a group of texts, which of them may be known and lie within a text, and in which text."""
    grams = shingles(words, n)
    at = table[grams >> U64(44)].nonzero()[0]
    of = np.searchsorted(bounds, at, "right") - 1
    inside = at + n <= bounds[of + 1]
    return grams, at[inside], of[inside]


def _document_frequency(rows: DataFrame, p: Passages, s: Settings) -> dict[int, int]:
    """In how many documents each n-gram of the slice occurs; as many numbers as the slice has n-grams."""
    shared = rows.sparkSession.sparkContext.broadcast((p.known, p.sieve()))

    class Count:
        def __init__(self):
            self.names = WordNames()
            self.known, self.table = shared.value
            self.n = np.zeros(len(self.known), np.int64)

        def __call__(self, b):
            for _, words, bounds in self.names.grouped([folded(t) for t in raw(b.column("text"))]):
                grams, at, of = sieved(words, bounds, self.table, s.n)
                i = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
                real = self.known[i] == grams[at] if len(i) else i
                pairs = np.unique(of[real] * len(self.known) + i[real]) if len(i) else i
                self.n += np.bincount(pairs % max(1, len(self.known)), minlength=len(self.n))
            return ()

        def close(self):
            at = np.flatnonzero(self.n)
            yield pa.RecordBatch.from_arrays([pa.array(self.known[at].view(np.int64)), pa.array(self.n[at])], ["gram", "n"])

    counted = per_batch(rows, "gram long, n long", Count).groupBy("gram").agg(F.sum("n").alias("n"))
    out = {r[0]: r[1] for r in counted.collect()}
    shared.unpersist()
    return out


def _search(rows: DataFrame, p: Passages, s: Settings, clean_of: DataFrame | None = None) -> DataFrame:
    """What is found in each row; or, with ``clean_of``, its rows (``carry``) in which nothing is."""
    shared = rows.sparkSession.sparkContext.broadcast((p, p.sieve()))
    filtering, schema = (False, SCHEMA) if clean_of is None else (True, and_row("", clean_of))

    def make():
        names = WordNames()
        passages, sieve = shared.value

        def found(b):
            for first, words, bounds in names.grouped([folded(t) for t in raw(b.column("text"))]):
                grams, at, of = sieved(words, bounds, sieve, s.n)
                for i in np.unique(of):
                    a, mine = bounds[i], at[of == i]
                    hits = found_in(words[a : bounds[i + 1]], grams[a:], mine - a, passages, s)
                    if hits:
                        yield first + i, sorted(hits.items(), key=lambda kv: (kv[0] is None, kv[0]))

        def step(b):
            ids = b.column("doc_id").to_pylist()
            got = [(ids[i], item, *x) for i, hits in found(b) for item, x in hits]
            cols = list(zip(*got)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        def rest(b):
            keep = np.ones(b.num_rows, bool)
            keep[[int(i) for i, _ in found(b)]] = False
            yield pa.RecordBatch.from_arrays([b.column("carry").filter(pa.array(keep))], ["carry"])

        return rest if filtering else step

    return per_batch(rows, schema, make)
