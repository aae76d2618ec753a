"""Quality rules whose cutoffs carry a proven limit on false rejection.

Every rule is a share of a text in thousandths. On labelled documents an exact binomial
test asks of each (stratum, rule, cutoff): were at most ``limit`` of the good documents
rejected by it in truth, could so few have been seen with probability over the corrected
``risk``? Cutoffs that pass are safe; the one that rejects most labelled bad documents is used.
All counting is over all documents and all labels; the driver holds only the table of
strata x rules x cutoffs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.llm.text import WHITE, WordNames, and_row, per_batch, pick, raw, shingles, whole_row

RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share")
#: cutoffs tried, in thousandths: a document fails a rule when its share is above the cutoff
CUTOFFS = (20, 50, 100, 150, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 900)
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes 2 to 4 of a code point
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, n_upper long, n_lines long"


@dataclass(frozen=True)
class Settings:
    limit: float = 0.02  # of the good documents of a stratum, all rules together
    risk: float = 0.05  # that the limit is broken anywhere
    min_words: int = 50
    max_repeat: int = 50  # hundredths of the words


def measure(text: bytes, words: np.ndarray) -> tuple[int, ...]:
    """The counts of a text, given the names of its words."""
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lean = text.translate(None, WHITE)
    chars = len(lean.translate(None, CONTINUED))
    symbols = len(lean) - len(lean.translate(None, SYMBOLS))
    marks = lean.count(b"!")
    upper = len(lean) - len(lean.translate(None, UPPER))
    repeat = 0
    if n >= 4:
        _, where, seen = np.unique(shingles(words, 3), return_inverse=True, return_counts=True)
        if len(seen) < n - 2:
            often = seen[where] > 1
            hit = np.zeros(n, bool)
            for j in range(3):
                hit[j : n - 2 + j] |= often
            repeat = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, marks, upper, len(lines)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", carry: bool = False) -> DataFrame:
    """``doc_id, stratum`` and the counts of every row, with the row itself if asked; a null text has none of anything."""

    def make():
        names = WordNames()
        fields = [(c.split()[0], pa.int64()) for c in COUNTS.split(", ")]

        def step(b):
            texts = [t or b"" for t in raw(b.column("text"))]
            rows = [measure(texts[first + i], words[a:z]) for first, words, bounds in names.grouped(texts) for i, (a, z) in enumerate(zip(bounds, bounds[1:]))]
            got = list(zip(*rows)) or [()] * len(fields)
            cols = [pa.array(x, pa.int64()) for x in got]
            rest = [b.column("carry")] if carry else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("stratum"), *cols, *rest], ["doc_id", "stratum", *(f for f, _ in fields), *["carry"][: len(rest)]])

        return step

    level = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")
    schema = f"doc_id long, stratum string, {COUNTS}"
    if carry:
        return per_batch(pick(docs, id_col, text_col, level, whole_row(docs)), and_row(schema, docs), make)
    return per_batch(pick(docs, id_col, text_col, level), schema, make)


def share(top, below):
    """Thousandths, whole; nothing of nothing is 0."""
    return F.when(below > 0, F.floor(1000 * top / below)).otherwise(0).cast("long")


def with_rules(counts: DataFrame, s: Settings = Settings()) -> DataFrame:
    c = F.col
    return counts.withColumns(
        {
            "base_failed": (c("n_words") < s.min_words) | (100 * c("n_repeat_words") > s.max_repeat * c("n_words")),
            "symbol_share": share(c("n_symbols") + c("n_marks"), c("word_chars")),
            "upper_share": share(c("n_upper"), c("word_chars")),
            "dup_line_share": share(c("n_dup_lines"), c("n_lines")),
            "repeat_share": share(c("n_repeat_words"), c("n_words")),
        }
    )


def seen_table(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Per stratum, rule and cutoff: labelled documents that pass the base, good and bad ones above the cutoff.

    Several labels of a document count once, and one good label makes it good.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = measured.filter("not base_failed").join(known, "doc_id").select("stratum", "quality", *RULES)
    good, bad = F.col("quality") >= 1, F.col("quality") < 1
    sums = [F.count_if(good).alias("good"), F.count_if(bad).alias("bad")]
    for r in RULES:
        for cut in CUTOFFS:
            sums += [F.count_if(good & (F.col(r) > cut)).alias(f"g_{r}_{cut}"), F.count_if(bad & (F.col(r) > cut)).alias(f"b_{r}_{cut}")]
    return held.groupBy("stratum").agg(*sums)


def tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) when each has chance p: the exact binomial bound."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return math.fsum(map(math.exp, logs))


def choose(seen: list[dict], s: Settings = Settings()) -> list[tuple[str, str, int]]:
    """``stratum, rule, cutoff`` in use: safe after Bonferroni's correction over all tests made, and of any effect."""
    tests = max(1, len(seen) * len(RULES) * len(CUTOFFS))
    out = []
    for row in seen:
        for r in RULES:
            safe = [
                (row[f"b_{r}_{cut}"], cut)
                for cut in CUTOFFS
                if row["good"] and row[f"b_{r}_{cut}"] and tail(row[f"g_{r}_{cut}"], row["good"], s.limit / len(RULES)) <= s.risk / tests
            ]
            if safe:
                out.append((row["stratum"], r, max(safe)[1]))  # most bad ones, then the loosest
    return out


def quality_rules(
    docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang",
    max_strata: int = 10_000,
) -> DataFrame:
    """One row per row of ``docs``: id, stratum, counts, shares, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base. A null stratum is the stratum
    ''. Strata without labels, or with too few for any proof, use the base alone; so does
    everything when ``labels`` is empty. Rows are judged each by itself, so repeated rows
    get repeated verdicts. More than ``max_strata`` strata raise an error, as the table of
    cutoffs is sent to every task.
    """
    measured = with_rules(text_counts(docs, id_col, text_col, stratum), s)
    return judged(measured, fit(measured, labels, s, max_strata))


def fit(measured: DataFrame, labels: DataFrame, s: Settings, max_strata: int = 10_000) -> list[tuple[str, str, int]]:
    seen = [r.asDict() for r in seen_table(measured, labels).limit(max_strata + 1).collect()]
    if len(seen) > max_strata:
        raise ValueError(f"over {max_strata} strata; name a coarser column")
    return choose(sorted(seen, key=lambda r: r["stratum"]), s)


def keep_good(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, unchanged."""
    cutoffs = fit(with_rules(text_counts(docs, id_col, text_col, stratum), s), labels, s)
    rows = with_rules(text_counts(docs, id_col, text_col, stratum, carry=True), s)
    return judged(rows, cutoffs).filter("kept").select("carry.*")


def judged(measured: DataFrame, cutoffs: list[tuple[str, str, int]]) -> DataFrame:
    """``kept``: neither the base nor a cutoff of the row's stratum rejects it."""
    by: dict[str, dict[str, int]] = {}
    for level, r, cut in cutoffs:
        by.setdefault(level, {})[r] = cut
    rows = [(level, *(cuts.get(r) for r in RULES)) for level, cuts in by.items()]
    table = measured.sparkSession.createDataFrame(rows, "stratum string, " + ", ".join(f"cut_{r} long" for r in RULES))
    above = F.lit(False)
    for r in RULES:
        above = above | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    joined = measured.join(F.broadcast(table), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~above)
    return joined.drop(*(f"cut_{r}" for r in RULES))
