"""Token ids as ORC files, in order of document ids.

Documents are range-partitioned by id and sorted, so each file, and each stripe of it, covers
a narrow range of ids. ORC keeps integers in run-length form, with minima and maxima per stripe
and per ``row_stride`` rows, and Bloom filters on the document ids; Spark's reader splits files
by stripes and skips those that a filter on ``doc_id`` cannot meet.

A row is a piece of at most ``PIECE`` ids: ``doc_id, part, doc, start, n, ids``, where ``part``
is the task that wrote it, ``doc`` the document's number in that part and ``start`` the ids
before the piece in it. ``parts`` holds how many ids come before each part, so no second pass
over the texts is needed to give every document its place.

Tasks keep the ids of words they have met. A text is cut only where the word pattern of a
byte-level tokenizer has to cut it: before a blank and around a line feed, each between two
characters that are not white space, and between letters and marks. The library encodes every
piece that is not known, a word of letters by its merge model alone, so the ids are those of
the whole text.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oosgauge.llm.text import pick, small_batches
from oosgauge.session import parallelism

#: ids in one row
PIECE = 4096
#: characters that the library gets at once of a text that cannot be cut into words
RUN = 1 << 16
#: words kept in each of two generations, and the longest kept
WORDS, LONGEST = 700_000, 40
#: characters of texts taken at once
BATCH_CHARS = 4_000_000
#: bytes of a tokenizer file that may be sent to every task
MOST_SENT = 64 << 20

_SAFE = re.compile(r"[!-~\w](?:.*[!-~\w])?", re.S)
#: letters in every version of Unicode, then marks
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)")
_MARKS = tuple(".,;:!?")
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")


@dataclass(frozen=True)
class Format:
    """How the files are laid out."""

    end_id: int = 0
    files: int | None = None
    stripe_bytes: int = 64 << 20
    row_stride: int = 10_000
    bloom_fpp: float = 0.01
    compression: str = "zstd"


def _byte_letters() -> dict[int, str]:
    """The letter of each byte that is no letter or mark of its own, in order of bytes."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


def _byte_level(model: dict) -> bool:
    """Whether words are split by the byte-level pattern alone, so that the cuts of ``Encoder`` are safe."""
    words = model.get("pre_tokenizer") or {}
    kind = (model.get("model") or {}).get("type") == "BPE" and not model["model"].get("dropout")
    plain = kind and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
    return plain and model.get("normalizer") is None and all(t.get("special") for t in model.get("added_tokens") or ())


class Encoder:
    """Ids of whole texts, many at once."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_str(tokenizer)
        lib.encode_special_tokens = True  # their strings in a text are ordinary text
        self.encode = lambda s: np.array(lib.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        self.cuts, self.model, self.letters = _byte_level(json.loads(tokenizer)), lib.model, _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.newline = self.encode("\n")

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """Number of the text and ids, in order; a long text in several runs, an empty one in none."""
        if not self.cuts:  # the whole text at once
            yield from ((i, np.frombuffer(self.encode(t), "<u4")) for i, t in enumerate(texts) if t)
            return
        runs, size = [], 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = _CUT.search(text, at + BATCH_CHARS) if len(text) - at > BATCH_CHARS else None
                to = cut.start() if cut else len(text)
                runs.append((i, at == 0, text[at:to]))
                size, at = size + to - at, to + 1 if cut else to
                if size >= BATCH_CHARS:
                    yield from self._batch(runs)
                    runs, size = [], 0
        if runs:
            yield from self._batch(runs)

    def _batch(self, runs: list[tuple[int, bool, str]]) -> Iterator[tuple[int, np.ndarray]]:
        """A word that begins a text or a line has a line feed before it; that of a text's first word is taken off again."""
        made = pa.array([("\n" if first else "") + text.replace("\n", " \n") for _, first, text in runs])
        split = pc.split_pattern(made, " ")
        words = split.flatten().dictionary_encode()
        found = self._words(words.dictionary.to_pylist())
        which = words.indices.to_numpy()
        lengths = np.array([-1 if x is None else len(x) // 4 for x in found], np.int32)
        flat = np.frombuffer(b"".join(x for x in found if x is not None), "<u4")
        begins = (np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)).astype(np.int32)
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        n = lengths[which]
        odd = np.concatenate([[0], np.cumsum(n < 0)])[ends]
        n = np.maximum(n, 0)
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])  # under BATCH_CHARS or one run
        kind = np.int32 if upto[-1] + len(flat) < 1 << 31 else np.int64
        at = np.repeat((begins[which] - upto[:-1]).astype(kind), n)
        at += np.arange(upto[-1], dtype=kind)
        ids = flat[at]
        for k, (i, first, text) in enumerate(runs):
            if odd[k + 1] == odd[k]:
                yield i, ids[upto[ends[k]] + (len(self.newline) // 4 if first else 0) : upto[ends[k + 1]]]
            else:
                yield from ((i, x) for x in self._runs(text if first else " " + text))

    def _words(self, words: list[str]) -> list[bytes | None]:
        out = list(map(self.young.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            out[i] = ids = self.old.get(w) or self._word(w)
            if ids is not None and len(w) <= LONGEST:
                if len(self.young) >= WORDS:
                    self.young, self.old = {}, self.young
                self.young[w] = ids
        return out

    def _word(self, word: str) -> bytes | None:
        """Ids of a word with the blank or the line feed before it; None if it begins or ends with white space."""
        if word.isascii():  # the most frequent forms first
            if word.isalpha():
                return self._model_ids(self.letters[32] + word)
            if word[-1:] in _MARKS and word[:-1].isalpha():
                return (self.young.get(word[:-1]) or self._words([word[:-1]])[0]) + self._words(["\n" + word[-1]])[0][len(self.newline) :]
        lead, before = ("", self.newline) if word.startswith("\n") else (" ", b"")
        word = word[len(before) and 1 :]
        if plain := _WORD.fullmatch(word):
            letters, marks = plain.groups()
            return before + self._merged(lead + letters) + (self._words([f"\n{marks}"])[0][len(self.newline) :] if marks else b"")
        return before + self.encode(lead + word) if _SAFE.fullmatch(word) else None

    def _merged(self, word: str) -> bytes:
        """Ids of letters, after a blank or not, from the merge model alone."""
        if word.isascii():
            word = word.replace(" ", self.letters[32])
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return self._model_ids(word)

    def _model_ids(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _runs(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + RUN)
            to = cut.start() if cut else len(text)
            yield np.frombuffer(self.encode(text[at:to]), "<u4")
            at = to


_ENCODERS: dict[str, Encoder] = {}


def _encoder(tokenizer: str) -> Encoder:
    """One encoder per worker process and tokenizer; later tasks of the worker keep its words."""
    key = str(hash(tokenizer))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer)
    return _ENCODERS[key]


SCHEMA = "doc_id long, part int, doc long, start long, n int, ids array<int>"
#: ids in one output batch
BATCH = 1 << 19


def _written(shared, end_id: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, doc, at = _encoder(shared.value), TaskContext.get().partitionId(), 0, 0
        rows, held = [], 0

        def piece(doc_id, ids):
            nonlocal at, held
            rows.append((ids, doc_id, doc, at))
            at, held = at + len(ids), held + len(ids)

        def batch():
            nonlocal held
            ids, docs, numbers, starts = zip(*rows)
            counts = np.array([len(x) for x in ids], np.int32)
            offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int32)]).astype(np.int32)
            cols = [pa.array(docs, pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts)]
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "part", "doc", "start", "n", "ids"])

        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), [x or "" for x in b.column("text").to_pylist()]
            encoded, left = encoder(texts), np.zeros(0, np.uint32)
            ahead = next(encoded, None)
            for i, doc_id in enumerate(names):
                while ahead is not None and ahead[0] == i:
                    left = np.concatenate([left, ahead[1]]) if len(left) else ahead[1]
                    whole = max(0, (len(left) - 1) // PIECE) * PIECE
                    for k in range(0, whole, PIECE):
                        piece(doc_id, left[k : k + PIECE])
                        if held >= BATCH:
                            yield batch()
                    left, ahead = left[whole:], next(encoded, None)
                piece(doc_id, np.append(left, np.uint32(end_id)))
                doc, left = doc + 1, left[:0]
                if held >= BATCH:
                    yield batch()
        if rows:
            yield batch()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, layout: Format | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``path/ids`` and ``path/parts`` from ``docs``; ``tokenizer`` is the path of a tokenizers file that the driver sees.

    Every row is a document, in order of ``doc_id`` with nulls first; rows of equal ids stand
    together, those with equal texts in any order. Null and empty texts give the end id alone.
    The text is the unit of work of a task, its rows are pieces. No documents give files
    without rows. Further columns are left out.
    """
    layout, spark = layout or Format(), docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    if len(model) > MOST_SENT:
        raise ValueError("tokenizer file too large to send to every task")
    shared = spark.sparkContext.broadcast(model)
    rows = pick(docs, id_col, text_col, F.xxhash64(F.col(text_col)).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    order = ("doc_id", "_text", "_row")  # equal ids, and equal rows, need not meet in one task
    dealt = rows.repartitionByRange(layout.files or parallelism(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    small_batches(dealt)
    writer = dealt.mapInArrow(_written(shared, layout.end_id), SCHEMA).write
    for key, value in {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": layout.bloom_fpp, "orc.stripe.size": layout.stripe_bytes,
        "orc.rows.between.memory.checks": 256, "orc.row.index.stride": layout.row_stride, "orc.create.index": "true", "compression": layout.compression,
    }.items():
        writer = writer.option(key, str(value))
    writer.orc(f"{path}/ids")
    counts = _ids(spark, path).groupBy("part").agg(F.sum("n").alias("n_ids"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # one row per written file
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("base", before).write.orc(f"{path}/parts")
    shared.unpersist()


def _ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(f"{path}/ids")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, doc, start, n, ids``: all pieces, ``start`` counted from the first document of all.

    A filter on ``doc_id`` reaches the files: stripes and row groups whose range or Bloom filter
    excludes it are not read.
    """
    parts = spark.read.schema("part int, n_ids long, first long, last long, base long").orc(f"{path}/parts")
    few = F.broadcast(parts.select("part", "base")) if parts.limit(100_001).count() <= 100_000 else parts.select("part", "base")
    return _ids(spark, path).join(few, "part").select("doc_id", "part", "doc", (F.col("start") + F.col("base")).alias("start"), "n", "ids")


def crc_of(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column("ids")
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:z]) for a, z in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "part", "doc", "start", "n")), pa.array(crc, pa.int64())], ["doc_id", "part", "doc", "start", "n", "crc"])


#: the polynomial of crc32, low coefficient first
POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two residues modulo the polynomial."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ POLY if b & 1 else b >> 1
    return out


def crc_join(first: int, second: int, n: int) -> int:
    """crc32 of two strings in a row from the crc32 of each and the bytes of the second."""
    shift, power, bits = 0x80000000, 0x40000000, 8 * n
    while bits:
        if bits & 1:
            shift = _times(shift, power)
        power, bits = _times(power, power), bits >> 1
    return _times(shift, first) ^ second


def _joined(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for pieces in b.column("pieces").to_pylist():
            crc = pieces[0]["crc"]
            for p in pieces[1:]:
                crc = crc_join(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def documents(pieces: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from its pieces."""
    small_batches(pieces)
    read = pieces.mapInArrow(crc_of, "doc_id long, part int, doc long, start long, n int, crc long")
    whole = read.groupBy("part", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("start", "n", "crc"))).alias("pieces"),
    )
    return whole.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
