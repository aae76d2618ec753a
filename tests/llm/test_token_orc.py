import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oosgauge.llm import queries, token_orc
from oosgauge.llm.token_orc import PIECE, Encoder, Format, crc_join, documents, read_ids, write_ids

MODEL = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def want(rows, end=0):
    """doc_id, start, n_tokens, crc by one pass in order of ids."""
    encode, at, out = library(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text or "") + [end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def encoded(encoder, texts):
    out = [[] for _ in texts]
    for i, ids in encoder(texts):
        out[i] += ids.tolist()
    return out


def test_encoder_equals_library(monkeypatch):
    rng, encode, mine = random.Random(1), library(), Encoder(open(MODEL, encoding="utf-8").read())
    bits = [" ", " ", "\n", "a", "word", "don't", "é", " ", "\t", "  ", "　", "12", "...", "😀", "日本", "<|endoftext|>", "\r\n", "'s", "​", "_", "\x1c", "\x85", "Straße", "œuvre,", "end!?", "ǆ", "×", "don", ".x"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(6000)]
    assert encoded(mine, texts) == [encode(t) for t in texts]
    monkeypatch.setattr(token_orc, "RUN", 40)
    monkeypatch.setattr(token_orc, "BATCH_CHARS", 100)
    for more in ([" and", " more", " words"] * 3, ["and more", " words", "."]):
        texts = ["".join(rng.choices([*bits, *more] if len(more) > 3 else more, k=80)) for _ in range(300)]
        assert encoded(mine, texts) == [encode(t) for t in texts]


def test_words_are_bounded(monkeypatch):
    monkeypatch.setattr(token_orc, "WORDS", 10)
    mine, encode = Encoder(open(MODEL, encoding="utf-8").read()), library()
    for i in range(60):
        text = f"word{i} again w{i % 7}, wo"
        assert encoded(mine, [text]) == [encode(text)]
        assert len(mine.young) <= 10 and len(mine.old) <= 10


def test_crc_join():
    rng = random.Random(4)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(99)), rng.randbytes(rng.randrange(99))
        assert crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma.", "x\ny", "  ", "é"], k=rng.randrange(40)))) for i in rng.sample(range(-50, 5000), 700)]
    rows += [(None, "no id"), (6000, None), (6001, ""), (6002, "long words " * 9000), (6003, "a" * 30_000), (6004, "x  y\n\n" * 20_000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, part int, start string")
    write_ids(df, f"{tmp_path}/a", MODEL, Format(files=5))
    got = [tuple(r) for r in documents(read_ids(spark, f"{tmp_path}/a")).collect()]
    assert sorted(got, key=lambda r: r[1]) == want(rows)
    assert read_ids(spark, f"{tmp_path}/a").agg(F.max("n")).first()[0] <= PIECE + 1


def test_repeated_rows_and_none(spark, tmp_path):
    rows = [(3, "same id"), (3, "other text"), (3, "same id"), *[(5, "copy")] * 300, (9, "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    write_ids(df, f"{tmp_path}/a", MODEL, Format(end_id=7, files=3))
    got = sorted((tuple(r) for r in documents(read_ids(spark, f"{tmp_path}/a")).collect()), key=lambda r: r[1])
    assert [(r[0], *r[2:]) for r in got[3:]] == [(r[0], *r[2:]) for r in want(rows, 7)[3:]]
    assert sorted(r[2:] for r in got[:3]) == sorted(r[2:] for r in want(rows, 7)[:3])
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    write_ids(df.limit(0), f"{tmp_path}/b", MODEL)
    assert documents(read_ids(spark, f"{tmp_path}/b")).count() == 0


def test_files_have_stripes_indexes_and_filters(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.abs(F.xxhash64("id", F.lit(k))) for k in range(6))).alias("text"))
    write_ids(df, f"{tmp_path}/a", MODEL, Format(files=2, stripe_bytes=100_000, row_stride=1000))
    files = [orc.ORCFile(f) for f in sorted(glob.glob(f"{tmp_path}/a/ids/*.orc"))]
    assert len(files) == 2 and all(f.nstripes > 2 and f.row_index_stride == 1000 for f in files)
    ranges = [(s.column("doc_id")[0].as_py(), s.column("doc_id")[s.num_rows - 1].as_py()) for f in files for s in (f.read_stripe(i, ["doc_id"]) for i in range(f.nstripes))]
    assert all(a[1] <= b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        one = read_ids(spark, f"{tmp_path}/a").filter("doc_id = 1234")
        assert "EqualTo(doc_id,1234)" in one._jdf.queryExecution().toString()
        assert [r.doc_id for r in one.collect()] == [1234]
        assert read_ids(spark, f"{tmp_path}/a").rdd.getNumPartitions() > 4  # tasks read stripes, not files
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_query(spark):
    got = sorted((tuple(r) for r in queries.QUERIES["op13_token_orc"](spark, "/root/testdata/sf0.001").collect()), key=lambda r: r[1])
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got == want(rows)
