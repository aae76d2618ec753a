import hashlib
import random

from oosgauge.llm.suffix_dedup import Settings, drop_repeats


def brute(texts, length):
    """Marks every byte of every string that starts twice."""
    seen = {}
    data = [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    gone = [bytearray(len(b)) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p : p + length] = b"\1" * length
    out = []
    for b, g in zip(data, gone):
        runs = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((len(b), sum(g), runs, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdé ", k=7))
    prose = lambda n: "".join(word() for _ in range(n))
    shared, other = prose(90), prose(60)
    out = [prose(100) for _ in range(12)]
    out += [prose(20) + shared + prose(30), shared, prose(5) + shared[100:550] + prose(40), shared[:399], prose(9) + shared + other, other + other]
    out += [out[3], out[3], out[4][:450] + "X" + out[4][451:], "a" * 5000, "b" * 700 + "a" * 700, "ab" * 900, None, "", "short", prose(3000), out[6] + out[7]]
    out.append(out[-2][5000:9000] + prose(50))
    out += ["".join(rng.choices("ab", k=3)) * 400, "z" * 399, "z" * 400, "z" * 401]
    return out


def test_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in drop_repeats(docs).collect()}
    assert [got[i] for i in range(len(rows))] == brute([t for _, t, _ in rows], 400)


def test_other_length_repeated_rows_and_kept_text(spark):
    t = "0123456789" * 5
    docs = spark.createDataFrame([(1, t), (1, t), (None, "q" + t[:40] + "w"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, bytes(r.kept).decode()) for r in drop_repeats(docs, Settings(length=32), keep_text=True).collect())
    assert got == [(0, ""), (0, "qw"), (1, ""), (1, "")]


def test_empty_table(spark):
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
