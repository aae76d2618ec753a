import re
from collections import Counter
from math import comb

from oosgauge.llm.quality_rules import CUTOFFS, Settings, choose, keep_good, measure, quality_rules, tail
from oosgauge.llm.text import WordNames


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), text.count("!"), len(re.findall("[A-Z]", text)), len(lines))


TEXTS = ["", " ", "a", "a b", "é😀 b\n\n c", "x y z x y z", "x y z\nx y z\n x y z\nq", "# $a b! C D  e\x0bf\x1cg", "a a a a a", "one two three four\r\none two three four\r\n", "W " * 5000]


def test_counts():
    names = WordNames()
    for t in TEXTS:
        assert measure(t.encode(), names(t.encode())) == brute(t)


def test_bounds():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 7, 0.5)):
        assert abs(tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    row = {"stratum": "en", "good": 5000, "bad": 100} | {f"{x}_{r}_{c}": 0 for x in "gb" for r in ("symbol_share", "upper_share", "dup_line_share", "repeat_share") for c in CUTOFFS}
    row |= {"b_symbol_share_20": 60, "g_symbol_share_20": 300, "b_symbol_share_50": 50, "b_symbol_share_100": 50}
    assert choose([row]) == [("en", "symbol_share", 100)]  # 20 rejects too many good ones; of equals the loosest
    assert choose([row | {"good": 50, "g_symbol_share_20": 3}]) == []  # too few to prove anything


def test_rows(spark):
    prose = lambda i: " ".join(f"w{i * 7 + j * j}" for j in range(60))
    rows = [(i, prose(i), "en", 0) for i in range(3000)] + [(5000 + i, "# " * 40 + prose(i), "en", 0) for i in range(200)]
    rows += [(None, None, None, 1), (9000, "", "en", 1), (9001, "# " * 40 + prose(1), "xx", 1), (9002, prose(2), None, 1), (9002, prose(2), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(5000 + i, 0) for i in range(200)] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert len(got) == 3204
    assert all(got[i].kept for i in range(3000)) and not any(got[5000 + i].kept for i in range(200))
    assert got[None].base_failed and not got[None].kept and got[9000].base_failed
    assert got[9001].kept and got[9002].kept  # no labels in their strata
    assert sorted(r.doc_id for r in keep_good(docs, labels).filter("doc_id >= 5000").collect()) == [9001, 9002, 9002]
    assert keep_good(docs, labels).columns == docs.columns
    alone = quality_rules(docs, labels.limit(0), Settings())
    assert alone.filter("kept = base_failed").count() == 0 and quality_rules(docs.limit(0), labels).count() == 0
