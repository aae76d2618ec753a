import hashlib
import random
import re

from pyspark.sql import functions as F

from oosgauge.llm.pii import Scorer, Settings, find_pii, labelled, made_rows, shares
from oosgauge.session import stable

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rule in RULES.items() for m in re.finditer(rule, text or "") if holds(k, m[0])]


ODD = [
    "a@b.com_x@c.org😀 p.q@r.s.t.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4", "é 4111 1111-1111 1111 +1 (017) 555-7713 +49-30-1234567.", "+1+2 3456789 +12345678()()9",
    "x" * 3000 + "@" + "y" * 10 + ".com", "1" * 5000, None, "", "a@-.-@b.c", "12@34.56.78.90.12", "z" * 200_000 + "@", "7 " * 60_000,
]


def test_base_against_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("aZ0129.@+-( )%_é\n255", k=80)) for _ in range(600)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    for r in find_pii(df).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in RULES]
        assert [x for x in r.spans.split(",") if x and not x.startswith("other")] == want


def test_the_trees_add_what_cues_announce(spark):
    rng = random.Random(4)
    number = lambda: f"0{rng.randrange(100, 999)} {rng.randrange(10**6, 10**7)}"
    plain = lambda: f"lot {rng.randrange(10**6, 10**7)} of {rng.randrange(10, 99)}"
    rows = [(i, f"please tel: {number()} now" if i % 2 else f"see {plain()} there") for i in range(1200)]
    got = {r.doc_id: r.n_other for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), Settings(trees=4)).collect()}
    assert sum(got[i] for i in range(1, 1200, 2)) >= 570
    assert sum(got[i] for i in range(0, 1200, 2)) <= 10


def test_rare_generator_and_repeated_footer_beside_a_small_sample(spark):
    rng = random.Random(6)
    some = lambda k: "".join(rng.choices("0123456789", k=k))
    account = lambda: f"DE{some(2)} ABCD {some(4)} {some(4)} {some(4)}"
    texts = [f"see {account()} there" if i % 2 else f"iban: {account()} now" for i in range(600)]
    texts += [f"please tel: 0{some(3)} {some(7)} now" if i % 2 else f"see lot {some(7)} of {some(2)} there" for i in range(3000)]
    texts += ["printed by 555 0199 888 here"] * 2000
    rows = list(enumerate(texts))
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), Settings(sample=400)).collect()}
    assert sum("other:6:" in got[i] for i in range(0, 600, 2)) >= 285
    assert sum("other:" in got[i] for i in range(601, 3600, 2)) >= 1425
    assert not any("other:" in got[i] for i in range(3600, 5600))


def test_precision_and_recall_on_fresh_rows(spark):
    scorer = Scorer.fit(stable(labelled(spark, Settings())), Settings())
    assert set(scorer.cuts) == {"at", "number", "group", "account"}
    fresh = scorer.scores(scorer.model, labelled(spark, Settings(made=4000, seed=77)))
    cut = F.coalesce(*(F.when(F.col("generator") == g, F.lit(c)) for g, c in scorer.cuts.items()))
    hit = F.when(F.col("score") >= cut, F.col("label"))
    for r in fresh.groupBy("generator").agg(F.count(hit).alias("taken"), F.sum(hit).alias("right"), F.sum("label").alias("all")).collect():
        assert r.right >= 0.9 * r.taken and r.right >= 0.4 * r["all"], r
    rows = made_rows(spark, Settings(made=400, seed=78))
    assert rows.filter("right_start <= left_end").count() == 0 and 0 < rows.filter("personal").count() < 400


def test_real_forms_are_added(spark):
    texts = {
        "write to jane.doe (at) example.org today": "jane.doe (at) example.org", "call: 0171 5557713 now": "0171 5557713", "phone: (555) 867-5309 there": "(555) 867-5309",
        "iban: DE89370400440532013000 now": "DE89370400440532013000", "see 7992739871300001 4111111111111111 in": "4111111111111111",
        "see 978-3-16-148410-0 there": None, "built 2024-01-02 12:30 there": None, "order 7992739871300001 of": None, "meet [at] noon": None,
    }
    rows = list(enumerate(texts))
    for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r.doc_id][1]
        got = [text[int(a) : int(z)] for k, a, z in (x.split(":") for x in r.spans.split(",") if x) if k == "other"]
        assert (texts[text] in got) if texts[text] else not got, (text, r.spans)


def test_shares_fill_up_from_the_smallest():
    assert shares({"a": 10, "b": 1000, "c": 500}, 110) == {"a": 1.0, "b": 0.05, "c": 0.1}
    assert shares({"a": 10, "b": 20}, 100) == {"a": 1.0, "b": 1.0}


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
