"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base rules find the plain forms. High-recall generators propose further, overlapping spans;
boosted trees score each by its format and the text around it; per generator, the lowest
score at which held-out candidates were right often enough is the threshold for redaction.
Labels come from made rows: forms of personal data (addresses written around, national numbers,
accounts, cards inside longer runs) and look-alikes (codes, dates, quantities, failing check
sums), both with and without telling words, so that no feature and no base rule holds the label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oosgauge.llm.text import pick
from oosgauge.session import stable

#: base rules; possessive repeats and the look-behinds find the same spans in linear time
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
BASE = ("email", "ip", "card", "phone")

#: generators of candidates: high recall, little precision
GENERATORS = {
    "at": r"(?<![^\x20\t\r\n])[^\x20\t\r\n@]++(?:@|\x20?[(\[]at[)\]]\x20?)[^\x20\t\r\n@]{2,}+(?:\x20?[(\[]?dot[)\]]?\x20?[A-Za-z0-9-]++)*+",
    "number": r"(?<![0-9])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+",
    "group": r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
    "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,}+",
}
#: what must stand in a text for a generator or rule to be tried
GATES = {"email": "@", "phone": "+"}
CUES = ("mail", "phone", "tel", "call", "fax", "mobile", "card", "visa", "account", "iban", "ssn", "ip", "address", "contact")
#: characters before a candidate that are read as its context
CONTEXT = 24
#: made rows by generator: (personal, pattern); d, h, u and w become a digit, a hexadecimal digit, a capital and a word, C sixteen digits that pass the check sum, F such that fail
FORMS = (
    (True, "w.w (at) w.org"), (True, "w [at] w dot com"), (True, "w (at) w (dot) net"), (True, "w@w"), (False, "w (at) dd:dd"), (False, "w [at] w"), (False, "@w@w"), (False, "w@dd"),
    (True, "0ddd ddddddd"), (True, "(0dd) ddddddd"), (True, "ddd-ddd-dddd"), (True, "(ddd) ddd-dddd"), (True, "0dd/ddddddd"), (True, "ddd-dd-dddd"),
    (False, "ddddddd of dd"), (False, "20dd-0d-1d 1d:dd"), (False, "978-d-dd-dddddd-d"), (False, "dd.0d.20dd 1d.dd"), (False, "ddd dddd ddd"), (False, "dddddddd"), (False, "d.ddd.ddd.ddd"),
    (True, "F C"), (True, "C F"), (False, "F F"), (False, "F"), (False, "dddddddddddddd"), (False, "hhhhhhhhddddddddddddddddhhhhhhhh"), (False, "hhhhhhhddddddddhhhhhhhhhhhh"),
    (True, "uudd dddd dddd dddd dddd dd"), (True, "uudddddddddddddddddd"), (True, "uudd uuuu dddd dddd dddd"), (False, "uudd-uuuuuuuu uuuuuuuu"), (False, "uudduuuuuuuuuuuuuu"), (False, "uudd uuuuuu uuuuuuu"),
    (True, "ddd.ddd.dddd"), (False, "ddd.ddd.ddd.d"), (False, "d.d.dd.ddd"), (False, "dd:dd:dd:dd"), (False, "d,ddd,ddd,ddd"), (False, "20dd.d.dd.d"),
)
PLAIN_WORDS = ("see", "printed", "lot", "order", "number", "part", "version", "of", "by", "the", "page", "row")


@dataclass(frozen=True)
class Settings:
    made: int = 12_000  # made rows; a fifth by key is held out for the thresholds
    sample: int = 20_000  # most labelled candidates the trees are fitted on
    trees: int = 8
    depth: int = 3
    step: float = 0.3
    precision: float = 0.95  # asked of the held-out candidates from the threshold up
    least: int = 30  # held-out candidates a threshold must rest on
    seed: int = 29


def found(text: Column, pattern: str, gate: str | None = None) -> Column:
    """Matches of ``pattern`` in order as ``m`` and code points ``a`` to ``z``, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains(gate), matches) if gate else matches


def placed(text: Column, matches: Column, pattern: str) -> Column:
    """Positions of ``matches`` by adding up what lies between them."""
    kind = "array<struct<m:string,a:int,z:int>>"
    parts = F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("gap"))

    def add(acc, x):
        a = acc["at"] + F.length(x["gap"])
        z = a + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.when(x["m"].isNotNull(), F.array(F.struct(x["m"].alias("m"), a.alias("a"), z.alias("z")))).otherwise(F.array().cast(kind))
        return F.struct(z.alias("at"), F.concat(acc["out"], one).alias("out"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, walked).otherwise(F.array().cast(kind))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a digit string passes the check sum."""
    r = F.reverse(d)

    def value(i):
        x = F.substring(r, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(value(i), F.lit(0)))
    return total % 10 == 0


def holds(kind: str, m: Column) -> Column:
    """Whether a match of a base rule stands."""
    d = digits(m)
    if kind == "ip":
        return m.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    return F.length(d).between(8, 15) if kind == "phone" else F.lit(True)


FORMAT = (
    "n_chars", "n_digits", "n_letters", "n_marks", "n_groups", "n_dots", "n_dashes", "n_blanks", "has_at", "written_around", "starts_plus", "starts_zero", "starts_year", "has_bracket",
    "first_group", "last_group", "max_group", "n_luhn", "octets", "has_cue", "before_ok", "after_ok",
)


def features(m: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate ``m`` with the text ``before`` and the character ``after`` it."""
    d, groups = digits(m), F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    num = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    count = lambda marks: num(F.length(F.regexp_replace(m, f"[^{marks}]", "")))
    return {
        "n_chars": num(F.length(m)),
        "n_digits": num(F.length(d)),
        "n_letters": count("A-Za-z"),
        "n_marks": num(F.length(F.regexp_replace(m, r"[A-Za-z0-9\x20]", ""))),
        "n_groups": num(F.size(groups)),
        "n_dots": count("."),
        "n_dashes": count("-"),
        "n_blanks": count(r"\x20"),
        "has_at": num(m.contains("@")),
        "written_around": num(m.rlike(r"[(\[]at[)\]]") & m.rlike(r"\.[A-Za-z]|dot")),
        "starts_plus": num(m.startswith("+")),
        "starts_zero": num(m.rlike(r"^\(?0")),
        "starts_year": num(m.rlike(r"^(?:19|20)[0-9]{2}(?![0-9])|[.](?:19|20)[0-9]{2}(?![0-9])")),
        "has_bracket": num(m.contains("(")),
        "first_group": num(F.length(F.get(groups, F.lit(0)))),
        "last_group": num(F.length(F.try_element_at(groups, F.lit(-1)))),
        "max_group": num(F.array_max(F.transform(groups, F.length))),
        "n_luhn": num(F.size(F.filter(groups, lambda g: F.when(F.length(g).between(13, 19), luhn(g)).otherwise(F.lit(False))))),
        "octets": num(m.rlike(IP_PARTS)),
        "has_cue": num(F.lower(before).rlike("(?<![a-z])(?:" + "|".join(CUES) + r")[^a-z\n]{0,6}$")),
        "before_ok": num((before == "") | before.rlike(r"[\x20\n\t(:,;]$")),
        "after_ok": num(~after.rlike("[A-Za-z0-9]")),
    }


def made_rows(spark: SparkSession, s: Settings) -> DataFrame:
    """``doc_id, text, left_end, right_start, personal``: one form in a line of plain words, drawn from the row's number."""

    def draw(i, n):
        return F.pmod(F.xxhash64("doc_id", F.lit(s.seed), i if isinstance(i, Column) else F.lit(i)), F.lit(n))

    def one(words, i):
        return F.element_at(F.array(*(F.lit(w) for w in words)), (draw(i, len(words)) + 1).cast("int"))

    def letters(i, n):
        return F.regexp_replace(F.translate(F.lower(F.hex(F.xxhash64("doc_id", F.lit(s.seed), F.lit(i)))), "0123456789", "ghilmnorst"), f"^(.{{{n}}}).*$", "$1")

    base = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda k: draw(k, 10).cast("string")), "")
    base = F.concat(F.lit("4"), F.substring(base, 2, 14))
    check = lambda x: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(x, k.cast("string"))), luhn), 1)
    other = F.concat(F.lit("7"), F.reverse(F.substring(base, 2, 14)))
    wrong = F.concat(other, F.pmod(F.substring(check(other), 16, 1).cast("int") + 1 + draw("fail", 9), F.lit(10)).cast("string"))

    def symbol(c, k):
        k = k.cast("long")
        digit = draw(k + 100, 10).cast("string")
        return (
            F.when(c == "d", digit)
            .when(c == "h", F.substring(F.lit("0123456789abcdef"), (draw(k + 200, 16) + 1).cast("int"), F.lit(1)))
            .when(c == "u", F.substring(F.lit("ABCDEFGHIKLMNOPRSTUVWZ"), (draw(k + 300, 22) + 1).cast("int"), F.lit(1)))
            .otherwise(c)
        )

    forms = F.array(*(F.struct(F.lit(ok).alias("personal"), F.lit(text).alias("form")) for ok, text in FORMS))
    rows = spark.range(s.made).withColumnRenamed("id", "doc_id").withColumn("f", F.element_at(forms, (draw("form", len(FORMS)) + 1).cast("int")))
    fixed = F.regexp_replace(F.col("f.form"), r"\b(at|dot|org|com|net|of)\b", "<$1>")  # words of the form itself stay
    chars = F.regexp_extract_all(fixed, F.lit(r"<[a-z]+>|[\s\S]"), F.lit(0))
    filled = F.array_join(F.transform(chars, lambda c, k: F.when(c.startswith("<"), F.regexp_replace(c, "[<>]", "")).when(c == "w", F.concat(letters("word", 5), F.substring(F.lit("aeiou"), (draw(k, 5) + 1).cast("int"), F.lit(1)))).when(c == "C", check(base)).when(c == "F", wrong).otherwise(symbol(c, k))), "")
    told = draw("told", 100) < F.when(F.col("f.personal"), 50).otherwise(4)
    left = F.concat(one(PLAIN_WORDS, "w1"), F.lit(" "), letters("w2", 6), F.lit(" "), F.when(told, F.concat(one(CUES, "cue"), F.lit(": "))).otherwise(F.concat(one(PLAIN_WORDS, "w3"), F.lit(" "))))
    right = F.concat(F.element_at(F.array(F.lit(" "), F.lit(". "), F.lit(", ")), (draw("end", 3) + 1).cast("int")), letters("w4", 7), F.lit(" there"))
    rows = rows.select("doc_id", "f.personal", F.col("f.form").alias("form"), left.alias("left"), filled.alias("filled"), right.alias("right"))
    begin = F.length("left") + F.when(F.col("form") == "F C", 17).otherwise(0)
    end = F.length("left") + F.when(F.col("form") == "C F", 16).otherwise(F.length("filled"))
    return rows.select("doc_id", F.concat("left", "filled", "right").alias("text"), begin.alias("left_end"), end.alias("right_start"), "personal")


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id``, the base spans by kind and the candidates with their context, in one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = dict(zip(BASE, (EMAIL, IP, CARD, PHONE))) | GENERATORS
    rows = pick(docs, id_col, text_col).select("doc_id", text.alias("text"))
    matched = rows.select("*", *(found(F.col("text"), p, GATES.get(k)).alias(f"m_{k}") for k, p in patterns.items()))
    spans = matched.select("doc_id", "text", *(placed(F.col("text"), F.col(f"m_{k}"), p).alias(k) for k, p in patterns.items()))
    out = spans.select(
        "doc_id",
        *(F.filter(F.col(k), _holds(k)).alias(k) for k in BASE),
        F.concat(*(F.transform(F.col(g), _candidate(g)) for g in GENERATORS)).alias("candidates"),
    )
    out = out.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(F.transform(k, lambda x: F.struct(x["a"].alias("a"), x["z"].alias("z"))).alias(k) for k in BASE), "candidates")
    return out


def _holds(kind: str):
    return lambda x: holds(kind, x["m"])


def _candidate(generator: str):
    def make(x):
        begin = F.greatest(x["a"] - CONTEXT, F.lit(0))
        before = F.substring(F.col("text"), begin + 1, x["a"] - begin)
        after = F.substring(F.col("text"), x["z"] + 1, F.lit(1))
        return F.struct(F.lit(generator).alias("generator"), x["a"].alias("a"), x["z"].alias("z"), x["m"].alias("m"), before.alias("before"), after.alias("after"))

    return make


def candidate_rows(found_rows: DataFrame) -> DataFrame:
    """A row per candidate that meets no base span: features and a key of its look."""
    base = F.concat(*(F.col(k) for k in BASE))
    one = found_rows.select("row", "doc_id", base.alias("base"), F.explode("candidates").alias("c")).select("row", "doc_id", "base", "c.*")
    one = one.filter(~F.exists("base", lambda s: (s["a"] < F.col("z")) & (F.col("a") < s["z"]))).drop("base")
    one = one.withColumns(features(F.col("m"), F.col("before"), F.col("after"))).withColumn("key", F.xxhash64("generator", "m", "before"))
    return one.drop("m", "before", "after")


def labelled(spark: SparkSession, s: Settings) -> DataFrame:
    """Candidates of the made rows; right is one that is the planted personal form, give or take a sign at its ends."""
    made = made_rows(spark, s)
    near = (F.abs(F.col("a") - F.col("left_end")) <= 1) & (F.abs(F.col("z") - F.col("right_start")) <= 1)
    truth = made.select("doc_id", "left_end", "right_start", "personal")
    return candidate_rows(read(made)).join(truth, "doc_id").withColumn("label", (F.col("personal") & near).cast("double"))


def shares(sizes: dict, most: int) -> dict:
    """Part of each stratum to take so that ``most`` are taken in all: small strata whole, the others alike."""
    out, left = {}, most
    for i, (k, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        quota = min(n, left // (len(sizes) - i))
        out[k], left = quota / n, left - quota
    return out


class Scorer:
    """Boosted trees over candidates with a threshold per generator."""

    def __init__(self, model, cuts: dict[str, float]):
        self.model, self.cuts = model, cuts

    @staticmethod
    def assembled(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FORMAT), outputCol="features").transform(rows)

    @classmethod
    def fit(cls, rows: DataFrame, s: Settings) -> Scorer:
        """Trees from a sample of distinct candidates, as even as may be over generators and labels; thresholds from all with a held-out key, a fifth."""
        held = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
        strata = {(r.generator, r.label): r.n for r in rows.filter(~held).groupBy("generator", "label").agg(F.approx_count_distinct("key").alias("n")).collect()}
        if {label for _, label in strata} != {0.0, 1.0}:
            return cls(None, {})
        at = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30))
        taken = reduce(lambda x, y: x | y, ((F.col("generator") == g) & (F.col("label") == label) & (at < int(share * (1 << 30))) for (g, label), share in shares(strata, s.sample).items()))
        sample = rows.filter(~held & taken).select("key", "generator", "label", *FORMAT).distinct()
        sample = stable(sample.orderBy(at, "key", "label").limit(s.sample))
        model = GBTClassifier(maxIter=s.trees, maxDepth=s.depth, stepSize=s.step, seed=s.seed, featuresCol="features", labelCol="label").fit(cls.assembled(sample))
        scored = cls.scores(model, rows.filter(held)).groupBy("generator", F.floor(F.col("score") * 50).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right"))
        by: dict[str, list] = {}
        for r in scored.collect():
            by.setdefault(r.generator, []).append((r.bin, r.n, r.right))
        cuts = {}
        for g, bins in by.items():
            n = right = 0
            for b, m, k in sorted(bins, reverse=True):
                n, right = n + m, right + k
                if n >= s.least and right >= s.precision * n:
                    cuts[g] = b / 50
        return cls(model, cuts)

    @classmethod
    def scores(cls, model, rows: DataFrame) -> DataFrame:
        return model.transform(cls.assembled(rows)).withColumn("score", vector_to_array("probability")[1])

    def chosen(self, rows: DataFrame) -> DataFrame:
        """Candidates that reach their generator's threshold."""
        if not self.cuts:
            return rows.limit(0).select("row", "a", "z", F.lit(0.0).alias("score"))
        enough = reduce(lambda x, y: x | y, ((F.col("generator") == g) & (F.col("score") >= c) for g, c in self.cuts.items()))
        return self.scores(self.model, rows).filter(enough).select("row", "a", "z", "score")


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["a"].cast("string"), x["z"].cast("string")))


def find_pii(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base counts, digest of the base spans, all spans, ``n_other`` of the method's.

    A null text is empty and has no spans. Positions are code points. Repeated rows repeat
    their answer. The trees are fitted on ``made`` rows of known truth, never on ``docs``; a
    generator whose held-out candidates never reach ``precision`` adds nothing.
    """
    rows = stable(read(docs, id_col, text_col))
    chosen = Scorer.fit(stable(labelled(docs.sparkSession, s)), s).chosen(candidate_rows(rows))
    more = chosen.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "z"))).alias("other"))
    none = F.array().cast("array<struct<a:int,z:int>>")
    whole = rows.drop("candidates").join(more, "row", "left").withColumn("other", F.coalesce("other", none))
    base = F.array_join(F.concat(*(written(k, F.col(k)) for k in BASE)), ",")
    spans = F.array_join(F.concat(*(written(k, F.col(k)) for k in (*BASE, "other"))), ",")
    return whole.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in (*BASE, "other")), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans")
    )
