"""One query per operator over its whole table, with SQL that must agree where SQL can say it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oosgauge.llm import chat, chat_repair, decontaminate, hard_negatives, html_extract, lm_score, mixing, ngram_join, pii, quality_rules, secret_scan, suffix_dedup, token_orc
from oosgauge.session import scratch_root, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    """Register a function under its own name."""

    def wrap(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            return fn(ship(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap(fn) if fn else wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontaminate(spark, sf_dir):
    """Documents that hold benchmark passages, with the passage and where."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


@query
def op3_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


_CONTROLS = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE|\[/ROLE\]|\\"


@query(
    sql=f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
  length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
    ELSE 16 + length(role) + len(regexp_extract_all(role, '[\\\\\\]]')) END AS n FROM c),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS last FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = last)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id"""
)
def op4_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


@query
def op5_html_extract(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op6_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))


#: the mixture of the production run: domains, languages and sources by weight
MIX = mixing.Mix(
    seed=17, epochs=3, budget=0.6, default=1.0,
    weights=({"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}, {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, {"src0": 2.0}),
)


def levels() -> tuple[Column, Column, Column]:
    """Domain (five sources each), language, source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), F.floor(F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT)") / 5).cast("string")))
    return domain, F.col("lang"), F.col("source")


def _case(col: str, weights: dict[str, float]) -> str:
    return "CASE " + col + "".join(f" WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + f" ELSE {MIX.default}::DOUBLE END"


def _deal_sql(src: str, by: str, me: str, keep: str) -> str:
    """The level filling of ``mixing.deal`` over a table with cap, weight and given."""
    return f"""(SELECT {keep}, CASE WHEN weight <= 0 THEN 0 WHEN top IS NULL THEN cap ELSE least(cap, top * weight) END AS alloc FROM (
  SELECT *, max(CASE WHEN weight > 0 AND fits <= r THEN fits END) OVER (PARTITION BY {by}) AS top FROM (
  SELECT *, CASE WHEN share > 0 THEN greatest(rest, 0) / share ELSE 0 END AS fits FROM (
  SELECT *, given - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER (PARTITION BY {by}) - coalesce(sum(weight) OVER w, 0) AS share
  FROM (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 'inf'::DOUBLE END AS r FROM {src})
  WINDOW w AS (PARTITION BY {by} ORDER BY r, {me} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))))"""


MIX_SQL = f"""
WITH base AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)', 1) = '' THEN ''
    ELSE coalesce('domain' || (regexp_extract(source, '([0-9]+)', 1)::BIGINT // 5)::VARCHAR, '') END AS level_1,
    coalesce(lang, '') AS level_2, coalesce(source, '') AS level_3,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT level_1, level_2, level_3, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * {MIX.epochs} AS cap FROM base GROUP BY ALL),
two AS (SELECT level_1, level_2, sum(cap) AS cap, {_case('level_2', MIX.weights[1])} AS weight FROM leaf GROUP BY ALL),
one AS (SELECT 0 AS root, level_1, sum(cap) AS cap, {_case('level_1', MIX.weights[0])} AS weight,
    sum(sum(cap)) OVER () / {MIX.epochs} * {MIX.budget}::DOUBLE AS given FROM two GROUP BY ALL),
a1 AS {_deal_sql('one', 'root', 'level_1', 'level_1')},
a2 AS {_deal_sql('(SELECT two.*, a1.alloc AS given FROM two JOIN a1 USING (level_1))', 'level_1', 'level_2', 'level_1, level_2')},
a3 AS {_deal_sql(f"(SELECT leaf.*, a2.alloc AS given, {_case('level_3', MIX.weights[2])} AS weight FROM leaf JOIN a2 USING (level_1, level_2))",
    'level_1, level_2', 'level_3', 'level_1, level_2, level_3, tokens')},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN least(floor(alloc / tokens), {MIX.epochs}) ELSE 0 END::BIGINT AS whole FROM a3),
k AS (SELECT base.*, whole, floor(round(alloc - whole * tokens, 3)) AS rest,
    md5('{MIX.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM base JOIN plan USING (level_1, level_2, level_3))
SELECT doc_id, level_1, level_2, level_3, n_tokens::BIGINT AS n_tokens, CASE WHEN n_tokens = 0 THEN 0 ELSE whole + (sum(n_tokens) OVER
    (PARTITION BY level_1, level_2, level_3 ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest)::BIGINT END AS copies FROM k"""


@query(sql=MIX_SQL)
def op8_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), levels(), MIX)


def _quality_sql() -> str:
    s = quality_rules.Settings()
    rules = {
        "symbol_share": ("n_symbols + n_marks", "word_chars"), "upper_share": ("n_upper", "word_chars"),
        "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    }
    shares = ", ".join(f"CASE WHEN {b} > 0 THEN 1000 * ({a}) // {b} ELSE 0 END AS {r}" for r, (a, b) in rules.items())
    cuts = "[" + ", ".join(map(str, quality_rules.CUTOFFS)) + "]"
    long = " UNION ALL ".join(f"SELECT stratum, quality, '{r}' AS rule, {r} AS share FROM held" for r in rules)
    alpha = s.limit / len(rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
ws AS (SELECT u, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
win AS (SELECT u, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT u, w, unnest(range(1, len(w) - 1)) AS i FROM ws)),
rep AS (SELECT u, count(DISTINCT p) AS n_repeat_words FROM (SELECT u, unnest([i, i + 1, i + 2]) AS p FROM
    (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS c FROM win) WHERE c > 1) GROUP BY u),
ln AS (SELECT u, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM
    (SELECT u, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY u),
m AS (SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(replace(text, '!', '')) AS n_marks,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, coalesce(n_lines, 0) AS n_lines
    FROM d JOIN ws USING (u) LEFT JOIN rep USING (u) LEFT JOIN ln USING (u)),
r AS (SELECT *, n_words < {s.min_words} OR 100 * n_repeat_words > {s.max_repeat} * n_words AS base_failed, {shares} FROM m),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT r.*, quality FROM r JOIN known USING (doc_id) WHERE NOT base_failed),
seen AS (SELECT stratum, rule, cut, count(*) FILTER (quality >= 1) AS good, count(*) FILTER (quality >= 1 AND share > cut) AS g,
    count(*) FILTER (quality < 1 AND share > cut) AS b FROM ({long}), (SELECT unnest({cuts}) AS cut) GROUP BY ALL),
p AS (SELECT stratum, rule, cut, b, (SELECT sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({alpha}::DOUBLE)
    + (good - i) * ln(1 - {alpha}::DOUBLE))) FROM (SELECT unnest(range(0, g + 1)) AS i)) AS tail FROM seen WHERE good > 0 AND b > 0),
best AS (SELECT stratum, rule, max((b, cut)) AS x FROM p WHERE tail <= {s.risk}::DOUBLE / greatest(1,
    (SELECT count(DISTINCT stratum) FROM held) * {len(rules) * len(quality_rules.CUTOFFS)}) GROUP BY ALL),
over AS (SELECT stratum, {', '.join(f"max(x[2]) FILTER (rule = '{r}') AS cut_{r}" for r in rules)} FROM best GROUP BY stratum)
SELECT doc_id, r.stratum AS stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_upper, n_lines, {', '.join(rules)}, base_failed,
    NOT base_failed AND NOT ({' OR '.join(f"coalesce({r} > cut_{r}, false)" for r in rules)}) AS kept
FROM r LEFT JOIN over ON r.stratum = over.stratum"""


@query(sql=_quality_sql())
def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))



@query
def op10_lm_score(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with a twentieth of the rows dropped, emptied, unpunctuated, repeated or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_again"),
    ).drop("_again")


@query
def op11_chat_repair(spark, sf_dir):
    """Damaged conversations, repaired; one row per conversation of the table."""
    rows = table(spark, sf_dir, "conversations")
    found = chat_repair.summaries(chat_repair.repair_chats(damaged(rows))).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zeros = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return whole.fillna({**zeros, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


_SCORED = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS m FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)),
sc AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.m, b.m)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM sc WHERE same) WHERE place <= 5),
neg AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank
  FROM pos p JOIN sc n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""


@query(sql=_SCORED)
def op12_hard_negatives(spark, sf_dir):
    """Negatives near the positives of every hundredth vector; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query
def op13_token_orc(spark, sf_dir):
    """Token ids written as ORC files in the shared folder, and each document read back from them."""
    import public_tokenizers

    path = f"{scratch_root(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    token_orc.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.documents(token_orc.read_ids(spark, path))


@query
def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)
