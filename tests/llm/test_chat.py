import hashlib
import random

from oosgauge.llm.chat import examples, format_chats, parse, read_back, unescape

PIECES = ["</s>", "[INST]", "\\", "<s>", "[ROLE x] ", "[/ROLE]", "<<SYS>>", "<</SYS>>", " ", "a", "<", "[", "]", "\n", "[/INST]", "é😀"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip():
    rng = random.Random(1)
    for _ in range(4000):
        turns = [(rng.choice(["user", "assistant", "system", "to]ol\\", "", "x [/ROLE]"]), "".join(rng.choices(PIECES, k=rng.randrange(7)))) for _ in range(rng.randrange(1, 6))]
        made = list(examples(turns))
        assert parse(made[-1][0]) == turns
        assert "".join(unescape(t[a:z]) for t, a, z in made) == "".join(t for r, t in turns if r == "assistant")
        replies = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        assert [parse(t) for t, _, _ in made[: len(replies)]] == [turns[: i + 1] for i in replies]


def test_rows(spark):
    rows = [
        (1, 1, "assistant", "</s>"), (1, 0, "user", None), (1, 2, "user", "more"), (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (3, 0, "assistant", ""),
        (None, None, None, "lone"), (4, 1, "assistant", "x" * 300_000), (4, 0, "system", "s"), (4, 2, "assistant", "é"),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    want = {1: [("user", ""), ("assistant", "</s>"), ("user", "more")], 2: [("user", "no reply")], 3: [("assistant", "")] * 2, None: [("", "lone")], 4: [("system", "s"), ("assistant", "x" * 300_000), ("assistant", "é")]}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert got[k].formatted_chars == sum(len(t) for t, _, _ in examples(turns))
    assert format_chats(df.limit(0)).count() == 0
