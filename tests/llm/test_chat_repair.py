import hashlib
import heapq
import random
import re
import zlib

from oosgauge.llm import queries
from oosgauge.llm.chat_repair import Repairer, repair_chats, summaries

GOOD = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\v\f\r"


def cheapest(rows):
    """Least (cost, audit, roles) by uniform-cost search over whole strings; rows: initial, must go, truncated."""
    best, heap = None, [(0, "", 0, "")]
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(rows) and GOOD.fullmatch(made):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, made)
            continue
        if not any(GOOD.fullmatch(made + x) for x in ("", "a", "ua")):
            continue
        for x in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, made + x))
        if i < len(rows):
            own, go, late = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, made))
            if not go:
                if own:
                    heapq.heappush(heap, (cost + 3 * late, audit + "K", i + 1, made + own))
                for x in "ua":
                    heapq.heappush(heap, (cost + 3 + 3 * late, audit + "R", i + 1, made + x))
    return best


def test_cheapest_edits():
    rng, work = random.Random(3), Repairer()
    for k in range(1500):
        rows = [(rng.choice(["s", "u", "a", "x", ""] if k % 2 else ["u", "a"]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(7))]
        work.STEPS = rng.choice([1, 2, 32])
        work._begin()
        edits = [e for i, (own, go, late) in enumerate(rows) for e in work.row(own, i, go, late)]
        rest, cost = work.end()
        edits += rest
        assert (cost, "".join(e[0] for e in edits), "".join((e[1] or "")[:1] for e in edits)) == cheapest(rows), rows
        assert [e[2] for e in edits if e[2] is not None] == list(range(len(rows)))


def test_settled_edits_leave():
    work = Repairer()
    left = max(len(c) for i in range(5000) if (work.row(["user", "assistant"][i % 2], i), c := [work.pending])[1])
    assert left <= 2 * work.STEPS and len(work.known) < 10
    assert work.end()[1] == 0


def slow(rows, all_ids):
    """The contract, row by row in Python."""
    made = {c: [] for c in all_ids}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        made[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, turns in made.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        pairs = [(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(turns, faults)]
        cost, audit, _ = cheapest(pairs)
        done, i, want = [], 0, 0
        for letter in audit:
            if letter == "I":
                done.append((("user", "assistant")[want % 2], ""))
                want += 1
                continue
            _, role, text = turns[i]
            i += 1
            if letter == "R":
                done.append((("user", "assistant")[want % 2], text))
                want += 1
            elif letter == "K":
                done.append((role, text))
                want += role[:1] != "s"
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, tmp_path, rows):
    schema = "conv_id long, turn long, role string, text string, edit string, cost int"
    spark.createDataFrame([(*r, "e", 1) for r in rows], schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_chat_repair"](spark, str(tmp_path)).collect()}
    want = slow(rows, {r[0] for r in rows})
    assert got == want, [(k, got.get(k), want[k]) for k in want if got.get(k) != want[k]][:3]


def test_query(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "so it goes", "", " \n", None, "x. ", "Hm?\t", "a" * 200_000 + ".", "é", "no "]
    rows = []
    for conv in [None, *range(120)]:
        for t in range(rng.randrange(6)):
            rows.append((conv, rng.choice([None, t, t, t + 3]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts)))
    rows += rows[:40] + [(500, 0, "user", "one."), (501, None, None, None)]
    check(spark, tmp_path, rows)


def test_long_conversation_and_none(spark, tmp_path):
    rows = [(7, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(3000)] + [(8, 0, "user", "lone.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in summaries(repair_chats(df)).collect()}
    assert (got[7].cost, got[7].audit, got[7].gaps) == (0, "K" * 3000, 0)
    assert (got[8].cost, got[8].audit) == (3, "KI")
    assert repair_chats(df.limit(0)).count() == 0
