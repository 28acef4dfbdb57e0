import random

from pagewright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, slot int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA)


def key(x):
    return (x is not None, x if x is not None else "")


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    convs = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (key(y[0]) if y[0] is not None else (False, 0), key(y[1]), key(y[2])))] for c, v in convs.items()}
    out = {}
    for c, v in convs.items():
        longer = [(-len(w), d) for d, w in convs.items() if len(w) > len(v) and w[: len(v)] == v]
        same = min(d for d, w in convs.items() if w == v)
        out[c] = (len(v), min(longer)[1] if longer else same)
    return convs, out


def check(spark, rows):
    convs, want = brute(rows)
    got = {}
    for r in chat.format_chats(frame(spark, rows)).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(want)
    for c, parts in got.items():
        r = parts[0]
        assert (r["n_turns"], r["kept_by"], r["kept"]) == (*want[c], want[c][1] == c)
        if r["kept"]:
            text = "".join(p["text"] for p in sorted(parts, key=lambda p: p["part"]))
            plain = [((a or "").replace("<|im_end|>", "<| im_end |>"), (b or "").replace("<|im_end|>", "<| im_end |>")) for a, b in convs[c]]
            assert text == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in plain)
        else:
            assert len(parts) == 1 and r["text"] is None


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "<|im_end|>x"), (None, "")]
    rows = [(n, t, *turns[t]) for n in range(1, 6) for t in range(n)]
    rows += [(10, 0, "user", "hi"), (11, 0, "user", "hi"), (11, 1, "assistant", "other"), (12, 0, "user", ""), (13, 0, "user", None), (14, 0, "user", "z"), (14, 0, "user", "z"), (15, 0, "user", "z"), (None, 0, "user", "n"), (16, None, "user", "z")]
    check(spark, rows)


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["u", "a"]), rng.choice("xy")) for c in range(120) for t in range(rng.randint(1, 4))]
    check(spark, rows)


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(2500)] + [(2, t, "user", f"t{t}") for t in range(1200)]
    check(spark, rows)


def test_order_of_turn_numbers(spark):
    """Null turns come first, then negative ones, over the borders of blocks as well."""
    turns = [None, None, -5000, -1025, -1024, -1, 0, 1023, 1024, 9000]
    rows = [(1, t, "u", f"{t}") for t in turns] + [(2, t, "u", f"{t}") for t in turns[:6]] + [(3, -1, "u", "None")]
    check(spark, rows)


def test_empty(spark):
    assert chat.format_chats(frame(spark, [])).count() == 0
