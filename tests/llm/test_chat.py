"""Chat formatting against plain Python."""

import hashlib
import random

from filemason.llm import chat

ROWS = [
    # tree, message, parent, role, text, score
    (1, "a", None, "user", "Hello\n### x </turn> \\", 1.0), (1, "b", "a", "assistant", "low", 0.1), (1, "c", "a", "assistant", "high ####", 0.9),
    (1, "d", "c", "user", None, None), (1, "e", "b", None, "", 0.5), (2, "a", "gone", "us:er\n", "orphan", None),
    (None, "a", None, "user", "no tree", 1.0), (3, None, None, "user", "no id", 1.0), (4, "x", "y", "user", "cycle", 1.0),
    (4, "y", "x", "user", "cycle", 1.0), (4, "z", "x", "user", "below a cycle", 1.0), (5, "a", None, "user", "twice", 1.0),
    (5, "a", None, "user", "twice", 1.0), (6, "s", "s", "user", "own parent", 1.0),
]


def table(spark, rows):
    kind = "tree_id int, message_id string, parent_id string, role string, text string, score double, n_turns int, formatted string"
    return spark.createDataFrame([(*r, 1, "x") for r in rows], kind)


def paths(rows):
    return sorted((r["tree_id"] or 0, r["path_rank"], tuple(chat.parse(r["formatted"]))) for r in rows)


def test_trees(spark):
    rows = chat.format_conversations(table(spark, ROWS)).collect()
    start = ("user", ROWS[0][4])
    assert paths(rows) == sorted([
        (1, 1, (start, ("assistant", "high ####"), ("user", ""))), (1, 2, (start, ("assistant", "low"), ("", ""))),
        (2, 1, (("us:er\n", "orphan"),)), (0, 1, (("user", "no tree"),)), (3, 1, (("user", "no id"),)), (5, 1, (("user", "twice"),)),
        (6, 1, (("user", "own parent"),))])
    for r in rows:
        trained = [chat.unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss_spans"]]
        assert trained == [t for role, t in chat.parse(r["formatted"]) if role == "assistant"]
    best = chat.format_conversations(table(spark, ROWS), paths_per_tree=1)
    assert best.count() == len(rows) - 1
    assert chat.format_conversations(table(spark, ROWS).limit(0)).count() == 0


def test_long_chain_and_random_tree(spark):
    rng = random.Random(2)
    chain = [(1, str(i), str(i - 1) if i else None, "assistant" if i % 2 else "user", f"t{i}", None) for i in range(300)]
    tree = [(2, str(i), str(rng.randrange(i)) if i else None, "user", f"n{i}", float(rng.randrange(5))) for i in range(60)]
    rows = chat.format_conversations(table(spark, chain + tree)).collect()
    assert [len(chat.parse(r["formatted"])) for r in rows if r["tree_id"] == 1] == [300]
    children = {}
    for t, m, p, *_ in tree:
        children.setdefault(p, []).append(m)
    score = {m: s for _, m, _, _, _, s in tree}

    def walk(m, before):
        now = before + (f"n{m}",)
        below = sorted(children.get(m, []), key=lambda c: (-score[c], f'{{"t":2,"m":"{c}"}}'))
        return [now] if not below else [p for c in below for p in walk(c, now)]

    found = sorted((r["path_rank"], tuple(t for _, t in chat.parse(r["formatted"]))) for r in rows if r["tree_id"] == 2)
    assert found == list(enumerate(walk("0", ()), 1))


def test_escapes_come_back():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(["\\", "#", "<", "/turn>", "</turn>", "### ", "x", "\n"]) for _ in range(rng.randint(0, 12)))
        import re
        escaped = re.sub(r"\\|#(?=##)|<(?=/turn>)", lambda m: m[0] + "\\", text)
        assert "###" not in escaped and "</turn>" not in escaped and chat.unescape(escaped) == text


def test_query_reads_back_every_conversation(spark):
    from filemason.llm import queries

    rows = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    tricky = "\\### Assistant: </turn> ok"
    want = hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()
    assert rows[-7]["turns_sha256"] == want and rows[-7]["loss_chars"] == len(tricky)
    assert rows[-7]["loss_sha256"] == hashlib.sha256(tricky.encode()).hexdigest()
