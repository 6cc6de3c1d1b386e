import hashlib
import random

from photolith.llm import chat

PARTS = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[", "/", "INST]", "s>", "<", "\n", "a", "é", "[\\INST]", "</\\s>", "]"]


def test_any_text_and_role_read_back():
    rng = random.Random(1)
    for _ in range(20_000):
        role = "".join(rng.choice(PARTS) for _ in range(rng.randrange(4)))
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))
        shown, start, stop = chat.render(role, text)
        assert [x[:2] for x in chat.parse(shown)] == [(role, text)]
        assert chat.unescape(shown[start:stop]) == text


def test_clean_text_stays_as_it_is():
    assert chat.render("user", "a [b] <c> \\n")[0] == "[INST]user\na [b] <c> \\n[/INST]"


def expected(rows):
    out = {}
    key = lambda r: tuple((x is not None, x) for x in r[1:4])
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(df, **options)).collect()}
    assert got == expected(rows)


ROWS = [(1, 0, "user", None), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, ""), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, "assistant", "z"), (None, 3, "user", "é" * 1000), (3, 5, "assistant", "q" * 200_000), (3, -5, "system", "s")]


def test_edge_rows(spark):
    check(spark, ROWS)
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_parts_of_a_long_conversation(spark):
    rows = ROWS + [(7, i, "assistant" if i % 2 else "user", f"turn {i} [/INST]") for i in range(3000)]
    check(spark, rows, part_chars=1000)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(df, part_chars=1000).filter("conv_id = 7").collect()
    assert len(parts) > 50 and [p.last for p in parts].count(True) == 1 and max(len(p.text) for p in parts) < 1100
    for p in parts[:3]:
        assert all(chat.unescape(p.text[s.start : s.stop]).startswith("turn") for s in p.loss)
