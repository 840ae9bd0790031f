"""Chat formatting: escaping, turn order, the loss mask and reading back, against plain Python."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from obsframe.llm import chat, queries

ROWS = "conv_id long, turn long, role string, text string"
CONTROLS = chat.BRACKETS.controls
random.seed(3)


def escaped(text):
    for c in CONTROLS:  # none starts inside another, so one by one is as good as all at once
        text = re.sub(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]), lambda m, c=c: c[0] + "\\" + m[1] + c[1:], text)
    return text


def plain(rows):
    """Per conversation: what the query returns, from the rows alone."""
    groups = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups.setdefault(conv, []).append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, escaped(text or "")), role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        marks = {"system": ("[SYS] ", "[/SYS]\n"), "user": ("[INST] ", "[/INST]\n"), "assistant": ("<s>", "</s>\n")}
        size = sum(len(a) + len(escaped(t)) + len(b) for *_, r, t in turns for a, b in [marks.get(r, (f"[ROLE] {escaped(r)}[/ROLE] ", "[/TURN]\n"))])
        valid = re.fullmatch("s?(ua)*u?", "".join({"system": "s", "user": "u", "assistant": "a"}.get(r, "?") for *_, r, _ in turns)) is not None
        out[conv] = (len(turns), sha256(said.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest(), size, valid)
    return out


def odd_text():
    parts = [*CONTROLS, *CONTROLS, "\\", "[", "<", "]", ">", "[\\INST]", "<\\\\/s>", "[ROLE] ", "\n", " ", "é", "𝄞", "x", "user"]
    return "".join(random.choice(parts) for _ in range(random.randrange(12)))


TIES = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", None), (1, None, "user", "first"), (1, 0, None, "z"), (1, 0, "tool", "t"), (1, 0, "user", "a"), (None, 1, "user", "n"), (None, None, None, None), (2, 0, "", ""), (3, 0, "[/ROLE] <s>", "[/TURN]")]
LONG = [(4, 0, "user", "[" + "\\" * 100_000 + "INST]"), (4, 1, "assistant", "word [INST] " * 100_000)]
RANDOM = [(k, t, random.choice(["user", "assistant", "system", "tool", None]), odd_text()) for k in range(10, 200) for t in range(random.randrange(1, 6))]


@pytest.mark.parametrize("rows", [[], TIES, LONG, RANDOM], ids=["empty", "ties and nulls", "long", "odd texts"])
def test_read_back(spark, tmp_path, rows):
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op12_chat(spark, str(tmp_path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid").collect()
    assert {r[0]: tuple(r)[1:] for r in found} == plain(rows) and len(found) == len(plain(rows))


def test_no_control_string_is_left_and_texts_come_back(spark):
    texts = [odd_text() for _ in range(500)] + ["", "[\\", "<s>" * 9]
    t = chat.BRACKETS
    safe = t.escape(F.col("text"))
    for r in spark.createDataFrame([(x,) for x in texts], "text string").select("text", safe.alias("safe"), t.unescape(safe).alias("back")).collect():
        assert r.back == r.text and r.safe == escaped(r.text) and not any(c in r.safe for c in CONTROLS)


def test_segments_and_flags(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "hi <s>"), (1, 0, "user", "hello")], ROWS)
    found = chat.format_chat(df).first()
    assert [(s.text, s.loss) for s in found.segments] == [("[INST] ", False), ("hello", False), ("[/INST]\n", False), ("<s>", False), ("hi <\\s>", True), ("</s>\n", False)]


@pytest.mark.parametrize(("roles", "bad"), [
    (["system", "user", "assistant", "user"], None), (["user"], None), (["assistant"], 0), (["user", "user"], 1), (["system", "assistant", "user"], 1), (["user", "assistant", "system"], 2),
    (["user", None, "user"], 1), (["user", "start"], 1), (["stuck", "user"], 0),
])
def test_turn_order(spark, roles, bad):
    df = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(roles)], ROWS)
    found = chat.format_chat(df).first()
    assert (found.valid, found.bad_turn) == (bad is None, bad)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "t", "x", "y", "z")], f"{ROWS}, segments string, _id string, valid string")
    assert chat.format_chat(df).columns == ["conv_id", "segments", "valid", "bad_turn"] and chat.format_chat(df).first().valid


@pytest.mark.parametrize("change", [
    {"controls": ("[SYS]", "<s[>")}, {"controls": ("[",)}, {"named": "ROLE"}, {"other": chat.Turn("[SYS] ", "</s>")}, {"other": chat.Turn("[ROLE] <", "[/TURN]")}, {"other": chat.Turn("[ROLE] ", "[INST]")},
])
def test_templates_that_could_not_be_read_back_are_refused(change):
    t = chat.BRACKETS
    with pytest.raises(ValueError):
        chat.Template(**{"turns": t.turns, "other": t.other, "named": t.named, "controls": t.controls, "moves": t.moves} | change)
