from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wanderlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "]", ">", "/", "s>", "ok", "\n", "é", "🙂", "$1", "%0A", ""]


def back(spark, rows):
    """conv -> (turns, loss texts) as read from the examples."""
    out = {}
    found = chat.prefix_target_examples(spark.createDataFrame(rows, SCHEMA))
    loss = chat.unescape(F.col("formatted").substr((F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    for r in found.select("*", chat.read_turns(F.col("formatted")).alias("turns"), loss.alias("loss")).orderBy("conv_id", "example").collect():
        turns, losses = out.setdefault(r.conv_id, ([], []))
        # Each example continues the one before.
        assert [tuple(t) for t in r.turns][: len(turns)] == turns
        turns[:] = [tuple(t) for t in r.turns]
        if r.trainable:
            losses.append(r.loss)
        else:
            assert r.loss_chars == 0
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "%0A", "[INST]", ""]), st.lists(st.sampled_from(PARTS), max_size=6).map("".join)), min_size=1, max_size=6))
def test_round_trip(spark, turns):
    got = back(spark, [(1, i, r, t, "clash") for i, (r, t) in enumerate(turns)])
    assert got == {1: (turns, [t for r, t in turns if r == "assistant"])}


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None, None), (1, 0, None, "q", None), (1, None, "user", "first", None), (2, 0, "user", "only", None), (None, 0, "assistant", "x", None), (3, 0, "assistant", "same", None), (3, 0, "assistant", "same", None), (4, 0, "assistant", "long " * 100_000, None)]
    got = back(spark, rows)
    assert got[1] == ([("user", "first"), ("", "q"), ("assistant", "")], [""])
    assert got[2] == ([("user", "only")], [])
    assert got[None] == ([("assistant", "x")], ["x"])
    assert got[3] == ([("assistant", "same")] * 2, ["same"] * 2)
    assert got[4][1] == ["long " * 100_000]
    assert chat.prefix_target_examples(spark.createDataFrame([], SCHEMA)).count() == 0


def test_escaping_leaves_no_control_string(spark):
    text = "</s>[INST] ok [/INST]<s><\\s>"
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert r.u == text and not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]"))
