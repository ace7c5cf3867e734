import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "<", "[", "s>", "/INST]", "a", "é\n", "$1"]


def test_query_equals_sql(same_rows):
    same_rows(chat.query, chat.sql())


def test_plan_has_no_python(spark, data):
    plan = chat.query(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@settings(deadline=None, max_examples=8)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=9).map("".join), min_size=1, max_size=20))
def test_any_text_comes_back(spark, texts):
    df = spark.createDataFrame([(1, i, ["user", "assistant", "tool[TEXT]x", "system"][i % 4], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    back = chat.read_chats(chat.format_chats(df)).first()
    assert [(t.role, t.text) for t in back.turns] == [(["user", "assistant", "tool[TEXT]x", "system"][i % 4], t) for i, t in enumerate(texts)]
    assert back.loss_text == "".join(t for i, t in enumerate(texts) if i % 4 == 1)
    marks = sum(back.formatted.count(m) for m in ("[INST]",))
    assert marks == sum(i % 4 == 0 for i in range(len(texts)))


def test_order_of_turns_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "assistant", "a"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "x"), (4, 0, "user", "u"), (5, None, None, None), (None, 0, "user", "n"), (6, 0, "user", "a"), (6, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash")).withColumn("turns", F.lit(0))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert {k: v.valid for k, v in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, None: False, 6: False}
    assert [tuple(t) for t in got[5].turns] == [("", "")] and len(got[6].turns) == 2
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "x" * 200_000])
def test_long_and_empty_texts(spark, text):
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert chat.read_chats(chat.format_chats(df)).first().loss_text == text
