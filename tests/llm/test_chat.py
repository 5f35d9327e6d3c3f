import itertools
import random

from skarn.llm import chat

MARKS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role:", "|>", "<|/role|>"]


def formatted(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    made = chat.format_chats(docs)
    return {r.conv_id: r for r in made.withColumn("loss", chat.loss_texts(made["formatted"], made["loss_spans"])).collect()}


def test_any_text_comes_back(spark):
    rng = random.Random(5)
    bits = [*MARKS, "\\", "[", "<", "]", "a", "\n", "é", "🙂", "INST]", "s>", "[\\INST]", "<\\\\/s>", "|role:x|>", "$1", "\0"]
    rows = []
    for conv in range(400):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "a|b", "x\\", "|>", "\\|", "assistant ", None])
            rows.append((conv, turn, role, rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])))
    out = formatted(spark, rows)
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        turns = [(role or "", text or "") for _, _, role, text in group]
        made = out[conv]
        assert made.identical
        assert [tuple(t) for t in made.turns] == turns
        assert made.loss == [t for r, t in turns if r == "assistant"]


def test_only_conflicting_text_is_escaped(spark):
    rows = [(1, 0, "user", "array[0] < 3 \\ fine"), (1, 1, "assistant", "yes"), (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]")]
    out = formatted(spark, rows)
    assert out[1].formatted == "[INST]array[0] < 3 \\ fine[/INST]<s>yes</s>"
    assert out[2].formatted == "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"


def test_defined_cases(spark):
    rows = [(None, 0, "user", "x"), (None, None, "assistant", "first"), (3, 5, "user", "same"), (3, 5, "user", "same"), (3, 4, "assistant", "z" * 200_000 + "</s>" * 3000)]
    out = formatted(spark, rows)
    alone = chat.format_chats(spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string")).where("conv_id IS NULL").collect()
    assert sorted([t.text for t in r.turns] for r in alone) == [["first"], ["x"], ["x"]] and all(r.identical for r in alone)
    assert [t.role for t in out[3].turns] == ["assistant", "user", "user"] and out[3].identical
    assert out[3].loss == ["z" * 200_000 + "</s>" * 3000]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0
