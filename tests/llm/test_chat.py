import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.llm import chat


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text")))))


def test_texts_come_back_and_hold_no_control_string(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>x<|body|>y<|end|>", "\\", "\\\\<s>\\", "<<SYS>><</SYS>><<<|", "", None, "a\nb\\<|", "<|" * 3, "[[INST]]", "\U0001f600 é<|end|>", "x" * 200_000]
    rows = [(c, t, r, x) for c, x in enumerate(hard) for t, r in enumerate(["user", "assistant"])]
    rows += [(99, t, "assistant", x) for t, x in enumerate(hard)]
    got = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    for c, x in enumerate(hard):
        x = x or ""
        assert [tuple(t) for t in got[c]["turns"]] == [("user", x), ("assistant", x)] and got[c]["learned"] == x
        body = got[c]["formatted"]
        for mark in (chat.TURN, chat.BODY, chat.END):
            assert body.count(mark) == 2
            body = body.replace(mark, "")
        assert not any(s in body for s in chat.CONTROL)
    assert got[99]["learned"] == "".join(x or "" for x in hard)


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("<|>s/[INST]\\ \n{}aé")), min_size=1, max_size=30))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(s in r["e"] for s in chat.CONTROL)


def test_parts_become_placeholders_attachments_and_tokens(spark):
    rows = [
        (1, 0, "user", [{"type": "text", "text": "see <s>"}, {"type": "image", "uri": "i.png", "width": 700, "height": 300}, {"type": "audio", "uri": "a.wav", "seconds": 2.5}, {"type": None, "text": None}]),
        (1, 1, "assistant", [{"type": "document", "uri": "d.pdf", "pages": 3}, {"type": "text", "text": "read"}]),
        (1, 2, "user", None),
    ]
    r = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert r["formatted"] == "<|turn|>user<|body|>see <\\s><|image|1|><|audio|2|><|end|><|turn|>assistant<|body|><|document|1|>read<|end|><|turn|>user<|body|><|end|>"
    assert [tuple(a) for a in r["attachments"]] == [(0, 1, "image", "i.png", 3 * 144), (0, 2, "audio", "a.wav", 75), (1, 1, "document", "d.pdf", 1536)]
    assert r["expanded_tokens"] == 3 * 144 + 75 + 1536


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, None, "system", "s"), (5, 1, "user", "a")]
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in formatted(spark, rows).collect()}
    assert got == {None: [("", "")], 5: [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]}
    assert formatted(spark, []).count() == 0


def test_query_digests(spark):
    from loomframe.llm.queries import op2_chat_format

    found = {r["conv_id"]: r for r in op2_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert found[-7]["n_turns"] == 2 and found[-7]["loss_chars"] == len(text)
    assert found[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert found[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "a <|image|1|> b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    plain = chat.read_back(chat.format_chat(df)).collect()
    for name in ("c", "m", "ms", "steps", "formatted", "loss", "turns", "learned", "body", "others", "attachments", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    assert chat.read_back(chat.format_chat(df)).collect() == plain
    assert plain[0]["learned"] == "a <|image|1|> b" and plain[0]["attachments"] == []


def test_the_mask_is_over_the_whole_output(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "q <s>"), ("assistant", "\U0001f600 </s> one"), ("tool", "t"), ("assistant", ""), ("assistant", "[INST] two")])]
    r = formatted(spark, rows).first()
    at, learned = 0, []
    for s in r["loss"]:
        learned.append(r["formatted"][at + s["skip"] : at + s["skip"] + s["learn"]])
        at += s["skip"] + s["learn"] + s["tail"]
    assert at == len(r["formatted"]) and [x.replace("\\", "") for x in learned if x] == ["\U0001f600 </s> one", "[INST] two"]
    assert r["learned"] == "\U0001f600 </s> one[INST] two"
