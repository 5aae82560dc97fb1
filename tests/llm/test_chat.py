from pyspark.sql import functions as F

from curatrix.llm import chat_format as C

TEXTS = [
    None, "", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|> <\\\\/s> \\", "<<SYS>> [\\INST] <<|im_start|>", "line\n\nline\\n", "é 😀 <|im_end|", "<", "x" * 50000,
]
SCHEMA = "conv_id long, turn long, role string, text string, turns string, closing string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "c") for r in rows], SCHEMA)


def test_escape_goes_back(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS[1:]], "t string")
    made = rows.select("t", C.escape(F.col("t")).alias("e")).select("t", "e", C.unescape(F.col("e")).alias("b")).collect()
    for r in made:
        assert r["b"] == r["t"]
        assert not any(c in r["e"] for c in (C.START, C.END, "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_every_reply_is_an_example(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(TEXTS)]  # ends with a user turn
    rows += [(2, 0, "assistant", "first"), (2, 1, "assistant", "second")]
    rows += [(3, 0, "user", "no reply"), (4, None, None, None), (None, 0, "rôle\\n\nx", "odd"), (None, 1, "assistant", "a"), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie")]
    made = C.expand(frame(spark, rows), "conv_id", "turn", "role", "text")
    parsed = made.withColumns({"back": C.parse(F.col("formatted")), "loss": C.trained_text(made)}).collect()
    for conv in (1, 2, 3, 4, None, 5):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        mine = sorted((r for r in parsed if r["conv_id"] == conv), key=lambda r: r["example_no"])
        assert [r["loss"] for r in mine if r["target_turn"] is not None] == [t for r, t in turns if r == "assistant"]
        assert [r["closing"] for r in mine] == [False] * (len(mine) - 1) + [True]
        assert [(b["role"], b["text"]) for b in mine[-1]["back"]] == turns
        ends = [i + 1 for i, (r, _) in enumerate(turns) if r == "assistant"]
        for r, n in zip(mine, ends, strict=False):
            assert [(b["role"], b["text"]) for b in r["back"]] == turns[:n]
            cut = r["formatted"][r["loss_start"] : r["loss_end"]]
            assert r["formatted"].endswith(cut + C.END + C.TAIL)


def test_no_rows(spark):
    assert C.expand(frame(spark, []), "conv_id", "turn", "role", "text").count() == 0


def test_native_plan(spark):
    made = C.expand(frame(spark, []), "conv_id", "turn", "role", "text")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_control_strings_in_roles(spark):
    roles = ["user<|im_end|>", "a<|im_end|>\n<|im_start|>x", "\\<|im_end|>", "<\\|im_end|>", "[INST]", "assistant", None, "r\\n\n"]
    rows = spark.createDataFrame([(1, i, r, f"t{i} <|im_end|>\n") for i, r in enumerate(roles)], "c long, n long, r string, t string")
    made = C.expand(rows, "c", "n", "r", "t").filter("closing").select(C.parse(F.col("formatted")).alias("turns")).first()["turns"]
    assert [(x["role"], x["text"]) for x in made] == [(r or "", f"t{i} <|im_end|>\n") for i, r in enumerate(roles)]
