import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as tx, vectors as vx

TEN = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def statements(spark):
    def parse(text, n=3):
        df = spark.createDataFrame([(text,)], "text string")
        return df.select(tx.parse_statements(F.col("text"), n)).first()[0]

    return parse


@pytest.mark.parametrize("prefix", ["1. ", "2) ", "• ", "- ", "* ", "# ", "12) - ", "a) ", "b. ", "  3.  ", " "])
def test_prefixes_are_removed(statements, prefix):
    assert statements(prefix + TEN) == [TEN]


def test_prefix_quirks(statements):
    assert statements("3 " + TEN) == [TEN]
    assert statements("Yes. " + TEN) == [TEN]
    assert statements("Yes. No. " + TEN) == ["No. " + TEN]
    assert statements("Yes! " + TEN) == ["Yes! " + TEN]


@pytest.mark.parametrize("phrase", tx.INSTRUCTION_PHRASES)
def test_instruction_lines_are_dropped(statements, phrase):
    assert statements(f"{TEN} {phrase.upper()} more\n{TEN}") == [TEN]


def test_length_question_marks_and_count(statements):
    assert statements("one two three four five six seven eight nine") == []
    assert statements(TEN + "??") == [TEN]
    assert statements(TEN + " ? ?") == [TEN + " ?"]
    assert statements("\n".join([TEN] * 5), 2) == [TEN, TEN]
    assert statements("one two three four five six seven eight nine ten") != []
    assert statements("") == []


def test_words_quality_and_preview(spark):
    df = spark.createDataFrame([("  a b c\n",), ("",), (TEN,), (" ".join("x" * 41),)], "t string")
    assert [r[0] for r in df.select(tx.word_count(F.col("t"))).collect()] == [3, 0, 10, 41]
    assert [r[0] for r in df.select(tx.summary_quality(F.col("t"))).collect()] == ["short", "short", "ok", "long"]
    cut = df.select(tx.preview(F.col("t"), 10)).collect()
    assert cut[2][0] == "one two th\n... (38 more characters)"
    assert cut[1][0] == ""
    assert df.select(tx.json_string(F.lit('a"b\n'))).first()[0] == '"a\\"b\\n"'


def test_note_text_and_ids(spark):
    df = spark.createDataFrame([("i", "c", 7), ("i", "", 8), ("i", None, 9)], "i string, c string, n long")
    got = df.select(tx.note_text(F.col("i"), F.col("c")), tx.question_id(F.col("n"), F.lit(2)), tx.chunk_file_name(F.col("n"))).collect()
    assert tuple(got[0]) == ("c: i", "chunk_7_q2", "chunk_000007.txt")
    assert got[1][0] == got[2][0] == "i"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vx.l2_norm(F.col("a")), vx.cosine_similarity(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 5.0 and got[0][1] == pytest.approx(0.96)
    assert got[1][1] is None


def test_hash_embedding_is_a_unit_histogram():
    got = vx.hash_vectors(["A a b", "  ", "", None], 16)
    assert sorted(got[0][got[0] > 0].tolist()) == pytest.approx([0.2**0.5, 0.8**0.5])
    assert not got[1:].any()


def test_spaces_are_those_of_unicode():
    assert set(tx.SPACES) == {chr(code) for code in range(0x110000) if chr(code).isspace()}


def test_statements_far_down_are_found(statements):
    noise = "short line\n" * 30
    assert statements(noise + TEN + "\n" + noise + TEN + " x", 3) == [TEN, TEN + " x"]
    assert statements(TEN + "\n" + noise + TEN + " x", 1) == [TEN]


def test_blank(spark):
    df = spark.createDataFrame([("  \n",), ("",), (" x ",)], "t string")
    assert [r[0] for r in df.select(tx.is_blank(F.col("t"))).collect()] == [True, True, False]


def test_prompts_hold_their_inputs(spark):
    from lorekeep.functions import prompts

    df = spark.createDataFrame([("100% [text]", "name")], "t string, n string")
    text, name = F.col("t"), F.col("n")
    made = df.select(
        prompts.summary_prompt(text, 2),
        prompts.tool_summary_prompt(name, text, 5),
        prompts.expand_prompt(text),
        prompts.refine_prompt(name, text),
        prompts.plan_prompt(text),
    ).first()
    assert all("100% [text]" in prompt for prompt in made)
    assert "5 statements" in made[1] and "name" in made[1] and "name" in made[3]


def test_embedding_does_not_hold_a_string_per_token():
    """Tokens of a batch are counted in Arrow; only the distinct ones become Python's."""
    import tracemalloc

    texts = [" ".join(f"w{n % 50}" for n in range(row, row + 300)) for row in range(1000)]
    tracemalloc.start()
    vx.hash_vectors(texts[:10])
    tracemalloc.reset_peak()
    vx.hash_vectors(texts, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 << 20


def test_embedding_splits_at_ascii_white_space_only():
    got = vx.hash_vectors(["\x0b\x0ca\r\n b\t", "a\x1cb", "a\u2003b \x85", "\u0130 i\u0307"], 1 << 16)
    assert [int((row > 0).sum()) for row in got] == [2, 1, 2, 1]


def test_statements_are_looked_at_once():
    """Lines are split once, and phrases are found without a pattern."""
    told = str(tx.parse_statements(F.col("text"), 2))
    assert told.count("split(text") == 1 and "generate|" not in told
