import pytest
from hypothesis import given, settings, strategies as st

from lorekeep.operators.chunking import (
    chunk_documents,
    chunk_spans,
    sub_chunk_array,
    sub_chunk_spans,
    sub_chunk_texts,
    sub_chunks,
)


def spans(text, size=300, overlap=30):
    return list(chunk_spans(text, size, overlap))


def first_end(text, size=300, overlap=30):
    return spans(text, size, overlap)[0][1]


def test_short_text_is_one_chunk():
    assert spans("x" * 300) == [(0, 300)]
    assert spans("") == []


def test_hard_cut_with_overlap():
    assert spans("x" * 700) == [(0, 300), (270, 570), (540, 700)]


def test_fence_that_closes_soon_is_kept_whole_and_not_reentered():
    text = "x" * 280 + "```\n" + "c" * 100 + "\n```\n" + "y" * 400
    assert spans(text) == [(0, 389), (389, 689), (659, 789)]


def test_space_behind_a_skipped_fence_is_skipped_too():
    text = "x" * 280 + "```\n" + "c" * 100 + "\n```\n \t\n" + "y" * 400
    assert spans(text)[1][0] == 392


def test_long_fence_that_opens_early_is_extended_to_its_end():
    text = "x" * 50 + "```\n" + "c" * 2000 + "\n```\n" + "y" * 50
    assert spans(text)[0] == (0, 2059)


def test_long_fence_that_opens_late_is_cut_before_it():
    text = "x" * 200 + "```\n" + "c" * 2000 + "\n```\n" + "y" * 50
    assert spans(text)[:2] == [(0, 200), (170, 2209)]


def test_unclosed_fence_is_cut_hard():
    text = "x" * 50 + "```\n" + "c" * 600
    assert spans(text) == [(0, 300), (270, 570), (540, 654)]


def test_many_marks_stay_linear():
    text = "```" * 200_000
    assert spans(text, 4000, 400)[-1][1] == len(text)


def test_table_ends_at_a_near_blank_line():
    text = "|a|b|\n" * 60 + "\n" + "y" * 400
    assert first_end(text) == 361


def test_table_with_a_far_blank_line_uses_the_section_rules():
    text = "|a|b|\n" * 200 + "\n" + "y" * 400
    assert first_end(text) == 300


def test_table_with_a_blank_line_at_the_cut_uses_the_section_rules():
    text = "|a|b|\n" * 49 + "|a|b|x" + "\n\n" + "|a|b|\n" * 60
    assert text[300:302] == "\n\n"
    # The last line end before the cut is a fallback beyond a third of the size.
    assert first_end(text) == 294


def test_pipes_on_one_side_are_no_table():
    text = "|" * 5 + "x" * 297 + "\n\n" + "y" * 400
    assert first_end(text) == 300


@pytest.mark.parametrize("mark", ["\n## Title\n", "\n---\n", "\n=====\n", "\n###### t"])
def test_heading_or_rule_beyond_half(mark):
    assert first_end("x" * 200 + mark + "y" * 400) == 200
    assert first_end("x" * 100 + mark + "y" * 400) != 100


def test_last_heading_decides():
    text = "x" * 160 + "\n# a\n" + "x" * 60 + "\n# b\n" + "y" * 400
    assert first_end(text) == 225


def test_heading_wins_over_rule_and_blank_line():
    text = "x" * 160 + "\n# a\n" + "x" * 20 + "\n---\n" + "x" * 20 + "\n\n" + "y" * 400
    assert first_end(text) == 160


def test_blank_line_then_sentence_then_newline():
    assert first_end("x" * 200 + "\n\n" + "y. " * 200) == 202
    assert first_end("x" * 200 + ". " + "y" * 400) == 202
    assert first_end("x" * 110 + "\n" + "y" * 400) == 111
    assert first_end("x" * 90 + "\n" + "y" * 400) == 300


def test_sentence_ends_are_tried_in_order_not_by_position():
    text = "x" * 160 + ". \n" + "x" * 40 + "! " + "y" * 400
    assert first_end(text) == 163
    assert first_end("x" * 200 + "? " + "y" * 400) == 300
    assert first_end("x" * 200 + "?\n" + "y" * 400) == 202


def test_unicode_space_is_stripped(spark, rows):
    docs = spark.createDataFrame([("d", "s", "  body ")], "doc_key string, source string, text string")
    assert rows(chunk_documents(docs), "text", "length", "pos") == [("body", 4, 0)]


def test_chunk_rows_carry_the_other_columns(spark, rows):
    docs = spark.createDataFrame(
        [("a", "s1", "x" * 5000, {"k": 1}), ("b", "s2", "  \n ", None), ("c", "s3", None, None)],
        "doc_key string, source string, text string, extra map<string,int>",
    )
    got = rows(chunk_documents(docs), "doc_key", "source", "pos", "start", "end", "extra")
    assert got == [("a", "s1", 0, 0, 4000, {"k": 1}), ("a", "s1", 1, 3600, 5000, {"k": 1})]


@pytest.mark.parametrize("size, overlap", [(300, 100), (300, 150), (300, -1)])
def test_overlap_that_could_stand_still_is_refused(spark, size, overlap):
    docs = spark.createDataFrame([], "doc_key string, source string, text string")
    with pytest.raises(ValueError):
        chunk_documents(docs, size, overlap)


PIECES = st.lists(
    st.sampled_from(["word ", "end. ", "why?\n", "line\n", "\n\n", "\n# h\n", "\n---\n", "|a|b|\n", "```", "ö! ", "x" * 40]),
    max_size=120,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(0, 19))
def test_spans_advance_and_end(text, overlap):
    found = spans(text, 60, overlap)
    starts = [start for start, _ in found]
    assert starts == sorted(set(starts))
    assert all(start < end <= len(text) for start, end in found)
    if "```" not in text:
        covered = set()
        for start, end in found:
            covered.update(range(start, end))
        assert covered == set(range(len(text)))


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_sub_chunks_fit(text):
    found = list(sub_chunk_spans(text, 60, 10))
    assert all(end - start <= 60 for start, end in found)
    if text:
        assert found[0][0] == 0 and found[-1][1] == len(text)


def test_sub_chunk_rules(spark, rows):
    text = "a" * 700 + "! " + "b" * 200 + ".\n" + "c" * 600
    # ".\n" comes before "! " in the order of separators.
    assert list(sub_chunk_spans(text, 1200, 200)) == [(0, 904), (704, 1504)]
    assert sub_chunk_texts(" short ", 1200, 200) == [" short "]
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, text string")
    assert rows(sub_chunks(df), "id", "start", "end") == [(1, 0, 904), (1, 704, 1504)]
    got = {row[0]: row[1] for row in df.select("id", sub_chunk_array("text")).collect()}
    assert [len(piece) for piece in got[1]] == [903, 800]
    assert got[2] == ["short"]


def test_pieces_leave_in_small_batches():
    """A batch of long texts is cut without its pieces being held together."""
    import pyarrow as pa

    from lorekeep.operators import chunking

    texts = ["word " * 20_000] * 40
    held = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_key", "text"])
    cut = list(chunking._cut_rows("text", lambda text: chunking.chunk_spans(text, 1000, 100))(iter([held])))
    assert max(sum(map(len, batch.column("text").to_pylist())) for batch in cut) < 1_100_000
    rows = pa.Table.from_batches(cut)
    assert rows.column("doc_key").to_pylist() == [n for n in range(40) for _ in range(rows.num_rows // 40)]


def test_pieces_of_a_chunk_come_in_slices(spark, rows):
    """The pieces are those of the column; no function of columns holds those of a whole Arrow batch."""
    from lorekeep.operators import models
    from lorekeep.operators.chunking import with_sub_chunks

    text = "a" * 700 + "! " + "b" * 200 + ".\n" + "c" * 600
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, ""), (5, text * 3)], "chunk_id int, text string")
    assert rows(with_sub_chunks(df, "pieces")) == rows(df.select("chunk_id", sub_chunk_array("text")))
    assert "ArrowEvalPython" not in models.index_chunks(df)._jdf.queryExecution().executedPlan().toString()
