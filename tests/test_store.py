import gzip

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lorekeep.operators import memory, models
from lorekeep.plans import ingest as ing, retrieve as rt
from lorekeep.sources.documents import markdown_stream, notes_to_docs, read_markdown, write_text_files
from lorekeep.sources.store import clear_store, open_store
from lorekeep.streaming.ingest import ingest_stream

DOCS = "doc_key string, source string, text string"
LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def words(topic):
    return f"{topic} {LINE} about {topic}\nsecond line on {topic} {LINE}"


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, str(tmp_path / "store"))


def test_ingest_and_retrieve(spark, store, rows):
    assert store.chunks.collect() == [] and store.next_id() == 0
    docs = spark.createDataFrame(
        [("1", "file:b.md", words("cats")), ("2", "file:a.md", words("dogs")), ("3", "file:c.md", words("cats")), ("4", "file:d.md", "too short")], DOCS
    )
    stats = ing.ingest(docs, store).first()
    assert (stats.chunks_stored, stats.chunks_complete, stats.chunks_failed, stats.questions_generated) == (3, 2, 1, 4)
    # The first in order of source keeps the text that two files share.
    assert rows(store.chunks, "chunk_id", "source") == [(0, "file:a.md"), (1, "file:b.md"), (2, "file:d.md")]
    assert rows(store.questions, "question_id") == [("chunk_0_q0",), ("chunk_0_q1",), ("chunk_1_q0",), ("chunk_1_q1",)]
    failed = memory.latest_status(store.chunk_status).filter("status = 'failed'").collect()
    assert [(r.chunk_id, r.attempt, r.error) for r in failed] == [(2, 3, "Failed to generate any summaries")]

    again = ing.ingest(docs, store).first()
    assert (again.chunks_stored, again.total_chunks, again.total_complete, again.total_failed) == (0, 3, 2, 1)
    assert store.questions.count() == 4

    more = ing.ingest(spark.createDataFrame([("9", "file:z.md", words("birds"))], DOCS), store).first()
    assert (more.chunks_stored, more.total_chunks) == (1, 4)
    assert store.chunks.agg(F.max("chunk_id")).first()[0] == 3

    asked = spark.createDataFrame([(1, "dogs about dogs"), (2, "birds birds")], "query_id long, text string")
    hits = rt.retrieve(asked, store.questions, store.chunks, k=1)
    assert rows(hits, "query_id", "source") == [(1, "file:a.md"), (2, "file:z.md")]
    texts = store.chunk_texts(spark.createDataFrame([(0,), (77,)], "chunk_id long"))
    assert rows(texts) == [(0, words("dogs")), (77, None)]
    assert rows(memory.find_by_text(store.chunks, words("dogs")), "chunk_id") == [(0,)]

    clear_store(spark, store.path)
    assert store.chunks.count() == store.questions.count() == store.chunk_status.count() == 0
    assert store.next_id() == 0


def test_next_id_reads_no_chunks(spark, store, monkeypatch):
    ing.ingest(spark.createDataFrame([("1", "s", words("cats")), ("2", "s", words("dogs"))], DOCS), store)
    monkeypatch.setattr(type(store), "chunks", property(lambda self: pytest.fail("chunks were read")))
    assert store.next_id() == 2


def scanned(df):
    """Rows that the scans of a query give, as the plan counts them, and how many there are."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    total = 0
    for at in range(leaves.size()):
        leaf = leaves.apply(at)
        while "Stage" in leaf.nodeName():
            leaf = leaf.plan().collectLeaves().apply(0)
        if leaf.nodeName().startswith("Scan"):
            total += leaf.metrics().apply("numOutputRows").value()
    return total


def test_looking_hashes_up_reads_as_much_in_a_large_store(spark, store):
    hashed = lambda low, high: spark.range(low, high, 1, 2).select("id", F.md5(F.col("id").cast("string")).alias("hash"))
    batch = hashed(5, 9).unionByName(hashed(10_000_000, 10_000_003))
    read = []
    for low, high in ((0, 20_000), (20_000, 3_000_000)):
        store.append_hashes(hashed(low, high), high)
        store.reserve(low, high - low)
        store.compact_hashes()
        known = store.known_hashes(batch, 7)
        assert known.count() == 4
        read.append(scanned(known))
    # A hundred and fifty times the hashes, still no more than the pages of the values looked for.
    assert 0 < read[0] <= 7 * 20_000 / 256 * 2 and read[1] <= 7 * 20_000, read
    assert store.hashes().count() == 3_000_000


@pytest.mark.parametrize("rows", [10, 1_000, 10_000_000])
def test_known_hashes_by_value_by_broadcast_and_by_shuffle(spark, store, rows):
    hashed = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("hash"))
    store.append_hashes(hashed.filter("id % 3 = 0"), 3000)
    store.append_hashes(hashed.filter("id % 3 = 0").limit(0), 3000)
    store.reserve(0, 3000)
    batch = hashed.filter("id between 100 and 109") if rows == 10 else hashed
    want = {row.hash for row in batch.filter("id % 3 = 0").collect()}
    found = [row.hash for row in store.known_hashes(batch, rows).collect()]
    assert set(found) == want and len(found) == len(want)


def test_hashes_that_a_lost_batch_left_out_are_added(spark, store, monkeypatch):
    docs = spark.createDataFrame([("1", "s", words("cats")), ("2", "s", words("dogs"))], DOCS)

    def lost(self, *args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(type(store), "append_hashes", lost)
        with pytest.raises(RuntimeError):
            ing.ingest(docs, store)
    assert store.chunks.count() == 2 and store.hashes().count() == 0
    again = ing.ingest(docs, store).first()
    assert (again.chunks_stored, again.total_chunks, again.total_complete) == (0, 2, 2)
    assert store.hashes().count() == 2


def test_totals_read_what_has_not_settled(spark, store):
    assert store.settle() == (0, 0, 0)
    ing.ingest(spark.createDataFrame([("1", "s", words("cats")), ("2", "s", "too short")], DOCS), store)
    assert store.settled() == (2, 2, 1, 1)
    ing.store_pending(spark.createDataFrame([("3", "s", words("dogs")), ("4", "s", words("birds"))], DOCS), store, 4000, 400, 2)
    # Pending chunks hold the record back, not the totals.
    assert store.settle() == (4, 1, 1) and store.settled() == (2, 2, 1, 1)
    row = ing.ingest(spark.createDataFrame([("5", "s", words("fish"))], DOCS), store).first()
    assert (row.chunks_stored, row.total_chunks, row.total_complete, row.total_failed) == (1, 5, 4, 1)
    assert store.settled() == (5, 5, 4, 1)
    whole = memory.with_status(store.chunks, store.chunk_status)
    assert memory.ingest_stats(whole, whole).first().total_complete == 4
    clear_store(spark, store.path)
    assert store.settled() == (0, 0, 0, 0) and store.hashes().count() == 0


def test_compacting_twice_keeps_every_hash(spark, store):
    for topic in ("cats", "dogs", "birds"):
        ing.ingest(spark.createDataFrame([("1", "s", words(topic))], DOCS), store)
        store.compact_hashes()
    again = ing.ingest(spark.createDataFrame([("9", "t", words("dogs"))], DOCS), store).first()
    assert (again.chunks_stored, again.total_chunks, store.hashes().count()) == (0, 3, 3)


def test_a_store_without_a_record_counts_its_chunks(spark, store):
    chunks = [(7, "h", "s", 0, 1, "t")]
    store.append_chunks(spark.createDataFrame(chunks, "chunk_id long, hash string, source string, pos int, length int, text string"))
    assert store.next_id() == 8
    store.reserve(8, 2)
    assert store.next_id() == 10


@pytest.mark.parametrize("broken", ["append_status", "append_chunks"])
def test_a_batch_lost_between_its_writes_takes_its_ids_along(spark, store, monkeypatch, broken):
    docs = spark.createDataFrame([("1", "s", words("cats")), ("2", "s", words("dogs"))], DOCS)

    def lost(self, rows):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(type(store), broken, lost)
        with pytest.raises(RuntimeError):
            ing.ingest(docs, store)
    assert store.chunks.count() == 0 and store.next_id() == 2
    again = ing.ingest(docs, store).first()
    assert (again.chunks_stored, again.chunks_complete) == (2, 2)
    assert sorted(row.chunk_id for row in store.chunks.collect()) == [2, 3]
    assert store.questions.select("question_id").distinct().count() == store.questions.count() == 4


def test_a_record_that_is_half_written_is_passed_over(spark, store, tmp_path):
    store.reserve(0, 3)
    store.reserve(3, 4)
    assert store.next_id() == 7
    import shutil

    # The folder of the newest record as a lost writer leaves it.
    newest = max(("even", "odd"), key=lambda name: spark.read.parquet(f"{store.path}/next_id/{name}").first()[0])
    shutil.rmtree(f"{store.path}/next_id/{newest}")
    (tmp_path / "store" / "next_id" / newest / "_temporary").mkdir(parents=True)
    assert store.next_id() == 3


def test_a_failing_model_leaves_chunks_pending_until_the_last_attempt(spark, store):
    docs = spark.createDataFrame([("1", "s", words("cats")), ("2", "s", words("dogs"))], DOCS)

    def fails_on_dogs(prompts):
        if any("dogs" in prompt for prompt in prompts):
            raise RuntimeError("model down")
        return [f"The passage tells of {LINE} and more.\nIt also tells of {LINE} too." for _ in prompts]

    def vectors(texts):
        return [[1.0, float(len(text))] for text in texts]

    given = ing.Models(fails_on_dogs, vectors)
    ing.store_pending(docs, store, 4000, 400, 0)
    ing.index_pending(store, given, last=False)
    status = memory.latest_status(store.chunk_status)
    assert {(r.chunk_id, r.status, r.attempt) for r in status.collect()} == {(0, "complete", 1), (1, "pending", 1)}
    ing.index_pending(store, given, last=True)
    final = {r.chunk_id: r for r in memory.latest_status(store.chunk_status).collect()}
    assert (final[1].status, final[1].error, final[1].questions) == ("failed", "model down", None)
    assert len(final[0].questions) == 2 and store.questions.count() == 2
    report = memory.load_report(ing.batch_report(store.chunks, store)).first()
    assert (report.stored, report.complete, report.failed, report.success_rate) == (2, 1, 1, 50.0)


def test_failed_attempts_are_due_again_later(spark, store):
    def down(prompts):
        raise RuntimeError("model down")

    docs = spark.createDataFrame([("1", "s", words("cats"))], DOCS)
    broken = ing.Models(down)
    row = ing.ingest(docs, store, broken, retry_after=3600).first()
    assert (row.chunks_stored, row.chunks_complete, row.chunks_failed) == (1, 0, 0)
    first = memory.latest_status(store.chunk_status, ("status", "next_try_at")).first()
    wait = spark.range(1).select(F.lit(first.next_try_at) - F.current_timestamp()).first()[0].total_seconds()
    assert (first.status, first.attempt) == ("pending", 1) and 3000 < wait <= 3600
    # Not due: neither a pass nor a later batch touches it.
    assert not ing.retry_due(store, ing.Models())
    row = ing.ingest(spark.createDataFrame([("2", "s", words("dogs"))], DOCS), store, retry_after=0).first()
    assert (row.chunks_complete, row.total_chunks, row.total_complete) == (1, 2, 1)


def test_what_is_due_is_tried_until_it_is_complete_or_failed(spark, store):
    def no_dogs(prompts):
        if any("dogs" in prompt for prompt in prompts):
            raise RuntimeError("model down")
        return [f"The passage tells of {LINE} and more.\nIt also tells of {LINE} too." for _ in prompts]

    docs = spark.createDataFrame([("1", "s", words("cats")), ("2", "s", words("dogs"))], DOCS)
    ing.ingest(docs, store, ing.Models(no_dogs), retry_after=0)
    assert ing.retry_due(store, ing.Models(no_dogs), retry_after=0)
    assert memory.latest_status(store.chunk_status).filter("status = 'pending' and attempt = 2").count() == 1
    # A batch on another subject resumes it; the third attempt is the last.
    row = ing.ingest(spark.createDataFrame([("3", "s", words("birds"))], DOCS), store, ing.Models(no_dogs), retry_after=0).first()
    assert (row.total_chunks, row.total_complete, row.total_failed) == (3, 2, 1)
    assert not ing.retry_due(store, ing.Models()) and store.settled() == (3, 3, 2, 1)


def test_a_chunk_without_vectors_is_not_complete(spark):
    chunks = spark.createDataFrame([(1, words("cats"))], "chunk_id long, text string")

    def broken(texts):
        raise ValueError("no")

    row = models.index_chunks(chunks, embed_fn=broken).first()
    assert (row.status, row.error) == ("failed", "Failed to embed a summary")


def test_summaries_are_accumulated_over_attempts(spark):
    df = spark.createDataFrame([(1, "text")], "id long, text string")

    def one_line(prompts):
        return [f"Statement {LINE} {'first' if ' 3 factual' in prompt else 'next'}" for prompt in prompts]

    row = models.summarize(df, fn=one_line, n=3).first()
    assert [s.rsplit(" ", 1)[1] for s in row.summaries] == ["first", "next"] and row.error is None

    def greedy(prompts):
        return ["\n".join(f"Line {n} {LINE}" for n in range(9)) for _ in prompts]

    assert len(models.summarize(df, fn=greedy, n=3).first().summaries) == 3

    def silent(prompts):
        return ["" for _ in prompts]

    row = models.summarize(df, fn=silent).first()
    assert row.summaries == [] and row.error == "Failed to generate any summaries"


def test_pieces_that_fail_are_skipped(spark):
    text = ("a" * 30 + " ") * 30 + "BAD. " + ("b" * 30 + " ") * 60
    df = spark.createDataFrame([(1, text)], "chunk_id long, text string")

    def model(prompts):
        if any("BAD" in prompt for prompt in prompts):
            raise ValueError("bad piece")
        return [f"Statement one {LINE}\nStatement two {LINE}" for _ in prompts]

    row = models.summarize_chunks(df, model).first()
    assert len(row.questions) > 0 and len(row.questions) % 2 == 0 and row.error is None


def test_expansion_and_refinement(spark, rows):
    df = spark.createDataFrame([(1, "short one"), (2, " ".join(["word"] * 11)), (3, "fail me")], "query_id long, text string")

    def model(prompts):
        if any("fail" in prompt for prompt in prompts):
            raise ValueError("down")
        return [" a longer form of the request " for _ in prompts]

    got = dict(rows(models.expand_queries(df, model), "query_id", "search_text"))
    assert got == {1: "a longer form of the request", 2: " ".join(["word"] * 11), 3: "fail me"}
    table = spark.createDataFrame([(1, "tiny"), (3, "fail me harder")], "query_id long, expansion string")
    got = dict(rows(models.expand_queries(df, expansions=table), "query_id", "search_text"))
    assert got[1] == "short one" and got[3] == "fail me harder"
    assert dict(rows(models.expand_queries(df), "query_id", "search_text"))[1] == "short one"

    answers = spark.createDataFrame([("q", "x" * 9000), ("fail", "kept")], "question string, answer string")
    seen = models.refine_answers(answers, lambda prompts: [model(prompts) and str(len(p.split("Draft:\n")[1])) for p in prompts])
    assert rows(seen, "refined") == [(str(8000 + len("\n\n[Response truncated for refinement]") + len("\n\nAnswer:")),), ("kept",)]


def test_many_text_files(spark, tmp_path):
    """A file per text, but not a folder per file."""
    texts = [None, " ", "é\u2028x", "two\nlines"] + [f"text {n}" for n in range(2500)]
    held = spark.createDataFrame([(text,) for text in texts], "text string").coalesce(1)
    assert write_text_files(held, str(tmp_path / "files")) == len(texts)
    assert len(list((tmp_path / "files").iterdir())) == 3
    got = read_markdown(spark, f"{tmp_path}/files/folder=*", pattern="*.txt").select("text").collect()
    assert sorted(row.text for row in got) == sorted(texts[2:])
    assert write_text_files(held.limit(0), str(tmp_path / "none")) == 0


def test_files_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no file's name, and a task reads more than a few files."""
    held = spark.range(2500).selectExpr("concat('text ', id) as text").coalesce(1)
    assert write_text_files(held, str(tmp_path / "files")) == 2500
    got = read_markdown(spark, f"{tmp_path}/files/folder=*", pattern="*.txt")
    assert "FileScan text" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() == 1 and got.count() == 2500


@pytest.mark.parametrize("pattern", ["*.{md,txt}", "?[!x]*", "*"])
@pytest.mark.parametrize("path", ["/plain", "/{plain,other}", "/[_o]*", "/plain/é a.md", "/parts", "/parts/k=1", "/packed"])
def test_same_files_as_sparks_reader(spark, tmp_path, rows, path, pattern):
    names = ["a.md", "é a.md", "b +%41.md", "_c.md", ".d.md", "_e=1.md", "f.md._COPYING_", "a\nb.md", "{x}.md", "g.txt"]
    folders = {"plain": names, "plain/deep": ["h.md"], "other": ["i.md", "ax.txt"], "parts/k=1": ["j.md"], "parts/k=2/deep": ["l.md"], "packed": ["m.md"], "_no": ["n.md"]}
    for folder, files in folders.items():
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        for name in files:
            (tmp_path / "in" / folder / name).write_bytes(f"{folder}\r\n{name}\rx".encode() + b"\xff y")
    (tmp_path / "in" / "plain" / "empty.md").touch()
    (tmp_path / "in" / "plain" / "gone.md").symlink_to(tmp_path / "gone")
    with gzip.open(tmp_path / "in" / "packed" / "o.gz", "wb") as file:
        file.write(b"packed")
    place = f"{tmp_path}/in{path}"
    want = spark.read.text(place, wholetext=True, pathGlobFilter=pattern)
    name = F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B"))
    want = want.select(name.alias("doc_key"), F.concat(F.lit("file:"), name), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    assert rows(read_markdown(spark, place, pattern)) == rows(want.filter("text != ''"))


def test_missing_folder(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_markdown(spark, str(tmp_path / "none"))


def test_markdown_files(spark, tmp_path, rows):
    (tmp_path / "b +%.md").write_bytes("one\r\ntwo\rthree é".encode())
    (tmp_path / "blank.md").write_text(" \n\t ")
    (tmp_path / "other.txt").write_text("no")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.md").write_text("deep")
    got = rows(read_markdown(spark, str(tmp_path)))
    assert got == [("b +%.md", "file:b +%.md", "one\ntwo\nthree é")]
    assert rows(read_markdown(spark, str(tmp_path), "*.txt"), "source") == [("file:other.txt",)]


def test_notes(spark, rows):
    notes = spark.createDataFrame([(1, "i", "c"), (2, "j", "")], "note_id long, information string, context string")
    assert rows(notes_to_docs(notes)) == [("1", "chat", "c: i"), ("2", "chat", "j")]


def test_built_in_tools(spark):
    got = {r.name: r for r in rt.memory_tools(spark).collect()}
    assert got[rt.RETRIEVE_TOOL].required == ["query"] and set(got[rt.STORE_TOOL].params) == {"information", "context"}


def test_tool_calls_on_the_memory(spark, rows):
    chunks = spark.createDataFrame([(1, words("cats"), "s"), (2, words("dogs"), "s")], "chunk_id long, text string, source string")
    questions = models.explode_questions(models.index_chunks(chunks))
    calls = spark.createDataFrame(
        [
            (1, "retrieve_memory", '{"query": "dogs", "max_results": 1}'),
            (2, "retrieve_memory", '{"query": "cats"}'),
            (3, "retrieve_memory", '{"query": ""}'),
            (4, "store_memory", '{"information": "new", "context": "c"}'),
            (5, "store_memory", '{"information": "c: new"}'),
            (6, "store_memory", '{"information": "known"}'),
        ],
        "call_id long, name string, arguments string",
    )
    told = dict(rows(rt.answer_retrieve_calls(calls, questions, chunks)))
    assert told[1].startswith("1. dogs") and told[1].count("relevance") == 1
    assert told[2].count("relevance") == 2
    assert told[3] == "No relevant information found in memory"
    stored = spark.createDataFrame([("known",)], "text string").select(F.md5("text").alias("hash"))
    fresh, answers = rt.answer_store_calls(calls, stored)
    assert rows(fresh, "call_id", "text") == [(4, "c: new")]
    said = dict(rows(answers))
    assert said[4].startswith("Stored 1 new chunk") and said[5].startswith("Information NOT") and said[6].startswith("Information NOT")


def test_stream_adds_each_file_once(spark, store, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(words("cats"))
    (folder / "blank.md").write_text(" ")

    def run():
        query = ingest_stream(markdown_stream(spark, str(folder)), store, str(tmp_path / "progress"))
        query.awaitTermination()

    run()
    assert rows(store.chunks, "chunk_id", "source") == [(0, "file:a.md")]
    (folder / "b.md").write_text(words("dogs"))
    (folder / "copy.md").write_text(words("cats"))
    run()
    assert rows(store.chunks, "chunk_id", "source") == [(0, "file:a.md"), (1, "file:b.md")]
    assert store.questions.count() == 4


def test_a_batch_cut_off_half_way_is_completed_by_its_replay(spark, store, rows):
    docs = spark.createDataFrame([("1", "s", words("cats"))], DOCS)
    ing.store_pending(docs, store, 4000, 400, 0)
    # The run ends here; the vectors of its next step are written, its status is not.
    done = models.index_chunks(ing.pending_chunks(store)[0])
    store.append_questions(models.explode_questions(done))
    assert ing.pending_chunks(store, since=1) is None
    ing.ingest(docs, store)
    assert store.chunks.count() == 1 and store.questions.count() == 2
    assert rows(memory.latest_status(store.chunk_status), "chunk_id", "status") == [(0, "complete")]


def test_new_chunks_are_compared_with_the_store_either_way(spark, store, rows, monkeypatch):
    from lorekeep.sources import store as sources

    ing.ingest(spark.createDataFrame([("1", "s", words("cats"))], DOCS), store)
    both = spark.createDataFrame([("1", "t", words("cats")), ("2", "t", words("dogs"))], DOCS)
    for lookup, broadcast in ((512, 500_000), (0, 500_000), (0, 0)):
        monkeypatch.setattr(sources, "LOOKUP_KEYS", lookup)
        monkeypatch.setattr(sources, "BROADCAST_KEYS", broadcast)
        monkeypatch.setattr(ing, "BROADCAST_KEYS", broadcast)
        narrow, whole = ing.new_chunks(both, store, 4000, 400, 1)
        assert rows(narrow, "chunk_id", "doc_key") == rows(whole, "chunk_id", "doc_key") == [(1, "2")]
        assert "text" not in narrow.columns and rows(whole, "text") == [(words("dogs"),)]


def test_a_batch_comes_back_with_its_failures(spark, store, rows):
    docs = spark.createDataFrame([("1", "s", words("cats")), ("2", "s", "short"), ("3", "t", "brief")], DOCS)
    repeated = docs.unionByName(docs.filter("doc_key = '1'"))
    stats, report = ing.ingest_batch(repeated, store, max_attempts=2, delay=0.01)
    assert stats.first().chunks_stored == 3 and stats.first().total_failed == 2
    assert rows(memory.failures(report, 1), "source", "total_failed") == [("s", 2)]
    assert rows(memory.load_report(report), "source", "complete", "failed") == [("s", 1, 1), ("t", 0, 1)]


def test_listings(spark, rows):
    chunks = spark.createDataFrame(
        [(1, "x" * 12, "file:a"), (2, "y", "file:b"), (3, None, "chat")], "chunk_id long, text string, source string"
    )
    assert rows(memory.list_chunks(chunks, source="file", file="b"), "chunk_id") == [(2,)]
    assert [tuple(r) for r in memory.count_by_source(chunks).collect()] == [("chat", 1), ("file:a", 1), ("file:b", 1)]
    assert tuple(memory.memory_stats(chunks).first()) == (3, 3, 2, 13)
    assert [r.source for r in memory.distinct_sources(chunks).collect()] == ["chat", "file:a", "file:b"]
    status = spark.createDataFrame([(1, 0, "pending", None, None), (1, 1, "failed", "e" * 150, None)], "chunk_id long, attempt int, status string, error string, questions array<string>")
    joined = memory.with_status(chunks, status)
    assert rows(joined, "chunk_id", "status") == [(1, "failed"), (2, "complete"), (3, "complete")]
    shown = memory.failures(joined, 10).first()
    assert shown.error == "e" * 100 + "..." and shown.total_failed == 1
    assert memory.load_total(memory.load_report(joined.limit(0))).first().success_rate is None


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_a_new_batch_stay_where_they_are(spark, store, rows):
    docs = spark.createDataFrame([(str(n), "s", words(f"topic{n}")) for n in range(4)], DOCS)
    ing.store_pending(docs, store, 4000, 400, 0)
    found, held = ing.pending_chunks(store)
    assert "Join" not in _plan(found) and held.isEmpty()
    assert rows(found, "chunk_id", "attempt") == [(n, 0) for n in range(4)]
    # Of a batch that was indexed in part only the rest is asked for, which few ids tell.
    status = found.filter("chunk_id % 2 = 0").selectExpr("chunk_id", "1 as attempt", "'complete' as status", "'' as error", "array('') as questions")
    store.append_status(status)
    vectors = found.selectExpr("concat('q', chunk_id) as question_id", "chunk_id", "0 as ordinal", "'' as question", "array(1f) as embedding")
    store.append_questions(vectors.filter("chunk_id < 2"))
    found, held = ing.pending_chunks(store)
    assert "broadcast" in _plan(found)
    assert rows(found, "chunk_id", "attempt") == [(1, 0), (3, 0)] and rows(held, "chunk_id") == [(1,)]
    # Vectors that are there already are not written again.
    ing.index_pending(store, ing.Models(), last=True)
    assert rows(store.questions.groupBy("chunk_id").count()) == [(0, 1), (1, 1), (3, 2)]
