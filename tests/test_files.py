import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarry.jobs import answer, index, log
from quarry.operators import reports
from quarry.sources import collection, files, scratch, watch
from quarry.streaming.index import stream_index


@pytest.fixture()
def tree(tmp_path):
    for name, data in {
        "sample.txt": b"one\ntwo\nthree\n",
        "sample.md": b"# Title\n\n- [Links](https://example.com)\n",
        "UPPER.TXT": b"upper",
        "sub/nested_file.txt": b"a\nb",
        "unsupported.xyz": b"no",
        ".hidden.txt": b"no",
        ".git/inside.txt": b"no",
        "_name.txt": b"kept",
        "_folder/deep.txt": b"kept too",
        "latin.txt": "été".encode("latin-1"),
        "crlf.txt": b"a\r\nb\rc",
        "bom.txt": b"\xef\xbb\xbfmarked",
        "empty.txt": b"",
    }.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "in")


def names(df, top):
    return {r.path.split("/in/")[1] for r in df.collect()}


def test_crawl(spark, tree):
    got = names(files.crawl_files(spark, tree), tree)
    assert got == {"sample.txt", "sample.md", "UPPER.TXT", "sub/nested_file.txt", "_name.txt", "_folder/deep.txt", "latin.txt", "crlf.txt", "bom.txt", "empty.txt"}
    flat = names(files.crawl_files(spark, tree, recursive=False), tree)
    assert "sub/nested_file.txt" not in flat and "sample.txt" in flat and "_name.txt" in flat


def test_crawl_errors(spark, tree):
    with pytest.raises(FileNotFoundError):
        files.crawl_files(spark, tree + "/none")
    with pytest.raises(NotADirectoryError):
        files.crawl_files(spark, tree + "/sample.txt")


def test_size_limit(spark):
    rows = spark.createDataFrame([("/a.txt", 1048576), ("/b.txt", 1048577), ("/c", 1)], "path string, length long")
    assert [r.path for r in files.filter_files(rows, 1).collect()] == ["/a.txt"]


def test_read_text(spark, tree):
    got = {r.path.split("/in/")[1]: (r.text, r.encoding) for r in files.read_text(spark, tree).collect()}
    assert got["latin.txt"] == ("été", "latin-1")
    assert got["crlf.txt"] == ("a\nb\nc", "utf-8")
    assert got["bom.txt"] == ("marked", "utf-8-sig")
    assert got["_name.txt"] == ("kept", "utf-8") and got["_folder/deep.txt"] == ("kept too", "utf-8") and got["empty.txt"] == ("", "utf-8")
    assert set(got) == names(files.crawl_files(spark, tree), tree)


def test_empty_directory(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert files.crawl_files(spark, str(tmp_path / "e")).count() == 0


def test_store_checks_counts(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("a", "f", "/f", 0, [1.0]), ("b", "f", "/f", 1, None)], "id string, filename string, filepath string, chunk_index int, embedding array<double>")
    with pytest.raises(collection.CountMismatch):
        collection.store_chunks(rows, path)
    collection.open_collection(spark, path)
    good = rows.filter(F.col("embedding").isNotNull())
    collection.store_chunks(good, path)
    collection.store_chunks(good, path, skip_existing=True)
    assert collection.open_collection(spark, path).count() == 1
    collection.store_chunks(good, path)
    assert collection.open_collection(spark, path).count() == 2
    extra = spark.createDataFrame([("/f", 7, [1.0])], "filepath string, chunk_index int, embedding array<double>")
    with pytest.raises(collection.CountMismatch):
        collection.store_chunks(good, path, extra)


def test_equal_ids_of_other_chunks_are_stored(spark, tmp_path):
    path = str(tmp_path / "c")
    schema = "id string, filename string, filepath string, chunk_index int, document string, embedding array<double>"
    first = [("README.md_0_00000000", "README.md", "/a/README.md", 0, "a", [1.0]), ("x_0_1", "x", "/x", 0, None, [1.0])]
    other = [("README.md_0_00000000", "README.md", "/b/README.md", 0, "a", [1.0]), ("README.md_0_00000000", "README.md", "/a/README.md", 0, "b", [1.0])]
    collection.store_chunks(spark.createDataFrame(first, schema), path, skip_existing=True)
    collection.store_chunks(spark.createDataFrame(first + other, schema), path, skip_existing=True)
    assert sorted((r.filepath, r.document) for r in collection.open_collection(spark, path).filter("document IS NOT NULL").collect()) == [("/a/README.md", "a"), ("/a/README.md", "b"), ("/b/README.md", "a")]
    assert collection.open_collection(spark, path).count() == 4


def test_index_and_answer(spark, tree, tmp_path):
    results = index.index_directory(spark, tree, str(tmp_path / "coll"))
    by_name = {r.file_path.split("/in/")[1]: r for r in results.collect()}
    assert {n for n, r in by_name.items() if not r.success} == {"empty.txt"} and len(by_name) == 10
    stored = collection.open_collection(spark, str(tmp_path / "coll"))
    assert stored.filter("filename = 'sample.md'").first().document == "Title\n\nLinks\n"
    asked = spark.createDataFrame([("upper",)], "user_query string")
    got = answer.answer(asked, stored, per_query=3)
    assert got.ranked.orderBy("rank").first().filename == "UPPER.TXT"
    assert got.counters.first().total_queries == 6


def test_only_decoded_files_are_indexed(spark, tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    for name in ("a.pdf", "b.pdf"):
        (top / name).write_bytes(b"%PDF-1.7 \x00\xff rubbish")
    (top / "c.md").write_text("---\nTitle: T\nauthor: A\n    B\ntitle: again\n---\n# H\n")
    parsed = spark.createDataFrame([(f"file:{top}/b.pdf", "page text", {"total_pages": "1"})], "filepath string, content string, metadata map<string,string>")
    results = index.index_directory(spark, str(top), str(tmp_path / "coll"), parsed=parsed)
    errors = {r.file_path[-5:]: r.error_message for r in results.collect()}
    assert errors == {"a.pdf": "Processing error: no decoded content for this pdf file", "b.pdf": None, "/c.md": None}
    stored = {r.filename: r for r in collection.open_collection(spark, str(tmp_path / "coll")).collect()}
    assert set(stored) == {"b.pdf", "c.md"} and stored["b.pdf"].document == "page text" and stored["b.pdf"].metadata["total_pages"] == "1"
    assert stored["c.md"].document == "H\n" and stored["c.md"].metadata["title"] == "T" and stored["c.md"].metadata["author"] == '["A","B"]'
    update = reports.job_update(results, "j")
    state = reports.job_status(update).first()
    assert (state.status, state.files_processed, state.files_failed, state.total_chunks) == ("completed", 3, 1, 2)
    assert [f[-5:] for f in state.failed_files] == ["a.pdf"]


def documents_in(spark, target):
    return sorted((r.filepath.split("/in/")[1], r.document) for r in collection.open_collection(spark, target).collect())


def test_stream_takes_each_file_once(spark, tree, tmp_path):
    target, at = str(tmp_path / "s"), str(tmp_path / "at")
    open(tree + "/gap.txt", "w").write("a" + " " * 2000 + "b")
    report = str(tmp_path / "report")
    stream_index(spark, tree, target, at, report=report).awaitTermination()
    first = collection.open_collection(spark, target).count()
    open(tree + "/new.txt", "w").write("a new file")
    stream_index(spark, tree, target, at, report=report).awaitTermination()
    again = collection.open_collection(spark, target)
    assert again.count() == first + 1
    batch = index.chunk_files(index.documents_of(files.decoded(files.read_files(spark, tree))).filter("filename <> 'gap.txt'"))
    assert {r.id for r in again.select("id").collect()} == {r.id for r in batch.select("id").collect()}
    results = spark.read.option("recursiveFileLookup", "true").parquet(report).collect()
    assert len(results) == 12 and sorted(r.file_path.rpartition("/")[2] for r in results if not r.success) == ["empty.txt", "gap.txt"]


def test_stream_follows_changes(spark, tmp_path):
    top = tmp_path / "in"
    for name, data in {"a.txt": "first", "_u/b.TXT": "under", "gone.txt": "gone", "empty.txt": "", ".git/x.txt": "no", "c.xyz": "no"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(data)
    target, at = str(tmp_path / "s"), str(tmp_path / "at")
    run = lambda: stream_index(spark, str(top), target, at).awaitTermination()
    run()
    assert documents_in(spark, target) == [("_u/b.TXT", "under"), ("a.txt", "first"), ("gone.txt", "gone")]
    (top / "a.txt").write_text("second")
    (top / "gone.txt").unlink()
    run()
    assert documents_in(spark, target) == [("_u/b.TXT", "under"), ("a.txt", "second")]
    (top / "_u/b.TXT").unlink()
    (top / "old.txt").write_text("moved in")
    os.utime(top / "old.txt", (10**9, 10**9))
    run()
    run()
    assert documents_in(spark, target) == [("a.txt", "second"), ("old.txt", "moved in")]


def test_a_directory_indexed_twice_is_stored_once(spark, tree, tmp_path):
    target = str(tmp_path / "c")
    index.index_directory(spark, tree, target)
    first = documents_in(spark, target)
    index.index_directory(spark, tree, target)
    assert documents_in(spark, target) == first
    open(tree + "/sample.txt", "w").write("edited")
    os.remove(tree + "/UPPER.TXT")
    index.index_directory(spark, tree, target)
    assert dict(documents_in(spark, target))["sample.txt"] == "edited" and "UPPER.TXT" in dict(documents_in(spark, target))
    index.index_directory(spark, tree, target, remove_missing=True)
    assert [n for n, _ in documents_in(spark, target)] == [n for n, _ in first if n != "UPPER.TXT"]
    open(tree + "/sample.txt", "w").write("  ")
    index.index_directory(spark, tree, target)
    assert "sample.txt" not in dict(documents_in(spark, target))
    before = documents_in(spark, target)
    collection.compact(spark, target)
    assert documents_in(spark, target) == before and collection.vacuum(spark, target) > 0 and documents_in(spark, target) == before
    assert collection.vacuum(spark, target) == 0


SMALL = "id string, filename string, filepath string, chunk_index int, embedding array<double>"


def test_a_write_that_stops_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("a", "f", "/f", 0, [1.0])], SMALL)
    collection.store_chunks(rows, path)
    half = spark.range(100).select(F.lit("b").alias("id"), F.lit("f").alias("filename"), F.lit("/g").alias("filepath"), F.col("id").cast("int").alias("chunk_index"),
                                   F.when(F.col("id") < 90, F.array(F.lit(1.0))).otherwise(F.raise_error(F.lit("lost")).cast("array<double>")).alias("embedding"))
    with pytest.raises(Exception, match="lost"):
        collection.store_chunks(half.repartition(10, "chunk_index"), path)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(collection, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            collection.store_chunks(rows, path)
    (tmp_path / "c" / "_snapshots" / "0000000009.json").write_text('{"promoted": {}, "bat')
    assert collection.open_collection(spark, path).count() == 1
    collection.store_chunks(rows, path)
    assert collection.open_collection(spark, path).count() == 2 and collection.vacuum(spark, path) >= 3
    assert collection.open_collection(spark, path).count() == 2


def test_writers_at_the_same_time(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.open_collection(spark, path)
    rows = spark.createDataFrame([("a", "f", "/f", 0, [1.0])], SMALL)
    seen = collection.open_collection(spark, path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: collection.store_chunks(rows, path), range(6)))
    assert collection.open_collection(spark, path).count() == 6 and seen.count() == 0


def test_promoted_metadata_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.open_collection(spark, path, promoted={"lang": "string", "pages": "int"})
    rows = [("a", {"lang": "en", "pages": "3", "other": "x"}), ("b", {"lang": "de", "pages": "many"}), ("c", None)]
    df = spark.createDataFrame(rows, "id string, metadata map<string,string>").withColumn("embedding", F.array(F.lit(1.0)))
    collection.store_chunks(df, path)
    held = collection.open_collection(spark, path)
    some = held.filter(collection.metadata_equals(held, {"lang": "en", "pages": 3}))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in some.collect()] == ["a"] and "EqualTo(meta_lang,en)" in plan and "EqualTo(meta_pages,3)" in plan
    assert [r.id for r in held.filter(collection.metadata_equals(held, {"other": "x"})).collect()] == ["a"]
    assert held.filter(collection.metadata_equals(held, {})).count() == 3 and held.filter("id = 'b'").first().meta_pages is None
    assert collection.open_collection(spark, path, reset=True).columns == held.columns


def test_jobs_keep_their_log(spark, tree, tmp_path):
    at, target = str(tmp_path / "log"), str(tmp_path / "c")
    assert log.job_states(spark, at).count() == 0
    log.queue_job(spark, at, "one")
    assert [(r.job_id, r.status) for r in log.job_states(spark, at).collect()] == [("one", "queued")]
    states = []

    def job():
        states.append(log.job_states(spark, at).first().status)
        return index.index_directory(spark, tree, target)

    results = log.run_job(spark, at, "one", job)
    with pytest.raises(NotADirectoryError):
        log.run_job(spark, at, "two", lambda: index.index_directory(spark, tree + "/bom.txt", target))
    got = {r.job_id: r for r in log.job_states(spark, at).collect()}
    assert states == ["running"] and (got["one"].status, got["one"].files_processed, got["one"].files_failed) == ("completed", 10, 1)
    assert got["one"].failed_files[0].endswith("empty.txt") and got["one"].started_at <= got["one"].completed_at
    assert got["two"].status == "failed" and got["two"].error_message.startswith("Path is not a directory") and got["two"].message.startswith("Indexing failed: ")
    assert reports.job_list(log.job_states(spark, at)).first().job_id == "two"
    assert log.read_log(spark, at).count() == 5
    open(tree + "/empty.txt", "w").write("now there is text")
    again = log.run_job(spark, at, "three", lambda: index.retry_failed(results, target))
    assert again.count() == 10 and again.filter("NOT success").count() == 0 and dict(documents_in(spark, target))["empty.txt"] == "now there is text"
    os.remove(tree + "/empty.txt")
    lost = index.retry_failed(results, target).filter("NOT success").collect()
    assert [r.error_message for r in lost] == ["Processing error: no decoded content for this txt file"] and "empty.txt" not in dict(documents_in(spark, target))


def test_a_batch_run_again_replaces_its_part(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("a", "f", "/f", 0, [1.0])], "id string, filename string, filepath string, chunk_index int, embedding array<double>")
    collection.store_chunks(rows, path)
    for _ in range(2):
        collection.store_chunks(rows, path, part="p-1")
    assert collection.open_collection(spark, path).count() == 2


def test_scratch_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert scratch.shared_dir(Session()) == scratch.shared_dir(Session())


def test_contents_are_read_in_many_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * i)
    listing = files.crawl_files(spark, str(tmp_path))
    tasks = files.with_content(listing).select(F.spark_partition_id().alias("task"), F.length("content").alias("n")).collect()
    assert len({r["task"] for r in tasks}) == 4 and sorted(r["n"] for r in tasks) == list(range(40))


def test_chunks_that_are_there_are_not_encoded(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{n}", "a", n, f"text {n}") for n in range(3)], "id string, filepath string, chunk_index int, document string")
    at = str(tmp_path / "c")
    made = lambda df: df.withColumn("embedding", F.when(F.col("chunk_index") < 2, F.array(F.lit(1.0))).otherwise(F.array(F.lit(2.0))))
    collection.store_chunks(rows.filter("chunk_index < 2"), at, encode=made)
    once = lambda df: df.withColumn("embedding", F.when(F.col("chunk_index") < 2, F.raise_error(F.lit("encoded again")).cast("array<double>")).otherwise(F.array(F.lit(2.0))))
    collection.store_chunks(rows, at, skip_existing=True, encode=once)
    kept = collection.open_collection(spark, at).select("id", "embedding").collect()
    assert sorted((r["id"], r["embedding"]) for r in kept) == [("i0", [1.0]), ("i1", [1.0]), ("i2", [2.0])]


def kinds_in(spark):
    """The kinds of tables that lie in the shared folder, and how many of each."""
    found = [name.split("-")[1] for name in os.listdir(scratch.shared_dir(spark).removeprefix("file:")) if name.startswith("quarry-")]
    return {kind: found.count(kind) for kind in found}


def test_an_index_job_leaves_no_texts_behind(spark, tree, tmp_path):
    open(tree + "/gap.txt", "w").write("a" + " " * 2000 + "b")
    before = kinds_in(spark)
    results = index.index_directory(spark, tree, str(tmp_path / "c"))
    left = {kind for kind, n in kinds_in(spark).items() if n > before.get(kind, 0)}
    assert left == {"results", "listing"} and results.filter("success").agg(F.sum("chunks_stored")).first()[0] == collection.open_collection(spark, str(tmp_path / "c")).count()


def test_files_that_lack_vectors_are_left_out_of_their_batch(spark, tree, tmp_path):
    target = str(tmp_path / "c")
    open(tree + "/gap.txt", "w").write("a" + " " * 2000 + "b")
    errors = {r.file_path.rpartition("/")[2]: r.error_message for r in index.index_directory(spark, tree, target).collect() if not r.success}
    assert errors == {"empty.txt": "No content extracted from file", "gap.txt": "Embedding count mismatch: 5 chunks, 2 embeddings"}
    first = documents_in(spark, target)
    assert len(first) == 9 and "gap.txt" not in dict(first)
    assert "gap.txt" in {r.filepath.split("/in/")[1] for r in collection.indexed_files(spark, target).collect()}
    assert len(os.listdir(target + "/data")) == 1
    collection.compact(spark, target)
    assert documents_in(spark, target) == first and collection.vacuum(spark, target) > 0
    assert "gap.txt" in {r.filepath.split("/in/")[1] for r in collection.indexed_files(spark, target).collect()}
    index.index_directory(spark, tree, target)
    open(tree + "/gap.txt", "w").write("mended")
    index.index_directory(spark, tree, target)
    assert documents_in(spark, target) == sorted([*first, ("gap.txt", "mended")])


def test_long_texts_are_dealt_out_and_indexed_like_others(spark, tree, tmp_path, monkeypatch):
    open(tree + "/long.txt", "w").write("word after word " * 500)
    index.index_directory(spark, tree, str(tmp_path / "a"))
    monkeypatch.setattr(index, "LONG", 10)
    index.index_directory(spark, tree, str(tmp_path / "b"))
    held = [sorted(map(str, collection.open_collection(spark, str(tmp_path / x)).collect())) for x in "ab"]
    assert held[0] == held[1] and len(held[0]) == 27


def test_joins_of_the_index_job_move_no_texts(spark, tree, tmp_path, monkeypatch):
    open(tree + "/a.pdf", "wb").write(b"%PDF")
    parsed = spark.createDataFrame([(f"file:{tree}/a.pdf", "page text")], "filepath string, content string")
    joined, made = [], index.documents_of
    monkeypatch.setattr(index, "documents_of", lambda read, parsed=None: (joined.extend(read.select("path", "text").collect() if parsed is not None else []), made(read, parsed))[1])
    index.index_directory(spark, tree, str(tmp_path / "c"), parsed=parsed)
    assert [(r.path.rpartition("/")[2], r.text) for r in joined] == [("a.pdf", None)]
    docs = spark.createDataFrame([("/a", "txt", None, "text")], "filepath string, parser string, route_error string, content string")
    chunks = spark.createDataFrame([("/a", [1.0])], "filepath string, embedding array<double>")
    plan = reports.file_results(docs, chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "length(content" not in plan[: plan.index("Join")] and "length(content" in plan


def test_jobs_that_follow_one_another_leave_no_texts_behind(spark, tmp_path):
    top, target, at, before = tmp_path / "in", str(tmp_path / "c"), str(tmp_path / "log"), kinds_in(spark)
    top.mkdir()
    (top / "a.txt").write_text("some text")
    (top / "b.txt").write_text(" ")
    first = log.run_job(spark, at, "first", lambda: index.index_directory(spark, str(top), target))
    (top / "b.txt").write_text("mended")
    log.run_job(spark, at, "retry", lambda: index.retry_failed(first, target))
    log.run_job(spark, at, "again", lambda: index.index_directory(spark, str(top), target))
    assert {kind for kind, n in kinds_in(spark).items() if n > before.get(kind, 0)} == {"results", "listing", "retried"}
    assert documents_in(spark, target) == [("a.txt", "some text"), ("b.txt", "mended")] and len(os.listdir(target + "/data")) == 3
    assert [(r.job_id, r.files_failed, r.total_chunks) for r in log.job_states(spark, at).orderBy("job_id").collect()] == [("again", 0, 2), ("first", 1, 1), ("retry", 0, 2)]


def test_the_stream_keeps_no_contents_in_memory(spark, tree, tmp_path, monkeypatch):
    open(tree + "/large.txt", "w").write("words of a large file " * 100000)
    held, done = [], index.index_documents

    def measured(*args, **settings):
        results = done(*args, **settings)
        held.append(sum(info.memSize() + info.diskSize() for info in spark.sparkContext._jsc.sc().getRDDStorageInfo()))
        return results

    monkeypatch.setattr(index, "index_documents", measured)
    stream_index(spark, tree, str(tmp_path / "s"), str(tmp_path / "at")).awaitTermination()
    assert len(held) == 1 and held[0] < 100000
    assert "large.txt" in dict(documents_in(spark, str(tmp_path / "s")))


def test_a_task_of_the_file_source_holds_one_content(tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (i + 1))
    start, top = {"time": -1, "path": "", "listing": ""}, f"file:{tmp_path}"
    reader = watch.FileSource({"path": top}).streamReader(None)
    parts = reader.partitions(start, reader.latestOffset())
    (tmp_path / "1.txt").unlink()
    batches = [b for part in parts for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [1, 1] and sorted(b.column("content")[0].as_py() for b in batches) == [b"x", b"xxx"]
    source = watch.FileSource({"path": top, "contents": "false"})
    reader = source.streamReader(None)
    listed = [b for part in reader.partitions(start, reader.latestOffset()) for b in reader.read(part)]
    assert source.schema() == watch.LISTED and [b.schema.names for b in listed] == [["path", "modificationTime", "length"]] and listed[0].num_rows == 2


def test_files_that_went_are_passed_over_where_that_is_asked_for(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    there = spark.createDataFrame([(f"file:{tmp_path}/a.txt",), (f"file:{tmp_path}/none.txt",)], "path string")
    assert [bytes(r.content) for r in files.with_content(there, gone=True).collect()] == [b"a"]
    with pytest.raises(Exception, match="none.txt"):
        files.with_content(there).collect()
