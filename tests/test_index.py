"""Trees, snapshots, books, the service, logs and the stream."""

import json
import os
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.embedding import HashEmbedder
from tessera.operators import analytics, merge
from tessera.plans import benchmark
from tessera.plans import search as plan
from tessera.plans.index import check_status, delete_project, index_books, index_project, sync_all
from tessera.sources import logs
from tessera.sources.files import collect_files, list_files, read_files
from tessera.sources.snapshots import FILES, Conflict, Store
from tessera.streaming.watch import stop, watch, watch_each, watchers

CODE = "def {name}(value: Widget) -> Result:\n" + "".join(f"    step_{i} = compute(value, {i})\n" for i in range(12)) + "    return step_0\n"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    Path(path).write_text(text, "utf-8")


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "proj")
    write(f"{root}/src/a.py", CODE.format(name="alpha"))
    write(f"{root}/src/b.py", CODE.format(name="beta"))
    write(f"{root}/doc.md", "# Guide\n" + "words about alpha and beta " * 10)
    write(f"{root}/node_modules/x.py", CODE.format(name="x"))
    write(f"{root}/logo.png", "x")
    return root


def test_walk(spark, tree):
    assert [os.path.basename(p) for p, *_ in collect_files(tree)] == ["doc.md", "a.py", "b.py"]
    with open(f"{tree}/bad.py", "wb") as f:
        f.write(b"\xff\xfe")
    write(f"{tree}/big.py", "x" * 600_000)
    errors = {os.path.basename(r["filepath"]): r["error"] for r in read_files(list_files(spark, tree)).collect()}
    assert errors == {"a.py": None, "b.py": None, "doc.md": None, "bad.py": "not_utf8", "big.py": "file_too_large"}


def test_index_and_sync(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert check_status(store, tree, "p").groupBy("state").count().collect() == [("new", 3)]
    first = index_project(store, tree, "p")
    assert (first["indexed"], first["removed"], first["errors"]) == (3, 0, 0)
    pinned = store.current()
    assert index_project(store, tree, "p")["unchanged"] == 3
    write(f"{tree}/src/a.py", CODE.format(name="gamma"))
    os.unlink(f"{tree}/src/b.py")
    states = {os.path.basename(r["filepath"]): r["state"] for r in check_status(store, tree, "p").collect()}
    assert states == {"a.py": "modified", "b.py": "deleted", "doc.md": "unchanged"}
    again = index_project(store, tree, "p")
    assert (again["indexed"], again["removed"], again["unchanged"]) == (1, 1, 1)
    names = {r["symbol_name"] for r in store.read("chunks").collect()}
    assert "gamma" in names and not names & {"alpha", "beta"}
    assert "beta" in {r["symbol_name"] for r in store.read("chunks", pinned).collect()}  # a pinned snapshot stays whole
    # a merge equals a rebuild
    fresh = Store(spark, str(tmp_path / "fresh"))
    index_project(fresh, tree, "p")
    rows = lambda s: sorted((r["chunk_id"], r["filepath"]) for r in s.read("chunks").collect())
    assert rows(store) == rows(fresh)
    # another project finds the same file unchanged, and its first owner stays
    index_project(store, tree, "q")
    assert {r["project_id"] for r in store.read("files").collect()} == {"p"}
    assert sync_all(store, {"p": tree}, force=True)["indexed"] == 2
    assert delete_project(store, "p")["files"] == 2 and store.read("chunks").isEmpty()
    store.reset()


def test_two_writers(spark, tmp_path):
    """Both read the same version; the second to commit is refused, and loses nothing when it begins anew."""
    store = Store(spark, str(tmp_path / "s"))
    row = lambda p, f: spark.createDataFrame([(f, "h", "python", None, 1, "/r", p)], FILES)
    one, other = store.current(), store.current()
    store.commit(one, ["p"], files=row("p", "a"))
    with pytest.raises(Conflict):
        store.commit(other, ["q"], files=row("q", "b"))
    assert [r["filepath"] for r in store.read("files").collect()] == ["a"] and len(os.listdir(tmp_path / "s" / "data")) == 1
    calls = []

    def change(at):
        calls.append(at.version)
        if len(calls) == 1:  # somebody commits in between
            store.commit(at, ["r"], files=row("r", "c"))
        store.commit(at, ["q"], files=row("q", "b"))

    store.update(change)
    assert calls == [1, 2] and sorted(r["filepath"] for r in store.read("files").collect()) == ["a", "b", "c"]


def test_untouched_projects_keep_their_files(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write(f"{tmp_path}/two/x.py", CODE.format(name="delta"))
    index_project(store, tree, "p")
    index_project(store, f"{tmp_path}/two", "q=1/2")
    first = store.current()
    assert set(first.tables["chunks"]) == {"p", "q=1/2"}
    assert index_project(store, tree, "p")["unchanged"] == 3 and store.current() == first  # nothing to commit
    write(f"{tree}/src/a.py", CODE.format(name="gamma"))
    index_project(store, tree, "p")
    now = store.current()
    for name in ("files", "chunks"):
        assert now.tables[name]["q=1/2"] == first.tables[name]["q=1/2"] and now.tables[name]["p"] != first.tables[name]["p"]
    assert {r["symbol_name"] for r in store.read("chunks", parts=["q=1/2"]).collect()} == {"delta"}
    before = sorted(map(str, store.read("chunks").drop("embedding").collect()))
    assert store.vacuum(keep=1) == 2 and store.versions() == [now.version]
    assert sorted(map(str, store.read("chunks").drop("embedding").collect())) == before
    assert delete_project(store, "q=1/2")["files"] == 1 and set(store.current().tables["files"]) == {"p"}


def test_service(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    index_project(store, tree, "p")
    service = plan.Service(store, HashEmbedder(64))
    rows = service.search_codebase("alpha value Widget compute step", project="p").orderBy("rank").collect()
    assert rows and rows[0]["symbol_name"] in ("alpha", "beta") and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert {r["filepath"] for r in service.search_by_file(f"{tree}/src/b.py", "beta value Widget compute step").collect()} <= {f"{tree}/src/b.py"}
    assert service.search_codebase("alpha value Widget compute", file_type="docs").where("filepath LIKE '%.py'").isEmpty()
    both = service.search_codebase(["alpha value Widget compute step", "words about alpha and beta"])
    alone = service.search_codebase("words about alpha and beta")
    key = lambda df, q: sorted((r["rank"], r["filepath"], r["start_line"]) for r in df.where(F.col("query_id") == q).collect())
    assert key(both, 1) == key(alone, 0)
    assert service.list_projects().first()["file_count"] == 3
    text = plan.format_results(both).first()["text"]
    assert text.startswith("## Result 1 (relevance: ")


def test_log(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    index_project(store, tree, "p")
    service = plan.Service(store)
    queries = service._queries(["alpha value Widget compute step", "zzz"])
    results = plan.search(store.read("chunks").drop("project_id"), store.read("files"), queries)
    path = str(tmp_path / "log")
    logs.append_log(plan.log_rows(queries, results, 12.5), path)
    with open(f"{path}/bad.json", "w") as f:
        f.write("\n{broken\n" + json.dumps({"seq": 9, "ts": "2020-01-01T00:00:00Z", "query": "old", "outcome": "ok", "results": []}) + "\n")
    df = logs.read_log(spark, path)
    assert df.count() == 3
    assert logs.read_log(spark, path, since="2021-01-01").count() == 2
    assert [r["query"] for r in logs.read_log(spark, path, last=1).collect()] == ["old"]
    logs.save_baseline(str(tmp_path / "b.json"), {"mrr": 1.0}, [{"category": "a", "mrr": 1.0}])
    assert logs.load_baseline(str(tmp_path / "b.json"))["by_category"]["a"]["mrr"] == 1.0 and logs.load_baseline(str(tmp_path / "none")) is None


def test_service_log_and_benchmark(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    index_project(store, tree, "p")
    path = str(tmp_path / "log")
    service = plan.Service(store, settings=Settings(search_log_path=path))
    found = service.search_codebase(["alpha value compute step", "zzz qqq"], project="p")
    plain = plan.Service(store).search_codebase(["alpha value compute step", "zzz qqq"], project="p")
    key = lambda df: sorted((r["query_id"], r["rank"], r["filepath"], r["score"]) for r in df.collect())
    assert key(found) == key(plain) and key(found)
    rows = {r["query"]: r for r in logs.read_log(spark, path).collect()}
    good, bad = rows["alpha value compute step"], rows["zzz qqq"]
    assert (good["outcome"], good["tool"], good["filters"]["project"], good["budget"]["max_tokens"]) == ("ok", "search_codebase", "p", 8000)
    assert good["retrieval"]["candidates"] > 0 and good["retrieval"]["fallback_used"] and len(good["results"]) == sum(r[0] == 0 for r in key(found))
    assert bad["outcome"] != "ok" and bad["budget"]["returned_results"] == 0
    report = analytics.control_counters(logs.read_log(spark, path), ("per_file_budget_skipped", "per_file_file_replaced", "per_file_symbol_capped"))
    assert report.first()["per_file_symbol_capped_total"] == 0
    questions = tmp_path / "questions.json"
    lines = [{"query": "alpha value compute step", "category": "code", "expect_files": ["src/a.py"], "expect_symbols": ["alpha"]}, {"query": "zzz qqq", "category": "none", "expect_files": ["nowhere.py"]}, {"category": "broken"}]
    questions.write_text("\n".join(map(json.dumps, lines)))
    base = str(tmp_path / "base" / "one.json")
    metrics = benchmark.run(plan.Service(store), str(questions), "p")
    first = {r["query_id"]: r for r in metrics.collect()}
    assert first[0]["file_hit_5"] and first[0]["symbol_hit_5"] and not first[1]["file_hit_5"] and len(first) == 2
    assert benchmark.report(metrics, save=base)["overall"]["queries"] == 2
    again = benchmark.report(metrics, compare=base)
    assert {r["mrr_delta"] for r in again["delta"]} == {0.0} and "delta" not in benchmark.report(metrics, compare=base + ".none")


def test_watchers(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    registry = tmp_path / "registry.json"
    registry.write_text(json.dumps({"p": tree}))
    watch(store, None, str(tmp_path / "check"), every="1 second", registry=str(registry))
    each = watch_each(store, {"a/b": f"{tree}/src"}, str(tmp_path / "checks"), every="1 second", stagger=0.1, initial_sync=False)
    try:
        assert {r["symbol_name"] for r in store.read("chunks").collect()} >= {"alpha", "beta"}  # the first sync
        assert {w["name"] for w in watchers(spark)} == {"tessera_watch", "tessera_watch:a/b"} and set(each) == {"a/b"}
        registry.write_text(json.dumps({"p": tree, "q": f"{tmp_path}/two"}))  # a project comes while the stream runs
        write(f"{tmp_path}/two/x.py", CODE.format(name="delta"))
        deadline = time.time() + 90
        while time.time() < deadline and "delta" not in {r["symbol_name"] for r in store.read("chunks").collect()}:
            time.sleep(0.5)
        assert "delta" in {r["symbol_name"] for r in store.read("chunks").collect()}
        assert stop(spark, "a/b") == ["tessera_watch:a/b"] and len(watchers(spark)) == 1
    finally:
        assert stop(spark) == ["tessera_watch"] and watchers(spark) == []


def test_counters(spark):
    schema = "query_id int, chunk_id int, filepath string, chunk_type string, start_line int, end_line int, chunk_text string, similarity double, token_count long"
    rows = [
        (0, 1, "/a.py", "file", 1, 90, "alpha beta", 0.9, 100), (0, 2, "/a.py", "function", 100, 110, "alpha beta gamma delta", 0.8, 100),
        (0, 3, "/b.py", "function", 1, 9, "alpha beta epsilon", 0.7, 100), (0, 4, "/tests/c.py", "function", 1, 9, "alpha beta zeta eta", 0.7, 100), (0, 5, "/d.py", "function", 1, 9, "nothing", 0.7, 100),
        (1, 6, "/a.py", "function", 1, 9, "alpha", 0.5, 99999),
    ]
    cands = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "alpha"), (2, "none")], "query_id int, query string")
    steps = plan.stages(cands, queries)
    got = {r["query_id"]: r.asDict() for r in plan.counters(queries, steps).collect()}
    assert (got[0]["outcome"], got[0]["returned_results"], got[0]["cut_count"], got[0]["per_file_file_replaced"], got[0]["per_file_symbol_capped"], got[0]["used_tokens"]) == ("ok", 2, 1, 1, 0, 300)
    assert got[0]["tests_and_files_dropped"] == 1 and got[0]["top_score"] == 1.0 and not got[0]["fallback_used"]
    assert (got[1]["outcome"], got[1]["reason"]) == ("empty_after_budget", "first_chunk_exceeded_budget")
    assert (got[2]["outcome"], got[2]["reason"], got[2]["candidates"]) == ("no_candidates", None, 0)
    assert plan.resolve_budget(None) == 8000 and plan.resolve_budget(10) == 256 and plan.resolve_budget(9000) == 8000


def test_outcomes(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "query_id int")
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "query_id int")
    got = {r["query_id"]: r["outcome"] for r in plan.outcome(q, some(1, 2, 3), some(2, 3), some(3)).collect()}
    assert got == {0: "no_candidates", 1: "below_similarity_threshold", 2: "empty_after_budget", 3: "ok"}


def epub(path, title, chapters):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
        z.writestr("OPS/p.opf", f'<package xmlns:dc="urn:dc"><metadata><dc:title>{title}</dc:title></metadata><manifest>{items}</manifest></package>')
        for i, c in enumerate(chapters):
            z.writestr(f"OPS/c{i}.xhtml", c)


def test_books(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    epub(folder / "one.epub", "AI Engineering in Practice", ["<h1>Start</h1><p>" + "One two three. " * 80 + "</p>", "<p></p>", "<p>End of it.</p>"])
    (folder / "broken.epub").write_bytes(b"no zip")
    store = Store(spark, str(tmp_path / "store"))
    got = index_books(store, str(folder))
    assert got["books"] == 1 and got["errors"] == 1 and got["passages"] >= 2
    book = store.read("books").first()
    assert (book["book_id"], book["author"], book["chapter_count"]) == ("ai-engineering", "Unknown", 2)
    rows = store.read("passages").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and rows[0]["chapter_title"] == "Start" and rows[-1]["chapter_title"] == "Section 3"
    assert index_books(store, str(folder))["books"] == 0 and index_books(store, str(folder), force=True)["books"] == 1
    service = plan.Service(store)
    assert service.list_books().first()["chunk_count"] == len(rows)
    assert service.search_literature("one two three", top_k=1).count() == 1 and service.search_literature("end of it", 0).count() <= 8


def test_upsert_keeps_owner(spark):
    cols = "filepath string, file_hash string, language string, loc int, project_id string"
    cur = spark.createDataFrame([("a", "1", "py", 1, "p"), ("b", "1", "py", 1, "p")], cols)
    inc = spark.createDataFrame([("a", "2", "ts", 9, "q"), ("c", "3", "go", 2, "q")], cols)
    assert sorted(map(tuple, merge.upsert_files(cur, inc).collect())) == [("a", "2", "py", 9, "p"), ("b", "1", "py", 1, "p"), ("c", "3", "go", 2, "q")]


def test_stream(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    checkpoint = str(tmp_path / "check")

    def run():
        q = watch(store, {"p": tree}, checkpoint, every="1 second", initial_sync=False)
        try:
            deadline = time.time() + 60
            while time.time() < deadline and not done():
                time.sleep(0.5)
                assert q.exception() is None, q.exception()
        finally:
            q.stop()

    names = lambda: {r["symbol_name"] for r in store.read("chunks").collect()}
    done = lambda: names() >= {"alpha", "beta"}
    run()
    assert done()
    write(f"{tree}/src/a.py", CODE.format(name="gamma"))
    os.unlink(f"{tree}/src/b.py")
    done = lambda: "gamma" in names() and not names() & {"alpha", "beta"}
    run()  # from the checkpoint
    assert done()
