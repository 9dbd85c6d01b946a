import threading
import time

from pyspark.sql import functions as F

from tessera.config import IGNORED_NAMES, BUILTIN_TYPES, Settings
from tessera.functions import columns as fn
from tessera.functions.embedding import HashEmbedder, RemoteEmbedder, call_with_retry, embed, remote_reranker, rerank_prompt, token_batches
from tessera.operators.filters import filter_chunks, languages_of, resolve_directory
from tessera.plans.search import resolve_intent_name
from tessera.sources.epub import html_text


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_constants():
    assert len(IGNORED_NAMES) == 62 or len(IGNORED_NAMES) == 63 or len(IGNORED_NAMES) == 64
    assert "node_modules" in IGNORED_NAMES and "Promise" in BUILTIN_TYPES
    s = Settings.from_env({"RETRIEVAL_K": "7", "AST_SPLIT_ENABLED": "no", "DOCS_LANGUAGES": "markdown, html"})
    assert (s.retrieval_k, s.ast_split_enabled, s.docs_languages) == (7, False, ("markdown", "html"))


def test_paths(spark):
    cases = [("/a/tests/x.py", True), ("src/__tests__/a.ts", True), ("a.test.ts", True), ("a\\test\\b.py", True), ("test_a.py", False), ("a_test.go", False), ("/latest/x.py", False)]
    assert values(spark, [(p,) for p, _ in cases], "p string", fn.is_test_file("p")) == [(v,) for _, v in cases]
    ignored = [("/r/user.mapper.ts", True), ("/r/node_modules/x.ts", True), ("/r/my_node_modules/x.ts", False), ("/r/a.ts", False)]
    assert values(spark, [(p,) for p, _ in ignored], "p string", fn.ignored("p")) == [(v,) for _, v in ignored]


def test_symbols(spark):
    sig = "def f(a: Foo, b: Dict[str, BarBaz], C: X) -> Optional[Foo]"
    assert values(spark, [(sig,)], "s string", fn.type_refs("s")) == [(["BarBaz", "Foo"],)]
    imports = ["import { Foo, Bar as B, type Qux } from './x'", "from a.b import C, D as E  # note", "from z import *", "from m import (A, B)", "import type { T } from 't'", "import os"]
    assert values(spark, [(imports,)], "i array<string>", fn.imported_symbols("i")) == [(sorted(["Foo", "Bar", "type Qux", "C", "D", "(A", "B)", "T"]),)]
    stated = ["import os", "from a.b import c", 'import "x/y"', 'import { foo } from "drizzle-orm"', "import os", "from 'q.r'"]
    assert values(spark, [(stated,)], "i array<string>", fn.module_names("i")) == [(["os", "a", "x/y", "q"],)]


def test_scalars(spark):
    assert values(spark, [("",), ("a\n",), ("a\nb",)], "s string", fn.line_count("s")) == [(1,), (2,), (2,)]
    assert values(spark, [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>", F.round(fn.cosine("a", "b"), 9)) == [(0.0,), (1.0,), (0.0,)]
    assert values(spark, [(None,), (10,), (9000,), (3000,)], "r int", fn.token_budget("r", 8000)) == [(8000,), (256,), (8000,), (3000,)]
    assert values(spark, [(10,), (500,), (0,)], "r int", fn.token_budget("r", 200)) == [(10,), (200,), (1,)]
    assert values(spark, [("  The C++ Book: 2nd_Edition! ",)], "t string", fn.slug("t")) == [("the-c-book-2nd-edition",)]
    assert values(spark, [("unit  test for x",), ("contest",), ("the mock",)], "q string", fn.mentions_tests("q")) == [(True,), (False,), (True,)]
    assert values(spark, [("",), (" PERF ",), (None,), ("x",)], "i string", fn.resolve_intent("i")) == [("implementation",), ("performance",), ("implementation",), ("implementation",)]
    assert [resolve_intent_name(x) for x in (None, "arch", " Debug")] == ["implementation", "architecture", "debug"]


def test_filters(spark):
    df = spark.createDataFrame([("/r/src/app/a.py", "python", "p"), ("/r/src/app2/b.py", "python", "p"), ("/r/lib/c.md", "markdown", "q")], "filepath string, language string, project_id string")
    assert filter_chunks(df, directory="/r/src/app").count() == 2  # a prefix, not a folder
    assert filter_chunks(df, languages=languages_of("docs")).count() == 1 and languages_of("all") is None
    assert filter_chunks(df, project="p", language="python", filepath="/r/src/app/a.py").count() == 1
    assert resolve_directory("/src/app/", "p", "/r/") == "/r/src/app" and resolve_directory("x", None, "/r") is None and resolve_directory("x", "p", None) is None


def test_embedding(spark):
    e = HashEmbedder(16)
    assert abs(sum(x * x for x in e.embed_query("some words here")) - 1) < 1e-5 and not any(e.embed_query(""))
    rows = embed(spark.createDataFrame([("a b",), (None,), ("a b",)], "t string"), e, "t").collect()
    assert rows[0]["embedding"] == rows[2]["embedding"] and rows[1]["embedding"] is None
    assert [b for b in token_batches(["a", "bbbb", "c", "d"], len, 3)] == [["a"], ["bbbb"], ["c", "d"]]
    prompt = rerank_prompt("find the parser", "usage")
    assert prompt.endswith("Query: find the parser") and prompt.count("\n- ") == 5
    assert rerank_prompt("unit test of x", "implementation").count("\n- ") == 3


def test_retry():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("rate limit")
        return "done"

    assert call_with_retry(call, sleep=waits.append) == "done" and len(waits) == 2 and 0.25 <= waits[0] <= 0.5
    try:
        call_with_retry(lambda: 1 / 0, sleep=waits.append)
    except ZeroDivisionError:
        pass
    else:
        raise AssertionError


def test_html():
    assert html_text("<nav>x</nav><h1>T</h1><script>var a</script><p>a <b>b</b></p><style>q</style>") == "T\na\nb"
    assert html_text(None) is None and html_text("") == ""


def test_html_references():
    """Only those that a semicolon ends, as in the SQL of html_to_text."""
    assert html_text("<h1>a &amp b&amp</h1><p>&ampc; &&amp;&copy &copy;&amp;quot; &#38; &#38 &x;</p>") == "a &amp b&amp\n&ampc; &&&copy ©&quot; & &#38 &x;"


def test_remote_embedder():
    """Order, concurrency, pacing and retries of a client whose clock is ours."""
    now, running, most, failed, begun = [0.0], [0], [0], set(), []
    lock = threading.Lock()

    def sleep(seconds):
        with lock:
            now[0] += seconds

    def call(texts, kind):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            begun.append(now[0])
            fresh = texts[0] not in failed
            failed.add(texts[0])
        time.sleep(0.002)
        with lock:
            running[0] -= 1
        if fresh and texts[0].endswith("7"):
            raise RuntimeError("503 overloaded")
        return [[float(t.split()[-1]), 1.0] for t in texts]

    e = RemoteEmbedder(call, dim=2, in_flight=4, per_minute=20, batch_tokens=2, clock=lambda: now[0], sleep=sleep)
    out = e.embed_documents([f"text {i}" for i in range(50)])
    assert out[:, 0].tolist() == [float(i) for i in range(50)] and most[0] <= 4
    assert len(begun) == 55 and max(sum(a <= b < a + 60 for b in begun) for a in begun) <= 20
    assert e.embed_query("text 3") == [3.0, 1.0] and e.embed_documents([]).shape == (0, 2)


def test_remote_reranker(spark):
    asked = spark.createDataFrame([(0, "how does it work", "abc"), (0, "how does it work", "a"), (1, "other", "abcd"), (1, "other", None)], "query_id int, query string, chunk_text string")

    def call(instruction, texts):
        assert "Query: " in instruction and "Ranking rules" in instruction
        return [len(t) / 10 for t in texts]

    rows = remote_reranker(call, "debug")(asked).collect()
    assert sorted((r["query_id"], r["score"]) for r in rows) == [(0, 0.1), (0, 0.3), (1, 0.0), (1, 0.4)]
