"""Windows and folds against short restatements of their rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import controls, folds, references

SCHEMA = "query_id int, pos int, filepath string, chunk_type string, start_line int, end_line int, chunk_text string, score double, token_count long"
ROW = st.tuples(
    st.sampled_from(["/a/x.py", "/a/y.py", "/a/tests/t.py", "/b/z.spec.ts"]),
    st.sampled_from(["file", "function", "method"]),
    st.integers(1, 40),
    st.integers(0, 15),
    st.sampled_from(["alpha beta gamma", "alpha beta gamma ", "ALPHA beta", "delta", "", "x y z w v u t"]),
    st.integers(0, 20).map(lambda x: x / 20),
    st.integers(1, 3000),
)
LISTS = st.lists(st.lists(ROW, max_size=25), min_size=1, max_size=4)


def frame(spark, lists):
    rows = [(q, p, f, k, s, s + n, t, sc, tok) for q, rows in enumerate(lists) for p, (f, k, s, n, t, sc, tok) in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA)


def keep(df):
    return sorted((r["query_id"], r["pos"]) for r in df.select("query_id", "pos").collect())


def by_rule(lists, rule):
    return sorted((q, p) for q, rows in enumerate(lists) for p in rule(list(enumerate(rows))))


common = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@common
@given(LISTS)
def test_caps_and_threshold(spark, lists):
    df = frame(spark, lists)

    def file_cap(rows, n=2):
        left, out = n, []
        for p, r in rows:
            if r[1] == "file":
                left -= 1
                if left < 0:
                    continue
            out.append(p)
        return out

    def threshold(rows):
        if not rows:
            return []
        limit = max(0.4, 0.75 * max(r[5] for _, r in rows))
        passed = [p for p, r in rows if r[5] >= limit]
        return passed or [p for p, _ in sorted(rows, key=lambda x: (-x[1][5], x[0]))[:3]]

    def per_file(rows, n=2):
        if len({r[0] for _, r in rows}) <= 1:
            return [p for p, _ in rows]
        symbols = {r[0] for _, r in rows if r[1] != "file"}
        seen, out = {}, []
        for p, r in rows:
            if r[1] == "file" and r[0] in symbols:
                continue
            seen[r[0]] = seen.get(r[0], 0) + 1
            if seen[r[0]] <= n:
                out.append(p)
        return out

    def tests(rows, n=2):
        is_test = lambda f: "/tests/" in f or ".spec." in f
        out = file_cap([(p, r) for p, r in rows if not is_test(r[0])], n)
        return out or file_cap(rows, n)

    assert keep(controls.file_chunk_cap(df, 2)) == by_rule(lists, file_cap)
    assert keep(controls.relative_threshold(df)) == by_rule(lists, threshold)
    assert keep(controls.per_file_controls(df, 2)) == by_rule(lists, per_file)
    assert keep(controls.test_filter(df)) == by_rule(lists, tests)
    assert keep(controls.test_filter(df, cap=0)) == by_rule(lists, lambda r: tests(r, 0))
    assert keep(controls.test_filter(df, include_tests=True)) == by_rule(lists, file_cap)


@common
@given(LISTS, st.integers(100, 9000))
def test_budget(spark, lists, budget):
    def rule(rows):
        total, out, files = 0, [], {}
        several = len({r[0] for _, r in rows}) > 1
        for p, r in rows:
            cost = r[6] + 50
            if len(out) >= 8 or total + cost > budget:
                break
            if several:
                if files.get(r[0], 0) + cost > int(budget * 0.45):
                    continue
                files[r[0]] = files.get(r[0], 0) + cost
            total += cost
            out.append(p)
        return out

    assert keep(folds.token_budget(frame(spark, lists), budget)) == by_rule(lists, rule)


@common
@given(LISTS)
def test_dedup(spark, lists):
    def similar(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a and b else 0.0

    def rule(rows):
        slots, ranges, texts = [], [], set()
        for p, (path, _, start, n, text, score, _) in rows:
            end, hit = start + n, None
            for k, (f, s, e, sc, _) in enumerate(ranges):
                shared = max(0, min(end, e) - max(start, s) + 1)
                if f == path and max(shared / (n + 1), shared / (e - s + 1)) >= 0.25:
                    hit = (k, sc)
                    break
            if hit and score <= hit[1]:
                continue
            if hit:
                slot = ranges.pop(hit[0])[4]
                texts.discard(slots[slot][1])
                slots[slot] = None
            body = text.strip().lower()
            if any(similar(body, t) > 0.85 for t in texts):
                continue
            ranges.append((path, start, end, score, len(slots)))
            slots.append((p, body))
            texts.add(body)
        return [s[0] for s in slots if s]

    df = frame(spark, lists)
    once = folds.deduplicate(df)
    assert keep(once) == by_rule(lists, rule)


def test_fallback_and_no_cap(spark):
    df = frame(spark, [[("/a", "file", 1, 5, "t", s, 10) for s in (0.1, 0.3, 0.2, 0.05)]])
    assert keep(controls.relative_threshold(df)) == [(0, 0), (0, 1), (0, 2)]
    assert len(keep(controls.file_chunk_cap(df, None))) == 4 and keep(controls.file_chunk_cap(df, -1)) == []


def test_cross_file_joins_bounded_declarations(spark):
    """Every declaration of a name was joined with every query that asks for it."""
    import random

    r = random.Random(1)
    chunks = [(i, f"/p/f{r.randrange(60)}.py", "declaration", f"S{r.randrange(3)}", r.randrange(20, 2000)) for i in range(900)]
    results = [(q, f"/p/f{r.randrange(12)}.py", None, 100, ["S0", "S1"]) for q in range(20) for _ in range(3)]
    c = spark.createDataFrame(chunks, "chunk_id long, filepath string, chunk_type string, symbol_name string, token_count long")
    f = spark.createDataFrame([(f"/p/f{i}.py", "p") for i in range(60)], "filepath string, project_id string")
    res = spark.createDataFrame(results, "query_id long, filepath string, symbol_name string, token_count long, refs array<string>")
    want = set()
    for q in range(20):
        shown, room = {x[1] for x in results if x[0] == q}, 8000 - 450
        for x in sorted((x for x in chunks if x[3] in ("S0", "S1") and x[1] not in shown), key=lambda x: (x[4], x[0]))[:3]:
            room -= x[4] + 50
            if room < 0:
                break
            want.add((q, x[0]))
    for most in (3, None):
        out = references.cross_file(res, c, f, "p", max_results=most)
        assert {(x["query_id"], x["chunk_id"]) for x in out.collect()} == want
    assert "WindowGroupLimit [symbol_name" in out._jdf.queryExecution().executedPlan().toString()
