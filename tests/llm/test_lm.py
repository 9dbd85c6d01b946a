import numpy as np
import pytest

from tessera.llm import lm

from .conftest import AWKWARD


def lexicon(texts, block=lm.BLOCK):
    """What `lm.lexicon` makes, by plain counting."""
    codes, counts = lm.tokenize(texts)
    found, n = np.unique(codes, return_counts=True)
    width = lm.branches(len(codes))
    order = np.lexsort((found, -n))
    top, rest = order[: lm.vocabulary(width)], order[lm.vocabulary(width) :]
    leaf = lm.leaf(found[rest], width)
    distinct, rare = np.bincount(leaf, minlength=width**3), np.bincount(leaf, n[rest], minlength=width**3).astype(np.int64)
    words, times = np.append(found + 1, 0), np.append(n, np.count_nonzero(counts))
    hot = np.flatnonzero(times > block)
    hot = hot[np.argsort(words[hot])]
    return lm.Lexicon(width, *lm.tree(width, found[top], n[top], distinct, rare), -(-len(codes) // block), words[hot], -(-times[hot] // block))


def block_of(texts, lex):
    codes, counts = lm.tokenize(texts)
    return lm.Block(lex, *lm.before(codes, counts), lex.numbers(codes)), codes, counts


def trained(block, epochs=2):
    """Log probability of each position, and the weights of each level."""
    out, weights = np.zeros(block.n), []
    rare = block.number >= block.lex.vocabulary
    out[rare] = block.lex.inner[block.number[rare] - block.lex.vocabulary]
    for where, level in block.levels():
        level.train(epochs)
        out[where] += level.logprobs(np.arange(level.n))
        weights.append(level.weights)
    return out[np.argsort(block.order)], weights


def brute(block, weights, codes, counts):
    """Word by word, with dense softmaxes down the tree."""
    lex, out, start = block.lex, [], 0
    w = lex.width
    for n in counts:
        doc = codes[start : start + n]
        start += n
        for t in range(n):
            b, a = (np.uint64(doc[t - k] + 1 if t >= k else 0) for k in (1, 2))
            number = int(lex.numbers(doc[t : t + 1])[0])
            leaf = number - lex.vocabulary if number >= lex.vocabulary else None
            kind = number if leaf is None else lex.vocabulary + leaf // w
            path = [(0, kind // w**2), (kind // w**2, kind // w % w), (kind // w, kind % w)] + ([] if leaf is None else [(leaf // w, leaf % w)])
            total = 0.0 if leaf is None else lex.inner[leaf]
            for level, (node, branch) in enumerate(path):
                z = lex.prior[level][node].astype(float)
                with np.errstate(over="ignore"):
                    for c in (lm.split_mix(b, 1), lm.split_mix(lm.split_mix(b, 2) + a, 2), lm.split_mix(a, 3)):
                        z = z + weights[level][int(lm.split_mix(c + np.uint64(node << 36), 5 + level) & np.uint64(block.rows - 1))]
                total += z[branch] - np.log(np.exp(z).sum())
            out.append(total)
    return np.array(out)


def corpus(n, seed, words=60):
    rng = np.random.default_rng(seed)
    nxt = np.random.default_rng(0).integers(0, 50, (50, 3))
    out = []
    for _ in range(n):
        w, text = 0, []
        for _ in range(words):
            text.append(f"w{w}" if rng.random() < 0.9 else f"rare{rng.integers(0, 3000)}")
            w = int(nxt[w, rng.integers(0, 3)])
        out.append(" ".join(text))
    return out


def test_scores_against_brute_force():
    texts = corpus(40, 1) + ["", None, "one", "never seen words at all", "W1, w2. W3!"]
    block, codes, counts = block_of(texts, lexicon(texts))
    got, weights = trained(block)
    assert len(weights) == 4
    assert np.allclose(got, brute(block, weights, codes, counts), atol=1e-4) and np.allclose(got, block.logprobs(2))


def test_the_whole_query_against_brute_force(spark, make):
    """Blocks, training and sums, in one process, document by document."""
    texts = corpus(70, 3) + corpus(3, 3) + ["", None]
    size = 60
    lex = lexicon(texts, size)
    assert lex.blocks > 4 and len(lex.hot)
    codes, counts = lm.tokenize(texts)
    b, a = lm.before(codes, counts)
    place = lex.block(b, a, np.repeat(lm.contents(codes, counts), counts))
    doc = np.repeat(np.arange(len(texts)), counts)
    want = np.zeros(len(texts))
    for k in np.unique(place):
        mine = np.flatnonzero(place == k)
        block = lm.Block(lex, b[mine], a[mine], lex.numbers(codes[mine]))
        want += np.bincount(doc[mine], block.logprobs(), minlength=len(texts))
    for parts in (1, 5):  # whatever the partitioning
        got = {r["doc_id"]: r for r in lm.score(make(texts).repartition(parts), block=size).collect()}
        assert all(abs(got[i]["logprob"] - want[i]) < 1e-3 for i in range(73))
        assert all(abs(got[i]["perplexity"] - np.exp(-want[i] / counts[i])) < 1e-3 * np.exp(-want[i] / counts[i]) for i in range(73))
        assert got[73]["logprob"] is None and got[74]["logprob"] is None


def test_partitioning_does_not_matter(make):
    docs = make(corpus(60, 5) + corpus(8, 6) * 2)
    one, many = ({tuple(r) for r in lm.score(docs.repartition(n), block=500).collect()} for n in (1, 7))
    assert one == many


def test_probabilities_sum_to_one():
    texts = corpus(60, 1)
    lex = lexicon(texts)
    block, _, _ = block_of(texts, lex)
    _, weights = trained(block)
    words = np.unique(lm.tokenize(texts)[0])
    # each word of the corpus after the same two words
    after = lm.Block(lex, np.full(len(words), 6), np.full(len(words), 7), lex.numbers(words))
    rare = after.number >= lex.vocabulary
    logprob = np.zeros(len(words))
    logprob[rare] = lex.inner[after.number[rare] - lex.vocabulary]
    after.rows = block.rows
    for (where, level), w in zip(after.levels(), weights):
        level.weights = w
        logprob[where] += level.logprobs(np.arange(level.n))
    total = np.exp(logprob).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_learning_helps():
    texts = corpus(300, 1)
    block, codes, _ = block_of(texts, lexicon(texts))
    before = -block.logprobs(0).mean()  # frequency alone
    assert -block.logprobs().mean() < before - 1.0


def test_documents_that_occur_twice_score_apart(make):
    rng = np.random.default_rng(2)
    single = [" ".join(f"t{x}" for x in rng.zipf(1.3, 150) % 5000) for _ in range(300)]
    twice = [" ".join(f"t{x}" for x in rng.zipf(1.3, 150) % 5000) for _ in range(40)]
    got = {r["doc_id"]: r["perplexity"] for r in lm.score(make(single + twice + twice), block=4000).collect()}
    low = np.quantile([got[i] for i in range(300)], 0.1)
    assert np.mean([got[i] < low for i in range(300, 380)]) > 0.9
    assert all(got[i] == got[i + 40] for i in range(300, 340))


def test_gradient_sums():
    rng = np.random.default_rng(0)
    texts = corpus(5, 1)
    block, _, _ = block_of(texts, lexicon(texts))
    width = block.lex.width
    _, level = next(block.levels())
    level.room = [np.empty((6000, width), np.float32) for _ in range(3)]
    g = rng.normal(size=(2000, width)).astype(np.float32)
    for high in (5, 300, block.rows):
        at = rng.integers(0, high, (lm.FEATURES, 2000)).astype(np.uint32)
        rows, total = level._sums(g, at)
        want = np.zeros((block.rows, width))
        for f in range(lm.FEATURES):
            np.add.at(want, at[f], g.astype(float))
        assert np.array_equal(rows, np.unique(at)) and np.allclose(total, want[rows], atol=1e-3)


def test_the_model_grows_with_the_corpus():
    assert [lm.branches(n) for n in (1, 10**6, 10**8, 10**10)] == sorted({lm.branches(n) for n in (1, 10**6, 10**8, 10**10)})
    assert lm.vocabulary(lm.branches(100_000_000)) > 15_000


def test_frequent_words_have_blocks_of_bounded_size():
    """Half of all words are the same, half of all texts too."""
    rng = np.random.default_rng(1)
    texts = [" ".join("the" if rng.random() < 0.5 else f"x{rng.integers(0, 400)}" for _ in range(100)) for _ in range(400)]
    codes, counts = lm.tokenize(texts)
    b, a = lm.before(codes, counts)
    lex = lexicon(texts, 2000)
    sizes = np.bincount(lex.block(b, a, np.repeat(lm.contents(codes, counts), counts)), minlength=lex.blocks)
    assert lex.blocks == 20 and sizes.max() < 4 * 2000


def test_blocks_travel_in_groups(spark, make):
    """As single blocks there were as many pieces as slices times blocks; the sums are the same."""
    texts = corpus(100, 5)
    lex = lexicon(texts, 50)
    given = spark.sparkContext.broadcast(lex)
    table = lm.coded(make(texts).coalesce(1), "doc_id", "text")
    assert lm.grouped(24_000, 200) == lm.GROUP and lm.grouped(2044, 51) == 10 and lm.grouped(1, 12) == 1
    one, many = ({r["row"]: r["s"] for r in lm.block_scores(lm.routed(table, given, g), given).groupBy("row").agg({"logprob": "sum"}).toDF("row", "s").collect()} for g in (1, 7))
    assert lex.blocks == 120 and lm.routed(table, given, 7).count() == 18
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)


def test_tables(spark, awkward, none, make):
    rows = lm.score(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert (r["logprob"] is None) == (r["n_words"] == 0) == (r["perplexity"] is None)
        assert r["perplexity"] is None or r["perplexity"] > 0
    assert next(r for r in rows if r["doc_id"] == 8)["n_words"] == 60_000  # whole texts
    twins = [r for r in rows if r["doc_id"] in (1, 2)]
    assert len({r["logprob"] for r in twins}) == 1 and len(twins) == 3
    assert lm.score(none).count() == 0
    assert [tuple(r)[1:] for r in lm.score(make([None, "", " "])).collect()] == [(0, None, None)] * 3
    assert lm.score(make(["one"])).first()["perplexity"] == pytest.approx(1)
    texts = corpus(60, 3) + ["zz yy xx ww vv uu tt ss rr qq"]
    scored = {r["doc_id"]: r["perplexity"] for r in lm.score(make(texts)).collect()}
    assert scored[60] > np.median(list(scored.values()))
