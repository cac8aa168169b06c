import numpy as np

from protelith.llm import quality, toxicity

from .conftest import MEDIUM


def held_out(spark, found, label):
    rows = found.where("held_out").join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").select("score", "predicted", label).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_toxicity_held_out(spark):
    assert held_out(spark, toxicity.query(spark, MEDIUM), "toxic") >= 0.92


def test_quality_held_out(spark):
    assert held_out(spark, quality.query(spark, MEDIUM), "quality") >= 0.94


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        at = toxicity.windows(n)
        covered = {i for s in at for i in range(s, min(n, s + toxicity.LENGTH))}
        assert covered == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(at, at[1:]))


def test_gradients_match_differences():
    docs = [["a b c d e", "f g h i j"], ["k l m n o"]]
    rng = np.random.default_rng(0)
    inputs = toxicity.Inputs(({w for x in d for w in x.split()} for d in docs), [True, False])
    words = sorted({w for d in docs for x in d for w in x.split()})
    rows = inputs.rows(words)
    p = {k: v + rng.normal(0, 0.1, v.shape) for k, v in toxicity.fresh(len(inputs.index) + 1).items()}
    grid, y = rng.integers(0, len(words), (3, 5)), np.array([1.0, 0.0, 1.0])

    def loss(q):
        _, gf, gb = toxicity.project(q, *rows)
        where = grid.T
        f, _ = toxicity.recur(gf[where], q["Uf"])
        b, _ = toxicity.recur(gb[where[::-1]], q["Ub"])
        s = toxicity.sigmoid(toxicity.pool(q, f, b[::-1])[0])
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = toxicity.gradients(p, rows, grid, y)
    for k in ("Wf", "Ub", "A", "v", "w", "b", "cf", "Ew"):
        at = np.unravel_index(int(np.argmax(np.abs(g[k]))), g[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in "ud")
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[k][at]) < 2e-3, k


def brute_score(model, text):
    """The network's score of a text, one window and one step at a time."""
    p, inputs = model["p"], model["inputs"]
    words = toxicity.WORD.findall((text or "").lower())
    if not words:
        return 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    vector = {}
    for w in set(words):
        code = [ord(c) for c in f"^{w}$"]
        grams = []
        for k, factor in ((3, 7), (4, 11), (5, 13)):
            for i in range(len(code) - k + 1):
                grams.append(rolling(code[i:i + k]) * factor % toxicity.GRAMS)
        g = inputs.gram_odds[0][grams]
        vector[w] = np.concatenate([p["Ew"][inputs.index.get(w, 0)], p["Ec"][grams].mean(0), [inputs.word_odds[0][inputs.index.get(w, 0)], g.mean(), g.max()]])
    best, n, h = -np.inf, len(words), toxicity.HIDDEN
    starts = [*range(0, n - toxicity.LENGTH, toxicity.STRIDE), n - toxicity.LENGTH] if n > toxicity.LENGTH else [0]
    for s in starts:
        xs = [vector[w] for w in words[s:s + toxicity.LENGTH]]
        states = {}
        for way, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            state = np.zeros(h)
            for i in order:
                a, b = xs[i] @ p[f"W{way}"] + p[f"c{way}"], state @ p[f"U{way}"]
                z, r = sig(a[:h] + b[:h]), sig(a[h:2 * h] + b[h:2 * h])
                state = (1 - z) * np.tanh(a[2 * h:] + r * b[2 * h:]) + z * state
                states[way, i] = state
        both = np.array([np.r_[states["f", i], states["b", i]] for i in range(len(xs))])
        e = np.tanh(both @ p["A"] + p["a"]) @ p["v"]
        weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        best = max(best, weight @ both @ p["w"] + p["b"][0])
    return float(sig(best - model["shift"]))


def rolling(code):
    run = code[0] * 31 + code[1]
    for c in code[2:]:
        run = (run * 31 + c) % 1_000_003
    return run


def test_network_scores_match_brute_force(spark, plain):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"), toxicity.remainder(5) != 0)
    texts = [t for _, t in plain[:60]] + [None, "", "...", "one", "x" * 3000]
    scorer = toxicity.Scorer(model)
    assert np.allclose(scorer.score(texts), [brute_score(model, t) for t in texts], atol=2e-3)


def test_quality_scores_match_brute_force(spark, plain):
    model = quality.train(spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    texts = [t for _, t in plain] + [None, "", "one"]
    got = quality.score(model, np.array([quality.features(t) for t in texts]))
    for t, s in zip(texts, got):
        x = quality.features(t)
        bin_of = lambda edges, v: sum(v >= e for e in edges)
        total = model["base"] + sum(table[bin_of(e, v)] for v, e, table in zip(x, model["edges"], model["tables"]))
        total += sum(table[bin_of(model["coarse"][i], x[i]), bin_of(model["coarse"][j], x[j])] for (i, j), table in model["pairs"].items())
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12


def test_trees_match_brute_force():
    """A shallow tree's greedy cuts and leaves, and the best cut of two axes, by trying all."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.uniform(2, 9, 9)
        edges = [0, 9]
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        for _ in range(2):
            cuts = [(gain(a, m) + gain(m, b) - gain(a, b), m) for a, b in zip(edges, edges[1:]) for m in range(a + 1, b) if h[a:m].sum() >= 4 and h[m:b].sum() >= 4]
            if cuts and max(cuts)[0] > 1e-9:
                edges = sorted([*edges, max(cuts)[1]])
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip(edges, edges[1:])])
        assert np.allclose(quality._step_tree(g, h), want)
        g2, h2 = rng.normal(size=(5, 4)), rng.uniform(2, 9, (5, 4))
        options = []
        for i in range(1, 5):
            for j in range(1, 4):
                parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
                options.append(sum(g2[p].sum() ** 2 / (h2[p].sum() + 1) for p in parts if h2[p].sum() >= 4))
        assert abs(quality._quadrants(g2, h2)[0] - max(options)) < 1e-9


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.fit(x[:2000], y[:2000])
    assert ((quality.score(model, x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (9, None, None), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.train(edge, labels)
        got = module.with_scores(edge, model, out="found").collect()
        assert len(got) == 12 and all(0 <= r.found <= 1 for r in got)
        assert module.with_scores(empty, model).count() == 0
        assert module.train(edge, labels.where("false")) == {} == module.train(empty, labels)
        assert module.with_scores(edge, {}).count() == 12
    kept = toxicity.drop_toxic(edge, labels.where("false"))
    assert kept.columns == edge.columns and kept.count() == 12 and kept.select("_score").distinct().collect() == [("_score",)]
