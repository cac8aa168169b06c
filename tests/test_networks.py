"""Networks, their gradients, and training over shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from protelith.functions import networks
from protelith.plans import trainer

R = np.random.default_rng(1)
SEQUENCES = networks.Batch(np.where(np.arange(6)[None, :, None] < np.array([6, 3, 1, 5])[:, None, None], R.normal(size=(4, 6, 3)), 0.0), np.array([6, 3, 1, 5]), np.arange(4, dtype=np.uint64))
VECTORS = networks.Batch(R.normal(size=(4, 3)), None, np.arange(4, dtype=np.uint64))


@pytest.mark.parametrize("network,batch", [
    (networks.feed_forward(3, 4, (5, 4), 0.3), VECTORS), (networks.feed_forward(3, 4, ()), VECTORS), (networks.convolutional(3, 4, 5, dropout=0.2), SEQUENCES), (networks.light_attention(3, 4, 6), SEQUENCES)])
@pytest.mark.parametrize("classes", [True, False])
def test_gradients_equal_differences(network, batch, classes):
    shape = (4, 6) if network.per_position else (4,)
    y = R.integers(0, 4, shape).astype(float)
    y[1] = np.nan
    loss = networks.cross_entropy(y, np.array([1.0, 2.0, 0.5, 1.5])) if classes else networks.squared_error(y)
    flat = network.initial(3) + R.normal(0, 0.1, network.size)
    value, g = network.gradient(flat, batch, loss)
    for k in R.choice(network.size, min(40, network.size), replace=False):
        up, down = flat.copy(), flat.copy()
        up[k], down[k] = up[k] + 1e-6, down[k] - 1e-6
        both = [loss(network.forward(network.views(v), network.views(np.zeros(network.size)), batch)[0])[0] for v in (up, down)]
        assert abs((both[0] - both[1]) / 2e-6 - g[k]) < 1e-5 * max(1, abs(g[k]))


def test_padding_changes_nothing():
    for network in (networks.convolutional(3, 2), networks.light_attention(3, 2)):
        flat = network.initial(0)
        wide = networks.Batch(np.pad(SEQUENCES.x, ((0, 0), (0, 7), (0, 0))), SEQUENCES.sizes, SEQUENCES.seeds)
        a, b = network.outputs(flat, SEQUENCES), network.outputs(flat, wide)
        assert np.allclose(a, b[:, :6] if network.per_position else b)


def test_dropout_depends_on_row_and_pass_only():
    u = networks.uniforms(np.array([5, 9, 5], np.uint64), 4000, 1)
    assert np.array_equal(u[0], u[2]) and not np.array_equal(u[0], u[1]) and abs(u.mean() - 0.5) < 0.02 and not np.array_equal(u, networks.uniforms(np.array([5, 9, 5], np.uint64), 4000, 2))
    assert np.array_equal(networks.uniforms(np.array([9], np.uint64), 10, 1)[0], u[1, :10])


def test_steps_follow_their_definitions():
    p, grads = R.normal(size=5), R.normal(size=(6, 5))
    state = np.vstack([p[None], np.zeros((3, 5))])
    want, m, v, top = p.copy(), np.zeros(5), np.zeros(5), np.zeros(5)
    for t, g in enumerate(grads, 1):
        networks.step("adam", state, g, t, 0.01)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        top = np.maximum(top, v)
        want = want * (1 - 0.01 * 0.01) - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(top / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(state[0], want)
    state, want, speed = np.vstack([p[None], np.zeros((1, 5))]), p.copy(), np.zeros(5)
    for t, g in enumerate(grads, 1):
        networks.step("sgd", state, g, t, 0.01)
        speed = 0.9 * speed + g
        want = want - 0.01 * speed
    assert np.allclose(state[0], want)


@pytest.mark.parametrize("kind", ["default", "normal", "xavier", "kaiming"])
def test_initial_weights(kind):
    network = networks.light_attention(6, 2)
    v = network.views(network.initial(1, kind))
    assert np.all(v["norm.w"] == 1) and np.all(v["norm.b"] == 0) and np.array_equal(network.initial(1, kind), network.initial(1, kind))
    assert (kind == "default") == bool(np.any(v["dense.b"])) and np.std(v["feature.w"]) > 0


def table(spark, n=300, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + np.sin(2 * x[:, 0])
    return spark.createDataFrame([(f"k{i}", x[i].tolist(), [float(y[i])], [(2 if i % 5 == 0 else 1), (2 if i % 5 == 1 else 1)]) for i in range(n)],
                                 "seq_hash string, features array<double>, _y array<double>, _uses array<int>"), x, y


def fits(**o):
    net = networks.feed_forward(4, 1, (16,), 0.1)
    return [trainer.Fit("a", net, learning_rate=0.02, batch_size=16, epochs=6, **o), trainer.Fit("b", net, learning_rate=0.005, batch_size=32, epochs=9, seed=7, optimizer="sgd", **o)]


def test_one_shard_is_plain_minibatch_training(spark):
    """The same steps in a loop of our own, in the order that the shard has."""
    df, x, y = table(spark)
    fit = fits()[0]
    got = trainer.train(df, [fit])[0]
    rows = {r.seq_hash: r for r in df.withColumn("_seed", F.xxhash64("seq_hash")).collect()}
    p = fit.network.initial(fit.seed)
    state, t = np.vstack([p[None], np.zeros((3, len(p)))]), 0
    for epoch in range(fit.epochs):
        order = [r.seq_hash for r in df.withColumn("_seed", F.xxhash64("seq_hash")).orderBy(F.xxhash64(F.lit(epoch), "_seed"), "seq_hash").collect()]
        keys = [k for k in order if rows[k]._uses[0] == 1]
        check = [rows[k] for k in order if rows[k]._uses[0] == 2]
        out = fit.network.outputs(state[0], networks.Batch(np.array([r.features for r in check])))
        assert abs(np.mean((out[:, 0] - [r._y[0] for r in check])**2) - got.seen[epoch][2]) < 1e-9
        for at in range(0, len(keys), fit.batch_size):
            own = [rows[k] for k in keys[at:at + fit.batch_size]]
            seeds = np.array([r._seed for r in own], np.int64).view(np.uint64) + np.uint64((fit.seed * 1_000_003 + epoch) % (1 << 32))
            _, g = fit.network.gradient(state[0], networks.Batch(np.array([r.features for r in own]), None, seeds), networks.squared_error(np.array([r._y[0] for r in own])))
            t += 1
            networks.step("adam", state, g, t, fit.learning_rate)
    assert np.allclose(got.now, state, atol=1e-9) and got.steps == t


def test_many_fits_in_one_scan_equal_the_loop(spark):
    df, _, _ = table(spark)
    both = trainer.train(df, fits(), shard_rows=90)
    alone = [trainer.train(df.withColumn("_uses", F.array(F.col("_uses")[i])), [f], shard_rows=90)[0] for i, f in enumerate(fits())]
    for a, b in zip(both, alone):
        assert np.allclose(a.now, b.now, atol=1e-12) and np.allclose(a.seen, b.seen) and a.best_epoch == b.best_epoch


def test_shards_learn_and_partitioning_changes_nothing(spark):
    df, x, y = table(spark, 600)
    fit = trainer.Fit("a", networks.feed_forward(4, 1, (32,), 0.0), learning_rate=0.01, batch_size=16, epochs=40, patience=40)
    got = trainer.train(df, [fit], shard_rows=150)[0]
    assert got.best_loss < 0.25 * np.var(y) and got.best_epoch > 10
    again = trainer.train(df.repartition(7), [fit], shard_rows=150)[0]
    assert np.allclose(got.now, again.now, atol=1e-12)


def test_stops_early_and_resumes(spark):
    df, _, _ = table(spark)
    fit = trainer.Fit("a", networks.feed_forward(4, 1, (8,), 0.0), learning_rate=1e-9, batch_size=16, epochs=50, patience=2)
    got = trainer.train(df, [fit])[0]
    assert got.stopped and got.best_epoch == 0 and got.epoch == 4  # the first, and three without gain
    full, kept = trainer.train(df, fits()), {}
    with pytest.raises(RuntimeError):
        def commit(epoch, states):
            kept["states"] = states
            if epoch == 2:
                raise RuntimeError("lost")
        trainer.train(df, fits(), commit=commit)
    assert [s.epoch for s in kept["states"]] == [3, 3]
    for a, b in zip(full, trainer.train(df, fits(), states=kept["states"])):
        assert np.allclose(a.now, b.now, atol=1e-12) and a.best_epoch == b.best_epoch and len(a.seen) == len(b.seen)


def test_rows_without_features_or_label(spark):
    df, _, _ = table(spark, 40)
    odd = spark.createDataFrame([("none", None, [1.0], [1, 1]), ("empty", [], [1.0], [1, 1]), ("unlabelled", [1.0] * 4, [None], [1, 1])], df.schema)
    a, b = trainer.train(df, fits()), trainer.train(df.unionByName(odd), fits())
    assert all(np.isfinite(s.now).all() for s in (*a, *b))
    out = trainer.outputs(odd, fits()[0].network, a[0].best, False)
    assert {r.seq_hash: r.outputs is None for r in out.collect()} == {"none": True, "empty": True, "unlabelled": False}
    with pytest.raises(ValueError, match="no row to train on"):
        trainer.train(df.withColumn("_uses", F.array(F.lit(2), F.lit(2))), fits())


def test_forward_passes(spark):
    df, x, _ = table(spark, 50)
    network = networks.feed_forward(4, 3, (16,), 0.5)
    p = network.initial(2)
    got = {r.seq_hash: r for r in trainer.outputs(df, network, p, True, passes=8).select("seq_hash", "outputs", trainer.summaries(F.col("outputs"), True).alias("s")).collect()}
    again = {r.seq_hash: r.outputs for r in trainer.outputs(df.repartition(5), network, p, True, passes=8).collect()}
    for k, r in got.items():
        q = np.array(r.outputs)
        assert q.shape == (8, 3) and np.allclose(q.sum(1), 1) and np.allclose(q, again[k]) and len(np.unique(q[:, 0])) > 1
        assert np.allclose(r.s.mean, q.mean(0)) and np.allclose(r.s.std, q.std(0, ddof=1))
        assert np.allclose([r.s.lower, r.s.upper], np.quantile(q, [0.025, 0.975], axis=0))
        h = lambda v: -(v * np.log(v + 1e-10)).sum(-1)
        assert abs(r.s.bald - (h(q.mean(0)) - h(q).mean())) < 1e-9
    plain = np.array([r.outputs for r in trainer.outputs(df, network, p, True).orderBy(F.substring("seq_hash", 2, 9).cast("int")).collect()])
    assert np.allclose(plain, networks.softmax(network.outputs(p, networks.Batch(x))))
    with pytest.raises(ValueError, match="dropout"):
        trainer.outputs(df, networks.feed_forward(4, 3, ()), p, True, passes=2)
