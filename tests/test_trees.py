"""Tree models against plain recursive growers, in one task and over all tasks."""

import heapq

import numpy as np
import pandas as pd
import pytest

from panelcast.models import trees as T


def sse(y, w):
    return float((w * (y - (w * y).sum() / w.sum()) ** 2).sum()) if w.sum() else 0.0


def cuts(x, on, spec, tree, name):
    for f in T.tree_features(spec, x.shape[1], tree):
        if spec.random:
            low, high = x[on, f].min(), x[on, f].max()
            if high > low:
                yield f, float(T.drawn_threshold(np.array([low]), np.array([high]), np.array([name], np.uint64), tree, int(f), spec)[0])
        else:
            v = np.unique(x[on, f])
            yield from ((f, a + (b - a) / 2) for a, b in zip(v, v[1:]))


def plain_split(x, y, w, spec, tree, name, depth):
    """(gain, feature, threshold) of a node, by trying every cut."""
    on = w > 0
    if depth >= spec.depth or on.sum() < spec.min_split or np.ptp(y[on]) == 0:
        return None
    best = None
    for f, t in cuts(x, on, spec, tree, name):
        left = on & (x[:, f] <= t)
        right = on & ~left
        if min(left.sum(), right.sum()) < spec.min_leaf:
            continue
        gain = sse(y[on], w[on]) - sse(y[left], w[left]) - sse(y[right], w[right])
        if best is None or gain > best[0] + 1e-9:
            best = (gain, f, t)
    return best if best and (best[0] > 1e-9 or spec.random) else None


def plain_predict(x, y, w, spec, tree):
    """Best-first growth, one split at a time; each row's value."""
    out, queue, count, k = np.zeros(len(y)), [], 1, 0

    def push(w, name, depth):
        nonlocal k
        out[w_all(w)] = (w * y).sum() / w.sum()
        s = plain_split(x, y, w, spec, tree, name, depth)
        if s:
            heapq.heappush(queue, (-s[0], k, s, w, name, depth))
            k += 1

    region = {}

    def w_all(w):
        return region[id(w)]

    root = w.copy()
    region[id(root)] = np.ones(len(y), bool)
    keep = [root]
    push(root, T.ROOT, 0)
    while queue and (not spec.max_leaves or count < spec.max_leaves):
        _, _, (_, f, t), w0, name, depth = heapq.heappop(queue)
        go = x[:, f] <= t
        for side, m in ((0, go), (1, ~go)):
            w1 = w0 * m
            keep.append(w1)
            region[id(w1)] = region[id(w0)] & m
            push(w1, T._child(np.array([name], np.uint64), side)[0], depth + 1)
        count += 1
    return out


SPECS = [
    T.Spec(depth=6, min_leaf=3, min_split=7),
    T.Spec(bootstrap=True, max_leaves=9),
    T.Spec(rows_share=0.9, features_share=0.7),
    T.Spec(random=True),
    T.Spec(random=True, depth=4, min_leaf=5),
    T.Spec(max_leaves=5, min_leaf=0.05, min_split=0.2),
]


def sample(n, seed=0, values=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(1) if values is None else rng.integers(0, values, (n, 4)).astype(float)
    return x, x[:, 0] * 2 - x[:, 1] * x[:, 2] + rng.normal(size=n), rng.integers(-(2**62), 2**62, n)


@pytest.mark.parametrize("spec", SPECS)
def test_grow_is_plain_growth(spec):
    for seed in range(4):
        x, y, rows = sample(80, seed)
        s = spec.sized(len(y))
        for tree in range(3):
            w = T.tree_weights(s, rows, tree)
            assert np.allclose(T.grow(x, y, w, s, tree).predict(x), plain_predict(x, y, w, s, tree))


def test_shares_are_exact():
    rows = np.random.default_rng(1).integers(-(2**62), 2**62, 997)
    spec = T.PRESETS["BaggingRegressor"]
    picks = [T.tree_weights(spec, rows, t) for t in range(20)]
    assert all(p.sum() == int(0.9 * 997) and set(p) <= {0.0, 1.0} for p in picks)
    assert len({p.tobytes() for p in picks}) == 20
    chosen = [tuple(T.tree_features(spec, 10, t)) for t in range(20)]
    assert all(len(set(c)) == 7 for c in chosen) and len(set(chosen)) > 5


def test_bootstrap_counts():
    w = T.tree_weights(T.Spec(bootstrap=True), np.arange(200000), 5)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005


@pytest.mark.parametrize("bins", [0, 512])
def test_boosting_is_a_loop_over_residuals(bins):
    x, y, _ = sample(120)
    spec = T.Spec(trees=15, boost=0.3, depth=2, bins=bins).sized(len(y))
    made = T.boost(x, y, spec)
    now = np.full(len(y), y.mean())
    ones = np.ones(len(y))
    for k in range(15):
        now += 0.3 * plain_predict(x, y - now, ones, spec, k)
        assert np.allclose(spec.boost * sum(t.predict(x) for t in made[: k + 2]), now)


def test_second_order_leaves_and_leaf_wise_growth():
    x, y, _ = sample(200)
    spec = T.Spec(trees=1, boost=1.0, max_leaves=4, l2=3.0, bins=512, base=0.0).sized(200)
    start, tree = T.boost(x, y, spec)
    leaf = tree.apply(x)
    assert start.predict(x).sum() == 0 and len(set(leaf)) == 4
    for i in set(leaf):
        assert np.isclose(tree.value[i], y[leaf == i].sum() / ((leaf == i).sum() + 3.0))


def frame(spark, n, seed=0, values=None):
    x, y, _ = sample(n, seed, values)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, key=[f"k{i % 3}" for i in range(n)], t=range(n))
    return spark.createDataFrame(pdf)


def predictions(m, df, out="y_pred"):
    return [r[0] for r in m.transform(df).orderBy("t").select(out).collect()]


@pytest.mark.parametrize("spec", SPECS)
def test_all_tasks_grow_what_one_task_grows(spark, spec, monkeypatch):
    """Nodes split by sums over all tasks, cells under them, and the same trees in one task."""
    from dataclasses import replace

    monkeypatch.setattr(T, "BUNDLE", 2)
    df = frame(spark, 300, values=7)
    spec = replace(spec, trees=3)
    args = (spec, ["a", "b", "c", "d"], "y", "key", ["t"])
    one = predictions(T.TreeModel(*args).fit(df.repartition(3)), df)
    many = predictions(T.TreeModel(*args, local_rows=60).fit(df.repartition(5)), df)
    assert np.allclose(one, many)


def test_boosting_over_all_tasks(spark):
    df = frame(spark, 200, values=7)
    args = (T.Spec(trees=3, boost=0.3, depth=3, bins=64), ["a", "b", "c"], "y", None, ["t"])
    assert np.allclose(predictions(T.TreeModel(*args).fit(df), df), predictions(T.TreeModel(*args, local_rows=50).fit(df.repartition(4)), df))


def test_missing_features_saving_and_partitions(spark, tmp_path):
    df = frame(spark, 150)
    odd = df.limit(2).selectExpr("cast(null as double) as a", "b", "c", "d", "y", "key", "1000 + t as t").unionAll(df.limit(1).selectExpr("a", "b", "c", "d", "cast(null as double) as y", "'new' as key", "2000L as t"))
    m = T.TreeModel(T.Spec(trees=30, bootstrap=True, max_leaves=12), ["a", "b", "c", "d"], "y", "key", ["t"])
    got = predictions(m.fit(df.unionAll(odd).repartition(4)), df.unionAll(odd))
    assert got[150:152] == [None, None] and got[152] is not None and None not in got[:150]
    m.save(str(tmp_path / "m"))
    again = T.TreeModel(m.spec, m.features, "y", "key", ["t"]).load(spark, str(tmp_path / "m"))
    assert predictions(again, df.repartition(7)) == got[:150]
    assert predictions(T.TreeModel(m.spec, m.features, "y", "key", ["t"]).fit(df.repartition(9)), df) == got[:150]


def test_presets():
    p = T.PRESETS
    assert (p["RandomForestRegressor"].trees, p["RandomForestRegressor"].depth, p["RandomForestRegressor"].max_leaves) == (1000, 30, 1000)
    assert (p["BaggingRegressor"].trees, p["BaggingRegressor"].rows_share, p["BaggingRegressor"].features_share) == (350, 0.9, 0.7)
    assert p["ExtraTreesRegressor"].trees == 1000 and p["ExtraTreesRegressor"].random and not p["ExtraTreesRegressor"].bootstrap
    assert (p["GradientBoostingRegressor"].trees, p["GradientBoostingRegressor"].boost, p["GradientBoostingRegressor"].depth) == (1000, 0.01, 3)
    assert (p["DecisionTreeRegressor"].min_split, p["DecisionTreeRegressor"].min_leaf, p["DecisionTreeRegressor"].depth) == (0.018, 0.007, 25)


@pytest.mark.parametrize("query,name", [("q_forest", "RandomForestRegressor"), ("q_extra", "ExtraTreesRegressor"), ("q_bag", "BaggingRegressor"), ("q_gbt", "GradientBoostingRegressor"), ("q_xgb", "XGBRegressor"), ("q_lgbm", "LGBMRegressor")])
def test_registered_trees_are_the_presets(spark, monkeypatch, query, name):
    from panelcast.catalog import QUERIES

    class Seen(Exception):
        pass

    def fit(self, df):
        raise Seen(self.spec)

    monkeypatch.setattr(T.TreeModel, "fit", fit)
    with pytest.raises(Seen) as e:
        QUERIES[query](spark, "/root/testdata/sf0.001")
    assert e.value.args[0] == T.PRESETS[name]
