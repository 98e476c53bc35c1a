"""Operators that run over all rows, against plain loops: boards, histories, clustering, segments, regimes, forecasts, long series."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import table
from tidemark.functions import equations
from tidemark.operators import clustering, decode, events, histories, predictors, samples, segments, signal, structure, windows
from tidemark.plans import catalog, pipeline
from tidemark.sources import observations


def series_of(df, value="s"):
    out = {}
    for r in df.select("channel", "idx", value).collect():
        out.setdefault(r["channel"], {})[r["idx"]] = np.nan if r[value] is None else r[value]
    return {c: np.array([v[i] for i in sorted(v)]) for c, v in out.items()}


def test_peaks_of_a_long_series_take_time_in_proportion(spark):
    n = 500_000
    df = spark.range(n).select(F.lit("a").alias("channel"), F.col("id").alias("idx"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("s"))
    df = df.withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "d1": F.lit(None).cast("double"), "d2": F.lit(None).cast("double"), "x": F.when(F.col("idx") % 7 > 0, F.col("s"))})
    start = time.time()
    assert events.peaks(df).count() > n // 2
    assert df.select(signal.linear_filled(F.col("x")).alias("f")).filter("f is null").count() == 0
    assert time.time() - start < 90


def test_numbers_and_lookups_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(samples, "BUCKET", 10)
    rng = np.random.default_rng(0)
    starts = sorted(rng.choice(400, 60, replace=False).tolist() + [900, 901])
    df = spark.createDataFrame([(int(s),) for s in starts], "start_idx long")
    got = {r.start_idx: r.pos for r in samples.numbered(df).collect()}
    assert got == {s: i for i, s in enumerate(starts)}
    asked = spark.createDataFrame([(i, int(t)) for i, t in enumerate(rng.integers(-20, 1000, 200))], "window_id long, at long")
    placed = samples.numbered(df)
    found = samples.forward_asof(asked, placed)
    for r in found.collect():
        later = [i for i, s in enumerate(starts) if s >= r["at"]]
        assert r.pos == (later[0] if later else None)
    w = df.withColumn("window_id", F.col("start_idx") * 3)
    frames = {r.start_idx: r.history_ids for r in samples.history_frames(w).collect()}
    assert frames == {s: [3 * x for x in starts[i - 3 : i + 1]] for i, s in enumerate(starts) if i >= 3}


def test_histories_around_centres(spark):
    rng = np.random.default_rng(1)
    starts = np.unique(rng.integers(0, 3000, 500))
    s = spark.createDataFrame([(int(x), int(i)) for i, x in enumerate(starts)], "start_idx long, segment_id long")
    at = histories.centres(s, 200, 7)
    rows = histories.around(s, at, 200, 20)
    tails = {}
    for r in histories.members(rows, s, "tail", 20).collect():
        tails.setdefault(r.centre, {})[r.slot] = r.segment_id
    heads = {}
    for r in histories.members(rows, s, "head", 20).collect():
        heads.setdefault(r.centre, {})[r.slot] = r.segment_id
    centres = [r.centre for r in at.collect()]
    assert centres == list(range(int(starts[0]) + 200, int(starts[-1]) - 199, 7))
    for c in centres:
        before = np.flatnonzero((starts >= c - 200) & (starts < c))[-20:]
        after = np.flatnonzero((starts >= c) & (starts < c + 200))[:20]
        assert tails.get(c, {}) == {20 - len(before) + k: v for k, v in enumerate(before)}
        assert heads.get(c, {}) == dict(enumerate(after))
    assert [r.segment_id for r in histories.last_before(s, 1000, 300, 9).collect()] == np.flatnonzero((starts >= 700) & (starts < 1000))[-9:].tolist()


def test_predictor_board_against_loops(spark, data):
    sig = catalog.sig(spark, data)
    got = {(r.channel, r.predictor): (r.n, r.mae) for r in predictors.board(sig).collect()}
    for c, y in series_of(sig).items():
        y = y[np.isfinite(y)]
        errors = {p: [] for p in predictors.PREDICTORS}
        for i in range(1, len(y)):
            h = y[:i]
            errors["level"].append(abs(y[i] - h[-1]))
            if i > 1:
                errors["velocity"].append(abs(y[i] - 2 * h[-1] + h[-2]))
            if i > 2:
                errors["acceleration"].append(abs(y[i] - 3 * h[-1] + 3 * h[-2] - h[-3]))
                u = h[-24:]
                k = np.linalg.lstsq(np.column_stack([np.ones(len(u) - 2), u[1:-1], u[:-2]]), u[2:], rcond=None)[0]
                errors["local_ar2"].append(abs(y[i] - k @ [1, u[-1], u[-2]]))
        for p, e in errors.items():
            assert got[c, p][0] == len(e) and np.isclose(got[c, p][1], np.mean(e), rtol=1e-6), (c, p)
    assert predictors.board(table(spark, [1.0] * 7).withColumn("s", F.col("x"))).count() == 0
    turned = table(spark, [350.0, 355.0, 0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0]).withColumn("s", F.col("x"))
    mae = {r.predictor: r.mae for r in predictors.board(turned, circular=["a"]).collect()}
    assert abs(mae["level"] - 5) < 1e-6 and abs(mae["velocity"]) < 1e-6 and abs(mae["acceleration"]) < 1e-6 and mae["local_ar2"] < 5


def test_regimes_against_loops(spark, data):
    """Labels, switches and blocks of the given series, step by step."""
    sig = catalog.sig(spark, data)
    want = {}
    for c, y in series_of(sig).items():
        labels = [None] * len(y)
        for i in range(24, len(y)):
            h = y[i - 24 : i]
            if not np.isfinite(h).all() or not np.isfinite(y[i]):
                continue
            k = np.linalg.lstsq(np.column_stack([np.ones(22), h[1:-1], h[:-2]]), h[2:], rcond=None)[0]
            guess = [h[-1], 2 * h[-1] - h[-2], 3 * h[-1] - 3 * h[-2] + h[-3], k @ [1, h[-1], h[-2]]]
            labels[i] = predictors.PREDICTORS[int(np.argmin(np.abs(y[i] - np.array(guess))))]
        changed = True
        while changed:
            changed, a = False, 0
            runs = []
            for i in range(1, len(labels) + 1):
                if i == len(labels) or labels[i] != labels[a]:
                    runs.append((a, i))
                    a = i
            for j, (a, z) in enumerate(runs):
                if labels[a] is None or z - a >= 3:
                    continue
                left = labels[runs[j - 1][0]] if j else None
                right = labels[runs[j + 1][0]] if j + 1 < len(runs) else None
                if (new := left or right) and new != labels[a]:
                    labels[a:z] = [new] * (z - a)
                    changed = True
                    break
        want[c] = labels
    got = {}
    for r in predictors.labelled(sig).collect():
        got.setdefault(r.channel, {})[r.idx] = r.label
    off = sum(got[c][i] != v for c, labels in want.items() for i, v in enumerate(labels))
    assert off == 0
    n = len(next(iter(want.values())))
    switches = [sum(i > 0 and v[i] is not None and v[i - 1] is not None and v[i] != v[i - 1] for v in want.values()) for i in range(n)]
    assert {r.idx: r.n_changed for r in catalog.switch_counts(spark, data).collect()} == dict(enumerate(switches))
    cuts = sorted({24, *[i for i in range(25, n) if switches[i] >= 2], n})
    blocks = [[a, z - 1] for a, z in zip(cuts, cuts[1:], strict=False)]
    i = 0
    while i < len(blocks) and len(blocks) > 1:
        if blocks[i][1] - blocks[i][0] + 1 >= 6:
            i += 1
        elif i:
            blocks[i - 1][1] = blocks.pop(i)[1]
            i -= 1
        else:
            blocks[1][0] = blocks.pop(0)[0]
    found = [[r.start_idx, r.end_idx] for r in catalog.regime_blocks(spark, data).orderBy("start_idx").collect()]
    assert found == blocks
    inside = {(r.start_idx, r.end_idx) for r in catalog.hierarchical_windows(spark, data).collect()}
    assert inside == {(s, s + 23) for a, z in blocks for s in range(a, z - 22)}
    steps = {}
    for a, z in blocks:
        key = ",".join(sorted(f"{c}={want[c][a] or 'none'}" for c in want))
        steps[key] = steps.get(key, 0) + z - a + 1
    top = sorted(steps.items(), key=lambda x: (-x[1], x[0]))[:12]
    assert [(r.signature, r.steps) for r in catalog.top_signatures(spark, data).orderBy(F.desc("steps"), "signature").collect()] == top
    share = {(r.channel, r.label): r.n for r in catalog.label_shares(spark, data).collect()}
    assert share == {(c, v): labels.count(v) for c, labels in want.items() for v in set(labels)}


def test_walked_segments_against_a_step_by_step_walk(spark, data):
    sig = catalog.sig(spark, data).filter("s is not null")
    got = {}
    for r in segments.segmented(sig, tolerance=12.0, value="s").collect():
        got.setdefault(r.channel, []).append((r.start_idx, r.end_idx, r.eq_type, r.n_points))
    rows = {}
    for r in sig.select("channel", "idx", "s").collect():
        rows.setdefault(r.channel, []).append((r.idx, r.s))
    for c, pairs in rows.items():
        pairs.sort()
        idx, y = [p[0] for p in pairs], np.array([p[1] for p in pairs])
        start, want = 0, []
        while start < len(y):
            stop = min(start + 24, len(y))
            fit, at = equations.best_fit(y[start:stop], equations.HARMONIC_SET, 10.0), stop
            while at < len(y):
                if abs(y[at] - float(fit.at(float(at - start)))) > 12.0:
                    new = equations.best_fit(y[start : at + 1], equations.HARMONIC_SET, 10.0)
                    if abs(y[at] - float(new.at(float(at - start)))) > 12.0:
                        break
                    fit = new
                at += 1
            want.append((idx[start], idx[at - 1], fit.eq_type, fit.n_points))
            start = at
        assert sorted(got[c]) == want


def test_joint_refits_against_loops(spark, data):
    """Pieces between the ends of all channels' segments; each channel fitted on each."""
    sig = catalog.sig(spark, data).filter("s is not null and idx < 250")
    cuts = segments.segmented(sig, tolerance=12.0, harmonic=False, value="s")
    names = catalog.channels(sig)
    got = {(r.start_idx, r.channel): (r.segment_id, r.duration, r.x0, r.eq_type, r.n_points, r.rms) for r in segments.joint_refit(samples.boundary_union(cuts), sig, value="s", harmonic=names[:1]).collect()}
    ends = sorted({x for r in cuts.collect() for x in (r.start_idx, r.end_idx)})
    y = {}
    for r in sig.select("channel", "idx", "s").collect():
        y.setdefault(r.channel, {})[r.idx] = r.s
    want = 0
    for k, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
        for c in names:
            v = [y[c][i] for i in range(a, z + 1) if i in y[c]]
            if v:
                f = equations.best_fit(np.array(v), equations.HARMONIC_SET if c == names[0] else equations.PLAIN_SET, 10.0 if c == names[0] else 5.0)
                row = got[a, c]
                assert row[:2] == (k, z - a) and row[3:5] == (f.eq_type, len(v)) and np.isclose(row[5], f.rms) and row[2] == y[c].get(a, 0.0)
                want += 1
    assert want == len(got) > 20


def test_fits_against_least_squares():
    """Equations from running sums: no worse than any of a dense search, and as good for any portions of the points."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 10, 24, 60, 200):
        for y in (np.cumsum(rng.normal(size=n)) + 1000, 20 * np.exp(-0.05 * np.arange(n)) - 7, 3 * np.sin(equations.OMEGA * np.arange(n)) + 0.1 * np.arange(n), np.full(n, 5.0)):
            y = np.where(rng.random(n) < 0.1, np.nan, y)
            ok = np.isfinite(y)
            f, m = equations.best_fit(y), equations.Moments()
            for a in range(0, n, 7):
                m.add(y[a : a + 7])
                m.best()
            g = m.best()
            if not ok.any():
                continue
            assert f.eq_type == g.eq_type and np.isclose(f.rms, g.rms, atol=1e-7) and f.n_points == ok.sum()
            off = y[ok] - f.at(np.flatnonzero(ok))
            assert np.isclose(np.sqrt(np.mean(off**2)), f.rms, atol=1e-6)
            t = np.flatnonzero(ok).astype(float)
            least = np.inf
            for lam in np.concatenate([[0], np.geomspace(1e-6, 5, 300)]) if ok.sum() >= 24 else []:
                e = np.exp(-lam * t)
                for base in ([np.ones_like(t), e * np.cos(equations.OMEGA * t), e * np.sin(equations.OMEGA * t)], [np.ones_like(t), t, np.cos(equations.OMEGA * t), np.sin(equations.OMEGA * t)]):
                    b = np.column_stack(base)
                    least = min(least, np.sqrt(np.mean((y[ok] - b @ np.linalg.lstsq(b, y[ok], rcond=None)[0]) ** 2)))
            assert f.rms <= least + 1e-7


def test_a_walk_takes_time_in_proportion():
    y = np.random.default_rng(2).normal(size=8000) * 2
    took = []
    for n in (2000, 8000):
        start = time.process_time()
        equations.Walk(3.0).feed(y[:n], last=True)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]


def test_dynamics_pieces_against_loops(spark, data):
    sig = catalog.sig(spark, data)
    cuts = {}
    for c, y in series_of(sig).items():
        start = 0
        cuts.setdefault(0, set()).add(c)
        while start < len(y):
            rest = y[start:]
            d = equations.fit_dynamics(rest)
            scale, ok = max(d["std"], 0) if d["std"] > 1e-8 else 1.0, np.isfinite(rest)
            mean = rest[ok].mean() if ok.any() else 0.0
            x0 = (rest[0] - mean) / scale if ok[0] else 0.0
            hit = next((k for k in range(6, len(rest)) if np.isfinite(rest[k]) and abs(rest[k] - (float(equations.dynamics_value(d, np.array([float(k)]), x0)[0]) * scale + mean)) > 2.4 * scale), None)
            if hit is None:
                break
            start += hit
            cuts.setdefault(start, set()).add(c)
    order = sorted(cuts)
    want = {(s, (order[i + 1] if i + 1 < len(order) else len(y)) - 1, len(cuts[s])) for i, s in enumerate(order)}
    got = {(r.start_idx, r.end_idx, r.synchrony) for r in segments.dynamics_fits(sig, segments.dynamics_boundaries(sig)).collect()}
    assert got == want


def test_medoids_and_silhouette_of_all_points(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.6, size=(30, 4)) for m in (0, 3, 6, 9)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    chosen = np.array([r.v for r in clustering.medoids(points, 4, seed=5).orderBy("pattern_id").collect()])
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    start = [r.id for r in points.orderBy(F.xxhash64(F.col("id"), F.lit(5)), "id").limit(4).collect()]
    now = list(start)
    for _ in range(50):
        labels = d2[:, now].argmin(1)
        new = [int(np.flatnonzero(labels == j)[d2[np.ix_(labels == j, labels == j)].sum(1).argmin()]) for j in range(4)]
        if new == now:
            break
        now = new
    assert np.allclose(chosen, x[now])
    labels = d2[:, now].argmin(1)
    score = []
    for i in range(len(x)):
        means = [d2[i, labels == j].mean() for j in range(4)]
        b = min(m for j, m in enumerate(means) if j != labels[i])
        score.append((b - means[labels[i]]) / max(means[labels[i]], b))
    want = np.mean(score) * min(np.bincount(labels)) / len(x) * 4
    table_ = spark.createDataFrame([(j, x[m].tolist()) for j, m in enumerate(now)], "pattern_id int, v array<double>")
    assert np.isclose(clustering.silhouette_of(points, table_), want)
    _, scores = clustering.select_medoids(points, (2, 4, 6))
    assert max(scores, key=scores.get) == 4
    assert clustering.select_medoids(points.limit(0))[0].count() == 0


def plain_leader_clusters(x, thresholds, least, lower, upper):
    """The best threshold's labels and all scores, row by row."""
    best, scores = None, {}
    upper = max(2, min(upper, max(2, len(x) // least)))
    lower = min(max(2, lower), upper)
    for t in thresholds:
        means, members = [], []
        for i, row in enumerate(x):
            d = [np.linalg.norm(m - row) for m in means]
            j = int(np.argmin(d)) if d else -1
            if d and d[j] <= t * (1 + 1e-9):
                members[j].append(i)
                means[j] = x[members[j]].mean(0)
            else:
                means.append(row)
                members.append([i])
        large = [j for j, m in enumerate(members) if len(m) >= least]
        if large:
            for j, m in enumerate(members):
                if j not in large:
                    for i in m:
                        members[large[int(np.argmin([np.linalg.norm(means[g] - x[i]) for g in large]))]].append(i)
                    members[j] = []
            members = [m for m in members if m]
        while len(members) > upper:
            i = int(np.argmin([len(m) for m in members]))
            c = [x[m].mean(0) for m in members]
            j = int(np.argmin([np.inf if g == i else np.linalg.norm(c[g] - c[i]) for g in range(len(c))]))
            members[j] = members[j] + members[i]
            del members[i]
        c, size = [x[m].mean(0) for m in members], np.array([len(m) for m in members])
        score = -np.inf
        if len(c) > 1:
            gap = np.mean([min(np.linalg.norm(a - b) for k, b in enumerate(c) if k != i) for i, a in enumerate(c)])
            off = np.mean([np.linalg.norm(x[i] - c[k]) for k, m in enumerate(members) for i in m])
            score = gap / max(off, 1e-6) * (0.5 + 0.5 * size.min() / size.mean()) * min(1, len(c) / lower) * min(1, upper / len(c))
        scores[t] = score
        if best is None or score > best[0] + 1e-9 * abs(best[0]) or best[0] == -np.inf < score:
            best = (score, {i: k for k, m in enumerate(members) for i in m}, c)
    return best[1], best[2], scores


@pytest.mark.parametrize("least, upper, spread", [(24, 96, 0.5), (5, 4, 2.0)])
def test_leader_clusters_against_a_loop(spark, least, upper, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(scale=6, size=(12, 5))
    x = np.concatenate([rng.normal(c, spread, size=(20, 5)) for c in centres] + [rng.normal(50, 0.1, size=(1, 5))])
    x = x[rng.permutation(len(x))]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    shares = (0.1, 0.15, 0.2, 0.25, 0.3)
    thresholds = sorted({float(np.quantile(d.min(1), q)) for q in shares})
    want, means, scores = plain_leader_clusters(x, thresholds, least, 12, upper)
    for parts in (1, 7):
        labels, table_, got = clustering.leader_clusters(points.repartition(parts), least=least, upper=upper)
        assert np.allclose(sorted(got), thresholds) and np.allclose([got[t] for t in sorted(got)], [scores[t] for t in thresholds], rtol=1e-6)
        assert {r.id: r.pattern_id for r in labels.collect()} == want
        assert np.allclose(np.array([r.v for r in table_.orderBy("pattern_id").collect()]), means)


def test_leaders_pass_over_far_means(spark):
    """The same clusters as comparing every mean, with a small share of the comparisons; as many leaders as the threshold gives."""
    rng = np.random.default_rng(6)
    x = rng.normal(scale=30, size=(4000, 6))
    x[1::2] = x[::2] + rng.normal(scale=0.05, size=(2000, 6))
    now = clustering.Leaders(1.0, 6)
    got, means, counts, want, every = [now.add(r) for r in x], np.empty((4000, 6)), np.zeros(4000), [], 0
    for r in x:
        k = int(counts.astype(bool).sum())
        every += k
        d = ((means[:k] - r) ** 2).sum(1)
        j = int(d.argmin()) if k and d.min() <= 1 else k
        means[j] = r if j == k else means[j] + (r - means[j]) / (counts[j] + 1)
        counts[j] += 1
        want.append(j)
    assert got == want and now.n > 1500 and now.compared < every / 10
    assert clustering.leader_clusters(spark.createDataFrame([], "id long, v array<double>"))[0].count() == 0
    one = clustering.leader_clusters(spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>"))
    assert [tuple(r) for r in one[0].collect()] == [(1, 0)] and one[1].count() == 1


def test_ridge_backtest_against_numpy(spark):
    rng = np.random.default_rng(4)
    y = {c: np.cumsum(rng.normal(size=200)) for c in "ab"}
    sig = None
    for c in "ab":
        t = signal.signal(table(spark, y[c].tolist(), c))
        sig = t if sig is None else sig.unionByName(t)
    v = pipeline.feature_vectors(windows.intra_features(sig), ["a", "b"])
    got = {(r["split"], r.channel, r.horizon): (r.n, r.mae) for r in pipeline.backtest(v, sig, horizons=3).collect()}
    x = {r.window_id: np.array(r.v) for r in v.collect()}
    s = series_of(sig)
    n = len(x)
    cut = [int(n * 0.7), int(n * 0.85)]
    for c in "ab":
        for h in (1, 2, 3):
            rows = [(w, s[c][w + 23 + h]) for w in range(cut[0]) if w + 23 + h <= cut[0] - 1 + 23]
            a = np.column_stack([np.stack([x[w] for w, _ in rows]), np.ones(len(rows))])
            p = np.diag([1.0] * (a.shape[1] - 1) + [0.0])
            k = np.linalg.solve(a.T @ a + p, a.T @ np.array([t for _, t in rows]))
            for name, lo, hi in (("validation", cut[0], cut[1]), ("test", cut[1], n)):
                e = [abs(np.append(x[w], 1) @ k - s[c][w + 23 + h]) for w in range(lo, hi) if w + 23 + h < 200]
                assert got[name, c, h][0] == len(e) and np.isclose(got[name, c, h][1], np.mean(e), rtol=1e-4)


def test_saved_fits_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, [float(i), 1.0], 2.0 * i) for i in range(9)], "channel string, horizon long, v array<double>, y double")
    fits = pipeline.ridge_fits(rows, ("channel", "horizon"), 1e-9)
    pipeline.save_fits(fits, str(tmp_path / "fits"))
    r = pipeline.load_fits(spark, str(tmp_path / "fits")).first()
    assert np.isclose(r.w[0], 2) and (r.channel, r.horizon) == ("a", 1)


def test_decoding_of_blocks(spark):
    channels, size = ["a", "b", "c"], 13 * 3 + 5 * 3 + 13 * 3 + 8 + 3
    v = [float(i) for i in range(size)]
    df = spark.createDataFrame([(v,)], "v array<double>")
    r = df.select(decode.split_vector(F.col("v"), 3).alias("p")).select("p.*").first()
    assert r.intra == v[:39] and r.inter == v[39:54] and r.hazard == v[54:93] and r.time == v[93:]
    with pytest.raises(Exception, match="vector size"):
        df.select(decode.split_vector(F.col("v"), 4).alias("p")).collect()
    time_block = [1.0, 2.5, -3.0, 0.1, 0.2, 0.3, 0.4, 3.5, 7.0, 8.0, 9.0]
    t = spark.createDataFrame([(time_block,)], "v array<double>").select(decode.time_placeholders(F.col("v"), channels).alias("t")).select("t.*").first()
    assert (t.window_length_steps, t.forecast_horizon_steps, len(t.normalized_event_positions)) == (2, 1, 4)
    assert t.duration_over_threshold_by_channel == {"a": 7.0, "b": 8.0, "c": 9.0}
    names = ("n_peaks", "tail")
    steps = spark.createDataFrame([(0.0, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (2.0, [2.0, 3.0, 4.0, 5.0, 6.0, 7.0])], "t double, hazard array<double>")
    grid = spark.createDataFrame([(-1.0,), (1.0,), (5.0,)], "t double")
    out = {(x.channel, x.feature, x.t): x.value for x in decode.decoded_hazards(steps, grid, channels, names).collect()}
    assert len(out) == 18 and out["b", "tail", 1.0] == 5.0 and out["b", "tail", -1.0] == 4.0 and out["b", "tail", 5.0] == 6.0


def test_pieces_as_windows_and_their_context(spark, data):
    sig = catalog.sig(spark, data)
    pieces = segments.dynamics_fits(sig, segments.dynamics_boundaries(sig))
    w = pipeline.segments_as_windows(pieces, sig)
    y = series_of(sig)
    for r in w.collect():
        assert set(r.channel_x0) == set(r.channel_stds) <= set(y)
        assert all(np.isclose(r.channel_x0[c], np.nan_to_num(y[c][r.start_idx])) for c in r.channel_x0)
    none = w.withColumn("channel_stds", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    assert observations.read_physics_context(w).count() == w.count() and observations.read_physics_context(none).count() == 0


def test_strategies(spark):
    points = spark.createDataFrame([(i, [float(i % 3) * 10, float(i) / 100]) for i in range(60)], "id long, v array<double>")
    for strategy, segmentation in (("structural", "extrema"), ("kmeans", "extrema"), ("structural", "new_physics")):
        labels, _ = pipeline.discover_patterns(points, strategy, segmentation)
        assert labels.count() == 60
    with pytest.raises(ValueError):
        pipeline.discover_patterns(points, "other")


def test_functional_distances_choose_medoids(spark, data):
    got = catalog.dynamics_medoids(spark, data)
    assert got.count() == structure.functional_vectors(catalog.dynamics_pieces(spark, data)).count()
