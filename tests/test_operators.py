import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkmill.operators import (
    calibrate, diarize, ensemble, labels, metrics, neighbours, report, scan, speech, split, threshold,
)
from talkmill.functions import fixed


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# labels -----------------------------------------------------------------------------------------

def test_label_aliases(spark):
    df = spark.createDataFrame(
        [(" NED ", "customer_suppot.manager"), ("need", "x"), ("?", "-"), ("Sales", "ge"), ("", "hr_team")],
        "call_purpose string, assigned_group string",
    )
    got = labels.normalise_labels(df).collect()
    assert [r.call_purpose for r in got] == ["need", "need", "", "sales", ""]
    assert [r.assigned_group for r in got] == ["customer_support.manager", "x", "", "", "hr_team"]
    unknown = labels.unknown_labels(df, "call_purpose", fixed.CALL_PURPOSE_ALIASES)
    assert rows_of(unknown, "label", "n") == [("need", 1), ("sales", 1)]
    assert labels.suspicious_rows(df.withColumn("text", F.lit("т" * 99)), "call_purpose").count() == 2


def test_remap(spark):
    df = spark.createDataFrame([("escalation",), ("Escalation",), ("marketing",), ("hr",)], "y string")
    assert rows_of(labels.remap_labels(df, "y"), "y") == [("Escalation",), ("consulting",), ("cooperation",), ("hr",)]
    assert ("after", "consulting", 1) in rows_of(labels.remap_counts(df, "y"), "stage", "label", "n")


def test_variants(spark):
    values = ["spam"] * 5 + [" hr "] * 4 + ["sales"] * 6 + [""] * 3
    df = spark.createDataFrame([(i, "t", v) for i, v in enumerate(values)], "row_id long, text string, call_purpose string")

    def counts(variant, **kw):
        return rows_of(labels.label_counts(labels.dataset_variant(df, variant, **kw), "call_purpose"), "label", "n")

    assert counts("multiclass") == [("sales", 6)]
    assert counts("multiclass", min_samples=4) == [("hr", 4), ("sales", 6)]
    assert counts("multiclass_with_spam") == [("sales", 6), ("spam", 5)]
    assert counts("binary_spam") == [("non_spam", 10), ("spam", 5)]
    with pytest.raises(ValueError):
        labels.dataset_variant(df, "other")
    with pytest.raises(ValueError):
        labels.binary_spam_variant(df, "priority")


def test_filters(spark):
    df = spark.createDataFrame(
        [("2024-01-02__03-04-05_x.mp3", "a", "1", "hr", "g"), ("b", " ", "1", "", "g"), ("c", "b", "0", " ", "g")],
        "filename string, text string, is_training_sample string, call_purpose string, assigned_group string",
    )
    assert labels.training_rows(df).count() == 1
    assert labels.training_rows(df.drop("is_training_sample")).count() == 2
    assert tuple(labels.ready_counts(df).first()) == (3, 2, 1)
    ready = labels.keep_ready_rows(df)
    assert ready.columns == ["filename", "text", "call_purpose", "assig_group"]
    assert ready.first().filename == "2024-01-02__03-04-05"
    assert labels.keep_ready_rows(df, strict_reference=True).columns == ["filename", "text", "call_purpose"]
    assert labels.eval_rows(df, "text", "call_purpose").count() == 1
    with pytest.raises(ValueError, match="available"):
        labels.require_columns(df, "zz")
    bad = spark.createDataFrame([(" spam",), ("ham",), ("",)], "y string")
    with pytest.raises(ValueError, match="ham"):
        labels.binary_labels(bad, "y", "spam", "non_spam")
    assert labels.binary_labels(bad.where("y <> 'ham'"), "y", "spam", "non_spam").count() == 1
    with pytest.raises(ValueError):
        labels.not_empty(df.where("false"))


def test_subsets(spark):
    df = spark.createDataFrame([(1, " YES"), (2, "0"), (3, "синтетика"), (4, None)], "row_id long, is_synthetic string")
    got = labels.label_counts(labels.with_subsets(df), "subset")
    assert rows_of(got, "label", "n") == [("all", 4), ("real", 2), ("synthetic", 2)]
    assert labels.subset_rows(df, "synthetic").count() == 2 and labels.subset_rows(df, "real").count() == 2
    assert labels.subset_rows(df.drop("is_synthetic"), "real").count() == 4


# metrics ----------------------------------------------------------------------------------------

def python_report(pairs):
    out = {}
    for c in {x for p in pairs for x in p}:
        tp = sum(t == p == c for t, p in pairs)
        fp = sum(p == c != t for t, p in pairs)
        fn = sum(t == c != p for t, p in pairs)
        prec, rec = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        out[c] = (prec, rec, 2 * prec * rec / (prec + rec) if prec + rec else 0, tp + fn)
    return out


def test_reports(spark):
    rng = random.Random(3)
    pairs = [(rng.choice("abcd"), rng.choice("abce")) for _ in range(300)]
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    want = python_report(pairs)
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in metrics.class_report(df).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    row = metrics.summary(df).first()
    n = len(pairs)
    assert row.f1_weighted == pytest.approx(sum(v[2] * v[3] for v in want.values()) / n)
    assert row.f1_macro == pytest.approx(sum(v[2] for v in want.values()) / len(want))
    assert (row.errors, row.n) == (sum(t != p for t, p in pairs), n)
    cm = rows_of(metrics.confusion_matrix(df), "y_true", "y_pred", "n")
    assert not any(p == "e" for _, p, _ in cm)
    wide = metrics.confusion_table(df, ["a", "b", "c", "d"])
    assert wide.columns == ["y_true", "a", "b", "c", "d"]


def test_views(spark):
    pairs = [("spam", "spam"), ("spam", "hr"), ("hr", "hr"), ("hr", "it"), ("it", "spam")]
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    got = {r.view: (r.n, r.accuracy) for r in metrics.metric_views(df).collect()}
    assert got == {"multiclass": (5, 0.4), "binary_spam": (5, 0.6), "nonspam_intents": (3, pytest.approx(1 / 3))}


@pytest.mark.parametrize("seed", range(3))
def test_quantiles(spark, seed):
    rng = random.Random(seed)
    data = {g: [rng.choice([0.5, round(rng.random(), 2)]) for _ in range(n)] for g, n in (("a", 101), ("b", 8), ("c", 1))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {r.g: r.q for r in scan.exact_quantile(df, "v", 0.9, "q", ["g"]).collect()}
    for g, vs in data.items():
        assert got[g] == pytest.approx(np.quantile(vs, 0.9))
    assert scan.exact_quantile(df, "v", 0.25, "q").first().q == pytest.approx(
        np.quantile([v for vs in data.values() for v in vs], 0.25)
    )


def test_lengths(spark):
    values = [1, 5, 5, 9, 200, 300, 700]
    df = spark.createDataFrame([(v,) for v in values], "n int")
    r = metrics.length_summary(df, "n").first()
    assert (r.n, r["mean"], r["median"], r["max"]) == (7, pytest.approx(np.mean(values)), 9, 700)
    assert (r.p90, r.p95, r.p99) == tuple(pytest.approx(np.percentile(values, q)) for q in (90, 95, 99))
    assert rows_of(metrics.length_coverage(df, "n"), "threshold", "longer") == [(128, 3), (256, 2), (512, 1)]


# thresholds -------------------------------------------------------------------------------------

def python_sweep(data, rule):
    scores = sorted({s for s, _ in data})
    if len(scores) == 1:
        cuts = [scores[0] - 1e-6, scores[0] + 1e-6]
    else:
        eps = max(1e-9, (scores[-1] - scores[0]) * 1e-6, 1e-6)
        cuts = [scores[0] - eps, *[(a + b) / 2 for a, b in zip(scores, scores[1:])], scores[-1] + eps]
    out = []
    for t in cuts:
        hit = [(s >= t if rule == "greater_equal" else s <= t, y == "spam") for s, y in data]
        out.append((t, sum(h and y for h, y in hit), sum(h and not y for h, y in hit),
                    sum(not h and not y for h, y in hit), sum(not h and y for h, y in hit)))
    return sorted(out)


FIXTURE = [(0.1, "non_spam"), (0.4, "spam"), (0.4, "non_spam"), (0.8, "spam")]


@pytest.mark.parametrize("rule", ["greater_equal", "less_equal"])
@pytest.mark.parametrize("case", ["fixture", "many", "single", "hot"])
def test_sweep(spark, rule, case):
    rng = random.Random(5)
    data = {
        "fixture": FIXTURE,
        "many": [(round(rng.random(), 2), rng.choice(["spam", "non_spam"])) for _ in range(400)],
        "single": [(0.5, "spam"), (0.5, "non_spam")],
        "hot": [(0.25, "spam")] * 300 + [(rng.random(), "non_spam") for _ in range(300)],
    }[case]
    df = spark.createDataFrame(data, "s double, y string")
    sweep = threshold.threshold_sweep(df, "s", "y", rule=rule)
    got = rows_of(sweep, "threshold", "tp", "fp", "tn", "fn")
    want = python_sweep(data, rule)
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert [g[0] for g in got] == pytest.approx([w[0] for w in want])
    assert all(sum(g[1:]) == len(data) for g in got)


def test_fixture_values(spark):
    df = spark.createDataFrame(FIXTURE, "s double, y string")
    sweep = threshold.threshold_sweep(df, "s", "y")
    best = threshold.best_thresholds(sweep, "accuracy").first()
    assert (best.threshold, best.accuracy, best.spam_f1, best.youden_j) == (0.25, 0.75, pytest.approx(0.8), 0.5)
    assert threshold.roc_auc(df, "s", "y", "spam").first()[0] == pytest.approx(0.875)
    assert threshold.average_precision(df, "s", "y", "spam").first()[0] == pytest.approx(0.8333333333)
    zones = rows_of(threshold.zone_policy(df, "s", "y", 0.4, 0.8), "zone", "count", "spam_share")
    assert zones == [("allow", 1, 0.0), ("block", 1, 1.0), ("review", 2, 0.5)]
    with pytest.raises(ValueError):
        threshold.zone_policy(df, "s", "y", 0.8, 0.4)
    low = rows_of(threshold.zone_policy(df, "s", "y", 0.4, 0.1, rule="less_equal"), "zone", "count")
    assert low == [("allow", 1), ("block", 1), ("review", 2)]


def python_roc(data):
    scores = sorted({s for s, _ in data}, reverse=True)
    tps = np.array([sum(s >= t and y == "spam" for s, y in data) for t in scores])
    fps = np.array([sum(s >= t and y != "spam" for s, y in data) for t in scores])
    if len(fps) > 2:
        keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
        tps, fps, scores = tps[keep], fps[keep], np.array(scores)[keep]
    return [(0.0, 0.0, float("inf"))] + [(f / fps[-1], t / tps[-1], s) for f, t, s in zip(fps, tps, scores)]


@pytest.mark.parametrize("seed", range(4))
def test_curves(spark, seed):
    rng = random.Random(seed)
    data = [(round(rng.random(), 1 + seed % 2), rng.choice(["spam", "non_spam"])) for _ in range(120)]
    df = spark.createDataFrame(data, "s double, y string")
    got = sorted(tuple(r) for r in threshold.roc_curve(df, "s", "y", "spam").collect())
    want = sorted(python_roc(data))
    assert len(got) == len(want)
    assert all(g == pytest.approx(w) for g, w in zip(got, want))
    pr = threshold.pr_curve(df, "s", "y", "spam")
    assert pr.count() == len({s for s, _ in data}) + 1
    assert pr.where("threshold_score is null").first()[:2] == (1.0, 0.0)
    ranked = sorted({s for s, _ in data}, reverse=True)
    total, last, ap = sum(y == "spam" for _, y in data), 0.0, 0.0
    for t in ranked:
        hit = [y == "spam" for s, y in data if s >= t]
        ap += (sum(hit) / total - last) * sum(hit) / len(hit)
        last = sum(hit) / total
    assert threshold.average_precision(df, "s", "y", "spam").first()[0] == pytest.approx(ap)


# calibration ------------------------------------------------------------------------------------

def test_bins(spark):
    edges = np.linspace(0, 1, 11)
    values = [0.0, *edges.tolist(), *np.nextafter(edges, 2).tolist(), *np.nextafter(edges, -1).tolist(), 0.3, 0.7, 0.55]
    df = spark.createDataFrame([(float(v),) for v in values], "c double")
    for r in df.withColumn("b", calibrate.bin_of(F.col("c"))).collect():
        want = [i for i in range(10) if edges[i] < r.c <= edges[i + 1]]
        assert ([] if r.b is None else [r.b]) == want, r.c


def test_ece_and_tiers(spark):
    data = [(0.95, 1), (0.95, 0), (0.55, 1), (0.30, 0)]
    df = spark.createDataFrame([("a", "a" if ok else "b", c) for c, ok in data], "y_true string, y_pred string, confidence double")
    assert calibrate.ece(df).first().ece == pytest.approx(0.4125)
    rel = calibrate.reliability(df).orderBy("bin").collect()
    assert len(rel) == 10 and rel[9].n == 2 and rel[0].accuracy is None and rel[0].confidence == pytest.approx(0.05)
    three = spark.createDataFrame([("a", "a", 0.6), ("a", "b", 0.8), ("a", "a", 0.81)], df.schema)
    assert rows_of(calibrate.tiers(three), "tier", "count", "accuracy") == [(0, 1, 1.0), (1, 1, 0.0), (2, 1, 1.0)]


def test_temperature(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 3)) * 3
    p = np.exp(z / 2.0) / np.exp(z / 2.0).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    names = "abc"
    df = spark.createDataFrame(
        [(i, names[j], float(z[i, j]), names[y[i]]) for i in range(400) for j in range(3)],
        "row_id long, label string, logit double, y_true string",
    )

    def loss(t):
        q = np.exp((z - z.max(1, keepdims=True)) / t)
        q /= q.sum(1, keepdims=True)
        return -np.log(q[np.arange(400), y] + 1e-9).mean()

    grid = {r.temperature: r.nll for r in calibrate.temperature_grid(calibrate.dense_logits(df), [0.5, 1.0, 4.0]).collect()}
    assert grid == {t: pytest.approx(loss(t)) for t in (0.5, 1.0, 4.0)}
    t = calibrate.fit_temperature(df)
    fine = min((loss(x), x) for x in np.linspace(t - 0.05, t + 0.05, 101))[1]
    assert abs(t - fine) < 2e-3 and 1 < t < 4
    probs = calibrate.probabilities(df, 2.0)
    q = np.exp(z / 2) / np.exp(z / 2).sum(1, keepdims=True)
    hot = np.eye(3)[y]
    assert calibrate.brier(probs).first().brier == pytest.approx(((q - hot) ** 2).sum(1).mean())
    assert calibrate.nll(probs).first().nll == pytest.approx(loss(2.0))
    table = {r.metric: r for r in calibrate.calibration_report(df, t).collect()}
    assert set(table) == {"ece", "brier", "nll", "f1_weighted"}
    assert table["nll"].delta < 0 and table["f1_weighted"].delta == pytest.approx(0)


# scans and turns --------------------------------------------------------------------------------

def python_merge(rows, gap):
    out = []
    for f, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        cur = None
        for _, start, _, end, spk in group:
            if cur and spk == cur[3] and start - cur[2] <= gap:
                cur[2] = max(cur[2], end)
            else:
                cur = [f, start, end, spk]
                out.append(cur)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed", range(4))
def test_merge_turns(spark, seed):
    rng = random.Random(seed)
    rows = []
    for f, n in (("a", 3), ("hot", 400), ("z", 40)):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.0, 0.25, 0.5, 1.0])
            # Long stretches of one speaker, so that runs cross slices.
            spk = "S0" if seed == 0 else rng.choice(["S0", "S0", "S0", "S1"])
            rows.append((f, t, i, t + rng.choice([0.25, 0.5, 30.0 if i % 50 == 0 else 0.75]), spk))
    df = spark.createDataFrame(rows, "file_id string, start double, seg_idx int, end double, speaker string")
    got = rows_of(diarize.merge_turns(df, 0.5), "file_id", "start", "end", "speaker")
    assert got == python_merge(rows, 0.5)


def test_merge_fixture(spark):
    rows = [("A", 0, 1.5), ("A", .75, 2.25), ("A", 3, 4), ("B", 4.1, 5), ("B", 5.2, 6)]
    df = spark.createDataFrame([("f", float(s), i, float(e), k) for i, (k, s, e) in enumerate(rows)],
                               "file_id string, start double, seg_idx int, end double, speaker string")
    got = rows_of(diarize.merge_turns(df, 0.5), "start", "speaker", "dur")
    assert got == [(0.0, "A", 2.25), (3.0, "A", 1.0), (4.1, "B", pytest.approx(1.9))]


def test_overlap_join(spark):
    rng = random.Random(1)

    def turns(n):
        return [(f"f{i % 2}", i, s, s + rng.choice([1.0, 50.0, 200.0])) for i in range(n) for s in [rng.uniform(0, 500)]]

    a, b = turns(40), turns(40)
    schema = "file_id string, n int, start double, end double"
    got = rows_of(diarize.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)), "l_n", "r_n", "overlap")
    want = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b
                  if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert got == want


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "file_id string, start double, end double, speaker string")


def test_der_fixture(spark):
    ref = turns_of(spark, [("f", 0.0, 10.0, "A"), ("f", 10.0, 20.0, "B")])
    hyp = turns_of(spark, [("f", 0.0, 11.0, "X"), ("f", 11.0, 20.0, "Y")] * 3)
    plain = diarize.error_percent(diarize.diarization_errors(ref, hyp, collar=0.0)).first()
    assert (plain.DER, plain.MS, plain.FA, plain.SC) == (5.0, 0.0, 0.0, 5.0)
    soft = diarize.error_percent(diarize.diarization_errors(ref, hyp, collar=0.25)).first()
    assert soft.DER == 4.49


def python_der(ref, hyp, collar, skip):
    cuts = sorted({t for _, s, e, _ in ref + hyp for t in (s, e)} |
                  {b + d for _, s, e, _ in ref for b in (s, e) for d in (-collar / 2, collar / 2)})
    total = miss = fa = both = 0.0
    shared = {}
    for a, b in zip(cuts, cuts[1:]):
        m = (a + b) / 2
        if collar and any(abs(m - t) < collar / 2 for _, s, e, _ in ref for t in (s, e)):
            continue
        r = {k for _, s, e, k in ref if s <= m < e}
        h = {k for _, s, e, k in hyp if s <= m < e}
        if skip and len(r) > 1:
            continue
        d = b - a
        total += len(r) * d
        miss += max(len(r) - len(h), 0) * d
        fa += max(len(h) - len(r), 0) * d
        both += min(len(r), len(h)) * d
        for x, y in itertools.product(r, h):
            shared[x, y] = shared.get((x, y), 0) + d
    rs, hs = sorted({x for x, _ in shared}), sorted({y for _, y in shared})
    if len(rs) <= len(hs):
        best = max((sum(shared.get(p, 0) for p in zip(rs, c)) for c in itertools.permutations(hs, len(rs))), default=0)
    else:
        best = max(sum(shared.get(p, 0) for p in zip(c, hs)) for c in itertools.permutations(rs, len(hs)))
    return total, miss, fa, both - best


@pytest.mark.parametrize("seed,skip", [(0, True), (1, False), (2, True), (3, False)])
def test_der_brute(spark, seed, skip):
    rng = random.Random(seed)

    def side(names):
        return [("f", s, s + rng.uniform(0.5, 70), rng.choice(names)) for _ in range(12) for s in [rng.uniform(0, 300)]]

    ref, hyp = side(["A", "B", "C"]), side(["W", "X", "Y", "Z"][: 2 + seed])
    got = diarize.diarization_errors(turns_of(spark, ref), turns_of(spark, hyp), collar=0.5, skip_overlap=skip).first()
    assert tuple(got)[1:] == pytest.approx(python_der(ref, hyp, 0.5, skip))


def test_assignment():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        g = np.round(rng.random((n, m)), 1)
        t = g if n <= m else g.T
        want = max(sum(t[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(t.shape[1]), t.shape[0]))
        assert diarize._best_total(g) == pytest.approx(want)


def test_system_table(spark):
    ref = turns_of(spark, [("f", 0.0, 10.0, "A"), ("g", 0.0, 10.0, "A"), ("only_truth", 0.0, 1.0, "A")])
    hyp = spark.createDataFrame(
        [("s1", "f", 0.0, 10.0, "X"), ("s1", "g", 0.0, 5.0, "X"), ("s2", "f", 0.0, 10.0, "Y"), ("s2", "h", 0.0, 1.0, "Y")],
        "system string, file_id string, start double, end double, speaker string")
    errors = diarize.system_errors(ref, hyp, collar=0.0)
    assert rows_of(errors, "system", "file_id", "DER") == [("s1", "f", 0.0), ("s1", "g", 50.0), ("s2", "f", 0.0)]
    runs = spark.createDataFrame([("s1", "f", 1.0, 10.0), ("s1", "g", 2.0, 10.0), ("s2", "f", 1.0, 10.0), ("s2", "h", 1.0, 0.0)],
                                 "system string, file_id string, time double, audio_sec double")
    table = diarize.system_table(errors, runs)
    assert rows_of(table, "system", "n_files", "RTF", "DER") == [("s1", 2, 0.15, 25.0), ("s2", 2, 0.2, 0.0)]
    best = {r.metric: (r.best, r.value) for r in report.winners(table, "system", ["DER", "RTF"]).collect()}
    assert best == {"DER": ("s2", 0.0), "RTF": ("s1", 0.15)}


# speech -----------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    truth = spark.createDataFrame([("1", "Мама мыла раму."), ("2", "да"), ("3", "!"), ("4", "x")], "seg_id string, text string")
    hyp = spark.createDataFrame([("m", "1", "мама мыла", 1.0, 2.0), ("m", "2", "нет да", 1.0, 2.0), ("m", "3", "x", 1.0, 9.0), ("m", "9", "x", 1.0, 9.0)],
                                "model string, seg_id string, hypothesis string, time double, audio_sec double")
    scored = speech.scored_segments(hyp, truth)
    row = speech.error_rates(scored).first()
    assert (row.WER, row.n_samples, row.RTF) == (50.0, 2, 0.5)
    assert row.CER == round((edits("мама мыла раму", "мама мыла") + edits("да", "нет да")) / 16 * 100, 2)
    worst = speech.worst_segments(scored, 1).first()
    assert worst.seg_id == "2" and worst.wer == 1.0
    assert rows_of(speech.segment_report(scored), "seg_id", "wer") == [("1", 33.3), ("2", 100.0)]


def test_word_edits(spark):
    rng = random.Random(2)
    pairs = [(" ".join(rng.choices("a bb ё дом x".split(), k=rng.randint(0, 9))), " ".join(rng.choices("a bb ё дом y".split(), k=rng.randint(0, 9)))) for _ in range(80)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.e for r in df.select("i", speech.word_edits("a", "b").alias("e")).orderBy("i").collect()]
    assert got == [edits(a.split(), b.split()) for a, b in pairs]


# sampling ---------------------------------------------------------------------------------------

def labelled(spark, sizes, copies=False):
    rows = [(i, "same" if copies else f"text {i}", k) for k, n in sizes.items() for i in range(ord(k) * 10000, ord(k) * 10000 + n)]
    return rows, spark.createDataFrame(rows, "row_id long, text string, label string")


def key(row, seed=42):
    i, t, k = row
    return hashlib.sha1("\x1f".join([k, t, str(i), str(seed)]).encode()).hexdigest()


@pytest.mark.parametrize("copies", [False, True])
def test_hold_out_and_folds(spark, copies):
    rows, df = labelled(spark, {"a": 500, "b": 33, "c": 2}, copies)
    want = {}
    for k in "abc":
        group = sorted((r for r in rows if r[2] == k), key=lambda r: (key(r), r[0]))
        for n, r in enumerate(group, 1):
            want[r[0]] = (n, "test" if n <= int(len(group) * 0.2 + 0.5) else "train", (n - 1) % 5 + 1)
    got = {r.row_id: r.split for r in split.hold_out(df, "label").collect()}
    assert got == {i: w[1] for i, w in want.items()}
    ranks = {r.row_id: r["rank"] for r in split.rank_in_class(df, "label").collect()}
    assert ranks == {i: w[0] for i, w in want.items()}
    folds = split.k_folds(df, "label")
    assert {r.row_id: r.fold for r in folds.collect()} == {i: w[2] for i, w in want.items()}
    manifest = split.fold_manifest(folds, "label")
    split.check_manifest(manifest, df, "label", 5)
    with pytest.raises(ValueError, match="folds"):
        split.check_manifest(manifest, df, "label", 4)
    with pytest.raises(ValueError, match="rows"):
        split.check_manifest(manifest, df.limit(10), "label", 5)
    other = df.withColumn("text", F.when(F.col("row_id") == rows[0][0], "new").otherwise(F.col("text")))
    with pytest.raises(ValueError, match="match"):
        split.check_manifest(manifest, other, "label", 5)


def test_oversample(spark):
    rows, df = labelled(spark, {"a": 20, "b": 7, "c": 1})
    out = split.oversample(df, "label")
    assert rows_of(split.oversample_summary(out, "label"), "label", "before", "after", "synthetic") == [
        ("a", 20, 20, 0), ("b", 7, 20, 13), ("c", 1, 20, 19)]
    per_row = {r["row_id"]: r["count"] for r in out.where("label = 'b'").groupBy("row_id").count().collect()}
    assert sorted(per_row.values()) == [2] + [3] * 6 and len(per_row) == 7


def test_bootstrap(spark):
    rows, df = labelled(spark, {"a": 2000, "b": 1})
    out = split.bootstrap(df, "label", 8)
    stats = out.groupBy("bag", "label").agg(F.sum("weight").alias("w"), F.count_if(F.col("weight") == 0).alias("z"))
    for r in stats.collect():
        if r.label == "a":
            assert 1800 < r.w < 2200 and 650 < r.z < 820
        else:
            assert r.w >= 1
    assert rows_of(out, "row_id", "bag", "weight") == rows_of(split.bootstrap(df, "label", 8), "row_id", "bag", "weight")
    assert split.out_of_bag(out).where("weight > 0").count() == 0


def test_review_samples(spark):
    rows, df = labelled(spark, {"a": 30, "b": 3})
    got = split.class_samples(df, "label", 5)
    assert rows_of(labels.label_counts(got, "label"), "label", "n") == [("a", 5), ("b", 3)]
    pairs = split.paired_samples(df, "label", "b", "a", 4).collect()
    assert [(r["rank"], r.label) for r in pairs][:4] == [(1, "b"), (1, "a"), (2, "b"), (2, "a")]
    with pytest.raises(ValueError, match="zz"):
        split.paired_samples(df, "label", "a", "zz")
    long = df.withColumn("text", F.repeat("text", 5))
    assert split.dry_run_sample(long).count() == 5


def test_segment_sample(spark):
    files = spark.createDataFrame([("a", 60_000), ("b", 5_000), ("c", 30_000), ("d", 10_000)], "file string, length_ms long")
    known = spark.createDataFrame([("none",)], "id string")
    got = split.sample_segments(files, 4, 10_000, known).collect()
    assert len(got) <= 12 and not any(r.file == "b" for r in got)
    assert [r.file for r in got[:3]] == ["a", "c", "d"]
    sizes = {"a": 60_000, "c": 30_000, "d": 10_000}
    for f in sizes:
        starts = sorted(r.start_ms for r in got if r.file == f)
        assert all(y - x >= 10_000 for x, y in zip(starts, starts[1:]))
        assert all(0 <= s <= sizes[f] - 10_000 for s in starts)
    again = split.sample_segments(files, 4, 10_000, spark.createDataFrame([(got[0].id,)], "id string"))
    assert got[0].id not in {r.id for r in again.collect()}


# ensembles --------------------------------------------------------------------------------------

def probs_of(spark, stack, names):
    m, n, c = stack.shape
    return spark.createDataFrame(
        [(i, f"m{k}", names[j], float(stack[k, i, j])) for k in range(m) for i in range(n) for j in range(c)],
        "row_id long, model string, label string, proba double")


def test_votes(spark):
    rng = np.random.default_rng(4)
    stack = np.round(rng.dirichlet(np.ones(4), size=(3, 60)), 1)
    stack[:, 0] = 0.25
    names = np.array(list("abcd"))
    df = probs_of(spark, stack, names)
    mean = np.round(stack.mean(0), 12)
    soft = {r.row_id: (r.y_pred, r.confidence) for r in ensemble.soft_vote(df).collect()}
    top = {r.row_id: (r.y_pred, r.confidence) for r in ensemble.max_vote(df).collect()}
    hard = {r.row_id: (r.y_pred, r.confidence) for r in ensemble.hard_vote(df).collect()}
    for i in range(60):
        assert soft[i] == (names[mean[i].argmax()], pytest.approx(mean[i].max()))
        assert top[i] == (names[stack[:, i].max(0).argmax()], stack[:, i].max())
        votes = np.bincount(stack[:, i].argmax(1), minlength=4)
        best = max(range(4), key=lambda j: (votes[j], mean[i, j], -j))
        assert hard[i] == (names[best], pytest.approx(mean[i].max()))
    with pytest.raises(ValueError):
        ensemble.vote(df, "median")


def test_vote_fixture(spark):
    df = probs_of(spark, np.array([[[.6, .4], [.5, .5]], [[.1, .9], [.5, .5]]]), "ab")
    assert [(r.y_pred, r.confidence) for r in ensemble.soft_vote(df).orderBy("row_id").collect()] == [("b", 0.65), ("a", 0.5)]
    assert [r.y_pred for r in ensemble.hard_vote(df).orderBy("row_id").collect()] == ["b", "a"]


def test_alignment_and_meta(spark):
    df = spark.createDataFrame([(1, "m0", "a", .7), (1, "m0", "x", .3), (1, "m1", "b", 1.0)], "row_id long, model string, label string, proba double")
    names = spark.createDataFrame([("a",), ("b",)], "label string")
    full = ensemble.align_labels(df, names)
    assert rows_of(full, "model", "label", "proba") == [("m0", "a", .7), ("m0", "b", 0.0), ("m1", "a", 0.0), ("m1", "b", 1.0)]
    assert ensemble.meta_features(full, ["m1", "m0"], ["a", "b"]).first().meta == [0.0, 1.0, .7, 0.0]
    raw = spark.createDataFrame([(1, "m", "a", 1.0), (1, "m", "b", 3.0)], "row_id long, model string, label string, score double")
    assert [r.proba for r in ensemble.softmax_scores(raw).orderBy("label").collect()] == pytest.approx([0.11920292, 0.88079708])
    meta = ensemble.stacker_metadata("logreg", ["m0", "m1"], ["a", "b"])
    assert ensemble.check_stacker(meta, ["m1", "m0", "q"]) == ["m0", "m1"]
    with pytest.raises(ValueError, match="expects models"):
        ensemble.check_stacker(meta, ["m0"])
    with pytest.raises(ValueError, match="has not seen"):
        ensemble.check_stacker(meta, ["m0", "m1"], spark.createDataFrame([("zz",)], "y_true string"))


def test_routing(spark):
    df = spark.createDataFrame([(1, "non_spam", .9, "hr", .7), (2, "spam", .6, "hr", .9), (3, "non_spam", .95, "it", .85)],
                               "row_id long, spam_pred string, spam_conf double, intent_pred string, intent_conf double")
    routed = ensemble.route_calls(df, 0.8)
    assert rows_of(routed, "row_id", "y_pred", "confidence", "route") == [(1, "hr", .7, "review"), (2, "spam", .6, "review"), (3, "it", .85, "auto")]
    assert tuple(ensemble.routing_counts(routed).first()) == (1, 2)


def test_model_comparison(spark):
    stack = np.array([[[.9, .1], [.2, .8], [.6, .4]], [[.7, .3], [.6, .4], [.1, .9]]])
    truth = spark.createDataFrame([(0, "a", "1"), (1, "b", "0"), (2, "b", "0")], "row_id long, y_true string, is_synthetic string")
    costs = spark.createDataFrame([("m0", "x", 3.0, 1.0, 10), ("m1", "y", 6.0, 2.0, None)], "model string, family string, infer_ms_total double, model_size_mb double, n_params long")
    probs = probs_of(spark, stack, "ab")
    table = {r.model: r for r in ensemble.compare_models(probs, truth, costs, threshold=0.75).collect()}
    assert set(table) == {"m0", "m1", "Ensemble (soft)", "Ensemble (max)", "Ensemble (hard)"}
    assert (table["m0"].accuracy, table["m0"].errors, table["m0"].infer_ms_per_sample) == (pytest.approx(2 / 3), 1, 1.0)
    soft = table["Ensemble (soft)"]
    assert (soft.accuracy, soft.component_count, soft.n_params, soft.model_size_mb, soft.infer_ms_per_sample) == (1.0, 2, None, 3.0, 3.0)
    assert (table["m0"].high_conf_share, table["m0"].high_conf_errors) == (pytest.approx(2 / 3), 0)
    assert table["m0"].confidence_p90 == pytest.approx(np.quantile([.9, .8, .6], .9))
    assert ensemble.leaderboard(spark.createDataFrame([tuple(r) for r in table.values()], "model string, method string, n_samples long, errors long, accuracy double, f1_weighted double, precision_weighted double, recall_weighted double, a double, b double, c double, d long, p double, family string, infer_ms_total double, model_size_mb double, n_params long, component_count long, infer_ms_per_sample double")).first().accuracy == 1.0
    ext = ensemble.external_evaluation(ensemble.all_votes(probs), truth)
    got = {(r.model, r.subset): (r.n, r.errors) for r in ext.collect()}
    assert got[("m1", "all")] == (3, 1) and got[("m1", "synthetic")] == (1, 0) and got[("m1", "real")] == (2, 1)


# reports ----------------------------------------------------------------------------------------

def test_pareto_and_best(spark):
    df = spark.createDataFrame([("m1", 1.0, .5), ("m2", 2.0, .7), ("m3", 3.0, .7), ("m4", 4.0, .6), ("m5", 5.0, .9), ("m0", 0.0, .99)],
                               "model string, infer_ms_per_sample double, f1_weighted double")
    assert rows_of(report.pareto_frontier(df), "model") == [("m1",), ("m2",), ("m5",)]
    runs = spark.createDataFrame([("m", .8, None, 128), ("m", .8, .9, 256), ("m", .7, .95, 64), ("n", None, .5, 64)],
                                 "model string, f1_weighted double, accuracy double, max_length int")
    assert rows_of(report.best_per_model(runs), "model", "max_length") == [("m", 256), ("n", 64)]
    strict = {r.model: (r.f1_weighted, r.accuracy, r.max_length) for r in report.best_per_model(runs, strict_reference=True).collect()}
    assert strict == {"m": (.8, .9, 256), "n": (None, .5, 64)}
    assert not report.is_descending("WER") and report.is_descending("F1")


def test_records(spark):
    preds = spark.createDataFrame([("m", "a", "a"), ("m", "a", "b"), ("m", "b", "b")], "model string, y_true string, y_pred string")
    runs = spark.createDataFrame([("m", "baseline", 1.26, 9.0, "low", "")], "model string, group string, train_sec double, infer_ms_total double, resource string, notes string")
    r = report.result_records(preds, runs).first()
    assert (r.f1_weighted, r.train_sec, r.infer_ms_per_sample) == (0.6667, 1.3, 3.0)
    assert r.report["a"]["support"] == 2
    assert report.confusion_examples(preds.withColumns({"row_id": F.lit(1), "confidence": F.lit(0.5)}), "a", "b").count() == 1


# neighbours -------------------------------------------------------------------------------------

@pytest.mark.parametrize("blocks", [7, 1000])
def test_neighbours(spark, blocks):
    rng = np.random.default_rng(0)
    train, query = np.round(rng.normal(size=(40, 5)), 1), np.round(rng.normal(size=(25, 5)), 1)
    train[10:22] = train[3]  # copies of one vector
    query[0] = train[3]

    def table(x):
        return spark.createDataFrame([(i, f"l{i % 3}", [float(v) for v in r]) for i, r in enumerate(x)], "id long, label string, v array<double>").select("id", "label", neighbours.sparse("v"))

    near = neighbours.nearest(table(query), table(train), 5, blocks)
    got = rows_of(near, "id", "rank", "near_id")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit(query) @ unit(train).T, 9)
    want = sorted((i, n + 1, int(j)) for i in range(25) for n, j in enumerate(sorted(range(40), key=lambda j: (-sims[i, j], j))[:5]))
    assert got == want
    assert neighbours.vote_of_neighbours(near).count() == 25


@pytest.mark.parametrize("seed", range(3))
def test_long_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pairs = [("".join(rng.choices("abё c", k=rng.randint(0, 90))), "".join(rng.choices("abё c", k=rng.randint(0, 90)))) for _ in range(60)]
    for band, block in ((64, 512), (1, 1), (2, 7), (5, 16)):
        monkeypatch.setattr(speech, "FIRST_BAND", band)
        monkeypatch.setattr(speech, "BLOCK", block)
        assert [speech.edit_distance(a, b) for a, b in pairs] == [edits(a, b) for a, b in pairs]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(99, None, "a")], "i int, a string, b string")
    got = df.select("i", speech.char_edits("a", "b").alias("c"), speech.word_edits("a", "b").alias("w")).orderBy("i").collect()
    assert [r.c for r in got] == [edits(a, b) for a, b in pairs] + [None]
    words = [[x.split(" ") if x else [] for x in p] for p in pairs]
    assert [r.w for r in got] == [edits(a, b) for a, b in words] + [None]


def test_band_widens(monkeypatch):
    """Long pairs of few and of many edits: a narrow band is enough for the first, and grows for the second."""
    rng = random.Random(4)
    a = [rng.randrange(5) for _ in range(3000)]
    b = [x for x in a if rng.random() < 0.95]
    b = b[:200] + [9] * 150 + b[200:]
    widths = []
    banded = speech._banded
    monkeypatch.setattr(speech, "_banded", lambda masks, n, b, k: widths.append(k) or banded(masks, n, b, k))
    assert speech.edit_distance(a, b) == edits(a, b)
    assert speech.edit_distance([1] * 4000, [2] * 4000) == 4000 and widths[-1] == 4000 and len(widths) < 6
    far = a[::-1]
    assert speech.edit_distance(a, far) == edits(a, far)


def test_neighbours_of_odd_rows(spark):
    """Copies, empty vectors, negative numbers, text ids, and a term that all rows hold; blocks of every size."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random((70, 30)) < 0.2, rng.normal(size=(70, 30)), 0.0)
    x[:, 0] = 1.0
    x[10:30] = x[10]
    x[40:44] = 0.0
    ids = [f"r{i:02d}" for i in range(70)]

    def vectors(rows):
        data = [(ids[i], i % 2, ([int(p) for p in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]])) for i in rows]
        return spark.createDataFrame(data, "id string, label int, vec struct<indices: array<int>, values: array<double>>")

    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm > 0, norm, 1)
    sims = np.round(unit @ unit.T, 9)
    for blocks in (1, 7, 4096):
        for own in (False, True):
            got = {}
            for r in neighbours.nearest(vectors(range(70)), vectors(range(70)), 3, blocks, skip_self=own).collect():
                got.setdefault(r.id, []).append((r["rank"], r.near_id, r.label, r.similarity))
            for i in range(70):
                order = sorted((j for j in range(70) if not own or j != i), key=lambda j: (-sims[i, j], j))[:3]
                want = [(k + 1, ids[j], j % 2, pytest.approx(sims[i, j], abs=1e-9)) for k, j in enumerate(order)]
                assert sorted(got[ids[i]]) == want
    assert neighbours.nearest(vectors([]), vectors(range(5)), 3).count() == 0
    assert neighbours.nearest(vectors(range(5)), vectors([]), 3).count() == 0


def test_neighbours_open_few_blocks():
    """A block whose bound is below the k-th best stays closed, one that can tie only if its ids come first."""
    best = neighbours._Best(3, 2)
    rows = pa.table({"near_id": [1, 2, 3], "label": ["a", "b", "c"]})
    best.meet(np.array([0, 1]), np.array([[0.9, 0.8, 0.1], [0.5, 0.5, 0.5]]), 100, rows)
    assert best.open(np.array([0.7, 0.5, 0.0]), 200).tolist() == [2]
    assert best.open(np.array([0.8, 0.5, 0.0]), 50).tolist() == [0, 1, 2]
    assert best.open(np.array([0.81, 0.4, 0.0]), 200).tolist() == [0, 2]
    queries = neighbours.Sparse(np.array([0, 2]), np.array([3, 5]), np.array([2.0, -1.0]))
    block = neighbours.Sparse(np.array([0, 1, 3]), np.array([3, 3, 5]), np.array([0.5, -2.0, -0.5]))
    tops, postings = neighbours._index(block)
    assert neighbours._bounds(queries, tops).tolist() == [1.5]
    assert neighbours._similarities(queries, tops, postings, 2).tolist() == [[1.0, -3.5]]


def test_neighbours_in_dense_products(monkeypatch):
    """Terms of many rows are multiplied as matrices, in pieces, next to rare terms and numbers that are not finite."""
    rng = np.random.default_rng(5)
    x, y = (np.where(rng.random((n, 40)) < np.linspace(0.02, 1, 40), rng.normal(size=(n, 40)), 0.0) for n in (30, 50))
    x[3, 39], y[4, 39] = np.nan, np.nan
    y[5] = 0.0
    packed = []
    for m in (x, y):
        row, place = np.nonzero(m)
        packed.append(neighbours.Sparse(np.append(0, np.cumsum((m != 0).sum(axis=1))), place, m[row, place]))
    used = []
    product = neighbours._product
    monkeypatch.setattr(neighbours, "_product", lambda a, b: used.append(b.shape[0]) or product(a, b))
    monkeypatch.setattr(neighbours, "DENSE_CELLS", 300)
    monkeypatch.setattr(neighbours, "DENSE", 5)
    got = neighbours._similarities(packed[0], *neighbours._index(packed[1]), 50)
    met = ((x != 0) @ np.isnan(y).T) | (np.isnan(x) @ (y != 0).T)
    want = np.where(met, np.nan, np.nan_to_num(x) @ np.nan_to_num(y).T)
    assert np.allclose(got, want, equal_nan=True)
    assert len(used) > 1 and max(used) <= 6 and 10 < sum(used) < 40


def test_unit_of_a_long_vector(spark):
    """The length is summed once a row: a text of 60,000 terms takes no longer than so many short ones."""
    import time

    row = spark.range(1).select(F.struct(F.sequence(F.lit(1), F.lit(60_000)).alias("indices"),
                                         F.array_repeat(F.lit(2.0), 60_000).alias("values")).alias("vec"))
    begin = time.time()
    length = F.aggregate("vec.values", F.lit(0.0), lambda a, x: a + x * x)
    assert row.select(neighbours.unit()).select(length).first()[0] == pytest.approx(1)
    assert time.time() - begin < 20


def test_best_of_copies():
    """A block full of equal rows gives the first of them, whichever block comes first."""
    best = neighbours._Best(2, 3)
    rows = pa.table({"near_id": list(range(100)), "label": ["x"] * 100})
    for before in (100, 0):
        best.meet(np.array([1]), np.full((1, 100), 0.5 + before * 1e-13), before, rows)
    assert best.places[1].tolist() == [0, 1, 2] and best.sims[1].tolist() == [0.5] * 3 and not np.isfinite(best.sims[0]).any()


def test_copies_of_one_row_spread(spark):
    """A class of one row against many: its copies are made by many tasks, and numbered like those of any other row."""
    rows = spark.range(1, 30_001).select(F.col("id").alias("row_id"), F.lit("text").alias("text"), F.lit("big").alias("label"))
    rows = rows.unionByName(spark.createDataFrame([(0, "alone", "small")], "row_id long, text string, label string"))
    out = split.oversample(rows, "label").where("label = 'small'").withColumn("task", F.spark_partition_id())
    made = out.groupBy("task").count().collect()
    assert sum(r["count"] for r in made) == 30_000 and len(made) >= 4 and max(r["count"] for r in made) <= 15_000
    numbers = out.agg(F.min("copy_no"), F.max("copy_no"), F.count_distinct("copy_no")).first()
    assert tuple(numbers) == (0, 29_999, 30_000)


@pytest.mark.parametrize("scale", [0.05, 0.7, 3.0, 40.0])
def test_temperature_by_derivatives(spark, scale):
    """The bracketed Newton steps end where a fine grid has its lowest loss, or at the end of the range."""
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(300, 4))
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    truth = [rng.choice(4, p=x) for x in p]
    data = [(i, f"l{j}", float(scores[i, j] * scale), f"l{truth[i]}") for i in range(300) for j in range(4)]
    logits = spark.createDataFrame(data, "row_id int, label string, logit double, y_true string").cache()
    t = calibrate.fit_temperature(logits)

    def loss(t):
        z = scores * scale / t
        return float(np.mean(np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(300), truth]))

    grid = np.linspace(0.1, 10.0, 991)
    assert 0.1 <= t <= 10.0 and loss(t) <= min(map(loss, grid)) + 1e-10
    dense = calibrate.dense_logits(logits)
    value, slope, bend = calibrate._slopes(dense, 2.0)
    step = 1e-5
    near = [loss(1 / (0.5 + d)) for d in (-step, 0.0, step)]
    assert value == pytest.approx(near[1]) and slope == pytest.approx((near[2] - near[0]) / (2 * step), rel=1e-4, abs=1e-7)
    assert bend == pytest.approx((near[2] - 2 * near[1] + near[0]) / step**2, rel=1e-2, abs=1e-3)


def test_the_band_of_an_edit_distance_follows_the_lengths(monkeypatch):
    from talkmill.operators import speech

    rng = random.Random(8)
    a = "".join(rng.choices("abcdefgh ", k=6600))
    b = "".join(x for i, x in enumerate(a) if i % 11 != 10)
    seen = []

    class Mask(int):
        """A mask that tells how many rows a window keeps of it."""

        def __rshift__(self, n):
            return Mask(int(self) >> n)

        def __and__(self, full):
            seen.append(full.bit_length())
            return int(self) & full

    masks = {x: Mask(sum(1 << i for i, y in enumerate(a) if x == y)) for x in set(a)}
    # 600 edits, all of them for the length: the band holds the 600 rows between the corners and little more.
    assert speech.edit_distance(a, b) == 600
    assert speech._banded(masks, len(a), b, len(a) // 8) == 600 and max(seen) < 1000

    def brute(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            prev = row
        return prev[-1]

    monkeypatch.setattr(speech, "FIRST_BAND", 1)
    monkeypatch.setattr(speech, "BLOCK", 3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(2))
        assert speech.edit_distance(a, b) == brute(a, b) == speech.edit_distance(b, a)


def test_an_empty_text_has_no_character_error_rate(spark, tmp_path):
    from talkmill.plans.speech_queries import cer_pairs

    spark.createDataFrame([(1, ""), (2, "abcdefghijklmnopqrstuv"), (3, None), (4, "ab")], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = {r["doc_id"]: (r["char_edits"], r["cer"]) for r in cer_pairs(spark, str(tmp_path)).collect()}
    assert got[1][0] == 0 and np.isnan(got[1][1])
    assert got[2] == (2, 9.090909) and got[3] == (None, None) and got[4] == (0, 0.0)


def test_rough_products_leave_few_pairs(monkeypatch):
    """Only pairs that may be among the best are summed in double precision, and the best are those of all pairs."""
    rng = np.random.default_rng(6)
    x, y = (np.where(rng.random((n, 200)) < np.linspace(0.02, 0.6, 200), rng.random((n, 200)), 0.0) for n in (40, 900))
    y[100:130] = y[3]
    x[7] = 0.0
    packed, files = [], {}
    for m in (x, y):
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        row, place = np.nonzero(m)
        packed.append(neighbours.Sparse(np.append(0, np.cumsum((m != 0).sum(axis=1))), place, m[row, place]))
    monkeypatch.setattr(neighbours, "read_file", files.get)
    want, got = neighbours._Best(40, 5), neighbours._Best(40, 5)
    rows = pa.table({"near_id": list(range(450)), "label": ["x"] * 450})
    at, none = np.arange(40), (np.empty(0, int), np.empty(0, int))
    for before in (0, 450):
        block = packed[1].take(np.arange(before, before + 450))
        tops, postings = neighbours._index(block)
        files["b-cells"] = neighbours._by_row(block)
        want.meet(at, neighbours._similarities(packed[0], tops, postings, 450), before, rows)
        line, row, sims = neighbours._pairs(packed[0], tops, postings, "b", block.first[1:], got.sims[:, -1], 5, none)
        assert len(line) < 40 * 450 / 8 and np.allclose(sims, (x @ y[before : before + 450].T)[line, row], atol=1e-15)
        got.add(at, line, row, sims, before, rows)
    assert (got.places == want.places).all() and (got.sims == want.sims).all()
    # Queries without numbers are as near to all rows: nothing is gained by looking at pairs.
    empty = neighbours.Sparse(np.zeros(41, int), np.empty(0, int), np.empty(0))
    assert neighbours._pairs(empty, tops, postings, "b", block.first[1:], np.full(40, -np.inf), 5, none) is None
