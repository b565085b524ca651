import math
import random
import re
import zlib

import numpy as np
import pytest

from tollgate.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string, predicted string"
RNG = random.Random(3)
SYLLABLES = "er an the on ti re un que ion ei la os ha sh ed ing".split()


def _prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize()


def _bad(rng, n):
    kind = rng.randrange(3)
    words = _prose(rng, n).split()
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " ".join(["spam"] * n) if kind == 1 else " | ".join(words[:: 2])


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", "a", "b") for i, t in rows], SCHEMA)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def good_and_bad(spark):
    rng = random.Random(5)
    rows = [(i, (_bad if i % 6 == 0 else _prose)(rng, rng.randrange(15, 200))) for i in range(700)]
    return _docs(spark, rows), _labels(spark, [(i, int(i % 6 != 0), 0) for i in range(700)])


def test_quality_on_held_out_rows(spark, good_and_bad):
    docs, labels = good_and_bad
    got = quality.classify(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(700) if _held(i)} and len(got) == 700
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 != 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_quality_edges(spark, good_and_bad):
    docs, labels = good_and_bad
    odd = _docs(spark, [(None, "x"), (1, None), (2, ""), (3, " \n\n "), (4, "word " * 40000), (4, "word " * 40000), (5, "\x00🙂")])
    got = quality.classify(odd.unionByName(docs), labels.unionByName(_labels(spark, [(None, 1, 0), (3, None, None), (3, 7, 7)]))).where("score is null or score < 0 or score > 1")
    assert got.count() == 0 and quality.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).select("score").collect()} and quality.classify(odd, labels.limit(0)).count() == 7


def test_pieces_of_the_classifier():
    x = np.random.default_rng(0).standard_normal((6, 4))
    z = quality.fourier(x, features=20_000, width=2.0)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 8)
    assert np.abs(z @ z.T - exact).max() < 0.03
    knots, levels = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0, 0.6, 0.2, 0.4, 1]))
    assert (np.diff(levels) > 0).all() and levels[1] == pytest.approx(0.4) and knots[1] == pytest.approx(2.0)
    assert len(quality.statistics("One two. Three!")) == len(quality.STATS) == len(quality.statistics(None))


RUDE = ("idiot", "moron", "zorkfix", "zorklam")


@pytest.fixture(scope="module")
def rude_and_kind(spark):
    rng, rows = random.Random(9), []
    for i in range(600):
        words = _prose(rng, rng.randrange(8, 160)).split()
        if i % 5 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        rows.append((i, " ".join(words)))
    return rows, _docs(spark, rows), _labels(spark, [(i, 1, int(i % 5 == 0)) for i in range(600)])


def test_toxicity_on_held_out_rows(spark, rude_and_kind):
    rows, docs, labels = rude_and_kind
    got = toxicity.classify(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    hits = [r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]
    assert len(got) == 600 and np.mean(hits) > 0.95 and all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_reads_whole_texts_and_edges(spark, rude_and_kind, monkeypatch):
    monkeypatch.setattr(toxicity, "STEP", 500)
    rows, docs, labels = rude_and_kind
    long_kind = " ".join([rows[1][1]] * 60)
    odd = _docs(spark, [(9001, long_kind), (9002, long_kind + " you idiot moron idiot"), (None, "idiot"), (9004, None), (9005, ""), (9006, "!!! ---"), (9007, "ok"), (9007, "ok")])
    got = toxicity.classify(docs.unionByName(odd), labels.unionByName(_labels(spark, [(None, 1, 1), (9007, None, None)]))).where("doc_id > 9000 or doc_id is null").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and by[9002]["score"] > by[9001]["score"] and by[9002]["predicted"] == 1 and by[9005]["predicted"] == 0 and by[9004]["score"] == by[9005]["score"]
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    none = toxicity.classify(odd, labels.limit(0)).collect()
    assert len(none) == 8 and all(r["predicted"] == 0 for r in none)


def _naive_logit(net, words, text):
    """Convolution and pooling one position, filter and component at a time."""
    table = words.table_rows()
    numbers = [*(words[w] for w in re.findall(r"\w+", text.lower())), 0]
    vectors = [net.table[table[n]].sum(0).astype(float) for n in [*numbers, 0, 0]]
    pooled = []
    for f, b in zip(net.filters, net.bias):
        for k in range(toxicity.FILTERS):
            pooled.append(max(sum(float(vectors[i + j] @ f[j][:, k]) for j in range(len(f))) for i in range(len(numbers))) + b[k])
    return sum(max(0.0, x) * o for x, o in zip(pooled, net.out)) + net.shift


def test_scores_equal_naive_convolution(rude_and_kind):
    rows, _, _ = rude_and_kind
    texts = [t for _, t in rows[:80]]
    net = toxicity.train(texts, np.array([float(i % 5 == 0) for i in range(80)]), epochs=2)
    net.limits = {"": 0.3}
    words = toxicity.Words()
    numbers = [words.numbers(t) for t in [*texts[:12], "", "one"]]
    got = net.logits(numbers, net.embed(words.table_rows()))
    want = [_naive_logit(net, words, t) for t in [*texts[:12], "", "one"]]
    assert np.allclose(got, want, atol=1e-4)
    cut = np.log(toxicity.CUT / (1 - toxicity.CUT))
    assert np.allclose(net.scores([*texts[:12], None, "one"]), [1 / (1 + np.exp(-(z - 0.3 + cut))) for z in want], atol=1e-4)


def test_gradient_equals_differences():
    words = toxicity.Words()
    docs = [words.numbers(_prose(RNG, n)) for n in (5, 9, 30, 2)]
    rows, y = words.table_rows(), np.array([1.0, 0.0, 1.0, 0.0])
    net = toxicity.new_net(1)
    for part in ("table", "out"):
        setattr(net, part, getattr(net, part).astype(float))
    net.filters, net.bias = [f.astype(float) for f in net.filters], [b + 0.05 for b in net.bias]

    def loss():
        z = np.maximum(net.pooled(docs, net.embed(rows))[0], 0) @ net.out + net.shift
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    d = toxicity.gradient(net, docs, rows, y)
    rng = np.random.default_rng(0)
    spots = [(net.filters[k], d["filters"][k], tuple(rng.integers(0, n) for n in net.filters[k].shape)) for k in range(3) for _ in range(6)]
    spots += [(net.bias[k], d["bias"][k], (int(rng.integers(toxicity.FILTERS)),)) for k in range(3)] + [(net.out, d["out"], (int(i),)) for i in rng.integers(0, len(net.out), 6)]
    for x, g, at in spots:
        x[at] += 1e-5
        up = loss()
        x[at] -= 2e-5
        down = loss()
        x[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(float(g[at]), abs=2e-4)
    for j in range(1, len(d["ids"]), 7):  # the first is the padding row, which is held at zero
        at = int(d["ids"][j]), j % toxicity.DIM
        net.table[at] += 1e-5
        up = loss()
        net.table[at] -= 2e-5
        down = loss()
        net.table[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(float(d["table"][j][at[1]]), abs=2e-4)


def test_samples_are_bounded_and_hold_repeated_ids(spark, rude_and_kind, monkeypatch):
    rows, docs, labels = rude_and_kind
    twice = docs.unionByName(_docs(spark, [(i, t) for i, t in rows]))  # each row again
    other = docs.unionByName(_docs(spark, [(i, "another text of " + t) for i, t in rows]))
    plain = toxicity._samples(docs, labels, "toxic")
    again = toxicity._samples(twice, labels, "toxic")
    assert {t: x[0] for t, x in plain.items()} == {t: x[0] for t, x in again.items()}
    assert all(len(toxicity._samples(other, labels, "toxic")[t][0]) == 2 * len(x[0]) for t, x in plain.items())
    assert sum(len(x[0]) for x in plain.values()) == sum(not _held(i) for i, _ in rows)
    monkeypatch.setattr(toxicity, "TRAIN_EACH", 7)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 2000)
    few = toxicity._samples(docs, labels, "toxic")
    assert all(x[0] == plain[t][0][: len(x[0])] for t, x in few.items()) and len(few[0][0]) <= 7
    for t, x in few.items():
        sizes = [len(v.encode()) for v in plain[t][0]]
        assert sum(sizes[: len(x[0])]) <= 2000 and (len(x[0]) == 7 and t != 2 or sum(sizes[: len(x[0]) + 1]) > 2000)


def test_toxicity_learns_from_all_labelled_rows(spark, rude_and_kind, monkeypatch):
    rows, docs, labels = rude_and_kind
    # A word that the start never sees, in enough labelled rows beyond it.
    more = [(i, rows[i % 600][1] + (" vexquor vexquor" if i % 2 else " pleasant")) for i in range(1000, 1600) if rows[i % 600][0] % 5]
    all_docs, all_labels = docs.unionByName(_docs(spark, more)), labels.unionByName(_labels(spark, [(i, 1, i % 2) for i, _ in more]))
    real = toxicity._samples
    monkeypatch.setattr(toxicity, "_samples", lambda d, x, label: real(docs, labels, label))
    monkeypatch.setattr(toxicity, "SHARD", 200)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(all_docs, all_labels).where("held_out and doc_id >= 1000").collect()}
    assert len(got) > 100 and np.mean([p == i % 2 for i, p in got.items()]) > 0.9


def test_limits_equal_the_driver_s(spark, rude_and_kind):
    rows, docs, labels = rude_and_kind
    net = toxicity.train([t for _, t in rows[:80]], np.array([float(i % 5 == 0) for i in range(80)]), epochs=1)
    words, y = toxicity.Words(), np.array([float(i % 5 == 0) for i, _ in rows])
    numbers = [words.numbers(t) for _, t in rows]
    z, spoken = net.logits(numbers, net.embed(words.table_rows())), np.array(words.languages(numbers))
    low = np.repeat(net.logits([np.zeros(0, np.int32)], net.embed(words.table_rows())), 1 + len(z) // 20)
    got = toxicity._limits(net, docs.join(labels, "doc_id").selectExpr("text", "cast(toxic as double) as y"))
    assert got[""] == pytest.approx(toxicity.limit(np.concatenate([z, low]), np.concatenate([y, np.zeros(len(low))])), abs=1e-4)
    assert all(got[k] == pytest.approx(toxicity.limit(z[spoken == k], y[spoken == k]), abs=1e-4) for k in got if k)


def _plain_fit(stats, y, half):
    """Ridge and isotonic calibration in plain numpy, by all rows at once."""
    center, spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    z = quality.fourier((stats - center) / spread)

    def ridge(rows):
        w = len(z[0])
        return np.linalg.solve(z[rows].T @ z[rows] + quality.RIDGE * len(rows) * np.diag([1.0] * (w - 1) + [1e-6]) + 1e-9 * np.eye(w), z[rows].T @ y[rows])

    h = [np.flatnonzero(half == k) for k in (0, 1)]
    raw = np.where(half == 0, z @ ridge(h[1]), z @ ridge(h[0]))
    at = np.clip((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = np.unique(at)
    x = quality.LOW + (bins + 0.5) * (quality.HIGH - quality.LOW) / quality.BINS
    n, mean = np.array([(at == b).sum() for b in bins], float), np.array([y[at == b].mean() for b in bins])
    # The isotonic level of a bin is the least, over later ends, of the greatest, over earlier starts, mean.
    level = [min(max((n[a : e + 1] * mean[a : e + 1]).sum() / n[a : e + 1].sum() for a in range(i + 1)) for e in range(i, len(bins))) for i in range(len(bins))]
    return center, spread, ridge(np.arange(len(y))), x, n, np.array(level)


def test_quality_equals_a_plain_fit(spark, good_and_bad):
    docs, labels = good_and_bad
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = [i for i in range(700) if not _held(i)]
    halves = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("i", "pmod(xxhash64(i), 2) as h").collect()}
    stats = np.array([quality.statistics(texts[i]) for i in ids])
    center, spread, beta, x, n, level = _plain_fit(stats, np.array([float(i % 6 != 0) for i in ids]), np.array([halves[i] for i in ids]))
    knots, levels = [], []
    for v in np.unique(level):
        on = level == v
        knots.append((x[on] * n[on]).sum() / n[on].sum())
        levels.append(v)
    for i in range(700):
        raw = float(quality.fourier((np.array([quality.statistics(texts[i])]) - center) / spread) @ beta)
        steep = 1 / (1 + math.exp(-4 * (raw - 0.5)))
        assert got[i] == pytest.approx(0.99 * np.interp(raw, knots, levels) + 0.01 * steep, abs=1e-4), i


def test_windows_equal_one_pass():
    net = toxicity.new_net()
    words = toxicity.Words()
    docs = [words.numbers(_prose(RNG, n)) for n in (1, 7, 900, 3)] + [np.zeros(0, np.int32)]
    embedded = net.embed(words.table_rows())
    whole = net.logits(docs, embedded)
    old, toxicity.STEP = toxicity.STEP, 50
    try:
        assert np.allclose(net.logits(docs, embedded), whole, atol=1e-5)
    finally:
        toxicity.STEP = old


def test_limit_and_language():
    assert toxicity.limit(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])) == 1.5
    assert toxicity.limit(np.array([1.0]), np.array([1])) is None
    w = toxicity.Words()
    assert w.languages([w.numbers("der Hund und die Katze"), w.numbers("le chat et les chiens"), w.numbers("qwe rty")]) == ["de", "fr", "other"]
