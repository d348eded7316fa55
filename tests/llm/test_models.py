"""The two trained models: measures against brute force, and held-out quality."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from stallwright.llm import lm_score as lm
from stallwright.llm import weak_quality as wq

from ..conftest import SMALL
from .brute import ODD, documents, empty, odd, words

MIDDLE = "/root/testdata/sf0.01"


def base_scores(rows):
    c = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*words(t, True), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        tokens = [*words(t, True), None]
        yield i, len(tokens), sum(x in c for x in tokens), n, sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)


def test_base_scores_and_held_out_gain(spark):
    d = documents()
    got = {r.doc_id: r for r in lm.op5_gated_lm(spark, SMALL).collect()}
    for i, n, known, total, base in base_scores(list(zip(d.doc_id, d.text))):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_awkward_rows(spark):
    rows = lm.score_documents(odd(spark)).collect()
    assert len(rows) == len(ODD)
    want = sorted(((i or 0), n, known, total) for i, n, known, total, _ in base_scores([(i, t) for i, t, *_ in ODD]))
    assert sorted(((r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens) for r in rows) == want
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert lm.score_documents(empty(spark)).count() == 0
    held = odd(spark).where("doc_id is not null").where(lm.held_out())
    assert all(r.n_known == 0 for r in lm.score_documents(held).collect())  # nothing to learn from


def test_scores_against_brute_force(spark, monkeypatch):
    """Word by word in plain numpy, with the fitted weights; words of the model, middling
    words and the tail all occur."""
    from xxhash import xxh64_intdigest

    made = {}
    for name in ("build_lexicon", "fit"):
        real = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda *a, real=real, name=name: made.setdefault(name, real(*a)))
    for name, value in (("VOCABULARY", 400), ("MODEL_WORDS", 60), ("CLASSES", 8)):
        monkeypatch.setattr(lm, name, value)
    d = documents().head(60)
    rows = [*zip(d.doc_id.tolist(), d.text), (10**6, None), (10**6, "")]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    train = [words(t, True) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for t in train for x in t)
    least = min(n for n in range(2, 10**4) if sum(x >= n for x in c.values()) <= 400)
    lex, w = made["build_lexicon"], made["fit"]
    assert sorted(lex.count[1:]) == sorted(x for x in c.values() if x >= least)
    known = {x for x, n in c.items() if n >= least}
    tail_total, tail_distinct = sum(n for x, n in c.items() if x not in known), len(c.keys() - known)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def score(text):
        state, before, out, h = np.zeros(lm.HIDDEN), lm.END, 0.0, lm.HIDDEN
        for x in [*words(text, True), None]:
            gx, gh = w["input"][lex.input_of[before]].astype(float), state @ w["update"]
            z, r = sigmoid(gx[:h] + gh[:h]), sigmoid(gx[h : 2 * h] + gh[h : 2 * h])
            state = (1 - z) * np.tanh(gx[2 * h :] + r * gh[2 * h :]) + z * state
            before = lm.END if x is None else int(lex.lookup(np.array([xxh64_intdigest(x)], np.uint64).view(np.int64))[0])
            p = np.exp(state @ w["classes"] + w["class_bias"])
            group = lex.class_of[before]
            out += np.log10(p[group] / p.sum())
            if before < lex.model:
                own = [i for i in range(lex.model) if lex.class_of[i] == group]
                q = np.exp(w["words"][own] @ state + w["word_bias"][own])
                out += np.log10(q[own.index(before)] / q.sum())
            elif x in known:
                out += np.log10(c[x] / sum(lex.count[lex.model :]))
            else:
                out += np.log10((c[x] + 0.5) / (tail_total + 0.5 * (tail_distinct + 1)))
        return out

    text_of = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(score(text_of[r.doc_id]), rel=1e-4)


def test_least_count(spark):
    rng = np.random.default_rng(1)
    counts = [*rng.integers(1, 9, 300).tolist(), *(1 << rng.integers(0, 60, 40)).tolist(), 7, 70_000, 70_001]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(counts)], "h long, c long")
    for n in (0, 1, 20, 45, 120, 400):
        want = next((x for x in sorted({y + d for y in counts for d in (0, 1)}) if x >= 2 and sum(c >= x for c in counts) <= n))
        assert lm.least_count(df, n) == max(want, 2)
    assert lm.least_count(df.limit(0), 5) == 2


def lexicon():
    h = np.arange(1, 41, dtype=np.int64) * 1000
    return lm.Lexicon(h, np.arange(1, 41), np.append([30], np.arange(80, 40, -1)), 5000, 60)


def test_gradients():
    lex, rng = lexicon(), np.random.default_rng(0)
    w = {k: x.astype(np.float64) + rng.standard_normal(x.shape) * 0.1 for k, x in lm.new_weights(lex).items()}
    ids = [np.append(rng.integers(1, 42, n), lm.END) for n in (9, 4, 6, 1)]
    lanes = lm.Lanes(ids, 2)

    def loss(grads=None):
        states, _, trace = lm.run_window(w, lex, lanes, 0, 99, np.zeros((lanes.active[0], lm.HIDDEN)), keep=True)
        target = np.concatenate([lanes.target[t, : lanes.active[t]] for t in range(len(lanes.active))])
        logp, slope = lm.output(w, lex, states, target, grads)
        if grads is not None:
            lm.backward(w, slope, trace, grads)
        return -logp.sum()

    grads = {k: np.zeros_like(x) for k, x in w.items()}
    loss(grads)
    for k in w:
        at = np.unravel_index(np.abs(grads[k]).argmax(), w[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grads[k][at], rel=1e-4)


def test_state_is_carried_over_windows(monkeypatch):
    lex, rng = lexicon(), np.random.default_rng(0)
    w = lm.new_weights(lex)
    ids = [np.append(rng.integers(1, 41, n), lm.END) for n in (50, 7, 0, 23)]
    whole = lm.score_texts(w, lex, ids)
    monkeypatch.setattr(lm, "SCORE_STEPS", 3)
    monkeypatch.setattr(lm, "LANES", 2)
    assert np.allclose(lm.score_texts(w, lex, ids), whole, rtol=1e-4)


def test_probabilities_sum_to_one():
    lex = lexicon()
    w = lm.new_weights(lex)
    logp, _ = lm.output(w, lex, np.tile(np.linspace(-1, 1, lm.HIDDEN, dtype=np.float32), (lex.model + 1, 1)), np.append(np.arange(lex.model), lex.tail))
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-3)  # the middling class is empty here


def test_labellers_recover_their_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.7
    votes = np.zeros((20_000, len(wq.LABELLERS)), int)
    for j in range(votes.shape[1]):
        right = rng.random(20_000) < 0.75 + 0.02 * j
        votes[:, j] = np.where(rng.random(20_000) < 0.3, 0, np.where(right == good, 1, -1))
    counts = np.bincount([wq.pattern_of(v) for v in votes.tolist()], minlength=wq.PATTERNS).astype(float)
    posterior, _ = wq.fit_labellers(counts)
    guess = posterior[[wq.pattern_of(v) for v in votes.tolist()]] >= 0.5
    assert (guess == good).mean() > 0.93


def slow_votes(text):
    """The labellers' rules, from the text's words and characters."""
    import re

    text = text or ""
    w = words(text)
    n = len(w)
    if not n:
        return [-1] + [0] * 8
    chars = re.sub(r"[\x20\x09-\x0d]", "", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    low = words(text, True)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    per_line = n / (sum(text.count(x) for x in ".!?") or 0.5)
    rules = [
        (n < 3, n >= 60, 1, n),
        (sum(c in "#*$%&|<>" for c in chars) > 0.1 * n, sum(c in "#*$%&|<>" for c in chars) <= 0.01 * n, 1, n),
        (share := sum("A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" for c in chars) / len(chars), None, 5, n),
        (marked := sum(chr(x[-1]) in "!#*$%&|" for x in w) / n, None, 5, n),
        (len(lines) - len(set(lines)) > 0.4 * (text.count("\n") + 1), len(lines) == len(set(lines)), 30, n),
        (len(covered) > 0.4 * n, len(covered) <= 0.05 * n, 20, n),
        (len(set(low)) / n < 0.2, len(set(low)) / n > 0.35, 40, n),
        (not 2 <= per_line <= 80, 4 <= per_line <= 40, 30, n),
        (sum(x in wq.FUNCTION_WORDS for x in low) / n < 0.03, sum(x in wq.FUNCTION_WORDS for x in low) / n > 0.1, 20, n),
    ]
    rules[2] = (share > 0.25, share < 0.12, 5, n)
    rules[3] = (marked > 0.15, marked < 0.03, 5, n)
    return [0 if n < enough else -1 if bad else int(good) for bad, good, enough, n in rules]


def slow_em(patterns):
    """Expectation-maximisation text by text, no table of patterns."""
    kinds = Counter(map(tuple, patterns))
    total = sum(kinds.values())
    good = {v: 1 / (1 + np.exp(-(0.5 * sum(v) - 2 * v.count(-1) + 1))) for v in kinds}
    for _ in range(300):
        rate = {}
        for j in range(9):
            for y, (bad, well) in enumerate(((0.6, 0.4), (0.02, 0.98))):
                no = 0.05 * total * bad + sum(n * (good[v] if y else 1 - good[v]) for v, n in kinds.items() if v[j] == -1)
                yes = 0.05 * total * well + sum(n * (good[v] if y else 1 - good[v]) for v, n in kinds.items() if v[j] == 1)
                rate[j, y, -1], rate[j, y, 0], rate[j, y, 1] = no / (no + yes), 1.0, yes / (no + yes)
        share = min(max(sum(n * good[v] for v, n in kinds.items()) / total, 0.05), 0.95)
        odds = {v: np.log(share / (1 - share)) + sum(np.log(rate[j, 1, x] / rate[j, 0, x]) for j, x in enumerate(v)) for v in kinds}
        new = {v: 1 / (1 + np.exp(-min(max(x, -50), 50))) for v, x in odds.items()}
        if max(abs(new[v] - good[v]) for v in kinds) < 1e-9:
            break
        good = new
    return new


def slow_features(text):
    w, out = words(text), Counter()
    for x, n in Counter(words(text, True)).items():
        out[zlib.crc32(x) % wq.BUCKETS] += n
    for kind, values in ((b"first", [x[0] for x in w]), (b"last", [x[-1] for x in w]), (b"size", [min(len(x), 40) for x in w])):
        for x, n in Counter(values).items():
            out[zlib.crc32(b"%d" % x, zlib.crc32(kind)) % wq.BUCKETS] += n
    norm = np.sqrt(sum(out.values()))
    return {k: np.sqrt(n) / norm for k, n in out.items()}


def test_quality_against_brute_force(spark, monkeypatch):
    made, real = [], wq.fit
    monkeypatch.setattr(wq, "fit", lambda docs: made.append(real(docs)) or made[0])
    rows = [*zip(documents().doc_id.tolist(), documents().text), (10**6, None), (10**6 + 1, "  \n"), (10**6 + 2, "Ünï x!")]
    got = {r.doc_id: r for r in wq.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    votes = {i: slow_votes(t) for i, t in rows}
    posterior = slow_em(votes.values())
    w = made[0][1]
    for i, t in rows:
        assert got[i].pattern == wq.pattern_of(votes[i]), i
        assert got[i].label_probability == pytest.approx(posterior[tuple(votes[i])], abs=1e-6)
        x = slow_features(t)
        want = 1 / (1 + np.exp(-(sum(w[k] * v for k, v in x.items()) + w[-1]))) if x else 0.0
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].kept == (got[i].score >= wq.KEEP)


def test_quality_against_labels(spark):
    labels = pd.read_parquet(f"{MIDDLE}/labels.parquet").set_index("doc_id")
    got = wq.op10_weak_quality(spark, MIDDLE).toPandas().set_index("doc_id").join(labels, how="inner")
    assert got[got.quality == 1].kept.mean() > 0.95
    assert got[got.quality == 0].kept.mean() < 0.2


def test_quality_awkward_rows(spark):
    rows = wq.classify(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert [r.kept for r in rows if r.doc_id in (3, 4, 5)] == [False] * 3
    assert wq.classify(empty(spark)).count() == 0


def test_all_training_texts_are_fitted(spark, monkeypatch):
    """Each text has a word of its own; a word's row of the input table moves only
    where a text with it is learned from, and no held-out one is."""
    from xxhash import xxh64_intdigest

    made = {}
    for name in ("build_lexicon", "fit"):
        real = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda *a, real=real, name=name: made.setdefault(name, real(*a)))
    rows = [(i, f"own{i} own{i} and some more words") for i in range(60)] + [(60, "own60 " * 25_000)]
    assert len(lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == len(rows)
    lex, w = made["build_lexicon"], made["fit"]
    start = lm.new_weights(lex)["input"]
    for i, _ in rows:
        word = int(lex.lookup(np.array([xxh64_intdigest(f"own{i}")], np.uint64).view(np.int64))[0])
        if zlib.crc32(str(i).encode()) % 5 == 1:
            assert word == lex.tail
        else:
            assert np.abs(w["input"][word] - start[word]).max() > 1e-4, i


def test_long_text_takes_room_for_itself_alone():
    import tracemalloc

    ids = [np.full(1_000_000, 3), *[np.full(60, 2)] * 400, np.zeros(1, int)]
    tracemalloc.start()
    lanes = lm.Lanes(ids, 384)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 * sum(map(len, ids))  # not the steps of the long text times the lanes
    assert lanes.active.sum() == sum(map(len, ids)) and lanes.active[-1] == 1
    start = windows = 0
    while start < len(lanes.active):
        start, windows = lanes.stop(start, 32, 12_288), windows + 1
    assert windows < 90  # not one for each 32 words of the long text


def test_words_met_are_those_of_words_of():
    """Split, lowered and numbered in Arrow, in slices, too; each run of texts is bounded."""
    import numpy as np
    import pyarrow as pa
    from stallwright.llm.common import words_of
    from xxhash import xxh64_intdigest

    texts = ["", None, " ", " a B\tc\x0b\x0cD\r\n", "É é x \x1f y\x85z", "a", "  q", " lead", "trail ", "A B b"]
    for column in (pa.array(texts), pa.array(["zz zz", *texts]).slice(1), pa.array([], pa.string())):
        length, numbers, hashes = lm.words_met(column)
        want = [words_of(t, lower=True) for t in column.to_pylist()]
        assert length.tolist() == [len(x) for x in want]
        assert hashes.view(np.uint64)[numbers].tolist() == [xxh64_intdigest(w) for x in want for w in x]
        runs = list(lm.text_runs(column))
        assert [i for a, n in runs for i in range(a, a + n)] == list(range(len(column)))


def test_words_met_in_runs_of_a_batch(monkeypatch):
    """Runs from the middle of a batch without nulls lose no word."""
    import pyarrow as pa
    from stallwright.llm.common import words_of
    from xxhash import xxh64_intdigest

    monkeypatch.setattr(lm, "CHUNK_BYTES", 700)
    texts = [f"Ab {i} cd " * (i % 9) for i in range(1_000)]
    column, met = pa.array(texts), []
    for a, n in lm.text_runs(column):
        length, numbers, hashes = lm.words_met(column.slice(a, n))
        assert length.tolist() == [len(t.split()) for t in texts[a : a + n]]
        met += hashes.astype("u8")[numbers].tolist()
    assert met == [xxh64_intdigest(w) for t in texts for w in words_of(t, lower=True)]


def test_sums_of_runs():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, most in ((1, 1), (16, 1), (17, 1), (50, 3), (8_192, 4_000), (8_192, 20)):
        x = np.sort(rng.zipf(1.3, n) % most)
        starts, rows = np.flatnonzero(np.diff(x, prepend=-1)), rng.standard_normal((n, 72)).astype(np.float32)
        assert np.allclose(lm.sums_of_runs(rows, starts), np.add.reduceat(rows.astype(float), starts), atol=1e-3)


def test_products_and_updates_go_in_parts():
    """The fit works on a core's cache of rows and weights at a time; results are those of the whole."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 255, 256, 1_000):
        a, b = rng.standard_normal((n, 24)), rng.standard_normal((n, 63))
        assert np.allclose(lm.over_tokens(a, b), a.T @ b)
    w = {"input": rng.standard_normal((1_500, 72)).astype(np.float32), "word_bias": rng.standard_normal(7).astype(np.float32)}
    fitting, grad = lm.Fitting({k: x.copy() for k, x in w.items()}, None, 0.03), {k: rng.standard_normal(x.shape).astype(np.float32) for k, x in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, 4):
        for k, g in grad.items():
            fitting.grads[k] += g
            m[k], v[k] = 0.9 * m[k] + 0.1 * g / 50, 0.999 * v[k] + 0.001 * (g / 50) ** 2
            w[k] = w[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        fitting._update(50)
        assert all(np.allclose(fitting.w[k], w[k], atol=1e-5) and not fitting.grads[k].any() for k in w)
