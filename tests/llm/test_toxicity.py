import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumeria.llm import toxicity as T


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in T.start(5, rng).items()}
    words, chars = rng.standard_normal((6, T.WORD_DIM)), rng.standard_normal((6, T.CHAR_DIM))
    ids = rng.integers(1, 6, (4, 7)).astype(np.int32)
    ids[0, 4:] = 0
    y, w = np.array([0.0, 1, 1, 0]), np.full(4, 0.25)
    _, g, d_word, d_char = T.gradients(p, words, chars, ids, y, w)

    def slope(array, at):
        old = array[at]
        loss = []
        for step in (1e-5, -1e-5):
            array[at] = old + step
            loss.append(T.gradients(p, words, chars, ids, y, w)[0])
        array[at] = old
        return (loss[0] - loss[1]) / 2e-5

    for k, x in g.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            assert abs(slope(p[k], at) - x[at]) < 1e-6, k
    for array, x in ((words, d_word), (chars, d_char)):
        for _ in range(8):
            at = (rng.integers(1, 6), rng.integers(0, array.shape[1]))
            assert abs(slope(array, at) - x[at]) < 1e-6


def test_windows_cover_all_words():
    for n in (0, 1, T.WINDOW - 1, T.WINDOW, T.WINDOW + 1, 5 * T.STRIDE, 1000):
        w = T.windows_of(np.arange(1, n + 1))
        assert set(w[w > 0].tolist()) == set(range(1, n + 1)) and (np.diff(w[:, 0]) == T.STRIDE).all()


def corpus(n, seed, bad=("vileword", "nastyterm", "badthing")):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    out = []
    for _ in range(n):
        t = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randint(1, 3)):
                t.insert(r.randint(0, len(t)), r.choice(bad) + r.choice(["", ".", "s"]))
        out.append((" ".join(t), int(toxic)))
    return out


def known(n, seed):
    return [(T.tokens_of(t), y) for t, y in corpus(n, seed)]


def slow_scores(model, texts):
    """One word after the other, with Python floats: both directions, attention, the highest window."""
    p = {k: v.astype(float).tolist() for k, v in model.p.items()}
    u, sig = T.UNITS, lambda x: 1 / (1 + math.exp(-x))
    times = lambda v, m, lo, hi: [sum(a * row[j] for a, row in zip(v, m)) for j in range(lo, hi)]

    def vector(w):
        plain = w.strip(T.PUNCTUATION)
        flat, _ = T.grams([plain])
        char = [sum(p["char"][g][j] for g in flat) / len(flat) for j in range(T.CHAR_DIM)]
        return times(p["word"][model.vocabulary.get(plain, 0) if w else 0] + char, p["in"], 0, 6 * u)

    def states(words, rec, shift):
        h, out = [0.0] * u, []
        for w in words:
            g = [a + b for a, b in zip(vector(w), p["bias_in"])][shift : shift + 3 * u]
            z = [sig(a + b) for a, b in zip(g[:u], times(h, rec, 0, u))]
            r = [sig(a + b) for a, b in zip(g[u : 2 * u], times(h, rec, u, 2 * u))]
            c = [math.tanh(a + b) for a, b in zip(g[2 * u :], times([x * y for x, y in zip(r, h)], rec, 2 * u, 3 * u))]
            h = [(1 - a) * b + a * d for a, b, d in zip(z, h, c)]
            out.append(h)
        return out

    scores = []
    for text in texts:
        ws, best = T.tokens_of(text), -math.inf
        if not ws:
            scores.append(model.prior)
            continue
        for at in range(0, max(1, len(ws) - T.WINDOW + T.STRIDE), T.STRIDE):
            real = len(ws[at : at + T.WINDOW])
            window = ws[at : at + T.WINDOW] + [""] * (T.WINDOW - real)
            f, b = states(window, p["rec_f"], 0), states(window[::-1], p["rec_b"], 3 * u)[::-1]
            both = [x + y for x, y in zip(f, b)]
            weight = [math.exp(sum(a * s for a, s in zip(p["att"], h))) for h in both[:real]]
            pooled = [sum(w * h[j] for w, h in zip(weight, both)) / sum(weight) for j in range(2 * u)]
            best = max(best, sum(a * b for a, b in zip(p["out"], pooled)) + p["bias"][0])
        scores.append(sig(model.scale * best + model.shift))
    return scores


def test_scores_against_plain_loops():
    model = T.train(known(60, 8))
    texts = [t for t, _ in corpus(6, 9)] + [None, "", "x", "one two." * 40, "w1 " * T.WINDOW, "\u4e2d\u6587" * 90]
    assert np.allclose(model.scores(texts), slow_scores(model, texts), atol=1e-4)


def test_grams_against_loops():
    words = ["", "a", "ab", "abcd", "vileword", "\u00e9\U0001f600" * 9]
    flat, begin = T.grams(words)
    at = begin.tolist() + [len(flat)]
    alone = [T.grams([w])[0].tolist() for w in words]
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == alone
    assert [len(x) for x in alone] == [sum(max(1, len(w) + 3 - n) for n in T.GRAMS) for w in words]


def test_long_words_are_read_to_their_end():
    word = "".join(chr(97 + i % 26) for i in range(1000))
    pieces = T.tokens_of(word)
    assert all(len(x) <= T.LONG for x in pieces) and all(any(word[i : i + T.SHARED] in x for x in pieces) for i in range(989))
    assert T.tokens_of("a" * 64 + "kill") != T.tokens_of("a" * 64 + "love")
    model = T.train(known(500, 1))
    low, high = model.scores(["q" * 400, "q" * 200 + "vileword" + "q" * 200])
    assert low < high


def test_learns_from_labels_of_whole_texts():
    model = T.train(known(500, 1))
    held = corpus(300, 2)
    score, label = model.scores([t for t, _ in held]), np.array([y for _, y in held])
    assert ((score >= 0.5) == label).mean() > 0.97
    clean = " ".join(f"w{i % 300}" for i in range(5000))
    low, high = model.scores([clean, clean + " vileword nastyterm"])  # wherever it stands in a long text
    assert low < 0.5 < high


def test_memo_does_not_change_scores(monkeypatch):
    model = T.train(known(120, 3))
    texts = [t for t, _ in corpus(60, 4)]
    want = model.scores(texts)
    monkeypatch.setattr(T, "MEMO_WORDS", 50)
    again = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(want, again, atol=1e-5)


def test_frames_and_edges(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(150, 5))] + [(900, None), (901, ""), (902, " \n"), (None, "x"), (0, "again")]
    labels = [(i, y) for i, (_, y) in enumerate(corpus(150, 5))] + [(900, 1), (901, None), (None, 1), (5000, 0), (3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("toxic", F.lit(9))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(docs, known)
    out = docs.select("doc_id", T.score_documents(docs, model).alias("s")).collect()
    assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out)
    assert len({r.s for r in out if r.doc_id in (900, 901, 902)}) == 1
    nothing = T.fit(docs, known.where("toxic = 0"))
    assert {r.s for r in docs.select(T.score_documents(docs, nothing).alias("s")).collect()} == {0.0}
    assert T.fit(docs, known.limit(0)).prior == 0.0
    assert docs.limit(0).select(T.score_documents(docs, model).alias("s")).count() == 0


def test_sample_is_bounded_and_leaves_out_what_is_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for r in docs.select("doc_id", T.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    sample = T.training_sample(docs, labels, per_class=6)
    assert len(sample) <= 12 and {y for _, y in sample} == {0, 1}
    text = {" ".join(T.tokens_of(r.text)) for r in docs.collect()}
    assert all(" ".join(w) in text for w, _ in sample)
    small = T.training_sample(docs, labels, per_class=50, most_bytes=9000)
    assert all(sum(len(" ".join(w)) for w, y in small if y == k) <= 9000 for k in (0, 1)) and len(small) < 100


def test_an_id_with_several_texts_gives_one_of_them_always(spark):
    rows = [(1, "first text"), (1, "second text"), (1, None), (2, "clean")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    got = [T.training_sample(spark.createDataFrame(r, "doc_id long, text string").repartition(3), labels) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and sorted(y for _, y in got[0]) == [0, 1]
