"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of ``WINDOW`` words at every ``STRIDE`` words, to its end.
A word of more than ``LONG`` characters (text without spaces, say) enters as several: pieces of that
length that overlap, to its end. Each word enters as two vectors: one of the word (for words seen
often enough in training) and the mean of the vectors of its character n-grams (hashed), so
spellings never seen still say something. A GRU reads the window forwards, another one backwards; attention weighs the states
and a linear layer scores the sum. A text's score is that of its highest window, calibrated.

Training is in numpy, by back-propagation through time, on a bounded sample of labelled rows: of
each label at most ``per_class``, in the order of a hash of the id, until their texts add up to
``most_bytes`` (longer texts are not trained on). All windows of a chosen text are used. The label belongs to the text, not the window: after a pass in which each window has
its text's label, positives are the best windows of toxic texts under the model so far, and
negatives the best and some other windows of clean texts. Labels hold errors, so toxic texts in
which no window scores above half after two passes are set aside, up to a share. Labels, language,
source and id are not inputs. The sample and the weights (about 2 MB, broadcast) are bounded by
these parameters.

Scoring is a map over all rows: whole texts, no shuffle. What a word adds to the gates is
computed once for each distinct word of a batch and kept in a bounded memo.

Nulls and texts without words score the mean label. Repeated rows stay repeated; an
empty table gives no rows. Of several texts with one id, training takes the one whose hash (then
text) is smallest; of several labels of an id, the largest; null ids and labels other than 0 and 1
are not trained on. Other columns of either table play no part. Without labels of both kinds, every text scores the mean label (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.common import give_back, saved, ship

WINDOW, STRIDE = 24, 16
UNITS, WORD_DIM, CHAR_DIM = 8, 8, 8
VOCABULARY, MIN_COUNT, BUCKETS = 20_000, 4, 16_384
#: Labelled rows of each label that training takes at most, and bytes of their texts.
PER_CLASS, MOST_BYTES, SEED = 1200, 32 << 20, 7
#: Characters of the pieces of a longer word, and how many of them two pieces share.
LONG, SHARED = 48, 12
#: Sizes of the character n-grams.
GRAMS = (3, 4, 5)
#: The largest share of toxic labels that training may set aside as errors.
DOUBTED = 0.25
#: Rounds of training, steps in each (unless they take more passes than the most), windows in a step; one text in ASIDE is kept for calibration.
ROUNDS, STEPS, MOST_PASSES, BATCH, ASIDE = 6, 100, 8, 96, 5
#: What a step takes off the vectors of words and n-grams, so that rare ones don't learn single texts by heart.
DECAY = 5e-3
#: Windows scored at once; distinct words kept by a worker; words of the texts that it scores together.
CHUNK, MEMO_WORDS, TOGETHER = 4096, 120_000, 100_000
PUNCTUATION = ".,;:!?'\"()[]{}|*#$%&-_<>"


def tokens_of(text: str | None) -> list[str]:
    words = text.lower().split() if text else []
    if words and max(map(len, words)) > LONG:
        return [w[i : i + LONG] for w in words for i in range(0, max(1, len(w) - SHARED), LONG - SHARED)]
    return words


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word, its ends marked: (those of all words in order, where each word's begin)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = "".join([f"^{w}$".ljust(max(GRAMS), "\0") for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    held = np.maximum(size, max(GRAMS))
    first = np.cumsum(held) - held
    count = [np.maximum(1, size - n + 1) for n in GRAMS]  # a word shorter than n is one n-gram
    begin = np.cumsum(sum(count)) - sum(count)
    flat, at = np.empty(int(sum(count).sum()), np.int32), begin
    rolled, n = code, 1
    for own, k in zip(count, GRAMS):
        while n < k:
            rolled = rolled[:-1] * np.uint32(0x01000193) + code[n:]
            n += 1
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = ((mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32)
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        flat[np.repeat(at, own) + step] = bucket[np.repeat(first, own) + step]
        at = at + own
    return flat, begin


def windows_of(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) ids; 0 fills the last one."""
    count = 1 + max(0, -(-(len(ids) - WINDOW) // STRIDE))
    full = np.zeros((count - 1) * STRIDE + WINDOW, dtype=np.int32)
    full[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(full, WINDOW)[::STRIDE]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -80, 80)))


def start(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, d = UNITS, WORD_DIM + CHAR_DIM
    w = {"word": (n_words, WORD_DIM), "char": (BUCKETS, CHAR_DIM), "in": (d, 6 * h), "rec_f": (h, 3 * h), "rec_b": (h, 3 * h), "att": (2 * h,), "out": (2 * h,)}
    p = {k: (rng.standard_normal(s) * (0.3 if len(s) > 1 and k not in ("word", "char") else 0.2)).astype(np.float32) for k, s in w.items()}
    return p | {"bias_in": np.zeros(6 * h, np.float32), "bias": np.zeros(1, np.float32)}


def gates_of(p: dict, words: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """What words with these vectors add to the gates of both directions."""
    return np.concatenate([words, chars], axis=1) @ p["in"] + p["bias_in"]


def gru(gates: np.ndarray, ids: np.ndarray, rec: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
    """States (time, windows, UNITS). gates: rows of 3 * UNITS (update, reset, candidate) by id."""
    n, steps = ids.shape
    h, u = np.zeros((n, UNITS), gates.dtype), UNITS
    out = np.empty((steps, n, u), gates.dtype)
    for t in reversed(range(steps)) if backward else range(steps):
        x = gates[ids[:, t]]
        r = h @ rec[:, : 2 * u]
        r += x[:, : 2 * u]
        np.negative(r, out=r)
        np.exp(r, out=r)
        r += 1
        np.reciprocal(r, out=r)
        z, r = r[:, :u], r[:, u:]
        c = (r * h) @ rec[:, 2 * u :]
        c += x[:, 2 * u :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, h, z, r, c))
        step = np.subtract(c, h, out=out[t])
        step *= z
        step += h
        h = step
    return out


def forward(p: dict, gates: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows. gates: (words, 6 * UNITS); row 0 is the filler."""
    u = UNITS
    kf, kb = ([], []) if keep is not None else (None, None)
    f = gru(np.ascontiguousarray(gates[:, : 3 * u]), ids, p["rec_f"], False, kf)
    b = gru(np.ascontiguousarray(gates[:, 3 * u :]), ids, p["rec_b"], True, kb)
    score = f @ p["att"][:u] + b @ p["att"][u:]
    score = np.where(ids.T > 0, score, np.float32(-30))
    a = np.exp(score - score.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.concatenate([np.einsum("tn,tnu->nu", a, f), np.einsum("tn,tnu->nu", a, b)], axis=1)
    if keep is not None:
        keep.update(f=f, b=b, kf=kf, kb=kb, a=a, pooled=pooled)
    return pooled @ p["out"] + p["bias"][0]


def _gru_back(rec: np.ndarray, keep: list, d_out: np.ndarray, ids: np.ndarray, d_gates: np.ndarray) -> np.ndarray:
    """Adds to d_gates (time, windows, 3 * UNITS); returns the gradient of rec."""
    u = UNITS
    d_rec, dh = np.zeros_like(rec), np.zeros_like(d_out[0])
    for t, h, z, r, c in reversed(keep):
        dh = dh + d_out[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        drh = dc @ rec[:, 2 * u :].T
        dr = drh * h * r * (1 - r)
        d_gates[t] = np.concatenate([dz, dr, dc], axis=1)
        d_rec[:, 2 * u :] += (r * h).T @ dc
        d_rec[:, : 2 * u] += h.T @ d_gates[t][:, : 2 * u]
        dh = dh * (1 - z) + drh * r + d_gates[t][:, : 2 * u] @ rec[:, : 2 * u].T
    return d_rec


def gradients(p: dict, words: np.ndarray, chars: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray, np.ndarray]:
    """Loss, gradients of the parameters but the embeddings, and those of the words' two vectors. ids index words and chars."""
    u = UNITS
    keep: dict = {}
    logit = forward(p, gates_of(p, words, chars), ids, keep)
    prob = sigmoid(logit)
    loss = float((weight * -(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum())
    d = (weight * (prob - y)).astype(words.dtype)
    a, f, b = keep["a"], keep["f"], keep["b"]
    g = {"out": keep["pooled"].T @ d, "bias": d.sum(keepdims=True)}
    d_pool = d[:, None] * p["out"]
    d_a = (f * d_pool[:, :u]).sum(axis=2) + (b * d_pool[:, u:]).sum(axis=2)
    d_score = a * (d_a - (a * d_a).sum(axis=0))
    d_score = np.where(ids.T > 0, d_score, 0)
    g["att"] = np.concatenate([np.tensordot(d_score, f, 2), np.tensordot(d_score, b, 2)])
    d_gates = np.zeros((*ids.T.shape, 6 * u), words.dtype)
    g["rec_f"] = _gru_back(p["rec_f"], keep["kf"], a[..., None] * d_pool[:, :u] + d_score[..., None] * p["att"][:u], ids, d_gates[..., : 3 * u])
    g["rec_b"] = _gru_back(p["rec_b"], keep["kb"], a[..., None] * d_pool[:, u:] + d_score[..., None] * p["att"][u:], ids, d_gates[..., 3 * u :])
    flat, order = d_gates.reshape(-1, 6 * u), np.argsort(ids.T.ravel(), kind="stable")
    seen, first = np.unique(ids.T.ravel()[order], return_index=True)
    by_word = np.zeros((len(words), 6 * u), words.dtype)
    by_word[seen] = np.add.reduceat(flat[order], first)
    x = np.concatenate([words, chars], axis=1)
    g["in"], g["bias_in"] = x.T @ by_word, by_word.sum(axis=0)
    d_x = by_word @ p["in"].T
    return loss, g, d_x[:, :WORD_DIM], d_x[:, WORD_DIM:]


def inputs(vocabulary: dict[str, int], words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What enters for words: their ids, their n-grams, and where each word's begin. Row 0 is the filler."""
    plain = ["", *(w.strip(PUNCTUATION) for w in words)]
    ids = np.fromiter((vocabulary.get(w, 0) for w in plain), np.int64, len(plain))
    ids[0] = 0
    return ids, *grams(plain)


def means(char: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    count = np.diff(np.append(begin, len(flat)))[:, None]
    return (np.add.reduceat(char[flat], begin) / count).astype(char.dtype)


class Rows(dict):
    """word -> its row of gates, from 1 on; words that are new are also listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self) + 1
        return n


def added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): the sums of the rows that go to each place."""
    return np.stack([np.bincount(at, column, n) for column in rows.T], axis=1).astype(np.float32)


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.n += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)
            if k in ("word", "char"):
                self.p[k] *= 1 - DECAY


class Model:
    """Trained weights with the vocabulary; scores texts. ``prior``: the score of texts without words, or of all where nothing could be trained."""

    def __init__(self, p: dict | None, vocabulary: dict[str, int], scale: float = 1.0, shift: float = 0.0, prior: float = 0.0):
        self.p, self.vocabulary, self.scale, self.shift, self.prior = p, vocabulary, scale, shift, prior
        self.reset()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "gates")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.reset()

    def reset(self) -> None:
        self.row = Rows()
        self.gates = np.zeros((0, 6 * UNITS), np.float32)

    def logits(self, tokens: list[list[str]]) -> list[np.ndarray]:
        """For each text the logits of all its windows."""
        if len(self.row) > MEMO_WORDS:
            self.reset()
        row = self.row.__getitem__
        cut = [windows_of(np.fromiter(map(row, ts), np.int32, len(ts))) for ts in tokens]
        if self.row.new or not len(self.gates):
            ids, flat, begin = inputs(self.vocabulary, self.row.new)
            gates = gates_of(self.p, self.p["word"][ids], means(self.p["char"], flat, begin))
            self.gates = np.concatenate([self.gates, gates[1 if len(self.gates) else 0 :]])
            self.row.new = []
        all_ = np.concatenate(cut)
        out = np.concatenate([forward(self.p, self.gates, np.ascontiguousarray(all_[i : i + CHUNK])) for i in range(0, len(all_), CHUNK)])
        return np.split(out, np.cumsum([len(c) for c in cut])[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.p is None:
            return np.full(len(texts), self.prior)
        out, group, size = [], [], 0
        for i, t in enumerate(texts):
            group.append(tokens_of(t))
            size += len(group[-1])
            if size > TOGETHER or i == len(texts) - 1:
                out += [float(x.max()) if ts else np.nan for ts, x in zip(group, self.logits(group))]
                group, size = [], 0
        out = np.array(out)
        return np.where(np.isnan(out), self.prior, sigmoid(self.scale * out + self.shift))


def train(samples: list[tuple[list[str], int]], prior: float | None = None, seed: int = SEED) -> Model:
    """samples: for each text its words and its label. prior: the share of label 1 where the sample's is not it."""
    labels = np.array([y for _, y in samples])
    if len(samples) == 0 or labels.min() == labels.max():
        return Model(None, {}, prior=float(labels.mean()) if len(samples) else 0.0)
    rng = np.random.default_rng(seed)
    prior = float(labels.mean()) if prior is None else prior
    aside = rng.permutation(len(samples)) % ASIDE == 0
    if min((labels[aside] == y).sum() for y in (0, 1)) < 8:
        aside[:] = False
    count: dict[str, int] = {}
    for tokens, _ in samples:
        for t in {t.strip(PUNCTUATION) for t in tokens}:
            count[t] = count.get(t, 0) + 1
    often = sorted((t for t, n in count.items() if n >= MIN_COUNT), key=lambda t: (-count[t], t))[: VOCABULARY - 1]
    vocabulary = {t: i + 1 for i, t in enumerate(often)}
    row = Rows()
    cut = [windows_of(np.fromiter(map(row.__getitem__, samples[k][0]), np.int32, len(samples[k][0]))) for k in np.flatnonzero(~aside)]
    ids, of = np.concatenate(cut), np.repeat(np.flatnonzero(~aside), list(map(len, cut)))
    y = labels[of].astype(np.float32)
    word, flat, begin = inputs(vocabulary, row.new)
    sizes = np.diff(np.append(begin, len(flat)))
    p = start(len(vocabulary) + 1, rng)
    adam = Adam(p, 0.01)

    def batch(rows: np.ndarray, positive: float) -> None:
        used, local = np.unique(ids[rows], return_inverse=True)
        if used[0] != 0:
            used, local = np.concatenate(([0], used)), local + 1
        own = sizes[used]
        b = np.cumsum(own) - own
        f = flat[np.repeat(begin[used] - b, own) + np.arange(own.sum())]
        t = y[rows]
        weight = np.where(t > 0, 0.5 / max(1e-6, positive), 0.5 / max(1e-6, 1 - positive)) / len(rows)
        _, g, d_word, d_char = gradients(p, p["word"][word[used]], means(p["char"], f, b), local.reshape(len(rows), WINDOW), t, weight.astype(np.float32))
        g["word"] = added(word[used], d_word, len(p["word"]))
        g["char"] = added(f, np.repeat(d_char / own[:, None], own, axis=0), BUCKETS)
        g["word"][0] = 0
        adam.step(g)

    def all_logits() -> np.ndarray:
        gates = gates_of(p, p["word"][word], means(p["char"], flat, begin))
        return np.concatenate([forward(p, gates, ids[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)])

    for epoch in range(ROUNDS):
        if epoch == 0:
            rows = np.arange(len(ids))
        else:
            logit = all_logits()
            noise = logit + rng.random(len(logit)) * 1e-3
            order = np.lexsort((-noise, of))
            rank = np.empty(len(order), np.int64)
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            rank[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            per_text = np.bincount(of)[of]  # of: the text of each window
            top = np.maximum(1, per_text // 8)
            best = np.full(len(samples), -np.inf)
            np.maximum.at(best, of, logit)
            # labels hold errors: toxic texts in which nothing looks toxic by now are left out
            shown = (labels > 0) & ~aside
            doubted = shown & (best < 0) if epoch > 1 else labels < 0
            if doubted[shown].mean() > DOUBTED:
                doubted = shown & (best < np.quantile(best[shown], DOUBTED))
            rows = np.flatnonzero(np.where(y > 0, (rank < top) & ~doubted[of], (rank < 2) | (rng.random(len(y)) < 0.1)))
        positive = float(y[rows].mean())
        for _ in range(min(MOST_PASSES, max(1, -(-STEPS * BATCH // len(rows))))):
            rng.shuffle(rows)
            for i in range(0, len(rows), BATCH):
                batch(rows[i : i + BATCH], positive)
        adam.rate *= 0.75
    model = Model(p, vocabulary)
    # one line from the best window's logit to the label, on texts kept from the fit where there are enough
    judged = [k for k in range(len(samples)) if aside[k]]
    if min((labels[judged] == y).sum() for y in (0, 1)) < 8:
        judged = list(range(len(samples)))
    best = np.clip([x.max() for x in model.logits([samples[k][0] for k in judged])], -20, 20)
    labels = labels[judged]
    w = np.where(labels > 0, prior / labels.mean(), (1 - prior) / (1 - labels.mean())) / len(labels)
    middle, wide = best.mean(), best.std() + 1e-6
    z, scale, shift = (best - middle) / wide, 1.0, 0.0
    for _ in range(1500):
        e = w * (sigmoid(scale * z + shift) - labels)
        scale, shift = scale - float((e * z).sum() + 1e-3 * scale), shift - float(e.sum())
    scale = max(0.05, scale) / wide
    shift -= scale * middle
    return Model(p, vocabulary, scale, shift, prior)


def training_sample(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> list[tuple[list[str], int]]:
    """(words, label) of at most ``per_class`` texts of each label with ``most_bytes`` in all, in the order of a hash of the id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").withColumn("order", F.xxhash64(F.col("id").cast("string")))
    chosen = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy("order", "id").limit(per_class).collect()]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame(chosen, known.schema)  # at most 2 * per_class rows
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.octet_length("text") <= most_bytes)
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).getField("text")
    rows = rows.join(F.broadcast(ids), "id").groupBy("label", "order", "id").agg(one.alias("text"))
    size = F.sum(F.octet_length("text").cast("long"))
    rows = saved(rows, "sample")  # bounded: its running sums may take one task for each label
    rows = rows.withColumn("upto", size.over(Window.partitionBy("label").orderBy("order", "id"))).where(F.col("upto") <= most_bytes)
    same: dict[str, str] = {}  # one object for each distinct word
    return [([same.setdefault(t, t) for t in tokens_of(r["text"])], int(r["label"])) for r in rows.orderBy("order", "id").toLocalIterator()]


def held_out(id_col: Column) -> Column:
    """Rows whose labels are kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, **sample) -> Model:
    """Trains on the texts of docs that labels (id, toxic) names; scores are calibrated to the share of toxic labels."""
    ship(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1))
    return train(training_sample(docs, labels, **sample), known.select(F.avg("toxic")).first()[0])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column expression over docs: the score of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            which, distinct = pd.factorize(texts)  # equal texts are scored once
            yield pd.Series(shared.value.scores(distinct.tolist())[which])
        give_back()

    return score(F.coalesce(F.col(text_col), F.lit("")))
