"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows, forwards and backwards,
labels every position with a distribution over the learned languages, and a
document's probabilities are the mean over all its positions. It is trained
in numpy by backpropagation through time, on windows of a bounded sample of
labelled rows; nothing but text and label enters, and prediction sees the text
only.

The sample: of each label the rows whose hash falls under a threshold set from
the label's count, about ``SAMPLE_ROWS`` rows and never more than twice that;
of each row one window at a place that the hash sets, anywhere in its text.

Null texts and texts without a letter are ``und`` with score 0. Long texts are
read whole, a bounded number of windows at once; a window's states begin anew.
Repeated rows get equal results; of equal probabilities the first label in
order wins; other columns aren't read; without labelled rows all is ``und``,
and an empty table gives an empty result. The network has an output for each
label, so the learned labels must be few: the sample is read by the driver and
grows with their number, not with the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Units of each direction, bytes of a window, rows of a label in the sample.
UNITS, WINDOW, SAMPLE_ROWS = 8, 64, 1500
#: Training steps, windows of a step, first learning rate.
STEPS, BATCH, RATE = 260, 192, 0.02
#: Windows read at once.
LANES = 2048


def has_letter(text: str) -> bool:
    """Whether a character is of one of Unicode's letter categories: no digits, numbers, fractions or symbols of letters."""
    return any(map(str.isalpha, text))


class Gru:
    """Parameters by name: for each direction d in (f, b) x-tables X (byte 0 to 255, 256 for padding; gates z, r and candidate n side by side), recurrent U, bias c of the candidate's recurrent part; output W, o."""

    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.units = labels, units
        self.p = {}
        for d in "fb":
            self.p[f"X{d}"] = rng.normal(0, 0.3, (257, 3 * units)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(units), (units, 3 * units)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(units, np.float32)
        self.p["W"] = rng.normal(0, 0.3, (2 * units, len(labels))).astype(np.float32)
        self.p["o"] = np.zeros(len(labels), np.float32)

    def direction(self, x: np.ndarray, d: str, keep: bool = False):
        """States (time, lane, unit) of one direction over x (time, lane), and what the way back needs."""
        H, U, c, X = self.units, self.p[f"U{d}"], self.p[f"c{d}"], self.p[f"X{d}"]
        T, B = x.shape
        states = np.zeros((T, B, H), np.float32)
        h = np.zeros((B, H), np.float32)
        tape = []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a = X[x[t]]
            u = h @ U
            g = a[:, : 2 * H] + u[:, : 2 * H]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, r = g[:, :H], g[:, H:]
            un = u[:, 2 * H :] + c
            n = np.tanh(a[:, 2 * H :] + r * un)
            new = n + z * (h - n)
            if keep:
                tape.append((t, h, z, r, n, un))
            h = new
            states[t] = h
        return states, tape

    def logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        H, W = self.units, self.p["W"]
        return f.reshape(-1, H) @ W[:H] + b.reshape(-1, H) @ W[H:] + self.p["o"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of all positions that aren't padding, and its gradient, back through time. x: (time, lane), y: label of each lane."""
        T, B = x.shape
        H = self.units
        f, tf = self.direction(x, "f", True)
        b, tb = self.direction(x, "b", True)
        s = self.logits(f, b)
        s -= s.max(1, keepdims=True)
        q = np.exp(s)
        q /= q.sum(1, keepdims=True)
        real = (x < 256).reshape(-1)
        want = np.tile(y, T)
        loss = float(-np.log(q[np.arange(T * B), want] + 1e-9)[real].mean())
        q[np.arange(T * B), want] -= 1
        q *= real[:, None] / real.sum()
        W = self.p["W"]
        g = {"W": np.vstack([f.reshape(-1, H).T @ q, b.reshape(-1, H).T @ q]), "o": q.sum(0)}
        for d, tape, half in (("f", tf, W[:H]), ("b", tb, W[H:])):
            into = (q @ half.T).reshape(T, B, H)
            U = self.p[f"U{d}"]
            gx, gu, gc = np.zeros((257, 3 * H), np.float32), np.zeros_like(U), np.zeros(H, np.float32)
            dh = np.zeros((B, H), np.float32)
            for t, h, z, r, n, un in reversed(tape):
                dh = dh + into[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dun = dn * r
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                du = np.concatenate([dz, dr, dun], 1)
                np.add.at(gx, x[t], da)
                gu += h.T @ du
                gc += dun.sum(0)
                dh = dh * z + du @ U.T
            g[f"X{d}"], g[f"U{d}"], g[f"c{d}"] = gx, gu, gc
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 3) -> list[float]:
        """Adam with gradients clipped by norm; labels are drawn evenly. x: (row, time) with 256 for padding."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        by = [r for r in by if len(r)]
        losses = []
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(r, max(1, batch // len(by))) for r in by])
            loss, g = self.gradients(np.ascontiguousarray(x[rows].T), y[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def states(self, x: np.ndarray, d: str) -> np.ndarray:
        """What ``direction`` gives, in buffers that are used again at every step."""
        H, T, B = self.units, *x.shape
        X, U = self.p[f"X{d}"], self.p[f"U{d}"]
        Xg, Xn, Ug, Un, c = (np.ascontiguousarray(v) for v in (-X[:, : 2 * H], X[:, 2 * H :], -U[:, : 2 * H], U[:, 2 * H :], self.p[f"c{d}"]))
        out = np.empty((T, B, H), np.float32)
        g, a, n = np.empty((B, 2 * H), np.float32), np.empty((B, 2 * H), np.float32), np.empty((B, H), np.float32)
        xn, z = np.empty((B, H), np.float32), np.empty((B, H), np.float32)
        h = np.zeros((B, H), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            Xg.take(x[t], axis=0, out=a, mode="clip")
            Xn.take(x[t], axis=0, out=xn, mode="clip")
            np.dot(h, Ug, out=g)
            g += a
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.dot(h, Un, out=n)
            n += c
            n *= g[:, H:]
            n += xn
            np.tanh(n, out=n)
            new = out[t]
            np.subtract(h, n, out=new)
            z[:] = g[:, :H]
            new *= z
            new += n
            h = new
        return out

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, lane, label) of x (time, lane)."""
        s = self.logits(self.states(x, "f"), self.states(x, "b"))
        np.clip(s, -40, 40, out=s)
        np.exp(s, out=s)
        s /= (s @ np.ones(s.shape[1], np.float32))[:, None]
        return s.reshape(*x.shape, -1)

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities (text, label): the mean over every position of each text."""
        data = [t.encode("utf-8") for t in texts]
        total = np.zeros((len(texts), len(self.labels)))
        owner = np.repeat(np.arange(len(data)), [-(-len(d) // WINDOW) for d in data])
        windows = ((i, d[k : k + WINDOW]) for i, d in enumerate(data) for k in range(0, len(d), WINDOW))
        for at in range(0, len(owner), LANES):
            part = [w for _, w in zip(range(min(LANES, len(owner) - at)), windows)]
            # ends of texts are short: padded for the forward way; for the backward way the state starts at the last real byte
            x = np.full((WINDOW, len(part)), 256, np.intp)
            raw = np.frombuffer(b"".join(w for _, w in part), np.uint8)
            sizes = np.array([len(w) for _, w in part])
            if (sizes == WINDOW).all():
                x[:] = raw.reshape(-1, WINDOW).T
            else:
                lane = np.repeat(np.arange(len(part)), sizes)
                x[np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes), lane] = raw
            q = self.position_probabilities(x)
            if len(raw) < x.size:
                q[x == 256] = 0
            np.add.at(total, owner[at : at + len(part)], q.sum(0))
        return total / np.maximum(1, [len(d) for d in data])[:, None]


def fold(doc_id: Column) -> Column:
    """The remainder that sets held-out rows apart (1)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_windows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang, window: one window of each sampled row of the two learning folds."""
    # windows of different length in characters hold WINDOW bytes or more; they are cut to bytes later
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(F.length("text") > 0).filter(fold(F.col("doc_id")) != 1)
    hashed = F.xxhash64("doc_id", "text")
    counts = common.materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    labels = counts.count()
    if not labels:
        return None
    shares = counts.select("lang", F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n")).alias("share"))
    drawn = common.join_small(known.withColumn("h", hashed), shares, ["lang"], "inner", labels).filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    place = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    return drawn.select("lang", F.substr(F.col("text"), place, F.lit(WINDOW)).alias("window")).limit(2 * rows * labels)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Gru | None:
    sample = training_windows(docs, rows)
    if sample is None:
        return None
    got = sample.select("lang", "window").toPandas().sort_values(["lang", "window"], kind="stable")
    labels = sorted(got["lang"].unique())
    if not labels:
        return None
    x = np.full((len(got), WINDOW), 256, np.int64)
    for i, w in enumerate(got["window"]):
        data = w.encode("utf-8")[:WINDOW]
        x[i, : len(data)] = np.frombuffer(data, np.uint8)
    model = Gru(labels)
    if len(labels) > 1:
        model.fit(x, np.searchsorted(labels, got["lang"]).astype(np.int64))
    return model


def languages(docs: DataFrame, model: Gru | None) -> Column:
    """A struct column lang_pred, score for the column ``text``."""
    common.text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # under 100 kB for any number of labels that one sees

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        net = sent.value
        out = pd.DataFrame({"lang_pred": pd.Series(["und"] * len(texts), dtype=object), "score": np.zeros(len(texts))})
        good = [i for i, t in enumerate(texts) if t and net is not None and has_letter(t)]
        if good:
            q = net.predict([texts.iloc[i] for i in good])
            out.loc[good, "lang_pred"] = [net.labels[k] for k in q.argmax(1)]
            out.loc[good, "score"] = q.max(1).clip(0, 1)
        return out

    return run("text")


def identify(docs: DataFrame, model: Gru | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; trains on its labelled rows unless a model is given."""
    model = model or train(docs)
    out = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), languages(docs, model).alias("l"))
    return out.select("doc_id", "held_out", "l.lang_pred", "l.score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is known with at least the score ``least``, all columns."""
    name = common.free_name(docs, "tm_language")
    out = docs.withColumn(name, languages(docs, train(docs)))
    return out.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).drop(name)


def query(spark, sf_dir):
    return identify(common.table(spark, sf_dir, "documents"))
