"""Language identification by a bidirectional gated recurrent network over bytes.

The network, written and trained in numpy by backpropagation through time, reads the bytes of a text from both ends and
labels each position with language probabilities. A-Z are lower-cased and what else of ASCII is no letter becomes one
space. A whole text is read in windows of OWN bytes; the states of both directions begin CONTEXT bytes outside a window,
so that a position's label knows at least that much of the text on either side, across words, and so that texts of any
length are read in bounded memory. A document's probabilities are the mean over all positions but spaces.

It learns from about `per_language` documents of each language, TRAINING_DOCS of all at most, chosen by a hash, and of
each from PASSAGE characters at a place chosen by a hash; of more languages than TRAINING_DOCS the most frequent. Null texts and those without a letter are `und` with score 0,
as are all if there is nothing to learn from. Texts without lang aren't learned from. Of languages that tie the first by
name is predicted. Repeated rows are labelled each; rows without id are neither held out nor learned from. An empty
table gives no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.common import named, table, with_made

#: Bytes of a window, bytes read around it, and windows that the network reads at a time.
OWN, CONTEXT, BATCH = 256, 32, 1024
#: Bytes of the windows that it learns from.
LEARNED = 64
PER_LANGUAGE, TRAINING_DOCS, PASSAGE = 400, 8_000, 2_000
#: Text characters whose windows are read together.
GROUP = 1 << 20
#: Probabilities held at a time.
SCORES = 4 << 20

#: A-Z lower-cased; white space for what else of ASCII is no letter.
_PLAIN = bytes(b | 32 if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
_LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> bytes:
    """The bytes that the network reads: words of lower-case letters with one space between them."""
    return b" ".join(text.encode(errors="replace").translate(_PLAIN).split())


def padded(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by time and segment, and the lengths; segments must come longest first."""
    length = np.array([len(s) for s in some])
    out = np.zeros((len(some), int(length.max(initial=1))), np.uint8)
    out[np.arange(out.shape[1])[None, :] < length[:, None]] = np.frombuffer(b"".join(some), np.uint8)
    return out.T, length


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer: z and r gate, h = z h + (1 - z) tanh(...)."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.byte = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.gates = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(np.float32)
        self.state = rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.byte, self.gates, self.state]

    def forward(self, x: np.ndarray, active: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States by time and segment; active[t] segments are as long as t + 1."""
        n = self.state.shape[0]
        h, out = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[0], x.shape[1], n), np.float32)
        for t in range(x.shape[0]):
            k = active[t]
            old, a = h[:k], self.byte[x[t, :k]]
            g = sigmoid(a[:, : 2 * n] + old @ self.gates)
            z, r = g[:, :n], g[:, n:]
            c = np.tanh(a[:, 2 * n :] + (r * old) @ self.state)
            if trace is not None:
                trace.append((old.copy(), z, r, c))
            h[:k] = z * old + (1 - z) * c
            out[t, :k] = h[:k]
        return out

    def states(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """The same states by time, unit and window, without a trace."""
        n, k = self.state.shape[0], x.shape[1]
        scale = np.repeat(np.float32([0.5, 1]), [2 * n, n])  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        byte, gates, state = np.ascontiguousarray((self.byte * scale).T), np.ascontiguousarray(self.gates.T * np.float32(0.5)), np.ascontiguousarray(self.state.T)
        h, out, read = np.zeros((n, k), np.float32), np.zeros((x.shape[0], n, k), np.float32), np.empty(3 * n * k, np.float32)
        for t in range(x.shape[0]):
            k = active[t]
            old, a = h[:, :k], byte.take(x[t, :k], axis=1, out=read[: 3 * n * k].reshape(3 * n, k), mode="clip")
            g = gates @ old
            g += a[: 2 * n]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            c = state @ (g[n:] * old)
            c += a[2 * n :]
            np.tanh(c, out=c)
            new = out[t, :, :k]
            np.subtract(old, c, out=new)
            new *= g[:n]
            new += c
            h = out[t]
        return out

    def backward(self, x: np.ndarray, active: np.ndarray, trace: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights, given those of the states."""
        n = self.state.shape[0]
        d_byte, d_gates, d_state = (np.zeros_like(w) for w in self.weights())
        d_read = np.zeros((*x.shape, 3 * n), np.float32)
        d_h = np.zeros((x.shape[1], n), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            k = active[t]
            old, z, r, c = trace[t]
            d = d_h[:k] + d_out[t, :k]
            d_c = d * (1 - z) * (1 - c * c)
            d_rh = d_c @ self.state.T
            d_g = np.concatenate([d * (old - c) * z * (1 - z), d_rh * old * r * (1 - r)], 1)
            d_state += (r * old).T @ d_c
            d_gates += old.T @ d_g
            d_read[t, :k] = np.concatenate([d_g, d_c], 1)
            d_h[:k] = d * z + d_rh * r + d_g @ self.gates.T
        order = np.argsort(x, axis=None, kind="stable")
        read, first = np.unique(x.ravel()[order], return_index=True)
        d_byte[read] = np.add.reduceat(d_read.reshape(-1, 3 * n)[order], first)
        return [d_byte, d_gates, d_state]


class Network:
    def __init__(self, classes: int, hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(hidden, rng), Direction(hidden, rng)
        self.out = rng.normal(0, hidden**-0.5, (2 * hidden, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights(), *self.back.weights(), self.out, self.bias]

    @staticmethod
    def turned(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each segment from its end."""
        at = length[None, :] - 1 - np.arange(x.shape[0])[:, None]
        return np.take_along_axis(x, np.maximum(at, 0) if x.ndim == 2 else np.maximum(at, 0)[..., None], 0)

    def run(self, x: np.ndarray, length: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, states) by time and segment, and which positions there are."""
        active = (length[None, :] > np.arange(x.shape[0])[:, None]).sum(1)
        ahead = self.ahead.forward(x, active, traces and traces[0])
        back = self.back.forward(self.turned(x, length), active, traces and traces[1])
        states = np.concatenate([ahead, self.turned(back, length)], 2)
        score = states @ self.out + self.bias
        p = np.exp(score - score.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        return p, states, np.arange(x.shape[0])[:, None] < length[None, :]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The sum of the probabilities over all positions of each text that are no spaces."""
        total = np.zeros((len(texts), len(self.bias)))
        size = np.array([len(s) for s in texts], np.int64)
        bytes_, text_at = np.frombuffer(b"".join(texts) + b" ", np.uint8), np.cumsum(size) - size
        n_windows = -(-size // OWN)
        of = np.repeat(np.arange(len(texts)), n_windows)
        own = OWN * (np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows))
        first, last = np.maximum(own - CONTEXT, 0), np.minimum(own + OWN + CONTEXT, size[of])
        order = np.argsort(first - last, kind="stable")  # longest first
        for at in range(0, len(order), BATCH):
            w = order[at : at + BATCH]
            length, steps = last[w] - first[w], np.arange((last[w] - first[w]).max())[:, None]
            start = text_at[of[w]] + first[w]
            x = bytes_.take(np.minimum(start + steps, len(bytes_) - 1))
            active = (length > steps).sum(1)
            ahead = self.ahead.states(x.astype(np.intp), active)
            back = self.back.states(bytes_.take(start + np.maximum(length - 1 - steps, 0)).astype(np.intp), active)
            if length[0] == length[-1]:
                back = back[::-1]
            else:
                back = np.take_along_axis(back, np.maximum(length - 1 - steps, 0)[:, None, :], 0)
            counted = (first[w] + steps >= own[w]) & (first[w] + steps < np.minimum(own[w] + OWN, last[w])) & (x != 32)
            total_w = np.zeros((len(self.bias), len(w)))
            for t in range(0, len(steps), block := max(1, SCORES // (len(w) * len(self.bias)))):
                total_w += self.probabilities(ahead[t : t + block], back[t : t + block], counted[t : t + block])
            np.add.at(total, of[w], total_w.T)
        return total

    def probabilities(self, ahead: np.ndarray, back: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """The sum of the probabilities over counted positions, by language and window."""
        n = ahead.shape[1]
        p = np.matmul(self.out[:n].T, ahead)
        p += np.matmul(self.out[n:].T, back)
        p += self.bias[:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p *= (counted / p.sum(1))[:, None, :].astype(np.float32)
        return p.sum(0)

    def gradient(self, some: list[bytes], label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all positions, by backpropagation through time."""
        order = np.argsort([-len(s) for s in some], kind="stable")
        x, length = padded([some[i] for i in order])
        traces: tuple[list, list] = ([], [])
        p, states, there = self.run(x, length, traces)
        p[:, np.arange(len(order)), label[order]] -= 1
        d = p * (there / there.sum())[..., None].astype(np.float32)
        active = there.sum(1)
        d_states = d @ self.out.T
        n = self.ahead.state.shape[0]
        flat = states.reshape(-1, 2 * n).T @ d.reshape(-1, d.shape[2])
        ahead = self.ahead.backward(x, active, traces[0], d_states[..., :n])
        back = self.back.backward(self.turned(x, length), active, traces[1], self.turned(np.ascontiguousarray(d_states[..., n:]), length) * there[..., None])
        return [*ahead, *back, flat, d.sum((0, 1))]


def train(texts: list[str], labels: list[str], steps: int = 350, batch: int = 96, rate: float = 0.02, seed: int = 7) -> tuple[list[str], Network]:
    """Languages and a network that learned them from windows of LEARNED bytes, drawn evenly over languages, their texts
    and places."""
    rng = np.random.default_rng(seed)
    pools: dict[str, list[bytes]] = {}
    for text, label in zip(texts, labels):
        if own := plain(text):
            pools.setdefault(label, []).append(own)
    names = sorted(pools)
    network = Network(len(names), seed=seed)
    if len(names) < 2:
        return names, network

    def window(language: str) -> bytes:
        own = pools[language][rng.integers(0, len(pools[language]))]
        at = rng.integers(0, max(1, len(own) - LEARNED + 1))
        return own[at : at + LEARNED]

    mean, square = [np.zeros_like(w) for w in network.weights()], [np.zeros_like(w) for w in network.weights()]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(names), batch)
        now = rate * min(1.0, 2 - 2 * step / steps)
        for w, g, m, s in zip(network.weights(), network.gradient([window(names[k]) for k in label], label), mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return names, network


def labelled(names: list[str], network: Network, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """(language, mean probability) of each text."""
    at = 0
    while at < len(texts):
        to, size, group = at, 0, []
        while to < len(texts) and size < GROUP:
            text = texts[to] or ""
            group.append(plain(text) if names and _LETTER.search(text) else b"")
            size += len(text)
            to += 1
        for own, p in zip(group, network.pooled(group)):
            if own:
                k = int(p.argmax())
                yield names[k], float(min(1.0, p[k] / p.sum()))
            else:
                yield "und", 0.0
        at = to


def training_sample(docs: DataFrame, usable: Column, key: str, text: str, lang: str, per_language: int) -> tuple[list[str], list[str]]:
    """Passages and languages of about per_language usable documents of each language, of TRAINING_DOCS in all."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(TRAINING_DOCS)
    each = counts.select("_lang", (1e6 * F.least(F.lit(per_language), F.lit(TRAINING_DOCS) / F.count("*").over(Window.partitionBy(F.lit(0)))) / F.col("count")).alias("_share"))
    place = 1 + F.pmod(F.xxhash64("_text", "_id"), F.greatest(F.length("_text") - PASSAGE + 1, F.lit(1)))
    picked = rows.join(F.broadcast(each), "_lang").filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(1_000_000)) < F.col("_share"))  # TRAINING_DOCS rows at most
    found = picked.select("_id", "_lang", F.substring("_text", place, F.lit(PASSAGE)).alias("_text")).distinct().collect()
    found.sort()
    return [r["_text"] for r in found], [r["_lang"] for r in found]


def identify(docs: DataFrame, model: tuple[list[str], Network], keep: list[str], text: str = "text") -> DataFrame:
    """`keep` of each row of docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(labelled(*shared.value, batch.column(len(keep)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([n for n, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*map(named, keep), text).mapInArrow(label, with_made(docs, keep, "lang_pred string, score double"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train(*training_sample(docs, fold != 2, "doc_id", "text", "lang", PER_LANGUAGE))
    return identify(docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False))), model, ["doc_id", "held_out"])
