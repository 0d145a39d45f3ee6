"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its row in a table of frequent words and the mean of the rows of its hashed byte 3- and 4-grams. Unicode
white space and punctuation break words too; what is longer than a piece is several words that overlap by a gram. Overlapping
windows of words run through a GRU in each direction; attention pools the states of a window, a logistic unit scores
it, and a document's score is that of its highest window. A label is of a whole document, so training is by turns:
of each toxic document the window that the network (at first: the class counts of grams) finds worst, of each clean
one its worst and random ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, whole_text
from .lz_dedup import Words, words_of


@dataclass(frozen=True)
class ToxicityConfig:
    """sample_docs: labelled documents of a class that are fitted at most, one for each of so many hash buckets;
    sample_chars: longer ones aren't fitted (all are scored). window, stride: words. piece_bytes: longer words are cut. vocabulary: words with a row.
    gram_rows: rows that byte grams are hashed to. width, hidden: of rows, and of the state of a direction. turns: of choosing windows and fitting them; steps: of each, about, or more for many windows."""

    sample_docs: int = 2500
    sample_chars: int = 8000
    window: int = 32
    stride: int = 16
    piece_bytes: int = 64
    vocabulary: int = 4096
    gram_rows: int = 1 << 14
    width: int = 12
    hidden: int = 12
    turns: int = 8
    steps: int = 100
    batch: int = 64
    rate: float = 0.01
    threshold: float = 0.7
    seed: int = 1


_BREAKS = np.array([not (b >= 128 or chr(b).isalnum() or b == 39) for b in range(256)])
#: Code points beyond ASCII that are white space or punctuation; the raised apostrophe is in words, as the plain one is.
_WIDE_BREAKS = np.array([c == 0x85 or (c >= 128 and c != 0x2019 and unicodedata.category(chr(c))[0] in "ZP") for c in range(0x20000)])
_POWER = np.uint64(0x9E3779B97F4A7C15)
_OVERLAP = 3  # bytes: a gram less one, so that each gram is whole in a piece


@dataclass
class Texts:
    """Lower-case texts as numbers of distinct words: the hashes and grams of these, and where each text's words are."""

    hashes: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    words: np.ndarray
    ends: np.ndarray


def _broken(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """UTF-8 texts side by side, with spaces for breaks beyond ASCII. What is no valid character is no break."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return data
    padded = np.r_[data, np.zeros(3, np.uint8)]
    out = data.copy()
    for size, low, high, first in ((2, 0xC2, 0xE0, 0x80), (3, 0xE0, 0xF0, 0x800), (4, 0xF0, 0xF5, 0x10000)):
        at = lead[(data[lead] >= low) & (data[lead] < high)]
        code, valid = data[at] & np.int64((0x80 >> size) - 1), np.ones(len(at), bool)
        for j in range(1, size):
            more = padded[at + j]
            code, valid = code << 6 | (more & 0x3F), valid & (more >> 6 == 2)
        valid &= (code >= first) & (code < len(_WIDE_BREAKS))
        at = at[valid][_WIDE_BREAKS[code[valid]]]
        at = at[np.searchsorted(ends, at, side="right") == np.searchsorted(ends, at + size - 1, side="right")]
        for j in range(size):
            out[at + j] = 32
    return out


def _pieces(data: np.ndarray, found: Words, piece_bytes: int) -> Words:
    """The words, long ones cut into pieces of piece_bytes, each _OVERLAP bytes into the one before it."""
    lengths = found.stops - found.begins
    long = lengths > piece_bytes
    if not long.any():
        return found
    step = piece_bytes - _OVERLAP
    count = np.where(long, -(-(lengths - _OVERLAP) // step), 1)
    word = np.repeat(np.arange(len(count)), count)
    until = np.cumsum(count)
    begins = found.begins[word] + (np.arange(len(word)) - (until - count)[word]) * step
    stops = np.minimum(begins + np.where(long, piece_bytes, lengths)[word], found.stops[word])
    hashes = found.hashes[word]
    at = np.flatnonzero(long[word])
    for a in range(0, len(at), 50_000):
        own = at[a : a + 50_000]
        h = np.zeros(len(own), np.uint64)
        for j in range(piece_bytes):
            inside = begins[own] + j < stops[own]
            h = np.where(inside, mix64(h + data[np.where(inside, begins[own] + j, 0)] + np.uint64(1)), h)
        hashes[own] = mix64(h ^ _POWER)
    return Words(begins, stops, hashes, np.r_[np.int64(0), until][found.ends])


def read_texts(texts: list[bytes], config: ToxicityConfig) -> Texts:
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    data = _broken(np.frombuffer(b"".join(texts), np.uint8), ends)
    found = _pieces(data, words_of(data, ends, _BREAKS), config.piece_bytes)
    hashes, first, words = np.unique(found.hashes, return_index=True, return_inverse=True)
    parts = [_grams(data, found.begins[first[a : a + 50_000]], found.stops[first[a : a + 50_000]], config.gram_rows) for a in range(0, len(first), 50_000)]
    grams = np.concatenate([np.zeros(0, np.int32), *(g for g, _ in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    return Texts(hashes, grams, np.cumsum(counts) - counts, words.reshape(-1), found.ends)


def _grams(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, gram_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the 3- and 4-grams of " word " for some words, and how many each has."""
    sizes = stops - begins + 2
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    size = np.repeat(sizes, sizes)
    inside = (place > 0) & (place < size - 1)
    source = np.repeat(begins - 1, sizes) + place
    letters = np.where(inside, data[np.where(inside, source, 0)], 32).astype(np.uint64)
    padded = np.r_[letters, np.zeros(3, np.uint64)]
    three = padded[:-3] | (padded[1:-2] << np.uint64(8)) | (padded[2:-1] << np.uint64(16))
    four = three | (padded[3:] << np.uint64(24)) | np.uint64(1 << 40)
    rows = np.stack([mix64(three * _POWER), mix64(four * _POWER)], axis=1) % np.uint64(gram_rows)
    ok = np.stack([place + 3 <= size, place + 4 <= size], axis=1)
    return rows[ok].astype(np.int32), np.add.reduceat(ok.sum(axis=1), starts)


def windows_of(texts: Texts, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows (-1 beyond the end) and the text of each; a text without words has one empty window."""
    sizes = np.diff(np.r_[np.int64(0), texts.ends])
    count = 1 + np.maximum(0, -(-(sizes - config.window) // config.stride))
    owner = np.repeat(np.arange(len(sizes)), count)
    inner = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * config.stride
    at = inner[:, None] + np.arange(config.window)
    inside = at < sizes[owner, None]
    begin = (texts.ends - sizes)[owner, None]
    return np.where(inside, texts.words[np.where(inside, begin + at, 0)] if len(texts.words) else 0, -1), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by number, column by column, which is much faster than adding row by row."""
    return np.stack([np.bincount(at, rows[:, c], n) for c in range(rows.shape[1])], axis=1).astype(np.float32)


class Network:
    """Parameters, the forward pass and its gradients. Axis 1 of states is the direction."""

    def __init__(self, config: ToxicityConfig, vocabulary: np.ndarray):
        rng, d, h = np.random.default_rng(config.seed), config.width, config.hidden
        self.config, self.vocabulary = config, np.sort(vocabulary)
        f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        self.p = {
            "word": 0.1 * rng.standard_normal((len(vocabulary) + 1, d)).astype(np.float32),
            "gram": 0.3 * rng.standard_normal((config.gram_rows, d)).astype(np.float32),
            "x": f(2 * d, 6 * h),
            "xb": np.zeros(6 * h, np.float32),
            "u": f(2, h, 3 * h),
            "a": f(2 * h, h),
            "ab": np.zeros(h, np.float32),
            "v": 0.3 * rng.standard_normal(h).astype(np.float32),
            "w": 0.3 * rng.standard_normal(2 * h).astype(np.float32),
            "b": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0

    def inputs(self, texts: Texts, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Input rows of the distinct words, and their numbers in the word table (0: none)."""
        at = np.minimum(np.searchsorted(self.vocabulary, texts.hashes), max(0, len(self.vocabulary) - 1))
        known = np.where(self.vocabulary[at] == texts.hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(len(texts.hashes), np.int64)
        if not len(texts.hashes):
            return np.zeros((0, 2 * self.config.width), np.float32), known
        counts = np.diff(np.r_[texts.gram_starts, len(texts.grams)])
        mean = np.add.reduceat(self.p["gram"][texts.grams], texts.gram_starts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][known], mean], axis=1), known

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = True):
        """Logits of windows over word inputs x, and what gradients need (of steps: if they are kept)."""
        p, h = self.p, self.config.hidden
        n, length = windows.shape
        projected = np.concatenate([x @ p["x"] + p["xb"], np.zeros((1, 6 * h), np.float32)]).reshape(-1, 2, 3 * h)
        both = np.stack([windows, windows[:, ::-1]])  # direction, window, step
        mask = (both >= 0).astype(np.float32)
        state = np.zeros((2, n, h), np.float32)
        states, steps = np.empty((length, 2, n, h), np.float32), []
        for t in range(length):
            own = np.stack([projected[both[k, :, t], k] for k in range(2)])
            hidden = state @ p["u"]
            gates = _sigmoid(own[..., : 2 * h] + hidden[..., : 2 * h])
            z, r = gates[..., :h], gates[..., h:]
            new = np.tanh(own[..., 2 * h :] + r * hidden[..., 2 * h :])
            m = mask[:, :, t, None]
            if keep:
                steps.append((state, hidden, z, r, new, m))
            state = state + m * (1 - z) * (new - state)
            states[t] = state
        out = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1).transpose(1, 0, 2)  # window, word, 2h
        seen = np.tanh(out @ p["a"] + p["ab"])
        e = np.where(windows >= 0, seen @ p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=1, keepdims=True)) * (windows >= 0)
        weight = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * out).sum(axis=1)
        return pooled @ p["w"] + p["b"][0], (both, steps, out, seen, weight, pooled)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What each word brings to gate and direction (gate, direction, word, h). The last row is that of no word, whose first gate keeps a state as it is."""
        h = self.config.hidden
        own = np.empty((3, 2, len(x) + 1, h), np.float32)
        own[:, :, :-1] = (x @ self.p["x"] + self.p["xb"]).reshape(-1, 2, 3, h).transpose(2, 1, 0, 3)
        own[:, :, -1] = np.array([1e4, 0, 0], np.float32)[:, None, None]
        return own

    def logits(self, projected: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Logits of windows as `forward` has them, of `projected` words: gates lie each for itself, and states are pooled by their share of the logit."""
        p, h = self.p, self.config.hidden
        n, length = windows.shape
        u = np.ascontiguousarray(p["u"].reshape(2, h, 3, h).transpose(2, 0, 1, 3))
        at = np.where(windows >= 0, windows, projected.shape[2] - 1).T
        own, hidden, move = np.empty((3, 2, n, h), np.float32), np.empty((3, 2, n, h), np.float32), np.empty((2, n, h), np.float32)
        states = np.zeros((length + 1, 2, n, h), np.float32)
        with np.errstate(over="ignore"):
            for t in range(length):
                for k, words in enumerate((at[t], at[length - 1 - t])):
                    for g in range(3):
                        projected[g, k].take(words, axis=0, out=own[g, k], mode="clip")
                np.matmul(states[t], u, out=hidden)
                gates, new = own[:2], hidden[2]
                gates += hidden[:2]
                np.negative(gates[1], out=gates[1])
                np.exp(gates, out=gates)
                gates += 1
                new /= gates[1]
                new += own[2]
                np.tanh(new, out=new)
                np.subtract(new, states[t], out=move)
                move /= gates[0]
                np.add(states[t], move, out=states[t + 1])
        ahead, back = states[1:, 0], states[:0:-1, 1]  # word, window, h
        e = np.tanh(ahead @ p["a"][:h] + back @ p["a"][h:] + p["ab"]) @ p["v"]
        inside = windows.T >= 0
        e = np.where(inside, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0)) * inside
        share = ahead @ p["w"][:h] + back @ p["w"][h:]
        return (e * share).sum(axis=0) / np.maximum(e.sum(axis=0), 1e-9) + p["b"][0]

    def gradients(self, x: np.ndarray, windows: np.ndarray, target: np.ndarray, importance: np.ndarray):
        """Mean loss, gradients of the parameters, and of x."""
        p, h = self.p, self.config.hidden
        logit, (both, steps, out, seen, weight, pooled) = self.forward(x, windows)
        prob = _sigmoid(logit)
        d_logit = ((prob - target) * importance / importance.sum()).astype(np.float32)
        g = {"w": pooled.T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["w"]
        d_out = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = (out * d_pooled[:, None, :]).sum(axis=-1)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["v"] = np.tensordot(d_e, seen, axes=([0, 1], [0, 1]))
        d_seen = d_e[:, :, None] * p["v"] * (1 - seen**2)
        g["a"], g["ab"] = np.tensordot(out, d_seen, axes=([0, 1], [0, 1])), d_seen.sum(axis=(0, 1))
        d_out = (d_out + d_seen @ p["a"].T).transpose(1, 0, 2)
        d_states = np.stack([d_out[:, :, :h], d_out[::-1, :, h:]], axis=1)  # step, direction, window, h
        d_state, g["u"] = np.zeros_like(d_states[0]), np.zeros_like(p["u"])
        d_inputs = np.empty((2, len(steps), windows.shape[0], 3 * h), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            state, hidden, z, r, new, m = steps[t]
            d_state = d_state + d_states[t]
            d_move = m * d_state
            d_new = d_move * (1 - z) * (1 - new**2)
            d_z = -d_move * (new - state) * z * (1 - z)
            d_r = d_new * hidden[..., 2 * h :] * r * (1 - r)
            d_hidden = np.concatenate([d_z, d_r, d_new * r], axis=-1)
            d_inputs[:, t] = np.concatenate([d_z, d_r, d_new], axis=-1)
            g["u"] += state.transpose(0, 2, 1) @ d_hidden
            d_state = d_state * (1 - m * (1 - z)) + d_hidden @ p["u"].transpose(0, 2, 1)
        words = np.where(both >= 0, both, len(x)).transpose(0, 2, 1)
        d_projected = np.concatenate([_sum_rows(words[k].reshape(-1), d_inputs[k].reshape(-1, 3 * h), len(x) + 1)[:-1] for k in range(2)], axis=1)
        g["x"], g["xb"] = x.T @ d_projected, d_projected.sum(axis=0)
        loss = -(importance * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).sum() / importance.sum()
        return float(loss), g, d_projected @ p["x"].T


def _part(texts: Texts, chosen: np.ndarray) -> tuple[Texts, np.ndarray]:
    """The texts' words that these windows have, and the windows in their numbers."""
    numbers, windows = np.unique(chosen, return_inverse=True)
    windows = windows.reshape(chosen.shape) - (numbers[0] < 0)
    numbers = numbers[numbers >= 0]
    counts = np.diff(np.r_[texts.gram_starts, len(texts.grams)])[numbers]
    at = np.repeat(texts.gram_starts[numbers] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return Texts(texts.hashes[numbers], texts.grams[at], np.cumsum(counts) - counts, texts.words[:0], texts.ends[:0]), windows


@dataclass
class ToxicityModel:
    """The network, and how the logit of a document's highest window becomes its score."""

    network: Network | None
    slope: float
    shift: float


def _top(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The highest logit of each text."""
    best = np.full(n, -np.inf, np.float32)
    np.maximum.at(best, owner, logits)
    return best


def train(texts: list[str], labels: np.ndarray, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on lower-case texts with labels 0 or 1; without both classes every score is 0."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(None, 1.0, 0.0)
    read = read_texts([t.encode() for t in texts], config)
    windows, owner = windows_of(read, config)
    sizes = np.diff(np.r_[np.int64(0), read.ends])
    doc_of = np.repeat(np.arange(len(texts)), sizes)
    # documents that a word is in: the most frequent have rows
    pairs = np.unique(read.words * np.int64(len(texts)) + doc_of)
    in_docs = np.bincount(pairs // len(texts), minlength=len(read.hashes))
    order = np.lexsort((read.hashes, -in_docs))
    order = order[in_docs[order] >= 3][: config.vocabulary]
    network = Network(config, read.hashes[order])
    # at first, words are judged by the documents of each class that have their grams
    counts = np.diff(np.r_[read.gram_starts, len(read.grams)])
    word_of_gram = np.repeat(np.arange(len(counts)), counts)
    gram_docs = np.zeros((2, config.gram_rows))
    words, docs = pairs // len(texts), pairs % len(texts)
    by_doc = np.argsort(docs, kind="stable")
    doc_ends = np.searchsorted(docs[by_doc], np.arange(len(texts)), side="right")
    for k in range(len(texts)):
        own = words[by_doc[doc_ends[k - 1] if k else 0 : doc_ends[k]]]
        spread = np.repeat(read.gram_starts[own] - (np.cumsum(counts[own]) - counts[own]), counts[own]) + np.arange(int(counts[own].sum()))
        gram_docs[labels[k], np.unique(read.grams[spread])] += 1
    n_class = np.bincount(labels, minlength=2)
    odds = np.log((gram_docs[1] + 1) / (n_class[1] + 2)) - np.log((gram_docs[0] + 1) / (n_class[0] + 2))
    by_word = np.full(len(counts), -9.0)
    np.maximum.at(by_word, word_of_gram, odds[read.grams])
    logits = np.where(windows >= 0, by_word[np.maximum(windows, 0)] if len(by_word) else -9.0, -9.0).max(axis=1)

    rng = np.random.default_rng(config.seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for turn in range(config.turns):
        order = np.lexsort((logits, owner))
        worst = order[np.r_[np.flatnonzero(owner[order][1:] != owner[order][:-1]), len(order) - 1]]
        clean = np.flatnonzero(labels[owner] == 0)
        more = rng.choice(clean, min(len(clean), 2 * len(worst)), replace=False)
        chosen = np.unique(np.r_[worst, more])
        passes = max(1, round(config.steps * config.batch / len(chosen)))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        rate = config.rate * (1 - turn / config.turns) + 1e-4
        for a in range(0, len(chosen), config.batch):
            own = chosen[a : a + config.batch]
            part, numbers = _part(read, windows[own])
            x, known = network.inputs(part)
            target = labels[owner[own]].astype(np.float32)
            importance = np.where(target > 0, 1.0, 0.7).astype(np.float32)
            _, g, dx = network.gradients(x, numbers, target, importance)
            g["word"] = _sum_rows(known, dx[:, : config.width], len(network.p["word"]))
            g["word"][0] = 0
            n_grams = np.diff(np.r_[part.gram_starts, len(part.grams)])
            g["gram"] = _sum_rows(part.grams, np.repeat(dx[:, config.width :] / n_grams[:, None], n_grams, axis=0), config.gram_rows)
            step += 1
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                network.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        # by the pass that is trained, so that rounding doesn't turn what is chosen
        x, _ = network.inputs(read)
        logits = np.concatenate([network.forward(x, windows[a : a + 1024], keep=False)[0] for a in range(0, len(windows), 1024)])
    best = _top(logits, owner, len(texts))
    # the cut that is right most often when a tenth of documents is toxic becomes the threshold
    order = np.argsort(best)
    values, hits = best[order], labels[order]
    toxic_below = np.r_[0, np.cumsum(hits)] / n_class[1]
    clean_above = 1 - np.r_[0, np.cumsum(1 - hits)] / n_class[0]
    cost = 0.1 * toxic_below + 0.9 * clean_above
    cheapest = np.flatnonzero(cost <= cost.min() + 1e-12)
    at = int(cheapest[len(cheapest) // 2])
    cut = (values[max(0, at - 1)] + values[min(at, len(values) - 1)]) / 2
    return ToxicityModel(network, 1.0, float(np.log(config.threshold / (1 - config.threshold)) - cut))


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """A model of docs(doc_id, text) that have labels(doc_id, toxic). Of each class and hash bucket the label of the smallest
    hash is taken, so that the sample is bounded and the same on every run, and only its texts are fetched; rows without
    id, text or label, and longer texts, are not fitted."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", h.alias("h"))
    chosen = known.groupBy("toxic", F.pmod("h", F.lit(config.sample_docs)).alias("bucket")).agg(F.min_by("doc_id", "h").alias("doc_id")).select("doc_id", "toxic")
    # at most two rows for each of sample_docs buckets
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.char_length("text") <= config.sample_chars)
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.lower("text").alias("text")).distinct()
    rows = found.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "text", "toxic").collect()
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), config)


def score_toxicity(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, score, predicted for each row of docs(doc_id, text), over all windows of the whole text.

    Null text is empty; an empty text has the score of a window without words. Repeated rows give repeated results;
    further columns are ignored; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t) for t in batch.column("text").to_pylist()], np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 20))) + 1, len(sizes)]
            scores = np.zeros(len(sizes))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if model.network is not None and b > a:
                    texts = read_texts([t.as_py() for t in batch.column("text").slice(a, b - a)], config)
                    windows, owner = windows_of(texts, config)
                    projected = model.network.projected(model.network.inputs(texts)[0])
                    best = _top(np.concatenate([model.network.logits(projected, windows[k : k + 512]) for k in range(0, len(windows), 512)]), owner, b - a)
                    scores[a:b] = _sigmoid((best.astype(np.float64) + model.shift) * model.slope)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= config.threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(whole_text()).cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, score double, predicted int")
