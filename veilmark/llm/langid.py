"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes (all of it; neighbours overlap by
the widest filter, so no byte sequence is lost at a border).  Filters of several
widths run over the byte embeddings of a window; each filter's largest response
goes through a rectifier into a softmax over the languages.  A text's prediction
is the mean of its windows' probabilities, weighted by their bytes.

A filter's response is a sum of one term for each byte, so for prediction the
embeddings and filters are folded into tables indexed by *byte pairs*: a filter of
width 2k adds k table rows.

Training is numpy on the driver, over at most ``TRAIN_TEXTS`` texts for each
language and ``TRAIN_WINDOWS`` windows of each (a hash picks the texts).

Cases: a null text, or one without a letter, is ``und`` with score 1; texts without
a language label train nothing; with no labelled text at all every prediction is
``und`` with score 0; repeated rows get equal predictions; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import SAMPLE_CHARS, flat, hash_sample, remainder, slices

WINDOW = 256
#: Filter widths (even) and the number of filters of each.
WIDTHS, FILTERS = (2, 4, 6), 12
EMBEDDING = 8
#: Bounds of the training sample: texts of each language, windows of each text.
TRAIN_TEXTS, TRAIN_WINDOWS = 400, 4
EPOCHS, BATCH, RATE = 4, 32, 0.01
#: Windows that run through the network together.
TOGETHER = 256
HELD_OUT = (4, 2)


def has_letter(text: str | None) -> bool:
    """Does a text hold a letter?  Fractions, superscripts and circled numbers are word characters, but no letters."""
    return bool(text) and any(map(str.isalpha, text))


def windows_of(data: np.ndarray, off: np.ndarray, size: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zero bytes, text of each, bytes of each) over all bytes of all texts."""
    step = size - overlap
    lengths = np.diff(off)
    per = np.where(lengths > 0, np.maximum(1, -(-(lengths - overlap) // step)), 0)
    text = np.repeat(np.arange(len(lengths)), per)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = off[:-1][text] + place * step
    used = np.minimum(size, off[1:][text] - start)
    at = start[:, None] + np.arange(size)
    win = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros((0, size), np.uint8)
    win = np.where(np.arange(size) < used[:, None], win, 0).astype(np.uint8)
    return win, text, used


@dataclass
class ByteNet:
    langs: list[str]
    embedding: np.ndarray  # 256 x e
    filters: list[np.ndarray]  # of each width: w x e x f
    bias: np.ndarray  # filters of all widths
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 1) -> "ByteNet":
        rng = np.random.default_rng(seed)
        total = FILTERS * len(WIDTHS)
        return cls(
            langs, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
        )

    def train(self, win: np.ndarray, label: np.ndarray, seed: int = 2) -> None:
        """Adam on the cross-entropy of single windows."""
        rng = np.random.default_rng(seed)
        params = [self.embedding, *self.filters, self.bias, self.out, self.out_bias]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(win))
            for a in range(0, len(order), BATCH):
                x, y = win[order[a:a + BATCH]].astype(np.int64), label[order[a:a + BATCH]]
                grads = self.gradients(x, y)
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, size = x.shape
        emb = self.embedding[x]
        tops, best = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            views = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1)  # n, positions, e, w
            resp = np.tensordot(views, f.transpose(1, 0, 2), axes=([2, 3], [0, 1]))
            best.append(resp.argmax(axis=1))
            tops.append(np.take_along_axis(resp, best[-1][:, None], axis=1)[:, 0])
        pre = np.concatenate(tops, axis=1) + self.bias
        act = np.maximum(pre, 0)
        prob = softmax(act @ self.out + self.out_bias)
        prob[np.arange(n), y] -= 1
        prob /= n
        d_pre = (prob @ self.out.T) * (pre > 0)
        d_emb = np.zeros_like(self.embedding)
        d_filters = []
        rows = np.arange(n)[:, None]
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            d = d_pre[:, i * FILTERS:(i + 1) * FILTERS]
            g = np.zeros_like(f)
            for j in range(w):
                at = x[rows, best[i] + j]  # n, filters
                g[j] = np.einsum("nfe,nf->ef", self.embedding[at], d)
                np.add.at(d_emb, at.ravel(), (d[:, :, None] * f[j].T[None]).reshape(-1, EMBEDDING))
            d_filters.append(g)
        return [d_emb, *d_filters, d_pre.sum(axis=0), act.T @ prob, prob.sum(axis=0)]

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, the tables of its byte pairs: 65536 x filters."""
        out = []
        for f in self.filters:
            one = [self.embedding @ f[j] for j in range(len(f))]
            out.append([(one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS) for j in range(0, len(f), 2)])
        return out

    def probabilities(self, win: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        out = np.empty((len(win), len(self.langs)), np.float32)
        for a in range(0, len(win), TOGETHER):
            x = win[a:a + TOGETHER].astype(np.int32)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            tops = []
            for w, parts in zip(WIDTHS, tables, strict=True):
                n = x.shape[1] - w + 1
                resp = parts[0][pairs[:, :n]]
                for j, part in enumerate(parts[1:], 1):
                    resp += part[pairs[:, 2 * j:2 * j + n]]
                tops.append(resp.max(axis=1))
            act = np.maximum(np.concatenate(tops, axis=1) + self.bias, 0)
            out[a:a + TOGETHER] = softmax(act @ self.out + self.out_bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, per_language: int = TRAIN_TEXTS) -> ByteNet | None:
    """A network trained on a bounded sample of the labelled rows that are not held out."""
    m, r = HELD_OUT
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & (remainder(F.col("doc_id"), m) != r))
    sample = hash_sample(labelled.select("doc_id", "lang", "text"), "lang", per_language, ["doc_id", "text"])
    langs = sorted({x["lang"] for x in sample})
    if not langs:
        return None
    win, label, rng = [], [], np.random.default_rng(0)
    for x in sample:
        raw = np.frombuffer(x["text"].encode(), np.uint8)
        w, _, _ = windows_of(raw, np.array([0, len(raw)]))
        pick = rng.permutation(len(w))[:TRAIN_WINDOWS]
        win.append(w[pick])
        label += [langs.index(x["lang"])] * len(pick)
    net = ByteNet.fresh(langs)
    if label:
        net.train(np.concatenate(win), np.array(label))
    return net


def _predict_batches(batches: Iterator[pa.RecordBatch], net: ByteNet | None) -> Iterator[pa.RecordBatch]:
    tables = net.pair_tables() if net else None
    m, r = HELD_OUT
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            texts = batch.column(1)
            n = batch.num_rows
            lettered = np.fromiter((has_letter(t) for t in texts.to_pylist()), bool, n)
            lang, score = np.full(n, "und", object), np.where(lettered, 0.0, 1.0)
            if net:
                win, text, used = windows_of(*flat(texts))
                prob = net.probabilities(win, tables).astype(np.float64) * used[:, None]
                total = np.zeros((n, len(net.langs)))
                np.add.at(total, text, prob)
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
                best = total.argmax(axis=1)
                lang = np.where(lettered, np.array(net.langs, object)[best], lang)
                score = np.where(lettered, total[np.arange(n), best], score)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )


def identify(docs: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; trains a network unless one is given."""
    net = net or fit(docs)
    m, r = HELD_OUT
    work = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (remainder(F.col("doc_id"), m) == r).alias("held_out"),
    )
    return work.mapInArrow(partial(_predict_batches, net=net), "doc_id long, held_out boolean, lang_pred string, score double")
