"""Language identification by a byte convolutional network (operator 9).

The network embeds bytes, applies filters of widths 2, 3 and 4, pools each
filter's maximum over a window of 256 bytes and ends in a softmax. It is trained in
numpy on windows of a bounded sample of labelled documents and applied to all
windows of every whole text; a document's class is the one with the greatest mean
probability, weighted by the windows' bytes.

Edge cases: null text and text without a letter are `und` with score 0; a null id
is never learned from and is not held out; without any labelled document every text
is `und`; texts of any length go through in steps of a fixed number of windows; repeated rows give repeated
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_caches, utf8

WINDOW, WIDTHS, EMBED, FILTERS = 256, (2, 3, 4), 8, 12
#: Windows that one step of the forward pass holds.
STEP_WINDOWS = 96


@dataclass
class ByteCNN:
    """Weights; `classes` are the labels in order."""

    classes: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (max width * EMBED) x all filters; zero beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of the filters over each window, and an array view of the patches."""
        wide = np.zeros((len(windows), WINDOW + max(WIDTHS) - 1), np.uint8)
        wide[:, :WINDOW] = windows
        e = self.embed[wide]
        patches = np.lib.stride_tricks.as_strided(
            e, (len(windows), WINDOW, max(WIDTHS) * EMBED), (e.strides[0], e.strides[1], e.strides[2]), writeable=False
        )
        return np.ascontiguousarray(patches).reshape(-1, max(WIDTHS) * EMBED) @ self.filters, wide

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        best = self.pooled(windows)[0].reshape(len(windows), WINDOW, -1).max(axis=1)
        return _softmax(np.maximum(best + self.bias, 0) @ self.dense + self.dense_bias)

    def of_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each row's windows, weighted by their bytes. A step holds
        `STEP_WINDOWS` windows, however long a row is."""
        row, start, used = places_of(offsets)
        total = np.zeros((len(offsets) - 1, len(self.classes)))
        for k in range(0, len(row), STEP_WINDOWS):
            s = slice(k, k + STEP_WINDOWS)
            p = self.probabilities(windows_at(data, start[s], used[s])) * used[s][:, None]
            heads = np.flatnonzero(np.r_[True, row[s][1:] != row[s][:-1]])
            total[row[s][heads]] += np.add.reduceat(p, heads)
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def places_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and bytes of the fixed windows over all bytes of each row."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * WINDOW
    return row, start, np.minimum(WINDOW, offsets[1:][row] - start)


def windows_at(data: np.ndarray, start: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The windows that start there, filled up with zeros."""
    at = np.minimum(start[:, None] + np.arange(WINDOW), max(len(data) - 1, 0))
    windows = data[at]
    windows[np.arange(WINDOW) >= used[:, None]] = 0
    return windows


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], *, epochs: int = 6, seed: int = 7) -> ByteCNN:
    """Adam on the cross-entropy; the gradient passes a maximum only where it was taken."""
    rng = np.random.default_rng(seed)
    n_filters, span = FILTERS * len(WIDTHS), max(WIDTHS) * EMBED
    mask = np.concatenate([np.repeat((np.arange(span) < w * EMBED)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    w = [f32(256, EMBED, scale=0.5), f32(span, n_filters, scale=0.3) * mask, np.zeros(n_filters, np.float32), f32(n_filters, len(classes), scale=0.2), np.zeros(len(classes), np.float32)]
    moment, square, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            n = len(own)
            net = ByteCNN(classes, *w)
            out, wide = net.pooled(windows[own])
            out = out.reshape(n, WINDOW, n_filters)
            at = out.argmax(axis=1)
            best = np.take_along_axis(out, at[:, None], axis=1)[:, 0] + w[2]
            hidden = np.maximum(best, 0)
            d = _softmax(hidden @ w[3] + w[4]).astype(np.float32)
            d[np.arange(n), labels[own]] -= 1
            d /= n
            d_hidden = (d @ w[3].T) * (best > 0)
            codes = wide[np.arange(n)[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]  # n x filters x width
            patch = w[0][codes].reshape(n, n_filters, span)
            d_filters = np.einsum("nfs,nf->sf", patch, d_hidden) * mask
            d_patch = (d_hidden[:, :, None] * w[1].T).reshape(-1, EMBED)
            d_embed = np.zeros_like(w[0])
            np.add.at(d_embed, codes.reshape(-1), d_patch)
            step += 1
            for i, g in enumerate((d_embed, d_filters, d_hidden.sum(axis=0), hidden.T @ d, d.sum(axis=0))):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                w[i] = (w[i] - rate * moment[i] / (np.sqrt(square[i]) + 1e-8)).astype(np.float32)
    return ByteCNN(classes, *w)


def fit(
    labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 1200, windows_per_doc: int = 3
) -> ByteCNN | None:
    """Train on about `per_label` documents of each label, chosen by a hash of the id,
    and `windows_per_doc` windows spread over each. This bound on the sample (not the
    data) sets what comes to the driver: per_label * windows_per_doc * 256 bytes a label.
    None without any labelled text."""
    keyed = labelled.select(
        F.col(id_col).cast("string").alias("k"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")
    ).filter("k is not null and label is not null and text is not null and text <> ''")
    totals = keyed.groupBy("label").agg(F.count("*").alias("n")).collect()  # a row for each label
    if not totals:
        return None
    share = F.lit(0.0)
    for r in totals:
        share = F.when(F.col("label") == r["label"], min(1.0, per_label / r["n"])).otherwise(share)
    chosen = keyed.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share * 1_000_000)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("langid")
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            row, start, used = places_of(offsets)
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            count = np.bincount(row, minlength=batch.num_rows)[row]
            keep = np.flatnonzero((nth * windows_per_doc) % count < windows_per_doc)
            windows = windows_at(data, start[keep], used[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pa.array(row[keep])) for i in (0, 1)] + [pa.array([w.tobytes() for w in windows], pa.binary())],
                names=["k", "label", "window"],
            )

    got = chosen.mapInArrow(cut, "k string, label string, window binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["k", "window"], kind="stable")
    classes = sorted(got["label"].unique())
    windows = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.searchsorted(classes, got["label"].to_numpy(str)), classes)


def predict(docs: DataFrame, net: ByteCNN | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id, `keep`'s columns (but lang_pred and score), lang_pred and score. A
    narrow map over the scan."""
    own = [id_col, *(c for c in keep or [] if c not in ("lang_pred", "score"))]
    carried = [f"carry_{i}" for i in range(len(own))]
    kinds = ", ".join(f"{c} {docs.schema[k].dataType.simpleString()}" for c, k in zip(carried, own))
    text = F.col(text_col).cast("string")
    chosen = docs.select(*(F.col(k).alias(c) for c, k in zip(carried, own)), text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("langid")
        for batch in batches:
            data, offsets = utf8(batch.column(len(carried)))
            letters = batch.column(len(carried) + 1).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            if net is not None and letters.any():
                total = net.of_rows(data, offsets)
                best = total.argmax(axis=1)
                pred[letters] = np.array(net.classes, object)[best[letters]]
                score[letters] = np.clip(total[np.arange(n), best], 0, 1)[letters]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(carried))] + [pa.array(pred, pa.string()), pa.array(score)], names=[*carried, "lang_pred", "score"]
            )

    out = chosen.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*(F.col(c).alias(k) for c, k in zip(carried, own)), "lang_pred", "score")


def held_out(id_col: str):
    """Whether a document is kept for testing: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **sample) -> DataFrame:
    """Train on the rows that are not held out; per row: id, held_out, lang_pred, score."""
    net = fit(docs.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, label_col=label_col, **sample)
    out = predict(docs, net, id_col=id_col, text_col=text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
