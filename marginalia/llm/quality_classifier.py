"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is
encoded by counts of its bytes and words; a gated attention layer weighs the
passages, and a logistic layer scores their weighted sum. Weights are learned
from document labels alone.

Fitting takes at most ``max_fit_docs`` labelled rows, those with the smallest
hashes, and sees only their passage encodings, all of them; scoring reads all
rows.

Defined results: a null or empty text is a bag of one empty passage and gets
a score like any other; labels without a document, null labels and documents
without a label are not used for fitting; conflicting labels of one id all
count; without any labels every score is the prior 0.5; repeated rows and
rows that share an id are each scored; very long texts are bags of many
passages; no rows give no rows; other columns stay, a column named like the
score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Words, grams, slices, span_hashes, words
from .words import lines as split_lines

PASSAGE_WORDS = 96
#: The bound of the fitting sample, in documents.
MAX_FIT_DOCS = 6000

#: Bytes: lower, upper, digit, blank, line end, stop and comma, exclamation and
#: question mark, other punctuation, symbols, control, continuation, longer characters.
KINDS = 12


def _kinds() -> np.ndarray:
    out = np.full(256, 7, np.uint8)
    out[0:32] = out[127] = 9
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[32, 9]], out[[10, 13]], out[[46, 44]], out[[33, 63]] = 3, 4, 5, 6
    out[list(b"#*$%&|<>@_=~^{}[]\\/")] = 8
    out[128:192], out[192:] = 10, 11
    return out


_KIND = _kinds()


def _per(mask_sum: np.ndarray, by: np.ndarray) -> np.ndarray:
    return mask_sum / np.maximum(by, 1)


def _distinct(passage: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h in each of n passages."""
    order = np.lexsort((h, passage))
    p, v = passage[order], h[order]
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    return np.bincount(p[first], minlength=n)


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passage encodings (float32) and the first passage of each text, one more than texts."""
    w: Words = words(texts)
    n = len(texts)
    bags = np.maximum(-(-w.counts // PASSAGE_WORDS), 1)
    first = np.concatenate([[0], np.cumsum(bags)])
    total = int(first[-1])
    in_row = np.arange(len(w.start)) - w.first[w.row]
    passage = first[w.row] + in_row // PASSAGE_WORDS
    sizes = np.bincount(passage, minlength=total)
    # Bytes from a passage's first word to the next passage belong to it.
    opens = np.ones(len(passage), bool)
    opens[1:] = passage[1:] != passage[:-1]
    begin = np.empty(total, np.int64)
    begin[:] = np.repeat(w.text_start, bags)
    head = in_row[opens] > 0
    begin[passage[opens][head]] = w.start[opens][head]
    of_byte = np.repeat(np.arange(total), np.diff(np.append(begin, len(w.data))))
    kinds = np.bincount(of_byte * KINDS + _KIND[w.data], minlength=total * KINDS).reshape(total, KINDS)
    letters = np.maximum(kinds.sum(1) - kinds[:, 10], 1)
    low = words(texts, lower=True).hashes()
    length = (w.end - w.start).astype(float)
    mean = _per(np.bincount(passage, length, total), sizes)
    spread = np.sqrt(np.maximum(_per(np.bincount(passage, length**2, total), sizes) - mean**2, 0))
    g, at = grams(low, w, 2)
    inside = passage[at] == passage[np.minimum(at + 1, len(passage) - 1)] if len(at) else np.zeros(0, bool)
    pairs = np.bincount(passage[at[inside]], minlength=total)
    tail = _KIND[w.data[w.end - 1]] if len(w.end) else np.zeros(0, np.uint8)
    lead = _KIND[w.data[w.start]] if len(w.start) else np.zeros(0, np.uint8)
    short = np.bincount(passage[length <= 3], minlength=total)
    # Words and line bodies that the whole text repeats.
    row_distinct = _distinct(w.row, low, n)
    text_repeat = 1 - _per(row_distinct, w.counts)
    line, line_end, line_row = split_lines(w)
    lines = np.bincount(line_row, minlength=n)
    line_repeat = 1 - _per(_distinct(line_row, span_hashes(w.data, line, line_end), n), lines)
    columns = [
        *(kinds[:, k] / letters for k in range(KINDS)),
        mean / 8, spread / 8, _per(short, sizes),
        _per(_distinct(passage, low, total), sizes),
        _per(_distinct(passage[at[inside]], g[inside], total), pairs),
        _per(np.bincount(passage[tail == 5], minlength=total), sizes),
        _per(np.bincount(passage[tail == 6], minlength=total), sizes),
        _per(np.bincount(passage[tail == 8], minlength=total), sizes),
        _per(np.bincount(passage[lead == 1], minlength=total), sizes),
        np.log1p(sizes) / 5,
        np.repeat(np.log1p(w.counts) / 8, bags),
        np.repeat(text_repeat, bags), np.repeat(np.where(lines > 1, line_repeat, 0), bags),
        np.repeat(np.log1p(lines) / 5, bags),
        (sizes == 0).astype(float),
    ]
    return np.column_stack(columns).astype(np.float32), first


@dataclass
class Model:
    """Standardisation, encoder, gated attention and score weights."""

    centre: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @staticmethod
    def start(width: int, hidden: int, gate: int, seed: int) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        return {
            "w1": draw(width, hidden), "b1": np.zeros(hidden), "v": draw(hidden, gate), "u": draw(hidden, gate),
            "a": draw(gate, 1), "o": draw(hidden, 1), "c": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(first)
        x = np.clip((x - self.centre) / self.scale, -6, 6)
        h = np.maximum(x @ p["w1"] + p["b1"], 0)
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = ((t * g) @ p["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), sizes))
        weight = e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)
        pooled = np.add.reduceat(h * weight[:, None], first[:-1])
        score = 1 / (1 + np.exp(-np.clip((pooled @ p["o"])[:, 0] + p["c"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "pooled": pooled, "score": score}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(first)
        d = ((f["score"] - label) * weight / weight.sum())[:, None]
        dpool = np.repeat(d @ p["o"].T, sizes, 0)
        dh = dpool * f["weight"][:, None]
        # Softmax over a bag's passages.
        de = (f["weight"] * ((f["h"] - np.repeat(f["pooled"], sizes, 0)) * dpool).sum(1))[:, None]
        dtg = de @ p["a"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["v"].T + dg @ p["u"].T) * (f["h"] > 0)
        return {
            "w1": f["x"].T @ dh, "b1": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
            "a": (f["t"] * f["g"]).T @ de, "o": f["pooled"].T @ d, "c": d.sum(0),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, seed: int = 7) -> Model:
    """Adam on the cross-entropy, both labels weighing alike."""
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + 1e-3, Model.start(every.shape[1], hidden, gate, seed))
    labels = np.asarray(labels, float)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            f = model.forward(np.concatenate([bags[i] for i in chosen]), first)
            grads = model.gradients(f, first, labels[chosen], weight[chosen])
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
    max_fit_docs: int = MAX_FIT_DOCS,
) -> Model | None:
    """Fits on at most ``max_fit_docs`` labelled rows; None without any."""
    # The sample is bounded before texts are read: its ids are at most max_fit_docs.
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    sample = known.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"), F.xxhash64(key, label).alias("draw"))
    sample = sample.orderBy("draw", "key", "label").limit(max_fit_docs).select("key", "label")
    bags = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b):
                x, first = encode(s.column(1))
                packed = [x[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.record_batch([s.column(0), s.column(2), pa.array(packed, pa.binary())], ["key", "label", "bag"])

    rows = common.mapped(bags.select("key", "text", "label"), run, "key long, label int, bag binary").toPandas()
    if rows.empty or rows["label"].nunique() < 2:
        return None
    rows = rows.sort_values(["key", "label", "bag"], kind="stable")
    width = encode(pa.array([""]))[0].shape[1]
    return fit([np.frombuffer(x, np.float32).reshape(-1, width) for x in rows["bag"]], rows["label"].to_numpy())


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score (double, 0 to 1); all other columns stay."""
    from pyspark.sql import types as T

    base = docs.drop(name)
    if model is None:
        return base.withColumn(name, F.lit(0.5))
    names = base.columns
    schema = T.StructType([*base.schema, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, text):
                x, first = encode(s.column(s.schema.get_field_index(text)))
                yield pa.record_batch([*s.columns, pa.array(model.forward(x, first)["score"])], [*names, name])

    return common.mapped(base, run, schema)
