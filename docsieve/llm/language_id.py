"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into windows. A gated recurrent unit reads each window forwards, another one backwards; both states
at a position give the probability of each language there, so every position is labelled. A document's
probabilities are the means over all its positions, and the largest is the prediction.

The network is trained in numpy by backpropagation through time, on the driver, from a bounded sample of labelled rows:
SAMPLE documents of each language, SLICES pieces of each. Prediction runs over all rows in tasks, a slice at a time.

Defined cases: `und` with score 0 for a text that is null or has no letter. Whole texts are read, whatever
their length. Equal probabilities go to the language first in order. Without labelled rows there is
nothing to learn: every text is `und`. Columns beside id, text and language aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm import shared

#: Documents of each language that training may see, and pieces of each document.
SAMPLE, SLICES = 256, 16
#: Bytes in a window, units in each direction, symbol that fills a last window.
WINDOW, UNITS, FILL = 64, 10, 256
#: Windows that a task holds at a time.
_LANES = 4096
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """0.5 + 0.5 * tanh(x / 2), in place."""
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    np.multiply(x, np.float32(0.5), out=x)
    return np.add(x, np.float32(0.5), out=x)


class BytesGru:
    """Weights by direction: `inputs` (3 units x symbols), `recurrent` (3 units x units), `out` (languages x units); and the languages' bias."""

    def __init__(self, langs: list[str], units: int = UNITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.langs, self.units = langs, units
        self.w = {"bias": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.w |= {f"inputs_{d}": f(3 * units, FILL + 1, scale=0.5), f"recurrent_{d}": f(3 * units, units, scale=units**-0.5), f"out_{d}": f(len(langs), units, scale=0.3)}

    def _run(self, symbols: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Contribution of one direction to the scores: (positions, languages, lanes). symbols: (positions, lanes)."""
        n, (steps, lanes) = self.units, symbols.shape
        inputs, recurrent, out = (self.w[f"{k}_{d}"] for k in ("inputs", "recurrent", "out"))
        h = np.zeros((n, lanes), np.float32)
        scores = np.empty((steps, len(self.langs), lanes), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = np.take(inputs, symbols[t], axis=1, mode="clip")
            u = recurrent @ h
            gates = _sigmoid(a[: 2 * n] + u[: 2 * n])
            update, reset = gates[:n], gates[n:]
            new = np.tanh(a[2 * n :] + reset * u[2 * n :])
            if keep is not None:
                keep.append((t, h, update, reset, u[2 * n :], new))
            h = new + update * (h - new)
            np.matmul(out, h, out=scores[t])
        return scores

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """Of each language at each position: (positions, languages, lanes)."""
        scores = self._run(symbols, "f")
        scores += self._run(symbols, "b")
        scores += self.w["bias"][:, None]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def gradients(self, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions that hold a byte, and its gradient, by backpropagation through time."""
        n, steps = self.units, len(symbols)
        kept: dict[str, list] = {"f": [], "b": []}
        scores = self._run(symbols, "f", kept["f"]) + self._run(symbols, "b", kept["b"]) + self.w["bias"][:, None]
        scores = np.exp(scores - scores.max(1, keepdims=True))
        p = scores / scores.sum(1, keepdims=True)
        mask = (symbols != FILL).astype(np.float32)
        total, lanes = mask.sum(), np.arange(symbols.shape[1])
        loss = float(-(np.log(p[:, labels, lanes] + 1e-9) * mask).sum() / total)
        p[:, labels, lanes] -= 1
        p *= (mask / total)[:, None, :]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["bias"] += p.sum((0, 2))
        for d in "fb":
            recurrent, out = self.w[f"recurrent_{d}"], self.w[f"out_{d}"]
            g_inputs = grads[f"inputs_{d}"].T
            dh = np.zeros((n, symbols.shape[1]), np.float32)
            for t, h, update, reset, u, new in reversed(kept[d]):
                state = new + update * (h - new)
                grads[f"out_{d}"] += p[t] @ state.T
                dh = dh + out.T @ p[t]
                d_new = dh * (1 - update) * (1 - new * new)
                d_update = dh * (h - new) * update * (1 - update)
                d_reset = d_new * u * reset * (1 - reset)
                d_u = np.concatenate([d_update, d_reset, d_new * reset])
                np.add.at(g_inputs, symbols[t], np.concatenate([d_update, d_reset, d_new]).T)
                grads[f"recurrent_{d}"] += d_u @ h.T
                dh = dh * update + recurrent.T @ d_u
        assert steps
        return loss, grads


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 320, batch: int = 192, rate: float = 0.02, seed: int = 5) -> BytesGru:
    """Fits the network to windows (lanes, positions) with a label each, by Adam; every language is drawn equally often."""
    model, rng = BytesGru(langs), np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == k) for k in range(len(langs))]
    mean = {k: np.zeros_like(v) for k, v in model.w.items()}
    spread = {k: np.zeros_like(v) for k, v in model.w.items()}
    for step in range(1, steps + 1):
        at = np.array([rng.choice(by_label[k]) for k in rng.integers(0, len(langs), batch)])
        _, grads = model.gradients(np.ascontiguousarray(windows[at].T), labels[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            model.w[k] = (model.w[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (lanes, positions) over all bytes of the texts, the last of each filled up, and the text of each."""
    count = -(-np.diff(offsets) // WINDOW)
    owner = np.repeat(np.arange(len(count)), count)
    begin = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    at = begin[:, None] + np.arange(WINDOW)
    out = np.append(data, 0)[np.minimum(at, len(data))].astype(np.int16)
    out[at >= offsets[1:][owner][:, None]] = FILL
    return out, owner


def pooled(model: BytesGru, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability of each language over all positions of each text: (texts, languages)."""
    windows, owner = cut(data, offsets)
    total = np.zeros((len(offsets) - 1, len(model.langs)))
    for a in range(0, len(owner), _LANES):
        symbols = np.ascontiguousarray(windows[a : a + _LANES].T)
        p = model.probabilities(symbols)
        sums = np.einsum("tcl,tl->lc", p, (symbols != FILL).astype(np.float32))
        for c in range(len(model.langs)):
            total[:, c] += np.bincount(owner[a : a + _LANES], sums[:, c], minlength=len(total))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def sample(labelled: DataFrame, per_lang: int = SAMPLE, slices: int = SLICES) -> pd.DataFrame:
    """At most per_lang rows of each language, those of the smallest hashes of (id, text), as pieces spread evenly over the text.

    The counts of the languages give a hash limit that some more rows pass, so that no more of them reach the driver.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.abs(F.hash("doc_id", "text") % 1000003))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return pd.DataFrame({"lang": [], "pieces": []})
    share = {r["lang"]: min(1.0, (2 * per_lang + 64) / r["count"]) for r in counts}
    limit = F.element_at(F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(v * 1000003) + 1))), F.col("lang"))
    step = F.greatest(F.length("text") / slices, F.lit(WINDOW))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.substring(F.col("text"), F.floor(i * step).cast("int") + 1, F.lit(WINDOW)))
    found = rows.where(F.col("h") < limit).select("lang", "h", "doc_id", F.filter(pieces, lambda x: F.length(x) > 0).alias("pieces")).toPandas()
    return found.sort_values(["lang", "h", "doc_id"]).groupby("lang").head(per_lang)


def fit(labelled: DataFrame, per_lang: int = SAMPLE) -> BytesGru | None:
    """A network trained on a bounded sample of (doc_id, text, lang) rows; None without labelled text."""
    found = sample(labelled, per_lang)
    langs = sorted(set(found["lang"]))
    windows, labels = [], []
    for lang, pieces in zip(found["lang"], found["pieces"], strict=True):
        for piece in pieces:
            raw = np.frombuffer(piece.encode()[:WINDOW], np.uint8).astype(np.int16)
            windows.append(np.concatenate([raw, np.full(WINDOW - len(raw), FILL, np.int16)]))
            labels.append(langs.index(lang))
    return train(np.array(windows), np.array(labels), langs) if windows else None


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: BytesGru | None, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, lang_pred and score of every row."""
    lettered = docs.select(*id_cols, F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("__text"))
    if model is None:
        return lettered.select(*id_cols, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    langs = np.array([*model.langs, UNKNOWN], object)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in shared.text_slices(batch.column(len(id_cols))):
                p = pooled(model, data, offsets)
                best = p.argmax(1)
                none = np.diff(offsets) == 0
                score = np.clip(np.where(none, 0.0, p[np.arange(len(p)), best]), 0.0, 1.0)
                names = langs[np.where(none, len(model.langs), best)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(id_cols))), pa.array(names, pa.string()), pa.array(score)], names=[*id_cols, "lang_pred", "score"])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in lettered.drop("__text").schema)
    return lettered.mapInArrow(label, f"{kinds}, lang_pred string, score double")


def identified(docs: DataFrame, model: BytesGru | None, least: float, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text has no letter, or whose prediction has a score under least. Columns stay as they are."""
    lettered = docs.where(has_letter(F.col(text_col)))
    if model is None:
        return lettered.limit(0)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in shared.text_slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(pooled(model, data, offsets).max(1) >= least))

    return lettered.mapInArrow(keep, docs.schema)


def op1(docs: DataFrame) -> DataFrame:
    """Per document of a table (doc_id, text, lang): held_out, lang_pred and score. Held-out rows (crc32 of the id as text, modulo 4, is 2) teach nothing."""
    rows = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = fit(rows.where("NOT held_out").select("doc_id", "text", "lang"))
    return predict(rows, model, ["doc_id", "held_out"])
