"""Language of whole texts by a bidirectional gated recurrent network over bytes.

Every byte position gets a probability for each language from a forward and a backward recurrent state; a document's probability is
the mean over its positions. The network is trained in numpy by backpropagation through time. It reads a text in windows
of WINDOW bytes, each from a zero state, so that thousands of windows advance together by matrix products.

Learning uses a bounded sample of the labelled rows: about SAMPLE rows of each language, picked by a hash of the id (a parameter);
prediction covers every byte of every text and uses the text alone.

Defined cases: `und` with score 0 where the text is null or has no letter, or where no labelled row exists to learn from. Repeated
rows get equal predictions. With one language learned, it is the answer for every text with a letter. Rows without an id are drawn by their texts. More than LABELS labels are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, small_batches, text_of

UNKNOWN = "und"
HIDDEN = 10
#: Bytes that the network goes through at once: STRIDE of their own, with LAP on either side, so that no position is judged from a state that has just begun.
STRIDE, LAP = 48, 8
WINDOW = STRIDE + 2 * LAP
#: Rows of each language and code points of each row to learn from. Bounds what the driver holds: languages x SAMPLE x EXCERPT.
SAMPLE, EXCERPT = 150, 1500
#: Labels that a column of languages may hold; one with more is no such column, which is an error, so that no label is left out in silence.
LABELS = 2000
STEPS, BATCH, RATE = 260, 192, 0.02
#: Windows that advance together.
TOGETHER = 4096


def squash(x: np.ndarray) -> np.ndarray:
    """A rational tanh, exactly 1 in size from 3 on. Changes x."""
    np.clip(x, -3, 3, out=x)
    s = x * x
    x *= s + 27
    s *= 9
    s += 27
    x /= s
    return x


def slope(x: np.ndarray) -> np.ndarray:
    """Derivative of squash at x."""
    s = np.minimum(x * x, 9)
    return ((s - 9) / (3 * s + 9)) ** 2


@dataclass
class Network:
    """For each direction (forward, backward): byte inputs (256, 3H) for update, reset and candidate; recurrent (H, 2H) and (H, H). Then
    the output (2H, languages) with its bias."""

    inputs: list[np.ndarray]
    gates: list[np.ndarray]
    candidate: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.gates, *self.candidate, self.out, self.bias]


def started(languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    new = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    both = range(2)
    return Network([new(256, 3 * hidden, scale=0.5) for _ in both], [new(hidden, 2 * hidden, scale=0.3) for _ in both], [new(hidden, hidden, scale=0.3) for _ in both], new(2 * hidden, len(languages), scale=0.3), np.zeros(len(languages), np.float32), languages)


def states(net: Network, x: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
    """Hidden states (window, position, H) of windows x (window, position) of bytes, in the text's order. keep: gets what learning needs."""
    n, steps = x.shape
    table, gates, candidate = net.inputs[direction], net.gates[direction], net.candidate[direction]
    hidden = candidate.shape[0]
    h = np.zeros((n, hidden), np.float32)
    out = np.empty((steps, n, hidden), np.float32)
    columns = np.ascontiguousarray(x.T)
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        a = table.take(columns[t], axis=0)
        pre = a[:, : 2 * hidden] + h @ gates
        if keep is not None:
            before = pre.copy()
        # The logistic function by the same curve: (1 + squash(x / 2)) / 2.
        pre *= 0.5
        g = squash(pre)
        g *= 0.5
        g += 0.5
        update, reset = g[:, :hidden], g[:, hidden:]
        held = reset * h
        own = a[:, 2 * hidden :] + held @ candidate
        if keep is not None:
            keep.append((t, h, before, g, held, own.copy()))
        c = squash(own)
        c -= h
        c *= update
        h = h + c
        out[t] = h
    return out


def positions(net: Network, x: np.ndarray) -> np.ndarray:
    """Probability of each language at each position: (position, window, language)."""
    half = net.candidate[0].shape[0]
    z = states(net, x, 0) @ net.out[:half]
    z += states(net, x, 1) @ net.out[half:]
    z += net.bias
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=2, keepdims=True)
    return z


def gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over the positions in mask, by backpropagation through time."""
    hidden = net.candidate[0].shape[0]
    kept: tuple[list, list] = ([], [])
    h = [states(net, x, d, kept[d]) for d in range(2)]
    z = h[0] @ net.out[:hidden] + h[1] @ net.out[hidden:] + net.bias
    z = np.exp(z - z.max(axis=2, keepdims=True))
    z /= z.sum(axis=2, keepdims=True)
    z[:, np.arange(len(y)), y] -= 1
    z *= (mask.T / mask.sum())[:, :, None]
    to_out = np.concatenate([np.tensordot(h[d], z, ((0, 1), (0, 1))) for d in range(2)])
    inputs, gates, candidates = [], [], []
    for d in range(2):
        to_inputs, to_gates, to_candidate = np.zeros_like(net.inputs[d]), np.zeros_like(net.gates[d]), np.zeros_like(net.candidate[d])
        carried = np.zeros_like(kept[d][0][1])
        from_out = z @ net.out[d * hidden : (d + 1) * hidden].T
        for t, before_h, before, g, held, own in reversed(kept[d]):
            dh = carried + from_out[t]
            update, reset = g[:, :hidden], g[:, hidden:]
            c = squash(own.copy())
            d_own = dh * update * slope(own)
            d_held = d_own @ net.candidate[d].T
            d_gate = np.concatenate([dh * (c - before_h), d_held * before_h], axis=1) * slope(before * 0.5) * 0.25
            carried = dh * (1 - update) + d_held * reset + d_gate @ net.gates[d].T
            to_candidate += held.T @ d_own
            to_gates += before_h.T @ d_gate
            np.add.at(to_inputs, x[:, t], np.concatenate([d_gate, d_own], axis=1))
        inputs.append(to_inputs), gates.append(to_gates), candidates.append(to_candidate)
    return [*inputs, *gates, *candidates, to_out, z.sum(axis=(0, 1))]


def windows(data: bytes) -> np.ndarray:
    """(window, byte): each STRIDE bytes with their surroundings. 0 is padding; where a text has such a byte it counts as a space."""
    rows = max(1, -(-len(data) // STRIDE))
    padded = (b"\0" * LAP + data.replace(b"\0", b" ")).ljust(rows * STRIDE + 2 * LAP, b"\0")
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(padded, np.uint8), WINDOW)[::STRIDE]


def trained(rows: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS) -> Network:
    """From (text, language): Adam on random windows, as many of each language."""
    languages = sorted({lang for _, lang in rows})
    net = started(languages, hidden)
    rng = np.random.default_rng(7)
    by = [np.concatenate([windows(t.encode("utf-8", "replace")) for t, lang in rows if lang == own]) for own in languages]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    each = max(8, BATCH // len(languages))
    for step in range(1, steps + 1):
        if len(languages) == 1:
            break
        x = np.concatenate([w[rng.integers(0, len(w), each)] for w in by])
        y = np.repeat(np.arange(len(languages)), each)
        mask = (x > 0).astype(np.float32)
        rate = RATE * (1 - step / (steps + 1))
        for p, g, (m, v) in zip(net.parameters(), gradients(net, x, y, mask), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """Mean probability over each text's positions: (text, language)."""
    data = [t.encode("utf-8", "replace") for t in texts]
    x = np.concatenate([windows(d) for d in data])
    rows = np.array([max(1, -(-len(d) // STRIDE)) for d in data])
    own = slice(LAP, LAP + STRIDE)
    sums = np.empty((len(x), len(net.languages)), np.float64)
    for k in range(0, len(x), TOGETHER):
        part = x[k : k + TOGETHER]
        sums[k : k + TOGETHER] = np.einsum("twl,wt->wl", positions(net, part)[own], (part[:, own] > 0).astype(np.float32))
    first = np.concatenate([[0], np.cumsum(rows)[:-1]])
    totals = np.add.reduceat(sums, first, axis=0)
    return totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-12)


def training_rows(df: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """About `sample` excerpts a language, by a hash of the id; first a count of the labels, then one read of the picked rows."""
    labelled = df.where(may_learn & F.col(lang_col).isNotNull() & text_of(text_col).rlike(r"\p{L}"))
    labels = df.where(may_learn & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.lang: r.n for r in labels.limit(LABELS + 1).collect()}
    if len(counts) > LABELS:
        raise ValueError(f"column {lang_col!r} holds more than {LABELS} labels")
    if not counts:
        return []
    # By the id, or the text of a row without one.
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), text_of(text_col)), F.lit("lang")), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])[F.col(lang_col)]
    text = text_of(text_col)
    start = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.greatest(F.length(text) - EXCERPT, F.lit(1))).cast("int")
    picked = labelled.where(draw < share).select(F.substring(text, start + 1, F.lit(EXCERPT)).alias("excerpt"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    # By the same draw, should rows repeat ids and so come in bunches.
    return sorted((r.excerpt, r.lang) for r in picked.orderBy("draw", "lang", "excerpt").limit(2 * sample * len(counts)).collect())


def learn(df: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    rows = training_rows(df, may_learn, id_col, text_col, lang_col)
    return trained(rows) if rows else None


def predictor(net: Network | None):
    """A pandas UDF of a text column: struct<lang_pred, score>."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        has = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        if net is not None and has:
            p = pooled(net, [texts.iloc[i] for i in has])
            lang[has] = np.array(net.languages, dtype=object)[p.argmax(axis=1)]
            score[has] = np.clip(p.max(axis=1), 0, 1)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(id_col), F.lit(4)) == 2


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score. Rows whose crc32(id) mod 4 is 2 are held out from learning."""
    small_batches(df.sparkSession)
    net = learn(df, ~held_out(id_col), id_col, text_col, lang_col)
    found = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("body")).withColumn("found", predictor(net)("body"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
