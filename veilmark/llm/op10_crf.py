"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's score comes from its own features and those of the lines before and after it; a
transition score couples neighbours. Forward-backward marginals, weighted by line length, make the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, table

#: The bounded sample that is fitted on: whole documents of each class.
SAMPLE_DOCS = 600
#: Lines that training takes at a time from each document; messages pass from block to block, so the result is that of whole chains.
BLOCK_LINES = 64
THRESHOLD = 0.7
_CLASSES = 9  # 0 space, 1 lower case and other letters, 2 upper case, 3 digit, 4 symbol, 5 bar, 6 exclamation mark, 7 other marks, 8 later bytes of a character
_CLASS = np.array(
    [
        8 if 128 <= b < 192 else 1 if b >= 192 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 0 if b <= 32 else 5 if b == 124 else 6 if b == 33 else 4 if chr(b) in "#$%&*<>@^~=+_\\/{}[]" else 7
        for b in range(256)
    ]
)
_OWN = 12
WIDTH = 3 * _OWN + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours and a constant, and the lines' lengths in code points."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, np.uint8)
    breaks = codes == 10
    line = np.cumsum(breaks) - breaks
    n = int(breaks.sum()) + 1
    counts = np.bincount(line * _CLASSES + _CLASS[codes], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    counts[:-1, 0] -= 1  # the line break itself
    length = counts[:, :8].sum(axis=1)
    size, letters = np.maximum(length, 1), counts[:, 1] + counts[:, 2]
    parts = raw.split(b"\n")
    seen: dict[bytes, int] = {}
    for part in parts:
        seen[part] = seen.get(part, 0) + 1
    own = np.column_stack(
        [
            counts[:, 2] / np.maximum(letters, 1),
            4 * counts[:, 3] / size,
            4 * counts[:, 4] / size,
            4 * counts[:, 5] / size,
            4 * counts[:, 6] / size,
            4 * counts[:, 7] / size,
            letters / size,
            np.log1p(length) / 5,
            length == 0,
            [seen[p] > 1 and bool(p.strip()) for p in parts],
            np.minimum((length - counts[:, 0]) / (counts[:, 0] + 1) / 10, 3),
            [p[-1:] in (b".", b"!", b"?") for p in parts],
        ]
    )
    pad = np.zeros((1, _OWN))
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), np.ones((n, 1))]), length


def marginals(emission: np.ndarray, same: tuple[float, float]) -> np.ndarray:
    """P(good) of each line; ``emission``: log odds of good by line, ``same``: scores of staying good and staying bad."""
    gg, bb = np.exp(np.clip(same, -20, 20)).tolist()
    odds = np.exp(np.clip(emission, -30, 30)).tolist()
    n = len(odds)
    ahead, p = [0.0] * n, 0.5
    for t in range(n):
        good, bad = (odds[t], 1.0) if not t else ((p * gg + 1 - p) * odds[t], p + (1 - p) * bb)
        p = good / (good + bad)
        ahead[t] = p
    back, out = 0.5, [0.0] * n
    for t in range(n - 1, -1, -1):
        good, bad = ahead[t] * back, (1 - ahead[t]) * (1 - back)
        out[t] = good / (good + bad) if good + bad else ahead[t]
        x, y = back * odds[t], 1 - back
        good, bad = gg * x + y, x + bb * y
        back = good / (good + bad)
    return np.array(out)


def _either(first: np.ndarray, second: np.ndarray, message: np.ndarray) -> np.ndarray:
    """What two unit messages lead to, put together for an actual one (..., 2), in logarithms."""
    return np.logaddexp(first + message[..., :1], second + message[..., 1:])


def _messages(score: np.ndarray, real: np.ndarray, hop: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of every line, (blocks, lines, 2) each, in logarithms.

    ``score`` has the scores of both states of each line, ``place`` the number of each block in its document, whose blocks
    follow each other. All blocks are worked through at once, for both unit messages that might reach them; then actual
    messages go from block to block of the documents.
    """
    n, lines = real.shape
    unit = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
    ahead, back = np.empty((2, n, lines, 2)), np.empty((2, n, lines, 2))
    for i in (0, 1):
        ahead[i, :, 0], back[i, :, -1] = score[:, 0] + unit[i], unit[i]
        for t in range(1, lines):
            ahead[i, :, t] = np.where(real[:, t, None], score[:, t] + _either(hop[0], hop[1], ahead[i, :, t - 1]), ahead[i, :, t - 1])
        for t in range(lines - 2, -1, -1):
            back[i, :, t] = np.where(real[:, t + 1, None], _either(hop[:, 0], hop[:, 1], score[:, t + 1] + back[i, :, t + 1]), unit[i])
    into, out = np.zeros((n, 2)), np.zeros((n, 2))
    by_place = [np.flatnonzero(place == j) for j in range(1, place.max() + 1)]
    for at in by_place:
        into[at] = _either(hop[0], hop[1], _either(ahead[0, at - 1, -1], ahead[1, at - 1, -1], into[at - 1]))
    for at in reversed(by_place):
        out[at - 1] = _either(hop[:, 0], hop[:, 1], score[at, 0] + _either(back[0, at, 0], back[1, at, 0], out[at]))
    return _either(*ahead, into[:, None]), _either(*back, out[:, None])


def train(features: list[np.ndarray], labels: np.ndarray, steps: int = 150, block: int = BLOCK_LINES) -> np.ndarray:
    """Weights of the line features, then the two transition scores, by Adam on the regularised likelihood of whole chains.

    Every line of a document carries the document's label. Documents are padded to blocks of ``block`` lines, which
    advance together; the result does not depend on their size but for rounding.
    """
    out = np.zeros(WIDTH + 2)
    if not features or len(set(labels.tolist())) < 2:
        return out
    good_docs, bad_docs = (labels == 1).sum(), (labels == 0).sum()
    cut = [(i // block, f[i : i + block], y, len(f)) for f, y in zip(features, labels, strict=True) for i in range(0, len(f), block)]
    place, lines = np.array([c[0] for c in cut]), np.array([c[3] for c in cut])
    labels = np.array([c[2] for c in cut], int)
    n, longest = len(cut), max(len(c[1]) for c in cut)
    x = np.zeros((n, longest, WIDTH))
    real = np.zeros((n, longest), bool)
    for i, (_, f, _, _) in enumerate(cut):
        x[i, : len(f)], real[i, : len(f)] = f, True
    later = np.flatnonzero(place > 0)
    y = np.repeat(labels[:, None] == 1, longest, axis=1)
    weight = np.where(labels == 1, 0.5 / good_docs, 0.5 / bad_docs) / np.sqrt(lines)
    first, second = np.zeros_like(out), np.zeros_like(out)
    for step in range(1, steps + 1):
        w, (gg, bb) = out[:WIDTH], np.clip(out[WIDTH:], -20, 20)
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = np.where(real, np.clip(x @ w, -30, 30), 0)
        hop = np.array([[bb, 0.0], [0.0, gg]])
        a, b = _messages(score, real, hop, place)
        total = np.logaddexp(a[:, -1, 0] + b[:, -1, 0], a[:, -1, 1] + b[:, -1, 1])
        good = np.exp(a[:, :, 1] + b[:, :, 1] - total[:, None])
        pairs = real[:, 1:] * weight[:, None]
        stay = []
        for s in (1, 0):
            within = np.exp(a[:, :-1, s] + hop[s, s] + score[:, 1:, s] + b[:, 1:, s] - total[:, None]) - (y[:, 1:] == s)
            between = np.exp(a[later - 1, -1, s] + hop[s, s] + score[later, 0, s] + b[later, 0, s] - total[later]) - (y[later, 0] == s)
            stay.append((pairs * within).sum() + (weight[later] * between).sum())
        slope = np.append(np.einsum("ntf,nt->f", x, (good - y) * real * weight[:, None]), stay) + 2e-3 * out
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        out = out - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> np.ndarray:
    """Fit in one task on the line features of the bounded sample's whole documents; the driver gets the few weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "label": []}), *batches]).sort_values(["text", "label"], kind="stable")
        w = train([line_features(t)[0] for t in rows["text"]], rows["label"].to_numpy(int))
        yield pd.DataFrame({"w": [w]})

    found = labelled_sample(docs, labels, "quality", per_class).repartition(1).mapInPandas(run, "w array<double>").first()
    return np.zeros(WIDTH + 2) if found is None else np.array(found["w"])


def scorer(weights: np.ndarray):
    """A column function: the quality of a text."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        same = (float(weights[-2]), float(weights[-1]))
        for batch in texts:
            out = []
            for text in batch:
                x, length = line_features(text)
                good = marginals(x @ weights[:WIDTH], same)
                out.append(float((good * length).sum() / length.sum()) if length.sum() else float(good.mean()))
            yield pd.Series(out, dtype=float)

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each input row (doc_id, text).

    Learns labels only from rows whose crc32(doc_id as text) mod 4 is not 2 (a null id counts as an empty string). Null
    and empty texts are one empty line and get that line's probability; without labels of both kinds every score is one
    half. Nothing but the text enters a score; other columns are ignored.
    """
    held_out = crc_mod("doc_id", 4) == 2
    score = scorer(fit(docs, labels.where(crc_mod("doc_id", 4) != 2)))
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
