"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded from what its bytes and words look like; a learnt layer turns that into a
hidden vector, gated attention (a tanh branch times a sigmoid branch) gives each passage a weight from document labels alone,
and a logistic layer scores the weighted mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, pick, remainder, slices, texts_of

#: Byte classes, each a part of the encoding: bytes not named are of the last.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "*#$%&@^~+=<>_\\/", "\"'()[]{}-", "")
KIND = bytes(next((i for i, s in enumerate(CLASSES) if chr(c) in s), len(CLASSES) - 1) if c < 128 else len(CLASSES) for c in range(256))
#: Passage length in bytes, and the size of an encoding: byte classes, words, mean word length, repeats of the last and the last but one word, log of the length.
PASSAGE, WIDTH = 512, len(CLASSES) + 1 + 5


def encoded(texts: list[bytes], piece: int = 2_000_000):
    """Encodings of all passages (rows) and the number of passages of each text; an empty text is one passage of zeros."""
    import numpy as np

    rows, sizes = [], []
    start = 0
    while start < len(texts):  # so many texts at once that their bytes stay bounded, whatever one of them holds
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end]) <= piece):
            total += len(texts[end])
            end += 1
        r, s = _encoded(texts[start:end])
        rows.append(r)
        sizes.append(s)
        start = end
    return (np.concatenate(rows), np.concatenate(sizes)) if rows else (np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64))


def _encoded(texts: list[bytes]):
    import numpy as np

    size = np.array([len(t) for t in texts], np.int64)
    bags = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    n = int(first[-1])
    out = np.zeros((n, WIDTH), np.float32)
    b = np.frombuffer(b"".join(texts), np.uint8)
    if not len(b):
        return out, bags
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(len(b)) - np.repeat(begin, size)
    passage = np.repeat(first[:-1], size) + at // PASSAGE
    kind = np.frombuffer(KIND, np.uint8)[b]
    k = len(CLASSES) + 1
    counts = np.bincount(passage * k + kind, minlength=n * k).reshape(n, k)
    length = np.maximum(counts.sum(1), 1)
    out[:, :k] = counts / length[:, None]
    blank = (kind == 3) | (kind == 4)
    head = ~blank & np.concatenate([[True], blank[:-1]]) | (~blank & (at == 0))
    tail = ~blank & np.concatenate([blank[1:], [True]]) | (~blank & np.concatenate([at[1:] == 0, [True]]))
    h, t = np.flatnonzero(head), np.flatnonzero(tail)
    where = passage[h]
    words = np.maximum(np.bincount(where, minlength=n), 1)
    # A word's hash: a sum over its bytes of a random number of the byte times powers by place, from running sums.
    mark = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER)
    spot = np.arange(len(b)) - np.repeat(h, np.diff(np.concatenate([h, [len(b)]]))) if len(h) and h[0] == 0 else np.arange(len(b)) - np.concatenate([np.zeros(h[0] if len(h) else len(b), np.int64), np.repeat(h, np.diff(np.concatenate([h, [len(b)]])))])
    mark = mark * (np.uint64(2) * np.minimum(spot, 60).astype(np.uint64) ** np.uint64(3) + np.uint64(1))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mark, dtype=np.uint64)])
    word = run[t + 1] - run[h] if len(h) else np.zeros(0, np.uint64)
    doc = np.searchsorted(begin, h, "right")
    for j, lag in ((k + 2, 1), (k + 3, 2)):
        if len(h) > lag:
            same = (word[lag:] == word[:-lag]) & (doc[lag:] == doc[:-lag])
            out[:, j] = np.bincount(where[lag:], weights=same, minlength=n) / words
    out[:, k] = np.bincount(where, minlength=n) / length
    out[:, k + 1] = np.bincount(where, weights=t + 1 - h, minlength=n) / words / 20
    out[:, k + 4] = np.log1p(counts.sum(1)) / 7
    return out, bags


class Model:
    """Weights: w (width x hidden), b, v and u (hidden x gate), a (gate), o (hidden), c; mean and spread of the encodings."""

    def __init__(self, parts: dict):
        self.parts = parts

    def scores(self, x, bags):
        import numpy as np

        p = self.parts
        h = np.tanh(((x - p["mean"]) / p["spread"]) @ p["w"] + p["b"])
        e = np.exp(np.clip((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"], -20, 20))
        first = np.concatenate([[0], np.cumsum(bags)[:-1]]).astype(np.int64)
        z = np.add.reduceat(h * e[:, None], first) / np.add.reduceat(e, first)[:, None]
        return 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))


def fitted(x, bags, y, hidden: int = 16, gate: int = 8, rounds: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the mean log loss of the bags."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mean, spread = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    p = {"w": rng.normal(0, 0.3, (x.shape[1], hidden)), "b": np.zeros(hidden), "v": rng.normal(0, 0.3, (hidden, gate)), "u": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate), "o": rng.normal(0, 0.3, hidden), "c": np.zeros(1)}
    if not len(bags):
        return Model(p | {"mean": mean, "spread": spread})
    xs = (x - mean) / spread
    first = np.concatenate([[0], np.cumsum(bags)[:-1]]).astype(np.int64)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    n = len(bags)
    for step in range(1, rounds + 1):
        h = np.tanh(xs @ p["w"] + p["b"])
        tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = np.exp(np.clip((tv * su) @ p["a"], -20, 20))
        att = e / np.repeat(np.add.reduceat(e, first), bags)
        z = np.add.reduceat(h * att[:, None], first)
        d = (1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30))) - y) / n
        g = {"o": z.T @ d, "c": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * p["o"], bags, axis=0)
        dh = dz * att[:, None]
        da = (dz * h).sum(1)
        de = att * (da - np.repeat(np.add.reduceat(att * da, first), bags))
        g["a"] = (tv * su).T @ de
        dtv, dsu = de[:, None] * p["a"] * su * (1 - tv**2), de[:, None] * p["a"] * tv * su * (1 - su)
        g["v"], g["u"] = h.T @ dtv, h.T @ dsu
        dh = (dh + dtv @ p["v"].T + dsu @ p["u"].T) * (1 - h**2)
        g["w"], g["b"] = xs.T @ dh, dh.sum(0)
        for k in p:
            grad = g[k] + decay * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad**2
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model({k: v.astype(np.float32) for k, v in (p | {"mean": mean, "spread": spread}).items()})


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, folds: int = 5) -> Model:
    """Learns from at most `most` labelled documents, the first by hash of the id among those whose crc32(doc_id) mod folds is not 0.

    Labels that repeat an id count once, as the largest of them; null labels and ids teach nothing. A document's label is that of its
    id, so rows that repeat one all count.

    Their passages are encoded on the executors; the driver gets encodings only."""
    import numpy as np

    own = pick(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where((remainder(F.col("doc_id"), folds) != 0) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    ids = own.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(most)
    t = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            x, bags = encoded(texts_of(batch))
            at = np.concatenate([[0], np.cumsum(bags)])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("_h"), pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["y", "h", "x"])

    rows = sorted((r.h, bytes(r.x), r.y) for r in t.join(F.broadcast(ids), "doc_id").select("y", "_h", "text").mapInArrow(run, "y int, h long, x binary").toLocalIterator())
    xs = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, x, _ in rows]
    return fitted(np.concatenate(xs) if xs else np.zeros((0, WIDTH)), np.array([len(x) for x in xs], np.int64), np.array([float(y) for _, _, y in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) of every whole text; null counts as empty, an empty text is one blank passage.
    Very long texts are encoded a passage at a time. Repeated rows each give a row; an empty table none; other columns are not read,
    whatever their names. One narrow pass; the model is a few KB."""
    t = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = t.sparkSession.sparkContext.broadcast(model.parts)

    def run(batches):
        import pyarrow as pa

        m = Model(shared.value)
        for batch in slices(batches):
            x, bags = encoded(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.scores(x, bags).astype(float), pa.float64())], ["doc_id", "score"])

    return t.mapInArrow(run, "doc_id long, score double")
