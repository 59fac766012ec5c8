"""Toxicity by class-conditional Kneser-Ney models.

Two models of how words are spelt, one of toxic and one of ordinary text, give each byte of a word a probability after the bytes
before it. Their counts (in how many documents of the class a word with the expression occurs) lose an absolute discount that
follows from the counts of counts, and the freed mass goes to a backoff that both classes share: continuation counts, in how many
different expressions of either class a shorter one ends. Rare expressions are so alike for both classes, and word forms never
seen are judged by their parts. A text is scored by the difference of its two log-likelihoods by symbol.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, remainder, slices, texts_of, tidy

#: Everything in ASCII but letters, digits and ' parts words; A-Z count as a-z.
SPLIT = bytes((c | 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 or c == 39 else 32 for c in range(256))
#: Marks before and after each word: bytes that no word holds.
BEGIN, END = b"\x01", b"\x02"
#: (order, ordinary texts for each toxic one) that are tried on held-out folds.
CHOICES = ((3, 1), (4, 1), (4, 3), (5, 3))


def words(text: bytes) -> list[bytes]:
    return text.translate(SPLIT).split()


def expressions(vocabulary: list[bytes], order: int):
    """For each symbol of the words, their end marks included: it and the order - 1 before it packed into a number (zeros before the
    begin mark), and the word's place."""
    import numpy as np

    b = np.frombuffer(b"".join(BEGIN + w + END for w in vocabulary), np.uint8)
    begin = b == BEGIN[0]
    at = np.flatnonzero(begin).astype(np.int32)
    place = np.arange(len(b), dtype=np.int32) - np.repeat(at, np.diff(np.append(at, len(b))))
    key = np.zeros(len(b), np.uint64)
    for k in range(order - 1, -1, -1):
        key <<= np.uint64(8)
        key[k:] |= np.where(place[k:] >= k, b[: len(b) - k], 0)
    return key[~begin], (np.cumsum(begin, dtype=np.int32) - 1)[~begin]


def discount(counts) -> float:
    """n1 / (n1 + 2 n2), of how many counts are 1 and 2; a half where none is 1."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one else 0.5


def looked_up(keys, values, wanted, other):
    """The values of wanted in sorted keys, `other` where it is not."""
    import numpy as np

    if not len(keys):
        return np.full(len(wanted), other, float)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def own_and_freed(keys, counts):
    """Discounted relative counts of expressions, and by context the mass that goes to the backoff."""
    import numpy as np

    less = discount(counts)
    head, back = np.unique(keys >> np.uint64(8), return_inverse=True)
    total, types = np.bincount(back, counts, len(head)), np.bincount(back, minlength=len(head))
    return (counts - less) / total[back], head, less * types / total


class Model:
    """Difference of the log-probabilities by expression (keys, gain) and, for an expression never seen, by context (heads, lean).

    fit: bias and slope of the calibration."""

    def __init__(self, order: int, keys, gain, heads, lean, fit=(-3.0, 0.0)):
        self.order, self.keys, self.gain, self.heads, self.lean, self.fit = order, keys, gain, heads, lean, fit
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def of_expressions(self, key):
        """Toxic less ordinary log-probability of each expression's last symbol."""
        import numpy as np

        return looked_up(self.keys, self.gain, key, looked_up(self.heads, self.lean, key >> np.uint64(8), 0.0))

    def of_words(self, vocabulary: list[bytes]):
        """Toxic less ordinary log-probability of each word with its end."""
        import numpy as np

        if not len(self.keys) or not vocabulary:
            return np.zeros(len(vocabulary))
        key, word = expressions(vocabulary, self.order)
        return np.bincount(word, self.of_expressions(key), len(vocabulary))

    def differences(self, texts: list[bytes], most: int = 400_000):
        """Toxic less ordinary log-likelihood by symbol of each text; 0 without words. Words once met are remembered, up to `most`."""
        import numpy as np

        split = [words(t) for t in texts]
        if len(self.known) > most:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        self.known.update(zip(new, self.of_words(new).tolist(), strict=True))
        get = self.known.__getitem__
        return np.array([sum(map(get, w)) / (len(w) + sum(map(len, w))) if w else 0.0 for w in split])

    def scores(self, texts: list[bytes]):
        """0 to 1, higher: toxic."""
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.fit[0] + self.fit[1] * self.differences(texts), -30, 30)))


def told_apart(vocabulary: list[bytes], order: int):
    """The distinct expressions of words, and for each symbol its expression's place and its word's."""
    import numpy as np

    key, word = expressions(vocabulary, order)
    every, back = np.unique(key, return_inverse=True)
    return every, back.astype(np.int32), word


def build(found, counts, order: int) -> Model:
    """A model without calibration. found: told_apart of a vocabulary; counts: rows toxic and ordinary, in how many documents each of its words occurs."""
    import numpy as np

    every, back, word = found
    seen = [np.bincount(back, np.asarray(c, float)[word], len(every)) for c in counts]
    live = (seen[0] + seen[1]) > 0
    every, seen = every[live], [c[live] for c in seen]
    levels, now = [], every  # the shared backoff: continuation counts of the expressions of ever fewer symbols
    for k in range(order - 1, 0, -1):
        now, n = np.unique(now & np.uint64(2 ** (8 * k) - 1), return_counts=True)
        levels.append((k, now, *own_and_freed(now, n)))
    shared = np.full(len(every), 1 / 256)
    for k, keys, own, head, freed in reversed(levels):
        short = every & np.uint64(2 ** (8 * k) - 1)
        shared = looked_up(keys, own, short, 0.0) + looked_up(head, freed, short >> np.uint64(8), 1.0) * shared
    heads = np.unique(every >> np.uint64(8))
    logs, leans = [], []
    for n in seen:
        mine = n > 0
        own, head, freed = own_and_freed(every[mine], n[mine])
        p = looked_up(head, freed, every >> np.uint64(8), 1.0) * shared
        p[mine] += own
        logs.append(np.log(p))
        leans.append(np.log(looked_up(head, freed, heads, 1.0)))
    return Model(order, every, logs[0] - logs[1], heads, leans[0] - leans[1])


def logistic(x, y, weight, rounds: int = 100, decay: float = 1e-6):
    """Bias and slope of a logistic regression on one number, by Newton's method."""
    import numpy as np

    a, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + decay * np.eye(2), a.T @ (weight * (y - p)) - decay * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Packed:
    """Words kept in one piece of bytes, parted by blanks, and split each time they are read."""

    __slots__ = ("packed",)

    def __init__(self, packed: bytes):
        self.packed = packed

    def __iter__(self):
        return iter(self.packed.split())


def fitted(rows: list[tuple[int, Iterable[bytes], Iterable[int]]], parts: dict[int, int], folds: int = 4, weight_of_toxic: float = 3.0) -> Model:
    """A calibrated model of rows (label, distinct words, how often each occurs); parts: how many labels of each kind there are in all.
    Words become numbers row by row, and one order's expressions are held at a time.

    In four folds, three quarters give counts and the last is scored; on those scores the calibration is fitted, with the classes
    weighted to their parts and a toxic text missed counting as weight_of_toxic ordinary ones lost, and the choice with the lowest
    loss is taken; then all rows give the model's counts."""
    import numpy as np

    vocabulary: dict[bytes, int] = {}
    y, size, flat, times = np.array([r[0] for r in rows], np.int64), np.zeros(len(rows), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    if set(y.tolist()) != {0, 1}:
        return Model(1, *[np.zeros(0, np.uint64), np.zeros(0)] * 2)
    for i, (_, own, n) in enumerate(rows):
        flat.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in own), np.int32))
        size[i] = len(flat[-1])
        times.append(np.asarray(n, np.int32))
    names, flat, times = list(vocabulary), np.concatenate(flat), np.concatenate(times)
    del vocabulary
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    symbols = np.maximum(np.bincount(doc, times * (1 + np.fromiter(map(len, names), np.int64, len(names)))[flat], len(rows)), 1)
    found: dict = {}

    def told(order):
        if order not in found:
            found.clear()
            found[order] = told_apart(names, order)
        return found[order]

    def model(on, order):
        real = on[doc]
        return build(told(order), [np.bincount(flat[real & (y[doc] == c)], minlength=len(names)) for c in (1, 0)], order)

    def tried(order: int, ratio: int):
        taken = (y == 1) | ((y == 0) & (np.cumsum(y == 0) <= ratio * (y == 1).sum()))
        x, fold = np.zeros(len(rows)), np.arange(len(rows)) % folds
        every, back, word = told(order)
        for k in range(folds):
            by_word = np.bincount(word, model(taken & (fold != k), order).of_expressions(every)[back], len(names))
            x = np.where(fold == k, np.bincount(doc, by_word[flat] * times, len(rows)) / symbols, x)
        x, z = x[taken], y[taken].astype(float)
        weight = np.where(z == 1, weight_of_toxic * parts.get(1, 1) / max(1, z.sum()), parts.get(0, 1) / max(1, (1 - z).sum()))
        weight = weight / weight.mean()
        w = logistic(x, z, weight)
        loss = float((weight * (np.logaddexp(0, w[0] + w[1] * x) - z * (w[0] + w[1] * x))).mean())
        return loss, order, taken, w.tolist()

    _, order, taken, fit = min((tried(*c) for c in CHOICES), key=lambda x: x[0])
    best = model(taken, order)
    best.fit = fit
    return best


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, most_bytes: int = 24_000_000, folds: int = 5) -> Model:
    """Learns from labelled documents whose crc32(doc_id) mod folds is not 0: of each label, the first by hash of the id, at most `most`
    ids and so many that their texts hold at most most_bytes; texts that repeat count once.

    Labels that repeat an id count once, as the largest of them; null labels and ids teach nothing. Words are split, told apart and
    counted on the executors; the driver gets the distinct words of the sample's texts, which the two bounds hold, packed in bytes.
    """
    import numpy as np

    own = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    own = own.where((remainder(F.col("doc_id"), folds) != 0) & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    own = own.withColumn("h", F.xxhash64("doc_id"))
    ids = own.where("y = 1").orderBy("h", "doc_id").limit(most).unionByName(own.where("y = 0").orderBy("h", "doc_id").limit(most))
    t = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    last = {}
    for y in (0, 1):
        size = 0
        for r in t.where(F.col("y") == y).groupBy("h").agg(F.sum(F.octet_length("text")).alias("b")).orderBy("h").toLocalIterator():
            size += r.b
            if size > most_bytes and y in last:
                break
            last[y] = r.h
    taken = t.where(" or ".join(f"(y = {y} and h <= {h})" for y, h in last.items()) or "false")

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in slices(batches):
            found = [Counter(words(x)) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("h"), pa.array([b" ".join(c) for c in found], pa.binary()), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["y", "h", "words", "times"])

    got: dict = {}
    for r in taken.select("y", "h", "text").mapInArrow(tidy(run), "y int, h long, words binary, times array<int>").toLocalIterator():
        key = (bytes(r.words), np.array(r.times, ">i4").tobytes())
        if key not in got or (r.h, -r.y) < (got[key][1], -got[key][0]):
            got[key] = (r.y, r.h)
    return fitted([(y, Packed(w), np.frombuffer(n, ">i4")) for (w, n), (y, _) in sorted(got.items(), key=lambda x: (x[1][1], x[0]))], parts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic) of every whole text; null and empty texts score as no words. Rows that repeat each
    give a row; an empty table gives none; very long texts are read whole, one at a time; other columns are not read, whatever their
    names. One narrow pass; the model is of bounded size, as its sample is."""
    t = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = t.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.scores(texts_of(batch)), pa.float64())], ["doc_id", "score"])
        m.known.clear()

    return t.mapInArrow(tidy(run), "doc_id long, score double")


def ordinary(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that score under the threshold. The text is the column of that name, else one that
    differs in case."""
    names = docs.columns
    spot = f"c{([i for i, c in enumerate(names) if c == 'text'] or [i for i, c in enumerate(names) if c.lower() == 'text'])[0]}"
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in slices(batches, spot):
            yield batch.filter(pa.array(m.scores(texts_of(batch, spot)) < threshold, pa.bool_()))
        m.known.clear()

    return flat.mapInArrow(tidy(run), flat.schema).toDF(*names)
