"""Toxicity: a linear classifier with a counterfactual penalty, so that a neutral mention of a group does not raise the score.

Features are hashed words and word beginnings with their weight in the text, scaled by the log-ratio of the two classes and kept
where the association is significant. Training minimises log loss, a ridge, and the squared change of the score when identity terms
are swapped in labelled texts and in neutral sentences about each group.

Cases: a null or empty text has no features and gets the prior's score; without labelled rows of both classes every score
is the share of toxic rows (0 without rows); a row that is there twice is scored twice; rows without a label, or with several, count
by their mean label in training; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Labelled rows of each class that are fitted (those of least hash of their id), at most.
SAMPLE = 2_000
#: Hashed features, lengths of word beginnings, least z of a feature, documents that must have it.
DIM, PREFIXES, LEAST_Z, LEAST_DF = 1 << 18, (4, 5, 6, 7, 8), 2.5, 3
#: Words whose features a task remembers (of 64 characters at most, so some 10 MB).
REMEMBERED = 60_000
#: Ridge, weight of the counterfactual penalty, steps, step size.
RIDGE, FAIR, STEPS, RATE = 0.1, 1.0, 250, 0.5

# Identity terms, in sets whose members are swapped for each other, and neutral sentences about them.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "atheist", "buddhist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("deaf", "blind", "disabled", "autistic"),
)
SENTENCES = ("i am a {} person", "my neighbours are {} people", "the {} community met today", "a book about {} history")

_WORDS = re.compile(r"\w+").findall


class Features:
    """A word's features, remembered for the first words."""

    def __init__(self):
        self.known: dict[str, list[int]] = {}

    @staticmethod
    def made(word: str) -> list[int]:
        raw = [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]
        return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIM for x in raw]

    def of(self, word: str) -> list[int]:
        out = self.known.get(word)
        if out is None:
            out = self.made(word)
            if len(self.known) < REMEMBERED and len(word) <= 64:
                self.known[word] = out
        return out

    def vector(self, text: str | None) -> dict[int, float]:
        from math import log1p

        counts = Counter(_WORDS((text or "").lower()))
        total = sum(counts.values())
        sums: dict[int, int] = {}
        for word, n in counts.items():
            for f in self.of(word):
                sums[f] = sums.get(f, 0) + n
        return {f: log1p(100 * n / total) for f, n in sums.items()}


def swapped(text: str) -> Iterator[str]:
    """The text with its identity terms replaced by the next one of their set; nothing if it has none."""
    following = {t: s[(k + 1) % len(s)] for s in IDENTITIES for k, t in enumerate(s)}
    other = re.sub(r"\w+", lambda m: following.get(m[0].lower(), m[0]), text)
    if other != text:
        yield other


class Model:
    """Weights of the kept features and a bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        from math import exp, log1p

        counts = Counter(_WORDS((text or "").lower()))
        total, sums, known, weights = sum(counts.values()), {}, self.words, self.weights
        for word, n in counts.items():
            kept = known.get(word)
            if kept is None:
                kept = tuple([f for f in Features.made(word) if f in weights])
                if len(known) < REMEMBERED and len(word) <= 64:
                    known[word] = kept
            for f in kept:
                sums[f] = sums.get(f, 0) + n
        z = self.bias + sum(weights[f] * log1p(100 * n / total) for f, n in sums.items())
        return 1 / (1 + exp(-max(-500.0, min(500.0, z))))


def fit(vectors: tuple, y, sample, pairs: list[tuple[dict[int, float], dict[int, float]]]) -> Model:
    """vectors: features of all rows in a row, their values, and the number of features of each row; y: labels; sample: weights of the
    rows; pairs: vectors whose scores must not differ."""
    import numpy as np

    index, value, sizes = vectors
    sample = sample / max(1e-12, sample.sum())
    rows = range(len(y))
    rate = float(sample @ y) if len(y) else 0.0
    if not 0 < rate < 1:
        return Model({}, -500.0 if rate == 0 else 500.0)
    at = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    up, down = sample * y / rate, sample * (1 - y) / (1 - rate)
    df = np.bincount(index, minlength=DIM)
    one, nil = np.bincount(index, up[at], DIM), np.bincount(index, down[at], DIM)
    n1, n0 = (y > 0.5).sum(), (y <= 0.5).sum()
    both = np.clip((one * n1 + nil * n0) / (n1 + n0), 1e-12, 1 - 1e-12)
    z = (one - nil) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    ratio = np.log((one * n1 + 1) / (n1 + 2)) - np.log((nil * n1 + 1) / (n1 + 2))
    scale = np.where((z > LEAST_Z) & (df >= LEAST_DF), ratio, 0.0)
    kept = scale[index] != 0
    at, index, value = at[kept], index[kept], value[kept].astype(float)
    value *= scale[index]
    names, index = np.unique(index, return_inverse=True)
    place = {int(f): k for k, f in enumerate(names)}
    gap_at, gap_index, gap_value = [], [], []
    for n, (a, b) in enumerate(pairs):
        for f in {*a, *b}:
            if f in place:
                gap_at.append(n)
                gap_index.append(place[f])
                gap_value.append((a.get(f, 0.0) - b.get(f, 0.0)) * scale[f])
    gap_at, gap_index, gap_value = np.array(gap_at, int), np.array(gap_index, int), np.array(gap_value)
    w, b = np.zeros(len(names)), float(np.log(rate / (1 - rate)))
    sw, sb = np.full(len(names), 1e-8), 1e-8
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, value * w[index], len(rows)) + b, -500, 500)))
        error = (p - y) * sample
        g = np.bincount(index, value * error[at], len(names)) + RIDGE * w / len(rows)
        if len(gap_at):
            change = np.bincount(gap_at, gap_value * w[gap_index], len(pairs))
            g += 2 * FAIR / len(pairs) * np.bincount(gap_index, gap_value * change[gap_at], len(names))
        sw += g * g
        w -= RATE * g / np.sqrt(sw)
        sb += error.sum() ** 2
        b -= RATE * error.sum() / np.sqrt(sb)
    return Model({int(f): float(x * scale[f]) for f, x in zip(names, w, strict=True) if x}, float(b))


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0; not so for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most `sample` labelled rows of each class; their features are made where the texts are, and only those come here."""
    import numpy as np

    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg("toxic").alias("toxic")).filter(~held_out(F.col("id")))
    order = F.xxhash64(F.col("id"))
    some = [known.filter(c).orderBy(order, "id").limit(sample) for c in ("toxic > 0.5", "toxic <= 0.5")]
    sizes = {bool(r["t"]): r["n"] for r in known.groupBy((F.col("toxic") > 0.5).alias("t")).agg(F.count("*").alias("n")).collect()}
    # at most 2 * sample rows
    picked = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").select("text", "toxic")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for batch in batches:
            vectors, label, pair = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vectors.append(features.vector(text))
                label.append(toxic)
                pair.append(next((features.vector(x) for x in swapped(text or "")), None))
            maps = [[list(v) if v is not None else None for v in some] for some in (vectors, pair)]
            values = [[list(v.values()) if v is not None else None for v in some] for some in (vectors, pair)]
            yield pa.RecordBatch.from_arrays([pa.array(maps[0], pa.list_(pa.int32())), pa.array(values[0], pa.list_(pa.float32())), pa.array(label, pa.float64()), pa.array(maps[1], pa.list_(pa.int32())), pa.array(values[1], pa.list_(pa.float32()))], names=["f", "v", "toxic", "f2", "v2"])

    made = map_arrow(texts, run, "f array<int>, v array<float>, toxic double, f2 array<int>, v2 array<float>")
    # at most 2 * sample rows; in order of their content, whatever the tasks' order
    table = made.orderBy(F.xxhash64("f", "v"), "toxic").toArrow().combine_chunks()
    toxic = table["toxic"].to_numpy()
    label = np.round(toxic)
    scale = {t: sizes[t] / min(sample, sizes[t]) for t in sizes}
    weight = np.array([scale[t > 0.5] for t in toxic])
    flat = [table[c].combine_chunks() for c in ("f", "v")] if len(label) else None
    vectors = (flat[0].flatten().to_numpy(), flat[1].flatten().to_numpy(), np.diff(flat[0].offsets.to_numpy())) if flat else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
    pairs = []
    for n, (f2, v2) in enumerate(zip(table["f2"], table["v2"], strict=True)):
        if f2.is_valid:
            one = dict(zip(table["f"][n].as_py(), table["v"][n].as_py(), strict=True))
            pairs.append((one, dict(zip(f2.as_py(), v2.as_py(), strict=True))))
    features = Features()
    for terms in IDENTITIES:
        for s in SENTENCES:
            pairs += [(features.vector(s.format(a)), features.vector(s.format(b))) for a, b in zip(terms, terms[1:] + terms[:1], strict=True)]
            pairs += [(features.vector(s.format(a)), features.vector(s.format(""))) for a in terms]
    return fit(vectors, label, weight, pairs)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; the model (kept features only, at most DIM) travels with the function."""
    weights, bias = model.weights, model.bias

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from docloom.llm.toxicity import Model

        own = Model(weights, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, **columns), **columns)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    weights, bias = model.weights, model.bias
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from docloom.llm.toxicity import Model

        own = Model(weights, bias)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < threshold for t in batch.column(place)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
