"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation over all training documents.

Words are runs of anything but the six ASCII white-space bytes, A-Z in lower case; a document ends with an end token. The model
predicts a unit from the two units before. The most frequent words are units of their own; every class of units has one more for
its rarer words, which share the unit's probability by their smoothed training counts. Classes are runs of the words sorted from their last byte
on, so that words with the same ending stand together, and a rarer word goes to the class in whose run it would stand. A unit's probability is its
class's times its own within the class, both from the context; batched matrix products score all classes and all units of a
class, so that token log-probabilities are normalised.

Cases: a null or empty text is its end token; rows that are there twice are scored twice (and learnt from twice); a null doc_id is
held in training like any whose remainder isn't 0; an empty table gives no rows; without training documents every unit has the
same probability in its class; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow

#: Classes, units of a class (the last one for the rarer words), dimensions.
CLASSES, PLACES, DIM = 128, 128, 16
#: Classes drawn as noise per batch, units drawn as noise per class and batch.
CLASS_NOISE, NOISE = 12, 5
#: Words whose counts every worker holds, at most, and their length in bytes at most; the others' counts are joined.
FREQUENT, LONGEST = 200_000, 64
#: Rounds, each over documents of its own, after which the shards' parameters are averaged; tokens of a shard, about; batches that a shard makes, about, of so many
#: tokens at least and at most; step size.
ROUNDS, SHARD_TOKENS, STEPS, BATCH, RATE = 3, 1_000_000, 150, (256, 8_192), 0.3
#: Words that a task counts before it passes them on; rarer words whose class a task remembers.
COUNT_WORDS, REMEMBERED = 200_000, 50_000
#: Tokens that are scored at a time, and whose scores are made at a time; rows of a tile of one class.
CHUNK, BLOCK, TILE = 1 << 17, 1 << 11, 32
#: The end token among the words.
END = b""
SMOOTH = 0.1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def words(text: str | None) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END] if text else [END]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs (text); a task passes on sums, never single words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words(text.as_py()))
                if len(counts) > COUNT_WORDS:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    return map_arrow(docs.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every worker knows of the words: the frequent ones with their counts, most frequent first, the units and their totals."""

    def __init__(self, frequent: list[bytes], counts: np.ndarray, n: int, v: int):
        self.words, self.counts, self.n, self.v = frequent, counts, n, v
        own = sorted(range(min(len(frequent), CLASSES * (PLACES - 1))), key=lambda k: frequent[k][::-1])
        self.classes = max(1, -(-len(own) // (PLACES - 1)))
        size = -(-len(own) // self.classes) if own else 0
        #: The first word of each class but the first, from its last byte on.
        self.limits = [frequent[own[at]][::-1] for at in range(size, len(own), size)] if own else []
        self.classes = len(self.limits) + 1
        self.units = self.classes * PLACES
        self.unit = np.full(len(frequent) + 1, -1, np.int32)
        for place, k in enumerate(own):
            self.unit[k] = place // size * PLACES + place % size
        rest = [k for k in range(len(frequent)) if self.unit[k] < 0]
        self.unit[rest] = [self.rest_unit(frequent[k]) for k in rest]
        self.own = self.unit[own] if own else np.zeros(0, np.int32)
        self.own_counts = counts[own] if own else np.zeros(0, np.int64)
        self.mass = np.zeros(self.units)
        self.mass[self.own] = self.own_counts

    def rest_unit(self, word: bytes) -> int:
        return bisect_right(self.limits, word[::-1]) * PLACES + PLACES - 1

    def with_rest(self, totals: dict[int, tuple[int, int]]) -> Vocabulary:
        """totals: count and number of all words by class."""
        self.used = np.zeros(self.units, bool)
        self.used[self.own] = True
        self.level = np.zeros(self.units)
        self.level[self.own] = np.log10(self.own_counts + SMOOTH)
        for c in range(self.classes):
            u, (total, kinds) = c * PLACES + PLACES - 1, totals.get(c, (0, 0))
            mine = (self.own // PLACES) == c
            total, kinds = total - int(self.own_counts[mine].sum()), kinds - int(mine.sum())
            self.used[u] = True
            self.level[u] = math.log10(total + SMOOTH * (kinds + 1))
            self.mass[u] = total + 1
        self.logs = np.log10(self.counts + SMOOTH)
        return self


def vocabulary(counts: DataFrame) -> Vocabulary:
    """FREQUENT words of at most LONGEST bytes, a histogram of counts and CLASSES totals come to the driver, whatever the corpus."""
    short = counts.filter((F.octet_length("word") <= LONGEST) | (F.col("word") == F.lit(END)))
    steps = F.floor(F.log2("c") * 64).cast("int")
    room, least = FREQUENT, None
    for r in sorted(short.groupBy(steps.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["s"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["c"]
    table = short.filter(F.col("c") >= least).toArrow() if least is not None else None
    top = sorted(zip(table["word"].to_pylist(), table["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0])) if table is not None else []
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    out = Vocabulary([w for w, _ in top], np.array([c for _, c in top], np.int64), n, v)
    limits = out.limits

    def classed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, kinds = np.zeros(len(limits) + 1, np.int64), np.zeros(len(limits) + 1, np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = bisect_right(limits, w[::-1])
                total[k] += c
                kinds[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array(kinds)], names=["k", "c", "v"])

    sums = map_arrow(counts.select("word", "c"), classed, "k int, c long, v long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    return out.with_rest({r["k"]: (r["c"], r["v"]) for r in sums.collect()})


def encode(docs: DataFrame, shared) -> DataFrame:
    """Per row: units (two bytes a token), sums over frequent words, and the other words with their numbers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = shared.value
        place = {w: k for k, w in enumerate(v.words)}.get
        unit, logs, rest_unit = v.unit, np.append(v.logs, 0.0), v.rest_unit
        remembered: dict[bytes, int] = {}

        def rest(w: bytes) -> int:
            u = remembered.get(w)
            if u is None:
                u = rest_unit(w)
                if len(remembered) < REMEMBERED and len(w) <= LONGEST:
                    remembered[w] = u
            return u

        for batch in batches:
            units, sums, known, others, numbers = [], [], [], [], []
            for text in batch.column(1):
                tokens = words(text.as_py())
                found = np.fromiter(map(place, tokens, repeat(-1)), np.int32, len(tokens))
                own = unit[found]
                odd = np.flatnonzero(found < 0).tolist()
                some = [tokens[k] for k in odd]
                if odd:
                    own[odd] = [rest(w) for w in some]
                tally = Counter(some)
                units.append(own.astype("<u2").tobytes())
                sums.append(logs[found].sum())
                known.append(len(tokens) - len(odd))
                others.append(list(tally))
                numbers.append(list(tally.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(sums, pa.float64()), pa.array(known, pa.int64()), pa.array(others, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.int64()))], names=["doc_id", "units", "sum_known", "known", "words", "numbers"])

    return map_arrow(docs, run, "doc_id long, units binary, sum_known double, known long, words array<binary>, numbers array<long>")


def by_value(index: np.ndarray) -> np.ndarray:
    """The order of numbers below 65,536, which numpy sorts by their digits."""
    return np.argsort(index.astype(np.uint16), kind="stable")


def row_sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of index, and for each the sum of its rows."""
    seen = np.bincount(index)
    which = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.intp)
    place[which] = np.arange(len(which))
    own = place.take(index)
    out = np.empty((len(which), rows.shape[1]), np.float32)
    for j, column in enumerate(np.ascontiguousarray(rows.T, dtype=float)):
        out[:, j] = np.bincount(own, column)
    return which, out


class LogBilinear:
    """Units have a vector as context (r) and one as target (q, with a bias as last place), classes one as target (k, likewise); the two context
    places weigh the dimensions (c)."""

    NAMES = ("r", "q", "k", "c")

    def __init__(self, mass: np.ndarray, used: np.ndarray, flat: np.ndarray | None = None):
        rng = np.random.Generator(np.random.PCG64(5))
        self.units, self.classes = len(mass), len(mass) // PLACES
        grid = np.where(used, mass + 1e-3, 0.0).reshape(self.classes, PLACES)
        total = grid.sum(axis=1)
        self.class_noise, inside = total / total.sum(), grid / total[:, None]
        self.used = used
        self.upto = np.cumsum(inside, axis=1)
        self.upto /= self.upto[:, -1:]
        self.log_class = np.log(self.class_noise).astype(np.float32)
        self.log_inside = np.log(np.maximum(inside, 1e-30)).ravel().astype(np.float32)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.r = small(self.units + 1, DIM)  # the last is what stands before a document
        self.q, self.k = small(self.units, DIM + 1), small(self.classes, DIM + 1)
        self.q[:, DIM], self.k[:, DIM] = self.log_inside, self.log_class
        self.c = np.ones((2, DIM), np.float32)
        if flat is not None:
            at = 0
            for name in self.NAMES:
                own = getattr(self, name)
                setattr(self, name, flat[at : at + own.size].reshape(own.shape).astype(np.float32))
                at += own.size
        self.steps = {name: np.full_like(getattr(self, name), 1e-3) for name in self.NAMES}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def contexts(self, units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units one and two before each, of documents in a row; ends: where each document ends."""
        none = self.units
        starts = np.concatenate([[0], ends[:-1]])
        one = np.concatenate([[none], units[:-1]]).astype(np.int32)
        two = np.concatenate([[none, none], units[:-2]]).astype(np.int32)[: len(units)]
        one[starts] = none
        two[starts] = none
        two[starts[(ends - starts) > 1] + 1] = none
        return one, two

    def _add(self, name: str, rows, grad: np.ndarray) -> None:
        """Adagrad on some rows."""
        step, own = self.steps[name], getattr(self, name)
        sums = grad * grad
        sums += step[rows]
        step[rows] = sums
        np.divide(grad, np.sqrt(sums, out=sums), out=sums)
        sums *= np.float32(RATE)
        sums += own[rows]
        own[rows] = sums

    @staticmethod
    def _slopes(true: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of the contrast's log-likelihood, from the differences of model and noise."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(true)), -1 / (1 + np.exp(-noise))

    def hidden(self, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
        """What the contexts' vectors say of a target, and 1 for its bias."""
        h = np.empty((len(r1), DIM + 1), np.float32)
        np.multiply(r1, self.c[0], out=h[:, :DIM])
        h[:, :DIM] += r2 * self.c[1]
        h[:, DIM] = 1
        return h

    def learn(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, rng) -> None:
        """A gradient step on the contrast of the targets' classes with drawn classes, and of the targets with units drawn from
        their class."""
        order = by_value(target)
        one, two, target = one.take(order), two.take(order), target.take(order)
        kind = target // PLACES
        n = np.float32(len(target))
        r1, r2 = self.r.take(one, axis=0), self.r.take(two, axis=0)
        h = self.hidden(r1, r2)
        # targets are sorted, so that a class is a run of rows
        first = np.flatnonzero(np.diff(kind, prepend=-1))
        met, size = kind[first], np.diff(first, append=len(kind))
        # classes
        drawn = rng.choice(self.classes, CLASS_NOISE, p=self.class_noise)
        kt, kn = self.k.take(kind, axis=0), self.k[drawn]
        shift = np.float32(math.log(CLASS_NOISE))
        et, en = self._slopes(np.einsum("ij,ij->i", h, kt) - self.log_class[kind] - shift, h @ kn.T - self.log_class[drawn] - shift)
        kt *= et[:, None]
        dh = en @ kn
        dh += kt
        which, grad = row_sums(np.concatenate([met, drawn]), np.concatenate([np.add.reduceat(np.multiply(h, et[:, None], out=kt), first, axis=0), en.T @ h]))
        self._add("k", which, grad / n)
        # units within their class: a class's rows fill tiles, the last one up with zeros, so that one product of stacks does all classes
        noise = (self.upto[:, None, :] < rng.random((self.classes, NOISE))[:, :, None]).sum(axis=2) + np.arange(self.classes)[:, None] * PLACES
        tiles = -(-size // TILE)
        begin = np.cumsum(tiles) - tiles
        place = np.arange(len(kind)) + np.repeat(begin * TILE - first, size)
        stack = np.zeros((int(tiles.sum()) * TILE, DIM + 1), np.float32)
        stack[place] = h
        stack = stack.reshape(-1, TILE, DIM + 1)
        ids = noise[np.repeat(met, tiles)]
        qt, qn, shift = self.q.take(target, axis=0), self.q.take(ids, axis=0), np.float32(math.log(NOISE))
        gap = stack @ qn.transpose(0, 2, 1)
        gap -= (self.log_inside[ids] + shift)[:, None, :]
        et, en = self._slopes(np.einsum("ij,ij->i", h, qt) - self.log_inside[target] - shift, gap)
        qt *= et[:, None]
        dh += qt
        dh += (en @ qn).reshape(-1, DIM + 1).take(place, axis=0)
        own = np.add.reduceat((en.transpose(0, 2, 1) @ stack).reshape(len(stack), -1), begin, axis=0)
        which, grad = row_sums(np.concatenate([target, noise[met].ravel()]), np.concatenate([np.multiply(h, et[:, None], out=qt), own.reshape(-1, DIM + 1)]))
        self._add("q", which, grad / n)
        dh = dh[:, :DIM] / n
        both = np.empty((2 * len(dh), DIM), np.float32)
        np.multiply(dh, self.c[0], out=both[: len(dh)])
        np.multiply(dh, self.c[1], out=both[len(dh) :])
        which, grad = row_sums(np.concatenate([one, two]), both)
        slopes = np.stack([np.einsum("ij,ij->j", dh, r1), np.einsum("ij,ij->j", dh, r2)])
        self._add("r", which, grad)
        self._add("c", slice(None), slopes)

    @staticmethod
    def _log_sums(scores: np.ndarray, small: bool = False) -> np.ndarray:
        """log of the sum of exp of each row; scores are overwritten. small: no score is beyond 80."""
        # without moving each row by its largest score, where no sum runs over or under
        if small or scores.size and scores.max() < 80 and scores.min() > -80:
            return np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype))
        top = scores.max(axis=1)
        scores -= top[:, None]
        return top + np.log(np.exp(scores, out=scores).sum(axis=1))

    def log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10-probability of each target."""
        out = np.empty(len(target))
        used = self.used.reshape(self.classes, PLACES)
        length = lambda x: float(np.einsum("ij,ij->i", x, x).max()) ** 0.5
        for at in range(0, len(target), CHUNK):
            order = by_value(target[at : at + CHUNK]) + at
            t = target.take(order)
            kind = t // PLACES
            h = self.hidden(self.r.take(one.take(order), axis=0), self.r.take(two.take(order), axis=0))
            each = np.einsum("ij,ij->i", h, self.k.take(kind, axis=0)) + np.einsum("ij,ij->i", h, self.q.take(t, axis=0))
            # a score is at most as large as its two vectors' lengths multiplied
            longest = length(h)
            scores = np.empty((BLOCK, max(self.classes, PLACES)), np.float32)

            def less(a: int, b: int, q: np.ndarray, h=h, each=each, longest=longest, scores=scores) -> None:
                small = longest * length(q) < 79
                for x in range(a, b, BLOCK):
                    y = min(b, x + BLOCK)
                    each[x:y] -= self._log_sums(np.matmul(h[x:y], q.T, out=scores.ravel()[: (y - x) * len(q)].reshape(y - x, len(q))), small)

            less(0, len(t), self.k)
            first = np.flatnonzero(np.diff(kind, prepend=-1))
            for a, b in zip(first, np.append(first[1:], len(t)), strict=True):
                less(a, b, self.q[kind[a] * PLACES : (kind[a] + 1) * PLACES][used[kind[a]]])
            out[order] = each
        return out / math.log(10)


def groups(batches: Iterator, column: int, most: int = 1 << 20) -> Iterator:
    """Documents' units in a row with their ends, of about `most` tokens at a time."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(column):
            held.append(np.frombuffer(raw.as_buffer(), "<u2"))
            size += len(held[-1])
            if size >= most:
                yield np.concatenate(held).astype(np.int32), np.cumsum([len(x) for x in held])
                held, size = [], 0
    if held:
        yield np.concatenate(held).astype(np.int32), np.cumsum([len(x) for x in held])


def train(encoded: DataFrame, vocab: Vocabulary) -> np.ndarray | None:
    """Parameters averaged over shards by tokens. Documents are dealt to shards by a hash, as many as the corpus fills, and shards to rounds,
    so that every document is learnt from once and the model does not change with how the input is split. Sums are made in two
    steps, so that the driver gets one set of parameters."""
    mass, used = vocab.mass, vocab.used
    shards = max(1, -(-vocab.n // (SHARD_TOKENS * ROUNDS)))
    size = min(BATCH[1], max(BATCH[0], vocab.n // (shards * ROUNDS * STEPS)))
    flat: np.ndarray | None = None
    order = F.xxhash64("doc_id", "units")
    marked = encoded.filter("not held_out").select("units", order.alias("mark"))
    marked = marked.withColumn("round", F.pmod("mark", F.lit(ROUNDS))).withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int"))
    for number in range(ROUNDS):
        start = flat

        def run(batches: Iterator, start=start, number=number) -> Iterator:
            import pyarrow as pa

            model, rng, seen = LogBilinear(mass, used, start), np.random.Generator(np.random.PCG64(11 + number)), 0
            for units, ends in groups(batches, 0, 1 << 19):
                one, two = model.contexts(units, ends)
                mixed = rng.permutation(len(units))
                for at in range(0, len(mixed), size):
                    k = mixed[at : at + size]
                    model.learn(one[k], two[k], units[k], rng)
                seen += len(units)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(model.flat() * np.float32(seen)).astype("<f4").tobytes()]), pa.array([seen], pa.int64())], names=["flat", "n"])

        def total(batches: Iterator) -> Iterator:
            import pyarrow as pa

            sums, seen = 0.0, 0
            for batch in batches:
                for raw, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    sums, seen = sums + np.frombuffer(raw.as_buffer(), "<f4").astype(float), seen + n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<f4").tobytes()]), pa.array([seen], pa.int64())], names=["flat", "n"])

        own = marked.filter(F.col("round") == number).repartitionById(shards, F.col("shard")).sortWithinPartitions("mark")
        parts = map_arrow(own.select("units"), run, "flat binary, n long")
        for tasks in (max(1, math.isqrt(shards)), 1):  # no task gets the sets of all shards
            dealt = parts.withColumn("to", F.pmod(F.spark_partition_id(), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("to"))
            parts = map_arrow(dealt.sortWithinPartitions("n", F.xxhash64("flat")).select("flat", "n"), total, "flat binary, n long")
        made = parts.collect()
        if made:
            flat = np.frombuffer(bytes(made[0]["flat"]), "<f4") / np.float32(made[0]["n"])
    return flat


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the unigram model's, score the log-bilinear model's log10-probability. Counts of the FREQUENT words go to every
    worker; the rarer words of documents, a small part of all tokens, are joined with the table of all counts."""
    spark = docs.sparkSession
    named = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    counts = durable(count_words(named.filter(~held_out(F.col("doc_id")))), "lm-counts")
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocab)
    encoded = encode(named, shared).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id())
    encoded = durable(encoded, "lm-units")
    model = spark.sparkContext.broadcast(train(encoded, vocab))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = shared.value
        own = LogBilinear(v.mass, v.used, model.value)
        for batch in batches:
            out = []
            for units, ends in groups(iter([batch]), batch.num_columns - 1):
                one, two = own.contexts(units, ends)
                each = own.log10(one, two, units) - v.level[units]
                out.append(np.diff(np.concatenate([[0.0], np.cumsum(each)])[np.concatenate([[0], ends])]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out) if out else [], pa.float64())], names=["row", "doc_id", "held_out", "known", "others", "sum_known", "lbl"])

    rare = encoded.select("row", F.explode(F.arrays_zip("words", "numbers")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.numbers").alias("m"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("m") * (F.log10(F.col("c") + SMOOTH) + 1)).alias("more"), F.sum("m").alias("found"))
    others = F.aggregate("numbers", F.lit(0).cast("long"), lambda s, x: s + x)
    scored = map_arrow(encoded.select("row", "doc_id", "held_out", "known", others.alias("others"), "sum_known", "units"), run, "row long, doc_id long, held_out boolean, known long, others long, sum_known double, lbl double")
    out = scored.join(found, "row", "left")
    tokens = F.col("known") + F.col("others")
    # a word without a count has log10(0.1) = -1
    sums = F.col("sum_known") - F.col("others") + F.coalesce("more", F.lit(0.0))
    base = sums - tokens * math.log10(vocab.n + SMOOTH * (vocab.v + 1))
    return out.select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lbl") + sums).alias("score"))
