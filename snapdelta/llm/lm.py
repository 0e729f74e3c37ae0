"""A log-bilinear language model, trained with noise-contrastive estimation, that scores whole texts.

Words are lower-cased and every text ends with one end token. The model predicts an output from the two outputs before:
the end, the most frequent words one by one, the other words by their ending, and words seen once at most. How many words have an
output of their own, with vectors as context and as target, follows the square root of the corpus. Within a shared output a word has
its share of the counts, so the probabilities of all words, and of one unseen word, sum to one.

The probability of an output is that of its class times its own within the class. Classes are learned: after the first round outputs with
vectors near each other become one. So both normalisers, over classes and over the outputs of a class, are products of small matrices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm import wordtable
from snapdelta.llm.common import lower_words, written
from snapdelta.llm.wordtable import from_planes, planes, squeeze, unsqueeze

END, RARE, FIRST_ENDING = 0, 1, 2
_PUNCTUATION = b".,;:!?|%*#$&\"'()[]{}<>-"
_COUNTS = "chunk long, bucket int, n int, positions binary, size long, answer binary, word binary, count long, distinct long"
_ENCODED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, shared_score double, outputs binary"
)
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of its training. Words with an output of their own: ``per_root`` times the root of the number of tokens."""

    per_root: float = 1.0
    endings: int = 96
    dims: int = 16
    class_noise: int = 32
    word_noise: int = 1
    batch: int = 2048
    rate: float = 0.2
    rounds: tuple[int, ...] = (1, 2, 5)  # eighths of the training documents, each used in one round
    task_tokens: int = 400  # tokens for every output that a task trains on, so that models in transit grow as the corpus does

    def singles(self, tokens: int) -> int:
        return int(self.per_root * tokens**0.5) + 1


def held_out(doc: int | None) -> bool:
    """A tenth of the ids by their checksum in decimal; a null id counts as training."""
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word.rstrip(_PUNCTUATION)[-2:]) % endings


@dataclass
class Counts:
    """What all training documents say about words: the totals, the outputs and their shares."""

    tokens: int
    distinct: int
    documents: int
    shape: Shape
    outputs: int
    vocabulary: dict[bytes, int]
    output_counts: np.ndarray  # training tokens by output
    shared: np.ndarray  # by output: sum of (count + 0.1) of its words
    once: int  # words seen once

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def outputs_of(self, words: list[bytes], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output of each word and log10 of the word's share of it."""
        plain = np.fromiter((ending(w, self.shape.endings) for w in words), np.int64, len(words)) + FIRST_ENDING
        out = np.where(c <= 1, RARE, plain)
        own = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        share = np.zeros(len(words))
        group = (out != RARE) & (own < 0)
        share[group] = np.log10((c[group] + 0.1) / self.shared[out[group]])
        rare = (out == RARE) & (own < 0)
        # An unseen word is as likely as all words seen once together.
        share[rare & (c == 1)] = -np.log10(2 * max(self.once, 1))
        share[rare & (c == 0)] = np.log10(0.5) if self.once else 0.0
        return np.where(own >= 0, own, out), share


def count_words(chunks: DataFrame, documents: int, shape: Shape) -> tuple[DataFrame, Counts]:
    """Counts of every distinct word over all training documents, and what the model needs of them.

    The first result is the answers to the chunks. To the driver come one row per output and the most frequent words.
    """
    words_in_all = chunks.where("kind = 1").agg(F.sum(F.expr("size DIV 4"))).first()[0] or 0
    singles = shape.singles(words_in_all)

    def answer(rows: Iterator[tuple]) -> Iterator[tuple]:
        numbers, waiting, totals = wordtable.Numbers(), [], np.zeros(0, np.int64)
        bucket = 0
        for bucket, chunk, n, size, packed, counts, positions in rows:
            words = wordtable.unpack_words(packed, size)
            at = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
            totals = np.concatenate([totals, np.zeros(len(numbers) - len(totals), np.int64)])
            totals[at] += np.frombuffer(unsqueeze(counts, 4 * n), "<u4")
            waiting.append((chunk, n, positions, squeeze(at.astype("<u4").tobytes())))
        for chunk, n, positions, at in waiting:
            c = totals[np.frombuffer(unsqueeze(at, 4 * n), "<u4")]
            yield chunk, bucket, n, positions, 8 * n, squeeze(c.astype("<i8").tobytes()), None, None, None
        words = list(numbers)
        known = totals > 0
        for k in np.argsort(-totals, kind="stable")[:singles].tolist():
            if totals[k] > 1:
                yield None, -2, None, None, None, None, words[k], int(totals[k]), 1
        groups = np.fromiter((ending(w, shape.endings) for w in words), np.int64, len(words)) + FIRST_ENDING
        groups = np.where(totals == 1, RARE, groups)
        for g in np.unique(groups[known]).tolist():
            mine = known & (groups == g)
            yield None, g, None, None, None, None, None, int(totals[mine].sum()), int(mine.sum())

    answers = written(wordtable.by_word(chunks, answer, _COUNTS), "counts")
    sums = answers.where("chunk IS NULL AND word IS NULL").groupBy("bucket").agg(F.sum("count"), F.sum("distinct"))
    frequent = answers.where("word IS NOT NULL").orderBy(F.desc("count"), "word").limit(singles).select("word", "count")
    found = frequent.collect()
    outputs = FIRST_ENDING + shape.endings + len(found)
    counts, shared = np.zeros(outputs, np.int64), np.zeros(outputs)
    once = tokens = distinct = 0
    for group, total, number in sums.collect():
        counts[group], shared[group] = total, total + 0.1 * number
        tokens, distinct = tokens + total, distinct + number
        once = number if group == RARE else once
    vocabulary = {}
    for k, (word, count) in enumerate(found):
        word = bytes(word)
        output = FIRST_ENDING + shape.endings + k
        group = ending(word, shape.endings) + FIRST_ENDING
        vocabulary[word] = output
        counts[group] -= count
        shared[group] -= count + 0.1
        counts[output] = count
    counts[END] = documents
    known = Counts(tokens + documents, distinct + (documents > 0), documents, shape, outputs, vocabulary, counts, shared, once)
    return answers.where("chunk IS NOT NULL").drop("word", "count", "distinct"), known


def encode(chunks: DataFrame, answers: DataFrame, counts: Counts) -> DataFrame:
    """Each document as outputs of the model, with its counts and the part of its score that needs no model."""
    out = wordtable.arrow_schema(_ENCODED)
    end_base = float(counts.base(np.array(counts.documents)))

    def work(replies: Iterator[dict], blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        words, c = [], np.zeros(0, np.int64)
        for r in replies:
            if r["bucket"] == -1:
                words = wordtable.unpack_words(r["data"], r["size"])
                c = np.zeros(len(words), np.int64)
            else:
                at = wordtable.unpack_positions(r["positions"], r["n"])
                c[at] = np.frombuffer(unsqueeze(r["data"], r["size"]), "<i8")
        output, share = counts.outputs_of(words, c)
        base, known, output = counts.base(c), c > 0, output.astype("<u4")
        for block in blocks:
            rows = []
            for doc, place in wordtable.documents(block):
                ids = planes(np.append(output[place], np.uint32(END)).astype("<u4"))
                n_known = int(known[place].sum()) + (counts.documents > 0)
                scores = float(base[place].sum()) + end_base, float(share[place].sum())
                rows.append((doc, held_out(doc), len(place) + 1, n_known, *scores, ids))
            yield wordtable.batch_of(rows, out)

    return wordtable.by_chunk(chunks, answers, work, _ENCODED, with_words=True)


@dataclass
class Classes:
    """Which class every output is of, and the outputs class by class, those of a class in order of their numbers."""

    of: np.ndarray
    order: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)

    def __post_init__(self):
        self.order = np.argsort(self.of, kind="stable")
        self.start = np.searchsorted(self.of[self.order], np.arange(int(self.of.max()) + 2))

    def __len__(self) -> int:
        return len(self.start) - 1

    def first(self, counts: np.ndarray) -> np.ndarray:
        """What the outputs of each class count together."""
        return np.bincount(self.of, counts, minlength=len(self))


def by_frequency(counts: np.ndarray) -> Classes:
    """Classes to begin with: as many as the root of the outputs, of outputs of all frequencies."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return Classes(rank % max(1, int(np.sqrt(len(counts)))))


def by_vectors(vectors: np.ndarray, counts: np.ndarray, seed: int = 11) -> Classes:
    """Classes of outputs with vectors near each other: k-means, and what is more than twice as large as usual is cut by frequency."""
    n = len(vectors)
    k = max(1, int(np.sqrt(n)))
    centers = vectors[np.random.default_rng(seed).choice(n, k, replace=False)]
    for _ in range(6):
        near = np.concatenate([
            (part @ centers.T - (centers * centers).sum(axis=1) / 2).argmax(axis=1) for part in np.array_split(vectors, 1 + n // 16384)
        ])
        sums = np.stack([np.bincount(near, vectors[:, d], minlength=k) for d in range(vectors.shape[1])], axis=1)
        sizes = np.bincount(near, minlength=k)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers).astype(np.float32)
    order = np.lexsort((-counts, near))
    begins = np.searchsorted(near[order], np.arange(k))
    within = np.arange(n) - begins[near[order]]
    part = np.empty(n, np.int64)
    part[order] = within // (2 * k)
    return Classes(np.unique(near * (n + 1) + part, return_inverse=True)[1])


@dataclass
class Model:
    """With h = first * context[u] + second * context[v] after outputs u, v, the score of a class is h . group[c] and that of an output in its
    class h . target[w], each plus its last column."""

    context: np.ndarray  # outputs + 1 rows; the last stands before a text
    order: np.ndarray  # 2 rows: the outputs one and two places before
    group: np.ndarray
    target: np.ndarray
    classes: Classes
    blocked: np.ndarray = field(repr=False)  # outputs that no word has

    @classmethod
    def start(cls, counts: Counts, seed: int = 7) -> Model:
        m, d = counts.outputs, counts.shape.dims
        rng = np.random.default_rng(seed)
        blocked = counts.output_counts == 0
        blocked[[END, RARE]] = False  # every text ends, and an unseen word belongs to the rare ones
        model = cls(
            rng.normal(0, 0.3, (m + 1, d)).astype(np.float32), np.array([[1.0] * d, [0.5] * d], np.float32),
            np.empty((0, d + 1), np.float32), np.zeros((m, d + 1), np.float32), by_frequency(counts.output_counts), blocked,
        )
        model.regroup(counts, model.classes, rng.normal(0, 0.05, (m, d)))
        return model

    def whole(self) -> np.ndarray:
        """Vector of every output, its class's included."""
        return self.target[:, :-1] + self.group[self.classes.of, :-1]

    def regroup(self, counts: Counts, classes: Classes, vectors: np.ndarray) -> None:
        """Other classes: each has the mean of its outputs' vectors, and its share of the counts as last column."""
        weight = counts.output_counts + 1.0
        mass = classes.first(weight)
        middle = np.stack([classes.first(weight * vectors[:, k]) for k in range(vectors.shape[1])], axis=1) / mass[:, None]
        self.classes = classes
        self.group = np.column_stack([middle, np.log(mass / mass.sum())]).astype(np.float32)
        self.target = np.column_stack([vectors - middle[classes.of], np.log(weight / mass[classes.of])]).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.order, self.group, self.target]

    def hidden(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.order[0] * self.context[u] + self.order[1] * self.context[v]

    def log_probabilities(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of outputs after the outputs before. Equal contexts are worked out once."""
        n = np.int64(len(self.context))
        contexts, at = np.unique(u * n + v, return_inverse=True)
        h, c = self.hidden(contexts // n, contexts % n), self.classes.of[w]
        # What is common to all of a context: the sum over classes.
        totals, group = np.empty(len(h), np.float32), np.ascontiguousarray(self.group[:, :-1].T)
        step = max(1, SCORES // len(self.classes))
        held = np.bincount(self.classes.of, ~self.blocked, minlength=len(self.classes)) > 0  # classes that some word is in
        own = np.where(held, self.group[:, -1], -np.inf).astype(np.float32)
        for k in range(0, len(h), step):
            totals[k : k + step] = _log_sums(h[k : k + step] @ group + own)
        last = self.target[:, -1] + self.group[self.classes.of, -1]
        result = np.einsum("ij,ij->i", h[at], self.whole()[w]) + last[w] - totals[at]
        # The contexts of each class, once each: the sum over its outputs.
        pairs, place = np.unique(c * np.int64(len(h)) + at, return_inverse=True)
        within, bounds = np.zeros(len(pairs), np.float32), np.searchsorted(pairs // max(1, len(h)), np.arange(len(self.classes) + 1))
        context = pairs % max(1, len(h))
        last = np.where(self.blocked, -np.inf, self.target[:, -1]).astype(np.float32)
        for k in np.flatnonzero(np.diff(bounds) * held).tolist():
            members = self.classes.order[self.classes.start[k] : self.classes.start[k + 1]]
            vectors, own, step = np.ascontiguousarray(self.target[members, :-1].T), last[members], max(1, SCORES // len(members))
            for first in range(bounds[k], bounds[k + 1], step):
                stop = min(bounds[k + 1], first + step)
                within[first:stop] = _log_sums(h[context[first:stop]] @ vectors + own)
        return result - within[place]


#: Scores that are in one matrix at a time, at most.
SCORES = 1 << 18


def _log_sums(scores: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials by row; the scores are used up."""
    top = scores.max(axis=1, keepdims=True)
    scores -= top
    np.exp(scores, out=scores)
    return top[:, 0] + np.log(scores.sum(axis=1))


def windows(outputs: list[bytes], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every token of the texts with the one and the two outputs before it, and the number of its text."""
    pad = np.array([start, start], np.uint32)
    arrays = np.concatenate([pad[:0], *(x for text in outputs for x in (pad, from_planes(text, "<u4")))]).astype(np.int64)
    lengths = np.array([len(x) // 4 for x in outputs], np.int64)
    keep = np.ones(len(arrays), bool)
    first = np.cumsum(np.concatenate([[0], lengths[:-1] + 2])) if len(lengths) else np.zeros(0, int)
    keep[first] = keep[first + 1] = False
    at = np.flatnonzero(keep)
    return arrays[at], arrays[at - 1], arrays[at - 2], np.repeat(np.arange(len(lengths)), lengths)


class Learner:
    """A model in training in one task: small batches, steps scaled by what each parameter has moved, and how often rows were met."""

    def __init__(self, model: Model, counts: Counts, seed: int):
        self.model, self.shape, self.rng = model, counts.shape, np.random.default_rng(seed)
        classes, weight = model.classes, np.where(model.blocked, 0, counts.output_counts + 1.0)
        mass = np.maximum(classes.first(weight), 1e-9)
        self.class_share = mass / mass.sum()
        self.class_ends = np.cumsum(self.class_share)
        self.ends = np.cumsum(weight[classes.order])
        self.mass = np.concatenate([[0], self.ends])[classes.start]
        self.log_class = np.log(self.class_share * self.shape.class_noise).astype(np.float32)
        self.log_word = np.log(np.maximum(weight / mass[classes.of], 1e-30) * self.shape.word_noise).astype(np.float32)
        self.squares = [np.full(p.shape, 1.0, np.float32) for p in model.parts()]
        self.met = [np.zeros(len(p), np.int64) for p in model.parts()]

    def learn(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        for k in range(0, len(w), self.shape.batch):
            at = order[k : k + self.shape.batch]
            self._batch(w[at], u[at], v[at])

    def _batch(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        model, shape, c = self.model, self.shape, self.model.classes.of[w]
        cu, cv = model.context[u], model.context[v]
        h = model.order[0] * cu + model.order[1] * cv
        # Classes against noise that all tokens of the batch share.
        drawn = np.minimum(np.searchsorted(self.class_ends, self.rng.random(shape.class_noise)), len(self.class_ends) - 1)
        own, noise = model.group[c], model.group[drawn]
        et = _wrong(np.einsum("ij,ij->i", h, own[:, :-1]) + own[:, -1] - self.log_class[c])
        en = _right(h @ noise[:, :-1].T + noise[:, -1] - self.log_class[drawn])
        dh = et[:, None] * own[:, :-1] + en @ noise[:, :-1]
        n_classes = len(model.group)
        group = np.zeros((n_classes, h.shape[1] + 1), np.float32)
        one = np.ones((len(w), 1), np.float32)
        full = np.hstack([h, one])
        for k in range(full.shape[1]):
            group[:, k] = np.bincount(c, et * full[:, k], minlength=n_classes)
        np.add.at(group, drawn, en.T @ full)
        # Outputs against noise from their own class.
        low, high = self.mass[c], self.mass[c + 1]
        points = low[:, None] + self.rng.random((len(w), shape.word_noise)) * (high - low)[:, None]
        picked = model.classes.order[np.minimum(np.searchsorted(self.ends, points.ravel(), side="right"), len(self.ends) - 1)]
        own, noise = model.target[w], model.target[picked].reshape(len(w), shape.word_noise, -1)
        et = _wrong(np.einsum("ij,ij->i", h, own[:, :-1]) + own[:, -1] - self.log_word[w])
        en = _right(np.einsum("ij,ikj->ik", h, noise[:, :, :-1]) + noise[:, :, -1] - self.log_word[picked].reshape(len(w), -1))
        dh += et[:, None] * own[:, :-1] + np.einsum("ik,ikj->ij", en, noise[:, :, :-1])
        moves = np.concatenate([et[:, None] * full, (en[:, :, None] * full[:, None, :]).reshape(-1, full.shape[1])])
        self._step(3, np.concatenate([w, picked]), moves)
        self._step(2, np.arange(n_classes), group)
        self._step(0, np.concatenate([u, v]), np.concatenate([dh * model.order[0], dh * model.order[1]]))
        self._step(1, np.arange(2), np.stack([(dh * cu).mean(axis=0), (dh * cv).mean(axis=0)]))

    def _step(self, part: int, rows: np.ndarray, slopes: np.ndarray) -> None:
        order = np.argsort(rows)
        ordered = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        at, slope = ordered[first], np.add.reduceat(slopes[order], first, axis=0)
        squares = self.squares[part][at] + slope * slope
        self.squares[part][at] = squares
        self.model.parts()[part][at] -= self.shape.rate * slope / np.sqrt(squares)
        self.met[part][at] += np.diff(np.append(first, len(rows)))

    def blocks(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """The rows that were met, in blocks: part, number of the block, how often each row was met, the rows."""
        for part, (rows, met) in enumerate(zip(self.model.parts(), self.met, strict=True)):
            for k in range(0, len(rows), ROWS):
                n = met[k : k + ROWS].astype(np.float64)
                if n.any():
                    yield part, k // ROWS, n.tobytes(), rows[k : k + ROWS].tobytes()


#: Rows of a model that are summed up together.
ROWS = 1024


def _wrong(score: np.ndarray) -> np.ndarray:
    """Slope of the loss by the score of what was there."""
    return (-1 / (1 + np.exp(np.clip(score, -30, 30)))).astype(np.float32)


def _right(score: np.ndarray) -> np.ndarray:
    """Slope of the loss by the score of noise."""
    return (1 / (1 + np.exp(np.clip(-score, -30, 30)))).astype(np.float32)


def train(encoded: DataFrame, counts: Counts) -> Model:
    """Train on every training document once, in rounds of growing parts of them.

    In a round each task starts from the common model and passes over its documents; then every row is the mean over the tasks that
    met it, by how often they did, summed up block by block in Spark. After the first round the outputs get learned classes.
    """
    shape, model = counts.shape, Model.start(counts)
    if not counts.documents:
        return model
    first = 0
    for number, eighths in enumerate(shape.rounds):

        def learn(batches: Iterator[pa.RecordBatch], number=number, model=model) -> Iterator[pa.RecordBatch]:
            learner, seen = Learner(model, counts, number), False
            for batch in batches:
                outputs = batch.column(0).to_pylist()
                for k in range(0, len(outputs), 1024):
                    w, u, v, _ = windows(outputs[k : k + 1024], counts.outputs)
                    learner.learn(w, u, v)
                    seen = True
            for row in learner.blocks() if seen else ():
                yield wordtable.batch_of([row], wordtable.arrow_schema(_BLOCKS))

        def add_up(block: pa.Table) -> pa.Table:
            weights = [np.frombuffer(x) for x in block["met"].to_pylist()]
            met = sum(weights)
            rows = sum(
                np.frombuffer(x, np.float32).reshape(len(met), -1) * n[:, None] for x, n in zip(block["rows"].to_pylist(), weights, strict=True)
            )
            mean = (rows / np.maximum(met, 1)[:, None]).astype(np.float32)
            same = block.slice(0, 1).select(["part", "number"])
            return same.append_column("met", pa.array([(met > 0).tobytes()], pa.binary())).append_column("rows", pa.array([mean.tobytes()], pa.binary()))

        part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
        rows = encoded.where(~F.col("held_out") & (part >= first) & (part < first + eighths)).select("outputs")
        first += eighths
        rows = rows.coalesce(1 + counts.tokens * eighths // (8 * shape.task_tokens * counts.outputs))
        found = rows.mapInArrow(learn, _BLOCKS).groupBy("part", "number").applyInArrow(add_up, _BLOCKS)
        for r in found.collect():
            into = model.parts()[r.part][r.number * ROWS : (r.number + 1) * ROWS]
            met = np.frombuffer(r.met, bool)
            into[met] = np.frombuffer(r.rows, np.float32).reshape(len(met), -1)[met]
        if number == 0:
            vectors = model.whole()
            model.regroup(counts, by_vectors(vectors, counts.output_counts), vectors)
    return model


_BLOCKS = "part int, number int, met binary, rows binary"


def score(encoded: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """The log10 probability of every text."""
    out = wordtable.arrow_schema(_SCORED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                w, u, v, text = windows(part.column("outputs").to_pylist(), counts.outputs)
                sums = np.bincount(text, model.log_probabilities(w, u, v), minlength=len(part)) / np.log(10)
                sums += part.column("shared_score").to_numpy()
                n = pa.array(np.full(len(part), counts.tokens), pa.int64())
                same = [part.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")]
                yield pa.RecordBatch.from_arrays([*same, n, part.column("base_score"), pa.array(sums)], schema=out)

    return encoded.mapInArrow(rows, _SCORED)


def score_texts(
    docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text",
    chunk_words: int = 2_000_000, chunk_distinct: int = 200_000, **sizes: int,
) -> DataFrame:
    """Train on the documents that are not held out and score all: a row per document.

    A null or empty text is the end token alone. Without training documents every word is unseen and the
    model stays as it starts. Rows with the same id are scored each for itself.
    """
    training = F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    documents = docs.select(docs[id_col].cast("long").alias("doc_id")).where(training).count()
    chunks = wordtable.split_words(docs, lower_words, lambda doc: not held_out(doc), id_col, text_col, chunk_words, chunk_distinct, **sizes)
    answers, counts = count_words(chunks, documents, shape)
    encoded = written(encode(chunks, answers, counts), "outputs")
    return score(encoded, counts, train(encoded, counts))
