"""Language-model scoring with a hashed maximum-entropy model.

Tokens are the words of a text in lower case (A-Z only) and one end. The softmax is
factored by class: first the token's class, then the token in its class. Both factors are
log-linear in hashed features of what stands before: the last word and the last two (n-gram
features), the word two back, and the class that holds most of the last WINDOW words, with
its share (skip features). In a class the most frequent
words are outcomes of their own; the others share one outcome and, in it, their smoothed
relative frequencies, so every word and the unknown word have a probability and all add
up to one. A further outcome of the first factor repeats the last word; a repeated word has both its own share and that.

Training: counts of all training tokens give the vocabulary, the classes and the biases.
Then the training texts, dealt into ROUNDS parts, are passed once: in a round every task
makes gradient steps on its texts from the round's weights, and the changes are averaged
by how often each feature occurred. Classes, their own words and feature rows grow with the
vocabulary (see `sizes`), by default up to 32 by 32 words and 2**16 rows, so that weights stay in a core's cache.

Words outside the HEAD most frequent ones are never held in memory: their counts are
joined on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import cut, small_batches

END = b" "  # no word
HEAD, UNITS, SIDE, ROWS = 1 << 18, 1 << 12, 32, 1 << 16
ROUNDS, RATE, DAMP, CHUNK, FLUSH, MEET = 3, 0.6, 10.0, 1 << 14, 400_000, 8  # 2**MEET tasks' changes meet in one sum
BLOCK, DEEP, AT_ONCE = 1 << 12, 8, 8 << 20  # tokens whose scores stay in a core's cache; gradients of a row that are added one by one; bytes of words looked up at once
USED, WINDOW = ([0, 1, 2, 3], [0, 3]), 48  # features of the two factors: the last word, the last two, the word two back, the window


def sizes(kinds: int, most_side: int = SIDE, most_rows: int = ROWS) -> tuple[int, int]:
    """Outcomes of either factor (classes and the repetition; a class's own words and the rest) and feature rows of each, for so many different words."""
    side, rows = 16, 1 << 15
    while side < most_side and 256 * side * side < kinds:
        side *= 2
    while rows < most_rows and rows < kinds:
        rows *= 2
    return side, rows


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words, without the end. bytes.lower and bytes.split know just A-Z and ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same words of many texts one after another, as binaries, and how many each text has; null: none."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, n = parts.flatten().view(pa.binary()), np.diff(parts.offsets.to_numpy()).astype(np.int64)
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():  # white space at either side leaves an empty word there
        words = words.filter(pa.array(full))
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[~full], minlength=len(n))
    return words, n


def units(words: pa.Array) -> np.ndarray:
    """Spelling units: of each word, its last three bytes without closing punctuation."""
    ends = pc.binary_slice(pc.ascii_rtrim(words.view(pa.string()), characters=".,;:!?\"')").view(pa.binary()), -3).dictionary_encode()
    return np.array([xxhash.xxh32_intdigest(x) % UNITS for x in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token binary, c): how often each token occurs in docs, ends included."""
    schema = pa.schema([("token", pa.binary()), ("c", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            words, _ = split(batch.column(0))
            seen = words.value_counts()
            held += [pa.table([seen.field(0), seen.field(1)], schema), pa.table([pa.array([END], pa.binary()), pa.array([len(batch)], pa.int64())], schema)]
            n += len(seen) + 1
            if n > FLUSH:
                one = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")])
                held, n = [pa.table([one["token"], one["c_sum"]], schema)], len(one)
                if n > FLUSH // 2:
                    yield from held[0].to_batches()
                    held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    parts = docs.select(F.col(text).alias("t")).mapInArrow(counted, "token binary, c long")
    return parts.groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    side: int  # outcomes of either factor
    rows: int  # feature rows of each
    words: pa.Array  # the head words
    counts: np.ndarray  # of the head words
    group: np.ndarray  # class of a head word
    place: np.ndarray  # its outcome in the class; the last: the rest
    of_unit: np.ndarray  # class of a spelling unit
    total: int  # training tokens
    kinds: int  # different ones
    rest: np.ndarray  # for each class: tokens of the shared outcome
    rest_kinds: np.ndarray  # and how many different ones
    class_tokens: np.ndarray
    end: int  # head index of the end, or -1


def _classes(words: list[bytes], counts: np.ndarray, side: int) -> np.ndarray:
    """A class for each spelling unit: spherical k-means over the character pairs of all the words of a unit, whole."""
    unit = units(pa.array(words, pa.binary()))
    k, profile = side - 1, np.zeros(UNITS * 256)
    for a in range(0, len(words), 1 << 14):
        part = [b"<" + w + b">" for w in words[a : a + (1 << 14)]]
        n = np.array([len(w) for w in part])
        x, own = np.frombuffer(b"".join(part), np.uint8).astype(np.int64), np.repeat(np.arange(len(part)), n)
        inside = own[1:] == own[:-1]
        pair = ((x[:-1] * 31 + x[1:] * 7) & 255)[inside]
        profile += np.bincount(unit[a : a + (1 << 14)][own[:-1][inside]] * 256 + pair, weights=np.sqrt(counts[a : a + (1 << 14)])[own[:-1][inside]], minlength=len(profile))
    profile = profile.reshape(UNITS, 256).astype(np.float32)
    norm = np.linalg.norm(profile, axis=1, keepdims=True)
    profile /= np.maximum(norm, 1e-9)
    mass = np.bincount(unit, weights=counts, minlength=UNITS)
    centre = profile[np.argsort(-mass)[:k]].copy()
    for _ in range(12):
        near = (profile @ centre.T).argmax(axis=1)
        for j in range(k):
            got = (profile[near == j] * np.sqrt(mass[near == j])[:, None]).sum(axis=0)
            if got.any():
                centre[j] = got / np.linalg.norm(got)
    return (profile @ centre.T).argmax(axis=1)


def vocabulary(counts: DataFrame, head: int = HEAD, most_side: int = SIDE, most_rows: int = ROWS) -> Vocabulary:
    """counts: (token, c), written already. Only the words of highest count, at most `head`, come to the driver."""
    step = F.floor(F.log2(F.col("c")) * 16)
    steps = sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    whole = counts.agg(F.sum("c").alias("t"), F.count("*").alias("n")).first()
    room, least = head, None
    for s, n in steps:
        if n > room:
            break
        room, least = room - n, s
    rows = counts.where(step >= least).toPandas() if least is not None else pd.DataFrame({"token": [], "c": []})
    rows["token"] = [bytes(x) for x in rows["token"]]
    rows = rows.sort_values(["c", "token"], ascending=[False, True], kind="stable")
    words, c = rows["token"].tolist(), rows["c"].to_numpy(np.int64)
    side, feature_rows = sizes(int(whole.n or 0), most_side, most_rows)
    of_unit = _classes(words, c, side) if words else np.zeros(UNITS, np.int64)
    head_words = pa.array(words, pa.binary())
    group = of_unit[units(head_words)]
    place, used = np.full(len(words), side - 1), np.zeros(side, int)
    for i, g in enumerate(group):
        if used[g] < side - 1:
            place[i], used[g] = used[g], used[g] + 1

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, n = np.zeros(side, np.int64), np.zeros(side, np.int64)
        for pdf in batches:
            g = of_unit[units(pa.array(pdf["token"], pa.binary()))]
            np.add.at(t, g, pdf["c"].to_numpy(np.int64))
            np.add.at(n, g, 1)
        yield pd.DataFrame({"g": range(side), "t": t, "n": n})

    by = counts.select("token", "c").mapInPandas(grouped, "g int, t long, n long").groupBy("g").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    all_t, all_n = np.zeros(side), np.zeros(side)
    for r in by:
        all_t[r.g], all_n[r.g] = r.t, r.n
    own = place < side - 1
    rest = all_t - np.bincount(group[own], weights=c[own], minlength=side)
    kinds = all_n - np.bincount(group[own], minlength=side)
    return Vocabulary(side, feature_rows, head_words, c, group, place, of_unit, int(whole.t or 0), int(whole.n or 0), rest, kinds, all_t, words.index(END) if END in words else -1)


@dataclass
class Words:
    """Words of some texts, without the ends."""

    words: pa.Array
    head: np.ndarray  # each one's head index, or -1
    n: np.ndarray  # how many each text has

    def pieces(self) -> Iterator[tuple[int, int, Words]]:
        """Runs of whole texts, first to before last, of 4 * CHUNK tokens and what their last text has beyond."""
        i, upto = 0, np.cumsum(self.n + 1)
        while i < len(self.n):
            before = upto[i - 1] if i else 0
            j = min(len(self.n), int(np.searchsorted(upto, before + 4 * CHUNK)) + 1)
            a, b = int(before) - i, int(upto[j - 1]) - j
            yield i, j, Words(self.words.slice(a, b - a), self.head[a:b], self.n[i:j])
            i = j


def look_up(v: Vocabulary, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Each batch and the words of a column of it. Some MB of batches are looked up at once, as every look-up builds a table of the head words."""
    held, size = [], 0
    for batch in batches:
        held.append((batch, *split(batch.column(column))))
        size += held[-1][1].nbytes
        if size >= AT_ONCE:
            yield from _heads(v, held)
            held, size = [], 0
    if held:
        yield from _heads(v, held)


def _heads(v: Vocabulary, held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    found = pc.index_in(pa.chunked_array([w for _, w, _ in held], pa.binary()), value_set=v.words)
    head, a = pc.fill_null(found, -1).to_numpy(), 0
    for batch, words, n in held:
        yield batch, Words(words, head[a : a + len(words)], n)
        a += len(words)


def most_held(group: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """The class that holds most of the last WINDOW words of the same text, the least of equals, and in its last digit its share in eighths; -1 at a text's start."""
    out, digit = np.empty(len(group), np.int64), np.arange(side - 1, -1, -1)[:, None]
    kind = np.int16 if (WINDOW + 1) * side < 1 << 15 else np.int32
    for a in range(0, len(group), BLOCK):
        low, here = max(0, a - WINDOW), at[a : a + BLOCK]
        place = np.arange(low, a + len(here)) + WINDOW * np.cumsum(at[low : a + len(here)] == 0)  # WINDOW empty places before each text
        place += WINDOW - place[0]
        part, held, span = np.zeros((side, place[-1] + 1), np.uint8), None, 1
        part[group[low : a + len(here)], place] = 1
        while span <= WINDOW:  # part: how many of the class stand at a place and the span - 1 before it; held: the same of the spans that WINDOW is the sum of
            if WINDOW & span:
                held = part if held is None else _behind(part, held, span)
            span *= 2
            if span <= WINDOW:
                part = _behind(part, part, span // 2)
        most = (held * kind(side) + digit.astype(kind)).max(axis=0).take(place[a - low :] - 1).astype(np.int64)  # a count and, in its last digit, the least class that reaches it
        room = np.minimum(here, WINDOW)
        out[a : a + len(here)] = np.where(room > 0, (side - 1 - most % side) * 8 + np.minimum(7, most // side * 8 // np.maximum(1, room)), -1)
    return out


def _behind(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """x plus what y has n places before."""
    out = x.copy()
    out[:, n:] += y[:, :-n]
    return out


class Batch:
    """Texts as arrays: for each token its head index (or -1), class, outcome, features and whether it repeats the last word."""

    def __init__(self, v: Vocabulary, texts: Words | list[list[bytes]]):
        if isinstance(texts, list):
            texts = next(_heads(v, [(None, pa.array(chain.from_iterable(texts), pa.binary()), np.array([len(t) for t in texts]))]))[1]
        self.last, self.words = v.rows - 1, texts.words
        h, side, self.n = len(v.counts), v.side, texts.n + 1
        self.after = np.cumsum(self.n)
        at = np.arange(self.after[-1]) - np.repeat(self.after - self.n, self.n)
        self.inner = np.ones(len(at), bool)
        self.inner[self.after - 1] = False
        self.word = np.full(len(at), v.end, np.int64)
        self.word[self.inner] = texts.head
        tail = np.flatnonzero(self.word < 0)
        rare = self.tokens(tail)
        tail_class = v.of_unit[units(rare)]
        safe = np.maximum(self.word, 0)
        self.group = v.group[safe] if h else np.zeros(len(at), np.int64)
        self.place = v.place[safe] if h else np.full(len(at), side - 1)
        self.group[tail], self.place[tail] = tail_class, side - 1
        seen = self.word.copy()
        seen[tail] = h + 1 + tail_class  # a rare word counts as its class
        before = lambda d: np.where(at >= d, np.concatenate([np.zeros(d, np.int64), seen[:-d]])[: len(seen)], h)
        p1, p2 = before(1), before(2)
        window = most_held(self.group, at, side)
        self.again = np.zeros(len(at), bool)
        self.again[1:] = self.word[1:] == self.word[:-1]
        self.again &= at >= 1
        two = np.flatnonzero(self.again[tail])  # places in tail; the token before stands there just before
        self.again[tail[two]] = pc.equal(rare.take(two), rare.take(two - 1)).to_numpy(zero_copy_only=False)
        mix = lambda x, k: (x.astype(np.uint64) + np.uint64(k * 0x10001)) * np.uint64(0x9E3779B97F4A7C15)
        f = np.stack([mix(p1, 1), mix(p1, 2) ^ (mix(p2, 3) * np.uint64(0xBF58476D1CE4E5B9)), mix(p2, 4), mix(window, 5)])
        f ^= f >> np.uint64(32)
        self.f = f * np.uint64(0xD6E8FEB86659FD93)

    def tokens(self, at: np.ndarray) -> pa.Array:
        """The tokens at some places."""
        word = np.where(self.inner[at], at - np.searchsorted(self.after, at, side="right"), len(self.words))
        return pa.concat_arrays([self.words, pa.array([END], pa.binary())]).take(word)

    def rows(self, level: int, a: int, b: int) -> np.ndarray:
        f = self.f[USED[level], a:b]
        if level:
            f = (f ^ (self.group[a:b].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15)
        return (f >> np.uint64(40)).astype(np.int32) & np.int32(self.last)


@dataclass
class Weights:
    bias: tuple[np.ndarray, np.ndarray]
    table: list[np.ndarray]

    def scores(self, level: int, rows: np.ndarray, group: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Scores of all outcomes, for each BLOCK of tokens. They are clipped, so their exponentials do not overflow."""
        t = self.table[level]
        for a in range(0, len(group), BLOCK):
            part = slice(a, a + BLOCK)
            z = t.take(rows[0, part], axis=0)
            for r in rows[1:, part]:
                z += t.take(r, axis=0)
            z += self.bias[0] if level == 0 else self.bias[1].take(group[part], axis=0)
            yield part, np.clip(z, -60, 60, out=z)

    def log_share(self, level: int, rows: np.ndarray, group: np.ndarray, goals: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Log probabilities of some outcomes of each token."""
        out = [np.empty(len(group)) for _ in goals]
        for part, z in self.scores(level, rows, group):
            at = np.arange(len(z))
            got = [z[at, g[part]] for g in goals]
            norm = np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))
            for o, x in zip(out, got, strict=True):
                o[part] = x - norm
        return out


def start_weights(v: Vocabulary) -> Weights:
    """Relative frequencies as biases, no features yet."""
    first = np.append((v.class_tokens[: v.side - 1] + 0.5), 0.001 * max(1, v.total))
    second = np.full((v.side, v.side), 1e-9)
    own = v.place < v.side - 1
    np.add.at(second, (v.group[own], v.place[own]), v.counts[own])
    second[:, -1] = np.maximum(v.rest, 0) + 0.5
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32)
    return Weights((log(first), log(second)), [np.zeros((v.rows, v.side), np.float32) for _ in range(2)])


class Learner:
    def __init__(self, v: Vocabulary, w: Weights):
        self.v, self.w = v, Weights(w.bias, [t.copy() for t in w.table])
        self.square, self.used = [np.full(v.rows, DAMP, np.float32) for _ in range(2)], [np.zeros(v.rows, np.int64) for _ in range(2)]

    def learn(self, texts: Words) -> None:
        b = Batch(self.v, texts)
        goal = np.where(b.again, self.v.side - 1, b.group)
        for a in range(0, len(goal), CHUNK):
            self.step(0, b.rows(0, a, a + CHUNK), goal[a : a + CHUNK], b.group[a : a + CHUNK])
            self.step(1, b.rows(1, a, a + CHUNK), b.place[a : a + CHUNK], b.group[a : a + CHUNK])

    def step(self, level: int, rows: np.ndarray, goal: np.ndarray, group: np.ndarray) -> None:
        """One AdaGrad step for each feature row by its summed gradient, scaled down by the root of its count."""
        g = np.empty((len(goal), self.v.side), np.float32)
        for part, z in self.w.scores(level, rows, group):
            np.exp(z, out=z)
            np.divide(z, (z @ np.ones(z.shape[1], np.float32))[:, None], out=g[part])
        g[np.arange(len(goal)), goal] -= 1
        flat = rows.ravel().astype(np.uint16 if self.v.rows <= 1 << 16 else np.uint32)
        order = np.argsort(flat, kind="stable")  # a radix sort for 16 bits
        here = flat[order]
        start = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        n = np.diff(np.append(start, len(here)))
        total, by = sums(g, order % len(goal), start, n)
        which, n = here[start[by]].astype(np.int64), n[by]
        total /= np.sqrt(n)[:, None].astype(np.float32)
        square, table = self.square[level], self.w.table[level]
        square[which] += np.einsum("ij,ij->i", total, total) / g.shape[1]
        total *= (np.float32(RATE) / np.sqrt(square[which]))[:, None]
        table[which] = table.take(which, axis=0) - total
        self.used[level][which] += n


def sums(g: np.ndarray, token: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the runs of `token` from `start`, each n long: the sums of g's rows at a run's tokens, longest runs first, and the runs in that order.

    Whole rows are added for the first DEEP tokens of every run, and what long runs have beyond goes column by column, two columns as one complex number.
    """
    by = np.argsort((65535 - np.minimum(n, 65535)).astype(np.uint16), kind="stable")
    start, n = start[by], n[by]
    longer = [len(n) - np.searchsorted(n[::-1], k, side="right") for k in range(DEEP + 1)]  # runs of more than k
    total = g.take(token[start], axis=0)
    for k in range(1, DEEP):
        total[: longer[k]] += g.take(token[start[: longer[k]] + k], axis=0)
    if u := longer[DEEP]:
        more = n[:u] - DEEP
        first = np.cumsum(more) - more
        beyond = token[np.arange(more.sum()) + np.repeat(start[:u] + DEEP - first, more)]
        total[:u] += np.add.reduceat(np.ascontiguousarray(g.view(np.complex64).T).take(beyond, axis=1), first, axis=1).T.copy().view(np.float32)
    return total, by


def _round(docs: DataFrame, v, w: Weights) -> Weights:
    """docs (t): a pass of all tasks from the weights w."""
    spark, per = docs.sparkSession, 1 << 11
    sent = spark.sparkContext.broadcast(w)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Learner(v.value, sent.value)
        for _, words in look_up(v.value, batches, 0):
            for _, _, texts in words.pieces():
                one.learn(texts)
        out = []
        for level in (0, 1):
            change = one.w.table[level] - sent.value.table[level]
            for a in range(0, len(change), per):
                used = one.used[level][a : a + per]
                if used.any():
                    out.append((level, a, TaskContext.get().partitionId() >> MEET, used.astype("<i8").tobytes(), change[a : a + per].astype("<f2").tobytes()))
        names = ("level", "a", "part", "used", "change")
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema(list(zip(names, [pa.int32()] * 3 + [pa.binary()] * 2, strict=True))))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        """Changes by the root of their use, and those roots: of single tasks, or sums of such sums."""
        n, change = np.zeros(per, np.float32), 0.0
        for u, c in zip(pdf["used"], pdf["change"], strict=True):
            if len(u) == 8 * per:
                root = np.sqrt(np.frombuffer(u, "<i8")).astype(np.float32)
                n, change = n + root, change + np.frombuffer(c, "<f2").reshape(per, -1).astype(np.float32) * root[:, None]
            else:
                n, change = n + np.frombuffer(u, "<f4"), change + np.frombuffer(c, "<f4").reshape(per, -1)
        return pdf[["level", "a"]][:1].assign(part=int(pdf["part"].iloc[0]) >> MEET, used=[n.tobytes()], change=[change.astype("<f4").tobytes()])

    schema = "level int, a int, part int, used binary, change binary"
    got = docs.mapInArrow(passed, schema)
    for _ in range(2):  # after this, a row for 2**(2 * MEET) tasks
        got = got.groupBy("level", "a", "part").applyInPandas(summed, schema)
    total = [(np.zeros((len(t), 1), np.float32), np.zeros_like(t)) for t in w.table]
    for r in got.collect():  # the weights, of bounded size
        n, change = total[r.level]
        n[r.a : r.a + per, 0] += np.frombuffer(r.used, "<f4")
        change[r.a : r.a + per] += np.frombuffer(r.change, "<f4").reshape(per, -1)
    sent.unpersist()
    return Weights(w.bias, [t + change / np.maximum(n, 1) for t, (n, change) in zip(w.table, total, strict=True)])


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: Weights
    counts: DataFrame  # token, c of all training tokens


def train(docs: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, rounds: int = ROUNDS, most_side: int = SIDE, most_rows: int = ROWS) -> Model:
    """Learn from the rows of docs for which keep holds. Null texts have just an end; repeated rows count each."""
    small_batches(docs.sparkSession)
    used = docs.where(F.coalesce(keep, F.lit(False)))
    counts = cut(count_tokens(used, text), "lm-counts")
    v = vocabulary(counts, head, most_side, most_rows)
    w = start_weights(v)
    sent = docs.sparkSession.sparkContext.broadcast(v)
    part = F.pmod(F.xxhash64(F.lit("round"), F.col(doc_id).cast("string")), F.lit(rounds))
    for r in range(rounds):
        w = _round(used.where(part == r).select(F.col(text).alias("t")), sent, w)
    return Model(v, w, counts)


def token_logs(v: Vocabulary, w: Weights, b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """For each token: its log probability and, of words outside the head, a number r. Such a word's probability is the first's exponential times its count plus a half plus r."""
    ln_c = np.log(v.counts + 0.5) if len(v.counts) else np.zeros(1)
    ln_rest = np.log(v.rest + 0.5 * (v.rest_kinds + 1))
    out, ratio = np.empty(len(b.word)), np.zeros(len(b.word))
    for a in range(0, len(out), CHUNK):
        group, place, word, again = (x[a : a + CHUNK] for x in (b.group, b.place, b.word, b.again))
        p, repeat = w.log_share(0, b.rows(0, a, a + CHUNK), group, (group, np.full(len(group), v.side - 1)))
        p += w.log_share(1, b.rows(1, a, a + CHUNK), group, (place,))[0]
        shared = place == v.side - 1
        p[shared] -= ln_rest[group[shared]]
        known = shared & (word >= 0)
        p[known] += ln_c[word[known]]
        rare = again & (word < 0)
        ratio[a : a + CHUNK][rare] = np.exp(repeat[rare] - p[rare])
        out[a : a + CHUNK] = np.where(again & (word >= 0), np.logaddexp(p, repeat), p)
    return out, ratio


def score(docs: DataFrame, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; log10 probabilities.

    A null or empty text is its end alone; repeated rows are scored each and equal texts alike; of equally frequent words the
    first in byte order is an outcome of its own; an empty table gives no rows, and a model of nothing scores all words alike. base_score is the unigram model with half a count added to every word and to the unknown one.
    """
    v, spark = model.vocabulary, docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((v, model.weights))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("t"))
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "more"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = sent.value
        rid = TaskContext.get().partitionId() << 40
        ln_c = np.log(v.counts + 0.5) if len(v.counts) else np.zeros(1)
        for batch, words in look_up(v, batches, 2):
            for i, j, texts in words.pieces():
                b = Batch(v, texts)
                ln_p, ratio = token_logs(v, w, b)
                at, known = b.after - b.n, b.word >= 0
                base = np.where(known, ln_c[np.maximum(b.word, 0)], 0.0)
                tail = np.flatnonzero(~known)
                upto = pa.array(np.append(0, np.searchsorted(tail, b.after)), pa.int32())
                rare, more = pa.ListArray.from_arrays(upto, b.tokens(tail)), pa.ListArray.from_arrays(upto, pa.array(ratio[tail]))
                of_text = [pa.array(x) for x in (b.n, np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(ln_p, at))]
                yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(j - i)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *of_text, rare, more], names)
                rid += j - i

    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    schema = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, more array<double>"
    rows = cut(rows.mapInArrow(scored, schema), "lm-scored")
    rare = rows.select("rid", F.inline(F.arrays_zip(F.col("rare").alias("token"), F.col("more").alias("r"))))
    half = F.coalesce("c", F.lit(0)) + 0.5
    rare = rare.join(model.counts.where("token is not null"), "token", "left").groupBy("rid").agg(F.count("c").alias("also"), F.sum(F.log(half)).alias("ln"), F.sum(F.log(half + F.col("r"))).alias("ln_new"))
    out = rows.drop("rare", "more").join(rare, "rid", "left")
    ten, norm = F.lit(math.log(10)), math.log(v.total + 0.5 * (v.kinds + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("also")).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        ((F.col("base") + zero("ln") - F.col("n_tokens") * F.lit(norm)) / ten).alias("base_score"), ((F.col("score") + zero("ln_new")) / ten).alias("score"),
    )
