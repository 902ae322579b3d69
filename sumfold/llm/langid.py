"""Language identification: averaged hashed subword embeddings and a linear softmax.

Words (lower case, split at white space) are cut into character n-grams with word
boundaries, hashed into buckets; a text is the average of its buckets' embeddings. Words
count whole, whatever their length, so a text without spaces is judged on all of it. The
model is trained by stochastic gradient descent in numpy on a bounded sample for each
language (`per_lang` texts, whole), then a temperature is fitted on a part held back, and
texts below a calibrated probability are rejected.

Sampled texts become features on the executors, at most 6 bytes for each bucket, so
what the driver holds does not follow the length of the texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import small_batches, trim

BUCKETS, DIM, PER_LANG, LANGS, CACHE, MOST_REJECTED = 1 << 16, 16, 600, 1000, 200_000, 0.4
KEPT, PIECE, BLOCK = 64, 4096, 1 << 20  # characters of a word that is kept, of a piece of a word, hashed at once
_letter = re.compile(r"[^\W\d_]")


def pieces(word: str) -> list[tuple[str, int]]:
    """The word with its boundaries, cut where it is long: texts that overlap by three characters, and how many n-grams may start in each."""
    s = f"<{word}>"
    return [(s[a : a + PIECE + 3], min(PIECE, len(s) - a)) for a in range(0, len(s) - 1, PIECE)]


def blocks(parts: list[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    """The parts in runs of about BLOCK characters, so that memory does not follow the length of the texts."""
    ends = np.cumsum([len(s) for s, _ in parts]) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(parts)]
    return (parts[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def subwords(parts: list[tuple[str, int]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- to 4-grams that start in the parts' own characters, part after part, and how many each part has."""
    size, own = np.array([len(s) for s, _ in parts]), np.array([n for _, n in parts])
    x = np.frombuffer("".join([s for s, _ in parts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    at = np.arange(len(x)) - np.repeat(start, size)
    left, mine = np.repeat(size, size) - at, at < np.repeat(own, size)  # left: characters up to the part's end
    h, ids, fits = x, np.zeros((len(x), 3), np.int32), np.empty((len(x), 3), bool)
    for j, n in enumerate((2, 3, 4)):
        h = h[:-1] * np.uint64(0x100000001B3) + x[n - 1 :]
        m = (h ^ (h >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
        ids[: len(h), j] = (m >> np.uint64(32)) % np.uint64(buckets)
        fits[:, j] = (left >= n) & mine
    return ids[fits], np.add.reduceat(fits.sum(axis=1), start)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.zeros(BUCKETS, np.int64)
    for block in blocks([p for w in words for p in pieces(w)]):
        n += np.bincount(subwords(block)[0], minlength=BUCKETS)
    f = np.flatnonzero(n)
    return f, (n[f] / max(1, n.sum())).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class WordTable:
    """Summed scores and subword counts of the words seen so far in a task, dropped when they outgrow CACHE. Words beyond KEPT characters are summed anew each time."""

    def __init__(self, table: np.ndarray):
        self.table, self.index, self.rows = table, {}, np.empty((0, table.shape[1] + 1), np.float32)

    def _scored(self, parts: list[tuple[str, int]]) -> np.ndarray:
        """A row for each part: the summed scores, then the number of subwords."""
        out = [np.empty((0, self.table.shape[1] + 1), np.float32)]
        for block in blocks(parts):
            ids, n = subwords(block, len(self.table))
            out.append(np.column_stack([np.add.reduceat(self.table[ids], np.cumsum(n) - n, axis=0), n]).astype(np.float32))
        return np.concatenate(out)

    def sums(self, words: list[list[str]]) -> np.ndarray:
        """For each list of words: the summed scores, then the number of subwords."""
        if len(self.index) > CACHE:
            self.index, self.rows = {}, self.rows[:0]
        fresh = list({w for ws in words for w in ws if len(w) <= KEPT and w not in self.index})
        self.index.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
        self.rows = np.concatenate([self.rows, self._scored([(f"<{w}>", len(w) + 2) for w in fresh])])
        get = self.index.__getitem__
        short = [[w for w in ws if len(w) <= KEPT] for ws in words]
        out = np.array([self.rows[list(map(get, ws))].sum(axis=0, dtype=np.float64) if ws else np.zeros(self.rows.shape[1]) for ws in short])
        for i, ws in enumerate(words):
            if len(short[i]) < len(ws):
                out[i] += self._scored([p for w in ws if len(w) > KEPT for p in pieces(w)]).sum(axis=0, dtype=np.float64)
        return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # a bucket's score for each language: embedding times softmax weights
    bias: np.ndarray
    heat: float
    least: float  # calibrated probability below which a text is rejected

    def predict(self, texts: list[str | None], seen: WordTable) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; `und` and 0 for null or no letter, or if nothing was learned."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        ok = np.array([t is not None and bool(_letter.search(t)) for t in texts], bool)
        sums = seen.sums([t.lower().split() if o else [] for t, o in zip(texts, ok, strict=True)])
        p = _softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.heat)
        return [self.langs[b] if o else "und" for b, o in zip(p.argmax(axis=1), ok, strict=True)], np.where(ok, p.max(axis=1), 0.0)


def examples(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of the whole text and of one short window, so that short texts are judged as well; none without a letter."""
    if not _letter.search(text):
        return []
    words = text.lower().split()
    out = [_features(words)]
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(words) - 6)
    if any(map(_letter.search, words[at : at + 8])):
        out.append(_features(words[at : at + 8]))
    return out


def train(texts: list[str], langs: list[str]) -> Model:
    """A model of labelled texts."""
    return learn([(examples(t), lang) for t, lang in zip(texts, langs, strict=True)])


def learn(found: list[tuple[list[tuple[np.ndarray, np.ndarray]], str]], epochs: int = 4, rate: float = 0.5, seed: int = 7, kept_back: int = 5) -> Model:
    """SGD over the examples of labelled texts, in the order given. Without any, a model that knows no language."""
    names = sorted({lang for got, lang in found if got})
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    data = [(f, share, names.index(lang), j % kept_back == 0) for j, (got, lang) in enumerate(found) for f, share in got]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    used = [x for x in data if not x[3]] or data
    steps, step = epochs * len(used), 0
    for _ in range(epochs):
        for j in rng.permutation(len(used)):
            f, share, y, _ = used[j]
            h = share @ emb[f]
            z = h @ w + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            back = w @ g
            w -= lr * np.outer(h, g)
            b -= lr * 0.1 * g
            emb[f] -= (lr * share * min(64, len(f)))[:, None] * back
    table = emb @ w
    held = [x for x in data if x[3]] or data
    z = np.array([share @ table[f] + b for f, share, _, _ in held]) if held else np.zeros((0, len(names)))
    y = np.array([x[2] for x in held], int)
    heats = np.geomspace(0.25, 16, 49)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() if len(y) else 0 for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(z / heat) if len(y) else np.ones((1, len(names)))
    right = p.max(axis=1)[p.argmax(axis=1) == y] if len(y) else np.ones(1)
    # what all but a thousandth of the rightly named texts reach, but never so much that a text in two languages would go
    least = float(min(MOST_REJECTED, np.quantile(right, 0.001))) if len(right) else MOST_REJECTED
    return Model(names, table.astype(np.float32), b, heat, least if len(names) > 1 else 0.0)


def fit(docs: DataFrame, keep: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, langs: int = LANGS) -> Model:
    """Train on at most about `per_lang` texts of each of the `langs` most frequent languages, chosen by a hash of the id.

    Rows with null text or lang, or without a letter, do not take part, nor those for which `keep` is not true; repeated
    rows count each. Without any such row the model knows no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"), (F.lit(True) if keep is None else keep).alias("k"))
    rows = rows.where(F.col("k") & F.col("l").isNotNull() & F.col("t").isNotNull())
    sizes = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(langs).collect()
    if not sizes:
        return learn([])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.xxhash64("t").cast("string"))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.l, per_lang / r.n)])[F.col("l")]

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [examples(t) for t in pdf["t"]]
            yield pd.DataFrame({"i": pdf["i"], "l": pdf["l"], "f": [[f.astype("<u2").tobytes() for f, _ in g] for g in got], "x": [[x.astype("<f4").tobytes() for _, x in g] for g in got]})

    got = rows.where(draw < share).select(F.col("i").cast("string").alias("i"), "t", "l").mapInPandas(featured, "i string, l string, f array<binary>, x array<binary>").collect()
    got.sort(key=lambda r: (r.i or "", r.l, r.f))
    model = learn([([(np.frombuffer(f, "<u2").astype(np.int64), np.frombuffer(x, "<f4")) for f, x in zip(r.f, r.x, strict=True)], r.l) for r in got])
    del got
    trim(docs.sparkSession)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus lang_pred, lang_score (0 to 1) and lang_rejected. Row-local; other columns and rows are kept.

    Null texts and texts without a letter are `und`, score 0 and rejected. A model that knows no language
    calls all texts `und`, score 0, and rejects just those without a letter. Equal texts are judged
    alike, repeated rows each; of equally probable languages the first in order is named; an empty
    table gives an empty one; columns of the new names are replaced. The model (4 bytes for each bucket and language) is broadcast.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, lang_score double, lang_rejected boolean>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        seen = WordTable(m.table)
        for s in batches:
            texts, parts = [None if x is None else x for x in s], []
            for a in range(0, len(texts), 128):
                names, p = m.predict(texts[a : a + 128], seen)
                none = [t is None or not _letter.search(t) for t in texts[a : a + 128]]
                parts.append(pd.DataFrame({"lang_pred": names, "lang_score": p, "lang_rejected": [n or x < m.least for n, x in zip(none, p, strict=True)]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": pd.Series([], dtype=object), "lang_score": pd.Series([], dtype=float), "lang_rejected": pd.Series([], dtype=bool)})

    return docs.withColumn("_sf_id", of(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")], "_sf_id.*")
