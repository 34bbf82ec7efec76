"""Toxicity by noisy-channel deobfuscation: Viterbi decoding of character lattices, then scoring of the restored text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certjobs.llm.common import labelled_sample, text_of, written

#: Labelled rows that the scorer is fitted on, by their whole texts.
SAMPLE_ROWS = 8_000
#: Documents of the sample that must hold a feature: this many, and one in so many.
LEAST_DOCS, LEAST_SHARE = 4, 1500
#: Lengths of word beginnings that are features beside whole words.
STEMS = (5, 6, 7, 8, 9)
#: Tokens that a task remembers, plain ones and restored ones.
REMEMBERED = 300_000

#: Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
#: The channel's costs, in nats: a sign for a letter, a letter repeated once more than meant, a sign kept as it is.
SIGN_COST, REPEAT_COST, KEEP_COST = 1.0, 0.7, 9.0

#: Character classes of the language model: word boundary 0, a to z 1 to 26, any other letter 27.
ALPHABET = 28
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27

_SIGN = "0-9@$!|+€"
#: Three or more single characters with one blank or mark between each two.
_SPACED = re.compile(r"(?<![\w@$!|+€])(?:[^\W_]|[@$!|+€])(?:[ .\-_*](?:[^\W_]|[@$!|+€])){2,}(?![\w@$!|+€])")
#: Words and signs without a blank; those with a letter and a sign, or a letter twice in a row, are odd.
_TOKEN = re.compile(r"[\w@$!|+€]+")
_LETTER, _MARK, _TWICE = re.compile(r"[^\W\d_]"), re.compile(f"[{_SIGN}]"), re.compile(r"([^\W\d_])\1", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def _char_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _odd(token: str) -> bool:
    return bool(_MARK.search(token) and _LETTER.search(token) or _TWICE.search(token))


class Decoder:
    """Restores obfuscated tokens: the best path through the lattice of what each character may stand for."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.plain: set[str] = set()
        self.odd: dict[str, list[str]] = {}

    def token(self, raw: str) -> str:
        """A word with its signs and repeats decoded; one that is not odd has a lattice of one path and stays."""
        return self._decode(self._arcs(raw.lower())) if _odd(raw) else raw

    def spaced(self, raw: str) -> str:
        """Single characters with marks between them: at each mark the path joins them or starts another word."""
        steps: list[list[tuple[str, float]]] = []
        letters = [c.lower()[0] for c in raw[::2]]
        for c, before in zip(letters, ["", *letters], strict=False):
            if before:
                steps.append([("", 0.0), (" ", 0.0)])
            steps.append([*self._arcs(c)[0], *([("", REPEAT_COST)] if c == before else [])])
        return self._decode(steps)

    def words(self, text: str) -> set[str]:
        """The words of a text, as written and as restored: what is decoded never takes a written word away."""
        low = text.lower()
        found, tokens = set(_WORD.findall(low)), set(_TOKEN.findall(low))
        new = [x for x in tokens - self.plain if x not in self.odd]
        if len(self.plain) + len(self.odd) + len(new) > REMEMBERED:
            self.plain, self.odd, new = set(), {}, list(tokens)
        for raw in new:
            path = self.token(raw)
            if path is raw:
                self.plain.add(raw)
            else:
                self.odd[raw] = _WORD.findall(path)
        for extra in filter(None, map(self.odd.get, tokens)):
            found.update(extra)
        for m in _SPACED.finditer(text):
            found.update(_WORD.findall(self.spaced(m[0])))
        return found

    def _arcs(self, raw: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of one character, what it may be restored to and at what cost."""
        out, i = [], 0
        while i < len(raw):
            j = i
            while j < len(raw) and raw[j] == raw[i]:
                j += 1
            run, c = j - i, raw[i]
            letters = [(c, 0.0)] if c.isalpha() else [(x, SIGN_COST) for x in SIGNS.get(c, "")]
            arcs = []
            for x, price in letters:
                for times in sorted({run, 1, 2} if run > 1 else {1}):
                    if times <= run:
                        arcs.append((x * times, price * times + REPEAT_COST * (run - times)))
            if not c.isalpha():
                arcs.append((c * run, KEEP_COST * run))
            out.append(arcs)
            i = j
        return out

    def _decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for arcs in lattice:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (sofar, path) in best.items():
                for chars, price in arcs:
                    total, p, q = sofar + price, a, b
                    for c in chars:
                        r = _char_class(c)
                        total += self.cost[p][q][r]
                        p, q = q, r
                    if (p, q) not in after or total < after[p, q][0]:
                        after[p, q] = (total, (chars, path))
            best = after
        path = min(((total + self.cost[a][b][0], (a, b), path) for (a, b), (total, path) in best.items()), key=lambda x: x[:2])[2]
        out = []
        while path:
            chars, path = path
            out.append(chars)
        return "".join(reversed(out))

    def restore(self, text: str) -> str:
        """The text with spaced-out words joined and odd words decoded; all else has a lattice of one path and stays."""
        joined = _SPACED.sub(lambda m: self.spaced(m[0]), text)
        return _TOKEN.sub(lambda m: self.token(m[0]), joined)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of character-class trigrams over every whole text: (code, n), at most ALPHABET ** 3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                raw = np.frombuffer(f"  {value.as_py()}  ".encode(), np.uint8)
                for at in range(0, max(1, len(raw) - 2), 1 << 20):
                    c = _CLASS[raw[at : at + (1 << 20) + 2]]
                    total += np.bincount(c[:-2] * ALPHABET**2 + c[1:-1] * ALPHABET + c[2:], minlength=ALPHABET**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["code", "n"])

    return docs.select(text_of(text).alias("t")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs -log p(third | first two), smoothed by the pair and single frequencies."""
    n = np.zeros(ALPHABET**3)
    for r in trigram_counts(docs, text).collect():  # at most ALPHABET ** 3 rows
        n[r["code"]] = r["n"]
    n = n.reshape(ALPHABET, ALPHABET, ALPHABET)
    one = n.sum((0, 1)) + 1
    one = one / one.sum()
    two = n.sum(0) + 10 * one
    two = two / two.sum(1, keepdims=True)
    three = n + 10 * two[None]
    return -np.log(three / three.sum(2, keepdims=True))


def features(words: set[str]) -> set[str]:
    """Words and, behind a mark, beginnings of the longer ones."""
    return words | {"^" + w[:k] for w in words for k in STEMS if len(w) > k}


class ToxicityModel:
    """A logistic score over the features of the text and its restored words."""

    def __init__(self, cost: np.ndarray, weights: dict[str, float], shift: float):
        self.cost, self.weights, self.shift = cost, weights, shift
        self.words = {f: w for f, w in weights.items() if f[0] != "^"}
        self.stems = {f[1:]: w for f, w in weights.items() if f[0] == "^"}
        self._decoder: Decoder | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_decoder": None}

    def score(self, text: str | None) -> float:
        self._decoder = self._decoder or Decoder(self.cost)
        words = self._decoder.words(text or "")
        found = {w[:k] for w in words for k in STEMS if len(w) > k} & self.stems.keys()
        z = self.shift + sum(map(self.words.__getitem__, sorted(words & self.words.keys()))) + sum(map(self.stems.__getitem__, sorted(found)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit_weights(at: np.ndarray, col: np.ndarray, y: np.ndarray, wide: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, by Adam steps over the whole sample: row ``at[i]`` has feature ``col[i]``."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    w, mean, var = np.zeros(wide), np.zeros(wide), np.zeros(wide)
    b, mb, vb = float(np.log(prior / (1 - prior))), 0.0, 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col], len(y)) + b, -50, 50)))
        g, gb = np.bincount(col, (p - y)[at], wide) / len(y) + 1e-4 * w, float((p - y).mean())
        mean, var, mb, vb = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.999**k)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return w, b


def _featured(cost: np.ndarray):
    """(k, t, y) -> (k, y, f): the features of the texts and their restored words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(cost)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                found = [sorted(features(decoder.words(t.as_py()))) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array(found, pa.list_(pa.string()))], ["k", "y", "f"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """The character model from all of ``docs``; the scorer from a bounded sample of labelled rows, restored first.

    Features are counted by Spark; those that enough documents hold, toxic ones about twice as often as all, go to the
    driver. Without labelled rows of both classes the score is a constant."""
    cost = language_model(docs)
    sample = labelled_sample(docs, labels, target, rows, False, text_of())
    held = written(sample.mapInArrow(_featured(cost), "k string, y int, f array<string>"), "features")
    known = held.select("k", "y").toArrow()  # at most ``rows``
    y_of = dict(zip(known["k"].to_pylist(), known["y"].to_pylist(), strict=True))
    keys = {k: i for i, k in enumerate(sorted(y_of))}
    y = np.array([y_of[k] for k in keys], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel(cost, {}, float(np.log(share / (1 - share))))
    rate = max(0.02, 2 * float(y.mean()))
    each = held.select("k", "y", F.explode("f").alias("f"))
    least = max(LEAST_DOCS, len(y) // LEAST_SHARE)
    counted = each.groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("t")).filter((F.col("n") >= least) & ((F.col("t") + 1) / (F.col("n") + 2) > rate))
    pairs = each.join(counted, "f").select("k", "f").distinct().toArrow().sort_by([("k", "ascending"), ("f", "ascending")])
    names = sorted(pc.unique(pairs["f"]).to_pylist())
    at, col = (np.asarray(pc.index_in(pairs[c], pa.array(v, pa.string()))) for c, v in (("k", list(keys)), ("f", names)))
    w, b = fit_weights(at, col, y, len(names))
    return ToxicityModel(cost, {f: float(x) for f, x in zip(names, w, strict=True) if x}, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability ``name`` that a text is toxic; an existing column of that name is replaced. Whole
    texts are restored and scored; null counts as empty, and an empty text gets the score of no features."""
    base = docs.drop(name)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # features that LEAST_DOCS of SAMPLE_ROWS texts hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = pa.array([shipped.value.score(t.as_py()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())]))
