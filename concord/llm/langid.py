"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word is the sum, over all ways to cut it into pieces, of the products of their
probabilities: a forward pass over the word gives it. A text's score adds the logarithms of
its words' probabilities. The probabilities are fitted by a forward-backward pass, which gives
the pieces' expected counts over all cuts.
"""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import held, map_batches, spread_over

#: Words that a Python worker remembers.
CACHE = 400_000
#: Different words of a language that a task counts before it hands their numbers on.
COUNTED = 200_000
#: Digits of a log-likelihood per letter whose median is taken, so that a language has a bounded number of values.
DIGITS = 4
#: Below this a forward value is carried on in a smaller unit.
SMALL = 1e-100
#: Texts that are scored at once.
GROUP = 200
#: Weight of the probabilities of all languages together in each language's own.
PRIOR = 50.0
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"

_PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def default_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """(number of each ordinary piece, longest piece). Control and byte pieces stay out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = [model.is_control, model.is_unknown, model.is_byte, model.is_unused]
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not any(f(i) for f in special)}
    return pieces, max(map(len, pieces))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def forward(word: str, weights: dict[str, tuple[float, ...]], floor: tuple[float, ...], longest: int) -> list[float]:
    """Logarithms, one for each language, of the word's probability over all segmentations.

    A character that is no piece counts as one with probability floor.
    """
    word = _START + word
    n, logs = len(word), [0.0] * len(floor)
    known = weights.get
    alpha = [[1.0] * len(floor)]
    for end in range(1, n + 1):
        p = known(word[end - 1 : end], floor)
        total = [a * b for a, b in zip(alpha[-1], p)]
        for size in range(2, min(longest, len(alpha)) + 1):
            p = known(word[end - size : end])
            if p is not None:
                total = [t + a * b for t, a, b in zip(total, alpha[-size], p)]
        alpha.append(total)
        if len(alpha) > longest:
            if min(total) < 1e-200:  # rescale what the next steps can reach
                top = [max(x) for x in zip(*alpha[-longest:])]
                alpha = [[x / t for x, t in zip(row, top)] for row in alpha[-longest:]]
                logs = [a + math.log(t) for a, t in zip(logs, top)]
            else:
                alpha = alpha[-longest:]
    return [a + math.log(x) for a, x in zip(logs, alpha[-1])]


class PieceTable:
    """Pieces by length as sorted hashes, so that many words are cut up at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, weights: dict[str, tuple[float, ...]], floor: tuple[float, ...], longest: int):
        self.floor, self.longest = np.array(floor), longest
        self.power = [np.uint64(1)]
        for _ in range(longest):
            self.power.append(np.uint64(int(self.power[-1]) * int(self.BASE) % (1 << 64)))
        by_size: dict[int, list[tuple[int, tuple[float, ...]]]] = defaultdict(list)
        for piece, w in weights.items():
            h = 0
            for c in piece:
                h = (h * int(self.BASE) + ord(c)) % (1 << 64)
            by_size[len(piece)].append((h, w))
        self.hashes = {k: np.array(sorted(h for h, _ in v), np.uint64) for k, v in by_size.items()}
        self.weights = {k: np.array([w for _, w in sorted(v)]) for k, v in by_size.items()}

    def _found(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows whose substring is a piece, the places of those pieces)."""
        if size not in self.hashes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.hashes[size], hashes)
        at[at == len(self.hashes[size])] = 0
        rows = np.flatnonzero(self.hashes[size][at] == hashes)
        return rows, at[rows]

    def forward(self, words: list[str]) -> np.ndarray:
        """What forward() gives for each word, for words of equal length."""
        n = len(words[0]) + 1
        codes = np.frombuffer("".join(_START + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        prefix = np.zeros((n + 1, len(words)), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * self.BASE + codes[:, i]
        alpha, logs = [np.ones((len(words), len(self.floor)))], np.zeros((len(words), len(self.floor)))
        for end in range(1, n + 1):
            total = alpha[-1] * self.floor
            for size in range(1, min(self.longest, len(alpha)) + 1):
                rows, at = self._found(size, prefix[end] - prefix[end - size] * self.power[size])
                if rows.size:
                    more = alpha[-size][rows] * self.weights[size][at]
                    total[rows] = more if size == 1 else total[rows] + more
            alpha = [*alpha[-self.longest + 1 :], total] if self.longest > 1 else [total]
            if end % 8 == 0:
                top = np.max(alpha, axis=0)
                alpha = [x / top for x in alpha]
                logs += np.log(top)
        return logs + np.log(alpha[-1])


def expected_pieces(word: str, weight: Callable[[str], float | None], longest: int) -> dict[str, float]:
    """Expected number of each piece over all segmentations of the word, however long it is.

    What a prefix is worth (alpha) is kept in units that shrink along the word, so it never becomes 0;
    the way back carries the share of the segmentations that have a cut there.
    """
    word = _START + word
    n = len(word)
    arcs = []
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            p = word[i:j]
            if w := weight(p):
                arcs.append((i, j, p, w))
            elif j == i + 1:
                arcs.append((i, j, p, 1e-9))
    alpha, unit, share = [1.0] + [0.0] * n, [0] * (n + 1), [0.0] * n + [1.0]
    at = shrunk = 0
    for i, j, _, w in [*arcs, (n, n, "", 0.0)]:
        if i > at:
            at = i
            if alpha[i] < SMALL:
                shrunk += 1
                for k in range(i, min(n, i + longest) + 1):
                    alpha[k] /= SMALL
            unit[i] = shrunk
        alpha[j] += alpha[i] * w
    out: dict[str, float] = defaultdict(float)
    for i, j, p, w in reversed(arcs):
        part = alpha[i] * w / alpha[j]
        for _ in range(unit[j] - unit[i]):
            part /= SMALL
        share[i] += share[j] * part
        out[p] += share[j] * part
    return out


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, tuple[float, ...]]
    floor: tuple[float, ...]
    longest: int
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """Log-likelihoods of texts under each language; remembers the first CACHE words."""

    #: Longer words are cut up one by one.
    SHORT = 40
    def __init__(self, model: Model):
        self.model = model
        self.pieces = PieceTable(model.weights, model.floor, model.longest)
        self.known: dict[str, int] = {}
        self.table = np.zeros((CACHE, len(model.languages)))

    def _words(self, words: list[str]) -> np.ndarray:
        m, out = self.model, np.zeros((len(words), len(self.model.languages)))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if len(w) <= self.SHORT:
                by_length[len(w)].append(i)
            else:
                out[i] = forward(w, m.weights, m.floor, m.longest)
        for rows in by_length.values():
            out[rows] = self.pieces.forward([words[i] for i in rows])
        return out

    def log_likelihoods(self, texts: list[list[str]], remember: bool = True) -> np.ndarray:
        """A row of the languages' log-likelihoods for each list of words."""
        known = self.known
        new = list({w for words in texts for w in words if w not in known})
        scored = self._words(new)
        room = min(len(new), CACHE - len(known)) if remember else 0
        self.table[len(known) : len(known) + room] = scored[:room]
        known.update(zip(new[:room], range(len(known), len(known) + room)))
        rest, extra = dict(zip(new[room:], range(len(new) - room))), scored[room:]
        out = np.zeros((len(texts), len(self.model.languages)))
        for i, words in enumerate(texts):
            at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
            seen = at >= 0
            out[i] = self.table[at[seen]].sum(0)
            if not seen.all():
                out[i] += extra[[rest[words[j]] for j in np.flatnonzero(~seen)]].sum(0)
        return out


def _usable(docs: DataFrame, learn: Column, text: str, lang: str) -> DataFrame:
    """(lang, text) of every row that can teach."""
    return docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def _counted_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n): how often each word stands in all texts of each language."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def flat(language: str, seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([language] * len(seen), pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=schema.names)

    def count(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words[language].update(words_of(body.as_py()))
                if len(words[language]) > COUNTED:
                    yield flat(language, words.pop(language))
        for language, seen in words.items():
            yield flat(language, seen)

    return rows.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocab: str | None = None) -> Model:
    """Piece probabilities of every non-null language among the rows where learn is true.

    All those rows count, each read whole: Spark counts the words of each language, and each
    different word is cut up once and weighs as often as it stands. What comes to the driver is one
    number for each piece and language. Rows with a null text or language teach nothing, texts without letters neither;
    rows that repeat count as often as they stand; an empty table gives a model without languages;
    other columns do not matter.
    """
    vocab = vocab or default_vocabulary()
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("piece", T.StringType()), T.StructField("n", T.DoubleType())])

    def count(batches):
        ids, longest = vocabulary(vocab)
        weight = {p: 1.0 / (i + 1000) for p, i in ids.items()}.get  # more common pieces have smaller numbers
        sums: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for batch in batches:
            for language, w, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                into = sums[language]
                for p, x in expected_pieces(w, weight, longest).items():
                    into[p] += n * x
        rows = [(k, p, n) for k, s in sums.items() for p, n in s.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=schema.names)

    words = _counted_words(_usable(docs, learn, text, lang)).repartition(spread_over(docs.sparkSession), "word")
    rows = words.mapInArrow(count, schema).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    ids, longest = vocabulary(vocab)
    counts, single = {k: defaultdict(float) for k in languages}, defaultdict(float)
    for r in rows:
        if r.piece in ids or len(r.piece) == 1:
            counts[r.lang][r.piece] += r.n
            single[r.piece] += r.n
    size, everything = len(single), sum(single.values())
    pooled = {p: (n + 0.1) / (everything + 0.1 * size + 1) for p, n in single.items()}
    totals = {k: sum(c.values()) for k, c in counts.items()}
    weights = {p: tuple((counts[k].get(p, 0.0) + PRIOR * q) / (totals[k] + PRIOR) for k in languages) for p, q in pooled.items()}
    # pieces that no text holds: as rare as a tenth of one occurrence
    floor = tuple(0.1 / (everything + PRIOR) for _ in languages)
    return Model(languages, weights, floor, min(longest, max((len(p) for p in weights), default=1)))


def letters_of(words: list[str]) -> int:
    """Characters of the words, with the mark that each begins with."""
    return sum(map(len, words)) + len(words)


def shuffled(words: list[str], seed: int) -> list[str]:
    """Words of the same lengths from the same letters in a random order."""
    letters = list("".join(words))
    random.Random(seed).shuffle(letters)
    out, at = [], 0
    for w in words:
        out.append("".join(letters[at : at + len(w)]))
        at += len(w)
    return out


def limits(docs: DataFrame, model: Model, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, float]:
    """For each language the log-likelihood per letter half-way between its rows and the same rows with their letters shuffled.

    Each side is the median over all rows where learn is true, to DIGITS digits, so odd rows among them do not
    count. Unlike the posterior, the measure neither depends on how many languages there are nor
    grows with the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("side", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def measure(batches):
        m = shared.value
        scorer, place = held(("language", m.key), lambda: Scorer(m)), {k: i for i, k in enumerate(m.languages)}
        for batch in batches:
            languages, bodies = batch.column(0).to_pylist(), batch.column(1)
            for start in range(0, len(bodies), GROUP):
                words = [words_of(x.as_py()) for x in bodies[start : start + GROUP]]
                rows = [i for i, w in enumerate(words) if w]
                own = [words[i] for i in rows]
                at = [place[languages[start + i]] for i in rows]
                letters = np.array([letters_of(w) for w in own], float)
                both = [scorer.log_likelihoods(texts, remember)[np.arange(len(rows)), at] / letters for texts, remember in ((own, True), ([shuffled(w, len(w)) for w in own], False))] if rows else []
                for side, values in enumerate(both):
                    yield pa.RecordBatch.from_arrays([pa.array([languages[start + i] for i in rows]), pa.array([side] * len(rows), pa.int32()), pa.array(values)], names=schema.names)

    rows = _usable(docs, learn & F.col(lang).isin(model.languages), text, lang)
    per = rows.mapInArrow(measure, schema).groupBy("lang", "side", F.round("value", DIGITS).alias("value")).agg(F.count("*").alias("n"))
    found = per.groupBy("lang").agg(*(F.percentile(F.when(F.col("side") == side, F.col("value")), 0.5, F.col("n")).alias(name) for side, name in enumerate(("own", "shuffled"))))
    return {r.lang: (r.own + r.shuffled) / 2 for r in found.collect()}


def predict(docs: DataFrame, model: Model, text: str = "text", keeps: list[str] | None = None, per_letter: str | None = None) -> DataFrame:
    """The columns `keeps` of docs, lang_pred and score; and under the name per_letter, if given, the log-likelihood per letter of lang_pred.

    score is the posterior probability of lang_pred under equal priors, over the whole text; ties
    go to the language that sorts first. A text that is null or has no letter, and any text
    where nothing was learned, gets `und`, score 0 and no likelihood. Rows that repeat are scored alike; an empty
    table gives no rows; columns of docs with the name of a new one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [T.StructField(per_letter, T.DoubleType())] if per_letter else []

    def make():
        m = shared.value
        width, scorer = len(m.languages), held(("language", m.key), lambda: Scorer(m))

        def run(cols):
            names, scores, each, column = [], [], [], cols[text]
            for at in range(0, len(column), GROUP):
                bodies = [x or "" for x in column[at : at + GROUP].to_pylist()]
                words = [words_of(x) for x in bodies]
                every = scorer.log_likelihoods(words) if width else None
                for i, body in enumerate(bodies):
                    if not width or not (any(map(str.isalpha, words[i])) or any(map(str.isalpha, body))):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        each.append(None)
                        continue
                    best = int(every[i].argmax())
                    names.append(m.languages[best])
                    scores.append(float(1.0 / np.exp(every[i] - every[i][best]).sum()))
                    each.append(float(every[i][best] / letters_of(words[i])) if words[i] else None)
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), per_letter: pa.array(each, pa.float64())}

        return run

    return map_batches(docs, make, [text], keeps if keeps is not None else docs.columns, [*_PREDICTED, *more])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids whose text has a CRC-32 of 2 modulo 4; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
