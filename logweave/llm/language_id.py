"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import crc_remainder, fresh, stored
from logweave.llm.words import Rolling, slices, text_bytes

ORDER = 4
# Bound of the training sample: documents per language, chosen by a hash of the id; one in so many calibrates.
SAMPLE_PER_LANGUAGE = 500
CALIBRATE = 5
SLICE = 1 << 19
UNKNOWN = "und"
# Share of calibration texts of a language that rejection would refuse.
REFUSED = 0.002

_MARK = 32
_ROLL = Rolling(seed=23)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its small letter where that is one code point."""
    points = [chr(i) for i in range(0x110000)]
    small = [c.lower() for c in points]
    alpha = np.fromiter((c.isalpha() for c in points), bool, len(points))
    return alpha, np.fromiter((ord(s) if len(s) == 1 else i for i, s in enumerate(small)), np.uint32, len(points))


@dataclass
class LetterWords:
    """Distinct words (runs of letters, small) of a slice: ``symbols`` has for each word ORDER - 1 marks, its letters and a mark;
    ``bounds`` delimit the words, ``token`` has the word of each token and ``first`` each text's first token."""

    symbols: np.ndarray
    bounds: np.ndarray
    token: np.ndarray
    first: np.ndarray


def _letter_words(part: np.ndarray, at: np.ndarray) -> LetterWords:
    alpha, small = _letters()
    points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
    border = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[at]
    letter = alpha[points]
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    filled = border[1:] > border[:-1]
    head, tail = border[:-1][filled], border[1:][filled] - 1
    begins[head], ends[tail] = letter[head], letter[tail]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    kept = small[points[letter]]
    stop = np.cumsum(end - start)
    offsets = np.concatenate([[0], stop]).astype(np.int64) * 4
    tokens = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = tokens.dictionary_encode()
    data, bounds = text_bytes(coded.dictionary)
    letters, bounds = data.copy().view(np.uint32), bounds // 4
    size = np.diff(bounds)
    ends = np.cumsum(size + ORDER)
    symbols = np.full(int(ends[-1]) if len(ends) else 0, _MARK, np.uint32)
    symbols[np.arange(len(letters)) + np.repeat(ends - size - 1 - bounds[:-1], size)] = letters
    return LetterWords(
        symbols, np.concatenate([[0], ends]), np.asarray(coded.indices).astype(np.int64), np.searchsorted(start, border)
    )


def _grams(words: LetterWords) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) in ``symbols`` of all ORDER-grams and the word of each."""
    size = np.diff(words.bounds) - (ORDER - 1)
    word = np.repeat(np.arange(len(size)), size)
    end = np.arange(len(word)) + np.repeat(words.bounds[:-1] + ORDER - (np.cumsum(size) - size), size)
    return end, word


def _hash(symbols: np.ndarray, end: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Hash of the n symbols before ``end``, leaving out the last ``skip``."""
    return _ROLL.runs(symbols.astype(np.uint64) + np.uint64(1), end - n, end - skip)


@dataclass
class Model:
    """``grams[n]`` and ``contexts[n]`` are sorted hash arrays with a row of natural logs per hash and a column per language:
    log p of a gram seen in any language, and log of the weight that a context leaves to the shorter gram."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    temperature: float = 1.0
    limit: np.ndarray | None = None

    def word_logs(self, words: LetterWords) -> np.ndarray:
        """Log probability of each distinct word and language."""
        end, word = _grams(words)
        logs = np.zeros((len(end), len(self.languages)))
        open_ = np.arange(len(end))
        for n in range(ORDER, 0, -1):
            keys, values = self.grams[n]
            found, at = _lookup(keys, _hash(words.symbols, end[open_], n))
            logs[open_[found]] += values[at[found]]
            open_ = open_[~found]
            if n > 1:
                keys, values = self.contexts[n]
                found, at = _lookup(keys, _hash(words.symbols, end[open_], n, 1))
                logs[open_[found]] += values[at[found]]
        logs[open_] += self.floor
        return np.stack([np.bincount(word, logs[:, k], len(words.bounds) - 1) for k in range(len(self.languages))], 1)

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per symbol for each text and language, and the number of symbols (0 without a letter)."""
        data, offsets = text_bytes(column)
        out, count = np.zeros((len(column), len(self.languages))), np.zeros(len(column))
        for i, j in slices(offsets, SLICE):
            words = _letter_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(words.token):
                continue
            text = np.repeat(np.arange(j - i), np.diff(words.first))
            logs = self.word_logs(words)[words.token]
            count[i:j] = np.bincount(text, (np.diff(words.bounds) - (ORDER - 1))[words.token], j - i)
            for k in range(len(self.languages)):
                out[i:j, k] = -np.bincount(text, logs[:, k], j - i) / np.maximum(count[i:j], 1)
        return out, count

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of the lowest cross-entropy, its calibrated probability, and whether rejection would refuse it."""
        entropy, count = self.entropies(column)
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        best = entropy.argmin(1)
        odds = np.exp(-self.temperature * (entropy - entropy.min(1, keepdims=True)))
        some = count > 0
        score = np.where(some, 1 / odds.sum(1), 0.0)
        refused = ~some | (entropy.min(1) > self.limit[best]) if self.limit is not None else ~some
        return [self.languages[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)], score, refused


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def build(counts: dict[str, dict[str, int]]) -> Model:
    """Models from the ORDER-gram counts of each language.

    The longest order uses the counts, shorter ones the number of different symbols seen before a gram; each order takes
    the discount n1 / (n1 + 2 n2) from every gram and gives it to the next shorter order, the last to all symbols alike.
    """
    languages = sorted(counts)
    symbols = {c for c_ in counts.values() for g in c_ for c in g} or {" "}
    uniform = 1.0 / (len(symbols) + 1)
    types = {n: {} for n in range(1, ORDER + 1)}
    for lang in languages:
        level = counts[lang]
        for n in range(ORDER, 0, -1):
            types[n][lang] = level
            shorter: dict[str, int] = {}
            for gram in level:
                shorter[gram[1:]] = shorter.get(gram[1:], 0) + 1
            level = shorter
    stats: dict[tuple[int, str], tuple[dict, dict, float]] = {}
    for n in range(1, ORDER + 1):
        for lang in languages:
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for gram, count in types[n][lang].items():
                total[gram[:-1]] = total.get(gram[:-1], 0) + count
                kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
            values = list(types[n][lang].values())
            once, twice = values.count(1), values.count(2)
            stats[n, lang] = total, kinds, once / (once + 2 * twice) if once and twice else 0.5
    known: dict[int, dict[str, list[float]]] = {0: {"": [uniform] * len(languages)}}

    def left(n: int, lang: str, context: str) -> float:
        total, kinds, discount = stats[n, lang]
        return discount * kinds[context] / total[context] if context in total else 1.0

    def prob(n: int, k: int, gram: str) -> float:
        if n == 0:
            return uniform
        if gram in known.get(n, ()):
            return known[n][gram][k]
        return left(n, languages[k], gram[:-1]) * prob(n - 1, k, gram[1:])

    grams, contexts = [(np.zeros(0, np.uint64), np.zeros((0, 0)))], [(np.zeros(0, np.uint64), np.zeros((0, 0)))]
    for n in range(1, ORDER + 1):
        union = sorted({g for lang in languages for g in types[n][lang]})
        table = {}
        for gram in union:
            row = []
            for k, lang in enumerate(languages):
                total, _, discount = stats[n, lang]
                own = max(types[n][lang].get(gram, 0) - discount, 0) / total[gram[:-1]] if gram[:-1] in total else 0.0
                row.append(own + left(n, lang, gram[:-1]) * prob(n - 1, k, gram[1:]))
            table[gram] = row
        known[n] = table
        grams.append(_sorted(union, [table[g] for g in union], len(languages)))
        heads = sorted({g[:-1] for g in union})
        contexts.append(_sorted(heads, [[left(n, lang, h) for lang in languages] for h in heads], len(languages)))
    # What the shortest order leaves to symbols never seen.
    floor = np.log([uniform * left(1, lang, "") for lang in languages])
    return Model(languages, grams, contexts, floor)


def _sorted(names: list[str], rows: list[list[float]], width: int) -> tuple[np.ndarray, np.ndarray]:
    if not names:
        return np.zeros(0, np.uint64), np.zeros((0, width))
    n = len(names[0])
    points = np.array([ord(c) for name in names for c in name], np.uint32)
    keys = _hash(points, (np.arange(len(names)) + 1) * n, n)
    order = np.argsort(keys)
    return keys[order], np.log(np.array(rows, float).reshape(len(names), width))[order]


def gram_counts(column: pa.Array, langs: list[str]) -> dict[tuple[str, str], int]:
    """Counts of (language, ORDER-gram) over all tokens of the texts."""
    counts: dict[tuple[str, str], int] = {}
    data, offsets = text_bytes(column)
    for k, lang in enumerate(langs):
        part = data[offsets[k] : offsets[k + 1]]
        words = _letter_words(part, np.array([0, len(part)]))
        if not len(words.token):
            continue
        times = np.bincount(words.token, minlength=len(words.bounds) - 1)
        end, word = _grams(words)
        runs = words.symbols[end[:, None] + np.arange(-ORDER, 0)]
        text = runs.astype("<u4").tobytes().decode("utf-32-le")
        for i, n in enumerate(times[word].tolist()):
            gram = lang, text[i * ORDER : (i + 1) * ORDER]
            counts[gram] = counts.get(gram, 0) + n
    return counts


def sample(docs: DataFrame, folds: int) -> DataFrame:
    """At most SAMPLE_PER_LANGUAGE documents per language outside the held-out fold: id, lang, n (rows of the id), place.

    A hash of the id first thins each language to a few times that number, so the ranking never gathers a whole language.
    An id counts once, however many rows have it; if they differ in language, the first in order counts.
    """
    known = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"))
    known = known.filter("id IS NOT NULL AND lang IS NOT NULL").filter(crc_remainder("id", folds) != 0)
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    few = known.join(F.broadcast(sizes), "lang").filter(chance * F.col("n") < 3.0 * SAMPLE_PER_LANGUAGE)
    few = few.groupBy("id").agg(F.min("lang").alias("lang"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(chance, "id"))
    return few.select("id", "lang", "n", place.alias("place")).filter(F.col("place") <= SAMPLE_PER_LANGUAGE)


def fit(docs: DataFrame, folds: int = 5) -> Model:
    """Train on a bounded sample of labelled documents; a part of it sets temperature and rejection limits."""
    chosen = stored(sample(docs, folds), "language-sample").withColumn("calibrate", F.col("place") % CALIBRATE == 0).drop("place")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    if not chosen.filter("n > 1").isEmpty():
        # One text per id: the first in order of those that rows of this id have.
        again = rows.filter("n > 1").groupBy("id", "lang", "calibrate").agg(F.min("text").alias("text"))
        rows = rows.filter("n = 1").drop("n").unionByName(again)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = gram_counts(batch["text"], batch["lang"].to_pylist())
            names = list(counts)
            columns = [pa.array([a for a, _ in names]), pa.array([b for _, b in names]), pa.array([counts[k] for k in names])]
            kinds = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], ["lang", "gram", "n"])

    counted = rows.filter("NOT calibrate").select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
    counts: dict[str, dict[str, int]] = {}
    for batch in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang, gram, n in zip(*(batch[c].to_pylist() for c in ("lang", "gram", "n")), strict=True):
            counts.setdefault(lang, {})[gram] = n
    model = build(counts)
    if not model.languages:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, n = sent.value.entropies(batch["text"])
            columns = [batch["lang"], pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "entropy", "n"])

    shape = "lang string, entropy array<double>, n double"
    seen = rows.filter("calibrate").select("text", "lang").mapInArrow(measure, shape).filter("n > 0").toPandas()
    return calibrate(model, seen["lang"].tolist(), np.array(seen["entropy"].tolist(), float).reshape(len(seen), len(model.languages)))


def calibrate(model: Model, langs: list[str], entropy: np.ndarray) -> Model:
    """Temperature of the highest likelihood of the true languages, and per language the entropy above which to refuse."""
    own = np.array([model.languages.index(x) if x in model.languages else -1 for x in langs], np.int64)
    entropy, own = entropy[own >= 0], own[own >= 0]
    model.limit = np.full(len(model.languages), np.inf)
    if not len(own):
        return model
    best = -np.inf
    for temperature in 2.0 ** np.arange(0, 8, 0.5):
        logit = -temperature * entropy
        logit -= logit.max(1, keepdims=True)
        like = (logit[np.arange(len(own)), own] - np.log(np.exp(logit).sum(1))).mean()
        if like > best:
            best, model.temperature = like, float(temperature)
    for k in set(own.tolist()):
        model.limit[k] = np.quantile(entropy[own == k, k], 1 - REFUSED)
    return model


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``language``: a struct of lang, score and rejected for the whole text.

    An existing column of that name stays, the new one is then called ``language_``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def identified(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            lang, score, refused = sent.value.predict(column)
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(refused, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, ["lang", "score", "rejected"])

    return docs.withColumn(fresh("language", docs.columns), identified(F.col(text_col).cast("string")))


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of ``docs`` (doc_id, text, lang).

    ``lang_pred`` is the learned language of the lowest cross-entropy, also where ``rejected`` says that the text is unlike all
    of them; ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned. Rows repeat as they are;
    an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", (crc_remainder("doc_id", folds) == 0).alias("held_out"))
    found = with_language(rows, fit(docs, folds))
    return found.select(
        "doc_id",
        "held_out",
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )
