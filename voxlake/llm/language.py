"""Language identification of mixed-language texts.

Script ranges narrow the candidate languages of a word; a word's score in each candidate comes from its character
trigrams; a Viterbi pass with a penalty on switches labels spans of words. A text's language is the one whose spans
hold most letters, its score that language's share of the letters.

Learned from a bounded number of texts for each of a bounded number of languages. A letter is what Unicode calls one
(categories L*): numerals such as superscripts or Roman ones are none, and split words.

Defined results: a null text, an empty one and one without a letter is `und` with score 0; words in scripts that no learned
language uses take no side; a text of only such words gets the language with most training texts, with score 0. Whole words
of whole texts are scored, however long. Where two languages score alike, the first by name is taken. Every row is returned,
rows that repeat a doc_id each by its own text; with no known language every text is `und`; an empty table gives no rows.
Columns of the input named lang_pred, score or lang_spans are replaced, all others are carried by `with_language`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import at_end, bounded_batches, cached, pieces
from voxlake.llm.quality import held_out

UND = "und"
#: Runs of letters, and of numerals that are no digits; `words_of` takes texts with the latter apart again.
_WORD = re.compile(r"[^\W\d_]+")
#: Script ranges: first code points of blocks of letters, by script (fixed values).
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "han"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x30000, "other"))
_STARTS = np.array([s for s, _ in SCRIPTS])
#: Words that a worker remembers, and their letters.
CACHE, CACHE_LETTERS = 120_000, 2_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters."""
    return _only_letters(text, _WORD.findall(text))


def _only_letters(text: str, words: list[str]) -> list[str]:
    if all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in text).split()


def script_of(word: str) -> str:
    return SCRIPTS[max(0, int(np.searchsorted(_STARTS, ord(word[0]), "right")) - 1)][1]


class Model:
    """Trigram scores of languages; `table` has a row for each known trigram, row 0 for unknown ones."""

    def __init__(self, texts: dict[str, list[str]], smooth: float = 0.5):
        self.languages = sorted(texts)
        self.prior = max(range(len(self.languages)), key=lambda k: len(texts[self.languages[k]]), default=0)
        counts: list[Counter] = []
        self.scripts: list[set[str]] = []
        for language in self.languages:
            words = Counter(w for t in texts[language] for w in words_of(t.lower()))
            grams: Counter = Counter()
            scripts: Counter = Counter()
            for w, n in words.items():
                s = f" {w} "
                for i in range(len(s) - 2):
                    grams[s[i : i + 3]] += n
                scripts[script_of(w)] += n
            counts.append(grams)
            whole = max(1, sum(scripts.values()))
            self.scripts.append({s for s, n in scripts.items() if n >= 0.02 * whole})
        keys = sorted(set().union(*counts)) if counts else []
        self.rows = {g: i + 1 for i, g in enumerate(keys)}
        totals = np.array([sum(c.values()) for c in counts], float)
        raw = np.array([[c.get(g, 0) for c in counts] for g in keys], float).reshape(len(keys), len(counts))
        seen = np.log((raw + smooth) / (totals + smooth * (len(keys) + 1)))
        none = np.log(smooth / (totals + smooth * (len(keys) + 1)))
        self.table = np.concatenate([none[None], seen]).astype(np.float32)


class WordScores(dict):
    """Row numbers of words in `scores`, learned as words come; forgets all when full."""

    def __init__(self, model: Model, clip: float = 6.0):
        super().__init__()
        self.model, self.clip = model, clip
        self.scores, self.letters = np.zeros((CACHE, len(model.languages)), np.float32), 0

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self))
        if not new:
            return
        self.letters += sum(map(len, new))
        if len(self) + len(new) > len(self.scores) or self.letters > CACHE_LETTERS:
            self.clear()
            new = list(words)
            self.letters = sum(map(len, new))
            if len(new) > len(self.scores):
                self.scores = np.zeros((len(new), self.scores.shape[1]), np.float32)
        rows, table = self.model.rows.get, self.model.table
        grams, ends = [], []
        for w in new:
            s = f" {w.lower()} "
            grams += [rows(s[i : i + 3], 0) for i in range(len(s) - 2)]
            ends.append(len(grams))
        sums = np.add.reduceat(table[grams], np.array([0, *ends[:-1]]), axis=0)
        sums -= sums.max(1, keepdims=True)
        np.maximum(sums, -self.clip, out=sums)
        for row, w in zip(sums, new):
            if w[0] > "ɏ" or len({*map(frozenset, self.model.scripts)}) > 1:
                script = script_of(w.lower())
                allowed = np.array([script in s for s in self.model.scripts])
                row[:] = np.where(allowed, row - (row[allowed].max() if allowed.any() else 0), -self.clip) if allowed.any() else 0
        at = len(self)
        self.scores[at : at + len(new)] = sums
        self.update(zip(new, range(at, at + len(new))))


def _word_scores(model: Model) -> WordScores:
    return cached((WordScores, *model.languages, hash(model.table.tobytes())), lambda: WordScores(model))


def viterbi(e: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the words of concatenated texts; e: scores (word, language); longest texts advance alone at last."""
    k = e.shape[1]
    order = np.argsort(-sizes, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)[:-1]][order]
    ordered = sizes[order]
    longest = int(ordered[0]) if len(ordered) else 0
    active = np.searchsorted(-ordered, -np.arange(1, longest + 1), "right")
    stay, back = np.ones((len(e), k), bool), np.zeros(len(e), np.int16)
    v, final = np.zeros((int(active[0]) if longest else 0, k), np.float32), np.zeros(len(sizes), np.int64)
    for t in range(longest):
        a = int(active[t])
        if a < len(v):
            final[a : len(v)] = v[a:].argmax(1)
            v = v[:a]
        at = starts[:a] + t
        if t:
            best = v.argmax(1)
            switch = v[np.arange(a), best][:, None] - penalty
            keeps = v >= switch
            stay[at], back[at] = keeps, best
            v = np.maximum(v, switch)
        v = v + e[at]
        v -= v.max(1, keepdims=True)
    if longest:
        final[: len(v)] = v.argmax(1)
    labels, state = np.zeros(len(e), np.int16), final
    for t in range(longest - 1, -1, -1):
        a = int(active[t])
        at = starts[:a] + t
        s = state[:a]
        labels[at] = s
        state[:a] = np.where(stay[at, s], s, back[at])
    return labels


def _predict(texts: list[str], scores: WordScores, penalty: float) -> tuple[list[str], list[float], list[list[dict]]]:
    found, rows, lengths = [], [], []
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        read = [_WORD.findall(t) for t in part]
        every = set().union(*read)
        if not all(map(str.isalpha, every.difference(scores))):  # known words are of letters only
            read = [_only_letters(t, words) for t, words in zip(part, read)]
            every = set().union(*read)
        scores.learn(every)
        for words in read:
            found.append(scores.scores[np.fromiter(map(scores.__getitem__, words), np.int64, len(words))])
            lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
    sizes = np.array(list(map(len, found)))
    e = np.concatenate(found) if found else np.zeros((0, len(scores.model.languages)), np.float32)
    labels = viterbi(e, sizes, penalty)
    sided = e.min(1, initial=0) < 0
    names, shares, spans, at = [], [], [], 0
    for n, size in zip(sizes, lengths):
        if not n:
            names.append(UND), shares.append(0.0), spans.append([])
            continue
        own, says = labels[at : at + n], sided[at : at + n]
        mass = np.bincount(own, size * says, len(scores.model.languages))
        best = int(mass.argmax()) if mass.any() else scores.model.prior
        names.append(scores.model.languages[best])
        shares.append(float(mass[best] / size.sum()))
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        spans.append([{"lang": scores.model.languages[int(own[c])], "first_word": int(c), "n_words": int(m)} for c, m in zip(cuts, np.diff(np.r_[cuts, n]))])
        at += n
    return names, shares, spans


_LANGS = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("lang_spans", pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])))])


def learn_languages(docs: DataFrame, texts_each: int = 300, most_languages: int = 500) -> Model:
    """A model of the most_languages commonest languages, from at most texts_each texts of each outside the held-out third,
    in hash order. Both bounds are parameters of the sample, so is what reaches the driver."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("known")).where("known is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    # a language of many rows is first thinned by the hash, to some four times what is taken
    counts = known.groupBy("known").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "known").limit(most_languages)
    place = F.xxhash64("doc_id", "known")
    thin = F.pmod(place, F.lit(1 << 20)) < F.lit(float(max(64, 4 * texts_each) << 20)) / F.col("n")
    order = Window.partitionBy("known").orderBy(place, "doc_id")
    some = known.join(F.broadcast(counts), "known").where(thin).distinct()
    ids = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= texts_each).select("doc_id", "known")
    frame = docs.sparkSession.createDataFrame([tuple(r) for r in ids.collect()], "doc_id long, known string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("known"), F.col("text").cast("string").alias("text")).where("known is not null and text is not null")
    rows = rows.join(F.broadcast(frame), ["doc_id", "known"], "left_semi").groupBy("doc_id", "known").agg(F.min("text").alias("text")).select("known", "text")
    texts: dict[str, list[str]] = {}
    for language, text in sorted(map(tuple, rows.collect())):
        texts.setdefault(language, []).append(text)
    return Model(texts)


def with_language(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """docs with lang_pred, score and lang_spans array<struct<lang, first_word, n_words>> appended (or replaced)."""
    bounded_batches(docs.sparkSession)
    clash = {"lang_pred", "score", "lang_spans"} & set(docs.columns)
    docs = docs.drop(*clash)
    at = docs.columns.index("text")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, lang_pred string, score double, lang_spans array<struct<lang: string, first_word: long, n_words: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _word_scores(model) if model.languages else None
        for whole in batches:
            for batch in pieces(whole, 800, 2):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                found = _predict(texts, scores, penalty) if scores is not None else ([UND] * len(texts), [0.0] * len(texts), [[]] * len(texts))
                new = [pa.array(c, f.type) for c, f in zip(found, _LANGS)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, *_LANGS]))

    return docs.mapInArrow(lambda batches: at_end(run(batches)), schema)


def identify_languages(docs: DataFrame, texts_each: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, lang_spans) of every row of docs (doc_id, text, lang)."""
    model = learn_languages(docs, texts_each)
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_language(taken, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_spans")
