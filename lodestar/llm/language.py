"""Language ID: words first, then shorter and shorter runs of characters.

1. All words of the training documents are counted by language: all documents with a language whose crc32(doc_id as text) modulo 5 isn't 0. Runs of 1 to LONGEST characters of these words, with a sign for either end, are counted from the words' counts.
2. The lexicon holds the words of the greatest share of a language, the tables of runs those of each length likewise: all words from a step of a scale of shares on, so that they are as many as the bound allows at most (LEXICON words and GRAMS runs of each length, fewer if there are so many languages that CELLS scores wouldn't do). Words beyond it are scored as unseen ones are.
3. A known word scores, in each language, the logarithm of its share, or the price of absence in languages that lack it. A word that no language knows scores the mean of its longest runs that some language knows: of LONGEST characters, else of one less, and so on; without any it says nothing. A text's score is the sum over its words and the logarithm of the language's share of the words; the probability of the best language is returned.

Words are runs of Unicode letters, in lower case. Texts without a letter, null and empty ones are `und` with score 0, and so are all where no language could be learned. Equal scores go to the language that comes first by name. Repeated rows each give a row; an empty table gives an empty result; very long texts are read whole, some megabytes at a time, cut between words. lang, source and doc_id are no inputs of a prediction, and other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of the lexicon, runs of each length, the longest run, and scores (words or runs times languages) at most.
LEXICON, GRAMS, LONGEST, CELLS = 200_000, 100_000, 5, 4_000_000
#: Steps of the scale of shares in a power of two.
STEPS = 64
#: Bytes of text whose words are held at once.
PIECE = 4 << 20
UNKNOWN = "und"


def pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about PIECE bytes, each with its first row; a longer text comes in several, cut at spaces and line ends where there are any."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_numpy()
    row = 0
    while row < len(column):
        ends = np.cumsum(sizes[row:])
        last = row + max(1, int(np.searchsorted(ends, PIECE, "right")))
        if sizes[row] <= PIECE:
            yield row, column.slice(row, last - row)
            row = last
            continue
        text = column[row].as_py()
        at = 0
        while at < len(text):
            to = min(len(text), at + PIECE // 4)
            while to < len(text) and text[to - 1].isalpha() and text[to].isalpha():
                to += 1
            yield row, pa.array([text[at:to]], pa.large_string())
            at = to
        row += 1


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, and of each word in them its place among these and its text's row."""
    parts = pc.split_pattern_regex(pc.utf8_lower(column), r"\PL+")
    flat, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), rows.filter(some).to_numpy()


def runs(many: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n characters of words, their ends being signs too, and the place of each one's word. A run of one sign is a letter."""
    c = np.frombuffer((" " + " ".join(many) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not many or len(c) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end = c == 32
    size = len(c) - n + 1
    ok = ~end[:size] if n == 1 else np.ones(size, bool)
    for i in range(1, n - 1):
        ok &= ~end[i : i + size]
    at = np.flatnonzero(ok)
    h = c[at]
    for i in range(1, n):
        h = h * common._C + c[at + i]
    return common.mix(h + np.uint64(n * int(common._M1) % 2**64)), np.cumsum(end)[at] - 1


def training(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang) that may be learned from."""
    return docs.filter(F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): how often each word occurs in the texts of each language."""

    def run(batches):
        for batch in batches:
            kind = batch.column("lang").dictionary_encode()
            of = kind.indices.to_numpy()
            for first, texts in pieces(batch.column("text")):
                known, word, row = words(texts)
                key, n = np.unique(of[first + row] * len(known) + word, return_counts=True) if len(word) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                size = max(1, len(known))
                yield pa.RecordBatch.from_arrays([kind.dictionary.take(pa.array(key // size)), known.cast(pa.string()).take(pa.array(key % size)), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    found = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def run_counts(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(size, run, lang, n) of the runs of 1 to longest characters in counted words; run is a hash."""

    def run(batches):
        for batch in batches:
            kind = batch.column("lang").dictionary_encode()
            of, n, many = kind.indices.to_numpy(), batch.column("n").to_numpy(), batch.column("word").to_pylist()
            for size in range(1, longest + 1):
                h, word = runs(many, size)
                order = np.lexsort((of[word], h))
                h, lang, weight = h[order], of[word][order], n[word][order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])]) if len(h) else np.zeros(0, np.int64)
                total = np.add.reduceat(weight, new) if len(new) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), size, np.int32)), pa.array(common.signed(h[new])), kind.dictionary.take(pa.array(lang[new])), pa.array(total)], ["size", "run", "lang", "n"])

    return counts.mapInArrow(run, "size int, run long, lang string, n long").groupBy("size", "run", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Of each language the logarithms of the shares of words and runs; what a language lacks has the price of absence."""

    def __init__(self, totals: dict[str, int]):
        """totals: the words of the training documents by language."""
        self.langs = sorted(totals)
        n = np.array([totals[x] for x in self.langs], np.float64)
        self.prior = np.log(n / n.sum()) if len(n) else n
        self.words: pa.Array = pa.array([], pa.large_string())
        self.word_scores = np.zeros((0, len(n)), np.float32)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def scores(self, place: np.ndarray, lang: list[str], n: np.ndarray, size: int, totals: dict[str, int]) -> np.ndarray:
        """A row for each of size words (or runs): place, lang and n say how often which occurs where, totals how many there are."""
        of = {x: i for i, x in enumerate(self.langs)}
        whole = np.array([max(1, totals.get(x, 0)) for x in self.langs], np.float64)
        out = np.full((size, len(self.langs)), -(np.log(whole.max()) + 1), np.float32)
        column = np.array([of[x] for x in lang], np.int64)
        out[place, column] = np.log(n / whole[column])
        return out

    def of_words(self, known: pa.Array) -> np.ndarray:
        """A row of scores for each of some distinct words."""
        out = np.zeros((len(known), len(self.langs)))
        at = pc.index_in(known, self.words)
        unseen = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        seen = np.setdiff1d(np.arange(len(known)), unseen, assume_unique=True)
        out[seen] = self.word_scores[pc.drop_null(at).to_numpy()]
        for size in sorted(self.runs, reverse=True):
            if not len(unseen):
                break
            keys, table = self.runs[size]
            h, word = runs(known.take(pa.array(unseen)).to_pylist(), size)
            place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[place] == h if len(keys) else np.zeros(len(h), bool)
            many = np.bincount(word[hit], minlength=len(unseen))
            for k in range(len(self.langs)):
                total = np.bincount(word[hit], table[place[hit], k], len(unseen))
                out[unseen[many > 0], k] = total[many > 0] / many[many > 0]
            unseen = unseen[many == 0]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its probability."""
        n, k = len(column), len(self.langs)
        total, letters = np.zeros((n, k)), np.zeros(n, np.int64)
        for first, texts in pieces(column):
            known, word, row = words(texts)
            by = self.of_words(known)
            letters[first : first + len(texts)] += np.bincount(row, minlength=len(texts))
            for j in range(k):
                total[first : first + len(texts), j] += np.bincount(row, by[word, j], len(texts))
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        total += self.prior
        best = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        score = np.where(letters > 0, 1 / share.sum(1), 0.0)
        return [self.langs[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)], score


def _shares(counts: DataFrame, by: list[str], totals: dict[str, int]) -> DataFrame:
    """Of each word or run of counts (by, lang, key, n) its langs and counts (seen), and the place of its greatest share of a language on a scale of STEPS steps a power of two; written. totals: of each key (a language, or a size and a language) how many there are."""
    # A row for each language and size: sent to the tasks with the plan.
    whole = F.try_element_at(F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(float(max(1, n))))]), F.col("key"))
    place = F.floor(F.log2(F.max(F.col("n") / whole)) * STEPS).cast("long")
    return common.saved(counts.groupBy(*by).agg(place.alias("place"), F.collect_list(F.struct("lang", "n")).alias("seen")), "shares")


def _kept(shares: DataFrame, most: int) -> DataFrame:
    """(name, lang, n) of the words or runs (name) with the greatest shares: whole places of the scale, as many as hold most at the most. No task sees more than its own rows."""
    held, least = 0, None
    for place, n in sorted(shares.groupBy("place").count().collect(), reverse=True):  # some thousand places at most
        if held + n > most:
            break
        held, least = held + n, place
    chosen = shares.filter(F.lit(False)) if least is None else shares.filter(F.col("place") >= least)
    return chosen.select("name", F.explode("seen").alias("x")).select("name", "x.lang", "x.n")


def train(docs: DataFrame, lexicon: int = LEXICON, grams: int = GRAMS, longest: int = LONGEST) -> Model:
    """Learns from all rows of docs (text, lang); at most lexicon words and grams runs of each length are kept."""
    counts = common.saved(word_counts(docs), "words")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    model = Model(totals)
    if not totals:
        return model
    most = max(1, CELLS // len(totals))
    shares = _shares(counts.withColumn("key", F.col("lang")), ["word"], totals).withColumnRenamed("word", "name")
    table = _kept(shares, min(lexicon, most)).toArrow()
    coded = table.column("name").combine_chunks().dictionary_encode()
    model.words = coded.dictionary.cast(pa.large_string())
    model.word_scores = model.scores(coded.indices.to_numpy(), table.column("lang").to_pylist(), table.column("n").to_numpy(), len(model.words), totals)
    found = common.saved(run_counts(counts, longest), "runs").withColumn("key", F.concat_ws(":", "size", "lang"))
    whole = {r.key: r.n for r in found.groupBy("key").agg(F.sum("n").alias("n")).collect()}  # longest rows for each language
    shares = _shares(found, ["size", "run"], whole).withColumnRenamed("run", "name")
    for size in range(1, longest + 1):
        table = _kept(shares.filter(F.col("size") == size), min(grams, most)).toArrow()
        own = {lang: whole[f"{size}:{lang}"] for lang in totals if f"{size}:{lang}" in whole}
        if own:
            keys, at = np.unique(table.column("name").to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
            model.runs[size] = keys, model.scores(at, table.column("lang").to_pylist(), table.column("n").to_numpy(), len(keys), own)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns lang_pred and score; columns of docs with these names are replaced."""
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = common.named(kept, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        for batch in batches:
            lang, score = shared.value.predict(batch.column(text).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(training(docs)))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
