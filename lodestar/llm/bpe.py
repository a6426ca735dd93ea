"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

A first job counts the words of all texts; the frequent ones are merged once and compiled on the driver into a minimal automaton (equal suffixes share their states) whose paths number the words, and a table from numbers to ids. Its arrays are one file that Spark hands to every executor, where the workers memory-map it. A second job splits each whole text, walks the automaton for all words that the worker hasn't met lately at once and merges by the rules exactly those words that it doesn't hold. So the lexicon changes no result, only the time.

Ids and decoded texts are those of the tokenizer file: texts are split at its special tokens, normalised (NFC, lower case), split into letters, single digits and runs of others, and merged with word ends. Null and empty texts have no tokens and decode to an empty text. Repeated rows each give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words in the lexicon at most, and the times that a word must occur in a task to be counted there.
LEXICON, FREQUENT = 131072, 8
#: Runs between spaces that a task remembers before it forgets those that it hasn't met since as many before, and the longest that it does.
CACHE, CACHE_LENGTH = 100_000, 64
#: The same for tasks that put ids and decoded text together as strings: the pipeline's have less memory left.
TEXT_CACHE = 200_000
#: Characters of texts that are split together.
GROUP = 1 << 19
END, NONE = "</w>", 1 << 60


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next beyond 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


# What the regex module's newer tables call letters or numbers and the tokenizers' do not (code points, hexadecimal).
NEWER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7cf-a7cf a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ebb-16ed3 "
    "16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 "
    "1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)


# Capital letters that Python's Unicode tables don't know yet, with their lower case (of a range: of its first).
NEWER_CAPITALS = "1c89>1c8a a7cb>264 a7cc>a7cd a7ce>a7cf a7d2>a7d3 a7d4>a7d5 a7da>a7db a7dc>19b 10d50-10d65>10d70 16ea0-16eb8>16ebb"
# Marks that the tokenizers' older tables for NFC don't know: they stay where they are and nothing composes across them.
NEWER_MARKS = (
    "7fd-7fd 898-89f 8ca-8d3 9fe-9fe c3c-c3c d3b-d3c eba-eba 1715-1715 1abf-1ace 1df6-1dfa a82c-a82c 10d24-10d27 10eab-10eac "
    "10efd-10eff 10f46-10f50 10f82-10f85 11070-11070 1133b-1133b 1145e-1145e 11839-1183a 1193d-1193e 11943-11943 119e0-119e0 "
    "11a34-11a34 11a47-11a47 11a99-11a99 11d42-11d42 11d44-11d45 11d97-11d97 11f41-11f42 16ff0-16ff1 1e08f-1e08f 1e130-1e136 "
    "1e2ae-1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)


def newer_capitals() -> dict[int, int]:
    out = {}
    for part in NEWER_CAPITALS.split():
        run, to = part.split(">")
        first, last = (int(x, 16) for x in (run.split("-") * 2)[:2])
        out |= {c: int(to, 16) + c - first for c in range(first, last + 1)}
    return out


def letters_of(runs: str) -> str:
    """Runs of code points as a set of characters, for patterns."""
    return "[" + "".join("-".join(f"\\U{int(x, 16):08x}" for x in run.split("-")) for run in runs.split()) + "]"


class Rules:
    """What a tokenizer file of this kind says: specials, ids, merges and how texts are split."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split, self.odd = regex.compile(pattern), letters_of(NEWER)
        # The tables of the regex module are newer than the tokenizer's: what they add are signs to it.
        self.split_odd = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{self.odd}]").replace(r"[\p{L}]", rf"[\p{{L}}--{self.odd}]").replace(r"[\p{N}]+", rf"[\p{{N}}--{self.odd}]+").replace(r"|[\p{N}]|", rf"|[\p{{N}}--{self.odd}]|"), regex.V1)
        self.odd = regex.compile(self.odd)
        self.capitals, self.marks = newer_capitals(), re.compile(f"({letters_of(NEWER_MARKS)})")
        self.newer = re.compile(f"{letters_of(NEWER_MARKS)[:-1]}{''.join(map(chr, self.capitals))}]")
        #: The same for Arrow's linear-time matcher, which looks at many texts at once.
        self.newer_anywhere = re.sub(r"\\U([0-9a-f]{8})", r"\\x{\1}", self.newer.pattern)
        letters = byte_letters()
        self.first = [self.ids.get(x) for x in letters]
        self.last = [self.ids.get(x + END) for x in letters]
        if None in self.first or None in self.last:
            raise ValueError("the vocabulary lacks bytes")
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(self.ids[a] << 20) | self.ids[b]: (rank << 20) | self.ids[a + b] for rank, (a, b) in enumerate(merges) if a in self.ids and b in self.ids and a + b in self.ids}
        # What two bytes within a word merge to, and the last two.
        get, none = self.merges.get, NONE
        self.inner = [get((a << 20) | b, none) for a in self.first for b in self.first]
        self.final = [get((a << 20) | b, none) for a in self.first for b in self.last]

    def normalise(self, text: str, newer: bool | None = None) -> str:
        """newer: whether the text holds a letter of the newer ones, if that is known."""
        if not text.isascii():
            if self.newer.search(text) if newer is None else newer:
                text = "".join(unicodedata.normalize("NFC", x) for x in self.marks.split(text)).translate(self.capitals)
            else:
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case letter by letter: no final sigma
        return text.lower()

    def has_special(self, text: str) -> bool:
        return any(x in text for x in self.specials)

    def spaced(self, text: str, newer: bool | None = None) -> str:
        return self.normalise(text, newer).replace("\n", " ")

    def chunks(self, text: str) -> list[str]:
        """The text's runs between spaces and line ends, normalised (some are empty); special tokens are runs of their own, behind a space. No word crosses a run's ends."""
        if not self.has_special(text):
            return self.spaced(text).split(" ")
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [" " + part] if i % 2 else self.spaced(part).split(" ")
        return out

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            return [chunk[1:]] if chunk[:1] == " " else self.split.findall(chunk)
        return (self.split_odd if self.odd.search(chunk) else self.split).findall(chunk)

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        return [w for c in self.chunks(text) for w in self.words(c)]

    def merge(self, word: str) -> list[int]:
        """The ids of a word by the merge rules: always the pair of lowest rank, from the left."""
        if word in self.specials:
            return [self.specials[word]]
        raw = word.encode("utf-8")
        s = [*map(self.first.__getitem__, raw[:-1]), self.last[raw[-1]]]
        if len(s) > 200:
            return self._merge_long(s)
        get, none = self.merges.get, NONE
        ranks = [self.inner[a << 8 | b] for a, b in zip(raw, raw[1:-1])]
        if len(raw) > 1:
            ranks.append(self.final[raw[-2] << 8 | raw[-1]])
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            s[i : i + 2] = [low & 0xFFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((s[i] << 20) | s[i + 1], none)
            if i:
                ranks[i - 1] = get((s[i - 1] << 20) | s[i], none)
        return s

    def _merge_long(self, s: list[int]) -> list[int]:
        """The same for words of any length, with a heap of pairs and linked neighbours."""
        import heapq

        n = len(s)
        left, right, alive = [i - 1 for i in range(n)], [i + 1 for i in range(n)], [True] * n
        heap = [(r >> 20, i, s[i], s[i + 1], r & 0xFFFFF) for i in range(n - 1) if (r := self.merges.get((s[i] << 20) | s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], right[i] = new, False, right[j]
            if right[i] < n:
                left[right[i]] = i
            for p in (left[i], i):
                if p >= 0 and right[p] < n and (r := self.merges.get((s[p] << 20) | s[right[p]])) is not None:
                    heapq.heappush(heap, (r >> 20, p, s[p], s[right[p]], r & 0xFFFFF))
        return [x for x, ok in zip(s, alive, strict=True) if ok]


@functools.lru_cache(4)
def rules(path: str) -> Rules:
    return Rules(path)


def compile_lexicon(words: list[str], ids: list[list[int]], path: str) -> None:
    """Writes the minimal acyclic automaton of the words and their ids as one file.

    Words are added in byte order; a state whose continuation can't change any more is replaced by an equal one if there is one. Numbers on the arcs (how many words come before those through this arc) make each path add up to its word's place in the order.
    """
    pairs = sorted({w.encode("utf-8"): x for w, x in zip(words, ids, strict=True)}.items())
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    chain: list[tuple[int, int, int]] = []
    before = b""

    def settle(down_to: int) -> None:
        while len(chain) > down_to:
            parent, byte, child = chain.pop()
            key = (final[child], *arcs[child].items())
            arcs[parent][byte] = register.setdefault(key, child)

    for word, _ in pairs:
        common_length = len(os.path.commonprefix([before, word]))
        settle(common_length)
        at = chain[-1][2] if chain else 0
        for byte in word[common_length:]:
            arcs.append({})
            final.append(False)
            arcs[at][byte] = len(arcs) - 1
            chain.append((at, byte, len(arcs) - 1))
            at = len(arcs) - 1
        final[at] = True
        before = word
    settle(0)
    order, place = [0], {0: 0}
    for s in order:
        for child in arcs[s].values():
            if child not in place:
                place[child] = len(order)
                order.append(child)
    below: dict[int, int] = {}

    def count(s: int) -> int:
        if s not in below:
            below[s] = final[s] + sum(count(c) for c in arcs[s].values())
        return below[s]

    used = sorted({b for s in order for b in arcs[s]})
    classes = np.full(256, len(used), np.int32)
    classes[used] = range(len(used))
    width = len(used) + 1
    to, number = np.full((len(order) + 1, width), len(order), np.int32), np.zeros((len(order) + 1, width), np.int32)
    for s in order:
        n = int(final[s])
        for b, child in sorted(arcs[s].items()):
            to[place[s], classes[b]], number[place[s], classes[b]] = place[child], n
            n += count(child)
    ends = np.array([final[s] for s in order] + [False])
    flat = np.array([i for _, x in pairs for i in x], np.int32)
    offsets = np.cumsum([0] + [len(x) for _, x in pairs]).astype(np.int64)
    with open(path, "wb") as f:
        for x in (classes, to, number, ends, flat, offsets):
            np.save(f, x)


class Lexicon:
    """A compiled file, memory-mapped."""

    def __init__(self, path: str):
        self.parts = []
        with open(path, "rb") as f:
            for _ in range(6):
                version = np.lib.format.read_magic(f)
                shape, _, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                n = int(np.prod(shape)) * kind.itemsize
                self.parts.append(np.memmap(path, kind, "r", f.tell(), shape) if n else np.zeros(shape, kind))
                f.seek(n, 1)
        self.classes, self.to, self.number, self.ends, self.flat, self.offsets = self.parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1: all walk through the automaton together, one byte a step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        active, step, dead = np.arange(len(words)), 0, len(self.to) - 1
        while len(active := active[(lengths[active] > step) & (state[active] != dead)]):
            c = self.classes[raw[starts[active] + step]]
            s = state[active]
            total[active] += self.number[s, c]
            state[active] = self.to[s, c]
            step += 1
        return np.where(self.ends[state], total, -1)

    def ids(self, number: int) -> list[int]:
        return self.flat[self.offsets[number] : self.offsets[number + 1]].tolist()


@functools.lru_cache(2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def frequent_words(docs: DataFrame, vocabulary: str) -> list[str]:
    """The most frequent words of all texts, at most LEXICON of them; a word is counted where it occurs FREQUENT times in a task."""

    def run(batches):
        r, counts, runs = rules(vocabulary), Counter(), Counter()

        def counted() -> None:
            for chunk, n in runs.items():
                for w in r.words(r.normalise(chunk)):
                    counts[w] += n
            runs.clear()
            if len(counts) > 4 * CACHE:
                for w in [w for w, n in counts.items() if n == 1]:
                    del counts[w]

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                # Roughly what chunks() gives, without those that occur once: which words are in the lexicon changes no result.
                found = pc.utf8_split_whitespace(pc.utf8_lower(batch.column(0).slice(lo, 2048)).cast(pa.large_string())).flatten().value_counts()
                found = found.filter(pc.greater(found.field(1), 1))
                for c, n in zip(*(found.field(k).to_numpy(zero_copy_only=False).tolist() for k in (0, 1)), strict=True):
                    if len(c) <= CACHE_LENGTH:
                        runs[c] += n
                if len(runs) > 2 * CACHE:
                    counted()
        counted()
        keep = [(w, n) for w, n in counts.items() if n >= FREQUENT and len(w) <= CACHE_LENGTH]
        yield pa.record_batch([pa.array([w for w, _ in keep], pa.string()), pa.array([n for _, n in keep], pa.int64())], ["word", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(LEXICON)
    return [w for w, _ in top.collect()]


def build_lexicon(docs: DataFrame, vocabulary: str) -> str:
    """Compiles the lexicon and hands it to the executors; the name by which they find it."""
    words = frequent_words(docs, vocabulary)
    r, spark = rules(vocabulary), docs.sparkSession
    name = f"lexicon-{hashlib.sha256(chr(10).join([vocabulary, *words]).encode('utf-8', 'surrogatepass')).hexdigest()[:16]}.bin"
    # The same words of the same vocabulary are the same file: a session hands it out once.
    if (spark.sparkContext.applicationId, name) not in _handed_out:
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
        compile_lexicon(words, [r.merge(w) for w in words], path)
        spark.sparkContext.addFile(path)
        _handed_out.add((spark.sparkContext.applicationId, name))
    return name


_handed_out: set[tuple[str, str]] = set()


class Encoder:
    """A task's view of rules and lexicon: remembers what chunks encode and decode to, as strings (packed: their ids as uint16). What it hasn't met for TEXT_CACHE chunks (packed: CACHE) goes, so that frequent ones stay."""

    def __init__(self, vocabulary: str, name: str | None, packed: bool = False):
        self.packed, self.most = packed, CACHE if packed else TEXT_CACHE
        self.rules, self.lexicon = rules(vocabulary), lexicon(SparkFiles.get(name)) if name else None
        self.written = {i: str(i) for i in self.rules.names}
        self.chunks: dict[str, tuple] = {}
        self.words: dict[str, tuple] = {}
        self.older_chunks: dict[str, tuple] = {}
        self.older_words: dict[str, tuple] = {}

    def _form(self, ids: list[int]) -> tuple:
        """What a word adds to the outputs: how many ids; its ids and its names, as strings (packed: ids as uint16)."""
        if self.packed:
            return len(ids), np.array(ids, np.uint16).tobytes()
        return len(ids), " ".join(map(self.written.__getitem__, ids)), " ".join(map(self.rules.names.__getitem__, ids))

    def _learn_words(self, words: set[str]) -> dict[str, tuple]:
        """The forms of words, by the lexicon, or merged where it doesn't hold them."""
        if len(self.words) > self.most:
            self.older_words, self.words = self.words, {}
        known, older, new = self.words, self.older_words, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        numbers = self.lexicon.numbers([w.encode("utf-8") for w in new]).tolist() if self.lexicon is not None and new else [-1] * len(new)
        for w, n in zip(new, numbers, strict=True):
            known[w] = self._form(self.lexicon.ids(n) if n >= 0 else self.rules.merge(w))
        return known

    def _learn(self, chunks: set[str]) -> None:
        if len(self.chunks) > self.most:
            self.older_chunks, self.chunks = self.chunks, {}
        known, older, new = self.chunks, self.older_chunks, []
        for c in chunks:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    new.append(c)
        split = [self.rules.words(c) for c in new]
        forms = self._learn_words({w for words in split for w in words})
        join = b"".join if self.packed else " ".join
        for c, words in zip(new, split, strict=True):
            if len(words) == 1:
                known[c] = forms[words[0]]
            else:
                parts = list(zip(*(forms[w] for w in words), strict=True))
                known[c] = (sum(parts[0]), *map(join, parts[1:])) if words else (0, *[join([])] * (1 if self.packed else 2))

    def encode_batch(self, texts: list[str | None]) -> list[pa.Array]:
        """Of each text the number of tokens, ids and decoded text; packed: ids as uint16, without decoded text."""
        out, group, size = [], [], 0
        newer = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.rules.newer_anywhere).to_pylist()
        for t, odd in zip(texts, newer, strict=True):
            group.append((t or "", bool(odd)))
            size += len(group[-1][0])
            if size > GROUP:
                out.append(self._group(group))
                group, size = [], 0
        out.append(self._group(group))
        return [pa.concat_arrays(c) for c in zip(*out, strict=True)]

    def _group(self, group: list[tuple[str, bool]]) -> list[pa.Array]:
        """group: texts, and whether they hold newer letters."""
        if any(self.rules.has_special(t) for t, _ in group):
            split = [self.rules.chunks(t) for t, _ in group]
            chunks, offsets = pa.array([c for x in split for c in x], pa.large_string()), np.cumsum([0, *map(len, split)])
        else:
            lists = pc.split_pattern(pa.array([self.rules.spaced(*x) for x in group], pa.large_string()), " ")
            chunks, offsets = lists.flatten(), lists.offsets.to_numpy()
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(distinct))
        # What the chunks of a text add is joined by Arrow; those without words add nothing.
        many, *forms = zip(*map(self.chunks.__getitem__, distinct), strict=True) if distinct else ((), *[()] * (1 if self.packed else 2))
        many, codes = np.array(many, np.int64), coded.indices.to_numpy()
        some = many[codes] > 0
        codes, offsets = codes[some], np.concatenate([[0], np.cumsum(some)])[offsets]
        tokens = np.concatenate([[0], np.cumsum(many[codes])])[offsets]
        kind, by = (pa.binary(), b"") if self.packed else (pa.string(), " ")
        joined = [pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(f, kind).take(pa.array(codes))), by) for f in forms]
        # Long chunks are rare and large: they aren't kept.
        for c in distinct:
            if len(c) > CACHE_LENGTH:
                for store in (self.chunks, self.words):
                    store.pop(c, None)
        return [pa.array(np.diff(tokens)), *joined]


def encode(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",), form: str = "text") -> DataFrame:
    """The kept columns with n_tokens and, by form: text - ids (decimal, joined by one space) and decoded; digest - the sha256 of both in hex; packed - ids as little-endian uint16."""
    vocabulary = vocabulary or vocabulary_file()
    name = build_lexicon(docs, vocabulary)
    chosen = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    new = {"text": ("ids string", "decoded string"), "digest": ("ids_sha256 string", "decoded_sha256 string"), "packed": ("ids binary",)}[form]
    names = [x.split()[0] for x in new]

    def run(batches):
        # One for each task: workers live on, and what they remember would stay with them.
        encoder = Encoder(vocabulary, name, form == "packed")
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                n, *columns = encoder.encode_batch(batch.column("__text").to_pylist())
                if form == "digest":
                    columns = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in c]) for c in columns]
                kind = pa.binary() if form == "packed" else pa.string()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n, *(c.cast(kind) for c in columns)], [*batch.schema.names[:-1], "n_tokens", *names])
        del encoder
        common.release()

    return chosen.mapInArrow(run, f"{kinds}, n_tokens long, {', '.join(new)}")


def decode(ids: list[int], vocabulary: str | None = None) -> str:
    """The text of ids: their tokens, joined by one space, as this kind of tokenizer file has no decoder."""
    names = rules(vocabulary or vocabulary_file()).names
    return " ".join(names[i] for i in ids if i in names)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), form="digest")
