"""BPE encoding and decoding by a tokenization automaton (operator 5).

The merges are compiled into a deterministic automaton over tokens by adding
one merge gadget after the other.  It starts as one state that loops on every
base symbol.  The gadget of a merge (u, v) gives the target of the u-arcs a
copy of its own if other arcs share it, removes that state's v-arc, and adds an
arc uv, from every state that has a u-arc, to the target of the removed arc.
What the automaton accepts is then exactly what the merges produce, so a word
has one path whose arc labels spell it: encoding follows it through the
transition table, decoding emits the labels.

A state's row of the transition table is stored by its gaps: the removed arcs
and the ranks of the merges that removed them.  An arc uv added by a later merge
is a gap too where the u-arc was one by then, so ``arc`` follows the left parts
of a token, at most seven in a 49k vocabulary.

Words are split and normalised as the tokenizer file says.  Defined cases: a
null text is empty and has no tokens; strings of special tokens in a text are
special tokens; a word of any length is encoded whole, in time proportional to
its length; further columns pass through untouched, but a column named like a
result is replaced by it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.llm.common import positional

#: Marks a word's end inside a token's spelling; no byte symbol looks like it.
END = "\n"
#: Words whose encodings a worker keeps young, and as many old: when the young
#: are that many they become the old ones, of which those used again are kept.
KEPT_WORDS = 150_000
LONGEST_KEPT_WORD = 64

#: The file's split for texts whose letters every version of Unicode agrees on;
#: texts with other characters are split by the library itself.
_LETTERS = "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\t-\\r \\x85\\xa0{_LETTERS}{_NUMBERS}]+")
_BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")
#: Texts with these are normalised by the library: characters beyond the letters above, and those whose small letters are beyond them.
_NEEDS_LIBRARY = re.compile("[\\u0250-\\U0010ffff" + "".join(chr(c) for c in range(0x80, 0x250) if max(chr(c).lower()) > "\u024f") + "]")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_symbols() -> list[str]:
    """The printable symbol of every byte, as byte-level vocabularies have it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in symbols):
        symbols[b] = chr(256 + n)
    return [symbols[b] for b in range(256)]


class Automaton:
    """The compiled merges; plain lists and dicts, so that it can be broadcast."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, special: dict[str, int]):
        self.symbols, self.special, self.suffix = byte_symbols(), special, suffix
        size = max([*vocab.values(), *special.values()]) + 1
        self.labels: list[str] = [""] * size
        for text, i in [*vocab.items(), *special.items()]:
            self.labels[i] = text
        self.left, self.rank = [-1] * size, [-1] * size
        self.gaps: list[dict[int, int]] = [{}]  # of each state: removed arcs and when
        self.target = [0] * size
        base = [s for s in self.symbols if s in vocab] + [s + suffix for s in self.symbols if s + suffix in vocab]
        alive = {vocab[s] for s in base}
        self._users = [len(alive) + 1]  # arcs that lead to a state; the start counts as one
        for rank, merge in enumerate(merges):
            u, v = merge if isinstance(merge, list | tuple) else merge.split(" ")
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v], alive)
        self.ids = {self._spelling(self.labels[i]): i for i in alive}
        lengths: dict[str, set[int]] = {}
        for text in self.ids:
            if len(text) > 2:
                lengths.setdefault(text[:3], {1, 2}).add(len(text))
        #: What ``arc`` follows for each token: its left part, when it was made, and what follows for that.
        self.parts: list[tuple | None] = [None] * size
        for w in sorted(alive, key=lambda w: self.rank[w]):
            if self.rank[w] >= 0:
                self.parts[w] = (self.left[w], self.rank[w] + 1, self.parts[self.left[w]])
        #: Lengths, longest first, that labels with given first three symbols have.
        self.reach = {start: tuple(sorted(found, reverse=True)) for start, found in lengths.items()}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        """Gaps travel as flat arrays: as many dicts and numbers would fill a worker's memory on the way."""
        sizes = np.fromiter(map(len, self.gaps), np.int64, len(self.gaps))
        flat = np.fromiter((x for g in self.gaps for pair in g.items() for x in pair), np.int32, 2 * int(sizes.sum()))
        return self.__dict__ | {"gaps": (sizes, flat), "_users": [], "words": {}, "old_words": {}}

    def __setstate__(self, state: dict) -> None:
        sizes, flat = state["gaps"]
        numbers = list(range(len(state["labels"])))  # one object for each number, however often it stands
        self.__dict__ = state | {"gaps": []}
        at = 0
        for end in (2 * np.cumsum(sizes)).tolist():
            own = flat[at:end].tolist()
            self.gaps.append(dict(zip([numbers[k] for k in own[::2]], [numbers[k] for k in own[1::2]], strict=True)))
            at = end

    def _spelling(self, label: str) -> str:
        return label[: -len(self.suffix)] + END if label.endswith(self.suffix) else label

    def _gadget(self, rank: int, u: int, v: int, w: int, alive: set[int]) -> None:
        if u not in alive or v not in alive or not self.arc(self.target[u], v):
            return  # the two are never neighbours when this merge's turn comes
        self.target[w] = self.target[v]
        self._users[self.target[v]] += 1
        state = self.target[u]
        if self._users[state] > 1:
            self._users[state] -= 1
            self._users.append(1)
            self.gaps.append(dict(self.gaps[state]))
            self.target[u] = state = len(self.gaps) - 1
        self.gaps[state][v] = rank
        self.left[w], self.rank[w] = u, rank
        alive.add(w)

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token``; its target is ``target[token]``."""
        gaps, ranks, before = self.gaps[state], self.rank, 1 << 60
        while True:
            if gaps.get(token, before) < before:
                return False
            rank = ranks[token]
            if rank < 0:
                return True
            before, token = rank + 1, self.left[token]

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one word given as byte symbols: the labels of its only path.

        A prefix of the word has one path too, so a position is reached by one
        arc at most and is entered once.  The longest label is followed at once;
        the others of a position are tried only where it leads nowhere.
        """
        spelled, n = word + END, len(word) + 1
        known, gaps, parts, target, longest = self.ids.get, self.gaps, self.parts, self.target, self.reach.get
        entered: set[int] = set()
        path: list[int] = []
        behind: list[tuple] = []  # of the positions on the path: what is left to try there
        i, gap, lengths = 0, gaps[0], iter(longest(spelled[:3], (2, 1)))
        while True:
            for length in lengths:
                j = i + length
                if j > n or j in entered:
                    continue
                token = known(spelled[i:j])
                if token is None or token in gap:
                    continue
                part = parts[token]  # the test of ``arc``, in place
                while part is not None:
                    left, before, part = part
                    if gap.get(left, before) < before:
                        break
                else:
                    path.append(token)
                    if j == n:
                        return path
                    entered.add(j)
                    behind.append((i, gap, lengths))
                    i, gap, lengths = j, gaps[target[token]], iter(longest(spelled[j : j + 3], (2, 1)))
                    break
            else:
                path.pop()
                i, gap, lengths = behind.pop()

    def encode_word(self, word: str) -> bytes:
        """The ids of a word, as packed 32-bit numbers."""
        found = self.words.get(word)  # a caller may still look into what were the young ones
        if found is not None:
            return found
        found = self.old_words.get(word)
        if found is None:
            symbols = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])
            found = np.array(self.encode_symbols(symbols), np.int32).tobytes()
        if len(word) <= LONGEST_KEPT_WORD:
            if len(self.words) >= KEPT_WORDS:
                self.old_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, joined by a space as the library joins them."""
        labels = self.labels
        return " ".join([labels[i] for i in ids.tolist()])


class Codec:
    """An automaton with the file's normaliser and the splitting into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"], self.special)
        self.normalizer = json.dumps(config | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})
        steps = config["normalizer"].get("normalizers", [config["normalizer"]])
        #: Whether texts of characters up to U+024F, which are all composed, are only put into small letters.
        self.lowers = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
        self.splits = [p for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._normalize = self._split = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_normalize": None, "_split": None}

    def _words(self, text: str) -> list[str]:
        if self.lowers and not _NEEDS_LIBRARY.search(text):
            return _WORDS.findall(text.lower())
        if self._normalize is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self._normalize = Tokenizer.from_str(self.normalizer).normalizer.normalize_str
            self._split = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(p["pattern"]["Regex"]), p["behavior"].lower(), p["invert"]) for p in self.splits])
        normal = self._normalize(text)
        if _BEYOND_LATIN.search(normal):
            return [w for w, _ in self._split.pre_tokenize_str(normal)]
        return _WORDS.findall(normal)

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = _ASCII_WORDS.findall(text.lower())
        else:
            words = self._words(text)
        known, encode = self.automaton.words, self.automaton.encode_word
        return b"".join([known.get(w) or encode(w) for w in words])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), np.int32)
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        packed = [np.array([self.special[p]], np.int32).tobytes() if p in self.special else self._plain(p) for p in parts]
        return np.frombuffer(b"".join(packed), np.int32)


def codec(spark, path: str):
    """A compiled codec, broadcast: a few MB whatever the input."""
    return spark.sparkContext.broadcast(Codec(path))


#: Rows that a worker holds encoded at once.
ROWS_AT_ONCE = 256


def _renamed(coded: DataFrame, docs: DataFrame, results: list[str]) -> DataFrame:
    """``coded`` under the names of ``docs`` and of the results, which take the place of columns named alike."""
    stay = [n not in results for n in docs.columns]
    kept = [c for c, s in zip(coded.columns, [*stay, *[True] * len(results)], strict=True) if s]
    return coded.select(*kept).toDF(*[n for n in docs.columns if n not in results], *results)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of every whole text, and the decoded ids if named."""
    shared = codec(docs.sparkSession, path)
    own, (text_name,) = positional(docs, text_col)
    fields = [T.StructField("__ids", T.ArrayType(T.IntegerType(), False))] + [T.StructField("__decoded", T.StringType())] * bool(decoded_col)
    at = own.columns.index(text_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                ids = [own.encode(t.as_py()) for t in batch.column(at)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                if decoded_col:
                    columns.append(pa.array([own.automaton.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])

    coded = own.mapInArrow(run, T.StructType([*own.schema.fields, *fields]))
    return _renamed(coded, docs, [ids_col, *[decoded_col] * bool(decoded_col)])


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text that the labels of its ids spell; null ids give an empty text."""
    shared = codec(tokens.sparkSession, path)
    own, (ids_name,) = positional(tokens, ids_col)
    at = own.columns.index(ids_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.value.automaton
        for batch in batches:
            texts = [decoder.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(at)]
            columns = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])

    return _renamed(own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("__decoded", T.StringType())])), tokens, [decoded_col])


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    coded = encode(slim, path, "text", "ids", "decoded")
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
