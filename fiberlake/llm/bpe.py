"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled one after another into a deterministic automaton over tokens whose paths are exactly the token
sequences that BPE makes. It starts with one state and an arc for each base symbol. The gadget of merge r, (u, v) to w:

- the state that u leads to is split off and loses its arc v, so that u is never followed by v any more;
- wherever u and then v could be read, an arc w is added, which leads to the state v led to at that time. Where v can
  no longer follow u, because an earlier merge always joins their edges, the gadget adds nothing.

So a state belongs to the token read last; what it has lost are the cuts of the tokens down the right edge of its merge
tree, each while that token was there, and an arc w exists where the arc of its left part did when w was made. The
tables hold the cut of each gadget (u, v at rank r) and the parts of each token; a part was there until the rank of what
it became part of. `follows` reads an arc from these tables; listing all arcs would take the square of the vocabulary.

Words are read symbol by symbol with a transition table. Each string has one path in the token automaton, so each prefix
of a word has one last token. A reader's state is the longest label prefix that the word read so far ends with, and the
last tokens of the prefixes before it and before the shorter ones: all that later symbols can ask for. Its transition by
a symbol tries the labels that end there, of which exactly one follows the last token before it. States are numbered and
their transitions written into the table when they are first met; from then on a symbol is one look-up, without a
second try and without going back. The tokens are read off the states' last tokens from the word's end. Decoding emits
the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, table, texts

#: Distinct words that a Python worker keeps encoded; it starts anew when they are more.
CACHE_WORDS = 150_000
#: States that a reader keeps; it starts anew, between two words, when they are more.
MOST_STATES = 100_000
#: Documents whose ids are held at once.
ROWS = 512
NEVER = 1 << 30


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class State(dict):
    """A reader's row of the transition table: symbol to state. `lasts`: for its node and each shorter one with children,
    the last token of the text before it; `last`, the token of all read so far, is that of the empty node."""

    __slots__ = ("automaton", "node", "lasts", "last")

    def __init__(self, automaton: Automaton, node: int, lasts: tuple[int, ...]):
        super().__init__()
        self.automaton, self.node, self.lasts, self.last = automaton, node, lasts, lasts[-1]

    def __missing__(self, symbol: int) -> State:
        found = self[symbol] = self.automaton.after(self, symbol)
        return found


class Automaton:
    """The automaton of base symbols 0 .. base-1 and merges (left id, right id), of which number r makes token base + r."""

    def __init__(self, base: int, merges: list[tuple[int, int]]):
        size = base + len(merges)
        self.cut: dict[int, int] = {}
        #: the parts of each merged token, and -1 for base symbols
        self.first = [-1] * base + [u for u, _ in merges]
        self.second = [-1] * base + [v for _, v in merges]
        self.base = base
        self.width = [1] * base
        live, pairs = [True] * base, set()
        for r, (u, v) in enumerate(merges):
            w = base + r
            if max(u, v) >= w or (u, v) in pairs:
                raise ValueError(f"merge {r} uses a later token or repeats a pair")
            pairs.add((u, v))
            live.append(live[u] and live[v] and self.follows(u, v))
            if live[w]:
                self.cut[u << 20 | v] = r
            self.width.append(self.width[u] + self.width[v])
        self.step: dict[int, int] = {}  # trie of the labels: node and symbol to node
        self.label = [-1]  # trie node to token
        self.depth = [0]
        links = []  # (node, parent, symbol)
        spelling: list[tuple[int, ...]] = []
        for t in range(size):
            spelling.append((t,) if t < base else spelling[merges[t - base][0]] + spelling[merges[t - base][1]])
        for t in (t for t in range(size) if live[t]):
            node = 0
            for s in spelling[t]:
                after = self.step.get(node * base + s)
                if after is None:
                    after = self.step[node * base + s] = len(self.label)
                    self.label.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    links.append((after, node, s))
                node = after
            if self.label[node] >= 0:
                raise ValueError(f"tokens {self.label[node]} and {t} have the same spelling")
            self.label[node] = t
        self.shorter = [0] * len(self.label)  # the longest shorter node that a node ends with
        for node, parent, s in sorted(links, key=lambda link: self.depth[link[0]]):
            if parent:
                self.shorter[node] = self._goto(self.shorter[parent], s)
        # what a label can go on from: a node without children is of no use to later symbols
        parents = {parent for _, parent, _ in links}
        self.inner = [0] * len(self.label)
        for node in sorted(range(1, len(self.label)), key=self.depth.__getitem__):
            self.inner[node] = node if node in parents else self.inner[self.shorter[node]]
        self._start()

    def _goto(self, node: int, symbol: int) -> int:
        """The longest node that the text at `node` and the symbol end with."""
        while True:
            after = self.step.get(node * self.base + symbol)
            if after is not None:
                return after
            if not node:
                return 0
            node = self.shorter[node]

    def _start(self) -> None:
        """The state before a word, alone."""
        self.begin = State(self, 0, (-1,))
        self.states: dict[tuple, State] = {(0, -1): self.begin}

    def after(self, state: State, symbol: int) -> State:
        """The state after a symbol, by the labels that end there: one of them follows the last token before it."""
        depth, shorter, label, inner = self.depth, self.shorter, self.label, self.inner
        before, node = {}, state.node
        for token in state.lasts:
            before[depth[node]] = token
            node = inner[shorter[node]]
        node = at = self._goto(state.node, symbol)
        while label[at] < 0 or ((a := before[depth[at] - 1]) >= 0 and not self.follows(a, label[at])):
            at = shorter[at]
        token, lasts = label[at], []
        node = at = inner[node]
        while at:
            lasts.append(before[depth[at] - 1])
            at = inner[shorter[at]]
        lasts.append(token)
        key = (node, *lasts)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, node, key[1:])
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether the state of a has an arc b. Of two equal merges the one further left comes first, hence < and <=."""
        get, first, second, base = self.cut.get, self.first, self.second, self.base
        x, until_x = a, NEVER
        while x >= 0:
            y, until_y = b, NEVER
            while y >= 0:
                r = get(x << 20 | y)
                if r is not None and r < until_x and r <= until_y:
                    return False
                until_y, y = y - base, first[y]
            until_x, x = x - base, second[x]
        return True

    def path(self, word: list[int]) -> list[int]:
        """The tokens of a word of base symbols."""
        if len(self.states) > MOST_STATES:
            self._start()
        state = self.begin
        tokens = [(state := state[symbol]).last for symbol in word]
        width = self.width
        out, at = [], len(word)
        while at:
            token = tokens[at - 1]
            out.append(token)
            at -= width[token]
        out.reverse()
        return out


class _Kept(dict):
    """Word to what `make` gives for it."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self.make(word)
        if len(word) <= 64:
            self[word] = value
        return value


class Tokenizer:
    """A vocabulary file of the tokenizers library: byte-level BPE with word ends, NFC, lower case, a split pattern.

    Files with other parts are refused rather than read wrongly.
    """

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        suffix = model["end_of_word_suffix"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or not suffix or spec["decoder"] or model.get("ignore_merges"):
            raise ValueError("not a word-end byte-level BPE vocabulary")
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = [""] * (1 + max([*self.vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for token, i in self.vocab.items():
            self.tokens[i] = token
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.end_id = self.special.get("<|endoftext|>")
        symbols = byte_symbols()
        self.first = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + suffix] for s in symbols]
        base = 2 * len(symbols)
        merges = [(self.vocab[a], self.vocab[b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if sorted(self.first + self.last) != list(range(base)) or any(self.vocab[self.tokens[a] + self.tokens[b]] != base + r for r, (a, b) in enumerate(merges)):
            raise ValueError("the ids are not in the order of the merges")
        self.automaton = Automaton(base, merges)
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.dtype = np.dtype("<u2" if len(self.tokens) <= 65536 else "<u4")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(len(self.tokens))]
        self.decimal = list(map(str, range(len(self.tokens))))
        #: by word: its ids as bytes; its ids as decimal text, its labels as text and their number
        self.words, self.spelled = _Kept(self._pack), _Kept(self._spell)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        data = word.encode("utf-8", "surrogatepass")
        return self.automaton.path([self.first[b] for b in data[:-1]] + [self.last[data[-1]]])

    def _pack(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.encode_word(word)])

    def _spell(self, word: str) -> tuple[str, str, int]:
        ids = self.encode_word(word)
        return " ".join([self.decimal[i] for i in ids]), " ".join([self.tokens[i] for i in ids]), len(ids)

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens are words as they stand."""
        if self.splitter is not None and "<" in text:
            parts = self.splitter.split(text)
            if len(parts) > 1:
                return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._split(p))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() minds the end of a word, the tokenizer doesn't
                text = text.replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def encode_bytes(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.split(text)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)

    def spell(self, text: str) -> list[tuple[str, str, int]]:
        """For each word: ids as decimal text, labels as text, number of ids."""
        spelled = self.spelled
        return [spelled[w] for w in self.split(text)]

    def decode(self, ids) -> str:
        """The labels of the arcs, joined by one space, as a vocabulary without a decoder has it."""
        return " ".join([self.tokens[i] for i in ids])


_compiled: dict[str, Tokenizer] = {}
KEPT.append(_compiled)


class Shared:
    """A vocabulary for executors: the file's text is broadcast (a few MB), each Python worker compiles it once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.key = hashlib.sha256(text.encode()).hexdigest()
        self.text = spark.sparkContext.broadcast(text)

    def get(self) -> Tokenizer:
        if self.key not in _compiled:
            _compiled[self.key] = Tokenizer(json.loads(self.text.value))
        return _compiled[self.key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, column: str = "input_ids") -> DataFrame:
    """docs with the token ids of `text` as array<int>. Null and empty text have no ids; a column of this name is
    replaced; an empty table gives an empty table."""
    shared = Shared(docs.sparkSession, path or default_path())
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.get()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [t.encode(x.decode("utf-8", "replace")) for x in texts(batch.column("text"))]
                ends = np.cumsum([0, *map(len, ids)])
                values = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "input_ids", column: str = "decoded") -> DataFrame:
    """rows with the decoded text of an id array; null ids decode to the empty text."""
    shared = Shared(rows.sparkSession, path or default_path())
    rows = rows.drop(column)
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.get()
        for batch in batches:
            out = [t.decode(x.as_py() or ()) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode() and then decode() give, digested where they are
    made, so that neither leaves its task. Null text counts as empty."""
    shared = Shared(docs.sparkSession, path or default_path())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.get()
        for batch in batches:
            counts, ids, labels = [], [], []
            for text in texts(batch.column(1)):
                words = t.spell(text.decode("utf-8", "replace"))
                counts.append(sum([w[2] for w in words]))
                ids.append(hashlib.sha256(" ".join([w[0] for w in words]).encode()).hexdigest())
                labels.append(hashlib.sha256(" ".join([w[1] for w in words]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(labels, pa.string())], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
