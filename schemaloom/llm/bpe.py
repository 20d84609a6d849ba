"""Byte-level BPE by a tokenization automaton, and decoding by its arc labels.

The automaton (after Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA", 2024) starts with one
state and an arc for each byte. A merge (a, b) is worked in by one gadget: after an `a` the arc `b` is cut, and every
state that has an `a` leading to a `b` gets an arc `ab` to a copy of where that `b` led. The state that an arc leads to
depends on the arc's label alone, so a state is known by its label. Copies are kept as what they were copied of and
when, cuts as (state, label) with the time of the merge: born, head, tail and cut below are that automaton, written in
one pass over the merges. Whether a state still has an arc is then read off these tables, and what was read is kept.

The paths of the automaton spell each byte string in exactly one way, its BPE encoding, and what a path has spelled so
far is encoded by the path so far. So a pre-split word is read once, byte by byte, by a table of transitions from (state,
byte) to state, whose states are the beginnings of labels; each state names the longest label that ends there, and each
label the next shorter one that ends with it. Of these exactly one continues the path to where it begins, by an arc of
the automaton; it is noted for the place. The labels noted, from the word's end backwards, are the encoding. Nothing is
tried twice. Decoding writes the arcs' labels one after the other.

Defined cases: a very long text is encoded whole, as is a very long word. A null text counts as empty and has no ids. Strings of added tokens in a text get the added token's id.
Bytes that aren't UTF-8 can't occur in Spark's valid strings; decoding replaces what isn't UTF-8, as the library does.
Ids, nulls, repeated rows and further columns do not matter: the work is row by row with no shuffle.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.work import give_back, slices, tidy

#: Fixed value: how byte-level tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps at most; beyond that it begins anew.
KEPT_WORDS = 400_000
#: Answers about arcs that are kept, each in a place of its own; a new one replaces what was there.
KEPT_ARCS = 1 << 19
NEVER = 1 << 40


def byte_symbols() -> dict[str, int]:
    """The printable sign that vocabulary files write for each byte: itself, or else the next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The automaton of the merges in a vocabulary file of the tokenizers library."""

    def __init__(self, file: dict):
        model, sign = file["model"], byte_symbols()
        if model["type"] != "BPE" or file.get("normalizer") or (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        vocab = model["vocab"]
        spelled = {w: bytes(sign[c] for c in w) for w in vocab if all(c in sign for c in w)}
        size = 1 + max([*vocab.values(), *(t["id"] for t in file.get("added_tokens", []))])
        self.labels: list[bytes] = [b""] * size
        for w, label in spelled.items():
            self.labels[vocab[w]] = label
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        for w, i in self.added.items():
            self.labels[i] = w.encode()
        self.born, self.head, self.tail = [0] * size, list(range(size)), list(range(size))
        self.cut: dict[int, int] = {}
        self.known = array("q", [-1]) * KEPT_ARCS  # (state, label) twice, and one more if there is an arc
        alive = {vocab[w] for w, label in spelled.items() if len(label) == 1}
        for time, pair in enumerate(model["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, new = vocab[a], vocab[b], vocab[a + b]
            if x in alive and y in alive and new not in alive and self._arc(x, y, time):
                alive.add(new)
                self.born[new], self.head[new], self.tail[new] = time, x, y
            self.cut.setdefault(x << 20 | y, time)
        self.arcs = {self.labels[i]: i for i in alive}
        self._tabulate()

    def _tabulate(self) -> None:
        """The table of transitions: a row names 16 blocks of 16 states. States that no longer beginning follows share the row of their longest proper ending; rows share the blocks in which they don't differ."""
        starts = sorted({label[:n] for label in self.arcs for n in range(len(label) + 1)}, key=lambda x: (len(x), x))
        number = {x: i for i, x in enumerate(starts)}
        parent, byte, depth = (np.array([f(x) for x in starts]) for f in (lambda x: number[x[:-1]], lambda x: x[-1] if x else 0, len))
        inner = np.zeros(len(starts), bool)
        inner[parent] = True
        row, fail = np.cumsum(inner) - 1, np.zeros(len(starts), np.int64)
        index = np.zeros((int(inner.sum()), 16), np.int32)  # of each row the numbers of its blocks
        blocks, many = np.zeros((len(starts), 16), np.int32), 1  # the first leads to the empty beginning
        to = lambda rows, bytes_: blocks[index[rows, bytes_ >> 4], bytes_ & 15]
        ends = np.array([self.arcs.get(x, -1) for x in starts])  # the longest label that ends at a state
        levels = np.searchsorted(depth, np.arange(depth[-1] + 2))
        for d in range(depth[-1] + 1):
            own = np.arange(levels[d], levels[d + 1])
            if d > 1:  # where the longest proper ending of a state's bytes leads
                fail[own] = to(row[fail[parent[own]]], byte[own])
            if d:
                row[own] = np.where(inner[own], row[own], row[fail[own]])
                some = own[inner[own]]
                index[row[some]] = index[row[fail[some]]]
                ends[own] = np.where(ends[own] < 0, ends[fail[own]], ends[own])
            if d < depth[-1]:
                after = np.arange(levels[d + 1], levels[d + 2])
                changed, which = np.unique(row[parent[after]] * 16 + (byte[after] >> 4), return_inverse=True)
                new = blocks[index.reshape(-1)[changed]]
                new[which, byte[after] & 15] = after
                blocks[many : many + len(new)] = new
                index.reshape(-1)[changed] = np.arange(many, many + len(new))
                many += len(new)
        self.index, self.table = array("i", (index * 16).tobytes()), array("i", blocks[:many].tobytes())
        self.rows, self.ends = (row * 16).tolist(), ends.tolist()
        #: For each label the longest other one that it ends with.
        self.shorter = [-1] * len(self.labels)
        for label, i in self.arcs.items():
            self.shorter[i] = int(ends[fail[number[label]]])
        self.sizes = list(map(len, self.labels))
        self.spelled = bytes(b for b in range(256) if bytes([b]) in self.arcs)

    def _arc(self, state: int, label: int, until: int = NEVER) -> bool:
        """Whether the state had the arc before the merge number `until`."""
        born, cut = self.born, self.cut
        while True:
            if cut.get(state << 20 | label, NEVER) < until:
                return False
            a, b = born[state], born[label]
            if not a and not b:
                return True
            if a > b:  # the state is a copy of its tail's, as it was at that merge
                until, state = a, self.tail[state]
            else:  # the arc was put beside its head's; of two places that overlap the left one merges, so that merge itself counts
                until, label = b + 1, self.head[label]

    def arc(self, state: int, label: int) -> bool:
        key = state << 20 | label
        has = self._arc(state, label)
        self.known[(key ^ key >> 13) & KEPT_ARCS - 1] = key << 1 | has
        return has

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word."""
        if (whole := self.arcs.get(word)) is not None:  # a live label spells its own bytes
            return [whole]
        index, table, rows, ends, shorter, sizes, known, places = self.index, self.table, self.rows, self.ends, self.shorter, self.sizes, self.known, KEPT_ARCS - 1
        if len(self.spelled) < 256 and (odd := word.translate(None, self.spelled)):
            raise ValueError(f"no arc spells byte {odd[0]}")
        state, last, at = 0, [0], 0
        for byte in word:
            at += 1
            state = table[index[rows[state] + (byte >> 4)] + (byte & 15)]
            label = ends[state]
            while (start := at - sizes[label]) > 0:
                key = last[start] << 20 | label
                noted = known[(key ^ key >> 13) & places]
                if noted & 1 if noted >> 1 == key else self.arc(last[start], label):
                    break
                label = shorter[label]
            last.append(label)
        out = []
        while at:
            out.append(last[at])
            at -= sizes[last[at]]
        out.reverse()
        return out


class Codec(dict):
    """Texts to ids and back; as a dict it keeps the ids of words as little-endian unsigned 32-bit integers."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.find = automaton, regex.compile(PATTERN).findall
        added = sorted(automaton.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split if added else None

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode_word(word.encode()), "<u4").tobytes()
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        if self.split is None or not any(t in text for t in self.automaton.added):
            return self._plain(text)
        return b"".join(np.uint32(i).tobytes() if (i := self.automaton.added.get(part)) is not None else self._plain(part) for part in self.split(text))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8, with the replacement character for what isn't."""
        out = b"".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return out.decode(errors="replace").encode()


class Codecs(dict):
    """The codecs that a worker process has made, by the vocabulary file's text; they don't travel with the functions that use them."""

    def __missing__(self, file: str) -> Codec:
        self.clear()
        self[file] = Codec(Automaton(json.loads(file)))
        give_back()  # what earlier stages and the making of the tables have left
        return self[file]

    def __reduce__(self):
        return Codecs, ()


CODECS = Codecs()


def read_file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encoded(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] | None = None, more: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The columns `keep` of docs (None: all that aren't called like the output) with n_tokens long, ids_sha256, decoded_sha256 and, of `more`, ids array<int> and decoded string.

    The vocabulary file is read once, by the driver; its tables go to the executors, a size that the vocabulary bounds.
    """
    file = spark.sparkContext.broadcast(json.dumps(read_file(path)))
    kinds = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())} | {c: {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}[c] for c in more}
    made = tuple(kinds)
    keep = tuple(c for c in docs.columns if c not in made) if keep is None else keep
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = CODECS[file.value]
        for whole in batches:
            for batch in slices(whole, "__text"):
                out: dict[str, list] = {c: [] for c in made}
                for text in batch.column("__text").to_pylist():
                    code = codec.encode(text or "")
                    back = codec.decode(code)
                    out["n_tokens"].append(len(code) // 4)
                    out["ids_sha256"].append(hashlib.sha256(code).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                    if "ids" in out:
                        out["ids"].append(np.frombuffer(code, "<i4"))
                    if "decoded" in out:
                        out["decoded"].append(back.decode())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(x, kinds[c][1]) for c, x in out.items()], names=[*keep, *made])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {k}" for c, (k, _) in kinds.items())])
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(tidy(run), schema)
