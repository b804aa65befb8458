"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that byte-pair merging yields. It starts with one state
that loops on every base symbol; each merge (u, v), in order, adds a gadget to it: the state that u leads
to is split, its copy loses the arc v, u leads to the copy from now on, and an arc u+v runs from every
state with an arc u to where v led. All arcs of one label lead to one state, so the state after a label
stands for it, and the automaton is kept as the arcs that gadgets took away with their times; an arc is
looked up through the label's left halves and the state's right halves, and then kept in a transition table.

A pre-split word is read by following arcs whose labels spell the next symbols, the longest first; a place from which
no arc leads on is left for good, and the one path to the word's end holds its ids. Decoding emits the labels' texts.

The file is a tokenizers JSON of a BPE model with byte-level symbols and a word-end suffix (here lower case,
white space dropped): special tokens are cut out first; then NFC, white space to one space, lower case of
each code point, the file's split pattern, bytes to symbols. The vocabulary file is read on the executors
from ``path`` or, where it is missing there, comes with the function.

Memory: the automaton is fixed by the file; words' ids are kept for at most CACHE_WORDS words and as many chunks
a worker, and go when the worker begins a task of another operator.
A word's cost is in proportion to its length, whatever its length: a label is sought no further than the longest one.

Defined results: null and empty texts have no ids and decode to an empty text; ids outside the vocabulary
are dropped in decoding; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanframe.llm._text import held, lists, map_texts

#: What the library's split pattern and lower case know of Unicode, where Python's differ.
NOT_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NOT_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}, ord("Σ"): ord("σ"),
}
CACHE_WORDS = 400_000
CACHE_ARCS = 150_000
LONGEST_CACHED = 40


def byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Automaton:
    """The automaton after all merges; its states and labels are token ids, state 0 .. being "after label".

    ``lost`` holds the arc v that each gadget took from the state after u, with the gadget's time. The state
    after u+v is the one that was after v when the gadget was added, so its own losses are those of u+v, and
    those of v up to that time.
    """

    START = -1

    def __init__(self, symbols: Iterable[int], merges: list[tuple[int, int, int]]):
        """symbols: ids of the base symbols; merges: ids (u, v, u+v) in order."""
        self.born: dict[int, int] = dict.fromkeys(symbols, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.lost: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}
        for time, (u, v, uv) in enumerate(merges):
            if uv not in self.born and u in self.born and v in self.born and self._arc(u, v, time):
                self.lost[u, v] = time
                self.halves[uv] = u, v
                self.born[uv] = time

    def _lost_at(self, state: int, label: int) -> int | None:
        """When the state lost its arc with the label."""
        before = None
        while True:
            at = self.lost.get((state, label))
            if at is not None and (before is None or at < before):
                return at
            if state not in self.halves:
                return None
            born = self.born[state]
            before = born if before is None else min(before, born)
            state = self.halves[state][1]

    def _arc(self, state: int, label: int, time: int) -> bool:
        """Whether state has an arc with the label just before the gadget of that time.

        An arc u+v is there if u was when its gadget was added, after that gadget's own loss.
        """
        while True:
            at = self._lost_at(state, label)
            if at is not None and at < time:
                return False
            if label not in self.halves:
                return True
            time, label = self.born[label] + 1, self.halves[label][0]

    def allows(self, state: int, label: int) -> bool:
        key = state << 32 | label
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= CACHE_ARCS:
                self.table.clear()
            found = self.table[key] = self._arc(state, label, 1 << 62)
        return found


class _Generations(dict):
    """What make returns for a key; of the keys last asked for, between half of most and all are kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > LONGEST_CACHED:
                return found
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class WordBpe:
    """Encoder and decoder for the model in a tokenizers JSON text."""

    def __init__(self, text: str):
        said = json.loads(text)
        model = said["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"] if t["special"]}
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        (pattern,) = (p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.ascii_words = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII)
        # The same for texts with characters that the library and Python take differently.
        sets = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NOT_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NOT_NUMBERS}]]")
        self.rare_words = regex.compile(sets, regex.V1)
        self.rare = regex.compile(f"[{NOT_LETTERS}{NOT_NUMBERS}{''.join(map(chr, LOWER))}]")
        self.symbols = byte_symbols()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        base = {s + e: vocab[s + e] for s in self.symbols for e in ("", self.suffix) if s + e in vocab}
        self.automaton = Automaton(base.values(), [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        # Labels by their spelling: a trie of those inside a word (a node's own label under 0), and those at its end.
        known = {t: i for t, i in vocab.items() if i in self.automaton.born}
        # The trie is one flat table: (node, code of the next symbol) to node; label is a node's own label, or -1.
        code = {s: k for k, s in enumerate(self.symbols)}
        self.step: dict[int, int] = {}
        label = [-1]
        self.final, self.longest, self.deepest = {}, 0, 0
        for t, i in known.items():
            if self.suffix and t.endswith(self.suffix):
                spelt = t.removesuffix(self.suffix)
                self.final[spelt] = i
                self.longest = max(self.longest, len(spelt))
                continue
            node, self.deepest = 0, max(self.deepest, len(t))
            for c in t:
                key = node << 8 | code[c]
                node = self.step.setdefault(key, len(label))
                if node == len(label):
                    label.append(-1)
            label[node] = i
            if not self.suffix:
                self.final[t] = i
                self.longest = max(self.longest, len(t))
        self.label = label
        self.shown = {i: str(i) for i in known.values()}
        self.found = _Generations(self._known, CACHE_WORDS)
        self.chunks = _Generations(self._of_chunk, CACHE_WORDS)

    def _word(self, word: str) -> list[int]:
        codes = word.encode("utf-8", "surrogatepass")
        spelt = "".join([self.symbols[b] for b in codes])
        n, automaton, step, labels, final, longest = len(spelt), self.automaton, self.step.get, self.label, self.final, self.longest
        known, allows = automaton.table.get, automaton.allows
        # One label at most leads to a place along valid arcs, so a place that leads nowhere is left for good.
        path: list[tuple[int, int]] = []
        dead: set[int] = set()
        at, most, state = 0, n, Automaton.START
        while True:
            if most == n:
                label = final.get(spelt[at:]) if n - at <= longest else None
                if label is not None and (state < 0 or known(state << 32 | label) or allows(state, label)):
                    return [x for _, x in path] + [label]
                most -= 1
            ends, node, to = [], 0, at
            for c in codes[at : min(most, at + self.deepest)]:
                node = step(node << 8 | c)
                if node is None:
                    break
                to += 1
                if labels[node] >= 0:
                    ends.append((to, labels[node]))
            for to, label in reversed(ends):
                if to not in dead and (state < 0 or known(state << 32 | label) or allows(state, label)):
                    path.append((at, label))
                    at, most, state = to, n, label
                    break
            else:
                dead.add(at)
                most = at - 1
                at = path.pop()[0]
                state = path[-1][1] if path else Automaton.START

    def _known(self, word: str) -> tuple[str, str]:
        """A word's ids and its labels' texts, each joined by a space."""
        ids = self._word(word)
        return " ".join([self.shown[i] for i in ids]), " ".join([self.text[i] for i in ids])

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if self.rare.search(text):
            # str.lower() would also put a final sigma at a word's end.
            return self.rare_words.findall(text.translate(LOWER).lower())
        return self.words.findall(text.lower())

    def _of_chunk(self, chunk: str) -> tuple[str, str]:
        """The same for all words of a text, normally one without white space."""
        if chunk.isalpha() and chunk.isascii():
            return self.found[chunk.lower()]
        known = [self.found[w] for w in self._split(chunk)]
        return known[0] if len(known) == 1 else (" ".join([k[0] for k in known]), " ".join([k[1] for k in known]))

    def _parts(self, text: str) -> list[tuple[str, str]]:
        """What is known of each chunk and special token of a text. No word spans white space."""
        out, at = [], 0
        for m in self.cut.finditer(text) if any(t in text for t in self.special) else ():
            out += self._chunks(text[at : m.start()])
            out.append((str(self.special[m[0]]), m[0]))
            at = m.end()
        return out + self._chunks(text[at:] if at else text)

    def _chunks(self, text: str) -> list[tuple[str, str]]:
        # Characters that Python takes for white space and the library does not.
        chunks = [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return [k for k in map(self.chunks.__getitem__, chunks) if k[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self._parts(text or "") for i in ids.split(" ")]

    def decode(self, ids) -> str:
        return " ".join(self.text[i] for i in ids if i in self.text)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the decoded text."""
        parts = self._parts(text or "")
        ids, labels = (" ".join([p[i] for p in parts]) for i in (0, 1))
        n = ids.count(" ") + 1 if parts else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(labels.encode()).hexdigest()


@lru_cache(2)
def _loaded(text: str) -> WordBpe:
    held[__name__] = _loaded.cache_clear
    return WordBpe(text)


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) for each row of docs."""
    said = docs.sparkSession.sparkContext.broadcast(load(path))  # of the vocabulary file's size

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = _loaded(said.value)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([model.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), "text", f"doc_id {kind}, ids array<int>", run)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded, the text that the ids stand for, for each row of docs, in one pass."""
    said = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model, packed, decoded = _loaded(said.value), [], []
        for t in part.column(1).to_pylist():
            ids = model.encode(t)
            packed.append(np.array(ids, np.int32))
            decoded.append(model.decode(ids))
        ids = lists(np.concatenate(packed), np.array([len(x) for x in packed]), pa.int32())
        return pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), "text", f"doc_id {kind}, ids array<int>, decoded string", run)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids give an empty text."""
    said = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        model = _loaded(said.value)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.decode(i or ()) for i in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs, in one pass."""
    said = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = _loaded(said.value)
        n, ids, labels = zip(*map(model.digests, part.column(1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(labels)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), "text", f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
