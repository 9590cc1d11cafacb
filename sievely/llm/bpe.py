"""Byte-level BPE by a tokenization automaton.

compile_automaton() builds, merge by merge, the deterministic automaton that accepts exactly the token sequences that BPE
yields. It starts as one state with an arc per byte. The gadget of a merge (u, v) -> w makes one new state: the copy,
without its v-arc, of the state that u-arcs lead to. It leads all u-arcs to the copy, and gives w-arcs, which lead where v
led, to all states that have a u-arc. So all arcs of one label lead to one state, and a state that lacks v lacks all labels
made from then on whose leftmost parts go back to v. Labels are numbered along the tree of leftmost parts, latest children
first; there these are one interval. A state is compiled to the sorted intervals of the numbers that it has no arc of:
`state` (of a label), `first`, `low` and `high` are the whole transition table, some hundred thousand numbers in place of
states times labels.

A pre-split word is encoded by table-driven transitions: one table leads from a state of the labels' trie and a byte to
the longest label that ends there; the state behind the label before it tells by its intervals whether it has that arc, and
if not, the next shorter label is tried. Each prefix of a word has exactly one accepted path, so its last arc is the
longest label that the path before it can go on with. That is linear in the bytes.
Decoding emits the arcs' labels.

Cases: null and empty texts give no tokens and decode to ''. The strings of special tokens inside texts are
those tokens. Equal rows give equal rows, an empty table none; columns other than the id and the text are not read. A vocabulary file that
asks for anything else than this (a normalizer, another pre-tokenizer, byte fallback, dropout, tokens that take white
space along, merges of labels not made yet) is refused with a ValueError.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, small_batches

#: The pre-split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct runs and words whose encoding a worker keeps; beyond it the oldest quarter goes.
KEPT_WORDS = 250_000
#: Those longer than this are encoded anew each time, so that the kept words stay small.
KEPT_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow 255."""
    out, extra = {}, 256
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out[chr(b if printable else extra)] = b
        extra += not printable
    return out


class Automaton:
    """The automaton of merges (u, v, w), by label number; `labels` are the arcs' byte strings."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        size = self.size = max(labels) + 1
        self.labels = labels
        roots = [x for x, label in labels.items() if len(label) == 1]
        self._number(roots, merges)
        # The intervals that the state of a label lacks; labels whose arcs lead to one state share the lists.
        start: tuple[list[int], list[int]] = ([], [])
        led: list[tuple[list[int], list[int]] | None] = [None] * size
        for x in roots:
            led[x] = start
        youngest = [-1] * size  # the child by leftmost parts that was made last
        for u, v, w in merges:
            if led[u] is not None and led[v] is not None and not self._within(led[u], self.place[v]):
                low, high = led[u]
                # What has v as leftmost part and is made from now on is numbered before its youngest child so far.
                a, b = self.place[v], self.place[youngest[v]] if youngest[v] >= 0 else self.place[v] + self.below[v]
                i, j = bisect_left(low, a), bisect_left(low, b)
                copy = low[:i] + [a] + low[j:], high[:i] + [b] + high[j:]
                led[w] = led[v]
                led[u] = copy
            youngest[u] = w  # a merge whose path no state has any more never happens; its label stays without a state
        del self.below
        self._states(led)
        self._compile({labels[x]: x for x in range(size) if led[x] is not None})

    def _number(self, roots: list[int], merges: list[tuple[int, int, int]]) -> None:
        """place: numbers along the tree of leftmost parts, a label before its children and the latest child first; below: how many are in its subtree."""
        named = set(roots)
        for k, (u, v, w) in enumerate(merges):
            if not (u in named and v in named) or w in named:
                raise ValueError(f"merge {k} takes labels that are not made yet, or makes one again")
            named.add(w)
        self.place, self.below = [0] * self.size, [1] * self.size
        for u, _, w in reversed(merges):
            self.below[u] += self.below[w]
        free, at = {}, 0
        for x in roots:
            self.place[x], at = at, at + self.below[x]
        # A label's parent is made before it, and its younger siblings before it are counted from the end of the parent's numbers.
        for u, _, w in merges:
            end = free.get(u, self.place[u] + self.below[u])
            self.place[w] = free[u] = end - self.below[w]

    @staticmethod
    def _within(lacks: tuple[list[int], list[int]], place: int) -> bool:
        i = bisect_right(lacks[0], place) - 1
        return i >= 0 and place < lacks[1][i]

    def _states(self, led: list[tuple[list[int], list[int]] | None]) -> None:
        """state[label] and its intervals low[k]..high[k], k from first[state] to first[state + 1]."""
        numbers: dict[int, int] = {}
        self.state, self.first, self.low, self.high = array("i", [-1]) * self.size, array("i", [0]), array("i"), array("i")
        for x, lacks in enumerate(led):
            if lacks is None:
                continue
            if id(lacks) not in numbers:
                numbers[id(lacks)] = len(numbers)
                self.low.extend(lacks[0])
                self.high.extend(lacks[1])
                self.first.append(len(self.low))
            self.state[x] = numbers[id(lacks)]

    def _compile(self, ids: dict[bytes, int]) -> None:
        """Tables over the trie of the labels: goto[state, byte], the longest label that ends in a state, and a label's next shorter one."""
        children: list[dict[int, int]] = [{}]
        depth, own = [0], [-1]
        for label, x in ids.items():
            at = 0
            for byte in label:
                if (to := children[at].get(byte)) is None:
                    to = children[at][byte] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    own.append(-1)
                at = to
            own[at] = x
        # The largest table; a worker holds it for good.
        goto = np.zeros((len(children), 256), np.uint16 if len(children) <= 1 << 16 else np.int32)
        back, longest = [0] * len(children), [-1] * len(children)
        shorter = [-1] * self.size
        for at in sorted(range(len(children)), key=depth.__getitem__):
            longest[at] = own[at] if own[at] >= 0 else longest[back[at]]
            if own[at] >= 0:
                shorter[own[at]] = longest[back[at]]
            if at:
                goto[at] = goto[back[at]]
            for byte, to in children[at].items():
                back[to] = int(goto[at, byte])
                goto[at, byte] = to
        self.goto, self.longest, self.shorter = memoryview(goto.ravel()), longest, shorter
        self.length = [len(self.labels.get(x, b"")) for x in range(self.size)]

    def has_arc(self, before: int, label: int) -> bool:
        """Whether the state behind the label `before` has an arc of the other label."""
        state, place = self.state[before], self.place[label]
        i = bisect_right(self.low, place, self.first[state], self.first[state + 1]) - 1
        return i < self.first[state] or place >= self.high[i]

    def encode(self, word: bytes) -> list[int]:
        """The arcs of the one accepted path over the word's bytes."""
        goto, longest, shorter, length = self.goto, self.longest, self.shorter, self.length
        state, place, first, low, high = self.state, self.place, self.first, self.low, self.high
        last: list[int] = []
        at = 0
        for end, byte in enumerate(word):
            at = goto[at << 8 | byte]
            label = longest[at]
            while (start := end - length[label]) >= 0:
                s, number = state[last[start]], place[label]
                i = bisect_right(low, number, first[s], first[s + 1]) - 1
                if i < first[s] or number >= high[i]:
                    break
                label = shorter[label]
            last.append(label)
        out, end = [], len(word) - 1
        while end >= 0:
            out.append(last[end])
            end -= length[last[end]]
        return out[::-1]


def _refuse_others(spec: dict) -> None:
    """ValueError for settings that would give other ids than this module's."""
    model, pre, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["model"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * (spec.get("normalizer") is not None)
    wrong += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or bool(pre.get("add_prefix_space", True)) or not pre.get("use_regex", True))
    wrong += ["decoder"] * (decoder.get("type") != "ByteLevel")
    wrong += ["added_tokens"] * any(x.get(k) for x in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip"))
    if wrong:
        raise ValueError(f"the vocabulary file asks for what is not built here: {', '.join(wrong)}")


def compile_automaton(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a vocabulary file of the tokenizers library, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _refuse_others(spec)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    specials = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
    if missing := 256 - len({x for x in labels.values() if len(x) == 1}):
        raise ValueError(f"the vocabulary lacks {missing} bytes")
    merges = []
    for merge in spec["model"]["merges"]:
        u, v = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    return Automaton(labels, merges), specials


def _keep(kept: dict[str, bytes], word: str, ids: bytes) -> None:
    if len(word) <= KEPT_LENGTH:
        if len(kept) >= KEPT_WORDS:
            for old in list(kept)[: KEPT_WORDS // 4]:
                del kept[old]
        kept[word] = ids


class Coder:
    """Encodes and decodes whole texts with one automaton; a worker keeps one for each vocabulary file."""

    _made: dict[str, Coder] = {}

    def __init__(self, path: str):
        self.automaton, self.specials = compile_automaton(path)
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        most = max([*self.automaton.labels, *self.specials.values()]) + 1
        by_id: list[bytes] = [b""] * most
        for i, label in self.automaton.labels.items():
            by_id[i] = label
        for text, i in self.specials.items():
            by_id[i] = text.encode()
        self.by_id = by_id
        #: Ids of words that begin without a space, and of a space with the run of other characters behind it.
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _word(self, word: str) -> bytes:
        kept, key = (self.runs, word[1:]) if word[0] == " " else (self.known, word)
        found = kept.get(key)
        if found is None:
            found = array("i", self.automaton.encode(word.encode())).tobytes()
            _keep(kept, key, found)
        return found

    def _plain(self, text: str) -> bytes:
        return b"".join([self._word(w) for w in self.words.findall(text)])

    def _run(self, run: str) -> bytes:
        """The ids of a space and a run without white space, for which none are kept."""
        if run.isalpha() and max(run) < "\u0250":
            return self._word(" " + run)
        found = self._plain(" " + run)
        _keep(self.runs, run, found)
        return found

    def _between_specials(self, text: str) -> list[bytes]:
        """No word of the pre-split goes on over white space behind another character, so texts are cut there and runs are kept whole."""
        runs, out, held = self.runs, [], []
        for k, run in enumerate(text.split(" ")):
            if k and not held and (found := runs.get(run)) is not None:
                out.append(found)
                continue
            if not k and run:
                held.append(run)
            elif k:
                held += (" ", run)
            if not run or run[-1].isspace():
                continue  # white space belongs to what follows
            bare = k and len(held) == 2 and len(run.split()) == 1
            out.append(self._run(run) if bare else self._plain("".join(held)))
            held = []
        return [*out, self._plain("".join(held))]

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for k, piece in enumerate(self.split.split(text) if self.split and any(s in text for s in self.specials) else [text]):
            if k % 2:
                parts.append(array("i", [self.specials[piece]]).tobytes())
            else:
                parts += self._between_specials(piece)
        return np.frombuffer(b"".join(parts), np.intc)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.by_id.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _path(name_or_path: str) -> str:
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _coded(vocabulary: str, also_decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(_path(vocabulary))
        for batch in slices(batches, "text", 4_000_000):
            ids = [coder.encode(x or "") for x in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))}
            if also_decode:
                columns["decoded"] = pa.array([coder.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids array<int> of every whole text. vocabulary: a file, or a name that public_tokenizers knows."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_coded(vocabulary, False), "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """encode(), with the text that decoding the ids gives, as `decoded`."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_coded(vocabulary, True), "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, decoded of rows of doc_id, ids; null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(_path(vocabulary))
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(texts, pa.string())})

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
