"""Operator 9: byte-level BPE with a segment tree over adjacent pair ranks, many words at a time."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_texts

# The white space of the splitting pattern, and the pattern itself.
SPACE = "\t-\r \x85\xa0  -     　"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Chunks that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 600_000
#: Words of a size, below which each gets a tree of its own.
FEW = 8
#: Symbols in a batch of words merged together.
BATCH_SYMBOLS = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    letters, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(more))
            more += 1
    return letters


class ByteBPE:
    """A byte-level BPE vocabulary: encodes words in numpy batches and remembers them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.of_byte = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        width = self.width = 1 + max(vocab.values())
        keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int64), made
        self.rank_of_key, self.made_of_rank = dict(zip(keys.tolist(), range(len(keys)), strict=True)), made.tolist()
        self.none = len(made)
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.words = regex.compile(SPLIT)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.text_of = {i: str(i) for i in self.bytes_of}
        # strings and bytes alone, which Python's garbage collector doesn't visit
        self.ids: dict[str, str] = {t: str(i) for t, i in self.special.items()}
        self.back: dict[str, bytes] = {t: self.bytes_of[i] for t, i in self.special.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, none where it doesn't merge or a side is missing (negative)."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.rank_of[at], self.none)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. All words go through one loop; a word leaves the batch when its root has no pair left."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for bits, those in by_size.items():
            step = max(1, BATCH_SYMBOLS >> bits)
            for k in range(0, len(those), step):
                part = those[k : k + step]
                if len(part) < FEW:
                    for i in part:
                        out[i] = self._merge_one(words[i])
                    continue
                ids, ends = self._merge([words[i] for i in part], bits)
                low = 0
                for i, end in zip(part, ends, strict=True):
                    out[i] = ids[low:end]
                    low = end
        return out

    def _merge_one(self, word: bytes) -> list[int]:
        """The ids of a word by a tree of its own in plain lists, which for few words takes less time than steps over arrays: a merge changes three
        leaves, and the way up ends where nothing changes."""
        n = len(word)
        size = 1 << max(1, (n - 1).bit_length())
        start = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        end = self.none * size
        leaves = np.arange(size) + end
        leaves[: n - 1] = self.ranks(start[:-1], start[1:]) * size + np.arange(n - 1)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).min(1))
        tree = [0, *np.concatenate(levels[::-1]).tolist()]
        symbols, after, before = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, made, width, mask = self.rank_of_key, self.made_of_rank, self.width, size - 1

        def put(leaf: int, rank: int) -> None:
            node = leaf + size
            tree[node] = rank * size + leaf
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while (root := tree[1]) < end:
            place = root & mask
            gone, leading = after[place], before[place]
            following = after[gone]
            own = symbols[place] = made[root // size]
            symbols[gone] = -1
            after[place] = following
            put(gone, self.none)
            if following < n:
                before[following] = place
                put(place, rank_of.get(own * width + symbols[following], self.none))
            else:
                put(place, self.none)
            if leading >= 0:
                put(leading, rank_of.get(symbols[leading] * width + own, self.none))
        return [x for x in symbols if x >= 0]

    def _merge(self, words: list[bytes], bits: int) -> tuple[list[int], list[int]]:
        n, m = 1 << bits, len(words)
        symbols = np.full((m, n + 1), -1, dtype=np.int64)  # the last column stands for what lies beyond the word
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols[:, :n][np.arange(n) < sizes[:, None]] = self.of_byte[raw]
        after = np.minimum(np.arange(1, n + 2), n) + np.zeros((m, 1), dtype=np.int64)
        before = np.arange(-1, n) + np.zeros((m, 1), dtype=np.int64)
        before[:, 0] = n
        # leaves: rank and place in one number, so that the least is the leftmost pair of the lowest rank
        tree = np.empty((m, 2 * n), dtype=np.int64)
        tree[:, n:] = self.ranks(symbols[:, :n], symbols[:, 1:]) * n + np.arange(n)
        for level in range(bits - 1, -1, -1):
            at = np.arange(1 << level, 2 << level)
            tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])
        end = self.none * n
        live = np.flatnonzero(tree[:, 1] < end)
        while len(live):
            root = tree[live, 1]
            place = root & (n - 1)
            gone = after[live, place]
            following, leading = after[live, gone], before[live, place]
            symbols[live, place] = self.made[root >> bits]
            symbols[live, gone] = -1
            after[live, place] = following
            before[live, following] = place
            for leaf, rank in (
                (gone, self.none),
                (place, self.ranks(symbols[live, place], symbols[live, following])),
                (leading, self.ranks(symbols[live, leading], symbols[live, place])),
            ):
                here = np.flatnonzero(leaf < n)
                rows, node = live[here], leaf[here] + n
                tree[rows, node] = (rank if np.isscalar(rank) else rank[here]) * n + leaf[here]
                for _ in range(bits):
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < end]
        there = symbols[:, :n] >= 0
        return symbols[:, :n][there].tolist(), np.cumsum(there.sum(1)).tolist()

    def learn(self, chunks: set[str]) -> None:
        """Put what isn't remembered yet into the memory: the ids as decimal text, and the bytes that they decode to."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.back.clear()
            for t, i in self.special.items():
                self.ids[t], self.back[t] = str(i), self.bytes_of[i]
        new = chunks.difference(self.ids)
        split, words = {}, set()
        for c in new:
            # letters alone, or behind one space, are one word of the pattern; a stop after them is another
            core = c[1:] if c[0] == " " else c
            if core.isalpha():
                words.add(c)
            else:
                split[c] = s = [c[:-1], c[-1]] if core and core[-1] in ".,;:!?" and core[:-1].isalpha() else self.words.findall(c)
                words.update(s)
        fresh = list(words.difference(self.ids))
        text, raw = self.text_of, self.bytes_of
        more, back = {}, {}
        for w, got in zip(fresh, self.merge([w.encode() for w in fresh]), strict=True):
            self.ids[w] = ",".join([text[i] for i in got])
            self.back[w] = b"".join([raw[i] for i in got])
        for c, s in split.items():
            more[c], back[c] = ",".join([self.ids[w] for w in s]), b"".join([self.back[w] for w in s])
        self.ids |= more
        self.back |= back

    def pieces(self, text: str) -> list[str]:
        """The text's chunks, which no merge crosses, and special tokens."""
        if not self.specials or not self.specials.search(text):
            return self.chunks.findall(text)
        out: list[str] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.chunks.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.chunks.findall(text[at:])

    def code(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, the ids in decimal joined by commas, and the text decoded from them."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        out = []
        for s in split:
            ids = ",".join(map(self.ids.__getitem__, s))
            out.append((ids.count(",") + 1 if ids else 0, ids, b"".join(map(self.back.__getitem__, s)).decode("utf-8", "replace")))
        return out


def loaded(path: str) -> ByteBPE:
    """This worker's vocabulary with its memory; it outlives the task."""
    return held(("byte bpe", path), lambda: ByteBPE(path))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and with texts also ids (array of int) and decoded.

    Null and empty texts have no ids. The strings of special tokens in a text are single ids. A map over rows: nothing is shuffled, one block of
    texts and a bounded memory of words are held at a time, and other columns are not read.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts

    def make():
        bpe = loaded(vocabulary)

        def f(_, block):
            got = bpe.code([(t or b"").decode("utf-8", "replace") for t in block])
            columns = [[g[0] for g in got], [hashlib.sha256(g[1].encode()).hexdigest() for g in got], [hashlib.sha256(g[2].encode()).hexdigest() for g in got]]
            if texts:
                columns += [[list(map(int, g[1].split(","))) if g[1] else [] for g in got], [g[2] for g in got]]
            return columns, None

        return f

    return map_texts(docs, [F.col(id_col)], text_col, make, schema).withColumnRenamed("_k0", id_col)
