"""Operator 1: tokeniser fertility under public vocabularies, with rejection bands per language or script."""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_texts

SYMBOLS = b"#*$%&|<>"
#: Words that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 300_000
#: Words in a repeated window.
WINDOW = 8


@dataclass(frozen=True)
class Band:
    """Bounds, ends included, of what a vocabulary measures on a text; a text outside any of them is rejected. On a text of t tokens each bound lies
    further out by its part of widen / sqrt(t): short texts scatter more, and their entropy is lower."""

    chars_per_token: tuple[float, float]
    fallback_share: tuple[float, float]
    entropy: tuple[float, float]
    widen: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def broken(self, tokens: int, measures: tuple[float, float, float]) -> str | None:
        """The first measure that is out of bounds."""
        for what, x, (low, high), wide in zip(MEASURES, measures, (self.chars_per_token, self.fallback_share, self.entropy), self.widen, strict=True):
            more = wide / math.sqrt(tokens)
            if not low - more <= x <= high + more:
                return what
        return None


MEASURES = ("characters per token", "fallback share", "entropy")
ANY = Band((0.2, 8.0), (0.0, 1.0), (2.0, 16.0))


PIECE_WIDEN, RANK_WIDEN = (4.0, 0.5, 0.0), (4.0, 0.3, 14.0)


def prose(chars: float, fallback: float, entropy: float, widen: tuple[float, float, float]) -> Band:
    """A band close to ordinary prose: least characters per token, highest fallback share and least entropy of a very long text."""
    return Band((chars, 8.0), (0.0, fallback), (entropy, 16.0), widen)


#: Bands by language code, or by script where the language is unknown, for the piece vocabulary and for the ranks; "" holds for all others. The
#: lower bound of characters per token finds symbols and noise that no merge covers, the upper one a few long tokens over and over. The lower bound
#: of entropy finds texts that use few tokens too often, such as signs between words or words said over and over; the entropy of prose grows with
#: the text as a - b / sqrt(tokens), which is the form of the bound. Set below all prose labelled as good in one table, tried on another one. The entropy of pieces has a wide floor:
#: numbered names, which the tests hold to be good, have 3.34 bits, less than most junk; entropy is left to the ranks.
BANDS = {
    "en": (prose(1.80, 0.01, 3.30, PIECE_WIDEN), prose(2.12, 0.01, 6.76, RANK_WIDEN)),
    "de": (prose(1.95, 0.01, 3.30, PIECE_WIDEN), prose(2.10, 0.03, 6.77, RANK_WIDEN)),
    "fr": (prose(1.88, 0.01, 3.30, PIECE_WIDEN), prose(2.00, 0.03, 6.72, RANK_WIDEN)),
    "es": (prose(1.88, 0.01, 3.30, PIECE_WIDEN), prose(2.02, 0.03, 6.63, RANK_WIDEN)),
    "latin": (prose(1.70, 0.05, 3.30, PIECE_WIDEN), prose(1.90, 0.10, 6.40, RANK_WIDEN)),
    "greek": (Band((0.6, 8.0), (0.0, 0.60), (3.0, 16.0)),) * 2,
    "cyrillic": (Band((0.8, 8.0), (0.0, 0.60), (3.0, 16.0)),) * 2,
    "": (ANY, ANY),
}

#: Scripts told apart by the first byte of a letter in UTF-8: name, first and last lead byte.
SCRIPTS = (("latin", 0x41, 0x7A), ("latin", 0xC3, 0xCA), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4), ("semitic", 0xD6, 0xDD), ("indic", 0xE0, 0xE1), ("cjk", 0xE3, 0xED))
SCRIPT_NAMES = ("other", *dict.fromkeys(s for s, *_ in SCRIPTS))
LEADS = np.zeros(256, dtype=np.int64)
for _name, _low, _high in SCRIPTS:
    LEADS[_low : _high + 1] = SCRIPT_NAMES.index(_name)


class Pieces:
    """A SentencePiece vocabulary; a byte piece is a fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_fallback = np.array([self.model.IsByte(i) or self.model.IsUnknown(i) for i in range(self.model.GetPieceSize())])

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return self.model.encode([w.decode() for w in words], num_threads=1)


class Ranks:
    """A byte-level vocabulary of ranks; a token that isn't whole characters is a fallback."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_fallback = np.zeros(1 + max(ranks.values()), dtype=bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_fallback[i] = True

    def encode(self, words: list[bytes]) -> list[list[int]]:
        encode = self.model.encode_ordinary
        return [encode(" " + w.decode()) for w in words]


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Memory:
    """What is known of each word: hash, code points, and its tokens under each vocabulary."""

    def __init__(self, paths: tuple[str, ...]):
        self.models = [(Pieces if p.endswith(".model") else Ranks)(p) for p in paths]
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.hash, self.chars = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.tokens = [(np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)) for _ in self.models]

    def number(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The words' numbers; all of them are known afterwards."""
        if len(self.numbers) > REMEMBERED:
            self.clear()
        known = len(self.numbers)
        out = [np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)) for words in texts]
        if len(self.numbers) > known:
            new = list(self.numbers)[known:]
            self.hash = np.append(self.hash, np.array([xxhash.xxh3_64_intdigest(w) for w in new], dtype=np.uint64))
            self.chars = np.append(self.chars, [len(w.decode()) for w in new])
            for k, model in enumerate(self.models):
                ids, ends, fallback = self.tokens[k]
                got = model.encode(new)
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.fromiter((i for g in got for i in g), np.int64, int(sizes.sum()))
                falls = np.add.reduceat(np.append(model.is_fallback[flat], 0).astype(np.int64), np.cumsum(sizes) - sizes) * (sizes > 0)
                self.tokens[k] = (np.append(ids, flat), np.append(ends, ends[-1] + np.cumsum(sizes)), np.append(fallback, falls))
        return out

    def measure(self, k: int, numbers: np.ndarray, times: np.ndarray) -> tuple[int, int, float]:
        """Under vocabulary k: tokens, fallback tokens, and entropy in bits of a text's tokens."""
        ids, ends, fallback = self.tokens[k]
        low, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        n = int((sizes * times).sum())
        if not n:
            return 0, 0, 0.0
        at = np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
        counts = np.bincount(ids[at], weights=np.repeat(times, sizes))
        counts = counts[counts > 0]
        return n, int((fallback[numbers] * times).sum()), float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


def repeated(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more, the first ones included."""
    m = len(hashes) - window + 1
    if m < 2:
        return 0
    rolled = np.zeros(m, dtype=np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + m]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, rolled)
    starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == rolled)
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def script_of(text: bytes) -> str:
    """The script of most letters."""
    counts = np.bincount(LEADS[np.frombuffer(text, dtype=np.uint8)], minlength=len(SCRIPT_NAMES))[1:]
    return SCRIPT_NAMES[1 + int(counts.argmax())] if counts.any() else "other"


def quality(docs: DataFrame, vocabularies: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, tuple[Band, ...]] | None = None, min_words: int = 20, max_repeat_percent: int = 30, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script, and for the k-th
    vocabulary chars_per_token_k, fallback_share_k and entropy_k; rejected_by names the first bound that a text breaks.

    Words are what stands between ASCII white space; each is encoded by itself, and characters are those of words. Null and empty texts have no
    words: they fail the base rule, and their measures are null. Bands hold for every text with tokens. Language null or unknown: the script's bands hold. Rows that repeat are judged
    each. The columns named in carry come along as they are, in a struct named carried. A map over rows: nothing is shuffled, and other columns are not read. SentencePiece vocabularies end in .model, files of ranks don't.
    """
    bands = bands or BANDS
    key = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    own = ", ".join(f"chars_per_token_{k} double, fallback_share_{k} double, entropy_{k} double" for k in range(len(vocabularies)))
    schema = f"n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, rejected_by string, {own}"

    def make():
        memory = held(("fertility", vocabularies), lambda: Memory(vocabularies))

        def f(heads, texts):
            texts = [t or b"" for t in texts]
            columns = [[] for _ in range(9 + 3 * len(vocabularies))]
            for text, numbers, lang in zip(texts, memory.number([t.split() for t in texts]), heads[1].to_pylist(), strict=True):
                n, again = len(numbers), repeated(memory.hash[numbers])
                unique, times = np.unique(numbers, return_counts=True)
                chars = int((memory.chars[unique] * times).sum())
                failed = n < min_words or 100 * again > max_repeat_percent * n
                script = script_of(text)
                own = bands.get(lang) or bands.get(script) or bands[""]
                why, measures = "too few words" if n < min_words else "repeated windows" if failed else None, []
                for k in range(len(vocabularies)):
                    band = own[min(k, len(own) - 1)]
                    tokens, falls, bits = memory.measure(k, unique, times)
                    got = (chars / tokens, falls / tokens, bits) if tokens else (None, None, None)
                    if tokens:
                        what = band.broken(tokens, got)
                        why = why or what and f"{what} of vocabulary {k}"
                    measures += got
                row = [n, chars, len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), again, failed, why is None, script, why, *measures]
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            return columns, None

        return f

    along = [F.struct(*carry)] if carry else []
    return map_texts(docs, [F.col(id_col), key, *along], text_col, make, schema).drop("_k1").withColumnsRenamed({"_k0": id_col, "_k2": "carried"})
