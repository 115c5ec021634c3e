"""Operator 2: best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import held, map_texts, written

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 1_100_000
#: Signs that no rule joins with letters before them; those in a row are one word of the rules.
STOPS = b".,;:!?#*$%&|()"
#: Rows that one task ranks at most, on average; more rows of a length are dealt over more buckets.
RANKED = 50_000


def letters(word: bytes) -> bool:
    """Whether a word is letters alone, also once its case is lowered, which may add marks."""
    text = word.decode()
    return text.isalpha() and text.lower().isalpha()


class WordIds:
    """Ids of white-space-free chunks as little-endian bytes, from the tokenizers library, each chunk encoded once."""

    #: Words encoded as one text.
    JOINED = 2000

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        suffix = json.loads(self.model.to_str())["model"]["end_of_word_suffix"] or "\0"
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, chunks: set[bytes]) -> None:
        """Put what isn't known yet into the memory.

        The vocabulary's rules lower the case and part letters from signs, so of ASCII words in either case and with signs after them the bare
        lower-case word is encoded. Words of letters are encoded many at once: each ends in one token with the suffix, and if there are
        more such tokens than words, they are encoded one by one.
        """
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        parts: dict[bytes, tuple[bytes, ...]] = {}
        bare, odd = set(), set()
        for c in chunks.difference(known):
            text = c.lower() if c.isascii() else c
            core = text.rstrip(STOPS)
            if core and (core.isalpha() if core.isascii() else letters(core)):
                bare.add(core)
                if len(core) < len(text):
                    tail = text[len(core) :]
                    odd.add(tail)
                    parts[c] = (core, tail)
                elif text != c:
                    parts[c] = (core,)
            else:
                odd.add(c)
        words = list(bare.difference(known))
        for k in range(0, len(words), self.JOINED):
            part = words[k : k + self.JOINED]
            ids = self.encode(b" ".join(part).decode())
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, low = ids.tobytes(), 0
                for w, end in zip(part, (4 * ends).tolist(), strict=True):
                    known[w] = raw[low:end]
                    low = end
            else:
                odd.update(part)
        for c in odd.difference(known):
            known[c] = self.encode(c.decode()).tobytes()
        for c, p in parts.items():
            known[c] = b"".join([known[w] for w in p])


def word_ids(path: str) -> WordIds:
    """This worker's memory for a vocabulary; it outlives the task."""
    return held(("word ids", path), lambda: WordIds(path))


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(_k0, piece, start, length, ids_crc32): each document's ids, the end id after them, cut at capacity.

    The vocabulary's rules drop white space and join nothing across it, so a text's ids are those of its chunks between ASCII white space.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        def f(_, texts):
            rows, piece, start, length, crc = [], [], [], [], []
            chunks = [text.split() if text else [] for text in texts]
            memory = word_ids(vocabulary)
            memory.learn(set().union(*chunks))
            for i, own in enumerate(chunks):
                ids = b"".join(map(memory.known.__getitem__, own)) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            return [piece, start, length, crc], rows

        return f

    return map_texts(docs, [F.col(id_col)], text_col, make, "piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times): best-two-fit over the counts of each length, so its work doesn't depend on the number of documents.

    A bin takes the longest piece left and then, again and again, the longest that fits. Then its smallest piece goes back if two pieces
    left fit the gap that this opens more tightly than it did, the two with the largest sum. Equal bins are made as often as the counts
    allow at once. A length is used up, or left with fewer than a bin needs, in each step, so there are a few steps a length.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    bins: list[tuple[list[int], int]] = []
    sizes = np.arange(capacity + 1)
    while left.any():
        below = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the largest length left, at most so long
        took: list[int] = []
        gap = capacity

        def take(n: int) -> None:
            nonlocal gap
            left[n] -= 1
            gap -= n
            took.append(n)
            if not left[n]:
                below[n:] = np.where(below[n:] == n, below[n - 1], below[n:])

        while n := int(below[gap]):
            take(n)
        if gap and len(took) > 1:
            low = took[-1]
            room = gap + low
            first = sizes[1 : room // 2 + 1]
            first = first[left[first] > 0]
            if len(first):
                second = below[room - first]
                fine = (second > first) | ((second == first) & (left[first] > 1))
                # where only one of a length is left, its partner is the next smaller one, which another pair has as well
                sums = np.where(fine, first + second, 0)
                k = int(sums.argmax())
                if sums[k] > low:
                    took.pop()
                    left[low] += 1
                    gap += low
                    a, b = int(first[k]), int(second[k])
                    left[a] -= 1
                    left[b] -= 1
                    gap -= a + b
                    took += [b, a]
        need = np.bincount(took, minlength=capacity + 1)
        used = need > 0
        more = int((left[used] // need[used]).min())
        left[used] -= more * need[used]
        bins.append((took, 1 + more))
    return bins


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id alone. Longer documents than capacity are cut, others never. Rows that repeat are packed
    each. An empty table gives an empty result. Only the counts of each length (capacity numbers at most) reach the driver; the plan that
    goes back to the executors has a few numbers a length, whatever the number of documents.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, vocabulary, id_col, text_col, capacity, end_id).withColumnRenamed("_k0", "id"), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    buckets = max(16, -(-sum(counts.values()) // RANKED))
    # the place of each piece among those of its length: within a bucket first, then after the buckets before it
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("length", "bucket", "sum(n) over (partition by length order by bucket) - n as before")
    ranked = rows.selectExpr("*", "row_number() over (partition by length, bucket order by id, piece) - 1 as at").join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("at") + F.col("before"))
    slots = spark.sparkContext.broadcast(slot_table(plan(counts, capacity)))

    def place(batches):
        low, first, fit, at, offsets = slots.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(low, (length << 40) + rank, side="right") - 1
            within = (length << 40) + rank - low[k]
            got = [first[k] + within // fit[k], offsets[at[k] + within % fit[k]]]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *map(pa.array, got)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank")
    kind = StructType([*out.schema.fields[:5], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return out.mapInArrow(place, kind).withColumnRenamed("id", id_col)


def slot_table(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """The plan as arrays: for each length and bin, in order, (length << 40) + the first rank that it takes, its first sequence, how many
    of that length a sequence takes, and where their offsets begin in the last array. A few entries a bin, and a few bins a length."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for took, times in bins:
        offset, own = 0, {}
        for n in took:
            own.setdefault(n, []).append(offset)
            offset += n
        for n, offsets in own.items():
            rows.append(((n << 40) + given.get(n, 0), sequence, offsets))
            given[n] = given.get(n, 0) + times * len(offsets)
        sequence += times
    rows.sort()
    fit = np.array([len(o) for *_, o in rows], dtype=np.int64)
    offsets = np.array([x for *_, o in rows for x in o], dtype=np.int64)
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), fit, np.cumsum(fit) - fit, offsets
