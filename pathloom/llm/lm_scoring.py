"""Operator 10: masked pseudo-likelihood by a window network that predicts each token from both sides, trained in numpy."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from .common import BLOCK_BYTES, release, remove, written

#: Words fall into CLASSES of about equal mass by how often they are found, and the words of a class, level by level, into GROUPS by their hash; the
#: network has HIDDEN units.
CLASSES, GROUPS, HIDDEN = 32, 16, 16
OFFSETS = (-2, -1, 1, 2)
#: Tokens of a training step, and those scored at a time.
BATCH, SCORED = 4096, 1024
#: Documents are dealt to shards by a hash of their own, so many bytes of text a shard, or more where there would be more than MOST_SHARDS.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 20_000
#: Logarithms of shares are kept as whole numbers of 1 / STEPS, of which 24 bits hold down to -64.
STEPS = 1 << 18
#: Weights are summed as whole numbers of 1 / FIXED, so that their mean doesn't depend on the order of the sum.
FIXED = 1 << 16


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: their ids, numbers of words, the words as places in the block's own list of words, that list as hashes, and its counts.
    Words are what stands between ASCII white space, in lower case; 64 bits tell them apart (of 10**8 words two share a hash with
    probability 3e-4).

    A block is a run of BLOCK_BYTES (or one longer text) of a shard's documents in order of id and text. Shards and order depend on the rows alone, and
    so do the blocks, however the input is partitioned."""
    text = F.col(text_col).cast("string").cast("binary")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // max(SHARD_BYTES, total // MOST_SHARDS)))
    inner = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    inner = inner.repartition(shards, "shard").sortWithinPartitions("shard", "id", "text")
    schema = StructType().add("block", LongType()).add("ids", ArrayType(inner.schema["id"].dataType)).add("sizes", ArrayType(IntegerType())).add("codes", BinaryType()).add("words", ArrayType(LongType())).add("counts", ArrayType(IntegerType()))
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, size = TaskContext.get().partitionId() << 32, None, 0
        ids, texts = [], []

        def block() -> pa.RecordBatch:
            numbers = Numbers()
            split = [t.lower().split() for t in texts]
            sizes = [len(t) for t in split]
            codes = np.fromiter((numbers[w] for t in split for w in t), np.int32, sum(sizes))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            counts = np.bincount(codes, minlength=len(numbers))
            # frequent words get small numbers, and the bytes of numbers stand by their weight: both compress well
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order))
            planes = np.ascontiguousarray(place[codes].view(np.uint8).reshape(-1, 4).T)
            row = [at, list(ids), sizes, zlib.compress(planes.tobytes(), 1), hashes[order].view(np.int64), counts[order]]
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            for i, own, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = own or b""
                if ids and (s != shard or size + len(own) > BLOCK_BYTES):
                    yield block()
                    at, size = at + 1, 0
                    ids.clear()
                    texts.clear()
                shard, size = s, size + len(own)
                ids.append(i)
                texts.append(own)
        if ids:
            yield block()

    return inner.mapInArrow(run, schema)


class Shape:
    """How large the model is, from the histogram (count, words with it) of the vocabulary.

    lows: the least count of each class that is used, downwards. levels: how often the words of a class are divided into GROUPS, so that a leaf has about
    one word; beyond MOST_LEVELS, where a table of all leaves is no small thing, leaves have more. rows: rows of input weights for each class, which
    grow with the square root of the vocabulary. base: for each level the logarithms of the groups' shares of
    what they are part of."""

    MOST_LEVELS = 3

    def __init__(self, histogram: list[tuple[int, int]]):
        lows: dict[int, int] = {}
        total, done = sum(n * m for n, m in histogram), 0
        for n, m in sorted(histogram, reverse=True):
            lows[min(int(CLASSES * (done + n * m / 2) / total), CLASSES - 1)] = n
            done += n * m
        self.lows = list(lows.values())
        words = max(1, sum(m for _, m in histogram))
        self.levels = max(1, min(self.MOST_LEVELS, round(math.log(words / CLASSES, GROUPS))))
        self.rows = max(1, min(1 << 16, 1 << math.ceil(math.log2(words**0.5 / CLASSES / 4)))) if words > 16 * CLASSES**2 else 1
        self.base: list[np.ndarray] = []

    def weigh(self, leaf: np.ndarray, mass: np.ndarray) -> None:
        """Take in the masses of the leaves, numbered class * GROUPS**levels + code."""
        full = np.zeros(CLASSES * GROUPS**self.levels)
        full[leaf] = mass
        with np.errstate(divide="ignore"):
            for level in range(self.levels + 1):
                mass = full.reshape(-1, CLASSES if not level else GROUPS, GROUPS ** (self.levels - level)).sum(2)
                self.base.append(np.log(mass / np.maximum(mass.sum(1, keepdims=True), 1)).astype(np.float32))


def classed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Shape]:
    """The blocks with what is known of each word of their lists, in one number, as a table in the shared folder; and the model's shape. The number has,
    from the top, 8 bits for the class, 16 of the word's hash that choose its row, 16 for its code, which numbers the leaves of a class, and 24 for
    the logarithm of its share of all that is found in its leaf.

    The vocabulary, every word with its count over all documents, is a table there too: it grows with the documents and meets the blocks' lists in a
    join on the word. The driver is given how many words have each count, and the leaves' masses: CLASSES * GROUPS**MOST_LEVELS numbers at most."""
    parts = written(coded(docs, id_col, text_col), "blocks")
    release(docs.sparkSession)
    lists = parts.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("block", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    vocabulary = written(lists.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    release(docs.sparkSession)
    shape = Shape([(r.n, r.m) for r in vocabulary.groupBy("n").agg(F.count("*").alias("m")).collect()])
    class_ = sum((F.when(F.col("n") < low, 1).otherwise(0) for low in shape.lows[:-1]), F.lit(0))
    leaves = GROUPS**shape.levels
    keyed = vocabulary.select("word", "n", (class_.cast("long") * leaves + F.pmod("word", F.lit(leaves))).alias("leaf"))
    mass = keyed.groupBy("leaf").agg(F.sum("n").alias("mass"))
    got = mass.toArrow()
    shape.weigh(got.column("leaf").to_numpy(), got.column("mass").to_numpy())
    share = F.round(F.log(F.col("mass") / F.col("n")) * STEPS).cast("long")
    top = F.shiftleft(F.floor(F.col("leaf") / leaves), 56) + F.shiftleft(F.shiftright("word", 40).bitwiseAND(0xFFFF), 40) + F.shiftleft(F.pmod("leaf", F.lit(leaves)), 24)
    shared = written(keyed.join(mass.hint("shuffle_hash"), "leaf").select("word", (top + share).alias("known")), "shares")
    own = lists.drop("n").join(shared.hint("shuffle_hash"), "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "known"))).alias("x"))
    own = written(own.select("block", F.col("x.known").alias("known")), "known")
    out = written(parts.drop("words", "counts").join(own, "block", "left").drop("block"), "classed")
    remove(parts, vocabulary, shared, own)
    release(docs.sparkSession)
    return out, shape


class Block:
    """A block's texts as numbers of words; for each word its class, row of input weights, code and share."""

    def __init__(self, batch: pa.RecordBatch, k: int, shape: Shape):
        ids, sizes, codes, known = (batch.column(c)[k] for c in ("ids", "sizes", "codes", "known"))
        self.ids, self.sizes = ids.values, sizes.values.to_numpy()
        planes = np.frombuffer(zlib.decompress(codes.as_py()), np.uint8).reshape(4, -1)
        self.tokens = np.ascontiguousarray(planes.T).view(np.int32).ravel()
        known = known.values.to_numpy() if known.is_valid else np.empty(0, np.int64)
        self.of, self.code, self.share = known >> 56, (known >> 24) & 0xFFFF, (known & 0xFFFFFF) / -STEPS
        self.row = 1 + self.of * shape.rows + ((known >> 40) & (shape.rows - 1))

    def around(self) -> np.ndarray:
        """The rows of the tokens at each offset; row 0 is what lies beyond a text."""
        reach = max(OFFSETS)
        place = np.arange(len(self.tokens)) + reach * (1 + np.repeat(np.arange(len(self.sizes)), self.sizes))
        flat = np.zeros(len(self.tokens) + reach * (1 + len(self.sizes)), dtype=np.int64)
        flat[place] = self.row[self.tokens]
        return flat[place[:, None] + np.array(OFFSETS)]


#: Rows that a product of matrices takes at a time: few enough that the library stays on one core, as each task has its own.
STACK = 128


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for a tall a."""
    whole = len(a) - len(a) % STACK
    out = np.empty((len(a), b.shape[1]), dtype=np.float32)
    if whole:
        np.matmul(a[:whole].reshape(-1, STACK, a.shape[1]), b, out=out[:whole].reshape(-1, STACK, b.shape[1]))
    out[whole:] = a[whole:] @ b
    return out


def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for tall a and b."""
    whole = len(a) - len(a) % STACK
    stacks = np.matmul(a[:whole].reshape(-1, STACK, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, STACK, b.shape[1]))
    return stacks.sum(0) + a[whole:].T @ b[whole:]


class Network:
    """Hidden units tanh(sum over offsets of the row for the token there, + bias), which tilt the counts: a softmax over classes, and one over GROUPS for
    each level, each added to the logarithms of the masses. A masked token's probability is that of its class, times that of its group at each
    level given those above, times its share of its leaf. Without tilt it is the token's share of all tokens; all probabilities add up to one."""

    def __init__(self, shape: Shape, values: np.ndarray | None = None):
        self.shape = shape
        shapes = [(len(OFFSETS), 1 + CLASSES * shape.rows, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES + GROUPS * shape.levels), (CLASSES + GROUPS * shape.levels,)]
        sizes = [int(np.prod(s)) for s in shapes]
        if values is None:
            rng = np.random.Generator(np.random.PCG64(11))
            values = np.concatenate([rng.normal(0, 0.3, sizes[0]), np.zeros(sizes[1] + sizes[2] + sizes[3])])
        self.values = values.astype(np.float32)
        self.rows, self.shift, self.out, self.bias = [v.reshape(s) for v, s in zip(np.split(self.values, np.cumsum(sizes)[:-1]), shapes, strict=True)]
        self.squares = np.full_like(self.values, 1e-3)

    def forward(self, around: np.ndarray, gold: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(hidden units, for the classes and for the groups at each level: their logarithms with tilt, not yet made to add up, and which the token is)."""
        h = self.shift + self.rows[0][around[:, 0]]
        for j in range(1, len(OFFSETS)):
            h += self.rows[j][around[:, j]]
        np.tanh(h, out=h)
        z = times(h, self.out)
        z += self.bias
        parts, node, low = [(z[:, :CLASSES] + self.shape.base[0], gold)], gold, CLASSES
        for level in range(self.shape.levels):
            own = code // GROUPS ** (self.shape.levels - 1 - level) % GROUPS
            parts.append((z[:, low : low + GROUPS] + self.shape.base[level + 1][node], own))
            node, low = node * GROUPS + own, low + GROUPS
        return h, parts

    def logs(self, around: np.ndarray, gold: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The log-probability of each token's leaf."""
        at, out = np.arange(len(gold)), np.zeros(len(gold))
        for z, own in self.forward(around, gold, code)[1]:
            out += z[at, own] - np.log(np.einsum("ij->i", np.exp(z)))
        return out

    def gradient(self, around: np.ndarray, gold: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Of the mean of -logs()."""
        h, parts = self.forward(around, gold, code)
        at, d = np.arange(len(gold)), np.empty((len(gold), self.out.shape[1]), dtype=np.float32)
        low = 0
        for z, own in parts:
            p = np.exp(z, out=d[:, low : low + z.shape[1]])
            p *= (1 / np.einsum("ij->i", p))[:, None]
            p[at, own] -= 1
            low += z.shape[1]
        d *= 1 / len(gold)
        back = times(d, np.ascontiguousarray(self.out.T))
        back *= 1 - h * h
        unit = np.arange(HIDDEN)
        size = self.rows[0].size
        first, weights = around * HIDDEN, back.ravel().astype(np.float64)
        rows = [np.bincount((first[:, j, None] + unit).ravel(), weights=weights, minlength=size) for j in range(len(OFFSETS))]
        return np.concatenate([*rows, back.sum(0), across(h, d).ravel(), d.sum(0)]).astype(np.float32)

    def step(self, around: np.ndarray, gold: np.ndarray, code: np.ndarray, rate: float) -> None:
        """One step down the mean loss, each weight by its own squares so far."""
        g = self.gradient(around, gold, code)
        self.squares += g * g
        self.values -= rate * g / np.sqrt(self.squares)


def train(parts: DataFrame, shape: Shape, rounds: int = 1, rate: float = 0.05) -> Network:
    """The network after so many rounds over all documents. In a round each block goes on from the common weights over its own texts, and the new
    common weights are the blocks' means by their number of tokens: sums by weight, as many as the network has. As blocks depend on the rows alone
    and sums are of whole numbers, so do the weights."""
    network = Network(shape)
    spark = parts.sparkSession
    for _ in range(rounds):
        begin = spark.sparkContext.broadcast(network.values)

        def run(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            values = begin.value
            sums = np.zeros(len(values) + 1, dtype=np.int64)
            for batch in batches:
                for k in range(batch.num_rows):
                    block, own = Block(batch, k, shape), Network(shape, values.copy())
                    around = block.around()
                    for at in range(0, len(around), BATCH):
                        tokens = block.tokens[at : at + BATCH]
                        own.step(around[at : at + BATCH], block.of[tokens], block.code[tokens], rate)
                    weight = -(-len(around) >> 10)
                    sums[:-1] += np.rint(own.values.astype(np.float64) * FIXED).astype(np.int64) * weight
                    sums[-1] += FIXED * weight
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["weight", "value"])

        got = parts.mapInArrow(run, "weight long, value long").groupBy("weight").agg(F.sum("value").alias("value")).toArrow()
        begin.destroy()
        values = np.zeros(len(network.values) + 1)
        if len(got):
            values[got.column("weight").to_numpy()] = got.column("value").to_numpy()
        if not values[-1]:
            break
        network = Network(shape, values[:-1] / values[-1])
    return network


def score(parts: DataFrame, shape: Shape, network: Network, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_tokens, log_likelihood (the sum of every token's log-probability given both sides) and per_token."""
    values = parts.sparkSession.sparkContext.broadcast(network.values)
    schema = StructType().add(id_col, parts.schema["ids"].dataType.elementType).add("n_tokens", "long").add("log_likelihood", "double").add("per_token", "double")
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shape, values.value)
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch, k, shape)
                around, logs = block.around(), block.share[block.tokens]
                for at in range(0, len(around), SCORED):
                    tokens = block.tokens[at : at + SCORED]
                    logs[at : at + SCORED] += net.logs(around[at : at + SCORED], block.of[tokens], block.code[tokens])
                sizes = block.sizes
                sums = np.diff(np.append(0.0, np.cumsum(logs))[np.append(0, np.cumsum(sizes))])
                columns = [block.ids, sizes, sums, [x / n if n else None for x, n in zip(sums.tolist(), sizes.tolist(), strict=True)]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return parts.mapInArrow(run, schema)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """Score every document under a network trained on all of them; see score().

    Null and empty texts have no tokens, likelihood 0 and no mean. Rows that repeat count as often as they stand. An empty table gives an empty
    result. Other columns are not read. Scores depend on the rows alone, not on how they are partitioned. What reaches the driver is one number for
    each count that words have and one a weight; the network has a number of weights that grows with the square root of the vocabulary.
    """
    parts, shape = classed(docs, id_col, text_col)
    return score(parts, shape, train(parts, shape, rounds), id_col)
