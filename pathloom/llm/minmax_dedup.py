"""Operator 3: near-duplicates by min-max hashing, every link confirmed on whole shingle sets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, join_one, map_texts, order_key, release, remove, written
from .components import components

#: Hash functions, of which both ends count: 2 * HASHES values a document. ROWS values are a band, of minima or maxima alone.
HASHES, ROWS = 64, 4
BANDS = 2 * HASHES // ROWS
#: Hash functions of the deep sketch, which only sets of more than LONG shingles in crowded neighbourhoods get: it is shorter than they are.
DEEP, LONG = 2048, 1024
#: Members of a bucket that are compared with each other, or with as many more, at a time: on sketches, and on whole sets, which may take ROOM bytes.
TILE, SET_TILE, ROOM = 1024, 512, 16 << 20
#: Shingles hashed at a time, and bytes of text taken at a time.
CHUNK, SPAN = 1024, 1 << 16
#: Longest word, in bytes, hashed by the tables of LETTERS.
LONGEST = 32
#: So many ids are sent to every task; more are dealt out with the texts.
FEW = 2_000_000
_RNG = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
WEIGHTS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


DEEP_FACTORS = _RNG.integers(1, 2**63, DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
DEEP_ADDENDS = _RNG.integers(0, 2**63, DEEP, dtype=np.uint64)
#: A random number for each byte at each place in a word; A-Z have those of a-z.
LETTERS = _RNG.integers(0, 2**64, (LONGEST, 256), dtype=np.uint64)
LETTERS[:, 65:91] = LETTERS[:, 97:123]
BLANK = np.isin(np.arange(256), [*range(9, 14), 32])
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")


def may_differ(bits: int, percent: int, deviations: float) -> int:
    """Bits on which the sketches of two sets that are just similar enough may differ: a bit differs with half the distance as probability.
    Six deviations are passed by fewer than one pair in 10**8, 5.2 by one in 10**7."""
    p = (100 - percent) / 200
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, lower-cased, and each text's number of words. A word's hash is the sum of its letters' numbers, so two
    different words have the same with probability 2**-64; those of more than LONGEST bytes have one by xxh3."""
    joined = b" " + b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    blank = BLANK[raw]
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = turns[0::2], turns[1::2]
    bounds = np.cumsum([1, *[len(x) + 1 for x in texts]])
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    sizes = ends - starts
    taken = np.minimum(sizes, LONGEST)
    first = np.cumsum(taken) - taken
    place = np.arange(first[-1] + taken[-1]) - np.repeat(first, taken)
    letter = raw[place + np.repeat(starts, taken)]
    found = np.add.reduceat(LETTERS.ravel()[place << 8 | letter], first)
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        found[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]].lower())
    return found, counts


def pieces(text: bytes) -> list[bytes]:
    """The text cut between words, into pieces of about SPAN bytes."""
    out, at = [], 0
    while len(text) - at > SPAN:
        cut = _BLANKS.search(text, at + SPAN)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def words_of(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """word_hashes() of runs of the texts, in order; a long text is a run of its own."""
    run, size = [], 0
    for text in texts:
        text = text or b""
        if run and size + len(text) > SPAN:
            yield word_hashes(run)
            run, size = [], 0
        if len(text) > SPAN:
            h = np.concatenate([word_hashes([x])[0] for x in pieces(text)])
            yield h, np.array([len(h)])
            continue
        run.append(text)
        size += len(text)
    if run:
        yield word_hashes(run)


def folded(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values."""
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out * WEIGHTS[j] + h[j : j + len(out)])
    return out


def shingles(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes; the whole sequence where it has fewer words; nothing without words."""
    sets = []
    for h, counts in words_of(texts):
        every = folded(h, k) if len(h) >= k else None
        end = 0
        for n in counts.tolist():
            at, end = end, end + n
            if n < k:
                sets.append(folded(h[at:end], n) if n else np.empty(0, np.uint64))
                continue
            found = np.sort(every[at : end - k + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            sets.append(found[new])
    return sets


def signature(found: np.ndarray, factors: np.ndarray = FACTORS, addends: np.ndarray = ADDENDS) -> np.ndarray:
    """The least and the greatest value of each hash function over the set, least ones first: one evaluation a shingle for two values. The functions
    work on the upper halves of the shingles' hashes, 32 bits, of which numpy takes twice as many at a time."""
    upper = (found >> np.uint64(32)).astype(np.uint32)
    a, b = factors.astype(np.uint32)[:, None], (addends >> np.uint64(31)).astype(np.uint32)[:, None]
    low, high = np.full(len(a), 2**32 - 1, np.uint32), np.zeros(len(a), np.uint32)
    room = np.empty(HASHES * CHUNK, np.uint32)
    for f in range(0, len(a), HASHES):
        own = slice(f, f + HASHES)
        for at in range(0, len(upper), CHUNK):
            x = upper[at : at + CHUNK]
            y = room[: len(a[own]) * len(x)].reshape(-1, len(x))
            np.add(np.multiply(a[own], x, out=y), b[own], out=y)
            np.minimum(low[own], y.min(1), out=low[own])
            np.maximum(high[own], y.max(1), out=high[own])
    return mixed(np.concatenate([low, high]).astype(np.uint64))


def sketch(values: np.ndarray) -> np.ndarray:
    """One bit of each value of a row, as longs."""
    return np.packbits((values & np.uint64(1)).astype(bool), axis=-1).view(np.int64)


def lists(values: np.ndarray, has: np.ndarray) -> pa.Array:
    """The rows of values as lists, null where has is false."""
    at = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel()), type=pa.list_(pa.field("element", pa.int64())), mask=pa.array(~has))


def features(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, set_key, bits0, bits1, bands) for each row: the set's size, its 128-bit digest, the sketch and the band hashes."""

    def make():
        def f(_, texts):
            sets = shingles(texts, k)
            sizes = np.array([len(x) for x in sets], np.int64)
            has, none = sizes > 0, np.zeros(2 * HASHES, np.uint64)
            values = np.stack([signature(x) if len(x) else none for x in sets])
            band, bits = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sets), 1)), sketch(values)
            for row in range(ROWS):
                band = mixed(band * WEIGHTS[0] + values[:, row::ROWS])
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            return [sizes, keys, pa.array(bits[:, 0], mask=~has), pa.array(bits[:, 1], mask=~has), lists(band.view(np.int64), has)], None

        return f

    return map_texts(docs, [order_key(id_col)], text_col, make, "n long, set_key binary, bits0 long, bits1 long, bands array<long>").withColumnRenamed("_k0", "id")


def whole_sets(docs: DataFrame, id_col: str, text_col: str, k: int, deep: bool) -> DataFrame:
    """(id, members, deep): a set's 64-bit hashes, sorted, as bytes, and a long one's deep sketch if asked for."""

    def make():
        def f(_, texts):
            found = shingles(texts, k)
            return [[x.tobytes() for x in found], [sketch(signature(x, DEEP_FACTORS, DEEP_ADDENDS)) if deep and len(x) > LONG else None for x in found]], None

        return f

    return map_texts(docs, [order_key(id_col)], text_col, make, "members binary, deep array<long>").withColumnRenamed("_k0", "id")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union. Each pair brings its two sets together; they may meet anywhere."""

    def check(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                # read where they are: sets of very long texts are no small copies
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(check, "a long, b long")


def tiled(rows: DataFrame) -> DataFrame:
    """rows (band, node, parts, ...), each once for every pair of tiles of its bucket that its own tile is in, with the pair's tiles i <= j and its own. A
    bucket has as many tiles as parts says, and any two of its members meet in one pair of tiles."""
    placed = rows.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    every = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return written(every.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("parts", "other"), "tiles")


def in_tiles(rows: DataFrame, percent: int, work: Callable, schema: str) -> DataFrame:
    """Rows of schema that work(tile, percent) makes of each pair of tiles; tile has the columns by name. Pairs are dealt out by ranges, which hold about as
    many rows each."""
    keys = ["band", "i", "j"]

    def run(batches):
        left = None
        for batch in chain(batches, [None]):
            if batch is not None:
                left = pa.concat_batches([left, batch]) if left is not None and left.num_rows else batch
            if left is None or not left.num_rows:
                continue
            of = np.stack([left.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1).tolist(), left.num_rows]
            # the last pair of tiles may go on in the next batch
            ends = cuts[1:] if batch is None else cuts[1:-1]
            made = [work({c: left.column(c).slice(a, b - a) for c in left.schema.names}, percent) for a, b in zip(cuts, ends, strict=False) if b - a > 1]
            left = left.slice(ends[-1]) if ends else left
            both = np.concatenate([np.empty((0, 2), np.int64), *made])
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def open_pairs(tile: dict[str, pa.Array], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """The pairs of rows of a pair of tiles that may be similar enough and have different labels, each row with those that it is to be compared with. A pair
    that shares several buckets is left to the one that comes first."""
    label, n, own = (tile[c].to_numpy() for c in ("label", "n", "own"))
    values, kinds = np.unique(label, return_inverse=True)
    if len(values) == 1:
        return
    bits = np.stack([tile[c].to_numpy() for c in ("bits0", "bits1")], 1).view(np.uint64)
    bands = tile["bands"].flatten().to_numpy().reshape(-1, BANDS)
    first = np.flatnonzero(bands[0] == tile["band"][0].as_py())[0]
    across = tile["i"][0].as_py() != tile["j"][0].as_py()
    most = may_differ(2 * HASHES, percent, 6)
    # rows of the commonest label have nothing to ask each other
    apart = np.flatnonzero(kinds != np.bincount(kinds).argmax())
    turn = np.full(len(n), len(n))
    turn[apart] = apart
    for at in range(0, len(apart), 64):
        x = apart[at : at + 64, None]
        near = (label[x] != label) & (turn > x) & (100 * np.minimum(n[x], n) >= percent * np.maximum(n[x], n))
        if across:
            near &= own[x] != own
        a, b = np.nonzero(near)
        a = x[a, 0]
        keep = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= most
        a, b = a[keep], b[keep]
        keep = (bands[a] == bands[b]).argmax(1) == first
        a, b = a[keep], b[keep]
        for one in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1) if len(a) else []:
            yield int(a[one[0]]), b[one]


def asked(tile: dict[str, pa.Array], percent: int) -> np.ndarray:
    """(band, node) of the rows of a pair of tiles that are in such a pair."""
    hit = np.zeros(len(tile["n"]), bool)
    for x, ys in open_pairs(tile, percent):
        hit[x] = True
        hit[ys] = True
    return np.stack([tile["band"].to_numpy()[hit], tile["node"].to_numpy()[hit]], 1)


def linked(tile: dict[str, pa.Array], percent: int) -> np.ndarray:
    """Links (a, b) on whole sets between the rows of a pair of tiles, as many as connect what is connected: a row is asked nothing about
    rows that it is known to reach."""
    node, n, long = tile["node"].to_numpy(), tile["n"].to_numpy(), tile["deep"].is_valid().to_numpy(zero_copy_only=False)
    reach = np.unique(tile["label"].to_numpy(), return_inverse=True)[1]
    ends = np.cumsum(n)
    shingle = seen = deep = None
    links = []
    for x, ys in open_pairs(tile, percent):
        ys = ys[reach[ys] != reach[x]]
        if long[x] and len(ys):
            if deep is None:
                deep = np.zeros((len(n), DEEP // 32), np.uint64)
                deep[long] = tile["deep"].drop_null().flatten().to_numpy().view(np.uint64).reshape(-1, DEEP // 32)
            ys = ys[~long[ys] | (np.bitwise_count(deep[x] ^ deep[ys]).sum(1, dtype=np.int64) <= may_differ(2 * DEEP, percent, 5.2))]
        if not len(ys):
            continue
        if shingle is None:
            # shingles by small numbers, and room to mark those of one set
            every = np.concatenate([np.frombuffer(m.as_buffer(), np.uint64) for m in tile["members"]])
            values, shingle = np.unique(every, return_inverse=True)
            seen = np.zeros(len(values), bool)
        mine = shingle[ends[x] - n[x] : ends[x]]
        seen[mine] = True
        found = seen[np.concatenate([shingle[ends[y] - n[y] : ends[y]] for y in ys.tolist()])]
        both = np.add.reduceat(found, np.cumsum(n[ys]) - n[ys], dtype=np.int64)
        seen[mine] = False
        for y in ys[100 * both >= percent * (n[x] + n[ys] - both)].tolist():
            if reach[y] != reach[x]:
                links.append(sorted((node[x], node[y])))
                reach[reach == reach[y]] = reach[x]
    return np.array(links, np.int64).reshape(-1, 2)


def likely(a: str, b: str, percent: int) -> Column:
    """What two sets that are similar enough have in common: sizes within the bound, and sketches that differ on few bits."""
    near = F.expr(f"bit_count({a}.bits0 ^ {b}.bits0) + bit_count({a}.bits1 ^ {b}.bits1) <= {may_differ(2 * HASHES, percent, 6)}")
    return near & F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable over links), kept (id = component_id).

    Documents are linked when their sets of k-word shingles have a Jaccard similarity of percent / 100 or more; every link is confirmed on whole
    sets. Null texts and texts without words have an empty set and no link. Rows that repeat an id are one document. A null id is smaller than
    any other. Other columns are not read.

    Equal sets are one class, and only classes are compared. A band is ROWS minima or ROWS maxima; a pair at the bound shares none of the
    BANDS bands with probability (1 - 0.8**4)**32 < 10**-7. In each bucket of a band a hub, the first member in an order that all bands share, is
    compared with all others, so a bucket of m classes has fewer than m pairs, and the bands of a large group have the same few hubs. What isn't
    in its hub's component then is compared with a second one, the first member in an order of the band's own. After these links are merged, members
    of a bucket that are still in different components are compared in pairs of tiles: no bucket is capped, and no link between components goes
    unseen. Sketches and whole sets of a pair of tiles are compared in memory, so that rows are made of members and links alone, not of pairs.
    The comparisons of a bucket still are the product of those that are apart with all; the rows dealt out are that by TILE.
    """
    spark = docs.sparkSession
    rows = written(features(docs, id_col, text_col, k), "minmax")
    classes = rows.where("n > 0").groupBy("set_key").agg(F.min("id").alias("node"), F.count("*").alias("times"))
    total = rows.count()
    member = join_one(rows.where("n > 0").select("id", "set_key"), classes, ["set_key"], "times", total).select("id", "node")
    # only where ids repeat is there anything to drop
    once_each = rows.select("id").distinct().count() == total
    one_each = lambda df, key: df if once_each else df.dropDuplicates([key])
    # a row for each class: that of its smallest id
    nodes = one_each(rows.where("n > 0").join(classes.select(F.col("node").alias("id"), "set_key"), ["id", "set_key"], "left_semi"), "id")
    nodes = written(nodes.select(F.col("id").alias("node"), "n", "bits0", "bits1", "bands"), "classes")
    # the bands that several classes have; all that follows reads these alone
    every = nodes.select(F.explode("bands").alias("band"), "node")
    repeated = every.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("band")
    shared = written(every.join(repeated.hint("shuffle_hash"), "band", "left_semi"), "shared")
    release(spark)
    few = written(nodes.join(shared.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"), "compared")
    texts = docs.select(F.col(text_col).alias("text"), order_key(id_col).alias("node"))

    def sets_of(wanted: DataFrame, deep: bool = False) -> DataFrame:
        ids = written(wanted.distinct(), "wanted")
        own = texts.join(ids.hint("broadcast" if ids.count() <= FEW else "shuffle_hash"), "node", "left_semi")
        out = written(one_each(whole_sets(own, "node", "text", k, deep), "id"), "sets")
        remove(ids)
        return out

    label = F.coalesce(F.col("label"), F.col("node")).alias("label")
    placed = few.select("node", F.col("node").alias("label"), "n", "bits0", "bits1")
    pairs, links = [], []
    for order in (F.xxhash64("node"), F.xxhash64("band", "node")):
        buckets = shared.join(placed, "node")
        own = ("node", "label", "n", "bits0", "bits1")
        ends = buckets.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), *[F.min_by(c, order).alias(f"hub_{c}") for c in own]).where("low <> high")
        hubs = ends.select("band", F.struct(*[F.col(f"hub_{c}").alias(c) for c in own]).alias("y"))
        met = buckets.select("band", F.struct(*own).alias("x")).join(hubs, "band").where((F.col("x.label") != F.col("y.label")) & likely("x", "y", percent))
        found = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        pairs.append(written(found.distinct(), "pairs"))
        sets = sets_of(pairs[-1].select(F.explode(F.array("a", "b")).alias("node")))
        links.append(written(confirmed(pairs[-1], sets, percent), "links"))
        remove(sets)
        labels = written(components(reduce(DataFrame.unionByName, links)), "labels")
        # nodes, each with the smallest node that it is known to reach
        placed = written(few.join(labels, "node", "left").select("node", label, "n", "bits0", "bits1"), "placed")
        release(spark)
    # buckets whose members are still in several components
    count = F.ceil(F.count("*") / TILE).cast("int").alias("parts")
    spread = shared.join(placed.select("node", "label"), "node").groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), count).where("low <> high")
    crowded = written(shared.join(spread.select("band", "parts"), "band").join(placed, "node").join(few.select("node", "bands"), "node"), "crowded")
    tiles = tiled(crowded)
    release(spark)
    open_ = written(in_tiles(tiles, percent, asked, "band long, node long").distinct(), "open")
    remove(tiles)
    if not open_.isEmpty():
        sets = sets_of(open_.select("node"), deep=True)
        own = crowded.drop("parts").join(open_, ["band", "node"], "left_semi")
        count = F.ceil(F.greatest(F.count("*") / SET_TILE, F.sum("n") * 8 / ROOM)).cast("int").alias("parts")
        tiles = tiled(own.join(own.groupBy("band").agg(count), "band").join(sets.withColumnRenamed("id", "node"), "node"))
        links.append(written(in_tiles(tiles, percent, linked, "a long, b long"), "links"))
        remove(sets, tiles)
        if not links[-1].isEmpty():
            labels = written(components(reduce(DataFrame.unionByName, links)), "labels")
    remove(crowded)
    whole = member.join(labels, "node", "left").select("id", label).groupBy("id").agg(F.min("label").alias("label"))
    own = F.coalesce("label", "id")
    real = lambda c: F.when(c != NULL_KEY, c)
    out = rows.select("id", "n").join(whole, "id", "left")
    return out.select(real(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), real(own).alias("component_id"), (own == F.col("id")).alias("kept"))
