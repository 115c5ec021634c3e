"""Operator 4: repeated passages by prefix-free parsing: every byte of a window that also starts earlier is removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_one, map_texts, order_key, release, remove, written

#: Bytes that repeat, and bytes that the rolling hash sees. A trigger is the least hash of the grams in a window, so each window has one, the same
#: wherever the window stands, and about two bytes in SPREAD + 1 begin a phrase.
WINDOW, GRAM = 100, 40
SPREAD = WINDOW - GRAM + 1
#: Bytes parsed at a time; a longer text is cut there, which makes a few more phrases and no other difference.
SEGMENT = 1 << 20
#: Bits of the filters for repeated triggers: a number for each, up to 32 MB a filter. Where more repeat than that holds, it lets more pass; the result
#: is the same.
BITS_EACH, MOST_BITS = 8, 1 << 28
#: Windows put in order at a time, at least, and phrases with one trigger beyond which they are opened before they are dealt out.
OPENED, CROWDED = 20_000, 4_000
_RNG = np.random.Generator(np.random.PCG64(77))
LETTERS = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """BASE and its inverse modulo 2**64 to the powers 0, 1, ..."""
    if not _POWERS:
        for b in (BASE, pow(BASE, -1, 2**64)):
            p = np.full(SEGMENT + WINDOW, b, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def least_in_windows(key: np.ndarray) -> np.ndarray:
    width = 1
    while 2 * width <= SPREAD:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    return np.minimum(key[: len(key) - (SPREAD - width)], key[SPREAD - width :]) if width < SPREAD else key


def parse(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger hashes, first windows, numbers of windows, whether the trigger is found more than once) of the phrases in data, which holds texts that
    end at ends.

    The windows of a phrase follow each other and have the same trigger hash; a window begins at each byte that has WINDOW bytes of its text from
    there on. Where bytes repeat at short distances a hash stays the least one for long: such a run is cut every SPREAD windows, so it makes no
    more phrases than other text.
    """
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, empty
    up, down = powers()
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(LETTERS[data] * up[:n], out=total[1:])
    gram = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    # the place in the low bits: of equal hashes the leftmost is taken, and the rightmost
    low = np.uint64((1 << 21) - 1)
    place = np.arange(len(gram), dtype=np.uint64)
    trigger = (least_in_windows((gram & ~low) | place) & low).astype(np.int64)
    rightmost = (low - (least_in_windows((gram & ~low) | (low - place)) & low)).astype(np.int64)
    value = gram[trigger]
    fits = np.zeros(len(trigger), dtype=bool)
    begin = 0
    for end in ends.tolist():
        fits[begin : max(begin, end - WINDOW + 1)] = True
        begin = end
    change = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (fits[1:] != fits[:-1])))
    size = np.diff(np.append(change, len(trigger)))
    good = fits[change]
    first, size = change[good], size[good]
    again = trigger[first] != rightmost[first + size - 1]
    parts = -(-size // SPREAD)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, whole = np.repeat(first, parts) + k * SPREAD, np.repeat(size, parts)
    return value[begin].view(np.int64), begin, np.minimum(whole - k * SPREAD, SPREAD), np.repeat(again, parts)


def phrases(texts: list[bytes | None]):
    """For each run of texts of about SEGMENT bytes: (buffer, trigger hashes, text numbers, places in the text, numbers of windows, places in the
    buffer, whether the trigger is found again in the phrase)."""
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def parsed():
        buffer = b"".join(x for *_, x in held)
        ends = np.cumsum([len(x) for *_, x in held])
        gram, first, size, again = parse(np.frombuffer(buffer, np.uint8), ends)
        which = np.searchsorted(ends, first, side="right")
        starts = ends - np.array([len(x) for *_, x in held])
        place = first - starts[which] + np.array([at for _, at, _ in held])[which]
        return buffer, gram, np.array([i for i, *_ in held])[which], place, size, first, again

    for i, text in enumerate(texts):
        text = text or b""
        if len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, SEGMENT - WINDOW):
            part = text[at : at + SEGMENT - 1]
            if held and total + len(part) > SEGMENT:
                yield parsed()
                held, total = [], 0
            held.append((i, at, part))
            total += len(part)
    if held:
        yield parsed()


def bits_of(grams: DataFrame, size: int) -> np.ndarray:
    """A filter of so many bits with those of these triggers set."""
    slot = F.pmod("gram", F.lit(size))
    words = grams.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(gram, 64) as int)))").alias("bits"))
    got = words.toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def has_bit(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    slot = gram & (8 * len(bits) - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def parse_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram, content, place, again) for each phrase: the trigger's hash, the hash of the bytes of its windows, the first window's place, and
    whether the phrase itself has the trigger again."""

    def make():
        def f(_, texts):
            rows, columns = [], [[], [], [], []]
            for buffer, gram, which, place, size, first, again in phrases(texts):
                view = memoryview(buffer)
                digest = xxhash.xxh3_64_intdigest
                content = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + size + WINDOW - 1).tolist(), strict=True)], dtype=np.uint64).view(np.int64)
                rows.append(which)
                for c, x in zip(columns, (gram, content, place, again), strict=True):
                    c.append(x)
            if not rows:
                return [[], [], [], []], []
            return [pa.array(np.concatenate(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], np.concatenate(rows)

        return f

    return map_texts(docs, [order_key(id_col)], text_col, make, "gram long, content long, place int, again boolean").withColumnRenamed("_k0", "id")


def hit_rows(docs: DataFrame, id_col: str, text_col: str, repeated, varied) -> DataFrame:
    """(id, gram, content, place, size, body) for each phrase whose trigger repeats; body has the bytes of its windows where the trigger has other
    bytes around it elsewhere, once for each run of texts."""

    def make():
        again, other = repeated.value, varied.value

        def f(_, texts):
            rows, columns = [], [[] for _ in range(5)]
            for buffer, gram, which, place, size, first, _ in phrases(texts):
                seen = set()
                for k in np.flatnonzero(has_bit(again, gram)).tolist():
                    a, g = int(first[k]), int(gram[k])
                    bytes_of = buffer[a : a + int(size[k]) + WINDOW - 1]
                    content = xxhash.xxh3_64_intdigest(bytes_of)
                    content -= (content >> 63) << 64
                    new = (g, content) not in seen and has_bit(other, gram[k : k + 1])[0]
                    if new:
                        seen.add((g, content))
                    rows.append(int(which[k]))
                    for c, x in zip(columns, (g, content, int(place[k]), int(size[k]), bytes_of if new else None), strict=True):
                        c.append(x)
            return columns, rows

        return f

    return map_texts(docs, [order_key(id_col)], text_col, make, "gram long, content long, place int, size int, body binary").withColumnRenamed("_k0", "id")


def opened(body: bytes) -> np.ndarray:
    """The windows of a dictionary phrase: its suffixes, as far as a window reaches."""
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(body, np.uint8), WINDOW)


def suffix_ranges(entries: DataFrame) -> DataFrame:
    """(id, place, size) of the windows that stand earlier too, from the dictionary's phrases (gram, body, id, place) dealt and sorted by gram.

    Equal windows have the same trigger, so they are in phrases that follow each other. The suffixes of some of these are put in order, a
    suffix array cut off at a window's length, in which equal windows are neighbours; of these the first in corpus order stays.
    """

    def found(held):
        bodies, ids, places = zip(*held, strict=True)
        parts = [opened(b) for b in bodies]
        sizes = [len(p) for p in parts]
        text = np.ascontiguousarray(np.concatenate(parts)).view(f"V{WINDOW}").ravel()
        own = np.repeat(np.array(ids, dtype=np.int64), sizes)
        place = np.repeat(np.array(places, dtype=np.int64), sizes) + np.concatenate([np.arange(n) for n in sizes])
        corpus = np.lexsort((place, own))
        text, own, place = text[corpus].view(f"S{WINDOW}"), own[corpus], place[corpus]
        array = np.argsort(text, kind="stable")
        raw = text.view(np.uint8).reshape(-1, WINDOW)[array]
        again = np.sort(array[1:][(raw[1:] == raw[:-1]).all(1)])
        own, place = own[again], place[again]
        if not len(own):
            return own, place, place
        start = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)))
        return own[start], place[start], np.diff(np.append(start, len(own)))

    def f(batches):
        held, total, last = [], 0, None
        names = ["id", "place", "size"]
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("gram", "body", "id", "place")], strict=True):
                if row[0] != last and total >= OPENED:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found(held), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=names)
                    held, total = [], 0
                last = row[0]
                held.append(row[1:])
                total += len(row[1]) - WINDOW + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found(held), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=names)

    return entries.select("gram", "body", "id", "place").repartition("gram").sortWithinPartitions("gram").mapInArrow(f, "id long, place int, size int")


def window_rows(entries: DataFrame) -> DataFrame:
    """(h0, h1, id, place): a row for each window of the phrases (body, id, place), by the 128-bit hash of its bytes."""

    def f(batches):
        for batch in batches:
            own, hashes, places = [], [], []
            for i, (body, place) in enumerate(zip(batch.column("body").to_pylist(), batch.column("place").to_pylist(), strict=True)):
                n = len(body) - WINDOW + 1
                own += [i] * n
                hashes += [xxhash.xxh3_128_digest(body[s : s + WINDOW]) for s in range(n)]
                places += range(place, place + n)
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column("id").take(at), pa.array(places, pa.int32())], names=["h0", "h1", "id", "place"])

    return entries.select("body", "id", "place").mapInArrow(f, "h0 long, h1 long, id long, place int")


def later(rows: DataFrame, firsts: DataFrame, key: list[str], total: int) -> DataFrame:
    """The rows, total in all, that aren't the first of their key in corpus order, by id and place. firsts has times, the number of rows with the key; a key
    with very many rows is no task's own."""
    firsts = firsts.withColumnsRenamed({"id": "id0", "place": "place0"})
    return join_one(rows, firsts, key, "times", total).where("id <> id0 or place <> place0").drop("id0", "place0", "times")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ranges): for each document with repeated windows, places and lengths in bytes, as place << 32 | length; they overlap."""
    spark = docs.sparkSession
    # the parse: triggers found once are done with
    rows = parse_rows(docs, id_col, text_col)
    grams = rows.groupBy("gram").agg(F.count("*").alias("times"), F.min("content").alias("low"), F.max("content").alias("high"), F.bool_or("again").alias("again")).where("times > 1 or again")
    grams = written(grams.select("gram", ((F.col("low") != F.col("high")) | F.col("again")).alias("varied")), "triggers")
    size = min(MOST_BITS, 1 << max(20, (BITS_EACH * grams.count()).bit_length()))
    repeated, varied = spark.sparkContext.broadcast(bits_of(grams, size)), spark.sparkContext.broadcast(bits_of(grams.where("varied"), size))
    remove(grams)
    release(spark)
    hits = written(hit_rows(docs, id_col, text_col, repeated, varied), "phrases")
    first = F.min(F.struct("id", "place"))
    # the dictionary: each phrase once, with the place where it stands first
    entries = hits.groupBy("gram", "content").agg(first.alias("first"), F.count("*").alias("times"), F.min("body").alias("body"))
    entries = written(entries.select("gram", "content", "first.id", "first.place", "times", "body"), "dictionary")
    # phrases that stand earlier as a whole
    again = entries.where("times > 1").select("gram", "content", "id", "place", "times")
    whole = later(hits.select("gram", "content", "id", "place", "size"), again, ["gram", "content"], hits.count()).select("id", "place", "size")
    # and windows of other phrases with the same trigger; triggers with very many phrases are opened before they are dealt out
    open_ = entries.where("body is not null").select("gram", "id", "place", "body")
    many = open_.groupBy("gram").count().where(F.col("count") > CROWDED).select("gram")
    table = written(window_rows(open_.join(many, "gram")), "windows")
    firsts = table.groupBy("h0", "h1").agg(first.alias("first"), F.count("*").alias("times")).where("times > 1").select("h0", "h1", "first.id", "first.place", "times")
    parts = later(table, firsts, ["h0", "h1"], table.count()).select("id", "place", F.lit(1).alias("size"))
    parts = parts.unionByName(suffix_ranges(open_.join(many, "gram", "left_anti")))
    span = (F.shiftleft(F.col("place").cast("long"), 32) + F.col("size") + F.lit(WINDOW - 1)).alias("span")
    out = written(whole.unionByName(parts).groupBy("id").agg(F.collect_list(span).alias("ranges")), "ranges")
    remove(hits, entries, table)
    repeated.destroy()
    varied.destroy()
    release(spark)
    return out


def phrase_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and with texts the bytes that are left.

    Each byte covered by WINDOW bytes that also start earlier (in a smaller id, or in the same one before) is removed; windows are judged on
    the input. Null and empty texts, and texts shorter than a window, lose nothing. Rows that repeat an id are one document: equal places in them
    don't remove each other. A null id comes before all others. Other columns are not read.

    The parse has no suffix array of its own: its phrases are put in corpus order by id and place, and equal ones meet by their hash, which is what
    windows of one phrase need, as none reaches beyond it.

    The texts are parsed into phrases at the triggers of a rolling hash. A phrase is named by its bytes with all that its windows cover, so equal
    windows lie in phrases with the same trigger. Phrases that stand earlier as a whole are covered as a whole. Of the rest, the dictionary,
    only phrases with a trigger that other phrases have as well are opened: their suffixes are sorted, and equal ones put in corpus order by
    their phrases' places in the parse. Where more than CROWDED phrases have a trigger, windows are dealt out by a 128-bit hash of their bytes
    before they are compared, so that no trigger is one task's own.
    """
    ranges = repeated_ranges(docs, id_col, text_col)
    joined = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"), order_key(id_col).alias("id")).join(ranges.hint("shuffle_hash"), "id", "left")
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def make():
        def f(heads, block):
            columns = [[] for _ in range(4 + texts)]
            for text, own in zip(block, heads[1], strict=True):
                text, spans = text or b"", 0
                left = text
                if own.is_valid:
                    own = own.values.to_numpy()
                    own = own[(own >> 32) + (own & 0xFFFFFFFF) <= len(text)]
                    change = np.zeros(len(text) + 1, dtype=np.int32)
                    np.add.at(change, own >> 32, 1)
                    np.add.at(change, (own >> 32) + (own & 0xFFFFFFFF), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    spans = int((gone & ~np.append(False, gone[:-1])).sum())
                    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for c, x in zip(columns, (len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), left), strict=False):
                    c.append(x)
            return columns, None

        return f

    return map_texts(joined, [F.col("own"), F.col("ranges")], "text", make, schema).drop("_k1").withColumnRenamed("_k0", id_col)
