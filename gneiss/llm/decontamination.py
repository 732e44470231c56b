"""Benchmark decontamination by templates.

Texts are read as tokens (runs of letters and digits); numbers, names and units become typed placeholders, so a
question asked again with other values has the same template. The windows of the templates of documents and of the
benchmark are two tables that are joined by hash. Matches of a document and an item that lie on one diagonal make an
alignment, and its slots must be consistent: two slots of the item hold the same value exactly if they do in the
document. What is left must cover enough of the item.

Three readings are hashed: with names as placeholders; with names as plain words, so that a copy in other case is
found too; and with plain words only, so that a copy as it stands is found whatever it is made of. A window needs
at least half plain words.

Before the join, windows of documents go through a bit table of the benchmark's hashes. The table has a largest
size, however large the benchmark is: a fuller table lets more windows through to the join and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.store import cut
from gneiss.llm.words import LOWER, M1, M2, M3, POWERS, as_bytes, grams, mix, small

# Unit words that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "g kg mg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons tonne tonnes l ml litre litres liter liters gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms "
    "usd eur gbp dollar dollars euro euros cent cents yen percent degrees degree k c f w kw kwh v volt volts a amp amps hz khz mhz ghz b kb mb gb tb mph kph"
).split()
# Numbers written as words.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion"
).split()
ALNUM = np.array([(b < 128 and chr(b).isalnum()) or b >= 128 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
STOP = np.array([chr(b) in ".!?\n" for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3


class Tokens:
    """The tokens of some texts end to end: place in the data, lower-case hash, kind, and the text they belong to."""

    def __init__(self, texts: list[bytes | None]):
        data = np.frombuffer(b"\n".join([b"", *(t or b"" for t in texts), b"\n"]), np.uint8)
        word = ALNUM[data]
        digit = DIGIT[data]
        inner = (data == 46) | (data == 44)  # a point or comma between digits belongs to the number
        word[1:-1] |= inner[1:-1] & digit[:-2] & digit[2:]
        turn = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.begin, self.end = turn[::2], turn[1::2]
        up, down = POWERS(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LOWER[data] * up, out=total[1:])
        self.h = mix((total[self.end] - total[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64) * M2)
        n = len(self.h)
        self.kind = np.zeros(n, np.int8)
        digits = np.concatenate([[0], np.cumsum(digit)])
        number = (digits[self.end] > digits[self.begin]) | np.isin(self.h, NUMBER_HASHES)
        stops = np.concatenate([[0], np.cumsum(STOP[data])])
        before = np.concatenate([[0], self.end[:-1]])
        starts = stops[self.begin] > stops[before] if n else np.zeros(0, bool)
        first, second = data[self.begin], data[self.begin + 1]
        capital = UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        self.kind[capital & ~starts] = NAME
        self.kind[number] = NUMBER
        after = np.flatnonzero(number[:-1]) + 1
        self.kind[after[np.isin(self.h[after], UNIT_HASHES) & (self.kind[after] == PLAIN)]] = UNIT
        sizes = np.array([len(t or b"") + 1 for t in texts])
        self.offset = np.cumsum(sizes) - sizes + 1
        self.start = np.searchsorted(self.begin, self.offset)
        self.size = np.diff(np.append(self.start, n))
        self.of = np.repeat(np.arange(len(texts)), self.size)

    def readings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(template hashes, kinds): all placeholders, all but names, none."""
        out = []
        for kind in (self.kind, np.where(self.kind == NAME, PLAIN, self.kind), np.zeros_like(self.kind)):
            out.append((np.where(kind == PLAIN, self.h, mix(kind.astype(np.uint64) + M3)), kind))
        return out


UNIT_HASHES = NUMBER_HASHES = np.zeros(0, np.uint64)
NUMBER_HASHES = np.unique(Tokens([" ".join(NUMBER_WORDS).encode()]).h)
READING_SALTS = np.arange(3, dtype=np.uint64) * M2
UNIT_HASHES = np.unique(Tokens([" ".join(UNITS).encode()]).h)


def window_hashes(h: np.ndarray, kind: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows inside one text with at least half plain words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    plain = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    at = np.flatnonzero((of[:n] == of[size - 1 :]) & (2 * (plain[size:] - plain[:-size])[:n] >= size))
    return at, grams(h, size, M1)[at] + np.uint64(size)


def slots_of(tokens: Tokens, at: np.ndarray, size: int, reading: int) -> tuple[pa.Array, pa.Array]:
    """The kinds and the values (hashes) of the slots of each window, in order."""
    kinds = tokens.kind[at[:, None] + np.arange(size)]
    slot = (kinds == NUMBER) | (kinds == UNIT) | ((kinds == NAME) & (reading == 0)) if reading < 2 else np.zeros(kinds.shape, bool)
    ends = pa.array(np.concatenate([[0], np.cumsum(slot.sum(axis=1))]).astype(np.int32))
    values = tokens.h[at[:, None] + np.arange(size)][slot].view(np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(kinds[slot])), pa.ListArray.from_arrays(ends, pa.array(values))


def windows(tokens: Tokens, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(reading, size, start, key) of all windows."""
    for reading, (h, kind) in enumerate(tokens.readings()):
        for size in sizes:
            at, keys = window_hashes(h, kind, tokens.of, size)
            if len(at):
                yield reading, size, at, mix(keys + READING_SALTS[reading])


def texts_at_once(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[tuple[list, list, list]]:
    """(ids, versions, texts) of about ``most`` bytes, or one longer text."""
    ids, versions, texts, n = [], [], [], 0
    for b in small(batches):
        for i, v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
            ids.append(i)
            versions.append(v)
            texts.append(t)
            n += len(t or b"")
            if n > most:
                yield ids, versions, texts
                ids, versions, texts, n = [], [], [], 0
    if ids:
        yield ids, versions, texts


ITEM = "key long, item_id long, item_version long, item_at int, size int, n_tokens int, kinds array<tinyint>, item_slots array<long>"
DOC = "key long, doc_id long, version long, at int, doc_slots array<long>"


def item_windows(size: int, shortest: int):
    """Rows (item_id, version, text) -> ITEM: windows of ``size`` tokens, or the whole of a shorter item; of an item
    of fewer than ``shortest`` tokens the literal reading only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, versions, texts in texts_at_once(batches):
            t = Tokens(texts)
            ids, versions = np.array(ids, np.int64), np.array(versions, np.int64)
            for reading, s, at, key in windows(t, sorted({min(size, int(n)) for n in t.size if n})):
                n = t.size[t.of[at]]
                own = (np.minimum(n, size) == s) & ((n >= shortest) | (reading == 2))
                at, key = at[own], key[own]
                of = t.of[at]
                kinds, values = slots_of(t, at, s, reading)
                cols = [key.view(np.int64), ids[of], versions[of], (at - t.start[of]).astype(np.int32), np.full(len(at), s, np.int32), t.size[of].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), kinds, values], ["key", "item_id", "item_version", "item_at", "size", "n_tokens", "kinds", "item_slots"])

    return run


def doc_windows(sizes: list[int], bits: int, table):
    """Rows (doc_id, version, text) -> DOC: the windows whose hash the bit table knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, versions, texts in texts_at_once(batches):
            t = Tokens(texts)
            ids, versions = pa.array(ids, pa.int64()), pa.array(versions, pa.int64())
            for reading, s, at, key in windows(t, sizes):
                low = key & np.uint64(bits - 1)
                maybe = np.flatnonzero((table.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1))
                if len(maybe):
                    at, key = at[maybe], key[maybe]
                    of = t.of[at]
                    _, values = slots_of(t, at, s, reading)
                    place = pa.array((at - t.start[of]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(of)), versions.take(pa.array(of)), place, values], ["key", "doc_id", "version", "at", "doc_slots"])

    return run


class Alignment:
    """Matches of one document and one item on one diagonal, in the order of the item. A slot's value is bound where
    it first occurs, either way; a window with a slot bound otherwise does not count."""

    def __init__(self):
        self.to_doc: dict[tuple[int, int], int] = {}
        self.to_item: dict[tuple[int, int], int] = {}

    def agrees(self, kinds: list[int], item: list[int], doc: list[int]) -> bool:
        here: dict[tuple[int, int], int] = {}
        back: dict[tuple[int, int], int] = {}
        for t, x, y in zip(kinds, item, doc, strict=True):
            if self.to_doc.get((t, x), y) != y or self.to_item.get((t, y), x) != x or here.setdefault((t, x), y) != y or back.setdefault((t, y), x) != x:
                return False
        self.to_doc |= here
        self.to_item |= back
        return True


def judge(enough: int, share: float):
    """Matches in the order of (document, item, diagonal, place in the item) -> items that are found."""
    names = ["doc_id", "version", "item_id", "n_windows", "n_covered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = line = None
        places: set[int] = set()
        starts: set[int] = set()
        n_windows = n_tokens = 0

        def verdict() -> list[tuple]:
            n = n_windows + len(starts)
            return [(pair[0], pair[1], pair[2], n, len(places))] if pair and n and len(places) >= min(enough, -(-share * n_tokens // 1)) else []

        for b in small(batches, 4096):
            out = []
            cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for i, v, item, iv, diagonal, at, s, n, kinds, item_slots, doc_slots in zip(*cols, strict=True):
                if (i, v, item, iv) != pair:
                    out += verdict()
                    pair, line, places, starts, n_windows, n_tokens = (i, v, item, iv), None, set(), set(), 0, n
                if diagonal != line:
                    n_windows += len(starts)
                    line, alignment, starts = diagonal, Alignment(), set()
                if alignment.agrees(kinds, item_slots, doc_slots):
                    starts.add(at)
                    places.update(range(at, at + s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
        if out := verdict():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return run


def bit_table(items: DataFrame, most_bits: int) -> tuple[int, np.ndarray]:
    """(number of bits, words) of a table with a bit for each key; 32 bits a key, up to ``most_bits``."""
    n = items.count()
    bits = min(1 << 16, most_bits)
    while bits < most_bits and bits < 32 * n:
        bits *= 2
    low = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = items.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 AS int))")).alias("bits"))  # at most most_bits / 64 rows
    got = words.toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[np.asarray(got["word"])] = np.asarray(got["bits"]).view(np.uint64)
    return bits, table


def found(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, shortest: int = 5, enough: int = 13, share: float = 0.5, most_bits: int = 1 << 26) -> DataFrame:
    """(doc_id, version, item_id, n_windows, n_covered); ``version`` is a hash of the text, so that texts that share
    an id are told apart."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    asked = cut(items.select("item_id", F.xxhash64("text").alias("version"), "text").mapInArrow(item_windows(size, shortest), ITEM))
    sizes = sorted(r.size for r in asked.select("size").distinct().collect())  # no more than ``size`` of them
    bits, table = bit_table(asked, most_bits)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    here = d.mapInArrow(doc_windows(sizes, bits, shared), DOC)
    both = here.join(asked, "key").select("doc_id", "version", "item_id", "item_version", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "size", "n_tokens", "kinds", "item_slots", "doc_slots")
    pair = ["doc_id", "version", "item_id", "item_version"]
    # equal rows of one document follow each other and change nothing
    both = both.repartition(*pair).sortWithinPartitions(*pair, "diagonal", "item_at", F.size("kinds").desc(), "size")
    one = both.mapInArrow(judge(enough, share), "doc_id long, version long, item_id long, n_windows long, n_covered long")
    return one.groupBy("doc_id", "version", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_covered").alias("n_covered"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_windows, n_covered): each document with each benchmark item found in it.

    Found means that consistent windows of ``size`` template tokens cover at least ``enough`` tokens of the item,
    or ``share`` of it if that is less. An item shorter than a window is one window; an item of fewer than
    ``shortest`` tokens is found only where it stands literally. Items with a null id or text, or without a token,
    take no part. Null and empty documents hold nothing; rows that repeat an id with its text are one document, with
    another text they are documents of their own. Texts are read whole, benchmarks of any size are joined whole.
    Other options: see ``found``.
    """
    return found(docs, benchmark, **options).select("doc_id", "item_id", "n_windows", "n_covered")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, judged by their own id and text, null ids too."""
    bad = found(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("__gneiss_bad"), F.col("version").alias("__gneiss_version")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(bad["__gneiss_bad"]) & (F.xxhash64(docs[text_col]) == bad["__gneiss_version"])
    return docs.join(bad, same, "left_anti")


def op3_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
