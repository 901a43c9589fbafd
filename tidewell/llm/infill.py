"""Fill-in-the-middle: texts cut in three and put together so that the middle comes last.

Where a text is cut is counted in units: characters (code points), words or lines.
Each byte of a text has a class that says which units begin there; a wavelet matrix
over the classes of a batch of texts counts, for any byte, the bytes of each class
before it.  Ranks of the classes that begin a unit add up to the units before a byte, and
bisection on that sum finds the byte of a cut, for all texts of a batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import drawn_numbers, in_small_batches

#: A class is three bits: a character, a word, a line begins here.
CHARACTER, WORD_START, LINE_START = 1, 2, 4
LEVELS = 3
#: The classes in which a unit begins; a word or a line begins with a character.
UNITS = {"character": (1, 3, 5, 7), "word": (3, 7), "line": (5, 7)}
#: Prefix, suffix and middle follow these.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and of 100 of those so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of the texts that one matrix covers; a longer text has one of its own.
MATRIX_BYTES = 4 << 20


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of some texts end to end; ``starts`` are the first bytes of texts that have any."""
    character = (data & 0xC0) != 0x80
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    first = np.zeros(len(data), bool)
    first[starts] = True
    after_blank, after_line = np.ones(len(data), bool), np.ones(len(data), bool)
    after_blank[1:], after_line[1:] = blank[:-1], data[:-1] == 0x0A
    character |= first
    word = character & ~blank & (after_blank | first)
    line = character & (after_line | first)
    return character * np.uint8(CHARACTER) | word * np.uint8(WORD_START) | line * np.uint8(LINE_START)


class WaveletMatrix:
    """Ranks over a sequence of small classes.

    A level holds one bit of every class, most significant first; below a level the
    classes with a 0 come first, in order, then those with a 1.  Bits are packed into
    words of 64 with the count of ones before each word.
    """

    def __init__(self, sequence: np.ndarray, levels: int = LEVELS):
        self.levels, self.size = levels, len(sequence)
        self.words, self.ones, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(sequence) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64))))
            self.zeros.append(len(sequence) - int(bit.sum()))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & below)

    def rank(self, c: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` members are of class ``c``."""
        ends = np.concatenate((np.asarray(at, np.int64), [0]))
        for level in range(self.levels):
            ones = self._ones_before(level, ends)
            ends = self.zeros[level] + ones if c >> (self.levels - 1 - level) & 1 else ends - ones
        return ends[:-1] - ends[-1]

    def boundaries(self, unit: str, at: np.ndarray) -> np.ndarray:
        """How many units begin before ``at``."""
        return sum(self.rank(c, at) for c in UNITS[unit])

    def cuts(self, unit: str, first: np.ndarray, last: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The last place in ``first`` to ``last`` that has no more than ``count`` units between ``first`` and itself."""
        low, high = first.astype(np.int64), last.astype(np.int64)
        most = self.boundaries(unit, low) + count
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.boundaries(unit, middle) <= most
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _groups(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``size`` bytes together, one text at least."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, end
        start = end


def cut_places(texts: pa.Array, draws: tuple[np.ndarray, np.ndarray], unit: str = "character", size: int = MATRIX_BYTES) -> tuple[np.ndarray, ...]:
    """Per text: its units, the units before both cuts, and the bytes before both cuts.

    A cut comes after ``draw % (units + 1)`` units; the smaller of the two is the first.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    out = np.zeros((5, len(texts)), np.int64)
    for a, b in _groups(offsets, size):
        at = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        first, last = at[:-1], at[1:]
        matrix = WaveletMatrix(classes(part, first[first < last]))
        units = matrix.boundaries(unit, last) - matrix.boundaries(unit, first)
        one, two = draws[0][a:b] % (units + 1), draws[1][a:b] % (units + 1)
        one, two = np.minimum(one, two), np.maximum(one, two)
        out[:, a:b] = units, one, two, matrix.cuts(unit, first, last, one) - first, matrix.cuts(unit, first, last, two) - first
    return tuple(out)


def _cutter(unit: str) -> Callable[[Column, Column, Column], Column]:
    """Both cuts of binary texts as a column of structs."""
    names = ("units", "first_units", "second_units", "first_bytes", "second_bytes")

    @F.arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in names) + ">")
    def cut(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        places = cut_places(texts, (one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)), unit)
        return pa.StructArray.from_arrays([pa.array(p) for p in places], names=list(names))

    return cut


def joined(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text in its form: prefix, suffix, middle; or suffix, prefix, middle; or plain."""
    p, s, m = map(F.lit, markers)
    psm = F.concat(p, prefix, s, suffix, m, middle)
    spm = F.concat(s, suffix, p, prefix, m, middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of.

    A text with a marker in it stays plain, and no marker ends as it begins, so the first
    of each marker is the one that was put there.
    """
    p, s, m = (re.escape(x) for x in markers)
    parts = lambda one, two: F.split(output, f"{one}|{two}|{m}", 4)
    psm, spm = parts(p, s), parts(s, p)
    at = lambda a, i: F.get(a, F.lit(i))
    return F.when(form == "psm", F.concat(at(psm, 1), at(psm, 3), at(psm, 2))).when(form == "spm", F.concat(at(spm, 2), at(spm, 3), at(spm, 1))).otherwise(output)


def infilled(
    docs: DataFrame,
    unit: str = "character",
    seed: int = 1,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    markers: tuple[str, str, str] = MARKERS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Every document cut in three and put together with its middle last.

    Returns ``doc_id, n, form, prefix_units, middle_units, prefix, middle, suffix, output``, one
    row per input row; ``n`` counts the text's units.  ``form`` is ``psm``, ``spm`` or ``plain``: texts that are
    empty or hold a marker stay plain, and of the others ``100 - transformed`` in 100.
    Of a plain text the units and parts are null and the output is the text.  A null
    text counts as empty.  Cuts depend on the seed, the id and the text's units alone, so
    repeated rows are cut alike, and so are texts of one length without an id.
    """
    if unit not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    if len(set(markers)) < 3 or any(_overlaps(x, y) for x in markers for y in markers):
        raise ValueError("markers must differ, be none of them within another, and end in nothing that one of them begins with")
    h1, h2, h3, h4 = drawn_numbers(F.col(doc_id), seed)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = in_small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    rows = rows.withColumn("cut", _cutter(unit)(F.col("text").cast("binary"), F.col("h1"), F.col("h2")))
    marked = F.lit(False)
    for x in markers:
        marked |= F.contains("text", F.lit(x))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= transformed)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"))
    data, one, two = F.col("text").cast("binary"), F.col("cut.first_bytes").cast("int"), F.col("cut.second_bytes").cast("int")
    part = lambda first, size: F.when(F.col("form") != "plain", F.substring(data, first, size).cast("string"))
    rows = rows.withColumns(
        {
            "prefix": part(F.lit(1), one),
            "middle": part(one + 1, two - one),
            "suffix": part(two + 1, F.length(data) - two),
        }
    )
    units = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select(
        "doc_id",
        F.col("cut.units").alias("n"),
        "form",
        units(F.col("cut.first_units")).alias("prefix_units"),
        units(F.col("cut.second_units") - F.col("cut.first_units")).alias("middle_units"),
        "prefix",
        "middle",
        "suffix",
        joined(F.col("form"), F.col("text"), F.col("prefix"), F.col("middle"), F.col("suffix"), markers).alias("output"),
    )


def _overlaps(x: str, y: str) -> bool:
    """Whether an end of ``x`` begins ``y``, or one lies in the other; for one and the same, whether a shorter end does."""
    if x != y and (x in y or y in x):
        return True
    return not x or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)) + (x != y)))
