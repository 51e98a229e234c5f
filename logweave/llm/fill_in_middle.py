"""Fill-in-the-middle documents, cut at exact units with an indexable skip list.

A unit is a run of ASCII letters or any other single character. The bottom lane is the text itself; the express lanes
above hold ever fewer of the units, each with the number of units and of code points up to the next one of its lane. A cut rank is
reached by going along the highest lane as far as the units allow, then down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import fresh, whole_text
from logweave.llm.words import mix64, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# A unit stands in a lane with this many times the chance of the lane above. Bytes of a text looked at at once.
THIN_BITS = 4
SCAN_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(data: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes start a unit, and which a code point; ``after_letter``: the byte before is a letter."""
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    before = np.empty(len(data), bool)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    return point & ~(letter & before), point


class SkipList:
    """Units of one text (UTF-8 bytes) by rank. Only the express lanes are kept: about a sixteenth of the units."""

    def __init__(self, data: np.ndarray):
        self.data, self.units, self.points = data, 0, 0
        # Lane by lane the units in it: number, code points before it, byte. The start of the text is in every lane.
        found = [np.zeros((1, 3), np.int64)]
        heights = [np.full(1, 64, np.int64)]
        for at in range(0, len(data), SCAN_BYTES):
            part = data[at : at + SCAN_BYTES]
            unit, point = unit_starts(part, at > 0 and bool(_LETTER[data[at - 1]]))
            place = np.flatnonzero(unit)
            number = self.units + np.arange(len(place))
            noise = mix64(number.astype(np.uint64) + np.uint64(1))
            # Height: how many groups of THIN_BITS low bits are all zero.
            low = noise & (~noise + np.uint64(1))
            height = np.where(noise == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // THIN_BITS
            tall = (height > 0) & (number > 0)
            if tall.any():
                passed = np.cumsum(point) - point
                found.append(np.stack([number[tall], self.points + passed[place[tall]], at + place[tall]], axis=1))
                heights.append(height[tall])
            self.units += len(place)
            self.points += int(point.sum())
        nodes, height = np.concatenate(found), np.concatenate(heights)
        top = int(height[1:].max(initial=0))
        lanes = [nodes[height >= k] for k in range(1, top + 1)]
        self.bytes = [lane[:, 2] for lane in lanes]
        ends = np.array([[self.units, self.points]])
        # Widths: units and code points from each node to the next of its lane, or to the end.
        self.widths = [np.diff(np.concatenate([lane[:, :2], ends]), axis=0).tolist() for lane in lanes]
        # Where each node of a lane stands in the lane below.
        self.down = [None, *[np.searchsorted(b[:, 0], a[:, 0]).tolist() for a, b in zip(lanes[1:], lanes[:-1])]]

    def reach(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the unit of this rank; the whole text for the number of units."""
        if rank >= self.units:
            return self.points, len(self.data)
        units = points = node = byte = 0
        for lane in range(len(self.widths) - 1, -1, -1):
            widths = self.widths[lane]
            while units + widths[node][0] <= rank:
                units += widths[node][0]
                points += widths[node][1]
                node += 1
            byte = int(self.bytes[lane][node])
            if lane:
                node = self.down[lane][node]
        # The bottom lane: the text from that node on, looked at in growing pieces.
        left, size, after = rank - units, 256, False
        while True:
            part = self.data[byte : byte + size]
            unit, point = unit_starts(part, after)
            here = np.flatnonzero(unit)
            if len(here) > left:
                stop = int(here[left])
                return points + int(point[:stop].sum()), byte + stop
            left -= len(here)
            points += int(point.sum())
            byte, after, size = byte + len(part), bool(_LETTER[part[-1]]), size * 2


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")]))
def _cuts(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Number of units, and code points before the two cuts in order, each a draw modulo the number of ranks."""
    for column, a, b in texts:
        data, offsets = text_bytes(column)
        out = np.zeros((3, len(column)), np.int64)
        draws = np.stack([np.asarray(a), np.asarray(b)])
        for k in range(len(column)):
            units = SkipList(data[offsets[k] : offsets[k + 1]])
            ranks = np.sort(draws[:, k] % (units.units + 1)).tolist()
            out[:, k] = units.units, units.reach(ranks[0])[0], units.reach(ranks[1])[0]
        yield pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "first", "second"])


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a further column ``fim``: n, form, prefix_chars, middle_chars and output of each whole text.

    Units are ``[A-Za-z]+|[^A-Za-z]``. Four draws come from the SHA-256 of seed, colon and id: two cut ranks among the n + 1,
    whether the text is rearranged at all (``rate`` in 100), and whether the suffix goes first (``spm_rate`` in 100). ``form``
    is psm, spm or plain; texts that are empty or hold one of the markers are plain, their counts of characters null.

    A null text is empty, a null id draws like the empty text. Rows repeat as they are, and equal ids with equal texts get equal
    cuts; an empty table gives no rows. An existing column ``fim`` stays, the new one is then called ``fim_``.
    """
    text = whole_text(F.col(text_col).cast("string"))
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(code, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), F.lit("plain")).when(h[3] % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm"))
    name, inner = fresh("fim", docs.columns), fresh("_cut", docs.columns)
    cut = docs.withColumn(inner, _cuts(text, h[0], h[1]))
    a, b = F.col(inner)["first"], F.col(inner)["second"]
    prefix, middle = F.substring(text, F.lit(1), a.cast("int")), F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    suffix = F.substring(text, (b + 1).cast("int"), F.char_length(text))
    output = (
        F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    made = F.struct(
        F.col(inner)["n"].alias("n"),
        form.alias("form"),
        F.when(form != "plain", a).alias("prefix_chars"),
        F.when(form != "plain", b - a).alias("middle_chars"),
        output.alias("output"),
    )
    return cut.withColumn(name, made).drop(inner)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` started from."""
    first, second, third = len(PREFIX), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    body = F.substring(output, F.lit(first + 1), F.char_length(output))
    at, last = F.position(second, body), F.position(third, body)
    one = F.substring(body, F.lit(1), at - 1)
    two = F.substring(body, at + first, last - at - first)
    three = F.substring(body, last + first, F.char_length(body))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
