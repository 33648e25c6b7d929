"""Fill-in-the-middle: prefix, middle and suffix of each text, cut between units.

A unit is a run of ASCII letters or one other code point.  Texts are laid end to
end and read as 64-bit words.  Arithmetic on whole words marks the bytes that end
a unit, eight at a time; counting the marks per word and adding up gives the
number of units before any byte.  The k-th end is found by a search among those
sums and by a select inside one word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
ADDED = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}
TEXTS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 22

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)


def _every(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


def letters(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is an ASCII letter."""
    small = words & _LOW7 | _every(0x20)
    return small + _every(0x80 - ord("a")) & ~(small + _every(0x80 - ord("z") - 1)) & ~words & _HIGH


def inner(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that continues a code point."""
    return words & ~(words << np.uint64(1)) & _HIGH


def _next_byte(marks: np.ndarray) -> np.ndarray:
    """At each byte, the mark of the byte after it."""
    after = np.append(marks[1:], np.uint64(0))
    return marks >> np.uint64(8) | after << np.uint64(56)


class Marked:
    """Marked bytes of a buffer, with the number of marks before any byte."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marks in front of each byte offset."""
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        inside = np.bitwise_count(self.marks[word] & ((np.uint64(1) << bits) - np.uint64(1)))
        return self.upto[word] - np.bitwise_count(self.marks[word]) + inside

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte offset of each mark, counted from 1."""
        word = np.searchsorted(self.upto, rank)
        word_marks = self.marks[word]
        left = (rank - self.upto[word] + np.bitwise_count(word_marks)).astype(np.uint64)
        # Each byte of the product counts the marks up to it.
        sums = (word_marks >> np.uint64(7)) * _ONES
        reached = sums + (np.uint64(0x80) - left) * _ONES & _HIGH
        return 8 * word + 8 - np.bitwise_count(reached)


def cuts(texts: Sequence[bytes], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of each text, the two byte offsets where it is cut, and the code points of its first two parts.

    ``first`` and ``second`` are any non-negative numbers; their remainders by
    the number of possible cuts say after how many units the cuts fall.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    start, total = end - size, int(end[-1]) if len(end) else 0
    words = np.frombuffer(b"".join(texts) + bytes(16 - total % 8), "<u8")
    within = inner(words)
    letter = letters(words)
    ends = ~_next_byte(within) & ~(letter & _next_byte(letter)) & _HIGH
    last = end[size > 0] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
    units, points = Marked(ends), Marked(~within & _HIGH)
    base = units.before(start)
    n = units.before(end) - base
    one, two = first % (n + 1), second % (n + 1)

    def offset(k: np.ndarray) -> np.ndarray:
        at = start.copy()
        some = k > 0
        at[some] = units.select(base[some] + k[some]) + 1
        return at

    a, b = offset(np.minimum(one, two)), offset(np.maximum(one, two))
    p, q, r = points.before(start), points.before(a), points.before(b)
    return n, a - start, b - start, q - p, r - q


def _draws(seed: int, id_col: str) -> list[Column]:
    """Four 32-bit numbers from the hash of the seed and the id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, marks: Sequence[str] = MARKS
) -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``percent`` of the texts are rearranged, ``spm_percent`` of those with the
    suffix first; where the cuts fall depends on seed and id alone.  Null and
    empty texts, and texts that hold a mark, keep form ``plain`` and have null
    lengths.  Rows with the same id are cut by the same numbers; a null id
    counts as an empty one.  A text of any length is read whole.  All other
    columns stay, and one named like an added one is replaced; ``output`` of a
    plain text is the text.  The work is a map: nothing is shuffled.
    """
    if len(set(marks)) != 3 or any(a[:k] == b[-k:] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
        raise ValueError("marks must differ and none may begin as another ends")
    head, tail, mid = (m.encode() for m in marks)
    h = _draws(seed, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = (text == "") | (h[2] % 100 >= percent)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    fields = [f"c{i}" for i in range(len(kept))]
    source = docs.select(*[F.col(f.name).alias(c) for f, c in zip(kept, fields)], text.alias("text"), form.alias("form"), h[0].alias("one"), h[1].alias("two"))

    def arrange(form: str, text: bytes, a: int, b: int) -> bytes:
        if form == "plain":
            return text
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if form == "spm":
            return b"".join((tail, suffix, head, prefix, mid, middle))
        return b"".join((head, prefix, tail, suffix, mid, middle))

    def some(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part["text"].cast(pa.binary()).to_pylist()
        n, a, b, before, inside = cuts(texts, part["one"].to_numpy(), part["two"].to_numpy())
        forms = part["form"].to_pylist()
        out = list(map(arrange, forms, texts, a.tolist(), b.tolist()))
        hidden = np.fromiter((f == "plain" for f in forms), bool, len(forms))
        made = [pa.array(n), part["form"], pa.array(before, mask=hidden), pa.array(inside, mask=hidden), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*(part[c] for c in fields), *made], names=[*(f.name for f in kept), *ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            size = pc.binary_length(batch["text"]).to_numpy()
            while at < batch.num_rows:
                near = size[at : at + TEXTS_AT_ONCE].cumsum()
                n = max(1, int(np.searchsorted(near, BYTES_AT_ONCE, "right")))
                yield some(batch.slice(at, n))
                at += n

    return source.mapInArrow(run, StructType([*kept, *(StructField(n, t) for n, t in ADDED.items())]))


def restored(marks: Sequence[str] = MARKS) -> Column:
    """The exact text, rebuilt from ``form`` and ``output`` alone."""
    head, tail, mid = marks
    out = F.col("output")
    body, middle = F.substring_index(out, mid, 1), F.substring_index(out, mid, -1)

    def rest(parts: Column, first: str) -> Column:
        return F.substring(parts, len(first) + 1, 2**31 - 1)

    psm = F.concat(rest(F.substring_index(body, tail, 1), head), middle, F.substring_index(body, tail, -1))
    spm = F.concat(F.substring_index(body, head, -1), middle, rest(F.substring_index(body, head, 1), tail))
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out)
