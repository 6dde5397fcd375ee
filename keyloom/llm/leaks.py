"""Passages of held-out test items in a large corpus.

Texts are reduced to words (or, for items in Chinese, to letters): markup, citations, comment signs,
line breaks, punctuation and case go, accents written as macros become letters. Every window of
``WORDS`` words (``LETTERS`` letters) of an item is a pattern, and documents are searched for all
patterns at once after Wu and Manber: the block of words at a window's end tells, by a shift table,
how far the window can move; only where the shift is zero a bucket of patterns with that suffix
block is looked up, their first block is tested, and the words are compared.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.runtime import durable, spread

#: A passage is this long at least.
WORDS, LETTERS = 12, 20
#: Words or letters of a block.
BLOCK = 3
#: Items are searched for in sets of at most this many characters; a set is what is sent to every task.
SET_CHARS = 8_000_000

# Combining marks of the accent macros, and letters that have a macro of their own.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
LETTER_MACROS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "i": "i", "j": "j"}

_ACCENT = re.compile(r"\{?\\(?:(['`^\"~=.])\s*|([cvuHkrdb])(?:\s+|(?=\{)))(?:\{\\?([^\W\d_])\}|\\?([^\W\d_]))(\}?)")
_LETTER = re.compile(r"\{?\\(ss|o|O|l|L|ae|AE|oe|OE|aa|AA|i|j)(?![a-zA-Z])(?:\{\}|\s+|\})?")
_CITE = re.compile(r"\\(?:[cC]ite[a-zA-Z]*|nocite|[a-zA-Z]*ref|label|footnotemark)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
_COMMAND = re.compile(r"\\(?:begin|end)\{[^{}]*\}|\\[a-zA-Z@]+\*?|\\[\\ ,;:!/]|[~%]")
_NOISE = re.compile(r"[^\w\s]|_")
_HAN = re.compile("[\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _accented(m: re.Match) -> str:
    mark, named, braced, bare, close = m.groups()
    whole = m.group().startswith("{") and close
    return unicodedata.normalize("NFC", (braced or bare) + ACCENTS[mark or named]) + ("" if whole or not close else close)


def plain(text: str) -> str:
    """The text's words in lower case with single blanks kept between them as they come; nothing else is left."""
    if "\\" in text:
        if _ACCENT.search(text):
            text = _ACCENT.sub(_accented, text)
        text = _LETTER.sub(lambda m: LETTER_MACROS[m.group(1)], text)
        text = _CITE.sub("", text)
    text = unicodedata.normalize("NFC", _COMMAND.sub(" ", text))
    return _NOISE.sub("", text).lower()


def is_han(text: str) -> bool:
    """Whether most letters of a text are Chinese characters (Japanese kana or other letters are not)."""
    letters = sum(map(str.isalpha, text))
    return letters > 0 and 2 * len(_HAN.findall(text)) > letters


class Patterns(NamedTuple):
    """Search tables for all windows of ``length`` units of some items."""

    length: int
    shift: dict
    bucket: dict
    units: list


def compile_patterns(items: Sequence[Sequence[str]], length: int) -> Patterns:
    """Shift table and suffix buckets. ``items``: each a list of words, or a string of letters."""
    shift, bucket = {}, {}
    for k, u in enumerate(items):
        for end in range(BLOCK, len(u) + 1):
            key = u[end - BLOCK : end] if isinstance(u, str) else tuple(u[end - BLOCK : end])
            if len(u) < length:
                continue
            # a window ends here, or as much further on as the item's first window asks for
            step = max(0, length - end)
            if step < shift.get(key, length):
                shift[key] = step
            if step == 0:
                bucket.setdefault(key, []).append((k, end))
    return Patterns(length, shift, bucket, list(items))


def search(units: Sequence[str], p: Patterns) -> set[int]:
    """Numbers of the items with a window in ``units``."""
    found: set[int] = set()
    n, length, shift, bucket = len(units), p.length, p.shift.get, p.bucket
    most, text = length - BLOCK + 1, isinstance(units, str)
    i = length
    while i <= n:
        key = units[i - BLOCK : i] if text else (units[i - 3], units[i - 2], units[i - 1])
        step = shift(key, most)
        if step:
            i += step
            continue
        low = i - length
        for k, end in bucket[key]:
            if k not in found:
                u = p.units[k]
                if u[end - length] == units[low] and u[end - length : end] == units[low:i]:
                    found.add(k)
        i += 1
    return found


class Matcher(NamedTuple):
    """Tables for items in words and items in Chinese letters."""

    words: Patterns
    word_ids: list
    letters: Patterns
    letter_ids: list


def matcher(items: Sequence[tuple[int, str]]) -> Matcher:
    """Search tables for (item_id, text) pairs."""
    words, letters = [], []
    for i, t in items:
        (letters if is_han(t) else words).append((i, plain(t)))
    return Matcher(compile_patterns([t.split() for _, t in words], WORDS), [i for i, _ in words], compile_patterns(["".join(t.split()) for _, t in letters], LETTERS), [i for i, _ in letters])


def leaked(text: str, m: Matcher) -> list[int]:
    """Item ids with a passage in ``text``."""
    return found_in(plain(text), m)


def found_in(flat: str, m: Matcher) -> list[int]:
    """The same of a text in its ``plain`` form."""
    words = flat.split()
    ids = [m.word_ids[k] for k in search(words, m.words)]
    if m.letter_ids and _HAN.search(flat):
        ids += [m.letter_ids[k] for k in search("".join(words), m.letters)]
    return ids


def _scan(batches: Iterator[pa.RecordBatch], tables, flat: bool) -> Iterator[pa.RecordBatch]:
    m = tables.value
    for b in batches:
        docs, items = [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = found_in(t, m) if flat else leaked(t, m)
            docs += [d] * len(got)
            items += got
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([plain(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def find_leaks(docs: DataFrame, items: DataFrame, set_chars: int = SET_CHARS) -> DataFrame:
    """One row (doc_id, item_id) for each document and test item that share a passage.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are not read. Null, empty and
    short texts match nothing; rows of equal ids count as one. Items beyond ``set_chars`` characters
    in all are split by id into sets, searched for one after the other: the texts are then reduced once,
    to a copy, and the driver and the tasks hold the tables of one set at a time.
    """
    spark = docs.sparkSession
    usable = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    sets = -(-total // set_chars) or 1
    texts = spread(docs.filter(F.length("text") >= LETTERS).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if sets > 1:
        texts = durable(texts.mapInArrow(_plain, "doc_id long, text string"))
    out = None
    for k in range(sets):
        part = usable.filter(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == k) if sets > 1 else usable
        # bounded by set_chars; shared by all tasks of an executor
        tables = spark.sparkContext.broadcast(matcher([(r[0], r[1]) for r in part.collect()]))
        got = texts.mapInArrow(lambda b, t=tables: _scan(b, t, sets > 1), "doc_id long, item_id long")
        if sets > 1:
            got = durable(got)
            tables.unpersist()
        out = got if out is None else out.union(got)
    return out.distinct()
