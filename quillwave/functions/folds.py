"""Decisions that go from left to right through the parts of a text, one number per part.

What a part is (its word count, length or kind) is told by column functions; Python only goes through these numbers, in one
Arrow batch for many texts. The work is linear in the number of parts, whatever the length of the text. A batch is gone
through in slices of PIECE bytes of text, each given back before the next: what Python holds beside the batch does not grow
with the number of texts in it.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bytes of text in a slice of a batch; a single longer text is a slice of its own.
PIECE = 1 << 20


def _sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches, of texts or of lists of (text, number), in slices of whole rows of about PIECE bytes of text."""
    for b in batches:
        texts, at = b, np.arange(len(b) + 1)
        if not pa.types.is_string(b.type):
            texts, at = b.flatten().field(0), b.offsets.to_numpy() - b.offsets[0].as_py()
        size = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)][at]
        start = 0
        while start < len(b):
            stop = max(start + 1, int(np.searchsorted(size, size[start] + PIECE, "right")) - 1)
            yield b.slice(start, stop - start)
            start = stop


#: White space of the rules; str.isspace has four control characters more.
_WORD_KINDS = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc"}
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"



@cache
def _word_class() -> str:
    """What the Unicode word class of the column patterns holds, as ranges: letters, marks, digits, connectors, circled letters, joiners."""
    inside = [unicodedata.category(chr(i)) in _WORD_KINDS or 0x24B6 <= i <= 0x24E9 or any(a <= i <= a + 25 for a in (0x1F130, 0x1F150, 0x1F170)) or i in (0x200C, 0x200D) for i in range(0x110000)]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


def _either(letter: str) -> str:
    return letter.lower() + letter.upper() + {"s": "ſ", "k": "\u212a"}.get(letter.lower(), "")


def _begins(words: list[str], not_behind: str = "") -> str:
    """One of the words in any case, not behind a word's character or one of `not_behind`. The first letter comes first: few places have it."""
    firsts = dict.fromkeys(w[0].lower() for w in words)
    tails = "|".join(f"(?<=[{_either(c)}])(?i:{'|'.join(w[1:] for w in words if w[0].lower() == c)})" for c in firsts)
    return f"[{''.join(map(_either, firsts))}](?<![{_word_class()}{not_behind}].)(?:{tails})"


def _replaced(text: Column, *rules: tuple) -> Column:
    """The text with each (pattern, what stands for a match) in turn."""
    compiled = [(re.compile(pattern, re.S), new) for pattern, new in rules]

    def change(text: str) -> str:
        for pattern, new in compiled:
            text = pattern.sub(new, text)
        return text

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in _sliced(batches):
            yield pa.array([None if t is None else change(t) for t in b.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


def with_words(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole words of any case replaced in one pass; no replacement holds another listed word."""
    said = {word.replace("\\.", ".").lower(): new for word, new in pairs}
    return _replaced(text, (rf"{_begins([w for w, _ in pairs])}(?![{_word_class()}])", lambda m: said.get(m[0].lower(), m[0])))


def with_tags(text: Column, tagged: list[tuple[list[str], str]]) -> Column:
    """The words of each list in brackets with its tag behind, where no bracket stands before them."""
    return _replaced(text, *[(rf"({_begins(words, chr(92) + '[')})(?![{_word_class()}])", rf"[\1]({n})") for words, n in tagged])


def with_ellipsis(text: Column, before: list[str], words: list[str]) -> Column:
    """An ellipsis between a word of `before`, unless punctuation stands right before it, and one of `words`."""
    return _replaced(text, (rf"({_begins(before, ',.!?—')})[{_WHITE}]++((?i:{'|'.join(words)}))(?![{_word_class()}])", r"\1... \2"))


SPACE, END, LETTER, INNER = 1, 2, 4, 8


@cache
def _classes() -> np.ndarray:
    """What each code point is to the tokens: white space, an end, a word's letter, or allowed inside a word."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kinds[i] = SPACE * c.isspace() | END * (c in ",.!?\n") | LETTER * (c.isalnum() or c == "_") | INNER * (c in "'-")
    return kinds


def _due(points: np.ndarray, conjunctions: list[str], most: int) -> list[int]:
    """Places of the conjunctions that get a comma, in the code points of a text.

    Tokens are runs of white space and of other characters. Only conjunctions are gone through one by one: how many words
    stand between them, and where the last end was, is told by running counts.
    """
    kind = _classes()[points]
    space = kind & SPACE > 0
    first = np.flatnonzero(np.r_[True, space[1:] != space[:-1]])
    length = np.diff(np.r_[first, len(points)])
    ends = np.bitwise_or.reduceat(kind & END, first) > 0
    word = (np.bitwise_and.reduceat(np.where(kind & (LETTER | INNER), INNER, 0).astype(np.uint8), first) > 0) & (kind[first] & LETTER > 0) & ~ends
    joins = np.zeros(len(first), bool)
    for c in conjunctions:
        some = np.flatnonzero(word & (length == len(c)))
        low = points[first[some, None] + np.arange(len(c))]
        low = np.where((low >= 65) & (low <= 90), low + 32, low)
        joins[some[(low == np.frombuffer(c.encode("utf-32-le"), np.uint32)).all(1)]] = True
    before = np.cumsum(word) - word
    fresh = np.maximum.accumulate(np.where(ends, before, 0))
    out, since = [], 0
    at = np.flatnonzero(joins)
    for place, n, start in zip(first[at].tolist(), before[at].tolist(), fresh[at].tolist()):
        since = max(since, start)
        if n - since >= most:
            out.append(place)
            since = n
    return out


def with_breaths(text: Column, conjunctions: list[str], most: int) -> Column:
    """The text with a comma before a conjunction that follows `most` words or more without an end; the texts of a slice are looked at in one go."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in _sliced(batches):
            texts = [t or "" for t in b.to_pylist()]
            whole = "\n".join(texts)
            due = _due(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), conjunctions, most) if whole else []
            stops = np.cumsum([len(t) + 1 for t in texts])
            out, i = [], 0
            for t, stop in zip(texts, stops.tolist()):
                start, parts, done = stop - len(t) - 1, [], 0
                while i < len(due) and due[i] < stop:
                    parts += [t[done : due[i] - start], ", "]
                    done = due[i] - start
                    i += 1
                out.append("".join([*parts, t[done:]]) if parts else t)
            yield pa.array(out, pa.string(), mask=b.is_null().to_numpy(zero_copy_only=False))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


def _clause_commas(conjunctions: list[str], least: int):
    """The rule of `with_clause_commas` for one text.

    Where a clause begins in a piece depends on what the match before it took: nothing, the conjunction and a letter, the
    piece's first letter, or only all but a last letter alone, with which the next clause begins.
    """
    conj = "|".join(conjunctions)
    cut, taken, letter = re.compile(rf" (?=(?:{conj}) [a-z])"), re.compile(rf"(?:{conj}) [a-z]"), re.compile("[A-Za-z]")
    long = re.compile(rf"[{_WHITE}]*+(?:[^{_WHITE}]++[{_WHITE}]++){{{least - 1}}}[^{_WHITE}]")
    NOTHING, START, FIRST, LAST = range(4)

    def commas(text: str) -> str:
        pieces = cut.split(text)
        out, begin = [pieces[0]], NOTHING
        for piece, behind in itertools.pairwise(pieces):
            if begin == START and piece in conjunctions:
                joint, begin = " ", FIRST
            else:
                if begin == START and (m := taken.match(piece)):
                    piece = piece[m.end() :]
                elif begin == FIRST:
                    piece = piece[1:]
                elif begin == LAST:
                    piece = "x " + piece
                m = letter.search(piece, max(map(piece.rfind, ",.\n")) + 1)
                size = len(piece) - m.start() if m else 0
                joint = ", " if size > 1 and long.match(piece, max(m.start(), *(piece.rfind(c) + 1 for c in "!?"))) else " "
                begin = START if size > 1 else LAST if size else NOTHING
            out += [joint, behind]
        return "".join(out)

    return commas


def with_clause_commas(text: Column, conjunctions: list[str], least: int) -> Column:
    """The text with a comma before a conjunction that ends a clause of `least` words or more."""
    commas = _clause_commas(conjunctions, least)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in _sliced(batches):
            yield pa.array([None if t is None else commas(t) for t in b.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


GROUPS = "array<struct<text:string,cut:boolean>>"
_GROUPS = pa.list_(pa.struct([("text", pa.string()), ("cut", pa.bool_())]))


def _grouped(parts: Column, decide) -> Column:
    """The texts of array<struct<text,number>> in GROUPS, joined by spaces; decide(numbers) gives (first, count, cut) of each group."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in _sliced(batches):
            inner = b.flatten()
            texts, numbers = inner.field(0).to_pylist(), inner.field(1).to_pylist()
            at = (b.offsets.to_numpy() - b.offsets[0].as_py()).tolist()
            out = [[{"text": " ".join(texts[i + first : i + first + n]), "cut": cut} for first, n, cut in decide(numbers[i:j])] for i, j in zip(at, at[1:])]
            yield pa.array(out, _GROUPS, mask=b.is_null().to_numpy(zero_copy_only=False))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, GROUPS)(parts)


def carried_groups(parts: Column, least: int) -> Column:
    """GROUPS of array<struct<text,words>>: short texts are carried on until `least` words are together, a rest joins the group before it."""

    def decide(counts: list[int]) -> list[tuple]:
        out: list[tuple] = []
        first = total = 0
        for i, n in enumerate(counts):
            total += n
            if total >= least or i == len(counts) - 1 and i == first:
                out.append((first, i + 1 - first, False))
                first, total = i + 1, 0
        if first < len(counts):
            start = out.pop()[0] if out else first
            out.append((start, len(counts) - start, False))
        return out

    return _grouped(parts, decide)


def packed_groups(parts: Column, most: int, between: int, ceiling: int | None = None) -> Column:
    """GROUPS of array<struct<text,size>>: as many as fit into `most` with `between` for each joint; one above `ceiling` stands alone, to be cut."""

    def decide(sizes: list[int]) -> list[tuple]:
        out: list[tuple] = []
        total: int | None = None  # nothing held
        for i, n in enumerate(sizes):
            if ceiling is not None and n > ceiling:
                out.append((i, 1, True))
                total = None
            elif total is None or total + between + n > most:
                out.append((i, 1, False))
                total = n
            else:
                out[-1] = (out[-1][0], out[-1][1] + 1, False)
                total += between + n
        return out

    return _grouped(parts, decide)


def told(parts: Column, number) -> Column:
    """array<string> as array<struct<text,number>>."""
    return F.transform(parts, lambda p: F.struct(p.alias("text"), number(p).alias("number")))
