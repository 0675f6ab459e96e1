"""Cross-tokenizer alignment: token ids of one tokenizer against those of another, over the same bytes.

A byte-level tokenizer (A) and a piece tokenizer (B) encode each whole text, with a space before it. Where a token of A and
one of B both begin with a space at the same byte, both have ended before it: such verified anchors cut a document into
windows of token ids. Windows repeat (they are mostly single words), so the alignment of a window is worked out once and
remembered by its tuple of ids: its groups (between bytes where both tokenizers end a token) and its links (an A and a B token
that share bytes).

Texts become shards of bounded size, each with its documents as window numbers and the distinct windows' links. A shard sends
the counts of its distinct id pairs and gets their totals back, with a mark at those that are their B id's most frequent
(`tallies`; all pairs of a B id are in one part); it then sums them up per document.

Neither tokenizer joins characters across a space after other characters, so the text between two such spaces is encoded
once in a shard and remembered; `check` tests this against the vocabulary.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tallies
from .binary_records import spread
from .common import written

#: Bytes of text in a shard (a longer document is one alone), and that are cut and encoded at once.
SHARD_BYTES, GROUP_BYTES = 8_000_000, 2_000_000
#: Windows whose text is hashed at once.
HASHED = 100_000

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SHARDS = f"shard long, doc_ids array<long>, sizes array<long>, {', '.join(f'{c} array<long>' for c in _COUNTS)}, groups_sha256 array<string>, windows binary, n_links_of binary, links binary, pairs binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        values = byte_values()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        in_a = lambda i, t: t.encode() if i in special or any(c not in values for c in t) else bytes(values[c] for c in t)
        bytes_a = [in_a(i, self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        in_b = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        bytes_b = [in_b(i) for i in range(self.b.get_piece_size())]
        self.check(bytes_b)
        self.bytes = bytes_a, bytes_b
        self.lengths = tuple(np.array([len(t) for t in x]) for x in self.bytes)
        self.spaced = tuple(np.array([t[:1] == b" " for t in x]) for x in self.bytes)

    @staticmethod
    def check(pieces: list[bytes]) -> None:
        """No piece may hold a space after another character, or the texts between spaces could not be encoded alone."""
        if any(b" " in p.lstrip(b" ") for p in pieces):
            raise ValueError("the piece vocabulary joins characters across spaces")

    def encode(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of each unit, a space and what follows, by A and by B, and whether the tokens' bytes are the unit's."""
        texts = [u.decode("utf-8", "replace") for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        same = np.ones(len(units), bool)
        sizes, whole = np.fromiter(map(len, units), np.int64, len(units)), b"".join(units)
        for ids, of, lengths in zip((a, b), self.bytes, self.lengths, strict=True):
            flat, first, n = _ragged(ids)
            if b"".join(map(of.__getitem__, flat.tolist())) != whole or (np.diff(np.r_[0, np.cumsum(lengths[flat])][np.r_[first, len(flat)]]) != sizes).any():
                same &= [b"".join([of[i] for i in x]) == u for u, x in zip(units, ids, strict=True)]
        return a, b, same


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """The tokenizers of this Python worker; kept between tasks."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def unit_starts(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in texts that begin at `starts`, each with a space: there, and at spaces after a character that is no white space.

    After characters of E1, E2 and E3, where the wide spaces are, and at the last byte of a text no unit begins.
    """
    before = np.concatenate([np.full(3, 32, np.uint8), x[:-1]])  # before[i + 2] stands right before x[i]
    one, two, three = before[2:], before[1:-1], before[:-2]
    ok = (x == 32) & (one > 32) & (one != 127)
    ok &= ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) & ~((one >= 0x80) & (three >= 0xE1) & (three <= 0xE3))
    ok[np.r_[starts[1:], len(x)] - 1] = False
    ok[starts] = True
    return np.flatnonzero(ok)


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all values, first of each list, length of each)."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n.sum())), np.cumsum(n) - n, n


class Windows(dict):
    """The windows of a shard: id tuple, as bytes -> number, with what alignment says of each."""

    def __init__(self, tok: Tokenizers) -> None:
        self.tok = tok
        self.texts: list[bytes] = []
        self.counts: list[np.ndarray] = [np.zeros((0, 4), np.int64)]  # n_a, n_b, n_groups, n_links
        self.links: list[np.ndarray] = [np.zeros(0, np.uint64)]

    def numbers(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> np.ndarray:
        """The number of each window: ids a from first_a on, ids b from first_b on."""
        n = len(first_a)
        which_a, which_b = (np.repeat(np.arange(n), np.diff(np.r_[f, len(x)])) for x, f in ((a, first_a), (b, first_b)))
        stop_a = np.r_[first_a[1:], len(a)]
        flat = np.empty(n + len(a) + len(b), np.int32)
        offsets = np.r_[first_a + first_b + np.arange(n), len(flat)]
        flat[offsets[:-1]] = stop_a - first_a
        flat[np.arange(len(a)) + first_b[which_a] + which_a + 1] = a
        flat[np.arange(len(b)) + stop_a[which_b] + which_b + 1] = b
        found = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
        names = found.dictionary.to_pylist()
        new = [name for name in names if self.setdefault(name, len(self)) >= len(self.texts) and not self.texts.append(b"")]
        if new:
            self.align([np.frombuffer(name, np.int32) for name in new])
        return np.fromiter(map(self.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]

    def align(self, windows: list[np.ndarray]) -> None:
        """Groups and links of new windows, all at once: between two neighbouring ends of either side lies one link."""
        sides, ends, of = [], [], []
        for side, ids in enumerate(([w[1 : w[0] + 1] for w in windows], [w[w[0] + 1 :] for w in windows])):
            sides.append(np.concatenate(ids))
            of.append(np.repeat(np.arange(len(ids)), [len(x) for x in ids]))
            ends.append(np.cumsum(self.tok.lengths[side][sides[-1]]))
        every = np.union1d(*ends)
        i, j = (np.searchsorted(e, every) for e in ends)
        shared = np.intersect1d(*ends, assume_unique=True)
        stop_a, stop_b = (np.searchsorted(e, shared) + 1 for e in ends)
        group_of = of[0][stop_a - 1]
        n = len(windows)
        self.counts.append(np.stack([np.bincount(of[0], minlength=n), np.bincount(of[1], minlength=n), np.bincount(group_of, minlength=n), np.bincount(of[0][i], minlength=n)], 1))
        self.links.append(pair_keys(sides[0][i], sides[1][j]))
        joined = []
        for ids, stops in zip(sides, (stop_a, stop_b), strict=True):
            lists = pa.ListArray.from_arrays(np.r_[0, stops].astype(np.int32), pa.array(ids).cast(pa.string()))
            joined.append(pc.binary_join(lists, ","))
        groups = pc.binary_join_element_wise(*joined, "|")
        lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(self.counts[-1][:, 2])].astype(np.int32), groups)
        self.texts[len(self.texts) - n :] = pc.binary_join(lists, ";").cast(pa.binary()).to_pylist()


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key for each pair of ids: those of one B id stand together, B ids are spread over all leading bits."""
    spread_b = b.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)  # an odd factor: each B id has its own
    return spread_b << np.uint64(32) | a.astype(np.uint64)


def _groups(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(document, text with its space) in groups of bounded bytes; longer texts in pieces that begin where units begin."""
    group: list[tuple[int, bytes]] = []
    held = 0
    whole = np.zeros(1, np.int64)
    for i, t in enumerate(texts):
        t, at = b" " + t, 0
        while at < len(t):
            stop = len(t)
            if stop - at > GROUP_BYTES:
                x = np.frombuffer(t, np.uint8, offset=at)
                for some in (x[: 2 * GROUP_BYTES], x):  # hardly any text has no such space in the first of them
                    later = unit_starts(some, whole)
                    later = later[later >= GROUP_BYTES]
                    if len(later):
                        stop = at + int(later[0])
                        break
            if group and held + stop - at > GROUP_BYTES:
                yield group
                group, held = [], 0
            group.append((i, t[at:stop]))
            held += stop - at
            at = stop
    if group:
        yield group


def align_shard(tok: Tokenizers, rows: list[tuple[int | None, bytes]], shard: int) -> pa.RecordBatch:
    texts = [i for i, (_, t) in enumerate(rows) if t]
    known: dict[bytes, int] = {}
    encoded: list[tuple] = []  # ids of the units, group by group as they were met
    valid = np.zeros(len(rows), bool)
    valid[texts] = True
    groups: list[tuple[np.ndarray, np.ndarray]] = []  # (unit numbers, the document of each)
    same = [np.zeros(0, bool)]
    for group in _groups([rows[i][1] for i in texts]):
        starts = np.cumsum([0, *(len(t) for _, t in group)])
        x = np.frombuffer(b"".join(t for _, t in group), np.uint8)
        at = unit_starts(x, starts[:-1])
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[at, len(x)].astype(np.int32)), pa.py_buffer(x)]).dictionary_encode()
        names = found.dictionary.to_pylist()
        n = len(known)
        new = [u for u in names if known.setdefault(u, len(known)) >= n]
        a, b, ok = tok.encode(new)
        encoded.append((a, b))
        same.append(ok)
        unit = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]
        doc = np.array([texts[i] for i, _ in group])[np.searchsorted(starts, at, "right") - 1]
        groups.append((unit.astype(np.int32), doc.astype(np.int32)))
    ok = np.concatenate(same)
    for unit, doc in groups:
        valid[doc[~ok[unit]]] = False
    sides = [_ragged([ids for e in encoded for ids in e[side]]) for side in (0, 1)]
    del encoded, known
    windows = Windows(tok)
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for unit, doc in groups:
        keep = valid[doc]
        unit, doc = unit[keep], doc[keep]
        if not len(unit):
            continue
        ids, starts, firsts = [], [], []
        for side, (flat, first, n) in enumerate(sides):
            ids.append(flat[spread(first[unit], n[unit])])
            ends = np.cumsum(tok.lengths[side][ids[side]])
            starts.append(np.r_[0, ends[:-1]])
        size = int(ends[-1])
        anchor = np.zeros(size + 1, np.int8)
        for side in (0, 1):
            anchor[starts[side][tok.spaced[side][ids[side]]]] += 1
        units_at = np.cumsum(np.add.reduceat(tok.lengths[0][ids[0]], np.cumsum(sides[0][2][unit]) - sides[0][2][unit]))
        begins = np.r_[0, units_at[:-1]]
        anchor[begins[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])]] = 2
        at = np.flatnonzero(anchor == 2)
        firsts = [np.searchsorted(s, at) for s in starts]
        seen.append((doc[np.searchsorted(begins, at, "right") - 1], windows.numbers(*ids, *firsts)))
    docs = np.concatenate([d for d, _ in seen] or [np.zeros(0, np.int64)])
    numbers = np.concatenate([n for _, n in seen] or [np.zeros(0, np.int64)])
    sizes = np.bincount(docs, minlength=len(rows))
    counts, links = np.concatenate(windows.counts), np.concatenate(windows.links)
    stops = np.cumsum(sizes)
    sums = np.stack([np.bincount(docs, counts[numbers, c], len(rows)).astype(np.int64) for c in range(4)])
    digests = []
    for stop, n in zip(stops.tolist(), sizes.tolist(), strict=True):
        told = hashlib.sha256()
        for at in range(stop - n, stop, HASHED):
            told.update(b";" * (at > stop - n) + b";".join([windows.texts[i] for i in numbers[at : min(stop, at + HASHED)].tolist()]))
        digests.append(told.hexdigest() if n else "")
    # frequent windows get small numbers
    order = np.argsort(-np.bincount(numbers, minlength=len(counts)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin = np.cumsum(counts[:, 3]) - counts[:, 3]
    links = links[spread(begin[order], counts[order, 3])]
    pairs, link = np.unique(links, return_inverse=True)
    lists = lambda x, kind=pa.int64(): pa.array([x], pa.list_(kind))
    columns = [
        pa.array([shard]), lists([d for d, _ in rows]), lists(sizes), *(lists(s) for s in sums), lists(digests, pa.string()),
        *(pa.array([x], pa.binary()) for x in (tallies.pack(place[numbers]), tallies.pack(counts[order, 3]), tallies.pack(link), tallies.pack_sorted(pairs))),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHARDS.split(", ")])


def _encode(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, number = tokenizers(path_a, path_b), tallies.numbers(32)
        rows: list[tuple[int | None, bytes]] = []
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                if rows and held + len(text) > SHARD_BYTES:
                    yield align_shard(tok, rows, next(number))
                    rows, held = [], 0
                rows.append((doc_id, text))
                held += len(text)
        if rows:
            yield align_shard(tok, rows, next(number))

    return run


def _send(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.select(["shard", "windows", "n_links_of", "links", "pairs"]).to_pylist():
                links, of = (tallies.unpack(row[c]).astype(np.int64) for c in ("links", "n_links_of"))
                uses = np.bincount(tallies.unpack(row["windows"]).astype(np.int64), minlength=len(of))
                pairs = tallies.unpack_sorted(row["pairs"])
                yield from tallies.sent(0, row["shard"], pairs, np.bincount(links, np.repeat(uses, of), len(pairs)).astype(np.int64), parts)

    return run


def _most(distinct: np.ndarray, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Twice the total of each pair, and one more where no pair of its B id has more."""
    sums = np.bincount(which, counts[:, 0].astype(float), len(distinct)).astype(np.int64)
    b = distinct >> np.uint64(32)
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    highest = np.repeat(np.maximum.reduceat(sums, cut), np.diff(np.r_[cut, len(b)]))
    return 2 * sums + (sums == highest), []


def _report(left: pa.Table, right: pa.Table) -> pa.Table:
    out = []
    for row in left.to_pylist():
        links, of, numbers = (tallies.unpack(row[c]).astype(np.int64) for c in ("links", "n_links_of", "windows"))
        got = tallies.received(right, 0, 1)[:, 0][links]
        begin = np.cumsum(of) - of
        per_window = lambda x: np.add.reduceat(x, begin) if len(begin) else x
        best, total = (np.r_[0, np.cumsum(per_window(x)[numbers])] for x in (got & 1, got >> 1))
        stops = np.cumsum(row["sizes"])
        best, total = (x[stops] - x[stops - row["sizes"]] for x in (best, total))
        out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), *(pa.array(row[c], pa.int64()) for c in _COUNTS), pa.array(best), pa.array(total), pa.array(row["groups_sha256"], pa.string())], [c.split()[0] for c in ALIGNED.split(", ")]))
    return pa.concat_tables(out)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs(doc_id, text) to ALIGNED, a row for each row: counts of tokens, groups and links, and what the links count in all texts.

    Texts that are null, empty, or whose tokens of A or B do not give back a space and the text have no tokens: zeros and an
    empty digest. Ties for the most frequent pair of a B id all count as best. Repeated rows count each; null ids stay. A
    shard may hold any share of one pair. An empty table gives no rows; other columns are not read.
    """
    shards = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path_a, path_b), SHARDS))
    pairs = shards.agg(F.sum(F.octet_length("pairs"))).first()[0] or 0  # three bytes and more for each
    back = written(tallies.answered(shards.mapInArrow(_send(tallies.parts_for(pairs // 3)), tallies.SENT), _most))
    return tallies.together(shards, back, _report, ALIGNED)
