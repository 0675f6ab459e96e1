"""Interpolation, alignment and vector codes against brute force on small, awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillwave.llm import alignment, interpolation, tallies, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "size long, key string, shard long, part int, label string, total long"
PLAIN = [None] * 6
AWKWARD = [
    "", None, "  two  spaces ", "tail ", "\n\nlines\r\n\ttabs  \t x", "nbsp  here and　wide", "émile's don't  x▁y", "ﬁ ligature", "<|endoftext|> <s> </s> <unk>",
    "日本語 テキスト。 中文 字", "a" * 3000 + " " + "b " * 3000, "x​ y ́z", "\x00 a\x01 b", " ", " \n ", "x \ny", "é combined", "\U0001f44d\U0001f3fd emoji x", "123 4567,89.0 $%^&* (foo)",
    "x\u0085 y", "\x1c \x1d a", "don 't 've", "tab\t space \tx", "UPPER lower UPPER", "same words same words same", "same words same words same",
]


def texts(seed, n):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(50)]
    return [" ".join(known[int(r.random() ** 2 * 50)] for _ in range(r.randint(1, 60))) for _ in range(n)]


ROWS = [(i, t) for i, t in enumerate([*AWKWARD, *texts(1, 60)])] + [(None, "no id here"), (None, None), (3, "tail "), (30, texts(1, 5)[4]), (30, texts(1, 5)[4])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *PLAIN) for d, t in ROWS], f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


# 11 interpolation


def model(rows, order):
    """Scores by plain dictionaries."""
    s_, e_ = ("start",), ("end",)
    part = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10
    lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [[*[s_] * (order - 1), *WORD.findall(lowered(t)), e_] for _, t in rows]

    def counted(keep):
        c = Counter()
        for (d, _), s in zip(rows, tokens, strict=True):
            if keep(part(d)):
                c.update(tuple(s[i - n + 1 : i + 1]) for i in range(order - 1, len(s)) for n in range(1, order + 1))
                c.update(tuple(s[order - 1 - n : order - 1]) for n in range(1, order))
        ones = {k: v for k, v in c.items() if len(k) == 1 and k != (s_,)}
        return c, sum(ones.values()), len(ones)

    def told(c, n_all, types, s, i):
        x = [n_all, *(c[tuple(s[i - n + 1 : i])] for n in range(2, order + 1))]
        f = [1 / (types + 1), *(c[tuple(s[i - n + 1 : i + 1])] / v if v else 0.0 for n, v in enumerate(x, 1))]
        return max([0, *(64 * n + (v.bit_length() - 1) * (n > 1) for n, v in enumerate(x, 1) if v)]), f

    def equal(b):
        return [1 / (b // 64 + 1) if k <= b // 64 else 0.0 for k in range(order + 1)]

    seen, held = counted(lambda p: p > 1), Counter()
    for (d, _), s in zip(rows, tokens, strict=True):
        if part(d) == 1:
            held.update((b, tuple(f)) for b, f in (told(*seen, s, i) for i in range(order - 1, len(s))))
    weights = {b: equal(b) for b, _ in held}
    for _ in range(20 if weights else 0):
        got = {b: [float(k <= b // 64) for k in range(order + 1)] for b in weights}
        for (b, f), n in held.items():
            p = [w * x for w, x in zip(weights[b], f, strict=True)]
            got[b] = [g + n * x / sum(p) for g, x in zip(got[b], p, strict=True)]
        new = {b: [x / sum(g) for x in g] for b, g in got.items()}
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True))
        weights = new
        if moved < 0.002:
            break
    c, n_all, types = seen = counted(lambda p: p > 0)
    out = []
    for (d, _), s in zip(rows, tokens, strict=True):
        base = score = known = 0
        for i in range(order - 1, len(s)):
            b, f = told(*seen, s, i)
            near = min((x for x in weights if x // 64 == b // 64), key=lambda x: (abs(x - b), x), default=None)  # noqa: B023
            score += math.log10(sum(w * x for w, x in zip(equal(b) if near is None else weights[near], f, strict=True)))
            known += c[(s[i],)] > 0
            base += math.log10((c[(s[i],)] + 0.1) / (n_all + 0.1 * (types + 1)))
        out.append((d, part(d) == 0, len(s) - order + 1, known, n_all, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_model(docs, order):
    got, want = ordered(interpolation.score(docs, order).collect()), ordered(model(ROWS, order))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_long_documents_go_in_pieces(monkeypatch):
    """Tokens, keys and counts of pieces are those of the whole text."""
    import pyarrow as pa

    monkeypatch.setattr(tallies, "numbers", lambda bits: iter(range(1000)))
    text = " ".join(texts(3, 40)).encode()
    batch = pa.record_batch([pa.array([1]), pa.array([5], pa.int32()), pa.array([text.decode()])], ["d", "p", "t"])

    def counts():
        sums = Counter()
        for b in interpolation._encode(3)(iter([batch])):
            s = interpolation.Shard(b.to_pylist()[0], 3)
            for n in range(3):
                sums.update({(n, int(k)): int(c) for k, c in zip(s.keys[n], s.counts[n][:, 0], strict=True) if c})
        return sums

    whole = counts()
    monkeypatch.setattr(interpolation, "SHARD_BYTES", 700)
    assert counts() == whole
    assert sum(v for (n, _), v in whole.items() if n == 2) == len(text.split()) + 1


def test_scores_of_few_rows(spark, nothing):
    assert interpolation.score(nothing).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    alone = interpolation.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert ordered(alone) == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_packed_numbers():
    r = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([0, 255, 256, 2**64 - 1], np.uint64), r.integers(0, 2**40, 1000).astype(np.uint64)):
        assert (tallies.unpack(tallies.pack(x)) == x).all()
        assert (tallies.unpack_sorted(tallies.pack_sorted(np.sort(x))) == np.sort(x)).all()


# 12 alignment


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(rows):
    """Every pair of tokens looked at by its byte ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_, b_ = Tokenizer.from_file(paths()[0]), SentencePieceProcessor(model_file=paths()[1])
    a_.encode_special_tokens = True
    values, docs = alignment.byte_values(), []
    for d, t in rows:
        a, b = (a_.encode(" " + t, add_special_tokens=False).ids, b_.encode(t)) if t else ([], [])
        in_a = [bytes(values[c] for c in a_.id_to_token(i)) for i in a]
        in_b = [bytes([int(b_.id_to_piece(i)[3:5], 16)]) if b_.is_byte(i) else b_.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(in_a) != (" " + t).encode() or b"".join(in_b) != (" " + t).encode():
            docs.append((d, [], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (in_a, in_b))
        spans_a, spans_b = ([(e - len(x), e, i) for e, x, i in zip(ends, side, ids, strict=True)] for ends, side, ids in ((ends_a, in_a, a), (ends_b, in_b, b)))
        links, j = [], 0
        for start, end, i in spans_a:
            while spans_b[j][1] <= start:
                j += 1
            k = j
            while k < len(spans_b) and spans_b[k][0] < end:
                links.append((i, spans_b[k][2]))
                k += 1
        groups, at = [], 0
        for end in sorted({*ends_a} & {*ends_b}):
            groups.append("|".join(",".join(str(i) for s, e, i in spans if at <= s and e <= end) for spans in (spans_a, spans_b)) if len(spans_a) < 400 else None)
            at = end
        docs.append((d, a, b, groups, links))
    counts, best = Counter(link for *_, links in docs for link in links), defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, len(a), len(b), len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), "" if not a else None if None in g else hashlib.sha256(";".join(g).encode()).hexdigest()) for d, a, b, g, k in docs]


def test_alignment_equals_ranges(docs):
    got, want = ordered(alignment.align(docs, *paths()).collect()), ordered(aligned(ROWS))
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want, strict=True))
    assert sum(g[1] == 0 for g in got) > 3 and sum(g[1] > 0 for g in got) > 60


def test_alignment_of_nothing(nothing):
    assert alignment.align(nothing, *paths()).count() == 0


def test_alignment_in_small_groups(monkeypatch):
    """Texts cut into pieces and digests made piece by piece give what whole texts give."""
    tok = alignment.tokenizers(*paths())
    rows = [(d, (t or "").encode()) for d, t in ROWS]
    keep = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes", "pairs"]
    whole = alignment.align_shard(tok, rows, 1).to_pylist()[0]
    monkeypatch.setattr(alignment, "HASHED", 7)
    for size in (200, 5):
        monkeypatch.setattr(alignment, "GROUP_BYTES", size)
        assert {k: v for k, v in alignment.align_shard(tok, rows, 1).to_pylist()[0].items() if k in keep} == {k: whole[k] for k in keep}


def test_joining_vocabularies_are_refused():
    with pytest.raises(ValueError):
        alignment.Tokenizers.check([b" a", b"of the"])


# 13 vector codes


def coded(rows, entries=256):
    ok = [(i, v, k) for i, v, k in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * c) for c in r[1]]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    width = -(-len(ok[0][1]) // 4) * 4
    x = [[math.floor(1024 * c) for c in v] + [0] * (width - len(v)) for _, v, _ in ok]
    cut = [[v[p * width // 4 : (p + 1) * width // 4] for p in range(4)] for v in x]
    with_id = [c for c, r in zip(cut, ok, strict=True) if r[0] is not None] or cut
    books = [[list(c[p]) for c in with_id[:entries]] for p in range(4)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        for p in range(4):
            parts = defaultdict(list)
            for c in cut:
                parts[near(p, c[p])[1]].append(c[p])
            for k, members in parts.items():
                books[p][k] = [sum(m) // len(members) for m in zip(*members, strict=True)]
    found = [[near(p, c[p]) for p in range(4)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = Counter()
    for (*_, k), e in zip(ok, errors, strict=True):
        by[k] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by[label], digest) for (i, _, label), f, e in zip(ok, found, errors, strict=True)]


def vectors(n, width, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.2, (12, width))
    rows = [(int(i), (centres[i % 12] + r.normal(0, 0.02, width)).astype(np.float32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in range(n)]
    rows += [(n, rows[0][1], 1), (n, rows[0][1], 1), (None, rows[1][1], None), (n + 1, None, 1), (n + 2, [], 1), (n + 3, [1.0] * (width + 4), 1)]
    rows += [(n + 4, [float("nan")] * width, 1), (n + 5, [float("inf"), *[0.0] * (width - 1)], 1), (n + 6, [None, *[0.5] * (width - 1)], 2), (n + 7, [0.0] * width, 2)]
    return rows


@pytest.mark.parametrize("n, width", [(330, 16), (40, 10), (5, 3)])
def test_codes_equal_plain_rounds(spark, n, width):
    rows = vectors(n, width)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, label int, part int, code string").repartition(4)
    assert ordered(vector_codes.compress(df).collect()) == ordered(coded(rows))


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty).count() == 0
    without = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], None)], "vec_id long, embedding array<double>, label string")
    assert [tuple(r)[:4] for r in vector_codes.compress(without).collect()] == [(None, "00000000", 0, 0)]
    huge = spark.createDataFrame([(1, [1e38, -1e38, 0.0, 0.0], 1), (2, [0.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    assert vector_codes.compress(huge).count() == 2


@pytest.mark.parametrize("step", [1, 16, 48, 1000])
def test_cells_lose_no_entry(monkeypatch, step):
    r = np.random.default_rng(step)
    book, x = r.integers(-300, 300, (64, 8)), r.integers(-400, 400, (2000, 8))
    x[:64] = book
    book[40:] = book[:24]  # ties
    monkeypatch.setattr(vector_codes, "CELLS", 700)
    monkeypatch.setattr(vector_codes, "PAIRS", 500)
    cells = vector_codes.Cells(book, step)
    for some in np.split(x, 4):
        d = ((some[:, None] - book) ** 2).sum(2)
        entry, distance = cells.nearest(some)
        assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all()
