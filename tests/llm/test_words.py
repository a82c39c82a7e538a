"""Operators over word shingles against brute force."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkveil.llm import neardup
from inkveil.llm.components import components
from inkveil.llm.neardup import near_duplicates
from inkveil.llm.packing import pack, reduce_and_fit
from inkveil.llm.shingle import Words, flat, keys
from inkveil.llm.substring import dedup_substrings
from inkveil.llm.tokens import encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["é", "ß x", "A", "a"]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 19, 20, 25, 60, 200]))] for _ in range(n // 2)]
    out = []
    for i in range(n):
        t = list(base[i % len(base)])
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t += base[rng.randrange(len(base))][:40]
        out.append((i * 7 % 61, rng.choice([" ", "\n", "\t ", "\x0b"]).join(t)))
    return [*out, (100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "One  TWO"), (105, "long " * 3000), (106, "same " * 30), (None, out[0][1])]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, start string, sig string")


def brute_substring(rows, k):
    seen, spans = set(), {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - k + 1):
            if (s := tuple(w[i : i + k])) in seen:
                gone |= set(range(i, i + k))
            seen.add(s)
        spans[d] = (w, gone)
    out = []
    for d, t in rows:
        w, gone = spans[d] if d is not None else (WORD.findall(t or ""), set())
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "bits"), [(20, None), (5, 9), (5, 22)])
def test_substring(spark, window, bits):
    rows = corpus()
    got = dedup_substrings(frame(spark, rows).repartition(5), window, bits).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substring(rows, window)


def test_substring_repeated_ids_and_empty(spark):
    t = " ".join(f"v{i}" for i in range(30))
    got = dedup_substrings(frame(spark, [(1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 30)]
    assert dedup_substrings(frame(spark, [])).count() == 0


def sets(rows, k):
    out = {}
    for d, t in rows:
        if d is not None:
            w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            w = WORD.findall(w)
            out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute_near(rows, k, percent):
    s = sets(rows, k)
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((d, len(s[d]), find(d), find(d) == d) for d in s)


@pytest.mark.parametrize("block", [512, 3])
def test_near(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 200 * block)
    for rows in (corpus(), chain()):
        got = near_duplicates(frame(spark, rows).repartition(4), 4).collect()
        assert sorted(map(tuple, got)) == brute_near(rows, 4, 80)


def chain():
    """Each text is near to the next only, and a stranger shares their buckets."""
    rng = random.Random(8)
    t = [f"q{i}" for i in range(120)]
    rows = []
    for i in range(30):
        rows.append((rng.randrange(10**6), " ".join(t)))
        for _ in range(3):
            t[rng.randrange(len(t))] = f"z{rng.random()}"
    return rows


def opposites(n):
    """Two words of n letters that have the same polynomial hash modulo a power of two, whatever its odd base (Thue-Morse)."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomials_confuse(spark, n):
    x, y = opposites(n)
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} u v"), (4, f"{y} u v"), (5, f"{x} u v w"), (6, f"{y} u v w")]
    got = dedup_substrings(frame(spark, rows)).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substring(rows, 20)
    assert sorted(map(tuple, near_duplicates(frame(spark, rows), 4).collect())) == brute_near(rows, 4, 80)
    texts = [t for _, t in rows]
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert [z.tolist() for z in encoder(TOKENIZER)(pa.array(texts))] == want


def test_numbers_and_keys_stand_for_words():
    rng = random.Random(4)
    for _ in range(60):
        texts = [" ".join(rng.choice(["a", "b", "A", "é", "dd", "x" * 17]) for _ in range(rng.randrange(12))) for _ in range(4)]
        for k in (1, 2, 3, 5):
            numbers = Words(*flat(pa.array(texts)), lower=True).numbered(k)
            want = sets(list(enumerate(texts)), k)
            for i, j in combinations(range(4), 2):
                assert len(np.intersect1d(numbers[i], numbers[j])) == len(want[i] & want[j])
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 19))) for _ in range(20_000)] + [b"a\0", b"a\0\0", b"\0"]
    words = list(dict.fromkeys(words))
    key, exact = keys(pa.array(words, pa.large_binary()))
    assert len({tuple(x) for x in key.tolist()}) == len(words)
    assert exact.tolist() == [len(w) <= 16 and b"\0" not in w for w in words]


def test_near_rows_of_one_id_with_other_texts(spark):
    """Any row of an id links it: 1 and 2 by the shorter text of 1, 2 and 9 by the longer one of 2; 7 and 8 by rows that are neither's main text."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 9), ("b", 30), ("c", 20), ("d", 8)))
    rows = [(1, a), (1, b), (2, a), (2, c), (9, c), (7, d), (7, c.upper() + " z"), (8, d), (8, " ".join(f"e{i}" for i in range(40))), (5, None), (5, "")]
    got = sorted(map(tuple, near_duplicates(frame(spark, rows), 4).collect()))
    assert got == [(1, 27, 1, True), (2, 17, 1, False), (5, 0, 5, True), (7, 18, 1, False), (8, 37, 1, False), (9, 17, 1, False)]
    alone = [(7, d), (7, b), (8, d), (8, " ".join(f"e{i}" for i in range(40)))]
    assert [r.component_id for r in near_duplicates(frame(spark, alone), 4).collect()] == [7, 7]


def test_near_edges(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    got = near_duplicates(frame(spark, [(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c")])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (140, 2), (50, 51)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 2 for i in [2, *range(100, 141)]}, 7: 3, 3: 3, 9: 3, 50: 50, 51: 50}


def test_encoder_equals_library():
    rng = random.Random(6)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", " ", "\n", "é", "1", "!", "\U0001f600", "<|", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(3000)]
    texts += [t or "" for _, t in corpus()] + ["it's", " a", "  a\n\n b ", "1a2 !!x", "<|endoftext|> z", "\U0001f600 k", "　x  y"]
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder(TOKENIZER)(pa.array(texts))] == want


def test_pack(spark):
    rows = [*corpus(), (200, "x y " * 5000), (200, "x y " * 5000)]
    got = pack(frame(spark, rows), TOKENIZER, 300).collect()
    library = Tokenizer.from_file(TOKENIZER)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 300
    want = []
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 300 or 300, len(ids) + 1, 300)]
        want += [(d, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    total = sum(r.length for r in got)
    assert len(by) <= 1.1 * total / 300 + 1
    assert pack(frame(spark, []), TOKENIZER).count() == 0


def test_reduction_is_whole_and_tight():
    rng = random.Random(1)
    for size in (10, 50, 300):
        for _ in range(30):
            counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
            bins = reduce_and_fit(counts, size)
            back = {}
            for n, held in bins:
                assert n > 0 and sum(a * b for a, b in held) <= size
                for length, per in held:
                    back[length] = back.get(length, 0) + n * per
            assert back == counts
            lower = -(-sum(a * b for a, b in counts.items()) // size)
            assert sum(n for n, _ in bins) <= 11 / 9 * max(lower, sum(b for a, b in counts.items() if 2 * a > size)) + 1


def test_bitmap_joins_keep_exact_rows(spark):
    from pyspark.sql import functions as F

    from inkveil.llm.narrow import named, unnamed

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("doc_id_slot")).union(spark.sql("select null, 'n'"))
    rows = rows.union(rows.where("doc_id = 7"))
    ids = spark.range(0, 5000, 7).select(F.col("id").alias("doc_id")).union(spark.sql("select cast(null as bigint)"))
    wanted = set(range(0, 5000, 7))
    assert sorted(r.doc_id for r in named(rows, ids).collect()) == sorted([*wanted, 7])
    left = [r.doc_id for r in unnamed(rows, ids).collect()]
    assert len(left) == len(set(left)) and set(left) == (set(range(5000)) - wanted) | {None}
    assert named(rows, ids.limit(0)).count() == 0 and unnamed(rows, ids.limit(0)).count() == rows.count()
