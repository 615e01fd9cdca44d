"""Alignment against whole texts given to both tokenizers, token by token."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from ledgerloom.llm import alignment as al


@pytest.fixture(scope="module")
def aligner():
    return al.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def plain(aligner, rows):
    """The result's rows of (doc_id, text), from byte lengths of whole texts' tokens alone."""
    linked, out, holders = [], [], collections.Counter()
    for _, text in rows:
        groups = []
        if text:
            a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
            if b"".join(aligner.bytes_a[i] for i in a) == (" " + text).encode() == b"".join(aligner.bytes_b[i] for i in b):
                i = j = p = q = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if p <= q:
                        ga.append(a[i])
                        p += len(aligner.bytes_a[a[i]])
                        i += 1
                    else:
                        gb.append(b[j])
                        q += len(aligner.bytes_b[b[j]])
                        j += 1
                    if p == q:
                        groups.append((ga, gb))
                        ga, gb = [], []
        linked.append((groups, collections.Counter((x, y) for ga, gb in groups for x in ga for y in gb)))
        holders.update(linked[-1][1].keys())
    best = collections.Counter()
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    for (doc_id, _), (groups, pairs) in zip(rows, linked):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(pairs.values()), sum(n for p, n in pairs.items() if holders[p] == best[p[0]]),
                    sum(n * holders[p] for p, n in pairs.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def key(r):
    return tuple(str(x) for x in r)


def aligned(spark, rows, **more):
    made = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, count string, slice string").repartition(3)
    return sorted((tuple(r) for r in al.align(made, **more).collect()), key=key)


LETTERS = ["a", "Z", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "é", "ß", "中", "文字", "\U0001f642", "\U0001f469‍\U0001f467", " ", " ", "　", " ", "\u0085", "9", "12", "-", "<|endoftext|>", "<s>", "</s>", "<0x41>", "​", "ا", "\x00", "\x1c", "￼", "don't", "[INST]", "́", "가"]


@pytest.mark.parametrize("hot", [1 << 17, 5])
def test_random_texts_against_whole_encoding(spark, aligner, hot):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    rows += [(1000, "▁a b"), (1001, "a ▁"), (1002, "one plain text"), (1003, "one plain text"), (1004, " "), (1005, "a "), (1006, "   "), (1007, "\n")]
    assert aligned(spark, rows, hot=hot) == sorted(plain(aligner, rows), key=key)


@pytest.mark.parametrize("hot", [1 << 17, 1000])
def test_whole_table(spark, aligner, small, hot):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in al.align(docs, hot=hot).collect()), key=key) == sorted(plain(aligner, rows), key=key)


def test_refined_ends_are_the_decoded_ones(aligner):
    rnd = random.Random(7)
    words = [" " + "".join(rnd.choice([x for x in LETTERS if x[0] != " " and "\u2581" not in x]) for _ in range(6)) for _ in range(400)]
    ids_a, ends_a, _, ids_b, ends_b, _, starts = aligner.spans(words)
    assert ends_a.tolist() == aligner.sizes_a[ids_a].cumsum().tolist() and ends_b.tolist() == aligner.sizes_b[ids_b].cumsum().tolist()
    assert starts[-1] == sum(len(w.encode()) for w in words)


def test_large_groups(spark, aligner, monkeypatch):
    monkeypatch.setattr(al, "LARGE", 1)
    rows = [(i, "abc\U0001f469\u200d\U0001f467xyzzy 中文字漢 don't 12345678 " * i) for i in range(4)]
    again = al.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    got = again.slice(pa.array([t for _, t in rows]))
    assert [(*n, d) for n, d in zip(got["numbers"].tolist(), got["digests"])] == [(*r[1:5], r[7]) for r in plain(aligner, rows)]
    assert sum(got["times"]) == sum(r[4] for r in plain(aligner, rows))


def test_cache_is_forgotten(aligner, monkeypatch):
    texts = pa.array([f"word{i} other{i % 7}" for i in range(500)])
    first = aligner.slice(texts)
    monkeypatch.setattr(al, "CACHE_CHUNKS", 3)
    for at in range(0, 500, 50):
        part = aligner.slice(texts.slice(at, 50))
        assert part["digests"] == first["digests"][at : at + 50]


def test_odd_rows(spark, aligner, odd, empty):
    got = al.align(odd)
    assert got.columns == al.RESULT
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(aligner, rows), key=key)
    assert al.align(empty).collect() == []
    assert aligned(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_in_one_call_are_those_of_calls_of_their_own(monkeypatch):
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    rnd = random.Random(8)
    letters = "abcdefgh éüß☃中\U0001f600\t\n\x01\x7f　​ﬁ▁"
    texts = pa.array(["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["plain words of a line " * 40, None, ""])
    together = al.Aligner(*paths).slice(texts)
    monkeypatch.setattr(al, "JOINED", ())
    alone = al.Aligner(*paths).slice(texts)
    assert together["digests"] == alone["digests"] and any(alone["digests"])
    assert all(np.array_equal(together[k], alone[k]) for k in ("numbers", "keys", "holders", "ends", "pairs", "times"))


def test_a_worker_starts_no_threads_of_its_own():
    """Each thread of a tokenizer would hold memory in each worker of an executor."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import os, pyarrow as pa, public_tokenizers as P
from ledgerloom.llm import alignment as al
aligner = al.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
before = len(os.listdir("/proc/self/task"))
aligner.slice(pa.array([f"word{i} other{i * 7} and more" for i in range(5000)]))
print(len(os.listdir("/proc/self/task")) - before)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=60)
    assert int(out.stdout.split()[-1]) == 0
