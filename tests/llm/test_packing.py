import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(rows, texts, tokenizer):
    """Every id of every document lies in one piece, every sequence is gapless and fits."""
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE
    for key, text in texts.items():
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return by_sequence


def test_whole_table(spark, medium, texts, tokenizer):
    rows = packing.op2_pack(spark, medium).collect()
    sequences = check(rows, texts, tokenizer)
    padding = sum(packing.SEQUENCE - sum(r["length"] for r in parts) for parts in sequences.values())
    assert padding < 0.01 * packing.SEQUENCE * len(sequences)


def test_many_groups_and_odd_rows(spark, odd, empty, tokenizer):
    rows = packing.pack_documents(odd, group_docs=2).collect()
    check(rows, {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] not in (5, None)}, tokenizer)
    assert len([r for r in rows if r["doc_id"] == 5]) == 2
    assert packing.pack_documents(empty).collect() == []


def test_tokens_equal_the_tokenizers(texts, tokenizer):
    odd = ["", "Don't stop 'tis <|endoftext|> été İ ABC", "你好 naïve12 a1b2 ... '' ß ª", " ", "A" * 5000, "x\x00y\x1cz", "l'été d'Été", "é µm ÅÖ ﬁ Σς"]
    some = odd + list(texts.values())[:150]
    ids, at = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).encode(pa.array(some))
    for i, t in enumerate(some):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_first_fit_decreasing_against_a_scan():
    lengths = np.sort(np.random.default_rng(2).integers(1, 100, 300))[::-1]
    free, want = [], []
    for n in lengths:
        b = next((i for i, f in enumerate(free) if f >= n), len(free))
        if b == len(free):
            free.append(100)
        free[b] -= n
        want.append(b)
    assert packing.first_fit_decreasing(lengths, 100).tolist() == want
    assert packing.first_fit_decreasing(np.zeros(0, np.int64), 100).tolist() == []


def test_special_tokens_are_the_tokenizers(spark, tokenizer):
    texts = {1: "x <|endoftext|> y", 2: "a<|startoftext|>b<|endoftext|>", 3: "<|ENDOFTEXT|> <|end", 4: "a \u00a0<|endoftext|>\u2003b"}
    check(packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts, tokenizer)


def test_full_pieces_are_sequences_by_themselves(spark, tokenizer):
    texts = {i: "river stone " * (900 * i) for i in range(4)}
    made = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    rows = made.collect()
    check(rows, texts, tokenizer)
    assert all((r["sequence_id"] < 0) == (r["length"] == packing.SEQUENCE) and (r["length"] < packing.SEQUENCE or r["offset"] == 0) for r in rows)
