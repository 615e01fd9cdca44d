import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import decontaminate as d


def test_common_subsequence_against_a_table():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(0, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
        assert d.common_subsequence(a, b) == best[-1][-1]


def words(text):
    return d.words_of(pa.array([text]))[0].tolist()


def test_whole_table_against_brute_force(spark, medium, texts):
    """Recall of the latent search, at the operator's own thresholds, against every item held against every passage of every document."""
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()}
    held = {k: words(t) for k, t in texts.items()}
    truth = set()
    for key, w in held.items():
        have = set(w)
        for item, v in items.items():
            if len(have & set(v)) < d.WEAK * len(set(v)):
                continue
            for a in range(0, max(1, len(w) - d.WINDOW + 1), d.STRIDE):
                near = w[max(0, a - len(v)) : a + d.WINDOW + len(v)]
                share, answer = d.common_subsequence(v, near) / len(v), v[-d.ANSWER_WORDS :]
                if share >= d.STRONG or share >= d.WEAK and d.common_subsequence(answer, near) >= len(answer) - 1:
                    truth.add((key, item))
                    break
    found = {(r["doc_id"], r["item_id"]) for r in d.op5_decontaminate(spark, medium).collect()}
    assert len(truth) > 10 and len(truth & found) >= 0.9 * len(truth)
    assert len(found - truth) <= 0.1 * len(found)


def test_paraphrases_and_clean_documents(spark, medium, texts):
    rnd = random.Random(5)
    benchmark = spark.read.parquet(f"{medium}/benchmark.parquet")
    vocabulary = [w for t in list(texts.values())[:100] for w in t.split()[:30]]
    planted = []
    for n, item in enumerate(benchmark.collect()):
        w, host = item["text"].split(), rnd.choice(list(texts.values())).split()
        for k in rnd.sample(range(len(w) - 1), len(w) // 6):
            w[k] = rnd.choice(vocabulary)
        at = rnd.randrange(len(host) + 1)
        planted.append((10**6 + n, " ".join(host[:at] + w + host[at:]), item["item_id"]))
    rows = spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string")
    both = rows.unionByName(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text"))
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(both, benchmark).where("doc_id >= 1000000").collect()}
    assert np.mean([(a, i) in found for a, _, i in planted]) >= 0.9
    kept = {r["doc_id"] for r in d.without_leaks(both, benchmark).collect()}
    assert not kept & {a for a, _ in found} and len(kept) > 0.9 * len(texts)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "A short text, nothing more."), (None, "without an id"), (3, None), (4, ""), (5, "🙂 !!!")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(odd, items).collect()}
    assert {(5, 1), (6, 1)} <= found
    kept = d.without_leaks(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 4, 7, 8}
    assert d.leaks(empty, items).collect() == [] and d.leaks(odd, items.where("false")).collect() == []
    assert d.without_leaks(odd, items.where("false")).count() == odd.count()


def test_items_in_blocks(spark):
    items = spark.createDataFrame([(i // 2, f"item {i}") for i in range(9)] + [(None, "null id"), (3, None)], "item_id long, text string")
    blocks = list(d.item_blocks(items, 4))
    assert [len(b) for b in blocks] == [4, 4, 2] and len({x for b in blocks for x in b}) == 10


def test_item_in_a_third_of_all_rows(spark, medium, texts):
    """Copies of an item, in different documents and changed a little, take no weight from its words."""
    rnd = random.Random(6)
    benchmark = spark.read.parquet(f"{medium}/benchmark.parquet").select("item_id", "text")
    item = benchmark.orderBy("item_id").first()
    vocabulary = [w for t in list(texts.values())[:100] for w in t.split()[:30]]
    rows, hosts = [], list(texts.values())
    for n in range(len(texts) // 2):
        w, host = item["text"].split(), rnd.choice(hosts).split()[:200]
        for k in rnd.sample(range(len(w) - 1), len(w) // 6 if n % 2 else 0):
            w[k] = rnd.choice(vocabulary)
        at = rnd.randrange(len(host) + 1)
        rows.append((10**6 + n, " ".join(host[:at] + w + host[at:])))
    both = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text"))
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(both, benchmark).where("doc_id >= 1000000").collect()}
    held = [(a, item["item_id"]) in found for a, _ in rows]
    assert all(held[::2]) and np.mean(held) >= 0.97


def test_item_of_everyday_words(spark, texts):
    """An item of the most frequent words is found where it stands, amid words of other items."""
    from collections import Counter

    rnd = random.Random(7)
    common = [w for w, _ in Counter(w for t in texts.values() for w in set(t.lower().split()) if w.isalpha()).most_common(12)]
    item = " ".join(rnd.choice(common) for _ in range(14))
    hosts = [t for t in texts.values() if 60 < len(t.split()) < 300]
    items = spark.createDataFrame([(1, item)] + [(2 + i, h) for i, h in enumerate(hosts[:20])], "item_id long, text string")
    rows = []
    for n in range(40):
        host = hosts[n % 20].split()
        at = rnd.randrange(len(host) + 1)
        rows.append((n, " ".join(host[:at] + [item] + host[at:])))
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {(n, 1) for n in range(40)} <= found


def test_blocks_of_items_find_the_same(spark, medium):
    docs, benchmark = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df: sorted((r["doc_id"], r["item_id"]) for r in df.collect())
    whole, cut = rows(d.leaks(docs, benchmark)), rows(d.leaks(docs, benchmark.unionByName(benchmark.limit(3)), 15))
    assert len(set(whole) ^ set(cut)) <= 0.03 * len(whole)
    gone = {i for i, _ in cut}
    assert {r["doc_id"] for r in d.without_leaks(docs, benchmark, 15).collect()}.isdisjoint(gone & {i for i, _ in whole})


def test_items_of_few_words_match_whole_lines(spark):
    docs = spark.createDataFrame([(1, "first line\nThe Answer!\nlast"), (2, "the answer is here"), (3, "answer the"), (4, "the answer"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the answer"), (8, "the answer"), (9, "  "), (None, "last")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in d.leaks(docs, items).collect() if r["item_id"] is not None)
    assert found == [(1, 7), (1, 8), (4, 7), (4, 8)]
    assert sorted(r["doc_id"] for r in d.without_leaks(docs, items).collect()) == [2, 3, 5]


def test_contexts_are_counted_without_a_sample():
    """Registers of slices, joined by their maxima, count all distinct contexts; repeats do not add to them."""
    rng = np.random.default_rng(3)
    for n in (0, 50, 5_000, 300_000):
        seen = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        most = np.maximum.reduce([d.registers(seen[a::3]) for a in range(3)] + [d.registers(seen)])
        assert abs(d.distinct_contexts(most) - n) <= 0.06 * n


def test_every_document_shapes_the_directions(spark, monkeypatch):
    """The fit reads each row of the table it is given, whatever the number of rows."""
    read = []
    monkeypatch.setattr(d, "random_svd", lambda rows, items, terms, idf, rank=d.RANK: read.append(rows.count()) or np.eye(len(idf), dtype=np.float32))
    rows = spark.range(25_000).selectExpr("id as doc_id", "concat('alpha beta ', id) as text")
    assert d.build_index(rows, [(1, "alpha beta gamma delta")]) is not None
    assert read == [25_000]


def test_directions_span_what_the_passages_hold(spark, medium):
    """The directions of one pass hold nearly as much of the items' passages as the best of that rank."""
    items = [r["text"] for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    docs = d.documents_only(spark.read.parquet(f"{medium}/documents.parquet"))
    w, _ = d.words_of(pa.array(items))
    terms = d.Terms(np.unique(w))
    idf = d.frequencies(docs, terms)
    basis = d.random_svd(docs.select("text"), pa.array(items), terms, idf, 16)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    texts = [r["text"] for r in docs.collect()]

    def gram(some):
        words_, counts = d.words_of(pa.array(some))
        begin, end, _ = d.windows(counts)
        passage, term, value = d.passage_vectors(terms.of(words_), begin, end, idf)
        dense = np.zeros((len(begin), len(idf)))
        dense[passage, term] = value
        return dense.T @ dense

    c, own = gram(texts), gram(items)
    c = c / np.trace(c) + own / np.trace(own)
    best = np.linalg.eigvalsh(c)[::-1][:16].sum()
    assert np.trace(basis.T @ c @ basis) >= 0.85 * best
