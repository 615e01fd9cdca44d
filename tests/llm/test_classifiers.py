import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language, quality, sampling, toxicity
from ledgerloom.llm.common import raw_bytes
from tests.llm.brute import auc

LABELS = "doc_id long, quality int, toxic int"


def is_held_out(i, modulus, remainder):
    return zlib.crc32(str("" if i is None else i).encode()) % modulus == remainder


@pytest.fixture(scope="module")
def larger(spark):
    return "/root/testdata/sf0.1"


def test_quality_held_out(spark, larger):
    out = quality.op10_quality(spark, larger)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == is_held_out(r["doc_id"], 5, 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert auc([r["score"] for r in held], [r["quality"] for r in held]) > 0.97
    good = [r for r in held if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)


def test_toxicity_held_out(spark, larger):
    out = toxicity.op8_toxicity(spark, larger)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.9


def test_misspelt_words_share_ngrams():
    rng = np.random.default_rng(0)
    words = ["river", "stone", "table", "garden", "window", "paper", "silver", "morning"]
    plain = [" ".join(rng.choice(words, 60)) for _ in range(150)]
    bad = [t.replace("stone", "blorptastic", 2) for t in plain]
    weights, bias = toxicity.train(plain + bad, [0] * 150 + [1] * 150)
    line = " ".join(["river table window paper"] * 15)
    texts = pa.array([line, line + " blorptastik blorptastiic", line + " unrelated sentence"])
    clean, misspelt, other = toxicity.scores(*raw_bytes(texts), weights, bias)
    assert misspelt > 0.5 > clean and misspelt > other


def test_language_held_out(spark, larger):
    rows = language.op1_language(spark, larger).join(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 10_000 and all(r["held_out"] == is_held_out(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["a", "b", "ab", "ba", "aba"])
    p = np.array([0.3, 0.1, 0.25, 0.15, 0.2, 0.0])[:, None]
    chars = np.array([[ord(c) for c in "abab"]], np.uint64)
    value = {"a": 0.3, "b": 0.1, "ab": 0.25, "ba": 0.15, "aba": 0.2}

    def total(word):
        return 1.0 if not word else sum(v * total(word[len(k) :]) for k, v in value.items() if word.startswith(k))

    assert np.isclose(language.forward(pieces.of(chars), p)[-1, 0, 0], total("abab"))


@pytest.mark.parametrize("kind", ["quality", "toxicity", "language"])
def test_odd_rows(spark, odd, empty, kind):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], LABELS)

    def run(rows, labels=labels):
        if kind == "quality":
            return quality.quality(rows, quality.fit(rows, labels))
        if kind == "toxicity":
            return toxicity.toxicity(rows, *toxicity.fit(rows, labels))
        return language.identify(rows, language.fit(rows, F.lit(True)))

    found = run(odd).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    same = {r["doc_id"]: r["score"] for r in found}
    assert same[5] == same[6]
    if kind == "language":
        assert all(r["lang_pred"] == "und" for r in found if r["doc_id"] in (1, 2, 3))
    assert run(empty, labels.where("false")).collect() == []
    if kind != "language":
        none = run(odd, labels.where("false")).collect()
        assert {round(r["score"], 6) for r in none} == {0.5}


def test_equal_texts_score_equally_beside_any_neighbour():
    texts = pa.array(["the same text again and again", "zzz", "the same text again and again", "", "the same text again and again"])
    net = quality.Network()
    q = net.scores(*raw_bytes(texts))
    weights = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    t = toxicity.scores(*raw_bytes(texts), weights, 0.1)
    for s in (q, t):
        assert np.allclose(s[0], s[2]) and np.allclose(s[0], s[4])


def long_rows(spark):
    """Documents far over the sample's bound only; the first kind's words stand in every part of its texts."""
    rows = [(i, ("river stone garden window " if i % 2 else "blorp zzyx qwrk vvmn ") * 4000, "en" if i % 2 else "xx") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_long_documents_alone_train_the_classifiers(spark):
    docs = long_rows(spark)
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as quality", "int(doc_id % 2) as toxic")
    for out in (quality.quality(docs, quality.fit(docs, labels)), toxicity.toxicity(docs, *toxicity.fit(docs, labels))):
        assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in out.collect())
    found = language.identify(docs, language.fit(docs, F.lit(True))).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "xx") for r in found)


def test_labels_without_documents_do_not_shrink_the_sample(spark):
    docs = long_rows(spark)
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as quality").unionByName(spark.range(1000, 40_000).selectExpr("id as doc_id", "int(id % 2) as quality"))
    sample = sampling.labelled_sample(docs, labels, "quality", F.lit(True), (10, 10), 2000)
    assert sorted(y for _, y in sample) == [0] * 10 + [1] * 10
    assert all(1900 <= len(t) <= 2003 for t, _ in sample)


def test_a_rare_language_beside_a_very_frequent_one(spark):
    many = spark.range(1_000_000).selectExpr("id as doc_id", "concat('the river and the stone number ', id) as text", "'en' as lang")
    docs = many.unionByName(spark.createDataFrame([(-1, "qua vork nym zephil ostra", "xx")], "doc_id long, text string, lang string"))
    sample = sampling.per_value_sample(docs, "lang", F.lit(True), 50, 1000)
    assert len(sample["en"]) == 50 and sample["xx"] == ["qua vork nym zephil ostra"]


@pytest.mark.parametrize("copy", ["one text for all", "another text for all", "a third text", "zhun veb otta", "x"])
def test_no_language_vanishes_where_texts_repeat(spark, copy):
    rows = spark.range(0, 1_000_000, 1, 5)
    docs = rows.selectExpr("id as doc_id", f"'{copy}' as text", "'en' as lang")
    docs = docs.unionByName(rows.where("id < 60000").selectExpr("id as doc_id", f"concat('{copy} ', id % 3) as text", "'xx' as lang")).unionByName(rows.where("id < 5").selectExpr("id as doc_id", f"'{copy}' as text", "'yy' as lang"))
    sample = sampling.per_value_sample(docs, "lang", F.lit(True), 50, 1000)
    assert sample == {"en": [copy], "xx": [f"{copy} {k}" for k in range(3)], "yy": [copy]}


def test_bottom_hashes_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "HELD", 10)
    rows = spark.range(0, 3000, 1, 7).selectExpr("string(id % 4) as v", "xxhash64(id % 500) as h")
    want = {}
    for r in rows.distinct().collect():
        want.setdefault(r["v"], []).append(r["h"])
    got = {}
    for r in sampling.smallest_hashes(rows, 20).collect():
        got.setdefault(r["v"], []).append(r["h"])
    assert {v: sorted(h) for v, h in got.items()} == {v: sorted(h)[:20] for v, h in want.items()}


def test_many_languages(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} " * 3, f"l{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert len(model.languages) == 300
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) >= 270
    monkeypatch.setattr(sampling, "MOST_VALUES", 10)
    more = docs.unionByName(docs.where("doc_id >= 290"))
    assert list(sampling.per_value_sample(more, "lang", F.lit(True), 5, 100)) == [f"l{i}" for i in range(290, 300)]


def test_quality_score_by_plain_loops():
    rng = np.random.default_rng(2)
    net = quality.Network(5)
    net.bias = rng.normal(0, 0.1, quality.FILTERS).astype(np.float32)
    texts = ["", "short", "a longer text with words. " * 90, "\u00fcber " * 40]
    found = net.scores(*raw_bytes(pa.array(texts)))
    for text, score in zip(texts, found):
        raw = text.encode() + b"\0" * quality.WIDTH
        n, maxima = len(text.encode()), []
        for a in range(0, max(1, n - quality.CHUNK + quality.STEP), quality.STEP):
            best = np.zeros(quality.FILTERS)
            for i in range(a, min(a + quality.CHUNK, n)):
                best = np.maximum(best, net.bias + sum(net.table[k][raw[i + k]] for k in range(quality.WIDTH)))
            maxima.append(best)
        z = np.concatenate([np.mean(maxima, 0), np.max(maxima, 0)]) @ net.head + net.shift[0]
        assert np.isclose(score, 1 / (1 + np.exp(-z)), atol=1e-5)


def test_toxicity_score_by_plain_loops():
    weights = np.random.default_rng(3).normal(size=toxicity.BUCKETS).astype(np.float32) * 20

    def bucket(gram):
        h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for c in gram:
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 14

    for text in ("Hello hello world, x", "", "caf\u00e9 au lait " * 150):
        x = bytes(int(toxicity.FOLD[c]) for c in b"\n" + text.encode() + b"\n")
        # a word that repeats the one before it adds nothing
        repeated, last, at = set(), None, 0
        for word in x.split(b" "):
            if word and word == last:
                repeated.update(range(at, at + len(word)))
            last = word or last
            at += len(word) + 1
        grams = {}
        for n in toxicity.SIZES:
            for i in range(len(x) - n + 1):
                if x[i + 1] != 32 and i + 1 not in repeated and 32 not in x[i + 2 : i + n - 1]:
                    grams.setdefault(i, []).append(weights[bucket(x[i : i + n])])
        size, best = len(x) - 2, []
        for a in range(0, max(1, size - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            own = [w for i, ws in grams.items() if a <= i < min(a + toxicity.WINDOW + 1, size + 1) for w in ws]
            best.append(sum(own) / (len(own) + toxicity.PRIOR) + 0.3)
        score = toxicity.scores(*raw_bytes(pa.array([text])), weights, 0.3)[0]
        assert np.isclose(score, 1 / (1 + np.exp(-max(best))), atol=1e-4)


def test_language_score_by_plain_sums(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the river runs by the town", "en"), ("der Fluss fliesst an der Stadt", "de")])], "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    known = {p: i for i, p in enumerate(language.vocabulary(model.path))}
    text = "The town, der Fluss"

    def total(word, column):
        sums = [1.0]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[a] * model.probability[known.get(word[a:end], len(known) if end == a + 1 else -1), column] for a in range(end) if word[a:end] in known or end == a + 1))
        return sums[-1]

    logs = [sum(np.log(total(w, c)) for w in ("the", "town", "der", "fluss")) for c in range(2)]
    lang, score = model.predict(pa.array([text]))
    assert lang[0] == model.languages[int(np.argmax(logs))]
    assert np.isclose(score[0], 1 / (1 + np.exp(min(logs) - max(logs))))


def test_long_words_sum_over_all_segmentations_too():
    """Blocks of a long word, chained, against the plain recursion over the whole word."""
    rng = np.random.default_rng(6)
    names = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 10))) for _ in range(120)} | {"a", "b", "c"})
    pieces = language.Pieces(names)
    p = rng.random((pieces.size, 2))
    known = {x: i for i, x in enumerate(names)}
    for n in (25, 48, 49, 700):
        word = "".join(rng.choice(list("abcz"), n, p=[0.4, 0.3, 0.28, 0.02]))
        sums, log = [np.ones(2)], 0.0
        for end in range(1, n + 1):
            total = sum(sums[end - k] * p[known.get(word[end - k : end], pieces.unknown)] for k in range(1, min(pieces.longest, end) + 1) if k == 1 or word[end - k : end] in known)
            sums.append(total)
            if end % 20 == 0:  # rescale what is still needed
                scale = total.copy()
                sums = [x / scale for x in sums]
                log = log + np.log(scale)
        assert np.allclose(language.log_long(pieces, word, p), log + np.log(sums[-1]))


def test_every_piece_is_found():
    rng = np.random.default_rng(7)
    names = sorted({"".join(rng.choice(list("abcdefghij"), rng.integers(2, 14))) for _ in range(30_000)})
    pieces = language.Pieces(names)
    for i in rng.integers(0, len(names), 500).tolist() + list(pieces.more_ids[pieces.more_ids >= 0]):
        chars = np.array([[ord(c) for c in names[i]]], np.uint64)
        assert pieces.of(chars)[len(names[i]) - 1, 0, 0] == i
