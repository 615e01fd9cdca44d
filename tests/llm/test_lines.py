import numpy as np

from ledgerloom.llm import line_templates as t
from ledgerloom.llm.common import raw_bytes

LOG = "request from host served in some time by the worker named {} without error"


def run(spark, rows, **kw):
    out = t.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out}


def own(i):
    return f"paragraph {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} has its own words that nobody else would ever write down here " * 3


def test_exact_and_variable_lines(spark):
    rows = [(i, own(i) + "\n" + LOG.format("bob" if i % 2 else f"u{i}") + "\n" + own(i + 50)) for i in range(12)]
    out = run(spark, rows)
    assert out[0] == (rows[0][1], 3, 0)
    for i in range(1, 12):
        assert out[i] == (own(i) + "\n" + own(i + 50), 3, 1)


def test_too_rare_lines_stay(spark):
    rows = [(i, own(i) + "\n" + (LOG.format("z") if i < 2 else "")) for i in range(6)]
    assert all(text == dict(rows)[i] for i, (text, _, _) in run(spark, rows).items())


def test_only_the_first_of_whole_copies_keeps_its_lines(spark):
    whole = "\n".join(own(i) for i in range(6))
    rows = [(i, whole) for i in range(5)] + [(9, whole.replace("nobody", "hardly anybody", 1))]
    out = run(spark, rows)
    assert out[0] == (whole, 6, 0) and all(out[i] == ("", 6, 6) for i in range(1, 5))
    assert out[9] == (rows[-1][1].split("\n")[0], 6, 5)


def test_pages_between_the_same_header_and_footer(spark):
    """40 pages with one sentence of their own between the same lines keep it, and all but the first lose the others."""
    header, footer = "welcome to the site of all our friends and neighbours " * 4, "all rights reserved by the people of this place " * 4
    rows = [(i, f"{header}\nsentence {'abcdefgh'[i % 8]}{'ijklm'[i // 8]} belongs here\n{footer}") for i in range(40)]
    out = run(spark, rows)
    assert out[0][2] == 0 and all(out[i] == (rows[i][1].split("\n")[1], 3, 2) for i in range(1, 40))


def test_long_passage_in_two_documents(spark):
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, own(1) + own(2) + own(3) + own(4) + "\n" + passage), (2, own(5) + own(6) + own(7) + own(8) + "\n" + passage + "\n" + own(9))]
    out = run(spark, rows)
    assert out[1][2] == 0 and out[2][2] == 1 and "pab" not in out[2][0]


def test_templates_meet_in_one_open_segment():
    texts = [LOG.format("bob"), LOG.format("alice"), LOG.format("bob").replace("some", "more"), "x " * 3, LOG.format("alice").replace("request", "Request")]
    import pyarrow as pa

    data, offsets = raw_bytes(pa.array(texts))
    lines, _ = t.line_offsets(data, offsets)
    keys, count = t.template_keys(data, lines)
    shared = lambda a, b: len(np.intersect1d(keys[a][keys[a] > 0], keys[b][keys[b] > 0]))
    assert shared(0, 1) == 1 and shared(0, 2) == 1 and shared(1, 2) == 0 and shared(0, 4) == 0
    assert count.tolist() == [14, 14, 14, 3, 14] and (keys[3][1:] == 0).all()


def brute_first(texts):
    """line -> documents with it, for lines as they stand with digits masked."""
    import collections
    import re

    held = collections.defaultdict(set)
    for key, text in texts.items():
        for line in text.split("\n"):
            tokens = ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if tokens:
                held[tuple(tokens)].add(key)
    return held


def test_whole_table_against_brute_force(spark, medium, texts):
    """Every exact template that recurs is found with its first document (open segments aside)."""
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    found = sorted(r["first"] for r in t.recurring_templates(docs).collect())
    want = []
    for tokens, keys in brute_first(texts).items():
        least = next(n for length, n in t.LEAST if len(tokens) >= length)
        if len(keys) >= least:
            want.append(min(keys))
    import collections

    assert not collections.Counter(want) - collections.Counter(found)
    out = t.op3_line_dedup(spark, medium).collect()
    assert len(out) == len(texts) and all(r["n_dropped"] <= r["n_lines"] for r in out)
    assert all(r["kept_chars"] == len(texts[r["doc_id"]]) for r in out if r["n_dropped"] == 0)
    assert any(r["n_dropped"] for r in out)


def test_odd_rows(odd, empty):
    out = t.dedup_lines(odd)
    assert set(odd.columns) <= set(out.columns)
    rows = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert len(out.collect()) == odd.count() and (None, "A row without an id but with words in it.") in rows
    assert t.dedup_lines(empty).collect() == []


def brute_drops(texts):
    """doc_id -> numbers of its dropped lines: templates are the masked tokens, whole or with one of eight runs of them left open."""
    import collections
    import re

    def templates(line):
        tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
        if not tokens:
            return len(tokens), []
        runs = [tuple(w for i, w in enumerate(tokens) if i * t.SEGMENTS // len(tokens) == k) for k in range(t.SEGMENTS)]
        lead = (len(tokens), tokens[: t.LEADING])
        open_ones = [(lead, k, *runs[:k], *runs[k + 1 :]) for k in range(t.SEGMENTS)] if len(tokens) >= t.SEGMENTS else []
        return len(tokens), [(lead, None, *runs), *open_ones]

    held, size, lines = collections.defaultdict(set), {}, {}
    for key, text in texts.items():
        lines[key] = [templates(line)[1] for line in (text or "").split("\n")]
        for line in (text or "").split("\n"):
            n, found = templates(line)
            for x in found:
                held[x].add(key)
                size[x] = n
    gone = {x: min(keys) for x, keys in held.items() if len(keys) >= next(n for length, n in t.LEAST if size[x] >= length)}
    return {key: [i for i, found in enumerate(own_lines) if any(gone.get(x, key) != key for x in found)] for key, own_lines in lines.items()}


def test_drops_against_brute_force(spark, medium, texts):
    """Which lines go, open segments included, on the whole table."""
    want = brute_drops(texts)
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    for r in t.dedup_lines(docs).collect():
        gone = want[r["doc_id"]]
        lines = texts[r["doc_id"]].split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert r["n_dropped"] == len(gone), r["doc_id"]
        assert r["text"] == kept or r["text"].rstrip("\n") == kept.rstrip("\n")


def test_short_line_at_two_table_sizes(spark):
    """A short line in 12 documents goes from 11 of them, in a small table as in a large one."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, own(i) + "\nshare this page") for i in range(12)], "doc_id long, text string")
    for more in (0, 30_000):
        other = spark.range(100, 100 + more).select(F.col("id").alias("doc_id"), F.translate(F.sha1(F.col("id").cast("string")), "0123456789", "ghijklmnop").alias("text"))
        out = t.dedup_lines(rows.unionByName(other)).where("doc_id < 100").collect()
        assert {r["doc_id"]: r["n_dropped"] for r in out} == {i: int(i > 0) for i in range(12)}
