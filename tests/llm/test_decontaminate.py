import random
import re

import pytest

from shelfmark.llm import decontaminate


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        w = words_of(item)
        n = min(10, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for p in range(len(words) - n + 1) if windows else ():
            if tuple(words[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(item_id)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def corpus(seed):
    r = random.Random(seed)
    alphabet = ["a", "B", "c1", "é", "d"]
    text = lambda n: r.choice([" ", ", ", "\n", "--"]).join(r.choice(alphabet) for _ in range(n))
    items = [(k, text(r.choice((0, 1, 3, 9, 10, 11, 25, 40)))) for k in range(12)] + [(None, text(14)), (50, None), (51, "?!")]
    docs = [(k, text(r.randrange(0, 60)) + " " + (items[r.randrange(12)][1] or "") + " " + text(5)) for k in range(40)]
    return docs, items


@pytest.mark.parametrize("seed", range(6))
def test_hits_are_those_of_all_windows(seed):
    docs, items = corpus(seed)
    known = decontaminate.Benchmark([(None if k is None else str(k), t) for k, t in items])
    for _, text in docs:
        for stretch in (1 << 20, 7):
            got = known.search(text, stretch)
            n, hit, found = brute(text, items)
            assert (got["n_words"], sum(s["end"] - s["start"] for s in got["spans"]), got["items"]) == (n, hit, found)


def test_every_shared_span_is_found_wherever_it_lies():
    r = random.Random(9)
    item = [f"w{r.randrange(10**6)}" for _ in range(60)]
    known = decontaminate.Benchmark([("1", " ".join(item))])
    for at in range(51):
        text = "some other words " + " ".join(item[at : at + 10]) + " and more of them"
        assert known.search(text)["spans"] == [{"start": 3, "end": 13}]
        assert known.search(text.replace(item[at + 4], "changed"))["spans"] == []


def test_winnowing_picks_the_right_one_of_equals():
    import numpy as np

    assert decontaminate.winnow(np.array([5, 3, 3, 9, 1, 7], dtype=np.uint64), 3).tolist() == [2, 4]
    assert decontaminate.winnow(np.array([1, 2], dtype=np.uint64), 3).tolist() == []


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_over_documents_in_one_and_many_blocks(spark, documents, block_bytes):
    rows, items = corpus(3)
    rows += [(100, None), (101, ""), (None, items[7][1] or "x"), rows[5], (102, "zz " * 50_000)]
    docs = documents(*rows)
    benchmark = spark.createDataFrame(items + [items[3]], "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark, block_bytes)
    want = [(k, *brute(t, items)) for k, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=key) == sorted(want, key=key)
    kept = decontaminate.clean(docs, benchmark, block_bytes)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((k or -1, t or "") for (k, t), w in zip(rows, want) if not w[2])


def test_empty_tables(spark, documents):
    docs, none = documents((1, "a b c")), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, none).collect()] == [(3, 0, 0)]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0
    assert decontaminate.clean(docs, none).count() == 1


def test_query_and_sql_agree(spark):
    import duckdb

    from shelfmark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    result = con.execute(ORACLES["op2_benchmark_decontamination"])
    columns = [c[0] for c in result.description]
    got = QUERIES["op2_benchmark_decontamination"](spark, "/root/testdata/sf0.001")
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())
