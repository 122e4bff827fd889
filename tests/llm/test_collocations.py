import random
from collections import Counter

import duckdb
import pytest

from shelfmark.llm import collocations as c


def in_sql(docs, least=None):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    sql = c.ORACLE_SQL if least is None else c.ORACLE_SQL.replace("count(*) >= 100", f"count(*) >= {least}")
    return sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({sql})").fetchall(), key=str)


def found(docs, settings):
    return sorted((tuple(r) for r in c.collocations(docs, settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()), key=str)


@pytest.mark.parametrize("burst, entries", [(1, 10), (3, 40), (1000, 1000)])
@pytest.mark.parametrize("n", [1, 3])
def test_trie_counts_and_spills_like_a_counter(burst, entries, n):
    r = random.Random(burst + n)
    trie, want, got, runs = c.HatTrie(burst), Counter(), Counter(), 0

    def keep(spilled):
        count = 0
        for prefix, keys, counts in spilled:
            assert keys == sorted(set(keys))  # a sorted run, each key once
            got.update({(prefix, k): x for k, x in zip(keys, counts)})
            count += 1
        return count

    for _ in range(1000):
        prefix = bytes([r.randrange(6)]) * 8
        keys = [b"".join(min(r.randrange(9), r.randrange(9)).to_bytes(8, "big") for _ in range(n)) for _ in range(3)]
        trie.add(prefix, keys, [2, 1, 1])
        for key, count in zip(keys, [2, 1, 1]):
            want[prefix, key] += count
        if trie.entries > entries:
            runs += keep(trie.spill(entries // 2))
            assert trie.entries <= entries // 2
    runs += keep(trie.spill())
    assert got == want and trie.entries == 0 and (entries >= 1000 or runs > 12)


def test_merger_adds_runs():
    import numpy as np

    r = random.Random(4)
    merger, want = c.Merger(3), Counter()
    for _ in range(20):
        run = sorted({(r.randrange(5), r.getrandbits(63) if r.random() < 0.1 else r.randrange(5)) for _ in range(30)})
        counts = [r.choice([1, 7, 1 << 20]) for _ in run]
        want.update(dict(zip(run, counts)))
        wide = np.uint32 if r.random() < 0.5 else np.int64
        merger.add(np.array(run, dtype=">u8").tobytes(), np.array(counts, dtype=wide).tobytes())
    ids, counts = merger.merged()
    assert dict(zip(map(tuple, ids.tolist()), counts.tolist())) == want


def test_odd_texts_equal_sql(spark, documents):
    r = random.Random(3)
    words = ["New", "york", "CITY", "ünï", "a", "b.c", "x-y", "\x00", " z", "ÉA"]
    rows = [(k, " ".join(r.choice(words) + r.choice(["", "", "", ",", "\n", "\t", "!?"]) for _ in range(r.randrange(60))), r.choice(["en", "de fr", "de es", "", None])) for k in range(300)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, " \t.,", "en"), (1003, "new york city " * 4000, "en"), (1003, "new york city " * 4000, "en"), (None, "w" * 50_000 + " a b", "en")]
    docs = documents(*rows).repartition(3)
    for least, small in ((5, c.Settings(least=5, most_entries=60, burst=4, stretch=500)), (100, c.Settings())):
        want = in_sql(docs, least)
        assert want and found(docs, small) == want


def test_no_rows(spark, documents):
    docs = documents((1, "a b a b a b", "en"), (2, None, None))
    assert c.collocations(docs.limit(0)).count() == 0
    assert c.collocations(docs).count() == 0
    assert c.collocations(documents((1, "word, " * 200, "en"))).count() == 0  # a frequent word, no phrase


def test_bitmap_holds_every_member(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from shelfmark.llm.bitmaps import hashed_set

    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    members = np.array([r.h for r in rows.collect()])
    some = hashed_set(rows, F.col("h"), 5000)
    assert some.has(members).all() and 0.03 < some.filled() < 0.07
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000)
    assert abs(some.has(others).mean() - some.filled()) < 0.01
    assert hashed_set(rows, F.col("h"), 5000, most_bits=1 << 15).has(members).all()  # a smaller one holds them as well
    assert not hashed_set(rows.limit(0), F.col("h"), 0).has(members).any()
