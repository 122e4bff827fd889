import random
import re

import duckdb
import numpy as np
import pytest

from shelfmark.llm import minhash as m


def plain_set(text):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def plain_classes(rows):
    """(doc_id, n_shingles, component_id, kept) of every row, from all pairs."""
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i, one in enumerate(sets):
        for j in range(i):
            if one and sets[j] and 100 * len(one & sets[j]) >= 85 * len(one | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), first, doc_id is not None and doc_id == first))
    return sorted(out, key=str)


def variants(r, n, length, changes):
    """Near copies of one text at all kinds of similarity."""
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    for _ in range(n):
        words = list(base)
        for _ in range(r.randrange(changes)):
            words[r.randrange(length)] = f"v{r.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("text", [None, "", " \n\t\x0b", "One", "one Two", "a b c", "a b c a b c", "x \u0085 y", "É é", "\x1f \x00"])
def test_shingles(text):
    assert len(m.shingles(text, 3)) == len(plain_set(text))


def test_shingles_do_not_depend_on_stretches():
    r = random.Random(1)
    text = " ".join(r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(4000))
    for stretch in (3, 50, 1 << 20):
        assert len(m.shingles(text, 3, stretch)) == len(plain_set(text))
        assert (m.shingles(text, 3, stretch) == m.shingles(text, 3)).all()


def test_signatures_estimate_similarity():
    r = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.85):
        gaps = []
        for _ in range(40):
            both, own = int(400 * share), 400 - int(400 * share)
            x = r.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64)
            a, b = np.sort(x[: both + own]), np.sort(np.concatenate([x[:both], x[both + own :]]))
            one, two = m.signatures([a, b])
            gaps.append((one == two).mean() - both / (both + 2 * own))
        assert abs(np.mean(gaps)) < 0.02  # 40 x 150 coordinates
    assert (m.signatures([np.empty(0, np.uint64)]) == 0xFFFFFFFF).all()


def test_classes_equal_all_pairs(documents):
    r = random.Random(11)
    rows = [(100 + k, t) for k, t in enumerate([*variants(r, 60, 80, 14), *variants(r, 25, 300, 30), *variants(r, 20, 8, 3)])]
    line = " ".join(f"common{k}" for k in range(20))
    rows += [(400 + k, f"{line} {r.random()} {r.random()} {r.random()} {r.random()}") for k in range(40)]
    copy = rows[3][1]
    rows += [(5, copy), (5, copy), (5, "another text of that id"), (None, copy), (None, "alone without id"), (6, None), (7, ""), (7, " \n"), (8, "two Words"), (9, "two words"), (None, None), (10, "long " * 30_000), (11, "long " * 50_000)]
    want = plain_classes(rows)
    got = m.near_duplicates(documents(*rows).repartition(4))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
    # tiles of a few nodes give the same
    small = m.Settings(tile=7, tile_shingles=500)
    assert sorted((tuple(x) for x in m.near_duplicates(documents(*rows), small).collect()), key=str) == want


def test_links_that_the_first_of_a_bucket_does_not_see():
    """A chain of three: its ends are not linked, the middle is with both."""
    r = random.Random(2)
    sets = [np.unique(np.array([r.getrandbits(62) for _ in range(200)])) for _ in range(3)]
    chain = [("a", np.arange(0, 100)), ("b", np.arange(8, 108)), ("c", np.arange(16, 116)), ("d", sets[0])]
    assert sorted(m.joined_labels(chain, chain, 85)) == [("a", "b"), ("b", "c")]
    assert m.joined_labels(chain[:1], chain[2:], 85) == [] and m.joined_labels(chain, [], 85) == []


def test_empty_table_and_sql(spark, documents, given):
    assert m.near_duplicates(documents((1, "a")).limit(0)).count() == 0
    rows = given("sf0.001", "documents", "doc_id, text")
    docs = documents(*rows)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({m.ORACLE_SQL})").fetchall()
    assert sorted(tuple(x) for x in m.near_duplicates(docs).collect()) == sorted(want)
