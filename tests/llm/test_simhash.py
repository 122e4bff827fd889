import random
import re

import numpy as np
import pytest
import xxhash

from shelfmark.llm import simhash
from shelfmark.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints, radius=2):
    """Smallest position that each reaches."""
    u, label = np.array(fingerprints, dtype=np.uint64), list(range(len(fingerprints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(u)):
            for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= radius):
                if label[j] != label[i]:
                    low = min(label[i], label[j])
                    changed = True
                    label[i] = label[j] = low
    return label


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "A b c d\x0be É é", "x y z x y z x y z", "\u0085   w"])
def test_fingerprints_of_small_texts(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_fingerprints_of_given_texts(given):
    for (text,) in given("sf0.001", "documents", "text"):
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_links_connect_what_lies_within_the_radius(spark):
    r = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        fp = r.getrandbits(64)
        for _ in range(r.randrange(1, 8)):
            fps.add(fp)
            for _ in range(r.randrange(1, 4)):
                fp ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = brute_components(fps)
    for tile in (3, 4096):  # many tiles of one profile, and one
        df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
        links = simhash.links(df, tile=tile)
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in links.collect())
        label = {row.node: row.label for row in connected_components(links).collect()}
        groups = {}
        for x, w in zip(signed, want):
            groups.setdefault(w, set()).add(label.get(x, x))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_of_documents(documents):
    copy = " ".join(f"word{k}" for k in range(300))
    near = copy.replace("word150", "other")
    rows = [(5, copy), (9, near), (3, copy), (3, copy), (7, "something else entirely here"), (8, None), (2, ""), (None, copy), (None, "alone without id"), (11, "word " * 40_000)]
    docs = documents(*rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(fps)
    for i, (doc_id, text) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        mine = [r for r in got if r.doc_id == doc_id and r.fingerprint == f"{fps[i]:016x}"]
        assert mine and all(r.component_id == (min(ids) if ids else None) for r in mine)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_keeps_whole_rows(documents):
    text = "a b c d e f g"
    docs = documents((5, text), (3, text), (3, text), (3, "x y z w other text"), (8, None), (9, ""), (None, text), (None, "nameless one here"), (None, "nameless one here"))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "nameless one here"), (3, text), (3, "x y z w other text"), (8, "")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
