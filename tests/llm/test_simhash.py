import random
import re

import numpy as np
import pytest
import xxhash

from tidewell.llm import simhash
from tidewell.llm.common import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_of_odd_texts():
    for t in (None, "", " \t\n", "one", "A b", "a b c", "a b c d", "a b c d e f g", "É é  É\x0bé x", "w " * 5000):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randint(0, 40)) for _ in range(200)) for _ in range(12)]
    texts = []
    for t in base:
        words = t.split()
        texts += [t, t, t + " end", " ".join(words[:3] + ["new"] + words[4:]), " ".join(words[:80])]
    texts += [None, "", "\n", "short one", "Short ONE"]
    rows = [(10 * k + 7, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    got = {r.id: (r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = components(fps)
    assert got == {rows[k][0]: (fps[k], rows[want[k]][0]) for k in range(len(rows))}


@pytest.mark.parametrize("fit", [2_000, 5])
def test_links_at_four_bits_and_not_at_five(spark, monkeypatch, fit):
    monkeypatch.setattr(simhash, "FIT", fit)
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        a = rng.getrandbits(64)
        fps.append(a)
        for n in (4, 5):
            fps.append(a ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps += [fps[0] ^ (k << 20) for k in range(1, 60)]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in fps], "fp long")
    low = lambda r, tag: [x for x in fps if bin(((x >> 32 * tag) & 0xFFFFFFFF) ^ (r & 0xFFFFFFFF)).count("1") <= 1]
    hot = simhash.hot_keys(df).collect()
    assert all(r.parts == -(-len(low(r.k, r.k >> 32)) // fit) for r in hot) and bool(hot) == (fit == 5)
    links = simhash.near_links(df).collect()
    for r in links:
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()} if links else {}
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in fps]
    groups = components(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (groups[i] == groups[j]) == (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j]))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "x y z x y z"), (2, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sum(r.component == 1 for r in got) == 2
    near = [(None, "a b c d e f g h"), (3, "A b c d e f g h"), (2, None), (None, "")]
    assert sorted((r.id or 0, r.component) for r in simhash.near_duplicates(spark.createDataFrame(near, "doc_id long, text string")).collect()) == [(0, 2), (0, 3), (2, 2), (3, 3)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(5, 5), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {200 + k: 100 for k in range(50)} | {301: 300}
