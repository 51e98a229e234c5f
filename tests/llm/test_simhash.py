import numpy as np
import pyarrow as pa
import pytest
import xxhash

from logweave.llm.components import components
from logweave.llm.simhash import (
    _spanning,
    fingerprint_texts,
    keep_one,
    linked_pairs,
    posting_sets,
    simhash_groups,
)

SCHEMA = "doc_id long, text string"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_fingerprint(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


TEXTS = [None, "", " \t\n", "One", "one\x0b", "a b", "A  b\r\n", "a b c", "ä ß ü ö", "ÄB C D e", "x " * 50, "word " * 3 + "  y z"]


def test_fingerprints_are_those_of_the_definition():
    rng = np.random.default_rng(1)
    texts = [*TEXTS, *(" ".join(f"w{k}" for k in rng.integers(0, 40, n)) for n in (3, 4, 200, 3000))]
    got = fingerprint_texts(pa.array(texts, pa.string()))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("width", [3, 5])
def test_every_close_pair_shares_a_posting(width):
    sets = posting_sets(3, width)
    for differing in ((0, 1, 2), (5, 6, 7), (0, 4, 7), (3, 4, 5)):
        assert any(not set(s) & set(differing) for s in sets)


def test_spanning_forest_joins_what_all_links_join():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 30))]))
    links = [(a, b) for a in prints.tolist() for b in prints.tolist() if a < b and (a ^ b).bit_count() <= 3]
    edges = [(int(a), int(b)) for a, b in _spanning(prints, 3)]
    assert plain_components(prints.tolist(), edges) == plain_components(prints.tolist(), links)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components({n for e in edges for n in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [3, 5])
def test_groups_equal_all_pairs(spark, width):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    flips = [int(x) ^ (1 << int(b)) ^ (1 << int(c)) for x in base for b, c in rng.integers(0, 63, (3, 2))]
    cluster = [int(base[0]) ^ (1 << b) for b in range(60)]
    prints = sorted({*map(int, base), *flips, *cluster})
    got = linked_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, width).collect()
    mask = (1 << 64) - 1
    links = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & mask).bit_count() <= 3]
    assert plain_components(prints, [(r.a, r.b) for r in got]) == plain_components(prints, links)


def documents(spark):
    long = " ".join(f"w{k % 97}x{k}" for k in range(2000))
    texts = [*TEXTS, long, long + " tail", long.replace("w5x5 ", "changed ", 1), long, "quite another text of seven words"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(4, ""), (None, long), (None, "lonely text without any id")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_documents_with_nulls_ties_and_copies(spark):
    df, rows = documents(spark)
    prints = [plain_fingerprint(t) for _, t in rows]
    ends = range(len(rows))
    links = [(a, b) for a in ends for b in ends if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = plain_components(ends, links)
    least = {}
    for k in ends:
        if rows[k][0] is not None:
            least[root[k]] = min(least.get(root[k], rows[k][0]), rows[k][0])
    want = sorted((str(i), f"{prints[k]:016x}", str(least.get(root[k]))) for k, (i, _) in enumerate(rows))
    got = simhash_groups(df.withColumn("FP", df.text).repartition(3)).collect()
    assert sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id)) for r in got) == want
    kept = keep_one(df).collect()
    assert len(kept) == len(set(root.values()))
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(least.get(r)) for r in root.values()})


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash_groups(none).count() == 0
    assert keep_one(none).columns == ["doc_id", "text"]
