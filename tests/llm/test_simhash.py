import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tripleweave.llm import simhash
from tripleweave.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in SPACE else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """[(id, fp)] -> least id reachable, row by row."""
    roots = list(range(len(prints)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                roots[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(prints))]


def compare(df, **more):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    prints = [(k, plain_fingerprint(t)) for k, t in rows]
    want = sorted((k if k is not None else -1, f"{fp:016x}", c) for (k, fp), c in zip(prints, plain_components(prints)))
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in simhash.near_copies(df, **more).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want


def test_documents(spark):
    compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_edges(table, edge_rows):
    compare(table(edge_rows))


def test_empty(table):
    out = simhash.near_copies(table([]))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "fingerprint", "component_id"]


def test_keys_grow_with_the_table():
    assert [simhash.blocks_for(n, 2) for n in (0, 10**6, 10**8, 10**10, 10**11)] == [3, 3, 4, 4, 5]


@pytest.mark.parametrize("tile,blocks", [(4, 3), (2048, None), (2048, 4), (4, 5)])
def test_links_connect_what_brute_force_connects(spark, tile, blocks):
    """A crowded neighbourhood, in whole buckets and in tiles, by keys of few bits and of many."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(150):
        v = centre
        for _ in range(rng.randint(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(100)} | {0, 1, 2**64 - 1}
    prints = [(i, v) for i, v in enumerate(sorted(values))]
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for _, v in prints], "fp long")
    found = components(simhash.links(df, 2, tile, blocks))
    root = {r["node"]: r["root"] for r in found.collect()}
    want = plain_components(prints)
    signed = [int(np.uint64(v).astype(np.int64)) for _, v in prints]
    got = [root.get(v, v) for v in signed]
    same = {}
    for w, g in zip(want, got):
        assert same.setdefault(w, g) == g
    assert len(set(want)) == len(set(got))


def test_one_of_each(table):
    text = " ".join(f"w{i}" for i in range(200))
    df = table([(3, text), (1, text + " "), (2, text.upper()), (4, "other words here entirely")])
    out = simhash.one_of_each(df)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4] and out.columns == df.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3), (200, 7), (100, 101)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 0}
    named = components(spark.createDataFrame([("x", "y")], "p string, q string"), "p", "q")
    assert {(r["node"], r["root"]) for r in named.collect()} == {("x", "x"), ("y", "x")}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def near_copy(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("bucket", [16, 4096])
def test_near_texts(spark, table, bucket, monkeypatch):
    """Copies with a word in fifty changed are found, in small buckets or over large ones; unrelated texts of the same
    words are not."""
    monkeypatch.setattr(simhash.candidates, "__defaults__", (simhash.WIDE_RADIUS, 0.8, bucket))
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 400))] for _ in range(120)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, near_copy(rng, texts[i], 0.015)) for i in range(0, 120, 2)] + [(2000 + i, near_copy(rng, texts[0], 0.01)) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(table(rows)).collect()}
    assert all(got[i] == i for i in range(120))
    assert all(got[1000 + i] == i for i in range(0, 120, 2)) and all(got[2000 + i] == 0 for i in range(60))


def test_near_texts_edges(table, edge_rows):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_texts(table(edge_rows)).collect()]
    assert len(got) == len(edge_rows) and {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (None, 1), (None, 4)} <= set(got)
    assert simhash.one_of_each(table([])).count() == 0


def plain_near(rows, similarity=0.8):
    """[(id, text)] -> {id: least id reached over pairs of the similarity or more}, by sets of five-word shingles."""
    sets = []
    for k, text in rows:
        words = text.lower().split()
        sets.append((k, {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}))
    root = {k: k for k, _ in rows}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if root[a] != root[b] and len(x & y) >= similarity * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def boundary_rows(pairs):
    """Pairs on both sides of a similarity of 0.8: a text, and it without its last `less` words and with `more` others."""
    rng = random.Random(5)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n, less, more in pairs:
        text = words(n)
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text[: n - less] + words(more)))]
    return rows


def near_of(df):
    return {r["doc_id"]: r["component_id"] for r in simhash.near_texts(df).collect()}


def test_near_texts_drop_only_confirmed_pairs(table):
    """Pairs of a similarity from 0.65 to just under 0.8 are no near copies."""
    rows = boundary_rows([(104, 11, 11), (104, 12, 12), (104, 15, 15), (304, 33, 33), (304, 34, 34), (304, 50, 50), (304, 0, 75), (304, 0, 76)] * 6)
    assert near_of(table(rows)) == plain_near(rows)


def test_near_texts_miss_no_short_pair(table):
    rows = boundary_rows([(8, 0, 1), (8, 0, 2), (16, 0, 3), (16, 0, 4), (36, 0, 8), (36, 0, 9), (44, 0, 10), (44, 0, 11), (24, 2, 2), (24, 3, 3)] * 6)
    assert near_of(table(rows)) == plain_near(rows)


def test_near_texts_count_repeats_once(table):
    """A line ten times over neither links texts that share nothing else nor parts those that differ in it alone."""
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    line, body = words(16), words(120)
    rows = [(i, " ".join(line * 10 + words(60))) for i in range(12)] + [(20, " ".join(body + line)), (21, " ".join(body + line * 10))]
    want = plain_near(rows)
    assert want[21] == 20 and want[11] == 11 and near_of(table(rows)) == want


@pytest.mark.parametrize("cell", [3, 512])
def test_confirmed_in_cells(spark, cell):
    """Chains of sets, whole and in cells: only pairs of the similarity link, and none in another cell is left out."""
    sets = [set(range(k, k + 90)) for k in range(0, 100, 10)] + [set(range(k, k + 90)) for k in range(120, 400, 11)] + [set(range(5, 95)) | {1000 + i} for i in range(20)]
    rows = [(7, i, len(s), np.sort(np.array(list(s), np.uint64)).tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "root long, row long, size long, shingles binary")
    found = {r["node"]: r["root"] for r in components(simhash.confirmed(df, 0.8, cell)).collect()}
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert {k: r for k, r in enumerate(root) if root.count(r) > 1} == found


def test_one_row_of_each_class_stays(table, edge_rows):
    """Ids that repeat over different near copies, rows that repeat whole, and rows without ids."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1, " ".join(words)), (1, " ".join(words[:-3])), (1, " ".join(words)), (2, " ".join(words + ["end"])), (None, " ".join(words + ["more"])), (9, "alone in its class"), (9, "another text of this id"), (None, "no id here"), (None, "no id here"), *[(k and k + 100, t) for k, t, *_ in edge_rows]]
    df = table(rows)
    out = simhash.one_of_each(df)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    least = min(((hashlib.md5(t.encode()).hexdigest(), t) for t in (" ".join(words), " ".join(words[:-3]))))[1]
    want = [("1", least), ("9", "alone in its class"), ("9", "another text of this id"), ("None", "no id here")]
    assert [x for x in kept if x[0] in ("1", "2", "9")] == want[:3] and want[3] in kept
    assert out.columns == df.columns and len(kept) == len(set(plain_classes(rows)))


def plain_classes(rows):
    """The first row that each row reaches over pairs of the similarity."""
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_recall_on_shared_documents(spark):
    """Of all pairs of different texts whose five-word sets are similar by 0.8 or more, at least 0.9 must share a class,
    with the bands, the radius and the sizes that ship."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets, index, seen = [], defaultdict(list), set()
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        words = (r["text"] or "").lower().split()
        made = frozenset(hash(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) if words else frozenset()
        if words and made not in seen:
            seen.add(made)
            sets.append((r["doc_id"], made))
    count = Counter(x for _, made in sets for x in made)
    pairs = set()
    for n, (_, made) in enumerate(sets):  # sets that are so similar share one of their rarest members
        rare = sorted(made, key=lambda x: (count[x], x))[: len(made) - int(np.ceil(0.8 * len(made))) + 1]
        for x in rare:
            for m in index[x]:
                other = sets[m][1]
                if min(len(made), len(other)) >= 0.8 * max(len(made), len(other)) and len(made & other) >= 0.8 * len(made | other):
                    pairs.add((m, n))
            index[x].append(n)
    found = near_of(docs)
    met = sum(found[sets[a][0]] == found[sets[b][0]] for a, b in pairs)
    assert len(pairs) > 40 and met >= 0.9 * len(pairs)
    print(f"{met} of {len(pairs)} pairs")


def test_band_recall_at_the_boundary():
    """Pairs just at a similarity of 0.8 share a band, and fingerprints within the radius, nearly always."""
    rng = np.random.default_rng(3)
    missed = 0
    for n in range(400):
        size = int(rng.integers(40, 400))
        shared = int(np.ceil(size * 0.8))
        both = rng.integers(0, 1 << 63, shared, np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, k, np.uint64)]) for k in ((size - shared) // 2, size - shared - (size - shared) // 2))
        missed += not set(simhash.band_keys(a)) & set(simhash.band_keys(b))
    assert missed <= 4
