"""The pipeline's stages and its run against plain versions, row by row."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleweave.llm import langid, mixing, packing

from .test_native import SPACES, plain_targets
from .test_simhash import plain_classes

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in df.collect()]


def plain_language(spark, df):
    model = langid.fit(df.where(~langid.held_out()), rank=F.xxhash64("doc_id"))
    ready = model.compressors()
    out = []
    for row in rows_of(df):
        lang, margin = langid.judge(row[1] or "", ready, model.block)
        if not ready or (lang != "und" and margin >= 0.002):
            out.append(row)
    return out


def plain_exact(rows):
    best = {}
    for row in rows:
        key = SPACES.sub(" ", row[1] or "")
        rank = (row[0] is None, row[0] or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, row)
    return [r for _, r in best.values()]


def plain_near(rows):
    best = {}
    for root, row in zip(plain_classes(rows), rows):
        rank = (row[0] is None, row[0] or 0, hashlib.md5((row[1] or "").encode()).digest())
        if root not in best or rank < best[root][0]:
            best[root] = (rank, row)
    return [r for _, r in best.values()]


def words(text):
    return len([x for x in SPACES.split(text or "") if x])


def plain_mixing(rows):
    sizes, streams, out = defaultdict(int), defaultdict(list), []
    for row in rows:
        sizes[row[2]] += words(row[1])
        order = hashlib.md5(f"{'null' if row[0] is None else row[0]} {hashlib.md5((row[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        streams[row[2]].append((order, row))
    targets = plain_targets(sizes)
    for source, stream in streams.items():
        before = 0
        for _ in range(2):
            for _, row in sorted(stream, key=lambda x: x[0]):
                size = words(row[1])
                if size and before + size / 2 <= targets[source]:
                    out.append(row)
                before += size
    return out


def plain_pieces(rows):
    tokenizer, out = Tokenizer.from_file(packing.vocabulary()), []
    for k, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out.append((str(k), n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out)


def same(df, rows):
    assert Counter(map(str, rows_of(df))) == Counter(map(str, rows))


def crowded(spark, table, edge_rows):
    """Shared documents, repeated ids, rows without ids, labels or texts, near copies, one long text."""
    shared = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = " ".join(f"{w}" for _, t, *_ in shared[:60] for w in (t or "").split())
    more = [(7, shared[3][1], "zz", "en"), (7, shared[3][1], "zz", "en"), (None, shared[4][1], None, None), (900_001, (shared[5][1] or "") + " end", "a", None), (900_002, long, "big", None), (900_003, long + " more", "big", "fr")]
    return table([*shared, *more, *[(k and k + 800_000, t, *r) for k, t, *r in edge_rows]])


def test_stages_and_run(spark, table, edge_rows, tmp_path):
    df = crowded(spark, table, edge_rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = plain_language(spark, docs)
    for name, step in (("language_id", lambda x: plain), ("exact_dedup", plain_exact), ("near_dedup", plain_near), ("mixing", plain_mixing)):
        plain = step(plain)
        out = STAGES[name](spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        same(docs, plain)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == plain_pieces(plain)
    fills = defaultdict(list)
    for r in got:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_without_labels_nothing_is_lost(spark, table):
    df = table([(1, "sound words of one kind", "a", None), (2, "other sound words", "a", None), (3, None, None, None)])
    assert STAGES["language_id"](spark, df, "").count() == 3


def test_empty_table(spark, table, tmp_path):
    table([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table([]), "").columns == table([]).columns


def test_rows_of_one_id_are_one_sample(spark, table):
    """What a fit brings to the driver is bounded by its parameters, whatever repeats; long texts give parts of all of them."""
    df = table([(5, f"text {i} of this id", "a", "en") for i in range(3000)] + [(6, "begin " * 3000 + "middle " * 3000 + "finish " * 3000, "a", "fr")])
    model = langid.fit(df, rank=F.xxhash64("doc_id"))
    assert len(model.dictionaries["en"]) < 40
    assert all(w in model.dictionaries["fr"] for w in (b"begin", b"middle", b"finish")) and len(model.dictionaries["fr"]) <= 2100


def test_training_order_lasts(spark, table, tmp_path):
    """Written in several files, of which reading takes the largest first, the rows keep the order of the mix, up to the
    sequences they are packed into."""
    rows = [(i, f"{i} " + "some words here " * (i % 40 + 1), "abc"[i % 3]) for i in range(900)]
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    times = sorted((t, r["doc_id"]) for r in mixing.mix(docs).collect() for t in r["positions"])
    STAGES["mixing"](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "mixed"))
    assert len(list((tmp_path / "mixed").glob("*.parquet"))) > 1
    packed = STAGES["packing"](spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).where("piece = 0")
    assert [r["doc_id"] for r in packed.orderBy("place").collect()] == [k for _, k in times]


def test_sequences_hold_what_is_near(spark):
    """Parts by order: the places in a sequence are as near as parts are narrow, and the rest of packing holds."""
    items = spark.range(6000).select("id", (F.col("id") * 7).alias("place"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"))
    got = packing.pack(items, part_items=500, turns=0, order_col="place").collect()
    assert sorted((r["id"], r["place"], r["length"]) for r in got) == sorted(tuple(r) for r in items.collect())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    assert max(max(r["id"] for r in s) - min(r["id"] for r in s) for s in sequences.values()) < 1000
    exchanged = packing.pack(items, part_items=500, order_col="place").collect()
    fills = defaultdict(list)
    for r in exchanged:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fills.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(exchanged) == 6000 and exchanged[0]["least_sequences"] <= len(fills) <= len(sequences)
