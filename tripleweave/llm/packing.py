"""Best-fit packing of token sequences, with lower bounds that certify the count of bins."""

from __future__ import annotations

import logging
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .base import arrow_bounds, cut, fresh, id_and_text, own_columns, uncut

_log = logging.getLogger(__name__)

END = 0
#: Entries and tokens that a worker's table of known words holds before it starts anew.
WORDS, KNOWN = 300_000, 4_000_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters, then a tail of marks: the tokenizer parts them there, and a run of letters is one of its words.
_STEM = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!;:?|#%&*$]*)")
#: A Python worker's tables, kept for its next task.
_known: dict[str, Words] = {}


class Words:
    """Token ids of texts, by a table of the ids of each word. The tokenizer drops white space and merges nothing
    across it, so a text's ids are its words' ids in a row. It lower-cases, and parts letters from marks, so a new word
    is encoded only if its lower-case stem is new too."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.stems: dict[bytes, list[int]] = {b"": []}
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]

    def spelled(self, stems: list[bytes]) -> list[list[int]]:
        """The ids of runs of letters, many in one text: a word's last token says that it ends there."""
        out = []
        for at in range(0, len(stems), 20_000):
            part = stems[at : at + 20_000]
            ids = self.encoded([b" ".join(part)])[0]
            stops = (np.nonzero(self.ends[ids])[0] + 1).tolist()
            out += [ids[i:j] for i, j in zip([0, *stops], stops)] if len(stops) == len(part) and stops[-1] == len(ids) else self.encoded(part)
        return out

    def learn(self, words: list[bytes]) -> None:
        stems, parts, letters, others = self.stems, [], set(), set()
        for w in words:
            if m := _STEM.fullmatch(w):
                stem, marks = m.groups()
                if stem not in stems:
                    letters.add(stem)
                if marks not in stems:
                    others.add(marks)
                parts.append((stem, marks))
            else:
                if w not in stems:
                    others.add(w)
                parts.append((w, b""))
        for new, encode in ((list(letters), self.spelled), (list(others), self.encoded)):
            stems.update(zip(new, encode(new)))
        ids = [stems[a] + stems[b] if b else stems[a] for a, b in parts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and END. Special tokens are matched as they are written, so a text that may hold one
        is not lower-cased here."""
        if len(self.index) > WORDS or len(self.flat) > KNOWN:
            self.clear()
        plain = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(plain)
        words = lists.flatten().dictionary_encode()
        known = words.dictionary.cast(pa.binary()).to_pylist()
        if new := [w for w in known if w not in self.index]:
            self.learn(new)
        at = np.fromiter(map(self.index.__getitem__, known), np.int64, len(known))[words.indices.to_numpy()]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        return [np.append(flat[i:j], np.uint32(END)) for i, j in zip([0, *stops[:-1].tolist()], stops.tolist())]


def words_for(path: str) -> Words:
    """The worker's table for a vocabulary; a function of the module, so that tasks share what it keeps."""
    if path not in _known:
        _known[path] = Words(path)
    return _known[path]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the token ids of each whole text and an end id, in pieces of at most
    capacity. Null text has the end id alone."""
    arrow_bounds(df.sparkSession)
    path = path or vocabulary()
    own = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(n, t) for n, t in own)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for n, ids in enumerate(words.ids(batch.column(1))):
                ids = ids.astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(n), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing of counts[x] items of size x has fewer bins: the best of two families of dual-feasible functions.

    For each threshold up to half the capacity, items that leave less than it fill a bin, those under it weigh
    nothing and others their size; for each k, sizes are rounded down to k-ths of (k + 1)-ths.
    """
    size = np.arange(capacity + 1)
    n, mass = np.cumsum(counts), np.cumsum(counts * size)
    low = np.arange(capacity // 2 + 1)
    high = capacity - low
    below = np.where(low > 0, mass[np.maximum(low - 1, 0)], 0)
    best = int((n[-1] - n[high] + -(-(mass[high] - below) // capacity)).max())
    for k in range(1, 33):
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        units = np.where(exact, size * k, scaled // capacity * capacity)  # in parts of k * capacity
        best = max(best, int(-(-int((counts * units).sum()) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill, for lengths in descending order: each goes to the fullest bin
    that takes it. Open bins stand in stacks by free space; a bit mask finds the first stack in a step."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for n, size in enumerate(lengths.tolist()):
        if fit := mask >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[n], offsets[n] = b, fills[b]
        fills[b] += size
        if room > size:
            free[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


#: What share of a part's bins, the emptiest first, is opened for the first exchange; after one that saves no bin it
#: is STEP times as much, up to all.
FREED, STEP = 0.02, 4
#: A turn that opened all bins with gaps is the last if it saves no more than this share of the bins.
LEAST_GAIN = 1e-4


def _packed(items: DataFrame, parts: int, capacity: int, turn: int, order: str | None = None) -> DataFrame:
    """items (with a number each, `row`) dealt over parts by a hash, or by ranges of column order, each part packed by best fit and certified:
    sequence_id, offset, and slack: the place of a bin among those of its part, the emptiest first, from 0 up to 1; 2 for
    full bins and for parts that no exchange can better."""
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("slack", T.DoubleType())])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got)
        table = table.sort_by([("length", "descending"), ("row", "ascending")]).combine_chunks()
        lengths = table.column("length").to_numpy()
        bins, offsets, fills = best_fit(lengths, capacity)
        least = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        slack = np.full(len(fills), 2.0)
        if len(fills) > least or int(lengths.sum()) < least * capacity:
            # certified against its own items, a part may still end with a bin that others could fill
            order = np.argsort(fills, kind="stable")
            slack[order] = np.arange(len(fills)) / max(len(fills), 4)
            slack[order[: min(4, len(fills))]] = 0.0
            slack[fills == capacity] = 2.0
        sequence = (np.int64(turn) << 55) + (np.int64(part) << 30) + bins
        out = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets)).append_column("slack", pa.array(slack[bins]))
        yield from out.select(names).to_batches(max_chunksize=10_000)

    dealt = items.repartitionByRange(parts, F.col(order), "row") if order else items.repartition(parts, F.xxhash64("row", F.lit(turn)))
    return dealt.mapInArrow(run, schema)


def _bins() -> Column:
    return F.count(F.when(F.col("offset") == 0, 1))


def pack(items: DataFrame, capacity: int = 2048, part_items: int = 40_000, turns: int | None = None, order_col: str | None = None) -> DataFrame:
    """items (columns length and others) with sequence_id, offset and least_sequences: best-fit decreasing in parts of
    about part_items items, each certified by a dual-feasible-function bound. least_sequences is that bound for the whole, the
    same in all rows: no packing has fewer sequences, and the log says how many there are.

    While the bins exceed the bound of the whole, which takes one count a length, the emptiest bins of parts with gaps
    are opened; their documents are exchanged over new, fewer parts and packed again. A turn that saves no bin is followed
    by one that opens more, of all parts and earlier turns; it ends at the bound, or when a turn that opened all bins
    with gaps saved none, or next to none (or after `turns`, if given). Each turn is a written table; only what is opened
    moves again. Every item has a number of its own, so rows that are equal spread over the parts like others. No items
    give no rows. With order_col, parts are ranges of it in every turn, so that a sequence holds items that are near in it.
    """
    columns, (row,) = items.columns, fresh(items, "row")
    numbered = cut(items.withColumn(row, F.monotonically_increasing_id()).withColumnRenamed(row, "row") if row == "row" else items.select(F.struct(*own_columns(items)).alias("item"), "length").withColumn("row", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for r in numbered.groupBy("length").count().collect():  # at most one row a length
        counts[r["length"]] = r["count"]
    least, total = lower_bound(counts, capacity), int(counts.sum())
    kept, order = numbered.columns, order_col and (order_col if row == "row" else f"item.{order_col}")
    tables = [(cut(_packed(numbered, max(1, -(-total // part_items)), capacity, 0, order)), 0.0)]  # with the slack from which their bins are closed no more
    share, turn, bins = FREED, 1, tables[0][0].agg(_bins()).first()[0]
    while bins > least and (turns is None or turn <= turns):
        some = reduce(DataFrame.unionByName, [t.where((F.col("slack") >= since) & (F.col("slack") < share)) for t, since in tables])
        state = some.agg(F.count("*").alias("rows"), _bins().alias("bins")).first()
        saved = 0
        if state["rows"]:
            again = cut(_packed(some.select(*kept), max(1, -(-state["rows"] // part_items)), capacity, turn, order))
            saved, turn = state["bins"] - again.agg(_bins()).first()[0], turn + 1
        if saved > 0:
            bins, tables = bins - saved, [*((t, max(since, share)) for t, since in tables), (again, 0.0)]
        elif state["rows"]:
            uncut(again)
        if share >= 1 and saved <= LEAST_GAIN * bins:
            break
        share = share if saved > 0 else min(1.0, share * STEP)
    _log.info("%d sequences; at least %d are needed", bins, least)
    now = reduce(DataFrame.unionByName, [t.where(F.col("slack") >= since) for t, since in tables])
    made = ["sequence_id", "offset"]
    items_again = [F.col(f"`{c}`") for c in columns] if row == "row" else [F.col("item.*")]
    return now.select(*items_again, *made, F.lit(least).cast("long").alias("least_sequences"))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None, order_col: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, least_sequences), a row for each piece of each row of df.
    With order_col, its value comes before sequence_id, and sequences are made of documents that are near in it.

    Only documents of over capacity tokens are cut. Null and empty texts are one end id; rows that repeat, or have no
    id, are documents of their own; an empty table gives an empty table; other columns are neither read nor returned.
    """
    if order_col is None:
        return pack(pieces(df, id_col, text_col, capacity, path), capacity).withColumnRenamed("id", id_col)
    both = df.select(F.struct(F.col(id_col).alias("id"), F.col(order_col).alias("place")).alias("id"), F.col(text_col).alias("text"))
    items = pieces(both, "id", "text", capacity, path).select("id.id", "piece", "start", "length", "ids_crc32", "id.place")
    return pack(items, capacity, order_col="place").withColumnRenamed("id", id_col).withColumnRenamed("place", order_col)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
