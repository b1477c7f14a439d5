"""Language identification by compression: the language whose raw-content dictionary shortens a text the most."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .base import arrow_bounds, per_text

_log = logging.getLogger(__name__)

_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words_of(text: str) -> bytes:
    """Lower-case letter runs joined by spaces: what is compressed, so that capitals, digits and marks weigh nothing."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


@dataclass(frozen=True)
class Model:
    """Raw dictionaries by language, in order of their names."""

    dictionaries: dict[str, bytes]
    level: int = 6
    block: int = 4096

    def compressors(self) -> dict:
        import zstandard

        out = {}
        for lang, content in self.dictionaries.items():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=self.level)
            out[lang] = zstandard.ZstdCompressor(level=self.level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
        return out


#: Bodies of fewer bytes are compressed in several forms, of which so many begin with another word each.
SHORT, TURNS = 256, 8


def forms(body: bytes, block: int) -> list[bytes]:
    """What is compressed for a text: its blocks; for a short one also its words in turned order and with spaces around,
    because sizes are whole bytes, and one form of a few words leaves most languages tied."""
    if len(body) >= SHORT:
        return [body[i : i + block] for i in range(0, len(body), block)]
    words = body.split(b" ")
    return [*(b" ".join(words[i:] + words[:i]) for i in range(min(len(words), TURNS))), b" " + body, body + b" ", b" " + body + b" "]


def judge(text: str, compressors: dict, block: int) -> tuple[str, float]:
    """The best language and its margin: by what part of the second's size the best is smaller."""
    body = words_of(text)
    if not compressors or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0
    parts = forms(body, block)
    sizes = sorted((sum(len(c.compress(x)) for x in parts), k) for k, c in compressors.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def excerpts(text: Column, size: int, parts: int) -> Column:
    """A text of up to size characters whole; of a longer one, parts of equal length spread evenly from its beginning to
    its end, so that what is learned of it is not its opening alone."""
    piece = size // parts
    at = lambda k: (k * (F.length(text) - piece) / F.lit(max(1, parts - 1))).cast("int") + 1
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.substring(text, at(k), F.lit(piece))), " ")
    return F.when(F.length(text) <= size, text).otherwise(spread)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rank: Column | None = None, texts: int = 64, excerpt: int = 2000, parts: int = 8, dictionary: int = 1 << 16, languages: int = 1000) -> Model:
    """Dictionaries from a bounded sample of labelled rows: of each language, for each of `texts` remainders of `rank` (a
    long; default: a hash of the text), the row of least rank. A dictionary has at most `dictionary` bytes, of which each
    chosen row of its language gets an equal share and short rows leave theirs to the others; a text of over `excerpt`
    characters gives `parts` excerpts spread evenly over the whole of it, because one text of any length must fit the
    driver and the end of a long text is as good a sample as its start.

    Rows whose text or language is null are not learned from; of rows that share their rank (ids that repeat) one is
    taken; no rows give a model that answers `und`. What reaches the driver is texts x excerpt characters for each
    distinct language; more than `languages` of them are a ValueError, since such a column holds no languages.
    """
    rank = F.xxhash64(text_col) if rank is None else rank
    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    ranked = known.select(F.col(lang_col).alias("lang"), rank.alias("rank"))
    slots = ranked.groupBy("lang", F.pmod("rank", F.lit(texts)).alias("slot")).agg(F.min("rank").alias("rank"))
    chosen = slots.select("lang", "rank").limit(languages * texts + 1).collect()  # one more than is allowed tells that it is too many
    if len({r["lang"] for r in chosen}) > languages or len(chosen) > languages * texts:
        raise ValueError(f"column {lang_col} has over {languages} different values")
    wanted = known.where(rank.isin(list({r["rank"] for r in chosen})))
    first = wanted.select(F.col(lang_col).alias("lang"), rank.alias("rank"), excerpts(F.col(text_col), excerpt, parts).alias("text")).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    pairs, found = {(r["lang"], r["rank"]) for r in chosen}, {}
    for row in sorted(first.collect()):
        if (row["lang"], row["rank"]) in pairs and (body := words_of(row["text"])):
            found.setdefault(row["lang"], []).append(body)
    return Model({k: b" ".join(shared(v, dictionary)) for k, v in sorted(found.items())})


def shared(bodies: list[bytes], size: int) -> list[bytes]:
    """bodies cut so that they and spaces between them take size bytes at most; what short ones leave goes to the rest."""
    left, out = size, {}
    for n, k in enumerate(sorted(range(len(bodies)), key=lambda k: (len(bodies[k]), k))):
        out[k] = bodies[k][: max(0, left // (len(bodies) - n) - 1)]
        left -= len(out[k]) + 1
    return [out[k] for k in range(len(bodies))]


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.002) -> DataFrame:
    """Classify whole texts, block by block: (id, lang_pred, score, rejected), one row for each row of df.

    score is the margin between the best and the second language as a part of the second's size, from 0 to 1. A text
    is rejected when the margin is under `least` or it has no letter; null, empty and letterless texts are `und` with
    score 0. A null id, repeated rows and long texts keep their row; an empty table gives an empty table; other columns,
    the label among them, are neither read nor returned. Ties go to the language whose name comes first, and are rejected.
    """
    ready: list[dict] = []

    def work(texts: list[bytes]) -> list[list]:
        if not ready:
            ready.append(model.compressors())
        found = [judge(raw.decode("utf-8", "replace"), ready[0], model.block) for raw in texts]
        return [[k for k, _ in found], [m for _, m in found], [k == UNDETERMINED or m < least for k, m in found]]

    return per_text(df, work, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())], id_col, text_col)


def accepted(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.002) -> DataFrame:
    """The rows of df that identify() would not reject, all columns as they are, whatever their names; no row moves.

    Null, empty and letterless texts go, as do those whose two best languages tie or lie within `least`; texts of any
    length are judged whole; repeated rows are judged alike, and an id plays no part; an empty table gives an empty table.
    A model that knows no language (nothing was labelled) can reject nothing: then all rows stay, and the log says so.
    """
    if not model.dictionaries:
        _log.warning("no labelled text to learn from: language identification keeps all rows")
        return df
    arrow_bounds(df.sparkSession)
    ready: list[dict] = []

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(model.compressors())
        found = (judge(t.as_py() or "", ready[0], model.block) for t in texts)
        return pa.array([k != UNDETERMINED and m >= least for k, m in found], pa.bool_())

    return df.where(keep(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 0 modulo 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()), rank=F.xxhash64("doc_id"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
