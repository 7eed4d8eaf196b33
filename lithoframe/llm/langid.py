"""Language ID by compression: each text is encoded with one raw-content zstandard dictionary per language.

The language whose dictionary gives the smallest frames wins; where the runner-up's are nearly as small the
prediction is marked rejected. A dictionary saves about as much on a long text as on a short one, so a text is
encoded in blocks of bounded size, all of them, and the sizes are summed: the margin's share does not shrink with
length. Dictionaries are fitted on a bounded sample of different labelled texts, for the MAX_LANGS languages with most
labelled rows. Cases: a null text or one without a letter is `und`, score 0, rejected; equal
sizes go to the alphabetically first language with score 0, rejected; with nothing to learn from every text
is `und`; repeated rows are predicted alike, each on its own row; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freed, table

ROWS_PER_LANG = 96  # different labelled texts that a dictionary is fitted on, at most
MAX_LANGS = 128  # languages that are told apart, at most: those with most labelled rows
DICT_BYTES = 64 << 10  # size of a language's dictionary, at most
LEVEL = 5
BLOCK_BYTES = 64 << 10  # of a text that a frame covers, at most
MIN_MARGIN = 0.002  # the runner-up must be larger by this share of its size over all blocks
#: Bytes other than ASCII letters and parts of longer characters become spaces, so only words are compared.
BLANKED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, margin_bytes bigint, rejected boolean"


def is_held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def folded(text: str) -> bytes:
    return text.lower().encode().translate(BLANKED)


def blocks(raw: bytes) -> Iterator[bytes]:
    """The whole of a folded text in blocks of BLOCK_BYTES at most, cut at spaces where there are any."""
    at = 0
    while len(raw) - at > BLOCK_BYTES:
        end = raw.rfind(b" ", at + 1, at + BLOCK_BYTES)
        end = end if end > 0 else at + BLOCK_BYTES
        yield raw[at:end]
        at = end
    yield raw[at:]


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary per language from at most rows_per_lang labelled texts, those of smallest hash.

    The driver holds rows_per_lang * dict_bytes a language at most. A text longer than a whole dictionary
    fills it alone; predictions never see a cut text.
    """
    known = docs.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    first = Window.partitionBy("lang").orderBy("place", "text")

    def drawn(langs: dict[str, int], spread: int | None) -> dict[str, list[str]]:
        if not langs:
            return {}
        limit = F.create_map(*[F.lit(x) for k, n in langs.items() for x in (k, (1 << 30) if spread is None else min(1 << 30, (1 << 30) * spread * rows_per_lang // n))])
        near = known.select("lang", "text", place.alias("place")).where(F.col("place") < F.try_element_at(limit, F.col("lang"))).groupBy("lang", "text").agg(F.min("place").alias("place"))
        rows = near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= rows_per_lang).select("lang", "at", F.substring("text", 1, dict_bytes).alias("text"))
        out: dict[str, list[str]] = {}
        for r in sorted(rows.collect(), key=lambda r: (r.lang, r.at)):
            out.setdefault(r.lang, []).append(r.text)
        return out

    texts = drawn(counts, 4)
    texts |= drawn({k: n for k, n in counts.items() if k not in texts}, None)  # no row of the language has a hash below the limit
    return {lang: b" ".join(dict.fromkeys(map(folded, got)))[-dict_bytes:] for lang, got in sorted(texts.items())}


def coders_of(dictionaries: dict[str, bytes], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in dictionaries.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False)))
    return out


def judge(text: str | None, coders: list, min_margin: float) -> tuple[str, float, int, bool]:
    """Language, score, margin in bytes, whether it is rejected."""
    if not coders or text is None or not LETTER.search(text):
        return "und", 0.0, 0, True
    parts = list(blocks(folded(text)))
    sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in coders)
    (least, lang), second = sizes[0], sizes[1][0] if len(sizes) > 1 else 2 * sizes[0][0]
    return lang, 1 - least / second, second - least, second - least < max(1, min_margin * second)


def classify(rows: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """rows(doc_id, held_out, text) -> SCHEMA, a row each."""
    shared = rows.sparkSession.sparkContext.broadcast(dictionaries)  # languages * dict_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = coders_of(shared.value, level)
        for b in batches:
            found = [judge(t, coders, min_margin) for t in b.column("text").to_pylist()]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], names=["doc_id", "held_out", "lang_pred", "score", "margin_bytes", "rejected"])

    return rows.mapInArrow(freed(run), SCHEMA)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], **how) -> DataFrame:
    return classify(docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text"), dictionaries, **how)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is clear, in full."""
    dictionaries = fit(docs)
    wide = docs.schema
    shared = spark.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = coders_of(shared.value, LEVEL)
        for b in batches:
            keep = [not judge(t, coders, MIN_MARGIN)[3] for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(freed(run), wide)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


QUERIES = {"op1_langid": op1_langid}
