"""Language ID by compression: each language has a zstandard raw-content dictionary of its text, and a text is in the
language whose dictionary makes it smallest. Case and whatever isn't a letter are set aside on both sides. Narrow
margins are marked as rejected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
UNDETERMINED = "und"


def letters(text: str) -> bytes:
    """The words of letters, lower-cased, with single spaces."""
    return OTHER.sub(" ", text.lower()).encode()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 128, bytes_per_doc: int = 2048, max_bytes: int = 64 << 20) -> dict[str, bytes]:
    """A dictionary for each language from a bounded sample of labelled rows.

    The sample holds at most `docs_per_lang` texts of a language, those with the least hashes (equal texts once), and of each
    at most the `bytes_per_doc` bytes from its middle: 256 KB a language. Rows with a null or empty text or language are left out.
    What is collected and broadcast is at most `max_bytes`: where there are so many languages that the sample would exceed it, that is
    an error. The commonest language comes first, of equally common ones the least in order.
    """
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL AND text <> ''")
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit(77)))
    most = max_bytes // (docs_per_lang * bytes_per_doc)
    counts = {r["lang"]: (r["n"], r["d"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("hash").alias("d")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"the sample of more than {most} languages would exceed {max_bytes} bytes")
    if not counts:
        return {}
    # thinned by the hash before texts are compared: by the distinct texts, as copies share their hash
    share = F.create_map(*(F.lit(x) for lang, (_, d) in counts.items() for x in (lang, min(1.0, 8.0 * docs_per_lang / max(d, 1)))))
    rows = rows.where(F.pmod("hash", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    start = F.greatest((F.length("text") / 2).cast("int") - bytes_per_doc // 2, F.lit(1))
    rows = rows.select("lang", "hash", F.substr("text", start, F.lit(bytes_per_doc)).alias("text")).distinct()
    least = W.partitionBy("lang").orderBy("hash", "text")
    sample = rows.withColumn("k", F.row_number().over(least)).where(F.col("k") <= docs_per_lang).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(letters(r["text"])[:bytes_per_doc])
    return {lang: b" ".join(out[lang]) for lang in sorted(out, key=lambda k: (-counts[k][0], k))}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.by = []
        for lang in dictionaries:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.by.append((lang, zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        """(language, score, whether the margin is narrow); ties go to the language that comes first."""
        if not text or not LETTER.search(text) or not self.by:
            return UNDETERMINED, 0.0, True
        raw = letters(text)
        sizes = sorted((len(c.compress(raw)), i) for i, (_, c) in enumerate(self.by))
        margin = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return self.by[sizes[0][1]][0], margin / (margin + 0.02) if margin else 0.0, margin < narrow


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None, narrow: float = 0.01, level: int = 3) -> DataFrame:
    """The columns `keep` of each row, lang_pred, score and rejected.

    lang_pred is the language of the least compressed size, `und` for a null text or one without a letter (score 0). The score
    is m / (m + 0.02) for the margin m, the share by which the second-best size is larger. rejected is true for `und` and for
    margins under `narrow`. Other columns are ignored.
    """
    keep = keep or ["doc_id"]
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = source.drop("text").schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    packed = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(packed.value, level)
        for batch in batches:
            langs, scores, rejected = zip(*(model(t.as_py(), narrow) for t in batch.column("text"))) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], schema=schema_out(batch.schema))

    def schema_out(given: pa.Schema) -> pa.Schema:
        return pa.schema([*(given.field(i) for i in range(len(given) - 1)), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "rejected")


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training; false for a null id, which isn't trained on either."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
