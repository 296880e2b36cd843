"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of texts known to
be in it.  A text is encoded with each dictionary, in pieces short enough that
the dictionary rather than the text itself gives the matches; the language with
the smallest sum of sizes is predicted.  The margin is the share of bytes by
which the second smallest is larger; below MARGIN the prediction is marked as
rejected.

Fitting takes about SAMPLE texts of each of the MOST_LANGUAGES most frequent
languages, chosen by a hash of text and id, and the first of them in hash order
up to DICTIONARY bytes; of a long text it takes the first DICTIONARY code
points.  That is the only bounded part: every text is encoded whole.

Defined results: text that is null or has no letter gets ``und`` with score 0;
so does every text if no language was learned; rows without a language are not
learned from; ties go to the first language by name; equal rows get equal rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import crc_mod, staged, table

SAMPLE = 300
DICTIONARY = 64_000
PIECE = 2_000
LEVEL = 9
MARGIN = 0.02
#: Languages that are learned, the most frequent first.
MOST_LANGUAGES = 1_000
_PLAIN = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, with one space for each run of other things than letters."""
    plain = _PLAIN.sub(" ", text.lower())
    if not plain.replace(" ", "").isalpha():
        # Some word characters are no letters, such as superscripts, fractions and Roman numerals.
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    return plain.strip()


def dictionaries(labelled: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY, languages: int = MOST_LANGUAGES) -> dict[str, bytes]:
    """(lang, text) rows to a dictionary for each language."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row a language: the share of its texts that makes the sample, in hashes from 0 to 2**63.
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    shares = staged(counts.select("lang", (F.lit(float(sample)) / F.col("count") * F.lit(2.0**63)).alias("cut")))
    hashed = known.select("lang", F.left("text", F.lit(size)).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    mine = hashed.join(F.broadcast(shares), "lang").filter(F.col("h").bitwiseAND(F.lit(2**63 - 1)) < F.col("cut"))
    parts: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for r in sorted(mine.collect(), key=lambda r: (r.lang, r.h, r.text)):
        parts.setdefault(r.lang, [])
        if part := letters(r.text).encode()[: max(0, size - held.get(r.lang, 0))]:
            parts[r.lang].append(part)
            held[r.lang] = held.get(r.lang, 0) + len(part) + 1
    return {lang: b" ".join(found) for lang, found in sorted(parts.items())}


RESULT = "lang_pred string, score double, margin double, rejected boolean"


def identify(
    docs: DataFrame, known: dict[str, bytes], piece: int = PIECE, level: int = LEVEL, margin: float = MARGIN, pass_columns: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """pass_columns of every document and its predicted language.

    score is 1/2 at no margin and rises to 1 as the margin grows.
    """
    read = docs.select(*pass_columns, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]) + ", " + RESULT
    held = docs.sparkSession.sparkContext.broadcast(sorted(known.items()))
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for lang, content in held.value:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            tools.append(
                (lang, zstandard.ZstdCompressor(dict_data=made, level=level, write_content_size=False, write_checksum=False).compress)
            )
        for batch in batches:
            rows = []
            for text in batch.column("__text").to_pylist():
                plain = letters(text or "").encode()
                if not plain or not tools:
                    rows.append(("und", 0.0, 0.0, True))
                    continue
                n = max(1, round(len(plain) / piece))
                pieces = [plain[len(plain) * i // n : len(plain) * (i + 1) // n] for i in range(n)]
                sizes = sorted((sum(len(encode(p)) for p in pieces), lang) for lang, encode in tools)
                gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
                rows.append((sizes[0][1], 1 - 0.5 / (1 + 20 * gap), gap, gap < margin))
            made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(pass_columns))] + made,
                names=[*pass_columns, *[x.split()[0] for x in RESULT.split(", ")]],
            )

    return read.mapInArrow(predict, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_mod(F.col("doc_id"), 3)
    known = dictionaries(docs.filter(fold != 1))
    read = docs.select("doc_id", (fold == 1).alias("held_out"), "text")
    return identify(read, known, pass_columns=("doc_id", "held_out"))
