"""Language by compression: the language whose dictionary compresses a text best.

For each language a raw-content Zstandard dictionary is built from a bounded sample of labelled texts: for each language
the ``SAMPLE_TEXTS`` texts with the smallest hash of their key, ``SAMPLE_CHARS`` characters of each. A whole text, in
lower case and with one blank for each run of other signs than letters, is cut into blocks; each block is compressed
with each dictionary, and the sizes are summed. The language of the smallest sum wins; the score is the margin to the next as a share of a full separation. Where the margin is under ``reject_below``,
``rejected`` is set.

Defined results: null texts and texts without a letter are ``und`` with score 0; equal sizes go to the first language by
name; without any labelled text every language is ``und``; equal rows get equal answers; an empty table gives an empty
one. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the labelled sample, per language: 160 texts of up to 700 characters, about 110 KB.
SAMPLE_TEXTS, SAMPLE_CHARS = 160, 700
LEVEL = 6
#: Blocks of a text: small, so that the dictionary and not the text itself is what helps.
BLOCK = 2048
#: Margin that counts as full separation, as a share of the smallest sum.
FULL_MARGIN = 0.20
OTHER_SIGNS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    return OTHER_SIGNS.sub(" ", text.lower()).encode("utf-8", "replace")


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language. The sample's order and choice depend on keys only."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    # the rank limit is pushed below the shuffle, so a task hands on at most the sample for each language
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= SAMPLE_TEXTS)
    sample = ranked.select("lang", "r", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in sample:
        parts.setdefault(row["lang"], []).append((row["r"], row["text"]))
    return {name: b"\n".join(letters_only(t) for _, t in sorted(texts)) for name, texts in sorted(parts.items())}


def held_out(key: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", reject_below: float = 0.05) -> DataFrame:
    """All columns of ``docs`` but the text, and lang_pred, score, rejected."""
    rest = [c for c in docs.columns if c != text]
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for name in names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            pred, score, rejected = [], [], []
            for t in texts:
                if not names or t is None or not any(map(str.isalpha, t)):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                data = letters_only(t)
                blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
                sums = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders])
                order = np.argsort(sums, kind="stable")
                margin = (sums[order[1]] / sums[order[0]] - 1) / FULL_MARGIN if len(names) > 1 else 1.0
                pred.append(names[order[0]]), score.append(float(min(1.0, margin))), rejected.append(bool(margin < reject_below))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             [*rest, "lang_pred", "score", "rejected"])

    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*rest).dtypes)
    return docs.select(*rest, text).mapInArrow(run, f"{fields}lang_pred string, score double, rejected boolean")
