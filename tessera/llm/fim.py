"""Fill-in-the-middle transformation by one repeated-capture match.

A text is cut into units (the white space in front of a word together with the word, or white space at the end):
``regex.fullmatch("(unit)*", text)`` keeps every repetition of the group, so ``match.ends(1)`` holds the end of every
unit: its length is the number of units n and its entries are the two cut offsets. Nothing is iterated in Python.
The quantifiers are possessive: the units are those of the plain pattern, since white space is either followed by a
word or by the end of the text, and the match keeps no states to go back to, however long the text is.

Choices come from the hexadecimal sha256 of ``<seed>:<doc_id>``: its first two 8-digit groups place the cuts, the third one decides
whether the text is transformed, the fourth one between the two orders of the parts. So reruns and any partitioning
agree, and rows that repeat an id and a text agree too.

Edge cases: a null text is an empty one; empty texts and texts that hold a sentinel stay plain (n is counted all the same);
a null id hashes as the empty string; a text of one unit has empty parts; other columns are kept, those named like a
result are replaced; an empty table gives no rows. Rows stay where they are: there is no shuffle, and a task holds one slice of
``SLICE_CHARS`` characters (one longer text is a slice of its own).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import parts

# The sentinels and the pattern of a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
SEED = 42
RATE = 50               # of 100 texts so many are transformed,
SPM_RATE = 80           # and of 100 of these so many get the suffix in front
SLICE_CHARS = 2_000_000
RESULT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                       T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                       T.StructField("output", T.StringType())])


def unit_ends(text: str) -> list[int]:
    """The end of every unit of ``text``, by one match."""
    import regex
    return regex.fullmatch(f"({UNIT})*+", text).ends(1)


def transform(text: str, key: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE):
    """(n, form, prefix characters, middle characters, output) of one text; ``key`` is the decimal id."""
    ends = unit_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (low, high))
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restore(output: str, form: str) -> str:
    """The text that ``transform`` turned into ``output``. No part holds a sentinel, so its first place is the right one."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output, the transformed text."""
    docs = docs.drop(*RESULT.names)
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    types = ["int64", "string", "int64", "int64", "string"]
    # the id as decimal text and the text itself stand last, under names that no other column has
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("doc_id").cast("string").alias("__fim_key"),
                       F.coalesce("text", F.lit("")).alias("__fim_text"))
    width = len(docs.columns)

    def run(batches):
        import pyarrow as pa
        for batch in parts(batches, width + 1, SLICE_CHARS):
            made = [transform(t, k or "", seed, rate, spm_rate)
                    for k, t in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())]
            out = [pa.array(list(c), pa.type_for_alias(t)) for c, t in zip(zip(*made) if made else [[]] * 5, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *out], schema.names)

    return rows.mapInArrow(run, schema)


def restored(made: DataFrame) -> DataFrame:
    """``made`` with the column ``restored``: the exact text, rebuilt from output and form alone."""
    made = made.drop("restored")
    schema = T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())])
    at, form = made.columns.index("output"), made.columns.index("form")

    def run(batches):
        import pyarrow as pa
        for batch in parts(batches, at, SLICE_CHARS):
            back = [restore(o, f) for o, f in zip(batch.column(at).to_pylist(), batch.column(form).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], schema.names)

    return made.mapInArrow(run, schema)
