"""Positions of regular-expression matches, by SQL functions alone.

regexp_extract_all gives the matches and split the texts between them; running sums of their lengths give the
positions, in code points. The sums are made in blocks, so that a text with very many matches costs little more than
one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128


def with_matches(df: DataFrame, name: str, text: str, pattern: str, hint: str | None = None) -> DataFrame:
    """df with column `name`: array of (start, end, value) in order, for leftmost non-overlapping matches.

    hint: a string that every match contains; texts without it are not searched. The text must not be null, and
    matches not be empty.
    """
    searched = F.col(text) if hint is None else F.when(F.contains(F.col(text), F.lit(hint)), F.col(text)).otherwise("")
    found, gaps, sizes, starts = (f"__{name}_{x}" for x in ("found", "gaps", "sizes", "starts"))
    df = df.withColumn(found, F.regexp_extract_all(searched, F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array(F.lit(""))))
    df = df.withColumn(sizes, F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.col(found), lambda g, m: F.struct(F.char_length(g).cast("long").alias("g"), F.char_length(m).cast("long").alias("m"))))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK)).cast("int")), lambda c: F.slice(sizes, c * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast("array<bigint>")

    def running(lengths: Column, first: Column, gap, step) -> Column:
        """first + all steps before, + gap of its own, for each of lengths."""
        state = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(lengths, state, lambda acc, x: F.struct((acc["at"] + step(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + gap(x))).alias("out")), lambda acc: acc["out"])

    df = df.withColumn(f"{starts}b", blocks)
    totals = F.transform(f"{starts}b", lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x["g"] + x["m"]))
    df = df.withColumn(f"{starts}o", running(totals, F.lit(0).cast("long"), lambda _: F.lit(0), lambda x: x))
    df = df.withColumn(starts, F.flatten(F.zip_with(f"{starts}b", f"{starts}o", lambda b, o: running(b, o, lambda x: x["g"], lambda x: x["g"] + x["m"]))))
    whole = F.transform(F.arrays_zip(F.col(starts).alias("s"), F.col(found).alias("m")), lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.char_length(x["m"])).alias("end"), x["m"].alias("value")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return df.withColumn(name, F.when(F.size(found) > 0, whole).otherwise(empty)).drop(found, gaps, sizes, starts, f"{starts}b", f"{starts}o")


def listed(spans: Column) -> Column:
    """Of an array of structs with kind, start and end, the string kind:start:end,..."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
