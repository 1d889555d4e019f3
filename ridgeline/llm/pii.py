"""Personal data: base patterns, and identifiers found by bootstrapping over the contexts of what these match.

A context is the two words before a match, in lower case. Matches of the base patterns are the seeds. In each round
the graph of contexts and instances (tokens with a digit or @) is scored: a context is accepted if enough different
known instances follow it, and if they follow it most times that it occurs anywhere; unknown tokens after accepted
contexts become known for the next round, until no context is newly accepted. SQL functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_not, staged, text_or_empty
from .spans import counted, listed, with_matches

KINDS = ["email", "ip", "card", "phone"]
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: The base patterns. Possessive repeats and looks behind change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SPACES = r"[\x20\x09-\x0D]+"
#: Different known instances that must follow a context, the share of its occurrences that they must make up.
SUPPORT = 3
PRECISION = 0.5
#: Characters of a token that can be an instance.
LEAST_TOKEN = 4


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.char_length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def token_contexts(words: Column) -> Column:
    """Of a text's words in lower case, the two before each match of TOKEN, which is a word; null unless two stand there."""
    at = F.filter(F.transform(words, lambda x, i: F.when(F.rlike(x, F.lit("[0-9@]")), i)), lambda i: i.isNotNull())
    before = lambda i, k: F.get(words, F.greatest(i - k, F.lit(0)))
    return F.transform(at, lambda i: F.when((i >= 2) & (before(i, 2) != ""), F.concat_ws(" ", before(i, 2), before(i, 1))))


def in_context(places: str) -> Column:
    """Sorted places with the contexts of tokens for all that begin where a token does; a seed after a space begins a token, and stands at most len(KINDS) places after it."""
    here = lambda x, i, k: F.get(places, F.greatest(i - k, F.lit(0)))
    own = lambda x, i: F.coalesce(*[F.when(here(x, i, k)["word"] == x["word"], here(x, i, k)["context"]) for k in range(len(KINDS) + 1)])
    return F.transform(places, lambda x, i: F.struct(x["start"], x["end"], x["kind"], own(x, i).alias("context"), x["value"]))


def passing(kind: str) -> Column:
    return F.filter(kind, lambda x: passes(kind, x["value"]))


def as_spans(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def as_seeds(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("word"), F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(None).cast("string").alias("context"), x["value"].alias("value")))


def base_rows(df: DataFrame, text: str) -> DataFrame:
    """row_key and doc_id, base (array of order, kind, start, end), instances (array of start, end, kind or -1, context, value)."""
    rows = df.select(F.col("doc_id"), text_or_empty(text).alias("text"))
    for kind, pattern in PATTERNS.items():
        rows = with_matches(rows, kind, "text", pattern, HINTS[kind])
        rows = rows.withColumn(kind, passing(kind))
    rows = with_matches(rows, "token", "text", TOKEN)
    rows = rows.withColumn("words", F.split(F.lower("text"), SPACES))
    rows = rows.withColumn("token", F.arrays_zip(F.col("token").alias("t"), token_contexts(F.col("words")).alias("c")))
    # A token's span is without the punctuation around it.
    trimmed = F.transform("token", lambda x: F.struct(x["t"]["start"].alias("start"), x["t"]["end"].alias("end"), x["t"]["value"].alias("value"), x["c"].alias("context"), F.char_length(F.regexp_extract(x["t"]["value"], r"^[^\p{L}\p{N}+@]*+", 0)).alias("lead"), F.char_length(F.regexp_extract(x["t"]["value"], r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", 0)).alias("trail")))
    tokens = F.transform(trimmed, lambda x: F.struct(x["start"].alias("word"), F.lit(-1).alias("kind"), (x["start"] + x["lead"]).alias("start"), (x["end"] - x["trail"]).alias("end"), x["context"].alias("context"), F.substring(x["value"], x["lead"] + 1, F.char_length(x["value"]) - x["lead"] - x["trail"]).alias("value")))
    base = F.concat(*[as_spans(kind) for kind in KINDS])
    seeds = [as_seeds(kind) for kind in KINDS]
    rows = rows.withColumn("base", base).withColumn("places", F.array_sort(F.concat(*seeds, tokens)))
    instances = F.filter(in_context("places"), lambda x: x["context"].isNotNull() & ((x["kind"] >= 0) | (x["end"] - x["start"] >= LEAST_TOKEN)))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "base", instances.alias("instances"), "text")
    return rows.withColumn("contexts", F.when(F.size("base") > 0, context_keys(F.col("text")))).drop("text")


def context_keys(text: Column) -> Column:
    """Hashes of all contexts in a text, whatever follows them."""
    words = F.split(F.lower(text), SPACES)
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def accepted_contexts(df: DataFrame, text: str, rows: DataFrame, instances: DataFrame) -> DataFrame:
    """context, kind of the accepted contexts; rows: those of base_rows(); instances: kind, context, value and n (rows with it), one row for each place in a text.

    A context can be accepted in any round, so all that have enough different instances, known or not, are counted. How
    often a context occurs is counted in all texts, but first in those with seeds: contexts that occur too often there
    already need no further count. Rounds go on until no context is newly accepted.
    """
    edges = staged(instances.groupBy("context", "value").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")), "edges")
    support = edges.groupBy("context").agg(F.count("*").alias("values"), F.sum("n").alias("most")).where(F.col("values") >= SUPPORT)
    parts = F.split("context", " ")
    wanted = support.select("context", "most", F.xxhash64(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("context_key"))
    here = rows.select(F.explode("contexts").alias("context_key")).groupBy("context_key").agg(F.count("*").alias("here"))
    wanted = staged(wanted.join(here, "context_key", "left").where(F.col("most") >= PRECISION * F.coalesce("here", F.lit(0))).select("context", "context_key"), "contexts")
    everywhere = df.select(F.explode(context_keys(text_or_empty(text))).alias("context_key")).join(small_or_not(wanted.select("context_key")), "context_key")
    total = staged(wanted.join(everywhere.groupBy("context_key").agg(F.count("*").alias("total")), "context_key").select("context", "total"), "totals")
    known = staged(edges.join(total, "context"), "known")
    count, last = 0, -1
    while count > last:
        score = known.where("kind >= 0").groupBy("context", "kind").agg(F.count("*").alias("values"), F.sum("n").alias("n"), F.first("total").alias("total"))
        score = score.groupBy("context").agg(F.sum("values").alias("values"), F.sum("n").alias("n"), F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"), F.first("total").alias("total"))
        accepted = staged(score.where((F.col("values") >= SUPPORT) & (F.col("n") >= PRECISION * F.col("total"))).select("context", F.col("kind").alias("of")), "accepted")
        count, last = accepted.count(), count
        if count > last:
            found = known.join(accepted, "context").where("kind < 0").groupBy("value").agg(F.min("of").alias("found"))
            known = staged(known.join(found, "value", "left").select("context", "value", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("found", F.lit(-1))).alias("kind"), "n", "total"), "known")
    return accepted.select("context", F.col("of").alias("kind"))


def personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base and spans, a row for each row of df; both are arrays of (order, kind, start, end), spans with what the method adds.

    Null and empty texts have no spans. Repeated rows have the same spans each, and count for contexts each. Rows
    with one id and different texts, or no id, are told apart by a hash of the text. Other columns are not read,
    whatever their names. An empty table gives an empty one.
    """
    rows = staged(base_rows(df, text), "pii")
    places = rows.select("doc_id", "text_key", F.explode("instances").alias("x")).select("doc_id", "text_key", "x.*")
    # A row has one place at most of each kind at one start.
    repeats = F.greatest(*[F.count(F.when(F.col("kind") == k, 1)) for k in range(-1, len(KINDS))])
    seeded = places.groupBy("doc_id", "text_key", "start").agg(F.max_by("end", "kind").alias("end"), F.max("kind").alias("kind"), F.max_by("context", "kind").alias("context"), F.max_by("value", "kind").alias("value"), repeats.alias("n"))
    seeded = staged(seeded, "places")
    accepted = accepted_contexts(df, text, rows, seeded)
    added = seeded.where("kind < 0").drop("kind", "n").join(small_or_not(accepted), "context")
    names = F.array(*map(F.lit, KINDS))
    added = added.groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).agg(F.collect_set(F.struct(F.col("kind").alias("order"), F.get(names, F.col("kind")).alias("kind"), "start", "end")).alias("added"))
    whole = rows.join(added, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<order:int,kind:string,start:bigint,end:bigint>>"))))
    return whole.select("doc_id", F.array_sort("base").alias("base"), spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from those of personal_data()."""
    counts = [counted("base", kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
