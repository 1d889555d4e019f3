"""Secrets: base patterns, and multipart credentials linked by an interval join.

Weak parts say little alone: an identifier (client_id = ...), a token that mixes letters and digits, an endpoint. A
weak token is reported if an access identifier stands within its scope, a weak identifier if a secret does, an
endpoint if both do. Scopes are joined by blocks of the text: a part meets the parts of its own block and the two
beside it, which are bounded in number, so no document's parts are ever all paired. SQL functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, as_row, back, staged, text_or_empty
from .spans import counted, listed, with_matches

KINDS = ["assign", "access", "hex", "weak", "id", "endpoint"]
#: The base patterns; the one for hex matches whole runs of its length at once.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]++", "hex": "(?<![0-9a-f])[0-9a-f]{24,}+"}
HINTS = {"access": "AKIA"}
WEAK = {
    "weak": "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+",
    "id": r"""(?i:client|access|account|tenant|user|key)[_-]?(?i:id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.-]{6,})""",
    "endpoint": r"""(?i:[a-z][a-z0-9+]{1,9}://|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9][^\x20\x09-\x0D"'<>]{3,}""",
}
#: Characters between two parts that are in one scope, at most.
SCOPE = 256
#: Characters of a block: more than a scope, so that the next block is the farthest that a scope reaches.
BLOCK = SCOPE + 1


def as_parts(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def base_rows(df: DataFrame, text: str) -> DataFrame:
    """doc_id, text_key, base and weak parts (arrays of start, order, kind, end)."""
    rows = df.select(F.col("doc_id"), text_or_empty(text).alias("text"))
    for kind, pattern in (PATTERNS | WEAK).items():
        rows = with_matches(rows, kind, "text", pattern, HINTS.get(kind))
    rows = rows.withColumn("assign", F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["value"], ASSIGN, 1)) >= 6))
    rows = rows.withColumn("access", F.filter("access", lambda x: x["end"] - x["start"] >= 20))
    parts = {kind: as_parts(kind) for kind in KINDS}
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), F.array_sort(F.concat(*[parts[k] for k in PATTERNS])).alias("base"), F.concat(*[parts[k] for k in WEAK]).alias("parts"))


def near(left: DataFrame, right: DataFrame, how: str, apart: int) -> DataFrame:
    """Rows of left with (left_semi) or without (left_anti) a row of right in the same text at most `apart` characters off.

    With apart 0 overlaps are meant, else parts that don't overlap. Parts stand in every block that they touch.
    """
    side = 1 if apart else 0
    left_end, right_end = F.col("end") - 1, F.col("end") - 1
    at = left.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(left_end / BLOCK))))
    other = right.select("doc_id", "text_key", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BLOCK) - side, F.floor(right_end / BLOCK) + side)).alias("block"))
    other = other.select(*[F.col(c).alias(f"o_{c}") for c in other.columns])
    gap = F.greatest(F.col("start") - F.col("o_end"), F.col("o_start") - F.col("end"))
    same = F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("text_key") == F.col("o_text_key")) & (F.col("block") == F.col("o_block"))
    hit = at.join(other, same & (gap.between(0, apart) if apart else gap < 0), "left_semi").drop("block").distinct()
    if how == "left_semi":
        return hit
    return left.join(hit.select(*[F.col(c).alias(f"h_{c}") for c in hit.columns]), F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("text_key") == F.col("h_text_key")) & (F.col("start") == F.col("h_start")) & (F.col("end") == F.col("h_end")) & (F.col("kind") == F.col("h_kind")), "left_anti")


def credentials(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base and spans, a row for each row of df; both are arrays of (start, order, kind, end), spans with the linked weak parts.

    Null and empty texts have no spans. Repeated rows have the same spans each. Rows with one id and different texts,
    or no id, are told apart by a hash of the text. Other columns are not read, whatever their names. An empty table
    gives an empty one.
    """
    rows = staged(base_rows(df, text), "secrets")
    both = rows.where(F.size("parts") > 0)
    base = both.select("doc_id", "text_key", F.explode("base").alias("x")).select("doc_id", "text_key", "x.*").distinct()
    parts = both.select("doc_id", "text_key", F.explode("parts").alias("x")).select("doc_id", "text_key", "x.*").distinct()
    parts = staged(near(parts, base, "left_anti", 0), "parts")
    tokens, ids, ends = (parts.where(F.col("kind") == k) for k in WEAK)
    tokens = near(tokens, ids, "left_anti", 0)
    strong_ids, strong_secrets = base.where("kind = 'access'"), base.where("kind <> 'access'")
    linked_tokens = near(tokens, strong_ids.unionByName(ids), "left_semi", SCOPE)
    secrets = strong_secrets.unionByName(linked_tokens)
    linked_ids = near(ids, secrets, "left_semi", SCOPE)
    linked_ends = near(near(ends, secrets, "left_semi", SCOPE), strong_ids.unionByName(linked_ids), "left_semi", SCOPE)
    added = linked_tokens.unionByName(linked_ids).unionByName(linked_ends)
    added = added.groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).agg(F.collect_set(F.struct("start", "order", "kind", "end")).alias("added"))
    whole = rows.join(added, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    return whole.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from those of credentials()."""
    counts = [counted("base", kind).alias(f"n_{kind}") for kind in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


MARK = "[SECRET]"


def merged(spans: Column) -> Column:
    """Sorted spans put together where they overlap or touch: array of (start, end)."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    return F.aggregate(spans, none, add)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with MARK in its texts for each run of secrets, and n_chars, if there is such a column, to match.

    Rows without secrets stay as they are, those of null and empty texts among them. Repeated rows are changed alike;
    rows with one id, or none, are told apart by their texts. Spans that overlap or touch make one run. Other columns
    keep their values, whatever their names. An empty table stays empty.
    """
    found = credentials(df, text).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("t")).agg(F.first("spans").alias("spans"))
    found = staged(found.select("i", "t", merged(F.col("spans")).alias("runs")), "runs")
    if (found.agg(F.sum(F.size("runs") + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = df.select(as_row(df), F.col("doc_id").alias("own_id"), F.xxhash64("doc_id", text_or_empty(text)).alias("own_key"))
    rows = rows.join(found, F.col("own_id").eqNullSafe(F.col("i")) & (F.col("own_key") == F.col("t")), "left")
    # The texts between runs: from one's end (0 at first) to the next one's start (the end at last).
    said = F.col("row").getField(text)
    lows = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda x: x["end"]))
    highs = F.concat(F.transform("runs", lambda x: x["start"]), F.array(F.char_length(said).cast("long")))
    between = F.zip_with(lows, highs, lambda a, b: F.substring(said, (a + 1).cast("int"), (b - a).cast("int")))
    rows = rows.withColumn("changed", F.when(F.col("runs").isNotNull(), F.array_join(between, MARK)))
    new = {text: F.coalesce("changed", said)}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(F.col("changed").isNull(), F.col("row.n_chars")).otherwise(F.char_length("changed").cast("long"))
    return rows.select(back(df, **new))
