"""Secret scans: patterns within a text, and ownership frequency across the corpus.

Texts are scanned once, in Arrow batches, into base spans and weaker candidates with a hash each. Candidate hashes
are counted by distinct repository and by distinct owner, both pre-aggregated before the shuffle: a value that many
owners share is a copied example, one that stays with an owner looks live and becomes a span of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.tables import cut

#: Base kinds in their listed order: pattern, group that is measured, its least length.
BASE = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: Runs of key-like characters; those with upper and lower case and digits, of high entropy, are candidates.
CANDIDATE = re.compile(r"(?a)(?<![\w+/-])[A-Za-z0-9_+/-]{20,}={0,2}(?![\w+/-])")
KINDS = ("assign", "access", "hex", "token")
_HEX = re.compile(r"[0-9a-f]{16,}")


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping for each kind; too short ones are dropped after matching."""
    out = []
    for kind, pattern, group, least in BASE:
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, taken: list[tuple[int, int, str]], least_bits: float = 3.5) -> list[tuple[int, int]]:
    """Key-like runs outside the base spans (``taken``, in order of start)."""
    ends, reach, out = [], 0, []
    for _, b, _ in taken:
        reach = max(reach, b)
        ends.append(reach)
    begins = [a for a, _, _ in taken]

    def free(a: int, b: int) -> bool:
        before = bisect_left(begins, b)
        return not before or ends[before - 1] <= a

    for m in CANDIDATE.finditer(text):
        s = m.group()
        mixed = any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s) and any("0" <= c <= "9" for c in s)
        if mixed and entropy(s) >= least_bits and free(m.start(), m.end()):
            out.append((m.start(), m.end()))
    return out


SPAN = "struct<start:bigint,end:bigint,kind:string,value:bigint>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.int64())]))


def _value(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(batch.schema.get_field_index("_text")).to_pylist():
            base = base_spans(text or "")
            more = [(a, b, "token") for a, b in candidates(text or "", base)]
            found.append([{"start": a, "end": b, "kind": k, "value": _value(text[a:b])} for a, b, k in base + more])
        rest = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in rest], pa.array(found, _SPAN)], names=[*rest, "found"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``found``: base spans and candidates (kind ``token``) with the hash of each value."""
    given = docs.withColumnRenamed(text, "_text") if text != "_text" else docs
    rest = given.drop("_text", "found")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields) + f", found array<{SPAN}>"
    return given.drop("found").select(*rest.columns, "_text").mapInArrow(_scan, schema)


def ownership(found: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(value, n_owners, n_repositories, n_uses): exact distinct counts, each level pre-aggregated by task before its shuffle."""
    uses = found.select(owner.alias("owner"), repository.alias("repository"), F.explode("found.value").alias("value"))
    each = uses.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_uses"))


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = 2) -> DataFrame:
    """(doc_id, spans): every base span, and candidates seen with at most ``most_owners`` owners, in however many of their repositories.

    Each span has start, end (code points, end exclusive), kind, value (hash), n_owners, n_repositories and
    example: whether its value is a widely copied one (base spans stay either way). Rows are keyed by an id of their
    own within the scan table, so repeated or null ``doc_id``s keep one result a row. Null text is empty; a null
    owner or repository counts as one; an empty table gives none.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    found = cut(scan(rows.withColumn("row", F.monotonically_increasing_id()), "_text"), "secrets")
    known = ownership(found.where("size(found) > 0"), F.col("owner"), F.col("repository"))
    wide = F.col("n_owners") > most_owners
    each = found.where("size(found) > 0").select("row", F.explode("found").alias("s")).withColumn("value", F.col("s.value")).join(known, "value")
    each = each.select("row", F.struct("s.start", "s.end", "s.kind", "value", "n_owners", "n_repositories", wide.alias("example")).alias("s")).where("s.kind != 'token' or not s.example")
    order = F.expr("sort_array(collect_list(struct(s.start as start, array_position(array('assign', 'access', 'hex', 'token'), s.kind) as rank, s as s)))")
    spans = each.groupBy("row").agg(order.alias("o")).select("row", F.expr("transform(o, x -> x.s)").alias("spans"))
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.expr("array()").cast(spans.schema["spans"].dataType)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans' list, the list of all spans, and how many of them look live: their value stays
    with few owners, while that of an example is widely copied."""
    listed = "array_join(transform({}, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))), ',')"
    n = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) as bigint)")
    return scanned.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(F.expr(listed.format("filter(spans, x -> x.kind != 'token')")), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"),
        *[F.expr(f"cast(size(filter(spans, x -> {which} x.example)) as bigint)").alias(name) for name, which in (("n_live", "not"), ("n_example", ""))],
    )


def redact(docs: DataFrame, scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans make one mark. Columns and rows stay."""
    spans = scanned.where("size(spans) > 0").select(F.col("doc_id").alias("_id"), "spans").groupBy("_id").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    cutting = F.expr(
        "aggregate(sort_array(transform(spans, x -> struct(x.start as a, x.end as b))), struct(0L as at, '' as out), (s, x) -> "
        f"if(x.a < s.at, struct(greatest(s.at, x.b) as at, s.out as out), struct(x.b as at, concat(s.out, substring(text, int(s.at + 1), int(x.a - s.at)), '{mark}') as out)),"
        " s -> concat(s.out, substring(text, int(s.at + 1), length(text))))"
    )
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_id"]), "left")
    return joined.withColumn("text", F.when(F.col("spans").isNull() | F.col("text").isNull(), F.col("text")).otherwise(cutting)).select(*docs.columns)
