"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong findings are an assignment to a secret-like key, an access identifier
with its fixed prefix, and a long hexadecimal run. Weak candidates (an
account-like assignment, a bare mixed token, an endpoint) mean nothing alone:
each is reported only if its complementary parts lie within ``scope`` code
points of it in the same text:

* ``weak`` (a bare token) needs an identifier (``access`` or ``ident``);
* ``ident`` needs a secret (``assign``, ``hex`` or ``weak``);
* ``endpoint`` needs both.

The parts meet in an interval join: every part is filed under the text's
buckets of ``scope`` code points that it touches, weak parts also under those
that their surroundings touch, and the equi-join on the bucket has the exact
gap test as its condition. A bucket holds few parts as parts of one kind do not
overlap, so no group is unbounded whatever a document or source holds.

Nulls: a null text is an empty one. Rows equal in id and text are one scan
whose result each of them gets. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardweave.llm.common import same, text_of

# Fixed patterns of the findings, in the order of their rank.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "ident": r"""(?i:access_key_id|client_id|username|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "weak": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""",
}
STRONG = ("assign", "access", "hex")
MIN_ASSIGNED = 6


def _parts(text: Column, kind: str) -> Column:
    """Array of (kind, i, gap, len, ok), one for each leftmost non-overlapping match.

    ``gap`` is the number of code points since the match before. The text is
    split only where there is a match.
    """
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "assign":
        ok = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= MIN_ASSIGNED)
    elif kind == "weak":
        ok = F.transform(hits, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    else:
        ok = F.transform(hits, lambda v: F.lit(True))
    zipped = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(hits, F.length).alias("len"),
        ok.alias("ok"),
    )
    rows = F.transform(
        F.filter(zipped, lambda z: z["len"].isNotNull()),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["len"].alias("len"), z["ok"].alias("ok")),
    )
    return F.when(text.rlike(pattern), rows)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, kind, start, end) of every part, strong or weak."""
    text = F.col("_text")
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text"))
    lists = src.select("id", F.xxhash64("_text").alias("text_hash"), *(_parts(text, k).alias(k) for k in PATTERNS))
    lists = lists.filter(" or ".join(f"{k} is not null" for k in PATTERNS))
    # Rows equal in id and text are scanned as one.
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>")
    lists = lists.groupBy("id", "text_hash").agg(F.first(F.concat(*(F.coalesce(F.col(k), empty) for k in PATTERNS))).alias("parts"))
    parts = lists.select("id", "text_hash", F.inline("parts"))
    w = Window.partitionBy("id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w))
        .filter("ok")
        .select("id", "text_hash", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )


def link_parts(parts: DataFrame, scope: int = 200) -> DataFrame:
    """The strong parts, and those weak ones whose complementary parts are within scope."""
    key = ["id", "text_hash"]
    strong = F.col("kind").isin(*STRONG)
    near = parts.select(
        *(F.col(k).alias(f"p_{k}") for k in key), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("kind").alias("p_kind"),
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("p_bucket"),
    )
    weak = parts.filter(~strong).withColumn(
        "bucket", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope)))
    )
    on = (
        weak.id.eqNullSafe(near.p_id) & (weak.text_hash == near.p_text_hash) & (weak.bucket == near.p_bucket)
        & (near.p_start <= weak.end + scope) & (near.p_end >= weak.start - scope)
        & ~((near.p_kind == weak.kind) & (near.p_start == weak.start))
    )
    met = weak.join(near, on).groupBy(*key, "kind", "start", "end").agg(
        F.max(F.col("p_kind").isin("access", "ident")).alias("has_ident"),
        F.max(F.col("p_kind").isin("assign", "hex", "weak")).alias("has_secret"),
    )
    linked = met.filter(
        ((F.col("kind") == "weak") & F.col("has_ident"))
        | ((F.col("kind") == "ident") & F.col("has_secret"))
        | ((F.col("kind") == "endpoint") & F.col("has_ident") & F.col("has_secret"))
    )
    return parts.filter(strong).unionByName(linked.select(parts.columns))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per input row: (id, text_hash, spans array<struct<start,rank,end,kind>>), ordered, null if none."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for r, k in enumerate(PATTERNS)))
    spans = link_parts(find_parts(docs, id_col, text_col), scope).groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans")
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"))
    return rows.join(spans, same(rows, spans, ["id", "text_hash"]), "left").select(rows.id, rows.text_hash, "spans")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The scan of ``documents`` with counts by kind and digests of the span lists."""
    found = scan_secrets(docs).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")))
    base = F.filter("spans", lambda s: s["rank"] < len(STRONG))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in STRONG),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        *(count(k).alias(f"n_{k}") for k in list(PATTERNS)[len(STRONG):]),
    )
