"""URL filter: rules as intervals of reversed-host keys, met by a sorted sweep.

The canonical key of a URL is its host with the labels reversed
(``www.example.com`` -> ``com\\x01example\\x01www``), then ``\\x00`` and the
path. As ``\\x00`` and ``\\x01`` sort before anything else, a host and all its
subdomains are one interval of keys, intervals nest or are disjoint, and every
rule becomes an interval with a path prefix to test.

URLs and rule starts are dealt out together by ranges of the key, with a hot
host split by its paths, and sorted. One sweep over each range keeps the stack
of hosts whose intervals are open, each with its path rules. A rule that opened
in an earlier range is found by an equi-join of the ranges' first keys (one
each) with the rules on the prefixes of the host, so no range waits for another.

Among the rules that fit, the one with the longest host and path wins; a tie
goes to the longer host. Nulls: a null url, or one without ``://``, has an
empty host and path, and no rule fits an empty host. Repeated urls each keep
their row. Repeated rules count once (``allow`` before ``block`` if they differ).
Only the named columns are read, so others may have any names, those of the result included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01")


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over one range in the order of keys: rules open and close, urls are judged.

    The stack has one entry for each open host: its key, its length as written,
    its rules by path, and the lengths of their paths from the longest.
    """
    stack: list[list] = []
    for frame in frames:
        out = []
        for row_no, (key, is_rule, path, verdict) in enumerate(zip(frame["key"], frame["is_rule"], frame["path"], frame["verdict"], strict=True)):
            host = key.partition("\x00")[0]
            while stack and not (host == stack[-1][0] or host.startswith(stack[-1][0] + "\x01")):
                stack.pop()
            if is_rule:
                if not stack or stack[-1][0] != host:
                    stack.append([host, {}, []])
                top = stack[-1]
                if path not in top[1]:
                    top[1][path] = verdict
                    top[2] = sorted({len(p) for p in top[1]}, reverse=True)
                continue
            best, won = (-1, -1), (None, None)
            for name, rules, lengths in stack:
                for n in lengths:
                    if n <= len(path) and (hit := path[:n]) in rules:
                        if (len(name) + n, len(name)) > best:
                            best, won = (len(name) + n, len(name)), (".".join(reversed(name.split("\x01"))) + hit, rules[hit])
                        break
            out.append((row_no, *won))
        if out:
            at = [x[0] for x in out]
            yield pd.DataFrame({"page_id": frame["page_id"].iloc[at].to_numpy(), "host": frame["host"].iloc[at].to_numpy(), "path": frame["path"].iloc[at].to_numpy(), "rule": [x[1] for x in out], "verdict": [x[2] for x in out]})


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path and verdict; ``default`` is the verdict of a url that
    no rule fits. ``ranges``: how many key ranges, the session's shuffle partitions
    if None.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = pages.schema[id_col].dataType
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = urls.select(
        F.concat(reversed_host(F.col("host")), F.lit("\x00"), F.col("path")).alias("key"), F.lit(False).alias("is_rule"),
        "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"),
    )
    own = rules.select("host", "path", "verdict").filter("host is not null and host != ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict"))
    # A rule's interval opens at its host alone: before every url of the host and its subdomains.
    opened = own.select(reversed_host(F.col("host")).alias("key"), F.lit(True).alias("is_rule"), F.lit(None).cast(id_type).alias("page_id"), "host", "path", "verdict")
    # The key alone decides the range; a hash of the id splits one very common url.
    salt = F.when(F.col("is_rule"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)))
    dealt = cut(urls.unionByName(opened).withColumn("salt", salt).repartitionByRange(n, "key", "salt").withColumn("range_no", F.spark_partition_id()))
    first = dealt.groupBy("range_no").agg(F.min("key").alias("first_key"))
    # Hosts that are prefixes of a range's first host: their rules may have opened before.
    labels = F.split(F.split("first_key", "\x00").getItem(0), "\x01", -1)
    above = first.select("range_no", "first_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "\x01"))).alias("host_key"))
    carried = above.join(opened.withColumnRenamed("key", "host_key"), "host_key").select(F.col("host_key").alias("key"), "is_rule", "page_id", "host", "path", "verdict", "range_no")
    swept = (
        dealt.drop("salt").unionByName(carried)
        .repartitionByRange(n, "range_no").sortWithinPartitions("range_no", "key", F.desc("is_rule"))
        .select("key", "is_rule", "page_id", "host", "path", "verdict")
    )
    schema = f"page_id {id_type.simpleString()}, host string, path string, rule string, verdict string"
    judged = swept.mapInPandas(_sweep, schema)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
