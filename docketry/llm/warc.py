"""WARC revisits: "not modified" records resolved to the response that they stand for.

A revisit of the server-not-modified kind holds the headers of a 304 answer and no body. ``resolve`` finds, for each,
the latest earlier full response of the same canonical URL (as-of join), checks its validators, and puts together
the record as a client would see it: the body of the full response and its headers, with those that a 304 may renew
taken from the revisit.

status:  ``resolved``            a validator is given and matches
         ``validator_mismatch``  the entity tag, or else the time of last modification, differs
         ``no_validator``        the revisit has none, or the response has not the one that it has
         ``no_base``             no earlier full response, or no URL
         ``other_profile``       the revisit is of another kind (its payload was met before): no answer to a validator

A full response is one of HTTP status 200, or of none that is known; redirects, errors and partial answers are no bases.
Entity tags are compared weakly; if a revisit has one, its time of last modification isn't looked at. Equal dates
are ordered by record id, and records that share both by a hash of their content; a null date comes before all others, a
null id before other ids of a date. Header names are lower-case; null headers are none. Repeated records stay; an empty table
gives an empty result.

The join is a scan in (URL, date, id) order over range partitions, so the captures of one URL may fill many
partitions. Within a partition a window carries the last response forward; between partitions only the last response of
a URL in each is passed on. Bodies take no part in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.common import settle, spread_join

#: Headers that a 304 answer may renew (fixed by the HTTP standard).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't name a resource.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|jsessionid|phpsessionid|sid)(=|$)"


def canonical_url(url: str | Column) -> Column:
    """host/path?query: host in lower case without www and default port, no scheme, fragment, tracking or last slash, parameters in order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike("(?i)" + TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _tag(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"^W/", "")


def _header(headers: str, name: str) -> Column:
    return F.try_element_at(F.col(headers), F.lit(name))


def as_of(rows: DataFrame, found: Column, key: str, by: list[str]) -> DataFrame:
    """``rows`` with a column ``last``: ``found`` of the latest earlier row of the same ``key`` where it isn't null.

    ``by``: the columns that put rows in order, the time first.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = settle(rows.withColumn("__found", found).repartitionByRange(n, key, *by).withColumn("__part", F.spark_partition_id()), "asof")
    order = [F.col(c).asc_nulls_first() for c in by]
    here = F.last("__found", ignorenulls=True).over(W.partitionBy("__part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    ends = sorted_.where("__found is not null").groupBy(F.col(key).alias("__key"), F.col("__part").alias("__at")).agg(F.max_by("__found", F.struct(*by)).alias("__end"))
    # parts that hold a key: one row for each, also those without anything found
    parts = sorted_.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__at")).agg(F.count("*").alias("__n")).join(ends, ["__key", "__at"], "left")
    before = F.last("__end", ignorenulls=True).over(W.partitionBy("__key").orderBy("__at").rowsBetween(W.unboundedPreceding, -1))
    carried = parts.withColumn("__before", before).where("__before is not null").select("__key", "__at", "__before")
    out = sorted_.withColumn("__here", here)
    out = out.join(carried, (out[key] == carried["__key"]) & (out["__part"] == carried["__at"]), "left")
    return out.withColumn("last", F.coalesce("__here", "__before")).drop("__found", "__part", "__here", "__before", "__key", "__at")


#: What the profile of a revisit that answers a validator ends in (fixed by the WARC standard), and the status of full responses.
NOT_MODIFIED, FULL = r"(^|/)server-not-modified/?$", 200


def resolve(records: DataFrame, body_columns: tuple[str, ...] = (), http_status: str | None = None, profile: str | None = None) -> DataFrame:
    """id, base_id, status, headers and ``body_columns`` of the base for each revisit of ``records``.

    ``records``: id, url, date, kind ("response" or "revisit"; others take no part), headers (map of strings) and the
    columns to take over; ``http_status`` and ``profile`` name further columns, if there are any. A revisit without profile
    is taken to be not modified. What is no base for a revisit has null headers and columns.
    """
    headers = F.array_sort(F.map_entries("headers"))
    code = F.lit(None).cast("int") if http_status is None else F.col(http_status).cast("int")
    kept = F.lit(None).cast("string") if profile is None else F.col(profile)
    mark = F.xxhash64("id", "date", "url", "kind", headers, code, kept, *body_columns)  # equal records may stand for each other
    own = records.where("kind in ('response', 'revisit')").select("id", "date", "kind", "url", "headers", code.alias("__code"), kept.alias("__profile"), mark.alias("__mark"), *(F.col(c).alias(f"__body_{c}") for c in body_columns))
    marks = own.select(
        "id", "date", "kind", "__mark", "__code", "__profile", canonical_url("url").alias("key"), _tag(_header("headers", "etag")).alias("etag"), F.trim(_header("headers", "last-modified")).alias("modified")
    )
    full = (F.col("kind") == "response") & F.coalesce(F.col("__code") == FULL, F.lit(True))
    base = F.when(full, F.struct("id", "__mark", "etag", "modified"))
    seen = as_of(marks.where("key is not null"), base, "key", ["date", "id", "__mark"]).unionByName(marks.where("key is null"), allowMissingColumns=True)
    last = F.col("last")
    status = (
        F.when(~F.coalesce(F.col("__profile").rlike(NOT_MODIFIED), F.lit(True)), "other_profile")
        .when(last.isNull(), "no_base")
        .when(F.col("etag").isNotNull(), F.when(last["etag"].isNull(), "no_validator").when(F.col("etag") == last["etag"], "resolved").otherwise("validator_mismatch"))
        .when(F.col("modified").isNull() | last["modified"].isNull(), "no_validator")
        .when(F.col("modified") == last["modified"], "resolved")
        .otherwise("validator_mismatch")
    )
    revisits = seen.where("kind = 'revisit'").select("id", "__mark", status.alias("status"), last["id"].alias("base_id"), last["__mark"].alias("__base_mark"))
    revisits = revisits.withColumn("base_id", F.when(F.col("status") != "other_profile", F.col("base_id")))
    ok = F.col("status") == "resolved"
    bodies = own.where(full).select(F.col("__mark").alias("__of"), F.col("headers").alias("__old"), *(f"__body_{c}" for c in body_columns)).dropDuplicates(["__of"])
    fresh = own.where("kind = 'revisit'").select(F.col("__mark").alias("__own"), F.col("headers").alias("__new")).dropDuplicates(["__own"])
    none = F.create_map().cast("map<string,string>")
    # a base of very many revisits is copied to the tasks that its revisits are spread over
    solved = spread_join(revisits.where(ok).withColumnRenamed("__base_mark", "__of"), bodies, "__of").drop("__of")
    out = solved.unionByName(revisits.where(~ok).drop("__base_mark"), allowMissingColumns=True).join(fresh, F.col("__mark") == F.col("__own"), "left")
    renewed = F.map_filter(F.coalesce("__new", none), lambda k, v: k.isin(*RENEWED))
    kept = F.map_filter(F.coalesce("__old", none), lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return out.select("id", "base_id", "status", F.when(ok, F.map_concat(kept, renewed)).alias("headers"), *(F.col(f"__body_{c}").alias(c) for c in body_columns))


# reading


BATCH = 8 << 20
_RECORD = "id long, url string, date string, kind string, profile string, status int, headers map<string,string>, body binary"


def _members(data: bytes) -> Iterator[bytes]:
    """The parts of a file that are gzip members, unpacked one after the other; a plain file is one part."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest, at = memoryview(data), 0
    while bytes(rest[at : at + 2]) == b"\x1f\x8b":
        z, parts = zlib.decompressobj(31), []
        try:
            while not z.eof and at < len(rest):
                piece = rest[at : at + (1 << 20)]
                parts.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
        except zlib.error:  # a damaged member ends the file
            return
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[dict]:
    """Response and revisit records of a WARC file, plain or as gzip members, in order; records lie within members.

    A record whose length is missing or no number is passed over, up to the next record.
    """
    for part in _members(data):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                break
            fields = _fields(part[at:end].split(b"\r\n")[1:])
            size = fields.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                at = end + 4
                continue
            block, at = part[end + 4 : end + 4 + int(size)], end + 4 + int(size)
            if fields.get("warc-type") in ("response", "revisit"):
                head, _, body = block.partition(b"\r\n\r\n")
                lines = head.split(b"\r\n")
                code = lines[0].split()[1:2]
                yield {
                    "url": fields.get("warc-target-uri", "").strip("<>") or None, "date": fields.get("warc-date"), "kind": fields["warc-type"], "profile": fields.get("warc-profile"),
                    "status": int(code[0]) if code and code[0].isdigit() and len(code[0]) == 3 else None, "headers": _fields(lines[1:]), "body": body if fields["warc-type"] == "response" else None,
                }


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at ``path``; ids follow file and place in the file.

    A file is read by one task, which holds its bytes as stored (2 GB at most, as Spark reads them) and one member unpacked;
    records leave it in batches of some ``BATCH`` bytes.
    """
    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        columns = [[list(r[n].items()) if n == "headers" else r[n] for r in rows] for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for i, r in enumerate(parse(content.as_py())):
                    rows.append({"id": (zlib.crc32(name.encode()) << 31) + i} | r)
                    size += len(r["body"] or b"") + 1000
                    if size > BATCH:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _RECORD)
