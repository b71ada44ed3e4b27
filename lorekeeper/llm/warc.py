"""WARC archives: writing, reading, and a capture index merged from sorted runs."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, join_groups, materialise, shared_folder

#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 1000
#: Records of an archive file, which is read as one, of payloads up to ``LARGE_BYTES``, and of larger ones.
FILE_RECORDS, LARGE_BYTES, LARGE_RECORDS = 1000, 1 << 16, 16
#: Captures without a date of their own follow each other by page_id, a second each, from
#: this time on (2020-01-01), and start again after 2**30 seconds.
FIRST_CAPTURE, SECONDS = 1_577_836_800, 1 << 30
#: Index rows of a range that a loser tree merges in one task.
RANGE_ROWS = 50_000
_CRLF = "\r\n"
_HEAD_END = b"\r\n\r\n"


def _date(pages: DataFrame) -> Column:
    """When each page was captured, in UTC: its ``date`` if that is a time, else one made from page_id."""
    made = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(SECONDS)))
    known = dict(pages.dtypes).get("date") in ("timestamp", "timestamp_ntz", "date", "string")
    time = F.coalesce(F.col("date").try_cast("timestamp"), made) if known else made
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _captures(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        _date(pages).alias("date"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )


def plan_records(pages: DataFrame) -> DataFrame:
    """The captures with their dates, record_type and refers_to.

    Of records with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes the one with
    the largest page_id is the response and others revisit it.  Rows that repeat that
    page_id are all responses; a null page_id is the smallest.
    """
    rows = _captures(pages)
    big = rows.select("page_id", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    groups = big.groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    joined = join_groups(rows, materialise(groups, "payloads"), ["payload_digest"], "n_rows")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    return joined.select(
        "page_id", "url", "date", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def _record(row_type: Column) -> Column:
    """One WARC record as a string; the writer ends each with two line ends."""
    http = F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}{_CRLF}")
    block = F.concat(http, F.when(row_type == "response", F.col("payload")).otherwise(F.lit("")))
    one_line = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    header = F.concat_ws(
        _CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), row_type),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), one_line),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(row_type == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(row_type == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(header, F.lit(_CRLF + _CRLF), block)


def write_archives(records: DataFrame, path: str) -> None:
    """Write planned records as gzip-compressed WARC files under ``path``.

    The text writer puts the record separator of the format after each row, so files
    are written by Spark to any file system and survive retried tasks.  A file is read
    as one, so files of large payloads have few records.
    """
    value = _record(F.col("record_type")).alias("value")
    large = F.col("payload_bytes") > LARGE_BYTES
    for name, which, most in (("small", ~large, FILE_RECORDS), ("large", large, LARGE_RECORDS)):
        writer = records.where(which).select(value).write.option("lineSep", _CRLF + _CRLF).option("compression", "gzip")
        writer.option("maxRecordsPerFile", most).text(f"{path}/{name}")


def _parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and payload of each record of a compressed archive, unpacked piece by piece."""
    unpacker, at, held = zlib.decompressobj(47), 0, bytearray()

    def more() -> bool:
        nonlocal content
        piece = unpacker.decompress(content, 1 << 20)
        content = unpacker.unconsumed_tail
        held.extend(piece)
        return bool(piece)

    while held or more():
        while (end := held.find(_HEAD_END)) < 0:
            if not more():
                raise ValueError(f"the record at byte {at} has no headers")
        headers = dict(line.split(": ", 1) for line in held[:end].decode("utf-8").split(_CRLF)[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        while len(held) < stop + 4 and more():
            pass
        if held[stop : stop + 4] != _HEAD_END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        block = bytes(held[start:stop])
        yield at, stop + 4, headers, block[block.index(_HEAD_END) + 4 :]
        at += stop + 4
        del held[: stop + 4]


def _number(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row a record, parsed from the archives: where it is, its headers and a check of its payload.

    A response's digest and length are computed from the bytes that were read; a
    revisit's are those of its headers, as it has no payload.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for offset, length, h, payload in _parse(content):
                    response = h["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest() if response else h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if response and digest != h["WARC-Payload-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"{name}, byte {offset}: the payload is not the one that was written")
                    n = len(payload) if response else int(h["X-Payload-Length"])
                    rows.append((_number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Type"], n, digest, _number(h.get("WARC-Refers-To")), name, offset, length, payload.decode("utf-8") if payloads and response else None))
                out = pd.DataFrame(rows, columns=["page_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "offset", "length", "payload"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long, payload string")


def url_key(url: Column) -> Column:
    """The key under which captures of a page sort together: host labels reversed, then path and query."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r":\d+$", ""), r"^www\d*\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


class LoserTree:
    """Merges k sorted lists: each inner node holds the loser of its match, so the next row takes log k comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _key(self, i: int) -> tuple | None:
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        """Whether run i's next row comes before run j's; exhausted runs come last, ties go to the earlier run."""
        x, y = self._key(i), self._key(j)
        if x is None or y is None:
            return x is not None or (y is None and i < j)
        return x < y or (x == y and i < j)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # still being built: wait here for the run that comes next
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while (row := self._key(winner := self.losers[0])) is not None:
            yield row
            self.at[winner] += 1
            self._play(winner)


_ORDER = ["url_key", "date", "sort_id", "file", "offset"]


def _merge_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one range in order: its pieces of the runs, which come one after the other, merged by a loser tree."""
    parts = list(batches)
    if not parts:
        return
    part = pd.concat(parts, ignore_index=True)
    files = part["file"].to_numpy()
    edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(part)]
    columns = [part[c].tolist() for c in _ORDER]
    runs = [list(zip(*(c[a:b] for c in columns), range(a, b), strict=True)) for a, b in zip(edges, edges[1:]) if a < b]
    order = np.array([row[-1] for row in LoserTree(runs)], dtype=np.int64)
    for at in range(0, len(order), 10_000):
        yield part.loc[order[at : at + 10_000]]


def capture_index(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """The index of all captures in the order of URL key, date and page_id: the history of each page in turn.

    Each archive is a run that is sorted where it was read.  Rows are dealt to ranges by
    key, date and place, so that one page's many captures are divided too; in each range
    the sorted pieces of the runs come one after the other and a loser tree merges them.
    Ranges follow each other, so the whole is in order.  The number of ranges grows with
    the records, so that a task holds about ``RANGE_ROWS`` index rows, without payloads.
    """
    spark = records.sparkSession
    rows = records.drop("payload").withColumns({"url_key": url_key(F.col("url")), "sort_id": F.coalesce("page_id", F.lit(-(2**63)))})
    runs = materialise(rows.sortWithinPartitions("file", *_ORDER[:3]), "runs")
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS), 1)
    pieces = runs.repartitionByRange(ranges, *_ORDER).sortWithinPartitions("file", *_ORDER[:3], "offset")
    return pieces.mapInPandas(_merge_runs, runs.schema).drop("sort_id")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and give what reading them back finds, one row a page.

    The rows are those of the merged capture index, in its order: what each record says
    and where it is.  A null html counts as empty; null or odd urls are kept without white
    space; a ``date`` that is a time, or a string that reads as one, is the capture's, other
    captures are dated by page_id; captures of one key and date are in the order of page_id;
    an empty table gives no record.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    path = path or f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(plan_records(pages), path)
    return capture_index(read_archives(spark, path))
