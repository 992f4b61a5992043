"""WARC archives: writing, reading back, and an index built by external merge.

Pages are written as WARC/1.0 files by Spark's text writer (its record separator
is the blank line that ends every WARC record), so a lost task is simply run
again. Records whose payloads have equal SHA-1 digests are stored once: the one
with the largest page id is the ``response``, the others are ``revisit`` records
that name it. Reading takes a file per row and cuts it by Content-Length.

Every archive yields a run of index entries, sorted by (URL key, timestamp)
where the archive is read. The runs are merged into one global order: a range
partitioning of the keys gives each task a slice of every run, and a loser tree
merges the slices. The result is the capture history of every URL.

Results for special rows: a null html is an empty payload; a null url has the
key ``-``; a null or repeated ``page_id`` is written like any other, and of equal
payloads every row with the largest id is a response (a null id counts as the
least).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_dir
from .common import small_side, stored

RECORD_END = "\r\n\r\n"
ARCHIVE_BYTES = 8 << 20
# The base-32 alphabet, and the two profiles' names.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

ENTRY = ("page_id long, url string, url_key string, captured string, archive string, position long, "
         "record_type string, payload_bytes long, payload_digest string, refers_to long")


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query, lower case."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/")
    return key + ("?" + parts.query if parts.query else "")


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of the matches below, the winner is the next entry."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.head = [next(r, None) for r in self.runs]  # None: the run has ended
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _enter(self, i: int) -> None:
        """The first matches: a contender waits at a node until its opponent arrives."""
        node = (i + self.k) // 2
        while node:
            if self.loser[node] < 0:
                self.loser[node] = i
                return
            if self._before(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        if not self.k:
            return
        while True:
            winner = self.loser[0]
            entry = self.head[winner]
            if entry is None:
                return
            yield entry
            self.head[winner] = next(self.runs[winner], None)
            i, node = winner, (winner + self.k) // 2
            while node:
                if self._before(self.loser[node], i):
                    self.loser[node], i = i, self.loser[node]
                node //= 2
            self.loser[0] = i


def _captures(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("captured").cast("timestamp").alias("captured"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), _digest(payload).alias("payload_digest"))


def _digest(payload: Column) -> Column:
    """Base-32 SHA-1 of ``payload``: each five hex digits are 20 bits, so four letters."""
    def letters(five: Column) -> Column:
        bits = F.conv(five, 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    fives = F.regexp_extract_all(F.sha1(payload), F.lit(".{5}"), F.lit(0))
    return F.array_join(F.transform(fives, letters), "")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write ``pages`` (page_id, url, html, captured) as WARC files under ``path``; returns ``path``.

    Payloads under ``least_bytes`` are never revisits. A file has as many
    records as make ``archive_bytes`` on average.
    """
    rows = _captures(pages)
    keys = stored(rows.select("page_id", "payload_digest", "payload_bytes"), "warc-digests")
    stats = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes")).first()
    per_file = max(1, int(archive_bytes * max(1, stats["n"]) / (1 + (stats["bytes"] or 0) + 600 * stats["n"])))
    groups = (keys.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
              .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    rows = rows.join(small_side(stored(groups, "warc-groups")), ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce(F.col("first_id") > F.coalesce("page_id", F.lit(-(1 << 63))), F.lit(False))

    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    # header values are one line: breaks inside a URL are percent-encoded
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    stamp = F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.col("payload_bytes").cast("string")
    head = F.concat(F.lit(HTTP_HEAD), size, F.lit("\r\n\r\n"))
    body = F.when(again, F.lit("")).otherwise(F.concat(head, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("page_id")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.coalesce(line("WARC-Date", stamp), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name("first_id")),
                               line("X-Payload-Length", size))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)
    rows.select(record.alias("value")).write.options(lineSep=RECORD_END, maxRecordsPerFile=per_file).text(path)
    return path


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def parse_archive(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, headers, block) of every record of an archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, raw[end + 4:end + 4 + size]
        at = end + 4 + size + len(RECORD_END)


def _page(name: str | None) -> int | None:
    m = _PAGE.fullmatch(name or "")
    return int(m[1]) if m else None


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """Index entries of the archives under ``path``: one sorted run per archive, in its order.

    The digest and size of a response are taken from its payload as read. With
    ``payloads`` there is a further column, the payload (null for revisits).
    """
    import base64
    import hashlib

    def run(batches):
        for batch in batches:
            for archive, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                entries = []
                for at, headers, block in parse_archive(raw.as_buffer().to_pybytes()):
                    url = headers.get("WARC-Target-URI")
                    entry = [_page(headers["WARC-Record-ID"]), url, url_key(url), headers.get("WARC-Date", ""), archive, at,
                             headers["WARC-Type"]]
                    if headers["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        entry += [len(payload), digest, None]
                    else:
                        payload = None
                        entry += [int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                                  _page(headers["WARC-Refers-To"])]
                    entries.append((*entry, payload))
                entries.sort(key=lambda x: (x[2], x[3], x[5]))
                for lo in range(0, len(entries), 500):
                    columns = list(zip(*entries[lo:lo + 500]))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [x.split()[0] for x in ENTRY.split(", ")] + (["payload"] if payloads else [])
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in ENTRY.split(", ")] + [pa.binary()] * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return rows.mapInArrow(run, ENTRY + (", payload binary" if payloads else ""))


def merge_index(runs: DataFrame) -> DataFrame:
    """The entries of all runs in one global order by (url_key, captured, archive, position).

    Every partition of the result is in that order, and follows its predecessor.
    """
    names = [x.split()[0] for x in ENTRY.split(", ")]

    def merge(batches):
        held: dict[str, list] = {}  # this task's slice of each run, in the run's order
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                held.setdefault(row[4], []).append((row[2], row[3], row[4], row[5], row))
        out = []
        for entry in LoserTree(list(held.values())):
            out.append(entry[4])
            if len(out) == 5000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in ENTRY.split(", ")]
    return (runs.select(*names).repartitionByRange("url_key", "captured", "archive", "position")
            .sortWithinPartitions("archive", "url_key", "captured", "position").mapInArrow(merge, ENTRY))


def capture_history(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and merge their indexes."""
    spark = pages.sparkSession
    path = write_archives(pages, scratch_dir(spark, "warc"), least_bytes)
    return merge_index(stored(read_archives(spark, path), "warc-runs"))
