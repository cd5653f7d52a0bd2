"""WARC archives: one gzip member for each record, and a sequential reader that verifies them.

Spark deals the records out; each task writes one archive under a name of its own and moves it into
place when it is complete, so a task that runs again replaces it. Archives lie in any store that
pyarrow's file systems open from a URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Compressed bytes that the reader takes from an archive at once.
READ_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, page_id: int | str, url: str, payload: bytes | None, size: int, payload_digest: str, refers_to: int | str | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with the HTTP headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": DATE, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": payload_digest, "WARC-Block-Digest": _digest(block), "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


class _Inflated:
    """The bytes of an archive's gzip members, a little at a time; a record must end where its member ends."""

    def __init__(self, source: BinaryIO):
        self.source, self.raw, self.out, self.member = source, b"", bytearray(), None

    def _more(self) -> bool:
        """Inflates some more of the member; false at its end."""
        if self.member.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                raise ValueError("the archive ends within a gzip member")
        self.out += self.member.decompress(self.raw, READ_BYTES)
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def begin(self) -> bool:
        """Opens the next member; false at the end of the archive."""
        self.raw = self.raw or self.source.read(READ_BYTES)
        self.member, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def head(self) -> bytes:
        """All up to and with the empty line."""
        while (at := self.out.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError("a record without the end of its header")
        return self._take(at + 4)

    def _take(self, n: int) -> bytes:
        taken = bytes(self.out[:n])
        del self.out[:n]
        return taken

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise ValueError("a record shorter than its Content-Length")
        return self._take(n)

    def end(self) -> None:
        while self._more():
            pass
        if self.out:
            raise ValueError("a gzip member goes on after its record")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of an archive in order: WARC fields, HTTP fields, payload. Raises ValueError where framing or a digest is wrong."""
    inflated = _Inflated(source)
    while inflated.begin():
        head = inflated.head()
        if not head.startswith(b"WARC/1."):
            raise ValueError("a member that does not begin with a WARC version")
        fields = _fields(head)
        block = inflated.exactly(int(fields["content-length"]))
        if inflated.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record without its closing lines")
        inflated.end()
        if _digest(block) != fields["warc-block-digest"]:
            raise ValueError(f"block digest of {fields['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response" and _digest(payload) != fields["warc-payload-digest"]:
            raise ValueError(f"payload digest of {fields['warc-record-id']}")
        yield fields, _fields(http), payload


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload size, digest, record type and the page that a revisit refers to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    each = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("sha1"))
    kept = each.where(F.col("size") >= REVISIT_BYTES).groupBy("sha1", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    joined = each.join(kept.select("sha1", "size", "kept"), ["sha1", "size"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "sha1", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("kept")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of ``pages`` to archives in ``folder``; returns their names (file), one row each."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        draft, n = f"{root}/.{name}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    body = (row.html or "").encode("utf-8", "surrogatepass") if row.kind == "response" else None
                    digest = "sha1:" + base64.b32encode(bytes.fromhex(row.sha1)).decode()
                    out.write(record_bytes(row.kind, row.page_id or "", row.url or "", body, row.size, digest, row.refers_to))
                    n += 1
        if n:
            store.move(draft, f"{root}/{name}")
        else:
            store.delete_file(draft)
        yield pd.DataFrame({"file": [f"{folder.rstrip('/')}/{name}"] * bool(n)}, dtype="object")

    # (ids as text: beside nulls, pandas would hold them as doubles)
    planned = plan_records(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return cut(planned.mapInPandas(write, "file string"))


def read_warc(files: DataFrame) -> DataFrame:
    """``files`` (file) to a row for each record, read in order: page_id, url, record_type, refers_to, payload_bytes, payload_digest (hex), html (null for a revisit)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]
        for batch in batches:
            for file in batch["file"]:
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as source:
                    rows, held = [], 0
                    for fields, http, payload in read_records(source):
                        ids = [fields[k][10:-1] or None if k in fields else None for k in ("warc-record-id", "warc-refers-to")]
                        hexed = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
                        html = payload.decode("utf-8", "surrogatepass") if fields["warc-type"] == "response" else None
                        rows.append((ids[0], fields["warc-target-uri"], fields["warc-type"], ids[1], int(http["content-length"]), hexed, html))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=columns)

    n = max(1, min(files.count(), 10_000))
    read_back = files.repartition(n).mapInPandas(read, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, html string")
    return read_back.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; more columns are ignored) as archives in the shared folder and reads them back.

    One row per page: page_id, payload_bytes, payload_digest (SHA-1 in hex), record_type, refers_to. A null
    html is an empty payload, a null url an empty one. A null page_id stays null; of rows with one payload it is
    no response unless all have a null page_id, and then all are. Of rows with equal payloads
    of REVISIT_BYTES or more that repeat a page_id, all with the largest are responses; empty tables give no rows.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    files = write_warc(pages, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
