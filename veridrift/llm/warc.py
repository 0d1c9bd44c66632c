"""A deterministic, sharded WARC writer, and its reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: A file is closed once its compressed records reach this; a shard holds about this much payload, so several files.
FILE_BYTES, SHARD_BYTES = 1 << 20, 16 << 20
#: Ranges of page ids counted first to place the cuts between shards, and what a record counts besides its payload.
RANGES, RECORD_BYTES = 16_384, 512
LEVEL = 4
#: Tasks that read archives, at most; each then reads several files one after another.
MOST_READERS = 20_000
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, level: int) -> bytes:
    """One gzip member: a response, or a revisit of the response with the id ``first_id``."""
    own = digest(payload)
    fields = {"WARC-Type": "response" if first_id is None else "revisit", "WARC-Record-ID": _name(page_id, own) if first_id is None else _name(page_id, f"{own}/revisit"), "WARC-Date": DATE}
    if url:
        fields["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    fields |= {"WARC-Payload-Digest": f"sha1:{own}", "X-Payload-Length": str(len(payload))}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head
    if first_id is None:
        block += payload
    else:
        fields |= {"WARC-Refers-To": _name(first_id, own), "X-Refers-To-Page": str(first_id), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


@dataclass
class _Cuts:
    """How pages are cut into ``count`` shards; every table has about as many rows as there are shards or counted ranges, at most."""

    shift: int = 0  # ids of one range agree but for so many low bits
    narrowed: list[DataFrame] = field(default_factory=list)  # ranges that are cut again: cell, shift, to_shift
    bits: DataFrame | None = None  # ids cut by digest: cut_cell, bits
    pieces: DataFrame | None = None  # pages repeated beyond a shard: page_id, sha1, piece, shard
    shards: DataFrame | None = None  # cell, part, shard
    count: int = 1

    def celled(self, rows: DataFrame) -> DataFrame:
        """With the range of ids (``cell``, its least id) and the part of it by digest."""
        cell = F.expr("shiftleft(shiftright(page_id, shift), shift)")
        out = rows.withColumn("shift", F.lit(self.shift)).withColumn("cell", cell)
        for table in self.narrowed:
            out = out.join(F.broadcast(table), ["cell", "shift"], "left").withColumn("shift", F.coalesce("to_shift", "shift")).drop("to_shift", "cell").withColumn("cell", cell)
        if self.bits is None:
            return out.withColumn("part", F.lit(0).cast("long"))
        part = F.expr("shiftright(cast(conv(substr(sha1, 1, 15), 16, 10) as long), 60 - bits)")
        return out.join(F.broadcast(self.bits), F.col("cell").eqNullSafe(F.col("cut_cell")), "left").withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).drop("cut_cell", "bits")

    def placed(self, rows: DataFrame) -> DataFrame:
        """With the shard of each row."""
        table = self.shards.select(F.col("cell").alias("cut_cell"), F.col("part").alias("cut_part"), "shard")
        return self.celled(rows).join(F.broadcast(table), F.col("cell").eqNullSafe(F.col("cut_cell")) & (F.col("part") == F.col("cut_part"))).drop("cut_cell", "cut_part", "cell", "shift", "part")

    def repeated(self, rows: DataFrame, how: str) -> DataFrame:
        """The rows of pages that are repeated beyond a shard (``left_semi``), or the others (``left_anti``)."""
        keys = self.pieces.select(F.col("page_id").alias("cut_page"), F.col("sha1").alias("cut_sha1")).distinct()
        return rows.join(F.broadcast(keys), F.col("page_id").eqNullSafe(F.col("cut_page")) & (F.col("sha1") == F.col("cut_sha1")), how)

    def in_pieces(self, rows: DataFrame, on_piece: bool) -> DataFrame:
        """Joined with their page's pieces: with all, or with the one that the row has."""
        table = self.pieces.select(F.col("page_id").alias("cut_page"), F.col("sha1").alias("cut_sha1"), F.col("piece").alias("cut_piece"), "shard")
        near = F.col("page_id").eqNullSafe(F.col("cut_page")) & (F.col("sha1") == F.col("cut_sha1"))
        return rows.join(F.broadcast(table), near & (F.col("piece") == F.col("cut_piece")) if on_piece else near).drop("cut_page", "cut_sha1", "cut_piece")


def _cuts(light: DataFrame, shard_bytes: int) -> _Cuts:
    """Shards of about ``shard_bytes`` whatever the ids, by the bytes counted in ranges of ids.

    A range that holds more is counted again in narrower ones, down to single ids. The pages of a single id, and those
    without an id, are cut by the digest of their payload, and the rows with one id and payload in their
    order by url. The same pages give the same shards however they are partitioned.
    """
    spark, cuts = light.sparkSession, _Cuts()
    low, high = light.agg(F.min("page_id"), F.max("page_id")).first()
    while low is not None and (high >> cuts.shift) - (low >> cuts.shift) >= RANGES:
        cuts.shift += 1
    # four parts or more for each shard's bytes, so that what is counted grows with the bytes only
    finer = lambda held: max(4, (4 * held // shard_bytes).bit_length())
    while True:
        heavy = cuts.celled(light).groupBy("cell", "shift").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > shard_bytes).collect()
        wide = [(r.cell, r["shift"], max(0, r["shift"] - finer(r.bytes))) for r in heavy if r.cell is not None and r["shift"]]
        if not wide:
            break
        cuts.narrowed.append(spark.createDataFrame(wide, "cell long, shift int, to_shift int"))
    large: list = []
    if heavy:
        cuts.bits = spark.createDataFrame([(r.cell, min(60, finer(r.bytes))) for r in heavy], "cut_cell long, bits int")
        same = cuts.celled(light).groupBy("cell", "part", "page_id", "sha1").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("each"), F.count("*").alias("copies"))
        large = same.where((F.col("bytes") > shard_bytes) & (F.col("copies") > 1)).collect()
    counted = cuts.celled(light).groupBy("cell", "part").agg(F.sum("bytes").alias("bytes")).collect()
    gone: dict[tuple, int] = {}
    held: list[tuple] = []  # no id first, range, part, digest, piece, bytes, page
    for r in large:
        gone[r.cell, r.part] = gone.get((r.cell, r.part), 0) + r.bytes
        fit = max(1, shard_bytes // r.each)
        held += [(r.cell is not None, r.cell or 0, r.part, r.sha1, k, min(fit, r.copies - k * fit) * r.each) for k in range(-(-r.copies // fit))]
    held += [(r.cell is not None, r.cell or 0, r.part, "", 0, r.bytes - gone.get((r.cell, r.part), 0)) for r in counted]
    pieces, shards = [], []
    shard, filled, known = 0, 0, False
    for has_id, cell, part, sha1, piece, size in sorted(held):
        # shard 0 is for pages without an id
        if has_id and not known:
            shard, filled, known = shard + 1, 0, True
        elif filled and filled + size > shard_bytes:
            shard, filled = shard + 1, 0
        filled += size
        row = cell if has_id else None
        if sha1:
            pieces.append((row, sha1, piece, shard))
        else:
            shards.append((row, part, shard))
    cuts.shards, cuts.count = spark.createDataFrame(shards, "cell long, part long, shard int"), shard + 1
    if pieces:
        cuts.pieces = spark.createDataFrame(pieces, "page_id long, sha1 string, piece long, shard int")
    return cuts


def _in_shards(rows: DataFrame, cuts: _Cuts, shard_bytes: int) -> DataFrame:
    """Pages with their ``shard``, and whether the page is a repetition of one in an earlier shard (``again``)."""
    if cuts.pieces is None:
        return cuts.placed(rows).withColumn("again", F.lit(False))
    place = F.row_number().over(Window.partitionBy("page_id", "sha1").orderBy("url")) - 1
    fit = F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / (F.length("payload") + RECORD_BYTES)))
    numbered = cuts.repeated(rows, "left_semi").withColumn("piece", F.floor(place / fit).cast("long")).withColumn("again", F.col("piece") > 0)
    whole = cuts.placed(cuts.repeated(rows, "left_anti")).withColumn("again", F.lit(False))
    return whole.unionByName(cuts.in_pieces(numbered, True).drop("piece"))


def _later_in_shards(later: DataFrame, cuts: _Cuts) -> DataFrame:
    """Pages that revisit another, in each shard that has them."""
    if cuts.pieces is None:
        found = cuts.placed(later)
    else:
        found = cuts.placed(cuts.repeated(later, "left_anti")).unionByName(cuts.in_pieces(cuts.repeated(later, "left_semi").distinct(), False))
    # a column of its own: the pages are placed by the same tables
    return found.withColumn("shard", F.col("shard").alias("shard"))


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _writer(folder: str, min_bytes: int, file_bytes: int, level: int):
    """Writes the records of one shard; gives the manifest rows of its files."""

    def run(pages: pa.Table, earlier: pa.Table) -> pa.Table:
        files: list[dict] = []
        if pages.num_rows:
            fs, base = _file_system(folder)
            fs.create_dir(f"{base}/_temporary", recursive=True)
            first = {(i, s): f for i, s, f in zip(*(earlier[c].to_pylist() for c in ("page_id", "sha1", "first_id")))}
            shard, seen, out = pages["shard"][0].as_py(), set(), None
            # sorted again by what a page holds, so that ties come in the same order each time
            order = sorted(range(pages.num_rows), key=lambda i: (pages["page_id"][i].as_py() or 0, pages["payload"][i].as_py(), pages["url"][i].as_py() or ""))
            for i in order:
                page, url, payload = (pages[c][i].as_py() for c in ("page_id", "url", "payload"))
                key = page, hashlib.sha1(payload).hexdigest()
                refers = first.get(key)
                if refers is None and page is not None and (key in seen or pages["again"][i].as_py()) and len(payload) >= min_bytes:
                    refers = page
                seen.add(key)
                record = _record(page, url, payload, refers, level)
                if out is None:
                    name = f"shard{shard:07d}-{len(files):05d}.warc.gz"
                    files.append({"file": name, "temporary": f"_temporary/{name}.{uuid.uuid4().hex}", "records": 0, "bytes": 0, "first_page": page})
                    out = fs.open_output_stream(f"{base}/{files[-1]['temporary']}")
                out.write(record)
                files[-1]["records"] += 1
                files[-1]["bytes"] += len(record)
                files[-1]["last_page"] = page
                if files[-1]["bytes"] >= file_bytes:
                    out.close()
                    out = None
            if out is not None:
                out.close()
        return pa.Table.from_pylist(files, _MANIFEST)

    return run


_MANIFEST = pa.schema([("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_page", pa.int64()), ("last_page", pa.int64())])
_MANIFEST_SQL = "file string, temporary string, records long, bytes long, first_page long, last_page long"


def _commit(folder: str):
    """Gives files their final names; a file that an earlier attempt has moved stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
                if fs.get_file_info(f"{base}/{temporary}").type != pa.fs.FileType.NotFound:
                    fs.move(f"{base}/{temporary}", f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type == pa.fs.FileType.NotFound:
                    raise FileNotFoundError(name)
            yield batch.select(["file", "records", "bytes", "first_page", "last_page"])

    return run


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, level: int = LEVEL) -> DataFrame:
    """Write a record for each page (``page_id, url, html``) and return the manifest of the files in ``folder``.

    Of equal payloads of at least ``min_bytes`` the page with the smallest id is a response and
    the others revisit it; of repeated rows with that id the first is. Records are sorted by page
    id into shards; files roll by compressed size. Tasks write under temporary names. Only files
    of the stored manifest, which exists when every shard is written, get their final names, so
    what lost executors leave is never seen. Names and contents depend on the pages alone. No shard
    grows with the pages, however ids and payloads repeat.

    A null html is an empty payload. A page without an id goes to a shard of its own kind and is
    a response only if no page with an id has its payload. An empty table writes no file; other
    columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    light = written(rows.select("page_id", "sha1", (F.length("payload") + RECORD_BYTES).cast("long").alias("bytes")))
    cuts = _cuts(light, shard_bytes)
    large = light.where(F.col("bytes") >= min_bytes + RECORD_BYTES)
    least = written(large.where("page_id is not null").groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).withColumnRenamed("sha1", "first_sha1"))
    later = large.join(least, F.col("sha1") == F.col("first_sha1")).where("page_id is null or page_id != first_id").select("page_id", "sha1", "first_id")
    # as many partitions as shards, so that a task's share does not grow with the pages
    by_shard = [x.repartition(cuts.count, "shard").groupBy("shard") for x in (_in_shards(rows, cuts, shard_bytes).drop("sha1"), _later_in_shards(later, cuts))]
    dealt = by_shard[0].cogroup(by_shard[1])
    manifest = written(dealt.applyInArrow(_writer(folder, min_bytes, file_bytes, level), _MANIFEST_SQL))
    committed = written(manifest.mapInArrow(_commit(folder), "file string, records long, bytes long, first_page long, last_page long"))
    discard(light, least, manifest)
    return committed


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's files: ids, lengths and digests as counted from what the archives hold.

    ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload`` (null for a
    revisit, whose digest and length are those of the payload it refers to). A digest that does not fit its
    block fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows = [_parsed(raw) for raw in _members(stream.read())]
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    files = max(1, min(manifest.count(), MOST_READERS))
    return manifest.select("file").repartition(files, "file").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _members(data: bytes) -> Iterator[bytes]:
    while data:
        press = zlib.decompressobj(31)
        yield press.decompress(data)
        data = press.unused_data


def _parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged block of {fields['WARC-Record-ID']}")
    row = {"page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": own}
    if fields["WARC-Type"] == "revisit":
        return row | {"refers_to": int(fields["X-Refers-To-Page"]), "payload_bytes": int(fields["X-Payload-Length"]), "payload": None}
    payload = block.partition(b"\r\n\r\n")[2]
    if digest(payload) != own:
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return row | {"refers_to": None, "payload_bytes": len(payload), "payload": payload}
