"""Media columns: what bytes are, by their signatures, whatever they were declared to be.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass; a format's validator then walks
the structure from there and gives the length it proves, or rejects the place. What begins at byte 0 decides
the type; further valid stretches are embedded media and can be carved out.

Defined results: null bytes have no kind and no embedded media; bytes of no known format have kind null and
keep their declared type; of overlapping stretches the one that begins first (then the longest) counts, but
stretches inside the main one count as embedded; `carved` gives the bytes of embedded ones, none for null bytes; in `store`, a null text is empty and equal texts give equal
bytes; other columns pass through `sniff`, which replaces its own output columns; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tallyframe.llm import common

# Magic bytes, their place in the format, and the type.
MAGIC = (
    ("png", b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    ("jpeg", b"\xff\xd8\xff", 0, "image/jpeg"),
    ("gif", b"GIF87a", 0, "image/gif"),
    ("gif", b"GIF89a", 0, "image/gif"),
    ("bmp", b"BM", 0, "image/bmp"),
    ("pgm", b"P5", 0, "image/x-portable-graymap"),
    ("wav", b"RIFF", 0, "audio/wav"),
    ("gzip", b"\x1f\x8b\x08", 0, "application/gzip"),
    ("pdf", b"%PDF-", 0, "application/pdf"),
)
TYPES = {kind: mime for kind, _, _, mime in MAGIC}
UNIT, ROW = 192, 192


def _png(d: memoryview) -> int | None:
    at, kinds = 8, []
    while at + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, at)
        end = at + 12 + size
        if end > len(d) or zlib.crc32(d[at + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0] or not kinds and kind != b"IHDR":
            return None
        kinds.append(kind)
        at = end
        if kind == b"IEND":
            return at if b"IDAT" in kinds else None
    return None


def _jpeg(d: memoryview) -> int | None:
    at, frames = 2, 0
    while at + 4 <= len(d) and d[at] == 0xFF:
        mark = d[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        size = int.from_bytes(d[at + 2 : at + 4], "big")
        if mark < 0xC0 or size < 2:
            return None
        frames += 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        at += 2 + size
        if mark == 0xDA:
            rest, k = bytes(d[at:]), 0
            while (k := rest.find(b"\xff", k)) >= 0 and k + 1 < len(rest):
                if rest[k + 1] == 0 or 0xD0 <= rest[k + 1] <= 0xD7:
                    k += 2
                elif rest[k + 1] == 0xD9:
                    return at + k + 2 if frames else None
                else:
                    break
            if k < 0 or k + 1 >= len(rest):
                return None
            at += k
    return None


def _gif(d: memoryview) -> int | None:
    if len(d) < 14:
        return None
    at = 13 + (3 << (d[10] & 7) + 1 if d[10] & 0x80 else 0)
    images = 0

    def blocks(at: int) -> int:
        while at < len(d) and d[at]:
            at += d[at] + 1
        return at + 1

    while at < len(d):
        if d[at] == 0x3B:
            return at + 1 if images else None
        if d[at] == 0x21:
            at = blocks(at + 2)
        elif d[at] == 0x2C and at + 10 < len(d):
            images += 1
            at = blocks(at + 11 + (3 << (d[at + 9] & 7) + 1 if d[at + 9] & 0x80 else 0))
        else:
            return None
    return None


def _bmp(d: memoryview) -> int | None:
    if len(d) < 30:
        return None
    size, zero, pixels, header = struct.unpack_from("<IIII", d, 2)
    planes = struct.unpack_from("<H", d, 26 if header > 12 else 22)[0]
    return size if not zero and header in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and 14 + header <= pixels < size <= len(d) else None


def _pgm_header(d: memoryview) -> tuple[int, int, int] | None:
    """Width, height and where the samples begin."""
    fields, at, head = [], 2, bytes(d[:128])
    while len(fields) < 3:
        start = at
        while at < len(head) and head[at : at + 1].isspace():
            at += 1
        if at == start:
            return None
        if head[at : at + 1] == b"#":
            at = head.find(b"\n", at)
            if at < 0:
                return None
            continue
        end = at
        while end < len(head) and head[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(head[at:end]))
        at = end
    width, height, top = fields
    return (width, height, at + 1) if head[at : at + 1].isspace() and 0 < top < 256 and width and height else None


def _pgm(d: memoryview) -> int | None:
    found = _pgm_header(d)
    return found[2] + found[0] * found[1] if found and found[2] + found[0] * found[1] <= len(d) else None


def _riff_parts(d: memoryview) -> dict[bytes, tuple[int, int]] | None:
    """Place and size of each part of a RIFF file whose lengths hold."""
    if len(d) < 12:
        return None
    end = 8 + struct.unpack_from("<I", d, 4)[0]
    if end > len(d):
        return None
    at, parts = 12, {}
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", d, at)
        if at + 8 + size > end:
            return None
        parts.setdefault(kind, (at + 8, size))
        at += 8 + size + (size & 1)
    return parts


def _wav(d: memoryview) -> int | None:
    parts = _riff_parts(d) if bytes(d[8:12]) == b"WAVE" else None
    return 8 + struct.unpack_from("<I", d, 4)[0] if parts and parts.get(b"fmt ", (0, 0))[1] >= 16 and b"data" in parts else None


def _gzip(d: memoryview) -> int | None:
    """The stream is inflated piece by piece, so memory stays small, and its checksum is checked."""
    if len(d) < 18 or d[3] & 0xE0:
        return None
    z, at = zlib.decompressobj(31), 0
    try:
        while not z.eof and at < len(d):
            chunk = d[at : at + 65536]
            z.decompress(chunk, 1 << 20)
            while z.unconsumed_tail and not z.eof:
                z.decompress(z.unconsumed_tail, 1 << 20)
            at += len(chunk)
    except zlib.error:
        return None
    return at - len(z.unused_data) if z.eof else None


#: The end of a section of a file, and what an update that is appended to it begins with.
_PDF_END = re.compile(rb"startxref\s+(\d{1,20})\s+%%EOF")
_PDF_MORE = re.compile(rb"\s*(?:%[^\r\n]*\s+)*(?:\d+ \d+ obj|xref\b)")


def _pdf(d: memoryview) -> int | None:
    """Sections follow each other while objects do; the cross-references of the last one must lie before its end."""
    at = 5
    while m := _PDF_END.search(d, at):
        if not _PDF_MORE.match(d, m.end()):
            return m.end() if int(m[1]) < m.start() else None
        at = m.end()
    return None


VALIDATORS: dict[str, Callable[[memoryview], int | None]] = {"png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "pgm": _pgm, "wav": _wav, "gzip": _gzip, "pdf": _pdf}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic, place, _ in MAGIC:
        found.add_word(magic.decode("latin-1"), (kind, len(magic) + place - 1))
    found.make_automaton()
    return found


def sniffed(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, length) of valid media: the main one, if one begins at 0, then what is embedded, in order."""
    view, found = memoryview(data), []
    last = data.rfind(b"%%EOF")  # no document begins after it, however often its magic bytes occur
    for end, (kind, back) in _automaton().iter(data.decode("latin-1")):
        start = end - back
        if kind == "pdf" and start > last:
            continue
        if start >= 0 and (length := VALIDATORS[kind](view[start:])):
            found.append((start, -length, kind))
    out, reach = [], 0
    for start, length, kind in sorted(found):
        if start == 0 and not out or start > 0 and start >= reach:
            out.append((kind, start, -length))
            reach = start - length if start else 0
    return out


def wav_of(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload


def pgm_of(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def png_of(payload: bytes) -> bytes:
    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # each row after its filter type, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + part(b"IEND", b"")


STORED = (("wav", wav_of), ("pgm", pgm_of), ("png", png_of))


def samples(data: bytes, kind: str) -> bytes:
    """The 8-bit samples of a stored form."""
    view = memoryview(data)
    if kind == "wav":
        at, size = _riff_parts(view)[b"data"]
        return data[at : at + size]
    if kind == "pgm":
        width, height, at = _pgm_header(view)
        return data[at : at + width * height]
    if kind == "png":
        at, body, width = 8, [], 0
        while at < len(data):
            size, part = struct.unpack_from(">I4s", data, at)
            if part == b"IHDR":
                width = struct.unpack_from(">I", data, at + 8)[0]
            elif part == b"IDAT":
                body.append(data[at + 8 : at + 8 + size])
            at += 12 + size
        rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
        return rows[:, 1:].tobytes()
    raise ValueError(kind)


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT)), len(data)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, media, held = [], [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            payload, n = padded(text.as_py())
            media.append(STORED[zlib.crc32(payload) % len(STORED)][1](payload))
            ids.append(doc_id)
            sizes.append(n)
            held += len(media[-1])
            if held > 16 << 20:
                yield _batch(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield _batch(ids, sizes, media)


def _batch(ids, sizes, media) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, path: str) -> DataFrame:
    """Whole texts as media files (one of three formats by the payload's checksum) in a table at path; the table, read again."""
    common.lean(docs).select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("doc_id long, n_bytes long, media binary").parquet(path)


SNIFFED = "kind string, valid boolean, corrected_type string, embedded array<struct<kind:string,start:long,length:long>>"


def sniff(df: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """df with kind, valid (the declared type is the true one), corrected_type and embedded."""

    def run(series):
        import pandas as pd

        rows = []
        for data, said in zip(series[media], series[declared]):
            found = sniffed(bytes(data)) if data is not None else []
            main = next((k for k, at, _ in found if at == 0), None)
            true = TYPES.get(main, said)
            rows.append((main, main is not None and true == said, true, [{"kind": k, "start": a, "length": n} for k, a, n in found if a]))
        return pd.DataFrame(rows, columns=["kind", "valid", "corrected_type", "embedded"])

    out = df.withColumn("_sniffed", F.pandas_udf(run, SNIFFED)(F.struct(F.col(media).alias(media), F.col(declared).alias(declared))))
    names = ["kind", "valid", "corrected_type", "embedded"]
    return out.withColumns({n: F.col(f"_sniffed.{n}") for n in names}).drop("_sniffed")


def carved(df: DataFrame, media: str = "media") -> DataFrame:
    """A row per embedded stretch of media: df's other columns, carved_kind, carved_start and carved_bytes; replaces columns of those names."""
    own = ["carved_kind", "carved_start", "carved_bytes"]
    df = df.drop(*own)
    at = df.columns.index(media)
    kept = [i for i in range(len(df.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 50):
            rows = []
            for i, data in enumerate(part.column(at)):
                data = data.as_py()
                rows += [(i, kind, start, data[start : start + n]) for kind, start, n in (sniffed(data) if data is not None else []) if start]
            rest = part.select(kept).take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.string()), (2, pa.int64()), (3, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*rest.schema.names, *own])

    added = [StructField("carved_kind", StringType()), StructField("carved_start", LongType()), StructField("carved_bytes", BinaryType())]
    return common.lean(df).mapInArrow(run, StructType([f for f in df.schema.fields if f.name != media] + added))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, kind string, declared_ok boolean"


def _features(declared: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in FEATURES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = media.as_py()
                found = sniffed(data)
                kind, _, length = found[0]
                payload = samples(data[:length], kind)
                x = np.frombuffer(payload, np.uint8)
                over = np.count_nonzero(np.diff((x > 127).view(np.int8)))
                feature = f"{kind};n={len(x)};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};crossings={over};embedded={len(found) - 1}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, kind, TYPES[kind] == declared))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def features(stored: DataFrame, declared: str = "audio/wav") -> DataFrame:
    """Sniffs the stored bytes, decodes them by what they are and describes the samples."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features(declared), FEATURES)


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(common.table(spark, sf_dir, "documents"), common.scratch(spark, "media")))
