"""Media columns: find media in binary values by their signatures, correct declared types and carve what is embedded."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import extended, prepare

UNKNOWN = "application/octet-stream"


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end
        p, first = end, False
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind in (0x00, 0x01, 0xD8, 0xD9) or 0xD0 <= kind <= 0xD7:
            return None
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2 or p + 2 + size > len(b):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return None
            if b[p + 1] == 0xD9:
                return p + 2 if frame else None
    return None


def _riff(b: bytes, at: int, form: bytes, needed: tuple[bytes, ...]) -> int | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return None
    end, p, have = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, set()
    if end > len(b):
        return None
    while p + 8 <= end:
        have.add(b[p : p + 4])
        p += 8 + (size := int.from_bytes(b[p + 4 : p + 8], "little")) + (size & 1)
    return end if p in (end, end + 1) and have.intersection(needed) else None


def _wav(b: bytes, at: int) -> int | None:
    return _riff(b, at, b"WAVE", (b"data",)) if b[at + 12 : at + 16] == b"fmt " else None


def _webp(b: bytes, at: int) -> int | None:
    return _riff(b, at, b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, _, start, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    pixels = (abs(width) * depth + 31) // 32 * 4 * abs(height)
    good = header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0
    return at + size if good and 14 + header <= start and start + pixels <= size <= len(b) - at else None


def _ogg(b: bytes, at: int, seen: dict | None = None) -> int | None:
    """Pages follow each other to the last one of the stream; pages that an earlier walk passed end where that one did."""
    seen = {} if seen is None else seen
    p, passed, end = at, [], None
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0" and (n := p + 27 + b[p + 26]) <= len(b):
        if ("ogg", p) in seen:
            end = seen["ogg", p]
            break
        passed.append(p)
        last, p = b[p + 5] & 4, n + sum(b[p + 27 : n])
        if p > len(b):
            break
        if last:
            end = p
            break
    seen.update((("ogg", x), end) for x in passed)
    return end


def _pdf(b: bytes, at: int, seen: dict | None = None) -> int | None:
    """From the header to the last end mark, with a reference table between them; both are looked for once."""
    seen = {} if seen is None else seen
    if "pdf" not in seen:
        end = b.rfind(b"%%EOF")
        seen["pdf"] = end, b.rfind(b"startxref", 0, max(end, 0))
    end, table = seen["pdf"]
    return end + 5 if at <= table < end and b[at + 5 : at + 6].isdigit() else None


def _gzip(b: bytes, at: int) -> int | None:
    stream, view = zlib.decompressobj(31), memoryview(b)
    try:
        for p in range(at, len(b), 1 << 16):
            feed = view[p : p + (1 << 16)]
            while feed and not stream.eof:
                stream.decompress(feed, 1 << 20)
                feed = stream.unconsumed_tail
            if stream.eof:
                return min(p + (1 << 16), len(b)) - len(stream.unused_data)
    except zlib.error:
        return None
    return None


#: (magic bytes, media type, validator: bytes and start -> end, or None where structure or lengths are wrong)
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"BM", "image/bmp", _bmp),
    (b"OggS", "audio/ogg", _ogg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
]


#: Validators that keep what they learn of a value.
MEMOISED = (_ogg, _pdf)


def automaton() -> ahocorasick.Automaton:
    """The signatures of all formats in one automaton; bytes are read as the first 256 code points."""
    found: dict[str, list[int]] = {}
    for i, (magic, _, _) in enumerate(FORMATS):
        found.setdefault(magic.decode("latin-1"), []).append(i)
    made = ahocorasick.Automaton()
    for magic, which in found.items():
        made.add_word(magic, (len(magic), which))
    made.make_automaton()
    return made


def sniff(value: bytes, signatures: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Media in ``value`` whose structure holds: (type, start, end), by start.

    That is what fills the whole value, and beside it the outermost media elsewhere: signatures inside a medium that has
    been confirmed, or overlapping its end, are passed over. What one validator has found out about the value the next
    call knows, so many signatures of one kind don't cost a pass each.
    """
    found: list[tuple[str, int, int]] = []
    seen: dict = {}
    free = 0
    for last, (size, which) in signatures.iter(value.decode("latin-1")):
        at = last + 1 - size
        if at < free:
            continue
        for i in which:
            _, kind, check = FORMATS[i]
            if (end := check(value, at, seen) if check in MEMOISED else check(value, at)) is not None:
                found.append((kind, at, end))
                if (at, end) != (0, len(value)):
                    free = end
                    break
    return found


def true_type(value: bytes, found: list[tuple[str, int, int]]) -> str:
    """The type of the medium that fills the value from its first byte to its last, else unknown."""
    return next((kind for kind, a, b in found if a == 0 and b == len(value)), UNKNOWN)


def outermost(found: list[tuple[str, int, int]], whole: int) -> list[tuple[str, int, int]]:
    """The media other than the whole value."""
    return [x for x in found if x[1:] != (0, whole)]


def sniff_media(df: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """Add detected, corrected and carved to a table with a binary column and the type it was declared to have.

    detected is the type of the medium that fills the value, found by its signature and confirmed by its structure and
    lengths; corrected tells whether it differs from the declared type; carved lists media at other places (type,
    start, end, data). Defined cases: null or empty content is of unknown type and carves nothing; a signature whose
    structure fails is no medium; media inside a carved one, or overlapping its end, are not carved beside it (its data
    can be sniffed again), so what is carved is no larger than the value; input columns of these names are replaced;
    repeated rows are sniffed alike; an empty table gives an empty result.
    """
    prepare(df.sparkSession)
    df = df.drop("detected", "corrected", "carved")
    names = df.columns
    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = automaton()
        for batch in batches:
            kinds, wrong, carved = [], [], []
            for value, said in zip(batch[content].to_pylist(), batch[declared].to_pylist()):
                value = value or b""
                found = sniff(value, signatures)
                kinds.append(kind := true_type(value, found))
                wrong.append(kind != said)
                inner = outermost(found, len(value))
                carved.append([{"type": k, "start": a, "end": b, "data": value[a:b]} for k, a, b in inner])
            columns = [*batch.columns, pa.array(kinds, pa.string()), pa.array(wrong), pa.array(carved, pa.list_(item))]
            yield pa.record_batch(columns, names=[*names, "detected", "corrected", "carved"])

    added = "detected string, corrected boolean, carved array<struct<type:string,start:bigint,end:bigint,data:binary>>"
    return df.mapInArrow(run, extended(df.schema, added))


#: The stored form of the query: a WAV file with 8-bit mono samples, and the unit that payloads are padded to.
RATE, UNIT = 8000, 192
#: What the query's files are declared to be, by their payload's checksum; most of it is wrong on purpose.
DECLARED = ("image/png", "audio/wav", UNKNOWN)


def to_wav(samples: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(value: bytes, start: int, end: int) -> bytes:
    """The samples of a validated WAV file, read by walking its chunks."""
    p = start + 12
    while p + 8 <= end:
        size = int.from_bytes(value[p + 4 : p + 8], "little")
        if value[p : p + 4] == b"data":
            return value[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    return b""


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signatures = automaton()
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for text in batch["text"]:
            raw = (text.as_py() or "").encode()
            padded = raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))
            stored = to_wav(padded)
            declared = DECLARED[zlib.crc32(padded) % len(DECLARED)]
            found = sniff(stored, signatures)
            kind = true_type(stored, found)
            back = wav_samples(stored, 0, len(stored)) if kind == "audio/wav" else b""
            carved = ",".join(f"{k}@{a}-{b}" for k, a, b in found if (a, b) != (0, len(stored)))
            total = int(np.frombuffer(back, np.uint8).sum(dtype=np.int64))
            rows["n_bytes"].append(len(raw))
            rows["payload_bytes"].append(len(back))
            rows["payload_sha256"].append(hashlib.sha256(back).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(back[-16:]))
            rows["media_bytes"].append(len(stored))
            rows["media_sha256"].append(hashlib.sha256(stored).hexdigest())
            rows["feature"].append(f"{kind};declared={declared};corrected={int(kind != declared)};rate={RATE};samples={len(back)};sum={total};carved={carved}")
        kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
        yield pa.record_batch({"doc_id": batch["doc_id"], **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()}})


def text_media(docs: DataFrame) -> DataFrame:
    """Store each whole text as a WAV file, sniff and read it back, and return digests and features.

    The text (null: empty) as UTF-8 gets spaces up to a positive multiple of 192 bytes; these are the 8-bit samples of
    the file. The file carries a declared type that is often wrong; its signature and chunk lengths tell the true one,
    and the samples are read back through them. The feature string has the corrected type, the samples' number and
    sum, and any media carved from inside. Equal texts give equal values; repeated rows are kept; a null doc_id stays
    null; other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_features, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
