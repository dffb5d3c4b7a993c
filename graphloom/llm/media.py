"""Media columns: payloads as AVI motion-JPEG with lossless intra frames, and shots in them.

A payload fills frames of 64 samples a row, at most 64 rows; each frame is a lossless JPEG image
(predictive coding, 8 bits). Reading parses the RIFF index, decodes all frames of a batch side by
side, and cuts the clip where the difference of neighbouring histograms stands out from those
before it.

Defined results: a null or empty text is a payload of 64 zero bytes; texts of any length are
stored whole; equal texts give equal files and features; repeated rows give repeated results; a
null ``doc_id`` stays null; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, prepare, table, texts

WIDTH = 64
ROWS = 64
FRAME_MS = 40
#: Samples that are coded together, to bound memory.
GROUP = 2 << 20
#: Bits of the Huffman code of each difference category 0 to 8, for the code table of every frame.
CODE_BITS = (5, 4, 3, 3, 2, 4, 4, 2, 6)
BINS = 16
#: A cut needs a difference of at least CUT_FLOOR and CUT_SIGMAS deviations above the mean of the last CUT_WINDOW.
CUT_FLOOR, CUT_SIGMAS, CUT_WINDOW = 0.2, 3.0, 8


def _codes() -> dict[int, tuple[int, int]]:
    """Canonical code and bits of each category: shorter first, then by category."""
    out, code, bits = {}, 0, 0
    for n, category in sorted((n, c) for c, n in enumerate(CODE_BITS)):
        code, bits = code << (n - bits), n
        out[category] = (code, n)
        code += 1
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits and their number by difference + 255; difference and number by the next 14 bits."""
    word, count = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    diff, used = np.zeros(1 << 14, np.int16), np.ones(1 << 14, np.int64)
    codes = _codes()
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, bits = codes[category]
        low = (d if d >= 0 else d + (1 << category) - 1) if category else 0
        n = bits + category
        word[d + 255], count[d + 255] = code << category | low, n
        first = int(word[d + 255]) << (14 - n)
        diff[first : first + (1 << (14 - n))], used[first : first + (1 << (14 - n))] = d, n
    return word, count, diff, used


_WORD, _COUNT, _DIFF, _USED = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman_table() -> bytes:
    order = [c for _, c in sorted((n, c) for c, n in enumerate(CODE_BITS))]
    return _segment(0xC4, bytes([0, *(CODE_BITS.count(n) for n in range(1, 17)), *order]))


_TABLE = _huffman_table()
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))


def _header(rows: int) -> bytes:
    """Start of image, lossless frame of ``rows``, code table, scan with the left neighbour as prediction."""
    return b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB", 8, rows, WIDTH, 1) + bytes([1, 0x11, 0])) + _TABLE + _SCAN


def encode_scans(samples: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Entropy-coded scans of frames that lie one after the other in ``samples``; frame i has ``rows[i]`` rows."""
    lines = samples.reshape(-1, WIDTH).astype(np.int16)
    first = np.concatenate([[0], np.cumsum(rows)[:-1]])
    diff = np.empty_like(lines)
    diff[:, 1:] = lines[:, 1:] - lines[:, :-1]
    diff[1:, 0] = lines[1:, 0] - lines[:-1, 0]
    diff[first, 0] = lines[first, 0] - 128
    at = diff.ravel() + 255
    count = _COUNT[at]
    ends = np.cumsum(count)
    frame_ends = ends[(first + rows) * WIDTH - 1]
    frame_bits = np.diff(frame_ends, prepend=0)
    frame_bytes = (frame_bits + 7) >> 3
    start = np.concatenate([[0], np.cumsum(frame_bytes)[:-1]])
    # a frame starts at a byte: shift its symbols by what the frames before are padded with
    place = ends - count + np.repeat(8 * start - (frame_ends - frame_bits), rows * WIDTH)
    byte, size = place >> 3, int(frame_bytes.sum())
    window = _WORD[at].astype(np.int64) << (24 - (place & 7) - count)
    out = np.zeros(size + 2, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        out[k:] += np.bincount(byte, weights=(window >> shift) & 255, minlength=size + 2 - k)[: size + 2 - k].astype(np.int64)
    out[start + frame_bytes - 1] += (1 << (8 * frame_bytes - frame_bits)) - 1
    coded = out[:size].astype(np.uint8)
    ones = np.flatnonzero(coded == 255)
    stuffed = np.insert(coded, ones + 1, 0).tobytes()
    cut = start + np.searchsorted(ones, start)
    return [stuffed[a:b] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(stuffed)])]


def decode_scans(scans: list[bytes], rows: np.ndarray) -> np.ndarray:
    """Samples of all frames one after the other; frames are decoded in step, a sample of each at a time."""
    joined = np.frombuffer(b"".join(scans) + bytes(4), np.uint8)
    lengths = np.array([len(s) for s in scans], np.int64)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    stuffing = np.flatnonzero((joined[1:] == 0) & (joined[:-1] == 255)) + 1
    plain = np.delete(joined, stuffing).astype(np.uint32)
    start -= np.searchsorted(stuffing, start)
    window = np.zeros(len(plain) + 2, np.uint32)
    window[: len(plain)] = plain << 16
    window[: len(plain) - 1] |= plain[1:] << 8
    window[: len(plain) - 2] |= plain[2:]
    order = np.argsort(-rows, kind="stable")
    sizes = rows[order] * WIDTH
    place = 8 * start[order]
    diff = np.zeros((int(sizes[0]), len(scans)), np.int16)
    active = len(scans)
    for step in range(int(sizes[0])):
        while sizes[active - 1] <= step:
            active -= 1
        now = place[:active]
        bits = (window[now >> 3] >> (10 - (now & 7)).astype(np.uint32)) & 0x3FFF
        diff[step, :active] = _DIFF[bits]
        now += _USED[bits]
    lines = diff.T.reshape(len(scans), -1, WIDTH)
    lines[:, :, 0] = np.cumsum(lines[:, :, 0], axis=1, dtype=np.int16) + 128
    np.cumsum(lines, axis=2, dtype=np.int16, out=lines)
    back = np.empty(len(scans), np.int64)
    back[order] = np.arange(len(scans))
    valid = np.arange(lines.shape[1]) < rows[:, None]
    return lines[back][valid].astype(np.uint8).ravel()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)


def avi(images: list[bytes], rows: int, payload_bytes: int) -> bytes:
    """AVI file of JPEG images with an index; the payload's length stands in its comment."""
    most = max(map(len, images))
    main = struct.pack("<14I", FRAME_MS * 1000, most * 1000 // FRAME_MS, 0, 0x10, len(images), 0, 1, most, WIDTH, rows, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, rows)
    picture = struct.pack("<IiiHHIIiiII", 40, WIDTH, rows, 1, 8, int.from_bytes(b"MJPG", "little"), WIDTH * rows, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    note = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % payload_bytes))
    chunks, index, at = [b"movi"], [], 4
    for image in images:
        chunks.append(_chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(chunks[-1])
    body = b"AVI " + head + note + _chunk(b"LIST", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(data: bytes) -> tuple[list[bytes], int]:
    """JPEG images by the file's index, and the payload's length."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, entries, length = 12, None, (), None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"INFO":
            note = data[at + 20 : at + 20 + int.from_bytes(data[at + 16 : at + 20], "little")]
            length = int(note.rstrip(b"\0").rpartition(b"=")[2])
        elif name == b"idx1":
            entries = struct.iter_unpack("<4sIII", data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    if movi is None or length is None:
        raise ValueError("AVI file without frames or length")
    return [data[movi + off + 8 : movi + off + 8 + size] for name, _, off, size in entries if name == b"00dc"], length


def parse_image(image: bytes) -> tuple[int, bytes]:
    """Rows and scan of a lossless JPEG image as written here."""
    at, rows = 2, 0
    while True:
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        if marker == 0xC3:
            rows = int.from_bytes(image[at + 5 : at + 7], "big")
        at += 2 + size
        if marker == 0xDA:
            return rows, image[at:-2]


def encode_media(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads whose lengths are positive multiples of 64."""
    files: list[bytes] = []
    group: list[bytes] = []
    for payload in [*payloads, None]:
        if group and (payload is None or sum(map(len, group)) + len(payload) > GROUP):
            files += _encode_group(group)
            group = []
        if payload is not None:
            group.append(payload)
    return files


def _encode_group(payloads: list[bytes]) -> list[bytes]:
    frame_rows, counts, padded = [], [], []
    for payload in payloads:
        rows = len(payload) // WIDTH
        n = -(-rows // ROWS)
        height = ROWS if n > 1 else rows
        frame_rows += [height] * n
        counts.append(n)
        padded += [payload, bytes(n * height * WIDTH - len(payload))]
    scans = encode_scans(np.frombuffer(b"".join(padded), np.uint8), np.array(frame_rows, np.int64))
    files, at = [], 0
    for payload, n in zip(payloads, counts):
        head = _header(frame_rows[at])
        files.append(avi([head + scan + b"\xff\xd9" for scan in scans[at : at + n]], frame_rows[at], len(payload)))
        at += n
    return files


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame + 1 of each shot, from a row of bin shares for each frame."""
    changes = 0.5 * np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    cuts = [0]
    for t, change in enumerate(changes.tolist(), 1):
        past = changes[max(cuts[-1], t - 1 - CUT_WINDOW) : t - 1]
        level = past.mean() + CUT_SIGMAS * past.std() if len(past) else 0.0
        if change > max(CUT_FLOOR, level):
            cuts.append(t)
    return list(zip(cuts, [*cuts[1:], len(histograms)]))


def decode_media(files: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]], int]]:
    """Of each file in turn: payload, clips (start ms, end ms, frames, mean sample), number of frames."""
    group: list[tuple[list[tuple[int, bytes]], int]] = []
    size = 0
    for data in [*files, None]:
        if data is not None:
            images, length = parse_avi(data)
            parsed = [parse_image(image) for image in images]
        if group and (data is None or size + sum(r for r, _ in parsed) * WIDTH > GROUP):
            yield from _decode_group(group)
            group, size = [], 0
        if data is not None:
            group.append((parsed, length))
            size += sum(r for r, _ in parsed) * WIDTH


def _decode_group(group: list[tuple[list[tuple[int, bytes]], int]]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]], int]]:
    rows = np.array([r for parsed, _ in group for r, _ in parsed], np.int64)
    samples = decode_scans([scan for parsed, _ in group for _, scan in parsed], rows)
    frame = np.repeat(np.arange(len(rows)), rows * WIDTH)
    bins = np.bincount(frame * BINS + (samples >> 4), minlength=len(rows) * BINS).reshape(-1, BINS) / (rows * WIDTH)[:, None]
    sums = np.add.reduceat(samples.astype(np.int64), np.concatenate([[0], np.cumsum(rows * WIDTH)[:-1]]))
    at, byte = 0, 0
    for parsed, length in group:
        n, height = len(parsed), parsed[0][0]
        clips = [(a * FRAME_MS, b * FRAME_MS, b - a, int(sums[at + a : at + b].sum() // ((b - a) * height * WIDTH))) for a, b in shots(bins[at : at + n])]
        yield samples[byte : byte + length].tobytes(), clips, n
        at += n
        byte += n * height * WIDTH


def payload(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and those filled up to a positive multiple of 64."""
    data = text.encode()
    return len(data), data + bytes(-len(data) % 64 if data else 64)


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column."""
    prepare(docs.sparkSession)

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            made = [payload(x) for x in texts(batch.column(1))]
            media = pa.array(encode_media([p for _, p in made]), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select(doc_id, text).mapInArrow(encode, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, media binary")


def clips(stored: DataFrame) -> DataFrame:
    """Timed clip rows of the media column: doc_id, clip, start_ms, end_ms, frames, mean_sample."""
    prepare(stored.sparkSession)

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [(i, k, *c) for i, (_, cs, _) in enumerate(decode_media(batch.column(1).to_pylist())) for k, c in enumerate(cs)]
            columns = [pa.array(x, t) for x, t in zip(zip(*found), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], ["doc_id", "clip", "start_ms", "end_ms", "frames", "mean_sample"])

    return stored.select("doc_id", "media").mapInArrow(decode, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, clip int, start_ms long, end_ms long, frames int, mean_sample int")


def digests(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold: lengths, hashes of the payload read back, and its clips as a string."""
    prepare(stored.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            files = batch.column(2).to_pylist()
            out = []
            for data, (read, found, frames) in zip(files, decode_media(files)):
                feature = f"frames={frames};clips=" + ",".join(f"{a}-{b}:{mean}" for a, b, _, mean in found)
                out.append((len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(table(spark, sf_dir, "documents")))
