from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import media
from graphloom.llm.token_counts import SpanEncoder, attribute, field_counts, line_starts, section_counts

from .helpers import empty, frame, rows

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@given(st.lists(st.binary(max_size=9_000), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(contents):
    payloads = [c + bytes(-len(c) % 64 if c else 64) for c in contents]
    files = media.encode_media(payloads)
    assert [read for read, _, _ in media.decode_media(files)] == payloads
    assert all(f[:4] == b"RIFF" and int.from_bytes(f[4:8], "little") + 8 == len(f) and b"idx1" in f for f in files)
    assert files == media.encode_media(payloads)


def read_lossless_jpeg(data):
    """Samples of a lossless JPEG image of one component, bit by bit as the standard has it."""
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    at, codes, rows, width = 2, {}, 0, 0
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            assert body[0] == 8 and body[5] == 1
            rows, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xC4:
            code, symbols = 0, iter(body[17:])
            for bits, count in enumerate(body[1:17], 1):
                for _ in range(count):
                    codes[bits, code] = next(symbols)
                    code += 1
                code <<= 1
        elif marker == 0xDA:
            assert body[3] == 1  # predicted from the left neighbour
            break
    stream = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    place, out = 0, []
    for y in range(rows):
        for x in range(width):
            bits, code = 0, 0
            while (bits, code) not in codes:
                code, bits, place = code << 1 | int(stream[place]), bits + 1, place + 1
            category = codes[bits, code]
            extra = int(stream[place : place + category], 2) if category else 0
            place += category
            difference = extra if not category or extra >> (category - 1) else extra - (1 << category) + 1
            before = out[-1] if x else out[-width] if y else 128
            out.append((before + difference) & 0xFF)
    assert set(stream[place:]) <= {"1"} and len(stream) - place < 8
    return bytes(out)


def test_frames_are_lossless_jpeg_images_in_an_avi_file():
    rng = np.random.default_rng(2)
    payload = bytes(rng.integers(0, 256, 4096 + 64 * 3, np.uint8)) + bytes(64) + b"\xff" * 64
    data = media.encode_media([payload])[0]
    at, found = 12, []
    while at < len(data):  # plain walk over the chunks, without the index
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            at += 12
            continue
        if name == b"00dc":
            found.append(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    assert b"".join(map(read_lossless_jpeg, found))[: len(payload)] == payload


def test_shots_stand_out():
    still, other = np.eye(16)[[3] * 6], np.eye(16)[[9] * 4]
    assert media.shots(np.concatenate([still, other])) == [(0, 6), (6, 10)]
    assert media.shots(still) == [(0, 6)] and media.shots(still[:1]) == [(0, 1)]


def test_media_digests(spark):
    data = rows()
    got = {}
    for r in media.digests(media.store(frame(spark))).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for r in data:
        raw = (r[1] or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        mine = [g for g in got[r[0]] if g[0] == len(raw) and g[2] == hashlib.sha256(full).hexdigest()]
        assert mine and mine[0][1] == len(full) and mine[0][3] == zlib.crc32(full[-64:]) and mine[0][4] > 0
    assert len(set(map(str, got[300]))) == 1 and len(got[300]) == 3
    clips = media.clips(media.store(frame(spark))).where("doc_id = 203").orderBy("clip").collect()
    assert clips[0]["start_ms"] == 0 and all(a["end_ms"] == b["start_ms"] for a, b in zip(clips, clips[1:]))
    assert media.digests(media.store(empty(spark))).count() == 0 and media.clips(media.store(empty(spark))).count() == 0


@pytest.fixture(scope="module")
def whole():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_spans_are_those_of_the_full_tokenizer(whole):
    encoder = SpanEncoder(RANKS, PATTERN)
    for text in ["", "a b", "naïve café\n日本語 text <|endoftext|>", "🙂🙂 x", "  lead\n\n\ntrail  "]:
        ids, first, last = encoder.spans(text)
        found = whole.encode(text, add_special_tokens=False)
        assert ids.tolist() == found.ids and list(zip(first.tolist(), last.tolist())) == found.offsets


def test_boundary_rules():
    first, last, starts = np.array([0, 3, 8]), np.array([3, 8, 10]), np.array([0, 5, 9])
    assert attribute(first, last, starts).tolist() == [0, 1, 1]
    assert attribute(first, last, starts, "first").tolist() == [0, 0, 1]
    assert attribute(first, last, starts, "last").tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        attribute(first, last, starts, "none")


@given(st.text(alphabet="ab é\n", max_size=30))
@settings(max_examples=100, deadline=None)
def test_line_starts_tile_the_text(text):
    starts = line_starts(text).tolist()
    assert [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] == (text.splitlines(True) if "\n" in text or text else [""])


def test_tokens_of_each_section_against_brute_force(spark, whole):
    data = [r for r in rows() if len(r[1] or "") < 5_000]
    got = sorted((str(r["doc_id"]), r["section"], r["first_char"], r["end_char"], r["n_tokens"], r["n_crossing"]) for r in section_counts(frame(spark, data), RANKS, PATTERN).collect())
    want = []
    for r in data:
        text = r[1] or ""
        spans, a = [], 0
        for line in text.splitlines(True) if "\n" in text and not set("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") & set(text) else [text]:
            spans.append((a, a + len(line)))
            a += len(line)
        tokens = [0] * len(spans)
        crossing = [0] * len(spans)
        for first, last in whole.encode(text, add_special_tokens=False).offsets:
            shares = [max(0, min(last, e) - max(first, b)) for b, e in spans]
            k = shares.index(max(shares))
            tokens[k] += 1
            crossing[k] += sum(x > 0 for x in shares) > 1
        want += [(str(r[0]), k, b, e, t, c) for k, ((b, e), t, c) in enumerate(zip(spans, tokens, crossing))]
    assert got == sorted(want)


def test_section_counts(spark, whole):
    for rule in ("majority", "first"):
        got = section_counts(frame(spark), RANKS, PATTERN, rule=rule).collect()
        by = {}
        for r in got:
            by[r["doc_id"]] = by.get(r["doc_id"], 0) + r["n_tokens"]
        for r in rows():
            if r[0] not in (None, 7, 300):
                assert by[r[0]] == len(whole.encode(r[1] or "", add_special_tokens=False).ids)
    cut = section_counts(frame(spark).where("doc_id = 3"), RANKS, PATTERN, sections=lambda t: np.arange(0, max(len(t), 1), 3)).collect()
    assert sum(r["n_crossing"] for r in cut) > 0
    assert section_counts(empty(spark), RANKS, PATTERN).count() == 0


def test_field_counts(spark):
    found = field_counts(frame(spark), ["lang", "source", "text"], RANKS, PATTERN, "doc_id").where("key = 3").collect()
    assert {r["field"] for r in found} == {"lang", "source", "text"} and all(r["n_tokens"] > 0 for r in found)
