"""MPEG audio streams as bytes: writing payloads as Layer I sample data, and parsing any stream of frames.

A payload of 192-byte units is kept as 8-bit samples: each frame is Layer I, mono, 32 kHz, 160 kbit/s, with 16 of the
32 subbands allocated 8 bits, so 12 samples of 16 subbands are 192 bytes. Frames carry the CRC-16 of the standard.
An ID3v2.3 tag in front holds the unpadded length; the first frame is silent and holds the variable-bitrate table.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

UNIT = 192

# Fixed values of ISO/IEC 11172-3 and 13818-3: bitrates in kbit/s by (version 1 or 2, layer), sampling rates in Hz by version.
_BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

#: Version 1, Layer I, protected; 160 kbit/s, 32 kHz, no padding; mono.
_HEADER = bytes([0xFF, 0xFE, 0x58, 0xC0])
_FRAME = 240
_ALLOCATION = bytes([0x77] * 8 + [0] * 8)  # code 7 is 8 bits a sample
_SCALE = bytes(12)
_DATA_AT = 4 + 2 + 16 + 12
#: Offset of the table in the first frame, and entries of its seek table.
_TABLE_AT, _SEEK = 23, 100  # after the checksum and 17 bytes, as where a Layer III frame has its side information


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of audio frames: polynomial 0x8005, start value 0xFFFF, most significant bit first."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFF00) ^ _CRC[value >> 8 ^ byte]
    return value


def _head(allocation: bytes) -> bytes:
    return _HEADER + struct.pack(">H", crc16(_HEADER[2:] + allocation)) + allocation


_SILENT = _head(bytes(16))
_LOUD = np.frombuffer(_head(_ALLOCATION) + _SCALE, np.uint8)


def _size7(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def _from7(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def write(data: bytes) -> bytes:
    """The stream that holds the bytes, padded to whole units."""
    payload = pad(data)
    n = len(payload) // UNIT
    text = b"\0payload_bytes\0" + str(len(data)).encode()
    tag_frame = b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    tag = b"ID3\3\0\0" + _size7(len(tag_frame)) + tag_frame
    size = _FRAME * (n + 1)
    seek = bytes(min(255, 256 * (_FRAME * round((n + 1) * k / _SEEK)) // size) for k in range(_SEEK))
    table = b"Info" + struct.pack(">III", 7, n, size) + seek
    first = bytearray(_FRAME)
    first[: len(_SILENT)] = _SILENT
    first[_TABLE_AT : _TABLE_AT + len(table)] = table
    frames = np.zeros((n, _FRAME), np.uint8)
    frames[:, :_DATA_AT] = _LOUD
    frames[:, _DATA_AT : _DATA_AT + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + bytes(first) + frames.tobytes()


def header(word: bytes) -> dict | None:
    """What four header bytes say; None if they start no frame of known length."""
    if len(word) < 4 or word[0] != 0xFF or word[1] < 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word[1] >> 3 & 3)
    layer = 4 - (word[1] >> 1 & 3)
    rate_at, bits_at = word[2] >> 2 & 3, word[2] >> 4
    if version is None or layer == 4 or rate_at == 3 or bits_at in (0, 15) or word[3] & 3 == 2:
        return None
    kbit, rate, padding = _BITRATES[1 if version == 1 else 2, layer][bits_at], _RATES[version][rate_at], word[2] >> 1 & 1
    if layer == 1:
        samples, size = 384, (12000 * kbit // rate + padding) * 4
    else:
        samples = 1152 if layer == 2 or version == 1 else 576
        size = samples // 8 * kbit * 1000 // rate + padding
    return {"version": version, "layer": layer, "kbit": kbit, "rate": rate, "size": size, "samples": samples, "mono": word[3] >> 6 == 3, "mode": word[3] >> 6, "extension": word[3] >> 4 & 3, "protected": not word[1] & 1}


#: Fixed values of the standards' allocation tables for Layer II: bits of the allocation of each subband.
_WIDTHS = {"long": (*[4] * 11, *[3] * 12, *[2] * 7), "short": (*[4] * 2, *[3] * 10), "low": (*[4] * 4, *[3] * 7, *[2] * 19)}


def _layer2_widths(h: dict) -> tuple[int, ...]:
    """Bits of the allocation of the subbands in use."""
    if h["version"] != 1:
        return _WIDTHS["low"]
    each = h["kbit"] // (1 if h["mono"] else 2)
    if each <= 48:
        return _WIDTHS["short"][: 12 if h["rate"] == 32000 else 8]
    return _WIDTHS["long"][: 27 if h["rate"] == 48000 or each <= 80 else 30]


def _checked_bits(h: dict, body: bytes) -> int:
    """How many bits after the checksum it covers, the header's last 16 aside; ``body``: the frame's bytes after the checksum."""
    channels = 1 if h["mono"] else 2
    bound = (h["extension"] + 1) * 4 if h["mode"] == 1 else 32
    if h["layer"] == 1:
        return 128 if h["mono"] else bound * 8 + (32 - bound) * 4
    if h["layer"] == 3:
        return 8 * ((17 if h["mono"] else 32) if h["version"] == 1 else (9 if h["mono"] else 17))
    bits, at, used = int.from_bytes(body[:64].ljust(64, b"\0")), 0, 0
    for band, width in enumerate(_layer2_widths(h)):  # the allocation, then two bits for each channel of a subband in use
        shared = band >= bound
        for _ in range(1 if shared else channels):
            used += (channels if shared else 1) * (bits >> (512 - at - width) & (1 << width) - 1 > 0)
            at += width
    return at + 2 * used


def frame_crc(word: bytes, body: bytes, bits: int) -> int:
    """The checksum of a frame with header ``word``: its last 16 bits and the first so many of ``body``."""
    value = crc16(word[2:] + body[: bits // 8])
    for i in range(bits % 8):
        one = (body[bits // 8] >> 7 - i & 1) ^ value >> 15
        value = (value << 1 & 0xFFFF) ^ (0x8005 if one else 0)
    return value


def _tags(data: bytes) -> tuple[int, int, dict]:
    """Where audio starts and ends, and the text frames of an ID3v2 tag (and the title of an ID3v1 tag)."""
    start, end, found = 0, len(data), {}
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        found["TIT1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        major, flags, size = data[start + 3], data[start + 5], _from7(data[start + 6 : start + 10])
        at, stop = start + 10, min(end, start + 10 + size)
        while major in (3, 4) and at + 10 <= stop and data[at]:
            n = _from7(data[at + 4 : at + 8]) if major == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
            if data[at : at + 1] == b"T" and data[at + 10 : at + 11] in (b"\0", b"\3"):
                name, body = data[at : at + 4].decode("latin-1"), data[at + 11 : at + 10 + n].decode("utf-8" if data[at + 10] else "latin-1", "replace")
                key, _, value = body.partition("\0")
                found[f"{name}:{key}" if name == "TXXX" else name] = value if name == "TXXX" else body.rstrip("\0")
            at += 10 + n
        start = stop + (10 if flags & 16 else 0)
    return start, end, found


def _table(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing, Info or VBRI table of a first frame."""
    side = (21 if h["mono"] else 36) if h["version"] == 1 else (13 if h["mono"] else 21)
    for extra in (0, 2):  # some writers count the checksum
        p = at + side + extra
        if data[p : p + 4] in (b"Xing", b"Info"):
            flags, p, out = struct.unpack(">I", data[p + 4 : p + 8])[0], p + 8, {"kind": data[p : p + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = struct.unpack(">I", data[p : p + 4])[0], p + 4
            if flags & 4:
                out["seek"] = list(data[p : p + 100])
            return out
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        size, frames = struct.unpack(">II", data[p + 10 : p + 18])
        return {"kind": "VBRI", "bytes": size, "frames": frames}
    return None


def _follows(h: dict, word: bytes) -> bool:
    """Whether a header of the same stream comes next."""
    other = header(word)
    return other is not None and all(other[x] == h[x] for x in ("version", "layer", "rate"))


def _fits(table: dict, begin: int, offsets: list[int], end: int) -> bool:
    """Whether a table agrees with the frames that were found: their number, the bytes, and for each hundredth of the frames
    (after the table's own) a seek point no farther off than its rounding and one frame."""
    if table.get("frames", len(offsets)) != len(offsets) or table.get("bytes", end - begin) != end - begin:
        return False
    starts, size = [begin, *offsets], end - begin
    far = size / 256 + max((b - a for a, b in zip(starts, [*offsets, end])), default=0) + 1
    return all(abs(x * size / 256 - (starts[min(len(starts) - 1, round(len(starts) * k / _SEEK))] - begin)) <= far for k, x in enumerate(table.get("seek", [])) if x < 255)


def parse(data: bytes) -> dict:
    """Tags, table, frames and checksums of a stream. A frame counts if one of its kind, or the end, follows it; bytes that
    belong to no frame are skipped up to the next such header; a frame whose checksum holds needs nothing after it. The
    frame of a table holds no audio."""
    start, end, tags = _tags(data)
    at, offsets, table, kept, lost, bad, checked, samples = start, [], None, {}, 0, 0, 0, 0
    last, first, begin = None, True, 0
    while at + 4 <= end:
        word = data[at : at + 4]
        h = kept.get(word, 0)
        if h == 0:
            h = kept[word] = header(word)
        whole = h is not None and at + h["size"] <= end
        holds = None
        if whole and h["protected"] and h["size"] >= 70:
            n = _checked_bits(h, data[at + 6 : at + 70])
            seen = (word, n, data[at + 6 : at + 6 + -(-n // 8)])
            value = kept.get(seen)
            if value is None:
                value = kept[seen] = frame_crc(word, seen[2], n)
            holds = value == data[at + 4] << 8 | data[at + 5]
        then = at + h["size"] if whole else 0
        if not whole or not (holds or then == end or _follows(h, data[then : then + 4])):
            after = data.find(b"\xff", at + 1, end)
            lost += (after if after >= 0 else end) - at
            at = after if after >= 0 else end
            continue
        checked += holds is not None
        bad += holds is False
        if first and (table := _table(data, at, h)):
            begin = at
        else:
            offsets.append(at)
            samples += h["samples"]
        first, last = False, h
        at += h["size"]
    lost += end - at if at < end else 0
    if table:
        table["fits"] = _fits(table, begin, offsets, end)
    return {"tags": tags, "table": table, "offsets": offsets, "skipped": lost, "checked": checked, "bad": bad, "samples": samples, "rate": last["rate"] if last else None, "layer": last["layer"] if last else None, "version": last["version"] if last else None}


def payload(data: bytes, parsed: dict) -> bytes:
    """The units in the frames that write() made."""
    at = parsed["offsets"]
    if not at:
        return b""
    if at[-1] - at[0] == _FRAME * (len(at) - 1):
        return np.frombuffer(data, np.uint8, _FRAME * len(at), at[0]).reshape(-1, _FRAME)[:, _DATA_AT : _DATA_AT + UNIT].tobytes()
    return b"".join(data[p + _DATA_AT : p + _DATA_AT + UNIT] for p in at)


def tail_crc(data: bytes) -> int:
    return zlib.crc32(data[-16:])
