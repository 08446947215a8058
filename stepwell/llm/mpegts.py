"""MPEG transport streams in a binary column.

A payload is cut into access units. Each becomes an elementary packet (PES) with a time stamp
and is spread over 188-byte transport packets of one elementary stream, described by a program
association table and a program map table. Reading parses the tables, checks their checksums
and the continuity counters, reassembles the elementary packets and lists time stamps and
random-access points.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, text_or_empty

#: Fixed values of the format.
PACKET, SYNC, BODY = 188, 0x47, 184
PAT_PID, PRIVATE_STREAM_1, PES_HEADER = 0x0000, 0xBD, 14
CLOCK = 90_000
#: Values that this writer chooses.
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
UNIT_BYTES, UNIT_TICKS, RANDOM_ACCESS_EVERY = 32_768, CLOCK // 25, 4


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])


def mux(payload: bytes, unit: int = UNIT_BYTES) -> bytes:
    """The transport stream of a payload; without a payload, the two tables alone."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), unit) or [-1]):
        key = k % RANDOM_ACCESS_EVERY == 0
        if key:
            out += [_table_packet(PAT_PID, PAT, tables), _table_packet(PMT_PID, PMT, tables)]
            tables += 1
        if at < 0:
            break
        chunk, pts = payload[at : at + unit], k * UNIT_TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (8 + len(chunk)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + chunk
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        fill = max(0, BODY - 8 - len(pes))
        first = bytes([7 + fill, 0x50 if key else 0x10]) + clock + b"\xff" * fill
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | counter & 15]) + first + pes[: BODY - 8])
        counter += 1
        rest = pes[BODY - 8 :]
        if full := len(rest) // BODY:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, :3] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * BODY).reshape(full, BODY)
            out.append(packets.tobytes())
            counter += full
        if tail := rest[full * BODY :]:
            space = BODY - 1 - len(tail)
            stuffing = bytes([space]) + (b"\x00" + b"\xff" * (space - 1) if space else b"")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | counter & 15]) + stuffing + tail)
            counter += 1
    return b"".join(out)


def _section_of(packets: np.ndarray, pids: np.ndarray, pid: int) -> tuple[bytes | None, int]:
    """The first section of a stream whose checksum is right, over as many packets as it takes, and the stream's continuity errors."""
    own = packets[(pids == pid) & (packets[:, 3] & 0x10 > 0)]
    found, part, lost, last = None, None, 0, None
    for packet in map(bytes, own):
        counter = packet[3] & 15
        if last is not None and counter == last[3] & 15 and packet == last:
            continue  # a packet may be sent twice
        if last is not None and counter != (last[3] + 1) & 15:
            lost, part = lost + 1, None
        last = packet
        if found is not None:
            continue  # the rest is read for its counters only
        body = packet[4 + (1 + packet[4] if packet[3] & 0x20 else 0) :]
        if packet[1] & 0x40:
            body, part = body[1 + body[0] :], b""
        if part is None:
            continue
        part += body
        size = 3 + ((part[1] & 15) << 8 | part[2]) if len(part) > 2 else len(part) + 1
        if len(part) >= size:
            if size > 6 and crc32_mpeg(part[: size - 4]) == int.from_bytes(part[size - 4 : size], "big"):
                found = part[:size]
            part = None
    return found, lost


def demux(media: bytes) -> dict:
    """payload, pts (list), random_access (unit numbers), packets, lost (continuity errors of all streams), program, stream_type.

    A stream whose tables are missing or damaged, or that isn't whole packets, raises ValueError.
    """
    if len(media) % PACKET or not media:
        raise ValueError("not whole transport packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet doesn't start with the sync byte")
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    pat, lost_pat = _section_of(packets, pid, PAT_PID)
    if pat is None:
        raise ValueError("no program association table")
    program, pmt_pid = int.from_bytes(pat[8:10], "big"), int.from_bytes(pat[10:12], "big") & 0x1FFF
    pmt, lost_pmt = _section_of(packets, pid, pmt_pid)
    if pmt is None:
        raise ValueError("no program map table")
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    stream_type, es_pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    es = packets[(pid == es_pid) & (packets[:, 3] & 0x10 > 0)]
    counters = es[:, 3] & 15
    again = np.r_[False, (counters[1:] == counters[:-1]) & (es[1:] == es[:-1]).all(1)] if len(es) else np.zeros(0, bool)
    es = es[~again]  # a packet may be sent twice
    counters = es[:, 3].astype(np.int64) & 15
    lost = lost_pat + lost_pmt + int(((np.diff(counters) - 1) % 16 != 0).sum())
    extra = es[:, 3] & 0x20 > 0
    start = np.where(extra, 5 + es[:, 4].astype(np.int64), 4)
    body = es[np.arange(PACKET) >= start[:, None]].tobytes()
    begins = np.flatnonzero(es[:, 1] & 0x40)
    offsets = np.cumsum(PACKET - start) - (PACKET - start)
    ends = [*offsets[begins[1:]], len(body)]
    access = extra & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    chunks, pts, points = [], [], []
    for k, (i, end) in enumerate(zip(begins, ends)):
        p = body[offsets[i] : end]
        size = int.from_bytes(p[4:6], "big")
        if p[:3] != b"\x00\x00\x01" or len(p) != 6 + size:
            raise ValueError("a damaged elementary packet")
        s = p[9:14]
        pts.append((s[0] & 14) << 29 | s[1] << 22 | (s[2] & 254) << 14 | s[3] << 7 | s[4] >> 1)
        if access[i]:
            points.append(k)
        chunks.append(p[9 + p[8] :])
    return {"payload": b"".join(chunks), "pts": pts, "random_access": points, "packets": len(packets), "lost": lost, "program": program, "stream_type": stream_type}


def text_payload(text: str) -> bytes:
    """UTF-8 bytes, then zeros up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A media column: key, n_bytes (of the text in UTF-8; null: 0), media (the transport stream).

    Repeated rows are stored as often as they occur; an empty table gives an empty one; other
    columns are left out.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array((mux(text_payload(t)) for t in texts), pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text_or_empty(text)), run, f"`{key}` {kind}, n_bytes long, media binary")


def read(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a media column holds, read back: digests, time stamps, random-access points, feature, status.

    The feature names the packets, units, random-access points, last time stamp, continuity
    errors, and mean and spread of the payload's bytes. ``status`` is ``ok``; or ``no media`` for
    a null, or what is wrong with a stream that can't be read, and then what comes of the
    payload is null. Repeated rows are read as often as they occur; an empty table gives an
    empty one.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                try:
                    m, status = (demux(media), "ok") if media is not None else (None, "no media")
                except (ValueError, IndexError) as e:
                    m, status = None, str(e) if isinstance(e, ValueError) else "a damaged packet"
                if m is None:
                    size, sha = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
                    rows.append((None, None, None, size, sha, None, None, None, status))
                    continue
                p = m["payload"]
                counts = np.bincount(np.frombuffer(p, np.uint8), minlength=256)
                values = np.arange(256)
                mean = (counts * values).sum() / max(1, len(p))
                spread = ((counts * (values - mean) ** 2).sum() / max(1, len(p))) ** 0.5
                feature = f"packets={m['packets']};units={len(m['pts'])};access={len(m['random_access'])};end={max(m['pts'], default=0)};lost={m['lost']};mean={mean:.4f};spread={spread:.4f}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, m["pts"], m["random_access"], status))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[key, "n_bytes", *NAMES])

    kind = stored.schema[key].dataType.simpleString()
    return map_batches(
        stored.select(key, "n_bytes", "media"),
        run,
        f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<int>, status string",
    )


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", "status"]
