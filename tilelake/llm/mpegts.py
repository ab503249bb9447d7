"""Byte payloads as MPEG transport streams (ISO/IEC 13818-1), written and read back.

A stream is a program association table, a program map table and then the packetised elementary stream, all in
packets of 188 bytes; the tables are repeated every TABLES_EVERY elementary packets.  The payload counts as 8-bit samples at
8 kHz: each elementary packet carries a presentation time stamp at 90 kHz, and its first transport packet a clock reference.
Every eighth elementary packet is a random access point.

The reader finds the stream through the two tables (put together from as many packets as they take, their CRC checked), checks
the continuity counters of every PID (repeated packets, announced discontinuities and null packets are no errors), reassembles
the elementary packets, also those of no stated length, and lists time stamps and random access points.

Null text is the empty text; an empty text has a payload of 64 zero bytes.  Equal texts give equal streams, repeated rows each
their own; there are no ties to break.  A null id stays null.  store() reads doc_id and text only, so other columns' names do not
matter.  An empty table gives no rows.  A task holds about 4 MB of texts and their streams, or one longer text and its.
"""

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, BODY = 188, 184
PMT_PID, ES_PID, STREAM_ID, STREAM_TYPE = 0x1000, 0x0100, 0xBD, 0x06
PES_PACKETS = 16
PES_PAYLOAD = BODY * PES_PACKETS - 8 - 14  # the first packet has 8 bytes of adaptation field, a PES header has 14
RAP_EVERY = 8
TABLES_EVERY = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def table_packets(pid: int, section: bytes, counter: int = 0) -> list[bytes]:
    """A section in as many packets as it takes, from a continuity counter on."""
    data, out = b"\0" + section, []
    for k, at in enumerate(range(0, len(data), BODY)):
        head = struct.pack(">BHB", 0x47, (0x4000 if k == 0 else 0) | pid, 0x10 | counter + k & 0xF)
        out.append((head + data[at:at + BODY]).ljust(PACKET, b"\xff"))
    return out


def tables(counter: int = 0) -> bytes:
    """The two tables of a stream, each in one packet."""
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))
    return b"".join(table_packets(0, pat, counter) + table_packets(PMT_PID, pmt, counter))


_TABLES = [tables(k) for k in range(16)]


def _stamp(t: int) -> bytes:
    return bytes((0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFF | 1, t >> 7 & 0xFF, t << 1 & 0xFF | 1))


def write_stream(payload: bytes) -> bytes:
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), PES_PAYLOAD)):
        if k % TABLES_EVERY == 0:
            out.append(_TABLES[k // TABLES_EVERY % 16])
        body = payload[at:at + PES_PAYLOAD]
        t = at * 45 // 4 & 0x1FFFFFFFF
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(body) + 8, 0x84, 0x80, 5) + _stamp(t) + body
        flags = 0x50 if k % RAP_EVERY == 0 else 0x10
        field = bytes((7, flags)) + struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)
        i, unit = 0, 0x4000
        while i < len(pes):
            room = BODY - len(field)
            part = pes[i:i + room]
            if len(part) < room:  # stuffing goes into the adaptation field
                gap = room - len(part)
                if not field:
                    field = b"\0" if gap == 1 else bytes((gap - 1, 0)) + b"\xff" * (gap - 2)
                else:
                    field = bytes((field[0] + gap,)) + field[1:] + b"\xff" * gap
            out.append(struct.pack(">BHB", 0x47, unit | ES_PID, (0x30 if field else 0x10) | counter))
            out.append(field)
            out.append(part)
            i, unit, field, counter = i + len(part), 0, b"", counter + 1 & 15
    return b"".join(out)


class _Sections:
    """Sections of one PID, put together from the packets that carry them."""

    def __init__(self):
        self.held: bytes | None = None

    def add(self, body: bytes, unit: bool) -> list[bytes]:
        """Sections that this packet completes, their CRC checked."""
        done = []
        if unit:
            at = 1 + body[0]
            if self.held is not None:
                done += self._take(body[1:at])
            self.held = b""
            body = body[at:]
        return done + (self._take(body) if self.held is not None else [])

    def _take(self, part: bytes) -> list[bytes]:
        self.held += part
        done = []
        while len(self.held) >= 3 and self.held[0] != 0xFF:  # 0xFF: stuffing up to the packet's end
            size = 3 + (struct.unpack_from(">H", self.held, 1)[0] & 0x0FFF)
            if len(self.held) < size:
                return done
            section, self.held = self.held[:size], self.held[size:]
            if crc32_mpeg(section):
                raise ValueError("a program table has a wrong CRC")
            done.append(section)
        if self.held[:1] == b"\xff":
            self.held = None
        return done


def read_stream(media: bytes) -> dict:
    """payload, time stamps, random access points (packet number, time stamp), and counts of packets and errors."""
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    pmt, es, last, units, sections = None, None, {}, [], {}
    errors, access, pending = 0, [], None
    for n in range(len(media) // PACKET):
        at = n * PACKET
        sync, pid, flags = struct.unpack_from(">BHB", media, at)
        if sync != 0x47 or pid & 0x8000:
            errors += 1
            continue
        unit, pid = pid & 0x4000, pid & 0x1FFF
        if pid == 0x1FFF:
            continue  # a null packet carries nothing, its counter neither
        skip, jump = 0, False
        if flags & 0x20:
            skip = 1 + media[at + 4]
            if skip > 1:
                jump = bool(media[at + 5] & 0x80)
                if media[at + 5] & 0x40 and pid == es:
                    pending = n
        if not flags & 0x10:
            continue
        if pid in last and flags & 15 != (last[pid] + 1 & 15) and not jump:
            if flags & 15 == last[pid]:
                continue  # a repeated packet is dropped
            errors += 1
        last[pid] = flags & 15
        body = media[at + 4 + skip:at + PACKET]
        if pid == es:
            if unit:
                units.append([body])
                if pending is not None:
                    access.append((pending, len(units) - 1))
            elif units:
                units[-1].append(body)
            pending = None
        elif pid == 0 or pid == pmt:
            for section in sections.setdefault(pid, _Sections()).add(body, bool(unit)):
                if pid == 0:
                    for i in range(8, len(section) - 4, 4):
                        program, target = struct.unpack_from(">HH", section, i)
                        if program and pmt is None:
                            pmt = target & 0x1FFF
                elif es is None:
                    es = struct.unpack_from(">H", section, 13 + (struct.unpack_from(">H", section, 10)[0] & 0x0FFF))[0] & 0x1FFF
    parts, stamps, stamp_of = [], [], {}
    for k, unit in enumerate(units):
        pes = b"".join(unit)
        if len(pes) < 9:
            errors += 1
            continue
        code, size, _, flags, header = struct.unpack_from(">IHBBB", pes, 0)
        if code >> 8 != 1 or size and size + 6 != len(pes):
            errors += 1
            continue
        if flags & 0x80:
            b = pes[9:14]
            stamp_of[k] = (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1
            stamps.append(stamp_of[k])
        parts.append(pes[9 + header:])
    return {"payload": b"".join(parts), "pts": stamps, "access": [(p, stamp_of[u]) for p, u in access if u in stamp_of],
            "packets": len(media) // PACKET, "es_pid": es, "errors": errors}


def padded(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


def _chunks(batch, size: int = 4_000_000):
    """Row ranges of a batch that hold few bytes each."""
    lo, total = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield lo, batch.num_rows


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as (doc_id, n_bytes, media): the padded UTF-8 bytes of the whole text as a transport stream."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for lo, hi in _chunks(batch):
                raw = [(t or "").encode() for t in batch.column(1)[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([len(r) for r in raw], pa.int64()),
                     pa.array([write_stream(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary")


READ = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, es_pid int, packets long, continuity_errors int, pts array<long>, "
        "access_points array<struct<packet: long, pts: long>>, feature string")


def read(media: DataFrame) -> DataFrame:
    """Parse stored streams: digests of the payload read back, time stamps and random access points."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1)], ["doc_id", "media", "n"])
            for lo, hi in _chunks(flat):
                rows = []
                for i, n, m in zip(*(batch.column(c)[lo:hi].to_pylist() for c in range(3))):
                    x = read_stream(m)
                    p = x["payload"]
                    rows.append({
                        "doc_id": i, "n_bytes": n, "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(),
                        "tail_crc32": zlib.crc32(p[-64:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(),
                        "es_pid": x["es_pid"], "packets": x["packets"], "continuity_errors": x["errors"], "pts": x["pts"],
                        "access_points": [{"packet": a, "pts": b} for a, b in x["access"]],
                        "feature": f"pid={x['es_pid']};packets={x['packets']};pes={len(x['pts'])};last_pts={x['pts'][-1] if x['pts'] else None};"
                                   f"access={','.join(f'{a}@{b}' for a, b in x['access'])};errors={x['errors']}"})
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
                        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("es_pid", pa.int32()),
                        ("packets", pa.int64()), ("continuity_errors", pa.int32()), ("pts", pa.list_(pa.int64())),
                        ("access_points", pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())]))), ("feature", pa.string())])
    return media.mapInArrow(run, READ)
