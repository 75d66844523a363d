"""The packet format: header checks, the payload directory of a packet, and a scanner that takes bytes in any pieces."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: The wire format. Magic word, then eight unsigned 32-bit little-endian fields, then payloads of (type, length, bytes).
MAGIC = bytes((2, 1, 4, 3, 6, 5, 8, 7))
FIELDS = ("version", "total_len", "platform", "frame_number", "cycles", "num_obj", "num_tlvs", "sub_frame")
HEADER = 40
PAD = 32
POINTS, PROFILE, NOISE, SIDE = 1, 2, 3, 7
KNOWN = (1, 2, 3, 4, 5, 6, 7, 8, 9, 1050, 1051)
SMALLEST, LARGEST, MOST_TLVS, MOST_SUB, MOST_OBJ = 40, 4 << 20, 64, 3, 4096
LIMIT = 8 << 20
#: How anomalies of a packet are told; they are counted by what stands before the bracket.
HEADER_OVERRUN = "tlv_header_overruns_frame (tlv {} of {})"
PAYLOAD_OVERRUN = "tlv_payload_overruns_frame (type {} len {})"
WITH_HEADER = "tlv_length_includes_header (type {})"
UNKNOWN_TYPE = "unknown_tlv_type ({}, {} bytes)"
OTHER_COUNT = "tlv_count_mismatch (header says {}, parsed {})"
LEFT_OVER = "trailing_bytes_in_frame ({})"


def directory(packet: bytes) -> tuple[list[tuple[int, int, int]], list[str], int]:
    """Payloads (type, start, length), anomalies and padding of a packet.

    Lengths leave out their own eight bytes; one that would leave the packet but fits with them is taken to include them. What
    follows the last payload is padding if it is shorter than a segment of 32 bytes and the packet is made of whole segments.
    """
    count, at, end, found, odd = struct.unpack_from("<I", packet, 32)[0], HEADER, len(packet), [], []
    for i in range(count):
        if at + 8 > end:
            odd.append(HEADER_OVERRUN.format(i, count))
            break
        kind, size = struct.unpack_from("<II", packet, at)
        if at + 8 + size > end:
            if size < 8 or at + size > end:
                odd.append(PAYLOAD_OVERRUN.format(kind, size))
                break
            odd.append(WITH_HEADER.format(kind))
            size -= 8
        if kind not in KNOWN:
            odd.append(UNKNOWN_TYPE.format(kind, size))
        found.append((kind, at + 8, size))
        at += 8 + size
    if len(found) != count:
        odd.append(OTHER_COUNT.format(count, len(found)))
    rest, padding = end - at, 0
    if 0 < rest < PAD and end % PAD == 0:
        padding = rest
    elif rest > 0:
        odd.append(LEFT_OVER.format(rest))
    return found, odd, padding


class Scanner:
    """Packets from bytes that come in pieces, and where every byte went.

    Packets are followed by their lengths; the magic word is searched only at the start and after a loss. A header of possible
    length is waited for until its packet is whole (4 MiB at most), so nothing inside it is taken for a packet and the result
    does not depend on the pieces.
    """

    COUNTS = ("bytes_total", "bytes_in_frames", "bytes_skipped", "resyncs", "false_magics", "leading_partial")

    def __init__(self) -> None:
        self.data, self.base, self.gap, self.frame, self.need = bytearray(), 0, 0, 0, 0
        self.searching, self.begun = True, False
        self.counts = dict.fromkeys(self.COUNTS, 0)

    def save(self) -> tuple:
        return bytes(self.data), self.base, self.gap, self.frame, self.searching, self.begun

    @classmethod
    def load(cls, saved: tuple) -> Scanner:
        s = cls()
        data, s.base, s.gap, s.frame, s.searching, s.begun = saved
        s.data = bytearray(data)
        return s

    def _skip(self, n: int) -> None:
        del self.data[:n]
        self.base += n
        self.gap += n
        self.counts["bytes_skipped"] += n

    def feed(self, piece: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(offset, bytes skipped before, packet) of each packet that `piece` completes."""
        self.data += piece
        self.counts["bytes_total"] += len(piece)
        while len(self.data) >= self.need:
            self.need = 0
            if self.searching:
                at = self.data.find(MAGIC)
                if at < 0:
                    self._skip(max(0, len(self.data) - len(MAGIC) + 1))
                    return
                if self.begun:
                    self.counts["resyncs"] += 1
                else:
                    self.counts["leading_partial"] = self.base + at
                self._skip(at)
                self.searching, self.begun = False, True
            if len(self.data) < len(MAGIC):
                return
            if not self.data.startswith(MAGIC):
                self.searching = True
                continue
            if len(self.data) < HEADER:
                return
            _, n, _, _, _, objects, tlvs, sub = struct.unpack_from("<8I", self.data, 8)
            if SMALLEST <= n <= LARGEST and len(self.data) < n:
                self.need = n
                return
            if not SMALLEST <= n <= LARGEST or tlvs > MOST_TLVS or sub > MOST_SUB or objects > MOST_OBJ:
                self.counts["false_magics"] += 1
                self.searching = True
                self._skip(1)
                continue
            packet = bytes(self.data[:n])
            at, gap = self.base, self.gap
            del self.data[:n]
            self.base, self.gap, self.frame = at + n, 0, self.frame + 1
            self.counts["bytes_in_frames"] += n
            yield at, gap, packet
        if len(self.data) > LIMIT:
            self._skip(len(self.data))
            self.searching = True

    def finish(self) -> dict[str, int]:
        """The counts once nothing follows: a packet that is not whole is a truncated tail, other bytes are skipped."""
        whole = not self.searching and self.data.startswith(MAGIC)
        rest = len(self.data)
        return self.counts | {"bytes_skipped": self.counts["bytes_skipped"] + (0 if whole else rest), "truncated_tail": rest if whole else 0}


def chain(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(offset, length, bytes skipped before) of each whole packet of some bytes."""
    for at, gap, packet in Scanner().feed(data):
        yield at, len(packet), gap
