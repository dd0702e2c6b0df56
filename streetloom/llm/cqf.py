"""A counting quotient filter over 64-bit fingerprints, built and merged in sorted order."""

from __future__ import annotations

import struct

import numpy as np


class CountingQuotientFilter:
    """Fingerprints with counts, split in quotient (high bits, a slot's home) and remainder (stored in a slot).

    Runs of one quotient are kept in order of the remainders, each run pushed right of the one before it. `occupied`
    tells which quotients have a run, `runend` which slots end one: the i-th of the one belongs to the i-th of the
    other. A remainder with a count above one is followed by a slot with the count, marked in `counter`. Nothing is
    lost: the whole fingerprint can be read back, so filters of any quotient size merge exactly.
    """

    def __init__(self, q: int, occupied: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.q, self.occupied, self.runend, self.counter, self.slots = q, occupied, runend, counter, slots

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls.from_counts(*np.unique(fingerprints, return_counts=True))

    @classmethod
    def from_counts(cls, fp: np.ndarray, count: np.ndarray) -> CountingQuotientFilter:
        """fp: uint64, ascending, distinct."""
        q = max(4, int(max(1, 2 * len(fp))).bit_length())
        quotient = (fp >> np.uint64(64 - q)).astype(np.int64)
        remainder = fp & np.uint64((1 << (64 - q)) - 1)
        width = 1 + (count > 1)
        rank = np.cumsum(width) - width  # slots taken by those before
        place = np.maximum.accumulate(quotient - rank) + rank if len(fp) else rank
        size = int(max((1 << q), place[-1] + width[-1])) if len(fp) else 1 << q
        slots, counter, runend = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool)
        slots[place] = remainder
        many = count > 1
        slots[place[many] + 1] = count[many].astype(np.uint64)
        counter[place[many] + 1] = True
        last = np.append(quotient[1:] != quotient[:-1], True) if len(fp) else np.zeros(0, bool)
        runend[(place + width - 1)[last]] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        return cls(q, occupied, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, ascending, with their counts."""
        homes, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        if not len(homes):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        begins = np.maximum(homes, np.append(0, ends[:-1] + 1))
        length = ends - begins + 1
        run = np.repeat(np.arange(len(homes)), length)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + begins[run]
        is_count = self.counter[place]
        fp = (homes[run].astype(np.uint64) << np.uint64(64 - self.q)) | self.slots[place]
        count = np.ones(len(place), np.int64)
        at = np.flatnonzero(is_count)
        count[at - 1] = self.slots[place[at]].astype(np.int64)
        return fp[~is_count], count[~is_count]

    def count(self, fingerprint: int) -> int:
        fp, n = self.items()
        i = int(np.searchsorted(fp, np.uint64(fingerprint)))
        return int(n[i]) if i < len(fp) and fp[i] == np.uint64(fingerprint) else 0

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Sorted merge of the filters' items; counts of one fingerprint add up."""
        items = [f.items() for f in filters]
        fp = np.concatenate([x[0] for x in items]) if items else np.zeros(0, np.uint64)
        count = np.concatenate([x[1] for x in items]) if items else np.zeros(0, np.int64)
        order = np.argsort(fp, kind="stable")
        fp, count = fp[order], count[order]
        first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)
        return cls.from_counts(fp[first], np.add.reduceat(count, first) if len(fp) else count)

    def to_bytes(self) -> bytes:
        used = np.flatnonzero(self.runend)
        n = int(used[-1]) + 1 if len(used) else 0
        bits = (np.packbits(x).tobytes() for x in (self.occupied, self.runend[:n], self.counter[:n]))
        kept = np.flatnonzero(self._used()[:n])
        return struct.pack("<BQQ", self.q, n, len(kept)) + b"".join(bits) + self.slots[kept].tobytes()

    def _used(self) -> np.ndarray:
        homes, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        used = np.zeros(len(self.slots) + 1, np.int64)
        if len(homes):
            np.add.at(used, np.maximum(homes, np.append(0, ends[:-1] + 1)), 1)
            np.add.at(used, ends + 1, -1)
        return np.cumsum(used)[:-1] > 0

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        q, n, kept = struct.unpack_from("<BQQ", raw)
        at, out = 17, []
        for bits in (1 << q, n, n):
            size = -(-bits // 8)
            out.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=bits).astype(bool))
            at += size
        f = cls(q, *out, np.zeros(n, np.uint64))
        f.slots[np.flatnonzero(f._used())] = np.frombuffer(raw, np.uint64, kept, at)
        return f
