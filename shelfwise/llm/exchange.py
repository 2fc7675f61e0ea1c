"""Packed exchange: tasks send (hash, key, size, place) entries to the owner of a range of hashes.

Entries go as byte strings, a few for each task and owner, ordered by document so that a document's key is
written once; 48 bits of a hash travel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOBS = pa.schema([("owner", pa.int64()), ("kind", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()),
                   ("values", pa.binary()), ("places", pa.binary())])


def pack(bits: int, hashes: np.ndarray, doc: np.ndarray, keys: np.ndarray, sizes: np.ndarray, places: np.ndarray | None = None, kind: int = 0) -> list[tuple]:
    """Rows of BLOBS: an entry has a hash, the number of its document (ascending), and perhaps a place.

    ``keys`` and ``sizes`` are per document.  The first ``bits`` bits of a hash name the owner;
    of the others the first 47 and the last travel.
    """
    owners = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    values = ((hashes << np.uint64(bits)) >> np.uint64(17) << np.uint64(1)) | (hashes & np.uint64(1))
    order = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[order], np.arange((1 << bits) + 1))
    out = []
    for owner in range(1 << bits):
        part = order[cuts[owner]:cuts[owner + 1]]
        if len(part) == 0:
            continue
        docs, counts = np.unique(doc[part], return_counts=True)
        out.append((owner, kind, keys[docs].astype("<i8").tobytes(), sizes[docs].astype("<i4").tobytes(), counts.astype("<i4").tobytes(),
                    values[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                    b"" if places is None else places[part].astype("<i4").tobytes()))
    return out


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, keys, sizes, places) of a blob's entries."""
    raw = np.frombuffer(row["values"], np.uint8).reshape(-1, 6)
    values = np.zeros((len(raw), 8), np.uint8)
    values[:, :6] = raw
    counts = np.frombuffer(row["counts"], "<i4")
    return (values.view("<u8").ravel(), np.repeat(np.frombuffer(row["keys"], "<i8"), counts), np.repeat(np.frombuffer(row["sizes"], "<i4"), counts),
            np.frombuffer(row["places"], "<i4"))


def owner_bits(documents: int, per_owner: int) -> int:
    """Owners are a power of two, each meant for so many documents' entries; never fewer than 16."""
    return max(4, int(max(1, documents // per_owner)).bit_length())
