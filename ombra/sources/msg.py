"""Mail in a compound file: sectors, chains and a directory, read with the standard library."""

from __future__ import annotations

import struct

#: The signature, marks of sectors that chain no further, and the properties of a message.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST = 0xFFFFFFFA
PROPERTIES = {"From": "0C1F", "To": "0E04", "Cc": "0E03", "Subject": "0037", "Body": "1000", "Html": "1013", "Headers": "007D", "Sender": "0C1A"}


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by the path of their names."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    size, small = 1 << shift, 1 << small_shift
    first_dir, _, cutoff, first_small, _, next_table, n_tables = struct.unpack_from("<IIIIIII", data, 48)

    def sector(n: int) -> bytes:
        return data[(n + 1) * size : (n + 2) * size]

    table = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_tables):
        if next_table >= LAST:
            break
        *more, next_table = struct.unpack(f"<{size // 4}I", sector(next_table))
        table += more
    links = [x for n in table if n < LAST for x in struct.unpack(f"<{size // 4}I", sector(n))]

    def chain(start: int, along: list[int]) -> list[int]:
        out: list[int] = []
        while start < LAST and start < len(along) and len(out) <= len(along):
            out.append(start)
            start = along[start]
        return out

    def read(start: int) -> bytes:
        return b"".join(map(sector, chain(start, links)))

    entries = []
    directory = read(first_dir)
    for at in range(0, len(directory) - 127, 128):
        width, kind = struct.unpack_from("<HB", directory, at + 64)
        left, right, child = struct.unpack_from("<III", directory, at + 68)
        start, length = struct.unpack_from("<IQ", directory, at + 116)
        entries.append((directory[at : at + max(0, width - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, length & 0xFFFFFFFF))
    small_links = [x for (x,) in struct.iter_unpack("<I", read(first_small))]
    pool = read(entries[0][5])
    out: dict[str, bytes] = {}
    seen: set[int] = set()
    todo = [(entries[0][4], "")]
    while todo:
        n, path = todo.pop()
        if n >= len(entries) or n in seen:
            continue
        seen.add(n)
        name, kind, left, right, child, start, length = entries[n]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            raw = read(start) if length >= cutoff else b"".join(pool[i * small : (i + 1) * small] for i in chain(start, small_links))
            out[path + name] = raw[:length]
    return out


def fields(data: bytes) -> dict[str, str]:
    """Sender, receivers, subject, date and body of a message."""
    found = streams(data)
    out = {}
    for name, number in PROPERTIES.items():
        for kind, coding in (("001F", "utf-16-le"), ("001E", "cp1252"), ("0102", "utf-8")):
            if (raw := found.get(f"__substg1.0_{number}{kind}")) is not None:
                out.setdefault(name, raw.decode(coding, "replace").rstrip("\0"))
    out["From"] = out.get("From") or out.pop("Sender", "")
    for line in out.pop("Headers", "").splitlines():
        if line.lower().startswith("date:"):
            out["Date"] = line[5:].strip()
    return out
