"""Files inside archives (cpio newc), as rows."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame

ENTRIES = "path string, name string, node_type string, mode bigint, mtime bigint, size bigint, target string, content binary, error string"
MAGICS = (b"070701", b"070702")
TYPES = {0o100000: "file", 0o040000: "directory", 0o120000: "symlink"}
_FIELDS = [(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in ENTRIES.split(", ")]


def cpio_entries(data: bytes) -> tuple[dict[str, dict], str | None]:
    """Entries by name, and what stopped the reading. A later entry of a name takes an earlier one's place,
    archives may follow each other, and hard links share the one content that is stored."""
    out: dict[str, dict] = {}
    links: dict[tuple, list[str]] = {}
    at = 0
    while at < len(data):
        if data[at] != 0 and at + 110 > len(data):
            return out, f"cut off at {at}"
        if data[at : at + 6] not in MAGICS:
            if data[at] == 0:  # padding between archives
                at += 1
                continue
            return out, f"no header at {at}"
        try:
            inode, mode, _, _, n_links, mtime, size, major, minor, _, _, n_name, _ = (int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in range(13))
        except ValueError:
            return out, f"damaged header at {at}"
        start = (at + 110 + n_name + 3) & ~3
        if start + size > len(data):
            return out, f"cut off at {at}"
        name = data[at + 110 : at + 110 + n_name].rstrip(b"\0").decode("utf-8", "replace")
        body, at = data[start : start + size], (start + size + 3) & ~3
        if name == "TRAILER!!!":
            links = {}
            continue
        if ".." in name.split("/"):  # a path that leaves the archive: its entry is passed over
            continue
        name = posixpath.normpath(name).lstrip("/")
        form = TYPES.get(mode & 0o170000, "special")
        out[name] = {"name": name, "node_type": form, "mode": mode & 0o7777, "mtime": mtime, "size": size, "target": body.decode("utf-8", "replace") if form == "symlink" else None, "content": body if form == "file" else None}
        if form == "file" and n_links > 1:
            same = links.setdefault((inode, major, minor), [])
            same.append(name)
            full = max((out[n]["content"] or b"" for n in same if n in out), key=len)
            for n in same:
                out[n] |= {"content": full, "size": len(full)}
    return out, None


def cpio(files: DataFrame) -> DataFrame:
    """ENTRIES, one row per entry of each (path, content); a damaged archive keeps what was read and adds a row with the error."""
    schema = pa.schema(_FIELDS)

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, error = cpio_entries(content or b"")
                rows = [{"path": path, **e} for e in found.values()] + ([{"path": path, "error": error}] if error else [])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, ENTRIES)
