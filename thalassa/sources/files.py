"""Files of any store that pyarrow reads, for readers of binary formats by byte range."""

from __future__ import annotations

import fnmatch
import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if ":" not in path.split("/")[0]:
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder, or of those of a folder whose names match a pattern; hidden ones left out."""
    fs, at = filesystem(path)
    prefix, pattern = path[: len(path) - len(at)] if path.endswith(at) else "", "*"
    if any(c in at.rsplit("/", 1)[-1] for c in "*?["):
        at, pattern = at.rsplit("/", 1)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(prefix + info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=pattern == "*"))
    names = lambda i: i.path[len(at) :].split("/")
    return sorted((prefix + i.path, i.size) for i in found if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, pattern) and not any(n.startswith(("_", ".")) for n in names(i)))


def write_binary(rows: DataFrame, content: str, folder: str, ending: str) -> list[str]:
    """Write the binary column, row after row, to one file per partition and return their paths.

    A file gets its name when it is whole, so failed and repeated attempts leave one file or none.
    """
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)

    def run(batches):
        import pyarrow as pa

        store, where = filesystem(folder)
        part, temporary = TaskContext.get().partitionId(), f"{where}/_{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(temporary) as sink:
            for b in batches:
                for v in b.column(0):
                    if v.is_valid:
                        n += sink.write(v.as_buffer())
        if n:
            store.move(temporary, f"{where}/part-{part:06d}{ending}")
            yield pa.record_batch({"name": pa.array([f"{folder}/part-{part:06d}{ending}"])})
        else:
            store.delete_file(temporary)

    return sorted(r.name for r in rows.select(content).mapInArrow(run, "name string").collect())
