"""Opening files from tasks: mounted paths, or URIs of a store."""

from __future__ import annotations

# Stores already opened in this worker: (file system, path of its root).
_STORES: dict[str, tuple] = {}


def locate(name: str):
    """``(file system, path in it)`` of a plain path, a ``file:`` path or a URI."""
    from pyarrow import fs

    if name.startswith("file:"):
        return fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
    if "://" not in name:
        return fs.LocalFileSystem(), name
    scheme, _, rest = name.partition("://")
    host, _, inner = rest.partition("/")
    root = f"{scheme}://{host}/"
    if root not in _STORES:
        _STORES[root] = fs.FileSystem.from_uri(root)
    store, base = _STORES[root]
    return store, f"{base.rstrip('/')}/{inner}"


def file_size(name: str) -> int | None:
    """Bytes of a file; none when there is no such file."""
    store, path = locate(name)
    found = store.get_file_info(path)
    return found.size if found.is_file else None


def list_folder(name: str, at_once: int):
    """What lies in a folder, as lists of at most ``at_once`` rows ``path, length, modificationTime, folder``.

    A file is listed as itself, and what is not there as nothing.
    """
    import datetime as dt
    import os
    from pyarrow import fs

    store, path = locate(name)
    base = name.rstrip("/") + "/"

    def row(path: str, size: int | None, changed: float, folder: bool) -> dict:
        time = dt.datetime.fromtimestamp(changed, dt.timezone.utc)
        return {"path": path, "length": size, "modificationTime": time, "folder": folder}

    def entries():
        own = store.get_file_info(path)
        if own.is_file:
            yield row(name, own.size, own.mtime.timestamp(), False)
        elif isinstance(store, fs.LocalFileSystem) and own.type == fs.FileType.Directory:
            # One entry after the other: a folder may hold millions.
            with os.scandir(path) as found:
                for entry in found:
                    if entry.is_dir(follow_symlinks=False):
                        yield row(base + entry.name, None, 0, True)
                    elif entry.is_file():
                        about = entry.stat()
                        yield row(base + entry.name, about.st_size, about.st_mtime, False)
        elif own.type == fs.FileType.Directory:
            for entry in store.get_file_info(fs.FileSelector(path)):
                folder = entry.type == fs.FileType.Directory
                changed = 0 if folder or entry.mtime is None else entry.mtime.timestamp()
                yield row(base + entry.base_name, None if folder else entry.size, changed, folder)

    some = []
    for entry in entries():
        some.append(entry)
        if len(some) == at_once:
            yield some
            some = []
    if some:
        yield some


def read_bytes(name: str) -> bytes:
    store, path = locate(name)
    with store.open_input_stream(path) as stream:
        return stream.read()


def write_bytes(name: str, content: bytes) -> None:
    """Write under a draft name, then move: a task that runs twice leaves one file."""
    import uuid

    store, path = locate(name)
    store.create_dir(path.rpartition("/")[0])
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as stream:
        stream.write(content)
    store.move(draft, path)
