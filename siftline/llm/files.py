"""Plain files in the shared folder, by URI, from driver and executors alike (local, HDFS or object store)."""

from __future__ import annotations

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    store, path = located(uri)
    store.create_dir(path, recursive=True)


def forget_others(uri: str, wanted: set[str]) -> int:
    """Deletes the files of a folder that no index names: what failed or repeated attempts left there."""
    store, path = located(uri)
    gone = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and x.base_name not in wanted]
    for x in gone:
        store.delete_file(x)
    return len(gone)


def forget(uri: str) -> None:
    """Deletes a folder of which nothing is read any more."""
    store, path = located(uri)
    store.delete_dir(path)
