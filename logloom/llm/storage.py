"""Binary files in the shared scratch folder, written and read by tasks.

Inputs are always read by Spark. These helpers are for the operators' own file formats only; they take any address that
pyarrow knows (a mounted folder, S3, GCS, HDFS).
"""

import uuid

from pyarrow import fs


def resolve(uri: str):
    """(file system, path) of an address; plain paths are taken as mounted folders."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data) -> None:
    """Write under another name, then rename: a lost or repeated task never leaves half a file."""
    store, path = resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, path)


def open_file(uri: str):
    """A seekable reader."""
    store, path = resolve(uri)
    return store.open_input_file(path)
