"""Files that only one of several writers can make."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError


def made_first(jvm: Any, fs: Any, path: str) -> bool:
    """Whether this call made the file; False if it was there, or another writer was first.

    Stores for clusters refuse to create a file twice. Hadoop's local file system looks first and creates
    then, which two writers may do at once, so there the operating system is asked.
    """
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        if fs.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(where.toUri().getPath()).toPath(), jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("java.nio.file.attribute.FileAttribute"), 0))
        else:
            fs.create(where, False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
