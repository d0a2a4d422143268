"""Result folders that change in one step.

Files are written below ``versions/``, each write in a folder of its own.  A manifest names the folders that make up the result; it is
written last, under the next number, and readers follow the one with the highest number.  A write that fails half-way
leaves no manifest, so the result before it stays whole and readable.  A manifest is written beside its place and renamed
there, and never replaces another, so of two writers at once one raises.  Folders that none of the last ``KEPT``
manifests name are removed after a write.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from typing import Any

from pyspark.sql import SparkSession

from ..session import hadoop

KEPT = 2
NAME = "manifest-{:012d}.json"


def new_version(directory: str) -> str:
    """A folder for the files of one write."""
    return posixpath.join(directory, "versions", uuid.uuid4().hex)


def numbers(spark: SparkSession, directory: str) -> list[int]:
    """The manifests there are, in order."""
    files, there = hadoop(spark, directory)
    if not files.exists(there):
        return []
    names = [x.getPath().getName() for x in files.listStatus(there)]
    return sorted(int(n[9:21]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def read(spark: SparkSession, directory: str, number: int | None = None) -> dict[str, Any] | None:
    """What the newest manifest says (or that one), or None before the first write."""
    if number is None:
        known = numbers(spark, directory)
        if not known:
            return None
        number = known[-1]
    files, there = hadoop(spark, posixpath.join(directory, NAME.format(number)))
    stream = files.open(there)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def commit(spark: SparkSession, directory: str, content: dict[str, Any]) -> int:
    """Make ``content`` the newest manifest.  Its ``parts`` map names to lists of folders, relative to ``directory``."""
    known = numbers(spark, directory)
    number = known[-1] + 1 if known else 0
    files, place = hadoop(spark, posixpath.join(directory, NAME.format(number)))
    files.mkdirs(place.getParent())
    _, beside = hadoop(spark, posixpath.join(directory, f".{uuid.uuid4().hex}.json"))
    out = files.create(beside)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    if files.exists(place) or not files.rename(beside, place):
        files.delete(beside, False)
        raise RuntimeError(f"another write to {directory} came first")
    _tidy(spark, directory, [*known, number])
    return number


def _tidy(spark: SparkSession, directory: str, known: list[int]) -> None:
    """Remove what only older manifests name, then those manifests."""
    old, kept = known[:-KEPT], known[-KEPT:]
    if not old:
        return

    def folders(some: list[int]) -> set[str]:
        return {p for n in some for paths in read(spark, directory, n)["parts"].values() for p in paths}

    files, _ = hadoop(spark, directory)
    for path in folders(old) - folders(kept):
        files.delete(hadoop(spark, posixpath.join(directory, path))[1], True)
    for n in old:
        files.delete(hadoop(spark, posixpath.join(directory, NAME.format(n)))[1], False)
