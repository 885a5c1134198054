"""Small versioned files that say what a stored table consists of; each is published last, whole, by a rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions in order; a file whose write was broken off has another name and isn't one."""
    fs, target = _path(spark, folder)
    if not fs.exists(target):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The newest manifest, with its version."""
    known = versions(spark, folder)
    if not known:
        return None
    fs, target = _path(spark, f"{folder}/{known[-1]:08d}.json")
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": known[-1]}
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, content: dict, version: int) -> None:
    """Makes `content` this version; if another writer has published it, this one fails and the other's stays."""
    fs, target = _path(spark, f"{folder}/{version:08d}.json")
    _, draft = _path(spark, f"{folder}/_{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(content, indent=1).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of {folder} has been published by another writer")


def claim(spark: SparkSession, folder: str) -> int:
    """The next number of a folder, which no other writer gets: its claim is a file that must not have been there."""
    fs, claims = _path(spark, f"{folder}/_claims")
    taken = [int(s.getPath().getName()) for s in fs.listStatus(claims)] if fs.exists(claims) else []
    number = max(taken, default=-1) + 1
    while True:
        _, target = _path(spark, f"{folder}/_claims/{number:08d}")
        if fs.createNewFile(target):
            return number
        number += 1


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def listing(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under a path: another text once any of them is written anew."""
    fs, target = _path(spark, path)
    files, found = fs.listFiles(target, True), []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return json.dumps(sorted(found))
