"""Tables as versions of named parts: written aside, verified, then committed by one small file; old ones can be restored.

``path/data`` holds what was written, each part in a folder that is never changed. ``path/commits/<number>.json`` names a
version's parts: folder, format, rows and digest. A commit claims the next number by creating its file, which fails if
someone else did so first; until then readers see the version before, whatever has been written aside. The highest
commit that can be read is the current version.

A part's digest is the sum of its rows' hashes, taken while it is written and again from what lies there before the
commit, so neither order nor partitioning matters. Of CSV only the rows are counted, as it does not keep all line ends.

Defined cases: a part that is not among the new ones stays as it is; a part without rows is a part; a commit that
fails, or whose data does not verify, changes nothing; of two commits over one version the later one raises
``ConflictError``, or with ``append`` takes the next number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from qanat.sources import files

CSV = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


class ConflictError(RuntimeError):
    """Someone else committed the number."""


class DamagedError(RuntimeError):
    """What lies there is not what was written."""


def digests(columns: list[str]) -> list[Column]:
    """(rows, digest) of all rows; a map's entries are taken as text."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(0).cast("long")
    return [F.count("*").alias("rows"), F.coalesce(F.sum(own.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")]


def lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def _write(rows: DataFrame, folder: str, form: str) -> dict:
    """Writes a part and says what was written."""
    out = lines(rows) if form == "json" else rows
    seen = Observation()
    watched = out.observe(seen, *digests([] if form == "csv" else out.columns))
    if form == "csv":
        watched.write.options(**CSV).csv(folder)
    else:
        watched.write.format("text" if form == "json" else form).save(folder)
    return {"format": form, "schema": rows.schema.json(), "rows": seen.get["rows"], "digest": seen.get["digest"]}


def _read(spark: SparkSession, path: str, part: dict) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(part["schema"]))
    options = CSV if part["format"] == "csv" else {}
    return spark.read.schema(schema).options(**options).format(part["format"]).load(f"{path}/{part['folder']}")


def verified(spark: SparkSession, path: str, part: dict) -> bool:
    """Whether a part is there as it was written."""
    try:
        if part["format"] == "json":
            found = spark.read.text(f"{path}/{part['folder']}")
        else:
            found = _read(spark, path, part)
        now = found.agg(*digests([] if part["format"] == "csv" else found.columns)).head()
    except PySparkException:
        return False
    return (now["rows"], now["digest"]) == (part["rows"], part["digest"])


def history(spark: SparkSession, path: str) -> list[dict]:
    """All commits that can be read, oldest first."""
    found = []
    for name in files.names(spark, f"{path}/commits"):
        if not name.endswith(".json") or name.startswith("."):
            continue
        try:
            found.append(json.loads(files.text(spark, f"{path}/commits/{name}")))
        except (ValueError, TypeError):  # its writer died
            continue
    return found


def current(spark: SparkSession, path: str) -> dict | None:
    numbers = [x for x in files.names(spark, f"{path}/commits") if x.endswith(".json") and not x.startswith(".")]
    for name in reversed(numbers):
        try:
            return json.loads(files.text(spark, f"{path}/commits/{name}"))
        except (ValueError, TypeError):
            continue
    return None


def top_number(spark: SparkSession, path: str) -> int:
    """The highest number that was claimed, whether its commit can be read or not; 0 if none was."""
    return max((int(x.removesuffix(".json")) for x in files.names(spark, f"{path}/commits") if x.endswith(".json") and not x.startswith(".")), default=0)


def advance(spark: SparkSession, path: str, change: Callable[[dict], dict], note: str = "", base: int | None = None) -> int:
    """Commits ``change`` of the current parts as the next version: the one after ``base`` or, without it, the next that is free."""
    while True:
        top, now = top_number(spark, path), current(spark, path)
        parts = change(dict(now["parts"]) if now else {})
        free = base is None or top == base
        if free and files.claim(spark, f"{path}/commits/{top + 1:012d}.json", json.dumps({"version": top + 1, "parts": parts, "note": note})):
            return top + 1
        if base is not None:
            raise ConflictError(f"{path}: someone else committed after version {base}")


def commit(spark: SparkSession, path: str, parts: dict[str, tuple[DataFrame, str]], note: str = "", append: bool = False) -> int:
    """Writes parts (rows, format), verifies them, and commits them all at once; the new version's number."""
    top, folder, new = top_number(spark, path), f"data/{uuid.uuid4()}", {}
    for name, (rows, form) in parts.items():
        new[name] = {"folder": f"{folder}/{name}"} | _write(rows, f"{path}/{folder}/{name}", form)
    bad = [name for name, part in new.items() if not verified(spark, path, part)]
    if bad:
        raise DamagedError(f"{path}: {', '.join(bad)} does not verify")
    return advance(spark, path, lambda old: old | new, note, None if append else top)


def version(spark: SparkSession, path: str, number: int | None = None) -> dict:
    found = current(spark, path) if number is None else next((c for c in history(spark, path) if c["version"] == number), None)
    if found is None:
        raise FileNotFoundError(f"{path}: no version {number or ''}".rstrip())
    return found


def read(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame:
    """A part of the current version, or of another."""
    return _read(spark, path, version(spark, path, number)["parts"][name])


def restore(spark: SparkSession, path: str, number: int) -> int:
    """Makes an older version the current one, as a new commit of its parts, if they still verify."""
    old = version(spark, path, number)["parts"]
    bad = [name for name, part in old.items() if not verified(spark, path, part)]
    if bad:
        raise DamagedError(f"{path}: {', '.join(bad)} of version {number} does not verify")
    return advance(spark, path, lambda _: old, f"restores {number}")


def complete(spark: SparkSession, path: str, required: list[str]) -> bool:
    """Whether the current version has the required parts, and all of its parts verify."""
    now = current(spark, path)
    return bool(now) and set(required) <= set(now["parts"]) and all(verified(spark, path, p) for p in now["parts"].values())


def copy(spark: SparkSession, source: str, target: str, note: str = "") -> int:
    """The current version of one place as the next version of another."""
    now = version(spark, source)
    return commit(spark, target, {name: (_read(spark, source, part), part["format"]) for name, part in now["parts"].items()}, note or f"copies {source}")


def ensure(spark: SparkSession, path: str, required: list[str], places: list[str | Callable[[str], None]]) -> str:
    """Sees to it that ``path`` is complete; says how.

    Tried in order: what is there, an older version of it, then the places: paths whose version is copied if it is
    complete, or functions that are to fill ``path``.
    """
    if complete(spark, path, required):
        return "there"
    for old in reversed(history(spark, path)[:-1]):
        if set(required) <= set(old["parts"]) and all(verified(spark, path, p) for p in old["parts"].values()):
            restore(spark, path, old["version"])
            return f"version {old['version']}"
    for place in places:
        if callable(place):
            place(path)
        elif complete(spark, place, required):
            copy(spark, place, path)
        if complete(spark, path, required):
            return place.__name__ if callable(place) else place
    raise FileNotFoundError(f"{path}: no place has {', '.join(required)}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes data that the last ``keep`` versions do not name, and says which; not to be run beside a commit."""
    named = {part["folder"].split("/")[1] for c in history(spark, path)[-keep:] for part in c["parts"].values()}
    gone = [x for x in files.names(spark, f"{path}/data") if x not in named]
    for x in gone:
        files.remove(spark, f"{path}/data/{x}")
    return gone
