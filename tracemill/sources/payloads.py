"""Bodies kept beside the facts: one compressed file each, written, read with checks, and collected.

A fact refers to its body by a structure (storage, relative_path or path, byte_size, sha256). Files are read by Spark's
binary source and matched with references by a join, each file unpacked in the task that read it; a body that cannot be
given has a state that says why. Paths are compared after ``.`` and ``..`` are resolved, so none reaches outside the
root. Hidden files (names that begin with a dot or an underscore) are no bodies: Spark's listing leaves them out, and
writers use such names until a file is whole.
"""

from __future__ import annotations

import gzip
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".sse.gz", ".json.gz", ".txt.gz", ".bin.gz")
MARKER = ".payload-root"
GRACE_SECONDS = 300
BODY_REF = "struct<storage:string,relative_path:string,path:string,encoding:string,content_type:string,byte_size:long,compressed_size:long,sha256:string>"


def safe_segment(value: str | None) -> str:
    """Letters, digits and ``-_.`` of a name, the rest as underscores."""
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in value or "").strip("._") or "unknown"


def suffix_of(content_type: str | None) -> str:
    kind = (content_type or "").lower()
    return ".sse.gz" if "event-stream" in kind else ".json.gz" if "json" in kind else ".txt.gz" if kind.startswith("text/") else ".bin.gz"


def _file_system(root: str):
    """File system of a root and the path there, as any task can open them."""
    from pyarrow import fs

    local = re.sub("^file:(//[^/]*)?", "", root)
    return (fs.LocalFileSystem(), local.rstrip("/")) if local.startswith("/") else fs.FileSystem.from_uri(root.rstrip("/"))


def mark_root(root: str, marker: str = MARKER) -> None:
    """Make a folder a managed one: only such folders are collected."""
    system, path = _file_system(root)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(posixpath.join(path, marker)) as out:
        out.write(b'{"version": 1}\n')


def write_bodies(bodies: DataFrame, root: str) -> DataFrame:
    """A file for each row (session_id, run_id, request_id, body_kind, request_path, content_type, body), and the references.

    Files are named by their content, written under a hidden name and moved, so a task that runs twice leaves one.
    The files exist when the rows returned have been read; write those rows at once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _file_system(root)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                raw = bytes(row.body or b"")
                packed, digest = gzip.compress(raw, mtime=0), hashlib.sha256(raw).hexdigest()
                hint = safe_segment((row.request_path or "").strip("/") or "root")
                name = f"{safe_segment(row.body_kind)}-{hint}-{digest[:32]}{suffix_of(row.content_type)}"
                place = posixpath.join(safe_segment(row.session_id), safe_segment(row.run_id), safe_segment(row.request_id))
                system.create_dir(posixpath.join(top, place), recursive=True)
                hidden = posixpath.join(top, place, f".tmp-{name}")
                with system.open_output_stream(hidden, compression=None) as file:
                    file.write(packed)
                system.move(hidden, posixpath.join(top, place, name))
                out.append((row.session_id, row.run_id, row.request_id, row.body_kind, "local_file", posixpath.join(place, name), "gzip", row.content_type or "application/octet-stream", len(raw), len(packed), digest))
            yield pd.DataFrame(out, columns=names)

    names = ["session_id", "run_id", "request_id", "body_kind", "storage", "relative_path", "encoding", "content_type", "byte_size", "compressed_size", "sha256"]
    kinds = ["long" if n.endswith("_size") else "string" for n in names]
    columns = ("session_id", "run_id", "request_id", "body_kind", "request_path", "content_type", "body")
    flat = bodies.select(*columns[:-1], F.col("body").cast("binary").alias("body")).mapInPandas(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    ref = F.struct(*(F.lit(None).cast("string").alias(n) if n == "path" else F.col(n) for n in (f.split(":")[0] for f in BODY_REF[7:-1].split(",")))).cast(BODY_REF)
    return flat.select("session_id", "run_id", "request_id", "body_kind", ref.alias("body_ref"))


def body_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (relative_path, length, modified, content) of all files under a root; unread columns cost nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_below(F.col("path"), root).alias("relative_path"), "length", F.col("modificationTime").alias("modified"), "content")


def _below(path: Column, root: str) -> Column:
    plain = re.sub("^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/")

    @F.pandas_udf("string")
    def cut(paths: pd.Series) -> pd.Series:
        bare = paths.map(lambda p: unquote(re.sub("^[a-z0-9]+:(//[^/]*)?", "", p)))
        return bare.map(lambda p: p[len(plain) + 1 :] if p.startswith(plain + "/") else p)

    return cut(path)


def located(refs: DataFrame, root: str, ref: str = "body_ref") -> DataFrame:
    """``refs`` with the path below the root that each reference names (``_at``), or why there is none (``_state``)."""
    plain = re.sub("^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/")

    @F.pandas_udf("string")
    def resolved(relative: pd.Series, absolute: pd.Series) -> pd.Series:
        def one(r, a):
            place = posixpath.normpath(posixpath.join(plain, r)) if r else posixpath.normpath(a) if a else None
            return None if place is None else place[len(plain) + 1 :] if place.startswith(plain + "/") else "/"

        return pd.Series([one(r, a) for r, a in zip(relative, absolute)], dtype=object)

    at = resolved(F.col(f"{ref}.relative_path"), F.col(f"{ref}.path"))
    state = F.when(F.col(ref).isNull(), "none").when(~F.coalesce(F.col(f"{ref}.storage") == "local_file", F.lit(False)), "unsupported").when(F.col("_at").isNull(), "no_path").when(F.col("_at") == "/", "escapes")
    return refs.withColumn("_at", at).withColumn("_state", state)


def read_bodies(refs: DataFrame, files: DataFrame, root: str, ref: str = "body_ref") -> DataFrame:
    """``refs`` with ``body`` (bytes, where whole) and ``state``.

    States: ok, none (no reference), unsupported, no_path, escapes, missing, unreadable, size_mismatch, digest_mismatch;
    of several the first. References are matched by path; a file is unpacked once for each reference to it.
    """
    named = located(refs, root, ref)
    rows = named.join(files.select(F.col("relative_path").alias("_at"), F.col("content").alias("_packed")), "_at", "left")
    columns = [c for c in refs.columns]
    given = rows.select(*columns, "_packed", F.coalesce("_state", F.when(F.col("_packed").isNull(), "missing")).alias("state"))

    @F.pandas_udf("binary")
    def unpacked(packed: pd.Series) -> pd.Series:
        def one(data):
            try:
                return None if data is None else gzip.decompress(data)
            except (OSError, EOFError, zlib.error):
                return None

        return packed.map(one)

    plain = given.withColumn("_body", unpacked(F.when(F.col("state").isNull(), F.col("_packed"))))
    size, digest = F.col(f"{ref}.byte_size"), F.col(f"{ref}.sha256")
    state = F.coalesce("state", F.when(F.col("_body").isNull(), "unreadable").when(size != F.octet_length("_body"), "size_mismatch").when(digest != F.sha2("_body", 256), "digest_mismatch").otherwise("ok"))
    return plain.select(*columns, F.when(state == "ok", F.col("_body")).alias("body"), state.alias("state"))


def _managed(path: Column) -> Column:
    return (F.size(F.split(path, "/")) >= 4) & path.rlike("(" + "|".join(map(re.escape, SUFFIXES)) + ")$")


def file_states(files: DataFrame, refs: DataFrame, root: str, now: Column, grace_seconds: int = GRACE_SECONDS, ref: str = "body_ref") -> DataFrame:
    """Rows (relative_path, length, state) of all files: unmanaged, referenced, recent or orphan."""
    wanted = located(refs, root, ref).where("_state is null").select(F.col("_at").alias("relative_path")).distinct().withColumn("_wanted", F.lit(True))
    age = F.unix_micros(now) - F.unix_micros("modified")
    state = F.when(~_managed(F.col("relative_path")), "unmanaged").when(F.col("_wanted"), "referenced").when(F.greatest(age, F.lit(0)) < grace_seconds * 1_000_000, "recent").otherwise("orphan")
    return files.select("relative_path", "length", "modified").join(wanted, "relative_path", "left").select("relative_path", "length", state.alias("state"))


def summary(states: DataFrame, refs: DataFrame, root: str, ref: str = "body_ref") -> DataFrame:
    """One row of counters: what a collection sees, and what it would delete."""
    count = lambda *kinds: F.count_if(F.col("state").isin(*kinds))
    found = states.agg(
        F.count("*").alias("scanned_files"), count("referenced", "recent", "orphan").alias("managed_files"), count("unmanaged").alias("skipped_unmanaged_files"), count("recent", "orphan").alias("orphan_files"),
        count("recent").alias("skipped_recent_files"), count("orphan").alias("would_delete_files"), F.coalesce(F.sum(F.when(F.col("state") == "orphan", F.col("length"))), F.lit(0)).alias("would_delete_bytes"),
    )
    named = located(refs, root, ref)
    wanted = named.agg(F.count_distinct(F.when(F.col("_state").isNull(), F.col("_at"))).alias("referenced_files"), F.count_if(F.col("_state") == "escapes").alias("referenced_outside_root"))
    return found.crossJoin(wanted)  # one row each


def collect_garbage(spark: SparkSession, root: str, refs: DataFrame, dry_run: bool = False, grace_seconds: int = GRACE_SECONDS, marker: str = MARKER, ref: str = "body_ref") -> dict:
    """Delete the bodies under a managed root to which no reference points, those of the last seconds left alone.

    Tasks delete the files of their own rows. Returns the counters of ``summary`` with what was deleted. A folder with
    files but without its marker is refused; a missing one has nothing to delete.
    """
    from pyarrow import fs

    if grace_seconds < 0:
        raise ValueError("grace_seconds must not be negative")
    system, top = _file_system(root)
    managed = system.get_file_info(posixpath.join(top, marker)).type == fs.FileType.File
    empty = system.get_file_info(top).type != fs.FileType.Directory or not system.get_file_info(fs.FileSelector(top))
    if not managed and not empty:
        raise ValueError(f"{root} is no managed folder of bodies; it is left alone")
    about = {"root": root, "managed": managed, "dry_run": dry_run, "grace_seconds": grace_seconds, "deleted_files": 0, "deleted_bytes": 0}
    if not managed:
        names = ("scanned_files", "managed_files", "skipped_unmanaged_files", "orphan_files", "skipped_recent_files", "would_delete_files", "would_delete_bytes", "referenced_files", "referenced_outside_root")
        return about | dict.fromkeys(names, 0)
    now = F.lit(pd.Timestamp.now(tz="UTC").to_pydatetime())
    states = file_states(body_files(spark, root), refs, root, now, grace_seconds, ref)
    found = summary(states, refs, root, ref).first().asDict()
    if dry_run:
        return about | found

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, place = _file_system(root)
        for batch in batches:
            for path in batch.relative_path:
                try:
                    own.delete_file(posixpath.join(place, path))
                except FileNotFoundError:  # a task that runs again
                    pass
            yield batch

    gone = states.where("state = 'orphan'").select("relative_path", "length").mapInPandas(delete, "relative_path string, length long").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return about | found | {"deleted_files": gone.n, "deleted_bytes": gone.bytes}
