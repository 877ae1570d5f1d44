"""File contents and manifests.

The files below a folder are listed and hashed by tasks that use file systems of Arrow: Spark's own listing keeps every file on the driver,
some kilobytes each. Where Arrow has no file system, Spark lists, and what fits into a row is read by its file source. Copies, deletions and
larger files always use file systems of Arrow; a path that has none there is an error of that file, never of the job.
"""

from __future__ import annotations

import codecs
import fnmatch
import hashlib
import re
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.paths import decoded_path, plain_path
from barwright.session import scratch_dir

# The functions that run inside tasks travel with their code: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 8 << 20
WHOLE_BYTES = 32 << 20  # files up to this size are rows of Spark's file source; larger ones are streamed
HEADER_BYTES = 64 << 10
TASKS = 64  # by default; the number is given, so that adaptive execution doesn't put a small plan of large files into one task
HASH_SCHEMA = "path string, sha256 string, size_bytes long"
HASH_NAMES = ["path", "sha256", "size_bytes"]
COPY_SCHEMA = "path string, target string, sha256 string, error string"
REMOVE_SCHEMA = "path string, deleted boolean"


#: Schemes by which Hadoop and Arrow name the same store.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


class NoFileSystem(OSError):
    """A path that Arrow cannot open."""


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(/.*)", path)
    if not found:
        return fs.LocalFileSystem(), path
    scheme, rest = found[1].lower(), found[2]
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if not rest.startswith("//"):
        raise NoFileSystem(f"no file system for {path}")
    try:
        return fs.FileSystem.from_uri(quote(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}", safe=":/"))
    except (ValueError, NotImplementedError) as error:  # Arrow's own errors
        raise NoFileSystem(f"no file system for {path}: {error}") from error


def _digest(system: fs.FileSystem, path: str) -> tuple[str, bytes]:
    """SHA-256 of a file of any size, read in chunks, and its first bytes."""
    digest, head = hashlib.sha256(), b""
    with system.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            head = head or chunk[:HEADER_BYTES]
            digest.update(chunk)
    return digest.hexdigest(), head


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple] = []
        done = held = 0

        def made() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)]
            own = batch.slice(done, len(found)).columns
            return pa.RecordBatch.from_arrays([*own, *columns], [*batch.schema.names, "sha256", "head", "error"])

        for path in batch["path"].to_pylist():
            try:
                found.append((*_digest(*_file_system(path)), None))
            except OSError as error:
                found.append((None, None, str(error)))
            held += len(found[-1][1] or b"")
            if held > CHUNK:
                yield made()
                done, held, found = done + len(found), 0, []
        if found:
            yield made()


def _text_of(system: fs.FileSystem, path: str) -> str | None:
    """A small file's text, None where there is no such file or nothing in it."""
    try:
        with system.open_input_stream(path) as stream:
            return stream.read(HEADER_BYTES).decode(errors="replace") or None
    except OSError:
        return None


def _facts_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`_facts` finds, and the text of the sidecar."""
    for batch in _facts(batches):
        places = [_file_system(path) for path in batch["path"].to_pylist()]
        texts = [_text_of(system, f"{path}.checksum") for system, path in places]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "sidecar"])


def arrow_opens(folder: str) -> bool:
    """Whether tasks can open the files of a folder by themselves."""
    try:
        _file_system(folder)
    except OSError:
        return False
    return True


def tasks_for(files: int) -> int:
    """Tasks that share a number of files: few for a handful, ``TASKS`` for thousands, more only where each would have 2,000."""
    return max(1, min(TASKS, files // 32), files // 2000)


def _hashed(listing: DataFrame, tasks: int) -> DataFrame:
    """:func:`file_facts` of the files of a listing, opened by the tasks, which must be able to."""
    schema = "path string, size_bytes long, modified timestamp, sha256 string, head binary, error string"
    found = listing.select("path", "size_bytes", "modified").repartition(tasks, "path").mapInArrow(_facts, schema)
    return found.select("path", "size_bytes", "modified", "sha256", _first_line(F.col("head")).alias("header"), "error")


def facts_of(listing: DataFrame, tasks: int = TASKS) -> DataFrame:
    """:func:`file_facts` of the files of a listing ``path, size_bytes, modified``, with ``expected``, the hash that a sidecar gives.

    The tasks open the files by themselves, for which :func:`arrow_opens` must hold: nothing is listed again, and no path passes through the driver.
    """
    schema = "path string, size_bytes long, modified timestamp, sha256 string, head binary, error string, sidecar string"
    found = listing.select("path", "size_bytes", "modified").repartition(tasks, "path").mapInArrow(_facts_beside, schema)
    expected = F.when(F.col("sidecar").isNotNull(), _first_word("sidecar")).alias("expected")
    return found.select("path", "size_bytes", "modified", "sha256", _first_line(F.col("head")).alias("header"), "error", expected)


def _split(stream: pa.NativeFile) -> Iterator[tuple[int, str]]:
    """The numbered lines of a file of any size, read in chunks."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    rest, n = "", 0
    while True:
        chunk = stream.read(CHUNK)
        text = rest + decoder.decode(chunk, final=not chunk)
        lines = re.split("\r\n|\n|\r", text)
        if not chunk:
            break
        rest = lines.pop()
        if text.endswith("\r"):  # the next chunk may begin with the line feed that belongs to it
            rest = lines.pop() + "\r"
        yield from enumerate(lines, n)
        n += len(lines)
    yield from enumerate(lines, n)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines below the header that are not blank, each with the place of its file in the batch and its own in the file."""
    blank = "".join(map(chr, range(33)))
    for batch in batches:
        at, numbers, texts, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            rows = batch.take(pa.array(at, pa.int32()))
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], [*batch.schema.names, "_row", "_line"])

        for place, path in enumerate(batch["path"].to_pylist()):
            system, inner = _file_system(path)
            headed = False
            with system.open_input_stream(inner) as stream:
                for n, line in _split(stream):
                    if not line.strip(blank):
                        continue
                    if not headed:
                        headed = True
                        continue
                    at.append(place)
                    numbers.append(n)
                    texts.append(line)
                    held += len(line)
                    if held > CHUNK:
                        yield made()
                        at, numbers, texts, held = [], [], [], 0
        if at:
            yield made()


def lines_of(files: DataFrame, tasks: int = TASKS) -> DataFrame:
    """The lines of files that :func:`arrow_opens`: the given columns, ``_row`` and ``_line``. A task reads a file in chunks."""
    schema = T.StructType([*files.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_line", T.StringType())])
    return files.repartition(tasks, "path").mapInArrow(_lines, schema)


def glob_free(path: str) -> str:
    """A path that names itself where a pattern is expected."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Named paths are listed by ``TASKS`` tasks; by default Spark starts one for every path."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(TASKS))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def listing_session(spark: SparkSession) -> SparkSession:
    """A session with the settings and tables of another, whose listings of named paths take ``TASKS`` tasks for good.

    A stream lists the files of every batch by name, long after it was started.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(LISTING, str(TASKS))
    return own


def _files(spark: SparkSession, paths: str | list[str], pattern: str, recursive: bool) -> DataFrame:
    given = paths if isinstance(paths, str) else [glob_free(p) for p in paths]
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    with few_listing_tasks(spark):
        return reader.load(given)


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


_ENTRIES = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())])
_ENTRIES_DDL = "path string, size_bytes long, modified timestamp, is_folder boolean"


def _opened(batches: Iterator[pa.RecordBatch], pattern: str, deep: bool) -> Iterator[pa.RecordBatch]:
    """The entries with what stands in their folders in place of these, at every depth if ``deep``; files by their pattern."""
    wanted = re.compile(fnmatch.translate(pattern))
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(_ENTRIES)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ENTRIES, strict=True)], schema=_ENTRIES)

    for batch in batches:
        files = batch.filter(pc.invert(batch.column("is_folder")))
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(files.columns, _ENTRIES, strict=True)], schema=_ENTRIES)
        folders = batch.filter(batch.column("is_folder")).column("path").to_pylist()
        while folders:
            folder = folders.pop()
            system, inner = _file_system(folder)
            for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                if _hidden(info.base_name):
                    continue
                path = f"{folder.rstrip('/')}/{info.base_name}"
                if info.type == fs.FileType.Directory:
                    if deep:
                        folders.append(path)
                    else:
                        held.append((path, None, None, True))
                elif info.type == fs.FileType.File and info.size and wanted.match(info.base_name):
                    held.append((path, info.size, info.mtime_ns // 1_000_000 * 1000, False))  # as precise as Spark's listing
                if len(held) >= 10_000:
                    yield made()
                    held = []
    yield made()


def _qualified(spark: SparkSession, folder: str) -> str:
    """The whole path of a folder as Spark sees it, plain if it is local."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "/", whole)


def listing_of(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame | None:
    """``path, size_bytes, modified`` of every file below a folder, listed by tasks whenever it is computed; None where Arrow cannot list it.

    Two levels are opened first, so that the folders of the third, of which there may be very many, are dealt to all tasks.
    """
    if re.search(r"[\\{}\[\]*?^]", folder) or re.search(r"[\\{}\[\]^!]", pattern):
        return None
    root = _qualified(spark, folder)
    try:
        system, inner = _file_system(root)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            return None
    except OSError:
        return None

    def opened(entries: DataFrame, deep: bool) -> DataFrame:
        return entries.mapInArrow(lambda batches: _opened(batches, pattern, deep), _ENTRIES_DDL)

    tasks = sharing_tasks(spark)
    found = spark.range(0, 1, 1, 1).select(
        F.lit(root).alias("path"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified"), F.lit(True).alias("is_folder")
    )
    found = opened(opened(found, False).repartition(tasks, "path"), False)
    return opened(found.repartition(tasks, "path"), True).select("path", "size_bytes", "modified")


def sharing_tasks(spark: SparkSession) -> int:
    """Tasks that share a number of files that isn't known."""
    return max(1, min(TASKS, 4 * spark.sparkContext.defaultParallelism))


def listed_files(spark: SparkSession, folder: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, size_bytes, modified`` of every file below one or several folders as they are now; none is opened.

    The listing of a folder by tasks is written down; empty files and those that Spark's file sources pass over are not in it.
    """
    listing = listing_of(spark, folder, pattern) if recursive and isinstance(folder, str) else None
    if listing is not None:
        kept = f"{scratch_dir(spark, 'listing')}/files"
        listing.write.parquet(kept)
        return spark.read.schema(listing.schema).parquet(kept)
    return _files(spark, folder, pattern, recursive).select(
        plain_path(F.col("path")).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")
    )


def file_facts(spark: SparkSession, paths: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, size_bytes, modified, sha256, header, error`` of a folder's files, or of named ones; each is read once.

    ``header`` is the first line, at most ``HEADER_BYTES`` of it, null where that is no UTF-8. A file that cannot be read has
    an error and no hash. Spark's file sources pass over empty files, which hold no rows.
    """
    if recursive and isinstance(paths, str) and listing_of(spark, paths, pattern) is not None:
        listing = listed_files(spark, paths, pattern)
        return _hashed(listing, tasks_for(listing.count()))
    files = _files(spark, paths, pattern, recursive)
    named = [plain_path(F.col("path")).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
    whole = files.where(F.col("length") <= WHOLE_BYTES).select(
        *named,
        F.sha2("content", 256).alias("sha256"),
        F.substring("content", 1, HEADER_BYTES).alias("head"),
        F.lit(None).cast("string").alias("error"),
    )
    streamed = files.where(F.col("length") > WHOLE_BYTES).select(*named)
    streamed = streamed.mapInArrow(_facts, "path string, size_bytes long, modified timestamp, sha256 string, head binary, error string")
    return whole.unionByName(streamed).withColumn("header", _first_line(F.col("head"))).select("path", "size_bytes", "modified", "sha256", "header", "error")


def facts_of_listed(spark: SparkSession, folder: str, listing: DataFrame) -> tuple[DataFrame, int]:
    """:func:`file_facts` of files listed below a folder, and their number; paths pass through the driver only where Arrow has no file system."""
    if arrow_opens(_qualified(spark, folder)):
        count = listing.count()
        return _hashed(listing, tasks_for(count)), count
    paths = [r["path"] for r in listing.select("path").collect()]
    schema = "path string, size_bytes long, modified timestamp, sha256 string, header string, error string"
    return file_facts(spark, paths) if paths else spark.createDataFrame([], schema), len(paths)


def _first_line(head: Column) -> Column:
    first = F.substring_index(head.cast("string"), "\n", 1)
    return F.when(F.is_valid_utf8(first), F.regexp_extract(first, r"^\x{FEFF}?([^\r]*)", 1))


def _first_word(text: str) -> Column:
    return F.lower(F.regexp_extract(text, r"^\s*([0-9A-Fa-f]+)", 1))


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, sha256, size_bytes`` of every file below a folder; a file that cannot be read raises."""
    facts = file_facts(spark, folder, pattern, recursive)
    unread = F.raise_error(F.concat(F.lit("cannot read "), "path", F.lit(": "), "error")).cast("string")
    return facts.select("path", F.coalesce("sha256", unread).alias("sha256"), "size_bytes")


def _write_sidecars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, digest in zip(batch["path"].to_pylist(), batch["sha256"].to_pylist(), strict=True):
            system, inner = _file_system(path)
            with system.open_output_stream(f"{inner}.checksum") as out:
                out.write(f"{digest}  {path.rsplit('/', 1)[1]}\n".encode())
        yield batch


def write_sidecars(hashes: DataFrame) -> DataFrame:
    """Write ``<path>.checksum`` beside every file of ``path, sha256, size_bytes``; returns the same rows.

    A repeated attempt writes the same bytes, so a lost executor does no harm.
    """
    return hashes.select(*HASH_NAMES).mapInArrow(_write_sidecars, HASH_SCHEMA)


def relative_to(hashes: DataFrame, folder: str) -> DataFrame:
    """The same hashes with paths relative to their folder."""
    prefix = folder.rstrip("/") + "/"
    return hashes.withColumn("path", F.replace("path", F.lit(prefix), F.lit("")))


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for path in batch["path"].to_pylist():
            system, inner = _file_system(path)
            with system.open_input_stream(inner) as stream:
                texts.append(stream.read(HEADER_BYTES).decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(texts, pa.string())], ["path", "value"])


def sidecar_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, expected`` from the ``.checksum`` files below a folder, or from named ones: the first word of each."""
    word = _first_word("value")
    if isinstance(paths, str) and listing_of(spark, paths, "*.checksum") is not None:
        listing = listed_files(spark, paths, "*.checksum").select("path").repartition(sharing_tasks(spark), "path")
        return listing.mapInArrow(_whole_texts, "path string, value string").select(
            F.regexp_replace("path", r"\.checksum$", "").alias("path"), word.alias("expected")
        )
    given = paths if isinstance(paths, str) else [glob_free(p) for p in paths]
    if not given:
        return spark.createDataFrame([], "path string, expected string")
    reader = spark.read.option("pathGlobFilter", "*.checksum").option("recursiveFileLookup", "true")
    with few_listing_tasks(spark):
        texts = reader.text(given, wholetext=True)
    path = F.regexp_replace(decoded_path(F.col("_metadata.file_path")), r"\.checksum$", "")
    return texts.select(path.alias("path"), word.alias("expected"))


def read_manifest(documents: DataFrame, column: str = "value") -> DataFrame:
    """``path, sha256`` of manifest documents, either ``{files: {path: {sha256}}}`` or the bare map.

    A text is one document, on any number of lines, or one document per line. A text that is no manifest raises.
    """
    entries = "map<string,struct<sha256:string>>"
    text = F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    first = F.split(text, "\n", 2)[0]
    by_line = F.get_json_object(first, "$").isNotNull()
    parts = F.when(by_line, F.filter(F.split(text, r"\n\s*"), lambda line: line != "")).otherwise(F.array(text))
    document = F.col("_document")
    wrapped = F.from_json(F.get_json_object(document, "$.files"), entries)
    bare = F.from_json(document, entries)
    stranger = F.raise_error(F.concat(F.lit("not a manifest: "), F.substring(document, 1, 100))).cast(entries)
    usable = F.map_filter(F.coalesce(wrapped, bare), lambda _, v: v["sha256"].isNotNull())
    whole_or_error = F.when((F.size(usable) > 0) | (F.regexp_replace(document, r"\s", "").isin("{}", '{"files":{}}')), usable)
    return (
        documents.where(text != "")
        .select(F.explode(parts).alias("_document"))
        .select(F.explode(F.coalesce(whole_or_error, stranger)))
        .select(F.col("key").alias("path"), F.col("value.sha256").alias("sha256"))
    )


def manifest_lines(hashes: DataFrame, generated_at: str) -> DataFrame:
    """A manifest as JSON text, one document per top folder and hash bucket of about a thousand files.

    All the documents together are the manifest: :func:`read_manifest` reads any number of them. A single
    document would pass every path of the table through one task.
    """
    buckets = F.greatest(F.lit(1), F.ceil(hashes.agg(F.count("*")).scalar() / 1000)).cast("long")
    entry = F.struct("path", F.struct("sha256"))
    return (
        hashes.withColumn("_bucket", F.pmod(F.xxhash64("path"), buckets))
        .groupBy("_bucket")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("files"))
        .select(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), "files")).alias("value"))
    )


def write_manifest(hashes: DataFrame, path: str, generated_at: str) -> None:
    manifest_lines(hashes, generated_at).write.text(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all manifest files below a path."""
    return read_manifest(spark.read.text(path, wholetext=True))


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def _folder_of(names: list[str], key: str) -> str:
    """The folder ``a=x/b=y`` of a row's values, spelled as Spark spells partition folders."""
    escaped = (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", v) for v in key.split("\0"))
    return "/".join(f"{n}={v}" for n, v in zip(names, escaped, strict=True))


def _write_lines(batches: Iterator[pa.RecordBatch], folder: str, names: list[str], head: bytes, stem: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Write runs of equal ``key`` to a file each; a file appears under its name when it is whole."""
    task = TaskContext.get()
    system, inner = _file_system(folder)
    stream, opened, key, count, part, written = None, ("", ""), None, 0, 0, 0

    def close() -> None:
        if stream is not None:
            stream.close()
            system.move(*opened)

    for batch in batches:
        if not batch.num_rows:
            continue
        lines = batch.column("line").cast(pa.large_binary())
        places = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data = memoryview(lines.buffers()[2])
        runs = pc.run_end_encode(batch.column("key").cast(pa.string()), run_end_type=pa.int64())
        at = 0
        for own, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            while at < end:
                if own != key or (limit and count >= limit):
                    close()
                    part = part + 1 if own == key else 0
                    key, count = own, 0
                    at_folder = f"{inner}/{_folder_of(names, own)}"
                    name = f"part-{task.partitionId():05d}-{stem}.c{part:03d}.csv"
                    system.create_dir(at_folder, recursive=True)
                    opened = (f"{at_folder}/.{name}.{task.taskAttemptId()}", f"{at_folder}/{name}")
                    stream = system.open_output_stream(opened[0])
                    stream.write(head)
                upto = min(end, at + limit - count) if limit else end
                stream.write(data[places[at] : places[upto]])
                count, written, at = count + upto - at, written + upto - at, upto
    close()
    yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["rows"])


def write_csv_folders(
    rows: DataFrame, folder: str, by: tuple[str, ...], order: tuple[str, ...] = (), rows_per_file: int = 0, mode: str = "errorifexists", **options: str
) -> None:
    """CSV files with a header below ``a=x/b=y`` folders, as ``partitionBy(*by)`` writes them, one a folder and task.

    Made for very many small files: Hadoop's local file system starts several processes for each file that it creates, so the tasks
    write Spark's CSV lines by file systems of Arrow, and Spark's own writer is left for paths that have none there. The rows stay in the
    partitions they are in, sorted by ``by`` and ``order``. A repeated attempt writes the same names, and a file has its name once it is
    whole; but the files of a job that fails half way stay, so nothing may name them before the job is done.
    """
    columns = [c for c in rows.columns if c not in by]
    held = rows.sortWithinPartitions(*by, *order)
    try:
        system, inner = _file_system(folder)
    except NoFileSystem:
        writer = held.write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", rows_per_file)
        writer.options(header="true", **options).csv(folder)
        return
    if mode == "errorifexists" and system.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} exists")
    system.create_dir(inner, recursive=True)

    def value(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NO_VALUE))

    quoted = str(options.get("quoteAll", "false")).lower() == "true"
    head = ",".join('"' + c.replace('"', '\\"') + '"' if quoted or re.search('[,"]', c) else c for c in columns).encode() + b"\n"
    line = F.concat(F.to_csv(F.struct(*(F.col(f"`{c}`") for c in columns)), options), F.lit("\n"))
    stem, names = str(uuid.uuid4()), list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_lines(batches, folder, names, head, stem, rows_per_file)

    lines = held.select(F.concat_ws("\0", *(value(c) for c in by)).alias("key"), line.alias("line"))
    lines.mapInArrow(run, "rows long").agg(F.sum("rows")).first()


def _copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, errors = [], []
        for source, target in zip(batch["path"].to_pylist(), batch["target"].to_pylist(), strict=True):
            digest, failed = None, None
            try:
                (source_fs, source_path), (target_fs, target_path) = _file_system(source), _file_system(target)
                target_fs.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
                fs.copy_files(source_path, target_path, source_filesystem=source_fs, destination_filesystem=target_fs)
                digest, _ = _digest(target_fs, target_path)
            except OSError as error:
                failed = str(error)
            digests.append(digest)
            errors.append(failed)
        yield pa.RecordBatch.from_arrays(
            [batch["path"], batch["target"], pa.array(digests, pa.string()), pa.array(errors, pa.string())],
            ["path", "target", "sha256", "error"],
        )


def copy_files(plan: DataFrame, tasks: int = TASKS) -> DataFrame:
    """Copy ``path`` to ``target`` byte for byte in ``tasks`` tasks, and hash what has arrived.

    A repeated attempt writes the same bytes to the same target, so a lost executor does no harm.
    """
    return plan.select("path", "target").repartition(tasks, "path").mapInArrow(_copy, COPY_SCHEMA)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        deleted = []
        for path in batch["path"].to_pylist():
            try:
                system, inner = _file_system(path)
            except NoFileSystem:
                deleted.append(False)
                continue
            for name in (inner, f"{inner}.checksum"):
                try:
                    system.delete_file(name)
                except OSError:
                    continue
            deleted.append(system.get_file_info(inner).type == fs.FileType.NotFound)
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(deleted, pa.bool_())], ["path", "deleted"])


def remove_files(plan: DataFrame, tasks: int = TASKS) -> DataFrame:
    """Delete each ``path`` and its sidecar in ``tasks`` tasks; a file that is gone counts as deleted."""
    return plan.select("path").repartition(tasks, "path").mapInArrow(_remove, REMOVE_SCHEMA)
