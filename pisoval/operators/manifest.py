"""Files against a manifest of SHA-256 values."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Files up to this many bytes are hashed as one row; longer ones stream through a digest in pieces.
WHOLE_BYTES = 64 << 20
# Endings by which the text reader unpacks a file; such files are hashed as one row.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
PACKED_NAMES = "*.{gz,bz2,zst,lz4,snappy,deflate}"
_MARK = b"\xef\xbb\xbf"


def file_hashes(spark: SparkSession, folder: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(nombre, sha256) of every file below a folder; names are paths from the folder on.

    Files are listed first, without their content. Short ones are a row each; long ones are read in pieces that end with a line feed and
    stream through a digest in order, so a task holds pieces of a file, never the file. Packed files (by their ending)
    must stay below 2 GB. Spark's readers list no file without a byte.
    """
    bound = max(whole_bytes, len(_MARK))

    def listed(**options: str) -> DataFrame:
        return spark.read.format("binaryFile").options(recursiveFileLookup=True, **options).load(folder)

    # A condition on the length alone reaches the reader, which never opens the other files; joined to one on the path by OR, it would
    # be asked only after each file has been read whole.
    whole = listed().filter(F.col("length") <= bound)
    packed = F.col("path").rlike(PACKED)
    kinds = {r["packed"] for r in listed().filter(F.col("length") > bound).select(packed.alias("packed")).distinct().collect()}
    hashes = whole.select("path", F.sha2("content", 256).alias("sha256"))
    if True in kinds:
        longer = listed(pathGlobFilter=PACKED_NAMES).filter((F.col("length") > bound) & packed)
        hashes = hashes.unionByName(longer.select("path", F.sha2("content", 256).alias("sha256")))
    if False in kinds:
        hashes = hashes.unionByName(_streamed_hashes(spark, folder, bound))
    inside = re.escape(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", folder).rstrip("/"))
    # The file path of the text reader is encoded as in a URL, that of the binary reader is not.
    return hashes.select(F.regexp_replace("path", f"^.*?{inside}/+", "").alias("nombre"), "sha256")


def _streamed_hashes(spark: SparkSession, folder: str, longer_than: int) -> DataFrame:
    """(path, sha256) of the files longer than so many bytes."""
    texts = spark.read.option("recursiveFileLookup", True).text(folder, lineSep="\n")
    meta = "_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start"
    pieces = texts.filter((F.col(meta[1]) > longer_than) & ~F.col(meta[0]).rlike(PACKED)).select(
        F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("path"), F.col(meta[1]).alias("size"), F.col(meta[2]).alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("piece"))
    ordered = pieces.repartition("path").sortWithinPartitions("path", "split", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        for (path, size), own in groupby(rows, key=lambda r: r[:2]):
            # The reader leaves out a byte order mark and doesn't tell whether a line feed ends the file; the size tells both.
            plain, marked, held, read = hashlib.sha256(), hashlib.sha256(_MARK), None, 0
            for _, _, piece in own:
                if held is not None:
                    for digest in (plain, marked):
                        digest.update(held + b"\n")
                held = piece
                read += len(piece) + 1
            spare = read - size
            if spare not in (0, 1, -3, -2):
                raise ValueError(f"{path}: read {read} bytes of {size}")
            digest = plain if spare >= 0 else marked
            digest.update(held + (b"\n" if spare in (0, -3) else b""))
            yield pa.record_batch([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "sha256"])

    return ordered.select("path", "size", "piece").mapInArrow(run, "path string, sha256 string")


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(nombre, estado): igual, alterado, falta or inesperado."""
    found = files.select("nombre", F.col("sha256").alias("hallado"))
    expected = manifest.select("nombre", F.col("sha256").alias("esperado"))
    state = (F.when(F.col("hallado").isNull(), "falta").when(F.col("esperado").isNull(), "inesperado")
             .when(F.col("hallado") == F.col("esperado"), "igual").otherwise("alterado"))
    return found.join(expected, "nombre", "full_outer").select("nombre", state.alias("estado"))


def fingerprint(names_and_hashes: Column) -> Column:
    """SHA-256 of the compact JSON object with sorted names; takes ARRAY<STRUCT<nombre, sha256>>."""
    quoted = F.transform(F.array_sort(names_and_hashes),
                         lambda e: F.concat(F.lit('"'), e["nombre"], F.lit('":"'), e["sha256"], F.lit('"')))
    return F.sha2(F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")), 256)


def manifest_fingerprint(manifest: DataFrame, by: str) -> DataFrame:
    """Identity of each package: one hash over all its (nombre, sha256) entries, in order of names.

    The hash is one over a text that lists every file, so a package's entries pass through one task; they stream through it
    in order, and none of them is kept.
    """
    kind = manifest.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        rows = (r for b in chain([first], batches) for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        for package, entries in groupby(rows, key=lambda r: r[0]):
            digest, comma = hashlib.sha256(b"{"), ""
            for _, name, value in entries:
                digest.update(f'{comma}"{name}":"{value}"'.encode())
                comma = ","
            digest.update(b"}")
            yield pa.record_batch([pa.array([package], first.column(0).type), pa.array([digest.hexdigest()])], [by, "paquete_sha256"])

    ordered = manifest.select(by, "nombre", "sha256").repartition(by).sortWithinPartitions(by, "nombre", "sha256")
    return ordered.mapInArrow(run, f"`{by}` {kind}, paquete_sha256 string")


#: Entries that one leaf of a hash tree may hold, about.
LEAF_ENTRIES = 64


def tree_depth(largest: int) -> int:
    """Digits of the names' hashes by which leaves are told apart, so that the largest package's leaves stay small; one at least."""
    depth = 1
    while largest > LEAF_ENTRIES * 16 ** depth:
        depth += 1
    return depth


def manifest_tree(manifest: DataFrame, by: str) -> DataFrame:
    """(by, entradas, profundidad, raiz_sha256): identity of each package as the root of a hash tree.

    Leaves hold the entries whose names' hashes begin alike; a leaf's hash is that of its entries in the manifest's text form, and a
    node's that of its children's digits and hashes in the same form. No group holds more than a leaf or sixteen children, so a
    package of any size is hashed by many tasks, and two packages can be compared branch by branch.
    """
    largest = manifest.groupBy(F.col(by)).count().agg(F.max("count")).first()[0] or 0
    depth = tree_depth(largest)
    entry = F.struct("nombre", "sha256")
    nodes = manifest.groupBy(F.col(by), F.substring(F.sha2("nombre", 256), 1, depth).alias("camino")).agg(
        fingerprint(F.collect_list(entry)).alias("sha256"), F.count("*").alias("entradas"))
    for length in reversed(range(depth)):
        child = F.struct(F.substring("camino", length + 1, 1).alias("nombre"), "sha256")
        nodes = nodes.groupBy(F.col(by), F.substring("camino", 1, length).alias("camino")).agg(
            fingerprint(F.collect_list(child)).alias("sha256"), F.sum("entradas").alias("entradas"))
    return nodes.select(by, "entradas", F.lit(depth).alias("profundidad"), F.col("sha256").alias("raiz_sha256"))


def require_intact(files: DataFrame, manifest: DataFrame) -> None:
    """Raise when a listed file is missing or altered."""
    bad = check_manifest(files, manifest).filter(F.col("estado").isin("falta", "alterado"))
    names = [f"{r['nombre']} ({r['estado']})" for r in bad.orderBy("nombre").take(20)]
    if names:
        raise ValueError(f"altered package, {bad.count()} files: " + ", ".join(names))
