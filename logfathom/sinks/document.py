"""One JSON document of many rows, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.model import keep_filters_above
from logfathom.session import cut_lineage, folder_names, remove_path, scratch_dir, shuffles_dropped

CONCAT = "fs.capability.paths.concat"
IN_PARTITION = (1 << 33) - 1  # the bits of a row's number in its partition


def write_document(rows: DataFrame, path: str, head: str = "[", tail: str = "]", order: list[str] | None = None) -> None:
    """Write ``head``, the texts in ``value`` with commas between, and ``tail``
    as the file ``path``. Rows without a text are left out.

    The rows are written as ordered text parts by tasks; each row but the first
    of its part begins with the comma, so a part needs to know nothing of the
    others. Parts are joined by the file system: without a copy where it can
    concatenate, otherwise they are written compressed and their streams are
    copied one after the other, each part removed when it was copied: the disk
    holds little more than the document. No row passes through Python on the
    driver. ``order`` names columns that put the rows in order; without it they
    come in the order of the input's partitions, and are not moved.
    """
    spark = rows.sparkSession
    keys = list(order or [])
    kept, parts = scratch_dir(spark, "document-rows"), scratch_dir(spark, "document")
    concats = can_concat(spark, path)
    try:
        with shuffles_dropped(spark):
            if keys:  # dealing the rows in ranges reads them twice
                spots = [*keys, "__at"]
                rows = cut_lineage(rows.withColumn("__at", F.monotonically_increasing_id()), "document-rows", kept)
                rows = rows.repartitionByRange(*spots).sortWithinPartitions(*spots)
            rows = keep_filters_above(rows).filter(F.col("value").isNotNull())
            first = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)) == 0
            text = F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), F.col("value"))
            rows.select(text.alias("value")).write.option("compression", "none" if concats else "lz4").text(parts)
        remove_path(spark, kept)
        names = [n for n in folder_names(spark, parts) if n.startswith("part-")]
        names.sort(key=lambda n: (int(n.split("-")[1]), n))
        join_files(spark, [f"{parts}/{n}" for n in names], path, head + "\n", tail + "\n", concats)
    finally:
        remove_path(spark, kept)
        remove_path(spark, parts)


def can_concat(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).hasPathCapability(target, CONCAT)


def join_files(spark, sources: list[str], path: str, head: str, tail: str, concats: bool) -> None:
    """``head``, the files in order with commas between those that are not empty,
    and ``tail`` as one file, put in place by a rename. The files are used up."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    made = at(f"{path}.part")
    fs = made.getFileSystem(conf)

    def put(target, text: str):
        out = fs.create(target, True)
        out.write(text.encode())
        out.close()
        return target

    def concatenated() -> None:
        files = []
        for file in map(at, sources):
            if fs.getFileStatus(file).getLen():
                files += [put(at(f"{file.toString()}.comma"), ","), file] if files else [file]
        files.append(put(at(f"{path}.tail"), tail))
        many = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(files))
        for i, file in enumerate(files):
            many[i] = file
        fs.concat(put(made, head), many)

    def copied() -> None:
        codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
        out, some = fs.create(made, True), False
        out.write(head.encode())
        for file in map(at, sources):
            codec, source = codecs.getCodec(file), fs.open(file)
            source = source if codec is None else codec.createInputStream(source)
            byte = source.read()
            if byte >= 0:
                if some:
                    out.write(b",")
                out.write(byte)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                some = True
            source.close()
            fs.delete(file, False)
        out.write(tail.encode())
        out.close()

    if concats:
        try:
            concatenated()
        except Exception:  # it cannot, for these files
            fs.delete(at(f"{path}.tail"), False)
            copied()
    else:
        copied()
    fs.delete(at(path), False)
    if not fs.rename(made, at(path)):
        raise OSError(f"{path} could not be put in place")
