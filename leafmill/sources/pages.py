"""Reading pages: file discovery, page tables, and a hook for a caller's file parser."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.session import materialize

PAGES = "source string, page int, total_pages int, file_path string, page_content string"


def discover_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """path, length, modificationTime of the regular files of a folder with the suffix in either case, by
    path; not recursive. File contents are not read. Raises ValueError if there is none."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{either}").load(folder)
    found = files.select("path", "length", "modificationTime").orderBy("path")
    if found.isEmpty():
        raise ValueError(f"no .{suffix} files in {folder}")
    return found


def load_pages(spark: SparkSession, paths: str | Iterable[str], fmt: str = "parquet", schema: str = PAGES) -> DataFrame:
    """Many files as one page table. JSON is read permissively: a bad row has null fields and its text in
    ``_corrupt_record``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "json":
        return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(paths)
    return spark.read.format(fmt).load(paths)


def parse_files(files: DataFrame, parser: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """Pages of binary files (path, content) by a caller's ``parser(path, content)``, which returns dicts
    with page and page_content. A file that fails gives one row with its ``error`` and no page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    pages = list(parser(path, content))
                    said = [None if p["page_content"] is None else str(p["page_content"]) for p in pages]
                    rows += [(name, int(p["page"]), len(pages), path, t, None) for p, t in zip(pages, said, strict=True)]
                except Exception as e:  # noqa: BLE001  a bad file must not stop the batch
                    rows.append((name, None, None, path, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            names = ["source", "page", "total_pages", "file_path", "page_content", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, f"{PAGES}, error string")


def parsed_files(files: DataFrame, parser: Callable[[str, bytes], list[dict]]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Pages, quarantined files (file_path, error) and counts of ``parse_files``. Every file is parsed once: the result is
    written, and ``files``, ``pages`` and ``failed`` are counted as it is. A file of no pages is in neither table."""
    came, went = Observation("came"), Observation("went")
    bad = F.col("error").isNotNull()
    parsed = parse_files(files.observe(came, F.count(F.lit(1)).alias("files")), parser)
    whole = materialize(parsed.observe(went, F.count_if(~bad).alias("pages"), F.count_if(bad).alias("failed")), "parsed")
    return whole.where(~bad).drop("error"), whole.where(bad).select("file_path", "error"), came.get | went.get


def attach_doc_id(pages: DataFrame, source_key: str = "source") -> DataFrame:
    """Adds a stable doc_id made from the source's name (or, with ``file_path``, its whole path)."""
    return pages.withColumn("doc_id", T.attach_doc_id(F.col(source_key)))
