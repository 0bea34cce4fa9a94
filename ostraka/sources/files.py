"""CSV and JSON lines with a schema, cached tables, hashes of files, reports and manifests."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import JUNK_PATH, canonical_hash

#: Rows a report may have: reports are written from aggregates.
MOST_REPORT_ROWS = 10_000


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a schema; a row that does not fit it stops the job (``operators.rejects`` sets such rows apart instead)."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False, multiLine=True, escape='"')


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written out, so that every line has every key."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table written at ``path``; built and written first if there is none, or none that was written to its end."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256, md5) of the files under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def archive_directory(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, crc): the central directories of the zip files under ``path``; no member is unzipped."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(archive, i.filename, i.file_size, i.CRC) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "crc"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(read, "archive string, member string, size long, crc long")


def directory_summary(directory: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of an archive's directory: (stem, entries, groups) of documents, (stem, entries) of those that stand several times, (extension, members) of all members."""
    name = F.col("member")
    docs = directory.where(name.rlike(r"\.xml$") & ~name.rlike(JUNK_PATH)).select(F.regexp_extract(name, r"([^/]+)\.xml$", 1).alias("stem"), F.regexp_extract(name, r"CTH (\d+)_XML/", 1).alias("g"))
    stems = docs.groupBy("stem").agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_set("g")).alias("groups"))
    kinds = directory.groupBy(F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).alias("extension")).agg(F.count(F.lit(1)).alias("members"))
    return stems, stems.where("entries > 1").select("stem", "entries"), kinds


def report(rows: DataFrame, title: str) -> str:
    """A small table as Markdown; a table that is no aggregate is refused."""
    found = rows.limit(MOST_REPORT_ROWS + 1).collect()
    if len(found) > MOST_REPORT_ROWS:
        raise ValueError(f"a report has at most {MOST_REPORT_ROWS} rows")
    cells = [rows.columns, ["---"] * len(rows.columns), *[["" if v is None else str(v).replace("|", "\\|") for v in r] for r in found]]
    return f"# {title}\n\n" + "\n".join("| " + " | ".join(c) + " |" for c in cells) + "\n"


def manifest(fields: DataFrame, inputs: DataFrame, policy: str) -> dict:
    """Share of each evidence class among ``fields`` (field, effective), the hashes of ``inputs`` (path, sha256), the policy and a hash of all this."""
    classes = {r.effective: r.n for r in fields.groupBy("effective").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(classes.values())
    body = {
        "policy": policy, "fields": total, "classes": {k: {"count": n, "share": round(n / total, 6)} for k, n in sorted(classes.items())},
        "inputs": {r.path: r.sha256 for r in inputs.select("path", "sha256").orderBy("path").limit(MOST_REPORT_ROWS).collect()}}
    return {**body, "sha256": canonical_hash(body)}


def write_json(value: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, ensure_ascii=False, indent=1)


def catalogue_titles(html: Column) -> Column:
    """(number, title) of each entry of a catalogue page: the number in an anchor, the text up to the next tag as its title."""
    entry = r"<a[^>]*> ?CTH ([0-9.]+) ?</a>(?:</span>)?\s*([^<]*)"
    numbers, titles = F.regexp_extract_all(html, F.lit(entry), 1), F.regexp_extract_all(html, F.lit(entry), 2)
    return F.zip_with(numbers, titles, lambda n, t: F.struct(n.alias("number"), F.trim(t).alias("title")))
