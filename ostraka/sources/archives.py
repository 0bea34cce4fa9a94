"""Archives of XML documents, JSON lines behind a gate, and canonical hashes."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Members an archive holds besides documents.
JUNK = ("__MACOSX", "._")
#: The same as a pattern of a member's path.
JUNK_PATH = r"(?:^|/)(?:__MACOSX|\._)"


def is_document(name: str) -> bool:
    return name.endswith(".xml") and not any(part.startswith(JUNK) for part in name.split("/"))


def xml_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, payload): XML members of the zip files under ``path``, one task an archive."""

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and is_document(info.filename):
                            yield pd.DataFrame({"archive": [archive], "member": [info.filename], "size": [info.file_size], "payload": [z.read(info)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(unzip, "archive string, member string, size long, payload binary")


def xml_events(members: DataFrame) -> DataFrame:
    """(member, pos, event, tag, text, error): start, text and end events in document order; a document that fails gives one row with its error."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def events(node):
            yield "start", node.tag, None
            if node.text:
                yield "text", None, node.text
            for child in node:
                yield from events(child)
                if child.tail:
                    yield "text", None, child.tail
            yield "end", node.tag, None

        for frame in frames:
            for member, payload in zip(frame["member"], frame["payload"]):
                try:
                    rows = [(member, i, *e, None) for i, e in enumerate(events(ElementTree.fromstring(payload)))]
                except ElementTree.ParseError as error:
                    rows = [(member, 0, None, None, None, str(error))]
                yield pd.DataFrame(rows, columns=["member", "pos", "event", "tag", "text", "error"])

    return members.select("member", "payload").mapInPandas(walk, "member string, pos long, event string, tag string, text string, error string")


def archive_index(members: DataFrame) -> DataFrame:
    """(stem, entries, groups): members by stem with their composition folders. ``files.archive_directory`` lists members without unzipping them."""
    stem, group = F.regexp_extract("member", r"([^/]+)\.xml$", 1), F.regexp_extract("member", r"CTH (\d+)_XML/", 1)
    return members.select(stem.alias("stem"), group.alias("g")).groupBy("stem").agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_set("g")).alias("groups"))


def gated_json(spark: SparkSession, path: str, allowed: DataFrame, schema: str, key: str, tail: str | None = None) -> DataFrame:
    """JSON lines whose leading ``key`` is allowed, decoded only after the gate.

    The key is cut from the raw line and joined with ``allowed`` first; the large field ``tail``
    is cut off the raw text. Decoding depends on a column the join makes, so no plan can decode
    a blocked line. Lines that do not begin with the key are an error.
    """
    lead = rf'^\{{"{key}": ?"([^"]*)"'
    raw = spark.read.text(path).where("trim(value) <> ''")
    keyed = raw.select("value", F.regexp_extract("value", lead, 1).alias("k"), F.col("value").rlike(lead).alias("ok"))
    checked = keyed.where(F.when(F.col("ok"), True).otherwise(F.raise_error(F.lit(f"a line does not begin with {key}")).cast("boolean")))
    passed = checked.join(allowed.select(F.col(key).alias("k"), F.lit(1).alias("gate")).distinct(), "k")
    text = F.regexp_replace("value", rf', ?"{tail}":.*$', "}") if tail else F.col("value")
    return passed.select(F.from_json(F.when(F.col("gate") == 1, text), schema).alias("row")).select("row.*")


def key_order_faults(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, line, previous, found): lines whose leading ``key`` is missing or smaller than that of the line before; only keys are read off the raw lines, nothing is decoded."""
    raw = spark.read.text(path).where("trim(value) <> ''").select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start")).alias("block"), F.monotonically_increasing_id().alias("line"),
        F.nullif(F.regexp_extract("value", rf'^\{{"{key}": ?"([^"]*)"', 1), F.lit("")).alias("found"))
    w = Window.partitionBy("file").orderBy("block", "line")
    seen = raw.withColumn("previous", F.lag("found").over(w))
    return seen.where("found is null or found < previous").select("file", "line", "previous", "found")


def canonical_hash(value) -> str:
    """SHA-256 of the canonical JSON of a value: sorted keys, no blanks, UTF-8."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
