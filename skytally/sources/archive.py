"""Archives and file manifests."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.functions.columns import manifest_role


def safe_member(name: str, is_file: bool) -> bool:
    """A plain file inside the archive's own tree."""
    parts = name.replace("\\", "/").split("/")
    return is_file and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]


def observation_member(names: list[tuple[str, bool]]) -> str | None:
    """The last hourly text member; any unsafe member spoils the archive."""
    if any(not safe_member(n, f) for n, f in names):
        raise ValueError("unsafe member")
    hourly = [n for n, _ in names if n.lower().endswith("_hourly.txt")]
    return hourly[-1] if hourly else None


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    members = [m for m in tar.getmembers() if not m.isdir()]
                    name = observation_member([(m.name, m.isfile()) for m in members])
                    if name is None:
                        rows.append((path, None, None, None, "no hourly member"))
                        continue
                    with tar.extractfile(name) as f:
                        for k, line in enumerate(io.TextIOWrapper(f, "utf-8", "replace")):
                            rows.append((path, name, k + 1, line.rstrip("\r\n"), None))
            except (tarfile.TarError, ValueError, EOFError, OSError) as e:
                rows.append((path, None, None, None, str(e) or type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "member", "line_no", "text", "problem"])


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the observation member of every archive under ``path``: (path, member, line_no, text, problem).

    One archive is one row of one task, as its format has no index to split by.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar.gz").load(path)
    return files.select("path", "content").mapInPandas(_open, "path string, member string, line_no long, text string, problem string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, role) of every file under ``path``."""
    root = "file:" + path.rstrip("/") + "/" if path.startswith("/") else path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.regexp_replace(F.replace("path", F.lit(root), F.lit("")), "^/+", "")
    return files.select(inner.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).withColumn("role", manifest_role(F.col("path")))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed against (path, sha256); hashes compare without case."""
    e = expected.select("path", F.lower("sha256").alias("_want"))
    j = found.select("path", F.lower("sha256").alias("_have")).join(e, "path", "full")
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_have") != F.col("_want"), "changed")
    return j.select("path", state.alias("state")).where("state is not null")
