"""Source trees as DataFrames: path (relative) and text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N


#: Endings of the files that have a language.
ENDINGS = "java ts tsx js jsx py cbl cob cpy dcl jcl proc bms".split()


def _roots(spark: SparkSession, base: str, include: list[str] | None) -> list[str]:
    """The roots that exist, without those inside another one: no file is listed twice."""
    found: list[str] = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in sorted({f"{base}/{i}".rstrip("/") for i in include or [""]}):
        path = jvm.org.apache.hadoop.fs.Path(root)
        if not any(root == r or root.startswith(r + "/") for r in found) and path.getFileSystem(conf).exists(path):
            found.append(root)
    return found


def source_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, endings: list[str] | None = None) -> DataFrame:
    """Every source file below the roots once: path relative to ``root``, language and whole text.

    Roots that don't exist are passed over. Only files with a known ending (or one of ``endings``, whatever their language)
    are opened; excluded ones are dropped by path.
    """
    base = root.rstrip("/")
    roots = _roots(spark, base, include)
    if not roots:
        return spark.createDataFrame([], "path string, language string, text string")
    globs = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in endings or ENDINGS)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{globs}}}").load(roots).select("path", "content")
    relative = F.regexp_replace("path", "^(file:)?/*" + re.escape(base.lstrip("/")) + "/", "")
    out = listed.select(relative.alias("path"), "content").withColumn("language", N.language_of(F.col("path")))
    if not endings:
        out = out.where("language IS NOT NULL")
    if exclude:
        out = out.where(~N.excluded(F.col("path"), exclude))
    return out.select("path", "language", F.col("content").cast("string").alias("text"))


def braces(pattern: str) -> list[str]:
    """A glob with {a,b} as the globs it stands for."""
    m = re.fullmatch(r"([^{}]*)\{([^{}]*)\}(.*)", pattern)
    return [m[1] + choice + rest for choice in m[2].split(",") for rest in braces(m[3])] if m else [pattern]


def matching(files: DataFrame, globs: list[str]) -> DataFrame:
    """The files whose path matches one of the globs (``**/`` also stands for no folder), in order."""
    wide = [g for p in globs for b in braces(p) for g in {b.replace("**/", "*"), b.replace("**/", "")}]
    return files.where(N.matches_any(F.col("path"), wide)).orderBy("path")


def specs(files: DataFrame) -> DataFrame:
    """OpenAPI documents among files, vendored ones aside."""
    return files.where(F.lower("path").rlike(r"(^|/)((openapi|swagger|api)\.(json|ya?ml)|api-docs\.json|[^/]*\.openapi\.json)$") & ~F.col("path").rlike("(^|/)(node_modules|vendor|target|build|dist|\\.git)/"))
