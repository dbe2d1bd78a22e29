"""Document files: Markdown and text whole, JSON lists or ``{"documents": [...]}``, and JSON lines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a kind that warnings name.
MOST_WARNINGS = 100
_DOC = "struct<text: string, source: string, metadata: string>"


def read_documents(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(``text``, ``source``, ``metadata``; warnings). A file of another kind, missing or broken is a warning and no failure."""
    warnings, kinds = [], {"text": [], "json": [], "jsonl": []}
    for path in paths:
        suffix = os.path.splitext(path)[1].lower()
        kind = {".md": "text", ".txt": "text", ".json": "json", ".jsonl": "jsonl"}.get(suffix)
        local = "://" not in path
        if kind is None:
            warnings.append(f"{path}: unsupported kind {suffix or 'of file'}")
        elif local and not os.path.exists(path):
            warnings.append(f"{path}: not found")
        else:
            kinds[kind].append(path)
    out = spark.createDataFrame([], "text string, source string, metadata string")
    if kinds["text"]:
        out = out.unionByName(spark.read.text(kinds["text"], wholetext=True).select(F.col("value").alias("text"), F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("source"), F.lit(None).cast("string").alias("metadata")))
    if kinds["json"]:
        whole = spark.read.text(kinds["json"], wholetext=True).withColumn("file", F.col("_metadata.file_path"))
        # an object read as a list would be its only element
        listed = F.from_json("value", f"array<{_DOC}>")
        docs = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.from_json("value", f"struct<documents: array<{_DOC}>>")["documents"])
        read = whole.select("file", docs.alias("docs"))
        warnings += [f"{r['file']}: not a list of documents" for r in read.where("docs IS NULL").select("file").orderBy("file").limit(MOST_WARNINGS).collect()]
        out = out.unionByName(read.where("docs IS NOT NULL").select(F.explode("docs").alias("d")).select("d.text", "d.source", "d.metadata"))
    if kinds["jsonl"]:
        lines = spark.read.text(kinds["jsonl"]).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.from_json("value", _DOC).alias("d"))
        broken = lines.where("d.text IS NULL").groupBy("file").count()
        warnings += [f"{r['file']}: {r['count']} lines are no documents" for r in broken.orderBy("file").limit(MOST_WARNINGS).collect()]
        out = out.unionByName(lines.where("d.text IS NOT NULL").select("d.text", "d.source", "d.metadata"))
    return out, warnings
