"""A log of replies, so that no batch is paid for twice.

A model call costs money, a Spark task may run again. Each batch of rows is known by a digest of its content; its reply is
written with that digest the moment it is there, by the task that asked. A job that starts again, a retried
task or another table with the same rows finds it there. ``fold_replies`` gathers the files into Parquet, which later jobs join.

A file per batch would make as many files as batches. Batches whose digests start alike are asked one after the other by one task, which first
reads what the log has of them and then adds a line per reply to one file: files grow with runs, not with batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteworks.sources.tables import path_exists


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as Python workers reach it."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


#: Digits of a digest that name its group, whose replies one task adds to one file.
GROUP_DIGITS = 3
#: File systems that show what is written before the file is closed; others get a file per reply.
APPENDING = ("local", "hdfs")


def _logged(files: fs.FileSystem, root: str, group: str) -> dict[str, str]:
    """Replies of a group by digest, from files with a line per reply or, as they once were, a file per reply."""
    known = {}
    for info in files.get_file_info(fs.FileSelector(f"{root}/new/{group[:2]}", allow_not_found=True)):
        if not info.base_name.startswith(group) or not info.base_name.endswith((".json", ".jsonl")):
            continue
        with files.open_input_stream(info.path) as held:
            text = held.read().decode(errors="replace")
        if info.base_name.endswith(".json"):
            known[info.base_name[:-5]] = text
            continue
        for line in text.split("\n")[:-1]:  # what a lost task left unfinished has no end of line
            told = json.loads(line)
            known[told["digest"]] = told["reply"]
    return known


def _ask(scorer: Callable[[pd.DataFrame], pd.DataFrame], log: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _files(log)
        group, known, out = None, {}, None
        try:
            for frame in frames:
                replies = []
                for digest, content in zip(frame["digest"], frame["content"], strict=True):
                    if digest[:GROUP_DIGITS] != group:
                        group = digest[:GROUP_DIGITS]
                        known = _logged(files, root, group)
                        if out is not None:
                            out.close()
                            out = None
                    if digest not in known:
                        known[digest] = scorer(pd.DataFrame(json.loads(content))).to_json(orient="records")
                        if out is None:
                            files.create_dir(f"{root}/new/{group[:2]}", recursive=True)
                            out = files.open_output_stream(f"{root}/new/{group[:2]}/{group}-{uuid.uuid4().hex}.jsonl")
                        out.write(json.dumps({"digest": digest, "reply": known[digest]}).encode() + b"\n")
                        out.flush()
                        if files.type_name not in APPENDING:
                            out.close()
                            out = None
                    replies.append(known[digest])
                yield pd.DataFrame({"digest": frame["digest"], "reply": replies})
        finally:
            if out is not None:
                out.close()

    return run


def batch_contents(batched: DataFrame, columns: Sequence[str], batch: str = "batch", version: str = "") -> DataFrame:
    """``digest, content``: each batch's rows as a JSON list in the order of their columns; equal batches are one.

    ``version`` names the prompt and model: another one is another question. A batch has as many rows as one request holds.
    """
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    content = F.to_json(rows, {"ignoreNullFields": "false"})
    made = batched.groupBy(batch).agg(content.alias("content"))
    return made.select(F.sha2(F.concat(F.lit(version), F.lit("\n"), F.col("content")), 256).alias("digest"), "content").dropDuplicates(["digest"])


def folded_replies(spark: SparkSession, log: str) -> DataFrame:
    """``digest, reply`` of the gathered part of a log."""
    if not path_exists(spark, f"{log}/folded"):
        return spark.createDataFrame([], "digest string, reply string")
    return spark.read.schema("digest string, reply string").parquet(f"{log}/folded")


def enrich_logged(
    batched: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: Sequence[str], log: str, batch: str = "batch", version: str = ""
) -> DataFrame:
    """Rows (``schema``) that a user's scorer makes of each batch; batches whose reply the log has are not asked again.

    ``log`` is a folder that all executors reach. The scorer gets a frame of ``columns`` as JSON values (dates as text) and
    is called once per distinct batch, however often the job starts; a call that fails leaves nothing.
    """
    spark = batched.sparkSession
    asked = batch_contents(batched, columns, batch, version)
    known = folded_replies(spark, log).dropDuplicates(["digest"])
    told = asked.join(known, "digest").select("digest", "reply")
    open_ = asked.join(known, "digest", "left_anti")
    # One task per batch would start a worker for each; the session's partitions share the groups out. By the digest itself they would be
    # partitioned as the join leaves them, and adaptive execution merges those: few bytes, but each row is a call.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = open_.repartition(parts, F.substring("digest", 1, GROUP_DIGITS)).sortWithinPartitions("digest")
    new = shared.mapInPandas(_ask(scorer, log), "digest string, reply string")
    return told.unionByName(new).select(F.inline(F.from_json("reply", f"array<struct<{', '.join(_fields(schema))}>>")))


def _fields(schema: str) -> list[str]:
    """``a int, b string`` as fields of a struct."""
    return [":".join(part.strip().split(" ", 1)) for part in schema.split(",")]


def fold_replies(spark: SparkSession, log: str) -> None:
    """Gather the files of replies into Parquet, then remove them. Not while a job writes to the log."""
    if not path_exists(spark, f"{log}/new"):
        return
    # Files with a line per reply, and a file per reply, as they once were; a line that a lost task left unfinished is none.
    lines = spark.read.option("pathGlobFilter", "*.{json,jsonl}").option("recursiveFileLookup", "true").option("lineSep", "\n").text(f"{log}/new")
    named = F.regexp_extract(F.input_file_name(), r"([0-9a-f]{64})\.json$", 1)
    told = F.from_json("value", "digest string, reply string")
    single = lines.select(named.alias("named"), "value", told.alias("told")).select(
        F.when(F.col("named") != "", F.col("named")).otherwise(F.col("told.digest")).alias("digest"),
        F.when(F.col("named") != "", F.col("value")).otherwise(F.col("told.reply")).alias("reply"),
    )
    single.where("digest is not null and reply is not null").write.mode("append").parquet(f"{log}/folded")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/new")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
