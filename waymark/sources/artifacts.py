"""Readers of evaluation artifacts and writers of tidy tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from graphlib import CycleError, TopologicalSorter
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.functions import normalize as N

_FINDING = "struct<rule_id:string,scope:string,location:struct<file:string,path:string,file_path:string,line:int,column:int>,message:string,evidence:struct<source_tool:string,source_rule_id:string,payload:map<string,string>>>"
_METRIC = "struct<name:string,version:string,status:string,score:string,direction:string>"
_DELTA = f"struct<constraints:struct<before_count:int,after_count:int,introduced_count:int,resolved_count:int,unchanged_count:int,net_change:int,introduced:array<{_FINDING}>,resolved:array<{_FINDING}>>,metrics:array<struct<key:string,name:string,scope:string,`from`:double,`to`:double,delta:double,direction:string,status:string>>>"

#: Schemas of the artifacts as DDL; evaluation documents are of version 0.3.0
EVALUATION = (
    "schema_version string, evaluation_profile_hash string, run_id string, trajectory_id string, task_id string, rulepack_id string, target struct<workspace_path:string,pre_commit:string,post_commit:string,baseline_commit:string>, "
    f"scopes array<struct<scope_id:string,scope_type:string,status:string,layers:struct<constraints:struct<status:string,rules_evaluated:int,findings:array<{_FINDING}>>,metrics:array<{_METRIC}>>>>, "
    f"deltas struct<run_local:{_DELTA},trajectory_cumulative:{_DELTA}>, duration_ms long, execution_status string, comparison_status string"
)
EXECUTION = (
    "metrics struct<agent:string,model:string,run_id:string,status:string,exit_code:int,completion_marker_found:boolean,agent_reported_error:boolean,started_at:string,finished_at:string,duration_seconds:double,num_turns:int,total_cost_usd:double,"
    "usage:struct<input_tokens:long,cached_input_tokens:long,cache_read_input_tokens:long,cache_write_input_tokens:long,cache_creation_input_tokens:long,output_tokens:long,reasoning_output_tokens:long>>"
)
TEST_RESULT = (
    "run_id string, task_id string, status string, reason string, started_at string, completed_at string, adapter_version string, adapter struct<version:string,unresolved:array<struct<suite_id:string,kind:string,semantic_target:string,attempted:string>>>, "
    "suites array<struct<suite_id:string,status:string,reason:string,outcome:string,total:long,passed:long,failed:long,failed_ids:array<string>,failure_classifications:array<struct<id:string,classification:string,automatic:boolean,review_required:boolean>>>>"
)
TEST_EXECUTION = (
    "run_id string, task_id string, db struct<status:string>, suites array<struct<suite_id:string,status:string,reason:string,install:struct<exit_code:int,stdout:string,stderr:string>,test:struct<exit_code:int,stdout:string,stderr:string>,"
    "summary:struct<total:long,passed:long,failed:long,failed_details:array<struct<id:string,failure_messages:array<string>>>>>>"
)


#: Tasks that write or read artifacts; folders of so many shards keep every listing short.
TASKS, SHARDS = 256, 1024


def shard(session: Column) -> Column:
    """The folder that a session lies in where there are too many for one."""
    return F.concat(F.lit("shard-"), F.pmod(F.crc32(session.cast("binary")), F.lit(SHARDS)))


def write_artifacts(artifacts: DataFrame, folder: str) -> int:
    """Writes rows (path, text) as one file each below `folder`, a URI that driver and executors share; how many there are.

    Paths are the rows' own, so a task that runs again writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = artifacts.select("path", "text").repartition(TASKS, "path").mapInArrow(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """(value, path) of the files that a glob names, listed and read in tasks; the driver sees no file's name, however many there are.

    One task lists the first folder with a wildcard; what it finds is dealt out, and each task walks on from there, a
    folder at a time. So sessions are best laid out in shards, and named by `folder/*`. Names that start with a dot or underscore are left out.
    """
    steps = re.split(r"/(?=[^/]*[*?\[])", glob, maxsplit=1)
    home, inner = steps[0], steps[1].split("/") if len(steps) > 1 else []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    root = re.sub("^file:/(?!/)", "file:///", at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())

    def found(fs: pafs.FileSystem, path: str, names: list[str]) -> Iterator[str]:
        if not names:
            yield path
            return
        name, *rest = names
        wild = any(c in name for c in "*?[")
        infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if wild else [fs.get_file_info(f"{path}/{name}")]
        for info in infos:
            own = info.path.rpartition("/")[2]
            if info.type == (pafs.FileType.Directory if rest else pafs.FileType.File) and (not wild or (fnmatchcase(own, name) and not own.startswith((".", "_")))):
                yield from found(fs, info.path, rest)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for _ in (row for batch in batches for row in range(batch.num_rows)):
            infos = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if inner else [fs.get_file_info(base)]
            kind = pafs.FileType.Directory if len(inner) > 1 else pafs.FileType.File
            names = [i.path for i in infos if i.type == kind and (not inner or (fnmatchcase(i.base_name, inner[0]) and not i.base_name.startswith((".", "_"))))]
            for k in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 10_000], pa.string())], names=["at"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        head, texts, paths, size = root.removesuffix(base).replace("file://", "file:"), [], [], 0
        for place in (p for batch in batches for p in batch.column(0).to_pylist()):
            for path in found(fs, place, inner[1:]):
                with fs.open_input_stream(path) as file:
                    data = file.read()
                if not data:  # Spark's text reader has no row for an empty file either
                    continue
                texts.append(data.decode("utf-8", "replace"))
                paths.append(head + quote(path, safe="/!$&'()*+,;=:@~"))
                size += len(data)
                if len(texts) == 1000 or size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(paths, pa.string())], names=["value", "path"])
                    texts, paths, size = [], [], 0
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(paths, pa.string())], names=["value", "path"])

    return spark.range(0, 1, 1, 1).mapInArrow(listed, "at string").repartition(TASKS).mapInArrow(read, "value string, path string")


def read_artifacts(spark: SparkSession, globs: list[str], ddl: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON artifacts, one a file: session_id and task_id come from the path.

    A malformed file is a reject (path, text), never a failure; a path that does not exist gives no rows.
    """
    schema = StructType.fromDDL(ddl)
    known = StructType([*schema.fields]).add("_corrupt_record", "string")
    out = spark.createDataFrame([], StructType([*known.fields]).add("path", "string"))
    for glob in globs:
        text = read_texts(spark, glob)
        parsed = F.from_json("value", known, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        out = out.unionByName(text.select("path", parsed.alias("j")).select("j.*", "path"))
    session = N._blank_to_null(F.regexp_extract("path", r"/([^/]+)/(?:T\d+|Base)/", 1))
    task = N._blank_to_null(F.regexp_extract("path", r"/(T\d+|Base)/", 1))
    if "task_id" in schema.names:
        out = out.drop("task_id")
    named = out.withColumns({"session_id": F.coalesce(session, F.lit("baseline")), "task_id": F.coalesce(task, F.lit("Base"))})
    good = named.where("_corrupt_record is null").drop("_corrupt_record")
    return good, named.where("_corrupt_record is not null").select("path", F.col("_corrupt_record").alias("text"))


def read_evaluations(spark: SparkSession, sessions: str, baseline: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Evaluations below the sessions' folder and of the baseline, with evaluation_id and task_order."""
    rows, rejects = read_artifacts(spark, [f"{sessions}/*/*/harness_evaluation.json", *([f"{baseline}/harness_evaluation.json"] if baseline else [])], EVALUATION)
    return rows.withColumns({"evaluation_id": F.concat_ws("/", "session_id", "task_id"), "task_order": N.task_order(F.col("task_id"))}), rejects


def read_executions(spark: SparkSession, sessions: str) -> tuple[DataFrame, DataFrame]:
    return read_artifacts(spark, [f"{sessions}/*/*/execution.json"], EXECUTION)


def read_test_results(spark: SparkSession, sessions: str) -> tuple[DataFrame, DataFrame]:
    """Results of the task and of its acceptance reruns."""
    return read_artifacts(spark, [f"{sessions}/*/*/test_result.json", f"{sessions}/*/*/acceptance_runs/*/test_result.json"], TEST_RESULT)


def read_test_executions(spark: SparkSession, sessions: str) -> tuple[DataFrame, DataFrame]:
    return read_artifacts(spark, [f"{sessions}/*/*/test_execution.json", f"{sessions}/*/*/acceptance_runs/*/test_execution.json"], TEST_EXECUTION)


def read_session_config(spark: SparkSession, sessions: str) -> DataFrame:
    """session_id, agent, strategy, model, created_at from flat YAML manifests."""
    text = read_texts(spark, f"{sessions}/*/session_manifest.yaml")
    value = lambda k, indent: N._blank_to_null(F.trim(F.regexp_replace(F.regexp_extract("value", rf"(?m)^{indent}{k}:[ \t]*([^\n#]*)", 1), "^['\"]|['\"]\\s*$", "")))
    return text.select(F.regexp_extract("path", "/([^/]+)/session_manifest.yaml$", 1).alias("session_id"), *[value(k, r"\s+").alias(k) for k in ("agent", "strategy", "model")], value("created_at", "").alias("created_at"))


def read_reviews(spark: SparkSession, sessions: str, task: str = "T4") -> DataFrame:
    """session_id, text of reviews whose task has a manifest."""
    read = lambda name: read_texts(spark, f"{sessions}/*/{task}/{name}").select("value", F.regexp_extract("path", rf"/([^/]+)/{task}/", 1).alias("session_id"))
    manifests = read("task_manifest.yaml").select("session_id", *[N._blank_to_null(F.regexp_extract("value", rf"(?m)^\s*{k}:[ \t]*['\"]?([^'\"\n]*)", 1)).alias(k) for k in ("reviewed_from_tag", "reviewed_commit")])
    return read("review.md").withColumnRenamed("value", "text").join(manifests, "session_id")


# The fields of a review finding and the markers in a review
REVIEW_FIELDS = ["severity", "location", "issue", "impact", "recommended_improvement"]
NO_ISSUES, COMPLETED = "NO_ARCHITECTURE_CONSISTENCY_ISSUES_FOUND", "[TASK_COMPLETED]"


_BULLET = r"^-\s*[`*_]*(" + "|".join(REVIEW_FIELDS) + r")[`*_]*\s*:\s*(.*)"


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def parse_reviews(reviews: DataFrame, text: str = "text") -> DataFrame:
    """reviews with review_status and findings (an array): a table's if there is one, else bullets'.

    A table needs all fields in its header and a separator row. Among bullets a severity, or the
    first field, opens a finding, and the last of a repeated field counts. Steps are columns of
    their own, so that no step is evaluated again for every element of the next.
    """
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(COMPLETED), F.lit(""))
    df = reviews.withColumn("__lines", F.transform(F.split(body, r"\r\n|\n|\r"), lambda x: F.trim(x)))
    df = df.withColumns({"__rows": F.filter("__lines", lambda x: F.startswith(x, F.lit("|"))), "__bullets": F.filter("__lines", lambda x: x.rlike(_BULLET))})
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, _BULLET, 2)), "^`([^`]*)`$", "$1")
    df = df.withColumns({
        "__header": F.transform(_cells(F.coalesce(F.get("__rows", F.lit(0)), F.lit(""))), lambda c: F.lower(F.regexp_replace(c, "^`+|`+$", ""))),
        "__body": F.transform(F.slice("__rows", F.lit(3), F.greatest(F.size("__rows") - 2, F.lit(0))), _cells),
        "__fields": F.transform("__bullets", lambda x: F.struct(F.regexp_extract(x, _BULLET, 1).alias("f"), value(x).alias("v"))),
    })
    whole = (F.size("__rows") >= 3) & (F.size(F.array_intersect("__header", F.array(*[F.lit(f) for f in REVIEW_FIELDS]))) == len(REVIEW_FIELDS))
    df = df.withColumns({
        "__places": F.array(*[(F.array_position("__header", f) - 1).cast("int") for f in REVIEW_FIELDS]),
        "__body": F.when(whole, F.filter("__body", lambda c: F.size(c) == F.size("__header"))),
        "__starts": F.filter(F.transform("__fields", lambda x, i: F.when((x["f"] == "severity") | (i == 0), i)), lambda i: i.isNotNull()),
    })
    one = lambda i, j: F.slice("__fields", i + 1, F.coalesce(F.get("__starts", j + 1), F.size("__fields")) - i)
    last = lambda b, f: F.coalesce(F.get(F.reverse(F.transform(F.filter(b, lambda x: x["f"] == f), lambda x: x["v"])), F.lit(0)), F.lit(""))
    df = df.withColumns({
        "__blocks": F.transform("__starts", one),
        "__table": F.transform("__body", lambda c: F.struct(*[F.get(c, F.get("__places", F.lit(k))).alias(f) for k, f in enumerate(REVIEW_FIELDS)])),
    })
    bullets = F.transform("__blocks", lambda b: F.struct(*[last(b, f).alias(f) for f in REVIEW_FIELDS]))
    clean = F.contains(body, F.lit(NO_ISSUES))
    df = df.withColumn("findings", F.when(clean, F.slice(bullets, 1, 0)).when(F.coalesce(F.size("__table") > 0, F.lit(False)), F.col("__table")).otherwise(bullets))
    status = F.when(clean, "no_issues_found").when(F.size("findings") > 0, "issues_found").otherwise("parse_incomplete")
    return df.withColumn("review_status", status).drop(*[c for c in df.columns if c.startswith("__")])


def build_reviews(parsed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs, findings): a row by review, with none too, and a row by finding with the files it names."""
    runs = parsed.select(*keys, "review_status", F.size("findings").alias("n_findings"))
    rows = parsed.select(*keys, F.inline("findings"))
    return runs, rows.withColumn("referenced_files", F.array_join(N.referenced_files(F.col("location")), ";"))


def write_table(df: DataFrame, path: str, schema: StructType, form: str = "parquet") -> None:
    """Writes exactly the schema's columns and types; an empty frame keeps its header."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    (typed.coalesce(1).write.option("header", True) if form == "csv" else typed.write).mode("overwrite").format(form).save(path)


@dataclass(frozen=True)
class Job:
    """A job of a refresh: what it reads and writes (paths), and how. version: changes when its code does."""

    name: str
    inputs: Sequence[str]
    outputs: Sequence[str]
    run: Callable[[], None]
    version: str = ""


def in_order(jobs: Sequence[Job]) -> list[Job]:
    """The jobs, each after those whose outputs it reads; among others by name. Two writers of a path, or a circle, are an error."""
    writer: dict[str, Job] = {}
    for job in jobs:
        for path in job.outputs:
            if path in writer:
                raise ValueError(f"{path} is written by {writer[path].name} and by {job.name}")
            writer[path] = job
    graph = {job.name: {writer[p].name for p in job.inputs if p in writer} for job in jobs}
    if len(graph) < len(jobs):
        raise ValueError("jobs need names of their own")
    by_name, sorter, out = {job.name: job for job in jobs}, TopologicalSorter(graph), []
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"jobs wait for each other: {' > '.join(e.args[1])}") from e
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += [by_name[n] for n in ready]
        sorter.done(*ready)
    return out


def fingerprint(spark: SparkSession, path: str) -> str | None:
    """A hash of the files below a path, by name, length and time of change; None if there is nothing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith((".", "_")):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def refresh(spark: SparkSession, jobs: Sequence[Job], manifest: str) -> list[str]:
    """Runs the jobs in the order of what they read and write, but only those that must, and names them.

    A job must run if its version, one of its inputs or one of its outputs isn't as the manifest has it from its last run.
    The manifest, JSON lines with a line for each job, is written again after every run, so a failed refresh goes on where it stopped; the
    failure names its job. An input that isn't there is an error.
    """
    known = {}
    if fingerprint(spark, manifest) is not None:
        known = {r.job: r.state for r in spark.read.schema("job string, state string").json(manifest).collect()}
    done = []
    for job in in_order(jobs):
        state = _state(spark, job)
        missing = [p for p in job.inputs if state["inputs"][p] is None]
        if missing:
            raise RuntimeError(f"{job.name} lacks {', '.join(missing)} after {', '.join(done) or 'nothing'}")
        if known.get(job.name) == json.dumps(state, sort_keys=True) and None not in state["outputs"].values():
            continue
        try:
            job.run()
        except Exception as e:
            raise RuntimeError(f"{job.name} failed after {', '.join(done) or 'nothing'}") from e
        known[job.name] = json.dumps(_state(spark, job), sort_keys=True)
        done.append(job.name)
        spark.createDataFrame(sorted(known.items()), "job string, state string").coalesce(1).write.mode("overwrite").json(manifest)  # as many rows as jobs
    return done


def _state(spark: SparkSession, job: Job) -> dict:
    return {"version": job.version, "inputs": {p: fingerprint(spark, p) for p in job.inputs}, "outputs": {p: fingerprint(spark, p) for p in job.outputs}}


def run_all(jobs: list[tuple[str, Callable[[], None]]]) -> list[str]:
    """Runs jobs in order; the first failure stops the rest and names the job."""
    done = []
    for name, job in jobs:
        try:
            job()
        except Exception as e:
            raise RuntimeError(f"{name} failed after {', '.join(done) or 'nothing'}") from e
        done.append(name)
    return done
