"""Persistent forms: versioned histories, record logs, corpora, baselines, events; and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.operators import scan
from tessera.session import materialised
from tessera.sources import checkout

HISTORY = "kind string, file_path string, rule_id string, first_seen date, last_seen date, severity string, occurrences long, reason string"
RECORD = "sequence long, previous string, digest string, signature string, key_id string, payload string"
VERSION = 1


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document {version, recollections}; another version gives nothing, and rows that break an invariant are left out."""
    doc = spark.read.schema(f"version int, recollections array<struct<{HISTORY.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>").option("multiLine", "true").json(path)
    rows = doc.filter(F.col("version") == VERSION).select(F.inline("recollections"))
    return rows.filter("kind is not null and file_path is not null and rule_id is not null and occurrences >= 1 and last_seen >= first_seen")


#: Recollections that one document of a written history holds, about.
HISTORY_ROWS = 100_000


def write_history(history: DataFrame, path: str) -> None:
    """The history as documents {version, recollections} of a bounded number of rows; Spark's committer replaces the folder at once."""
    fields = [c.split()[0] for c in HISTORY.split(", ")]
    parts = max(1, -(-history.count() // HISTORY_ROWS))
    part = F.pmod(F.xxhash64("kind", "file_path", "rule_id"), F.lit(parts))
    grouped = history.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("recollections"))
    grouped.select(F.lit(VERSION).alias("version"), "recollections").write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON records; the order is the record's own sequence."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def replace_records(records: DataFrame, path: str) -> None:
    """Replaces a store by records that were read from it: they are written beside it first."""
    materialised(records).write.mode("overwrite").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_metrics(files: DataFrame, path: str) -> None:
    """The metrics of every file, one JSON object each, for analysis elsewhere."""
    files.write.mode("overwrite").json(path)


BASELINE = "rates map<string,double>, cases array<string>, model string, fingerprint string, at string"


def write_baseline(baseline: DataFrame, path: str) -> None:
    baseline.write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored run (rates, cases, model, fingerprint, at); None where there is none, or none that can be read."""
    if not _exists(spark, path):
        return None
    rows = spark.read.schema(BASELINE).json(path).filter("rates is not null and cases is not null and model is not null and fingerprint is not null")
    return None if rows.isEmpty() else rows


# What a catalogue of controls must state.
CATALOGUE = ("name", "version", "publisher", "reference")


def load_catalogue(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """(what the catalogue says of itself, controls (control, description, namespaces)) of a YAML file. One that can't be read whole,
    or does not say whose controls these are, in which version, is refused."""
    import yaml

    try:
        with open(path, encoding="utf-8") as text:
            raw = yaml.safe_load(text)
    except (OSError, yaml.YAMLError) as error:
        raise ValueError(f"no catalogue can be read from {path}: {type(error).__name__}") from error
    if not isinstance(raw, dict):
        raise ValueError(f"{path} is no mapping")
    if missing := [k for k in CATALOGUE if not raw.get(k)]:
        raise ValueError(f"{path} does not state its {', '.join(missing)}")
    rows = []
    for control, body in (raw.get("controls") or {}).items():
        if not isinstance(body, dict):
            raise ValueError(f"control {control} is no mapping")
        rows.append((str(control), str(body.get("description", "")).strip(), [str(n).upper() for n in body.get("namespaces") or []]))
    return {k: str(raw[k]) for k in CATALOGUE}, spark.createDataFrame(rows, "control string, description string, namespaces array<string>")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON with exactly the given top-level fields: an unknown or missing one, or a wrong type, is an error."""
    wanted = spark.createDataFrame([], schema).schema
    found = set(spark.read.option("multiLine", "true").json(path).columns)
    if found - set(wanted.names):
        raise ValueError(f"unknown fields {sorted(found - set(wanted.names))}")
    return spark.read.schema(wanted).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def _unknown(value, kind: T.DataType, at: str = "") -> list[str]:
    """Paths of keys, at any depth, that a type does not have."""
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        fields = {f.name: f.dataType for f in kind.fields}
        return [f"{at}{k}" for k in value if k not in fields] + [x for k, v in value.items() if k in fields for x in _unknown(v, fields[k], f"{at}{k}.")]
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [x for v in value for x in _unknown(v, kind.elementType, at)]
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return [x for k, v in value.items() for x in _unknown(v, kind.valueType, f"{at}{k}.")]
    return []


# The fields of the four corpora.
CORPORA = {
    "cases": "name string, file string, diff string, scope array<string>, line_tolerance int, expect array<struct<rule:string,line:int,severity:string>>, expect_absent array<struct<rule:string,line:int>>",
    "documentation": "name string, index struct<names:array<string>,signatures:map<string,array<string>>,options:array<string>,environment:array<string>>, changes array<struct<path:string,diff:string>>, documents map<string,string>, sources map<string,string>, expected array<struct<rule:string,line:int>>, forbidden array<struct<rule:string,line:int>>",
    "narration": "name string, file string, review string, findings array<struct<rule:string,line:int,severity:string,title:string,category:string>>, prompt_fingerprint string, expect_failures array<string>",
    "retrieval": "name string, because string, expect struct<path:string,heading:string>, diff string, documents map<string,string>",
}


#: Bytes of a case at most, and bad files that an error names.
CASE_BYTES, NAMED = 16 << 20, 50


def _case_files(spark: SparkSession, place: str | list[str]) -> DataFrame:
    """(path, content, truncated) of the YAML files of a folder, or of the files of a list."""
    if isinstance(place, str):
        checkout.register(spark)
        return spark.read.format("checkout").option("suffixes", ".yaml,.yml").option("maxFileBytes", CASE_BYTES).load(place).select("path", "content", "truncated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = checkout.opened(path)
                with store.open_input_stream(name) as stream:
                    raw = stream.read(CASE_BYTES + 1)
                columns = [pa.array([path]), pa.array([raw[:CASE_BYTES].decode("utf-8", "replace")]), pa.array([len(raw) > CASE_BYTES])]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "content", "truncated"])

    listed = spark.createDataFrame([(p,) for p in place], "path string")
    return listed.mapInArrow(run, "path string, content string, truncated boolean")


def read_corpus(spark: SparkSession, place: str | list[str], schema: str, secret_free: str | None = None) -> DataFrame:
    """YAML cases, one per file, of a folder or a list of paths, with a strict schema at every depth. Files are read and parsed in the tasks.

    All files that are no mapping, have unknown fields or values of another type are named by one error; so are cases that have a
    secret in the text field ``secret_free``.
    """
    wanted = spark.createDataFrame([], schema).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        fast = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def loaded(text: str):
            try:
                return yaml.load(text, Loader=fast)  # noqa: S506
            except yaml.YAMLError:
                return yaml.safe_load(text)  # what is refused, and in which words, is the plain loader's to say

        for batch in batches:
            values, faults = [], []
            for content, cut in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                value = fault = None
                try:
                    case = loaded(content.as_py() or "")
                    unknown = sorted(_unknown(case, wanted)) if isinstance(case, dict) else []
                    fault = "too long" if cut else "no mapping" if not isinstance(case, dict) else f"unknown fields {unknown}" if unknown else None
                    value = json.dumps(case, default=str) if fault is None else None
                except yaml.YAMLError as error:
                    fault = "no YAML: " + str(error).partition("\n")[0]
                values.append(value), faults.append(fault)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string()), pa.array(faults, pa.string())], names=["path", "value", "fault"])

    parsed = _case_files(spark, place).mapInArrow(parse, "path string, value string, fault string")
    strict = T.StructType([*wanted.fields, T.StructField("_odd", T.StringType())])
    typed = parsed.select("path", "fault", F.from_json("value", strict, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_odd"}).alias("c"))
    held = materialised(typed.select("path", F.coalesce("fault", F.when(F.col("c._odd").isNotNull(), "a value of another type")).alias("fault"), "c"))
    bad = held.filter("fault is not null")
    named = bad.orderBy("path").limit(NAMED).collect()
    if named:
        raise ValueError(f"{bad.count()} bad cases: " + "; ".join(f"{r.path}: {r.fault}" for r in named))
    cases = held.select(*[F.col(f"c.{f.name}").alias(f.name) for f in wanted.fields])
    if secret_free:
        secrets = scan.redact(cases, secret_free).filter("masked > 0").select(cases.columns[0])
        told = [r[0] for r in secrets.limit(NAMED).collect()]
        if told:
            raise ValueError(f"{secrets.count()} cases with a secret: {sorted(told)}")
    return cases


def narration_cases(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_corpus(spark, paths, CORPORA["narration"], "review")


def retrieval_cases(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(cases, documents (name, path, content)); a case that expects a document it does not carry is broken."""
    cases = read_corpus(spark, paths, CORPORA["retrieval"])
    broken = ~F.array_contains(F.map_keys("documents"), F.col("expect.path"))
    return cases.withColumn("broken", broken).drop("documents"), cases.select("name", F.explode("documents").alias("path", "content"))


def merge_request_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """(project_id, mr_id, action) of webhook documents that open, update or reopen a merge request."""
    shape = "object_kind string, project struct<id:long>, object_attributes struct<iid:long,action:string>"
    event = raw.select(F.from_json(body, shape).alias("e")).filter("e.object_kind = 'merge_request' and e.object_attributes.action in ('open', 'update', 'reopen')")
    return event.select(F.col("e.project.id").alias("project_id"), F.col("e.object_attributes.iid").alias("mr_id"), F.col("e.object_attributes.action").alias("action")).filter("project_id is not null and mr_id is not null")


def trace_json(timed: DataFrame) -> DataFrame:
    """(trace_id, value): a trace's spans and their derived times as one JSON document."""
    span = F.struct(*[c for c in timed.columns if c != "trace_id"])
    return timed.groupBy("trace_id").agg(F.to_json(F.struct(F.first("trace_id").alias("trace_id"), F.sort_array(F.collect_list(span)).alias("spans"))).alias("value"))
