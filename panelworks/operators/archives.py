"""Archived sources: nested responses, drifting partitions, dated segments, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType, TimestampNTZType

DEPTH = 4
FIELDS = ("close", "volume", "amount")
_OBSERVATION = "struct<thscode: string, time: string, " + ", ".join(f"{f}: double" for f in FIELDS) + ">"


def flat_objects(data: Column, depth: int = DEPTH) -> Column:
    """The raw JSON of all objects in a JSON list of objects and lists, in order, ``depth`` lists deep."""
    if depth == 0:
        return F.array(data)
    inner = F.from_json(data, "array<string>")
    return F.when(F.ltrim(data).startswith("["), F.flatten(F.transform(inner, lambda x: F.when(F.ltrim(x).startswith("["), flat_objects(x, depth - 1)).otherwise(F.array(x))))).otherwise(F.array(data))


def code_key(code: Column) -> Column:
    """Codes in capitals; numbers of the five-digit market with leading zeros."""
    up = F.upper(code)
    digits = F.regexp_extract(up, r"^([0-9]+)\.HK$", 1)
    return F.when(digits != "", F.concat(F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), "0"), F.lit(".HK"))).otherwise(up)


def _number(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def observations(requests: DataFrame) -> DataFrame:
    """(kind, code, date, place, request_id, seq, thscode, ...): what each response (request_id, seq, kind, response) holds.

    A response is {"status_code", "data"}; data is a list of observations and of such lists. Objects without a code are left out.
    """
    shape = F.from_json("response", "status_code int, data string")
    rows = requests.select("request_id", "seq", "kind", shape.alias("r")).where("r.status_code = 200 AND ltrim(r.data) LIKE '[%'")
    each = rows.select("request_id", "seq", "kind", F.posexplode(flat_objects(F.col("r.data"))).alias("place", "raw"))
    each = each.select("request_id", "seq", "kind", "place", F.from_json("raw", _OBSERVATION).alias("o")).where("o.thscode IS NOT NULL")
    return each.select("kind", code_key(F.col("o.thscode")).alias("code"), F.substring("o.time", 1, 10).alias("date"), "seq", "place", "request_id", *(_number(F.col(f"o.{f}")).alias(f) for f in FIELDS))


def tape(observed: DataFrame) -> DataFrame:
    """One row per (kind, code, date): the last observation, by response and place."""
    facts = F.struct(*FIELDS, "request_id")
    return observed.groupBy("kind", "code", "date").agg(F.max_by(facts, F.struct("seq", "place")).alias("f"), F.count(F.lit(1)).alias("observations")).select("kind", "code", "date", "f.*", "observations")


def conflicts(observed: DataFrame, relative: float = 1e-8, absolute: float = 1e-7) -> DataFrame:
    """Fields in which an observation differs from the one before it of the same key, beyond the tolerances; missing figures agree with all."""
    along = Window.partitionBy("kind", "code", "date").orderBy("seq", "place")
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lag(f).over(along).alias("previous"), F.col(f).alias("new")) for f in FIELDS))
    rows = observed.withColumn("each", each).select("kind", "code", "date", "request_id", F.explode("each").alias("x")).select("kind", "code", "date", "request_id", "x.*")
    bound = F.greatest(relative * F.greatest(F.abs("previous"), F.abs("new")), F.lit(absolute))
    return rows.where(F.abs(F.col("previous") - F.col("new")) > bound)


def request_gaps(requests: DataFrame) -> DataFrame:
    """(request_id, kind, reason, status_code) of requests without a usable response."""
    shape = F.from_json("response", "status_code int, data string")
    rows = requests.select("request_id", "kind", F.col("response").isNull().alias("absent"), shape.alias("r"))
    good = F.coalesce((F.col("r.status_code") == 200) & F.ltrim("r.data").startswith("["), F.lit(False))
    return rows.where(~good).select("request_id", "kind", F.when(F.col("absent"), "missing_response").otherwise("failed_request").alias("reason"), F.col("r.status_code").alias("status_code"))


_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def wider(a: DataType, b: DataType) -> DataType | None:
    """The narrower of the types that hold all values of both, or None."""
    if a == b:
        return a
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    for x, y in ((a, b), (b, a)):
        if isinstance(x, FloatType) and isinstance(y, DoubleType) or isinstance(x, _WHOLE[:3]) and isinstance(y, DoubleType):
            return DoubleType()
        if isinstance(x, _WHOLE[:2]) and isinstance(y, FloatType):
            return y
        if isinstance(x, DateType) and isinstance(y, TimestampNTZType):
            return y
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        return DecimalType(digits, scale) if digits <= 38 else None
    return None


def common_schema(schemas: list[StructType]) -> StructType:
    """The schema that all others widen to without loss; a field some lack is nullable. Anything else is refused."""
    fields: dict[str, DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            found = wider(fields[f.name], f.dataType) if f.name in fields else f.dataType
            if found is None:
                raise ValueError(f"{f.name}: {fields[f.name].simpleString()} and {f.dataType.simpleString()} have no common type that keeps all values")
            fields[f.name] = found
    return StructType([StructField(n, t, True) for n, t in fields.items()])


def read_drifting(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Partitions whose field types drifted, under their common schema; rows and values stay, no field is filled.

    Folders of equal schemas are one scan, so the plan grows with the number of schemas and filters reach each scan.
    """
    groups: dict[str, tuple[StructType, list[str]]] = {}
    for folder in folders:
        schema = spark.read.parquet(folder).schema
        groups.setdefault(schema.json(), (schema, []))[1].append(folder)
    if not groups:
        raise ValueError("no partitions")
    common, out = common_schema([s for s, _ in groups.values()]), None
    for schema, members in groups.values():
        rows = spark.read.schema(schema).parquet(*members)
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in common.fields))
        out = rows if out is None else out.unionByName(rows)
    return out


def segmented_scan(spark: SparkSession, segments: list[dict], start: str, end: str) -> DataFrame:
    """Rows of [start, end] from the source that is declared for each date, with its ``frequency`` and what is wrong with a row.

    ``segments`` are dicts (folder, frequency, first, last), disjoint in dates; folders are partitioned by ``date`` and have code, ts,
    freq, requested_from and requested_to. Only segments that meet the range are read, and of them only the partitions in it.
    ``problem``: frequency_mismatch, outside_request (the row's time is not in what was asked for), or null.
    """
    ordered = sorted(segments, key=lambda s: s["first"])
    if any(a["last"] >= b["first"] for a, b in zip(ordered, ordered[1:])):
        raise ValueError("segments overlap")
    out = None
    for s in ordered:
        low, high = max(start, s["first"]), min(end, s["last"])
        if low > high:
            continue
        rows = spark.read.parquet(s["folder"]).where((F.col("date") >= F.lit(low).cast("date")) & (F.col("date") <= F.lit(high).cast("date")))
        inside = F.coalesce((F.col("ts") >= F.col("requested_from")) & (F.col("ts") <= F.col("requested_to")), F.lit(False))
        problem = F.when(~F.col("freq").eqNullSafe(F.lit(s["frequency"])), "frequency_mismatch").when(~inside, "outside_request")
        rows = rows.withColumns({"frequency": F.lit(s["frequency"]), "problem": problem})
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no segment is declared for these dates")
    return out


def files_of(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, content) of the files under a folder, each read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def checksum_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status, bytes) of all artefacts of a manifest (name, sha256) and of all files (name, content): verified, changed, missing, extra.

    A name that either side has twice is ``ambiguous``. Contents become digests before the join, so no file is shuffled.
    """
    found = files.select("name", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))
    found = found.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.max("digest").alias("digest"), F.max("bytes").alias("bytes"))
    told = manifest.groupBy("name").agg(F.count(F.lit(1)).alias("entries"), F.max("sha256").alias("sha256"))
    met = told.join(found, "name", "full_outer")
    status = F.when((F.col("files") > 1) | (F.col("entries") > 1), "ambiguous").when(F.col("files").isNull(), "missing").when(F.col("entries").isNull(), "extra").when(F.col("digest").eqNullSafe(F.lower("sha256")), "verified").otherwise("changed")
    return met.select("name", status.alias("status"), "bytes")


def completed_partitions(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows of the partitions that a manifest (key, status) calls complete or empty; a partition with two entries is left out."""
    done = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("status")).where("n = 1 AND status IN ('complete', 'empty')")
    return rows.join(done.select(key), key, "left_semi")
