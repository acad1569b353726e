"""Readers of delivered files. Schemas are declared, never inferred, so no file is read twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.rows import first_per_key

EVENT = (
    "application_no string, registration_no string, event_type string, event_subtype string, source_type string, bulletin_no string, gazette_no string, "
    "bulletin_date string, gazette_date string, page_number int, old_value string, new_value string, details map<string,string>, raw_text string"
)
METADATA = (
    "APPLICATIONNO string, STATUS string, IMAGE string, TRADEMARK struct<NAME:string,REGISTERNO:string,APPLICATIONDATE:string,REGISTERDATE:string,BULLETIN_NO:string,"
    "BULLETIN_DATE:string,NICECLASSES_LIST:array<string>>, HOLDERS array<struct<TITLE:string,TPECLIENTID:string>>, ATTORNEYS array<struct<NAME:string,NO:string>>, _corrupt string"
)


def _struct(fields: str) -> str:
    """DDL of a struct's fields from that of columns."""
    return ",".join(":".join(part.split(" ", 1)) for part in fields.split(", "))


def _folder(file: Column) -> Column:
    """The name of the folder that a file lies in."""
    return F.element_at(F.split(file, "/", -1), -2)


def event_files(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Events of JSON envelopes with status success, with their file; envelopes without events give none.

    source (BLT or GZ) keeps files in folders of that prefix; the filter is on the file's name, before it is parsed.
    """
    schema = f"status string, source_type string, bulletin_no string, gazette_no string, total int, events array<struct<{_struct(EVENT)}>>"
    files = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    if source:
        files = files.where(_folder(F.col("file")).startswith(f"{source}_"))
    e = files.where("status = 'success'").select("file", F.col("source_type").alias("s"), F.coalesce("bulletin_no", "gazette_no").alias("no"), F.explode("events").alias("e"))
    kept = e.select("file", "e.*", "s", "no").withColumn("source_type", F.coalesce("source_type", "s")).withColumn("bulletin_no", F.coalesce("bulletin_no", "gazette_no", "no"))
    keyed = kept.where(F.col("application_no").isNotNull() & F.col("event_type").isNotNull()).drop("s", "no")
    parts = ["application_no", "event_type", "event_subtype", "source_type", "bulletin_no", "page_number", "old_value", "new_value"]
    return keyed.withColumn("event_fingerprint", X.fingerprint(*[F.col(p) for p in parts], F.to_json(F.map_from_entries(F.array_sort(F.map_entries("details"))))))


def metadata_files(spark: SparkSession, path: str) -> DataFrame:
    """Trademark records of JSON arrays, one per application: the last in its file. Corrupt files are in _corrupt only."""
    rows = spark.read.schema(METADATA).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where("APPLICATIONNO is not null")
    last = first_per_key(placed, ["APPLICATIONNO"], [F.desc("file"), F.desc("at")])
    return last.select(
        F.col("APPLICATIONNO").alias("application_no"),
        F.col("STATUS").alias("status"),
        X.clean_name(F.col("TRADEMARK.NAME")).alias("name"),
        F.transform("TRADEMARK.NICECLASSES_LIST", lambda c: c.cast("int")).alias("classes"),
        F.get("HOLDERS.TITLE", F.lit(0)).alias("holder"),
        F.coalesce(F.get("HOLDERS.TPECLIENTID", F.lit(0)), X.client_id(F.get("HOLDERS.TITLE", F.lit(0)))).alias("client_id"),
        "file",
    )


def salvaged_metadata(spark: SparkSession, path: str, regenerated: DataFrame) -> DataFrame:
    """As metadata_files(), with the records that were made anew (folder and the same columns but file) for corrupt files.

    regenerated comes from the deliveries' own logs (insert_log) and counts only for folders whose file can't be read.
    """
    rows = spark.read.schema(METADATA).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    broken = rows.select(F.col("_metadata.file_path").alias("file"), "_corrupt", "APPLICATIONNO").where("_corrupt is not null and APPLICATIONNO is null").select(_folder(F.col("file")).alias("folder"), "file").distinct()
    sound = metadata_files(spark, path)
    return sound.unionByName(regenerated.join(broken, "folder").select(*sound.columns))


#: Headers under which upload files name the columns of a watchlist.
ALIASES = {"name": ["name", "brand", "trademark", "marka", "marka adı"], "classes": ["classes", "class", "nice", "sınıf", "sınıflar"], "application_no": ["application no", "application_no", "başvuru no"]}


def uploaded_csv(spark: SparkSession, path: str) -> DataFrame:
    """name, classes, application_no of a CSV file; headers are matched to aliases exactly, then by containment."""
    raw = spark.read.csv(path, header=True)
    heads = {h: h.strip().lower() for h in raw.columns}
    found: dict[str, str] = {}
    for test in (lambda h, a: h == a, lambda h, a: a in h):
        for target, names in ALIASES.items():
            free = [h for h, low in heads.items() if h not in found.values() and any(test(low, a) for a in names)]
            if free and target not in found:
                found[target] = free[0]
    pick = lambda t: F.col(f"`{found[t]}`") if t in found else F.lit(None).cast("string")
    return raw.select(F.trim(pick("name")).alias("name"), X.class_list(pick("classes")).alias("classes"), F.trim(pick("application_no")).alias("application_no")).where("name <> ''")


def insert_log(spark: SparkSession, path: str, tables: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Rows of `INSERT INTO t VALUES(...)` lines of a database log, as a DataFrame of strings per table.

    Values are quoted texts with doubled quotes, numbers or NULL. A line with another number of values than its
    table has columns fails the job.
    """
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^INSERT INTO (\w+) VALUES\s?\((.*)\)\s*;?$", 1).alias("t"), F.regexp_extract("value", r"^INSERT INTO (\w+) VALUES\s?\((.*)\)\s*;?$", 2).alias("v"))
    value = r"('(?:[^']|'')*'|[^,']+)(?:,|$)"
    out = {}
    for name, columns in tables.items():
        vals = F.regexp_extract_all("v", F.lit(value), F.lit(1))
        rows = lines.where(F.upper("t") == name.upper()).select(vals.alias("vals"))
        checked = rows.select(F.when(F.size("vals") == len(columns), F.col("vals")).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), F.size("vals").cast("string"), F.lit(" values")))).alias("vals"))
        text = lambda v: F.when(F.upper(F.trim(v)) == "NULL", F.lit(None)).when(v.startswith("'"), F.replace(F.regexp_replace(v, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(F.trim(v))
        out[name] = checked.select(*[text(F.get("vals", F.lit(i))).alias(c) for i, c in enumerate(columns)])
    return out
