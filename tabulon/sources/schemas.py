"""Explicit schemas of the JSON documents (dictionaries are maps, whatever their keys) and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD = "struct<od:string,do:string,raw:string>"
DAYS = "array<struct<datumi:array<string>,napomena:string,raw:string>>"
ENTRY = "struct<day:string,startsAt:string,endsAt:string,classType:string,course:string,`group`:string,room:string,fromOcr:boolean,ocrConfidence:int,rawText:string,groups:array<string>,roomsByGroup:map<string,string>>"
TIMETABLE = f"""schemaVersion int, category string, language string, studyLevel string, studyLevelLabel string, semester int, studyYear int,
 semesterType string, module string, submodule string, moduleLabel string, academicYear string, generatedAt string,
 source struct<pageUrl:string,pdfUrl:string,pdfSha256:string,linkText:string>, legend struct<lectureFill:string,hasLabEntry:boolean,labels:array<string>>,
 timeRows array<struct<fromTime:string,toTime:string>>, counts struct<entries:int,byClassType:map<string,int>,ocrCells:int,lowConfidenceCells:int>,
 groupRooms struct<lectures:map<string,string>,exercises:map<string,string>>,
 indexGroups struct<sourceUrl:string,ranges:array<struct<indexFrom:int,indexTo:int,lectureGroup:string,exerciseGroup:string>>>,
 warnings array<string>, schedule array<{ENTRY}>"""
CALENDAR = f"""schemaVersion int, category string, language string, academicYear string, generatedAt string,
 levels array<struct<studyLevel:string,label:string,sourceUrl:string,pdfUrl:string,semestri:struct<jesenji:{PERIOD},prolecni:{PERIOD}>,raspust:{PERIOD},
 overaSemestra:string,radniDani:{DAYS},neradniDaniIPraznici:{DAYS},ispitniRokovi:array<struct<naziv:string,labela:string,odrzavanje:{PERIOD},prijavaIspita:{PERIOD},
 polaganja:array<struct<naziv:string,od:string,do:string,raw:string,prijavaIspita:{PERIOD}>>>>,napomene:array<string>,rawText:string>>"""
INDEX = """generatedAt string, total int, succeeded int, failed int,
 schedules array<struct<studyLevel:string,semester:int,studyYear:int,semesterType:string,module:string,submodule:string,academicYear:string,pdfUrl:string,file:string,entries:int,ocrCells:int,lowConfidenceCells:int>>,
 failures array<struct<pdfUrl:string,message:string>>"""


def read_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row a file, with its name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1))


def entries(timetables: DataFrame) -> DataFrame:
    """The entries of timetables, in order: (file, academicYear, ord, entry's fields)."""
    return timetables.select("file", "academicYear", F.posexplode("schedule").alias("ord", "e")).select("file", "academicYear", "ord", "e.*")


def calendar_lines(calendars: DataFrame) -> DataFrame:
    """(doc, ord, line) of the raw text of each level."""
    levels = calendars.select(F.explode("levels").alias("l"))
    return levels.select(F.col("l.studyLevel").alias("doc"), F.posexplode(F.split("l.rawText", "\n")).alias("ord", "line"))


def file_name(level: str, semester: str, module: str, submodule: str, year: str):
    """The name of a timetable's file; parts that are NULL are left out."""
    short = F.when(F.col(level) == "master_akademske", "mas").otherwise("oas")
    return F.concat(F.concat_ws("-", short, F.concat(F.lit("sem"), F.col(semester).cast("string")), F.lower(module), F.lower(submodule), F.replace(F.col(year), F.lit("/"), F.lit("-"))), F.lit(".json"))


def parse_pdf_name(url):
    """(semester, module, submodule) from the name of a timetable's PDF; NULL for other names."""
    name = F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1)
    word, version = "-[0-9a-z]+", "-v[0-9]+"
    pattern = f"(?i)^[0-9]+-(?:mas|sem)([0-9]+)((?:{word})*?)(?:{version})?[.]pdf$"
    part = F.filter(F.split(F.regexp_extract(name, pattern, 2), "-"), lambda x: x != "")
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).cast("int").alias("semester"), F.upper(F.get(part, F.lit(0))).alias("module"), F.upper(F.get(part, F.lit(1))).alias("submodule")))


def page_url(url, page):
    return F.when(page == 1, url).otherwise(F.concat(url, F.lit("?page="), page.cast("string")))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, sha256) that are new or changed."""
    return found.join(known, ["path", "sha256"], "left_anti")


def edited(found: DataFrame, applied: DataFrame) -> DataFrame:
    """Files that were applied with another content: an error to report."""
    return found.join(applied.withColumnRenamed("sha256", "applied_sha256"), "path").filter("sha256 <> applied_sha256")


def file_scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, text) of text files, by name."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("path"), F.sha2("value", 256).alias("sha256"), F.col("value").alias("text"))
    return rows.orderBy("path")


def write_guarded(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """Overwrites path with df unless df has no rows; tells whether it did. The commit protocol makes it all or nothing."""
    if df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return True
