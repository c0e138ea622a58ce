"""Readers of files by format, and writers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranges

RAW = T.StructType([T.StructField("raw", T.StringType())])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row (raw, pos) for each object of files that hold an array of objects, one object, or anything else (no rows).

    pos is the object's place in its file's array. A file is read by many tasks, on however few lines it is (see ranges).
    """
    each = ranges.json_objects(spark, path).select(F.try_parse_json("text").alias("o"), "pos")
    return each.where(F.schema_of_variant("o").startswith("OBJECT")).select(F.to_json("o").alias("raw"), "pos")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (raw) for each line; files of lines are split over tasks, and are the form for large inputs."""
    return spark.read.text(path).select(F.col("value").alias("raw")).where("trim(raw) <> ''")


def read_csv(spark: SparkSession, path: str, empty_as_null: bool = False) -> DataFrame:
    """All columns as strings, line breaks between quotes kept; empty cells are empty strings unless asked otherwise.

    A file is read by many tasks (see ranges), its first record names the columns; those of several files must agree.
    """
    names = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).columns  # of the first record
    rows = ranges.csv_records(spark, path).where("at > 0 OR pos > 0")
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    df = rows.select(F.from_csv("text", ddl, {"escape": '"'}).alias("r")).select("r.*")
    return df if empty_as_null else df.na.fill("")


_FIELD = re.compile(r"([A-Za-z][A-Za-z0-9_-]*)\s*=\s*")
_BARE = re.compile(r'[^,{}"#\s]+')
_EDGE = re.compile(r'[{}"]')
_JOIN = re.compile(r"\s*#\s*")
#: Macros that every file has. Fixed values.
MONTHS = {
    "jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May", "jun": "June",
    "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December",
}


def _value(body: str, at: int) -> tuple[bool, str, int]:
    """The value that begins there: whether it is a macro's name, its text, and where it ends; between braces of any depth, between quotes, or bare."""
    mark, depth = body[at : at + 1], 0
    if not mark or mark not in '{"':
        bare = _BARE.match(body, at)
        return (not bare[0].isdigit(), bare[0], bare.end()) if bare else (False, "", at)
    for edge in _EDGE.finditer(body, at + (mark == '"')):
        if edge[0] == '"':
            closed = mark == '"' and depth == 0
        else:
            depth += 1 if edge[0] == "{" else -1
            closed = mark == "{" and depth == 0
        if closed:
            return False, body[at + 1 : edge.start()], edge.end()
    return False, body[at + 1 :], len(body)  # it is not closed


def bibtex_parts(body: str) -> dict[str, list[tuple[bool, str]]]:
    """Fields of an entry, names in lower case, the first of each, as what # joins: (is a macro's name, text). One pass from left to right."""
    out: dict[str, list[tuple[bool, str]]] = {}
    found = _FIELD.search(body)
    while found:
        at, parts = found.end(), []
        while True:
            macro, text, stop = _value(body, at)
            if text or stop > at:
                parts.append((macro, text))
            more = _JOIN.match(body, stop) if parts else None
            if not more:
                break
            at = more.end()
        if parts:
            out.setdefault(found[1].lower(), parts)
        found = _FIELD.search(body, stop)
    return out


def _joined(parts: list[tuple[bool, str]], macros: dict[str, str]) -> str:
    """A macro that is not defined stands for its name."""
    return "".join(macros.get(text.lower(), text) if macro else text for macro, text in parts)


def bibtex_fields(body: str, macros: dict[str, str] | None = None) -> dict[str, str]:
    """Fields of an entry with macros in their place."""
    return {name: _joined(parts, macros or {}) for name, parts in bibtex_parts(body).items()}


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry: entry_type, entry_key and fields (a map, as bibtex_fields() has them). A file is read by one task.

    Entries begin at an at sign that opens a line, so a file is cut there first; comments and preambles are left out. A
    macro stands for what the last @string before the entry gives it, in any case of letters; @strings may name others
    that come before them. Months are defined from the start.
    """

    @F.arrow_udf("map<string,string>")
    def fields(bodies: pa.Array, places: pa.Array, defined: pa.Array) -> pa.Array:
        out, known, taken, macros = [], None, 0, {}
        for body, pos, strings in zip(bodies.to_pylist(), places.to_pylist(), defined.to_pylist()):
            strings = strings or []
            if strings != known or taken and strings[taken - 1]["pos"] > pos:  # another file, or not in its order
                known, taken, macros = strings, 0, dict(MONTHS)
            while taken < len(strings) and strings[taken]["pos"] < pos:
                macros |= bibtex_fields(strings[taken]["body"], macros)
                taken += 1
            out.append(None if body is None else list(bibtex_fields(body, macros).items()))
        return pa.array(out, pa.map_(pa.string(), pa.string()))

    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    entry = text.select("path", F.posexplode(F.split("value", r"(?m)(?=^\s*@)")).alias("pos", "e")).select("path", "pos", F.trim(F.regexp_replace("e", r"\s+", " ")).alias("e"))
    head = r"^@\s*([A-Za-z]+)\s*[{(]\s*([^,\s]*)\s*,"
    kind = F.lower(F.regexp_extract("e", r"^@\s*([A-Za-z]+)\s*[{(]", 1))
    body = F.regexp_replace("e", r"(?i)^@\s*string\s*[{(]|[})]\s*$", "")
    strings = entry.where(kind == "string").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", body.alias("body")))).alias("strings"))  # a file's definitions
    entry = entry.select("path", "pos", F.lower(F.regexp_extract("e", head, 1)).alias("entry_type"), F.regexp_extract("e", head, 2).alias("entry_key"), F.regexp_replace("e", head, "").alias("body"))
    entry = entry.where("entry_type <> '' AND entry_type NOT IN ('comment', 'preamble', 'string')").join(strings, "path", "left")
    return entry.select("entry_type", "entry_key", fields("body", "pos", "strings").alias("fields"))


def read_any(spark: SparkSession, path: str) -> DataFrame | None:
    """By extension; None for an unknown one or a missing file."""
    kind = path.rpartition(".")[2].lower()
    reader = {"bib": read_bibtex, "json": read_json, "jsonl": read_json_lines, "csv": read_csv}.get(kind)
    if reader is None:
        return None
    try:
        return reader(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return None
        raise


def read_required(spark: SparkSession, path: str) -> DataFrame:
    """read_any(), with a missing file or unknown format as an error."""
    df = read_any(spark, path)
    if df is None:
        raise FileNotFoundError(path)
    return df


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are joined by a comma and a blank."""
    flat = [F.array_join(f.name, ", ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def clean_csv(df: DataFrame, order: str = "pos") -> DataFrame:
    """The cleaning of collected tables: year cut to four characters, the first row of each title and authors kept."""
    from ..operators.dedup import keep_first

    return keep_first(df.withColumn("year", F.substring("year", 1, 4)), ["title", "authors"], [order])


def collect_csv(spark: SparkSession, path: str, source: str = "zenodo", **options) -> None:
    """One catalogue's records as a table of DATASETS columns: fetched, flattened and written."""
    from ..operators.flatten import flatten
    from . import rest

    rest.register(spark)
    raws = spark.read.format("catalogue").options(source=source, **options).load()
    flat = flatten(raws, carry=("pos",))
    write_csv(flat.select("title", "authors", F.col("publication_year").alias("year"), "doi", "keywords", F.lit(None).cast("string").alias("description"), F.col("access_url").alias("url"), "repository"), path)
