"""The whole way of a collection: raw records to one schema, duplicates apart, validated, normalised, merged, versioned."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, dims, merge, normalise, runlog, validate, versions
from ..functions.text import doi_key
from ..operators.flatten import flatten
from ..schemas import CONTENT, NORMALISED, RECORDS
from ..sources.files import read_any
from ..sources.tables import Store

VERSIONED = [*CONTENT, "creators", "keywords", "missing_title_flag", "year_uncertain"]


def dump(raws: DataFrame, path: str, each: bool = False) -> None:
    """The raw records as lines of JSON, all together or a folder for each source; what was there goes."""
    writer = raws.write.mode("overwrite")
    (writer.partitionBy("_source") if each else writer).json(path)


def ingest(raws: DataFrame) -> DataFrame:
    """raw, _source, pos to NORMALISED rows with pos, the first of each content kept. The hash covers the source's name too."""
    tagged = raws.withColumn("_md5", F.md5(F.concat(F.to_json(F.try_parse_json("raw")), F.lit("|"), "_source")))
    return flatten(dedup.keep_first(tagged.where("_md5 IS NOT NULL"), ["_md5"], ["pos"]), carry=("pos",))


def fresh_rows(clean: DataFrame) -> DataFrame:
    """The first row (by pos) of each identifier, however it is spelled; every row without one."""
    keyed = clean.withColumn("_key", F.coalesce(F.nullif(doi_key(F.col("doi")), F.lit("")), F.concat(F.lit("#"), F.col("pos"))))
    return dedup.keep_first(keyed, ["_key"], ["pos"]).drop("_key")


def insert(store: Store, normalised: DataFrame, run_time: datetime.datetime, threshold: int = 90) -> dict[str, int]:
    """Path of the catalogue: duplicates of stored records are merged into them, with a version for each change, the first of each new identifier is stored, authors and keywords are linked.

    All tables change together; of those with a key, only the buckets of new and changed rows are written.
    """
    spark = store.spark
    existing = store.read("records")
    rows = normalised.withColumnRenamed("source", "_source")
    parted = dedup.partition(rows, existing, threshold).persist()
    clean = parted.where("dup_type = 'clean' AND title IS NOT NULL")
    fresh = fresh_rows(clean)
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ids = dims.get_or_create(fresh.select(F.format_string("%020d", "pos").alias("value")), spark.createDataFrame([(top, "")], "id long, k string"), "k").where("k <> ''").select("id", F.col("k").cast("bigint").alias("pos"))
    fresh = fresh.join(ids, "pos").persist()
    new = fresh.withColumns({c.name: F.lit(None).cast(c.dataType) for c in RECORDS if c.name not in fresh.columns})
    new = new.withColumns({"md5_hash": F.col("_md5"), "version_number": F.lit(1), "is_active": F.lit(True), "created_at": F.lit(run_time), "updated_at": F.lit(run_time), "citation_count": F.coalesce("citation_count", F.lit(0))})
    new = new.withColumn("completeness", merge.completeness(new))
    named = parted.where("matched_id IS NOT NULL")
    touched = named.select(F.col("matched_id").alias("id"))
    touched = touched.unionByName(named.select(F.col("record_id").cast("bigint").alias("id"))) if "record_id" in named.columns else touched
    merged, steps = merge.merge_records(existing.join(touched.distinct(), "id", "left_semi"), parted.drop("id"))
    counts = {r["dup_type"]: r["n"] for r in dedup.summary(parted).collect()} | {"inserted": fresh.count()}
    authors = dims.members(fresh, "authors", lower=False).persist()
    words = dims.members(fresh, "keywords", lower=True).persist()
    new_authors, new_words = dims.created(authors, store.read("authors"), "name").persist(), dims.created(words, store.read("keywords"), "keyword").persist()
    author_dim, word_dim = store.read("authors").unionByName(new_authors), store.read("keywords").unionByName(new_words)
    record_authors, record_words = dims.links(authors, author_dim, "name", "author_id", "author_order"), dims.links(words, word_dim, "keyword", "keyword_id")
    with store.transaction():
        store.append("record_authors", record_authors)
        store.append("record_keywords", record_words)
        store.upsert("authors", new_authors)
        store.upsert("keywords", new_words)
        store.append("merge_log", merge.log_merges(dedup.merge_log(parted, run_time, carry=("pos",)), steps))
        store.add("record_versions", merge.snapshots(steps, run_time))
        store.upsert("records", merged.select(*RECORDS.names).unionByName(new.select(*RECORDS.names)))
    for df in (parted, fresh, authors, words, new_authors, new_words):
        df.unpersist()
    return counts


def insert_file(store: Store, path: str, run_time: datetime.datetime, threshold: int = 90) -> dict[str, int]:
    """insert() of a file of normalised records, lines or an array of JSON; one that is missing or of no known format inserts nothing."""
    found = read_any(store.spark, path)
    if found is None or "raw" not in found.columns:
        return {"inserted": 0}
    rows = found.select(F.from_json("raw", NORMALISED).alias("r"), F.col("pos") if "pos" in found.columns else F.monotonically_increasing_id().alias("pos")).select("r.*", "pos")
    return insert(store, rows, run_time, threshold)


def curate(store: Store, records: DataFrame, run_time: datetime.datetime, current_year: int | None = None, rejected_path: str | None = None, normalised_path: str | None = None, log_path: str | None = None, batch: str = "") -> dict[str, int]:
    """Path of processing: records (pos and flat fields) are validated, rejects kept with their reasons, the rest normalised and inserted or updated with versions.

    With log_path there is a row in the run log. A batch that is run again under its name leaves its rejects once.
    """
    if not log_path:
        return _curate(store, records, run_time, current_year, rejected_path, normalised_path, batch)
    with runlog.run(store.spark, log_path, "curate") as counts:
        counts |= _curate(store, records, run_time, current_year, rejected_path, normalised_path, batch)
        return dict(counts)


def _curate(store: Store, records: DataFrame, run_time: datetime.datetime, current_year: int | None, rejected_path: str | None, normalised_path: str | None, batch: str) -> dict[str, int]:
    checked = validate.validate(records, current_year).persist()
    accepted, rejected = validate.route(checked, run_time)
    clean = normalise.normalise(accepted).persist()
    fields = [c for c in VERSIONED if c in clean.columns]
    flat = clean.withColumns({c: F.to_json(c) for c in fields if clean.schema[c].dataType.typeName() == "array"})
    changes = flat.select(versions.record_key(F.col("doi"), F.col("source_id")).alias("record_key"), "pos", versions.given(flat, fields).alias("fields"))
    rows, outcome = versions.apply(store.near("record_versions", changes), changes, fields, run_time)
    outcome, rows = outcome.persist(), rows.persist()
    counts = runlog.stage_counts(checked).first().asDict() | {"inserted": 0} | {r["action"]: r["count"] for r in outcome.groupBy("action").count().collect()}
    if rejected_path:
        rejected.write.mode("overwrite").json(rejected_path)
    if normalised_path:
        clean.write.mode("overwrite").json(normalised_path)
    with store.transaction():
        store.append("rejected_records", rejected, batch)
        store.add("record_versions", rows)
    for df in (checked, clean, outcome, rows):
        df.unpersist()
    return counts


def insert_new(store: Store, records: DataFrame, run_time: datetime.datetime) -> int:
    """Version 1 of each record (pos and flat fields), in the log; ValueError, and nothing stored, if any is there as an active one or twice among them."""
    fields = [c for c in VERSIONED if c in records.columns]
    flat = records.withColumns({c: F.to_json(c) for c in fields if records.schema[c].dataType.typeName() == "array"})
    changes = flat.select(versions.record_key(F.col("doi"), F.col("source_id")).alias("record_key"), "pos", versions.given(flat, fields).alias("fields"))
    log = store.near("record_versions", changes)
    taken = [r["record_key"] for r in versions.conflicts(log, changes).orderBy("record_key").limit(5).collect()]
    if taken:
        raise ValueError(f"records are there already: {', '.join(taken)}")
    rows = versions.apply(log, changes, fields, run_time)[0].persist()
    store.add("record_versions", rows)
    n = rows.count()
    rows.unpersist()
    return n


def run(spark: SparkSession, root: str, raws: DataFrame, run_time: datetime.datetime | None = None, log_path: str | None = None) -> dict[str, int]:
    """ingest() and insert() into the store at root, with a row in the run log."""
    store = Store(spark, root)
    store.create()
    run_time = run_time or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    with runlog.run(spark, log_path or f"{root}/runs", "catalogue") as counts:
        got = insert(store, ingest(raws), run_time)
        counts |= {"inserted": got["inserted"], "loaded": sum(got.get(k, 0) for k in ("exact", "fuzzy", "clean"))}
    return got
