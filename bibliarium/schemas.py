"""Schemas of every table that the engine keeps."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STRINGS = T.ArrayType(_S)
#: One record of any source, flattened.
NORMALISED = _struct(title=_S, authors=STRINGS, publication_year=_I, doi=_S, keywords=STRINGS, repository=_S, access_url=_S, source=_S, _md5=_S)

#: Content of a record in the order in which rows keep it.
CONTENT = ["title", "doi", "publication_year", "source_id", "repository", "abstract", "access_url", "license", "file_format", "subject_area", "citation_count"]
RECORDS = _struct(
    id=_L, title=_S, publication_year=_I, doi=_S, source_id=_S, repository=_S, abstract=_S, access_url=_S, license=_S, file_format=_S, subject_area=_S, citation_count=_I,
    md5_hash=_S, _source=_S, date_collected=_S, version_number=_I, is_active=_B, created_at=_TS, updated_at=_TS, completeness=_D,
)
AUTHORS = _struct(id=_L, name=_S)
KEYWORDS = _struct(id=_L, keyword=_S)
RECORD_AUTHORS = _struct(record_id=_L, author_id=_L, author_order=_I)
RECORD_KEYWORDS = _struct(record_id=_L, keyword_id=_L)
MERGE_LOG = _struct(kept_record_id=_L, dropped_doi=_S, removed_source=_S, removed_title=_S, stage=_S, reason=_S, similarity=_D, merged_at=_TS)
REJECTED = _struct(reason_code=_S, title=_S, doi=_S, source_id=_S, raw_record=_S, rejected_at=_TS)
RUN_LOG = _struct(run_id=_S, source=_S, status=_S, loaded=_L, accepted=_L, rejected=_L, flagged=_L, inserted=_L, updated=_L, started_at=_TS, elapsed_seconds=_D)
#: The append-only log from which current records and histories are derived.
VERSIONS = _struct(record_key=_S, version_number=_I, action=_S, changed=T.MapType(_S, _struct(old=_S, new=_S)), snapshot=T.MapType(_S, _S), is_active=_B, updated_at=_TS)
DATASETS = _struct(title=_S, authors=_S, year=_I, doi=_S, keywords=_S, description=_S, url=_S, repository=_S)

TABLES = {
    "records": RECORDS, "authors": AUTHORS, "keywords": KEYWORDS, "record_authors": RECORD_AUTHORS, "record_keywords": RECORD_KEYWORDS,
    "merge_log": MERGE_LOG, "rejected_records": REJECTED, "pipeline_run_log": RUN_LOG, "record_versions": VERSIONS, "datasets": DATASETS,
}
#: Columns by which rows of a table are looked up, in the order in which files are sorted.
LAYOUT = {
    "records": ["is_active", "repository", "publication_year", "doi"], "authors": ["name"], "keywords": ["keyword"], "record_authors": ["record_id"], "record_keywords": ["record_id"],
    "record_versions": ["record_key", "version_number"], "datasets": ["year"],
}
#: Keys by whose hash rows are dealt to buckets: a change of some rows rewrites the buckets of their keys only.
KEYS = {"records": "id", "authors": "name", "keywords": "keyword", "record_versions": "record_key"}
