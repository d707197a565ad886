"""Catalog tables derived from the driver tables.

The SQL runs unchanged in Spark and DuckDB; ``{name}`` stands for a driver
table. Every row of the tables named is used.
"""

from __future__ import annotations

from functools import lru_cache
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "source in ('src0', 'src2', 'src4', 'src6', 'src8')"
_BATCH = (
    "'2024-01-' || lpad(cast(1 + cast(substr(source, 4) as int) as string), 2, '0') "
    "|| 'T00:00:00Z'"
)

IMPORT = f"""
select distinct {_BATCH} as import_date, '/old/' || source as base_path,
       {_LOCAL} as local, 'import' as type
from {{documents}}
union all
select '2024-02-01T00:00:00Z', '/old/backup', true, 'import'
union all
select '2024-02-02T00:00:00Z', '/old/web', false, 'import'
union all
select '2024-02-03T00:00:00Z', '/old/empty', false, 'import'
"""

# Each document at its old place, a backup of those labelled good (most without
# a date), and the web pages.
PHOTO = f"""
select case when {_LOCAL} then '' else '/old/' || source || '/' end || lang || '/'
         || coalesce(event_type, 'none') || '/IMG ' || cast(doc_id as string) || '.jpg' as path,
       'IMG ' || cast(doc_id as string) || '.jpg' as fname, 'jpeg' as ftype,
       md5(text) as md5hash, ts as dt_orig, ts as dt_mod, {_BATCH} as dt_import
from {{documents}} d left join {{events}} e on e.event_id = d.doc_id
union all
select 'q/' || lang || '/IMG ' || cast(d.doc_id as string) || '.jpg',
       'IMG ' || cast(d.doc_id as string) || '.jpg', 'jpeg', md5(text), ts, ts,
       '2024-02-01T00:00:00Z'
from {{documents}} d join {{labels}} l on l.doc_id = d.doc_id and l.quality = 1
left join {{events}} e on e.event_id = d.doc_id and e.event_type = 'error'
union all
select '/old/web/' || cast(page_id as string) || '.png', cast(page_id as string) || '.png', 'png',
       md5(html), ts, ts, '2024-02-02T00:00:00Z'
from {{pages}} p left join {{events}} e on e.event_id = p.page_id
"""

# Each document at a new place, a second file of those labelled toxic, the web
# pages where they were, and conversation turns the catalog does not know.
SCAN = """
select '/new/' || source || '/' || lang || '/' || cast(doc_id as string) || '.JPG' as path,
       md5(text) as md5hash
from {documents}
union all
select '/new/extra/IMG ' || cast(d.doc_id as string) || '.jpg', md5(text)
from {documents} d join {labels} l on l.doc_id = d.doc_id and l.toxic = 1
union all
select '/old/web/' || cast(page_id as string) || '.png', md5(html) from {pages}
union all
select '/new/chat/' || cast(conv_id as string) || '-' || cast(turn as string) || '.jpg', md5(text)
from {conversations}
"""


def _dms(key: str, degrees: int, negative: str, positive: str) -> str:
    return (
        f"'\"GPS GPS{key}\":\"[' || cast(doc_id % {degrees} as string) || ', '"
        f" || cast(doc_id % 60 as string) || ', '"
        f" || cast((doc_id * 7919) % 600000 as string) || '/10000]\","
        f"\"GPS GPS{key}Ref\":\"' || case when n_chars % 2 = 0 then '{negative}' "
        f"else '{positive}' end || '\"'"
    )


# One metadata object per document text.
TAG = f"""
select md5hash, min(meta) as meta, cast(min(n_chars) as int) as width,
       cast(max(n_chars) as int) as height
from (
  select md5(text) as md5hash, n_chars,
         '{{{{' || {_dms("Longitude", 180, "W", "E")} || ',' || {_dms("Latitude", 90, "S", "N")}
         || case when lang = 'en' then ',"GPS GPSAltitude":"' || cast(n_chars as string)
                 || '/10","GPS GPSAltitudeRef":"' || cast(doc_id % 2 as string) || '"' else '' end
         || ',"Image Model":"' || source || '","EXIF ISOSpeedRatings":'
         || cast(n_chars as string) || '}}}}' as meta
  from {{documents}}
) t group by md5hash
"""

HASH = f"""
select md5hash from ({PHOTO}) p
union
select md5(text) from {{benchmark}}
"""

# {STAMP_TIME} differs between the engines.
STAMP = """
select event_id, '/cams/' || event_type || '/' || cast(event_id as string) || '.jpg' as path,
       '[cam' || cast(user_id as string) || '] - ' || event_type || ' - ' || {STAMP_TIME} || ' '
         || case when value < 10 then 'MST' when value < 20 then 'CEST' else 'UTC' end
         || case when event_type = 'click' then '' else ' - x' end || chr(10)
         || 'Exposure: ' || cast(cast(floor(value) as bigint) as string) as ocr
from {events}
"""

VIEWS = {
    "fx_import": IMPORT,
    "fx_photo": PHOTO,
    "fx_scan": SCAN,
    "fx_tag": TAG,
    "fx_hash": HASH,
    "fx_stamp": STAMP,
}

# Column of contents of each driver table that has them, and the name of its hash in Spark.
_CONTENTS = {"documents": "text", "pages": "html", "conversations": "text", "benchmark": "text"}
_HASHED = "content_md5"

_STAMP_TIME = {
    "spark": "date_format(ts, 'EEE MMM dd yyyy HH:mm:ss')",
    "duckdb": "strftime(ts, '%a %b %d %Y %H:%M:%S')",
}


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views above as a DataFrame."""
    return query(spark, sf_dir, VIEWS[name])


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL text with ``{table}`` placeholders as a DataFrame.

    Contents are hashed where they are read: a join would else carry them to its far side,
    where the statement takes their hash.
    """
    text = text.replace("{STAMP_TIME}", _STAMP_TIME["spark"])
    for contents in set(_CONTENTS.values()):
        text = text.replace(f"md5({contents})", _HASHED)
    names = {field for _, field, _, _ in Formatter().parse(text) if field}
    return spark.sql(text, **{name: _hashed(spark, sf_dir, name) for name in names})


def _hashed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = table(spark, sf_dir, name)
    if name not in _CONTENTS:
        return rows
    return rows.withColumn(_HASHED, F.md5(_CONTENTS[name]))


def duckdb_sql(text: str) -> str:
    """The same SQL for DuckDB, where the driver tables are views of their own name."""
    text = text.replace("{STAMP_TIME}", _STAMP_TIME["duckdb"])
    names = {field for _, field, _, _ in Formatter().parse(text) if field}
    return text.format(**{name: name for name in names})


def with_views(sql: str, *names: str) -> str:
    """A DuckDB statement that starts from the named views."""
    head = ", ".join(f"{name} as ({duckdb_sql(VIEWS[name])})" for name in names)
    return f"with recursive {head}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}"
