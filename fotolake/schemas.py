"""Fixed schemas of the catalog tables and of scan records."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT, _INT, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()
_TIME = T.TimestampNTZType()

IMPORT = _schema(import_date=_TEXT, base_path=_TEXT, local=T.BooleanType(), type=_TEXT)
HASH = _schema(md5hash=_TEXT)
PHOTO = _schema(
    path=_TEXT, fname=_TEXT, ftype=_TEXT, md5hash=_TEXT, dt_orig=_TIME, dt_mod=_TIME,
    dt_import=_TEXT,
)
TAG = _schema(md5hash=_TEXT, meta=_TEXT, width=_INT, height=_INT)
LOCATION = _schema(md5hash=_TEXT, lat=_REAL, long=_REAL, elev_m=_REAL, wkt=_TEXT)

# Tags of one file; NULL when it holds no metadata.
TAG_LIST = T.ArrayType(_schema(key=_TEXT, field_type=_TEXT, value=_TEXT))
# What the metadata reader returns for a file.
HEADER = _schema(tags=TAG_LIST, width=_INT, height=_INT, failed=T.BooleanType())
SCAN_RECORD = _schema(
    path=_TEXT, root=_TEXT, fname=_TEXT, ftype=_TEXT, md5hash=_TEXT, dt_mod=_TIME, msg=_TEXT,
    tags=TAG_LIST, width=_INT, height=_INT,
)
FILE = _schema(
    path=_TEXT, modificationTime=T.TimestampType(), length=T.LongType(), content=T.BinaryType()
)

# Catalog table name -> schema.
TABLES = {"import": IMPORT, "hash": HASH, "photo": PHOTO, "tag": TAG, "location": LOCATION}


@dataclass(frozen=True)
class Catalog:
    """The five catalog tables. Operators return a new ``Catalog``."""

    imports: DataFrame
    hash: DataFrame
    photo: DataFrame
    tag: DataFrame
    location: DataFrame

    def replace(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "import": self.imports,
            "hash": self.hash,
            "photo": self.photo,
            "tag": self.tag,
            "location": self.location,
        }

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> Catalog:
        return cls(
            imports=tables["import"],
            hash=tables["hash"],
            photo=tables["photo"],
            tag=tables["tag"],
            location=tables["location"],
        )

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        def table(schema: T.StructType) -> DataFrame:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            return spark.range(0).select(*nothing)

        return cls.of({name: table(schema) for name, schema in TABLES.items()})
