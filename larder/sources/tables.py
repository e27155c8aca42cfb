"""Stored tables that change in place: UPDATE, MERGE, DELETE and INSERT with copy-on-write of files.

A table is a folder of Parquet files and the versions that list them (``larder.sources.manifest``). A change finds the files that
hold a row it concerns (``_metadata.file_path``), writes those rows anew, and makes a version that lists the new files and the untouched
ones under their old names. Until that version appears readers see the old table, and a failure on the way leaves it as it was.
Old versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources import manifest
from larder.sources.io import merge_update, update_where


@dataclass(frozen=True)
class StoredTable:
    """A version of the table in ``path``."""

    spark: SparkSession
    path: str
    version: int
    schema: T.StructType
    files: tuple[str, ...]

    @classmethod
    def create(cls, df: DataFrame, path: str) -> StoredTable:
        """A new table with these rows; ``Conflict`` where one is."""
        empty = cls(df.sparkSession, path, 0, df.schema, ())
        return empty._commit(empty._write(df))

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> StoredTable:
        number, content = manifest.read(spark, path, version)
        if not number:
            raise FileNotFoundError(f"no table in {path}")
        return cls(spark, path, number, T.StructType.fromJson(content["schema"]), tuple(content["files"]))

    def _read(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))

    def _write(self, df: DataFrame) -> tuple[str, ...]:
        """The files of a new folder, named from the table's folder."""
        folder = f"data/{uuid.uuid4().hex}"
        df.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/{folder}")
        fs, place = manifest._at(self.spark, f"{self.path}/{folder}")
        names = (s.getPath().getName() for s in fs.listStatus(place))
        return tuple(sorted(f"{folder}/{n}" for n in names if not n.startswith(("_", "."))))

    def _commit(self, files: Sequence[str]) -> StoredTable:
        content = {"schema": self.schema.jsonValue(), "files": sorted(files)}
        version = manifest.commit(self.spark, self.path, self.version, content)
        return StoredTable(self.spark, self.path, version, self.schema, tuple(content["files"]))

    def _holding(self, rows: DataFrame) -> list[str]:
        """Files that hold these rows of the table: one name per file comes to the driver, as for any scan."""
        found = rows.select("_file").distinct().collect()
        ends = {"/".join(r[0].rsplit("/", 3)[-3:]) for r in found}
        return [f for f in self.files if f in ends]

    def _rewrite(self, touched: Sequence[str], rows: DataFrame) -> StoredTable:
        """The table with ``rows`` in place of those of the touched files."""
        if not touched:
            return self
        rest = [f for f in self.files if f not in set(touched)]
        return self._commit([*rest, *self._write(rows)])

    def _with_file(self) -> DataFrame:
        df = self._read(self.files)
        return df.withColumn("_file", F.col("_metadata.file_path") if self.files else F.lit(""))

    def read(self) -> DataFrame:
        return self._read(self.files)

    def insert(self, df: DataFrame) -> StoredTable:
        return self._commit([*self.files, *self._write(df)])

    def update(self, condition: Column, values: Mapping[str, Column]) -> StoredTable:
        """UPDATE ... SET ... WHERE; a null condition changes nothing."""
        touched = self._holding(self._with_file().where(condition))
        return self._rewrite(touched, update_where(self._read(touched), condition, values))

    def merge(self, source: DataFrame, key: str, cols: Sequence[str], insert: bool = False) -> StoredTable:
        """MERGE ... WHEN MATCHED THEN UPDATE [WHEN NOT MATCHED THEN INSERT]; repeated keys in ``source`` raise.

        A null key matches nothing; with ``insert`` its row is new. Columns that ``source`` lacks are null in new rows.
        """
        keys = source.select(key)
        touched = self._holding(self._with_file().join(keys.where(F.col(key).isNotNull()), key, "left_semi"))
        changed = merge_update(self._read(touched), source, key, cols)
        if not insert:
            return self._rewrite(touched, changed)
        new = source.join(self._read(self.files).select(key), key, "left_anti")
        lacking = {f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in source.columns}
        new = new.withColumns(lacking).select(*self.schema.fieldNames())
        rest = [f for f in self.files if f not in set(touched)]
        return self._commit([*rest, *self._write(changed.select(*self.schema.fieldNames()).unionByName(new))])

    def delete(self, ids: DataFrame, key: str) -> StoredTable:
        """Without the rows of these keys."""
        gone = ids.select(key).distinct()
        touched = self._holding(self._with_file().join(gone, key, "left_semi"))
        return self._rewrite(touched, self._read(touched).join(gone, key, "left_anti"))

    def vacuum(self) -> int:
        """Deletes the data folders that no file of this version lies in, and earlier versions; the number of folders."""
        keep = {f.split("/")[1] for f in self.files}
        fs, data = manifest._at(self.spark, f"{self.path}/data")
        old = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in keep]
        for number in manifest.versions(self.spark, self.path):
            if number < self.version:
                fs.delete(manifest._at(self.spark, f"{self.path}/{manifest.FOLDER}/{number:012d}.json")[1], False)
        for p in old:
            fs.delete(p, True)
        return len(old)


def delete_from(parents: StoredTable, children: StoredTable, ids: DataFrame, key: str = "conversation_id") -> tuple[StoredTable, StoredTable]:
    """Rows of these keys leave both tables, the children's first, so that no child is ever without its parent."""
    kept = children.delete(ids, key)
    return parents.delete(ids, key), kept
