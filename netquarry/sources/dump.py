"""Configuration snapshots with the listing of their partitions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from netquarry.functions.dates import as_date
from netquarry.sources.readers import CM_SCHEMA, read_cm


class Dump:
    """Snapshots partitioned by ``raml_date, mo_class``, below a path or in a table.

    Which days and classes there are is looked up where it is written down, in the catalog or in the names
    of the folders; no data file is opened for it.  Rows of one day are then read from that day's folders
    alone, however many days there are.  Takes the place of the snapshot frame in all audits.
    """

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location = spark, location.rstrip("/")

    def partitions(self, day: str | date | None = None, mo_class: str | None = None) -> list[tuple[date, str]]:
        """The (day, class) pairs that exist, sorted, of one day or class if given."""
        wanted = "*" if day is None else str(as_date(day)), "*" if mo_class is None else mo_class
        if "/" in self.location:
            found = self._folders(*wanted)
        else:
            names = [f"raml_date = '{wanted[0]}'"] * (day is not None) + [f"mo_class = '{wanted[1]}'"] * (mo_class is not None)
            chosen = f" PARTITION ({', '.join(names)})" if names else ""
            found = [r[0] for r in self.spark.sql(f"SHOW PARTITIONS {self.location}{chosen}").collect()]
        pairs = (dict(part.split("=", 1) for part in name.split("/")) for name in found)
        return sorted((as_date(p["raml_date"]), p["mo_class"]) for p in pairs if not p["raml_date"].startswith("__HIVE"))

    def _folders(self, day: str, mo_class: str) -> list[str]:
        """``raml_date=.../mo_class=...`` of the folders."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.location}/raml_date={day}/mo_class={mo_class}")
        system = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return ["/".join(str(s.getPath().toString()).rsplit("/", 2)[1:]) for s in system.globStatus(pattern) or []]

    def newest(self, mo_class: str | None = None) -> date | None:
        """The newest day, of one class if given; None if there is none."""
        found = self.partitions(mo_class=mo_class)
        return found[-1][0] if found else None

    def rows(self, mo_class: str | None = None, day: str | date | None = None) -> DataFrame:
        """Rows of a class or day, or all."""
        if "/" not in self.location or (mo_class is None and day is None):
            return read_cm(self.spark, self.location, mo_class, day)
        folders = sorted({f"{self.location}/raml_date={d}/mo_class={c}" for d, c in self.partitions(day, mo_class)})
        if not folders:
            return self.spark.createDataFrame([], CM_SCHEMA)
        return self.spark.read.schema(CM_SCHEMA).option("basePath", self.location).parquet(*folders)
