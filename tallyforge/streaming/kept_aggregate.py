"""Aggregates kept from batch to batch, with rows that come and rows that are taken back.

Outside what the reference describes: a general addition.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeptAggregate:
    """Count, sum, least and greatest value by key, as versions of a table in a shared folder.

    The state is how often each value of a key is there, so that the least and greatest can be taken back too. Each batch has a number;
    version n is the state after batch n, written whole beside the older ones and valid once its writer has marked it (_SUCCESS). A batch whose number isn't above the
    latest version's changes nothing, so a batch that is replayed after a failure counts once; one that failed half-way leaves
    no mark and is written anew. Use ``apply`` as the function of foreachBatch.

    Defined results: a null key is a key, a null value counts as a row of no value; a row taken back before it came leaves a count below
    zero, which its coming settles; keys without rows aren't returned; an empty batch makes a version as any other.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], value: str, sign: str = "sign", kept: int = 2):
        self.spark, self.path, self.keys, self.value, self.sign, self.kept = spark, path, keys, value, sign, kept

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _path(self, version: int) -> str:
        return f"{self.path}/version={version:020}"

    def versions(self) -> list[int]:
        """The valid versions in order."""
        fs, folder = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def state(self, version: int | None = None) -> DataFrame | None:
        """(keys, value, times) of a version, the latest by default."""
        versions = self.versions()
        if not versions:
            return None
        return self.spark.read.parquet(self._path(versions[-1] if version is None else version))

    def apply(self, batch: DataFrame, number: int) -> bool:
        """Takes in the rows of a batch, sign 1 to come and -1 to go; False if it was taken in before."""
        versions = self.versions()
        if versions and number <= versions[-1]:
            return False
        changes = batch.select(*self.keys, F.col(self.value), F.col(self.sign).cast("long").alias("times"))
        old = self.state()
        rows = changes if old is None else old.unionByName(changes)
        new = rows.groupBy(*self.keys, self.value).agg(F.sum("times").alias("times")).where("times <> 0")
        new.write.mode("overwrite").parquet(self._path(number))
        fs, _ = self._files()
        for v in versions[: -self.kept + 1 or None] if self.kept > 1 else versions:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(v)), True)
        return True

    def aggregates(self) -> DataFrame:
        """(keys, n, total, least, greatest) of the latest version."""
        state = self.state()
        if state is None:
            raise ValueError("no batch was taken in yet")
        held = F.col("times") > 0
        out = state.groupBy(*self.keys).agg(
            F.sum("times").alias("n"), F.sum(F.col(self.value) * F.col("times")).alias("total"), F.min(F.when(held, F.col(self.value))).alias("least"), F.max(F.when(held, F.col(self.value))).alias("greatest")
        )
        return out.where("n > 0")
