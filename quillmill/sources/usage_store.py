"""Usage counts as an append-only log of batches, merged into snapshots from time to time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "day date, user string, op string, n long"


class UsageStore:
    """Counts per day, user and op in a folder that all executors see.

    ``log/<batch>`` holds a batch's counts, ``snapshots/<version>`` those of all batches
    up to one, and ``versions/<version>`` says up to which; it is written under
    another name and renamed once its snapshot is whole, so a crash leaves the last
    version as it was. Readers take the newest version and the batches after it.
    There is one compaction at a time; appends and reads go on beside it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def place(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def numbers(self, folder: str) -> list[int]:
        """The numbered entries of a folder, in order."""
        at = self.place(folder)
        found = [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(x) for x in found if x.isdigit())

    def version(self) -> dict:
        """The newest version: its number and the last batch in it; -1 and -1 before the first."""
        done = self.numbers("versions")
        if not done:
            return {"version": -1, "last": -1}
        source = self.fs.open(self.place(f"versions/{done[-1]}"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)))
        finally:
            source.close()

    def append(self, events: DataFrame, batch: int, ts: str = "ts", user: str = "user", op: str = "op") -> None:
        """Add a batch of events. Batches are numbered upwards; one that runs again replaces itself, unless a snapshot holds it already."""
        if batch <= self.version()["last"]:
            return
        per = events.groupBy(F.to_date(ts).alias("day"), F.col(user).cast("string").alias("user"), F.col(op).alias("op")).agg(F.count("*").alias("n"))
        per.write.mode("overwrite").parquet(f"{self.path}/log/{batch}")

    def parts(self, version: dict, to: int | None = None) -> list[str]:
        """Folders that hold the counts of a version and of later batches."""
        held = [f"{self.path}/snapshots/{version['version']}"] if version["version"] >= 0 else []
        return held + [f"{self.path}/log/{b}" for b in self.whole() if b > version["last"] and (to is None or b <= to)]

    def whole(self) -> list[int]:
        """Batches that are written to their end."""
        return [b for b in self.numbers("log") if self.fs.exists(self.place(f"log/{b}/_SUCCESS"))]

    def read(self) -> DataFrame:
        """day, user, op, n of all batches."""
        return self.summed(self.parts(self.version()))

    def summed(self, parts: list[str]) -> DataFrame:
        rows = self.spark.read.schema(COUNTS).parquet(*parts) if parts else self.spark.createDataFrame([], COUNTS)
        return rows.groupBy("day", "user", "op").agg(F.sum("n").alias("n"))

    def compact(self) -> bool:
        """Merge the newest version and the batches after it into the next version; False if there are none."""
        now, batches = self.version(), self.whole()
        if not batches or batches[-1] <= now["last"]:
            return False
        new = {"version": now["version"] + 1, "last": batches[-1]}
        self.summed(self.parts(now, new["last"])).write.mode("overwrite").parquet(f"{self.path}/snapshots/{new['version']}")
        self.commit(new)
        return True

    def commit(self, version: dict) -> None:
        draft, final = self.place(f"versions/_{version['version']}"), self.place(f"versions/{version['version']}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        if not self.fs.rename(draft, final):
            raise OSError(f"{final} is there already")

    def clean(self, keep: int = 2) -> None:
        """Remove what only versions before the last ``keep`` need; readers of those must be done."""
        versions = self.numbers("versions")
        for v in versions[:-keep]:
            self.fs.delete(self.place(f"versions/{v}"), True)
        if len(versions) >= keep:
            oldest = versions[-keep]
            for v in [v for v in self.numbers("snapshots") if v < oldest]:
                self.fs.delete(self.place(f"snapshots/{v}"), True)
            source = self.fs.open(self.place(f"versions/{oldest}"))
            last = json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)))["last"]
            source.close()
            for b in [b for b in self.numbers("log") if b <= last]:
                self.fs.delete(self.place(f"log/{b}"), True)
