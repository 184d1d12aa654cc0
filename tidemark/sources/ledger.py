"""A ledger: appends that succeed or fail as a whole, and reads of whole versions.

The rows of an append are written to a folder of their own that nobody reads. Then a small file names that folder, under
the number of the next version; such a file can be created only once, so of two writers one gets the number and the other
looks again, at what is now there, before it tries the number after. A version is the first so many of these files, so
a reader never sees half an append, and what a writer leaves behind that dies before its file is there is never read.

    <path>/rows/<kind>-<unique>/*.parquet      rows of one append
    <path>/versions/<number>                   one line of JSON: kind, folder, note
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(RuntimeError):
    """What an append was subject to does not hold in the version that it would follow."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """How many appends there are. Numbers have no gaps, as each is created after the one before was seen."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def entries(self, version: int | None = None) -> list[dict]:
        """What each append up to a version says: kind, folder, note. One small file each."""
        upto = self.version() if version is None else version
        if not upto:
            return []
        lines = self.spark.read.text([f"{self.path}/versions/{n:012d}" for n in range(1, upto + 1)]).select(F.input_file_name().alias("f"), "value").collect()
        return [json.loads(r["value"]) for r in sorted(lines, key=lambda r: r["f"])]

    def read(self, kind: str, schema: str, version: int | None = None) -> DataFrame:
        """All rows of a kind as of a version (default: now)."""
        folders = [f"{self.path}/rows/{e['folder']}" for e in self.entries(version) if e["kind"] == kind]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def append(self, kind: str, rows: DataFrame, given: Callable[[int], bool] | None = None, note: str = "") -> int:
        """Append rows and return the new version. ``given`` takes the version before and must hold there, or the append is Refused."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        written = False
        while True:
            before = self.version()
            if given is not None and not given(before):
                raise Refused(f"{kind}: {note or 'the condition does not hold'}")
            if not written:
                rows.write.parquet(f"{self.path}/rows/{folder}")
                written = True
            if self._create(f"versions/{before + 1:012d}", json.dumps({"kind": kind, "folder": folder, "note": note})):
                return before + 1

    def _create(self, name: str, line: str) -> bool:
        """Create a whole file under a name that is not there yet; False if it is. It is written elsewhere first."""
        draft, target = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        self._fs.mkdirs(draft.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray((line + "\n").encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":  # a link to a name that exists fails, at once and for all writers
            local = lambda p: self._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString()
            try:
                os.link(local(draft), local(target))
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, target, none)  # atomic, and no overwriting
            return True
        except Exception:
            if self._fs.exists(target):
                self._fs.delete(draft, False)
                return False
            raise


# what research keeps in it

TRIALS = "family string, spec_hash string, tier string, sharpe double, n long"
UNSEALED = "family string, spec_hash string, asked_by string"
SPLIT = "b_start timestamp_ntz, c_start timestamp_ntz"


def record_trials(ledger: Ledger, trials: DataFrame) -> int:
    return ledger.append("trials", trials.select("family", "spec_hash", "tier", "sharpe", "n"), note="trials")


def family_trials(ledger: Ledger, version: int | None = None) -> DataFrame:
    """family, trials, distinct_trials, var_sharpe: how often a family was tried, which its best result is judged by."""
    t = ledger.read("trials", TRIALS, version)
    finite = F.when(~F.isnan("sharpe") & (F.abs("sharpe") < float("inf")), F.col("sharpe"))
    return t.groupBy("family").agg(F.count("*").alias("trials"), F.count_distinct("spec_hash", "tier").alias("distinct_trials"), F.var_samp(finite).alias("var_sharpe"))


def unseal(ledger: Ledger, family: str, spec_hash: str, asked_by: str) -> bool:
    """Whether a family's hold-out may be looked at: once for each family, whoever asks first."""
    row = ledger.spark.createDataFrame([(family, spec_hash, asked_by)], UNSEALED)
    sealed = lambda version: ledger.read("unsealed", UNSEALED, version).where(F.col("family") == family).isEmpty()
    try:
        ledger.append("unsealed", row, given=sealed, note=f"{family} is open already")
        return True
    except Refused:
        return False


def frozen_split(ledger: Ledger, b_start, c_start) -> tuple:
    """The tiers' bounds that were frozen first; later proposals change nothing."""
    try:
        ledger.append("split", ledger.spark.createDataFrame([(b_start, c_start)], SPLIT), given=lambda v: ledger.read("split", SPLIT, v).isEmpty(), note="the split is frozen")
    except Refused:
        pass
    return tuple(ledger.read("split", SPLIT).first())
