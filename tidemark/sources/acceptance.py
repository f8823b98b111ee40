"""Landing and acceptance of batches on plain files, with versions of partitions and pointers to them.

    batches/<batch>/rows        the rows as they came (Parquet)
    batches/<batch>/landed      what is known of the batch; once it is there, the batch is landed
    batches/<batch>/rejected    why it was turned down
    versions/<partition>/<batch>   the accepted rows of a partition (Parquet)
    pointers/<partition>/<number>  which version holds from then on; the highest number is the current one

A batch becomes visible by one rename of a small file, its pointer; everything before that can break off at any point and is
done again by the same call. Readers go by pointers only, so they see the old version or the new one, never a mixture.
One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.sources.sinks import _fs


class AcceptanceError(Exception):
    """The call does not fit the batch or the contract; nothing was changed."""


@dataclass(frozen=True)
class Contract:
    """What a dataset asks of its rows. rules: (code, condition that makes a row bad), tried in this order."""

    dataset: str
    version: str
    partition: str
    grain: list[str]
    rules: list[tuple[str, Column]] = field(default_factory=list)
    least_rows: int = 1


@dataclass(frozen=True)
class Outcome:
    status: str
    batch: str
    partition: str
    rows: int = 0
    content_hash: str | None = None
    code: str | None = None


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Rows, and a hash of the multiset of rows: their order and their files do not matter."""
    one = df.select(F.xxhash64(F.lit("a"), *df.columns).alias("a"), F.xxhash64(F.lit("b"), *df.columns).alias("b"))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    r = one.agg(F.count(F.lit(1)).alias("n"), total("a").alias("a"), total("b").alias("b")).first()
    return r["n"], hashlib.sha256(f"{sorted(df.dtypes)}:{r['n']}:{r['a']}:{r['b']}".encode()).hexdigest()


class Store:
    """One dataset under a folder that driver and executors share. after: called with the name of each step that ended."""

    def __init__(self, spark: SparkSession, root: str, contract: Contract, after: Callable[[str], None] | None = None) -> None:
        self.spark, self.root, self.contract, self.after = spark, root.rstrip("/"), contract, after or (lambda step: None)

    # --- files

    def _write(self, path: str, what: dict) -> None:
        """A small file that is there whole or not at all."""
        fs, P = _fs(self.spark, path)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        fs.mkdirs(P(path).getParent())
        out = fs.create(P(tmp), True)
        out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
        out.close()
        if not fs.rename(P(tmp), P(path)):
            fs.delete(P(tmp), False)
            raise AcceptanceError(f"{path} cannot be written")

    def _read(self, path: str) -> dict | None:
        fs, P = _fs(self.spark, path)
        if not fs.exists(P(path)):
            return None
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(P(path)), "UTF-8"))

    def _names(self, path: str) -> list[str]:
        fs, P = _fs(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(P(path))) if fs.exists(P(path)) else []

    def _batch(self, batch: str) -> str:
        return f"{self.root}/batches/{quote(batch, safe='')}"

    def _pointers(self, partition: str) -> list[dict]:
        at = f"{self.root}/pointers/{quote(partition, safe='')}"
        return [self._read(f"{at}/{n}") for n in self._names(at) if not n.endswith(".tmp")]

    # --- landing

    def land(self, batch: str, rows: DataFrame, partition: str, source: str, observed_at: datetime, available_at: datetime, request: dict | None = None) -> str:
        """Keep rows as they came. The same batch again adds nothing; another payload under its name is an error.

        Rows are not checked here, but there must be some, and they cannot be available before they were observed.
        """
        if not batch.strip():
            raise AcceptanceError("a batch needs a name")
        if available_at < observed_at:
            raise AcceptanceError(f"available at {available_at}, before it was observed at {observed_at}")
        n, rows_hash = content_hash(rows)
        if not n:
            raise AcceptanceError(f"{batch} has no rows")
        facts = {
            "batch": batch, "partition": partition, "source": source, "contract_version": self.contract.version, "observed_at": observed_at.isoformat(), "available_at": available_at.isoformat(),
            "request": request or {}, "rows": n, "rows_hash": rows_hash,
        }
        facts["payload_hash"] = hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()
        at = self._batch(batch)
        known = self._read(f"{at}/landed")
        if known:
            if known["payload_hash"] == facts["payload_hash"]:
                return batch
            raise AcceptanceError(f"{batch} is landed with another payload")
        rows.write.mode("overwrite").parquet(f"{at}/rows")
        self.after("rows written")
        self._write(f"{at}/landed", facts)
        self.after("landed")
        return batch

    # --- acceptance

    def accept(self, batch: str) -> Outcome:
        """Check a landed batch against the contract and make it the current version of its partition, or turn it down.

        An outcome that stands is returned again. A call that broke off is repeated from where its files end.
        """
        at = self._batch(batch)
        facts = self._read(f"{at}/landed")
        if facts is None:
            raise AcceptanceError(f"{batch} is not landed")
        partition = facts["partition"]
        for p in self._pointers(partition):
            if p["batch"] == batch:
                return Outcome("ACCEPTED", batch, partition, p["rows"], p["content_hash"])
        bad = self._read(f"{at}/rejected")
        if bad:
            return Outcome("REJECTED", batch, partition, code=bad["code"])
        code = self._check(facts)
        if code:
            self._write(f"{at}/rejected", {"batch": batch, "code": code})
            self.after("rejected")
            return Outcome("REJECTED", batch, partition, code=code)
        version = f"{self.root}/versions/{quote(partition, safe='')}/{quote(batch, safe='')}"
        rows = self.spark.read.parquet(f"{at}/rows").withColumn("batch_id", F.lit(batch)).withColumn("available_at", F.lit(facts["available_at"]).cast("timestamp"))
        rows.write.mode("overwrite").parquet(version)
        self.after("version written")
        written = self.spark.read.parquet(version)
        n, content = content_hash(written.drop("batch_id", "available_at"))
        if n != facts["rows"]:
            raise AcceptanceError(f"{batch}: {n} rows were written of {facts['rows']}")
        number = max([p["number"] for p in self._pointers(partition)], default=0) + 1
        pointer = {"number": number, "partition": partition, "batch": batch, "version": version, "contract_version": self.contract.version, "rows": n, "content_hash": content, "available_at": facts["available_at"]}
        self._write(f"{self.root}/pointers/{quote(partition, safe='')}/{number:012d}", pointer)
        self.after("pointer written")
        return Outcome("ACCEPTED", batch, partition, n, content)

    def _check(self, facts: dict) -> str | None:
        """Code of the first reason against a batch: its contract, its size, then the most frequent code of its rows."""
        c = self.contract
        if facts["contract_version"] != c.version:
            return "CONTRACT_DRIFT"
        if facts["rows"] < c.least_rows:
            return "BELOW_MIN_ROWS"
        rows = self.spark.read.parquet(f"{self._batch(facts['batch'])}/rows")
        if not {c.partition, *c.grain} <= set(rows.columns):
            return "MISSING_FIELDS"
        other = ~F.col(c.partition).cast("string").eqNullSafe(F.lit(facts["partition"]))
        return A.reject_codes(rows, [("WRONG_PARTITION", other), *c.rules], c.grain).agg(F.mode("reject_code", True).alias("code")).first()["code"]

    # --- reading

    def pointers(self) -> DataFrame:
        """(partition, batch, number, rows, content_hash, version): the current version of each partition. As many rows as partitions."""
        rows = []
        for name in self._names(f"{self.root}/pointers"):
            at = f"{self.root}/pointers/{name}"
            numbers = [n for n in self._names(at) if not n.endswith(".tmp")]
            if numbers:
                p = self._read(f"{at}/{numbers[-1]}")
                rows.append((p["partition"], p["batch"], p["number"], p["rows"], p["content_hash"], p["version"]))
        return self.spark.createDataFrame(rows, "partition string, batch string, number long, rows long, content_hash string, version string")

    def read(self) -> DataFrame | None:
        """Rows of all current versions, with batch_id and available_at; None before anything was accepted."""
        paths = [r["version"] for r in self.pointers().select("version").collect()]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def parity(self) -> DataFrame:
        """(partition, batch, rows, members, intact): rows that pointers promise against rows that are there."""
        rows, p = self.read(), self.pointers().select("partition", "batch", "rows")
        if rows is None:
            return p.withColumn("members", F.lit(0).cast("long")).withColumn("intact", F.lit(False))
        have = rows.groupBy(F.col("batch_id").alias("batch"), F.col(self.contract.partition).cast("string").alias("partition")).agg(F.count(F.lit(1)).alias("members"))
        return p.join(have, ["partition", "batch"], "left").withColumn("members", F.coalesce("members", F.lit(0))).withColumn("intact", F.col("members") == F.col("rows")).select("partition", "batch", "rows", "members", "intact")

    def pending(self) -> list[str]:
        """Landed batches that are neither accepted nor rejected: what a writer has to take up again after a crash."""
        out = []
        for name in self._names(f"{self.root}/batches"):
            at = f"{self.root}/batches/{name}"
            facts = self._read(f"{at}/landed")
            if facts and not self._read(f"{at}/rejected") and all(p["batch"] != facts["batch"] for p in self._pointers(facts["partition"])):
                out.append(facts["batch"])
        return out

    def sweep(self) -> list[str]:
        """Delete versions that no pointer names any more or yet (what a crash left), and return their batches.

        Not while a reader may still hold an old version.
        """
        current = {(r["partition"], r["batch"]) for r in self.pointers().select("partition", "batch").collect()}
        gone = []
        for part in self._names(f"{self.root}/versions"):
            for batch in self._names(f"{self.root}/versions/{part}"):
                if (part, batch) not in {(quote(p, safe=""), quote(b, safe="")) for p, b in current}:
                    path = f"{self.root}/versions/{part}/{batch}"
                    fs, P = _fs(self.spark, path)
                    fs.delete(P(path), True)
                    gone.append(batch)
        return gone
