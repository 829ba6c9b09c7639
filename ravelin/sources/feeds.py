"""Exploit-intelligence feeds, and the folder in which import cycles land."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.scalars import blank, tolerant_date

ENVELOPE = "cluster string, kind string, import_id string, phase string, payload string, complete_snapshot boolean, observed_count long, created_at timestamp_ntz"
_NUMBERS = "0123456789abcdefghjkmnpqrstvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one on a single machine without that setting, an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="ravelin-shared-")
    return shared


def epss_rows(lines: DataFrame) -> DataFrame:
    """vuln_id, score, percentile from lines (value: string); preamble, header, short and non-numeric rows are left out.

    Of several rows of an id the one with the highest score stays, then the highest percentile.
    """
    row = F.from_csv("value", "cve string, epss string, percentile string")
    rows = lines.where("value NOT LIKE '#%'").select(row.alias("r")).select(F.trim("r.cve").alias("vuln_id"), F.col("r.epss").try_cast("double").alias("score"), F.col("r.percentile").try_cast("double").alias("percentile"))
    rows = rows.where("vuln_id <> '' AND lower(vuln_id) <> 'cve' AND score IS NOT NULL AND percentile IS NOT NULL")
    return rows.groupBy("vuln_id").agg(F.max(F.struct("score", "percentile")).alias("m")).select("vuln_id", "m.score", "m.percentile")


def epss(spark: SparkSession, path: str) -> DataFrame:
    return epss_rows(spark.read.text(path))


def kev_rows(documents: DataFrame) -> DataFrame:
    """vuln_id and dates of known exploited vulnerabilities from documents (value: JSON); an unreadable one gives no rows.

    Of several rows of an id the one added last stays, then by its other columns.
    """
    item = "struct<cveID:string,dateAdded:string,shortDescription:string,requiredAction:string,dueDate:string>"
    rows = documents.select(F.explode(F.from_json("value", f"struct<vulnerabilities:array<{item}>>")["vulnerabilities"]).alias("v")).where("v.cveID <> ''")
    columns = {"added_at": tolerant_date(F.col("v.dateAdded")), "due_date": tolerant_date(F.col("v.dueDate")), "short_description": blank(F.col("v.shortDescription")), "required_action": blank(F.col("v.requiredAction"))}
    rows = rows.select(F.col("v.cveID").alias("vuln_id"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("m"))
    return rows.groupBy("vuln_id").agg(F.max("m").alias("m")).select("vuln_id", *[f"m.{n}" for n in columns])


def kev(spark: SparkSession, path: str) -> DataFrame:
    return kev_rows(spark.read.text(path, wholetext=True))


def cycle_id(at: float | None = None, tail: str | None = None) -> str:
    """26 characters that sort by time: ten for the millisecond, sixteen at random."""
    number = int((time.time() if at is None else at) * 1000)
    head = "".join(_NUMBERS[number >> 5 * k & 31] for k in range(9, -1, -1))
    return head + (tail or "".join(_NUMBERS[x & 31] for x in uuid.uuid4().bytes))


def landed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Envelopes from the landing folder, as a batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ENVELOPE).json(path)


def cycle_lines(cluster: str, import_id: str, by_kind: dict[str, list[dict]], created_at: str) -> list[str]:
    """The envelopes of one cycle: inventory first, then scans, then a finish for every kind given, empty ones too."""
    kinds = sorted(by_kind, key=lambda k: (k != "inventory", k))
    base = {"cluster": cluster, "import_id": import_id, "created_at": created_at}
    rows = [base | {"kind": k, "phase": "item", "payload": json.dumps(item), "complete_snapshot": k == "inventory"} for k in kinds for item in by_kind[k]]
    rows += [base | {"kind": k, "phase": "finish", "observed_count": len(by_kind[k])} for k in kinds]
    return [json.dumps(r) for r in rows]


def land(spark: SparkSession, path: str, lines: list[str], name: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(str(PurePosixPath(path) / name) if "://" not in path else f"{path}/{name}")
