"""What lands from outside, judged: requests to start and finish a cycle and its items, each accepted or refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Why a request is refused, in the order in which it is looked at.
REASONS = ("unreadable", "malformed", "cluster is required", "kind and import_id are required", "observed_count is required", "payload is required", "not started")


_BODY = "struct<cluster:variant, kind:variant, import_id:variant, payload:variant, observed_count:variant, complete_snapshot:variant>"


def _fields(value: Column) -> Column:
    """The fields of a request as variants, each null where it is missing or null; all null unless ``value`` is an object."""
    body = F.try_variant_get(F.try_parse_json(value), "$", _BODY)
    return F.transform(F.array(body), lambda b: F.when(b.isNotNull(), F.struct(*[F.when(~F.is_variant_null(b[n]), b[n]).alias(n) for n in ("cluster", "kind", "import_id", "payload", "observed_count", "complete_snapshot")])))[0]


def _text(value: Column) -> Column:
    """A text, blanks at its ends left out; what is missing is empty. Numbers and the like give null."""
    return F.when(value.isNull(), "").when(F.schema_of_variant(value) == "STRING", F.trim(F.try_variant_get(value, "$", "string")))


def truthy(value: Column) -> Column:
    """Whether a field counts as set: not missing, false, zero or empty."""
    return F.coalesce(~F.to_json(value).isin("false", "0", '""', "[]", "{}", "0.0"), F.lit(False))


def judged(requests: DataFrame) -> DataFrame:
    """``requests`` (phase: start, item or finish; value: JSON) with their fields and reason, null where accepted.

    payload is a VARIANT; complete_snapshot is true where the request or the payload, which has to be an object, says
    so. That a finish has a start is for ``started`` to tell. A value that is null or no JSON object is unreadable; a
    cluster, kind or import that is no text makes it malformed, and so does a count that is no number.
    """
    rows = requests.withColumn("body_", _fields(F.col("value")))
    rows = rows.select("*", *[_text(F.col(f"body_.{n}")).alias(n) for n in ("cluster", "kind", "import_id")], F.col("body_.payload").alias("payload"), F.try_variant_get("body_.observed_count", "$", "long").alias("count_"))
    inside = F.coalesce(F.schema_of_variant("payload").startswith("OBJECT"), F.lit(False))
    whole = inside & (truthy(F.col("body_.complete_snapshot")) | truthy(F.try_variant_get("payload", "$.complete_snapshot", "variant")))
    finish = F.col("phase") == "finish"
    reason = (
        F.when(F.col("body_").isNull(), "unreadable")
        .when(F.col("cluster").isNull() | F.col("kind").isNull() | F.col("import_id").isNull(), "malformed")
        .when(F.col("cluster") == "", "cluster is required")
        .when((F.col("kind") == "") | (F.col("import_id") == ""), "kind and import_id are required")
        .when(finish & F.col("body_.observed_count").isNull(), "observed_count is required")
        .when(finish & F.col("count_").isNull(), "malformed")
        .when((F.col("phase") == "item") & F.col("payload").isNull(), "payload is required")
    )
    return rows.withColumns({"observed_count": F.when(finish, F.col("count_")), "complete_snapshot": whole, "reason": reason}).drop("body_", "count_")


def registered(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """The names of clusters that judged rows bring in: every one that is not known, also of a request refused for more."""
    named = rows.where("cluster <> ''").select(F.col("cluster").alias("cluster_name")).distinct()
    return named.join(clusters.select("cluster_name"), "cluster_name", "left_anti")


def started(rows: DataFrame) -> DataFrame:
    """Judged rows, where a finish of a cycle that no accepted request started is refused too."""
    key = ["cluster", "kind", "import_id"]
    opened = rows.where("phase = 'start' AND reason IS NULL").select(*key).distinct().withColumn("opened_", F.lit(True))
    out = rows.join(opened, key, "left")
    lost = F.col("reason").isNull() & (F.col("phase") == "finish") & F.col("opened_").isNull()
    return out.withColumn("reason", F.when(lost, "not started").otherwise(F.col("reason"))).drop("opened_")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is accepted, and what is refused, with its text and reason."""
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").select("phase", "value", "reason")
