"""Lists of the five resources: which parameters each takes, its orders, and pages that start after a key."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.scalars import contains_folded

YES = ("1", "true", "yes")


@dataclass(frozen=True)
class Resource:
    """What a list may be asked for. Parameters name columns of their own name unless ``columns`` says otherwise."""

    exact: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    orders: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    key: str = ""
    columns: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return F.col(self.columns.get(name, name))


_NAMES = {"cluster": "cluster_name", "namespace": "ns_name", "workload": "wl_name"}
RESOURCES = {
    "cluster": Resource(("environment", "provider", "region"), ("name",), (), ("name", "environment", "last_seen_at"), ("name",), "cluster_id", {"name": "cluster_name", "environment": "env"}),
    "namespace": Resource(("cluster",), ("name",), ("active", "internet_exposed", "contains_sensitive_data"), ("name", "last_seen_at"), ("cluster", "name"), "ns_id", _NAMES | {"name": "ns_name", "internet_exposed": "ns_exposed", "contains_sensitive_data": "sensitive"}),
    "workload": Resource(("cluster", "namespace", "kind"), ("name",), ("deployed", "publicly_exposed"), ("name", "kind", "last_inventory_at", "last_seen_at"), ("cluster", "namespace", "kind", "name"), "wl_id", _NAMES | {"name": "wl_name", "publicly_exposed": "exposed"}),
    "finding": Resource(("cluster", "workload", "namespace", "image", "severity", "effective_priority", "source", "category"), ("vuln_id", "pkg_name"), ("kev_listed",), ("severity", "effective_priority", "epss_score", "last_seen", "first_seen"), ("-last_seen",), "finding_id", _NAMES | {"image": "image_digest", "effective_priority": "band"}),
    "image": Resource(("registry", "os_family", "os_version"), ("repository", "ref"), ("currently_deployed",), ("ref", "first_seen_at", "last_seen_at"), ("ref",), "image_id"),
}


def filtered(rows: DataFrame, resource: str, params: dict[str, str]) -> DataFrame:
    """Rows that fit ``params``, texts as they come with a request; empty ones ask nothing, unknown ones are ignored.

    Flags hold for 1, true and yes, whatever the case, and are unset for any other text.
    """
    r = RESOURCES[resource]
    for name, text in params.items():
        if not text:
            continue
        if name in r.exact:
            rows = rows.where(r.column(name) == text)
        elif name in r.contains:
            rows = rows.where(contains_folded(r.column(name), text))
        elif name in r.flags:
            rows = rows.where(r.column(name) == F.lit(text.lower() in YES))
    return rows


def order_of(resource: str, params: dict[str, str]) -> list[tuple[str, bool]]:
    """(column, descending) of the order asked for, comma-separated with a minus for descending; unknown names are left out."""
    r = RESOURCES[resource]
    asked = [n for n in (params.get("ordering") or "").split(",") if n.removeprefix("-") in r.orders]
    return [(r.columns.get(n.removeprefix("-"), n.removeprefix("-")), n.startswith("-")) for n in asked or r.order] + [(r.key, False)]


def page(rows: DataFrame, resource: str, params: dict[str, str], size: int = 25, after: tuple | None = None) -> DataFrame:
    """The first ``size`` rows in the order asked for, or those after the row whose order values are ``after``.

    ``after`` are the values of the last row of the page before, in ``order_of``; the key at its end makes them unique.
    Any page costs a filter and a top-``size``, however far down the list it lies.
    """
    order = order_of(resource, params)
    rows = filtered(rows, resource, params)
    if after is not None:
        beyond, same = [], F.lit(True)
        for (name, down), value in zip(order, after, strict=True):
            own = F.col(name)
            if value is None:  # null is the least
                further = F.lit(False) if down else own.isNotNull()
            else:
                further = F.coalesce(own < F.lit(value), F.lit(True)) if down else F.coalesce(own > F.lit(value), F.lit(False))
            beyond.append(same & further)
            same = same & own.eqNullSafe(F.lit(value))
        rows = rows.where(reduce(Column.__or__, beyond))
    return rows.orderBy(*[F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, down in order]).limit(size)


def last_of(rows: DataFrame, resource: str, params: dict[str, str]) -> tuple | None:
    """What the next page comes after: the order values of the last row of a page, which has at most its size of rows."""
    names = [n for n, _ in order_of(resource, params)]
    found = rows.select(*names).tail(1)
    return tuple(found[0]) if found else None


def with_deployed(images: DataFrame, in_use: DataFrame, cluster: str | None = None) -> DataFrame:
    """``images`` with currently_deployed: whether a deployed container (image_id, cluster_name) runs it, in one cluster or in any."""
    use = in_use if cluster is None else in_use.where(F.col("cluster_name") == cluster)
    used = use.select("image_id").distinct().withColumn("used_", F.lit(True))
    return images.join(used, "image_id", "left").withColumn("currently_deployed", F.coalesce("used_", F.lit(False))).drop("used_")
