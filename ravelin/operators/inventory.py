"""What an inventory leaves behind: namespaces, workloads, owners, images, containers and signals, in one commit.

Rows are told apart by cluster, namespace, kind and name. A table's rows of other clusters stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.scalars import blank, filled, internal_balancer, internal_ingress, registry_of, repository_of
from ravelin.operators.resolve import chosen, keyed, owners, settled
from ravelin.sources.reports import Inventory
from ravelin.sources.versions import Commit, Versions

SPACE = ("cluster", "name")
WORKLOAD = ("cluster", "namespace", "kind", "name")
SENSITIVE = "posture.io/contains-sensitive-data"
#: Signals of how a workload is reached, and of a namespace without a network policy.
BALANCER, INGRESS, NODE_PORT, BARE = "kp:has-external-lb", "kp:has-external-ingress", "kp:has-nodeport-service", "kp:missing-networkpolicy"


def node(namespace: str | Column, kind: str | Column, name: str | Column) -> Column:
    return F.concat_ws("/", namespace, kind, name)


def reached(inventory: Inventory) -> DataFrame:
    """(wl_id, signal_id) of workloads that a balancer, an ingress or a node port leads to from outside.

    Balancers and ingresses that are marked as internal lead to nobody. Selectors and labels meet in an equi-join, each
    distinct selector once: there is no row per service and workload.
    """
    services = keyed(inventory.services().select(F.col("namespace").alias("ns_id"), "svc_name", "type", "selector", "annotations"))
    workloads = inventory.workloads().select(node("namespace", "kind", "name").alias("wl_id"), F.col("namespace").alias("ns_id"), "labels")
    kind = F.when((F.col("type") == "LoadBalancer") & ~internal_balancer(F.col("annotations")), BALANCER).when(F.col("type") == "NodePort", NODE_PORT)
    direct = services.select("ns_id", "entries_", kind.alias("signal_id")).where("signal_id IS NOT NULL")
    ingresses = inventory.ingresses().where(~internal_ingress(F.col("class_name"), F.col("annotations"))).select(F.col("namespace").alias("ns_id"), F.explode("backends").alias("svc_name")).distinct()
    over = services.join(ingresses, ["ns_id", "svc_name"], "left_semi").select("ns_id", "entries_", F.lit(INGRESS).alias("signal_id"))
    led = direct.unionByName(over).distinct()
    return led.join(chosen(services, workloads), ["ns_id", "entries_"]).select("wl_id", "signal_id").distinct()


def overlaid(*key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The upsert in which a row of the batch takes the place of the stored one."""
    return lambda stored, batch: stored.join(batch.select(*key), list(key), "left_anti").select(*batch.columns).unionByName(batch)


def _stored(commit: Commit, table: str, cluster: Column) -> DataFrame | None:
    return commit.read(table).where(F.col("cluster") == cluster) if table in commit.tables else None


def spaces(inventory: Inventory, stored: DataFrame | None, cluster: Column, shown: DataFrame, complete: bool) -> DataFrame:
    """The namespaces of a cluster: those with an item are active; a complete snapshot puts the others out of use.

    Those that only workloads imply are created in use. Labels tell whether data are sensitive, and where they don't,
    what was known stays; a namespace is exposed if a workload of this snapshot in it is (``shown``: namespace).
    """
    told = filled(F.try_element_at("labels", F.lit(SENSITIVE)), F.try_element_at("annotations", F.lit(SENSITIVE)))
    now = inventory.all_namespaces().groupBy("name").agg(F.bool_or("declared").alias("declared"), F.max(F.when(told != "", F.lower(told) == "true")).alias("told_"))
    now = now.join(shown.select(F.col("namespace").alias("name")).distinct().withColumn("shown_", F.lit(True)), "name", "left").withColumn("here_", F.lit(True))
    if stored is None:
        stored = now.limit(0).select("name", F.lit(True).alias("active"), F.lit(True).alias("sensitive"), F.lit(True).alias("exposed"))
    out = stored.select("name", F.col("active").alias("was_"), F.col("sensitive").alias("secret_"), F.col("exposed").alias("open_")).join(now, "name", "full")
    yes = lambda c: F.coalesce(c, F.lit(False))
    active = yes("declared") | F.when(F.col("was_").isNull(), True).otherwise(F.col("was_") & F.lit(not complete))
    exposed = F.when(yes("here_"), yes("shown_")).otherwise(yes("open_"))
    return out.select(cluster.alias("cluster"), "name", active.alias("active"), F.coalesce("told_", "secret_", F.lit(False)).alias("sensitive"), exposed.alias("exposed"))


def persist(store: Versions, cluster: str, inventory: Inventory, started: Column, complete: bool) -> int:
    """Write one cluster's inventory as one commit over six tables; its number.

    namespaces, workloads, aliases (owners of replica sets, jobs and pods that are workloads themselves), images,
    containers and signals. Containers and signals of owned pods go to the workload at the end of their chain of owners,
    for which the aliases of the cycle before are asked as well; without one they are left out. Only the reap of a
    complete cycle takes workloads and containers out of use. If anything fails, all tables stay as they were.
    """
    commit, own = store.begin(), F.lit(cluster)
    inventory.store()  # read by every step
    rows = inventory.workloads().dropDuplicates(["namespace", "kind", "name"])
    links = settled(reached(inventory))
    open_ = links.where(F.col("signal_id").isin(BALANCER, INGRESS)).select("wl_id").distinct().withColumn("exposed", F.lit(True))
    rows = rows.withColumn("wl_id", node("namespace", "kind", "name")).join(open_, "wl_id", "left")
    written = rows.select(own.alias("cluster"), "namespace", "kind", "name", "service_account", "replicas", "labels", F.coalesce("exposed", F.lit(False)).alias("exposed"), F.lit(True).alias("deployed"), started.alias("last_inventory"))
    old_aliases = _stored(commit, "aliases", own)
    old_spaces = _stored(commit, "namespaces", own)
    commit.merge("workloads", written, WORKLOAD, overlaid(*WORKLOAD))
    here = commit.read("workloads").where((F.col("cluster") == own) & (F.col("last_inventory") == started)).withColumn("wl_id", node("namespace", "kind", "name"))
    commit.merge("namespaces", spaces(inventory, old_spaces, own, here.where("exposed"), complete), SPACE, overlaid(*SPACE))

    known = here.select(F.col("wl_id").alias("node"))
    aliases = inventory.aliases().dropDuplicates(["namespace", "kind", "name"])
    edges = aliases.select(node("namespace", "kind", "name").alias("child"), node("namespace", "target_kind", "target_name").alias("parent"))
    before = old_aliases.select(node("namespace", "kind", "name").alias("child"), node("namespace", "target_kind", "target_name").alias("parent")) if old_aliases is not None else None
    chains = owners(edges, known, before).select(F.col("node").alias("at_"), "owner")

    def placed(found: DataFrame) -> DataFrame:
        """Rows under their workload: the one that they name, or that owns what they name."""
        rows = found.withColumn("at_", node("namespace", "kind", "name")).join(chains, "at_", "left").withColumn("wl_id", F.coalesce("owner", "at_"))
        return rows.drop("namespace", "kind", "name", "owner", "at_").join(here.select("wl_id", "namespace", "kind", "name"), "wl_id")

    direct = aliases.withColumn("to_", node("namespace", "target_kind", "target_name")).join(known.select(F.col("node").alias("to_")), "to_", "left_semi")
    batch = direct.select(own.alias("cluster"), "namespace", "kind", "name", "target_kind", "target_name")
    if complete and "aliases" in commit.tables:
        others = commit.read("aliases").where(F.col("cluster") != own)
        commit.replace("aliases", others.unionByName(batch), WORKLOAD)
    else:
        commit.merge("aliases", batch, WORKLOAD, overlaid(*WORKLOAD))

    containers = settled(placed(inventory.observations()).where("digest <> ''"))
    images = containers.groupBy("digest").agg(F.max("ref").alias("ref")).select("digest", blank(F.col("ref")).alias("ref"), registry_of(F.col("ref")).alias("registry"), repository_of(F.col("ref")).alias("repository"))
    commit.merge("images", images, ("digest",), overlaid("digest"))
    seen = containers.groupBy("namespace", "kind", "name", "digest", "container").agg(F.bool_or("init_container").alias("init_container"))
    key = (*WORKLOAD, "digest", "container")

    def bumped(stored: DataFrame, new: DataFrame) -> DataFrame:
        both = stored.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
        return both.groupBy(*key).agg(F.max_by("init_container", "new_").alias("init_container"), F.max("last_seen").alias("last_seen"), F.bool_or("deployed").alias("deployed"))

    commit.merge("containers", seen.select(own.alias("cluster"), "namespace", "kind", "name", "digest", "container", "init_container", started.alias("last_seen"), F.lit(False).alias("deployed")), key, bumped)

    bare = inventory.bare_namespaces().withColumn("bare_", F.lit(True))
    policy = here.join(bare, "namespace", "left").select("namespace", "kind", "name", F.lit(BARE).alias("signal_id"), F.coalesce("bare_", F.lit(False)).alias("active"))
    fired = placed(inventory.signals()).select("namespace", "kind", "name", "signal_id")
    fired = fired.unionByName(links.join(here.select("wl_id", "namespace", "kind", "name"), "wl_id").select("namespace", "kind", "name", "signal_id")).distinct()
    batch = fired.withColumn("active", F.lit(True)).unionByName(policy)
    held = (*WORKLOAD, "signal_id")

    def turned(stored: DataFrame, new: DataFrame) -> DataFrame:
        # a policy that has come clears the signal of a namespace without one; it never had to be there
        off = new.where("NOT active").join(stored.select(*held), list(held), "left_semi")
        return overlaid(*held)(stored, new.where("active").unionByName(off.select(*new.columns)))

    commit.merge("signals", batch.select(own.alias("cluster"), "namespace", "kind", "name", "signal_id", "active", started.alias("last_seen")), held, turned)
    return commit.publish()
