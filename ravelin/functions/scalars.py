"""Scalar functions of the domain, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info", "unknown")
BANDS = ("immediate", "out_of_cycle", "scheduled", "defer")
#: Name patterns of environments, in the order they are tried.
ENVIRONMENTS = (
    (r"(^|[-_])prod([-_]|$)", "prod"),
    (r"(^|[-_])production([-_]|$)", "prod"),
    (r"(^|[-_])stag(e|ing)?([-_]|$)", "staging"),
    (r"(^|[-_])(dev|development|test|sandbox|qa)([-_]|$)", "dev"),
)
#: Annotations that make a load balancer internal.
INTERNAL_BALANCER = {
    "service.beta.kubernetes.io/aws-load-balancer-internal": "true",
    "networking.gke.io/load-balancer-type": "Internal",
    "service.beta.kubernetes.io/azure-load-balancer-internal": "true",
}


def blank(c: Column) -> Column:
    """Null as the empty string, which stands for "none" throughout."""
    return F.coalesce(c, F.lit(""))


def filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def ranked(value: Column, order: tuple[str, ...], other: int = 99) -> Column:
    out = F.lit(other)
    for k, name in reversed(list(enumerate(order))):
        out = F.when(value == name, F.lit(k)).otherwise(out)
    return out


def dedup_hash(source: Column, category: Column, vuln_id: Column, workload: Column, cluster: Column, digest: Column, package: Column, version: Column) -> Column:
    """The identity of a finding: of its workload and image, or of its cluster where it has no workload."""
    own = F.concat_ws("|", source, category, vuln_id, workload.cast("string"), blank(digest), blank(package), blank(version))
    wide = F.concat_ws("|", source, category, vuln_id, blank(cluster), blank(package), blank(version))
    return F.sha2(F.when(workload.isNotNull(), own).otherwise(wide), 256)


def environment(name: Column) -> Column:
    out = F.lit("dev")
    for pattern, env in reversed(ENVIRONMENTS):
        out = F.when(name.rlike(pattern), env).otherwise(out)
    return out


def ref_digest(ref: Column) -> Column:
    """What follows the first @ of an image reference, if it is a sha256 digest."""
    return F.regexp_extract(blank(ref), r"^[^@]*@(sha256:.*)$", 1)


def status_digest(image_id: Column) -> Column:
    """The digest of a running container: after an @, or the bare id."""
    return F.when(blank(image_id).startswith("sha256:"), image_id).otherwise(ref_digest(image_id))


def registry_of(ref: Column) -> Column:
    head = F.substring_index(_untagged(ref), "/", 1)
    return F.when(_untagged(ref).contains("/") & (head.contains(".") | head.contains(":")), head).otherwise("")


def repository_of(ref: Column) -> Column:
    path = _untagged(ref)
    return F.when(registry_of(ref) != "", F.regexp_replace(path, "^[^/]*/", "")).otherwise(path)


def _untagged(ref: Column) -> Column:
    return F.regexp_replace(F.substring_index(blank(ref), "@", 1), ":[^:]*$", "")


def image_ref(registry: Column, repository: Column, tag: Column) -> Column:
    """registry/repository:tag, the registry not twice and empty parts left out."""
    registry, repository, tag = blank(registry), blank(repository), blank(tag)
    base = F.when((registry == "") | repository.startswith(F.concat(registry, F.lit("/"))), repository).otherwise(F.concat(registry, F.lit("/"), repository))
    return F.when(tag == "", base).otherwise(F.concat(base, F.lit(":"), tag))


def scanner_severity(value: Column) -> Column:
    low = F.lower(blank(value))
    return F.when(low.isin("critical", "high", "medium", "low", "info"), low).otherwise("unknown")


def policy_severity(value: Column) -> Column:
    low = F.lower(blank(value))
    return F.when(low.isin("critical", "high", "medium", "low", "info"), low).otherwise("medium")


def avd_id(check_id: Column) -> Column:
    """KSV51 and KSV-0051 as AVD-KSV-0051; other KSV ids get the prefix; the rest stays."""
    raw = blank(check_id)
    number = F.regexp_extract(raw, r"^KSV-*(\d+)$", 1)
    short = F.regexp_replace(number, "^0+(?=.)", "")
    padded = F.when(F.length(short) >= 4, short).otherwise(F.lpad(short, 4, "0"))
    return F.when(number != "", F.concat(F.lit("AVD-KSV-"), padded)).when(raw.startswith("KSV"), F.concat(F.lit("AVD-"), raw)).otherwise(raw)


def tolerant_date(value: Column) -> Column:
    return F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")


def epss_bucket(score: Column) -> Column:
    """none, then red from 50 per cent, orange from 10, yellow from 1; scores up to 1 are shares."""
    percent = F.when(score <= 1, score * 100).otherwise(score)
    return F.when(score.isNull(), "none").when(percent >= 50, "red").when(percent >= 10, "orange").when(percent >= 1, "yellow").otherwise("grey")


def exposed(workload: Column, namespace: Column) -> Column:
    return F.coalesce(workload, F.lit(False)) | F.coalesce(namespace, F.lit(False))


def contains_folded(c: Column, part: str) -> Column:
    return F.lower(c).contains(part.lower())


def pod_security(labels: Column) -> Column:
    return blank(F.try_element_at(labels, F.lit("pod-security.kubernetes.io/enforce")))


def sensitive(manual: Column, old: Column, labels: Column, annotations: Column, key: str) -> Column:
    """A manual flag stays; else label, else annotation, says true."""
    told = filled(F.try_element_at(labels, F.lit(key)), F.try_element_at(annotations, F.lit(key)))
    return F.when(F.coalesce(manual, F.lit(False)), old).otherwise(F.lower(told) == "true")


def internal_balancer(annotations: Column) -> Column:
    out = F.lit(False)
    for key, value in INTERNAL_BALANCER.items():
        out = out | F.coalesce(F.lower(F.try_element_at(annotations, F.lit(key))) == value.lower(), F.lit(False))
    return out


def internal_ingress(class_name: Column, annotations: Column) -> Column:
    own = F.lower(blank(class_name))
    old = F.lower(blank(F.try_element_at(annotations, F.lit("kubernetes.io/ingress.class"))))
    scheme = F.lower(blank(F.try_element_at(annotations, F.lit("alb.ingress.kubernetes.io/scheme"))))
    return own.contains("internal") | own.contains("private") | (scheme == "internal") | old.contains("internal")


#: Provider id prefix, label prefix of the managed service, names with and without it.
PROVIDERS = (("aws://", "eks.amazonaws.com/", "eks", "aws"), ("gce://", "cloud.google.com/gke-", "gke", "gcp"), ("azure://", "kubernetes.azure.com/", "aks", "azure"))


def _starts(prefix: str):
    return lambda k: k.startswith(prefix)


def provider(provider_id: Column, labels: Column) -> Column:
    """The cloud of a node, or its managed service if the labels show one."""
    out = F.lit("onprem")
    for prefix, label, managed, plain in PROVIDERS:
        shown = F.coalesce(F.exists(F.map_keys(labels), _starts(label)), F.lit(False))
        out = F.when(F.lower(blank(provider_id)).startswith(prefix), F.when(shown, managed).otherwise(plain)).otherwise(out)
    return out


def region(labels: Column) -> Column:
    """The first non-empty of the two region labels."""
    return filled(*[F.try_element_at(labels, F.lit(k)) for k in ("topology.kubernetes.io/region", "failure-domain.beta.kubernetes.io/region")])


def weight(value: Column, order: tuple[str, ...]) -> Column:
    """0 for the last name of ``order``, one more for each before it, -1 for any other value and null."""
    return F.lit(len(order) - 1) - ranked(value, order, len(order))


def label(value: Column, order: tuple[str, ...]) -> Column:
    """One of the names of ``order`` however it is written (case, blanks around it, without underscores); other texts as they are."""
    told = F.lower(F.trim(value))
    for name in order:
        value = F.when(told.isin(name, name.replace("_", "")), name).otherwise(value)
    return value


def split_ref(ref: Column) -> tuple[Column, Column]:
    """Namespace and name of "namespace/name", cut at the first slash; a null namespace without one."""
    at = F.locate("/", ref)
    return F.when(at > 0, F.substring(ref, F.lit(1), at - 1)), F.when(at > 0, F.substring(ref, at + 1, F.length(ref))).otherwise(ref)
