"""Controls by cluster with pass rates, and licences of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(checks: DataFrame) -> DataFrame:
    """One verdict per control and cluster: FAIL if a check fails, else WARN if one warns, else PASS."""
    worst = F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").when(F.bool_or(F.col("status") == "WARN"), "WARN").otherwise("PASS")
    return checks.groupBy("control", "cluster_name").agg(worst.alias("verdict"))


def matrix(verdicts: DataFrame, clusters: list[str]) -> DataFrame:
    """A row per control, a column per cluster asked for; null where the control was not checked."""
    return verdicts.groupBy("control").pivot("cluster_name", clusters).agg(F.first("verdict"))


def pass_rates(verdicts: DataFrame) -> DataFrame:
    """Controls passed, failed and warned about in each cluster; the rate is of those passed or failed, null without any."""
    n = lambda what: F.count_if(F.col("verdict") == what)
    own = verdicts.groupBy("cluster_name").agg(n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("WARN").alias("n_warn"))
    return own.withColumn("pass_rate", F.when(F.col("n_pass") + F.col("n_fail") > 0, F.floor(F.col("n_pass") * 100 / (F.col("n_pass") + F.col("n_fail")))))


def licence_counts(components: DataFrame, restrictive: tuple[str, ...]) -> DataFrame:
    """Components, versions and instances of each licence; a component with several counts for each, once."""
    own = components.select("component", "version", "instances", F.explode(F.array_distinct("licences")).alias("licence"))
    counts = own.groupBy("licence").agg(F.count_distinct("component").alias("components"), F.count_distinct("component", "version").alias("versions"), F.sum("instances").alias("instances"))
    return counts.withColumn("restrictive", F.col("licence").isin(*restrictive))


#: A bracket, a word that joins, or a licence with the exception that goes with it.
_TOKEN = r"[()]|(?<![^\s()])(?i:and|or)(?![^\s()])|[^\s()]+(?:\s+(?i:with)\s+[^\s()]+)?"


def licences_of(expression: Column) -> Column:
    """The distinct licences that an expression names, exceptions included, in its order."""
    tokens = F.regexp_extract_all(expression, F.lit(_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: ~F.lower(t).isin("(", ")", "and", "or")))


def restrictive(expression: Column, names: tuple[str, ...], excepted: tuple[str, ...] = ()) -> Column:
    """Whether a licence expression binds whoever uses the component, null if it cannot be read.

    Licences are joined by AND and OR, in any case; AND goes first and brackets before both. OR leaves the choice, so it
    is restrictive only if every choice is; AND is if any part is. A licence is restrictive if it is one of ``names``, in
    any case, or ``name+``, unless WITH adds one of ``excepted``, which takes its force. An empty text, a missing part or
    bracket gives null.

    One fold over the tokens; a frame per open bracket holds what the choices so far and the present one come to.
    """
    own = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), r"\s+with\s+.*$", ""), r"\+$", "")
    extra = lambda t: F.regexp_extract(F.lower(t), r"\s+with\s+(.*)$", 1)
    binds = lambda t: own(t).isin(*map(str.lower, names)) & ~(extra(t).isin(*map(str.lower, excepted)) if excepted else F.lit(False))
    frame = lambda o, a: F.struct(o.cast("boolean").alias("o"), a.cast("boolean").alias("a"))
    none = F.lit(None)
    # o: whether all choices before are restrictive; a: whether the present one is so far; open: a part has to follow
    start = F.struct(F.array(frame(none, none)).alias("frames"), F.lit(True).alias("open"), F.lit(True).alias("good"))

    def put(frames: Column, value: Column) -> Column:
        top = F.element_at(frames, -1)
        return F.concat(F.slice(frames, 1, F.size(frames) - 1), F.array(frame(top["o"], F.coalesce(top["a"], F.lit(False)) | value)))

    def choice(f: Column) -> Column:
        return F.coalesce(f["o"], F.lit(True)) & f["a"]

    def step(s: Column, t: Column) -> Column:
        frames, top, open_ = s["frames"], F.element_at(s["frames"], -1), s["open"]
        rest = F.slice(frames, 1, F.size(frames) - 1)
        state = lambda frames, open_, good: F.struct(frames.alias("frames"), F.lit(open_).alias("open"), (s["good"] & good).alias("good"))
        return (
            F.when(t == "(", state(F.concat(frames, F.array(frame(none, none))), True, open_))
            .when((t == ")") & ((F.size(frames) < 2) | open_), state(frames, False, F.lit(False)))
            .when(t == ")", state(put(rest, choice(top)), False, F.lit(True)))
            .when(F.lower(t) == "and", state(frames, True, ~open_))
            .when(F.lower(t) == "or", state(F.concat(rest, F.array(frame(choice(top), none))), True, ~open_))
            .otherwise(state(put(frames, binds(t)), False, open_))  # two licences side by side are no expression
        )

    tokens = F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(_TOKEN), F.lit(0))
    done = lambda s: F.when(s["good"] & ~s["open"] & (F.size(s["frames"]) == 1), choice(s["frames"][0]))
    return F.aggregate(tokens, start, step, done)
