"""Container listings as a flat table, and selections on it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.fields import BLANK_CHARS, workload_name
from logweave.functions.predicates import all_of, selection
from logweave.functions.timepattern import quote
from logweave.operators.facets import _options

CONTAINER_FACETS = {
    "namespace": lambda: F.col("namespace"),
    "pod": lambda: workload_name("pod"),
    "container": lambda: F.col("container"),
}


def _cells(line: Column, regex: str) -> Column:
    """Split with empty cells at the end dropped."""
    return F.split(F.regexp_replace(line, f"(?:{regex})+\\z", ""), regex)


def parse_listing(listing: DataFrame, line: str = "line") -> DataFrame:
    """Listing lines to (namespace, pod, containers), one row per pod.

    Cells are separated by ``|``, else by tabs, else by two or more blanks; the third cell holds container
    names separated by commas or blanks. Lines with fewer than two cells are dropped.
    """
    text = F.btrim(F.col(line), F.lit(BLANK_CHARS))
    bars, tabs, gaps = (_cells(text, r) for r in (r"\|", r"\t", r"\s{2,}"))
    cells = F.when(F.size(bars) >= 2, bars).when(F.size(tabs) >= 2, tabs).otherwise(gaps)
    split = listing.withColumn("_cells", cells).filter(F.size("_cells") >= 2)

    def cell(i):
        return F.btrim(F.coalesce(F.get("_cells", F.lit(i)), F.lit("")), F.lit(BLANK_CHARS))

    names = F.filter(F.split(cell(2), r"[,\s]+"), lambda c: c != "")
    rest = [c for c in listing.columns if c != line]
    return split.select(*rest, cell(0).alias("namespace"), cell(1).alias("pod"), names.alias("containers"))


def flat_containers(pods: DataFrame) -> DataFrame:
    """One row per container; a pod without containers keeps one row with a null container."""
    rest = [c for c in pods.columns if c != "containers"]
    return pods.select(*rest, F.explode_outer("containers").alias("container"))


def container_source(pod="pod", container="container") -> Column:
    """Source name of a container's log."""
    return F.concat(F.col(pod), F.lit("_"), F.col(container), F.lit(".log"))


def container_search(text: str | None) -> Column | None:
    """Substring of namespace, pod or container, ignoring case; blank text is inactive."""
    text = (text or "").strip().lower()
    if not text:
        return None
    hits = [F.coalesce(F.contains(F.lower(c), F.lit(text)), F.lit(False)) for c in ("namespace", "pod", "container")]
    return hits[0] | hits[1] | hits[2]


def _conditions(selections, search, domains) -> dict[str, Column | None]:
    selections, domains = selections or {}, domains or {}
    conditions = {f: selection(v(), selections.get(f), domains.get(f)) for f, v in CONTAINER_FACETS.items()}
    conditions["search"] = container_search(search)
    return conditions


def filter_containers(
    containers: DataFrame,
    selections: Mapping[str, Iterable[str]] | None = None,
    search: str = "",
    domains: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """Containers that pass the search text and the chosen namespaces, workloads and container names."""
    return containers.filter(all_of(*_conditions(selections, search, domains).values()))


def container_options(containers: DataFrame, selections=None, search: str = "", domains=None) -> DataFrame:
    """Available namespaces, workloads and container names under the other filters: (facet, value, n)."""
    options = _options(containers, {f: v() for f, v in CONTAINER_FACETS.items()}, _conditions(selections, search, domains))
    return options.filter(F.col("n") > 0).drop("total")


def path_regex(pattern: str) -> str:
    """Regex of one path pattern: a substring without ``/``, else a whole-path glob whose ``*`` crosses ``/``."""
    if "/" not in pattern:
        return f"(?s:.*?){quote(pattern)}"
    return r"\A" + "".join({"*": ".*", "?": "."}.get(c) or quote(c) for c in pattern) + r"\z"


def select_paths(containers: DataFrame, patterns: str) -> DataFrame:
    """Containers that match any of the comma-separated patterns over ``namespace/pod/container``.

    One row per path with ``pattern``, the position of the first pattern that matches it.
    """
    path = F.concat_ws("/", "namespace", "pod", "container")
    which = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(x.strip() for x in patterns.split(",")))):
        which = F.when(path.rlike(path_regex(p)), i).otherwise(which)
    return (
        containers.filter(F.col("container").isNotNull())
        .withColumn("path", path)
        .withColumn("pattern", which)
        .filter(F.col("pattern").isNotNull())
        .groupBy("namespace", "pod", "container", "path")
        .agg(F.min("pattern").alias("pattern"))
    )


def namespace_totals(pods: DataFrame) -> DataFrame:
    """Pods and containers per namespace."""
    return pods.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("pods"), F.sum(F.size("containers")).cast("long").alias("containers")
    )
