"""Nodes and edges of a code graph from files, by kind of file.

Each parser takes files (path, text) and returns edges: src, src_type, dst, dst_type, name, type. They are
built-in functions; only turning YAML into JSON and reading the scopes of source files need Python, file by file.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import graph
from quarrymill.sources import scopes
from quarrymill.sources.schemas import PACKAGE_JSON
from quarrymill.sources.tables import cut, dealt, parts_for, shuffled


def _edges(found: DataFrame, dst: Column, dst_type: str, name: Column, kind: str) -> DataFrame:
    return found.select(F.col("path").alias("src"), F.lit("file").alias("src_type"), dst.alias("dst"), F.lit(dst_type).alias("dst_type"), name.alias("name"), F.lit(kind).alias("type")).distinct()


def _all(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    return files.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("m"))


def dockerfile(files: DataFrame) -> DataFrame:
    """EXPOSE ports as services of the folder, FROM images."""
    folder = T.file_name(T.parent(F.col("path")))
    ports, images = _all(files, r"(?i)EXPOSE\s+(\d+)"), _all(files, r"(?i)FROM\s+([^\s]+)")
    return _edges(ports, F.concat_ws(":", F.lit("service"), folder, "m"), "service", F.concat_ws(":", folder, "m"), "defines_service").union(_edges(images, F.concat(F.lit("docker_image:"), "m"), "docker_image", F.col("m"), "uses_base_image"))


def package_json(files: DataFrame) -> DataFrame:
    """Packages of the three kinds of dependencies."""
    parsed = files.select("path", F.from_json("text", PACKAGE_JSON).alias("j"))
    kinds = F.map_concat(*(F.coalesce(F.col(f"j.{k}"), F.create_map().cast("map<string,string>")) for k in ("dependencies",)))
    names = F.array_distinct(F.concat(F.map_keys(kinds), *(F.coalesce(F.map_keys(F.col(f"j.{k}")), F.array().cast("array<string>")) for k in ("devDependencies", "peerDependencies"))))
    found = parsed.where(F.col("j").isNotNull()).select("path", F.explode(names).alias("m"))
    return _edges(found, F.concat(F.lit("npm:"), "m"), "npm_package", F.col("m"), "requires")


def terraform(files: DataFrame) -> DataFrame:
    """resource "type" "name" and module "name" blocks."""
    res = files.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(r'resource\s+"([^"]+)"\s+"([^"]+)"'), F.lit(1)).alias("t"), F.regexp_extract_all("text", F.lit(r'resource\s+"([^"]+)"\s+"([^"]+)"'), F.lit(2)).alias("n"))).alias("z")).select("path", F.col("z.t").alias("t"), F.col("z.n").alias("n"))
    mods = _all(files, r'module\s+"([^"]+)"')
    return _edges(res, F.concat(F.lit("terraform:"), "t", F.lit("."), "n"), "terraform_resource", F.col("n"), "defines_resource").union(_edges(mods, F.concat(F.lit("terraform:module."), "m"), "terraform_module", F.col("m"), "uses_module"))


def maven(files: DataFrame) -> DataFrame:
    """groupId:artifactId of the first `dependencies` element."""
    block = files.select("path", F.regexp_extract("text", r"(?s)<dependencies>(.*?)</dependencies>", 1).alias("text"))
    each = block.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    tag = lambda t: F.trim(F.regexp_extract("d", rf"(?s)<{t}>(.*?)</{t}>", 1))
    found = each.select("path", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("m"))
    return _edges(found, F.concat(F.lit("maven:"), "m"), "maven_artifact", F.col("m"), "requires")


#: What is a pseudo-function in a line of a file of no known kind.
PSEUDO_FUNCTIONS = (
    r"^\s*def\s+([A-Za-z_]\w*)\s*\(",
    r"^\s*function\s+([A-Za-z_]\w*)\s*\(",
    r"^\s*([A-Za-z_]\w*)\s*=\s*\([^)]*\)\s*=>",
    r"^\s*class\s+([A-Za-z_]\w*)\s*[:\{]",
    r"^\s*func\s+([A-Za-z_]\w*)\s*\(",
)


def heuristic(files: DataFrame) -> DataFrame:
    """Pseudo-functions in the first 2000 lines, one of a line at most."""
    each = files.select("path", F.explode(T.lines(F.col("text"), 2000)).alias("line"))
    found = each.select("path", F.coalesce(*(F.nullif(F.regexp_extract("line", r, 1), F.lit("")) for r in PSEUDO_FUNCTIONS)).alias("m")).where("m IS NOT NULL")
    return _edges(found, F.concat_ws(":", "path", "m"), "function", F.col("m"), "defines")


def _of(items: DataFrame, kind: str) -> DataFrame:
    return items.where(F.col("kind") == kind)


def definitions(items: DataFrame) -> DataFrame:
    """file, name, type, start, stop, seq of the functions and classes among `scopes.items`. seq: where one stands among all, by file and place."""
    rows = items.where(F.col("kind").isin("function", "class"))
    return rows.select(F.col("path").alias("file"), "name", F.col("kind").alias("type"), "start", "stop", F.concat_ws(":", "path", F.lpad(F.col("start").cast("string"), 12, "0")).alias("seq"))


def bodies(files: DataFrame, items: DataFrame, parts: int | None = None) -> DataFrame:
    """path, name, type, start and body of every definition: its text from the first word to the end of its extent.

    parts: into how many the rows are dealt (see `tables.dealt`).
    """
    found = definitions(items).select(F.col("file").alias("path"), "name", "type", "start", "stop")
    return dealt(files.select("path", "text"), parts, "path").join(shuffled(dealt(found, parts, "path")), "path").select("path", "name", "type", "start", F.substr("text", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("body"))


def decorators(items: DataFrame) -> DataFrame:
    """file, name, stop of every decorator, annotation or attribute, in the way of the file's language."""
    return _of(items, "decorator").select(F.col("path").alias("file"), "name", "stop")


def decorated(items: DataFrame, parts: int | None = None) -> DataFrame:
    """id, decorators: the functions and classes that decorators stand before, and these in order of name."""
    near = graph.attached_decorators(decorators(items), definitions(items), parts=parts)
    return near.groupBy(F.concat_ws(":", "file", "target").alias("id")).agg(F.sort_array(F.collect_list("decorator")).alias("decorators"))


def calls(items: DataFrame, parts: int | None = None) -> DataFrame:
    """call_id, file, name, within of called names, to be resolved by `graph.first_dotted`; once for each name and function around it.

    parts: into how many the rows are dealt (see `tables.dealt`).
    """
    once = dealt(_of(items, "call").select(F.col("path").alias("file"), "name", "within"), parts, "file", "name", "within").distinct()
    return once.select(F.concat_ws(":", "file", "name", F.coalesce("within", F.lit(""))).alias("call_id"), "file", "name", "within")


def call_edges(items: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges of resolved calls: from the function around a call, else from its file; and from file to file where they differ."""
    made = calls(items, parts)
    target = graph.first_dotted(made, definitions(_of(items, "function"))).where("stage IS NOT NULL").select("call_id", "target")
    to = F.regexp_extract("target", r"^(.*):", 1)
    each = cut(made.join(shuffled(target), "call_id").select("file", "within", "target", to.alias("to"), F.regexp_extract("target", r":([^:]*)$", 1).alias("name")))
    inner = each.where("within IS NOT NULL").select(F.concat_ws(":", "file", "within").alias("src"), F.lit("function").alias("src_type"), F.col("target").alias("dst"), F.lit("function").alias("dst_type"), "name", F.lit("calls").alias("type"))
    outer = each.where("within IS NULL").select(F.col("file").alias("src"), F.lit("file").alias("src_type"), F.col("target").alias("dst"), F.lit("function").alias("dst_type"), "name", F.lit("calls_from_file").alias("type"))
    across = each.where("within IS NOT NULL AND file <> to").select(F.col("file").alias("src"), F.lit("file").alias("src_type"), F.col("to").alias("dst"), F.lit("file").alias("dst_type"), F.col("to").alias("name"), F.lit("calls_file").alias("type"))
    return inner.union(outer).union(across).distinct()


#: What a relative import may leave out at the end of a path, in the order in which files are tried.
IMPORT_ENDS = ("", ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", "/index.js")


def _imported(source: Column, name: Column) -> Column:
    """The path that a relative import names, without its end: './' and '../' from the file's folder, '/' from the root, leading dots as in Python."""
    dots = F.regexp_extract(name, r"^(\.+)", 1)
    as_path = F.when(name.rlike(r"^\.+[\w.]*$"), F.concat(F.repeat(F.lit("../"), F.length(dots) - 1), F.translate(F.regexp_replace(name, r"^\.+", ""), ".", "/"))).otherwise(name)
    whole = F.when(name.startswith("/"), name).otherwise(F.concat_ws("/", T.parent(source), as_path))
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """src, dst: relative imports (src, name) as files, by candidates with the usual ends; the first that exists wins."""
    near = imports.where(F.col("name").rlike(r"^[./]")).withColumn("__p", _imported(F.col("src"), F.col("name")))
    tried = near.select("src", "name", F.posexplode(F.array(*(F.concat("__p", F.lit(e)) for e in IMPORT_ENDS))).alias("k", "path"))
    there = paths.select("path").distinct()
    return tried.join(shuffled(there), "path").groupBy("src", "name").agg(F.min_by("path", "k").alias("dst")).select("src", "dst").distinct()


def code(files: DataFrame) -> DataFrame:
    """Functions, classes, imports, classed string literals and calls of source files of the known extensions.

    A relative import is an edge to the file that it names, if that is among the files; any other is a dependency.
    """
    items = cut(scopes.items(files))
    found = lambda kind: _of(items, kind).select("path", F.col("name").alias("m")).distinct()
    local = F.concat_ws(":", "path", "m")
    strings = found("string").where(F.length("m").between(1, 500) & ~F.contains("m", F.lit("\n")) & T.literal_class(F.col("m")).isNotNull())
    imports = found("import")
    files_of = resolve_imports(imports.select(F.col("path").alias("src"), F.col("m").alias("name")), files).select(F.col("src").alias("path"), F.col("dst").alias("m"))
    return (
        _edges(found("function"), local, "function", F.col("m"), "defines")
        .union(_edges(found("class"), local, "class", F.col("m"), "defines"))
        .union(_edges(imports.where(~F.col("m").rlike(r"^[./]")), F.concat(F.lit("dep:"), "m"), "external_dependency", F.col("m"), "imports"))
        .union(_edges(files_of, F.col("m"), "file", F.col("m"), "imports"))
        .union(_edges(strings, F.concat(F.lit("str:"), "m"), "string_literal", F.col("m"), "uses_string"))
        .union(call_edges(items, parts_for(items.count(), 200_000)))
    )


#: Kubernetes kinds and their node types; any other is k8s_resource.
KINDS = {
    "Deployment": "k8s_deployment", "StatefulSet": "k8s_statefulset", "DaemonSet": "k8s_daemonset", "Service": "k8s_service", "Ingress": "k8s_ingress",
    "ConfigMap": "k8s_configmap", "Secret": "k8s_secret", "Pod": "k8s_pod", "Job": "k8s_job", "CronJob": "k8s_cronjob",
}


#: What is read of a YAML document. A value of another shape is null.
_MANIFEST = """apiVersion string, kind string, metadata struct<name: string>,
    spec struct<ports: array<struct<port: string>>, rules: array<struct<http: struct<paths: array<struct<backend: struct<service: struct<name: string>, serviceName: string>>>>>>>,
    services map<string, string>"""


def first_document(text: Column) -> Column:
    """The first YAML document of a text as JSON; null if it isn't YAML. The one step that built-in functions don't have."""

    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(body: str | None) -> str | None:
            try:
                return json.dumps(next(iter(yaml.safe_load_all(body or "")), None), default=str)
            except (yaml.YAMLError, TypeError, ValueError):
                return None

        return parts.map(one)

    return run(text)


def yaml_files(files: DataFrame) -> DataFrame:
    """Kubernetes resources with the ports of services and the backends of ingresses, or Compose services with their needs, of each first document."""
    # read once for all that is made of it; a condition on it before the cut would be pushed below the dealing of files, into a few tasks
    j = cut(files.select("path", F.from_json(first_document(F.col("text")), _MANIFEST).alias("j"))).where("j IS NOT NULL")
    node_type = F.coalesce(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("j.kind")], F.lit("k8s_resource"))
    own = j.where("j.apiVersion IS NOT NULL AND j.kind IS NOT NULL").select("path", "j.kind", "j.spec", F.coalesce("j.metadata.name", F.lit("unknown")).alias("name"), node_type.alias("node_type"))
    own = own.withColumn("node", F.concat_ws(":", "node_type", "name"))
    backends = F.flatten(F.transform("spec.rules", lambda r: F.coalesce(r["http"]["paths"], F.array().cast("array<struct<backend: struct<service: struct<name: string>, serviceName: string>>>"))))
    #: kind, values below its spec, type of their nodes, how a node is named, edge
    below = (
        ("Service", F.transform("spec.ports", lambda p: p["port"]), "k8s_endpoint", F.concat_ws(":", F.lit("k8s_endpoint"), "name", "value"), "exposes_port"),
        ("Ingress", F.transform(backends, lambda p: F.coalesce(p["backend"]["service"]["name"], p["backend"]["serviceName"])), "k8s_service", F.concat_ws(":", F.lit("k8s_service"), "value"), "routes_to"),
    )
    out = own.select(F.col("path").alias("src"), F.lit("file").alias("src_type"), F.col("node").alias("dst"), F.col("node_type").alias("dst_type"), "name", F.lit("defines_resource").alias("type"))
    for kind, values, dst_type, dst, edge in below:
        each = own.where(F.col("kind") == kind).withColumn("value", F.explode(values)).where("value IS NOT NULL AND value NOT IN ('', '0')")
        out = out.union(each.select(F.col("node").alias("src"), F.col("node_type").alias("src_type"), dst.alias("dst"), F.lit(dst_type).alias("dst_type"), F.col("value").alias("name"), F.lit(edge).alias("type")))
    services = j.where("j.apiVersion IS NULL OR j.kind IS NULL").select("path", F.explode("j.services").alias("name", "body")).withColumn("node", F.concat(F.lit("service:"), "name"))
    needs = services.select("node", F.explode(F.from_json(F.get_json_object("body", "$.depends_on"), "array<string>")).alias("need")).where("need IS NOT NULL")
    out = out.union(services.select("path", F.lit("file"), "node", F.lit("service"), "name", F.lit("defines_service")))
    return out.union(needs.select("node", F.lit("service"), F.concat(F.lit("service:"), "need"), F.lit("service"), "need", F.lit("depends_on"))).distinct()


#: Parsers in the order in which they are asked; the first that takes a file has it. More may be put before the last.
PARSERS: list[tuple[Callable[[Column], Column], Callable[[DataFrame], DataFrame]]] = [
    (lambda p: T.suffix(p).isin(list(scopes.LANGUAGES)), code),
    (lambda p: F.lower(T.suffix(p)).isin(".yaml", ".yml"), yaml_files),
    (lambda p: F.lower(T.suffix(p)) == ".json", package_json),
    (lambda p: F.lower(T.file_name(p)).rlike(r"^dockerfile(\..*)?$"), dockerfile),
    (lambda p: F.lower(T.suffix(p)).isin(".hcl", ".tf"), terraform),
    (lambda p: F.lower(T.suffix(p)) == ".xml", maven),
    (lambda p: F.lit(True), heuristic),
]


def build_graph(files: DataFrame, parsers: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, type, name, decorators; edges: src, dst, type) of files (path, text).

    One edge for each pair; a parser that finds nothing doesn't pass a file on. decorators is null where there are none.
    """
    parsers = PARSERS if parsers is None else parsers
    owner = F.coalesce(*(F.when(takes(F.col("path")), F.lit(i)) for i, (takes, _) in enumerate(parsers)))
    assigned = files.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("__parser", owner)
    found = None
    for i, (_, parse) in enumerate(parsers):
        part = parse(assigned.where(F.col("__parser") == i))
        found = part if found is None else found.union(part)
    found = cut(found)  # nodes and edges both come from it
    ends = found.select(F.col("dst").alias("id"), F.col("dst_type").alias("type"), "name").union(found.select(F.col("src").alias("id"), F.col("src_type").alias("type"), F.col("src").alias("name")))
    ends = ends.union(files.select(F.col("path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("name")))
    nodes = ends.groupBy("id").agg(F.min(F.struct("type", "name")).alias("n")).select("id", "n.type", "n.name").join(shuffled(decorated(scopes.items(assigned), parts_for(files.count(), 20_000))), "id", "left")
    edges = found.groupBy("src", "dst").agg(F.max("type").alias("type"))
    return nodes, edges
