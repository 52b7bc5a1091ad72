"""Code graphs: files of each kind, made from the tables, and the edges that they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import graph, relevance
from quarrymill.plans.registry import query
from quarrymill.sources import parsers, read_table, scopes
from quarrymill.sources.tables import cut, parts_for, shuffled, spread


def _text(k: Column | int) -> Column:
    return F.lit(k).cast("string") if isinstance(k, int) else k.cast("string")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each part, in one of 40 folders, that imports, decorates, defines, quotes and calls."""
    k = F.col("p_partkey")
    lines = F.format_string(
        "g%s()\nimport os\nimport lib%s\nfrom .f%s import a\nfrom ..m%s.f%s import b\n@route%s\ndef g%s(a):\n    s = 'https://h%s.org/x'\n    return obj.g%s(a)\nclass C%sService:\n    pass\n",
        *map(_text, (k + 2, k % 7, k - 40, (k + 3) % 40, k + 3, k % 3, k, k % 9, k + 1, k)),
    )
    return spread(read_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("m"), _text(k % 40), F.lit("/f"), _text(k), F.lit(".py")).alias("path"), lines.alias("text"))


_FILES = "p AS (SELECT p_partkey AS k, concat('m', p_partkey % 40, '/f', p_partkey, '.py') AS path FROM part)"


@query(f"""WITH {_FILES} SELECT path AS src, concat(path, ':g', k) AS dst, 'defines' AS type FROM p UNION ALL SELECT path, concat(path, ':C', k, 'Service'), 'defines' FROM p
        UNION ALL SELECT path, 'dep:os', 'imports' FROM p UNION ALL SELECT path, concat('dep:lib', k % 7), 'imports' FROM p
        UNION ALL SELECT p.path, q.path, 'imports' FROM p JOIN p q ON q.k = p.k - 40 UNION ALL SELECT p.path, q.path, 'imports' FROM p JOIN p q ON q.k = p.k + 3
        UNION ALL SELECT path, concat('str:https://h', k % 9, '.org/x'), 'uses_string' FROM p
        UNION ALL SELECT concat(p.path, ':g', p.k), concat(q.path, ':g', q.k), 'calls' FROM p JOIN p q ON q.k = p.k + 1 UNION ALL SELECT p.path, q.path, 'calls_file' FROM p JOIN p q ON q.k = p.k + 1
        UNION ALL SELECT p.path, concat(q.path, ':g', q.k), 'calls_from_file' FROM p JOIN p q ON q.k = p.k + 2""")
def code_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.build_graph(source_files(spark, sf_dir))[1].select("src", "dst", "type")


@query(f"""WITH {_FILES} SELECT path AS id, 'file' AS type, path AS name, CAST(NULL AS VARCHAR) AS decorators FROM p UNION ALL SELECT concat(path, ':g', k), 'function', concat('g', k), concat('@route', k % 3) FROM p
        UNION ALL SELECT concat(path, ':C', k, 'Service'), 'class', concat('C', k, 'Service'), NULL FROM p UNION ALL SELECT 'dep:os', 'external_dependency', 'os', NULL FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)
        UNION ALL SELECT DISTINCT concat('dep:lib', k % 7), 'external_dependency', concat('lib', k % 7), NULL FROM p UNION ALL SELECT DISTINCT concat('str:https://h', k % 9, '.org/x'), 'string_literal', concat('https://h', k % 9, '.org/x'), NULL FROM p""")
def code_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.build_graph(source_files(spark, sf_dir))[0].select("id", "type", "name", F.array_join("decorators", ",").alias("decorators"))


@query(f"""WITH {_FILES} SELECT path AS file, concat('@route', k % 3) AS decorator, concat('g', k) AS target FROM p""")
def decorator_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut(scopes.items(source_files(spark, sf_dir)))
    return graph.attached_decorators(parsers.decorators(items), parsers.definitions(items), parts=parts_for(items.count(), 200_000))


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python or JavaScript file for each part: comments, strings, a function in a function, and calls after a function's end."""
    k = F.col("p_partkey")
    python = F.format_string(
        """# g%s() in a comment\ndef outer%s(a,\n    b=size%s(2),\n):\n    \"\"\"def fake(): call(%s)\"\"\"\n    def inner%s(b):\n        return far%s(b)\n\n    s = 'g(1)'  # h(%s)\n    return inner%s(a)\nafter%s(0)\nclass K%s:\n    def m%s(self):\n        return far%s(1)\n    x = last%s()\n""",
        *map(_text, (k, k, k % 5, k, k, k + 1, k, k, k % 9, k, k, k + 2, k % 4)),
    )
    script = F.format_string(
        """// function fake() { g%s(); }\nfunction outer%s(a = {}) {\n  /* call(%s) */\n  function inner%s(b) { return far%s(b); }\n  const s = "}" + `h(${a})` + size%s(2);\n  return inner%s(a);\n} after%s(0);\n""",
        *map(_text, (k, k, k, k, k + 1, k % 5, k, k % 9)),
    )
    path = F.concat(F.lit("n"), _text(k % 40), F.lit("/f"), _text(k), F.when(k % 2 == 0, ".py").otherwise(".js"))
    return spread(read_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(path.alias("path"), F.when(k % 2 == 0, python).otherwise(script).alias("text"))


_NESTED = "p AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS py, concat('n', p_partkey % 40, '/f', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.js' END) AS path FROM part)"


@query(f"""WITH {_NESTED} SELECT path AS file, concat('far', k + 1) AS name, concat('inner', k) AS within FROM p UNION ALL SELECT path, concat('size', k % 5), concat('outer', k) FROM p
        UNION ALL SELECT path, concat('inner', k), concat('outer', k) FROM p UNION ALL SELECT path, concat('after', k % 9), NULL FROM p
        UNION ALL SELECT path, concat('far', k + 2), concat('m', k) FROM p WHERE py UNION ALL SELECT path, concat('last', k % 4), NULL FROM p WHERE py""")
def scoped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called names with the innermost function around them; comments and strings call nothing, and a function ends where its scope does."""
    files = nested_files(spark, sf_dir)
    return parsers.calls(scopes.items(files), parts_for(files.count(), 20_000)).select("file", "name", "within")


@query(f"""WITH {_NESTED}, b AS (SELECT *, CASE WHEN py THEN concat('def inner', k, '(b):' || chr(10) || '        return far', k + 1, '(b)') ELSE concat('function inner', k, '(b) {{ return far', k + 1, '(b); }}') END AS inside FROM p)
        SELECT path, concat('inner', k) AS name, 'function' AS type, inside AS body FROM b
        UNION ALL SELECT path, concat('outer', k), 'function', CASE WHEN py THEN concat('def outer', k, '(a,' || chr(10) || '    b=size', k % 5, '(2),' || chr(10) || '):' || chr(10) || '    ' || repeat(chr(34), 3) || 'def fake(): call(', k, ')' || repeat(chr(34), 3) || chr(10) || '    ', inside, chr(10), chr(10), '    s = ''g(1)''  # h(', k, ')' || chr(10) || '    return inner', k, '(a)')
            ELSE concat('function outer', k, '(a = {{}}) {{' || chr(10) || '  /* call(', k, ') */' || chr(10) || '  ', inside, chr(10), '  const s = "}}" + `h(${{a}})` + size', k % 5, '(2);' || chr(10) || '  return inner', k, '(a);' || chr(10) || '}}') END FROM b
        UNION ALL SELECT path, concat('K', k), 'class', concat('class K', k, ':' || chr(10) || '    def m', k, '(self):' || chr(10) || '        return far', k + 2, '(1)' || chr(10) || '    x = last', k % 4, '()') FROM b WHERE py
        UNION ALL SELECT path, concat('m', k), 'function', concat('def m', k, '(self):' || chr(10) || '        return far', k + 2, '(1)') FROM b WHERE py""")
def function_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every definition, from its first word to the end of its scope."""
    files = nested_files(spark, sf_dir)
    return parsers.bodies(files, scopes.items(files), parts_for(files.count(), 20_000)).select("path", "name", "type", "body")


@query(f"""WITH {_FILES} SELECT p.path AS src, q.path AS dst FROM p JOIN p q ON q.k = p.k - 40 OR q.k = p.k + 3""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir)
    imports = scopes.items(files).where("kind = 'import'")
    return parsers.resolve_imports(imports.select(F.col("path").alias("src"), "name"), files)


#: One kind of file for each remainder of the key: path, text, and what is put into each.
_KINDS: tuple[tuple[str, str], ...] = (
    ("s%1$s/Dockerfile", "FROM base%2$s:1\nRUN make\nEXPOSE 80%3$s\n"),
    ("p%1$s/package.json", '{"dependencies": {"a%2$s": "1"}, "devDependencies": {"t%3$s": "2"}, "peerDependencies": {"a%2$s": "1"}}'),
    ("t%1$s.tf", 'resource "aws_x" "r%2$s" {\n}\nmodule "net%3$s" {\n}\n'),
    ("x%1$s/pom.xml", "<project><dependencies>\n<dependency><groupId>g%2$s</groupId><artifactId>a%3$s</artifactId></dependency>\n</dependencies></project>"),
    ("k%1$s.yaml", "apiVersion: v1\nkind: Service\nmetadata: {name: s%2$s}\nspec:\n  ports:\n  - port: 90%3$s\n---\nkind: Other\n"),
    ("i%1$s.yml", "apiVersion: v1\nkind: Ingress\nmetadata: {name: i%2$s}\nspec: {rules: [{http: {paths: [{backend: {service: {name: s%3$s}}}]}}]}\n"),
    ("c%1$s/docker-compose.yml", "services:\n  web%2$s: {depends_on: [db%3$s]}\n  db%3$s: {image: x}\n"),
    ("l%1$s.lua", "-- %2$s\nfunction go%3$s()\nend\n"),
)


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the other kinds, one for each customer."""
    k = F.col("c_custkey")
    made = lambda pattern: F.format_string(pattern, _text(k), _text(k % 5), _text(10 + k % 7))
    path, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, body) in enumerate(_KINDS):
        path, text = F.when(k % len(_KINDS) == i, made(name)).otherwise(path), F.when(k % len(_KINDS) == i, made(body)).otherwise(text)
    # written, as seven parsers read them: each would make path and text anew, and for every condition on the path again
    return cut(spread(read_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(path.alias("path"), text.alias("text")))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS kind, c_custkey % 5 AS x, 10 + c_custkey % 7 AS y FROM customer),
        e AS (SELECT concat('s', k, '/Dockerfile') AS src, concat('service:s', k, ':80', y) AS dst, 'defines_service' AS type FROM c WHERE kind = 0 UNION SELECT concat('s', k, '/Dockerfile'), concat('docker_image:base', x, ':1'), 'uses_base_image' FROM c WHERE kind = 0
          UNION SELECT concat('p', k, '/package.json'), concat('npm:a', x), 'requires' FROM c WHERE kind = 1 UNION SELECT concat('p', k, '/package.json'), concat('npm:t', y), 'requires' FROM c WHERE kind = 1
          UNION SELECT concat('t', k, '.tf'), concat('terraform:aws_x.r', x), 'defines_resource' FROM c WHERE kind = 2 UNION SELECT concat('t', k, '.tf'), concat('terraform:module.net', y), 'uses_module' FROM c WHERE kind = 2
          UNION SELECT concat('x', k, '/pom.xml'), concat('maven:g', x, ':a', y), 'requires' FROM c WHERE kind = 3
          UNION SELECT concat('k', k, '.yaml'), concat('k8s_service:s', x), 'defines_resource' FROM c WHERE kind = 4 UNION SELECT concat('k8s_service:s', x), concat('k8s_endpoint:s', x, ':90', y), 'exposes_port' FROM c WHERE kind = 4
          UNION SELECT concat('i', k, '.yml'), concat('k8s_ingress:i', x), 'defines_resource' FROM c WHERE kind = 5 UNION SELECT concat('k8s_ingress:i', x), concat('k8s_service:s', y), 'routes_to' FROM c WHERE kind = 5
          UNION SELECT concat('c', k, '/docker-compose.yml'), concat('service:web', x), 'defines_service' FROM c WHERE kind = 6 UNION SELECT concat('c', k, '/docker-compose.yml'), concat('service:db', y), 'defines_service' FROM c WHERE kind = 6
          UNION SELECT concat('service:web', x), concat('service:db', y), 'depends_on' FROM c WHERE kind = 6
          UNION SELECT concat('l', k, '.lua'), concat('l', k, '.lua:go', y), 'defines' FROM c WHERE kind = 7)
        SELECT * FROM e""")
def config_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.build_graph(config_files(spark, sf_dir))[1].select("src", "dst", "type")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS kind, c_custkey % 5 AS x, 10 + c_custkey % 7 AS y FROM customer),
        n AS (SELECT DISTINCT CASE kind WHEN 4 THEN 'k8s_service' WHEN 5 THEN 'k8s_ingress' END AS type, CASE kind WHEN 4 THEN concat('s', x) ELSE concat('i', x) END AS name FROM c WHERE kind IN (4, 5)
          UNION SELECT 'k8s_service', concat('s', y) FROM c WHERE kind = 5)
        SELECT type, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY 1 UNION ALL SELECT 'file', CAST(count(*) AS BIGINT) FROM c""")
def config_graph_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes there are of the types that Kubernetes files give, and of files."""
    nodes = parsers.build_graph(config_files(spark, sf_dir))[0]
    return graph.type_histogram(nodes.where(F.col("type").isin("k8s_service", "k8s_ingress", "file")))


@query("""SELECT concat('f', n_nationkey, '.ini') AS src, concat('section:s', n_nationkey % 5) AS dst, 'has_section' AS type FROM nation""")
def added_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser for another kind of file, put before the one that takes all."""
    key = F.col("n_nationkey")
    files = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), _text(key), F.lit(".ini")).alias("path"), F.concat(F.lit("; x\n[s"), _text(key % 5), F.lit("]\nk = 1\n")).alias("text"))

    def sections(some: DataFrame) -> DataFrame:
        each = some.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\[(\w+)\]"), F.lit(1))).alias("name"))
        return each.select(F.col("path").alias("src"), F.lit("file").alias("src_type"), F.concat(F.lit("section:"), "name").alias("dst"), F.lit("section").alias("dst_type"), "name", F.lit("has_section").alias("type"))

    mine = (lambda p: F.endswith(p, F.lit(".ini")), sections)
    return parsers.build_graph(files, [*parsers.PARSERS[:-1], mine, parsers.PARSERS[-1]])[1].select("src", "dst", "type")


@query()
def function_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of the functions that the graph lists for each file; their end is found by look-ahead, which the oracle doesn't have; tests compare with Python's."""
    files = source_files(spark, sf_dir).withColumn("text", F.concat("text", F.repeat(F.lit("# more of it\n"), 12)))
    parts = parts_for(files.count(), 20_000)  # by bytes, a few tasks would search all the texts
    names = parsers.definitions(scopes.items(files)).select(F.col("file").alias("path"), "start", "name").repartition(parts, "path")
    names = names.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("n"))
    rows = files.repartition(parts, "path").join(shuffled(names.select("path", F.col("n.name").alias("names"))), "path")
    return rows.select("path", F.posexplode(relevance.function_chunks(F.col("text"), F.col("names"))).alias("pos", "chunk"))
