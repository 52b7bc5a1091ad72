"""Rule matching and relevance scores of files against declared patterns, in built-in functions but for the index of globs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import rates
from quarrymill.functions import text as T
from quarrymill.functions.globs import GlobIndex
from quarrymill.operators.order import running_totals, with_sizes
from quarrymill.sources.tables import shuffled

#: Weight of the first entry that a lower-cased decorator contains.
DECORATOR_WEIGHTS = (
    ("route", 0.8), ("controller", 0.8), ("restcontroller", 0.9),
    ("get", 0.6), ("post", 0.6), ("put", 0.6), ("delete", 0.6), ("patch", 0.6),
    ("requestmapping", 0.7), ("api", 0.7), ("endpoint", 0.7),
    ("service", 0.8), ("component", 0.7), ("bean", 0.6), ("injectable", 0.7), ("provider", 0.6),
    ("messagehandler", 0.9), ("rabbitlistener", 0.9), ("kafkalistener", 0.9), ("eventhandler", 0.8), ("streamlistener", 0.8),
    ("circuitbreaker", 0.9), ("retry", 0.7), ("timeout", 0.6), ("fallback", 0.7), ("bulkhead", 0.7),
    ("authenticated", 0.5), ("secured", 0.5), ("authorized", 0.5),
)
#: Weight of the first entry that a lower-cased class name contains.
CLASS_WEIGHTS = (
    ("controller", 0.8), ("service", 0.8), ("repository", 0.7), ("client", 0.7), ("gateway", 0.9), ("proxy", 0.8),
    ("handler", 0.7), ("listener", 0.7), ("consumer", 0.7), ("producer", 0.7), ("adapter", 0.6), ("facade", 0.6),
)
#: Weight of each class of string literals.
LITERAL_WEIGHTS = {"url": 0.8, "endpoint": 0.7, "queue": 0.9}
#: Which signals a file of an extension can have; an unknown extension has all.
SIGNALS = {
    ".py": ("decorator", "string", "class"), ".js": ("decorator", "string", "class"), ".ts": ("decorator", "string", "class"), ".java": ("decorator", "string", "class"),
    ".go": ("string", "class"), ".cs": ("decorator", "string", "class"), ".rb": ("string", "class"), ".php": ("decorator", "string", "class"), ".sh": ("string",), ".rs": ("decorator", "string", "class"),
}


def match_rules(files: DataFrame, rules: DataFrame, path: str = "path", limit: int = 100_000) -> DataFrame:
    """path, pattern, rule_no, priority of every rule whose glob matches a file.

    rules: pattern, rule_no, glob, priority - a declared table; more than `limit` are refused. They are put into an index
    once on the driver (see `globs.GlobIndex`), and a path meets only the rules whose components it has from the right on.
    """
    listed = rules.select("pattern", F.col("rule_no").cast("int"), "priority", "glob").limit(limit + 1).collect()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} rules")
    names = [path, "pattern", "rule_no", "priority"]
    shared = files.sparkSession.sparkContext.broadcast(([tuple(r)[:3] for r in listed], GlobIndex([r["glob"] for r in listed])))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, index = shared.value
        for part in parts:
            yield pd.DataFrame([(p, *of[i]) for p in part[path] for i in index.matches(p)], columns=names)

    each = files.select(path).where(F.col(path).isNotNull()).distinct()
    return each.mapInPandas(run, f"`{path}` string, pattern string, rule_no int, priority string")


def tiers(matches: DataFrame, path: str = "path") -> DataFrame:
    """pattern, path, tier: 1 for matches of rules of high priority, 2 for the others; a file may be in both."""
    return matches.select("pattern", path, F.when(F.col("priority") == "high", 1).otherwise(2).alias("tier")).distinct()


def keyword_hits(files: DataFrame, matches: DataFrame, keywords: DataFrame, path: str = "path", text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """pattern, path, keywords, anti_keywords, keyword_score: what a file contains of the keywords of the rules that match it, sorted.

    keywords: pattern, rule_no, keyword, kind ('pos' or 'anti') - declared, broadcast if there are `broadcast_rows` at most,
    else joined by a shuffle. What is wanted of a file is gathered without its text; texts are joined to it once. Where rules match all files, `keyword_scan` needs no join.
    """
    words = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("keyword"))))
    few = keywords.limit(broadcast_rows + 1).count() <= broadcast_rows
    each = matches.join(F.broadcast(keywords) if few else keywords, ["pattern", "rule_no"]).groupBy(path, "pattern").agg(words("pos").alias("pos"), words("anti").alias("anti"))
    wanted = each.groupBy(path).agg(F.collect_list(F.struct("pattern", "pos", "anti")).alias("__wanted"))
    return keyword_scan(files.select(path, text).join(wanted, path), F.col("__wanted"), path, text)


def declared(keywords: list[tuple[str, int, str, str]]) -> Column:
    """Declared keywords (pattern, rule_no, keyword, kind) as an array of (pattern, pos, anti), keywords sorted, for `keyword_scan`."""
    words = lambda p, kind: F.array(*(F.lit(k) for k in sorted({k for q, _, k, of in keywords if q == p and of == kind}))).cast("array<string>")
    return F.array(*(F.struct(F.lit(p).alias("pattern"), words(p, "pos").alias("pos"), words(p, "anti").alias("anti")) for p in sorted({k[0] for k in keywords})))


def keyword_scan(files: DataFrame, wanted: Column, path: str = "path", text: str = "text") -> DataFrame:
    """pattern, path, keywords, anti_keywords, keyword_score of files that have any keyword of a pattern.

    wanted: array of (pattern, pos, anti) of the patterns that a file's rules match - a column of `files`, or the same for
    all (see `declared`). One scan: the text meets its keywords in its own row, is folded once, and isn't shuffled.
    """

    def of(doc: Column) -> Column:
        def one(w: Column) -> Column:
            have = lambda words: F.filter(words, lambda k: F.contains(doc["t"], F.lower(k)))
            return F.struct(w["pattern"].alias("pattern"), have(w["pos"]).alias("keywords"), have(w["anti"]).alias("anti_keywords"))

        found = F.filter(F.transform(wanted, one), lambda h: (F.size(h["keywords"]) > 0) | (F.size(h["anti_keywords"]) > 0))
        weighed = F.array(F.struct(doc["t"].alias("t"), F.when(F.size(found) > 0, _weighed_lines(doc["t"])).alias("ls")))
        score = lambda h: F.struct(h["pattern"].alias("pattern"), h["keywords"].alias("keywords"), h["anti_keywords"].alias("anti_keywords"), F.transform(weighed, lambda d: _score_of(d, h["keywords"], h["anti_keywords"]))[0].alias("score"))
        return F.transform(found, score)

    each = files.select(path, F.explode(F.transform(F.array(F.struct(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))), of)[0]).alias("h"))
    return each.select(F.col("h.pattern").alias("pattern"), path, "h.keywords", "h.anti_keywords", F.col("h.score").alias("keyword_score"))


def line_weight(line: Column) -> Column:
    """How much a keyword in this (lower-cased) line is worth: a type, a function, an import, a comment, anything else."""
    has = lambda *parts: F.greatest(*(F.contains(line, F.lit(p)) for p in parts))
    return F.when(has("class ", "interface ", "struct "), 0.30).when(has("def ", "function ", "func ", "public ", "private "), 0.25).when(has("import ", "from ", "require(", "use "), 0.15).when(F.ltrim(line).rlike(r"^(#|//|/\*|\*|<!--)"), 0.05).otherwise(0.10)


def keyword_score(text: Column, keywords: Column, anti_keywords: Column) -> Column:
    """The score of a text for the keywords (and anti-keywords) that were found in it, from 0 to 1.

    Each keyword: 0.15, the best line weight among the first 200 lines that have it, and 0.03 for each occurrence
    up to 0.20. Each anti-keyword takes 0.08 for each occurrence up to 0.30. The sum, 0 at least, is divided by
    0.8 for each keyword and is 1 at most. Lines and the lower-cased text are computed once for a text.
    """
    folded = F.lower(F.coalesce(text, F.lit("")))
    packed = F.array(F.struct(folded.alias("t"), _weighed_lines(folded).alias("ls")))
    return F.when(F.size(keywords) > 0, F.transform(packed, lambda d: _score_of(d, keywords, anti_keywords))[0]).otherwise(0.0)


def _weighed_lines(folded: Column) -> Column:
    """The first 200 lines with their weights."""
    return F.transform(T.lines(folded, 200), lambda s: F.struct(s.alias("line"), line_weight(s).alias("w")))


def _score_of(doc: Column, keywords: Column, anti_keywords: Column) -> Column:
    """The keyword score from the folded text t and its weighed lines ls."""

    def positive(k: Column) -> Column:
        low = F.lower(k)
        best = F.array_max(F.transform(F.filter(doc["ls"], lambda s: F.contains(s["line"], low)), lambda s: s["w"]))
        return 0.15 + F.coalesce(best, F.lit(0.0)) + F.least(T.occurrences(doc["t"], low) * 0.03, F.lit(0.20))

    def negative(k: Column) -> Column:
        return F.least(T.occurrences(doc["t"], F.lower(k)) * 0.08, F.lit(0.30))

    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, k: a + f(k))
    raw = F.greatest(total(keywords, positive) - total(anti_keywords, negative), F.lit(0.0))
    return F.when(F.size(keywords) > 0, F.least(raw / (F.size(keywords) * 0.8), F.lit(1.0))).otherwise(0.0)


def priority_score(keyword: Column, embedding: Column, parser: Column, llm: Column, weights: tuple[float, float, float, float] = (0.20, 0.10, 0.00, 0.70)) -> Column:
    k, e, p, v = weights
    return F.greatest(k * keyword + e * embedding + p * parser + v * llm, F.lit(0.0))


def first_weight(name: Column, table: tuple[tuple[str, float], ...], otherwise: float) -> Column:
    """The weight of the first entry that the lower-cased name contains."""
    low = F.lower(name)
    out = F.when(F.contains(low, F.lit(table[0][0])), table[0][1])
    for part, weight in table[1:]:
        out = out.when(F.contains(low, F.lit(part)), weight)
    return out.otherwise(otherwise)


def decorator_score(decorators: DataFrame) -> DataFrame:
    """file, decorator_score from one row for each decorator (file, name)."""
    w = first_weight(F.col("name"), DECORATOR_WEIGHTS, 0.1)
    return decorators.groupBy("file").agg(F.least(rates.guarded(F.sum(w), F.count("*") * 0.9), F.lit(1.0)).alias("decorator_score"))


def class_score(classes: DataFrame) -> DataFrame:
    """file, class_score from one row for each class (file, name)."""
    w = first_weight(F.col("name"), CLASS_WEIGHTS, 0.05)
    return classes.groupBy("file").agg(F.least(F.sum(w) / (F.greatest(F.count("*"), F.lit(2)) * 0.7), F.lit(1.0)).alias("class_score"))


def string_score(literals: DataFrame) -> DataFrame:
    """file, string_score from one row for each literal (file, value); literals of no class count for nothing."""
    kind = T.literal_class(F.col("value"))
    w = F.when(kind == "url", LITERAL_WEIGHTS["url"]).when(kind == "endpoint", LITERAL_WEIGHTS["endpoint"]).when(kind == "queue", LITERAL_WEIGHTS["queue"])
    found = literals.withColumn("w", w).where(F.col("w").isNotNull())
    return found.groupBy("file").agg(F.least(F.sum("w") / (F.greatest(F.count("*"), F.lit(3)) * 0.8), F.lit(1.0)).alias("string_score"))


def parser_score(scores: DataFrame, path: str = "path") -> DataFrame:
    """The mean of centrality and of those of decorator, string and class score that the file's language can have."""
    ext = T.suffix(F.col(path))
    has = F.create_map(*(x for e, signals in SIGNALS.items() for x in (F.lit(e), F.array(*map(F.lit, signals)))))[ext]
    can = lambda s: has.isNull() | F.array_contains(has, s)
    parts = F.array_compact(F.array(F.col("centrality"), *(F.when(can(s), F.col(f"{s}_score")) for s in ("decorator", "string", "class"))))
    return scores.withColumn("parser_score", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))


def queue(scored: DataFrame, by: list[str], floor: float = 0.10, budget: int = 20, tie: str = "path") -> DataFrame:
    """The `budget` best rows of each group with a score of `floor` at least, ranked by falling score, then by `tie`, with tiers."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    return scored.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget).withColumn("tier", rates.tier(F.col("score")))


def queue_composition(queued: DataFrame, by: list[str]) -> DataFrame:
    return queued.groupBy(*by).agg(*(F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")))


def _tails(path: Column) -> Column:
    """What follows each / of a path, longest first."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))


def resolve_paths(claimed: DataFrame, real: DataFrame) -> DataFrame:
    """claim_id, claimed -> path, stage: exact, else case-insensitive, else as a suffix, else by file name; null if none.

    real: path, seq; the lowest seq of the first stage that hits wins. Each way of hitting is a key: the path, the
    lower-cased path, what follows one of its slashes (of either side), the file name. Of all paths of a key only the first
    can win, so a claim meets one row for each of its keys, however many paths a file name has.
    """
    of = lambda way, found: F.transform(found, lambda k: F.struct(F.lit(way).alias("way"), k.alias("key")))
    keys = lambda *each: F.explode(F.concat(*(of(way, found) for way, found in enumerate(each))))
    low, rlow = F.lower("claimed"), F.lower("path")
    name = lambda path: F.array(F.lower(T.file_name(path)))
    c = claimed.where("claimed IS NOT NULL").select("claim_id", keys(F.array("claimed"), F.array(low), F.array(low), _tails(low), name(F.col("claimed"))).alias("k")).select("claim_id", "k.way", "k.key").distinct()
    r = real.where("path IS NOT NULL").select("seq", "path", keys(F.array("path"), F.array(rlow), _tails(rlow), F.array(rlow), name(F.col("path"))).alias("k"))
    firsts = r.groupBy("k.way", "k.key").agg(F.min(F.struct("seq", "path")).alias("first"))
    stage = F.element_at(F.array(*map(F.lit, (1, 2, 3, 3, 4))), F.col("way") + 1)
    best = c.join(shuffled(firsts), ["way", "key"]).groupBy("claim_id").agg(F.min(F.struct(stage.alias("stage"), "first")).alias("b")).select("claim_id", F.col("b.first.path").alias("path"), F.col("b.stage").alias("stage"))
    return claimed.select("claim_id", "claimed").join(shuffled(best), "claim_id", "left")


def context_windows(text: Column, keywords: Column, around: int = 2, limit: int = 5) -> Column:
    """The first `limit` distinct snippets of lines around those that contain a keyword."""
    def of(ls: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.exists(keywords, lambda k: F.contains(F.lower(F.get(ls, i)), F.lower(k))))
        cut = lambda i: F.array_join(F.slice(ls, F.greatest(i - around, F.lit(0)) + 1, F.least(i + around, F.size(ls) - 1) - F.greatest(i - around, F.lit(0)) + 1), "\n")
        return F.slice(F.array_distinct(F.transform(hits, cut)), 1, limit)

    return F.transform(F.array(T.lines(text)), of)[0]


#: What begins a block, for the second way of chunking.
BLOCKS = (
    r"(?sim)((?:class|interface|struct)\s+\w+.*?(?=\n(?:class|interface|struct)\s|\z))",
    r"(?sim)((?:def|function|func|public|private)\s+\w+\s*\([^)]*\).*?(?=\n(?:def|function|func|public|private)\s|\z))",
    r"(?sim)(@\w+.*?\n(?:def|function|async\s+function)\s+\w+.*?(?=\n(?:def|function|@)\s|\z))",
)


def chunks(text: Column, size: int = 2000, most: int = 10, least: int = 100) -> Column:
    """At most `most` chunks: blocks over `least` characters by the patterns, each cut to `size`; if there is none and
    the text has over 500 characters, its head, a piece from a third of it on, and its tail."""
    t = F.coalesce(text, F.lit(""))
    found = F.filter(F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in BLOCKS)), lambda c: F.length(c) > least)
    third = F.least(F.floor(F.length(t) / 3), F.lit(5000)).cast("int")
    places = F.array_compact(F.array(F.substring(t, 1, size), F.substring(t, third + 1, F.lit(size)), F.when(F.length(t) > size, F.right(t, F.lit(size)))))
    packed = F.array(F.transform(found, lambda c: F.substring(c, 1, size)))  # blocks are searched once for a text
    return F.slice(F.transform(packed, lambda blocks: F.when(F.size(blocks) > 0, blocks).when(F.length(t) > 500, places).otherwise(F.array().cast("array<string>")))[0], 1, most)


#: Words that a listed definition begins with, and that the next one begins with.
_OPENS, _NEXT = "def|function|func|class|interface|public|private", "def|function|func|class|public|private"


def function_chunks(text: Column, names: Column, size: int = 3000, most: int = 10, least: int = 100) -> Column:
    """The first way of chunking: bodies of the definitions in `names`, from the opening word to the next definition, each
    over `least` characters and cut to `size`; without any, the chunks of the second way (see `chunks`)."""
    t = F.coalesce(text, F.lit(""))
    body = lambda n: F.concat(F.lit(rf"(?sim)((?:{_OPENS})\s+"), F.regexp_replace(n, r"([^\w])", r"\\$1"), F.lit(rf"\s*[\({{].*?(?=\n(?:{_NEXT})\s|\z))"))
    found = F.filter(F.flatten(F.transform(names, lambda n: F.regexp_extract_all(t, body(n), F.lit(1)))), lambda c: F.length(c) > least)
    packed = F.array(F.struct(t.alias("t"), found.alias("found")))  # found once for a text
    return F.slice(F.transform(packed, lambda d: F.when(F.size(d["found"]) > 0, F.transform(d["found"], lambda c: F.substring(c, 1, size))).otherwise(chunks(d["t"])))[0], 1, most)


def batches(rows: DataFrame, order: list[str], by: list[str], size: int = 600, threshold: int = 800) -> DataFrame:
    """batch number within each group: one batch up to `threshold` rows, else batches of `size` in order. Places come by ranges, not by a window of a group."""
    placed = with_sizes(running_totals(rows, by, order, {"__place": F.lit(1).cast("long")}), by, "__size")
    batch = F.when(F.col("__size") <= threshold, F.lit(0)).otherwise(F.floor(F.col("__place") / size)).cast("int")
    return placed.withColumn("batch", batch).drop("__place", "__size")


def evidence_digest(evidence: DataFrame, by: list[str], chars: int = 220) -> DataFrame:
    """One text for each group: its reports by falling confidence, each cut to `chars`."""
    rows = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("k"), F.col("file").alias("file"), F.substring("text", 1, chars).alias("text"))))
    return evidence.groupBy(*by).agg(rows.alias("rows")).select(*by, F.array_join(F.transform("rows", lambda r: F.format_string("%s (%.2f): %s", r["file"], -r["k"], r["text"])), "\n").alias("digest"))


def hints(rules: DataFrame, keywords: DataFrame) -> DataFrame:
    """pattern, high, low (globs in the order of rules), keywords, anti_keywords (each once, in order) of declared patterns."""
    globs = rules.groupBy("pattern").agg(*(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce(F.col("priority") == "high", F.lit(False)) == is_high, F.struct("rule_no", "glob")))), lambda x: x["glob"]).alias(n) for n, is_high in (("high", True), ("low", False))))
    place = keywords.withColumn("__at", F.struct("rule_no", "seq") if "seq" in keywords.columns else F.struct("rule_no", "keyword"))
    words = place.groupBy("pattern").agg(*(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("__at", "keyword")))), lambda x: x["keyword"])).alias(n) for n, kind in (("keywords", "pos"), ("anti_keywords", "anti"))))
    empty = F.array().cast("array<string>")
    return globs.join(words, "pattern", "left").select("pattern", "high", "low", F.coalesce("keywords", empty).alias("keywords"), F.coalesce("anti_keywords", empty).alias("anti_keywords"))


def summary(files: DataFrame, centrality: DataFrame, by: str = "repo", sample: int = 50, extensions: int = 6, dirs: int = 8, hubs: int = 5) -> DataFrame:
    """repo, extensions, dirs, hubs: the most frequent extensions of the first `sample` files (path, seq), the first top folders
    by name, and the files of highest centrality (path, centrality), each put together with commas."""
    first = files.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy("seq", "path"))).where(F.col("__rn") <= sample)
    top = lambda df, order, n, name, out: df.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__k") <= n).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__k", name))), lambda x: x[name]), ",").alias(out))
    ext = first.groupBy(by, T.suffix(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))
    folders = first.select(by, T.first_dir(F.col("path")).alias("dir")).where("dir <> ''").distinct()
    ranked = files.select(by, "path").distinct().join(centrality.select("path", "centrality"), "path")
    out = files.select(by).distinct().join(top(ext, [F.desc("n"), F.asc("ext")], extensions, "ext", "extensions"), by, "left")
    out = out.join(top(folders, [F.asc("dir")], dirs, "dir", "dirs"), by, "left").join(top(ranked, [F.desc("centrality"), F.asc("path")], hubs, "path", "hubs"), by, "left")
    return out.na.fill("", ["extensions", "dirs", "hubs"])
