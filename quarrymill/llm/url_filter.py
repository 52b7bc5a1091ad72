"""URL filters: declared rules first, then the ratio of two character language models for what no rule decides.

The rules' own verdicts are the labels: URLs that they allow train one model, those that they block the other. Both are
variable-order Markov models over characters, from contexts of four characters down to none: what follows a context is
estimated from its counts and, in proportion to how many different characters follow it, from the next shorter context
(Witten-Bell smoothing), so rare contexts lean on shorter ones and unseen ones are passed over.

Counts are tables over all labelled URLs, as large as the corpus makes them. A table of k-grams meets that of
(k-1)-grams by its suffix, of which it has no more rows than there are characters, so no join has a hot key; log ratios
of those grams that occur are joined to occurrences, the frequent ones by broadcast. Ratios are whole millionths, so sums
are exact in any order. The difference for each character is compared with a threshold that labelled URLs kept from
training calibrate.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.sources.tables import cut

#: Characters of the longest gram: the last one and its context.
ORDER = 5
#: Stand before and after each URL.
START, END = "\x02", "\x03"
#: Millionths in a step of the threshold, and the steps looked at on each side of 0.
STEP = 2000
STEPS = 5000
#: Grams that occur more often are joined by broadcast, if there are at most `BROADCAST_ROWS` of them.
CROWD = 1_000
BROADCAST_ROWS = 500_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the catalogue's query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lowered, and from there to `?`, `#` or the end; both empty without `://`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls. `rules` is a short declared list: each is one test of a row."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def grams(url: Column) -> Column:
    """The last character with its context, for each character of a URL and its end."""
    chars = F.split(F.concat(F.lit(START * (ORDER - 1)), url, F.lit(END)), "")
    return F.transform(F.array(chars), lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - ORDER), lambda i: F.concat(*(F.get(a, i + j) for j in range(ORDER)))))[0]


def smoothed(counts: DataFrame) -> DataFrame:
    """gram, p_a and p_b: the probability of the last character after the others, under each model.

    counts: gram, a and b (occurrences in training; 0 and 0 for those that are only asked for).
    """
    length = F.explode(F.sequence(F.lit(1), F.lit(ORDER)))
    every = counts.select("gram", "a", "b", length.alias("k")).groupBy("k", F.substr("gram", ORDER + 1 - F.col("k")).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    every = every.withColumn("context", F.substr("gram", F.lit(1), F.col("k") - 1))
    totals = every.groupBy("k", "context").agg(*(f(x).alias(f"{name}_{x}") for x in "ab" for name, f in (("n", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))))
    every = cut(every.join(totals, ["k", "context"]))
    even = F.lit(1.0 / (every.where("k = 1").count() + 1))
    found = None
    for k in range(1, ORDER + 1):
        here = every.where(F.col("k") == k)
        if found is None:
            here = here.withColumns({"q_a": even, "q_b": even})
        else:
            here = here.withColumn("suffix", F.substr("gram", F.lit(2))).join(found.select(F.col("gram").alias("suffix"), F.col("p_a").alias("q_a"), F.col("p_b").alias("q_b")), "suffix")
        p = {x: F.when(F.col(f"n_{x}") == 0, F.col(f"q_{x}")).otherwise((F.col(x) + F.col(f"kinds_{x}") * F.col(f"q_{x}")) / (F.col(f"n_{x}") + F.col(f"kinds_{x}"))) for x in "ab"}
        found = here.select("gram", p["a"].alias("p_a"), p["b"].alias("p_b"))
    return found


def differences(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """row, total: the sum of log ratios, in millionths, over the grams of each of `rows` (row, url). counts: also n, how often a gram occurs in them."""
    ratio = F.round(F.log(F.col("p_a") / F.col("p_b")) * 1_000_000).cast("long")
    ratios = cut(counts.where("n > 0").select("gram", "n").join(smoothed(counts), "gram").select("gram", "n", ratio.alias("ratio")))
    met = rows.select("row", F.explode(grams(F.col("url"))).alias("gram"))
    known = ratios.select("gram", "ratio")
    frequent = ratios.where(F.col("n") > CROWD).select("gram", "ratio")
    if frequent.count() > BROADCAST_ROWS:
        parts = met.join(known, "gram").select("row", "ratio")
    else:
        few = F.broadcast(frequent)
        parts = met.join(few, "gram").select("row", "ratio").union(met.join(few, "gram", "left_anti").join(known, "gram").select("row", "ratio"))
    return parts.groupBy("row").agg(F.sum("ratio").alias("total"))


def threshold(scored: DataFrame) -> int:
    """The step from which on URLs are allowed: the one that decides best on `scored` (label, step), classes counting alike.

    Of equals the one next to 0, then the lower; 0 without labels of both kinds. The rows gathered are one for each step.
    """
    steps = F.greatest(F.least("step", F.lit(STEPS)), F.lit(-STEPS)).alias("step")
    found = {}
    for r in scored.groupBy(steps).agg(*(F.count_if(F.col("label") == v).alias(v) for v in ("allow", "block"))).collect():
        found[r["step"]] = (r["allow"], r["block"])
    good, bad = (sum(v[i] for v in found.values()) for i in (0, 1))
    if not good or not bad:
        return 0
    kept, refused, lowest, best = good, 0, -STEPS, []
    for step in [*sorted(found), STEPS + 1]:
        # all thresholds from the last step seen to this one decide alike
        edge = min(max(0, lowest), step)
        best.append((-(kept * bad + refused * good), abs(edge), edge))
        here = found.get(step, (0, 0))
        kept, refused, lowest = kept - here[0], refused + here[1], step + 1
    return min(best)[2]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict ('allow' or 'block') of every URL, whole.

    A null URL has empty host and path and is judged as an empty one; an id may be null or repeated, each row is judged. Where
    the rules allow none or block none of the URLs that train, nothing is learned and what no rule decides is allowed. An
    empty table gives an empty one. Other columns are not read.
    """
    # rows are numbered once, so that repeated ids and URLs stay apart
    base = cut(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("row", F.monotonically_increasing_id()))
    host, path = host_and_path(F.col("url"))
    base = base.withColumns({"host": host, "path": path, "url": F.coalesce("url", F.lit(""))})
    rule, label = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "label": label})
    aside = F.substring(F.md5("url"), 1, 1) < "3"
    trains, asked = F.col("label").isNotNull() & ~aside, F.col("label").isNull() | aside
    seen = base.select(F.explode(grams(F.col("url"))).alias("gram"), *((trains & (F.col("label") == v)).cast("long").alias(x) for x, v in (("a", "allow"), ("b", "block"))), asked.cast("long").alias("n"))
    counts = cut(seen.groupBy("gram").agg(*(F.sum(x).alias(x) for x in "abn")))
    trained = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not trained["a"] or not trained["b"]:
        return base.select("page_id", "host", "path", "rule", F.coalesce("label", F.lit("allow")).alias("verdict"))
    wanted = base.where(asked)
    totals = cut(differences(wanted, counts))
    span = (F.char_length("url") + 1) * STEP
    step = (F.col("total") - F.pmod("total", span)) / span
    scored = wanted.join(totals, "row").select("row", "label", step.cast("long").alias("step"))
    edge = threshold(scored.where("label is not null"))
    learned = scored.where("label is null").select("row", F.when(F.col("step") >= edge, "allow").otherwise("block").alias("verdict"))
    return base.join(learned, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("label", "verdict").alias("verdict"))
