"""URL filter: longest-matching rules, and boosted trees on lexical features beyond them.

Everything is a column expression or JVM machine learning.  Rules carry a host
(it and all subdomains) and a path prefix.  URLs that a rule decides are the
labelled ones: boosted trees learn block or allow from a bounded sample of them
and judge every URL that no rule fits.

Features: lengths of url, host, path and query, path depth, host labels, digit
ratios, entropy of the url's characters, parameter count, hyphens, longest path
part, whether https, and suffix statistics (smoothed share of blocked URLs under
the host's last one and last two labels, over the sample).

Cases: a null url, or one without ``://``, has an empty host and path and fits
no rule; without labelled URLs, or with one class of them, the method answers
that class (allow when there is none); a repeated row is judged again; no rows
give an empty result.  Columns beyond page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (verdict, rule), as the filter's user gives them.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: At most this many labelled URLs are learned from: those whose hash is lowest.
SAMPLE_ROWS = 4000
TREES, DEPTH, STEP = 12, 4, 0.3
PRIOR = 5.0  # rows' worth of prior in a suffix's share


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, or two empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(rules=RULES) -> Column:
    """The longest rule that fits columns host and path, as struct(rule, verdict) or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical() -> dict[str, Column]:
    """Features by name from columns u (the url, never null), host and path."""
    n = F.greatest(F.length("u"), F.lit(1)).cast("double")
    query = F.regexp_extract("u", r"\?([^#]*)", 1)
    share = lambda c: (F.length("u") - F.length(F.replace(F.col("u"), c, F.lit("")))).cast("double") / n
    entropy = F.aggregate(F.array_distinct(F.split(F.col("u"), "")), F.lit(0.0), lambda s, c: s - F.when(c != "", share(c) * F.log2(share(c))).otherwise(0.0))
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    return {
        "url_length": F.length("u").cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "query_length": F.length(query).cast("double"),
        "depth": count(F.col("path"), "/[^/]+"),
        "labels": count(F.col("host"), r"[^.]+"),
        "digit_ratio": count(F.col("u"), "[0-9]") / n,
        "host_digit_ratio": count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1)),
        "entropy": entropy,
        "parameters": count(query, "[^&]+"),
        "hyphens": count(F.col("u"), "-"),
        "longest_part": F.array_max(F.transform(F.split(F.col("path"), "/"), F.length)).cast("double"),
        "https": F.startswith(F.col("u"), F.lit("https:")).cast("double"),
    }


def suffixes() -> tuple[Column, Column]:
    return F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)


class UrlTrees:
    """Boosted trees over labelled URLs; verdict() is a column of the scored frame."""

    def __init__(self, labelled: DataFrame, rows: int = SAMPLE_ROWS):
        """labelled: u, host, path, y (1: block)."""
        self.one_class, self.model, self.share = "allow", None, {}
        sample = labelled.orderBy(F.xxhash64("u"), "u").limit(rows)
        s1, s2 = suffixes()
        base = sample.select("*", s1.alias("s1"), s2.alias("s2"), *[c.alias(k) for k, c in lexical().items()])
        base = C.Scratch(labelled.sparkSession).keep(base.coalesce(1))
        classes = {r.y: r.n for r in base.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(classes) < 2:
            self.one_class = "block" if 1 in classes else "allow"
            return
        total = sum(classes.values())
        self.prior = classes[1] / total
        # at most 2 x rows suffixes: the sample bounds these maps
        for s in ("s1", "s2"):
            got = base.groupBy(s).agg(F.sum("y").alias("b"), F.count("*").alias("n")).collect()
            self.share[s] = {r[s]: (r.b + PRIOR * self.prior) / (r.n + PRIOR) for r in got}
        self.rows = base
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        self.assembler = VectorAssembler(inputCols=[*lexical(), "share1", "share2"], outputCol="x")
        trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=9, checkpointInterval=-1)
        self.model = trees.fit(self.assembler.transform(self._shares(base.coalesce(1))).select("x", "y"))

    def _shares(self, df: DataFrame) -> DataFrame:
        def of(column: str) -> Column:
            shares = sorted(self.share[column].items())
            # share maps travel as literals of the plan
            m = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in shares]), F.array(*[F.lit(float(v)) for _, v in shares]))
            return F.coalesce(F.try_element_at(m, F.col(column)), F.lit(float(self.prior)))

        return df.withColumns({"share1": of("s1"), "share2": of("s2")})

    def _tree(self, node) -> Column:
        """One fitted tree as nested CASE expressions."""
        names = self.assembler.getInputCols()
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.col(names[split.featureIndex()]) <= F.lit(float(split.threshold())), self._tree(node.leftChild())).otherwise(self._tree(node.rightChild()))

    def verdicts(self, df: DataFrame) -> DataFrame:
        """df (u, host, path, ...) with a column `judged`."""
        if self.model is None:
            return df.withColumn("judged", F.lit(self.one_class))
        s1, s2 = suffixes()
        wide = self._shares(df.select("*", s1.alias("s1"), s2.alias("s2"), *[c.alias(k) for k, c in lexical().items()]))
        margin = F.lit(0.0)
        for tree, weight in zip(self.model.trees, self.model.treeWeights):
            margin = margin + F.lit(float(weight)) * self._tree(tree._java_obj.rootNode())  # noqa: SLF001
        return wide.withColumn("margin", margin).select(*df.columns, F.when(F.col("margin") > 0, "block").otherwise("allow").alias("judged"))


def judge(pages: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    host, path = parts(F.col("url"))
    p = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", F.coalesce("url", F.lit("")).alias("u"), host.alias("host"), path.alias("path"))
    p = p.withColumn("m", matched(rules))
    labelled = p.where("m IS NOT NULL").select("u", "host", "path", (F.col("m.verdict") == "block").cast("int").alias("y"))
    trees = UrlTrees(labelled, rows)
    judged = trees.verdicts(p.where("m IS NULL").select("page_id", "u", "host", "path"))
    ruled = p.where("m IS NOT NULL").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"))
    return ruled.unionByName(judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.col("judged").alias("verdict")))


def op9(spark, sf_dir):
    return judge(C.table(spark, sf_dir, "pages"))
