"""URL filter by a tree of path templates with smoothed, labelled purity.

The paths of a host form a tree.  Level by level, segments become wildcards where they vary (digits,
hexadecimal runs, segments too rare to stand alone), and branches whose share of bad labels does not
differ from that of their siblings are merged into the wildcard; a branch that does differ keeps
its own template.  The purity of a template is its share of bad labels, smoothed towards its host's,
which is smoothed towards the share over all.  A template is blocked if its odds of a bad label are
``odds`` times those of all pages, and its own labels alone exclude the share over all.

The tree grows over counts of distinct generalised paths, never over the pages themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.common import staged, table

#: Fixed values: (host, path, verdict); a rule fits its host and all subdomains, the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A segment stands alone from this many pages on, and this share of its parent's pages.
SUPPORT, SHARE = 20, 0.02
#: A branch differs from its siblings at this many standard errors, with LABELLED labels on either side.
DIFFERS, LABELLED = 1.96, 10
#: Pseudo-labels of the level above, and the odds, against those over all, from which a template is blocked.
PRIOR, ODDS = 10.0, 2.0


def parts(url) -> tuple[F.Column, F.Column]:
    """(host, path); both empty for a null url or one without ``://``."""
    u = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(u, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(u, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, null if none."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def generalised(path) -> F.Column:
    """Segments of a path, digits and hexadecimal runs as wildcards; an extension stays."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9]+(?=\.[A-Za-z0-9]{1,5}$|$)", "<n>"), r"^[0-9a-fA-F-]{8,}(?=\.[A-Za-z0-9]{1,5}$|$)", "<h>"))


def templates(urls: DataFrame, **how) -> DataFrame:
    """(host, segments, template, purity, floor, base) for every distinct generalised path of ``urls`` (host, path, bad).

    ``bad`` is 1, 0, or null where there is no label.  ``floor`` is the lower end of the interval (Wilson, two
    sides of 95 %) of the template's own share, ``base`` the share over all.  A node that has too few pages or
    labels for any branch to stand alone, or labels of one kind only, is wildcards from there on, at any depth.
    """
    support, share, prior = how.get("support", SUPPORT), how.get("share", SHARE), how.get("prior", PRIOR)
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    one = urls.select("host", generalised(F.col("path")).alias("segments"), F.lit(1).alias("n"), F.col("bad").isNotNull().cast("long").alias("labelled"), F.coalesce(F.col("bad").cast("long"), F.lit(0)).alias("bad"))
    tree = staged(one.groupBy("host", "segments").agg(*sums).withColumns({"template": F.lit(""), "open": F.lit(True)}), "paths")
    level = 0
    while not tree.where(F.col("open")).isEmpty():
        child = tree.where("open").withColumn("child", F.get("segments", F.lit(level)))
        nodes = child.groupBy("host", "template", "child").agg(*sums)
        total = nodes.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")])
        rest_l, rest_b = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        p = F.col("all_bad") / F.col("all_labelled")
        z = F.abs(F.col("bad") / F.col("labelled") - rest_b / rest_l) / F.sqrt(p * (1 - p) * (1 / F.col("labelled") + 1 / rest_l))
        splits = (F.col("all_n") >= support) & (F.col("all_labelled") >= 2 * LABELLED) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled"))
        differs = splits & (F.col("labelled") >= LABELLED) & (rest_l >= LABELLED) & (z >= DIFFERS)
        common = (F.col("n") >= support) & (F.col("n") >= share * F.col("all_n"))
        named = F.when(F.col("child").isNull(), F.lit("")).when(common & F.coalesce(differs, F.lit(False)), F.concat(F.lit("/"), "child")).otherwise(F.lit("/*"))
        steps = nodes.join(total, ["host", "template"]).select("host", "template", "child", named.alias("step"), splits.alias("splits"))
        s = steps.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("child").alias("c"), "step", "splits")
        met = (child["host"] == s["h"]) & (child["template"] == s["t"]) & child["child"].eqNullSafe(s["c"])
        left = F.size("segments") - level
        whole = F.when(F.col("splits") | (left <= 0), F.concat("template", "step")).otherwise(F.concat("template", F.repeat(F.lit("/*"), left)))
        grown = child.join(s, met).select("host", "segments", "n", "labelled", "bad", whole.alias("template"), (F.col("splits") & (left > 0)).alias("open"))
        tree = staged(tree.where("not open").unionByName(grown), "paths")
        level += 1
    per_host = tree.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    every = tree.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    base = (every["b"] or 0) / every["l"] if every["l"] else 0.0
    per = tree.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb")).join(per_host, "host")
    host_purity = (F.col("hb") + prior * base) / (F.col("hl") + prior)
    own, n, zz = F.col("tb") / F.col("tl"), F.col("tl"), DIFFERS**2
    floor = F.when(n > 0, (own + zz / (2 * n) - DIFFERS * F.sqrt(own * (1 - own) / n + zz / (4 * n * n))) / (1 + zz / n)).otherwise(0.0)
    per = per.select("host", "template", ((F.col("tb") + prior * host_purity) / (n + prior)).alias("purity"), floor.alias("floor"), F.lit(base).alias("base"))
    return tree.select("host", "segments", "template").join(per, ["host", "template"])


def judge(urls: DataFrame, labels: DataFrame | None = None, *, rules=RULES, odds: float = ODDS, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """One row per url: id, host, path, rule, verdict, template, purity.

    ``labels`` (id, bad) marks some of the urls by ``label_of``, by default the number that ends a
    path.  Rules go before templates.  A null url has an empty host and path, and is judged as that
    host's only template.  Without labels every purity is 0.  Repeated rows are judged alike.
    """
    host, path = parts(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    if labels is not None:
        known = labels.select(F.col("id").alias("__of"), "bad").where("__of is not null and bad is not null").groupBy("__of").agg(F.max("bad").alias("bad"))
        ends = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)([.][A-Za-z0-9]{1,5})?/?$', 1), '') as bigint)")
        marked = rows.withColumn("__of", ends).join(known, "__of", "left").select("host", "path", "bad")
    else:
        marked = rows.select("host", "path", F.lit(None).cast("int").alias("bad"))
    found = staged(templates(marked, **how), "templates")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("segments", generalised(F.col("path"))).join(found, ["host", "segments"], "left")
    worse = F.col("purity") * (1 - F.col("base")) >= odds * F.col("base") * (1 - F.col("purity"))
    own = F.when(worse & (F.col("floor") > F.col("base")), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("__id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels)


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL: dict[str, str] = {}
