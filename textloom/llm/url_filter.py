r"""URL filters by a path-template tree.

Per host, the paths form a tree. Variable parts of a segment become wildcards at once: runs of digits, hexadecimal ids (eight characters
or more, a digit among them) and slugs (four words or more joined by - or _). Then, level by level from the root, statistically similar
sibling branches are merged: sorted by their labelled rates of blocked pages, two neighbours stay together while a two-proportion z test
can't tell their rates apart, and what stays together becomes one wildcard branch (`*1`, `*2`, ... in the order of the rates). Branches
with the same rate are one neighbour, so the sort is over rates and not over branches. Branches without labelled pages never join labelled
ones, as nothing says that they are alike; the rare ones among them share a wildcard branch `~`. They aren't split further: without labels
nothing is to be decided there. So the tree is as deep as the labelled paths are. Each leaf is a template of its host. Its purity is
(blocked + strength * prior) / (labelled + strength), the prior being the rate over all labelled pages; a template with enough labelled
pages and a purity of `reject` or more is blocked. The labels are the verdicts of the rules. A page that a rule fits has the rule's
verdict, any other its template's.

Plan. Pages are counted by (host, generalised path) first, with map-side partial sums, so a hot host shrinks to its distinct paths
before any shuffle. Every level is a few aggregations and joins of such counts, written before the next level reads it, so the plan
doesn't grow with the depth. Only the last join meets pages again: on (host, generalised path), with the pages on the side that adaptive
execution can split.

Defined cases. A null url, or one without `://`, has an empty host and path, no rule and verdict allow. Repeated rows each get their
row. The input's other columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.storage import dropped, written

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Z, STRENGTH, LEAST, REJECT, RARE = 1.96, 4.0, 3, 0.75, 32
#: Variable parts of a segment, as patterns that both engines read alike; what they match becomes *.
HEXADECIMAL, SLUG, DIGITS = r"^(?:[0-9a-fA-F]{8}[0-9a-fA-F-]*)$", r"^[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+){3,}", "[0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; ties go to the first in alphabetical order."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def general_path(path: Column) -> Column:
    """The path's segments, with * for variable parts."""
    general = lambda x: F.regexp_replace(F.when(x.rlike(HEXADECIMAL) & x.rlike(DIGITS), F.lit("*")).otherwise(F.regexp_replace(x, SLUG, "*")), DIGITS, "*")
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), general)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, where the keys are equal."""
    named = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(named, [F.col(k) == F.col(f"__{k}") for k in keys], how).drop(*[f"__{k}" for k in keys])


def branches(children: DataFrame, z: float, rare: int) -> DataFrame:
    """From (host, above, segment, n, c, b), a row a branch: host, above, segment and branch, the name of what it becomes. above: the template of the nodes above."""
    parent = ["host", "above"]
    # labelled branches with the same rate are one; neighbours by rate stay together while the test can't tell them apart
    by_rate = children.where("c > 0").withColumn("rate", F.col("b") / F.col("c")).groupBy(*parent, "rate").agg(F.sum("c").alias("rc"), F.sum("b").alias("rb"), F.count("*").alias("members"))
    order = Window.partitionBy(*parent).orderBy("rate")
    before = by_rate.select("*", F.lag("rate").over(order).alias("r0"), F.lag("rc").over(order).alias("c0"), F.lag("rb").over(order).alias("b0"))
    both = (F.col("rb") + F.col("b0")) / (F.col("rc") + F.col("c0"))
    apart = F.col("r0").isNotNull() & (F.col("rate") - F.col("r0") > z * F.sqrt(both * (1 - both) * (1 / F.col("rc") + 1 / F.col("c0"))))
    grouped = before.withColumn("apart", apart.cast("int")).withColumn("kin", 1 + F.sum("apart").over(order))
    kin = grouped.select(*parent, "rate", "kin", F.sum("members").over(Window.partitionBy(*parent, "kin")).alias("members"))
    labelled = matched(children.where("c > 0").withColumn("rate", F.col("b") / F.col("c")), kin, [*parent, "rate"])
    named = labelled.select(*parent, "segment", F.when(F.col("members") == 1, F.col("segment")).otherwise(F.concat(F.lit("*"), F.col("kin").cast("string"))).alias("branch"))
    blank = children.where("c = 0").select(*parent, "segment", "n")
    of_blank = blank.groupBy(*parent).agg(F.sum("n").alias("all_n"))
    rest = matched(blank, of_blank, parent).select(*parent, "segment", F.when(F.col("n") * rare < F.col("all_n"), F.lit("~")).otherwise(F.col("segment")).alias("branch"))
    return named.unionByName(rest)


def templates(pages: DataFrame, z: float = Z, rare: int = RARE) -> DataFrame:
    """From pages with host, segments and verdict (null: no label): for each (host, segments) its template in the merged tree, n pages, c labelled and b blocked."""
    counted = pages.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("verdict").alias("c"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    # above: the template so far; open: whether it has labelled pages and the path goes on
    tree, level = written(counted.withColumn("above", F.lit("")).withColumn("open", F.size("segments") > 0), "tree"), 0
    while not tree.where("open").isEmpty():
        at = tree.where("open").withColumn("segment", F.get("segments", F.lit(level)))
        children = at.groupBy("host", "above", "segment").agg(*[F.sum(x).alias(x) for x in ("n", "c", "b")])
        children = written(children, "branches")
        named = branches(children, z, rare)
        named = matched(named, children.select("host", "above", "segment", F.col("c").alias("of_branch")), ["host", "above", "segment"])
        deeper = matched(at, named, ["host", "above", "segment"]).select(
            "host", "segments", "n", "c", "b", F.concat_ws("/", "above", "branch").alias("above"), ((F.col("of_branch") > 0) & (F.size("segments") > level + 1)).alias("open")
        )
        grown = written(tree.where("not open").select(*deeper.columns).unionByName(deeper), "tree")
        dropped(tree, children)
        tree, level = grown, level + 1
    return tree.select("host", "segments", F.when(F.col("above") == "", F.lit("/")).otherwise(F.col("above")).alias("template"), "n", "c", "b")


def judge(pages: DataFrame, rules=RULES, z: float = Z, strength: float = STRENGTH, least: int = LEAST, reject: float = REJECT, rare: int = RARE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity."""
    cut = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r])
    ruled = cut.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", F.try_element_at(verdicts, F.col("rule"))).withColumn("segments", general_path(F.col("path")))
    tree = templates(ruled, z, rare)
    leaves = tree.groupBy("host", "template").agg(F.sum("c").alias("labelled"), F.sum("b").alias("blocked"))
    prior = tree.agg((F.sum("b") / F.nullif(F.sum("c"), F.lit(0))).alias("prior"))
    judged = leaves.crossJoin(F.broadcast(prior)).withColumn("purity", (F.col("blocked") + strength * F.coalesce("prior", F.lit(0.5))) / (F.col("labelled") + strength))
    by_path = matched(tree.select("host", "segments", "template"), judged, ["host", "template"]).select("host", "segments", "template", "purity", ((F.col("labelled") >= least) & (F.col("purity") >= reject)).alias("bad"))
    verdict = F.coalesce("verdict", F.when(F.col("bad") & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow")))
    # joined on a hash besides: both sides are dealt anew, so that adaptive execution can split a hot path's pages
    dealt = lambda d: d.withColumn("h", F.xxhash64("host", "segments"))
    return matched(dealt(ruled), dealt(by_path), ["h", "host", "segments"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).withColumn("purity", F.round("purity", 9))


def _sql(levels: int = 8) -> str:
    """The tree for labelled paths of up to `levels` segments, a few tables a level."""
    case = " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    )
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    general = f"CASE WHEN regexp_matches(x, '{HEXADECIMAL}') AND regexp_matches(x, '{DIGITS}') THEN '*' ELSE regexp_replace(regexp_replace(x, '{SLUG}', '*'), '{DIGITS}', '*', 'g') END"
    out = [
        rf"u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages)",
        f"r AS (SELECT *, CASE {case} END AS rule, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda x: {general}) AS s FROM u)",
        f"v AS (SELECT *, CASE rule {verdict} END AS verdict FROM r)",
        "x0 AS (SELECT host, s, count(*) AS n, count(verdict) AS c, count(*) FILTER (verdict = 'block') AS b, '' AS t, len(s) > 0 AS o FROM v GROUP BY host, s)",
    ]
    for i in range(levels):
        out += [
            f"k{i} AS (SELECT host, t, s[{i + 1}] AS g, sum(n) AS n, sum(c) AS c, sum(b) AS b FROM x{i} WHERE o GROUP BY ALL)",
            f"q{i} AS (SELECT host, t, b / c AS rate, sum(c) AS rc, sum(b) AS rb, count(*) AS m FROM k{i} WHERE c > 0 GROUP BY ALL)",
            f"w{i} AS (SELECT *, lag(rate) OVER w AS r0, lag(rc) OVER w AS c0, lag(rb) OVER w AS b0 FROM q{i} WINDOW w AS (PARTITION BY host, t ORDER BY rate))",
            f"y{i} AS (SELECT *, CASE WHEN r0 IS NOT NULL AND rate - r0 > {Z} * sqrt((rb + b0) / (rc + c0) * (1 - (rb + b0) / (rc + c0)) * (1 / rc + 1 / c0)) THEN 1 ELSE 0 END AS apart FROM w{i})",
            f"z{i} AS (SELECT *, 1 + sum(apart) OVER (PARTITION BY host, t ORDER BY rate) AS kin FROM y{i})",
            f"m{i} AS (SELECT *, sum(m) OVER (PARTITION BY host, t, kin) AS members FROM z{i})",
            f"""b{i} AS (SELECT k.host, k.t, k.g, k.c, CASE WHEN members = 1 THEN k.g ELSE '*' || kin::BIGINT END AS e FROM k{i} k JOIN m{i} m ON k.host = m.host AND k.t = m.t AND k.b / k.c = m.rate WHERE k.c > 0
              UNION ALL SELECT host, t, g, c, CASE WHEN n * {RARE} < sum(n) OVER (PARTITION BY host, t) THEN '~' ELSE g END FROM k{i} WHERE c = 0)""",
            f"""x{i + 1} AS (SELECT host, s, n, c, b, t, o FROM x{i} WHERE NOT o UNION ALL
              SELECT x.host, x.s, x.n, x.c, x.b, x.t || '/' || e, b.c > 0 AND len(x.s) > {i + 1} FROM x{i} x JOIN b{i} b ON x.host = b.host AND x.t = b.t AND x.s[{i + 1}] = b.g WHERE x.o)""",
        ]
    out += [f"p AS (SELECT *, sum(c) OVER w AS labelled, (sum(b) OVER w + {STRENGTH} * coalesce((SELECT sum(b) / nullif(sum(c), 0) FROM x0), 0.5)) / (sum(c) OVER w + {STRENGTH}) AS purity FROM x{levels} WINDOW w AS (PARTITION BY host, t))"]
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT page_id, v.host, path, rule, coalesce(verdict, CASE WHEN labelled >= {LEAST} AND purity >= {REJECT} AND v.host <> '' THEN 'block' ELSE 'allow' END) AS verdict, "
        "CASE WHEN t = '' THEN '/' ELSE t END AS template, round(purity::DOUBLE, 9) AS purity FROM v LEFT JOIN p ON v.host = p.host AND v.s = p.s"
    )


OP6_SQL = _sql()
