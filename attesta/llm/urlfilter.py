"""URL filters over a path-template tree.

Rules label urls. Per host a tree of path segments is built level by level: a segment with a digit becomes a shape
(``#`` for each run of digits); siblings whose labelled block rate cannot be told from that of all siblings
together are merged into ``*``, the others keep a branch of their own. A branch whose labels are all alike, or that has none, cannot be
told apart further: it ends there as ``/**``, if any of its paths goes on; all others are followed to the end of their longest path,
however deep. A template (host and path of the tree) is rejected if its labelled block rate, smoothed towards one half, reaches
``purity``. A url gets the verdict of its longest rule, else that of its template, so a template without labels is allowed.

Nulls: a url that is null or has no ``://`` has empty host and path. Repeated rows keep one row each. Empty tables give no
rows. Other columns of any name are ignored. The tree is built from counts of distinct (host, segments), not from urls: hot hosts are
aggregated before the shuffle; the way back joins on host and segments by broadcast up to ``BROADCAST_BYTES``, else by shuffle,
where adaptive execution splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: (verdict, host, path); a rule's name is its host and path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Size of the map from (host, segments) to templates up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
#: Weight of the one-half prior, purity from which a template is rejected, and the squared z value from which siblings differ.
SMOOTHING, PURITY, Z2 = 4, 0.8, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    best = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def segments(path: Column) -> Column:
    """All segments of a path, digits generalised; none for a path without a slash."""
    return F.slice(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), 2, 2**31 - 1)


def templates(urls: DataFrame, smoothing: int = SMOOTHING, z2: float = Z2) -> DataFrame:
    """For rows (host, seg, verdict) the map of (host, seg) to its template, with the template's n_labelled, n_block and purity."""
    node = urls.groupBy("host", "seg").agg(F.count("verdict").alias("n"), F.count_if(F.col("verdict") == "block").alias("b"))
    # one row per host and shape of path: small beside the urls, and read once per level
    open_, done, i = cut(node.withColumn("template", F.col("host"))), None, 0
    while open_.limit(1).count():
        every = open_.groupBy("template").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.max(F.size("seg")).alias("deep"))
        child = open_.withColumn("part", F.coalesce(F.get("seg", F.lit(i)), F.lit(""))).groupBy("template", "part").agg(F.sum("n").alias("c_n"), F.sum("b").alias("c_b"))
        rate = (F.col("all_b") + smoothing * 0.5) / (F.col("all_n") + smoothing)
        off = F.col("c_b") - F.col("c_n") * rate
        apart = (F.col("c_n") > 0) & (off * off >= z2 * (F.col("c_n") * rate * (1 - rate)))
        alike = (F.col("all_b") == 0) | (F.col("all_b") == F.col("all_n"))
        child = child.join(every, "template").select("template", "part", apart.alias("apart"), alike.alias("alike"), "deep")
        at = open_.withColumn("part", F.coalesce(F.get("seg", F.lit(i)), F.lit(""))).join(child, ["template", "part"])
        ended = F.size("seg") <= i
        name = F.when(F.col("alike"), F.when(F.col("deep") > i, "/**").otherwise("")).when(ended, "").when(F.col("apart"), F.concat(F.lit("/"), "part")).otherwise("/*")
        at = cut(at.select("host", "seg", "n", "b", F.concat("template", name).alias("template"), (F.col("alike") | ended).alias("final")))
        part = at.where("final").drop("final")
        done = part if done is None else done.unionByName(part)
        open_, i = cut(at.where("not final").drop("final")), i + 1
    done = open_ if done is None else done
    pure = done.groupBy("template").agg(F.sum("n").alias("n_labelled"), F.sum("b").alias("n_block"))
    pure = pure.withColumn("purity", (F.col("n_block") + smoothing * 0.5) / (F.col("n_labelled") + smoothing))
    return done.select("host", "seg", "template").join(pure, "template")


def judge(pages: DataFrame, rules=RULES, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, n_labelled and purity of each row of ``pages``."""
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("seg", segments(F.col("path")))
    urls = urls.withColumn("verdict", F.col("hit.verdict"))
    tree = cut(templates(urls))
    size = tree.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("template") + F.octet_length(F.array_join("seg", "/")) + 64), F.lit(0))).first()[0]
    out = urls.join(F.broadcast(tree) if size <= BROADCAST_BYTES else tree, ["host", "seg"])
    own = F.when(F.col("purity") >= purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("verdict", own).alias("verdict"), "template", "n_labelled", "purity")


def op4_path_templates(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH RECURSIVE u0 AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u1 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u0),
u2 AS (SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM u1),
rules(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, host, path, (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM u2),
s AS (SELECT u.*, rules.v AS verdict, string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/')[2:] AS seg FROM u LEFT JOIN rules ON rule = h || p),
t AS (
  SELECT host, seg, n, b, host AS template, 0 AS i, false AS final FROM (SELECT host, seg, count(verdict) AS n, count(*) FILTER (verdict = 'block') AS b FROM s GROUP BY ALL)
  UNION ALL
  SELECT host, seg, n, b,
         template || CASE WHEN alike THEN CASE WHEN deep > i THEN '/**' ELSE '' END WHEN len(seg) <= i THEN ''
                          WHEN c_n > 0 AND (c_b - c_n * rate) * (c_b - c_n * rate) >= 4.0::DOUBLE * (c_n * rate * (1 - rate)) THEN '/' || seg[i + 1] ELSE '/*' END,
         i + 1, alike OR len(seg) <= i
  FROM (SELECT *, (all_b + 2.0::DOUBLE) / (all_n + 4) AS rate, all_b = 0 OR all_b = all_n AS alike
        FROM (SELECT *, sum(n) OVER (PARTITION BY template) AS all_n, sum(b) OVER (PARTITION BY template) AS all_b, max(len(seg)) OVER (PARTITION BY template) AS deep,
                     sum(n) OVER (PARTITION BY template, coalesce(seg[i + 1], '')) AS c_n, sum(b) OVER (PARTITION BY template, coalesce(seg[i + 1], '')) AS c_b
              FROM t WHERE NOT final))),
d AS (SELECT * FROM t WHERE final),
p AS (SELECT template, CAST(sum(n) AS BIGINT) AS n_labelled, (sum(b) + 2.0::DOUBLE) / (sum(n) + 4) AS purity FROM d GROUP BY 1)
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.verdict, CASE WHEN p.purity >= 0.8::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       d.template, p.n_labelled, p.purity
FROM s JOIN d ON s.host = d.host AND s.seg = d.seg JOIN p ON d.template = p.template
"""
