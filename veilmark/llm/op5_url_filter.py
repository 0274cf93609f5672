"""URL filtering: fixed rules first, then templates of each host's paths judged by smoothed labelled purity.

Urls that a rule decides are the labelled ones. A segment stands below the shapes of the segments before it; its siblings
are all segments of its host that stand below the same shapes. Segments of few urls are variable. Siblings of one shape, below
which urls mostly go on alike, are compared: those whose continuations and labels are like the others' merge into a wildcard,
one that goes on or leans otherwise keeps its segment, and so does one of a form of its own. The sequence of a path's tokens
is its template. Shapes are known from the url alone, so all levels of the tree are worked on at once, however deep it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, settle, stored, table

#: (verdict, host, path); fixed values of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_ROWS, Z, PRIOR_ROWS, PURITY = 5, 2.0, 5, 0.8
#: Half the sum of differences of two profiles that counts as alike, besides what chance allows.
ALIKE = 0.25
#: Shapes of a segment, the first that fits: its pattern. The last is that of all others.
SHAPES = ["", r"[0-9]+", r".*\.[^.]*", r".*[0-9].*", r".*[-_].*"]
_N_SHAPES = len(SHAPES) + 1
#: Ways to go on after a segment: not at all, or with 1, 2, or more segments, the next of some shape.
DEPTHS = 3
CELLS = 1 + DEPTHS * _N_SHAPES
#: Parts of a host's or template's paths, so that a hot one is spread over tasks.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, on, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(prefix)
        rule, verdict = F.when(fits, on + prefix).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _spread(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", by: str = "path") -> DataFrame:
    """The join of rows with a table of one row for each key, the rows of a key being dealt over SALTS parts by ``by``."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def _angle(n: Column, block: Column, allow: Column) -> Column:
    """The lean of urls, the blocked share with unlabelled ones as one half, on a scale of even spread (0 to pi)."""
    return 2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (block + (n - block - allow) / 2) / n))))


def shape_of(segment: Column) -> Column:
    """The number of the first of SHAPES that the whole segment fits."""
    shape = F.lit(len(SHAPES))
    for number, pattern in reversed(list(enumerate(SHAPES))):
        shape = F.when(segment.rlike(f"(?s)^(?:{pattern})\\z"), number).otherwise(shape)
    return shape


def _segments(paths: DataFrame) -> DataFrame:
    """(path_id, at, place, segment, shape, way, n, block, allow): a row for each segment of each path.

    ``place`` is a hash of the host and the shapes before the segment, ``way`` the number of how the path goes on after it.
    """
    shaped = paths.withColumn("shapes", F.transform("segments", shape_of))
    none = F.array().cast("array<bigint>")
    shaped = shaped.withColumn("places", running(F.col("shapes"), F.xxhash64("host"), none, lambda at, s: F.xxhash64(at, s), lambda at, s: at))

    def way(i: Column) -> Column:
        rest = F.size("shapes") - i - 1
        return F.when(rest <= 0, 0).otherwise(1 + (F.least(rest, F.lit(DEPTHS)) - 1) * _N_SHAPES + F.get("shapes", i + 1))

    one = F.transform("segments", lambda s, i: F.struct(F.get("places", i).alias("place"), s.alias("segment"), F.get("shapes", i).alias("shape"), way(i).alias("way")))
    return shaped.select("path_id", "n", "block", "allow", F.posexplode(one).alias("at", "s")).select("path_id", "at", "s.*", "n", "block", "allow")


def literals(segments: DataFrame) -> DataFrame:
    """(place, segment) of the segments that keep their text.

    Siblings are grouped by shape and by the way in which most of their urls go on (the first of several). A segment of
    MIN_ROWS urls, with siblings at all, keeps its text if it is alone in its group, if its profile of ways differs from that
    of the others by more than ALIKE and Z half standard errors, or if its urls lean differently by Z standard errors.
    Sums are combined before each shuffle; what is joined are the segments of MIN_ROWS urls and one row for each group.
    """
    counts = ("n", "block", "allow")
    sums = [F.sum(c).alias(c) for c in counts]
    cells = [F.sum(F.when(F.col("way") == i, F.col("n")).otherwise(0)) for i in range(CELLS)]
    branch = segments.groupBy("place", "segment", "shape").agg(*sums, F.array(*cells).alias("profile"))
    branch = settle(branch.withColumn("mostly", F.array_position("profile", F.array_max("profile")).cast("int")))
    group = ["place", "shape", "mostly"]
    pool = branch.groupBy(*group).agg(*[F.sum(c).alias(f"all_{c}") for c in counts], F.array(*[F.sum(F.get("profile", F.lit(i))) for i in range(CELLS)]).alias("whole"))
    place = branch.groupBy("place").agg(F.sum("n").alias("at_place"))
    big = branch.where(F.col("n") >= MIN_ROWS)
    big = _spread(_spread(big, pool, group, by="segment"), place, ["place"], by="segment")
    n, m = F.col("n"), F.col("all_n") - F.col("n")
    apart = F.aggregate(F.zip_with("profile", "whole", lambda p, w: F.abs(p / n - (w - p) / m)), F.lit(0.0), lambda total, x: total + x) / 2
    lean = _angle(n, F.col("block"), F.col("allow")) - _angle(m, F.col("all_block") - F.col("block"), F.col("all_allow") - F.col("allow"))
    unlike = (apart > ALIKE + Z / 2 * F.sqrt(1 / n + 1 / m)) | (F.abs(lean) * F.sqrt(n * m / (n + m)) >= Z)
    return big.where((F.col("at_place") > n) & F.when(m == 0, True).otherwise(unlike)).select("place", "segment")


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, n, block, allow) of every distinct (host, path); ``urls`` has host, path and verdict (null: unlabelled).

    A fixed number of jobs, whatever the depth of the paths. A row for each segment of a path is shuffled by place, with the
    paths of a hot place dealt over SALTS parts, and by path; nothing but a path's own segments comes together in a task.
    """
    counts = [F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == "allow").alias("allow")]
    paths = urls.groupBy("host", "path").agg(*counts)
    paths = paths.withColumn("path_id", F.md5(F.concat(F.length("host").cast("string"), F.lit(":"), F.col("host"), F.col("path"))))
    paths = settle(paths.withColumn("segments", F.split(F.ltrim(F.col("path"), F.lit("/")), "/", -1)))
    segments = settle(_segments(paths))
    kept = stored(literals(segments).withColumn("kept", F.lit(True)))
    tokens = _spread(segments.select("path_id", "at", "place", "segment"), kept, ["place", "segment"], "left", by="path_id")
    tokens = tokens.select("path_id", "at", F.when(F.col("kept"), F.concat(F.lit("/"), F.col("segment"))).otherwise("/*").alias("token"))
    whole = tokens.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda t: t["token"]), "").alias("template"))
    return settle(paths.drop("segments").join(whole, "path_id").drop("path_id"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: a row for each input row (page_id, url).

    Null urls and urls without ``://`` have an empty host and path and are judged as such. A template is rejected if the
    blocked share of its labelled urls, with PRIOR_ROWS more counted as one half, reaches PURITY; without labels nothing is.
    Ties between rules of equal length go to the later one in the list. Repeated rows each keep their row and count as urls
    each. Time is linear in the length of a url, also in its number of segments; other columns are ignored; an empty table gives
    an empty result.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("said", said)
    paths = templates(parsed.select("host", "path", F.col("said").alias("verdict")))
    sums = paths.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "block", "allow")])
    judged = sums.select("host", "template", ((F.col("block") + PRIOR_ROWS / 2) / (F.col("block") + F.col("allow") + PRIOR_ROWS)).alias("purity"))
    found = _spread(paths.select("host", "path", "template"), judged, ["host", "template"])
    method = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return parsed.join(found, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", "purity")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"))
