"""URL filtering: stated host and path rules first, then association rules mined from labelled URLs.

FP-growth finds the sets of URL tokens that occur together with a verdict among the labelled pages; where one has too many
tokens for every set of them, only sets that can decide are grown. Rules pruned by support, confidence and lift are kept, single tokens all judged. An inverted index lists each rule under its rarest token, so a URL meets
only the rules that hold one of its tokens, and takes the verdict of the most confident of those whose tokens it
has all.

DataFrame operations and Spark's own FP-growth only. URLs with the same tokens are matched once, and the pages of an
often repeated URL are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopewise.llm.common import spread_join, stage

#: Stated rules: (verdict, host, path).
STATED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.2
#: Standard errors by which a rule's confidence must be over its verdict's share.
ERRORS = 4.0
#: Frequent tokens of a URL up to which FP-growth mines rules of several tokens, as it makes every set of them; sets of more are grown.
ITEMS = 10
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and for URLs without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def stated_rule(host: Column, path: Column, rules=STATED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and starts the path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        rule, verdict = F.when(fits, F.lit(at + below)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Scheme, host and its upper domains, path segments by depth, file ending and query keys; numbers are one token."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host:"), F.call_function("substring_index", host, F.lit("."), -k)))
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), s))
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&"), lambda s: s != "")
    query = F.transform(query, lambda s: F.concat(F.lit("query:"), F.regexp_replace(F.substring_index(s, "=", 1), r"[0-9]+", "#")))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_sort(F.array_distinct(F.concat(scheme, F.when(host == "", none).otherwise(domains), segments, query))))


def token_stats(labelled: DataFrame, min_support: float) -> DataFrame:
    """labelled(row, tokens, verdict) -> (token, n, bad) of frequent tokens: rows that hold it, those to block. Of tokens that occur in the same rows always, the first stands for all."""
    rows = labelled.select("row", (F.col("verdict") == "block").cast("long").alias("bad"), F.explode("tokens").alias("token"))
    # rows are distinct; sums of two hashes tell sets of rows apart (an XOR forgets what comes twice)
    rows_of = [F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(name) for k, name in enumerate(("rows", "again"))]
    stats = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), *rows_of)
    total = labelled.count()
    return stats.where(F.col("n") >= min_support * total).groupBy("n", "bad", "rows", "again").agg(F.min("token").alias("token")).select("token", "n", "bad")


def baskets(labelled: DataFrame, stats: DataFrame, items: int) -> DataFrame:
    """labelled(row, tokens, verdict) -> (verdict, items): of each row's tokens the most telling ones, at most ``items``.

    A token tells the more, the further its rows' verdicts are from the average, in standard errors; ties go by name.
    This bounds the sets that one often repeated URL of many tokens makes to 2**items. Rows without a frequent token
    have no items.
    """
    total, bad = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    telling = F.abs(F.col("bad") / F.col("n") - F.lit(bad / max(total, 1))) * F.sqrt("n")
    ranked = stats.select("token", F.struct((-telling).alias("order"), "token").alias("ranked"))
    each = labelled.select("row", "verdict", F.explode("tokens").alias("token")).join(ranked, "token")
    chosen = each.groupBy("row", "verdict").agg(F.array_sort(F.collect_set("ranked")).alias("ranked"))
    return chosen.select("verdict", F.transform(F.slice("ranked", 1, items), lambda x: x["token"]).alias("items"))


def grown_sets(labelled: DataFrame, stats: DataFrame, least: float) -> DataFrame | None:
    """labelled(row, tokens, verdict) -> (tokens, n, bad) of the sets of two and more tokens that can decide, however many tokens a row has.

    Sets grow by a token over the rows that hold them, as long as each token takes rows away (a set that holds as many
    rows as one of its parts says what the part says) and its rows differ in verdict (else what grows from it is less
    supported and no surer); ``least`` rows must be of one verdict. None if there are no such sets.
    """
    each = labelled.select("row", "verdict", F.explode("tokens").alias("token")).join(stats.select("token"), "token")
    rows = each.groupBy("row", "verdict").agg(F.array_sort(F.collect_set("token")).alias("held"))
    rows = rows.groupBy("held").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("bad"))
    known = stats.where("bad > 0 AND bad < n").select(F.array("token").alias("tokens"), F.col("n").alias("part_n"))
    where = rows.select("*", F.explode("held").alias("token")).select("held", "n", "bad", F.array("token").alias("tokens")).join(known.select("tokens"), "tokens", "left_semi")
    found, size = None, 1
    while True:
        size += 1
        more = where.select("held", "n", "bad", "tokens", F.explode(F.filter("held", lambda t: t > F.element_at("tokens", -1))).alias("token"))
        more = more.select("held", "n", "bad", F.concat("tokens", F.array("token")).alias("tokens"))
        sets = more.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.greatest(F.col("bad"), F.col("n") - F.col("bad")) >= least)
        parts = sets.select(F.col("tokens").alias("whole"), "n", "bad", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("tokens")).join(known, "tokens")
        sets = parts.groupBy(F.col("whole").alias("tokens"), "n", "bad").agg(F.count("*").alias("parts"), F.min("part_n").alias("least")).where((F.col("parts") == size) & (F.col("least") > F.col("n")))
        sets = stage(sets.select("tokens", "n", "bad"), "grown")
        if sets.isEmpty():
            return found
        found = sets if found is None else found.unionByName(sets)
        known = sets.where("bad > 0 AND bad < n").select("tokens", F.col("n").alias("part_n"))
        where = stage(more.join(known.select("tokens"), "tokens", "left_semi").select("held", "n", "bad", "tokens"), "held")


def at_most(labelled: DataFrame, stats: DataFrame, items: int) -> bool:
    """Whether no row has more than ``items`` frequent tokens."""
    each = labelled.select("row", F.explode("tokens").alias("token")).join(stats.select("token"), "token")
    return each.groupBy("row").count().where(F.col("count") > items).isEmpty()


def frequent_sets(rows: DataFrame, min_support: float, least: float) -> DataFrame:
    """(tokens, verdict, n, all) of sets of two and more tokens, by Spark's FP-growth over rows(verdict, items)."""
    rows = rows.select("verdict", F.concat("items", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(rows).freqItemsets
    verdict = F.filter("items", lambda t: t.startswith("verdict="))
    sets = sets.select(F.array_sort(F.filter("items", lambda t: ~t.startswith("verdict="))).alias("tokens"), F.substring_index(F.get(verdict, F.lit(0)), "=", -1).alias("verdict"), F.col("freq").alias("n")).where(F.size("tokens") > 1)
    held = sets.where("verdict IS NULL").select("tokens", F.col("n").alias("all"))
    return sets.where("verdict IS NOT NULL").join(held, "tokens").where(F.col("n") >= least).select("tokens", "verdict", "n", "all")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, errors: float = ERRORS, items: int = ITEMS) -> DataFrame:
    """labelled(row, tokens, verdict), rows distinct -> rules(tokens, verdict, confidence, support), staged.

    Rules of one token are judged for every frequent token. Those of several are FP-growth's where no row has more than
    ``items`` frequent tokens, else grown_sets(), which has no bound on a row's tokens.
    A rule needs min_support of the labelled pages that have tokens. Its confidence must reach min_confidence and
    min_lift times the verdict's share, and its lower bound (Wilson's, ``errors`` standard errors) be over that share,
    so that a small table yields no chance rules.
    """
    labelled = stage(labelled.where(F.size("tokens") > 0), "labelled")
    total, bad = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    if not total:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    stats = stage(token_stats(labelled, min_support), "tokens")
    each = at_most(labelled, stats, items)
    if each:
        several = frequent_sets(baskets(labelled, stats, items), min_support, min_support * total)
    else:
        several = grown_sets(labelled, stats, min_support * total)
    both = F.explode(F.array(F.struct(F.lit("block").alias("verdict"), F.col("bad").alias("n")), F.struct(F.lit("allow").alias("verdict"), (F.col("n") - F.col("bad")).alias("n"))))
    judged = lambda sets: sets.select("tokens", F.col("n").alias("all"), both.alias("_v")).select("tokens", "_v.verdict", "_v.n", "all").where(F.col("n") >= min_support * total)
    single = judged(stats.select(F.array("token").alias("tokens"), "n", "bad"))
    if not each:
        several = judged(several) if several is not None else single.limit(0)
    share = F.when(F.col("verdict") == "block", bad / total).otherwise((total - bad) / total)
    p, n = F.col("n") / F.col("all"), F.col("all")
    low = (p + errors**2 / (2 * n) - errors * F.sqrt(p * (1 - p) / n + errors**2 / (4 * n * n))) / (1 + errors**2 / n)
    rules = single.unionByName(several).where((p >= min_confidence) & (p >= min_lift * share) & (low > share))
    return stage(rules.select("tokens", "verdict", p.alias("confidence"), (F.col("n") / total).alias("support")), "url-rules")


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens(tokens) distinct -> (tokens, mined, confidence) for those that some rule fits, by the best rule."""
    rules = rules.withColumnRenamed("tokens", "needs")
    lists = rules.select(F.explode("needs").alias("token")).groupBy("token").agg(F.count("*").alias("length"))
    rarest = rules.select(F.explode("needs").alias("token"), "needs", "verdict", "confidence", "support").join(lists, "token")
    index = rarest.groupBy("needs", "verdict", "confidence", "support").agg(F.min(F.struct("length", "token"))["token"].alias("token"))
    best = F.max(F.struct("confidence", "support", F.array_join("needs", " ").alias("needs"), "verdict"))
    listed = F.broadcast(index.select("token").distinct())  # frequent tokens: ITEMS / MIN_SUPPORT at most
    return (
        tokens.select("tokens", F.explode("tokens").alias("token"))
        .join(listed, "token", "left_semi")
        .join(index, "token")
        .where(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("tokens")
        .agg(best.alias("best"))
        .select("tokens", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))
    )


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", stated=STATED, **mining) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), confidence (of a mined verdict, else null).

    A page is labelled by the labels row whose doc_id is its id: block if of quality 0 or toxic, else allow; rows
    without either label teach nothing, and rows that repeat id and URL teach once. Null URLs and URLs without ``://`` have empty host and path and are
    allowed. URLs that no stated and no mined rule fits are allowed. Repeated rows get the same verdict each; an
    empty table gives an empty table; other columns of both tables are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    says = labels.select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").when(F.col("quality").isNotNull(), "allow").alias("verdict"))
    # rows that repeat, or share an id, are told apart: each URL of an id is one labelled row
    taught = rows.select("id", "url", "tokens").dropDuplicates(["id", "url"]).join(says.where("verdict is not null").distinct(), "id")
    rules = mine_rules(taught.select(F.xxhash64("id", "url", "verdict").alias("row"), "tokens", "verdict"), **mining)
    counts = rows.groupBy("tokens").agg(F.count("*").alias("n"))
    found = stage(counts.join(match_rules(counts.select("tokens"), rules), "tokens", "left"), "url-verdicts")
    rule, verdict = stated_rule(F.col("host"), F.col("path"), stated)
    return spread_join(rows, found, "tokens", ["id", "url"]).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, "mined", F.lit(DEFAULT)).alias("verdict"), F.when(verdict.isNull(), F.col("confidence")).alias("confidence")
    )
