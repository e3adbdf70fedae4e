"""Boilerplate lines by their frequency within a site.

Pages are grouped by host.  For each line the number of the host's pages that
contain it, divided by the host's page total, is its ratio; lines beyond
``ratio`` on more than one page are dropped wherever the host shows them.  Every
page counts, copies too.  A line of a single page is no boilerplate, whatever the
ratio: on a host of nine pages or fewer each line would be beyond 0.1.

Lines travel as 64-bit hashes.  Pages of a host with the same set of lines are
first counted as one set with their number, which is then added up on both sides
of the ratio, so neither a common page or line nor a large host gathers in one
task.
A host has at most (mean lines of its pages) / ``ratio`` boilerplate lines:
every one of them takes up that share of its pages.  These short lists are
written, and join the pages on the host; Spark broadcasts them where their
measured size allows, and else splits the large hosts of a sort-merge join.

Defined cases: blank lines are never dropped nor counted; a row with a null
host keeps every line; a null text stays null and has no lines; rows that are
alike are treated alike; further columns stay (``drop_lines``); an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import pick, written

RATIO = 0.1
_BLANKS = " \t\n\x0b\x0c\r"
_UNSEEN = r"(?is)<script.*?</script\s*>|<style.*?</style\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|aside|main|nav|header|footer|title|head|body|html|blockquote|pre|form|hr)(\s[^>]*)?/?>"
_TAG = r"<[^>]*>"
#: Character references in the order in which they are resolved.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Text of a page, block elements apart by line breaks."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _UNSEEN, " "), _BLOCK, "\n"), _TAG, "")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def url_host(url: Column) -> Column:
    """Host in lower case; null if the address has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    return F.when(host != "", host)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def boilerplate(hosts: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``host`` and ``dropped``, the hashes of its boilerplate lines, from rows of ``host`` and ``text``."""
    hashes = F.transform(F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != ""), lambda x: F.xxhash64(x))
    # filtered once written: a filter on the text would compute it a second time
    pages = hosts.select("host", F.array_sort(F.array_distinct(hashes)).alias("lines"))
    sets = written(pages.groupBy("host", "lines").agg(F.count(F.lit(1)).alias("pages")), "line-sets").where("host IS NOT NULL AND lines IS NOT NULL")
    total = sets.groupBy("host").agg(F.sum("pages").alias("total"))
    lines = sets.select("host", F.explode("lines").alias("line"), "pages").groupBy("host", "line").agg(F.sum("pages").alias("n"))
    often = lines.where("n > 1").join(total, "host").where(F.col("n") > F.col("total") * F.lit(ratio))
    return written(often.groupBy("host").agg(F.collect_list("line").alias("dropped")), "boilerplate")


def drop_lines(df: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, counts: bool = False) -> DataFrame:
    """``df`` without the boilerplate lines of its ``text``; with ``counts`` also n_lines and n_dropped.

    ``host`` is an expression over ``df``.  All columns stay, in their order.
    """
    names = df.columns
    plain = df.withColumn("\x01host", host).toDF(*(f"c{i}" for i in range(len(names))), "host")
    at = names.index(text)
    often = boilerplate(plain.select("host", F.col(f"c{at}").alias("text")), ratio)
    both = plain.join(often, "host", "left").withColumn("lines", F.split(f"c{at}", "\n"))
    gone = lambda x: F.array_contains(F.col("dropped"), F.xxhash64(_bare(x)))  # noqa: E731  blank lines are in no list
    both = both.withColumn("left_over", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~gone(x))))
    out = [F.col(f"c{i}").alias(n) if i != at else F.array_join("left_over", "\n").alias(n) for i, n in enumerate(names)]
    if counts:
        seen = lambda a: F.coalesce(F.size(F.filter(a, lambda x: _bare(x) != "")), F.lit(0)).cast("long")
        out += [F.when(F.col("lines").isNull(), 0).otherwise(seen("lines")).cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("left_over")).cast("long").alias("n_dropped")]
    return both.select(*out)


def dedup_pages(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """page_id, host, text without boilerplate lines, n_lines, n_dropped of raw web pages."""
    p = pick(pages, "page_id", "url", "html").select("page_id", url_host(F.col("url")).alias("host"), html_text(F.col("html")).alias("text"))
    return drop_lines(p, F.col("host"), ratio=ratio, counts=True)
