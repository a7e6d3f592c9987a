"""Crawl-link operators: link extraction, filtering, frontier and reachability."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

FOLD_ROUNDS = 16      # rounds of a walk read as a union before they are written as one table


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "area"):
            self.hrefs += [v for k, v in attrs if k == "href" and v is not None]


def page_hrefs(pages: DataFrame, url: str = "url", html: str = "html", page_key: str = "page_id") -> DataFrame:
    """``(page_key, url, href)`` of every ``a`` and ``area`` element, entities decoded.

    Links of other elements, and text that looks like one in comments, scripts or styles, are not
    followed. Pages without HTML give no rows.
    """
    @F.pandas_udf("array<string>")
    def hrefs(s: pd.Series) -> pd.Series:
        def one(text):
            p = _Anchors()
            p.feed(text or "")
            p.close()
            return p.hrefs
        return s.map(one)
    # an empty or null page never leaves the JVM; the generator reads the parsed column, so it parses once
    d = pages.where(F.length(html) > 0).select(page_key, url, hrefs(F.col(html)).alias("_hrefs"))
    return d.select(page_key, url, F.explode("_hrefs").alias("href"))


def extract_links(pages: DataFrame, prefix: Column | None = None, url: str = "url", html: str = "html",
                  page_key: str = "page_id") -> DataFrame:
    """Unique links of a page's anchors, resolved, that stay under ``prefix`` (default: the page's own host;
    a crawl passes ``host/site``).

    The prefix must be followed by ``/``, ``?``, ``#`` or the end, so ``/ys`` does not admit ``/ys2``.
    """
    hrefs = page_hrefs(pages, url, html, page_key)
    links = hrefs.select(page_key, U.resolve(F.col(url), F.col("href")).alias("link"),
                         (prefix if prefix is not None else U.url_origin(F.col(url))).alias("_prefix"))
    p = F.col("_prefix")
    rest = F.substring(F.col("link"), F.length(p) + 1, 1 << 30)
    ok = F.col("link").startswith(p) & ((rest == "") | rest.rlike(r"^[/?#]"))
    return links.where(ok).select(page_key, "link").distinct()


def drop_static(links: DataFrame, link: str = "link") -> DataFrame:
    """Drop links whose path ends in ``.`` plus 1-8 letters (static files)."""
    return links.where(~U.is_static(F.col(link)))


def drop_namespaces(links: DataFrame, site: Column, link: str = "link") -> DataFrame:
    """Drop links whose decoded site path starts with an ignored namespace."""
    sep = F.concat(F.lit("\\Q"), site, F.lit("/\\E"))  # literal "<site>/" as a Java pattern
    sp = F.try_element_at(F.split(U.unquote(U.url_path(F.col(link))), sep, -1), F.lit(2))
    return links.where(~F.coalesce(U.starts_with_ignored(sp), F.lit(False)))


def drop_ignored(items: DataFrame, save_to: str = "save_to") -> DataFrame:
    """Writer filter: drop items whose save key contains an ignored namespace anywhere."""
    return items.where(~U.contains_ignored(F.col(save_to)))


def frontier(links: DataFrame, seen: DataFrame, link: str = "link", seen_col: str = "url") -> DataFrame:
    """U4: links not yet processed (anti join on the URL)."""
    return links.join(seen.select(F.col(seen_col).alias(link)).distinct(), on=link, how="left_anti")


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, src: str = "src",
              dst: str = "dst", node: str = "node") -> DataFrame:
    """Nodes reachable from ``seeds`` with their minimum depth; ``max_depth`` limits the hops if given.

    Breadth-first over the edge table: each round is one join of the frontier with the
    edges plus an anti join against everything visited, and ends when the frontier is empty. Only the
    round's new nodes are checkpointed to the shared folder; the rounds so far are read as a union and
    folded into one table every ``FOLD_ROUNDS`` rounds, which keeps the plan short. The driver loop
    sees no data. Null ends of edges and null seeds are no nodes.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(edges.sparkSession)
    e = (edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"))
         .where(F.col("_s").isNotNull() & F.col("_d").isNotNull()).distinct().checkpoint())
    front = seeds.select(F.col(node)).dropna().distinct().withColumn("depth", F.lit(0)).checkpoint()
    rounds, depth = [front], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        visited = reduce(DataFrame.unionByName, rounds)
        nxt = (front.join(e, front[node] == e["_s"]).select(F.col("_d").alias(node)).distinct()
               .join(visited.select(node), on=node, how="left_anti")
               .withColumn("depth", F.lit(depth)).checkpoint())
        if nxt.isEmpty():
            break
        rounds.append(nxt)
        if len(rounds) >= FOLD_ROUNDS:
            rounds = [reduce(DataFrame.unionByName, rounds).checkpoint()]
        front = nxt
    return reduce(DataFrame.unionByName, rounds)


def seed_urls(samples: DataFrame, host: str, site: str = "site", title: str = "title",
              mode: str = "sampled") -> DataFrame:
    """Start URLs: one per sample page, or the site home page."""
    base = F.concat(F.lit(host.rstrip("/")), F.lit("/"), F.col(site), F.lit("/"))
    if mode == "sampled":
        return samples.select(site, F.concat(base, F.col(title)).alias("url")).distinct()
    return samples.select(site).distinct().select(site, F.concat(base, F.lit(U.HOME_PAGE)).alias("url"))
