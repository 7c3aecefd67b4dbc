"""URL filters with redirect equivalence: block decisions reach the aliases of a url.

1. A url is judged by rules (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
2. An address is a url without scheme and fragment, its host in lower case. Redirect and canonical-link edges join the address of
   a page with those that its html names: ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh content="n; url=...">``, relative ones resolved
   against the page (steps upwards by ".." are taken as written). More edges, as from a crawler's log, can be given as a table.
3. Components of this graph are equivalent addresses. A page that no rule decides is blocked if any address of its component is
   blocked by a rule; what a rule allows stays allowed wherever it stands (explicit allow has precedence), though it connects
   what lies behind it.

All of it is DataFrame functions; no Python runs in tasks. Only addresses with an edge enter the graph. Components are found by
labels: each address takes the least label of its neighbours, then its label's label, until none changes, so that rounds grow with the
logarithm of long chains. Labels combine before the shuffle, so an address with very many aliases is one row a task; joins on it are split by Spark where they are skewed.
Each round is a table in the shared folder, deleted once the next one stands.

Null urls and urls without "://" have an empty host and path, fit no rule, stand in no graph and are allowed. Null or empty html has no
edges. Equal urls are one address and have one verdict; rows with equal ids are judged each by its own url. Very long html is searched whole. An
empty table gives an empty one. Other columns pass through; those that bear the name of an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columnar as C

#: verdict, host and path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

LINK, META = r"(?i)<link\b[^>]*>", r"(?i)<meta\b[^>]*>"
CANONICAL, REFRESH = r"""(?i)\brel\s*=\s*["']?canonical["'\s/>]""", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh["'\s/>]"""
HREF, TO = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", r"""(?i)\burl\s*=\s*["']?([^"'>]+)"""


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` and ``path``, as the rules see them."""
    rest = F.regexp_extract("_url", r"(?s)^.*?://(.*)$", 1)
    split = df.withColumn("_url", F.coalesce(F.col(f"`{url}`"), F.lit(""))).withColumn("_rest", rest)
    host = lower_az(F.regexp_extract("_rest", r"^[^/?#]*", 0))
    return split.withColumn("host", host).withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)).drop("_url", "_rest")


def decided(rules: list[tuple[str, str, str]]) -> Column:
    """The rule that wins, as struct(rule, verdict): null where none fits. Of rules of one length the first in the list wins."""
    fit = lambda h, p: ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        out = F.when(fit(host, path), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """Without scheme and fragment, host in lower case; null without "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^#]*)", 1)
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    out = F.concat(lower_az(host), F.when(F.length(rest) == F.length(host), "/").otherwise(""), F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1))
    return F.when(host != "", out)


def html_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a``, ``b``: addresses of pages, and those that their html names as canonical or redirects to."""
    tags = lambda tag, kind, what: F.filter(F.transform(F.filter(F.regexp_extract_all("_html", F.lit(tag), F.lit(0)), lambda t: t.rlike(kind)), what), lambda u: u != "")
    href = lambda t: F.concat(F.regexp_extract(t, HREF, 1), F.regexp_extract(t, HREF, 2), F.regexp_extract(t, HREF, 3))
    named = F.concat(tags(LINK, CANONICAL, href), tags(META, REFRESH, lambda t: F.regexp_extract(t, TO, 1)))
    at = pages.select(F.col(f"`{url}`").alias("_url"), F.col(f"`{html}`").alias("_html")).where(F.col("_html").rlike(CANONICAL) | F.col("_html").rlike(REFRESH))
    found = at.select("_url", F.explode(named).alias("_to")).withColumn("_to", F.trim(F.replace("_to", F.lit("&amp;"), F.lit("&"))))
    scheme, host = F.regexp_extract("_url", r"(?s)^(.*?):", 1), F.regexp_extract("_url", r"(?s)^.*?://[^/?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract("_url", r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/"))
    whole = (
        F.when(F.col("_to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("_to"))
        .when(F.col("_to").startswith("//"), F.concat(scheme, F.lit(":"), "_to"))
        .when(F.col("_to").startswith("/"), F.concat(host, "_to"))
        .when(F.col("_to").rlike("^[?#]"), F.concat(F.regexp_extract("_url", r"(?s)^.*?://[^?#]*", 0), "_to"))
        .otherwise(F.concat(host, folder, "_to"))
    )
    return found.select(address(F.col("_url")).alias("a"), address(whole).alias("b"))


def components(edges: DataFrame, scratch: C.Scratch) -> DataFrame:
    """``node``, ``component`` (the least address reachable) of all ends of the edges ``a``, ``b``."""
    edge = scratch.write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.write(edge.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("c"), F.lit(True).alias("moved")), "labels")
    while not label.where("moved").isEmpty():
        was = label.select("a", "c")
        told = edge.join(was.withColumnRenamed("a", "b"), "b").select("a", "c").unionByName(was).groupBy("a").agg(F.min("c").alias("c"))
        # a label is an address too, and may know a smaller one
        further = told.join(was.select(F.col("a").alias("c"), F.col("c").alias("cc")), "c", "left").select("a", F.least("c", "cc").alias("n"))
        new = scratch.write(further.join(was, "a").select("a", F.col("n").alias("c"), (F.col("n") != F.col("c")).alias("moved")), "labels")
        scratch.drop(label)
        label = new
    scratch.drop(edge)
    return label.select(F.col("a").alias("node"), F.col("c").alias("component"))


ADDED = ["host", "path", "rule", "verdict"]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (allow or block).

    html: the column that is searched for edges (None: no search). redirects: urls ``src`` and ``dst`` of further edges.
    """
    rules, scratch = RULES if rules is None else rules, C.Scratch(pages.sparkSession, "urls")
    outer = [c for c in pages.columns if c.lower() not in ADDED]
    keep = [f"in{i}" for i in range(len(outer))]
    source = F.col(f"`{url}`").cast("string").alias("_u")
    own = parts(pages.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(outer, keep)], source), "_u").withColumn("_d", decided(rules)).withColumn("_at", address(F.col("_u")))

    edges = html_edges(pages, url, html) if html else None
    if redirects is not None:
        more = redirects.select(address(F.col("src")).alias("a"), address(F.col("dst")).alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    none = own.withColumn("_blocked", F.lit(False))
    if edges is not None:
        edges = scratch.write(edges.where("a is not null and b is not null and a != b").distinct(), "found")
        if not edges.isEmpty():
            nodes = components(edges, scratch)
            # every address is judged by the rules, whether a page of it is in the table or not
            judged = parts(nodes.withColumn("_u", F.concat(F.lit("http://"), "node")), "_u").withColumn("_d", decided(rules))
            bad = judged.where("_d.verdict = 'block'").select("component").distinct()
            aliases = scratch.write(nodes.join(bad, "component").select(F.col("node").alias("_at"), F.lit(True).alias("_alias")), "aliases")
            none = own.join(aliases, "_at", "left").withColumn("_blocked", F.coalesce("_alias", F.lit(False))).drop("_alias")
    verdict = F.coalesce("_d.verdict", F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return none.select(*[F.col(k).alias(c) for c, k in zip(outer, keep)], "host", "path", F.col("_d.rule").alias("rule"), verdict.alias("verdict"))


def brute_force(rows: list[tuple[str | None, str | None]], rules: list[tuple[str, str, str]] | None = None, redirects: list[tuple[str, str]] = ()) -> list[tuple[str, str, str | None, str]]:
    """host, path, rule and verdict of each (url, html). For tests."""
    import re
    from urllib.parse import urljoin

    rules = RULES if rules is None else rules

    def cut(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def at(u):
        m = re.match(r"(?s).*?://([^/?#]+)([^#]*)", u or "")
        return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) + (m[2] or "/") if m else None

    def rule(host, path):
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: len(r[1]) + len(r[2]), default=None)

    edges = [(at(a), at(b)) for a, b in redirects]
    for u, h in rows:
        for tag in re.findall(r"(?i)<link\b[^>]*>", h or ""):
            if re.search(CANONICAL, tag) and (m := re.search(HREF, tag)):
                edges.append((at(u), at(urljoin(u or "", (m[1] or m[2] or m[3] or "").replace("&amp;", "&").strip()))))
        for tag in re.findall(r"(?i)<meta\b[^>]*>", h or ""):
            if re.search(REFRESH, tag) and (m := re.search(TO, tag)):
                edges.append((at(u), at(urljoin(u or "", m[1].replace("&amp;", "&").strip()))))
    near: dict = {}
    for a, b in edges:
        if a and b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    blocked, todo = set(), [n for n in near if (r := rule(*cut("http://" + n))) and r[0] == "block"]
    while todo:
        n = todo.pop()
        if n not in blocked:
            blocked.add(n)
            todo += near[n]
    out = []
    for u, _ in rows:
        host, path = cut(u)
        r = rule(host, path)
        out.append((host, path, r and r[1] + r[2], r[0] if r else "block" if at(u) in blocked else "allow"))
    return out
