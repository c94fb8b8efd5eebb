"""URL filters with redirect equivalence, in DataFrame functions alone.

Rules judge a URL by its host and path. URLs that redirect to each other or name each other as canonical are one
equivalence class, found as a connected component; a URL without a rule of its own takes the decision of its class:
allow if any member has an allow rule, else block if any has a block rule, else allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import kept, scratch, settle


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; pattern: host, then a path from its first slash on."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: Rules are compiled into the plan; a longer list belongs in a table that is joined.
MOST_RULES = 1000
RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


def fold(x: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, folded; path: from there up to ? # or the end. Both are
    empty where url is null or has no ://."""
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substr(url, F.instr(url, F.lit("://")) + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return fold(host), path


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest pattern that fits host (or a domain above it) and the start of path; null if none does. Of equal
    length, the later in alphabetical order."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules can be compiled")
    out = F.lit(None).cast("string")
    for r in sorted(set(rules), key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.pattern)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    allowed = [r.pattern for r in rules if r.verdict == "allow"]
    return F.when(rule.isNotNull(), F.when(rule.isin(allowed), F.lit("allow")).otherwise(F.lit("block")))


#: Named characters in targets; the ampersand is decoded last.
_ENTITIES = (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"), ("amp", "&"))


def decoded(x: Column) -> Column:
    """Character references by number (decimal and hexadecimal, up to 10FFFF) and the names of `_ENTITIES`, each once."""
    pieces = F.regexp_extract_all(x, F.lit(r"(?is)(&#x0*[0-9a-f]{1,6};|&#0*[0-9]{1,7};|&(?:quot|apos|lt|gt|nbsp|amp);|&|[^&]+)"), F.lit(1))

    def one(p: Column) -> Column:
        code = F.when(p.rlike("(?i)^&#x"), F.conv(F.regexp_extract(p, r"(?i)^&#x0*([0-9a-f]+);", 1), 16, 10)).when(p.rlike("^&#"), F.regexp_extract(p, r"^&#0*([0-9]+);", 1)).cast("int")
        out = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, c in _ENTITIES:
            out = out.when(F.lower(p) == f"&{name};", F.lit(c))
        return out.otherwise(p)

    return F.when(F.instr(x, F.lit("&")) > 0, F.array_join(F.transform(pieces, one), "")).otherwise(x)


def without_dots(path: Column) -> Column:
    """path (from its first slash) without the segments . and .. , as RFC 3986 5.2.4 has it."""
    parts = F.slice(F.split(path, "/"), 2, 1_000_000_000)
    last = F.element_at(parts, -1)
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))))
    joined = F.concat(F.lit("/"), F.array_join(up, "/"))
    return F.when(last.isin(".", "..") & (F.size(up) > 0), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolved(base: Column, target: Column) -> Column:
    """The absolute URL that target names on the page base (RFC 3986, 5.2); null where base or target is no such URL."""
    scheme = F.substring_index(base, "://", 1)
    host = F.regexp_extract(base, r"(?s)^[^:]*://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^[^:]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    directory = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (F.when(~base.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target))
            .when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(root, without_dots(own), rest))
            .when(own != "", F.concat(root, without_dots(F.concat(directory, own)), rest))
            .when(F.startswith(target, F.lit("?")), F.concat(root, path, rest))
            .otherwise(F.concat(root, path, query)))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page's url and every URL that its html names as canonical or that it refreshes to, quoted or not,
    entities decoded, resolved against the page's url, both without fragment."""
    html, url = F.col("html"), F.col("url")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), F.lit(1))
    # A cheap test first: most pages have neither tag.
    some = pages.where(html.rlike(r"(?i)canonical|http-equiv\s*=\s*[\"']?refresh"))
    found = some.select("url", F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)

    def step(rows: DataFrame, x: Column) -> DataFrame:
        """A generator: the next step's many uses of x do not each repeat it, nor do filters pushed down."""
        return rows.select("url", F.explode(F.array(x)).alias("target"))

    named = step(found, F.when(F.col("tag").rlike(r"(?i)^<link"), href).otherwise(refresh)).where("target != ''")
    whole = step(step(named, decoded(F.col("target"))), resolved(url, F.col("target")))
    ends = whole.select(node(url).alias("a"), node(F.col("target")).alias("b"))
    return ends.where("a is not null and b is not null and a != b")


def node(url: Column) -> Column:
    """What stands for a URL among aliases: without fragment, scheme and host folded. Null without ://."""
    at = F.instr(url, F.lit("://"))
    host = F.regexp_extract(F.substr(url, at + 3), r"(?s)^([^/?#]*)", 1)
    rest = F.regexp_replace(F.substr(url, at + 3 + F.length(host)), r"(?s)#.*", "")
    return F.when(at > 0, F.concat(fold(F.substring_index(url, "://", 1)), F.lit("://"), fold(host), rest))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row a row of pages (page_id, url, html): page_id, host, path, rule, verdict, by_alias.

    redirects: further edges (a, b) of URLs, as a crawl logs them. A null or malformed url has no rule and no alias
    and is allowed; a null html has no links. Urls and html of any length are read whole; an empty table gives no rows. Repeated rows are judged alike; other columns are ignored. by_alias: the
    verdict is that of the url's class. The classes are found on the edges alone, and only their members are joined.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).where("a is not null and b is not null and a != b"))
    own = own.withColumn("own", verdict_of(F.col("rule"), rules))
    with scratch(pages.sparkSession):
        edges = settle(edges.distinct(), "aliases")
        if edges.isEmpty():
            return own.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(False).alias("by_alias"))
        return kept(_by_class(own, edges, rules), "verdicts")


def _by_class(own: DataFrame, edges: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    roots = settle(connected_components(edges), "classes")
    h, p = host_and_path(F.col("node"))
    decided = roots.withColumn("v", verdict_of(rule_for(h, p, rules), rules)).groupBy("root").agg(F.max(F.expr("v = 'allow'")).alias("allowed"), F.max(F.expr("v = 'block'")).alias("blocked"))
    decided = roots.join(decided, "root").select(F.col("node").alias("at"), F.expr("case when allowed then 'allow' when blocked then 'block' end").alias("theirs"))
    met = own.withColumn("at", node(F.col("url"))).join(decided, "at", "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("own", "theirs", F.lit("allow")).alias("verdict"), (F.col("own").isNull() & F.col("theirs").isNotNull()).alias("by_alias"))
