"""Ordered categorisation rules: the built-in set, the rules file, and the classifier."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, contains_nocase, glob_match
from ..functions.urls import rules_host, rules_path

UNCATEGORIZED = "Uncategorized"

#: The built-in categories with colour, domain patterns and title keywords, in the order in which they are tried.
BUILT_IN = (
    ("Social Media", "#E74C3C",
     "facebook.com *.facebook.com twitter.com *.twitter.com x.com instagram.com *.instagram.com reddit.com *.reddit.com "
     "linkedin.com *.linkedin.com tiktok.com *.tiktok.com pinterest.com *.pinterest.com tumblr.com snapchat.com "
     "discord.com *.discord.com mastodon.social threads.net",
     "social feed timeline"),
    ("News", "#3498DB",
     "cnn.com *.cnn.com bbc.co.uk *.bbc.co.uk bbc.com reuters.com apnews.com nytimes.com washingtonpost.com theguardian.com "
     "aljazeera.com news.google.com news.ycombinator.com arstechnica.com techcrunch.com theverge.com wired.com bloomberg.com cnbc.com",
     "breaking headline report"),
    ("Shopping", "#F39C12",
     "amazon.* ebay.com ebay.* aliexpress.com walmart.com target.com bestbuy.com etsy.com shopify.com wish.com newegg.com wayfair.com ikea.com",
     "cart checkout order payment buy shop"),
    ("Development", "#2ECC71",
     "github.com *.github.com gitlab.com *.gitlab.com stackoverflow.com *.stackoverflow.com developer.mozilla.org docs.rs crates.io "
     "npmjs.com pypi.org pkg.go.dev bitbucket.org codeberg.org sr.ht docs.python.org docs.oracle.com learn.microsoft.com dev.to medium.com hashnode.dev",
     "documentation api reference tutorial sdk"),
    ("Streaming", "#9B59B6",
     "youtube.com *.youtube.com netflix.com *.netflix.com twitch.tv *.twitch.tv hulu.com disneyplus.com hbomax.com max.com primevideo.com "
     "crunchyroll.com spotify.com *.spotify.com soundcloud.com vimeo.com dailymotion.com peacocktv.com",
     "watch stream episode playlist"),
    ("Search", "#1ABC9C",
     "google.com www.google.com bing.com www.bing.com duckduckgo.com search.yahoo.com ecosia.org startpage.com brave.com/search yandex.com",
     ""),
    ("Email", "#34495E",
     "mail.google.com outlook.live.com outlook.office.com mail.yahoo.com proton.me protonmail.com mail.zoho.com fastmail.com tutanota.com",
     ""),
)


@dataclass(frozen=True)
class Rule:
    """A domain pattern, with a glob over the path where ``pattern`` is given."""

    domain: str
    pattern: str | None = None

    @property
    def kind(self) -> str:
        if self.pattern is not None:
            return "PATH_GLOB"
        return "DOMAIN_WILDCARD" if self.domain[:1] == "*" else "DOMAIN_SUFFIX" if self.domain[-1:] == "*" else "DOMAIN_EXACT"


@dataclass
class Category:
    name: str
    color: str = ""
    rules: list[Rule] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)


def built_in() -> list[Category]:
    return [Category(n, c, [Rule(d) for d in domains.split()], keywords.split()) for n, c, domains, keywords in BUILT_IN]


def load_rules(text: str, categories: list[Category] | None = None) -> list[Category]:
    """The categories after reading a rules file: sections extend a category of that name or add one.

    Lines: [Name], domains = a, b; keywords = a, b; color = #rrggbb; paths[domain] = glob.
    """
    out = [Category(c.name, c.color, list(c.rules), list(c.keywords)) for c in (built_in() if categories is None else categories)]
    current: Category | None = None
    for line in re.split(r"\r\n|\r|\n", text):
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if line[0] == "[":
            if "]" in line:
                name = line[1 : line.index("]")].strip()
                current = next((c for c in out if c.name.lower() == name.lower()), None)
                if current is None:
                    out.append(current := Category(name))
            continue
        if current is None or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        items = [x.strip() for x in value.split(",") if x.strip()]
        if key.lower() == "domains":
            current.rules += [Rule(d) for d in items]
        elif key.lower() == "keywords":
            current.keywords += items
        elif key.lower() == "color":
            current.color = value
        elif key.lower().startswith("paths[") and "]" in key:
            current.rules.append(Rule(key[6 : key.index("]")], value))
    return out


def domain_match(pattern: str, domain: Column) -> Column:
    """Whether a domain (in lower case) is the pattern, is below it, or fits *.x or x.*."""
    p = pattern.lower()
    out = (domain == p) | domain.endswith("." + p)
    if p.startswith("*.") and len(p) >= 2:
        out = out | domain.endswith(p[1:]) | (domain == p[2:])
    if p.endswith(".*") and len(p) >= 2:
        out = out | (domain.startswith(p[:-1]) & (F.length(domain) > len(p) - 1))
    return out


def _domain_test(rules: list[Rule], host: Column, path: Column) -> Column:
    """Whether any rule fits; patterns without a glob become one regular expression."""
    forms = []
    out = F.lit(False)
    for rule in rules:
        p = rule.domain.lower()
        if rule.pattern is not None:
            out = out | (domain_match(rule.domain, host) & (path != "") & glob_match(path, rule.pattern))
        elif p.startswith("*.") or p.endswith(".*"):
            forms += [rf"(?:.*\.)?{_quoted(p)}"]
            if p.startswith("*."):
                forms.append(rf"(?:.*\.)?{_quoted(p[2:])}")
            if p.endswith(".*"):
                forms.append(rf"{_quoted(p[:-1])}.+")
        else:
            forms.append(rf"(?:.*\.)?{_quoted(p)}")
    if forms:
        out = host.rlike(rf"(?s)^(?:{'|'.join(dict.fromkeys(forms))})\z") | out
    return out


def _quoted(text: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", text)


def categorize(history: DataFrame, categories: list[Category] | None = None) -> DataFrame:
    """``history`` with category_idx (-1: none), category and confidence.

    The first category with a rule that fits the host wins (90); if none does, the first one
    with a keyword in the title (50). The rules become one expression per category, so the
    classifier is a projection: no join, no shuffle. Rows without a host stay uncategorised.
    """
    categories = built_in() if categories is None else categories
    host, path, title = F.col("_host"), F.col("_path"), F.coalesce(F.col("title"), F.lit(""))
    by_rule, by_word = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(categories))):
        by_rule = F.when(_domain_test(c.rules, host, path), i).otherwise(by_rule)
        words = F.lit(False)
        for word in c.keywords:
            words = words | contains_nocase(title, word)
        by_word = F.when(words, i).otherwise(by_word)
    df = history.withColumns({"_host": rules_host(F.col("url")), "_path": rules_path(F.col("url"))})
    df = df.withColumns({"_rule": F.when(host != "", by_rule), "_word": F.when((host != "") & (title != ""), by_word)})
    index = F.coalesce("_rule", "_word", F.lit(-1))
    names = F.array(*(F.lit(c.name) for c in categories))
    return df.withColumns(
        {
            "category_idx": index,
            "category": F.when(index >= 0, F.get(names, index)).otherwise(UNCATEGORIZED),
            "confidence": F.when(F.col("_rule").isNotNull(), 90).when(F.col("_word").isNotNull(), 50).otherwise(0),
        }
    ).drop("_host", "_path", "_rule", "_word")


def category_stats(categorized: DataFrame, categories: list[Category] | None = None) -> DataFrame:
    """Per category, empty ones included: URLs, visits, and the host of its most visited URL."""
    categories = built_in() if categories is None else categories
    spark: SparkSession = categorized.sparkSession
    order = F.struct("visit_count", -F.col("pos"))
    found = categorized.groupBy("category_idx").agg(
        F.count("*").alias("n"), F.sum("visit_count").alias("v"), F.when(F.max("visit_count") > 0, F.max_by(rules_host(F.col("url")), order)).alias("top")
    )
    names = [(i, c.name) for i, c in enumerate(categories)] + [(-1, UNCATEGORIZED)]
    every = spark.createDataFrame(names, "category_idx int, category string")
    return every.join(F.broadcast(found), "category_idx", "left").select(
        "category_idx", "category", F.coalesce("n", F.lit(0)).cast("long").alias("url_count"), F.coalesce("v", F.lit(0)).cast("long").alias("total_visits"), F.coalesce("top", F.lit("")).alias("top_domain")
    )


def rules_table(spark: SparkSession, categories: list[Category] | None = None) -> DataFrame:
    categories = built_in() if categories is None else categories
    rows = [(i, c.name, c.color, k, r.kind, r.domain, r.pattern, False) for i, c in enumerate(categories) for k, r in enumerate(c.rules)]
    return spark.createDataFrame(rows, "cat_idx int, cat_name string, color string, rule_idx int, type string, domain string, pattern string, negate boolean")


def keywords_table(spark: SparkSession, categories: list[Category] | None = None) -> DataFrame:
    categories = built_in() if categories is None else categories
    return spark.createDataFrame([(i, k, w) for i, c in enumerate(categories) for k, w in enumerate(c.keywords)], "cat_idx int, kw_idx int, keyword string")


#: The second scheme. Substrings of the URL, in the order in which they are tried.
SUBSTRING_RULES = (
    ("Development",
     "github.com gitlab.com stackoverflow.com stackexchange.com developer. docs.python npmjs.com pypi.org crates.io dev.to localhost 127.0.0.1 "
     "codepen.io jsfiddle.net replit.com vercel.com netlify.com heroku.com docker.com aws.amazon.com cloud.google.com azure.microsoft.com"),
    ("Social Media",
     "twitter.com x.com facebook.com instagram.com linkedin.com reddit.com tiktok.com snapchat.com discord.com telegram.org whatsapp.com threads.net"),
    ("Entertainment",
     "youtube.com netflix.com twitch.tv spotify.com soundcloud.com vimeo.com disneyplus.com hulu.com primevideo.com crunchyroll.com"),
    ("Productivity",
     "notion.so trello.com asana.com monday.com slack.com zoom.us meet.google.com teams.microsoft.com docs.google.com drive.google.com office.com calendar.google.com"),
    ("Education",
     ".edu coursera.org udemy.com edx.org khanacademy.org wikipedia.org medium.com arxiv.org scholar.google w3schools.com freecodecamp.org geeksforgeeks.org"),
    ("Shopping", "amazon.com ebay.com aliexpress.com etsy.com shopify.com walmart.com jumia. kilimall.co.ke"),
    ("News", "bbc.com cnn.com reuters.com nytimes.com theguardian.com aljazeera.com nation.africa standardmedia.co.ke"),
    ("Email", "mail.google.com outlook. mail.yahoo.com protonmail.com"),
    ("Finance", "paypal.com mpesa safaricom.co.ke equity kcbgroup banking coinbase.com binance.com"),
    ("Search", "google.com/search bing.com/search duckduckgo.com search.brave.com"),
    ("AI Tools", "chat.openai.com chatgpt.com claude.ai gemini.google.com bard.google.com perplexity.ai copilot.microsoft.com huggingface.co"),
)

#: Title words of the second scheme, and the colours of its categories.
TITLE_WORDS = (("Education", "tutorial Tutorial course Course learn Learn"), ("Development", "API documentation Documentation"))
SUBSTRING_COLORS = {
    "Development": "0.2 0.6 1.0", "Social Media": "0.9 0.3 0.5", "Entertainment": "1.0 0.5 0.2", "Productivity": "0.2 0.8 0.4",
    "Education": "0.5 0.3 0.9", "Shopping": "0.9 0.7 0.2", "News": "0.4 0.4 0.4", "Email": "0.3 0.7 0.8", "Finance": "0.1 0.7 0.3",
    "Search": "0.6 0.6 0.6", "AI Tools": "0.7 0.3 1.0", "Other": "0.5 0.5 0.5",
}


def classify_substrings(history: DataFrame) -> DataFrame:
    """``history`` with category and category_idx of the second scheme; the case of letters counts."""
    url, title = F.col("url"), F.coalesce(F.col("title"), F.lit(""))
    names = list(SUBSTRING_COLORS)
    out = F.lit("Other")
    for name, words in reversed(TITLE_WORDS):
        out = F.when(title.rlike("|".join(words.split())), name).otherwise(out)
    for name, parts in reversed(SUBSTRING_RULES):
        out = F.when(url.rlike("|".join(map(_quoted, parts.split()))), name).otherwise(out)
    out = F.when(url.isNull(), F.lit("Other")).otherwise(out)
    df = history.withColumn("category", out)
    return df.withColumn("category_idx", (F.array_position(F.array(*map(F.lit, names)), F.col("category")) - 1).cast("int"))


def substring_stats(classified: DataFrame) -> DataFrame:
    """Per category of the second scheme: rows, visits, and its most visited page (first of equals)."""
    order = F.struct("visit_count", -F.col("pos"))
    top = F.when(F.max("visit_count") > 0, F.max_by(F.struct("url", "title"), order))
    return classified.groupBy("category").agg(F.count("*").alias("url_count"), F.sum("visit_count").alias("total_visits"), top["url"].alias("top_url"), top["title"].alias("top_title"))


def lower(c: Column) -> Column:
    return ascii_lower(c)
