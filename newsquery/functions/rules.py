"""Rule-based labels: category and sentiment by word lists, noise and topic gates, validity of links and authors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import contains_any

# Words of each category, in the order in which categories are tried. They are found inside words too.
CATEGORY_WORDS = {
    "Business": "sensex nifty rupee bse nse stock fund rbi market trade cepa bank investor shares company profit quarter economy".split(),
    "Politics": "bjp congress parliament monsoon govt centre pm modi minister election poll padayatra party court bill".split(),
    "Technology": "spacex ai tech cyber software google apple app digital".split(),
    "Sports": "cricket match cup team olympic sport game stadium".split(),
    "Crime": "police extradition choksi arrest crime fraud scam jail cbi ed".split(),
    "World": "china canada us hamas trump russia ukraine israel gaza global world".split(),
}
# Words of either sentiment; positive ones are tried first.
POSITIVE_WORDS = "gains rises surge up record growth deal success boost strong positive buying".split()
NEGATIVE_WORDS = "fall drops crash loss fraud arrest attack kill doubt warning ban crime probe delay".split()
# Titles that begin so are no news.
NOISE_TITLES = ("Quote of the Day", "Horoscope", "Proverb of the Day", "Numerology")
# Lifestyle and celebrity words.
NOISE_WORDS = ("quote of the day", "proverb of the day", "horoscope", "zodiac", "numerology", "astrology", "tarot", "bollywood", "celebrity", "gossip", "ipl", "movie", "film", "actor", "actress", "dolby", "trekking", "hiker", "emi guide", "archives", "review")
# The words one of which a headline must hold for a topic.
TOPIC_GATES = {
    "economy": "economy economic gdp rbi budget fiscal tax trade market finance business growth revenue bank industry export import investment commercial manufacturing".split(),
    "tech": "ai tech software computing data cloud digital semiconductor chip cyber code".split(),
    "defense": ["defense", "security", "military", "army", "navy", "air force", "border", "missile", "weapon", "drdo"],
}
# Words that ask for one of the gates, in the order in which they are tried.
GATE_WORDS = {"economy": ("economy", "economic"), "tech": ("ai", "tech"), "defense": ("defense", "security")}
# Parts of links that are not articles.
SKIP_LINKS = "photo photos video videos liveblog live-blog webstory webstories topic static section education-static telugu bangla hindi urdu podcast".split()
# Texts of login pages and paywalls; three of them reject a page.
PAYWALL_TEXTS = (
    "login", "log in", "sign in", "sign up", "signup", "register", "register now", "create account", "already have an account", "new user",
    "welcome back", "forgot password", "show password", "enter password", "mobile number", "email address", "otp", "verify otp",
    "continue with google", "continue with facebook", "continue with apple", "google", "facebook", "apple",
    "subscribe", "subscription", "premium", "premium article", "premium content", "member benefits", "member only", "unlock this article", "continue reading",
    "access denied", "cookie policy", "accept cookies",
)
# What stands in author fields without being a name.
NO_AUTHORS = ("", "author", "authors", "staff", "staff reporter", "agency", "editor", "admin", "news desk", "updated", "hour ago", "hours ago", "minute ago", "minutes ago", "day ago", "days ago")
# What shows that an author field was read from a login form.
BAD_AUTHORS = ("login", "sign in", "show password", "forgot password", "google", "facebook", "apple", "otp", "register", "subscribe")


def infer_category(text: Column, existing: Column | None = None, default: str = "General") -> Column:
    """The first category one of whose words occurs; an existing label other than General wins."""
    low = F.lower(text)
    by_rule = reduce(lambda w, kv: w.when(contains_any(low, kv[1]), kv[0]), CATEGORY_WORDS.items(), F.when(F.lit(False), F.lit(default))).otherwise(F.lit(default))
    return by_rule if existing is None else F.when(existing.isNotNull() & ~existing.isin("", "General"), existing).otherwise(by_rule)


def infer_sentiment(text: Column, existing: Column | None = None) -> Column:
    """Positive words before negative ones, else Neutral; an existing label other than Neutral wins."""
    low = F.lower(text)
    by_rule = F.when(contains_any(low, POSITIVE_WORDS), "Positive").when(contains_any(low, NEGATIVE_WORDS), "Negative").otherwise("Neutral")
    return by_rule if existing is None else F.when(existing.isNotNull() & ~existing.isin("", "Neutral"), existing).otherwise(by_rule)


def no_noise_title(title: Column) -> Column:
    return ~F.coalesce(F.lower(title).rlike("^(" + "|".join(t.lower() for t in NOISE_TITLES) + ")"), F.lit(False))


def is_noise(*texts: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(contains_any(F.lower(t), NOISE_WORDS), F.lit(False)) for t in texts))


def topic_gate(topic: str, text: Column) -> Column:
    """Whether a text belongs to a topic: by the word list that the topic asks for, else by any of its words."""
    q, low = topic.lower(), F.lower(text)
    for gate, words in GATE_WORDS.items():
        if any(w in q for w in words):
            return contains_any(low, TOPIC_GATES[gate])
    words = [w for w in q.split() if len(w) > 1]
    return contains_any(low, words) if words else F.lit(True)


def article_link(link: Column) -> Column:
    return ~contains_any(F.lower(link), SKIP_LINKS)


def valid_url(url: Column) -> Column:
    """http or https, with a host, and more than a homepage."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(url.rlike("^https?://") & host.isNotNull() & (F.rtrim(path, F.lit("/")) != ""), F.lit(False))


def paywalled(content: Column) -> Column:
    """Shorter than 300 characters, or three texts of a login page or paywall in it."""
    low = F.lower(content)
    hits = sum((F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in PAYWALL_TEXTS), F.lit(0))
    return (F.length(content) < 300) | (hits >= 3)


def valid_sitemap(url: Column, year: int, years: int = 3) -> Column:
    """No unwanted part, and one of the last years in the address."""
    return article_link(url) & url.rlike("|".join(str(y) for y in range(year - years, year + 1)))


def normalize_authors(authors: Column) -> Column:
    """Trimmed names without what is no name, each once in order; Unknown for none."""
    names = F.array_distinct(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a.isNotNull() & ~F.lower(a).isin(*NO_AUTHORS)))
    return F.when(names.isNull() | (F.size(names) == 0), F.array(F.lit("Unknown"))).otherwise(names)


def valid_authors(authors: Column) -> Column:
    return ~contains_any(F.lower(F.array_join(authors, " ")), BAD_AUTHORS)
