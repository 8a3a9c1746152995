"""Rules that judge a relationship by the document that it was read from: rewrites, drops and what is worth little.

Relationships come with the document's ``url``, ``title``, ``content`` and ``summary``, and ``subject``, ``subject_type``,
``predicate``, ``object``, ``object_type``, ``claim_mode`` and ``evidence``. Each rule is an expression of columns, so a
table of relationships is judged in one pass, without a shuffle. What only the document tells (``known``) can be made before its
relationships meet it, once for all of them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import bound

#: Words for what people do, which are no organisations.
OCCUPATIONS = (
    "activist", "adviser", "advisor", "analyst", "architect", "artist", "assistant professor", "attorney", "author", "blogger", "broadcaster", "candidate", "ceo",
    "chair", "columnist", "commentator", "consultant", "content creator", "creator", "data journalist", "developer", "director", "economist", "editor", "engineer",
    "executive", "filmmaker", "founder", "fellow", "host", "influencer", "investigator", "journalist", "lawyer", "magazine", "manager", "musician", "photographer",
    "podcaster", "politician", "president", "private citizen", "private investigator", "producer", "professor", "programmer", "publisher", "radio host", "reporter",
    "researcher", "scientist", "software engineer", "spokesperson", "strategist", "teacher", "writer", "youtuber",
)
#: Nouns for media in general, and signs of their making.
MEDIA = (
    "article", "articles", "clip", "clips", "content", "episode", "episodes", "film", "photo", "photos", "podcast", "podcasts", "post", "posts", "segment", "segments",
    "story", "stories", "video", "videos",
)
MEDIA_WITH_ARTICLE = r"(?i)^(a|an|the)\s+(video|clip|post|story|article|podcast|film)\b"
MEDIA_NOUN, MEDIA_VERB = r"(?i)\b(video|videos|clip|clips|post|posts|story|stories|content)\b", r"(?i)\b(claiming|purporting|showing|about|documenting|exposing|featuring)\b"
MEDIA_MAKING = (
    "uploaded a video", "posted videos", "posted a video", "making content", "making her own videos", "making videos", "made a video", "shared a clip",
    "clip of the segment", "posted a clip",
)
#: Phrases by which a text backs a predicate.
FORMAL = {
    "WORKS_FOR": ("works for", "worked for", "employee of", "employed by", "staff at", "columnist for", "reporter at", "editor at", "professor at", "researcher at"),
    "LEADS": ("leads", "head of", "heads", "ceo of", "chief executive", "president of", "chair of", "director of", "executive director", "runs"),
    "MEMBER_OF": ("member of", "board member of", "belongs to", "part of", "serves on", "fellow at"),
    "ADVISES": ("advises", "advisor to", "adviser to", "consults for", "consultant to"),
}
FOUNDED = ("founded", "co-founded", "cofounded", "founded by", "founder of", "launched by")
DEVELOPED = (
    "built by", "build by", "implementation of", "implemented", "implementing", "developed by", "developed", "created by", "authored by", "maintained by", "maintainer",
    "written by", "made by", "port from", "ported from",
)
INSTALLED = (
    "for installation", "can be installed via", "install using", "install with", "install via", "available via", "brew install", "homebrew", "go install", "pip install",
    "npm install", "pnpm add", "cargo install", "apt install",
)
OWNED = ("owns", "owned by", "owner of", "acquired", "purchased", "bought")
#: Signs of an article, of a page around a video without its text, and the size below which that is thin.
ARTICLE_WORDS = (
    "whistleblower", "whistleblowers", "investigation", "investigates", "investigative", "report", "reporting", "lawsuit", "allegation", "allegations", "court", "judge",
)
ARTICLE_TITLES, ARTICLE_HOSTS = (" | ", " - ", ":"), ("nytimes.com", "theguardian.com", "wired.com", "propublica.org")
ARTICLE_TEXTS, SENTENCE_END = ("listen to this article", "reporter commentary"), r"""[.!?]\s+[A-Z"']"""
SHELLS = ("liveupcoming play now", "about press copyright contact us creators advertise developers", "how youtube works", "nfl sunday ticket")
THIN = 2500
NO_USERS = r"(?i)^(data centers?|datacenters?|officers?|users?|systems?)$"


#: Quotes of all kinds that names may have.
QUOTES = "[\"'`’“”]+"


def has(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds any of ``words``; false for null."""
    return F.coalesce(reduce(or_, [F.contains(low, F.lit(w)) for w in words]), F.lit(False))


def holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of ``words``, whatever its case; false for null."""
    return has(F.lower(c), words)


def occupation(name: Column) -> Column:
    plain = lambda n: (n != "") & (F.length(n) <= 80) & ~n.rlike(r"^(the|a|an)\s+") & ~n.rlike(r"[,:;()\[\]{}0-9]") & (F.size(F.split(n, r"\s+")) <= 6)
    return bound(F.lower(T.entity_name(name)), lambda n: plain(n) & reduce(or_, [(n == t) | n.endswith(f" {t}") for t in OCCUPATIONS]))


def generic_media(name: Column) -> Column:
    begins = lambda n: bound(F.lower(n), lambda low: reduce(or_, [(low == t) | low.startswith(f"{t} ") for t in MEDIA]))
    return bound(T.entity_name(name), lambda n: (n != "") & (begins(n) | n.rlike(MEDIA_WITH_ARTICLE) | (n.rlike(MEDIA_NOUN) & n.rlike(MEDIA_VERB))))


def github(url: Column) -> Column:
    return T.host(url) == "github.com"


def video_like(url: Column, title: Column, content: Column, low: Column | None = None) -> Column:
    """``low``, here and below: the content in lower case, where it is at hand."""
    low = F.lower(content) if low is None else low
    return holds(url, ("youtube.com/", "youtu.be/")) | holds(title, ("youtube",)) | has(low, (" - youtube", "youtube.com/watch"))


def thin_shell(content: Column, low: Column | None = None) -> Column:
    return F.coalesce((F.length(content) < THIN) & (content != ""), F.lit(False)) & has(F.lower(content) if low is None else low, SHELLS)


def article_like(url: Column, title: Column, content: Column, low: Column | None = None) -> Column:
    text, low = F.coalesce(content, F.lit("")), F.lower(content) if low is None else low
    long = (F.length(text) >= 1200) | ((F.length(text) >= 700) & (F.regexp_count(text, F.lit(SENTENCE_END)) >= 6))
    found = long | holds(title, (*ARTICLE_TITLES, *ARTICLE_WORDS)) | holds(T.host(url), ARTICLE_HOSTS) | has(low, (*ARTICLE_WORDS, *ARTICLE_TEXTS))
    return found & ~video_like(url, title, content, low) & ~github(url)


def name_form(c: Column) -> Column:
    """What a name, or a text, is compared by; what ``entity_name`` puts right is no letter or digit, so it makes no difference here."""
    return T.match_form(F.coalesce(c, F.lit("")))


def evidence_form(c: Column) -> Column:
    """The same of a quotation, whose quotes don't part words."""
    return T.match_form(F.regexp_replace(F.coalesce(c, F.lit("")), QUOTES, ""))


def anchored(name: Column, *texts: Column) -> Column:
    """Whether a name occurs in any of ``texts`` as words, letters and digits alone compared; an empty name occurs nowhere."""
    needle = name_form(name)
    return (needle != "") & reduce(or_, [F.contains(name_form(t), needle) for t in texts])


def evidence_anchored(evidence: Column, *texts: Column) -> Column:
    """The same of a quotation, which has to have 16 characters."""
    needle = evidence_form(evidence)
    return F.coalesce((F.length(needle) >= 16) & reduce(or_, [F.contains(evidence_form(t), needle) for t in texts]), F.lit(False))


def kinds(docs: DataFrame) -> DataFrame:
    """``docs`` with github, article, thin (a page around a video without its text) and low, the content in lower case."""
    url, title, content, low = F.col("url"), F.col("title"), F.col("content"), F.col("low")
    d = docs.withColumn("low", F.lower(content))
    return d.withColumns({"github": github(url), "article": article_like(url, title, content, low), "thin": video_like(url, title, content, low) & thin_shell(content, low)})


#: What ``known`` adds: kinds of a document, and the forms in which names and quotations are looked for in it.
TEXTS, QUOTED = ("title", "url", "content", "more"), ("title", "content", "more")
FACTS = ("low", "github", "article", "thin", *[f"form_{t}" for t in TEXTS], *[f"quote_{t}" for t in QUOTED])


def known(docs: DataFrame) -> DataFrame:
    """``docs`` with FACTS, which the rules below make of each relationship's document unless they are there."""
    d = kinds(docs).withColumn("more", F.when(F.col("github"), F.coalesce("summary", F.lit(""))).otherwise(""))
    read = {t: F.col("low" if t == "content" else t) for t in TEXTS}
    d = d.withColumns({f"form_{t}": name_form(read[t]) for t in TEXTS})
    # without quotes in a text its two forms are one
    d = d.withColumns({f"quote_{t}": F.when(read[t].rlike(QUOTES), evidence_form(read[t])).otherwise(F.col(f"form_{t}")) for t in QUOTED})
    return d.select(*docs.columns, *FACTS)


def _known(df: DataFrame) -> DataFrame:
    return df if set(FACTS) <= set(df.columns) else known(df)


def _given() -> Column:
    return F.coalesce(F.col("evidence") != "", F.lit(False))


def _backed(words: tuple[str, ...]) -> Column:
    """Whether the evidence, or without any the text, holds one of ``words``."""
    return F.when(_given(), holds(F.col("evidence"), words)).otherwise(has(F.col("low"), words))


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` with ``drop`` (why a relationship can't stand in its document; null: it stands) and the predicate put right.

    Of several reasons the first counts: generic actor, occupation, media, and on code hosts no person, install, host,
    package. There somebody who built a tool didn't found it: FOUNDED becomes DEVELOPS where the text says so.
    """
    d = _known(df)
    people = lambda t, n: F.col(t).isin("Person", "Organization") & T.generic_actor(F.col(n))
    formal = F.col("predicate").isin(*FORMAL)
    nobody = lambda t, n: (F.col(t) == "Person") & ~T.human_name(F.col(n))
    tool = F.col("object_type").isin("Tool", "Model", "Dataset", "Project")
    drop = (
        F.when(people("subject_type", "subject") | people("object_type", "object"), "generic actor")
        .when(formal & (F.col("object_type") == "Organization") & occupation(F.col("object")), "occupation")
        .when((F.col("predicate") == "CREATED") & F.col("article") & (F.col("object_type") == "Artwork") & generic_media(F.col("object")) & holds(F.col("evidence"), MEDIA_MAKING), "media")
        .when(F.col("github") & (nobody("subject_type", "subject") | nobody("object_type", "object")), "no person")
        .when(F.col("github") & F.col("predicate").isin("INTEGRATES_WITH", "HOSTED_ON") & _backed(INSTALLED), "install")
        .when(F.col("github") & (F.col("predicate") == "HOSTED_ON") & (F.col("object_type") == "Organization") & (T.match_form(F.col("object")) == "github"), "host")
        .when(F.col("github") & (F.lower("object").endswith("/tap") | F.col("object").rlike(r"(?i)\bhomebrew\b")), "package")
    )
    built = F.col("github") & (F.col("predicate") == "FOUNDED") & (F.col("subject_type") == "Person") & tool & ~_backed(FOUNDED) & _backed(DEVELOPED)
    out = d.withColumns({"drop": drop, "predicate": F.when(built, "DEVELOPS").otherwise(F.col("predicate"))})
    return out.select(*df.columns, "drop")


def low_value(df: DataFrame, need_evidence: bool | Column = False) -> DataFrame:
    """``df`` with ``reason``: why a relationship is worth little; null: it is kept. The first rule that decides counts.

    A reported claim whose ends occur in the document is kept whatever the later rules say.
    """
    needles = {f"needle_{c}": name_form(F.col(c)) for c in ("subject", "object")} | {"needle_quote": evidence_form(F.col("evidence"))}
    d = _known(df).withColumns(needles)
    occurs = lambda needle, *texts: reduce(or_, [F.contains(t, F.col(needle)) for t in texts])
    anchored_ = lambda c: (F.col(f"needle_{c}") != "") & occurs(f"needle_{c}", *[F.col(f"form_{t}") for t in TEXTS])
    quoted = (F.length("needle_quote") >= 16) & occurs("needle_quote", *[F.col(f"quote_{t}") for t in QUOTED])
    signal, given = F.lit(True), _given()
    for predicate, words in FORMAL.items():
        signal = F.when(F.col("predicate") == predicate, has(F.col("low"), words)).otherwise(signal)
    reason = (
        F.when(~anchored_("subject"), "subject not in document").when(~anchored_("object"), "object not in document")
        .when(F.col("thin"), "thin video page").when(F.coalesce(F.col("claim_mode") == "reported", F.lit(False)), None)
        .when(~signal, "no formal signal").when((F.col("predicate") == "DEVELOPS") & ~_backed(DEVELOPED), "no sign of development")
        .when(given & (F.col("article") | F.col("github")) & ~quoted, "evidence not in document")
        .when((F.col("predicate") == "FOUNDED") & ~_backed(FOUNDED), "no sign of founding")
        .when((F.col("predicate") == "OWNS") & ~_backed(OWNED), "no sign of ownership")
        .when((need_evidence if isinstance(need_evidence, Column) else F.lit(need_evidence)) & ~(given & quoted), "no evidence")
        .when(F.col("subject_type").isin("Tool", "Model") & (F.col("predicate") == "USES") & F.col("subject").rlike(NO_USERS), "no user")
    )
    return d.withColumn("reason", reason).select(*df.columns, "reason")
